from pyspark.sql import functions as F

from feedloom.operators import deliveries as D

KIND = "entry_id bigint, guid string, link string, feed string, wide_payload string, file string"


def table(spark, tmp_path, rows, parts=3):
    path = str(tmp_path / "entries.parquet")
    spark.createDataFrame(rows, KIND).repartition(parts).write.parquet(path)
    return path


ROWS = [
    (1, "a", "l1", "f", "x", "clash"),
    (2, " a\n", "l2", "f", "y", None),  # the same but for white space at its ends
    (3, "A", "l1", "f", "x", None),  # letter case counts
    (4, "a", "l1", "g", "x", None),  # another feed
    (5, None, "l9", "f", "x", None),
    (6, "  ", "l9", "f", "x", None),
    (7, " 　", "l9", "f", "x", None),
    (8, None, None, "f", "x", None),
    (9, "", " ", "f", "x", None),
    (10, None, "l9", None, "x", None),
    (11, None, "l9", None, "x", None),
]


def test_copies(spark, tmp_path):
    path = table(spark, tmp_path, ROWS)
    got = {tuple(r) for r in D.pairs(spark, path).collect()}
    assert got == {(1, 2), (5, 6), (5, 7), (6, 7), (10, 11)}
    kept = D.keep_one(spark, path)
    assert sorted(r["entry_id"] for r in kept.collect()) == [1, 3, 4, 5, 8, 9, 10]
    some = D.keep_one(spark, path, ["link", "entry_id"])
    assert some.schema.names == ["link", "entry_id"] and sorted(r["entry_id"] for r in some.collect()) == [1, 3, 4, 5, 8, 9, 10]
    other = D.keep_one_anywhere(spark, path)
    assert other.schema.names == kept.schema.names and sorted(map(str, other.collect())) == sorted(map(str, kept.collect()))
    assert kept.schema.names == KIND.replace(" bigint", "").replace(" string", "").split(", ")


def test_hot_message_and_row_groups(spark, tmp_path):
    rows = [(i, "hot" if i % 3 == 0 else f"g{i}", None, "f", "x", None) for i in range(3000)]
    path = table(spark, tmp_path, rows, 5)
    kept = {r["entry_id"] for r in D.keep_one(spark, path).select("entry_id").collect()}
    assert kept == {i for i in range(3000) if i % 3 or i == 0}
    assert D.groups(spark, path).select("copies").collect()[0][0] == 1000


def test_repeated_rows_and_empty_table(spark, tmp_path):
    path = table(spark, tmp_path, [(1, "a", "l", "f", "x", None)] * 4)
    assert D.keep_one(spark, path).count() == 1 and D.keep_one_anywhere(spark, path).count() == 1 and D.pairs(spark, path).count() == 0
    empty = str(tmp_path / "none.parquet")
    spark.createDataFrame([], KIND).write.parquet(empty)
    assert D.keep_one(spark, empty).count() == 0 and D.pairs(spark, empty).count() == 0


def test_payload_is_not_shuffled(spark, tmp_path):
    path = table(spark, tmp_path, ROWS)
    plan = D.deletion_vectors(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "wide_payload" not in plan
    assert D.keep_one(spark, path).where(F.col("wide_payload") == "y").count() == 0
