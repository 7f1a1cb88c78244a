from feedloom.streaming import ingest


def test_stream_into_the_store(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "store")
    kind = "seq bigint, link string, title string"
    write = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(kind).parquet(source)
    write([(1, "a", "first"), (2, "a", "again"), (3, "b", "x")])
    run = lambda: ingest.ingest(stream(), root, str(tmp_path / "ck"), "seq").trigger(availableNow=True).start().awaitTermination()
    run()
    write([(4, "a", "later"), (5, "c", "y")])
    run()
    got = {r["link"]: r["title"] for r in ingest.current(spark, root).collect()}
    assert got == {"a": "first", "b": "x", "c": "y"}
    assert ingest.current(spark, str(tmp_path / "none")) is None


def _batch(spark, *rows):
    return spark.createDataFrame(rows, "seq bigint, link string, title string")


def _links(spark, root):
    return sorted((r["link"], r["title"]) for r in ingest.current(spark, root).collect())


def test_a_batch_that_is_run_again(spark, tmp_path):
    import shutil

    root = str(tmp_path / "store")
    work = ingest.insert_new(root, "seq")
    work(_batch(spark, (1, "a", "first"), (2, "a", "again")), 0)
    work(_batch(spark, (1, "a", "first"), (2, "a", "again")), 0)
    assert _links(spark, root) == [("a", "first")]
    work(_batch(spark, (3, "a", "later"), (4, "b", "x")), 1)
    # killed between the write of the part and its marker
    (tmp_path / "store" / "v=1" / "_SUCCESS").unlink()
    assert _links(spark, root) == [("a", "first")]
    work(_batch(spark, (3, "a", "later"), (4, "b", "x")), 1)
    assert _links(spark, root) == [("a", "first"), ("b", "x")]
    assert spark.read.parquet(f"{root}/v=1").count() == 1  # only what is new is written
    # folded, also if the old parts were not deleted
    shutil.copytree(f"{root}/v=0", f"{tmp_path}/kept")
    ingest.compact(spark, root)
    assert ingest.parts(spark, root) == [(0, 1)]
    shutil.copytree(f"{tmp_path}/kept", f"{root}/v=0")
    assert ingest.parts(spark, root) == [(0, 1)] and _links(spark, root) == [("a", "first"), ("b", "x")]
    work(_batch(spark, (9, "z", "none")), 1)  # in the folded part already
    work(_batch(spark, (5, "b", "no"), (6, "c", "y")), 2)
    assert _links(spark, root) == [("a", "first"), ("b", "x"), ("c", "y")]
