"""Personal information over tables: candidates and votes of all texts, reliabilities from all of them, decisions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.pii import KINDS, Finder, Gazetteer, Model, redact
from feedloom.session import cut

#: A gazetteer beyond this size is refused: it goes to every worker.
MOST_PARTS = 200_000

_SPAN = "kind string, start_pos bigint, end_pos bigint, votes string"


def gazetteer(parts: DataFrame) -> Gazetteer:
    """From (name_part, part_kind, lang)."""
    rows = parts.select("name_part", "part_kind", "lang").limit(MOST_PARTS + 1).collect()
    if len(rows) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} name parts")
    return Gazetteer.of(sorted(tuple(r) for r in rows if r[0] and r[1]))


def candidates(df: DataFrame, text: str, g: Gazetteer, out: str) -> DataFrame:
    """Replace `text` by `out` ARRAY<STRUCT<kind, start_pos, end_pos, votes>>: the candidates of each text with their votes.

    Null and empty texts have none. Each text is read whole; rows and other columns pass through.
    """
    fields = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.StructType.fromDDL(_SPAN)))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("votes", pa.string())]))
    shared = df.sparkSession.sparkContext.broadcast(g)  # bounded by MOST_PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, codes = Finder(shared.value), {}

        def coded(votes: tuple[int, ...]) -> str:
            if votes not in codes:
                codes[votes] = ",".join(map(str, votes))
            return codes[votes]

        for b in batches:
            at = b.schema.get_field_index(text)
            new = pa.array([[{"kind": s.kind, "start_pos": s.start, "end_pos": s.end, "votes": coded(s.votes)} for s in finder.candidates(t)] if t else [] for t in b.column(at).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(b.columns) if i != at], new], names=schema.names)

    return df.mapInArrow(run, schema)


def _model(spans: DataFrame) -> tuple[dict[str, Counter], Model]:
    """Fit on how often each pattern of votes occurs (kind, votes): at most 3 to the power of labellers for each kind."""
    got: dict[str, Counter] = {k: Counter() for k in KINDS}
    for r in spans.groupBy("kind", "votes").count().collect():
        got[r["kind"]][tuple(map(int, r["votes"].split(",")))] += r["count"]
    got = {k: Counter(dict(sorted(c.items()))) for k, c in got.items()}
    return got, Model(got)


def fit(docs: DataFrame, text: str, parts: DataFrame) -> Finder:
    """Estimate the labellers and train the span classifier on the votes for all candidates of all texts."""
    g = gazetteer(parts)
    x = candidates(docs.select(F.col(f"`{text}`").alias("t")), "t", g, "c")
    return Finder(g, _model(x.select(F.explode_outer("c").alias("c")).where("c IS NOT NULL").select("c.kind", "c.votes"))[1])


def found(docs: DataFrame, key: str, text: str, parts: DataFrame) -> DataFrame:
    """(key, kind, start_pos, end_pos) of each place of personal information; texts are read once.

    The candidates of all texts, which are far smaller than the texts, are written with their votes; the patterns of
    votes are counted, the model is fitted on the counts, and what it says of each pattern decides over the
    candidates. Positions are as in `with_pii`, and so are the places.
    """
    spark = docs.sparkSession
    x = cut(candidates(docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")), "t", gazetteer(parts), "c").where("size(c) > 0"))
    flat = x.select(F.explode("c").alias("c")).select("c.kind", "c.votes")
    counted, model = _model(flat)
    good = [f"{k}:{','.join(map(str, v))}" for k, votes in counted.items() for v in votes if model.says(k, v)]
    if not good:
        return x.where("false").select(F.col("k").alias(key), *[F.lit(None).cast(t).alias(n) for n, t in (("kind", "string"), ("start_pos", "bigint"), ("end_pos", "bigint"))])
    kept = F.filter("c", lambda y: F.concat_ws(":", y["kind"], y["votes"]).isin(good))
    kept = F.array_sort(F.transform(kept, lambda y: F.struct(y["start_pos"].alias("start_pos"), (-y["end_pos"]).alias("till"), y["kind"].alias("kind"))))
    reach = lambda s: F.aggregate(s, F.lit(0).cast("bigint"), lambda a, y: F.greatest(a, -y["till"]))
    x = x.select("k", kept.alias("s"))
    # candidates overlap in few texts only; of overlapping ones the first stays
    plain = F.forall(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.get("s", i)["start_pos"] >= -F.get("s", i - 1)["till"])
    none = F.array().cast("array<struct<start_pos:bigint,till:bigint,kind:string>>")
    apart = F.aggregate("s", none, lambda acc, y: F.when(y["start_pos"] >= reach(acc), F.concat(acc, F.array(y))).otherwise(acc))
    x = x.where("size(s) > 0").select("k", F.explode(F.when((F.size("s") < 2) | plain, F.col("s")).otherwise(apart)).alias("s"))
    return x.select(F.col("k").alias(key), "s.kind", "s.start_pos", (-F.col("s.till")).alias("end_pos"))


def with_pii(df: DataFrame, text: str, finder: Finder, out: str) -> DataFrame:
    """Add `out` STRUCT<spans ARRAY<STRUCT<kind, start_pos, end_pos>>, text STRING>.

    Positions count code points from 0, the end is the first after a span; spans are in order and do not overlap. The
    text has a typed placeholder in the stead of each. Null texts have no spans and stay null. Each text is read whole;
    rows and other columns pass through.
    """
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType())])
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StructType([T.StructField("spans", T.ArrayType(span)), T.StructField("text", T.StringType())]))])
    kind = pa.struct([("spans", pa.list_(pa.struct([("kind", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64())]))), ("text", pa.string())])
    shared = df.sparkSession.sparkContext.broadcast(finder)  # bounded by MOST_PARTS and the patterns of votes

    def one(t: str | None) -> dict:
        got = shared.value.find(t)
        return {"spans": [{"kind": k, "start_pos": a, "end_pos": b} for k, a, b in got], "text": redact(t, got) if got else t}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([one(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, new], names=schema.names)

    return df.mapInArrow(run, schema)
