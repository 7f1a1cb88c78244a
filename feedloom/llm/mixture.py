"""Mix sources to target shares of a total size, each document repeated a capped number of times.

Documents are aggregated by membership pattern (the set of sources a document belongs to), so that the flow network
has a node for each pattern and repetition and one for each source, whatever the number of documents. A min-cost flow
routes token capacity to the quotas of the sources; the cost of the r-th repetition of a document rises with r. The
flow becomes ranges of a seeded hash of the documents, and the final pass over the texts only compares hashes.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.llm import bpe
from feedloom.llm.site_lines import digest
from feedloom.session import cut


class Network:
    """Directed arcs with integer capacities and costs; flow by cheapest augmenting paths."""

    def __init__(self):
        self.head: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = {}

    def arc(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for u, v, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out.setdefault(u, []).append(len(self.head))
            self.head.append(v)
            self.room.append(r)
            self.cost.append(c)
        return len(self.head) - 2

    def used(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def run(self, source: int, sink: int, most: int) -> int:
        """Send up to `most` from source to sink at the least cost; what was sent."""
        sent = 0
        while sent < most:
            far, via, queue, waiting = {source: 0}, {}, deque([source]), {source}
            while queue:
                u = queue.popleft()
                waiting.discard(u)
                for e in self.out.get(u, ()):
                    if self.room[e] > 0 and far[u] + self.cost[e] < far.get(v := self.head[e], 1 << 60):
                        far[v], via[v] = far[u] + self.cost[e], e
                        if v not in waiting:
                            waiting.add(v)
                            queue.append(v)
            if sink not in via:
                break
            path, v = [], sink
            while v != source:
                path.append(via[v])
                v = self.head[via[v] ^ 1]
            step = min([most - sent, *(self.room[e] for e in path)])
            for e in path:
                self.room[e] -= step
                self.room[e ^ 1] += step
            sent += step
        return sent


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeats: int


def route(patterns: dict[tuple[str, ...], int], targets: list[Target], size: int, fill: bool = False) -> dict[tuple[tuple[str, ...], int, str], int]:
    """Tokens of each (pattern, repetition, source): what source takes of the r-th pass over a pattern.

    The quota of a source is its share of `size`. Where a source can't fill its quota, the total stays below `size`,
    since tokens of other sources would take these further from their shares. With `fill` all quotas are raised by
    the least common factor at which the total is reached (or all capacity is used). Sources without documents get
    nothing. Total and capacity are never exceeded.
    """
    targets = [t for t in targets if t.share > 0 and t.max_repeats > 0]

    def flow(factor: float) -> tuple[int, dict]:
        net, start, end = Network(), 0, 1
        node = {t.source: 2 + i for i, t in enumerate(targets)}
        arcs, n = {}, 2 + len(targets)
        for t in targets:
            net.arc(node[t.source], end, min(size, int(factor * t.share * size)))
        for p, tokens in patterns.items():
            own = [t for t in targets if t.source in p]
            for r in range(1, 1 + max((t.max_repeats for t in own), default=0)):
                net.arc(start, n, tokens, r * r)
                for t in own:
                    if r <= t.max_repeats:
                        arcs[p, r, t.source] = net.arc(n, node[t.source], tokens)
                n += 1
        sent = net.run(start, end, size)
        return sent, {k: net.used(a) for k, a in arcs.items() if net.used(a)}

    low, high = 1.0, 1.0
    sent, best = flow(1.0)
    if not fill:
        return best
    most, _ = flow(float(1 << 30))
    slack = len(targets) + 1  # quotas are whole tokens
    while sent < most - slack and high < 1 << 30:
        low, high = high, high * 2
        sent, best = flow(high)
    for _ in range(40):
        if high - low < 1e-9 * high:
            break
        mid = (low + high) / 2
        got, at = flow(mid)
        if got >= most - slack:
            high, best = mid, at
        else:
            low = mid
    return best


def order_of(key: Column, seed: int) -> Column:
    """Place of a document in the seeded order."""
    return F.xxhash64(F.lit(seed), key)


def measured(docs: DataFrame, key: str, sources: str, text: str, vocabulary: str, seed: int, by_text: bool = False) -> DataFrame:
    """(pattern, place, n): sorted distinct sources, place in the seeded order and tokens of each document.

    Documents of no source have the empty pattern: they count for the size of the corpus and are never taken. With
    `by_text` a document belongs to the sources of all documents that have its text; texts meet as digests.
    """
    if by_text:
        return _by_text(docs, key, sources, text, vocabulary, seed)
    x = docs.select(F.coalesce(F.array_sort(F.array_distinct(F.array_compact(F.col(sources)))), F.array().cast("array<string>")).alias("pattern"), order_of(F.col(key), seed).alias("place"), F.col(text).alias("body"))
    x = bpe.encode_column(x.where("length(body) > 0"), "body", "n", vocabulary, count_only=True)
    return cut(x.select("pattern", "place", "n").where("n > 0"))


def _by_text(docs: DataFrame, key: str, sources: str, text: str, vocabulary: str, seed: int) -> DataFrame:
    own = F.coalesce(F.array_distinct(F.array_compact(F.col(sources))), F.array().cast("array<string>"))
    x = docs.select(own.alias("own"), order_of(F.col(key), seed).alias("place"), digest(F.col(text)).alias("doc"), F.col(text).alias("body"))
    x = cut(bpe.encode_column(x.where("length(body) > 0"), "body", "n", vocabulary, count_only=True).select("own", "place", "doc", "n").where("n > 0"))
    # a text has at most as many sources as there are; those of one source only are left out of the join
    some = x.select("doc", F.explode("own").alias("s")).distinct().groupBy("doc").agg(F.array_sort(F.collect_list("s")).alias("all")).where("size(all) > 1")
    return x.join(some, "doc", "left").select(F.coalesce("all", F.array_sort("own")).alias("pattern"), "place", "n")


#: More patterns than this are refused: their sums come to the driver, and the flow has a node for each.
MOST_PATTERNS = 100_000
#: Long documents up to this number are broadcast.
BROADCAST = 1 << 20


def _totals(sizes: DataFrame) -> dict[tuple[str, ...], int]:
    rows = sizes.groupBy("pattern").agg(F.sum("n").alias("total")).limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of membership")
    return {tuple(r["pattern"]): r["total"] for r in rows}


def _mixes(targets: DataFrame) -> dict[int, tuple[list[Target], float]]:
    """The targets and the size factor of each mixture."""
    out: dict[int, tuple[list[Target], float]] = {}
    for r in sorted(targets.where("source IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL").collect(), key=lambda r: (r["mix_id"], r["source"])):
        out.setdefault(r["mix_id"], ([], r["size_factor"]))[0].append(Target(r["source"], r["target_share"], r["max_repeats"]))
    return out


POLICY = "mix_id int, policy string, asked bigint, tokens bigint, shortfall double, max_deviation double"


def policies(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, policy, asked, tokens, shortfall, max_deviation): what each way to treat scarce sources comes to.

    'nearest' gives each source its part of the size asked for, or all it has; this is what `plan` does. 'size' raises
    all parts until the size is reached. 'shares' lowers the size until every source that has documents keeps its
    share. The shortfall is the part of the size that is not reached, the deviation that of a source's share of what
    is reached from its target, the largest of a mixture.
    """
    totals, rows = _totals(sizes), []
    corpus = sum(totals.values())
    for mix, (goals, factor) in _mixes(targets).items():
        size = int(factor * corpus)
        parts = {p: n for p, n in totals.items() if {t.source for t in goals} & set(p)}
        full: dict[str, int] = {}
        for (_, _, s), n in route(parts, goals, size).items():
            full[s] = full.get(s, 0) + n
        held = min((n / (t.share * size) for t in goals for n in [full.get(t.source, 0)] if n and t.share > 0), default=0.0) if size else 0.0
        for policy, wanted, fill in (("nearest", size, False), ("size", size, True), ("shares", int(min(1.0, held) * size), False)):
            got: dict[str, int] = {}
            for (_, _, s), n in route(parts, goals, wanted, fill).items():
                got[s] = got.get(s, 0) + n
            total = sum(got.values())
            off = max((abs(got.get(t.source, 0) / total - t.share) for t in goals), default=0.0) if total else 0.0
            rows.append((mix, policy, size, total, 1 - total / size if size else 0.0, off))
    return sizes.sparkSession.createDataFrame(rows, POLICY)


#: Slices of the seeded order; only those that hold the end of a range are ordered exactly.
SLICES = 4096
#: A document is long if it has more than this part of the tokens of its pattern; so there are at most as many.
LONG = 1024
RANGE = "mix_id int, pattern array<string>, copy int, source string, size string, low bigint, high bigint"
FLOOR, CEILING = -(1 << 63), (1 << 63) - 1


def _choose(long: list[tuple[int, int]], short: int, wanted: int) -> tuple[list[tuple[int, int]], int]:
    """Of the long documents (place, tokens) in seeded order those to take, and the tokens left for short ones.

    Long ones get their proportional part of `wanted`; one that would overshoot is passed over for the next.
    """
    goal = wanted * sum(n for _, n in long) / max(1, short + sum(n for _, n in long))
    taken, have = set(), 0
    for limit in (goal, wanted):
        for place, n in long:
            if place not in taken and have + n / 2 <= limit and (limit == goal or wanted - have > short):
                taken.add(place)
                have += n
    return [x for x in long if x[0] in taken], max(0, min(short, wanted - have))


def _cuts(short: DataFrame, wanted: list[tuple]) -> list[tuple]:
    """(pattern, cut, place): the place at which the short documents before it have `cut` tokens.

    A document lies before a cut if its middle does, so that the error is half a short document.
    """
    spark = short.sparkSession
    cuts = spark.createDataFrame(wanted, "pattern array<string>, cut bigint")
    part = F.shiftright("place", 52).alias("part")
    sums = short.groupBy("pattern", part).agg(F.sum("n").alias("n"))
    before = Window.partitionBy("pattern").orderBy("part")  # SLICES rows of a pattern at most
    sums = sums.withColumn("start", F.sum("n").over(before) - F.col("n"))
    at = sums.join(F.broadcast(cuts), "pattern").where("cut >= start AND cut <= start + n").groupBy("pattern", "cut").agg(F.max(F.struct("part", "start")).alias("at")).select("pattern", "cut", "at.part", "at.start")
    near = at.select("pattern", "part", "start").distinct()
    inside = short.withColumn("part", part).join(near, ["pattern", "part"])
    order = Window.partitionBy("pattern", "part").orderBy("place")
    middle = inside.withColumn("mid", F.col("start") + F.sum("n").over(order) - F.col("n") / 2)
    last = middle.join(at.drop("start"), ["pattern", "part"]).where("mid < cut").groupBy("pattern", "cut").agg(F.max("place").alias("last"))
    got = at.join(last, ["pattern", "cut"], "left").collect()  # a row for each cut
    # where no document of the slice lies before the cut, the cut is where the slice begins
    return [(tuple(r["pattern"]), r["cut"], r["part"] << 52 if r["last"] is None else r["last"] + 1) for r in got]


def plan(docs: DataFrame, targets: DataFrame, key: str, sources: str, text: str, vocabulary: str, seed: int = 42, by_text: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ranges of the mixtures, the measured documents (pattern, place, n, size) and the places of long ones.

    Only sums by pattern, at most LONG long documents of each and the targets come to the driver; patterns are bounded
    by MOST_PATTERNS. Null and empty texts have no tokens; documents of no source count for the total only. Targets with a
    null source, share or cap count as absent. Empty tables give empty mixtures. For `by_text` see `measured`.
    """
    spark = docs.sparkSession
    sizes = measured(docs, key, sources, text, vocabulary, seed, by_text)
    if by_text:
        sizes = cut(sizes)
    totals = _totals(sizes)
    sums = sizes.groupBy("pattern").agg(F.sum("n").alias("total"))
    sizes = sizes.join(sums, "pattern").select("pattern", "place", "n", F.when(F.col("n") * LONG > F.col("total"), "long").otherwise("short").alias("size"))
    long: dict[tuple, list] = {}
    for r in sizes.where("size = 'long' AND size(pattern) > 0").select("pattern", "place", "n").collect():
        long.setdefault(tuple(r["pattern"]), []).append((r["place"], r["n"]))
    docs_tokens = sum(totals.values())
    rows, wanted = [], []
    for mix, (goals, factor) in _mixes(targets).items():
        parts = {p: n for p, n in totals.items() if {t.source for t in goals} & set(p)}
        left: dict = {}
        for (p, r, s), n in sorted(route(parts, goals, int(factor * docs_tokens)).items()):
            if n == totals[p]:
                rows.append((mix, list(p), r, s, "all", FLOOR, CEILING))
                continue
            free, begin = left.get((p, r)) or (sorted(long.get(p, ())), 0)
            short = totals[p] - sum(x for _, x in long.get(p, ()))
            took, rest = _choose(free, short - begin, n)
            rows += [(mix, list(p), r, s, "long", place, place + 1) for place, _ in took]
            wanted.append((mix, p, r, s, begin, begin + rest, short))
            left[p, r] = ([x for x in free if x not in took], begin + rest)
    cuts = {(p, c) for _, p, _, _, a, b, short in wanted for c in (a, b) if 0 < c < short}
    at = {(p, c): place for p, c, place in _cuts(sizes.where("size = 'short'"), [(list(p), c) for p, c in cuts])} if cuts else {}
    for mix, p, r, s, a, b, short in wanted:
        low, high = (FLOOR if c <= 0 else CEILING if c >= short else at.get((p, c), FLOOR) for c in (a, b))
        rows.append((mix, list(p), r, s, "short", low, high))
    ends = [(list(p), place) for p, x in long.items() for place, _ in x]
    return spark.createDataFrame(rows, RANGE), sizes, spark.createDataFrame(ends, "pattern array<string>, place bigint")


def _hit(rows: str) -> Column:
    same = (F.col(f"{rows}.pattern") == F.col("m.pattern")) & ((F.col("m.size") == "all") | (F.col("m.size") == F.col(f"{rows}.size")))
    return same & (F.col(f"{rows}.place") >= F.col("m.low")) & (F.col(f"{rows}.place") < F.col("m.high"))


def mixture(docs: DataFrame, ranges: DataFrame, long: DataFrame, key: str, sources: str, seed: int = 42) -> DataFrame:
    """Columns of `docs` as struct `d` with mix_id, mix_source and copy (from 1), a row for each use of a document.

    The ranges and the long documents were made on the driver and are broadcast, the long ones up to BROADCAST of them;
    the texts are not shuffled.
    """
    marked = long.withColumn("is_long", F.lit(True))
    marked = F.broadcast(marked) if long.limit(BROADCAST + 1).count() <= BROADCAST else marked
    pattern = F.array_sort(F.array_distinct(F.array_compact(F.col(sources))))
    x = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("d"), pattern.alias("pattern"), order_of(F.col(key), seed).alias("place"))
    x = x.join(marked, ["pattern", "place"], "left")
    x = x.select("d", "pattern", "place", F.when(F.col("is_long"), "long").otherwise("short").alias("size"))
    return x.alias("x").join(F.broadcast(ranges.alias("m")), _hit("x")).select("x.d", F.col("m.mix_id").alias("mix_id"), F.col("m.source").alias("mix_source"), F.col("m.copy").alias("copy"))


def shares(ranges: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, share_of_size, actual_share, reachable, deviation, tokens, documents, copies, top_copy).

    share_of_size is relative to the size asked for, actual_share to the size reached; reachable is the target or what
    all documents of the source come to, repeated as often as they may be; deviation is share_of_size less reachable.
    """
    used = sizes.alias("s").join(F.broadcast(ranges.alias("m")), _hit("s"))
    used = used.groupBy("mix_id", "source", "copy").agg(F.sum("n").alias("n"), F.count("*").alias("k")).groupBy("mix_id", "source").agg(F.sum("n").alias("tokens"), F.max("k").alias("documents"), F.sum("k").alias("copies"), F.max("copy").alias("top_copy"))
    all_tokens = used.groupBy("mix_id").agg(F.sum("tokens").alias("all_tokens"))
    has = sizes.groupBy("pattern").agg(F.sum("n").alias("n")).select(F.explode("pattern").alias("source"), "n").groupBy("source").agg(F.sum("n").alias("has"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    out = targets.join(used, ["mix_id", "source"], "left").join(all_tokens, "mix_id", "left").join(has, "source", "left")
    out = out.crossJoin(sizes.agg(F.sum("n").alias("corpus")))  # one row
    size = F.col("size_factor") * F.col("corpus")
    asked = F.coalesce(F.col("tokens") / size, F.lit(0.0))
    actual = F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share")
    most = F.least(F.col("target_share"), F.coalesce(F.col("has") * F.col("max_repeats") / size, F.lit(0.0)))
    return out.select("mix_id", "source", "target_share", asked.alias("share_of_size"), actual, most.alias("reachable"), (asked - most).alias("deviation"), *map(zero, ("tokens", "documents", "copies", "top_copy")))
