"""Rules for URLs: load a list, and tell which URLs it blocks.

Rules have a kind (exception, prefix, domain, wildcard, regex), a scheme and ordered fragments. A URL is blocked if no
exception holds and a prefix, domain or wildcard rule does. Small lists are matched as a broadcast of the rules; lists
of any size by an equi-join on the first five characters of a fragment with the five-character windows of the URL, after
which only candidate pairs are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of the key by which rules are found; rules with less are only matched by texts with less.
KEY = 5
#: Up to so many rules are compared with each URL; more are joined by key, so that a URL meets only those it may match.
FEW = 200
#: Up to so many rules the keyed ones are sent to all tasks, so that no window of a URL is exchanged.
BROADCAST = 200_000
#: Regular expressions have no key; more than these are an error.
REGEXES = 1_000


def load(lines: DataFrame, column: str = "value", order: str = "line_no") -> DataFrame:
    """Rules from the lines of a list (order, column); comments, headers and blank lines go.

    The first test that holds decides, in the order of the list below. Null lines are blank.
    """
    t = F.trim(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"^[\s﻿]+|\s+$", ""))
    kind = (
        F.when(t.startswith("||"), "domain")
        .when(t.startswith("!"), None)
        .when(t.startswith("|"), "prefix")
        .when(t.startswith("@@||"), "exception")
        .when(t.startswith("["), None)
        .when(t.startswith("/") & t.endswith("/") & (F.length(t) > 1), "regex")
        .when(t == "", None)
        .otherwise("wildcard")
    )
    x = lines.select(F.col(order).alias("rule_id"), t.alias("t"), kind.alias("kind")).where("kind IS NOT NULL")
    cut = {"domain": 3, "prefix": 2, "exception": 5, "regex": 2}
    body = F.when(F.col("kind") == "regex", F.expr("substr(t, 2, length(t) - 2)"))
    for k, at in cut.items():
        if k != "regex":
            body = body.when(F.col("kind") == k, F.expr(f"substr(t, {at})"))
    x = x.withColumn("body", body.otherwise(F.col("t")))
    plain = F.col("kind").isin("domain", "exception")
    at = F.instr("body", "://")
    schemed = ~plain & (F.col("kind") != "regex") & (at > 0)
    x = x.withColumn("scheme", F.when(schemed, F.expr("substr(body, 1, instr(body, '://') - 1)")).when(F.col("kind").isin("prefix", "wildcard"), "http"))
    rest = F.btrim(F.when(schemed, F.expr("substr(body, instr(body, '://') + 3)")).otherwise(F.col("body")), F.lit("*"))
    fields = F.when(plain, F.array(F.btrim("body", F.lit("*")))).when(F.col("kind") == "regex", F.array("body")).otherwise(F.filter(F.split(rest, r"\*"), lambda f: f != ""))
    return x.withColumn("fields", fields).withColumn("sep", F.get("fields", F.lit(0))).where("length(sep) > 0").select("rule_id", "kind", "scheme", "sep", "fields")


def url_parts(url: Column) -> Column:
    """Scheme, host (with port and user) and the rest behind the scheme; no scheme is an empty one."""
    at = F.instr(url, "://")
    scheme = F.when(at > 0, F.substring_index(url, "://", 1)).otherwise("")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(url)
    return F.struct(scheme.alias("scheme"), F.substring_index(rest, "/", 1).alias("host"), rest.alias("rest"))


def in_order(text: Column, fields: Column, anchored: bool) -> Column:
    """The fragments stand in the text one after the other, the first at its start if anchored."""
    escaped = F.transform(fields, lambda f: F.regexp_replace(f, r"([%_\\])", r"\\$1"))
    like = F.concat(F.lit("" if anchored else "%"), F.array_join(escaped, "%"), F.lit("%"))
    return F.call_function("like", text, like)


def _holds(u: str, r: str) -> Column:
    """Whether a rule holds for a URL, each kind in its own way."""
    host, rest, scheme = F.col(f"{u}.host"), F.col(f"{u}.rest"), F.col(f"{u}.scheme")
    kind, sep, fields = F.col(f"{r}.kind"), F.col(f"{r}.sep"), F.col(f"{r}.fields")
    short_host, short_rest, short_rule = F.octet_length(host) < KEY, F.octet_length(rest) < KEY, F.octet_length(sep) < KEY
    on_host = F.when(short_host, short_rule & host.startswith(sep)).otherwise(~short_rule & host.contains(sep))
    first = F.substr(sep, F.lit(1), F.lit(KEY))
    on_rest = F.when(short_rest, short_rule & rest.startswith(sep)).otherwise(~short_rule & (F.instr(first, "*") == 0))
    same = scheme == F.col(f"{r}.scheme")
    return (
        F.when(kind.isin("exception", "domain"), on_host)
        .when(kind == "prefix", same & on_rest & in_order(rest, fields, True))
        .when(kind == "wildcard", same & on_rest & ~short_rest & ~short_rule & in_order(rest, fields, False))
        .otherwise(False)
    )


def _parsed(urls: DataFrame, key: str, url: str) -> DataFrame:
    p = url_parts(F.coalesce(F.col(url), F.lit("")))
    return urls.select(F.col(key).alias("k"), p.alias("p")).select("k", "p.*")


def _decide(hits: DataFrame, urls: DataFrame, key: str) -> DataFrame:
    got = hits.groupBy("k").agg(F.bool_or(F.col("kind") == "exception").alias("free"), F.bool_or(F.col("kind") != "exception").alias("bad"))
    x = urls.join(got, urls[key] == got["k"], "left").drop("k")
    return x.withColumn("blocked", F.coalesce(F.col("bad") & ~F.col("free"), F.lit(False))).drop("bad", "free")


def blocked(urls: DataFrame, rules: DataFrame, key: str, url: str) -> DataFrame:
    """Add `blocked`. The number of rules is checked first; beyond FEW they are joined by key. `key` is unique.

    Null and empty URLs are not blocked.
    """
    if rules.limit(FEW + 1).count() > FEW:
        return blocked_by_key(urls, rules, key, url)
    u, r = _parsed(urls, key, url).alias("u"), F.broadcast(rules.where("kind <> 'regex'")).alias("r")
    return _decide(u.join(r, _holds("u", "r")).select("u.k", "r.kind"), urls, key)


def blocked_by_key(urls: DataFrame, rules: DataFrame, key: str, url: str) -> DataFrame:
    """J5 for lists of any size: candidates share five characters, then the rule is verified.

    Up to BROADCAST rules go to all tasks, so that only hits are exchanged; beyond that the windows are.
    Short rules meet short texts on their first characters. A rule of five bytes but less than five characters is keyed
    by all of it and meets the windows of two to four characters that have as many bytes.
    """
    keyed = rules.where("kind <> 'regex'").withColumn("g", F.substring("sep", 1, KEY))
    if rules.limit(BROADCAST + 1).count() <= BROADCAST:
        keyed = F.broadcast(keyed)
    u = _parsed(urls, key, url)
    grams = lambda c: F.when(F.length(c) >= KEY, F.transform(F.sequence(F.lit(1), F.length(c) - KEY + 1), lambda i: F.substr(c, i, F.lit(KEY)))).otherwise(F.array())
    starts = lambda c: F.when((F.octet_length(c) < KEY) & (F.length(c) > 0), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substr(c, F.lit(1), i))).otherwise(F.array())
    size = lambda c, n: F.filter(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substr(c, i, F.lit(n))), lambda w: F.octet_length(w) >= KEY)
    few = lambda c: F.when(F.octet_length(c) > F.length(c), F.concat(*[size(c, n) for n in range(2, KEY)])).otherwise(F.array())
    host, rest = F.col("host"), F.col("rest")
    windows = F.array_distinct(F.concat(grams(host), grams(rest), starts(host), starts(rest), few(host), few(rest)))
    pairs = u.select("k", "scheme", "host", "rest", F.explode(windows).alias("g")).alias("u").join(keyed.alias("r"), F.col("u.g") == F.col("r.g")).where(_holds("u", "r")).select("u.k", "r.kind")
    return _decide(pairs, urls, key)


def matches_regex(urls: DataFrame, rules: DataFrame, key: str, url: str) -> DataFrame:
    """J5f, off by default: (key) of URLs that a regex rule matches; only for few rules, which are broadcast.

    Regular expressions have no key, so more than REGEXES of them are an error.
    """
    r, most = rules.where("kind = 'regex'").select("sep"), min(REGEXES, BROADCAST)
    if r.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} regex rules")
    return urls.alias("u").join(F.broadcast(r).alias("r"), F.expr(f"u.`{url}` rlike r.sep"), "left_semi").select(key)
