"""URL rules by sort-merge range joins.

A host's canonical key is its labels in reverse order, each followed by a dot: ``a.example.net`` is
``net.example.a.``. A rule's host and all its subdomains are the keys that begin with the rule's key,
an interval of the sorted keys; and the paths that begin with a rule's path are an interval of the sorted
paths below its host. Intervals of prefixes are nested or apart. Keys and rules are sorted together by
ranges; a sweep over each range keeps a stack of the rules whose interval is open.

The join is done twice. The first sweep takes the distinct hosts of the pages and the distinct hosts of the rules and
gives each host the rule hosts on its stack, as many as it has labels at most. The second one takes the
distinct pairs of such a rule host and a path, and the rules, by host and path; the top of its stack is the
longest rule of that host. A site with very many path rules is thus one row of the first sweep, spread over the
ranges of the second by its paths, and a page never carries more than one rule for each rule host. Of
these the longest decides.

Range bounds are cut from a bounded sample of the keys. A rule that opened in an earlier range is open at the
start of a range if its key is a prefix of the bound: such rules are sent to that range as well. A host
or url with a third of all pages is one row in a sweep; the joins back to the pages are left to Spark,
which splits a large key.

Edge cases: a NULL url and one without ``://`` have an empty host and path and no rule fits them unless
its host is empty, too. Letters other than A-Z keep their case. Of rules with the same host and path the
verdict ``block`` counts. Equal length of host and path together: the rule with the longer host wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.llm.common import LOWER, UPPER, materialise


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def bounds_of(keys: DataFrame, ranges: int, per_range: int = 20, longest: int = 200) -> list[tuple[str, str]]:
    """At most ``ranges - 1`` pairs ``site, key`` that cut the sorted keys into about equal parts.

    Any texts can be bounds, so long ones are shortened.
    """
    most = ranges * per_range
    n = keys.count()
    sample = keys if n <= most else keys.where(F.xxhash64("site", "key").bitwiseAND((1 << 52) - 1) < int((1 << 52) * most / n))
    # Some more may pass the hash test, so the number is bounded again.
    found = sorted(tuple(r) for r in sample.select(F.left("site", F.lit(longest)), F.left("key", F.lit(longest))).limit(2 * most).collect())
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def swept(keys: DataFrame, rules: DataFrame, ranges: int) -> DataFrame:
    """``site, key, open``: for each row of ``keys`` the rules of its site that are prefixes of its key, shortest first.

    ``keys`` has ``site, key`` and ``rules`` has ``site, key, verdict``, all distinct and not NULL. A key without a rule has no row.
    """
    bounds = bounds_of(keys, ranges)
    here = F.struct("site", "key")
    part = sum((F.when(here >= F.struct(F.lit(s), F.lit(k)), 1).otherwise(0) for s, k in bounds), F.lit(0)).cast("int")
    later = F.array(*[F.when((F.col("site") == s) & F.lit(k).startswith(F.col("key")), i) for i, (s, k) in enumerate(bounds, 1)]) if bounds else F.array().cast("array<int>")
    starts = rules.select("site", "key", F.lit(0).alias("kind"), "verdict", part.alias("part"))
    # A rule that starts at a bound is in the bound's own range already.
    carried = starts.withColumn("at", F.explode(F.array_compact(later))).where("part < at").select("site", "key", "kind", "verdict", F.col("at").alias("part"))
    events = keys.select("site", "key", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("verdict"), part.alias("part"))
    dealt = events.union(starts).union(carried).repartitionByRange(max(1, ranges), "part").sortWithinPartitions("part", "site", "key", "kind")
    return dealt.select("part", "site", "key", "kind", "verdict").mapInPandas(sweep, "site string, key string, open array<struct<key:string,verdict:string>>")


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by range, site and key, rules before keys; the stack lives as long as a site in a range."""
    stack: list[dict] = []
    place = None
    for batch in batches:
        sites, keys, opens = [], [], []
        for part, site, key, kind, verdict in batch.itertuples(index=False):
            if (part, site) != place:
                place, stack = (part, site), []
            while stack and not key.startswith(stack[-1]["key"]):
                stack.pop()
            if kind == 0:
                stack.append({"key": key, "verdict": verdict})
            elif stack:
                sites.append(site)
                keys.append(key)
                opens.append(list(stack))
        yield pd.DataFrame({"site": pd.Series(sites, dtype=object), "key": pd.Series(keys, dtype=object), "open": pd.Series(opens, dtype=object)})


def fitting(urls: DataFrame, rules: DataFrame, ranges: int) -> DataFrame:
    """``key, path, best``: the longest rule (``size, inner, key, path, verdict``) of each distinct host key and path that has one."""
    places = materialise(urls.select("key", "path").distinct(), "places")
    hosts = places.select(F.lit("").alias("site"), "key").distinct()
    of_hosts = rules.select(F.lit("").alias("site"), "key", F.lit(None).cast("string").alias("verdict")).distinct()
    above = materialise(swept(hosts, of_hosts, ranges).select("key", "open.key").toDF("key", "sites"), "hosts")
    asked = materialise(places.join(above, "key").select("key", "path", F.explode("sites").alias("site")), "asked")
    of_paths = rules.select(F.col("key").alias("site"), F.col("path").alias("key"), "verdict")
    pairs = asked.select("site", F.col("path").alias("key")).distinct()
    tops = materialise(swept(pairs, of_paths, ranges).select("site", F.col("key").alias("path"), F.element_at("open", -1).alias("rule")), "paths")
    size = F.length("site") + F.length("rule.key")
    rule = F.struct(size.alias("size"), F.length("site").alias("inner"), F.col("site").alias("key"), F.col("rule.key").alias("path"), F.col("rule.verdict").alias("verdict"))
    # A host has one rule host of each length, so the longest rule is never tied.
    return asked.join(tops, ["site", "path"]).groupBy("key", "path").agg(F.max(rule).alias("best"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int = 64) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages`` (``page_id, url``).

    ``rules`` has ``host, path, verdict``; ``rule`` is host and path of the one that decides, or NULL.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("key", key_of(F.col("host")))
    keyed = rules.where("host is not null and path is not null and verdict is not null").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
    keyed = keyed.groupBy(key_of(F.col("host")).alias("key"), "path").agg(F.max(F.col("verdict") == "block").alias("blocks"))
    keyed = keyed.select("key", "path", F.when(F.col("blocks"), "block").otherwise("allow").alias("verdict"))
    judged = urls.join(materialise(fitting(urls, keyed, ranges), "fitting"), ["key", "path"], "left")
    host = F.array_join(F.reverse(F.split(F.expr("substring(best.key, 1, length(best.key) - 1)"), r"\.", -1)), ".")
    return judged.select("page_id", "host", "path", F.concat(host, F.col("best.path")).alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
