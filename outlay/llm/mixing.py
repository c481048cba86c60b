"""Mixing sources to target weights by temperature.

A source with the token share ``p`` gets the weight ``p ** a / sum(p ** a)``. The exponent ``a`` lies
between 1 (shares as they are) and 0 (all alike) and is bisected: the largest one whose weights have
``entropy_share`` of the highest possible entropy, but no smaller one than keeps every source within
``max_repeats`` passes over its documents; where no exponent does, the shares stay as they are.

The weights become token budgets that add up to ``budget`` (the corpus size by default). A source's
stream is one permutation of its documents after another, each ordered by hashes of its own, until the
budget is filled; the last document is kept whole. The streams are cut into equally many blocks in
proportion to their budgets, so that each block of about ``block_tokens`` tokens has the target
weights, and each block is permuted in itself.

Prefix sums are taken in two steps: within buckets of a permutation, whose number follows the size of
the source, and over the sums of the buckets. No window holds a source, however large.

Edge cases: a document counts its words and one end, so a NULL or empty text is one token and takes
part. A NULL source is the source ``''``. Documents with one id are placed by their own texts; rows
that repeat id and text are interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outlay.llm.common import materialise, split_words

STEPS = 40  # halvings of the exponent's interval
AT_ONCE = 4  # of them for each pass over the sources
BUCKET_ROWS = 4000


def token_table(docs: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens, text_md5`` of every document."""
    return docs.select(
        F.col("doc_id"),
        F.coalesce("source", F.lit("")).alias("source"),
        (F.coalesce(F.size(split_words(F.col("text"))), F.lit(0)) + 1).cast("bigint").alias("n_tokens"),
        F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"),
    )


def bisected(sources: DataFrame, value: Callable[[float], list[Column]], up: Callable[..., bool]) -> tuple[float, float]:
    """The interval of ``a`` after ``STEPS`` halvings; ``up(a, *value(a))`` says to go on above ``a``.

    A pass asks for all ``2 ** AT_ONCE - 1`` points that the next halvings may need.
    """
    lo, hi = 0.0, 1.0
    for _ in range(STEPS // AT_ONCE):
        n = 1 << AT_ONCE
        points = [lo + (hi - lo) * i / n for i in range(1, n)]
        columns = [c.alias(f"v{i}_{j}") for i, a in enumerate(points, 1) for j, c in enumerate(value(a))]
        row = sources.agg(*columns).first()
        left, right = 0, n
        while right - left > 1:
            mid = (left + right) // 2
            got = [row[f"v{mid}_{j}"] for j in range(len(value(0.0)))]
            left, right = (mid, right) if up(points[mid - 1], *got) else (left, mid)
        lo, hi = lo + (hi - lo) * left / n, lo + (hi - lo) * right / n
    return lo, hi


def exponent(sources: DataFrame, entropy_share: float, max_repeats: float, passes: float) -> float:
    """``sources`` has ``share``; ``passes`` is the budget in units of the corpus."""
    p, n = F.col("share"), sources.count()
    if n == 0:
        return 1.0
    target = entropy_share * math.log(n)

    def entropy(a: float) -> list[Column]:
        return [F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.ln(p))]

    def repeats(a: float) -> list[Column]:
        return [F.sum(F.pow(p, F.lit(a))), F.max(F.pow(p, F.lit(a)) / p)]

    by_entropy, _ = bisected(sources, entropy, lambda a, z, t: math.log(z) - a * t / z >= target)
    _, by_repeats = bisected(sources, repeats, lambda a, z, top: top / z * passes > max_repeats)
    return round(max(by_entropy, by_repeats), 9)


def mix_sources(docs: DataFrame, entropy_share: float = 0.99, max_repeats: float = 4.0, budget: int | None = None, block_tokens: int = 1 << 18, seed: int = 1) -> DataFrame:
    """``doc_id, source, n_tokens, epoch, block, position``: the documents in training order.

    ``position`` counts from 1 within the block; ``epoch`` counts the passes over the source from 0.
    """
    tokens = materialise(token_table(docs), "tokens")
    per_source = tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    per_source = materialise(per_source, "sources")
    total = per_source.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    shares = per_source.withColumn("share", F.col("tokens") / F.lit(max(total, 1)))
    a = exponent(shares, entropy_share, max_repeats, budget / max(total, 1))
    z = shares.agg(F.sum(F.pow("share", F.lit(a)))).first()[0] or 1.0
    blocks = max(1, -(-budget // block_tokens))
    wanted = shares.withColumn("wanted", F.floor(F.round(F.pow("share", F.lit(a)) / z, 9) * budget + 0.5).cast("bigint"))
    plan = wanted.select(
        "source",
        "tokens",
        "wanted",
        F.expr("wanted div tokens").alias("full"),
        F.greatest(F.lit(1), F.ceil(F.col("docs") / BUCKET_ROWS)).alias("buckets"),
    )

    def key(kind: str, epoch: Column) -> Column:
        return F.md5(F.concat_ws("|", F.lit(kind), F.lit(seed), epoch, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_md5"))

    rows = tokens.join(plan, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full"))))
    rows = rows.withColumn("key", key("order", F.col("epoch")))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = materialise(rows.withColumn("bucket", F.floor(place * F.col("buckets"))), "permuted")
    cell = ["source", "epoch", "bucket"]
    sums = rows.groupBy(*cell).agg(F.sum("n_tokens").alias("in_bucket"))
    ahead = sums.withColumn("before", F.sum("in_bucket").over(W.partitionBy("source", "epoch").orderBy("bucket")) - F.col("in_bucket")).drop("in_bucket")
    within = F.sum("n_tokens").over(W.partitionBy(*cell).orderBy("key", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, 0))
    placed = rows.withColumn("within", within - F.col("n_tokens")).join(ahead, cell).withColumn("start", F.col("before") + F.col("within"))
    placed = placed.where((F.col("epoch") < F.col("full")) | (F.col("start") < F.expr("wanted % tokens")))
    offset = F.col("epoch") * F.col("tokens") + F.col("start")
    block = F.least(F.lit(blocks - 1), F.floor(offset.cast("double") * F.lit(float(blocks)) / F.col("wanted"))).cast("bigint")
    blocked = placed.select("doc_id", "source", "n_tokens", "epoch", block.alias("block"), key("block", F.col("epoch")).alias("key"))
    position = F.row_number().over(W.partitionBy("block").orderBy("key", "doc_id", "source", "n_tokens"))
    return blocked.select("doc_id", "source", "n_tokens", "epoch", "block", position.cast("bigint").alias("position"))
