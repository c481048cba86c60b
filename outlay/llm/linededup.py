"""Line deduplication with a suffix array over line-ID sequences.

Every document is a sequence of lines (``text`` split at ``\\n``). A line run is repeated if the same
lines occur, in order, at an earlier place: in a document with a smaller doc_id, or higher up in the
same one. For each line the longest repeated run that starts there is found; if it has ``min_words``
words or more, its lines are deleted. The earliest copy of every run stays.

Prefix doubling ranks the suffixes by their first 1, 2, 4, ... lines: the pair of ranks of the two
halves is sorted and numbered. Ranks that occur once end there, as in the Larsson-Sadakane order, so
each level is smaller than the one before; the ranks of all levels are the suffix array as far as
suffixes are alike. The rows of one rank at level ``k`` are a longest-common-prefix interval of depth
``2 ** k``. Intervals of every other depth are reached by descending from the top level: the members
of an interval that agree on the next block form the deeper interval; its earliest member stays behind
to stand for all of them at lesser depths. A member that is not the earliest of an interval has a
repeated run of that depth.

Built-in expressions only. Documents with the same text are one at first: the earliest stands for the
others, which are deleted if they have ``min_words`` words. Lines of the rest are compared by MD5, and
lines that occur once take no part. Groups are reduced by counts and minima, which combine on the map
side; windows hold the lines of one document.

Edge cases: a NULL text stays NULL and has no lines; an empty text has one empty line. Rows that repeat
both doc_id and text are one document and get the same result. A NULL doc_id counts as the largest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outlay.llm.common import materialise, split_words

LAST = 2**63 - 1
KEYS = ["id", "body"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_table(docs: DataFrame) -> DataFrame:
    """``id, body, words_in_doc, pos, line, words`` of every line; lines and bodies by their MD5."""
    rows = docs.where("text is not null").select(F.coalesce("doc_id", F.lit(LAST)).cast("bigint").alias("id"), F.md5("text").alias("body"), _lines(F.col("text")).alias("lines"))
    one = rows.select("id", "body", F.transform("lines", lambda x: F.struct(F.unhex(F.md5(x)).alias("line"), F.size(split_words(x)).alias("words"))).alias("lines"))
    total = F.aggregate("lines", F.lit(0).cast("bigint"), lambda acc, x: acc + x.words)
    return one.select("id", "body", total.alias("words_in_doc"), F.posexplode_outer("lines").alias("pos", "x")).select("id", "body", "words_in_doc", "pos", "x.line", "x.words")


def numbered(lines: DataFrame) -> DataFrame:
    """``at, doc, pos, rank, words`` of the lines that occur more than once; ``at`` follows the text order."""
    ids = lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line")
    ids = materialise(ids, "line-ids").select("line", F.monotonically_increasing_id().alias("rank"))
    known = lines.join(ids, "line").select("id", "body", "pos", "rank", "words")
    ordered = known.orderBy("id", "body", "pos").select("*", F.monotonically_increasing_id().alias("at"))
    ordered = materialise(ordered, "positions")
    return ordered.withColumn("doc", F.min("at").over(W.partitionBy(*KEYS)))


def ranks(positions: DataFrame) -> list[DataFrame]:
    """Level ``k`` has ``doc, pos, rank`` of the positions whose run of ``2 ** k`` lines is repeated."""
    levels = [positions.select("doc", "pos", "rank")]
    while True:
        level, step = levels[-1], 1 << (len(levels) - 1)
        second = level.select("doc", (F.col("pos") - step).alias("pos"), F.col("rank").alias("second"))
        pairs = materialise(level.join(second, ["doc", "pos"]), "pairs")
        names = pairs.groupBy("rank", "second").agg(F.count("*").alias("n")).where("n > 1").select("rank", "second")
        names = materialise(names.orderBy("rank", "second").select("*", F.monotonically_increasing_id().alias("new")), "names")
        deeper = materialise(pairs.join(names, ["rank", "second"]).select("doc", "pos", F.col("new").alias("rank")), "ranks")
        if deeper.isEmpty():
            return levels
        levels.append(deeper)


def repeated_runs(positions: DataFrame) -> DataFrame:
    """``doc, pos, length`` of the longest run at each position that also occurs earlier."""
    levels = ranks(positions)
    zero = F.lit(0).cast("bigint")
    # A member's interval is named by the place of its earliest member and the depth.
    state = positions.select("doc", "pos", "at", F.lit(0).alias("length"), zero.alias("interval"), F.lit(True).alias("open"))
    for k in reversed(range(len(levels))):
        step = 1 << k
        block = levels[k].select("doc", F.col("pos").alias("then"), "rank")
        looked = materialise(state.withColumn("then", F.col("pos") + F.col("length")).join(block, ["doc", "then"], "left").drop("then"), "looked")
        groups = looked.where("rank is not null").groupBy("interval", "length", "rank").agg(F.count("*").alias("n"), F.min("at").alias("first")).where("n > 1").drop("n")
        met = looked.where("rank is not null").join(groups, ["interval", "length", "rank"], "left")
        deep, first = F.col("first").isNotNull(), F.col("at") == F.col("first")
        below = F.struct((F.col("length") + step).alias("length"), F.col("first").alias("interval"), (F.col("open") & ~first).alias("open"))
        here = F.struct("length", "interval", "open")
        fates = F.when(deep & first, F.array(below, here)).when(deep, F.array(below)).otherwise(F.array(here))
        moved = met.select("doc", "pos", "at", F.explode(fates).alias("fate")).select("doc", "pos", "at", "fate.*")
        # Positions without a repeated block here need no group; joined, they would all meet at one NULL key.
        state = moved.union(looked.where("rank is null").select(*moved.columns))
    return state.where("open and length > 0").select("doc", "pos", "length")


def deleted_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``id, body, whole, gone``: documents that lose lines; all (``whole``) or those at the places ``gone``."""
    lines = materialise(line_table(docs), "lines")
    texts = lines.where("pos = 0").select(*KEYS, "words_in_doc").distinct()
    firsts = texts.groupBy("body").agg(F.min("id").alias("id"))
    copies = texts.join(firsts.withColumnRenamed("id", "first"), "body").where("id > first").where(F.col("words_in_doc") >= min_words)

    positions = materialise(numbered(lines.join(firsts, KEYS, "left_semi").dropDuplicates([*KEYS, "pos"])), "numbered")
    by_doc = W.partitionBy("doc").orderBy("pos")
    sums = positions.withColumn("upto", F.sum("words").over(by_doc))
    runs = repeated_runs(positions)
    ends = sums.select("doc", F.col("pos").alias("last"), F.col("upto").alias("upto_last"))
    begun = sums.join(runs, ["doc", "pos"], "left").withColumn("last", F.col("pos") + F.col("length") - 1).join(ends, ["doc", "last"], "left")
    long_enough = F.col("upto_last") - F.col("upto") + F.col("words") >= min_words
    reach = begun.withColumn("reach", F.max(F.when(long_enough, F.col("last")).otherwise(F.lit(-1))).over(by_doc))
    gone = reach.where("reach >= pos").groupBy(*KEYS).agg(F.sort_array(F.collect_list("pos")).alias("gone"))
    nothing = F.lit(None).cast("array<int>")
    return gone.select(*KEYS, F.lit(False).alias("whole"), "gone").union(copies.select(*KEYS, F.lit(True).alias("whole"), nothing.alias("gone")))


def dedup_lines(docs: DataFrame, min_words: int = 50, counts: tuple[str, str] = ("n_lines", "n_deleted")) -> DataFrame:
    """``docs`` with ``text`` cleaned and its numbers of lines and of deleted lines added.

    A document that loses all its lines has the text ``''``.
    """
    lost = deleted_lines(docs, min_words).hint("merge")
    lost = lost.select(F.col("id").alias("__id"), F.col("body").alias("__body"), F.col("whole").alias("__whole"), F.col("gone").alias("__gone"))
    marked = docs.withColumns({"__id": F.coalesce("doc_id", F.lit(LAST)).cast("bigint"), "__body": F.md5("text")})
    joined = marked.join(lost, ["__id", "__body"], "left").withColumn("__split", _lines(F.col("text")))
    n = F.coalesce(F.size("__split"), F.lit(0))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__split") - 1), "__gone")
    text = (
        F.when(F.col("__whole"), F.lit(""))
        .when(F.col("__gone").isNotNull(), F.array_join(F.transform(stay, lambda i: F.get("__split", i)), "\n"))
        .otherwise(F.col("text"))
    )
    lost_lines = F.when(F.col("__whole"), n).otherwise(F.coalesce(F.size("__gone"), F.lit(0)))
    out = joined.withColumns({"__text": text, counts[0]: F.when(F.col("text").isNull(), 0).otherwise(n).cast("bigint"), counts[1]: lost_lines.cast("bigint")})
    return out.withColumn("text", F.col("__text")).select(*docs.columns, *counts)
