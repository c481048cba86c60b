"""Quality rules with thresholds from quantile sketches per language and source.

Each document gets a few integer rates. Their distributions are kept as mergeable sketches: counts by
logarithmic bins with 64 bins for each power of two, so a quantile is right within 1/64 and sketches
are merged by adding counts. The sketches of a group (language, source) serve if it has ``min_docs``
documents; else those of its language, merged over the sources; else those of all.

A rate is accepted up to ``q3 + reach * max(q3 - q1, slack)`` of its group and, where short values are
bad as well, down to ``q1 - reach * max(q3 - q1, slack)``: fences that follow the group instead of
fixed cutoffs, and that reject no fixed share of a clean one. The thresholds are joined back to the
documents, which are filtered by them and by the base rule.

Built-in expressions only. Texts are read once, for the features. Sketches combine on the map side: a
hot group sends a row for each task and bin.

Edge cases: a NULL or empty text has no words and fails the base rule. NULL languages and sources are
groups of their own. Rows are judged one by one, so repeated rows get equal verdicts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outlay.llm.common import NOT_SPACE, materialise, split_words

# Fixed value: the characters counted as symbols.
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5
BITS = 6


@dataclass(frozen=True)
class Rate:
    name: str
    slack: int
    both_sides: bool = False


# Per mille, but for the word length, which is in hundredths of a character.
RATES = (Rate("symbol_rate", 20), Rate("dup_line_rate", 100), Rate("repeat_rate", 50), Rate("upper_rate", 60), Rate("word_length", 60, True))


def window_places(words: Column) -> Column:
    """The windows of ``WINDOW`` words as hash and place, sorted so that equal ones are neighbours."""
    n = F.size(words) - WINDOW
    windows = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")))
    return F.when(n > 0, F.sort_array(windows)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source``, the base counts and the rates of every row."""
    split = docs.select("doc_id", "lang", "source", F.col("text"), F.coalesce(split_words(F.col("text")), F.array().cast("array<string>")).alias("words"))
    counted = split.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.coalesce(F.char_length(F.regexp_replace("text", SYMBOLS, "")), F.lit(0)).cast("bigint").alias("n_symbols"),
        F.coalesce(F.char_length(F.regexp_replace("text", r"[^\p{Lu}]+", "")), F.lit(0)).cast("bigint").alias("n_upper"),
        F.coalesce(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(NOT_SPACE)), F.array().cast("array<string>")).alias("lines"),
        window_places(F.col("words")).alias("windows"),
    )
    same = lambda x, i: (x.h == F.get("windows", i + 1).h) | ((i > 0) & (x.h == F.get("windows", i - 1).h))
    # A quick test first: most texts repeat no window.
    hashes = F.col("windows.h")
    twice = F.when(F.size(F.array_distinct(hashes)) < F.size("windows"), F.filter("windows", lambda x, i: F.coalesce(same(x, i), F.lit(False))))
    placed = counted.select("*", F.sort_array(F.transform(twice, lambda x: x.i)).alias("at"))
    cover = F.aggregate(
        F.transform("at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda acc, x: acc + x
    )
    base = placed.select(
        *[c for c in counted.columns if c not in ("lines", "windows")],
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(cover, F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )

    def rate(part: str, whole: str, scale: int) -> Column:
        return F.coalesce(F.expr(f"{scale} * {part} div greatest({whole}, 1)"), F.lit(0))

    return base.withColumns(
        {
            "symbol_rate": rate("n_symbols", "word_chars", 1000),
            "dup_line_rate": rate("n_dup_lines", "n_lines", 1000),
            "repeat_rate": rate("n_repeat_words", "n_words", 1000),
            "upper_rate": rate("n_upper", "word_chars", 1000),
            "word_length": rate("word_chars", "n_words", 100),
        }
    )


# A whole number below 64 is its own bin, else its power of two and its next six bits decide.
BIN = f"case when value < {1 << BITS} then value else (length(bin(value)) - {BITS + 1}) * {1 << BITS} + shiftright(value, length(bin(value)) - {BITS + 1}) end"
# The least value of a bin.
LEAST = f"case when bin < {2 << BITS} then bin else shiftleft(bin % {1 << BITS} + {1 << BITS}, cast(bin div {1 << BITS} - 1 as int)) end"


def sketches(rows: DataFrame) -> DataFrame:
    """``lang, source, rate, bin, n``: the sketch of every rate in every group."""
    pairs = F.array(*[F.struct(F.lit(r.name).alias("rate"), F.col(r.name).alias("value")) for r in RATES])
    long = rows.select("lang", "source", F.inline(pairs))
    return long.groupBy("lang", "source", "rate", F.expr(BIN).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, min_docs: int, reach: float) -> DataFrame:
    """``lang, source, rate, lo, hi`` of every group that occurs, from the finest sketch with ``min_docs`` documents."""
    levels = []
    for depth, keys in enumerate((["lang", "source"], ["lang"], [])):
        merged = sketch.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))
        w = W.partitionBy(*keys, "rate")
        run = merged.withColumns({"total": F.sum("n").over(w), "upto": F.sum("n").over(w.orderBy("bin"))})
        quarter = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.expr(LEAST)))
        levels.append(run.groupBy(*keys, "rate").agg(F.max("total").alias(f"n{depth}"), quarter(1).alias(f"q1_{depth}"), quarter(3).alias(f"q3_{depth}")))
    fine, lang, all_ = levels
    lang = lang.withColumnRenamed("lang", "lang_l").withColumnRenamed("rate", "rate_l")
    all_ = all_.withColumnRenamed("rate", "rate_a")
    joined = fine.join(lang, fine.lang.eqNullSafe(lang.lang_l) & (fine.rate == lang.rate_l)).join(F.broadcast(all_), F.col("rate") == F.col("rate_a"))
    pick = lambda c: F.when(F.col("n0") >= min_docs, F.col(f"{c}_0")).when(F.col("n1") >= min_docs, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2"))
    slack = F.element_at(F.create_map(*[F.lit(x) for r in RATES for x in (r.name, r.slack)]), F.col("rate"))
    chosen = joined.select("lang", "source", "rate", pick("q1").alias("q1"), pick("q3").alias("q3")).withColumn("width", reach * F.greatest(F.col("q3") - F.col("q1"), slack))
    two = F.col("rate").isin([r.name for r in RATES if r.both_sides])
    return chosen.select("lang", "source", "rate", F.when(two, F.col("q1") - F.col("width")).alias("lo"), (F.col("q3") + F.col("width")).alias("hi"))


def judge(docs: DataFrame, min_docs: int = 200, reach: float = 3.0, min_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """``doc_id``, the base counts, the rates, ``base_failed``, ``failed`` (names of rates) and ``kept`` of every row."""
    rows = materialise(features(docs), "features")
    limits = thresholds(materialise(sketches(rows), "sketches"), min_docs, reach)
    wide = limits.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rate") == r.name, F.col(c))).alias(f"{r.name}_{c}") for r in RATES for c in ("lo", "hi")])
    wide = wide.withColumnRenamed("lang", "g_lang").withColumnRenamed("source", "g_source")
    joined = rows.join(wide, rows.lang.eqNullSafe(wide.g_lang) & rows.source.eqNullSafe(wide.g_source))
    broken = [F.when((F.col(r.name) > F.col(f"{r.name}_hi")) | F.coalesce(F.col(r.name) < F.col(f"{r.name}_lo"), F.lit(False)), F.lit(r.name)) for r in RATES]
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    failed = F.array_compact(F.array(*broken))
    out = joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), F.array_join(failed, ",").alias("failed"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed") == ""))


def keep_good(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows that fail; rows with one id are judged by their own language, source and text."""
    keyed = docs.select(F.struct(*[F.xxhash64(c).alias(c) for c in ("doc_id", "text")], F.col("lang"), F.col("source")).alias("doc_id"), "lang", "source", "text")
    bad = judge(keyed, **settings).where(~F.col("kept")).select("doc_id.*").distinct()
    bad = bad.select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "text", "lang", "source")])
    same = (F.xxhash64(docs.doc_id) == F.col("__doc_id")) & (F.xxhash64(docs.text) == F.col("__text")) & docs.lang.eqNullSafe(F.col("__lang")) & docs.source.eqNullSafe(F.col("__source"))
    return docs.join(bad, same, "left_anti")
