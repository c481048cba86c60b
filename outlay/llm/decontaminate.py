"""Benchmark decontamination: a hash set of normalised test n-grams against training token windows.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A test item gives all its
windows of ``width`` words; an item with fewer words, but not none, is one window. A window occurs in
a document where all its words follow each other; every word under an occurrence is hit.

Built-in expressions only. The documents are read once: each gives one row for itself and one for each
position; the positions probe the hash set by the hash of the first three words and the survivors are
verified word by word, all within the scan's stage. Only hits and one row for each document are
shuffled, and they are grouped by document, so the largest group is one document's own hits.

Edge cases: a NULL or empty text, or one without words, has no words and no hits. A NULL or empty item
has no window. An item without id is searched for and hit, but not counted or listed. Repeated
documents give a row each; items with one id count once. An empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outlay.llm.common import ascii_lower, materialise

# Fixed value: what separates words once A-Z are lower-case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 13
ANCHOR = 3


def normalised_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``item_id, words`` of every distinct window of every item."""
    tokens = items.select("item_id", normalised_words(F.col("text")).alias("item_words")).where(F.size("item_words") > 0)
    length = F.least(F.lit(width), F.size("item_words"))
    starts = tokens.select("item_id", "item_words", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("item_words") - length + 1)).alias("start"))
    return starts.select("item_id", F.slice("item_words", F.col("start"), F.col("length")).alias("words")).distinct()


def window_hits(docs: DataFrame, windows: DataFrame, broadcast_rows: int = 2_000_000) -> DataFrame:
    """One row for each document (``start`` 0) and one for each occurrence of a window in it.

    ``docs`` has ``row`` and ``text``, ``windows`` has ``window_id`` and ``words``. The hash set is
    broadcast if it has at most ``broadcast_rows`` windows, else Spark picks a join; results agree.
    """
    keyed = windows.select(
        "window_id",
        "words",
        F.size("words").alias("length"),
        F.xxhash64(F.least(F.lit(ANCHOR), F.size("words")), *[F.coalesce(F.get("words", F.lit(i)), F.lit("")) for i in range(ANCHOR)]).alias("anchor"),
    )
    shape = keyed.agg(F.count("*").alias("n"), F.collect_set(F.least(F.lit(ANCHOR), F.col("length"))).alias("widths")).first()
    tokens = docs.select("row", F.coalesce(normalised_words(F.col("text")), F.array().cast("array<string>")).alias("doc_words"))

    def anchors(width: int) -> Column:
        def at(i: Column) -> Column:
            parts = [F.get("doc_words", i + k) if k < width else F.lit("") for k in range(ANCHOR)]
            return F.struct((i + 1).alias("start"), F.xxhash64(F.lit(width), *parts).alias("anchor"))

        n = F.size("doc_words") - width
        return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), at)).otherwise(NOTHING)

    NOTHING = F.array().cast("array<struct<start:int,anchor:bigint>>")
    self_row = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).cast("bigint").alias("anchor")))
    probes = tokens.select("row", "doc_words", F.concat(self_row, *[anchors(w) for w in sorted(shape["widths"])]).alias("probe"))
    # Outer, though no probe is empty: an inner one adds a filter that would build the probes twice.
    probes = probes.select("row", "doc_words", F.inline_outer("probe"))
    keyed = F.broadcast(keyed) if shape["n"] <= broadcast_rows else keyed
    same = F.slice(probes.doc_words, F.greatest(probes.start, F.lit(1)), keyed.length) == keyed.words
    found = probes.join(keyed, (probes.anchor == keyed.anchor) & (probes.start > 0) & same, "left")
    return found.where((F.col("start") == 0) | F.col("window_id").isNotNull()).select(
        "row", "start", "length", "window_id", F.when(F.col("start") == 0, F.size("doc_words")).cast("bigint").alias("n_words")
    )


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: int = 20) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs``.

    Contaminated: ``n_hit > 0 and share * n_hit >= n_words``.
    """
    occurring = materialise(item_windows(items, width).withColumn("window_id", F.sha2(F.array_join("words", " "), 256)), "windows")
    windows = occurring.select("window_id", "words").distinct()
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("part_row"))
    hits = window_hits(rows.select(F.struct("part_row", "doc_id").alias("row"), "text"), windows)
    # Hits are few beside the texts; they are kept so that their two uses read them once.
    hits = materialise(hits, "hits")

    before = W.partitionBy("row").orderBy("start", "length").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    covered = hits.withColumn("seen", F.coalesce(F.max(end).over(before), F.lit(0)))
    per_doc = covered.groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.when(F.col("start") == 0, 0).otherwise(F.greatest(F.lit(0), end - F.greatest("start", "seen")))).cast("bigint").alias("n_hit"),
    )
    named = hits.where("start > 0").select("row", "window_id").distinct().join(occurring.where("item_id is not null"), "window_id")
    named = named.select("row", F.col("item_id").cast("string").alias("item")).distinct()
    listed = named.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    n, h = F.col("n_words"), F.col("n_hit")
    return per_doc.join(listed, "row", "left").select(
        F.col("row.doc_id").alias("doc_id"),
        n,
        h,
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((h > 0) & (h * share >= n)).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: int = 20) -> DataFrame:
    """``docs`` without its contaminated rows; rows with one id are judged by their own texts."""
    marked = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__text": F.xxhash64("text")})
    keyed = marked.select(F.struct("__id", "__text").alias("doc_id"), "text")
    bad = materialise(contamination(keyed, items, width, share).where("contaminated").select("doc_id.*").distinct(), "contaminated")
    return marked.join(bad, ["__id", "__text"], "left_anti").select(*docs.columns)


def remove_spans(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, text`` with the words under an occurrence taken out, and what separated them kept.

    The texts with hits are cut: each hit word is deleted, separators stay as they are.
    """
    windows = item_windows(items, width).select("words").distinct().withColumn("window_id", F.sha2(F.array_join("words", " "), 256))
    rows = docs.select("doc_id", "text").withColumn("key", F.struct(F.col("doc_id"), F.xxhash64("text").alias("hash")))
    hits = window_hits(rows.select(F.col("key").alias("row"), "text"), windows).where("start > 0")
    spans = hits.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("at")).distinct()
    spans = spans.groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("hit"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    gaps = F.split("text", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1)
    joined = rows.join(spans, rows.key.eqNullSafe(spans.row), "left")
    kept = joined.withColumns({"__words": words, "__gaps": gaps})
    # Gap 0 precedes word 1, so a position of ``hit`` is the index of the word's own gap before it.
    piece = F.transform(
        "__gaps",
        lambda gap, i: F.concat(gap, F.when(F.array_contains("hit", i + 1), F.lit("")).otherwise(F.coalesce(F.get("__words", i), F.lit("")))),
    )
    return kept.select("doc_id", F.when(F.col("hit").isNull(), F.col("text")).otherwise(F.array_join(piece, "")).alias("text"))
