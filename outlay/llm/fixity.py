"""Merkle fixity audit of WARC replicas.

A file's records lie at byte offsets. Its offsets are cut into ranges of ``leaf_bytes``; a leaf hashes
the records that begin in its range, in the order of their offsets, and a node hashes its ``fanout``
children in order, up to one root for each file. Ranges do not shift when a record is lost, so only the
leaves that hold damage differ. Two replicas are compared by their roots; below roots that differ the
children are compared, level by level, and only within differing leaves record against record.

Record hashes are written once and each level is built from the one below by a grouping of at most
``fanout`` children, whatever the size of a file. Levels are kept, so the descent reads them and joins
only the children of nodes that differ.

Edge cases: a NULL payload hashes as an empty one with a mark of its own; records without file or offset
are a file ``''`` and an offset -1. Records at the same place are told apart by their hashes: repeated
ones count as one. A file that only one replica has differs at its root. Two empty replicas agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outlay.llm.common import materialise


def warc_payloads(pages: DataFrame, per_file: int = 256) -> DataFrame:
    """``file, page_id, payload``: pages as response records of numbered files, in the order of their ids."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.0"),
        F.lit("WARC-Type: response"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce("url", F.lit(""))),
        F.concat(F.lit("Content-Length: "), F.octet_length(F.coalesce("html", F.lit("")))),
        F.lit("\r\n"),
    )
    return pages.select(F.format_string("part-%08d.warc", F.expr(f"page_id div {per_file}")).alias("file"), "page_id", F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary")).alias("payload"))


def size_of(payload: Column) -> Column:
    return F.octet_length(payload).cast("bigint")


def hash_of(payload: Column) -> Column:
    """SHA-256 of a payload behind a mark; a missing one has another mark than an empty one."""
    mark = F.when(payload.isNull(), F.lit("-").cast("binary")).otherwise(F.concat(F.lit("+").cast("binary"), payload.cast("binary")))
    return F.sha2(mark, 256)


def with_offsets(records: DataFrame) -> DataFrame:
    """``records`` (``file, page_id, size`` and more) with the ``offset`` of each, one behind the other.

    Rows are shuffled by file as they are, so hash payloads before and leave them behind.
    """
    before = W.partitionBy("file").orderBy("page_id").rowsBetween(W.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))


def warc_records(pages: DataFrame, per_file: int = 256) -> DataFrame:
    """``file, offset, page_id, hash``: the records of the pages' WARC files by hash; payloads stay in the scan."""
    hashed = warc_payloads(pages, per_file).select("file", "page_id", size_of(F.col("payload")).alias("size"), hash_of(F.col("payload")).alias("hash"))
    return with_offsets(hashed).select("file", "offset", "page_id", "hash")


def record_hashes(records: DataFrame) -> DataFrame:
    """``file, offset, hash``, one row for each place and hash; made from ``payload`` where there is one."""
    hashed = hash_of(F.col("payload")) if "payload" in records.columns else F.col("hash")
    return records.select(F.coalesce("file", F.lit("")).alias("file"), F.coalesce("offset", F.lit(-1)).cast("bigint").alias("offset"), hashed.alias("hash")).distinct()


def joined_hash(order: Column, hash_: Column) -> Column:
    """The hash of a node: its children's places and hashes in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), hash_.alias("h")))), lambda x: F.concat_ws(":", x.o, x.h))
    return F.sha2(F.array_join(parts, "\n"), 256)


def leaf_of(leaf_bytes: int, last: int) -> Column:
    """The leaf of a record; records without an offset are spread over all leaves by their hashes."""
    spread = F.pmod(F.xxhash64("hash"), F.lit(last + 1))
    return F.when(F.col("offset") >= 0, F.floor(F.col("offset") / leaf_bytes)).otherwise(spread).cast("bigint")


def tree(hashes: DataFrame, leaf_bytes: int, fanout: int, last: int) -> list[DataFrame]:
    """``file, node, hash`` of each level, leaves first; the last one has the root of every file, node 0.

    ``last`` is the largest leaf of either replica, so that both trees have the same height.
    """
    node = leaf_of(leaf_bytes, last)
    levels = [materialise(hashes.groupBy("file", node.alias("node")).agg(joined_hash(F.col("offset"), F.col("hash")).alias("hash")), "leaves")]
    widest = last
    while widest > 0:
        below = levels[-1]
        above = below.groupBy("file", F.expr(f"node div {fanout}").alias("parent")).agg(joined_hash(F.col("node"), F.col("hash")).alias("hash"))
        levels.append(materialise(above.withColumnRenamed("parent", "node"), "nodes"))
        widest //= fanout
    return levels


def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of the nodes whose hashes differ or that one side lacks."""
    right = b.withColumnRenamed("hash", "other")
    return a.join(right, keys, "full").where(~F.col("hash").eqNullSafe(F.col("other"))).select(*keys)


def audit(first: DataFrame, second: DataFrame, leaf_bytes: int = 1 << 16, fanout: int = 16) -> DataFrame:
    """``file, offset, kind, hash_first, hash_second`` of each damaged record, ``kind`` changed, missing or extra.

    ``first`` and ``second`` have ``file, offset`` and ``payload`` or, from ``hash_of``, ``hash``; missing and extra are seen from ``second``.
    """
    a, b = materialise(record_hashes(first), "hashes"), materialise(record_hashes(second), "hashes")
    size = a.union(b).agg(F.max("offset").alias("top"), F.count(F.when(F.col("offset") < 0, 1)).alias("placeless")).first()
    last = max((size["top"] or 0) // leaf_bytes, size["placeless"] // fanout)
    trees = [tree(x, leaf_bytes, fanout, last) for x in (a, b)]
    bad = differing(trees[0][-1], trees[1][-1], ["file", "node"])
    for level in reversed(range(len(trees[0]) - 1)):
        bad = materialise(bad, "differing").withColumnRenamed("node", "parent")
        sides = [t[level].withColumn("parent", F.expr(f"node div {fanout}")).join(bad, ["file", "parent"], "left_semi").drop("parent") for t in trees]
        bad = differing(*sides, ["file", "node"])
    bad = materialise(bad, "differing")
    node = leaf_of(leaf_bytes, last)
    found = [x.withColumn("node", node).join(bad, ["file", "node"], "left_semi").select("file", "offset", "hash") for x in (a, b)]
    only = [found[0].join(found[1], ["file", "offset", "hash"], "left_anti"), found[1].join(found[0], ["file", "offset", "hash"], "left_anti")]
    both = only[0].withColumnRenamed("hash", "hash_first").join(only[1].withColumnRenamed("hash", "hash_second"), ["file", "offset"], "full")
    kind = F.when(F.col("hash_second").isNull(), "missing").when(F.col("hash_first").isNull(), "extra").otherwise("changed")
    return both.select("file", "offset", kind.alias("kind"), "hash_first", "hash_second")
