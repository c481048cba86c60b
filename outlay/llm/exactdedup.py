"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Texts are equal when they are identical after white space is deleted. Moving all texts, or even all
hashes, to find the few that are equal would cost more than the answer, so:

1. Every row is written once with its normalised text, the text's SHA-256 and a 64-bit fingerprint.
2. Each task takes the fingerprints of its rows, cut to ``log2(rows) + spare_bits`` bits, sorts them and
   deals them out by value to owners. A message holds the distinct values for one owner as gaps in
   Golomb-Rice code: the quotients in unary, the remainders in a fixed number of bits.
3. An owner decodes its messages, and answers each with a bitmap: bit i is set when another message
   holds the i-th value as well.
4. A sender sets the bits of its rows: those the owner reported and those that were equal among its own.
5. Only such suspects move: they are grouped by hash and normalised text, byte for byte. Copies combine
   before the shuffle, so a group that holds a third of all rows arrives as one row for each task.
6. Every suspect learns its group's outcome. The groups that hold a thousandth of all rows or more, at
   most a thousand, are broadcast; the others are joined, and none of those can fill a task.

A message holds at most ``per_sender`` rows and an owner about ``per_owner`` values, whatever the size of
the table. Cut fingerprints that agree by chance only make a suspect that stays alone in its group.

Edge cases: a NULL text is empty; empty texts are equal to one another and to those of white space alone.
Of equal texts the one with the most code points before the deletion stays, then the smallest
``doc_id``; rows without an id come after those with one. Rows repeated with their id count each, and
exactly one of them stays. An empty table gives an empty one. Two texts that share a SHA-256 are reported
as an error, since a result by hash would be wrong for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlay.llm.common import SPACES, materialise

MESSAGE = "sender bigint, owner bigint, n int, shift int, unary binary, rest binary"
HOT_GROUPS = 1000


def golomb_encode(values: np.ndarray, span: int) -> tuple[int, bytes, bytes]:
    """Ascending distinct ``values`` below ``span`` as remainder width, unary quotients and remainders."""
    n = len(values)
    gaps = np.diff(values, prepend=np.int64(-1)) - 1
    shift = max(0, int(np.log2(max(1.0, 0.69 * span / n)))) if n else 0
    quotients = gaps >> shift
    unary = np.zeros(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = (gaps[:, None] >> np.arange(shift)) & 1
    return shift, np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8)).tobytes()


def golomb_decode(n: int, shift: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * shift].reshape(n, shift).astype(np.int64)
    return np.cumsum((quotients << shift) + (bits << np.arange(shift)).sum(axis=1) + 1) - 1


def send(rows: DataFrame, bits: int, owner_bits: int, per_sender: int) -> DataFrame:
    """One message for each sender and owner; ``rows`` and ``sizes`` stay with the sender: its rows in the
    order of their values, and how many of them share each value."""
    span_bits = bits - owner_bits

    def messages(ids: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        values = (prints.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(values, kind="stable")
        distinct, first, sizes = np.unique(values[order], return_index=True, return_counts=True)
        placed = ids[order]
        owners, starts = np.unique(distinct >> span_bits, return_index=True)
        out = []
        for owner, a, b in zip(owners, starts, [*starts[1:], len(distinct)]):
            shift, unary, rest = golomb_encode(distinct[a:b] & ((1 << span_bits) - 1), 1 << span_bits)
            end = first[b] if b < len(distinct) else len(placed)
            out.append((int(ids[0]), int(owner), int(b - a), shift, unary, rest, placed[first[a] : end], sizes[a:b].astype(np.int32)))
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = ["sender", "owner", "n", "shift", "unary", "rest", "rows", "sizes"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, prints, held = [], [], 0
        for batch in batches:
            ids.append(batch.column("row").to_numpy(zero_copy_only=False))
            prints.append(batch.column("print").to_numpy(zero_copy_only=False))
            held += batch.num_rows
            if held >= per_sender:
                yield messages(np.concatenate(ids), np.concatenate(prints))
                ids, prints, held = [], [], 0
        if held:
            yield messages(np.concatenate(ids), np.concatenate(prints))

    return rows.select("row", "print").mapInArrow(run, f"{MESSAGE}, rows array<bigint>, sizes array<int>")


def answer(messages: DataFrame) -> DataFrame:
    """``sender, owner, found``: for each message a bitmap of the values that another message has too."""

    def run(table: pa.Table) -> pa.Table:
        values = [golomb_decode(*m) for m in zip(*(table.column(c).to_pylist() for c in ("n", "shift", "unary", "rest")))]
        _, place, counts = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        shared = np.split(counts[place] > 1, np.cumsum([len(v) for v in values])[:-1])
        found = pa.array([np.packbits(s).tobytes() for s in shared], pa.binary())
        return pa.table({"sender": table.column("sender"), "owner": table.column("owner"), "found": found})

    return messages.select("sender", "owner", "n", "shift", "unary", "rest").groupBy("owner").applyInArrow(run, "sender bigint, owner bigint, found binary")


def marks(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """``word, mask``: the suspects as a bitmap, 64 rows to a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            suspects = [np.empty(0, np.int64)]
            for found, rows, sizes in zip(*(batch.column(c).to_pylist() for c in ("found", "rows", "sizes"))):
                sizes = np.array(sizes)
                shared = np.unpackbits(np.frombuffer(found, np.uint8))[: len(sizes)].astype(bool) | (sizes > 1)
                suspects.append(np.array(rows)[np.repeat(shared, sizes)])
            ids = np.sort(np.concatenate(suspects))
            words, starts = np.unique(ids >> 6, return_index=True)
            masks = np.bitwise_or.reduceat(np.int64(1) << (ids & 63), starts) if len(ids) else ids
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(masks, pa.int64())], ["word", "mask"])

    both = messages.select("sender", "owner", "rows", "sizes").join(answers, ["sender", "owner"])
    return both.select("found", "rows", "sizes").mapInArrow(run, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask"))


def written_rows(docs: DataFrame, whole: bool) -> DataFrame:
    """``row, doc_id, size, sha, print, body`` of every row, stored; with ``whole`` the row itself as ``doc``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    body = F.regexp_replace(text, SPACES, "")
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if whole else []
    rows = docs.select("doc_id", F.char_length(text).alias("size"), body.alias("body"), *kept)
    rows = rows.select("*", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2("body", 256)).alias("sha"), F.xxhash64("body").alias("print"))
    return materialise(rows, "rows")


def groups_of(suspects: DataFrame) -> DataFrame:
    """``sha, n, best`` of each group of suspects whose normalised texts are the same bytes."""
    order = F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    same = suspects.groupBy("sha", "body").agg(F.count("*").alias("n"), F.min(order).alias("best"))
    by_hash = same.groupBy("sha").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), F.min("best").alias("best"))
    clash = F.raise_error(F.lit("different texts share a SHA-256"))
    return by_hash.select("sha", "n", F.when(F.col("texts") > 1, clash.cast("boolean")).otherwise(F.lit(True)).alias("one"), "best").where("one").drop("one")


def members(docs: DataFrame, whole: bool = False, spare_bits: int = 10, per_sender: int = 1 << 20, per_owner: int = 1 << 20) -> DataFrame:
    """Every row with ``keep_id``, ``group_size`` and ``kept``."""
    rows = written_rows(docs, whole)
    total = rows.count()
    size_bits = max(total - 1, 0).bit_length()
    owner_bits = max(size_bits - (per_owner - 1).bit_length(), 0)
    # At most 62 bits, so that a value and the place behind it fit into a signed word.
    messages = materialise(send(rows, min(size_bits + spare_bits, 62), owner_bits, per_sender), "messages")
    words = materialise(marks(messages, answer(messages)), "suspects")
    word, bit = F.shiftright("row", 6) == F.col("word"), F.getbit("mask", F.col("row").bitwiseAND(63).cast("int")) == 1
    groups = materialise(groups_of(rows.join(words, word).where(bit)), "groups")
    hot = F.broadcast(groups.where(F.col("n") * HOT_GROUPS >= total))
    rest = groups.where(F.col("n") * HOT_GROUPS < total)
    carried = rows.drop("body", "print")
    marked = carried.join(words, word, "left").withColumn("suspect", F.coalesce(bit, F.lit(False)))
    alone = marked.where("not suspect").select(*carried.columns, F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"))
    suspects = marked.where("suspect").select(*carried.columns)
    outcome = [*carried.columns, F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept")]
    common = suspects.join(hot, "sha").select(*outcome)
    others = suspects.join(hot.select("sha"), "sha", "left_anti").join(rest, "sha").select(*outcome)
    return alone.union(common).union(others)


def exact_duplicates(docs: DataFrame, **sizes: int) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row for each row of ``docs``."""
    return members(docs, **sizes).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def remove_copies(docs: DataFrame, **sizes: int) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    return members(docs, whole=True, **sizes).where("kept").select("doc.*")
