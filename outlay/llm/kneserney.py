"""Interpolated modified Kneser-Ney language model over words.

Numbering. Words are 64-bit hashes. Each task counts the distinct words of its texts and sends them to shards
by hash range. A shard adds them up, writes them into the shared folder and numbers its words by falling
count; a word's number over all is made of that rank and of the shard, so frequent words have small numbers.

Counting. Each task counts the n-grams of highest order it sees, as word numbers, and sends them, packed, to
shards by hash range. A shard adds up its n-grams and writes them into the shared folder; it sends on the
number of left neighbours of each shorter n-gram (its count one order down) and the followers of each
context (how many, and how many seen once, twice, more often). One shuffle for each order does both. A
frequent word is no hot key: shards cut by the hash of the whole n-gram, and contexts arrive as one
partial sum for each shard.

Packing loses nothing. Rows are sorted, and a number is the difference from the row above where all numbers
before it are the same; numbers and counts are then compressed byte by byte.

Files. A shard has one file for each order. Its n-grams are sorted by a 64-bit hash, which is one to one for
the numbers of one or two words. The shard and an index give the upper bits; the lower ones take six bytes,
and what these have to spare holds the count, or marks one that is kept beside them. A context is an n-gram
of the order below and shares its row: a byte names its followers, the frequent kinds of which are
listed once for each shard and the others kept beside them.

Scoring. Workers map the files of all shards into memory, so that a process holds no copy and the
nodes share the pages they read, and look up sorted blocks of hashes. A document's score is the sum of
log10 probabilities of its words and one end, each given the ``order - 1`` tokens before it:

    p(w | u) = max(c(u w) - D(c), 0) / c(u) + g(u) p(w | u without its first token)

with the three discounts of each order from its counts of counts, ``g`` the discounted mass, and the
uniform distribution over the known words and one unknown below the unigrams.

The shared folder has to be mounted on all nodes. A shard is written under another name and then
renamed, so a repeated task leaves the same files. The model knows how many shards it has; a worker that
sees fewer fails instead of scoring without them. Training reads its rows twice; a word that the first
reading did not meet is an error.

Edge cases: a NULL text is empty, its only token is the end. Without any training row every token has
probability 1. Texts are taken whole. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from outlay.llm.common import posix_path, shared_folder
from outlay.llm.shingles import MULTIPLIER, WordHashes, mix  # noqa: F401 (callers of grams hash words with WordHashes)

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
RAW, STATS = 0, 99  # kinds of packed rows; n is an n-gram, -n a context of n-grams
FILES = 200  # added to n in the statistics: how many shards of n-grams were written
SCHEMA = "level int, kind int, shard int, blob binary, stats array<bigint>"
EMPTY = np.empty(0, np.uint64)
FIRST, UNKNOWN = 0, 0xFFFFFFFF  # numbers of the start mark and of words not seen in training
LOW_BITS, LEAST_SPARE = 48, 2  # bits of a stored row, and of these for its count
ELSEWHERE = 255  # followers that are not among the listed kinds
FALLBACK = np.array([0, 0.5, 1.0, 1.5])  # discounts of counts 0, 1, 2, 3 and more


@dataclass(frozen=True)
class Model:
    folder: str
    order: int
    bits: int
    stats: dict[int, list[int]]  # by order: total, types, types counted once, twice, 3, 4 times, 3 or more times

    def files(self) -> dict[int, int]:
        """How many shards each level has."""
        return {n - FILES: s[0] for n, s in self.stats.items() if n >= FILES}

    def discounts(self, n: int) -> np.ndarray:
        """What is taken from counts of 0, 1, 2, 3 and more."""
        _, _, n1, n2, n3, n4, _ = self.stats.get(n, [0] * 7)
        if not (n1 and n2 and n3 and n4):
            return FALLBACK.copy()
        y = n1 / (n1 + 2 * n2)
        d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
        # An estimate has to leave something to the count and to the words not seen; counts of counts that
        # rise give none, and then the fixed one stands in.
        return np.where((d > 0) & (d < [1, 1, 2, 3]), d, FALLBACK)


def differences(columns: list[np.ndarray], back: bool = False) -> list[np.ndarray]:
    """Sorted columns as steps from the row above, or as they are where a column before has changed; and back."""
    out, changed = [], np.arange(len(columns[0])) == 0
    for c in columns:
        if back:
            total = np.cumsum(c, dtype=np.uint32)
            first = np.flatnonzero(changed)
            plain = total - np.repeat(total[first] - c[first], np.diff([*first, len(c)]))
            out.append(plain)
        else:
            plain = c
            out.append(np.where(changed, c, np.diff(c, prepend=c[:1])))
        changed = changed | np.concatenate([[True], plain[1:] != plain[:-1]])[: len(c)]
    return out


def planes(a: np.ndarray) -> bytes:
    """The lowest bytes of all values, then the next ones."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes()


def pack(words: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    """Sorted rows of word numbers and their counts."""
    narrow = all(c.max(initial=0) < 1 << 32 for c in counts)
    body = [planes(c.astype("<u4")) for c in differences(words)] + [planes(c.astype("<u4" if narrow else "<u8")) for c in counts]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(words[0]), narrow], "<u8").tobytes() + b"".join(body))


def unpack(blobs: list[bytes], words: int, counts: int) -> list[np.ndarray]:
    """The columns of packed blobs: ``words`` of numbers, then ``counts`` of counts."""
    parts = []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, narrow = map(int, np.frombuffer(raw, "<u8", 2))
        at, columns = 16, []
        for width in [4] * words + [4 if narrow else 8] * counts:
            a = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
            columns.append(np.ascontiguousarray(a.T).view(f"<u{width}").ravel())
            at += n * width
        parts.append([*differences(columns[:words], back=True), *(c.astype(np.uint64) for c in columns[words:])])
    return [np.concatenate(p) for p in zip(*parts)]


def pack_words(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    body = planes(np.diff(hashes, prepend=np.uint64(0)).astype("<u8")) + planes(counts.astype("<u8"))
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack_words(blobs: list[bytes]) -> list[np.ndarray]:
    parts = []
    for blob in blobs:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(2, 8, -1)
        steps, counts = (np.ascontiguousarray(a.T).view("<u8").ravel() for a in raw)
        parts.append([np.cumsum(steps, dtype=np.uint64), counts])
    return [np.concatenate(p) for p in zip(*parts)]


def keys_of(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams of word numbers; no two n-grams of one or two words share one."""
    key = columns[0].astype(np.uint64)
    if len(columns) > 1:
        key = key << np.uint64(32) | columns[1]
    key = mix(key)
    for c in columns[2:]:
        key = mix(key * MULTIPLIER + c)
    return key


def folded(columns: list[np.ndarray], width: int) -> np.ndarray:
    """One number for each row of ``columns`` of ``width`` bits, in the order of the rows; equal rows share it."""
    key, used = columns[0].astype(np.uint64), width
    for c in columns[1:]:
        if used + width > 64:
            distinct, key = np.unique(key, return_inverse=True)
            key, used = key.astype(np.uint64), len(distinct).bit_length()
        key, used = key << np.uint64(width) | c.astype(np.uint64), used + width
    return key


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, a place of each, and sums of ``counts`` by key. Keys arrive as sorted runs."""
    order = np.argsort(keys, kind="stable")
    at = keys[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, np.int64)
    return at[first], order[first], [np.add.reduceat(c[order], first) if len(first) else c[:0] for c in counts]


def summed_rows(columns: list[np.ndarray], *counts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of word numbers in order, and sums of ``counts`` of each."""
    width = max(1, *(int(c.max(initial=0)).bit_length() for c in columns))
    _, first, sums = summed(folded(columns, width), *counts)
    return [c[first] for c in columns], sums


def shards_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)


def sharded(kind: int, words: list[np.ndarray], counts: list[np.ndarray], bits: int) -> Iterator[tuple[int, int, bytes, None]]:
    """Packed rows for each shard; the rows are sorted."""
    shard = shards_of(keys_of(words), bits)
    order = np.argsort(shard.astype(np.uint16) if bits <= 16 else shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange((1 << bits) + 1))
    for s in np.flatnonzero(edges[1:] > edges[:-1]):
        rows = order[edges[s] : edges[s + 1]]
        yield kind, int(s), pack([c[rows] for c in words], [c[rows] for c in counts]), None


@dataclass
class Block:
    """Texts as tokens with an end each; a token is a place in ``hashes``, where 0 is the start and 1 the end."""

    tokens: np.ndarray
    sizes: np.ndarray
    hashes: np.ndarray


def block_of(texts: pa.Array) -> Block:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, edges = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    edges = edges - edges[0]
    filled = pc.not_equal(words, "")
    before = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    sizes = np.diff(before[edges])
    coded = words.filter(filled).dictionary_encode()
    known = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(chain([START, END], map(xxh64_intdigest, known)), np.uint64, len(known) + 2)
    tokens = np.insert(coded.indices.to_numpy() + np.int32(2), np.cumsum(sizes), 1)
    return Block(tokens, sizes + 1, hashes)


def token_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[Block, list[pa.RecordBatch]]]:
    """The texts in blocks of about ``size`` tokens, or a longer text alone; and the rows they come from."""
    rows, held = [], 0

    def block() -> tuple[Block, list[pa.RecordBatch]]:
        return block_of(pa.chunked_array([r.column("text") for r in rows]).cast(pa.large_string()).combine_chunks()), rows

    for batch in batches:
        begun = 0
        for i, n in enumerate(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)):
            held += n // 6 + 1  # a word has about six bytes
            if held >= size:
                rows.append(batch.slice(begun, i + 1 - begun))
                yield block()
                rows, held, begun = [], 0, i + 1
        if begun < batch.num_rows:
            rows.append(batch.slice(begun))
    if rows:
        yield block()


def padded(tokens: np.ndarray, sizes: np.ndarray, order: int, start: int | np.generic) -> tuple[np.ndarray, np.ndarray]:
    """The tokens in a line with ``order - 1`` start marks before each text, and their places there."""
    line = np.insert(tokens, np.repeat(np.cumsum(sizes) - sizes, order - 1), start)
    return line, np.arange(sizes.sum()) + np.repeat(np.arange(1, len(sizes) + 1) * (order - 1), sizes)


def grams_of(line: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    return [line[at - (order - 1) + j] for j in range(order)]


def grams(block: list[np.ndarray], order: int) -> list[np.ndarray]:
    """The columns of the n-grams of word hashes that end in each token, with start marks before each text."""
    return grams_of(*padded(np.concatenate(block), np.array([len(t) for t in block]), order, START), order)


def level_of(kind: int) -> int:
    """A context of n-grams goes where the n-grams one order down go, so that both have one array of hashes."""
    return kind if kind >= 0 else -kind - 1


def rows_of(found: list[tuple]) -> pa.Table:
    kinds, shards, blobs, stats = zip(*found) if found else ((), (), (), ())
    return pa.table([pa.array([level_of(k) for k in kinds], pa.int32()), pa.array(kinds, pa.int32()), pa.array(shards, pa.int32()), pa.array(blobs, pa.binary()), pa.array(stats, pa.list_(pa.int64()))], names=["level", "kind", "shard", "blob", "stats"])


def store(folder: str, level: int, shard: int, keys: np.ndarray, counts: np.ndarray, bits: int, **arrays: np.ndarray) -> None:
    """Write the rows of one shard, sorted by key, into one file."""
    index = max(64 - bits - LOW_BITS + LEAST_SPARE, (len(keys) // 16).bit_length(), 0)
    low = 64 - bits - index
    spare = LOW_BITS - low
    most = (1 << min(spare, 32)) - 1
    own = keys & np.uint64((1 << (64 - bits)) - 1)
    row = (own & np.uint64((1 << low) - 1)) << np.uint64(spare) | np.minimum(counts, np.uint64(most))
    many = np.flatnonzero(counts >= most)
    arrays |= {
        "start": np.searchsorted(own >> np.uint64(low), np.arange((1 << index) + 1, dtype=np.uint64)).astype(smallest(np.array([len(keys)]))),
        "upper": (row >> np.uint64(16)).astype("<u4"),
        "lower": (row & np.uint64(0xFFFF)).astype("<u2"),
        "many": many.astype(smallest(many)),
        "counts": counts[many].astype(smallest(counts[many])),
    }
    head, at = {"bits": [bits, low, spare, most], "arrays": {}}, 0
    for name, a in arrays.items():
        head["arrays"][name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    os.makedirs(f"{folder}/grams{level}", exist_ok=True)
    path = f"{folder}/grams{level}/{shard:06d}"
    with open(f"{path}.{os.getpid()}", "wb") as f:
        f.write(np.array([len(text)], "<u8").tobytes() + text)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8))
    os.replace(f"{path}.{os.getpid()}", f"{path}.grams")


def smallest(a: np.ndarray) -> np.dtype:
    return np.dtype("<u4") if int(a.max(initial=0)) < 1 << 32 else np.dtype("<u8")


def kinds_of(parts: list[np.ndarray], rows: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """The followers of each of ``n`` contexts: a byte for the kind, the kinds, and those that are no listed kind."""
    width = max(1, *(int(p.max(initial=0)).bit_length() for p in parts))
    distinct, first, back, often = np.unique(folded(parts, width), return_index=True, return_inverse=True, return_counts=True)
    listed = np.argsort(-often, kind="stable")[: ELSEWHERE - 1]
    code = np.full(len(distinct), ELSEWHERE, np.uint8)
    code[listed] = np.arange(1, len(listed) + 1)
    kind = np.zeros(n, np.uint8)
    kind[rows] = code[back]
    rare = np.flatnonzero(code[back] == ELSEWHERE)
    values = np.concatenate([np.zeros((1, len(parts)), np.uint64), np.stack([p[first[listed]] for p in parts], 1)])
    others = np.stack([p[rare] for p in parts], 1).ravel()
    return {"kind": kind, "kinds": values.ravel(), "rare": rows[rare].astype(smallest(rows[rare])), "others": others.astype(smallest(others))}


def spread(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, values.dtype)
    out[at] = values
    return out


def numbered(docs: DataFrame, folder: str, bits: int, block: int) -> DataFrame:
    """Count the words of ``docs`` and write them with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _ in token_blocks(batches, block):
            hashes, _, (n,) = summed(b.hashes, np.bincount(b.tokens, minlength=len(b.hashes)).astype(np.uint64))
            hashes, n = hashes[n > 0], n[n > 0]
            edges = np.searchsorted(shards_of(hashes, bits), np.arange((1 << bits) + 1))
            yield from rows_of([(RAW, int(s), pack_words(hashes[edges[s] : edges[s + 1]], n[edges[s] : edges[s + 1]]), None) for s in np.flatnonzero(edges[1:] > edges[:-1])]).to_batches()

    def shard_of(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        hashes, counts = unpack_words(table.column("blob").to_pylist())
        hashes, _, (counts,) = summed(hashes, counts)
        rank = np.empty(len(hashes), np.uint64)
        rank[np.argsort(counts.max(initial=0) - counts, kind="stable")] = np.arange(len(hashes), dtype=np.uint64)
        numbers = (rank << np.uint64(bits)) + np.uint64(shard + FIRST + 1)
        if numbers.max(initial=0) >= UNKNOWN:
            raise OverflowError("more words than numbers of 32 bits")
        store(folder, RAW, shard, hashes, counts, bits, number=numbers.astype("<u4"))
        return rows_of([(STATS, shard, None, [FILES + RAW, 1, 0, 0, 0, 0, 0, 0]), (STATS, shard, None, [RAW, int(counts.sum()), len(counts), 0, 0, 0, 0, 0])])

    return docs.select("text").mapInArrow(run, SCHEMA).groupBy("shard").applyInArrow(shard_of, SCHEMA)


def counted(docs: DataFrame, words: Model, block: int) -> DataFrame:
    """The n-grams of highest order of ``docs``, packed for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(words)
        for b, _ in token_blocks(batches, block):
            numbers, _ = arrays.words(b.hashes)
            if (numbers[1:] == UNKNOWN).any():
                raise ValueError("a text has words that were not there when words were counted; training needs the same rows twice")
            by_number = np.argsort(numbers)
            place = np.empty(len(numbers), np.uint32)
            place[by_number] = np.arange(len(numbers), dtype=np.uint32)
            columns = grams_of(*padded(place[b.tokens], b.sizes, words.order, place[0]), words.order)
            columns, (n,) = summed_rows(columns, np.ones(len(columns[0]), np.uint64))
            numbers = numbers[by_number]
            yield from rows_of(list(sharded(words.order, [numbers[c] for c in columns], [n], words.bits))).to_batches()

    return docs.select("text").mapInArrow(run, SCHEMA)


def reduced(packed: DataFrame, folder: str, order: int, bits: int) -> DataFrame:
    """Add up each shard, write it, and send on what the next lower order and the contexts need."""

    def followers(n: np.ndarray) -> list[np.ndarray]:
        return [n, *(m.astype(np.uint64) for m in (n == 1, n == 2, n >= 3))]

    def shard_of(table: pa.Table) -> pa.Table:
        kinds, shard = table.column("kind").to_pylist(), table.column("shard")[0].as_py()
        if kinds[0] == STATS:
            return table.select(["level", "kind", "shard", "blob", "stats"])
        blobs: dict[int, list[bytes]] = {}
        for kind, blob in zip(kinds, table.column("blob").to_pylist()):
            blobs.setdefault(kind, []).append(blob)
        level = table.column("level")[0].as_py()
        own, keys, columns, n, extra = blobs.pop(level, []), EMPTY, [], EMPTY, {}
        if own:
            *columns, n = unpack(own, level, 1)
            columns, (n,) = summed_rows(columns, n)
            keys = keys_of(columns)
        rows, _, (counts,) = summed(keys, n)
        for packed_rows in blobs.values():
            found = unpack(packed_rows, level, 4)
            found, parts = summed_rows(found[:level], *found[level:])
            context, order_of, _ = summed(keys_of(found))
            # Contexts of start marks alone are no n-grams.
            every = np.union1d(rows, context)
            rows, counts = every, spread(np.searchsorted(every, rows), counts, len(every))
            extra = kinds_of([p[order_of] for p in parts], np.searchsorted(rows, context), len(rows))
        store(folder, level, shard, rows, counts, bits, **extra)
        out: list[tuple] = [(STATS, shard, None, [FILES + level, 1, 0, 0, 0, 0, 0, 0])]
        if not own:
            return rows_of(out)
        out.append((STATS, shard, None, [level, int(n.sum()), len(n), *(int((n == k).sum()) for k in (1, 2, 3, 4)), int((n >= 3).sum())]))
        if level > 1:
            above, parts = summed_rows(columns[:-1], *followers(n))
            out += sharded(-level, above, parts, bits)
            # One left neighbour for each distinct n-gram; behind two start marks there is none to count.
            left = np.where((columns[0] == FIRST) & (columns[1] == FIRST), n, np.uint64(1)) if level > 2 else np.ones(len(n), np.uint64)
            below, sums = summed_rows(columns[1:], left)
            out += sharded(level - 1, below, sums, bits)
        return rows_of(out)

    return packed.groupBy("level", "shard").applyInArrow(shard_of, SCHEMA)


def stats_of(packed: DataFrame) -> dict[int, list[int]]:
    sums = packed.where(F.col("kind") == STATS).groupBy(F.col("stats")[0].alias("n")).agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(1, 8)])
    return {r.n: [r[f"s{i}"] for i in range(1, 8)] for r in sums.collect()}


def train(docs: DataFrame, order: int = 2, shard_tokens: int = 2_000_000, block: int = 3_000_000) -> Model:
    """Count ``docs`` (``text``) and write the model into the shared folder."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    about = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    bits = max(0, (about // shard_tokens).bit_length())
    folder = posix_path(shared_folder(spark, "ngrams"))
    words = Model(folder, order, bits, stats_of(numbered(rows, folder, bits, block)))
    packed = counted(rows, words, block)
    for _ in range(order):
        packed = reduced(packed, folder, order, bits)
    return Model(folder, order, bits, words.stats | stats_of(packed))


class Shard:
    """One file of a shard, mapped into memory."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        begin = 8 + int(data[:8].view("<u8")[0])
        head = json.loads(data[8:begin].tobytes())
        self.bits, self.low, self.spare, self.most = head["bits"]
        self.arrays = {name: data[begin + at : begin + at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, n, at) in head["arrays"].items()}

    def rows(self, at: np.ndarray) -> np.ndarray:
        return self.arrays["upper"][at].astype(np.uint64) << np.uint64(16) | self.arrays["lower"][at]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which ``keys`` are here, in which rows, and their counts: a binary search below the index."""
        own = keys & np.uint64((1 << (64 - self.bits)) - 1)
        part = (own >> np.uint64(self.low)).astype(np.int64)
        want = own & np.uint64((1 << self.low) - 1)
        lo, end = (self.arrays["start"][part + i].astype(np.int64) for i in (0, 1))
        upper, hi, last = self.arrays["upper"], end.copy(), len(self.arrays["upper"]) - 1
        above = (want << np.uint64(self.spare) >> np.uint64(16)).astype(np.uint32)
        for _ in range(int((hi - lo).max(initial=0)).bit_length()):
            middle = (lo + hi) >> 1
            smaller = (upper[np.minimum(middle, last)] < above) & (lo < hi)
            hi = np.where(smaller, hi, middle)
            lo = np.where(smaller, middle + 1, lo)
        hit = np.flatnonzero(lo < end)
        hit = hit[upper[lo[hit]] == above[hit]]
        row = self.rows(lo[hit])
        # Few rows share their upper bytes; those that do are gone through one by one.
        while len(behind := np.flatnonzero((row >> np.uint64(self.spare) < want[hit]) & (lo[hit] + 1 < end[hit]))):
            lo[hit[behind]] += 1
            row[behind] = self.rows(lo[hit[behind]])
        same = row >> np.uint64(self.spare) == want[hit]
        hit, row = hit[same], row[same]
        at, count = lo[hit], (row & np.uint64((1 << self.spare) - 1)).astype(np.int64)
        if len(many := np.flatnonzero(count >= self.most)):
            count[many] = self.arrays["counts"][np.searchsorted(self.arrays["many"], at[many])]
        return hit, at, count

    def followers(self, at: np.ndarray) -> np.ndarray:
        """How many followers the contexts in rows ``at`` have, and how many of them once, twice, more often."""
        kind = self.arrays["kind"][at]
        out = self.arrays["kinds"].reshape(-1, 4)[np.where(kind == ELSEWHERE, 0, kind)].astype(float)
        if len(rare := np.flatnonzero(kind == ELSEWHERE)):
            out[rare] = self.arrays["others"].reshape(-1, 4)[np.searchsorted(self.arrays["rare"], at[rare])]
        return out


class Arrays:
    """Look-ups in the sorted rows of all shards, mapped into memory as they are needed."""

    def __init__(self, model: Model):
        self.model = model
        for level, written in model.files().items():
            folder = f"{model.folder}/grams{level}"
            here = len(glob.glob(f"{glob.escape(folder)}/*.grams"))
            if here < written:
                raise FileNotFoundError(f"{folder}: {here} of {written} shards of the model are here; is the shared folder mounted?")
        self.open: dict[tuple[int, int], Shard | None] = {}

    def found(self, level: int, keys: np.ndarray) -> Iterator[tuple[Shard, np.ndarray, np.ndarray, np.ndarray]]:
        """For each shard: itself, which of the sorted ``keys`` it has, in which rows, and their counts."""
        bits = self.model.bits
        edges = np.searchsorted(shards_of(keys, bits), np.arange((1 << bits) + 1))
        for shard in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            if (level, shard) not in self.open:
                path = f"{self.model.folder}/grams{level}/{shard:06d}.grams"
                self.open[level, shard] = Shard(path) if os.path.exists(path) else None
            if (s := self.open[level, shard]) is not None and len(s.arrays["upper"]):
                hit, at, count = s.find(keys[edges[shard] : edges[shard + 1]])
                yield s, hit + edges[shard], at, count

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words, and their counts in the training text."""
        order = np.argsort(hashes)
        number, count = np.full(len(hashes), UNKNOWN, np.uint32), np.zeros(len(hashes))
        for s, hit, at, n in self.found(RAW, hashes[order]):
            number[order[hit]], count[order[hit]] = s.arrays["number"][at], n
        number[hashes == START] = FIRST
        return number, count

    def counts(self, grams: list[np.ndarray]) -> np.ndarray:
        """Counts of n-grams of word numbers; 0 where there are none."""
        keys = keys_of(grams)
        order, count = np.argsort(keys), np.zeros(len(keys))
        for _, hit, _, n in self.found(len(grams), keys[order]):
            count[order[hit]] = n
        return count

    def contexts(self, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of n-grams, and the followers that they have as contexts."""
        keys, back = np.unique(keys_of(grams), return_inverse=True)
        count, followers = np.zeros(len(keys)), np.zeros((len(keys), 4))
        for s, hit, at, n in self.found(len(grams), keys):
            count[hit] = n
            if "kind" in s.arrays:
                followers[hit] = s.followers(at)
        return count[back], followers[back]

    def probabilities(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of the last token of each n-gram of word hashes: its probability, and its count in the training text."""
        hashes, line = np.unique(np.stack(columns, 1).ravel(), return_inverse=True)
        return self.chances(hashes, line, np.arange(len(columns) - 1, len(line), len(columns)))

    def chances(self, hashes: np.ndarray, line: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of the tokens ``at`` these places of a line of places in ``hashes``."""
        m = self.model
        numbers, raw = self.words(hashes)
        count, followers = (x[line] for x in self.contexts([numbers]))
        line_of = numbers[line]
        total, types, n1, n2, _, _, n3 = m.stats.get(1, [0] * 7)
        d = m.discounts(1)
        c = count[at]
        if total:
            p = (np.maximum(c - d[np.minimum(c, 3).astype(int)], 0) + (d[1:] @ [n1, n2, n3]) / (types + 1)) / total
        else:
            p = np.ones(len(at))
        for n in range(2, m.order + 1):
            d = m.discounts(n)
            parts = followers[at - 1]
            sure = np.maximum(parts[:, 0], 1)
            rest = np.where(parts[:, 0] > 0, parts[:, 1:] @ d[1:] / sure, 1.0)
            if n < m.order:
                # An n-gram is the context of the next token, so both are looked up at once.
                count, followers = (np.concatenate([x[:1].repeat(n - 1, 0), x]) for x in self.contexts([line_of[j : len(line) - n + 1 + j] for j in range(n)]))
                c = count[at]
            else:
                c = self.counts([line_of[at - n + 1 + j] for j in range(n)])
            p = np.maximum(c - d[np.minimum(c, 3).astype(int)], 0) / sure + rest * p
        return p, raw[line[at]]


def score(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",), block: int = 400_000) -> DataFrame:
    """``columns`` of ``docs`` with ``n_tokens, n_known, train_tokens, base_score`` and ``score`` of every row."""
    added = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    total, types = (model.stats.get(RAW) or [0, 0])[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(model)
        for b, rows in token_blocks(batches, block):
            p, raw = arrays.chances(b.hashes, *padded(b.tokens, b.sizes, model.order, 0))
            sizes = b.sizes
            starts = np.cumsum(sizes) - sizes
            base, known, scores = [np.add.reduceat(x, starts) for x in (np.log10((raw + 1) / (total + types + 1)), (raw > 0).astype(np.int64), np.log10(p))]
            kept = pa.Table.from_batches(rows).select(list(columns))
            values = [sizes, known, np.full(len(sizes), total), base, scores]
            names = [x.split()[0] for x in added.split(", ")]
            for name, v in zip(names, values):
                kept = kept.append_column(name, pa.array(v))
            yield from kept.to_batches()

    chosen = docs.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "text")
    return chosen.mapInArrow(run, f"{schema}, {added}")


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def score_corpus(docs: DataFrame, order: int = 3) -> DataFrame:
    """``doc_id, held_out`` and the scores of every row, by a model of the rows that are not held out."""
    marked = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return score(marked, train(marked.where(~F.col("held_out")), order), ("doc_id", "held_out"))
