"""Runs of repeated word sequences, found while the words of a text are appended one by one.

A square is a sequence of words that follows itself at once; a run is a stretch that repeats with a
smallest period, as far as it goes. Whenever a block of ``P`` words, ``P`` a power of two, is complete, a
catcher looks for squares with periods from ``P`` to ``2 P - 1`` that reach into the block: it compares
the block with the words one such period earlier. Where all ``P`` words agree, the comparison is carried
backwards to the first word that agrees, and each word appended later carries it forwards until one
differs. Then the squares seen under way have merged into one run, which is reported with its exact ends.

A run of at least four periods holds at least three periods of words that equal those one period
before, so at least one completed block of its level lies wholly among them: no run is missed. While a run
with a short period goes on, catchers of higher levels skip the periods that lie wholly inside it: by
periodicity these could only be multiples of the short one. The candidates of a catcher are the earlier
places of its last word, linked backwards. A word thus costs a few steps on each of ``log n`` levels, and
long repetitions do not cost more.

Each text is handled on its own where it is read; nothing is shuffled, and a task holds one text.

Edge cases: NULL and empty texts have no words and no runs, and collapse to an empty text. Texts are read
whole. Rows come back as they are, repeated ones each; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
LEAST_LENGTH, LEAST_PERIODS = 6, 4


def agree(words: Sequence, end: int, period: int, size: int) -> bool:
    """Whether the ``size`` words before ``end`` equal those one period earlier; short pieces first."""
    done, piece = 0, 1
    while done < size:
        piece = min(2 * piece, size - done)
        high, low = end - done, end - done - piece
        if words[low:high] != words[low - period : high - period]:
            return False
        done += piece
    return True


def find_runs(words: Sequence) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    live: dict[int, int] = {}  # period -> first word of a stretch that still goes on
    last: dict = {}  # word -> its last place
    before: list[int] = []  # place -> the place before it of the same word

    def finish(period: int, end: int) -> None:
        start = live.pop(period)
        if end - start >= max(LEAST_LENGTH, LEAST_PERIODS * period):
            found[start, end] = min(period, found.get((start, end), period))

    for place, word in enumerate(words):
        nearest = last.get(word, -1)
        before.append(nearest)
        last[word] = place
        if live:
            for period in [p for p in live if words[place - p] != word]:
                finish(period, place)
        end, distance = place + 1, place - nearest
        if nearest < 0 or distance >= 2 * (end & -end):
            continue
        # The lowest level with a period as long as the distance; no lower one has a candidate.
        size = 1 << distance.bit_length() - 1
        while not end % size and end >= 2 * size:
            # Periods below ``least`` lie wholly inside a run of a lower level.
            least = max([size, *(end - size - a + 1 for p, a in live.items() if p < size)]) if live else size
            most = min(2 * size - 1, end - size)
            earlier = nearest if least <= most else -1
            while earlier >= 0 and place - earlier <= most:
                period = place - earlier
                if period >= least and (size == 1 or words[place - 1] == words[earlier - 1]) and period not in live and agree(words, end, period, size):
                    start = end - size - period
                    while start and words[start - 1] == words[start - 1 + period]:
                        start -= 1
                    live[period] = start
                earlier = before[earlier]
            size *= 2
    for period in list(live):
        finish(period, len(words))
    return sorted((start, end - start, period) for (start, end), period in found.items())


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods; of equals the first, then the one with the shorter period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without the repetitions: of each run its first period stays."""
    kept, place = [], 0
    for start, end in sorted((s + p, s + n) for s, n, p in runs):
        kept += words[place:start]
        place = max(place, end)
    return kept + words[place:]


def periodic_runs(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of every row with ``n_words``, its ``runs``, the ``strongest`` of them and the ``collapsed``
    text, whose words are joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, tops, texts = [], [], [], []
            for text in batch.column("__text"):
                words = (text.as_py() or b"").split()  # of bytes: at ASCII white space
                found = find_runs(words)
                counts.append(len(words))
                runs.append([dict(zip(RUN.names, r)) for r in found])
                top = strongest(found)
                tops.append(top and dict(zip(RUN.names, top)))
                texts.append(b" ".join(collapse(words, found)))
            kind = pa.struct([(c, pa.int64()) for c in RUN.names])
            new = [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(kind)), pa.array(tops, kind), pa.array(texts, pa.binary())]
            kept = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], [*kept, "n_words", "runs", "strongest", "collapsed"])

    chosen = docs.select(*columns, F.col("text").cast("string").cast("binary").alias("__text"))
    schema = T.StructType([f for f in chosen.schema if f.name != "__text"])
    schema = schema.add("n_words", T.LongType()).add("runs", T.ArrayType(RUN)).add("strongest", RUN).add("collapsed", T.BinaryType())
    return chosen.mapInArrow(run, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with the repetitions of runs cut out of their texts; other texts stay as they are."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    found = periodic_runs(docs.select(whole, "text"), ("doc",))
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("doc.text").cast("string"))
    return found.select(*[text.alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])
