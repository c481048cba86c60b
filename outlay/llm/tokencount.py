"""Token counts of a unigram tokenizer, without making the tokens.

An Aho-Corasick automaton enumerates all vocabulary pieces in a text. The dynamic programme carries,
for each position, the best score of a segmentation that ends there and its number of pieces; no path
is stored. The tie rule is that of the tokenizer: starts are tried in ascending order, pieces of a
start in ascending length, and a later candidate has to be better, so of equal scores the earliest
start stays. A character that no single-character piece covers costs the least score of the
vocabulary minus 10 and gives one unknown piece for a run of them, or one piece for each of its UTF-8
bytes where the vocabulary has all byte pieces.

White space is marked as usual: each blank becomes ``MARK``, and one precedes the text. Where no piece
has ``MARK`` behind another character, no piece crosses the start of a marked word, and words are
counted one by one and remembered; with whole-number scores their sums are exact, so the result is that
of the whole text. Otherwise whole texts are segmented.

Edge cases: NULL and empty texts have no tokens and score 0. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_COST = 10.0
BYTES = [f"<0x{i:02X}>" for i in range(256)]
WORD = regex.compile(f"{MARK}+[^{MARK}]*")


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]

    @property
    def has_bytes(self) -> bool:
        return set(BYTES) <= set(self.pieces)

    @property
    def by_word(self) -> bool:
        """Whether counting word by word is exact."""
        crossing = any(MARK in p.lstrip(MARK) for p in self.pieces)
        return not crossing and MARK in self.pieces and all(float(s).is_integer() for s in self.scores)


def load_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a public SentencePiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    return Vocabulary(tuple(model.id_to_piece(i) for i in range(n)), tuple(float(model.get_score(i)) for i in range(n)))


class Counter:
    """Best score and number of pieces of texts under one vocabulary."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = 300_000):
        self.automaton = ahocorasick.Automaton()
        for piece, score in zip(vocabulary.pieces, vocabulary.scores):
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(vocabulary.scores, default=0.0) - UNKNOWN_COST
        self.bytes, self.by_word, self.remembered = vocabulary.has_bytes, vocabulary.by_word, remembered
        self.words: dict[str, tuple[float, int]] = {}

    def segment(self, text: str) -> tuple[float, int]:
        n = len(text)
        # Score, pieces, and whether the last piece is an unknown one.
        best: list[tuple[float, int, bool] | None] = [None] * (n + 1)
        best[0] = (0.0, 0, False)
        ends: dict[int, list[tuple[int, float]]] = {}
        for end, (size, score) in self.automaton.iter(text):
            ends.setdefault(end + 1, []).append((end + 1 - size, score))
        for end in range(1, n + 1):
            top: tuple[float, int, bool] | None = None
            single = False
            for start, score in sorted(ends.get(end, ())):
                single |= start == end - 1
                before = best[start]
                if before is not None and (top is None or before[0] + score > top[0]):
                    top = (before[0] + score, before[1] + 1, False)
            before = best[end - 1]
            if not single and before is not None and (top is None or before[0] + self.unknown > top[0]):
                more = len(text[end - 1].encode("utf-8", "surrogatepass")) if self.bytes else int(not before[2])
                top = (before[0] + self.unknown, before[1] + more, True)
            best[end] = top
        score, pieces, _ = best[n]
        return score, pieces

    def count(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        marked = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return self.segment(marked)
        total, pieces = 0.0, 0
        for word in WORD.findall(marked):
            found = self.words.get(word)
            if found is None:
                if len(self.words) >= self.remembered:
                    self.words.clear()
                found = self.segment(word)
                if len(word) <= 64:
                    self.words[word] = found
            total += found[0]
            pieces += found[1]
        return total, pieces


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` with ``n_tokens`` and ``best_score`` of every row; the vocabulary travels with the job once."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            counted = [counter.count(t.as_py()) for t in batch.column("__text")]
            kept = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array([c[1] for c in counted], pa.int64()), pa.array([c[0] for c in counted], pa.float64())],
                [*kept, "n_tokens", "best_score"],
            )

    chosen = docs.select(*columns, F.col("text").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "__text")
    return chosen.mapInArrow(run, f"{schema}, n_tokens bigint, best_score double")
