"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character n-grams of 1 to 3 letters, with every run of other characters taken as
one space, so that digits, symbols and layout say nothing. Term frequencies are damped by a logarithm,
weighted by inverse document frequency and scaled to length one.

1. Document frequencies are counted over all labelled training texts, as sums by feature.
2. The classifier is fitted on a bounded sample of the training rows: for each language the rows with
   the smallest hashes, about ``per_language`` of them, or fewer where many languages share ``most_rows``,
   but always a few of each. The features of the sample are made by all
   tasks. The fit itself is follow-the-regularised-leader with per-coordinate rates and L1 and L2
   penalties, over the sample in one task; it leaves a sparse table ``lang, feature, weight``.
3. A fifth of the sample is held back and sets the temperature that minimises its log loss.
4. Prediction reads whole texts, in Arrow batches, with the sparse weights as a small constant: at most
   ``2 ** bits`` features times the number of languages. Every language of the training rows is learned.

Edge cases: a NULL text and one without a letter give ``und`` with score 0. Rows without language or
text take no part in learning. With no training row at all every text is ``und``; with one language
all others are that language, with score 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Settings:
    bits: int = 16
    sizes: tuple[int, ...] = (1, 2, 3)
    per_language: int = 500
    most_rows: int = 32_000
    least_per_language: int = 20
    epochs: int = 4
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5


@dataclass
class Model:
    langs: list[str]
    bias: np.ndarray
    features: np.ndarray  # sorted feature numbers with a weight
    weights: np.ndarray  # one row for each of them, one column for each language
    idf: np.ndarray
    temperature: float = 1.0
    settings: Settings = field(default_factory=Settings)


def features(text: str, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashed n-grams of a text and how often each occurs; none if it has no letter."""
    plain = NOT_LETTERS.sub(" ", text.lower()).strip()
    if not plain:
        return np.empty(0, np.int64), np.empty(0)
    code = np.frombuffer(f" {plain} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    counts = np.zeros(1 << s.bits, np.int32)
    for n in s.sizes:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, np.uint64)
        for j in range(n):
            h = (h ^ code[j : len(code) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        counts += np.bincount((h >> np.uint64(64 - s.bits)).astype(np.int64), minlength=len(counts)).astype(np.int32)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(float)


def weighed(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(count)) * idf[at]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def document_frequencies(rows: DataFrame, s: Settings) -> DataFrame:
    """``feature, n`` over all rows; feature -1 has the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << s.bits, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                df[features(text.as_py(), s)[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int64()), pa.array([*df[at], n], pa.int64())], ["feature", "n"])

    counts = rows.select("text").mapInArrow(run, "feature bigint, n bigint")
    return counts.groupBy("feature").agg(F.sum("n").alias("n"))


def sampled(rows: DataFrame, s: Settings) -> DataFrame:
    """About equally many rows of every language, those with the smallest hashes; all rows of a rare one."""
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    wanted = F.least(F.lit(s.per_language), F.greatest(F.lit(s.least_per_language), F.lit(s.most_rows) / F.col("languages")))
    counts = counts.crossJoin(F.broadcast(counts.agg(F.count("*").alias("languages")))).select("lang", "n", wanted.alias("wanted"))
    share = F.xxhash64("doc_id", "text").bitwiseAND((1 << 52) - 1) / float(1 << 52)
    return rows.join(F.broadcast(counts), "lang").where((share * F.col("n") < F.col("wanted")) | (F.col("n") <= s.least_per_language)).select("doc_id", "lang", "text")


def vectors(rows: DataFrame, s: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py(), s) for t in batch.column("text")]
            at = pa.array([m[0].astype(np.int32) for m in made], pa.list_(pa.int32()))
            count = pa.array([m[1].astype(np.int32) for m in made], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("fold"), at, count], ["lang", "fold", "at", "count"])

    return rows.select("lang", "text", F.xxhash64("doc_id", "text", F.lit(1)).alias("fold")).mapInArrow(run, "lang string, fold bigint, at array<int>, count array<int>")


def gathered(sample: DataFrame) -> DataFrame:
    return sample.repartition(1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases. Each coordinate keeps a sum of adjusted gradients and one of their squares;
    its weight solves the penalised problem that the sums stand for, exactly 0 within the L1 penalty."""
    size = (1 << s.bits) + 1  # the last one is the bias
    lead, square = np.zeros((size, n_langs)), np.zeros((size, n_langs))
    bias = np.array([size - 1])
    order = np.random.default_rng(0)

    def solve(at: np.ndarray) -> np.ndarray:
        z, n = lead[at], square[at]
        l1 = np.where(at[:, None] == size - 1, 0.0, s.l1)
        w = -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    for _ in range(s.epochs):
        for i in order.permutation(len(rows)):
            at, x, lang = rows[i]
            at, x = np.concatenate([at, bias]), np.append(x, 1.0)
            w = solve(at)
            p = softmax(x @ w)
            p[lang] -= 1
            g = x[:, None] * p[None, :]
            n = square[at]
            lead[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / s.alpha * w
            square[at] = n + g * g
    w = solve(np.arange(size))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, langs: np.ndarray) -> float:
    """Golden-section search of the scale with the least log loss.

    A hundredth of the target is spread over all languages; else a faultless sample would ask for no doubt at all.
    """
    if not len(logits):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        p = np.log(np.maximum(p, 1e-12))
        return -(0.99 * p[np.arange(len(langs)), langs] + 0.01 * p.mean(axis=1)).mean()

    lo, hi, g = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(labelled: DataFrame, s: Settings = Settings()) -> Model:
    """Fit on ``doc_id, text, lang``; rows without text or language are left out."""
    rows = labelled.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    # At most 2 ** bits + 1 numbers come back.
    df = {r.feature: r.n for r in document_frequencies(rows, s).collect()}
    total = df.pop(-1, 0)
    idf = np.full(1 << s.bits, np.log(1 + total) + 1)
    idf[list(df)] = np.log((1 + total) / (1 + np.array(list(df.values()), float))) + 1
    sample = vectors(sampled(rows, s), s)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        pdf = pd.concat(frames).sort_values(["fold", "lang"])
        langs = sorted(pdf["lang"].unique())
        number = {x: i for i, x in enumerate(langs)}
        made = [(np.asarray(a, np.int64), weighed(np.asarray(a, np.int64), np.asarray(c, float), idf), number[x]) for a, c, x in zip(pdf["at"], pdf["count"], pdf["lang"])]
        held = (pdf["fold"] % 5 == 0).to_numpy()
        # Held-out rows that would leave a language without a training row are not held out.
        seen = {r[2] for r, h in zip(made, held) if not h}
        test = [r for r, h in zip(made, held) if h and r[2] in seen]
        w, b = fit_ftrl([r for r, h in zip(made, held) if not h or r[2] not in seen], len(langs), s)
        logits = np.array([x @ w[at] + b for at, x, _ in test])
        t = temperature(logits, np.array([r[2] for r in test], np.int64))
        at, lang = np.nonzero(w)
        out = pd.DataFrame({"lang": [langs[i] for i in lang], "feature": at, "weight": w[at, lang]})
        head = pd.DataFrame({"lang": langs, "feature": -1, "weight": b})
        yield pd.concat([out, head, pd.DataFrame({"lang": [""], "feature": [-2], "weight": [t]})])

    # The sample is bounded, so one task may hold it, and the weights are as well. A shuffle lies between,
    # so that scan, filter and features stay with all tasks.
    fitted = gathered(sample).mapInPandas(fit, "lang string, feature bigint, weight double").toPandas()
    head = fitted[fitted["feature"] == -1].sort_values("lang")
    langs = list(head["lang"])
    body = fitted[fitted["feature"] >= 0]
    at = np.unique(body["feature"].to_numpy(np.int64)) if len(body) else np.empty(0, np.int64)
    weights = np.zeros((len(at), len(langs)))
    if len(body):
        weights[np.searchsorted(at, body["feature"]), np.searchsorted(np.array(langs, object), body["lang"])] = body["weight"]
    t = fitted[fitted["feature"] == -2]["weight"]
    return Model(langs, head["weight"].to_numpy(float), at, weights, idf, float(t.iloc[0]) if len(t) else 1.0, s)


def predict(docs: DataFrame, model: Model, columns: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``columns`` of ``docs`` with language and probability; no other column than ``text`` is looked at."""
    dense = np.zeros((1 << model.settings.bits, len(model.langs)))
    dense[model.features] = model.weights
    langs, bias, idf, t, s = model.langs, model.bias, model.idf, model.temperature, model.settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = [], []
            for text in batch.column("__text"):
                at, count = features(text.as_py() or "", s)
                if not len(at) or not langs or not LETTER.search(text.as_py()):
                    lang.append("und")
                    score.append(0.0)
                    continue
                p = softmax((weighed(at, count, idf) @ dense[at] + bias) / t)
                lang.append(langs[int(p.argmax())])
                score.append(float(p.max()))
            kept = [c for c in batch.schema.names if c != "__text" or own]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*kept, *names])

    own = "__text" in columns
    chosen = docs.select(*columns) if own else docs.select(*columns, F.col("text").cast("string").alias("__text"))
    fields = [f for f in chosen.schema if f.name != "__text" or own]
    return chosen.mapInArrow(run, T.StructType([*fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def identify(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; a third of the documents takes no part in learning."""
    marked = docs.select("doc_id", "text", "lang", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"))
    model = train(marked.where(~F.col("held_out")), s)
    return predict(marked, model, ["doc_id", "held_out"])


def reject_unknown(docs: DataFrame, min_score: float = 0.3, s: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows that have no letter or whose best language is less likely than ``min_score``."""
    model = train(docs.where(F.coalesce(fold(F.col("doc_id"), 3) != 1, F.lit(True))), s)
    # The text travels once, under the name that ``predict`` reads.
    renamed = docs.withColumnRenamed("text", "__text")
    scored = predict(renamed, model, renamed.columns, ("__lang", "__score"))
    kept = scored.where((F.col("__lang") != "und") & (F.col("__score") >= min_score)).drop("__lang", "__score")
    return kept.withColumnRenamed("__text", "text")
