"""Runs against brute force on words and on texts, planted runs, odd rows, clashing names."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from outlay.llm import periodicity
from outlay.llm.queries import op12_periodic_runs

DOCS = "doc_id bigint, text string"


def brute(words):
    n, found = len(words), {}
    for period in range(1, n // 4 + 1):
        i = period
        while i < n:
            j = i
            while j < n and words[j] == words[j - period]:
                j += 1
            if j - i + period >= max(6, 4 * period) and j > i:
                found.setdefault((i - period, j - i + period), period)
            i = max(j, i + 1)
    return sorted((s, length, p) for (s, length), p in found.items())


def test_runs_equal_brute_force():
    rnd = random.Random(1)
    seen = 0
    for _ in range(4000):
        n = rnd.randrange(60)
        words = [rnd.randrange(rnd.choice([1, 2, 3, 5])) for _ in range(n)]
        if n > 8:
            a, p = rnd.randrange(n // 2), rnd.randrange(1, n // 3)
            words = [words[i] if i < a or rnd.random() < 0.02 else words[a + (i - a) % p] for i in range(n)]
        words *= rnd.choice([1, 1, 2, 5])
        want = brute(words)
        assert periodicity.find_runs(words) == want
        seen += len(want)
    assert seen > 2000


def test_many_overlapping_runs():
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    assert periodicity.find_runs(list(b)) == brute(list(b))
    nested = list("aaaaaab" * 6 + "c" + "ababababx" * 5)
    assert periodicity.find_runs(nested) == brute(nested) and len(brute(nested)) > 10


@pytest.mark.parametrize("words", [["a"] * 50_000, ["a", "b"] * 25_000, [str(i % 9_000) for i in range(50_000)]])
def test_long_repetitions_are_one_run(words):
    period = len(set(words))
    assert periodicity.find_runs(words) == [(0, 50_000, period)]


def test_strongest_and_collapse():
    runs = [(0, 8, 2), (10, 12, 3), (30, 7, 1), (40, 7, 1)]
    assert periodicity.strongest(runs) == (30, 7, 1) and periodicity.strongest(runs[:2]) == (0, 8, 2) and periodicity.strongest([]) is None
    words = "x a b a b a b a b y y y y y y z".split()
    assert periodicity.collapse(words, periodicity.find_runs(words)) == "x a b y z".split()


def expected(rows):
    out = []
    for i, text in rows:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute(words)
        top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
        rest = b" ".join(w for k, w in enumerate(words) if k not in dropped)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        milli = top[0] if top[0] is None else 1000 * top[1] // top[2]
        out.append((i, len(runs), *top, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def test_query_on_odd_rows(spark, tmp_path):
    odd = [None, "", " \n\t", "x", "…é\xa0日 \x1cb", "a " * 3000, "q\x0bq\x0cq q\tq\nq", "la la la la la la di", "Ab ab " * 4]
    rows = [(i, odd[i % len(odd)]) for i in range(60)] + [(i, " ".join(f"w{(i * k) % 97}" for k in range(i))) for i in range(60, 160)]
    rows += [rows[7], rows[70], (None, "no id " * 6)]
    spark.createDataFrame(rows, DOCS).withColumn("n", F.lit("mine")).write.parquet(str(tmp_path / "documents.parquet"))
    got = op12_periodic_runs(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


def test_collapsed_texts_keep_their_columns(spark):
    rows = [(1, "a  b"), (2, "z z z z z z z b"), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.lit("mine").alias(c) for c in ("runs", "doc", "collapsed", "strongest", "n_words", "__text")])
    cut = periodicity.collapse_runs(docs)
    assert cut.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.doc) for r in cut.collect() if r.text) == [(1, "a  b", "mine"), (2, "z b", "mine")]
    assert cut.count() == 4 and periodicity.collapse_runs(docs.limit(0)).count() == 0
