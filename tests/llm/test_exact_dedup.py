"""Exact duplicates: the code, the exchange at small message sizes, ties, odd rows, clashing names."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from outlay.llm import exactdedup

DOCS = "doc_id bigint, text string"


def brute(rows):
    groups = collections.defaultdict(list)
    for place, (i, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i or 0, place, i))
    out = []
    for body, found in groups.items():
        best = min(found)
        out += [(f[4], best[4], len(found), f is best or f == best, hashlib.sha256(body.encode()).hexdigest()) for f in found]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


@pytest.mark.parametrize("n,span", [(0, 8), (1, 1), (1, 1 << 40), (5, 5), (1000, 1 << 30), (300, 301)])
def test_code_round_trip(n, span):
    values = np.sort(np.array(random.Random(n).sample(range(span), n), np.int64))
    shift, unary, rest = exactdedup.golomb_encode(values, span)
    assert exactdedup.golomb_decode(n, shift, unary, rest).tolist() == values.tolist()
    if n == 1000:
        # Far below eight bytes a value.
        assert len(unary) + len(rest) < 3 * n


@pytest.mark.parametrize("sizes", [{}, {"per_sender": 3, "per_owner": 4, "spare_bits": 0}])
def test_equals_brute_force(spark, sizes):
    rnd = random.Random(5)
    texts = ["a b", " a\tb\n", "ab", "a  b  ", None, "", " \x0b\x0c\r", "x", "…é 日本", "…é日本", "\x1c", "\xa0", "z " * 40_000]
    rows = [(i, rnd.choice(texts) if i % 3 else f"w{rnd.randrange(60)} v") for i in range(400)]
    # A group with a third of all rows, rows repeated with their id, ties and rows without an id.
    rows += [(1000 + i, "hot text" + " " * (i % 2)) for i in range(300)] + [(7, "again")] * 3 + [(None, "again"), (None, None), (None, "n"), (None, "n ")]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    assert got(exactdedup.exact_duplicates(docs, **sizes)) == brute(rows)


def test_copies_are_removed_and_columns_stay(spark):
    rows = [(2, "a b"), (1, "ab"), (3, "a b"), (4, None), (None, " ")]
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.lit("mine").alias(c) for c in ("row", "sha", "body", "size", "print", "doc", "n", "best", "word", "mask")])
    kept = exactdedup.remove_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.sha, r.doc) for r in kept.collect() if r.doc_id) == [(2, "a b", "mine", "mine")]
    # White space alone is longer than nothing, so the row without an id stays.
    assert kept.count() == 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert exactdedup.exact_duplicates(docs).count() == 0 and exactdedup.remove_copies(docs).columns == ["doc_id", "text"]
