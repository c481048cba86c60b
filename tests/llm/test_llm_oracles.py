"""The registered corpus queries against their SQL, and those without SQL against brute force."""

import collections
import math
import os
import zlib

import pytest
from compare import check, connect

from outlay.llm import kneserney
from outlay.llm.common import read
from outlay.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    problems, n = check(QUERIES[name](spark, SF_DIR), ORACLES[name], con)
    assert not problems
    assert n


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def test_lm_scores_equal_brute_force(spark):
    got = {r.doc_id: r for r in kneserney.score_corpus(read(spark, SF_DIR, "documents"), order=2).collect()}
    docs = [(r.doc_id, r.text) for r in read(spark, SF_DIR, "documents").select("doc_id", "text").collect()]
    train = [tokens(t) for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    one = collections.Counter(w for x in train for w in x)
    two = collections.Counter(g for x in train for g in zip(["<s>", *x], x))
    left = collections.Counter(w for _, w in two)

    def discounts(counts):
        n = [0] + [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2])
        return [0] + [k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)]

    d1, d2 = discounts(left), discounts(two)
    total, known = sum(one.values()), sum(left.values())
    spare = sum(d1[min(c, 3)] for c in left.values()) / known / (len(left) + 1)
    context, mass = collections.Counter(), collections.Counter()
    for (u, _), c in two.items():
        context[u] += c
        mass[u] += d2[min(c, 3)]

    def p(u, w):
        low = max(left[w] - d1[min(left[w], 3)], 0) / known + spare
        c = two[u, w]
        return (max(c - d2[min(c, 3)], 0) + mass[u] * low) / context[u] if context[u] else low

    assert len(got) == len(docs)
    for i, text in docs:
        x, r = tokens(text), got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(one[w] > 0 for w in x), total)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert math.isclose(r.score, sum(math.log10(p(u, w)) for u, w in zip(["<s>", *x], x)), rel_tol=1e-7)
        assert math.isclose(r.base_score, sum(math.log10((one[w] + 1) / (total + len(one) + 1)) for w in x), rel_tol=1e-9)


def test_language_of_held_out_documents(spark):
    rows = QUERIES["op9_language_id"](spark, SF_DIR).join(read(spark, SF_DIR, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_token_counts_equal_the_library(spark):
    from outlay.llm.queries import VOCABULARY
    from outlay.llm.tokencount import MARK, load_vocabulary

    tokenizers = pytest.importorskip("tokenizers")
    v = load_vocabulary(VOCABULARY)
    t = tokenizers.Tokenizer(tokenizers.models.Unigram(list(zip(v.pieces, v.scores)), unk_id=0, byte_fallback=True))
    t.normalizer = tokenizers.normalizers.Sequence([tokenizers.normalizers.Prepend(MARK), tokenizers.normalizers.Replace(" ", MARK)])
    got = {r.doc_id: r.n_tokens for r in QUERIES["op6_token_counts"](spark, SF_DIR).collect()}
    for r in read(spark, SF_DIR, "documents").collect():
        assert got[r.doc_id] == len(t.encode(r.text or "").ids)


def test_lm_query_equals_brute_force_trigrams(spark):
    got = {r.doc_id: r for r in QUERIES["op3_lm_scoring"](spark, SF_DIR).collect()}
    docs = [(r.doc_id, tokens(r.text)) for r in read(spark, SF_DIR, "documents").select("doc_id", "text").collect()]
    pad = ["<s>", "<s>"]
    counts = {3: collections.Counter(g for i, x in docs if zlib.crc32(str(i).encode()) % 7 != 2 for g in zip([*pad, *x], ["<s>", *x], x))}
    counts[2], counts[1] = collections.Counter(), collections.Counter()
    for g, c in counts[3].items():
        counts[2][g[1:]] += c if g[:2] == ("<s>", "<s>") else 1
    for g in counts[2]:
        counts[1][g[1:]] += 1
    discount, context, mass = {}, {}, {}
    for n, found in counts.items():
        k = [0] + [sum(v == j for v in found.values()) for j in (1, 2, 3, 4)]
        y = k[1] / (k[1] + 2 * k[2])
        discount[n] = [0] + [j - (j + 1) * y * k[j + 1] / k[j] for j in (1, 2, 3)]
        context[n], mass[n] = collections.Counter(), collections.Counter()
        for g, c in found.items():
            context[n][g[:-1]] += c
            mass[n][g[:-1]] += discount[n][min(c, 3)]

    def p(g):
        n, u = len(g), g[:-1]
        low = p(g[1:]) if n > 1 else 1 / (len(counts[1]) + 1)
        c = counts[n][g]
        return (max(c - discount[n][min(c, 3)], 0) + mass[n][u] * low) / context[n][u] if context[n][u] else low

    for i, x in docs:
        want = sum(math.log10(p(g)) for g in zip([*pad, *x], ["<s>", *x], x))
        assert math.isclose(got[i].score, want, rel_tol=1e-7)
