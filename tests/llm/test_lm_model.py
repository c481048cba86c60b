"""The language model where counts are unusual or files are missing."""

import math
import os

import numpy as np
import pyarrow as pa
import pytest

from outlay.llm import kneserney
from outlay.llm.shingles import words_of


@pytest.mark.parametrize("often", [(1, 2, 2, 9, 20), (9, 1, 8, 1, 30), (5, 0, 2, 1, 3), (4, 3, 2, 1, 5)])
def test_discounts_leave_something(often):
    n1, n2, n3, n4, more = often
    model = kneserney.Model("", 2, 0, {2: [100, 50, n1, n2, n3, n4, more]})
    d = model.discounts(2)
    assert d[0] == 0 and all(0 < x < k for x, k in zip(d[1:], (1.0001, 2, 3)))


def test_scores_are_finite_where_every_follower_is_frequent(spark):
    # Trigrams seen once, twice, ... with rising counts of counts, and contexts all of whose followers are frequent.
    texts = [f"s{k} t{k} u{j}" for k, times in ((1, 1), (2, 2), (3, 2), (4, 9)) for j in range(times) for _ in range(k)]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    model = kneserney.train(train, 3)
    docs = spark.createDataFrame([(1, "s4 t4 never"), (2, "s4 t4 u0"), (3, "none of these words"), (4, None)], "doc_id int, text string")
    scores = {r.doc_id: r.score for r in kneserney.score(docs, model).collect()}
    assert all(math.isfinite(x) and x < 0 for x in scores.values()) and scores[2] > scores[1]


def test_missing_shards_are_an_error(spark):
    train = spark.createDataFrame([("a b c",), ("a b d",)], "text string")
    model = kneserney.train(train, 2)
    assert set(model.files()) == {0, 1, 2}
    kneserney.Arrays(model)
    os.rename(f"{model.folder}/grams1", f"{model.folder}/elsewhere")
    with pytest.raises(FileNotFoundError, match="grams1: 0 of 1 shards"):
        kneserney.Arrays(model)
    words = kneserney.grams([np.array([kneserney.END])], 2)
    os.rename(f"{model.folder}/elsewhere", f"{model.folder}/grams1")
    assert 0 < kneserney.Arrays(model).probabilities(words)[0][0] < 1


def test_packed_trigrams_have_no_hashes():
    rnd = np.random.default_rng(3)
    columns = [(1_000_000 ** rnd.random(200_000)).astype(np.uint32) for _ in range(3)]
    columns, (counts,) = kneserney.summed_rows(columns, np.ones(200_000, np.uint64))
    blob = kneserney.pack(columns, [counts])
    assert len(blob) < 6 * len(counts)
    for got, want in zip(kneserney.unpack([blob, blob], 3, 1), [*columns, counts]):
        assert (got == np.concatenate([want, want])).all()


@pytest.mark.parametrize("bits", [0, 3, 18])
def test_stored_rows_take_six_bytes_and_are_found(tmp_path, bits):
    rnd = np.random.default_rng(bits)
    n = 20_000 if bits else 2_000_000
    every = np.unique(rnd.integers(0, 1 << (64 - bits), 2 * n, np.uint64, endpoint=False))
    # Rows that differ only in their last bits share an index entry and their upper bytes.
    every = np.unique(np.concatenate([every, every[:500] + np.uint64(1), every[:500] + np.uint64(2)]))
    here = rnd.random(len(every)) < 0.5
    counts = (rnd.pareto(2, here.sum()) + 1).astype(np.uint64)
    counts[:9] = 1 << 40
    kneserney.store(str(tmp_path), 3, 0, every[here], counts, bits)
    if not bits:
        assert (tmp_path / "grams3/000000.grams").stat().st_size < 8.5 * here.sum()
    hit, _, count = kneserney.Shard(str(tmp_path / "grams3/000000.grams")).find(every)
    assert (hit == np.flatnonzero(here)).all() and (count == counts).all()


def test_followers_of_rare_kinds():
    parts = [np.arange(5000, dtype=np.uint64) // d for d in (1, 2, 3, 4)]
    arrays = kneserney.kinds_of(parts, np.arange(0, 10_000, 2), 10_000)
    shard = kneserney.Shard.__new__(kneserney.Shard)
    shard.arrays = arrays
    got = shard.followers(np.arange(10_000))
    assert (got[::2] == np.stack(parts, 1)).all() and not got[1::2].any()


def test_words_of_blocks():
    texts = ["", "  Ab\x0bcd\x1cE\u00a0f \u0130\n", "\t\r\n", "x" * 50, "A a  A", "\u3000\x85 \x00 \x0c"]
    blocks = list(kneserney.token_blocks(iter(pa.RecordBatch.from_pydict({"text": texts[i : i + 2]}) for i in (0, 2, 4)), 8))
    hashes = kneserney.WordHashes()
    want = [[*hashes.of(words_of(t)), kneserney.END] for t in texts]
    got = [list(t) for b, _ in blocks for t in np.split(b.hashes[b.tokens], np.cumsum(b.sizes)[:-1])]
    assert got == want and len(blocks) > 1 and sum(r.num_rows for _, rows in blocks for r in rows) == len(texts)


def test_a_word_missing_from_the_vocabulary_is_an_error(spark, tmp_path):
    known = spark.createDataFrame([("a b",)], "text string")
    kneserney.numbered(known, str(tmp_path), 0, 100).collect()
    model = kneserney.Model(str(tmp_path), 2, 0, {kneserney.FILES: [1, 0, 0, 0, 0, 0, 0]})
    with pytest.raises(Exception, match="not there when words were counted"):
        kneserney.counted(spark.createDataFrame([("a c",)], "text string"), model, 100).collect()


def test_shards_and_blocks_do_not_change_scores(spark):
    rnd = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(30 ** r)}" for r in rnd.random(i % 40))) for i in range(120)], "doc_id int, text string")
    known = docs.where("doc_id % 3 > 0")
    one, many = kneserney.train(known, 3), kneserney.train(known, 3, shard_tokens=100, block=50)
    assert one.bits == 0 and many.bits > 3 and {k: v for k, v in one.stats.items() if k < kneserney.FILES} == {k: v for k, v in many.stats.items() if k < kneserney.FILES}
    assert kneserney.score(docs, one).orderBy("doc_id").collect() == kneserney.score(docs, many, block=30).orderBy("doc_id").collect()
