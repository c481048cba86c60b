"""Near duplicates where many documents meet in very many tables without being linked."""

import random

import pytest

from outlay.llm import minhash


@pytest.fixture
def sizes(monkeypatch):
    """Rows of what is written between the steps, by purpose."""
    found, write = {}, minhash.materialise

    def counted(df, purpose):
        out = write(df, purpose)
        found[purpose] = max(found.get(purpose, 0), out.count())
        return out

    monkeypatch.setattr(minhash, "materialise", counted)
    return found


def test_a_document_has_a_row_for_each_sub_key_and_none_for_a_table(spark, sizes):
    rng = random.Random(5)
    passage = [f"w{i}" for i in range(300)]
    # The same passage with words of their own: similar at 0.66 to 0.83, mostly not linked, and one pair of near copies.
    texts = [" ".join(passage + [f"own{d}x{i}" for i in range(rng.randint(30, 75))]) for d in range(60)]
    texts.append(texts[7] + " one more")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}

    sets = [set(zip(*(t.split()[j:] for j in range(5)))) for t in texts]
    want = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((want[a], want[b]))
                want = [low if x == high else x for x in want]
    assert got == dict(enumerate(want)) and got[60] == got[7] and 1 < len(set(want)) < 60
    # 16 sub-keys on each side, 256 tables: with a row for each table this was several times as many.
    pairs_of_steps = {k: n for k, n in sizes.items() if k not in ("items", "prefixes")}
    assert max(pairs_of_steps.values()) <= 32 * len(texts), pairs_of_steps
