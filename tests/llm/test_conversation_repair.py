"""Repairs against brute force: letters, whole conversations, a conversation over many tasks, odd rows."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from outlay.llm import convrepair
from outlay.llm.queries import op11_conversation_repair

ROWS = "conv_id bigint, turn bigint, role string, text string"
NEXT, NAME = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}


def cheapest(rows):
    """Least cost, then least audit, over all paths; ``rows`` are (initial, must go, truncated)."""
    best = {"": (0, "")}

    def insertions(found):
        for _ in range(3):
            for state, (cost, audit) in list(found.items()):
                put(found, NEXT[state], (cost + 2, audit + "I"))
        return found

    def put(found, state, path):
        found[state] = min(path, found.get(state, path))

    best = insertions(best)
    for initial, gone, cut in rows:
        after = {}
        for state, (cost, audit) in best.items():
            put(after, state, (cost + 3, audit + "D"))
            if not gone:
                if initial == NEXT[state] or (initial == "s" and state == ""):
                    put(after, initial, (cost + cut, audit + "K"))
                put(after, NEXT[state], (cost + 2 + cut, audit + "R"))
        best = insertions(after)
    return min(best[s] for s in ("", "a") if s in best)


def expected(rows):
    """The query's result for (conv_id, turn, role, text) rows, row by row."""
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        found = groups[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        found += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, found in groups.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faults, rows = set(), collections.Counter(), []
        for _, role, text in found:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            rows.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [r[0] for r in found if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = cheapest(rows)
        state, lines, left = "", [], iter(found)
        for letter in audit:
            row = next(left) if letter != "I" else None
            if letter != "D":
                state = row[1][0] if letter == "K" else NEXT[state]
                lines.append((row[1] if letter == "K" else NAME[state]) + ":" + (row[2] if row else ""))
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def test_auction_equals_all_paths(monkeypatch):
    rnd = random.Random(2)
    for chunk in (16, 3):
        monkeypatch.setattr(convrepair, "CHUNK", chunk)
        for _ in range(3000):
            letters = "".join(rnd.choice("suaoSUAOddua") for _ in range(rnd.randrange(30)))
            rows = [(k.lower(), k == "d", k.isupper()) for k in letters]
            assert convrepair.repair(letters) == cheapest(rows)


def odd_conversations(rnd):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Yes.", "Yes.", "No!", "cut", "cut ", "", " \t", None, "…é日.\n", "what?\x0b", "a.\xa0", "x " * 5000]
    rows = []
    for conv in range(60):
        for turn in range(rnd.randrange(12)):
            rows.append((conv, rnd.choice([turn, turn, turn, 3, None]), rnd.choice(roles), rnd.choice(texts)))
    rows += [(None, 5, "user", "Hi."), (None, None, "assistant", "Ho."), (None, 9, "user", "Hi.")]
    rows += [(99, 0, "user", "Alone?")] * 3
    # A conversation with a third of all rows, and one without turns.
    rows += [(77, i, rnd.choice(roles), rnd.choice(texts) if i % 3 else f"line {i}.") for i in range(200)]
    return rows + [(78, None, rnd.choice(roles), f"t{i % 7}.") for i in range(40)]


@pytest.mark.parametrize("size", [1024, 4])
def test_query_on_odd_rows(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(convrepair, "FRAGMENT", size)
    rows = odd_conversations(random.Random(4))
    random.Random(5).shuffle(rows)
    docs = spark.createDataFrame(rows, ROWS).select("*", *[F.lit("mine").alias(c) for c in ("n", "text_id", "audit", "kind", "letters")])
    docs.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = op11_conversation_repair(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


def test_repaired_rows(spark, monkeypatch):
    monkeypatch.setattr(convrepair, "FRAGMENT", 2)
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "Still there?"), (1, 3, "assistant", "Yes"), (2, 4, "assistant", " "), (3, 0, "user", "One.")]
    found = convrepair.Repair(spark.createDataFrame(rows, ROWS).repartition(3))
    got = sorted(tuple(r) for r in found.repaired().collect())
    want = [(1, 0, "system", "Be brief.", "K"), (1, 1, "user", "Hi.", "K"), (1, 2, "assistant", "", "I"), (1, 3, "user", "Still there?", "K"), (1, 4, "assistant", "Yes", "K")]
    assert got == [*want, (3, 0, "user", "One.", "K"), (3, 1, "assistant", "", "I")]
    summary = {r.conv_id: (r.cost, r.audit, r.duplicate, r.truncated) for r in found.summary().collect()}
    assert summary == {1: (6, "KKDIKK", 1, 1), 2: (3, "D", 0, 0), 3: (2, "KI", 0, 0)}


def test_empty_table(spark):
    found = convrepair.Repair(spark.createDataFrame([], ROWS))
    assert found.summary().count() == found.repaired().count() == found.digests().count() == 0
