"""Repair of conversations by the cheapest edits, found by an auction on a lattice of integer costs.

A repaired conversation is empty, or an optional system message and then user and assistant in turn.
The rows of a conversation are taken by ``turn`` (NULL first), then role, then the SHA-256 of the text.
Blank rows and repetitions of an earlier role and text must go; a row whose text does not end a sentence is
truncated. Keeping a row costs 0, giving it the other role 2, deleting it 3, inserting an empty message 2,
and a truncated row that stays 1. Of equally cheap edits those with the least audit string are taken: one
letter for each edit, ``D < I < K < R``.

The lattice has a node for each place between rows and each state (nothing yet, after system, after
user, after assistant). The auction holds a price for every node, never above its cost to the end, and a path
from the origin. At the end of the path it takes the cheapest arc plus price, the least letter among
equals: if the node's price is lower, it rises to that and the path contracts by one node, else the path
extends. When the path arrives, complementary slackness makes every arc of every cheapest repair tight,
and following the least tight arc from the origin spells the audit.

In Spark:

1. Rows that agree in all columns combine to one with a count; texts travel as hashes until the last step.
2. First occurrences are minima by group; only texts that do repeat within a conversation are joined back.
3. A range exchange sorts the rows, so that even a conversation with a third of all rows is spread over
   tasks. Each task packs its rows into fragments of at most ``FRAGMENT`` rows, one letter for each row, and
   repairs at once the conversations that begin and end within it.
4. Only what crosses a task's edge or is longer than a fragment is brought together, as letters; pieces
   of ``CHUNK`` rows are auctioned from the last to the first, each against the prices of the next.
5. Edits meet the texts in the order of the conversation, streamed: no task holds a conversation's texts.

The audit and the hash of a conversation are single values, so one task has to write each; it holds a byte or
two for each of the conversation's rows, and the texts pass through it one by one.

Edge cases: NULL roles and texts count as one space, so such rows are illegal or blank. NULL is a
conversation of its own. ``copies`` (if the table has that column) says how often a row counts; a
conversation whose rows all count 0 times comes back with zeros. Extra columns are ignored. An empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outlay.llm.common import NOT_SPACE, materialise

FRAGMENT, CHUNK = 1024, 16
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("", "system", "user", "assistant")
ENTERS = {"s": (NOTHING,), "u": (NOTHING, SYSTEM, ASSISTANT), "a": (USER,), "o": ()}
LEGAL = {"su", "ua", "au"}
# What a state still costs behind the last row, and the letters of it.
END, TAIL = (0, 4, 2, 0), ("", "II", "I", "")
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1


def arcs_of(kind: str, count: int = 1) -> list[list[tuple[str, int, int, int]]]:
    """By state the arcs ``(letters, cost, rows taken, next state)`` in the order of their letters.

    ``kind`` is the initial of a row's role, ``o`` for others, upper case if truncated; ``d`` are ``count``
    rows that must go. Such a series is one step: the least audit has no insertion among deletions.
    """
    initial, more = kind.lower(), TRUNCATED if kind.isupper() else 0
    out = []
    for state in range(4):
        arcs = [("D" * count, DELETE * count, 1, state), ("I", INSERT, 0, NEXT[state])]
        if kind != "d":
            if state in ENTERS[initial]:
                arcs.append(("K", more, 1, "-sua".index(initial)))
            if "-sua"[NEXT[state]] != initial:
                arcs.append(("R", REROLE + more, 1, NEXT[state]))
        out.append(arcs)
    return out


ROWS = {kind: arcs_of(kind) for kind in "suaoSUAO"}


def lattice(letters: str) -> list[list[list[tuple[str, int, int, int]]]]:
    """The steps of a conversation's letters, one for each row; ``d`` rows side by side are one step."""
    steps, place = [], 0
    while place < len(letters):
        if letters[place] != "d":
            steps.append(ROWS[letters[place]])
            place += 1
        else:
            end = place
            while end < len(letters) and letters[end] == "d":
                end += 1
            steps.append(arcs_of("d", end - place))
            place = end
    return steps


def auction(steps: list, right: tuple[int, ...], origins: tuple[int, ...]) -> list[list[int]]:
    """Prices of all nodes, exact for ``origins`` of the first column; ``right`` has those of the last one."""
    prices, least = [list(right)], min(right)
    for step in reversed(steps):
        # Whatever happens to a row, it costs at least its cheapest arc.
        least += min(cost for arcs in step for _, cost, taken, _ in arcs if taken)
        prices.append([least] * 4)
    prices.reverse()
    for origin in origins:
        path = [(0, origin)]
        while path[-1][0] < len(steps):
            place, state = path[-1]
            best, goal = -1, path[-1]
            for _, cost, taken, after in steps[place][state]:
                price = cost + prices[place + taken][after]
                if best < 0 or price < best:
                    best, goal = price, (place + taken, after)
            if prices[place][state] < best:
                prices[place][state] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(goal)
    return prices


def trace(steps: list, prices: list[list[int]], state: int) -> tuple[str, int]:
    """The letters of the least tight arcs from ``state``, and the state they lead to."""
    letters, place = [], 0
    while place < len(steps):
        for label, cost, taken, after in steps[place][state]:
            if prices[place][state] == cost + prices[place + taken][after]:
                letters.append(label)
                place, state = place + taken, after
                break
    return "".join(letters), state


def repair(letters: str) -> tuple[int, str]:
    """Cost and audit of a conversation."""
    steps = lattice(letters)
    chunks = [steps[i : i + CHUNK] for i in range(0, len(steps), CHUNK)]
    rights, right = [], END
    for i, chunk in reversed(list(enumerate(chunks))):
        rights.append(right)
        right = tuple(auction(chunk, right, (NOTHING, SYSTEM, USER, ASSISTANT) if i else (NOTHING,))[0])
    audit, state = [], NOTHING
    for chunk, end in zip(chunks, reversed(rights)):
        piece, state = trace(chunk, auction(chunk, end, (state,)), state)
        audit.append(piece)
    return right[NOTHING], "".join(audit) + TAIL[state]


# Sums of a fragment; the last six join it to its neighbours.
SUMS = ("blank", "duplicate", "truncated", "illegal", "distinct", "low", "high", "head", "tail", "first_turn", "last_turn")


def joined(a: tuple, b: tuple) -> tuple:
    """The sums of two fragments that follow one another."""
    if a[7] is None or b[7] is None:  # one of them has no row
        return b if a[7] is None else a
    illegal = a[3] + b[3] + ((a[8] + b[7]) not in LEGAL)
    distinct = a[4] + b[4] - (a[10] is not None and a[10] == b[9])
    low = b[5] if a[5] is None else a[5]
    high = a[6] if b[6] is None else b[6]
    return a[0] + b[0], a[1] + b[1], a[2] + b[2], illegal, distinct, low, high, a[7], b[8], a[9], b[10]


def outcome(sums: tuple, letters: str) -> tuple:
    cost, audit = repair(letters)
    gaps = 0 if sums[5] is None else sums[6] - sums[5] + 1 - sums[4]
    return gaps, *sums[:4], cost, audit


def initial_of(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


HEADER = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
HEADERS = [c.split()[0] for c in HEADER.split(", ")]


def keyed(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, text_id, copies`` without NULL in role and text."""
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    plain = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"), copies.cast("bigint").alias("copies"))
    return plain.withColumn("text_id", F.unhex(F.sha2("text", 256)))


def same_group(a: str, b: str) -> Column:
    return F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.role") == F.col(f"{b}.role")) & (F.col(f"{a}.text_id") == F.col(f"{b}.text_id"))


def judged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text_id, n, blank, again, cut, initial``: one row for rows that agree in all.

    Rows that count 0 times leave one row with ``n`` 0 for their conversation.
    """
    gone = F.col("copies") == 0
    some, ends = F.regexp_like("text", F.lit(NOT_SPACE)), F.regexp_like("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    marked = rows.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").otherwise(F.col("role")).alias("role"),
        F.when(gone, F.lit(b"")).otherwise(F.col("text_id")).alias("text_id"),
        "copies",
        (~gone & ~some).alias("blank"),
        (~gone & some & ~ends).alias("cut"),
    )
    cells = marked.groupBy("conv_id", "turn", "role", "text_id").agg(F.sum("copies").alias("n"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    cells = materialise(cells, "cells")
    said = cells.where("n > 0 and not blank").groupBy("conv_id", "role", "text_id")
    said = said.agg(F.count("*").alias("times"), F.count("turn").alias("placed"), F.min("turn").alias("first_turn")).where("times > 1")
    first = F.when(F.col("placed") == F.col("times"), F.col("first_turn"))
    repeated = materialise(said.select("conv_id", "role", "text_id", first.alias("first_turn")), "repeated")
    joined_ = cells.alias("c").join(repeated.alias("r"), same_group("c", "r"), "left")
    again = F.col("r.role").isNotNull() & ~F.col("c.turn").eqNullSafe(F.col("r.first_turn"))
    return joined_.select("c.conv_id", "c.turn", "c.role", "c.text_id", "n", "blank", again.alias("again"), "cut", initial_of(F.col("c.role")).alias("initial"))


class Fragment:
    """Rows of one conversation side by side; ``turns`` to ``counts`` have one entry for each."""

    def __init__(self, conv: object, begins: bool):
        self.conv, self.begins = conv, begins
        self.turns: list = []
        self.roles: list = []
        self.ids: list = []
        self.counts: list = []
        self.letters: list[str] = []
        self.sums = (0, 0, 0, 0, 0, None, None, None, None, None, None)

    def add(self, turn: int | None, role: str, text_id: bytes, n: int, blank: bool, again: bool, cut: bool, initial: str) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.ids.append(text_id)
        self.counts.append(n)
        if n:
            live = not (blank or again)
            row = (n if blank else 0, 0 if blank else n - live, int(live and cut), n - 1, int(turn is not None), turn, turn, initial, initial, turn, turn)
            self.sums = joined(self.sums, row)
            self.letters.append((initial.upper() if cut else initial) + "d" * (n - 1) if live else "d" * n)

    def row(self, name: str, ends: bool) -> tuple:
        letters, closed = "".join(self.letters), self.begins and ends
        done = outcome(self.sums, letters) if closed else (None,) * len(HEADERS)
        return (self.conv, name, self.turns[0], self.roles[0], self.ids[0], self.turns, self.roles, self.ids, self.counts, letters, *self.sums, closed, *done)


def rows_of(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in columns))


def record_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def map_rows(df: DataFrame, schema: T.StructType, fn) -> DataFrame:
    """``fn`` from the rows of a partition, as tuples, to rows of ``schema``; a batch at a time is held."""
    from pyspark.sql.pandas.types import to_arrow_schema

    columns, out = df.columns, to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return record_batches(fn(row for batch in batches for row in rows_of(batch, columns)), out)

    return df.mapInArrow(run, schema)


def schema_of(kind: T.DataType, rest: str) -> T.StructType:
    schema = T.StructType().add("conv_id", kind)
    for field in T._parse_datatype_string(rest).fields:
        schema = schema.add(field)
    return schema


def fragments(cells: DataFrame) -> DataFrame:
    """Sorted rows packed by conversation; ``closed`` ones are whole conversations and have their outcome."""
    keys = ["conv_id", "turn", "role", "text_id"]
    types = {c: "string" if c in ("head", "tail") else "bigint" for c in SUMS}
    sums = ", ".join(f"sum_{c} {types[c]}" for c in SUMS)
    rest = f"fragment string, turn bigint, role string, text_id binary, turns array<bigint>, roles array<string>, ids array<binary>, counts array<bigint>, letters string, {sums}, closed boolean, {HEADER}"

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        task, number, part = TaskContext.get().partitionId(), 0, None
        for conv, *cell in rows:
            if part is None or conv != part.conv or len(part.turns) == FRAGMENT:
                if part is not None:
                    yield part.row(f"{task}-{number}", conv != part.conv)
                    number += 1
                part = Fragment(conv, part is not None and conv != part.conv)
            part.add(*cell)
        if part is not None:
            yield part.row(f"{task}-{number}", False)

    ordered = cells.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return map_rows(ordered, schema_of(cells.schema["conv_id"].dataType, rest), run)


def brought_together(open_: DataFrame) -> DataFrame:
    """``fragment, piece, state, base, ends`` of fragments of conversations that no task had whole; the first
    one of each conversation has the outcome."""
    kind = open_.schema["conv_id"].dataType
    chosen = open_.select("conv_id", "turn", "role", "text_id", "fragment", "letters", *[f"sum_{c}" for c in SUMS])
    ordered = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text_id").drop("turn", "role", "text_id")

    def pieces(conv: object, held: list[tuple[str, str]], sums: tuple) -> Iterator[tuple]:
        done = outcome(sums, "".join(letters for _, letters in held))
        audit, place, state, base = done[-1], 0, NOTHING, 0
        for i, (name, letters) in enumerate(held):
            start, begin, first, left = place, state, base, len(letters)
            ends = i == len(held) - 1
            while left or (ends and place < len(audit)):
                label = audit[place]
                left -= label != "I"
                row = letters[len(letters) - left - 1].lower() if label == "K" else ""
                state = state if label == "D" else "-sua".index(row) if row else NEXT[state]
                base += label != "D"
                place += 1
            yield (conv, name, audit[start:place], begin, first, ends, *(done if not i else (None,) * len(HEADERS)))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple[str, str]] = []
        conv, total = None, None
        for now, name, letters, *sums in rows:
            if held and now != conv:
                yield from pieces(conv, held, total)
                held = []
            total = joined(total, tuple(sums)) if held else tuple(sums)
            conv = now
            held.append((name, letters))
        if held:
            yield from pieces(conv, held, total)

    return map_rows(ordered, schema_of(kind, f"fragment string, piece string, state int, base bigint, ends boolean, {HEADER}"), run)


def edits(pieces: DataFrame) -> DataFrame:
    """Rows that stay or have insertions beside them: ``conv_id, turn, role, text_id, base, before, new_role, after``.

    ``before`` and ``after`` are the initials of inserted rows, ``base`` counts the repaired rows ahead.
    """
    chosen = pieces.select("conv_id", "turns", "roles", "ids", "counts", "piece", "state", "base")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, turns, roles, ids, counts, piece, state, base in rows:
            place = 0
            for i, (turn, role, text_id, count) in enumerate(zip(turns, roles, ids, counts)):
                start, before, stays, after = base, "", None, ""
                last = i == len(turns) - 1
                while count or (last and place < len(piece)):
                    label, place = piece[place], place + 1
                    count -= label != "I"
                    if label == "D":
                        continue
                    state = "-sua".index(role[0]) if label == "K" else NEXT[state]
                    base += 1
                    if label != "I":
                        stays = role if label == "K" else ROLE[state]
                    elif stays is None:
                        before += "-sua"[state]
                    else:
                        after += "-sua"[state]
                if base > start:
                    yield conv, turn, role, text_id, start, before, stays, after

    rest = "turn bigint, role string, text_id binary, base bigint, before string, new_role string, after string"
    return map_rows(chosen, schema_of(pieces.schema["conv_id"].dataType, rest), run)


class Repair:
    """The outcome of each conversation and the edits of its rows; ``rows`` has ``conv_id, turn, role, text``."""

    def __init__(self, rows: DataFrame):
        self.rows = keyed(rows)
        self.kind = self.rows.schema["conv_id"].dataType
        parts = materialise(fragments(judged(self.rows)), "fragments")
        open_ = parts.where("not closed")
        found = materialise(brought_together(open_), "pieces")
        columns = ["conv_id", "turns", "roles", "ids", "counts", "piece", "state", "base", *HEADERS]
        whole = parts.where("closed").select("*", F.col("audit").alias("piece"), F.lit(0).alias("state"), F.lit(0).cast("bigint").alias("base")).select(*columns)
        rest = open_.drop("conv_id", *HEADERS).join(found, "fragment").select(*columns)
        self.pieces = whole.union(rest)

    def summary(self) -> DataFrame:
        """``conv_id``, the counts of faults, ``cost`` and ``audit`` of every conversation."""
        return self.pieces.where(F.col("audit").isNotNull()).select("conv_id", *HEADERS)

    def _merged(self, headers: bool) -> DataFrame:
        """Edits, each ahead of the row it belongs to, and that row's text."""
        columns = ["conv_id", "turn", "role", "text_id", "kind", "text", "base", "before", "new_role", "after"]
        heads = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in HEADER.split(", ")] if headers else []

        def null(name: str, kind: str) -> Column:
            return F.lit(None).cast(kind).alias(name)

        done = edits(self.pieces).select("conv_id", "turn", "role", "text_id", F.lit(1).alias("kind"), null("text", "string"), "base", "before", "new_role", "after", *heads)
        blank = [null("base", "bigint"), *[null(c, "string") for c in ("before", "new_role", "after")]]
        texts = self.rows.where("copies > 0").select("conv_id", "turn", "role", "text_id", F.lit(2).alias("kind"), "text", *blank, *heads)
        both = done.union(texts)
        if not headers:
            return both.select(*columns).repartitionByRange(*columns[:4]).sortWithinPartitions(*columns[:5])
        first = self.summary().select("conv_id", null("turn", "bigint"), F.lit("").alias("role"), F.lit(b"").alias("text_id"), F.lit(0).alias("kind"), null("text", "string"), *blank, *HEADERS)
        return both.union(first).repartition("conv_id").sortWithinPartitions("conv_id", (F.col("kind") > 0), *columns[1:5])

    def repaired(self) -> DataFrame:
        """``conv_id, position, role, text, edit`` of the rows of every repaired conversation, counted from 0."""

        def run(rows: Iterator[tuple]) -> Iterator[tuple]:
            waiting = None
            for conv, _, role, _, kind, text, base, before, new_role, after in rows:
                if kind == 1:
                    for i, c in enumerate(before):
                        yield conv, base + i, ROLE["-sua".index(c)], "", "I"
                    waiting = (base + len(before), new_role, after) if new_role is not None else None
                elif waiting:
                    place, new_role, after = waiting
                    yield conv, place, new_role, text, "K" if new_role == role else "R"
                    for i, c in enumerate(after):
                        yield conv, place + 1 + i, ROLE["-sua".index(c)], "", "I"
                    waiting = None

        return map_rows(self._merged(False), schema_of(self.kind, "position bigint, role string, text string, edit string"), run)

    def digests(self) -> DataFrame:
        """The summary with ``repaired_sha256``, the hash of the repaired ``role:text`` lines."""

        def run(rows: Iterator[tuple]) -> Iterator[tuple]:
            head, hash_, lines, waiting = None, hashlib.sha256(), 0, None

            def add(role: str, text: str) -> None:
                nonlocal lines
                hash_.update((("\n" if lines else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                lines += 1

            for conv, _, _, _, kind, text, _, before, new_role, after, *header in rows:
                if kind == 0:
                    if head is not None:
                        yield *head, hash_.hexdigest()
                    head, hash_, lines, waiting = (conv, *header), hashlib.sha256(), 0, None
                elif kind == 1:
                    for c in before:
                        add(ROLE["-sua".index(c)], "")
                    waiting = (new_role, after) if new_role is not None else None
                elif waiting:
                    add(waiting[0], text)
                    for c in waiting[1]:
                        add(ROLE["-sua".index(c)], "")
                    waiting = None
            if head is not None:
                yield *head, hash_.hexdigest()

        return map_rows(self._merged(True), schema_of(self.kind, f"{HEADER}, repaired_sha256 string"), run)
