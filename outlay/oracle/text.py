"""The report texts as SQL concatenations, from the same fixed values the operators use."""

from __future__ import annotations

from string import Formatter


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def say(template: str, **sql: str) -> str:
    pieces = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(quote(literal))
        if name:
            pieces.append(sql[name])
    return "(" + " || ".join(pieces) + ")"
