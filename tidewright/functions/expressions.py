"""Expressions that specs may hold: arithmetic, comparison, CASE and CAST over a table's own columns."""

from __future__ import annotations

import re

from ..errors import SpecError

TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|([A-Za-z_]\w*)|('(?:[^']|'')*')|(<=|>=|<>|!=|[-+*/%<>=(),]))")
WORDS = frozenset("case when then else end and or not in is null cast as between like true false int bigint double float string varchar date timestamp boolean".split())
CALLS = frozenset("round abs floor ceil coalesce nullif least greatest upper lower concat year month day length".split())


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, token): number, name, text or sign. SpecError for anything else."""
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise SpecError(f"{text!r}: {text[at:at + 10]!r} is not allowed here")
        kind = ("number", "name", "text", "sign")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


def names(text: str, columns: set[str] | None = None) -> set[str]:
    """Columns that an expression reads; with `columns`, any other name is an error."""
    found, parts = set(), tokens(text)
    for k, (kind, token) in enumerate(parts):
        if kind != "name" or token.lower() in WORDS and (columns is None or token not in columns):
            continue
        if k + 1 < len(parts) and parts[k + 1][1] == "(":
            if token.lower() not in CALLS:
                raise SpecError(f"{text!r}: the function {token!r} is not allowed")
            continue
        if columns is not None and token not in columns:
            raise SpecError(f"{text!r}: no column {token!r}")
        found.add(token)
    return found


def safe_sql(text: str, columns: set[str]) -> str:
    """The expression with every divisor wrapped, so that a division by zero gives null."""
    names(text, columns)
    parts = [f"`{t}`" if kind == "name" and t in columns else t for kind, t in tokens(text)]

    def operand(at: int) -> int:
        """Where the operand that starts at `at` ends."""
        while at < len(parts) and parts[at] in ("-", "+"):
            at += 1
        end = at + 1
        if at < len(parts) and parts[at] != "(" and end < len(parts) and parts[end] == "(":
            end += 1
        elif at >= len(parts) or parts[at] != "(":
            return end
        depth = 1
        while depth and end < len(parts):
            depth += {"(": 1, ")": -1}.get(parts[end], 0)
            end += 1
        return end

    k = len(parts) - 1
    while k >= 0:  # from the right: an inner divisor is wrapped before the outer one is taken
        if parts[k] in ("/", "%"):
            end = operand(k + 1)
            parts[k + 1 : end] = ["NULLIF", "(", *parts[k + 1 : end], ",", "0", ")"]
        k -= 1
    return " ".join(parts)
