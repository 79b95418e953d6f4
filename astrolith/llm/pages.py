"""Scanned pages: reading order from line boxes, joined words, folded letters."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex

#: signs that break a word at a line end (hyphens of several sorts, = and ~)
BREAKS = "-¬=~­‐‑–"
_SIGN = f"[{regex.escape(BREAKS)}]"
# the sign comes first in the pattern, so that the search can leap to it
_LINE_BREAK = regex.compile(rf"{_SIGN}(?<=\p{{L}}{_SIGN})[ \t]*\n[ \t]*(?=\p{{L}})")


def reading_order(text: str, xs: list[int] | None, ws: list[int] | None) -> list[str]:
    """The lines of a page, column after column.

    Two columns read straight across each other alternate line by line; their
    boxes start at different x.  Without one box per line the order stays.
    """
    lines = text.split("\n")
    if "\r" in text:
        lines = [x.rstrip("\r") for x in lines]
    if not xs or len(xs) != len(lines) or max(xs) - min(xs) < 60:
        return lines
    wide = sorted(ws)[len(ws) // 2]
    starts = sorted(set(xs))
    cuts = [b for a, b in zip(starts, starts[1:]) if b - a > max(60, 0.3 * wide)]
    if not cuts:
        return lines
    columns: list[list[str]] = [[] for _ in range(len(cuts) + 1)]
    for line, x in zip(lines, xs):
        columns[sum(x >= c for c in cuts)].append(line)
    return [line for c in columns for line in c]


def joined(lines: list[str]) -> str:
    """Lines as running text, words broken at line ends put together."""
    return _LINE_BREAK.sub("", "\n".join(lines)).replace("­", "")


def boxes(column: pa.Array) -> list[tuple[list[int], list[int]] | None]:
    """(x values, widths) per row of a line_boxes column, without dictionaries."""
    flat = column.values
    offsets = column.offsets.to_pylist()
    x, w = flat.field("x").to_pylist(), flat.field("w").to_pylist()
    out = []
    for i, ok in enumerate(column.is_valid().to_pylist()):
        a, b = offsets[i], offsets[i + 1]
        out.append((x[a:b], w[a:b]) if ok and None not in x[a:b] and None not in w[a:b] else None)
    return out


_OLD = str.maketrans({"ſ": "s", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ß": "ss", "æ": "ae", "œ": "oe", "’": "'", "|": "l"})
_DIGIT = str.maketrans("oOiIlLsSzZbBgGqj|!:", "0011115522" + "8" * 2 + "9" * 3 + "1" * 4)


@lru_cache(maxsize=400_000)
def fold(word: str) -> str:
    """Lower case without accents, old letters and ligatures; digits misread as
    letters in words, and letters misread as digits in numbers, set right."""
    w = word.translate(_OLD).lower()
    if not w.isascii():
        w = "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))
    digits = sum(c.isdigit() for c in w)
    if not digits:
        return w
    if digits * 2 >= len(w):
        return w.translate(_DIGIT)
    return w.translate(str.maketrans("0158", "olsb"))
