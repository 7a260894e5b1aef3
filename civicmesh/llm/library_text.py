"""Where the tokenizers library and this Python know different versions of Unicode.

A character that was assigned lately may be a letter, have a small form or be a combining mark to one of both only. The
differences are not listed here but measured on the driver, once a process: the library's own classes and normal forms of
every code point are held against those of ``regex``, ``str`` and ``unicodedata``. Workers get the few that differ and
treat these as the library does.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

#: Code points with anything assigned in any version: the first four planes and the tags.
SCANNED = (*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000))
#: A mark below, a mark above and a mark of the highest class: what a code point does behind them tells its own class.
MARKS = "̣́ͅ"
#: A character of each class that no other part of a word pattern names.
STAND_INS = {"L": "ª", "N": "0", "S": "\t", "": "*"}


class Differences:
    """Code points that the library sees otherwise.

    ``classes``: a stand-in of the library's class; ``small``: the library's small form; ``marks``: code points at which the
    library's composition breaks off, as it takes them for starters; ``any``: finds one of all these."""

    def __init__(self, classes: dict[int, str], small: dict[int, str], marks: set[int]):
        self.classes, self.small, self.marks = classes, small, marks
        self.any = re.compile(_set({*classes, *small, *marks}))
        self.runs = re.compile(f"({_set(marks)})")

    def __reduce__(self):
        return Differences, (self.classes, self.small, self.marks)

    def composed(self, text: str) -> str:
        """NFC of the runs between the library's additional starters."""
        return "".join(part if i % 2 else unicodedata.normalize("NFC", part) for i, part in enumerate(self.runs.split(text)))


def _set(points: set[int]) -> str:
    """A pattern for one of these code points; one that nothing fits if there are none."""
    order, out = sorted(points), []
    for c in order:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out) + "]" if out else "(?!)"


def _inside(spans, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    for a, b in spans:
        out[a:b] = True
    return out


@lru_cache(maxsize=1)
def differences() -> Differences:
    from tokenizers import Regex, normalizers, pre_tokenizers

    chars = [*map(chr, SCANNED)]
    text, n = "".join(chars), len(chars)
    theirs: dict[str, np.ndarray] = {}
    differs = np.zeros(n, bool)
    for name, cls, own in (("L", r"\p{L}+", r"\p{L}+"), ("N", r"\p{N}+", r"\p{N}+"), ("S", r"\s+", r"\p{White_Space}+")):
        found = pre_tokenizers.Split(Regex(cls), "removed", invert=True).pre_tokenize_str(text)
        theirs[name] = _inside((span for _, span in found), n)
        differs |= theirs[name] != _inside((m.span() for m in regex.finditer(own, text)), n)
    classes = {}
    for i in np.flatnonzero(differs).tolist():
        classes[SCANNED[i]] = STAND_INS[next((k for k in "LNS" if theirs[k][i]), "")]

    lines = "\n".join(chars[11:])  # a line for each character after the line end itself
    small = normalizers.Lowercase().normalize_str(lines).split("\n")
    small = {ord(c): b for c, a, b in zip(chars[11:], lines.lower().split("\n"), small, strict=True) if a != b}

    marks = set()
    known = [c for c in chars[11:] if c > "˿"]
    for mark in MARKS:
        lines = "\n".join("a" + mark + c for c in known)
        pairs = zip(known, unicodedata.normalize("NFC", lines).split("\n"), normalizers.NFC().normalize_str(lines).split("\n"), strict=True)
        marks |= {ord(c) for c, a, b in pairs if a != b}
    lines = "\n".join(known)
    for a, b in zip(unicodedata.normalize("NFD", lines).split("\n"), normalizers.NFD().normalize_str(lines).split("\n"), strict=True):
        if a != b:
            marks |= {*map(ord, a[1:])}
    return Differences(classes, small, marks)
