"""English normalization as one function over a text: each rule looks only where it can apply, words are rewritten by a table in one pass."""

from __future__ import annotations

import re
import unicodedata

from .amounts import normalized_numbers
from .text import CONTRACTIONS, FILLERS, SPECIAL_LETTERS

#: Signs that stay for numbers.
KEPT = ".%$¢€£"

_WORD = re.compile(r"\w+")
#: Rules of the table for whole words without an apostrophe, by word; the others in their order.
_TITLES = {m[1]: by for pattern, by in CONTRACTIONS if (m := re.fullmatch(r"\\b(\w+)\\b", pattern))}
_APOSTROPHES = [(re.compile(pattern), by) for pattern, by in CONTRACTIONS if "'" in pattern]


class _Folded(dict):
    """Characters as they stand after symbols and diacritics are gone, each found out once."""

    def __missing__(self, code: int) -> str:
        parts = unicodedata.normalize("NFKD", chr(code))
        self[code] = "".join(_folded(c) for c in parts)
        return self[code]


def _folded(c: str) -> str:
    if c in KEPT:
        return c
    if c in SPECIAL_LETTERS:
        return SPECIAL_LETTERS[c]
    kind = unicodedata.category(c)
    return "" if kind == "Mn" else " " if kind[0] in "MSP" else c


_fold = _Folded()


def english_normalized(text: str, spellings: dict[str, str] | None = None) -> str:
    """Lower case; brackets and fillers out; contractions and titles written out; symbols and diacritics out; spelled numbers as digits;
    words by a table of spellings; signs that belong to no number out; white space as one space."""
    s = text.lower()
    if "<" in s or "[" in s:
        s = re.sub(r"[<\[][^>\]]*[>\]]", "", s)
    if "(" in s:
        s = re.sub(r"\(([^)]+?)\)", "", s)
    if "m" in s:
        s = re.sub(FILLERS, "", s)
    if "'" in s:
        s = re.sub(r"\s+'", "'", s)
        for pattern, by in _APOSTROPHES:
            s = pattern.sub(by, s)
    s = _WORD.sub(lambda m: _TITLES.get(m[0], m[0]), s)
    if "," in s:
        s = re.sub(r"(\d),(\d)", r"\1\2", s)
    if "." in s:
        s = re.sub(r"\.([^0-9]|$)", r" \1", s)
    s = normalized_numbers(s.translate(_fold))
    if spellings:
        s = " ".join(spellings.get(w, w) for w in s.split())
    s = re.sub(r"[.$¢€£]([^0-9])", r" \1", s)
    if "%" in s:
        s = re.sub(r"([^0-9])%", r"\1 ", s)
    return re.sub(r"\s+", " ", s)
