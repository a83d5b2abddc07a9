"""Porter's suffix stripping (M. F. Porter, An algorithm for suffix stripping, 1980), by tables of its rules."""

from __future__ import annotations

import re
from functools import lru_cache

# The endings of the published steps, with what replaces them. Steps 2 and 3 ask for a measure above 0, step 4 for one above 1.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def shape(stem: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel after a consonant."""
    out = ""
    for letter in stem:
        out += "v" if letter in "aeiou" or letter == "y" and out.endswith("c") else "c"
    return out


def measure(stem: str) -> int:
    """How often a run of vowels is followed by a run of consonants."""
    return len(re.findall("v+c+", shape(stem)))


def _short(stem: str) -> bool:
    return shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and shape(stem).endswith("c")


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _swapped(word: str, table: dict[str, str], least: int) -> str:
    """The word with its longest known ending replaced, where what stands before has enough measure."""
    ending = _longest(word, table)
    return word[: -len(ending)] + table[ending] if ending and measure(word[: -len(ending)]) > least else word


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters, or with other signs than a to z, stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    word = _swapped(word, {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}, -1)
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) else word
    elif (ending := _longest(word, ("ed", "ing"))) and "v" in shape(word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")) or not _double(word) and measure(word) == 1 and _short(word):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swapped(_swapped(word, STEP2, 0), STEP3, 0)
    ending = _longest(word, STEP4)
    if ending and measure(word[: -len(ending)]) > 1 and (ending != "ion" or word[-4] in "st"):
        word = word[: -len(ending)]
    if word.endswith("e") and (measure(word[:-1]) > 1 or measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word
