"""Numbers in words and words in numbers, each by one grammar.

To read numbers, every word becomes one letter that says what kind of word it is; a pattern over those letters finds the amounts
(a sign, a number, a unit); the words of each are evaluated and written once. To speak them, one pattern of written amounts is put
into words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

from .text import ABBREVIATIONS

#: English number words, scales, and the words that carry a sign, a currency or a percent.
ONES = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
SCALES = ("", "thousand", "million", "billion", "trillion", "quadrillion", "quintillion", "sextillion", "septillion", "octillion", "nonillion", "decillion")
ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
ENDINGS = {1: "st", 2: "nd", 3: "rd"}
SIGNS = {"minus": "-", "negative": "-", "plus": "+", "positive": "+"}
CURRENCIES = {"pound": "£", "pounds": "£", "euro": "€", "euros": "€", "dollar": "$", "dollars": "$", "cent": "¢", "cents": "¢"}
SPOKEN_CURRENCIES = {
    "$": "dollars", "€": "euros", "£": "pounds", "¢": "cents", "¥": "japanese yen", "﷼": "saudi riyal", "₹": "indian rupees", "₽": "russian rubles", "฿": "thai baht", "₺": "turkish liras",
    "₴": "ukrainian hryvnia", "₣": "swiss francs", "₡": "costa rican colon", "₱": "philippine peso", "₪": "israeli shekels", "₮": "mongolian tögrög", "₩": "south korean won", "₦": "nigerian naira", "₫": "vietnamese Đồng",
}


# ---------------------------------------------------------------- words to digits


@dataclass(frozen=True)
class Word:
    """A number word. kind: Z nought, U 1 to 9, E 10 to 19, T tens, S a scale, o a small number and s a scale that end a number by their suffix,
    N a figure, M a figure with its sign, + a sign, $ a currency, % percent, / per, & and, 2 double or triple, . point, w any other."""

    kind: str
    number: int = 0
    text: str = ""


def _lexicon() -> dict[str, Word]:
    out = {w: Word("Z") for w in ("o", "oh", "zero")} | {"zeroth": Word("o", 0, "th")}
    for n, w in [*enumerate(ONES)][1:] + [(10 * n, w) for n, w in enumerate(TENS) if w]:
        regular = w[:-1] + "ieth" if w.endswith("y") else w + ("h" if w.endswith("t") else "th")
        out[w] = Word("U" if n < 10 else "E" if n < 20 else "T", n)
        out["sixes" if w == "six" else w[:-1] + "ies" if w.endswith("y") else w + "s"] = Word("o", n, "s")
        out[ORDINALS[w] if w in ("one", "two", "three", "five", "twelve") else regular] = Word("o", n, ENDINGS.get(n, "th"))
    for n, w in [(100, "hundred"), *((1000**k, w) for k, w in enumerate(SCALES) if w)]:
        out |= {w: Word("S", n), w + "s": Word("s", n, "s"), w + "th": Word("s", n, "th")}
    out |= {w: Word("+", text=sign) for w, sign in SIGNS.items()} | {w: Word("$", text=sign) for w, sign in CURRENCIES.items()}
    return out | {"per": Word("/"), "percent": Word("%"), "and": Word("&"), "double": Word("2", 2), "triple": Word("2", 3), "point": Word(".")}


LEXICON = _lexicon()
#: Longer runs of figures are words like any other.
LONGEST = 300
_FIGURE = re.compile(rf"([-+£€$¢]?)([0-9]{{1,{LONGEST}}}(?:\.[0-9]{{1,{LONGEST}}})?)")
#: A number is a run of number words, an "and" after a scale, a point; a word with a suffix ends it. A point or a sign before a number word of
#: any kind is part of what follows; the last of several signs counts, and one without a number goes to the word behind it.
_AMOUNT = re.compile(
    r"(?P<sign>(?:\+(?=[^wM]))*)(?:(?P<number>[os]|(?:[NM]|[ZUETS]|2[ZUE]|\.(?=[^wM]))(?:[ZUETS]|2[ZUE]|(?<=S)&(?=[^wM])|\.(?=[^wM])|(?<=\.)N)*[os]?)"
    r"(?P<unit>(?<![os])(?:%|/\$|\$))?|(?<=\+)(?P<word>[^wM+]))"
)


def _word(text: str) -> Word:
    figure = _FIGURE.fullmatch(text)
    if figure:
        return Word("M" if figure[1] else "N", text=text)
    return LEXICON.get(text, Word("w", text=text))


class Number:
    """A number as its figures so far. `room` is how many of the last figures a small number may fill: the noughts of "twenty" or "two hundred";
    one that does not fit is written behind, as in "nineteen eighty four". spelled: figures were written one after another."""

    def __init__(self):
        self.figures, self.room, self.spelled = "", 0, False

    def whole(self, n: int) -> None:
        self.figures, self.spelled = str(n), False
        self.room = len(self.figures) - len(self.figures.rstrip("0")) if n else 2

    def figure(self, text: str) -> None:
        value = Fraction(text)
        if self.figures:  # decimals, or parts of an address
            self.write(text)
        elif value.denominator == 1:
            self.whole(int(value))
        else:
            self.write(text)

    def write(self, figures: str) -> None:
        self.figures, self.room, self.spelled = self.figures + figures, 0, True

    def small(self, n: int) -> None:
        """A number below a hundred."""
        text, was_empty, spelled, room = str(n), not self.figures, self.spelled, self.room
        if not was_empty and len(text) <= room:
            self.figures = self.figures[: -len(text)] + text
        else:
            self.write(text)
            self.spelled = spelled or not was_empty
        self.room = 1 if n >= 20 and n % 10 == 0 else 0

    def times(self, by: int) -> str | None:
        """Multiplies by a scale: all of what was spelled out ("2.5 million"), else the last group of three. Where nothing whole comes of it the
        figures so far are a number of their own, which is returned, and the scale begins the next."""
        before = self.figures
        if not before:
            self.whole(by)
        elif self.spelled or before == "0":
            product = Fraction(before) * by if _FIGURE.fullmatch(before) else Fraction(1, 2)
            if product.denominator > 1:
                self.whole(by)
                return before
            self.whole(int(product))
        else:
            self.whole(int((before[:-3] or "0") + "000") + int(before[-3:]) * by)
        return None


def _evaluated(words: list[Word]) -> list[str]:
    """The numbers of a run of number words, the last with its suffix."""
    number, out, repeat, suffix = Number(), [], 1, ""
    for w, behind in zip(words, [*words[1:], Word("w")]):
        if w.kind in "NM":
            number.figure(_FIGURE.fullmatch(w.text)[2])
        elif w.kind == "2":
            repeat = w.number
        elif w.kind == "." and behind.kind in "ZUETN":
            number.write(".")
        elif w.kind == "Z":
            number.figures = "" if number.figures == "0" and not number.spelled else number.figures
            number.write("0" * repeat)
            repeat = 1
        elif w.kind in "UETo":
            if repeat > 1:
                number.write(str(w.number) * repeat)
                repeat = 1
            else:
                number.small(w.number)
        elif w.kind in "Ss":
            ended = number.times(w.number)
            out += [ended] if ended is not None else []
        suffix = w.text if w.kind in "os" else ""
    return [*out, number.figures + suffix]


def digits_of_words(text: str) -> str:
    """Spelled numbers of lower-case words as digits: "two hundred and five" to 205, "twenty first" to 21st, "nineteen eighty
    four" to 1984, "double seven" to 77, "three point one four" to 3.14, "minus five dollars" to -$5's parts, "ten percent" to 10%."""
    said = text.split()
    words = [_word(w) for w in said]
    kinds = "".join(w.kind for w in words)
    out, done = [], 0
    for m in _AMOUNT.finditer(kinds):
        out += said[done : m.start()]
        first, done = m.start("number"), m.end()
        if m["word"]:
            out.append(words[done - 2].text + said[done - 1])
            continue
        if (m["unit"] or "").startswith("/") and said[done - 1] != "cent":
            done -= 2  # "per" something else
        unit = kinds[m.end("number") : done]
        sign = words[first - 1].text if m["sign"] else _FIGURE.fullmatch(words[first].text)[1] if words[first].kind == "M" else ""
        *others, last = _evaluated(words[first : m.end("number")])
        if not last:  # a point that nothing follows has no unit either
            unit, done = "", m.end("number")
        sign = words[done - 1].text if unit == "$" else sign
        for k, number in enumerate([*others, last]):
            if not number:
                continue
            out.append((sign if k == 0 or unit == "$" and number is last else "") + number + ("%" if unit in ("%", "/$") and number is last else ""))
    return " ".join(out + said[done:])


_HALF = re.compile(r"(?:(\S+)\s+)?\band\s+a\s+half\b")
#: Between a letter and a figure, but not before an ending of a number; and the space before an ending.
_TOUCH = re.compile(r"(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])(?!(?:st|nd|rd|th|s)\b)")
_APART = re.compile(r"(?<=[0-9])\s+(?=(?:st|nd|rd|th|s)\b)")


def number_rules_before(text: str) -> str:
    """ "two and a half" to "two point five"; letters and figures that touch are parted, but for the endings st, nd, rd, th and s."""

    def half(m: re.Match) -> str:
        if m[1] is None:
            return ""
        return m[1] + (" point five" if _word(m[1]).kind in tuple("ZUETS") else " and a half")

    return _APART.sub("", _TOUCH.sub(" ", " ".join(_HALF.sub(half, text).split())))


#: A whole sum with its cents, behind a dot or as a sum of their own.
_SUM = re.compile(r"(?P<unit>[€£$])(?P<whole>[0-9]+)(?P<joint> (?:and )?¢|\.)(?P<cents>[0-9]{1,2})\b")


def number_rules_after(text: str) -> str:
    """ "$2 and ¢7" to $2.07, "$0.07" to ¢7, and a lone "1" or "1s" as a word."""

    def joined(m: re.Match) -> str:
        if m["whole"] == "0":
            return f"¢{int(m['cents'])}"
        return m[0] if m["joint"] == "." else f"{m['unit']}{m['whole']}.{m['cents']:0>2}"

    return " ".join({"1": "one", "1s": "ones"}.get(w, w) for w in _SUM.sub(joined, text).split(" "))


def normalized_numbers(text: str) -> str:
    return number_rules_after(digits_of_words(number_rules_before(text)))


# ---------------------------------------------------------------- digits to words


def _groups(n: int) -> Iterator[tuple[int, str]]:
    """Groups of three figures from the highest on, with their scales; groups of zeros are left out."""
    figures = str(n)
    k = -(-len(figures) // 3)
    for group in re.findall(r"\d{3}", figures.zfill(3 * k)):
        k -= 1
        if int(group):
            yield int(group), SCALES[k]


def number_words(n: int, between: str = ", ", joint: str = "-", hundred: str = " ") -> str:
    """An integer in English words: what stands between groups of three figures, between tens and ones, and after a hundred."""
    if n < 0:
        return "minus " + number_words(-n, between, joint, hundred)
    if n < 20:
        return ONES[n]
    if n < 100:
        return TENS[n // 10] + (joint + ONES[n % 10] if n % 10 else "")
    if n < 1000:
        return f"{ONES[n // 100]} hundred" + (hundred + number_words(n % 100, between, joint) if n % 100 else "")
    return between.join(number_words(g, between, joint, hundred) + (f" {scale}" if scale else "") for g, scale in _groups(n))


def ordinal_words(n: int) -> str:
    head, last = re.fullmatch(r"(.*?)([a-z]+)", number_words(n)).groups()
    return head + (ORDINALS.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th"))


def year_words(n: int) -> str:
    """1001 to 2999: hundreds where the century is round, no comma in the years up to 2009, else as any number."""
    if 2000 <= n < 2010:
        return "two thousand" + (" " + ONES[n % 100] if n % 100 else "")
    return number_words(n // 100) + " hundred" if n % 100 == 0 else number_words(n)


def _read(figures: str) -> str:
    figures = figures.lstrip("0") or "0"
    if len(figures) > 18:
        return "number out of range"
    return year_words(int(figures)) if 1000 < int(figures) < 3000 else number_words(int(figures))


#: A sum of dollars, a sum of pounds, or a number with decimals and an ordinal ending. Commas stand between figures only.
_WRITTEN = re.compile(r"\$(?P<dollars>[0-9.,]*[0-9])|£(?P<pounds>[0-9](?:[0-9,]*[0-9])?)|(?P<whole>[0-9](?:[0-9,]*[0-9])?)(?:\.(?P<part>[0-9]+))?(?P<ordinal>st|nd|rd|th)?")


def _dollars(amount: str, spoken_ordinals: bool) -> str:
    whole, *cents = amount.replace(",", "").split(".")
    if len(cents) > 1:
        return spell_numbers(amount, spoken_ordinals) + " dollars"
    parts = [(whole.lstrip("0"), "dollar"), (cents[0].lstrip("0") if cents else "", "cent")]
    return ", ".join(f"{_read(n)} {unit}{'s' * (n != '1')}" for n, unit in parts if n) or "zero dollars"


def spell_numbers(text: str, spoken_ordinals: bool = True) -> str:
    """Numbers as read aloud: sums of dollars and pounds, decimals, ordinals, years, integers. Ordinals are words of their own
    ("twenty-first"), or with spoken_ordinals False the number's words and the ending ("twenty-onest"), as speech front ends have it."""

    def said(m: re.Match) -> str:
        if m["dollars"]:
            return _dollars(m["dollars"], spoken_ordinals)
        if m["pounds"]:
            return _read(m["pounds"].replace(",", "")) + " pounds"
        whole, part, ending = m["whole"].replace(",", ""), m["part"], m["ordinal"]
        if ending and len(part or whole) <= 18:
            last = int(part or whole)
            own = ordinal_words(last) if spoken_ordinals else number_words(last) + ("th" if 10 <= last % 100 <= 20 else ENDINGS.get(last % 10, "th"))
        else:
            own = _read(part or whole)
        return f"{_read(whole)} point {own}" if part else own

    return _WRITTEN.sub(said, text)


_SPEECH = re.compile(r"(?<!\w)(?P<minus>-)?(?P<unit>[" + "".join(SPOKEN_CURRENCIES) + r"])?(?P<whole>[0-9](?:[0-9,]*[0-9])?)(?:\.(?P<part>[0-9]+))?(?P<percent>%)?")


def speak_numbers(text: str) -> str:
    """Numbers for speech: a minus, thousands commas, decimals figure by figure, percent and the currency behind."""

    def said(m: re.Match) -> str:
        whole = m["whole"].replace(",", "")
        own = number_words(int(whole), " ", " ", " and ") if len(whole) <= 3 * len(SCALES) else " ".join(ONES[int(c)] for c in whole)
        out = ("minus " if m["minus"] else "") + own
        if m["part"] and m["part"] != "00":
            out += " point " + " ".join(ONES[int(c)] for c in m["part"])
        return out + (" percent" if m["percent"] else "") + (" " + SPOKEN_CURRENCIES[m["unit"]] if m["unit"] else "")

    return _SPEECH.sub(said, text)


_SHORT = re.compile(r"\b(" + "|".join(short for short, _ in ABBREVIATIONS) + r")\.")


def speech_text(text: str) -> str:
    """Text for a speech front end: ASCII only, lower case, numbers in words with their endings, abbreviations written out, one
    space for white space, no double quotes."""
    plain = spell_numbers(text.encode("ascii", "ignore").decode().lower(), spoken_ordinals=False)
    return re.sub(r"\s+", " ", _SHORT.sub(lambda m: dict(ABBREVIATIONS)[m[1]], plain)).replace('"', "")
