"""Functions that are procedures by nature, each over an Arrow batch: subword tokenizers,
repetition, HTML nodes, alignment, spectra. The plain functions work on one value; the *_udf wrap them.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: Words whose pieces a worker remembers before it starts anew.
KNOWN_WORDS = 50_000
#: Bytes of text, and words, that a worker holds as Python objects at once, whatever the size of a batch.
STEP_BYTES, STEP_WORDS = 1 << 20, 1 << 16


def _slices(column: pa.Array, length: pa.Array, most: int) -> Iterator[pa.Array]:
    """Runs of rows of a batch whose lengths come to `most` at most; a longer row is a run of its own."""
    upto = np.cumsum(pc.fill_null(length, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield column.slice(at, end - at)
        at = end


def text_slices(texts: pa.Array) -> Iterator[pa.Array]:
    return _slices(texts, pc.binary_length(texts), STEP_BYTES)


def word_slices(words: pa.Array) -> Iterator[pa.Array]:
    return _slices(words, pc.list_value_length(words), STEP_WORDS)


# ---------------------------------------------------------------- subwords


def wordpieces(word: str, vocabulary: frozenset[str], unknown: str = "[UNK]", longest: int = 100) -> list[str]:
    """Greedy longest pieces, later ones marked ##; a word that is too long or cannot be covered is unknown."""
    if len(word) > longest:
        return [unknown]
    out, at = [], 0
    while at < len(word):
        mark = "##" if at else ""
        end = next((e for e in range(len(word), at, -1) if mark + word[at:e] in vocabulary), None)
        if end is None:
            return [unknown]
        out.append(mark + word[at:end])
        at = end
    return out


def _pieces_udf(pieces: Callable[[str], list[str]]):
    """Array of words to array of their pieces, some rows of a batch at a time. Their different words are cut once each, a worker remembers those of
    KNOWN_WORDS words, and the pieces of all occurrences are gathered."""
    known: dict[str, list[str]] = {}

    def cut(words: pa.Array) -> pa.Array:
        flat = words.flatten().dictionary_encode()
        if len(known) > KNOWN_WORDS:
            known.clear()
        table = []
        for w in flat.dictionary.to_pylist():
            got = known.get(w)
            if got is None:
                got = known[w] = pieces(w)
            table.append(got)
        size = np.array([len(x) for x in table], np.int64)
        first = np.cumsum(size) - size
        row = flat.indices.drop_null().to_numpy()
        n = size[row] if len(size) else np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(n)])
        values = pa.array([p for x in table for p in x], pa.string()).take(pa.array(np.arange(upto[-1]) + np.repeat(first[row] - upto[:-1], n) if len(row) else [], pa.int64()))
        held = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        if flat.null_count:  # a null word has no pieces
            seen = np.concatenate([[0], np.cumsum(flat.indices.is_valid().to_numpy(zero_copy_only=False))])
            held = np.diff(seen[np.concatenate([[0], np.cumsum(held)])])
        bound = upto[np.concatenate([[0], np.cumsum(held)])]
        return pa.ListArray.from_arrays(pa.array(bound, pa.int32()), values, mask=words.is_null())

    @F.arrow_udf("array<string>")
    def applied(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for words in word_slices(batch):
                yield cut(words)

    return applied


def wordpiece_udf(vocabulary: Iterable[str], unknown: str = "[UNK]"):
    """Array of words to array of pieces; the vocabulary goes out with the function, so it must be of a vocabulary's size."""
    known = frozenset(vocabulary)
    return _pieces_udf(lambda w: wordpieces(w, known, unknown))


def byte_letters() -> dict[int, str]:
    """A printable letter for every byte: itself where it is printable, else the next code point from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(spare)) for b in range(256)}


def merge_pairs(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The lowest-ranked adjacent pair merged everywhere, again and again until none has a rank."""
    while len(symbols) > 1:
        best = min(zip(symbols, symbols[1:]), key=lambda p: ranks.get(p, math.inf))
        if best not in ranks:
            break
        out, i = [], 0
        while i < len(symbols):
            if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == best:
                out.append(symbols[i] + symbols[i + 1])
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


def byte_bpe_udf(ranks: dict[tuple[str, str], int]):
    letters = byte_letters()
    return _pieces_udf(lambda w: merge_pairs([letters[b] for b in w.encode()], ranks))


# ---------------------------------------------------------------- repetition and documents


def _longest_square(text: str, least: int) -> int:
    """The longest unit of at least `least` and less than half of all characters that stands twice at the end; 0 if none does.

    By the Z-function of the reversed text, in linear time: the unit of r characters is repeated where r characters from r on equal
    the first ones.
    """
    back, n = text[::-1], len(text)
    if n < 2 * least:
        return 0
    z, left, right, best = [0] * n, 0, 0, 0
    for i in range(1, (n + 1) // 2):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and back[k] == back[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
        if k >= i >= least and i < n // 2:
            best = i
    return best


_SENTENCE_END = re.compile(r"[.?!\n]")


def truncate_repetitions(text: str, least: int = 30) -> str:
    """A tail that repeats a unit of at least `least` characters, the longest there is, without its repetitions, then on to the end of a
    sentence of the tail. Case does not count."""
    low = text.lower()
    size = _longest_square(low, least) if len(low) == len(text) else 0
    if not size:
        return text
    unit = low[-size:]
    kept = next(end for end in range(len(low), -1, -size) if not (end >= size and low.endswith(unit, 0, end)))
    tail, marks = low[kept:], [m.start() for m in _SENTENCE_END.finditer(low)]
    mirrored = [len(low) - 1 - m for m in reversed(marks)]  # as far from the start as the marks are from the end
    for end in marks[bisect_left(marks, kept) :]:
        start = next(iter(mirrored[bisect_left(mirrored, kept) :]), 0)
        if not (end and start):
            break
        kept = end + 1
        if low[start:end] in tail:
            break
    return text[:kept]


def similar_line_runs(lines: list[str], least: int = 15, gap: int = 3) -> list[tuple[int, int]]:
    """Runs (first, last) of more than `least` lines in which one line after another is alike: equal, or with an indel similarity
    above 0.9, both of 4 to 199 characters. Empty lines are passed over, marks of missing pages are never alike, and runs that are no more
    than `gap` lines apart are one."""
    shown = [i for i, x in enumerate(lines) if x]
    fits = lambda x: 3 < len(x) < 200
    alike: list[int] = []
    for i, j in zip(shown, shown[1:]):
        a, b = lines[i], lines[j]
        if fits(a) and fits(b) and not a.startswith("[MISSING_PAGE") and (a == b or indel_ratio(a, b) > 0.9):
            alike += range(i, j)
    out: list[tuple[int, int]] = []
    for i in alike:
        if out and i - out[-1][1] < gap:
            out[-1] = out[-1][0], i + 1
        else:
            out.append((i, i + 1))
    return [(a, b) for a, b in out if b - a + 1 > least]


def indel_ratio(a: str, b: str) -> float:
    """1 - insertions and deletions over the joint length: twice the longest common subsequence over it."""
    if not a and not b:
        return 1.0
    if 2 * sum((Counter(a) & Counter(b)).values()) <= 0.9 * (len(a) + len(b)):
        return 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))  # an upper bound, and that is enough of an answer
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


MISSING_PAGE = "\n\n[MISSING_PAGE_POST]\n\n"


def drop_repeated_references(text: str) -> str:
    """Runs of lines that hardly differ but for their numbers, as of references made up, cut with the heading that is left alone by it,
    each with a mark of the missing page."""
    lines = text.split("\n")
    plain = [re.sub(r"[\d_]|\*\*", "", x).strip() for x in lines]
    for a, b in reversed(similar_line_runs(plain)):
        while b + 1 < len(lines) and plain[b + 1] and indel_ratio(plain[a], plain[b + 1]) >= 0.9:
            b += 1
        lines[a : b + 1] = [MISSING_PAGE]
    return re.sub(r"## References\n+(?=\[MISSING_PAGE_POST(?::\d+)?\])", "\n\n", "\n".join(lines)) if len(lines) < len(plain) else text


_ITEM = re.compile(r"(?P<mark>[-*]) ?(?:(?:\d|[ixv])+ )?[^-*\s].*? (?P<next>[-*]) .*", re.I)
_NUMBERING = re.compile(r"[\dixv]+(?:\.[\dixv])*", re.I)


def normalize_lists(text: str) -> str:
    """Lines that begin as a list item and go on with more items, each item on a line of its own, indented by the dots of its number."""
    out = []
    for line in text.split("\n"):
        m = _ITEM.fullmatch(line)
        if m is None:
            out.append(line)
            continue
        first, *rest = line[len(m["mark"]) :].lstrip(" ").split(m["next"] + " ") if m["next"] != m["mark"] else [x for x in line.split(m["mark"] + " ")][1:]
        for k, item in enumerate([first, *rest]):
            number, _, words = item.strip().partition(" ")
            if words:
                level = number.count(".") if _NUMBERING.fullmatch(number) else 0
                out.append("\t" * level + (m["next"] if k else m["mark"]) + " " + item.strip())
    return "\n".join(out)


#: What tables look like that went wrong, and how; as they are applied, in order.
TABLE_LIMITS = (("\\begin{tabular}", 15), ("\\multicolumn", 60), ("&", 400))
TABLE_FIXES = (
    ("\\begin{table} \\begin{tabular}", "\\begin{table}\n\\begin{tabular}"),
    ("\\end{tabular} \\end{table}", "\\end{tabular}\n\\end{table}"),
    ("\\end{table} Tab", "\\end{table}\nTab"),
)
EMPTY_TABLES = (r"\begin{tabular}{l l}  & \ \end{tabular}", "\\begin{tabular}{}\n\n\\end{tabular}")


def correct_tables(text: str) -> str:
    """Lines that can only be run-away tables emptied, table parts on lines of their own, empty tables out."""
    if "\\" not in text and "&" not in text:
        return text
    text = "\n".join("" if any(x.count(part) > most for part, most in TABLE_LIMITS) else x for x in text.split("\n"))
    for wrong, right in TABLE_FIXES:
        text = text.replace(wrong, right)
    text = re.sub(r"(?m)(?<=[^\n])\\begin{tab(?!.*\\begin{tab)", r"\n\\begin{tab", text)
    for empty in EMPTY_TABLES:
        text = text.replace(empty, "")
    return text


#: The length from which a heading is text, initials that no reference has, and marks that a scan leaves behind.
LONG_HEADING, MANY_INITIALS = 100, 10
MARGIN, STAMP = "* [leftmargin=*]", "**S. A. B.**"
_NUMBERS_ONLY = re.compile(r"(?:\.?[\dixv])*\s*")
_ENTRY = re.compile(r"(\* \[\d+\])(.*)")
_LETTER = re.compile(r"(?<=(.))_([a-zA-Z0-9])_(?:_([a-zA-Z0-9]{1,3})_)?(?=(.))", re.S)
_TABULAR = re.compile(r"\\begin\{tabular\}\{([clr ]{2,})\}([&\s\\]*) \\end\{tabular\}")


def _heading(line: str) -> str | None:
    """What a heading says; None for any other line."""
    marks, space, said = line.partition(" ")
    return said if space and marks and not marks.strip("#") else None


def _headings(text: str) -> str:
    """Headings as long as a paragraph become text; numbers that head nothing, with the empty lines below, become one empty line; margins go."""
    out: list[str] = []
    lines, bare = text.split("\n"), False
    for k, line in enumerate(lines):
        said = _heading(line)
        if said is not None:
            plain = re.sub(r"^\d*\W? ?", "", said)
            line = plain if len(plain) >= LONG_HEADING else line
        if bare and not line.strip():
            continue
        bare = said is not None and _NUMBERS_ONLY.fullmatch(said) is not None
        if line != MARGIN or k in (0, len(lines) - 1):
            out.append("" if bare else line)
    return "\n".join(out)


def _reference(line: str) -> str:
    """A line of a list of references: emptied where it is all initials, without the empty brackets behind its number."""
    entry = _ENTRY.fullmatch(line)
    if entry is None:
        return line
    initials = re.sub(r"\s|\.(?=\.)", "", entry[2])[: 2 * MANY_INITIALS]
    if len(initials) == 2 * MANY_INITIALS and set(initials[1::2]) == {"."} and all("A" <= c <= "W" for c in initials[::2]):
        return ""
    return entry[1] + entry[2].removeprefix("[]")


def _footnote(line: str, whole: bool) -> str:
    """A line without notes that are marked inside it and, where it is a `whole` footnote, without what names its text twice."""
    first, *notes = line.split("[FOOTNOTE:")
    for note in notes:
        name, end, rest = note.partition("]")
        inside, close, behind = rest.partition("[ENDFOOTNOTE]")
        first += behind if name and end and close else "[FOOTNOTE:" + note
    if first.startswith("Footnote ") and whole:
        spots = [(first.find(mark), mark) for mark in (": footnotetext:", ": thanks:") if mark in first]
        if spots:
            at, mark = min(spots)
            first = first[: at + 1] + " " + re.sub(r"^\W+", "", first[at + len(mark) :])
    return first


def _formula(m: re.Match) -> str:
    """A letter in italics as a formula, with its index; only between spaces and stops."""
    before, letter, index, after = m.groups()
    if index and (before.isspace() or before in ".,()") and (after.isspace() or after in ".,:()"):
        return rf"\({letter}_{{{index[-1]}}}\)"
    if not index and (before.isspace() or before.isdigit() or before in ".,") and (after.isspace() or after.isdigit() or after in ".,;"):
        return rf"\({letter}\)"
    return m[0]


def _references(text: str) -> str:
    """References, footnotes and letters that a scan gets wrong; a lone letter that a page begins or ends with goes."""
    lines = [_reference(x) for x in text.split("\n")]
    whole = [False, *(not x for x in lines[2:]), True]  # with an empty line, or none, below
    text = "\n".join(_footnote(x, e) for x, e in zip(lines, whole))
    alone = lambda c: c.isalnum() or c == "_"
    if text[1:3] == "\n\n" and alone(text[0]):
        text = text[3:]
    if text[-3:-1] == "\n\n" and alone(text[-1]):
        text = text[:-3]
    return _LETTER.sub(_formula, text)


def _leftovers(text: str) -> str:
    """Empty tables, stamps that stand twice, headings and full stops on their own, and more than one empty line."""
    text = _TABULAR.sub(lambda m: "" if m[2].count("\\") in (0, 2) else m[0], text.replace("\\begin{array}[]{", "\\begin{array}{"))
    text = re.sub(f"(?:{re.escape(STAMP)}\n+){{2,}}", "", text)
    short = lambda x: x[:1] == "#" and re.fullmatch(r"#+(?: [\[\w])?", x) is not None
    out: list[str] = []
    for line in text.split("\n"):
        if line.strip() or not out or out[-1] != ".":
            out.append("" if short(line) else line.rstrip() if line.rstrip() == "." else line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join("" if x == "." else x for x in out))


def _page_end(text: str) -> str:
    """What parts a page from the next: an empty line after a sentence, a heading or a caption and before one, else a space."""
    lone = text.rstrip("\n") in set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789,;:") and len(text) < 3
    opens = not lone and text.startswith(("#", "**", "\\begin"))
    sentence = text.endswith((".", "}"))
    caption = not lone and not sentence and text.rpartition("\n")[2].startswith(("#", "Figure", "Table"))
    behind = "\n\n" if sentence or caption and not opens else ""
    return ("\n\n" if opens else "") + text + behind + ("" if opens or caption else " ")


def clean_document(text: str) -> str:
    """A scanned page's text by all of the rules above: headings, repetitions, references, formulas, lists, the end of the page, tables."""
    text = _headings((text or "").strip())
    head, newline, last = text.rpartition("\n")
    if newline and _heading(last) is not None:  # a heading that nothing follows
        text = head
    text = _references(drop_repeated_references(truncate_repetitions(text)))
    return _leftovers(correct_tables(_page_end(normalize_lists(text))))


def final_text(tokenized: str, original: str) -> str:
    """The part of the original that a tokenized answer stands for, spaces aside; the original where they don't align."""

    def packed(s: str) -> tuple[str, list[int]]:
        at = [i for i, c in enumerate(s) if c != " "]
        return "".join(s[i] for i in at), at

    plain = " ".join("".join(f" {c} " if not c.isalnum() and not c.isspace() else c for c in unicodedata.normalize("NFC", original)).split()).lower()
    start = plain.find(tokenized)
    if start < 0:
        return original
    a, where_a = packed(plain)
    b, where_b = packed(original)
    if len(a) != len(b):
        return original
    index = {p: k for k, p in enumerate(where_a)}
    first, last = index.get(start), index.get(start + len(tokenized) - 1)
    return original if first is None or last is None else original[where_b[first] : where_b[last] + 1]


def string_udf(fn: Callable[[str], str]):
    """A function of one text as an Arrow-batched column function, some rows of a batch at a time; null stays null."""

    @F.arrow_udf("string")
    def applied(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in text_slices(batch):
                yield pa.array([None if t is None else fn(t) for t in texts.to_pylist()], pa.string())

    return applied


# ---------------------------------------------------------------- HTML nodes


class _Nodes(HTMLParser):
    """Text nodes with the path of their element. Void elements hold nothing; an end tag closes the nearest open
    element of its name, and what is open inside it; one without any is ignored."""

    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[list] = [["", {}, None]]  # tag, children by tag, own entry in the parent's children
        self.found: list[tuple[str, list]] = []
        self.text: list[str] = []

    def flush(self) -> None:
        text = "".join(self.text).strip()
        self.text.clear()
        if text:
            self.found.append((text, [(s[0], s[2]) for s in self.stack[1:]]))

    def handle_starttag(self, tag, attrs):
        self.flush()
        siblings = self.stack[-1][1].setdefault(tag, [0])
        siblings[0] += 1
        if tag not in self.VOID:
            self.stack.append([tag, {}, (siblings[0], siblings)])

    def handle_startendtag(self, tag, attrs):
        self.flush()
        self.stack[-1][1].setdefault(tag, [0])[0] += 1

    def handle_endtag(self, tag):
        self.flush()
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data):
        self.text.append(data)

    def handle_comment(self, data):
        self.flush()
        if data.strip():
            self.found.append((data.strip(), [(s[0], s[2]) for s in self.stack[1:]]))


def html_nodes(source: str) -> list[tuple[str, str]]:
    """Text nodes in document order, character references decoded, stripped, empty ones left out, each with its
    xpath: a subscript where an element has siblings of its name. Scripts, styles and comments count as text."""
    p = _Nodes()
    p.feed(source or "")
    p.close()
    p.flush()
    return [(text, "".join(f"/{tag}[{n}]" if total[0] > 1 else f"/{tag}" for tag, (n, total) in path)) for text, path in p.found]


def html_nodes_udf():
    @F.pandas_udf("array<struct<node:string,xpath:string>>")
    def nodes(source: pd.Series) -> pd.Series:
        return source.map(lambda s: [{"node": n, "xpath": x} for n, x in html_nodes(s)])

    return nodes


# ---------------------------------------------------------------- spectra


def mel_filters(bins: int, filters: int, low: float, high: float, rate: int) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale."""
    mel = lambda f: 2595.0 * np.log10(1.0 + f / 700.0)
    points = 700.0 * (10 ** (np.linspace(mel(low), mel(high), filters + 2) / 2595.0) - 1.0)
    freq = np.linspace(0, rate // 2, bins)
    slope = points[None, :] - freq[:, None]
    width = np.diff(points)
    return np.maximum(0, np.minimum(-slope[:, :-2] / width[:-1], slope[:, 2:] / width[1:]))


def chroma_filters(bins: int, chroma: int, rate: int, tuning: float = 0.0) -> np.ndarray:
    """Gaussian weights of FFT bins for pitch classes, each bin's weights of unit length."""
    size = 2 * (bins - 1)
    freq = np.linspace(0, rate, size, endpoint=False)[1:]
    octave = chroma * np.log2(freq / (440.0 * 2.0 ** (tuning / chroma) / 16))
    octave = np.concatenate(([octave[0] - 1.5 * chroma], octave))
    width = np.concatenate((np.maximum(np.diff(octave), 1.0), [1.0]))
    away = np.subtract.outer(octave, np.arange(chroma)).T
    half = round(chroma / 2)
    away = np.remainder(away + half + 10 * chroma, chroma) - half
    weight = np.exp(-0.5 * (2 * away / width) ** 2)
    weight /= np.maximum(np.linalg.norm(weight, axis=0), 1e-12)
    weight *= np.exp(-0.5 * (((octave / chroma - 5.0) / 2.0) ** 2))
    return np.roll(weight, -3 * (chroma // 12), axis=0)[:, :bins].T


def fft_length(window: int) -> int:
    return 1 << max(0, (window - 1).bit_length())


def spectrogram(wave: np.ndarray, frame: int, hop: int, remove_mean: bool = False, preemphasis: float | None = None, power: float = 2.0) -> np.ndarray:
    """|FFT|^power of Hann-windowed frames: a row for each frame."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)
    count = 1 + (len(wave) - frame) // hop if len(wave) >= frame else 0
    frames = np.stack([wave[k * hop : k * hop + frame] for k in range(count)]).astype(float) if count else np.zeros((0, frame))
    if remove_mean:
        frames = frames - frames.mean(axis=1, keepdims=True)
    if preemphasis is not None:
        frames = np.concatenate([frames[:, :1] * (1 - preemphasis), frames[:, 1:] - preemphasis * frames[:, :-1]], axis=1)
    return np.abs(np.fft.rfft(frames * window, n=fft_length(frame))) ** power


def spectrogram_udf(frame: int, hop: int):
    @F.pandas_udf("array<array<double>>")
    def applied(wave: pd.Series) -> pd.Series:
        return wave.map(lambda w: None if w is None else [r.tolist() for r in spectrogram(np.asarray(w, float), frame, hop)])

    return applied
