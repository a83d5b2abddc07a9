"""Token ids of many texts by way of their words.

A tokenizer that drops white space and never joins across it gives a text the ids of its words, one after another;
one that also keeps letters apart from marks gives the ids of the pieces between letters and ASCII marks. Then
each distinct piece has to be encoded once: pieces are hashed for a whole block of texts at a time, looked up in
a table of known ones, and their ids gathered. Whether a tokenizer is of this kind is read from the normalizer and
pre-tokenizer that its file declares, and tried on a probe when the encoder is made; any other gets whole texts.
"""

from __future__ import annotations

import json
import os

import numpy as np

from ._common import ASCII_SPACE, U64, Words

#: Pieces that a worker remembers, at about 30 bytes each, before it starts anew.
KNOWN = 1_500_000
#: New pieces that wait in a small table before they are merged into the large one.
RECENT = 100_000
#: Fixed value: the split of a word tokenizer whose matches hold no white space and never both letters and ASCII marks but the apostrophe.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PROBE = "It's a Test, naïve 12 thé́ é́x  \t don't!? #tag\n z y ́a 'S'll Σας İi ﬁ 你好…, 12:30 a.,b x., Y.\r\n (a-b) x's rock'n'roll a…,b end".encode()

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True


class Pieces(Words):
    """Words, cut once more between an ASCII letter and an ASCII mark other than the apostrophe."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(data, offsets, ASCII_SPACE, fold=True)
        if len(data) < 2:
            return
        letter, mark = _LETTER[self.data], _MARK[self.data]
        cut = np.flatnonzero(letter[1:] & mark[:-1] | mark[1:] & letter[:-1]) + 1
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        cut = cut[~first[cut]]
        self.start, self.end = np.sort(np.concatenate([self.start, cut])), np.sort(np.concatenate([self.end, cut]))
        self.bound = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.bound)


def declares_pieces(declared: dict) -> bool:
    """Whether a tokenizer, by its own description, gives a text the ids of its pieces: what it normalizes never reaches over white
    space (composition, one character's lower case, runs of white space), it keeps the matches of WORD_SPLIT only, and neither
    truncates nor pads."""

    def parts(x: dict | None, name: str) -> list[dict]:
        return [] if x is None else x[name] if x["type"] == "Sequence" else [x]

    for x in parts(declared["normalizer"], "normalizers"):
        if x["type"] not in ("NFC", "Lowercase") and (x["type"], x.get("pattern"), x.get("content")) != ("Replace", {"Regex": r"\s+"}, " "):
            return False
    split, *rest = parts(declared["pre_tokenizer"], "pretokenizers") or [{"type": None}]
    if (split["type"], split.get("pattern"), split.get("behavior"), split.get("invert")) != ("Split", {"Regex": WORD_SPLIT}, "Removed", True):
        return False
    if any(x["type"] != "ByteLevel" or x["add_prefix_space"] or x["use_regex"] for x in rest):
        return False
    model = declared["model"]
    return model["type"] == "BPE" and not model["dropout"] and declared["truncation"] is None and declared["padding"] is None


class Encoder:
    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()
        self.by_piece = declares_pieces(json.loads(self.tokenizer.to_str()))
        if not self.by_piece:
            return
        probe = np.frombuffer(PROBE, np.uint8)
        self.by_piece = self.encode(probe, np.array([0, len(probe)]))[0].tolist() == [*self.whole([PROBE.decode()])[0].tolist(), end_id]
        self.forget()

    def forget(self) -> None:
        self.keys, self.rows = np.zeros(0, U64), np.zeros(0, np.int64)  # the large table, by key
        self.new_keys, self.new_rows = np.zeros(0, U64), np.zeros(0, np.int64)
        self.ids, self.first = np.array([self.end_id], np.uint32), np.array([0, 1])  # row 0 is the end id

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of letters only: many are encoded in one run, which is cut after each piece that ends a word."""
        out: list[np.ndarray] = []
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            (ids,) = self.whole([" ".join(some)])
            cut = np.flatnonzero(self.ends[ids]) + 1
            out += np.split(ids, cut[:-1]) if len(cut) == len(some) and cut[-1] == len(ids) else self.whole(some)
        return out

    def learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        plain = np.array([t.isalpha() for t in texts], bool)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        ids = self.letters([texts[k] for k in np.flatnonzero(plain)]) + self.whole([texts[k] for k in np.flatnonzero(~plain)])
        size = np.array([len(x) for x in ids])
        rows = np.arange(len(self.first) - 1, len(self.first) - 1 + len(ids))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
        self.ids = np.concatenate([self.ids, *ids])
        self.new_keys, self.new_rows = _merged(self.new_keys, self.new_rows, keys[order], rows)
        if len(self.new_keys) > RECENT:
            self.keys, self.rows = _merged(self.keys, self.rows, self.new_keys, self.new_rows)
            self.new_keys, self.new_rows = self.new_keys[:0], self.new_rows[:0]

    def rows_of(self, keys: np.ndarray) -> np.ndarray:
        """Table rows of sorted keys, -1 where there is none."""
        out = np.full(len(keys), -1)
        for known, rows in ((self.keys, self.rows), (self.new_keys, self.new_rows)):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = rows[at[hit]]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and how many each has."""
        if not self.by_piece:
            raw, cut = data.tobytes(), offsets.tolist()
            return self._joined(self.whole([raw[a:b].decode() for a, b in zip(cut[:-1], cut[1:])]))
        # Special tokens are told by their case and hold marks: texts that may have one are encoded whole.
        odd = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        odd = np.unique(np.searchsorted(offsets, odd, "right") - 1)
        pieces = Pieces(data, offsets)
        if len(self.first) > KNOWN:
            self.forget()
        keys, at, number = np.unique(pieces.hashes(), return_index=True, return_inverse=True)
        rows = self.rows_of(keys)
        if (missing := np.flatnonzero(rows < 0)).size:
            raw = pieces.data.tobytes()
            self.learn(keys[missing], [raw[a:b] for a, b in zip(pieces.start[at[missing]].tolist(), pieces.end[at[missing]].tolist())])
            rows[missing] = self.rows_of(keys[missing])
        row = np.insert(rows[number], pieces.bound[1:], 0)
        size = np.diff(self.first)[row]
        total = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(total[-1]) + np.repeat(self.first[row] - total[:-1], size)
        ids, cut = self.ids[place], total[pieces.bound + np.arange(len(offsets))]
        if not len(odd):
            return ids, np.diff(cut)
        texts = [ids[a : b - 1] for a, b in zip(cut[:-1], cut[1:])]
        for k, own in zip(odd, self.whole([data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in odd])):
            texts[k] = own
        return self._joined(texts)

    def _joined(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        end = np.array([self.end_id], np.uint32)
        parts = [x for t in texts for x in (t, end)]
        return np.concatenate(parts) if parts else end[:0], np.array([len(t) + 1 for t in texts], np.int64)


def _merged(keys: np.ndarray, rows: np.ndarray, more_keys: np.ndarray, more_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, rows = np.concatenate([keys, more_keys]), np.concatenate([rows, more_rows])
    order = np.argsort(keys, kind="stable")
    return keys[order], rows[order]
