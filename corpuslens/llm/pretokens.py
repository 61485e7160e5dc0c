"""Vectorised pre-tokens of a byte-level BPE vocabulary (numpy, inside tasks).

The vocabulary file's own splitting pattern (contractions, letters, numbers,
other signs, each with one leading space, and white space) is applied to whole
slices of texts as array operations over code points.  Code points whose
class differs between Unicode versions, and the strings of added tokens, are
rare: texts with one go through the library's own splitter.

File formats and the pattern's meaning are fixed by the vocabulary file.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa

from .words import SpanHasher, random_words

LETTER, NUMBER, SPACE, OTHER, STOP = range(5)
SLICE_CHARS = 1 << 19


def tokenizer_file(name: str) -> str:
    """A path as given, or the place of a named public vocabulary file."""
    if os.path.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def load_tokenizer(text: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_str(text)


def added_tokens(text: str) -> list[str]:
    return [t["content"] for t in json.loads(text)["added_tokens"]]


def code_classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of every code point, and whether it is the same in all Unicode versions in use."""
    import regex
    n = 0x110000
    kind = np.full(n, OTHER, np.uint8)
    points = [c for c in range(n) if not 0xD800 <= c <= 0xDFFF]
    whole = "".join(map(chr, points))
    at = np.array(points)
    for pattern, k in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, whole):
            kind[at[m.start():m.end()]] = k
    old = unicodedata.ucd_3_2_0
    stable = kind == OTHER
    for c in np.flatnonzero(~stable).tolist():
        stable[c] = old.category(chr(c)) != "Cn"
    return kind, stable


class PreTokens:
    """Splits texts into pre-tokens: spans of one code point array with hashes."""

    def __init__(self, tokenizer_json: str, classes: tuple[np.ndarray, np.ndarray]):
        self.kind, self.stable = classes
        self.tokenizer = load_tokenizer(tokenizer_json)
        self.added = added_tokens(tokenizer_json)
        self.hasher = SpanHasher(1 << 16)
        self.plane = random_words(17, 13)

    def split(self, texts: list[str]) -> "Pieces":
        """Pre-tokens of each text.  A text with an added token, or with a code
        point of unsure class, gets its pieces from the library's splitter."""
        units = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", np.uint32)
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        stop = np.cumsum(n + 1) - 1                     # the place behind each text
        kind = self.kind[units]
        kind[stop] = STOP
        odd = np.unique(np.searchsorted(stop, np.flatnonzero(~self.stable[units]), "left"))
        odd = set(odd.tolist())
        odd.update(i for i, t in enumerate(texts) if any(a in t for a in self.added))
        begin = self._begins(units, kind)
        extra = {}
        for i in odd:
            lo, hi = int(stop[i] - n[i]), int(stop[i])
            begin[lo:hi] = False
            extra[i] = self._library(texts[i])
        start = np.flatnonzero(begin & (kind != STOP))
        row = np.searchsorted(stop, start, "left")
        later = np.append(start[1:], len(units))
        end = np.minimum(later, stop[row])
        h = self.hasher.hash((units & 0xFFFF).astype(np.int64) if len(units) else units, start, end)
        if (units > 0xFFFF).any():                      # tell planes apart
            high = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.plane[units >> 16] * (units > 0xFFFF).astype(np.uint64))])
            h = h + (high[end] - high[start]) * np.uint64(0x9E3779B97F4A7C15)
        return Pieces(units, start, end, row, h, extra)

    def _begins(self, units: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """True where a pre-token begins."""
        before = np.empty_like(kind)
        before[0], before[1:] = STOP, kind[:-1]
        begin = kind != before
        after = np.empty_like(kind)
        after[-1], after[:-1] = STOP, kind[1:]
        # the last white space before other text stands alone, and a plain space joins what follows
        lone = (kind == SPACE) & (after != SPACE) & (after != STOP)
        begin |= lone
        joined = np.flatnonzero(lone & (units == 32)) + 1
        begin[joined] = False
        # contractions: an apostrophe that begins a pre-token takes one or two letters
        quote = np.flatnonzero(begin & (units == 39))
        if len(quote):
            u = np.concatenate([units, [0, 0]])
            a, b = u[quote + 1], u[quote + 2]
            one = np.isin(a, [115, 116, 109, 100])                                   # 's 't 'm 'd
            two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)   # 're 've 'll
            begin[quote[one] + 1] = False
            begin[quote[two] + 1] = False
            for at, size in ((quote[one], 2), (quote[two], 3)):
                at = at + size
                at = at[at < len(units)]
                begin[at[(kind[at] == LETTER)]] = True
        return begin

    def _library(self, text: str) -> list[str | int]:
        """Pre-token strings of a text; an added token is its id."""
        out: list[str | int] = []
        while text:
            where = [(text.find(a), -len(a), a) for a in self.added if a in text]
            at, _, found = min(where) if where else (len(text), 0, "")
            out += [text[s:e] for _, (s, e) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text[:at])] if at else []
            if found:
                out.append(self.tokenizer.token_to_id(found))
            text = text[at + len(found):]
        return out


class Pieces:
    """Pre-tokens in text order: spans of ``units``, their text and hash; ``extra``
    holds the pieces of the texts that the library split."""

    __slots__ = ("units", "start", "end", "row", "hash", "extra")

    def __init__(self, units, start, end, row, hash_, extra):
        self.units, self.start, self.end, self.row, self.hash, self.extra = units, start, end, row, hash_, extra

    def text(self, i: int) -> str:
        return self.units[self.start[i]:self.end[i]].tobytes().decode("utf-32-le", "surrogatepass")


class Known:
    """Hash -> slot of pre-tokens met before (a cache: it starts anew when full).

    ``fresh(texts)`` is called with the strings of new pre-tokens and must
    append one entry for each to the owner's store; slot = order of arrival."""

    BITS, MOST = 20, 500_000

    def __init__(self, fresh, forget):
        self.fresh, self.forget = fresh, forget
        self.reset()

    def reset(self) -> None:
        self._table(self.BITS)
        self.size = 0
        self.by_text: dict[str, int] = {}
        self.forget()

    def _table(self, bits: int) -> None:
        self.mask = (1 << bits) - 1
        self.key = np.zeros(1 << bits, np.uint64)
        self.slot = np.full(1 << bits, -1, np.int32)

    def slots(self, pieces: Pieces) -> np.ndarray:
        """Slot of every pre-token of ``pieces``."""
        if self.size > self.MOST:
            self.reset()
        h = pieces.hash
        out = self._find(h)
        new = np.flatnonzero(out < 0)
        if len(new):
            _, first = np.unique(h[new], return_index=True)
            texts = [pieces.text(i) for i in new[first]]
            self._insert(h[new[first]], np.arange(self.size, self.size + len(texts), dtype=np.int32))
            self.size += len(texts)
            self.fresh(texts)
            out[new] = self._find(h[new])
        return out

    def one(self, text: str) -> int:
        """Slot of a single string (texts that the library split)."""
        if text not in self.by_text:
            self.by_text[text] = self.size
            self.size += 1
            self.fresh([text])
        return self.by_text[text]

    def _find(self, h: np.ndarray) -> np.ndarray:
        at = (h & np.uint64(self.mask)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        todo = np.arange(len(h))
        while len(todo):
            a = at[todo]
            s = self.slot[a]
            hit = (s >= 0) & (self.key[a] == h[todo])
            out[todo[hit]] = s[hit]
            todo = todo[(s >= 0) & ~hit]
            at[todo] = (at[todo] + 1) & self.mask
        return out

    def _insert(self, h: np.ndarray, slots: np.ndarray) -> None:
        bits = int(self.mask).bit_length()
        while (self.size + len(h)) * 4 > 3 << bits:      # only a very long text needs more than the first table
            bits += 1
        if bits > int(self.mask).bit_length():
            used = np.flatnonzero(self.slot >= 0)
            h, slots = np.concatenate([self.key[used], h]), np.concatenate([self.slot[used], slots])
            self._table(bits)
        at = (h & np.uint64(self.mask)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = self.slot[at[todo]] < 0
            _, first = np.unique(at[todo[free]], return_index=True)  # one claimant per place
            won = todo[free][first]
            self.key[at[won]], self.slot[at[won]] = h[won], slots[won]
            left = np.ones(len(h), bool)
            left[won] = False
            todo = todo[left[todo]]
            at[todo] = np.where(self.slot[at[todo]] >= 0, (at[todo] + 1) & self.mask, at[todo])


def text_lists(column: pa.Array, limit: int = SLICE_CHARS):
    """``(first row, texts)`` of about ``limit`` characters; null is empty."""
    texts, first, size = [], 0, 0
    for i, t in enumerate(column.to_pylist()):
        texts.append(t or "")
        size += len(texts[-1])
        if size >= limit:
            yield first, texts
            texts, first, size = [], i + 1, 0
    if texts:
        yield first, texts
