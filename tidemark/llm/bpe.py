"""Exact byte-pair encoding by dynamic programming over prefixes.

For each prefix of a piece of text the last token of its encoding is unique. It is a token that ends there, as an automaton
of all suffix matches lists them, and that is compatible with the last token of the prefix before it: the two side by side
encode to themselves. So the last tokens are found prefix by prefix, and following them back from the end gives the ids,
in time linear in the text whatever the order of merges.
"""

from __future__ import annotations

import json
import unicodedata

import ahocorasick
import numpy as np

#: Code points of Unicode's White_Space property (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3
#: Pairs of tokens whose compatibility is remembered.
PAIRS = 500_000
#: What follows an apostrophe in a contraction that is a piece of its own (fixed values).
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


def byte_letters() -> dict[str, int]:
    """The characters by which vocabulary files write the 256 bytes: printable ones stand for themselves, the others
    for the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, the pairs that merge into them, and the automaton of their suffix matches."""

    def __init__(self, path: str):
        """Reads a byte-level BPE vocabulary in the JSON form of the ``tokenizers`` library."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        ids: dict[str, int] = model["vocab"]
        size = max(ids.values()) + 1
        self.rank = [-1] * size  # order of merging, bytes before all
        self.left, self.right = [-1] * size, [-1] * size
        self.pairs: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        self.bytes_of: dict[int, bytes] = {}

        def add(written: str, token: int) -> None:
            raw = bytes(letters[c] for c in written)
            self.bytes_of[token] = raw
            self.automaton.add_word(raw.decode("latin-1"), (token, len(raw)))

        for c in letters:
            add(c, ids[c])
        for i, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            t = ids[a + b]
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = i, ids[a], ids[b]
                add(a + b, t)
            self.pairs[ids[a], ids[b]] = t
        self.automaton.make_automaton()
        self._compatible: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` side by side stay as they are.

        The merges that made the two are undone, the latest first. At each stage the parts that touch must not form a
        pair that would have merged before the stage ended; of equal ranks the left one merges first.
        """
        known = self._compatible.get((a, b))
        if known is not None:
            return known
        x, y, until = a, b, len(self.rank)
        rank, answer = self.rank, True
        while True:
            t = self.pairs.get((x, y))
            if t is not None and rank[t] < until:
                answer = False
                break
            if rank[x] < 0 and rank[y] < 0:
                break
            if rank[x] > rank[y]:
                until, x = rank[x], self.right[x]
            else:
                until, y = rank[y] + 1, self.left[y]
        if len(self._compatible) > PAIRS:
            self._compatible.clear()
        self._compatible[a, b] = answer
        return answer

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece of text; any length."""
        n = len(piece)
        last, width = [-1] * n, [0] * n
        compatible = self.compatible
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            if last[end] < 0:
                at = end - size
                if at < 0 or compatible(last[at], token):
                    last[end], width[end] = token, size
        out, at = [], n - 1
        while at >= 0:
            out.append(last[at])
            at -= width[at]
        out.reverse()
        return out


def character_classes() -> np.ndarray:
    """For each code point: letter, digit, white space or other."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    first = {"L": LETTER, "N": DIGIT}
    category = unicodedata.category
    kinds[:] = np.fromiter((first.get(category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    kinds[WHITE_SPACE] = SPACE
    return kinds


class Pieces:
    """Splits many texts at once into the pieces that are encoded one by one, without a regular expression.

    The rules are those of the vocabulary's pattern: contractions; runs of letters, of digits or of other signs, each with
    one space before it; white space, whose last sign goes with what follows if it's a space.
    """

    def __init__(self) -> None:
        self.classes = character_classes()
        self.tails = [np.frombuffer(c.encode(), dtype=np.uint8) for c in sorted(CONTRACTIONS, key=len)]

    def split(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``data``: UTF-8 of all texts end to end; ``starts``: the byte at which each non-empty text begins.

        Returns the first byte of each piece, and the number of pieces before each text.
        """
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        n = len(at)
        wide = np.concatenate([data, np.zeros(4, dtype=np.uint8)])
        code = data[at].astype(np.int32)
        many = np.flatnonzero(code >= 0x80)
        if len(many):
            b0, p = code[many], at[many]
            b1, b2, b3 = (wide[p + i].astype(np.int32) & 0x3F for i in (1, 2, 3))
            code[many] = np.where(b0 < 0xE0, ((b0 & 0x1F) << 6) | b1, np.where(b0 < 0xF0, ((b0 & 0x0F) << 12) | (b1 << 6) | b2, ((b0 & 0x07) << 18) | (b1 << 12) | (b2 << 6) | b3))
            np.minimum(code, 0x10FFFF, out=code)
        kind = self.classes[code]
        text_start = np.zeros(n + 1, dtype=bool)
        chars = np.searchsorted(at, starts)
        text_start[chars] = True
        text_start[n] = True
        run = np.empty(n, dtype=bool)  # a new class, or a new text
        run[0] = True
        np.not_equal(kind[1:], kind[:-1], out=run[1:])
        run |= text_start[:n]
        spaces = kind == SPACE
        blank = code == 0x20
        # the last sign of a run of white space that something follows in the same text
        closes = spaces.copy()
        closes[:-1] &= ~spaces[1:]
        closes &= ~text_start[1:]
        begins = run | closes
        joined = np.zeros(n, dtype=bool)  # what follows a space goes with it
        np.logical_and(closes[:-1], blank[:-1], out=joined[1:])
        begins &= ~joined
        self._contract(code, kind, run, begins, joined, text_start)
        first = np.flatnonzero(begins)
        return at[first], np.searchsorted(first, chars)

    def _contract(self, code, kind, run, begins, joined, text_start) -> None:
        n = len(code)
        alone = np.flatnonzero((code == 0x27) & run & ~joined)
        alone = alone[alone + 1 < n]
        alone = alone[(kind[alone + 1] == LETTER) & ~text_start[alone + 1]]
        done = np.zeros(len(alone), dtype=bool)
        for tail in self.tails:
            k = len(tail)
            fits = ~done & (alone + k < n)
            for i in range(k):
                fits &= code[np.minimum(alone + 1 + i, n - 1)] == tail[i]
                if i:
                    fits &= ~text_start[np.minimum(alone + 1 + i, n - 1)]
            hit = alone[fits]
            begins[hit + 1] = False
            after = hit + 1 + k
            after = after[after < n]
            begins[after[(kind[after] == LETTER)]] = True
            done |= fits


SLOTS = 1 << 20
#: Bytes of a piece that is remembered; longer ones are encoded wherever they stand.
LONGEST_KEPT = 256


class Encoder:
    """Encodes batches of texts. Equal pieces are encoded once: a table of keys answers the pieces seen before, comparing
    all of their bytes; only new ones go through the dynamic programme. Pieces of up to ``LONGEST_KEPT`` bytes are remembered,
    until ``memo`` pieces or ``memo_bytes`` bytes are held; then, between two batches, all are forgotten. Longer pieces are
    encoded for their batch only. So memory is bounded by these, ``PAIRS`` and the batch, however large and odd the corpus."""

    def __init__(self, path: str, memo: int = 600_000, memo_bytes: int = 48 << 20):
        self.vocabulary, self.pieces, self.memo, self.memo_bytes = Vocabulary(path), Pieces(), memo, memo_bytes
        self._masks = np.array([0] + [(1 << (8 * i)) - 1 for i in range(1, 9)], dtype=np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.low, self.high = np.zeros(SLOTS, dtype=np.uint64), np.zeros(SLOTS, dtype=np.uint64)
        self.size, self.entry = np.zeros(SLOTS, dtype=np.uint8), np.zeros(SLOTS, dtype=np.int32)
        self.known: dict[bytes, int] = {}
        self.count, self.used, self.held = 0, 0, 0
        self.offset, self.length = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int32)
        self.flat = np.zeros(1 << 18, dtype=np.int32)

    def _full(self) -> bool:
        return self.count > self.memo or self.held + 4 * self.used > self.memo_bytes

    def _learn(self, piece: bytes) -> int:
        """Encodes a piece and returns its entry; the entry of a long one holds until the batch ends."""
        ids = self.vocabulary.encode_piece(piece)
        if self.count == len(self.offset):
            self.offset, self.length = np.resize(self.offset, 2 * self.count), np.resize(self.length, 2 * self.count)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.offset[self.count], self.length[self.count] = self.used, len(ids)
        self.used += len(ids)
        if len(piece) <= LONGEST_KEPT:
            self.known[piece] = self.count
            self.held += len(piece)
        self.count += 1
        return self.count - 1

    def _entries(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        size = np.diff(first, append=len(data))
        padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
        words = np.ndarray(shape=(len(data) + 8,), dtype="<u8", buffer=padded, strides=(1,))
        low = words[first] & self._masks[np.minimum(size, 8)]
        long = np.flatnonzero(size > 8)
        high = np.zeros(len(first), dtype=np.uint64)
        high[long] = words[np.minimum(first[long] + 8, len(data))] & self._masks[np.minimum(size[long] - 8, 8)]
        short = size <= 16
        mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ ((high + size.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F))
        slot = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)).astype(np.int64)
        found = short & (self.low[slot] == low) & (self.high[slot] == high) & (self.size[slot] == size)
        out = self.entry[slot]
        raw = data.tobytes()
        known, learn = self.known, self._learn
        for i in np.flatnonzero(~found).tolist():
            a, s = int(first[i]), int(size[i])
            piece = raw[a : a + s]
            e = known.get(piece)
            if e is None:
                e = learn(piece)
            out[i] = e
            if s <= 16 and not self.size[(k := slot[i])]:
                self.low[k], self.high[k], self.size[k], self.entry[k] = low[i], high[i], s, e
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray, want_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Texts as UTF-8 bytes ``data`` with ``offsets`` (one more than texts). Returns the number of ids of each text,
        and all ids end to end (empty if not wanted)."""
        n = len(offsets) - 1
        counts = np.zeros(n, dtype=np.int64)
        filled = np.flatnonzero(np.diff(offsets) > 0)
        base, end = int(offsets[0]), int(offsets[-1])
        data = np.ascontiguousarray(data[base:end])
        if not len(filled):
            return counts, np.zeros(0, dtype=np.int32)
        if self._full():
            self._forget()
        first, before = self.pieces.split(data, (offsets[filled] - base).astype(np.int64))
        entries = self._entries(data, first)
        lengths = self.length[entries].astype(np.int64)
        counts[filled] = np.add.reduceat(lengths, before)
        if not want_ids:
            return counts, np.zeros(0, dtype=np.int32)
        total = int(lengths.sum())
        shift = self.offset[entries] - (np.cumsum(lengths) - lengths)
        return counts, self.flat[np.repeat(shift, lengths) + np.arange(total)]
