"""Byte-level BPE of whole texts in one process: words are folded once and held.

A text falls into chunks: a run without white space and the space before it, or
a run of white space.  No word of the vocabulary's pattern crosses a chunk.  The
ids of chunks seen lately are held as bytes, so a text's ids are those of its
chunks, joined.  Chunks that aren't held are split by the pattern, and their
words are folded together: all words of one length side by side, one merge a
word and step.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from collections import defaultdict
from functools import lru_cache
from itertools import groupby

import numpy as np

#: White space as Unicode has it.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Bytes of a word up to which it is folded beside others; a longer one is folded alone, by a heap.
SHORT = 64
#: Rank of what isn't a token, and the bits of a position in a short word.
_NONE, _BITS = 1 << 24, 6
#: Characters of a chunk that count as one more chunk.
_LONG = 64


def parse_ranks(vocabulary: bytes) -> dict[bytes, int]:
    """Ranks by token, of lines of a token in base 64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}


@lru_cache(maxsize=1)
def patterns() -> tuple[re.Pattern, re.Pattern]:
    """Those of a chunk and of a word; letters and numbers are those of Python's Unicode tables."""
    of: dict[str, list[str]] = {"L": [], "N": []}
    for kind, run in groupby(range(0x110000), lambda c: unicodedata.category(chr(c))[0]):
        if kind in of:
            first, *rest = run
            of[kind].append(f"\\U{first:08x}-\\U{rest[-1] if rest else first:08x}")
    letter, number = "".join(of["L"]), "".join(of["N"])
    gap = rf"[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    word = rf"'(?:[sdmt]|ll|ve|re)| ?[{letter}]+| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+|{gap}"
    return re.compile(rf" ?[^{_SPACE}]+|{gap}"), re.compile(word)


class Pairs:
    """Ranks of pairs of ids in a hash table with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        self.base = max(ranks.values()) + 2
        found = [(a * self.base + b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
        keys, values = np.array([k for k, _ in found], np.int64), np.array([r for _, r in found], np.int32)
        self.bits = max(8, (4 * len(found)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while left.size:
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]
            won = self.keys[at[left]] == keys[left]
            self.values[at[left[won]]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that ``a`` and ``b`` make; ``_NONE`` where they make none."""
        keys = a.astype(np.int64) * self.base + b
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.int32(_NONE))
        left = np.flatnonzero((held != keys) & (held != -1))
        while left.size:
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (held != -1)]
        return out


class Encoder:
    """Ids of texts under one vocabulary; about ``most`` chunks are held, whatever the texts.

    They are held in two generations: when the newer is full, the older is
    dropped, and a chunk that is met again passes to the newer.
    """

    def __init__(self, vocabulary: bytes, most: int):
        self.ranks = parse_ranks(vocabulary)
        if any(bytes([b]) not in self.ranks for b in range(256)) or max(self.ranks.values()) >= _NONE:
            raise ValueError(f"a vocabulary has every single byte, and ranks below {_NONE}")
        self.chunk, self.word = patterns()
        self.most = max(1, most // 2)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0
        self.pairs = Pairs(self.ranks)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.first = self.pairs.rank(np.repeat(self.single, 256), np.tile(self.single, 256))
        self.packed = {r: r.to_bytes(4, "little") for r in self.ranks.values()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, 4 bytes each."""
        parts = [self.chunk.findall(t) for t in texts]
        self._hold(set().union(*parts))
        return [b"".join(map(self.new.__getitem__, p)) for p in parts]

    def _hold(self, chunks: set[str]) -> None:
        """Puts ``chunks`` into the newer generation."""
        if self.size > self.most:
            self.old, self.new, self.size = self.new, {}, 0
        unknown = []
        for c in chunks.difference(self.new):
            if (ids := self.old.get(c)) is None:
                unknown.append(c)
            else:
                self.new[c] = ids
            self.size += 1 + len(c) // _LONG
        words = [self.word.findall(c) for c in unknown]
        ids = self.fold(set().union(*words))
        for c, w in zip(unknown, words):
            self.new[c] = ids[w[0]] if len(w) == 1 else b"".join([ids[x] for x in w])

    def fold(self, words: set[str]) -> dict[str, bytes]:
        """Ids of each word.  A token needs no merges: every token is what its own merges make."""
        out: dict[str, bytes] = {}
        by_length: dict[int, list[tuple[str, bytes]]] = defaultdict(list)
        for w in words:
            raw = w.encode("utf-8", "surrogateescape")
            if (r := self.ranks.get(raw)) is not None:
                out[w] = self.packed[r]
            elif len(raw) > SHORT:
                out[w] = self._fold_long(raw)
            else:
                by_length[len(raw)].append((w, raw))
        for n, own in by_length.items():
            raw = np.frombuffer(b"".join(x for _, x in own), np.uint8).reshape(len(own), n).T
            ids, counts = self._fold_short(np.ascontiguousarray(raw))
            flat, ends = ids.tobytes(), np.cumsum(counts * 4).tolist()
            start = 0
            for (w, _), end in zip(own, ends):
                out[w] = flat[start:end]
                start = end
        return out

    def _fold_short(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, a column each, one after the other, and how many each has.

        ``key`` has rank and position of the pair that begins at a position: the
        least of a column is its leftmost pair of lowest rank.  The last row is
        of an id that makes no pair; it spares asking for a word's ends.
        """
        n, m = raw.shape
        token = np.full((n + 1, m), self.pairs.base - 1, np.int32)
        token[:n] = self.single[raw]
        key = np.full((n + 1, m), _NONE << _BITS, np.int32)
        key[: n - 1] = (self.first[raw[:-1].astype(np.int32) * 256 + raw[1:]] << _BITS) + np.arange(n - 1, dtype=np.int32)[:, None]
        after = np.repeat(np.arange(1, n + 2, dtype=np.int8)[:, None], m, 1)
        before = np.repeat(np.arange(-1, n, dtype=np.int8)[:, None], m, 1)
        alive = np.ones((n, m), bool)
        while True:
            least = key.min(axis=0)
            on = np.flatnonzero(least < _NONE << _BITS)
            if not on.size:
                return token[:n].T[alive.T], alive.sum(axis=0)
            least = least[on]
            at, made = (least & ((1 << _BITS) - 1)).astype(np.int64), least >> _BITS
            gone = after[at, on].astype(np.int64)
            right, left = after[gone, on].astype(np.int64), before[at, on].astype(np.int64)
            token[at, on], after[at, on], before[right, on] = made, right, at
            key[gone, on], alive[gone, on] = _NONE << _BITS, False
            key[at, on] = (self.pairs.rank(made, token[right, on]) << _BITS) + at
            key[left, on] = (self.pairs.rank(token[left, on], made) << _BITS) + np.maximum(left, 0)

    def _fold_long(self, raw: bytes) -> bytes:
        """Ids of one word, in a time that grows little faster than its length."""
        n, get = len(raw), self.ranks.get
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # an end of 0: merged into the piece before
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, start, end = heapq.heappop(heap)
            middle = ends[start]
            if not middle or middle == n or ends[middle] != end:
                continue
            ends[start], ends[middle] = end, 0
            if end < n:
                before[end] = start
                if (r := get(raw[start : ends[end]])) is not None:
                    heapq.heappush(heap, (r, start, ends[end]))
            if start and (r := get(raw[before[start] : end])) is not None:
                heapq.heappush(heap, (r, before[start], end))
        return b"".join(self.packed[get(raw[i : ends[i]])] for i in range(n) if ends[i])
