"""Word n-grams of many texts at once, as 64-bit hashes in numpy.

Texts are lower-cased and split at white space.  A word's hash is a polynomial
over its UTF-8 bytes modulo 2**64, made from one running sum over the batch and
then mixed, so no Python object is built for a word.  An n-gram's hash mixes
those of its words in order.
"""

from __future__ import annotations

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_MUL = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _grow(n: int) -> None:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_R, _RINV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words in each text.

    A null text has no words, like an empty one.
    """
    lowered = [(t or "").lower() for t in texts]
    # every Unicode space becomes an ASCII one, so that bytes tell words apart
    encoded = [(t if t.isascii() else " ".join(t.split())).encode("utf-8", "surrogatepass") for t in lowered]
    lengths = np.fromiter((len(e) + 1 for e in encoded), np.int64, len(encoded))
    buf = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8) if encoded else np.zeros(0, np.uint8)
    # the ASCII characters that str.split() takes for white space
    space = (buf == 32) | ((buf >= 9) & (buf <= 13)) | ((buf >= 28) & (buf <= 31))
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space))))
    starts, ends = edges[0::2], edges[1::2]
    _grow(len(buf) + 1)
    run = np.empty(len(buf) + 1, np.uint64)
    run[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers[0][: len(buf)], out=run[1:])
    h = (run[ends] - run[starts]) * _powers[1][starts]
    h = mix(h + (ends - starts).astype(np.uint64) * _MUL[2])
    bounds = np.cumsum(lengths)
    per_text = np.diff(np.searchsorted(starts, np.concatenate(([0], bounds))))
    return h, per_text


def ngram_hashes(words: np.ndarray, per_text: np.ndarray, n: int, whole_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each text, and the index of each one's text.

    With ``whole_short`` a text of fewer than n words has one gram, its whole
    word sequence; without, it has none.
    """
    doc = np.repeat(np.arange(len(per_text)), per_text)
    if len(words) >= n:
        h = words[: len(words) - n + 1] * _MUL[0]
        for k in range(1, n):
            h = mix(h) + words[k : len(words) - n + 1 + k] * _MUL[k % 8]
        inside = doc[: len(words) - n + 1] == doc[n - 1 :]
        grams, owner = mix(h[inside] + np.uint64(n)), doc[: len(words) - n + 1][inside]
    else:
        grams, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if whole_short:
        first = np.concatenate(([0], np.cumsum(per_text)[:-1])).astype(np.int64) if len(per_text) else np.zeros(0, np.int64)
        extra_h, extra_d = [], []
        for size in range(1, n):
            d = np.flatnonzero(per_text == size)
            if len(d):
                h = words[first[d]] * _MUL[0]
                for k in range(1, size):
                    h = mix(h) + words[first[d] + k] * _MUL[k % 8]
                extra_h.append(mix(h + np.uint64(size)))
                extra_d.append(d)
        if extra_h:
            grams, owner = np.concatenate([grams, *extra_h]), np.concatenate([owner, *extra_d])
    return grams, owner
