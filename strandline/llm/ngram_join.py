"""Exact Jaccard join of documents' sets of word n-grams, with set-relation skipping.

Tokens (hashed n-grams) are put in one global order, rare ones first, and a set
is indexed by its prefix: two sets of Jaccard similarity t share a token there.

1. One pass over the texts gives word counts, n-grams that recur more than their
   words explain (shared passages, copies), and a fingerprint of each set.  Both
   counts give the order; only the heaviest are kept, in tables of fixed size: any
   order is correct, a better one skips more.  Documents with one fingerprint have
   equal sets; the one of lowest id represents them from here on.
2. Prefix tokens, packed by task and hash range, are grouped by token.  An index
   list is cut into blocks of neighbouring positions; a pair of blocks whose
   positions and sizes leave too little overlap is skipped as a whole.  Sets that
   have a pair left become members of the list's home, its lowest set.  Bitmaps of
   the members' sets bound each pair's overlap; a pair belongs to the lowest home
   that both are members of, and members without a pair of their home's go.
3. The full sets of a home's members come together.  A set's answers are its
   overlaps with all others there, from full index lists; the next set is the
   most similar one not yet answered, and its overlaps are those of the last set
   less the lists of tokens it lacks plus those of tokens it has in addition.
   A large home is cut into blocks of members, and every pair of blocks is a
   task of its own.
4. A task tells how many links each of its sets has, weighted by copies, and
   only those pairs that join groups not joined there before.  Stars of these
   give the classes; copies get their representative's.

Every pair is verified on whole sets, each in one task only.  Nothing is capped.
Hashes stand for n-grams (64 bits in the index, 48 in verification): two n-grams
of a pair meet with a chance of about 10^-9 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandline.llm.common import chunks, id_filter, join_told, most_frequent, own_prints, shuffle_partitions, stored, tidy
from strandline.llm.textgrams import mix, ngram_hashes, word_hashes

N, THRESHOLD = 2, 0.6
#: Words and recurring n-grams in the ordering tables.
MAX_WORDS, MAX_GRAMS = 1 << 18, 1 << 18
#: Counts from which a task reports a word, or an n-gram.
LOCAL_WORDS, LOCAL_GRAMS = 2, 3
#: Members of a home that one task holds at once; sets of a task at most.
BLOCK = 3000
#: Entries of an index list that one block has.
LIST_BLOCK = 256
#: Prefix entries of one hash range, about.
RANGE_ENTRIES = 4_000_000
#: Ids of copies up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_COPIES = 1_000_000


def _sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, words per text, gram hashes and the text of each gram."""
    words, per_text = word_hashes(texts)
    grams, owner = ngram_hashes(words, per_text, n, whole_short=True)
    return words, per_text, grams, owner


def _distinct_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and distinct gram hashes in order of text with the text of each; hashing holds many bytes a character."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for s, e in chunks([len(t or "") for t in texts]):
        words, _, grams, owner = _sets(texts[s:e], n)
        grams, owner = _distinct(grams, owner)
        parts.append((words, grams, owner + s))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _six(grams: np.ndarray) -> bytes:
    """The low 48 bits of hashes, as a set of them travels."""
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _distinct(grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((grams, owner))
    g, o = grams[order], owner[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    return g[first], o[first]


def _tally(values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    v, c = np.unique(values, return_counts=True)
    keep = c >= least
    return v[keep], c[keep]


def _prints(grams: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and a fingerprint of 128 bits of each text's set; ``grams`` are distinct, in order of text."""
    size = np.bincount(owner, minlength=count)
    ends = np.cumsum(size)
    out = []
    for salt in (0x51ED270B9F6AA1C3, 0xC2B2AE3D27D4EB4F):
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(grams ^ np.uint64(salt)))))
        out.append((run[ends] - run[ends - size]).view(np.int64))
    return size, out[0], out[1]


_WORD, _GRAM, _TOTAL, _DOC = range(4)


def tallied(docs: DataFrame, n: int, t: float, id_col: str, text_col: str) -> DataFrame:
    """(kind, token, c, fa, fb), stored: tasks' counts of words and n-grams, prefix entries, and fingerprints.

    A fingerprint's row has the id as token and the set's size as c; texts
    without words have none.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = 0
        names = ["kind", "token", "c", "fa", "fb"]
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1).to_pylist()
            for s, e in chunks([len(t or "") for t in texts], 6_000_000):
                words, own, owner = _distinct_sets(texts[s:e], n)
                size, fa, fb = _prints(own, owner, e - s)
                entries += int(_prefix(size, t)[size > 0].sum())
                w, wc = _tally(words, LOCAL_WORDS)
                g, gc = _tally(own, LOCAL_GRAMS)
                some = size > 0
                kind = np.repeat(np.array([_WORD, _GRAM, _DOC], np.int8), [len(w), len(g), some.sum()])
                zero = np.zeros(len(w) + len(g), np.int64)
                columns = (kind, np.concatenate([w.view(np.int64), g.view(np.int64), ids[s:e][some]]), np.concatenate([wc, gc, size[some]]), np.concatenate([zero, fa[some]]), np.concatenate([zero, fb[some]]))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)
        tidy()
        yield pa.RecordBatch.from_arrays([pa.array([_TOTAL], pa.int8()), *(pa.array([x], pa.int64()) for x in (0, entries, 0, 0))], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    return stored(rows.mapInArrow(count, "kind tinyint, token bigint, c bigint, fa bigint, fb bigint"), "tallies")


def heavy_tokens(tallies: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Most frequent words and n-grams with their counts, sorted by hash, and the number of prefix entries."""
    total = stored(tallies.filter(F.col("kind") < _DOC).groupBy("kind", "token").agg(F.sum("c").alias("c")), "heavy")
    out = []
    for kind, most in ((_WORD, MAX_WORDS), (_GRAM, MAX_GRAMS)):
        t = most_frequent(total.filter(F.col("kind") == kind), most, "token")[0].select("token", "c").toArrow()
        token, c = t["token"].to_numpy().view(np.uint64), t["c"].to_numpy()
        order = np.argsort(token)
        out += [token[order], c[order]]
    tidy()
    entries = sum(r["c"] for r in total.filter(F.col("kind") == _TOTAL).collect())
    return (*out, entries)


def _count_of(values: np.ndarray, table: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, counts[at], 0)


def _ordered(texts: list[str | None], n: int, heavy: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of each text in the global order, their texts, and sizes."""
    words_t, words_c, grams_t, grams_c, _ = heavy
    words, per_text, grams, owner = _sets(texts, n)
    total = max(1, int(words_c.sum()))
    w = np.log2(np.maximum(_count_of(words, words_t, words_c), 1).astype(np.float32) / np.float32(total))
    # an n-gram's expected frequency if words were independent; short texts have no such n-grams
    inside = np.repeat(np.arange(len(per_text)), per_text)
    freq = np.full(len(grams), -60, np.float32)
    if len(words) >= n:
        f = w[: len(words) - n + 1].copy()
        for k in range(1, n):
            f += w[k : len(words) - n + 1 + k]
        f = f[inside[: len(words) - n + 1] == inside[n - 1 :]]
        freq[: len(f)] = f
    expected = np.rint(np.maximum(freq + np.float32(np.log2(total)), -30)).astype(np.int64)
    order = np.lexsort((grams, owner))
    g, o, x = grams[order], owner[order], expected[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    g, o, x = g[first], o[first], x[first]
    seen = _count_of(g, grams_t, grams_c)
    rank = np.where(seen > 0, np.maximum(x, np.rint(np.log2(np.maximum(seen, 1))).astype(np.int64)), x)
    order = np.lexsort((g, rank, o))
    return g[order], o[order], np.bincount(o, minlength=len(texts))


def _prefix(size: np.ndarray, t: float) -> np.ndarray:
    """Length of the prefix in which a set shares a token with any set of similarity t."""
    return size - np.ceil(t * size - 1e-9).astype(np.int64) + 1


def _need(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Least overlap of sets of these sizes that are t similar."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9)


def _pack(doc: np.ndarray, size: np.ndarray, owner: np.ndarray, token: np.ndarray, pos: np.ndarray) -> bytes:
    """Prefix entries of one task and hash range; texts by number, tokens by 32 bits of hash."""
    used, local = np.unique(owner, return_inverse=True)
    order = np.argsort(token, kind="stable")
    head = np.array([len(used), len(token)], np.int64)
    # a position cut off at 65535 only weakens the bound
    parts = (head, doc[used], size[used].astype(np.int64), token[order], local[order].astype(np.uint32 if len(used) > 65535 else np.uint16), np.minimum(pos[order], 65535).astype(np.uint16))
    return pa.compress(b"".join(p.tobytes() for p in parts), codec="lz4", asbytes=True)


def _unpack(blob: bytes, n_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(blob, n_bytes, codec="lz4", asbytes=True)
    used, m = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    at = 16
    out = []
    for kind, length in ((np.int64, used), (np.int64, used), (np.uint32, m), (np.uint32 if used > 65535 else np.uint16, m), (np.uint16, m)):
        out.append(np.frombuffer(raw, kind, length, at))
        at += length * np.dtype(kind).itemsize
    doc, size, token, local, pos = out
    return token, doc[local], size[local], pos.astype(np.int64)


def _blocks_with_pairs(size: np.ndarray, pos: np.ndarray, t: float) -> np.ndarray:
    """Which entries of one token's list, in order of size, have a partner left.

    The list is cut into blocks of equal length; blocks are compared by their
    least position and size bounds first.
    """
    m = len(size)
    keep = np.zeros(m, bool)
    starts = list(range(0, m, LIST_BLOCK))
    for bi, a in enumerate(starts):
        za, pa_ = size[a : a + LIST_BLOCK], pos[a : a + LIST_BLOCK]
        for c in starts[bi:]:
            zc, pc = size[c : c + LIST_BLOCK], pos[c : c + LIST_BLOCK]
            if za[-1] < t * zc[0] - 1e-9:  # all later ones are larger still
                break
            if min((za - pa_).max(), (zc - pc).max()) < _need(za[0], zc[0], t):
                continue
            if c > a and keep[a : a + LIST_BLOCK].all() and keep[c : c + LIST_BLOCK].all():
                continue
            bound = np.minimum((za - pa_)[:, None], (zc - pc)[None, :])
            ok = (bound >= _need(za[:, None], zc[None, :], t)) & (za[:, None] >= t * zc[None, :] - 1e-9)
            if a == c:
                ok &= ~np.tri(len(za), dtype=bool)
            keep[a : a + LIST_BLOCK] |= ok.any(1)
            keep[c : c + LIST_BLOCK] |= ok.any(0)
    return keep


def _small_lists(start: np.ndarray, length: np.ndarray, size: np.ndarray, pos: np.ndarray, t: float, keep: np.ndarray) -> None:
    """The same for all lists of one short length at once."""
    for m in np.unique(length):
        rows = start[length == m]
        for s in range(0, len(rows), max(1, 2_000_000 // int(m * m))):
            at = rows[s : s + max(1, 2_000_000 // int(m * m))][:, None] + np.arange(m)
            z, p = size[at], pos[at]
            bound = np.minimum((z - p)[:, :, None], (z - p)[:, None, :])
            ok = (bound >= _need(z[:, :, None], z[:, None, :], t)) & (np.minimum(z[:, :, None], z[:, None, :]) >= t * np.maximum(z[:, :, None], z[:, None, :]) - 1e-9)
            ok &= ~np.eye(int(m), dtype=bool)
            keep[at] |= ok.any(2)


def members(own: DataFrame, heavy: tuple, n: int, t: float) -> DataFrame:
    """(home, doc_id): sets of ``own`` (doc_id, text) that may be similar share a home."""
    spark = own.sparkSession
    parts = max(shuffle_partitions(spark), -(-heavy[4] // RANGE_ENTRIES))
    table = spark.sparkContext.broadcast(heavy)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list) -> pa.RecordBatch:
            doc = np.concatenate([h[0] for h in held])
            size = np.concatenate([h[1] for h in held])
            shift = np.cumsum([0] + [len(h[0]) for h in held])
            owner = np.concatenate([h[2] + shift[i] for i, h in enumerate(held)])
            token, pos = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
            part = (token >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1).astype(np.uint64))
            low = (token & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            p_ids, blobs, raw = [], [], []
            for p in range(parts):
                some = order[cut[p] : cut[p + 1]]
                if len(some):
                    used = len(np.unique(owner[some]))
                    blobs.append(_pack(doc, size, owner[some], low[some], pos[some]))
                    raw.append(16 + 16 * used + len(some) * (4 + (4 if used > 65535 else 2) + 2))
                    p_ids.append(p)
            return pa.RecordBatch.from_arrays([pa.array(p_ids, pa.int32()), pa.array(blobs, pa.binary()), pa.array(raw, pa.int64())], ["part", "blob", "n_bytes"])

        held, total = [], 0
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for s, e in chunks([len(x or "") for x in texts], 2_000_000):
                g, o, size = _ordered(texts[s:e], n, table.value)
                start = np.concatenate(([0], np.cumsum(size)[:-1]))
                pos = np.arange(len(g)) - start[o]
                front = pos < _prefix(size, t)[o]
                held.append((ids[s:e].astype(np.int64), size, o[front], g[front], pos[front]))
                total += int(front.sum())
                if total > 1_500_000:
                    yield flush(held)
                    held, total = [], 0
        if held:
            yield flush(held)
        del held
        tidy()

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of one hash range follow one another; a task may have several ranges
        def found(blobs: list, raw: list) -> pa.RecordBatch:
            token, doc, size, pos = (np.concatenate(x) for x in zip(*map(_unpack, blobs, raw)))
            order = np.lexsort((pos, size, token))
            token, doc, size, pos = token[order], doc[order], size[order], pos[order]
            start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            length = np.diff(np.append(start, len(token)))
            keep = np.zeros(len(token), bool)
            short = (length >= 2) & (length <= 32)
            _small_lists(start[short], length[short], size, pos, t, keep)
            for s, m in zip(start[length > 32], length[length > 32]):
                keep[s : s + m] = _blocks_with_pairs(size[s : s + m], pos[s : s + m], t)
            which = np.repeat(np.arange(len(start)), length)[keep]
            doc = doc[keep]
            if not len(doc):
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64())], ["home", "doc_id"])
            order = np.lexsort((doc, which))
            which, doc = which[order], doc[order]
            first = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
            home = np.repeat(doc[first], np.diff(np.append(first, len(doc))))
            pair = np.unique(np.stack([home, doc], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["home", "doc_id"])

        now, blobs, raw = None, [], []
        for b in batches:
            for p, blob, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if p != now and blobs:
                    yield found(blobs, raw)
                    blobs, raw = [], []
                now = p
                blobs.append(blob)
                raw.append(size)
        if blobs:
            yield found(blobs, raw)
        del blobs
        tidy()

    packed = own.mapInArrow(index, "part int, blob binary, n_bytes bigint")
    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(lists, "home bigint, doc_id bigint").distinct()


def _answers(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, t: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each set of ``left``: (its index, partners in ``right`` after it, similarity)."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), size)
    tokens, ids = np.unique(flat, return_inverse=True)
    at = np.cumsum(np.concatenate(([0], size)))
    mine = [np.sort(ids[at[i] : at[i + 1]]) for i in range(len(sets))]
    in_right = np.zeros(len(sets), bool)
    in_right[right] = True
    sel = in_right[owner]
    order = np.argsort(ids[sel], kind="stable")
    post, bound = owner[sel][order], np.searchsorted(ids[sel][order], np.arange(len(tokens) + 1))

    def lists_of(toks: np.ndarray) -> np.ndarray:
        return np.concatenate([post[bound[k] : bound[k + 1]] for k in toks]) if len(toks) else np.zeros(0, np.int64)

    # one order that puts similar sets beside each other: the most similar open one comes next
    open_ = np.zeros(len(sets), bool)
    open_[left] = True
    last, overlap = -1, np.zeros(len(sets), np.int64)
    for start in left:
        i = int(start)
        while i >= 0 and open_[i]:
            if last >= 0:
                gone, new = np.setdiff1d(mine[last], mine[i], True), np.setdiff1d(mine[i], mine[last], True)
            if last >= 0 and len(gone) + len(new) < len(mine[i]):
                overlap -= np.bincount(lists_of(gone), minlength=len(sets))
                overlap += np.bincount(lists_of(new), minlength=len(sets))
            else:
                overlap = np.bincount(lists_of(mine[i]), minlength=len(sets))
            open_[i], last = False, i
            js = np.flatnonzero(overlap > 0)
            js = js[(js != i) & in_right[js]]
            sim = overlap[js] / (size[i] + size[js] - overlap[js])
            ok = sim >= t - 1e-12
            yield i, js[ok], sim[ok]
            near = js[open_[js]]
            s = overlap[near] / (size[i] + size[near] - overlap[near])
            i = int(near[np.argmax(s)]) if len(near) and s.max() > 0.5 else -1


def _bitmap(grams: np.ndarray) -> bytes:
    """The set's size and a bitmap of its hashes, of at least twice as many bits."""
    bits = max(256, 1 << int(2 * len(grams) - 1).bit_length())
    b = np.zeros(bits, np.uint8)
    b[(grams & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.int64(len(grams)).tobytes() + np.packbits(b, bitorder="little").tobytes()


def _folded(words: np.ndarray, count: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) brought to fewer words."""
    return np.bitwise_or.reduce(words.reshape(len(words), -1, count), axis=1)


class _Lower:
    """Which members of a home share a lower home; their pairs belong there."""

    def __init__(self, lists: list[list[int]], home: int) -> None:
        self.lower = [[g for g in x if g < home] for x in lists]
        members: dict[int, list[int]] = {}
        for k, x in enumerate(self.lower):
            for g in x:
                members.setdefault(g, []).append(k)
        self.members = {g: np.array(x, np.int64) for g, x in members.items() if len(x) > 1}
        self.count = len(lists)

    def of(self, k: int) -> np.ndarray | None:
        """A mask of the members that share a lower home with member k; None for none."""
        found = [self.members[g] for g in self.lower[k] if g in self.members]
        if not found:
            return None
        mask = np.zeros(self.count, bool)
        for x in found:
            mask[x] = True
        return mask

    def clear(self, ok: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        """Take such pairs out of a matrix of pairs."""
        for r in np.flatnonzero(ok.any(1)):
            mask = self.of(int(rows[r]))
            if mask is not None:
                ok[r] &= ~mask[columns]


def _pruner(t: float):
    """Members that still have a partner by the bitmaps' bound on the overlap.

    Two sets share at most the common bits and the hashes that fell on a bit
    already set.  Sets that may be similar differ in size by 1 / t at most, so
    each is compared with those of its own bitmap size and of larger ones, folded.
    """

    def prune(group: pa.Table) -> pa.Table:
        ids, where, home = group["doc_id"].to_numpy(), group["block"].to_numpy(), group["home"][0].as_py()
        ba, bb = group["ba"][0].as_py(), group["bb"][0].as_py()
        held = group["payload"].to_pylist()
        size = np.array([int(np.frombuffer(h, np.int64, 1)[0]) for h in held])
        count = np.array([(len(h) - 8) // 8 for h in held])
        keep = np.zeros(len(ids), bool)
        owned = _Lower(group["homes"].to_pylist(), home)
        for c in np.unique(count):
            small = np.flatnonzero(count == c)
            x = np.stack([np.frombuffer(held[k], np.uint64, offset=8) for k in small])
            extra_x = size[small] - np.bitwise_count(x).sum(1)
            for d in np.unique(count[count >= c]):
                if d > 2 * c / t:  # larger by more than similar sets can be
                    continue
                large = np.flatnonzero(count == d)
                y = _folded(np.stack([np.frombuffer(held[k], np.uint64, offset=8) for k in large]), int(c))
                extra_y = size[large] - np.bitwise_count(y).sum(1)
                step = max(1, 4_000_000 // (len(large) * int(c)))
                for s in range(0, len(small), step):
                    i = small[s : s + step]
                    common = np.bitwise_count(x[s : s + step, None, :] & y[None, :, :]).sum(2, dtype=np.int64)
                    bound = common + np.minimum(extra_x[s : s + step, None], extra_y[None, :])
                    a, b = size[i][:, None], size[large][None, :]
                    ok = (bound >= _need(a, b, t)) & (np.minimum(a, b) >= t * np.maximum(a, b) - 1e-9) & (ids[i][:, None] != ids[large][None, :])
                    if ba != bb:
                        ok &= where[i][:, None] != where[large][None, :]
                    owned.clear(ok, i, large)
                    keep[i] |= ok.any(1)
                    keep[large] |= ok.any(0)
        left = np.unique(ids[keep])
        return pa.table({"home": np.full(len(left), home, np.int64), "doc_id": left})

    return prune


def _gathered(own: DataFrame, found: DataFrame, n: int, payload) -> DataFrame:
    """(home, ba, bb, block, doc_id, copies, homes, payload): members with what a task needs of their sets.

    Member k of a home lies in one of its blocks; a task has two blocks, or one
    with itself.  Texts stay where they are: their hashes are joined with the
    members, after a filter of fixed size has dropped most others.
    """
    sizes = found.groupBy("home").agg(F.count("*").alias("m")).filter("m > 1")
    blocked = found.join(sizes, "home").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    tasks = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.col("doc_id").alias("__member"), "copies", "home", F.least("block", "other").alias("ba"), F.greatest("block", "other").alias("bb"), "block"
    )
    per_doc = tasks.groupBy("__member").agg(F.max("copies").alias("copies"), F.collect_list(F.struct("home", "ba", "bb", "block")).alias("at"))
    bits, bit = id_filter(found, "doc_id")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bits.value
        for b in batches:
            at = b.column(2).to_numpy()
            b = b.filter(pa.array(seen[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1))
            ids, texts = b.column(0), b.column(1).to_pylist()
            for s, e in chunks([len(x or "") for x in texts], 3_000_000):
                _, g, o = _distinct_sets(texts[s:e], n)
                cut = np.searchsorted(o, np.arange(e - s + 1))
                yield pa.RecordBatch.from_arrays([ids.slice(s, e - s), pa.array([payload(g[cut[i] : cut[i + 1]]) for i in range(e - s)], pa.binary())], ["doc_id", "payload"])
        tidy()

    sets = own.select("doc_id", "text", bit(F.col("doc_id")).alias("bit")).mapInArrow(gather, "doc_id bigint, payload binary")
    joined = sets.join(per_doc, F.col("doc_id") == F.col("__member"))
    return joined.select("doc_id", "payload", "copies", F.array_distinct("at.home").alias("homes"), F.explode("at").alias("p")).select("p.home", "p.ba", "p.bb", "p.block", "doc_id", "copies", "homes", "payload")


def _joiner(t: float, pairs: bool):
    """What a task tells of its pairs: all of them, or links by set and the pairs that join groups."""

    def join(group: pa.Table) -> pa.Table:
        ba, bb, home = group["ba"][0].as_py(), group["bb"][0].as_py(), group["home"][0].as_py()
        order = np.argsort(group["doc_id"].to_numpy(), kind="stable")
        ids, where, copies = (group[c].to_numpy()[order] for c in ("doc_id", "block", "copies"))
        payload, homes = group["payload"], group["homes"].to_pylist()
        owned = _Lower([homes[k] for k in order], home)
        sets = [_from_six(payload[k].as_py()) for k in order.tolist()]
        left = np.flatnonzero(where == ba)
        right = left if ba == bb else np.flatnonzero(where == bb)
        label, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        a, b, s = [], [], []
        for i, js, sim in _answers(sets, left, right, t):
            ok = ids[js] != ids[i]
            if ba == bb:
                ok &= js > i
            mask = owned.of(i)
            if mask is not None:
                ok &= ~mask[js]
            js, sim = js[ok], sim[ok]
            links[i] += copies[js].sum()
            links[js] += copies[i]
            if not pairs and len(js):
                apart, first = np.unique(label[js], return_index=True)
                new = apart != label[i]
                js, sim = js[first[new]], sim[first[new]]
                for x in apart[new]:
                    label[label == x] = label[i]
            a.append(np.minimum(ids[i], ids[js]))
            b.append(np.maximum(ids[i], ids[js]))
            s.append(sim)
        some = np.flatnonzero(links) if not pairs else np.zeros(0, np.int64)
        none, count = np.zeros(0, np.int64), sum(map(len, a))
        return pa.table({
            "a": pa.array(np.concatenate([none, *a, ids[some]])), "b": pa.array(np.concatenate([none, *b, ids[some]])),
            "jaccard": pa.array(np.concatenate([np.zeros(0), *s, np.zeros(len(some))])), "links": pa.array(np.concatenate([np.zeros(count, np.int64), links[some]])),
        })

    return join


class _Join:
    """The join's parts: ``rows`` (a, b, jaccard, links) and the documents' representatives."""

    def __init__(self, docs: DataFrame, n: int, t: float, id_col: str, text_col: str, pairs: bool) -> None:
        kind = docs.schema[id_col].dataType.typeName()
        if kind not in ("byte", "short", "integer", "long", "void"):
            raise TypeError(f"ids must be integers, not {kind}")
        own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
        tallies = tallied(own, n, t, "doc_id", "text")
        heavy = heavy_tokens(tallies)
        # rows that repeat an id and a set are one; an id with several sets shares its fingerprints with no other
        rows = tallies.filter(F.col("kind") == _DOC).select(F.col("token").alias("doc_id"), "fa", "fb")
        prints = stored(rows.distinct(), "prints")
        self.prints = own_prints(prints)
        self.reps = stored(self.prints.groupBy("fa", "fb", "own").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "representatives")
        other = stored(self.prints.join(self.reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti").select(F.col("doc_id").alias("__copy")).distinct(), "copies")
        few = other.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES
        chosen = own.join(F.broadcast(other) if few else other, F.col("doc_id") == F.col("__copy"), "left_anti")
        if rows.count() > prints.count():
            chosen = chosen.dropDuplicates(["doc_id", "text"])
        weight = self.reps.groupBy(F.col("rep").alias("doc_id")).agg(F.max("copies").alias("copies"))
        first = stored(members(chosen, heavy, n, t).join(weight, "doc_id"), "members")
        bits = _gathered(chosen, first, n, _bitmap).groupBy("home", "ba", "bb").applyInArrow(_pruner(t), "home bigint, doc_id bigint")
        found = stored(bits.distinct().join(weight, "doc_id"), "members")
        self.rows = _gathered(chosen, found, n, _six).groupBy("home", "ba", "bb").applyInArrow(_joiner(t, pairs), "a bigint, b bigint, jaccard double, links bigint")


def similar_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, jaccard) for all pairs a < b of representatives whose n-gram sets are ``threshold`` similar.

    A representative is the lowest id of those with an equal set; see
    ``similar_classes`` for everything else.
    """
    return _Join(docs, n, threshold, id_col, text_col, True).rows.groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))


def similar_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, links) for each id of ``docs``.

    ``links`` is the number of other ids whose n-gram sets are ``threshold``
    similar to the id's, copies included; ``class_id`` is the lowest id that is
    reached over links, the id itself without any.

    Words are lower-cased and split at white space; a text of fewer than n words
    has one gram, all its words.  A text without words (null, empty, white space)
    has no links.  Rows that repeat an id and a set are one; sets of one id that
    differ are compared one by one, and its links are added.  A null id has a row
    with a null class and no links, as often as it occurs.  Ids must be integers;
    others raise a TypeError.  An empty table gives an empty result; other columns
    are ignored.
    """
    join = _Join(docs, n, threshold, id_col, text_col, False)
    rows = stored(join.rows, "links")
    links = rows.filter("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    of_group = groups(rows.filter("a < b").select("a", "b")).select(F.col("doc_id").alias("rep"), F.col("group").alias("class_id"))
    reps = join.reps.join(links, "rep", "left").join(of_group, "rep", "left")
    # only sets that a row may share have anything to tell
    told = reps.filter("copies > 1 or links is not null").select("fa", "fb", "own", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "copies")
    told = stored(told, "classes")
    known = join_told(join.prints, told, ["fa", "fb", "own"])
    known = known.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("links").alias("links"))
    ids = docs.select(F.col(id_col).alias("doc_id"))
    every = ids.filter("doc_id is not null").distinct().join(known.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id"), "left")
    none = ids.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return every.select("doc_id", F.coalesce("class_id", F.col("doc_id").cast("long")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links")).unionByName(none)


def groups(pairs: DataFrame) -> DataFrame:
    """(doc_id, group): each id of ``pairs`` with the lowest id of its connected component.

    Alternating large-star and small-star steps; each is a written table, so a
    lost executor costs nothing and the plan stays short.
    """
    e = stored(pairs.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        new = stored(small, "edges")
        # finished when every node has one edge, and none of the centres is a leaf
        if new.groupBy("u").count().filter("count > 1").isEmpty() and new.join(new.select(F.col("u").alias("x")), F.col("v") == F.col("x"), "left_semi").isEmpty():
            return new.select(F.col("u").alias("doc_id"), F.col("v").alias("group"))
        e = new


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, with all columns, without documents whose class has a lower id.

    Null, empty and blank texts stay, as do rows with a null id.  Rows that repeat
    an id are one document: all go or, of those with one text, one row stays.  An
    empty table gives an empty result; ids that aren't integers raise a TypeError.
    """
    classes = stored(similar_classes(docs, n, threshold, id_col, text_col).filter("doc_id is not null"), "classes")
    dropped = classes.filter("class_id < doc_id").select(F.col("doc_id").alias("__dropped"))
    few = dropped.limit(2_000_001).count() <= 2_000_000
    kept = docs.join(F.broadcast(dropped) if few else dropped, F.col(id_col) == F.col("__dropped"), "left_anti")
    again = stored(docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__again")).count().filter("count > 1").select("__again"), "repeats")
    if again.isEmpty():
        return kept
    same = F.col(id_col) == F.col("__again")
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))
