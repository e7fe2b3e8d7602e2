"""Toxicity by compression distance.

Two zstandard dictionaries are trained, each on windows of one class of labelled
documents: one on ordinary text, one on toxic text.  A window is a word with its
boundaries.  Compressed under both, a window that only the toxic dictionary knows
becomes much shorter there; that gain over its length is the distance.  A window
counts as toxic from a calibrated gain on, and a document from a calibrated share
of such windows on.

Toxic documents consist mostly of ordinary words.  So the toxic dictionary is
trained on those of their windows that are over-represented against ordinary
documents; trained on all of them, it learns the ordinary words again.  Windows of
several words were tried: the other words' noise hides one toxic word (on held-out
documents, windows of 3 words found 52 % of toxic ones where 0.8 % of ordinary ones
were rejected; words find more than 99 %).

Every window ends in a fixed trailer that both dictionaries hold; without it blocks
as small as a word would be stored uncompressed.

Fitting reads a bounded sample of labelled rows (``MAX_TOXIC``, ``MAX_ORDINARY``)
in one task; scoring reads every word of every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, functions as F

from strandline.llm.common import tidy

#: Labelled documents that are read for fitting, by a seeded hash of their id.
MAX_TOXIC, MAX_ORDINARY = 3000, 9000
ORDINARY_BYTES, TOXIC_BYTES, LEVEL, MIN_MATCH = 65536, 16384, 13, 3
#: zstandard's cover parameters: segment and d-mer sizes; windows that the ordinary dictionary is trained on, at most.
SEGMENT, DMER, MAX_WINDOWS = 64, 6, 400_000
#: An over-represented word is so many times as frequent in toxic documents, and in so many at least.
RATIO, LEAST = 20, 3
TRAILER = bytes(range(128, 160))
#: Remembered words of one task; beyond, the memory starts afresh.
MEMO = 400_000
_PUNCT = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    gain: float
    share: float

    def compressors(self) -> tuple[zs.ZstdCompressor, zs.ZstdCompressor]:
        p = zs.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0, format=zs.FORMAT_ZSTD1_MAGICLESS)
        return tuple(zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=p) for d in (self.toxic, self.ordinary))

    def decide(self, hits: int, windows: int) -> bool:
        return hits > 0 and hits >= self.share * windows


def normal_words(word: str) -> list[str]:
    """The parts of a white-space word between punctuation."""
    return _PUNCT.sub(" ", word).split()


def _lengths(c: zs.ZstdCompressor, windows: list[bytes]) -> np.ndarray:
    size = np.fromiter(map(len, windows), np.uint64, len(windows))
    start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.uint64)
    out = c.multi_compress_to_buffer(zs.BufferWithSegments(b"".join(windows), np.stack([start, size], 1).astype("<u8").tobytes()), threads=1)
    return np.fromiter(map(len, (out[i] for i in range(len(out)))), np.int64, len(out))


def gains(pair: tuple[zs.ZstdCompressor, zs.ZstdCompressor], words: list[str]) -> np.ndarray:
    """(length under ordinary - length under toxic) / window length, for each word."""
    if not words:
        return np.zeros(0)
    windows = [b" " + w.encode("utf-8", "replace") + b" " + TRAILER for w in words]
    size = np.fromiter((len(x) - len(TRAILER) - 1 for x in windows), np.int64, len(windows))
    return (_lengths(pair[1], windows) - _lengths(pair[0], windows)) / size


def _split(text: str | None) -> list[str]:
    return [p for w in (text or "").lower().split() for p in normal_words(w)]


def _without_copies(docs: list[list[str]]) -> list[list[str]]:
    """Documents less than half of whose trigrams an earlier one has."""
    seen: set = set()
    out = []
    for w in docs:
        grams = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
        if 2 * len(grams & seen) <= len(grams):
            out.append(w)
        seen |= grams
    return out


def _trained(windows: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes; where there is too little to train on, the windows themselves."""
    if sum(map(len, windows)) > 4 * size and len(windows) > 100:
        try:
            return zs.train_dictionary(size, windows, k=SEGMENT, d=DMER).as_bytes()
        except zs.ZstdError:
            pass
    return b"".join(dict.fromkeys(windows))[-size:]


def _window(word: str) -> bytes:
    return b" " + word.encode("utf-8", "replace") + b" "


def fit(toxic_texts: list[str], ordinary_texts: list[str]) -> ToxicityModel:
    """Train on the first 70 % of either class, calibrate on the rest.

    Without toxic or without ordinary texts, the model rejects nothing.
    """
    nothing = ToxicityModel(TRAILER, TRAILER, 2.0, 1.0)
    if not toxic_texts or not ordinary_texts:
        return nothing
    small = len(toxic_texts) < 20 or len(ordinary_texts) < 20
    cut_t, cut_o = (len(x) if small else len(x) * 7 // 10 for x in (toxic_texts, ordinary_texts))
    held_t, held_o = (toxic_texts, ordinary_texts) if small else (toxic_texts[cut_t:], ordinary_texts[cut_o:])
    df_t: Counter = Counter()
    df_o: Counter = Counter()
    train_t = _without_copies([_split(t) for t in toxic_texts[:cut_t]])
    for w in train_t:
        df_t.update(set(w))
    ordinary: list[bytes] = []
    for t in ordinary_texts[:cut_o]:
        w = _split(t)
        df_o.update(set(w))
        if len(ordinary) < MAX_WINDOWS:
            ordinary += map(_window, w)
    # with one unseen ordinary document granted
    over = {w for w, c in df_t.items() if c >= LEAST and c * cut_o >= RATIO * (df_o[w] + 1) * len(train_t)}
    toxic = [_window(w) for d in train_t for w in d if w in over]
    if not toxic:
        return nothing
    model = ToxicityModel(_trained(ordinary[:MAX_WINDOWS], ORDINARY_BYTES) + TRAILER, _trained(toxic, TOXIC_BYTES) + TRAILER, 2.0, 1.0)
    del ordinary, toxic, train_t
    scorer = Scorer(model)

    def gains_of(texts: list[str]) -> list[np.ndarray]:
        out, known = [], {}
        for t in texts:
            w = _split(t)
            new = sorted(set(w) - known.keys())
            known.update(zip(new, gains(scorer.pair, new)))
            out.append(np.array([known[x] for x in w] or [-1.0]))
        return out

    g_t, g_o = gains_of(held_t), gains_of(held_o)
    best = None
    for limit in (0.36, 0.4, 0.44, 0.48, 0.52, 0.56, 0.6):
        for share in (0.0, 0.001, 0.002, 0.003, 0.004):
            hit = lambda g: (k := (g >= limit).sum()) > 0 and k >= share * len(g)  # noqa: B023, E731
            recall, wrong = np.mean([hit(g) for g in g_t]), np.mean([hit(g) for g in g_o])
            # of equal scores, the thresholds nearest the middle of the grid
            key = (round(recall - 5 * wrong, 4), -abs(limit - 0.48) - 20 * abs(share - 0.002))
            if best is None or key > best[0]:
                best = (key, limit, share)
    return ToxicityModel(model.ordinary, model.toxic, best[1], best[2])


def fit_on(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> ToxicityModel:
    """Fit on labelled rows of ``docs``, in one task that has them alone.

    Ids are chosen by hash first, so that only chosen texts move.  An id with
    both labels isn't fitted; of rows that repeat an id, one is.
    """
    ids = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").select("doc_id", "toxic")
    order = F.xxhash64("doc_id")
    chosen = ids.filter("toxic = 1").orderBy(order, "doc_id").limit(max_toxic).unionByName(ids.filter("toxic = 0").orderBy(order, "doc_id").limit(max_ordinary))
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, ordinary = [], []
        for b in batches:
            for kind, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (toxic if kind == 1 else ordinary).append(text)
        m = fit(toxic, ordinary)
        del toxic, ordinary
        tidy()
        yield pa.RecordBatch.from_arrays([pa.array([m.ordinary], pa.binary()), pa.array([m.toxic], pa.binary()), pa.array([m.gain]), pa.array([m.share])], ["ordinary", "toxic", "gain", "share"])

    one = rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", "toxic", "text").repartition(1).sortWithinPartitions("h", "doc_id").select("toxic", "text")
    fitted = one.mapInArrow(run, "ordinary binary, toxic binary, gain double, share double").first()
    return ToxicityModel(bytes(fitted.ordinary), bytes(fitted.toxic), fitted.gain, fitted.share) if fitted else fit([], [])


class Scorer:
    """Counts a document's toxic windows; each distinct word is compressed once a task."""

    def __init__(self, model: ToxicityModel):
        self.model, self.pair, self.memo = model, model.compressors(), {}

    def add(self, words: set[str]) -> None:
        new = sorted(words - self.memo.keys())
        if len(self.memo) + len(new) > MEMO:
            self.memo = {}
            new = sorted(words)
        parts = [normal_words(w) for w in new]
        flat = sorted({p for ps in parts for p in ps})
        hit = dict(zip(flat, gains(self.pair, flat) >= self.model.gain))
        self.memo.update((w, int(any(hit[p] for p in ps))) for w, ps in zip(new, parts))

    def count(self, texts: list[str | None]) -> list[tuple[int, int]]:
        docs = [(t or "").lower().split() for t in texts]
        self.add(set().union(*docs))
        return [(sum(map(self.memo.__getitem__, d)), len(d)) for d in docs]


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, windows, toxic_windows, toxic) for each row of ``docs``.

    A null or empty text has no windows and isn't toxic.  Null ids and repeated
    rows keep their rows.  Words of any length are compressed whole.  An empty
    table gives an empty result; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.llm.common import chunks

        scorer = Scorer(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [x for s, e in chunks([len(t or "") for t in texts]) for x in scorer.count(texts[s:e])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for _, n in found], pa.int64()), pa.array([k for k, _ in found], pa.int64()), pa.array([model.decide(k, n) for k, n in found], pa.bool_())],
                ["doc_id", "windows", "toxic_windows", "toxic"],
            )
        del scorer
        tidy()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, windows bigint, toxic_windows bigint, toxic boolean")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that the model doesn't reject.

    Null and empty texts stay; repeated rows are decided alike; an empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.llm.common import in_parts

        scorer = Scorer(model)
        for b in in_parts(batches, lambda b: b.column(text_col)):
            found = scorer.count(b.column(text_col).to_pylist())
            yield b.filter(pa.array([not model.decide(k, n) for k, n in found], pa.bool_()))
        del scorer
        tidy()

    return docs.mapInArrow(run, docs.schema)
