"""Quality by a likelihood ratio of hashed n-grams.

Words and word pairs are hashed into a fixed number of buckets.  One pass over
the whole corpus counts them twice: over all documents (the raw multinomial)
and over the trusted ones (the target).  A document's score is the mean, over
its n-grams, of log p_target - log p_raw, and it is kept from a fixed score on.
Both tables have a fixed size whatever the corpus, so they may be broadcast.

Log ratios are rounded to millionths and added as integers: the score doesn't
depend on the order of addition, and the same document always decides alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BUCKETS, MAX_N, SMOOTHING, SCALE = 1 << 16, 2, 1.0, 1_000_000
#: Documents score about 0 when they are like the corpus; below this they are unlike trusted text.
THRESHOLD = -0.35
#: Trusted ids up to which they are broadcast; beyond, labels are joined by shuffle.
BROADCAST_IDS = 2_000_000


def grams(texts: list[str | None], buckets: int, max_n: int = MAX_N) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text index of every 1..max_n-gram."""
    from strandline.llm.textgrams import ngram_hashes, word_hashes

    words, per_text = word_hashes(texts)
    parts = [ngram_hashes(words, per_text, n) for n in range(1, max_n + 1)]
    return np.concatenate([(h % np.uint64(buckets)).astype(np.int64) for h, _ in parts]), np.concatenate([d for _, d in parts])


def corpus_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket over all of ``docs`` and over the trusted ones.

    ``trusted`` has a column doc_id; nulls and repeats in it are ignored.
    """
    ids = trusted.select(F.col("doc_id").alias("__trusted")).filter("__trusted is not null").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    joined = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("__trusted"), "left").select("text", F.col("__trusted").isNotNull().alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.llm.common import chunks

        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            texts, flags = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), bool)
            for s, e in chunks([len(t or "") for t in texts]):
                g, d = grams(texts[s:e], buckets)
                raw += np.bincount(g, minlength=buckets)
                good += np.bincount(g[flags[s:e][d]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(raw[some]), pa.array(good[some])], ["bucket", "raw", "good"])

    # as many rows as buckets, however large the corpus
    rows = joined.mapInArrow(count, "bucket bigint, raw bigint, good bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    at = rows["bucket"].to_numpy()
    raw[at], good[at] = rows["raw"].to_numpy(), rows["good"].to_numpy()
    return raw, good


def log_ratios(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Smoothed log p_target - log p_raw of each bucket, in millionths."""
    p = np.log((good + SMOOTHING) / (good.sum() + SMOOTHING * len(good)))
    q = np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * len(raw)))
    return np.rint((p - q) * SCALE).astype(np.int64)


def score(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_grams, score, keep) for each row of ``docs``.

    A text without words (null, empty, white space) has score null and is not
    kept.  Null ids and repeated rows keep their rows; other columns are
    ignored; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    table = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.llm.common import chunks

        r = table.value
        for b in batches:
            texts = b.column(1).to_pylist()
            total, n = [], []
            for s, e in chunks([len(t or "") for t in texts]):
                g, d = grams(texts[s:e], len(r))
                order = np.argsort(d, kind="stable")
                count = np.bincount(d, minlength=e - s)
                run_sum = np.concatenate(([0], np.cumsum(r[g[order]])))
                ends = np.cumsum(count)
                total.append(run_sum[ends] - run_sum[ends - count])
                n.append(count)
            total, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (total, n))
            value = np.where(n > 0, total / np.maximum(n, 1) / SCALE, np.nan)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(value, mask=n == 0), pa.array((n > 0) & (value >= threshold))], ["doc_id", "n_grams", "score", "keep"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_grams bigint, score double, keep boolean")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Score ``docs`` against those that ``labels`` call good and not toxic."""
    raw, good = corpus_counts(docs, labels.filter("quality = 1 and coalesce(toxic, 0) = 0"), buckets)
    return score(docs, log_ratios(raw, good), threshold)
