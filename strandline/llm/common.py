"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters of text that one numpy pass works on.
CHUNK_CHARS = 1_500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    ``spark.checkpoint.dir`` names it on a cluster; only where that setting is
    absent and all runs in one process (local tests) is a temporary folder used.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), f"strandline-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def reach_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Where the package was installed or shipped to the executors, the extra
    folder changes nothing.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The copy lives in the shared folder, so the loss of an executor costs
    nothing; the folder's owner removes it with the application's other files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy() -> None:
    """Give memory that a task has freed back to the system: a worker lives on beside the executor's heap."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def in_parts(batches: Iterator, texts: Callable = lambda batch: batch) -> Iterator:
    """``batches`` in slices of about ``CHUNK_CHARS`` bytes of text, in their order; ``texts`` gives a batch's array of them.

    So what a worker holds beside a batch, and what the engine gets back at once,
    doesn't grow with the batch.  A text is never cut.
    """
    import pyarrow.compute as pc

    for b in batches:
        for s, e in chunks(pc.fill_null(pc.binary_length(texts(b)), 0).to_pylist()):
            yield b.slice(s, e - s)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def most_frequent(counted: DataFrame, most: int, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``counted`` of greatest count ``c``, ``most`` or a few more or less, and the rest.

    Counts fall into bins of a 16th of a power of 2; of the last bin a share
    by hash of ``key`` is taken, so that neither a sort nor one task sees all rows.
    """
    binned = counted.withColumn("__bin", F.floor(16 * F.log2("c")).cast("int"))
    sizes = {r[0]: r[1] for r in binned.groupBy("__bin").count().collect()}  # 1,024 at most
    total, last, share = 0, None, 1.0
    for last in sorted(sizes, reverse=True):
        if total + sizes[last] > most:
            share = (most - total) / sizes[last]
            break
        total += sizes[last]
    if last is None:
        return counted, counted
    part = F.pmod(F.xxhash64(key, F.lit(9)), F.lit(1 << 20)) < int(share * (1 << 20))
    top = (F.col("__bin") > last) | ((F.col("__bin") == last) & part)
    return binned.filter(top).drop("__bin"), binned.filter(~top).drop("__bin")


#: Bits of the filter that ``id_filter`` makes: 4 MB, whatever the number of ids.
FILTER_BITS = 1 << 25


def _filter_bit(ids: Column) -> Column:
    return F.pmod(F.xxhash64(ids, F.lit(77)), F.lit(FILTER_BITS))


def id_filter(ids: DataFrame, id_col: str):
    """Broadcast bits (4 MB at most) of the ids in ``ids``, and the column that finds an id's bit.

    A bit may stand for other ids as well: it spares work before a join, and
    doesn't replace the join.
    """
    import numpy as np

    bit = _filter_bit(F.col(id_col))
    held = ids.groupBy(F.floor(bit / 32768).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(32768))).alias("bits")).toArrow()
    bits = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for bucket, b in zip(held["bucket"].to_pylist(), held["bits"].to_pylist()):
        bits[bucket] = np.frombuffer(b, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(bits.ravel()), _filter_bit


#: Copies from which a key is hot, and hot keys at most.
HOT, MOST_HOT = 10_000, 100_000


def join_told(members: DataFrame, told: DataFrame, keys: list[str]) -> DataFrame:
    """``members`` with what ``told`` (keys, copies, ...) says of their keys; rows without stay out.

    Hot keys are broadcast (``MOST_HOT`` at most), so that no task has all copies
    of one; the others are joined by shuffle.
    """
    hot_from = max(HOT, told.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] // MOST_HOT)
    hot, rest = told.filter(F.col("copies") > hot_from).drop("copies"), told.filter(F.col("copies") <= hot_from).drop("copies")
    cold = members.join(F.broadcast(hot.select(keys)), keys, "left_anti")
    return members.join(F.broadcast(hot), keys).unionByName(cold.join(rest, keys))


def own_prints(prints: DataFrame) -> DataFrame:
    """``prints`` (doc_id, fa, fb; distinct) with ``own``: 0, or for an id with several prints a number of its own.

    So copies of one content share (fa, fb, own), and an id with several contents
    shares none of them.
    """
    several = stored(prints.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__several")), "several")
    none = F.lit(0).cast("long")
    if several.isEmpty():
        return prints.withColumn("own", none)
    own = F.when(F.col("__several").isNull(), none).otherwise(F.shiftleft("doc_id", 1).bitwiseOR(F.lit(1)))
    return prints.join(several, F.col("doc_id") == F.col("__several"), "left").select("doc_id", "fa", "fb", own.alias("own"))


def chunks(sizes: list[int], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ``(start, end)`` ranges whose sizes add up to about ``limit``.

    One element larger than the limit is a range of its own.
    """
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
