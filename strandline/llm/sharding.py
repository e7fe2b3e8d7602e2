"""Sharding by proportional stratified interleaving.

Rows of a source are put in a seeded order; row r of n has the fractional rank
(2r - 1) / 2n.  Sorted by that rank, the sources interleave in proportion, so
equal cuts of the order all hold the mixture of the whole.

Neither order is made in one task.  Rows are ranked inside small buckets (by
hash prefix, then by fractional rank) and the ranks are shifted by the number
of rows in earlier buckets.  The first shift comes from one narrow aggregate;
the second is a closed formula of the sources' sizes, so a hot source is spread
over as many tasks as any other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

SHARDS, SEED, BUCKETS = 64, 17, 4096


def stratified_shards(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row (doc_id, source, position, shard) for each row of ``docs``.

    Null sources are a source of their own.  A null id hashes like an empty
    string.  Repeated rows are kept, each with a position; which of two equal
    rows comes first can't be told apart.  Texts aren't read.  An empty table
    gives an empty result.  Other columns are ignored, whatever their names.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("h"),
    ).withColumn("b", F.substring("h", 1, 3))
    counts = rows.groupBy("source", "b").agg(F.count("*").alias("c"))
    before = F.sum("c").over(W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, -1))
    places = counts.select(
        F.col("source").alias("s"), F.col("b").alias("sb"),
        F.coalesce(before, F.lit(0)).alias("earlier"), F.sum("c").over(W.partitionBy("source")).alias("n"),
    )
    ranked = (
        rows.withColumn("k", F.row_number().over(W.partitionBy("source", "b").orderBy("h", "doc_id")))
        .join(places, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("sb")))
        .select("doc_id", "source", "h", "n", (F.col("k") + F.col("earlier")).alias("r"))
        .withColumn("f", (2 * F.col("r") - 1).cast("double") / (2 * F.col("n")).cast("double"))
        .withColumn("fb", F.expr(f"(2 * r - 1) * {BUCKETS} div (2 * n)"))
    )
    sizes = counts.groupBy("source").agg(F.sum("c").alias("n"))
    upto = sizes.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BUCKETS).cast("long"))).alias("at"))
    # rows of a source whose fractional rank is below at / BUCKETS
    upto = upto.groupBy("at").agg(F.sum(F.expr(f"((2 * n * at - 1) div {BUCKETS} + 1) div 2")).alias("below"))
    total = sizes.agg(F.sum("n").alias("total"))
    placed = ranked.withColumn("k", F.row_number().over(W.partitionBy("fb").orderBy("f", "source", "h", "doc_id"))).join(upto, F.col("fb") == F.col("at")).crossJoin(F.broadcast(total))
    position = F.col("k") + F.col("below")
    return placed.select("doc_id", "source", position.alias("position"), F.expr(f"cast((k + below - 1) * {n_shards} div total as int)").alias("shard"))


def sql(n_shards: int = SHARDS, seed: int = SEED) -> str:
    return f"""
WITH h AS (SELECT doc_id, source, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST) AS r, count(*) OVER (PARTITION BY source) AS n FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * r - 1 AS DOUBLE) / CAST(2 * n AS DOUBLE), source NULLS FIRST, h, doc_id NULLS FIRST) AS position, count(*) OVER () AS total FROM r)
SELECT doc_id, source, position, CAST((position - 1) * {n_shards} // total AS INTEGER) AS shard FROM p
"""
