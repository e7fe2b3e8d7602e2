"""Mixing sources to target weights by capped water-filling.

A source may be repeated at most ``max_epochs`` times.  Sources whose share
would need more are clamped there, and what they leave over goes to the others
in proportion to their weights, until all fit.  The end of that process is a
water level L with share = min(cap, weight * L); with sources in order of
cap / weight it is found by running sums, without a loop.

A document of a source with e epochs appears floor(e) times, and once more if
its seeded hash, as a fraction, is below e - floor(e).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window as W, functions as F

#: Relative target shares; a source that isn't named has DEFAULT_WEIGHT.
WEIGHTS = {"src0": 20, "src1": 12, "src2": 9, "src3": 6, "src4": 3, "src5": 1}
DEFAULT_WEIGHT, MAX_EPOCHS, BUDGET, SEED = 4, 3, 1.0, 23
#: Sources up to which their table of epochs is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def source_epochs(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, default_weight: float = DEFAULT_WEIGHT, max_epochs: float = MAX_EPOCHS, budget: float = BUDGET, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, chars, target_chars, epochs) for each source of ``docs``.

    ``budget`` is the mixture's size as a multiple of the input's characters.
    A null source is a source of its own with the default weight.  A source of
    weight 0, or without characters, gets no epochs.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.length(F.col(text_col)), F.lit(0)).cast("long")).alias("n"))
    weight = F.lit(float(default_weight))
    for name, value in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    level = W.orderBy("ratio", "source")  # over sources, not documents
    upto = level.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    t = (
        sizes.withColumn("w", weight).withColumn("cap", F.lit(float(max_epochs)) * F.col("n"))
        .withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")))
        .withColumn("total", F.lit(float(budget)) * F.sum("n").over(whole))
        .withColumn("filled", F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("cap"))).over(upto), F.lit(0.0)))
        .withColumn("open", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
        .withColumn("l", F.when((F.col("w") > 0) & (F.col("open") > 0), (F.col("total") - F.col("filled")) / F.col("open")))
        .withColumn("level", F.max(F.when(F.col("l") <= F.col("ratio"), F.col("l"))).over(whole))
    )
    share = F.when(F.col("w") > 0, F.least(F.col("cap"), F.coalesce(F.col("w") * F.col("level"), F.col("cap")))).otherwise(0.0)
    return t.select("source", F.col("n").alias("chars"), share.alias("target_chars"), F.when(F.col("n") > 0, share / F.col("n")).otherwise(0.0).alias("epochs"))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, default_weight: float = DEFAULT_WEIGHT, max_epochs: float = MAX_EPOCHS, budget: float = BUDGET, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", columns: list[str] | None = None, copy_col: str | None = "copy") -> DataFrame:
    """Rows of ``docs`` as often as the mixture has them, with their number from 0 on in ``copy_col``.

    ``columns`` are those returned besides (id and source unless given); one that
    is named as ``copy_col`` gives way to it.  Without ``copy_col`` there is no
    such column.  Repeated rows share a hash and are repeated alike; a null id hashes
    like an empty string; a null or empty text counts no characters but its row
    is sampled like others of its source.  An empty table gives an empty result.
    """
    keep = [id_col, source_col] if columns is None else columns
    epochs = source_epochs(docs, weights, default_weight, max_epochs, budget, source_col, text_col).select(F.col("source").alias("__mix_source"), F.col("epochs").alias("__mix_epochs"))
    few = epochs.select("__mix_source").limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    u = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    times = F.floor("__mix_epochs") + F.when(u < F.col("__mix_epochs") - F.floor("__mix_epochs"), 1).otherwise(0)
    joined = docs.join(F.broadcast(epochs) if few else epochs, F.col(source_col).eqNullSafe(F.col("__mix_source")))
    return joined.withColumn("__mix_times", times.cast("int")).filter("__mix_times > 0").select(*[c for c in keep if c != copy_col], F.explode(F.expr("sequence(0, __mix_times - 1)")).alias(copy_col or "__mix_copy")).drop("__mix_copy")


def sql(weights: Mapping[str, float] = WEIGHTS, default_weight: float = DEFAULT_WEIGHT, max_epochs: float = MAX_EPOCHS, budget: float = BUDGET, seed: int = SEED) -> str:
    cases = " ".join(f"WHEN source = '{k}' THEN {float(v)}" for k, v in weights.items())
    return f"""
WITH n AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n FROM documents GROUP BY source),
w AS (SELECT *, CAST(CASE {cases} ELSE {float(default_weight)} END AS DOUBLE) AS w, CAST({float(max_epochs)} AS DOUBLE) * n AS cap FROM n),
c AS (SELECT *, cap / w AS ratio, CAST({float(budget)} AS DOUBLE) * sum(n) OVER () AS total,
  coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS filled,
  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS open FROM w),
l AS (SELECT *, (total - filled) / open AS l FROM c),
e AS (SELECT source, CASE WHEN n > 0 THEN least(cap, coalesce(w * max(CASE WHEN l <= ratio THEN l END) OVER (), cap)) / n ELSE 0.0 END AS epochs FROM l),
d AS (SELECT doc_id, d.source, epochs, CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM documents d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
t AS (SELECT doc_id, source, CAST(floor(epochs) AS INTEGER) + CASE WHEN u < epochs - floor(epochs) THEN 1 ELSE 0 END AS times FROM d)
SELECT doc_id, source, CAST(c AS INTEGER) AS copy FROM (SELECT doc_id, source, unnest(range(times)) AS c FROM t)
"""
