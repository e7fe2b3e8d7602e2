"""The pattern language ``A -edge-> B [WHERE field=value]`` compiled to one plan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from strandline.graph import PropertyGraph
from strandline.operators.lookup import uncapped

_PATTERN = re.compile(r"^\s*(\S+)\s+-(?:(\S+?)-)?>\s+(\S+)(?:\s+where\s+(\w+)\s*=\s*(.+?))?\s*$", re.I)


def parse(pattern: str) -> tuple[str, str, str, str | None, str | None]:
    m = _PATTERN.match(pattern)
    if not m:
        raise ValueError(f"not a pattern: {pattern!r}")
    return m[1], m[2] or "*", m[3], m[4], m[5].strip("'\"") if m[5] else None


def like(column: Column, value: str) -> Column:
    """Equal but for case; ``*`` is anything, a trailing ``*`` any ending."""
    if value == "*":
        return F.lit(True)
    low = F.lower(F.coalesce(column.cast("string"), F.lit("")))
    return F.startswith(low, F.lit(value[:-1].lower())) if value.endswith("*") else low == value.lower()


def graph_query(g: PropertyGraph, pattern: str, limit: int = 50) -> DataFrame:
    """(source, edge_type, target, error); WHERE holds if either end has it; a limit of 0 or less means all.

    What isn't a pattern, or names a field that nodes don't have, gives one row
    with the error.
    """
    n = g.nodes
    try:
        source, edge, target, field, value = parse(pattern)
        if field and field not in n.columns:
            raise ValueError(f"nodes have no field {field!r}")
    except ValueError as wrong:
        return n.sparkSession.createDataFrame([(None, None, None, str(wrong))], "source string, edge_type string, target string, error string")
    s = n.select(F.col("id").alias("source"), F.col("type").alias("st"), *([F.col(field).alias("sf")] if field else []))
    t = n.select(F.col("id").alias("target"), F.col("type").alias("tt"), *([F.col(field).alias("tf")] if field else []))
    e = g.edges.filter(like(F.col("type"), edge)).select("source", "target", F.col("type").alias("edge_type"))
    rows = e.join(s.filter(like(F.col("st"), source)), "source").join(t.filter(like(F.col("tt"), target)), "target")
    if field:
        rows = rows.filter(like(F.col("sf"), value) | like(F.col("tf"), value))
    return uncapped(rows.select("source", "edge_type", "target", F.lit(None).cast("string").alias("error")).orderBy("source", "edge_type", "target"), limit)
