"""What changed, what that reaches, and renames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from strandline.graph import PropertyGraph
from strandline.operators.lookup import god_nodes, node_degrees, uncapped
from strandline.operators.traverse import layers


def detect_changes(g: PropertyGraph, changed_files: DataFrame, max_depth: int = 2) -> DataFrame:
    """(id, depth): nodes of changed files (0) and what depends on them within ``max_depth``."""
    seeds = g.nodes.join(changed_files.select("file_path").distinct(), "file_path", "left_semi").select(F.lit("").alias("root"), "id")
    return layers(g.edges.filter("type <> 'contains'"), seeds, "in", max_depth).select("id", "depth")


def upper_median_degree(g: PropertyGraph, degrees: DataFrame | None = None) -> DataFrame:
    """One row (median): the degree of the middle node, the upper of two; found by counts of equal degrees."""
    d = node_degrees(g) if degrees is None else degrees
    by = d.groupBy("degree").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.orderBy("degree"))
    t = by.withColumn("upto", upto).withColumn("n", F.sum("c").over(W.partitionBy()))
    return t.filter("upto > n div 2").agg(F.min("degree").alias("median"))


def hot_nodes(g: PropertyGraph, changed: DataFrame, top_n: int = 5, hubs: int = 10, degrees: DataFrame | None = None) -> DataFrame:
    """Changed nodes of at least the upper median degree that aren't among the ``hubs`` anyway."""
    d = node_degrees(g) if degrees is None else degrees
    few = F.broadcast(god_nodes(g, hubs, degrees=d).select("id")) if hubs > 0 else god_nodes(g, hubs, degrees=d).select("id")
    high = d.crossJoin(F.broadcast(upper_median_degree(g, d))).filter("degree >= median").select("id", "degree")
    found = high.join(changed.select("id"), "id", "left_semi").join(few, "id", "left_anti")
    return uncapped(found.orderBy(F.desc("degree"), "id"), top_n)


def rename(g: PropertyGraph, old: str, new: str, lines: DataFrame | None = None) -> DataFrame:
    """(where, confidence, before, after): nodes whose name holds ``old``; of ``lines`` (file_path, line, text) those with it as a word."""
    import re

    hit = g.nodes.filter(F.contains(F.col("name"), F.lit(old))).select(F.col("id").alias("where"), F.lit("high").alias("confidence"), F.col("name").alias("before"), F.replace("name", F.lit(old), F.lit(new)).alias("after"))
    if lines is None:
        return hit
    plain = new.replace("\\", "\\\\").replace("$", "\\$")  # neither is special in the new name
    word = rf"\b{re.escape(old)}\b"
    text = lines.filter(F.col("text").rlike(word)).select(F.concat_ws(":", "file_path", F.col("line").cast("string")).alias("where"), F.lit("medium").alias("confidence"), F.col("text").alias("before"), F.regexp_replace("text", word, plain).alias("after"))
    return hit.unionByName(text)


def apply_renames(rows: list[tuple[str, int]], old: str, new: str, dry_run: bool = True) -> list[tuple[str, int, str, str]]:
    """Rewrite lines (file, line number) of local files, ``old`` as a word; (file, line, before, after) of what changes.

    A driver's tool on a working copy; without ``dry_run=False`` nothing is written.
    """
    import re

    by_file: dict[str, set[int]] = {}
    for path, line in rows:
        by_file.setdefault(path, set()).add(line)
    word, out = re.compile(rf"\b{re.escape(old)}\b"), []
    for path, lines in sorted(by_file.items()):
        with open(path, encoding="utf-8") as f:
            text = f.read().splitlines(keepends=True)
        for k in sorted(lines):
            if 0 < k <= len(text) and (after := word.sub(lambda _: new, text[k - 1])) != text[k - 1]:
                out.append((path, k, text[k - 1].rstrip("\n"), after.rstrip("\n")))
                text[k - 1] = after
        if not dry_run:
            with open(path, "w", encoding="utf-8") as f:
                f.writelines(text)
    return out
