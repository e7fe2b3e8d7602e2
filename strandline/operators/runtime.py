"""Overlays of runs: calls, edges, coverage, timelines and who exercised what."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strandline.operators.lookup import uncapped


def hotspots(calls: DataFrame, known: DataFrame, by: str = "cumtime", limit: int = 20) -> DataFrame:
    if by not in ("cumtime", "ncalls", "tottime"):
        raise ValueError(f"by must be cumtime, ncalls or tottime, not {by!r}")
    return uncapped(calls.join(known.select(F.col("id").alias("node_id")), "node_id", "left_semi").orderBy(F.desc(by), "node_id"), limit)


def run_edges(dynamic: DataFrame, static: DataFrame, mode: str = "dynamic_only") -> DataFrame:
    """Calls seen only at run time, those that fired, or static ones that didn't though their caller ran."""
    keys = ["caller", "callee"]
    s = static.select(*keys).distinct()
    if mode == "dynamic_only":
        return dynamic.join(s, keys, "left_anti")
    if mode == "fired":
        return dynamic.join(s, keys, "left_semi")
    if mode == "dead":
        ran = dynamic.select("caller").unionByName(dynamic.select(F.col("callee").alias("caller"))).distinct()
        return s.join(ran, "caller", "left_semi").join(dynamic, keys, "left_anti")
    raise ValueError(f"mode must be dynamic_only, fired or dead, not {mode!r}")


def merge_calls(calls: DataFrame) -> DataFrame:
    """Runs of one node as one: counts and own time add up, cumulative time is the largest."""
    return calls.groupBy("node_id").agg(F.sum("ncalls").alias("ncalls"), F.round(F.sum("tottime"), 6).alias("tottime"), F.max("cumtime").alias("cumtime"))


def merge_missing(arcs: DataFrame) -> DataFrame:
    """(node_id, arc): arcs that every run covering the node missed."""
    runs = arcs.groupBy("node_id").agg(F.count_distinct("run").alias("runs"))
    return arcs.filter("arc is not null").groupBy("node_id", "arc").agg(F.count_distinct("run").alias("n")).join(runs, "node_id").filter("n = runs").select("node_id", "arc")


def exercisers(exercised: DataFrame, limit: int = 50) -> DataFrame:
    by = exercised.select("node_id", "test_id").distinct().groupBy("node_id").agg(F.count("*").alias("tests"), F.min("test_id").alias("first_test"))
    return uncapped(by.orderBy(F.desc("tests"), "node_id"), limit)


def branches(coverage: DataFrame, partial_only: bool = True) -> DataFrame:
    """Nodes with branches; partial ones have at least two, not all hit."""
    c = coverage.withColumn("missing", F.col("branches_total") - F.col("branches_hit"))
    return c.filter("branches_total >= 2 and branches_hit < branches_total") if partial_only else c.filter("branches_total > 0")


def depths(events: DataFrame) -> DataFrame:
    """(trace, event, ts, depth): how many frames are open when each begins.

    Events have trace, event, ts and dur.  In the order of begin and, of equals,
    the longer first, an event is nested in those that end after it begins.
    """

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ts", "dur", "event"], ascending=[True, False, True])
        ends: list[float] = []
        out = []
        for ts, dur in zip(group["ts"], group["dur"]):
            while ends and ends[-1] <= ts:
                ends.pop()
            out.append(len(ends))
            ends.append(ts + dur)
        return pd.DataFrame({"trace": group["trace"], "event": group["event"], "ts": group["ts"], "depth": out})

    return events.select("trace", "event", "ts", "dur").groupBy("trace").applyInPandas(walk, "trace bigint, event bigint, ts bigint, depth int")


def timeline(deep: DataFrame, key: str) -> DataFrame:
    return deep.groupBy(key).agg(F.min("ts").alias("first_ts"), F.count("*").alias("count"), F.min("depth").alias("min_depth"))


def ledger(exercised: DataFrame, known: DataFrame, contains: DataFrame) -> DataFrame:
    """(node_id, test_id): execution evidence of known nodes; a class has that of its methods."""
    e = exercised.select("node_id", "test_id").join(known.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    lifted = e.join(contains.select(F.col("target").alias("node_id"), F.col("source").alias("owner")), "node_id").select(F.col("owner").alias("node_id"), "test_id")
    return e.unionByName(lifted).distinct()


def profile_rows(stats: dict) -> Iterator[tuple]:
    """(file, line, function, ncalls, tottime, cumtime) of a decoded profile's stats."""
    for (path, line, name), (_, ncalls, tottime, cumtime, _) in stats.items():
        yield path, line, name, ncalls, tottime, cumtime
