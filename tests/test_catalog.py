"""Every registered graph query against its SQL, and those without SQL against brute force."""

import importlib.util

import pytest
from oracle import SF_DIR, differences
from pyspark.sql import functions as F
from strandline import catalog
from strandline.sources import star


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, name):
    names, left, right, (n, m) = differences(spark, catalog.queries()[name], catalog.oracle_sql()[name])
    assert names and not left and not right and n == m


def test_entry_imports():
    spec = importlib.util.find_spec("__spark_entry__")
    import __spark_entry__ as entry

    assert spec and set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_depths(spark):
    rows = star.table(spark, SF_DIR, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), (F.floor(F.col("value") * 1000) * 100000).cast("bigint").alias("dur")).collect()
    got = {r.event: r.depth for r in catalog.queries()["trace_depth"](spark, SF_DIR).collect()}
    by = {}
    for r in rows:
        by.setdefault(r.user_id, []).append(r)
    for mine in by.values():
        stack = []
        for r in sorted(mine, key=lambda r: (r.ts, -r.dur, r.event_id)):
            while stack and stack[-1] <= r.ts:
                stack.pop()
            assert got[r.event_id] == len(stack)
            stack.append(r.ts + r.dur)
    assert len(got) == len(rows)
