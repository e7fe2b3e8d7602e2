"""Steps whose tables must not outgrow their input."""

import os
import random

import pytest
from pyspark.sql import functions as F
from strandline.graph import PropertyGraph
from strandline.operators import change, lookup, structure, traverse, verify


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(i, i.split(":")[1], i.split(":", 2)[2]) for i in nodes], "id string, type string, name string")
    return PropertyGraph.of(n, spark.createDataFrame(edges, "source string, target string, type string"))


def counted(monkeypatch, module):
    """Rows of each table that ``module`` writes from now on."""
    rows, cut = [], module.cut

    def write(df):
        t = cut(df)
        rows.append(t.count())
        return t

    monkeypatch.setattr(module, "cut", write)
    return rows


def test_conformers_propose_few(spark, monkeypatch):
    rows = counted(monkeypatch, structure)
    cls = {f"c{i}": {f"m{i % 10}", f"n{i % 9}", f"k{i % 7}"} for i in range(300)}
    cls["all"] = {"m1", "n1", "k1", "z"}
    nodes = [f"py:class:{c}" for c in cls] + [f"py:method:{c}.{m}" for c, s in cls.items() for m in s]
    g = graph(spark, nodes, [(f"py:class:{c}", f"py:method:{c}.{m}", "contains") for c, s in cls.items() for m in s])
    got = {(r.protocol[9:], r.conformer[9:], r.methods) for r in structure.protocol_conformers(g).collect()}
    assert got == {(a, b, len(cls[a])) for a in cls for b in cls if a != b and cls[a] <= cls[b]}
    assert len(rows) == 2 and rows[0] == sum(map(len, cls.values())) and rows[1] < 1500


@pytest.mark.parametrize("chunk", (0, 2_000_000))
def test_components_of_a_long_path(spark, monkeypatch, chunk):
    monkeypatch.setattr(traverse, "CHUNK", chunk)
    rows = counted(monkeypatch, traverse)
    n = [f"a:x:{i}" for i in random.Random(1).sample(range(10_000), 400)]
    g = graph(spark, n[:-1], [(a, b, "calls") for a, b in zip(n, n[1:]) if a != n[199]] + [(n[5], n[5], "calls")])
    g = PropertyGraph(g.nodes, g.edges.repartition(8, F.rand(1)))
    got = {r.id: r.component for r in traverse.components(g).collect()}
    assert got == {i: min(half) for half in (n[:200], n[200:]) for i in half if i != n[-1]}
    assert len(rows) < 12


def test_id_grammar_sorts_one_range(spark, monkeypatch):
    rows = counted(monkeypatch, lookup)
    n = [f"a:x:{i:03}" for i in range(301)] + ["a:y:0", "a:z:1", "a:z:2"]
    edges = [(n[0], i, "calls") for i in n[5:]] + [(n[1], n[2], "calls")]
    g = graph(spark, n, edges)
    degree = {i: sum((a == i) + (b == i) for a, b, _ in edges) for i in n}
    kinds = {}
    for i in sorted(n, key=lambda i: (degree[i], i)):
        kinds.setdefault(i[:3], []).append(i)
    assert {r.example: r.n for r in lookup.id_grammar(g).collect()} == {k[len(k) // 2]: len(k) for k in kinds.values()}
    assert len(rows) == 2 and rows[1] == sum(degree[i] == degree[k[len(k) // 2]] for k in kinds.values() for i in k)


def test_rare_keys_are_grouped_after_the_shuffle(spark):
    g = graph(spark, ["a:x:0"], [("a:x:0", f"a:x:{i}", "calls") for i in range(9)])
    for t in (g.degree(), traverse.arcs(g.edges, "both")):
        assert "REPARTITION_BY_NUM" in t._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in traverse.steps(g.edges, "both")._jdf.queryExecution().executedPlan().toString()


def test_hot_nodes_count_degrees_once(spark, monkeypatch):
    rows = counted(monkeypatch, lookup)
    n = [f"a:x:{i}" for i in range(8)]
    g = graph(spark, n, [(a, b, "calls") for k, a in enumerate(n) for b in n[k + 1 : 7]])
    assert [r.id for r in change.hot_nodes(g, g.nodes, 3, 2).collect()] == n[2:5] and rows == [8]


def test_no_walk_for_equations_with_declared_tests(spark, monkeypatch):
    rows = counted(monkeypatch, traverse)
    n = ["a:function:f", "a:function:g", "a:function:t", "m:equation:1", "m:equation:2"]
    g = graph(spark, n, [(n[0], n[3], "implements"), (n[2], n[3], "tests"), (n[2], n[0], "calls"), (n[1], n[0], "calls")])
    g = PropertyGraph(g.nodes.withColumn("is_test", F.col("name") == "t"), g.edges)
    assert [(r.equation, r.test, r.tier) for r in verify.evidence(g).collect()] == [(n[3], n[2], "declared")] and rows == [0]
    assert {r.key: r.n for r in verify.summary(g, spark.createDataFrame([(n[1], n[2])], "node_id string, test_id string")).collect()} == {"verified": 1, "documented": 1, "orphan_code": 1, "tested": 1, "claims_refuted": 1, "executed_unclaimed": 1}


def test_twins_propose_by_rare_shingles(spark, monkeypatch):
    rows = counted(monkeypatch, structure)
    r = random.Random(2)
    sets = {i: set(r.sample(range(300), 20)) for i in range(60)}
    sets |= {100 + i: (sets[i] - {min(sets[i])}) | {1000 + i} for i in range(20)}
    s = spark.createDataFrame([(i, f"s{x}") for i, own in sets.items() for x in own], "id long, shingle string")
    for least in (0.7, 0.25):
        want = {(a, b): round(len(x & y) / len(x | y), 4) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y)}
        assert {(p.a, p.b): p.similarity for p in structure.twin_paths(s, min_similarity=least).collect()} == {k: v for k, v in want.items() if v >= least}
    assert rows[2] < len(want) / 4


def test_shortest_path_leaves_the_last_round_out(spark, monkeypatch):
    rows = counted(monkeypatch, traverse)
    n = [f"a:x:{i}" for i in range(40)]
    g = graph(spark, n, [(n[0], n[1], "calls"), (n[0], n[2], "calls"), (n[3], n[1], "calls"), (n[3], n[2], "uses")] + [(n[1], i, "calls") for i in n[4:]] + [(n[1], n[0], "a")])
    path = traverse.shortest_path(g, n[0], n[3])
    assert [r.id for r in path.orderBy("hop").collect()] == [n[0], n[1], n[3]] and 36 not in rows
    assert [tuple(r)[1:] for r in traverse.path_edges(g, path).orderBy("hop").collect()] == [(n[0], n[1], "calls"), (n[3], n[1], "calls")]
    assert [r.id for r in traverse.shortest_path(g, n[0], n[0]).collect()] == [n[0]] and traverse.shortest_path(g, n[0], "a:x:none").count() == 0


def test_communities_keep_one_round(spark, monkeypatch):
    kept, cut = [], traverse.cut

    def write(df):
        kept.append(cut(df))
        return kept[-1]

    monkeypatch.setattr(traverse, "cut", write)
    n = [f"a:x:{i:02}" for i in range(14)]
    traverse.communities(graph(spark, n, [(a, b, "calls") for a, b in zip(n, n[1:])])).collect()
    there = [os.path.exists(t.inputFiles()[0].removeprefix("file://")) for t in kept]
    assert len(kept) > 3 and there == [True] + [False] * (len(kept) - 2) + [True]
