"""Small literal graphs for operators that the star graph doesn't reach."""

import collections

import pytest
from pyspark.sql import functions as F
from strandline.functions import text
from strandline.graph import PropertyGraph
from strandline.operators import change, lookup, resolve, runtime, structure, traverse, verify
from strandline.plans import pattern
from strandline.sources import files
from strandline.streaming import journal


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(i, i.split(":")[1], i.split(":", 2)[2]) for i in nodes], "id string, type string, name string")
    e = spark.createDataFrame(edges, "source string, target string, type string")
    return PropertyGraph.of(n, e)


@pytest.fixture(scope="module")
def small(spark):
    f = "py:function:"
    return graph(spark, [f + x for x in ("m.a", "m.b", "m.c", "m.d", "m.lone")] + ["py:class:m.K"], [(f + "m.a", f + "m.b", "calls"), (f + "m.b", f + "m.c", "calls"), (f + "m.c", f + "m.a", "calls"), (f + "m.c", f + "m.d", "calls"), (f + "m.a", f + "m.b", "calls"), (f + "m.d", f + "m.d", "calls")])


def test_walks(small):
    f = "py:function:m."
    got = {r.id: r.depth for r in traverse.impact(small, f + "d", "upstream", -1).collect()}
    assert got == {f + "c": 1, f + "b": 2, f + "a": 3}
    assert [r.id for r in traverse.shortest_path(small, f + "a", f + "d").orderBy("hop").collect()] == [f + "a", f + "c", f + "d"]
    assert traverse.shortest_path(small, f + "a", f + "lone").count() == 0
    comp = {r.id: r.component for r in traverse.components(small).collect()}
    assert comp[f + "d"] == f + "a" and comp[f + "lone"] == f + "lone"
    assert {r.id: r.degree for r in small.degree().collect()}[f + "d"] == 3
    assert traverse.closure(small.typed("calls")).filter(F.col("id") == f + "d").count() == 0
    groups = {r.id: r.community for r in traverse.communities(small).collect()}
    assert groups[f + "lone"] == f + "lone"


def test_betweenness(spark):
    n = [f"a:x:{i}" for i in range(5)]
    g = graph(spark, n, [(n[i], n[i + 1], "calls") for i in range(4)])
    top = traverse.bridges(g, pivots=5, top_n=5).collect()
    assert top[0].id == n[2] and top[0].score == max(r.score for r in top)


def spread(near):
    """Labels of propagation run to its end."""
    before, label = None, sorted(near)
    while True:
        at = dict(zip(sorted(near), label))
        new = [max((sum(at[j] == c for j in near[i]), c) for c in (at[j] for j in near[i]))[1] for i in sorted(near)]
        before, label, old = label, new, before
        if new in (before, old):
            return dict(zip(sorted(near), new))


def test_communities_run_to_the_end(spark):
    n = [f"a:x:{i:02}" for i in range(14)]
    near = {n[i]: n[max(0, i - 1) : i] + n[i + 1 : i + 2] for i in range(14)}
    g = graph(spark, n, [(a, b, "calls") for a, b in zip(n, n[1:])])
    assert {r.id: r.community for r in traverse.communities(g).collect()} == spread(near)


def test_bridges_of_all_pivots(spark):
    n = [f"a:x:{i}" for i in range(10)]
    edges = [(n[0], n[i]) for i in range(1, 5)] + [(n[9], n[i]) for i in range(5, 9)] + [(n[0], n[9])]
    near = {i: [b for a, b in edges if a == i] + [a for a, b in edges if b == i] for i in n}
    label = spread(near)
    got = {r.id: r.score for r in traverse.bridges(graph(spark, n, [(a, b, "calls") for a, b in edges])).collect()}
    assert got == {i: round(52 / 72, 6) for i in (n[0], n[9]) if len({label[i], *(label[j] for j in near[i])}) > 1}


def test_processes(spark):
    f = "py:function:"
    g = graph(spark, [f + x for x in "abcd"], [(f + "a", f + "b", "calls"), (f + "b", f + "c", "calls"), (f + "b", f + "d", "calls"), (f + "c", f + "d", "calls")])
    assert [(r.length, r.path.replace(f, "")) for r in traverse.processes(g).collect()] == [(4, "a > b > c > d")]


def test_spans(spark):
    d = spark.createDataFrame([("foo", "f", 9, 20), ("bar", "f", 30, 40), ("K", "f", 45, 80), ("a", "f", 51, 55), ("b", "f", 57, 61)], "id string, file_path string, first_line int, end_line int")
    asked = {9: "foo", 10: "foo", 30: "bar", 51: "a", 53: "a", 56: "K", 57: "b", 22: "bar", 21: None, 90: None}
    got = {r.line: r.id for r in lookup.bind_lines(d, spark.createDataFrame([("f", k) for k in asked], "file_path string, line int")).collect()}
    assert got == asked


def test_verdicts(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    claims = df([("t_ran", "eq"), ("t_idle", "eq"), ("t_away", "eq"), ("t_ran", "bare")], "test string, equation string")
    impl = df([("eq", "f")], "equation string, code string")
    got = {(r.test, r.equation): r.verdict for r in verify.verdicts(claims, impl, df([("f", "t_ran")], "node_id string, test string"), df([("t_ran",), ("t_idle",)], "test string")).collect()}
    assert got == {("t_ran", "eq"): "corroborated", ("t_idle", "eq"): "refuted", ("t_away", "eq"): "out_of_capture", ("t_ran", "bare"): "no_implementation"}
    assert {r.verdict for r in verify.verdicts(claims, impl, df([], "node_id string, test string"), df([], "test string")).collect()} == {""}


def test_runs(spark):
    dyn = spark.createDataFrame([("A", "B", 8), ("A", "C", 4)], "caller string, callee string, count long")
    sta = spark.createDataFrame([("A", "B"), ("B", "D"), ("X", "Y")], "caller string, callee string")
    pairs = lambda mode: {(r.caller, r.callee) for r in runtime.run_edges(dyn, sta, mode).collect()}
    assert pairs("dynamic_only") == {("A", "C")} and pairs("fired") == {("A", "B")} and pairs("dead") == {("B", "D")}
    with pytest.raises(ValueError):
        pairs("all")
    arcs = spark.createDataFrame([("r1", "n", "1-2"), ("r2", "n", "1-2"), ("r1", "n", "2-3"), ("r2", "n", None)], "run string, node_id string, arc string")
    assert [r.arc for r in runtime.merge_missing(arcs).collect()] == ["1-2"]


def test_twins(spark):
    sets = {"alpha": range(40), "beta": range(40), "delta": range(5, 45), "gamma": range(100, 140)}
    s = spark.createDataFrame([(k, v) for k, r in sets.items() for v in r], "id string, shingle long")
    got = {(r.a, r.b): r.similarity for r in structure.twin_paths(s).collect()}
    assert got == {("alpha", "beta"): 1.0, ("alpha", "delta"): round(35 / 45, 4), ("beta", "delta"): round(35 / 45, 4)}
    assert ("alpha", "beta") not in {(r.a, r.b) for r in structure.twin_paths(s, spark.createDataFrame([("beta", "alpha")], "source string, target string")).collect()}


def test_resolution_is_order_free(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "__init__.py").write_text("")
    (tmp_path / "pkg" / "core.py").write_text("import os\nfrom typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    from pkg import other\nclass Base:\n    def run(self):\n        return self.step()\n    def step(self):\n        return os.getcwd()\nclass Child(Base):\n    x = 1\n")
    (tmp_path / "pkg" / "test_core.py").write_text("import pytest\nfrom pkg.core import Child\n@pytest.mark.verifies('eq-one')\n@pytest.mark.l1\ndef test_it():\n    Child().run()\n")
    g = files.analyze_directory(spark, str(tmp_path))
    edges = {(r.source, r.target, r.type) for r in g.edges.collect()}
    assert ("py:method:pkg.core.Base.run", "py:method:pkg.core.Base.step", "calls") in edges
    assert ("py:class:pkg.core.Child", "py:class:pkg.core.Base", "inherits") in edges
    assert ("py:function:pkg.test_core.test_it", "py:class:pkg.core.Child", "calls") in edges
    test = g.nodes.filter("is_test").first()
    assert test.verifies == ["eq-one"] and test.vv_level == "L1" and test.decorator_lineno == 3
    assert g.edges.filter("type_checking").count() == 1
    assert resolve.marker_edges(PropertyGraph(g.nodes.unionByName(graph(spark, ["math:equation:eq-one"], [("a", "b", "x")]).nodes), g.edges), "verifies", "tests", "math:equation:").count() == 1
    files.write_sqlite(g, str(tmp_path / "g.db"))
    back = files.read_sqlite(spark, str(tmp_path / "g.db"))
    assert {r.id for r in back.nodes.collect()} == {r.id for r in g.nodes.collect()}
    assert collections.Counter((r.source, r.target, r.type) for r in back.edges.collect()) == collections.Counter((r.source, r.target, r.type) for r in g.edges.collect())
    files.write_parquet(g, f"file://{tmp_path}/g")
    assert files.read_parquet(spark, f"file://{tmp_path}/g").nodes.count() == g.nodes.count()


def test_merge_and_chase(spark):
    a, b = graph(spark, ["py:function:m.f", "py:file:x"], [("a", "b", "references")]), graph(spark, ["py:function:m.f"], [("c", "d", "calls")])
    m = resolve.merge_graphs(a, b)
    assert m.nodes.count() == 2 and m.edges.count() == 2
    got = {r.public: r.defining for r in resolve.chase(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "public string, defining string")).collect()}
    assert got["a"] == "c" and got["b"] == "c"


def test_pattern(small):
    assert pattern.parse("function -calls-> * WHERE name=m.a*") == ("function", "calls", "*", "name", "m.a*")
    assert pattern.parse("a -> b") == ("a", "*", "b", None, None)
    with pytest.raises(ValueError):
        pattern.parse("nonsense")
    assert pattern.graph_query(small, "FUNCTION -calls-> * where name=m.a", 0).count() == 3


def test_small_parts(spark, small, tmp_path):
    row = spark.createDataFrame([("see <~m.f>", "!x", "a.b.c")], "t string, n string, d string").select(text.role_target(F.col("t")).alias("t"), text.role_target(F.col("n")).alias("n"), text.module_of(F.col("d")).alias("m"), text.under(F.lit("a/bc"), "a/b").alias("u")).first()
    assert tuple(row) == ("m.f", None, "a.b", False)
    assert change.rename(small, "lone", "sole").first().after == "m.sole"
    assert lookup.search(small, "").count() == 0
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"ts":"2024-01-01T00:00:00","tool":"q","ok":true,"ms":2}\n{"ts":"2024-01-01T00:01:00","tool":"q","ok":false,"ms":4}\n')
    q = journal.usage(journal.read(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("usage").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.tool, r.calls, r.failed, r.ms) for r in spark.table("usage").collect()] == [("q", 2, 1, 3.0)]


def test_empty(spark):
    g = graph(spark, ["a:x:y"], [("a:x:y", "a:x:y", "calls")])
    empty = PropertyGraph(g.nodes.limit(0), g.edges.limit(0))
    for f in (lookup.stats, traverse.components, structure.dead_functions, verify.coverage, lambda h: lookup.context(h, "q"), lambda h: traverse.impact(h, "q")):
        f(empty).collect()
