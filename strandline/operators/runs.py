"""Runs: records of a profile, a coverage report, a collection or a trace bound to nodes, and what is kept of them.

A run is a set of families, each a table with a column ``run``: calls, edges,
coverage, timeline, markers and exercised, and the ledger of the binding.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandline.functions.text import absolute, under
from strandline.graph import PropertyGraph, spread
from strandline.operators.lookup import bind_lines, uncapped

#: What each family is made from.
KINDS = {
    "calls": ("cprofile",), "edges": ("cprofile",), "coverage": ("coverage",),
    "timeline": ("viztracer",), "markers": ("pytest",), "exercised": ("coverage",),
}
EXECUTABLE = ("function", "method")


@dataclass(frozen=True)
class Run:
    """A run's families; a family that it doesn't have is None."""

    name: str
    kind: str
    calls: DataFrame | None = None
    edges: DataFrame | None = None
    coverage: DataFrame | None = None
    timeline: DataFrame | None = None
    markers: DataFrame | None = None
    exercised: DataFrame | None = None
    ledger: DataFrame | None = None
    meta: dict = field(default_factory=dict)

    def families(self) -> list[str]:
        """The families that have a row."""
        return [f for f in KINDS if (t := getattr(self, f)) is not None and not t.isEmpty()]


def definitions(g: PropertyGraph, executable: bool = False) -> DataFrame:
    """(id, file_path, first_line, def_line, end_line) of the nodes with a place; decorators belong to the extent."""
    n = g.nodes.filter("file_path is not null and lineno is not null")
    n = n.filter(F.col("type").isin(*EXECUTABLE)) if executable else n.filter("type <> 'module'")
    first = F.coalesce("decorator_lineno", "lineno")
    return n.select("id", "file_path", first.alias("first_line"), F.col("lineno").alias("def_line"), F.coalesce("end_lineno", "lineno").alias("end_line"))


def in_scope(path: Column, prefixes: list[str]) -> Column:
    """Whether a path lies under one of the prefixes, by whole components; without any, all do."""
    hit = F.lit(not prefixes)
    for p in prefixes:
        hit = hit | under(path, p)
    return hit


def bind(records: DataFrame, defs: DataFrame, prefixes: list[str] | None = None, root: str = "") -> DataFrame:
    """``records`` (file, line, ...) with ``id`` and ``outcome``.

    The first reason that holds: outside_scope, unindexed_file (no definition is
    in it), no_enclosing_node; else bound.  Relative files are taken from ``root``.
    """
    r = records.withColumn("file", absolute(F.col("file").cast("string"), root))
    d = defs.withColumn("file_path", F.col("file_path").cast("string"))
    scoped = in_scope(F.col("file"), prefixes or [])
    places = bind_lines(d, r.filter(scoped).select(F.col("file").alias("file_path"), "line"))
    known = d.select(F.col("file_path").alias("__known")).distinct()
    places = places.select(F.col("file_path").alias("__file"), F.col("line").alias("__line"), "id")
    t = r.join(places, (F.col("file") == F.col("__file")) & (F.col("line") == F.col("__line")), "left")
    t = t.join(known, F.col("file") == F.col("__known"), "left")
    outcome = F.when(~scoped, "outside_scope").when(F.col("__known").isNull(), "unindexed_file").when(F.col("id").isNull(), "no_enclosing_node").otherwise("bound")
    return t.withColumn("outcome", outcome).drop("__file", "__line", "__known")


def ledger_of(bound: DataFrame) -> DataFrame:
    """(outcome, records): what became of the records."""
    return bound.groupBy("outcome").agg(F.count("*").alias("records"))


def diagnosis(ledger: DataFrame) -> str:
    """Why nothing was bound, in a sentence; empty if something was."""
    n = {r["outcome"]: r["records"] for r in ledger.collect()}  # four rows at most
    if n.get("bound"):
        return ""
    if not sum(n.values()):
        return "the artifact has no records"
    if n.get("unindexed_file") and not n.get("outside_scope"):
        return "no file of the artifact is in the graph: give the folder that its paths are relative to"
    if n.get("outside_scope") and not n.get("unindexed_file"):
        return "every record lies outside the prefixes; several may be given"
    if n.get("no_enclosing_node"):
        return "no record lies inside a definition: is the graph that of the traced sources?"
    return "no record was bound, for several reasons"


def overlay_profile(name: str, records: DataFrame, callers: DataFrame, defs: DataFrame, prefixes: list[str] | None = None, root: str = "") -> Run:
    """A profile's records (file, line, ncalls, tottime, cumtime) and callers (file, line, caller_file, caller_line, count).

    Counts and own time of a node's records add up; of cumulative times, which
    nest, the largest stays.  Callers that aren't bound, and a node's calls of
    itself, make no edge.
    """
    b = bind(records, defs, prefixes, root)
    calls = b.filter("id is not null").groupBy(F.col("id").alias("node_id")).agg(F.sum("ncalls").alias("ncalls"), F.sum("tottime").alias("tottime"), F.max("cumtime").alias("cumtime"))
    callee = bind(callers, defs, prefixes, root).select(F.col("id").alias("callee"), F.col("caller_file").alias("file"), F.col("caller_line").alias("line"), "count")
    both = bind(callee.filter("callee is not null"), defs, prefixes, root).select(F.col("id").alias("caller"), "callee", "count")
    edges = both.filter("caller is not null and caller <> callee").groupBy("caller", "callee").agg(F.sum("count").alias("count"))
    return _named(Run(name, "cprofile", calls=calls, edges=edges, ledger=ledger_of(b)))


def test_name(context: Column) -> Column:
    """The dotted name of a coverage context: phase and parameters fall away, ``a/b.py::C::t`` is a.b.C.t."""
    bare = F.substring_index(context, "|", 1)
    file, rest = F.regexp_extract(bare, r"^([^:]+)\.py::(.+)$", 1), F.regexp_extract(bare, r"^([^:]+)\.py::(.+)$", 2)
    dotted = F.concat(F.replace(file, F.lit("/"), F.lit(".")), F.lit("."), F.replace(rest, F.lit("::"), F.lit(".")))
    return F.substring_index(F.when(file != "", dotted).otherwise(bare), "[", 1)


def bind_contexts(contexts: DataFrame, known: DataFrame) -> DataFrame:
    """(context, test): the method, else the function, that a context names; null if the graph has neither."""
    c = contexts.select("context").filter("context <> ''").distinct().withColumn("__name", test_name(F.col("context")))
    tries = c.select("context", F.posexplode(F.array(*(F.concat(F.lit(f"py:{t}:"), "__name") for t in ("method", "function")))).alias("place", "id"))
    hit = tries.join(known.select("id").distinct(), "id", "left_semi").groupBy("context").agg(F.min_by("id", "place").alias("test"))
    return c.select("context").join(hit, "context", "left")


def overlay_coverage(name: str, lines: DataFrame, arcs: DataFrame, contexts: DataFrame, defs: DataFrame, known: DataFrame, prefixes: list[str] | None = None, root: str = "") -> Run:
    """A coverage report's lines (file, line, hit), arcs (file, from, to, hit) and contexts (file, line, context).

    Lines and arcs belong to every definition whose body holds them, so nested
    ones count in both; decorators don't belong to a body.
    """
    scoped = lambda df: df.withColumn("file", absolute(F.col("file").cast("string"), root)).filter(in_scope(F.col("file"), prefixes or []))
    d = spread(defs.select(F.col("id").alias("node_id"), F.col("file_path").cast("string").alias("file"), "def_line", "end_line"), "file")

    def inside(df: DataFrame, line: str) -> DataFrame:
        """The distinct rows with the definitions that hold them: one shuffle by file serves both."""
        return spread(df, "file").distinct().join(d, "file").filter(F.col(line).between(F.col("def_line"), F.col("end_line")))

    by_line = inside(scoped(lines).select("file", "line", "hit"), "line").groupBy("node_id").agg(F.count_if("hit").alias("lines_hit"), F.count("*").alias("lines_total"))
    arc = F.struct(F.col("from").cast("int").alias("from"), F.col("to").cast("int").alias("to"))
    by_arc = inside(scoped(arcs).select("file", "from", "to", "hit"), "from").groupBy("node_id").agg(
        F.count_if("hit").alias("branches_hit"), F.count("*").alias("branches_total"), F.array_sort(F.collect_list(F.when(~F.col("hit"), arc))).alias("missing_arcs")
    )
    counts = {c: 0 for c in ("lines_hit", "lines_total", "branches_hit", "branches_total")}
    no_arcs = F.array().cast("array<struct<from:int,to:int>>")
    coverage = by_line.join(by_arc, "node_id", "full_outer").fillna(counts).withColumn("missing_arcs", F.coalesce("missing_arcs", no_arcs))
    tests = bind_contexts(contexts, known)
    exercised = inside(scoped(contexts).select("file", "line", "context"), "line").select("node_id", "context").distinct().join(tests.filter("test is not null"), "context").select("node_id", F.col("test").alias("test_id")).distinct()
    files = d.select(F.col("file").alias("__known")).distinct()
    seen = lines.select("file").distinct().withColumn("file", absolute(F.col("file").cast("string"), root)).join(files, F.col("file") == F.col("__known"), "left")
    outcome = F.when(~in_scope(F.col("file"), prefixes or []), "outside_scope").when(F.col("__known").isNull(), "unindexed_file").otherwise("bound")
    unknown = tests.filter("test is null").select(F.lit("unknown_context").alias("outcome"))
    return _named(Run(name, "coverage", coverage=coverage, exercised=exercised, ledger=ledger_of(seen.select(outcome.alias("outcome")).unionByName(unknown))))


def overlay_tests(name: str, tests: DataFrame, defs: DataFrame, prefixes: list[str] | None = None, root: str = "") -> Run:
    """A collection's tests (seq, nodeid, file, line, markers map<string,string>).

    Parameters make several tests of one node: markers unite, of one name the
    first counts; ids stay in order.
    """
    b = bind(tests.filter("file is not null and line > 0"), defs, prefixes, root)
    hit = b.filter("id is not null").withColumnRenamed("id", "node_id")
    marks = hit.select("node_id", "seq", F.explode(F.coalesce("markers", F.create_map().cast("map<string,string>"))).alias("k", "v"))
    marks = marks.groupBy("node_id", "k").agg(F.min_by("v", "seq").alias("v")).groupBy("node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("markers"))
    first = hit.filter("nodeid is not null").groupBy("node_id", "nodeid").agg(F.min("seq").alias("seq"))
    ids = first.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "nodeid"))), lambda x: x["nodeid"]).alias("pytest_ids"))
    none = F.create_map().cast("map<string,string>")
    rows = hit.select("node_id").distinct().join(marks, "node_id", "left").join(ids, "node_id", "left")
    rows = rows.select("node_id", F.coalesce("markers", none).alias("markers"), F.coalesce("pytest_ids", F.array().cast("array<string>")).alias("pytest_ids"))
    return _named(Run(name, "pytest", markers=rows, ledger=ledger_of(b)))


def overlay_trace(name: str, deep: DataFrame, defs: DataFrame, prefixes: list[str] | None = None, root: str = "") -> Run:
    """A trace's events (file, line, ts, depth), the depth as ``runtime.depths`` finds it."""
    b = bind(deep, defs, prefixes, root)
    rows = b.filter("id is not null").groupBy(F.col("id").alias("node_id")).agg(F.min("ts").alias("first_ts"), F.count("*").alias("count"), F.min("depth").alias("min_depth"))
    return _named(Run(name, "viztracer", timeline=rows, ledger=ledger_of(b)))


def _named(run: Run) -> Run:
    tables = {f.name: t.withColumn("run", F.lit(run.name)) for f in fields(run) if isinstance(t := getattr(run, f.name), DataFrame)}
    return Run(run.name, run.kind, meta=run.meta, **tables)


def merge_runs(runs: list[Run], name: str) -> Run:
    """Several runs as one; a single run as it is.

    Call counts and own times add up, cumulative times are the largest, edges add
    up; of a node's missing arcs those stay that every run covering it missed, and
    its hits are the rest; who exercised what is united.  Timelines and markers
    aren't merged: order and claims of different runs don't add up.
    """
    if len(runs) == 1:
        return runs[0]

    def united(family: str) -> DataFrame | None:
        found = [t for r in runs if (t := getattr(r, family)) is not None]
        out = found[0] if found else None
        for t in found[1:]:
            out = out.unionByName(t)
        return out

    out: dict[str, DataFrame] = {}
    if (t := united("calls")) is not None:
        out["calls"] = t.groupBy("node_id").agg(F.sum("ncalls").alias("ncalls"), F.round(F.sum("tottime"), 6).alias("tottime"), F.max("cumtime").alias("cumtime"))
    if (t := united("edges")) is not None:
        out["edges"] = t.groupBy("caller", "callee").agg(F.sum("count").alias("count"))
    if (t := united("coverage")) is not None:
        out["coverage"] = merge_coverage(t)
    if (t := united("exercised")) is not None:
        out["exercised"] = t.select("node_id", "test_id").distinct()
    return _named(Run(name, "merged", meta={"runs": [r.name for r in runs]}, **out))


def merge_coverage(coverage: DataFrame) -> DataFrame:
    """Coverage of several runs (run, node_id, ...) as one row a node."""
    by = coverage.groupBy("node_id").agg(F.count_distinct("run").alias("runs"), F.max("lines_hit").alias("lines_hit"), F.max("lines_total").alias("lines_total"), F.max("branches_total").alias("branches_total"))
    arcs = coverage.select("run", "node_id", F.explode("missing_arcs").alias("arc")).distinct().groupBy("node_id", "arc").agg(F.count("*").alias("n"))
    missed = arcs.join(by.select("node_id", "runs"), "node_id").filter("n = runs").groupBy("node_id").agg(F.array_sort(F.collect_list("arc")).alias("missing_arcs"))
    t = by.join(missed, "node_id", "left").withColumn("missing_arcs", F.coalesce("missing_arcs", F.array().cast("array<struct<from:int,to:int>>")))
    hit = F.greatest(F.col("branches_total") - F.size("missing_arcs"), F.lit(0)).cast("long")
    return t.select("node_id", "lines_hit", "lines_total", hit.alias("branches_hit"), "branches_total", "missing_arcs")


def require_family(run: Run, family: str, others: list[Run] | None = None) -> DataFrame:
    """The family's table; a run without it is an error, since an empty answer would say something else."""
    if family not in KINDS:
        raise ValueError(f"family must be one of {', '.join(KINDS)}, not {family!r}")
    t = getattr(run, family)
    if t is None or t.isEmpty():
        have = [r.name for r in others or [] if family in r.families()]
        raise ValueError(f"run {run.name!r} ({run.kind}) has no {family}, which {' or '.join(KINDS[family])} gives; runs that have it: {', '.join(have) or 'none'}")
    return t


def write_run(run: Run, path: str) -> None:
    """Store a run under ``path``, a folder for each family and run; one of that name is replaced."""
    spark = next(t for f in fields(run) if isinstance(t := getattr(run, f.name), DataFrame)).sparkSession
    delete_run(spark, path, run.name)
    for f in (*KINDS, "ledger"):
        if (t := getattr(run, f)) is not None:
            t.drop("run").write.mode("overwrite").parquet(f"{path}/{f}/run={run.name}")
    rows = [(run.kind, sorted((k, str(v)) for k, v in run.meta.items()))]
    spark.createDataFrame(rows, "kind string, meta array<struct<k:string,v:string>>").coalesce(1).write.mode("overwrite").parquet(f"{path}/about/run={run.name}")


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete_run(spark: SparkSession, path: str, name: str) -> bool:
    """Remove a run; whether there was one."""
    hit = False
    for f in (*KINDS, "ledger", "about"):
        files, p = _folder(spark, f"{path}/{f}/run={name}")
        hit = files.delete(p, True) or hit
    return hit


def load_run(spark: SparkSession, path: str, name: str) -> Run | None:
    """A stored run; None if there is none of that name."""
    files, about = _folder(spark, f"{path}/about/run={name}")
    if not files.exists(about):
        return None
    tables = {}
    for f in (*KINDS, "ledger"):
        files, p = _folder(spark, f"{path}/{f}/run={name}")
        if files.exists(p):
            tables[f] = spark.read.parquet(f"{path}/{f}/run={name}").withColumn("run", F.lit(name))
    row = spark.read.parquet(f"{path}/about/run={name}").first()
    return Run(name, row["kind"], meta={x["k"]: x["v"] for x in row["meta"]}, **tables)


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run, family, rows) of the stored runs; ``about`` has one row for each."""
    out = spark.createDataFrame([], "run string, family string, rows bigint")
    for f in (*KINDS, "about"):
        files, p = _folder(spark, f"{path}/{f}")
        if files.exists(p):
            rows = spark.read.option("basePath", f"{path}/{f}").parquet(f"{path}/{f}").groupBy(F.col("run").cast("string").alias("run")).agg(F.count("*").alias("rows"))
            out = out.unionByName(rows.select("run", F.lit(f).alias("family"), "rows"))
    return out


# questions about runs; ids that the graph no longer has are left out


def _known(t: DataFrame, g: PropertyGraph, node: str = "", column: str = "node_id") -> DataFrame:
    t = t.join(g.nodes.select(F.col("id").alias(column)), column, "left_semi")
    return t.filter(F.contains(F.col(column), F.lit(node))) if node else t


def accessors(g: PropertyGraph, span: int = 2) -> DataFrame:
    """(id) of properties and of definitions of at most ``span`` + 1 lines."""
    prop = F.exists(F.coalesce("decorators", F.array().cast("array<string>")), lambda d: F.contains(d, F.lit("property")))
    return g.nodes.filter(prop | (F.col("end_lineno") - F.col("lineno") <= span)).select("id")


def edges(g: PropertyGraph, dynamic: DataFrame, calls: DataFrame | None = None, mode: str = "dynamic_only", node: str = "", substantive_only: bool = False, limit: int = 50) -> DataFrame:
    """(caller, callee, count, in_static, accessor) of a run's edges against the static calls.

    dynamic_only: fired without a static call; fired: with one; dead: static calls
    between nodes that the run reached, which didn't fire.
    """
    if mode not in ("dynamic_only", "fired", "dead"):
        raise ValueError(f"mode must be dynamic_only, fired or dead, not {mode!r}")
    keys = ["caller", "callee"]
    static = g.typed("calls").select(F.col("source").alias("caller"), F.col("target").alias("callee")).distinct()
    fired = dynamic.groupBy(*keys).agg(F.sum("count").alias("count"))
    if mode == "dead":
        ran = dynamic.select(F.explode(F.array(*keys)).alias("id"))
        ran = (ran.unionByName(calls.select(F.col("node_id").alias("id"))) if calls is not None else ran).distinct()
        found = static.join(ran.withColumnRenamed("id", "caller"), "caller", "left_semi").join(ran.withColumnRenamed("id", "callee"), "callee", "left_semi")
        found = found.join(fired, keys, "left_anti").withColumn("count", F.lit(0).cast("long"))
    else:
        found = _known(_known(fired, g, "", "caller"), g, "", "callee").join(static, keys, "left_semi" if mode == "fired" else "left_anti")
    small = accessors(g).withColumn("small", F.lit(True))
    for end in keys:
        found = found.join(small.select(F.col("id").alias(end), F.col("small").alias(f"__{end}")), end, "left")
    found = found.withColumn("accessor", F.coalesce(F.col("__caller") | F.col("__callee"), F.col("__caller"), F.col("__callee"), F.lit(False)))
    found = found.filter(F.contains("caller", F.lit(node))) if node else found
    found = found.filter("not accessor") if substantive_only else found
    found = found.select(*keys, "count", F.lit(mode != "dynamic_only").alias("in_static"), "accessor")
    return uncapped(found.orderBy(F.desc("count"), *keys), limit)


def markers(g: PropertyGraph, marks: DataFrame, marker: str = "", node: str = "", limit: int = 50) -> DataFrame:
    """(node_id, markers, n_markers, invocation) of tests, the most marked first; the invocation runs them."""
    t = _known(marks, g, node)
    t = t.filter(F.map_contains_key("markers", F.lit(marker))) if marker else t
    n = F.size(F.map_keys("markers"))
    names = F.array_join(F.array_sort(F.map_keys("markers")), ",")
    t = t.select("node_id", names.alias("markers"), n.alias("n_markers"), F.concat(F.lit("pytest "), F.array_join("pytest_ids", " ")).alias("invocation"))
    return uncapped(t.orderBy(F.desc("n_markers"), "node_id"), limit)


def branches(g: PropertyGraph, coverage: DataFrame, node: str = "", partial_only: bool = True, limit: int = 50) -> DataFrame:
    """(node_id, lines_hit, lines_total, branches_hit, branches_total, discriminates): those that branch on a tag first, then the most missed."""
    t = _known(coverage, g, node)
    t = t.filter("branches_total >= 2 and branches_hit < branches_total") if partial_only else t
    tags = g.typed("discriminates_on").join(g.nodes.select(F.col("id").alias("target"), "name"), "target", "left")
    tags = tags.groupBy(F.col("source").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("name", "target"))), ",").alias("discriminates"))
    t = t.join(tags, "node_id", "left").withColumn("discriminates", F.coalesce("discriminates", F.lit("")))
    t = t.select("node_id", "lines_hit", "lines_total", "branches_hit", "branches_total", "discriminates")
    return uncapped(t.orderBy(F.desc(F.col("discriminates") != ""), F.desc(F.col("branches_total") - F.col("branches_hit")), "node_id"), limit)


def timeline(g: PropertyGraph, rows: DataFrame, max_depth: int = -1, limit: int = 50) -> DataFrame:
    """(node_id, first_ts, count, min_depth) in the order of first entry; those deeper than ``max_depth`` (0 or more) are left out."""
    t = _known(rows, g).select("node_id", "first_ts", "count", "min_depth")
    t = t.filter(F.col("min_depth") <= max_depth) if max_depth >= 0 else t
    return uncapped(t.orderBy("first_ts", "node_id"), limit)


def exercisers(g: PropertyGraph, exercised: DataFrame, node: str = "", limit: int = 50) -> DataFrame:
    """(node_id, tests, first_test): how many known tests ran a node."""
    t = _known(exercised.select("node_id", "test_id").distinct(), g, node)
    tests = t.join(g.nodes.select(F.col("id").alias("test_id")), "test_id", "left_semi")
    by = tests.groupBy("node_id").agg(F.count("*").alias("tests"), F.min("test_id").alias("first_test"))
    by = t.select("node_id").distinct().join(by, "node_id", "left").fillna(0, ["tests"])
    return uncapped(by.orderBy(F.desc("tests"), "node_id"), limit)
