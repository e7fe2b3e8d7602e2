"""Registered queries on runs, evidence and names, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.catalog import CUSTOMER, PART, graph_of, plain, register
from strandline.graph import PropertyGraph, cut, shared_dir
from strandline.operators import change, lookup, names, runs, structure, traverse, verify
from strandline.operators.runs import Run
from strandline.sources import star

_DAY = "datediff('day', DATE '1970-01-01', {}::DATE)"
_SOLD = f"""s AS (SELECT o_orderkey AS o, o_custkey AS f, {_DAY.format('o_orderdate')} AS ordered, {_DAY.format('l_shipdate')} AS line, l_linenumber AS k, l_returnflag AS rf, l_linestatus AS ls, l_quantity AS q, l_extendedprice AS x
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
d AS (SELECT o_orderkey AS id, o_custkey AS f, {_DAY.format('o_orderdate')} AS a FROM orders)"""
_BOUND = """asked AS (SELECT DISTINCT f, line FROM s UNION SELECT DISTINCT f, ordered FROM s),
i AS (SELECT a.f, a.line, arg_min(d.id, (-d.a) * 1000000000 + d.id) AS id FROM asked a JOIN d ON d.f = a.f AND a.line BETWEEN d.a AND d.a + 30 GROUP BY ALL),
n AS (SELECT a.f, a.line, arg_min(d.id, d.a * 1000000000 + d.id) AS id FROM asked a JOIN d ON d.f = a.f AND d.a BETWEEN a.line + 1 AND a.line + 8 GROUP BY ALL),
b AS (SELECT a.f, a.line, coalesce(i.id, n.id) AS id FROM asked a LEFT JOIN i ON i.f = a.f AND i.line = a.line LEFT JOIN n ON n.f = a.f AND n.line = a.line)"""


def _sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a file (customer), at the days on which they were shipped."""
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    o, line = star.table(spark, sf_dir, "orders"), star.table(spark, sf_dir, "lineitem")
    return line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("string").alias("file"), day("o_orderdate").alias("ordered"), day("l_shipdate").alias("line"), F.col("l_linenumber").alias("k"), "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"
    )


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as definitions of thirty days."""
    day = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date"))
    return star.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("file_path"), day.alias("first_line"), day.alias("def_line"), (day + 30).alias("end_line"))


def profile_run(spark: SparkSession, sf_dir: str) -> Run:
    t = _sold(spark, sf_dir)
    records = t.select("file", "line", F.lit(1).cast("long").alias("ncalls"), F.col("l_quantity").alias("tottime"), F.col("l_extendedprice").alias("cumtime"))
    callers = t.select("file", "line", F.col("file").alias("caller_file"), F.col("ordered").alias("caller_line"), F.lit(1).cast("long").alias("count"))
    return runs.overlay_profile("profile", records, callers, _definitions(spark, sf_dir))


def coverage_run(spark: SparkSession, sf_dir: str, name: str = "coverage", parity: int | None = None) -> Run:
    """Coverage of all lines, or of those of even or odd line numbers as a run of its own."""
    t = _sold(spark, sf_dir)
    t = t if parity is None else t.filter(F.col("k") % 2 == parity)
    t = cut(t.select("file", "line", "k", "l_returnflag", "l_linestatus"))  # four tables come of it
    lines = t.select("file", "line", (F.col("l_returnflag") != "N").alias("hit"))
    arcs = t.select("file", F.col("line").alias("from"), (F.col("line") + F.col("k")).alias("to"), (F.col("l_linestatus") == "F").alias("hit"))
    contexts = t.select("file", "line", F.expr("concat('t/c', cast(file as bigint) % 7, '.py::t', k, '[p]|run')").alias("context"))
    known = spark.range(7).select(F.explode(F.expr("transform(sequence(1, 5), j -> concat('py:function:t.c', id, '.t', j))")).alias("id"))
    return runs.overlay_coverage(name, lines, arcs, contexts, _definitions(spark, sf_dir), known)


def _missing(t: DataFrame) -> DataFrame:
    return t.withColumn("missing", F.size("missing_arcs").cast("long")).drop("missing_arcs", "run")


plain("overlay_profile", lambda s, d: profile_run(s, d).calls.drop("run"), f"WITH {_SOLD}, {_BOUND} SELECT id AS node_id, count(*) AS ncalls, sum(q) AS tottime, max(x) AS cumtime FROM s JOIN b ON b.f = s.f AND b.line = s.line WHERE id IS NOT NULL GROUP BY id")
plain("overlay_profile_edges", lambda s, d: profile_run(s, d).edges.drop("run"), f"WITH {_SOLD}, {_BOUND} SELECT c.id AS caller, b.id AS callee, count(*) AS count FROM s JOIN b ON b.f = s.f AND b.line = s.line JOIN b c ON c.f = s.f AND c.line = s.ordered WHERE b.id IS NOT NULL AND c.id IS NOT NULL AND b.id <> c.id GROUP BY ALL")
plain(
    "binding_ledger", lambda s, d: runs.ledger_of(runs.bind(_sold(s, d).select(F.when(F.col("k") == 7, F.concat(F.lit("other/"), "file")).otherwise(F.concat(F.lit("in/"), "file")).alias("file"), "line", "k"), _definitions(s, d).withColumn("file_path", F.concat(F.lit("in/"), "file_path")).filter(F.col("file_path") != "in/1"), ["in"])),
    f"WITH {_SOLD}, {_BOUND} SELECT CASE WHEN k = 7 THEN 'outside_scope' WHEN s.f = 1 THEN 'unindexed_file' WHEN id IS NULL THEN 'no_enclosing_node' ELSE 'bound' END AS outcome, count(*) AS records FROM s JOIN b ON b.f = s.f AND b.line = s.line GROUP BY 1",
)
_COVERED = """l AS (SELECT d.id, count(*) FILTER (hit) AS lh, count(*) AS lt FROM (SELECT DISTINCT f, line, rf <> 'N' AS hit FROM s) x JOIN d ON d.f = x.f AND x.line BETWEEN a AND a + 30 GROUP BY 1),
r AS (SELECT d.id, count(*) FILTER (hit) AS bh, count(*) AS bt FROM (SELECT DISTINCT f, line, line + k AS t, ls = 'F' AS hit FROM s) x JOIN d ON d.f = x.f AND x.line BETWEEN a AND a + 30 GROUP BY 1)"""
plain("overlay_coverage", lambda s, d: _missing(coverage_run(s, d).coverage), f"WITH {_SOLD}, {_COVERED} SELECT id AS node_id, lh AS lines_hit, lt AS lines_total, bh AS branches_hit, bt AS branches_total, bt - bh AS missing FROM l JOIN r USING (id)")
plain("overlay_exercised", lambda s, d: coverage_run(s, d).exercised.drop("run"), f"WITH {_SOLD} SELECT DISTINCT d.id AS node_id, 'py:function:t.c' || (s.f % 7) || '.t' || k AS test_id FROM s JOIN d ON d.f = s.f AND line BETWEEN a AND a + 30 WHERE k <= 5")
plain("coverage_ledger", lambda s, d: coverage_run(s, d).ledger.drop("run"), f"WITH {_SOLD} SELECT 'bound' AS outcome, count(DISTINCT f) AS records FROM s UNION ALL SELECT 'unknown_context', count(DISTINCT (f % 7, k)) FROM s WHERE k > 5 HAVING count(*) > 0")


def _merged(spark: SparkSession, sf_dir: str) -> Run:
    return runs.merge_runs([coverage_run(spark, sf_dir, "even", 0), coverage_run(spark, sf_dir, "odd", 1)], "both")


plain("merge_runs", lambda s, d: _missing(_merged(s, d).coverage), f"""
WITH {_SOLD}, x AS (SELECT k % 2 AS run, f, line, k, rf <> 'N' AS lhit, ls = 'F' AS bhit FROM s),
l AS (SELECT run, d.id, count(*) FILTER (lhit) AS lh, count(*) AS lt FROM (SELECT DISTINCT run, f, line, lhit FROM x) y JOIN d ON d.f = y.f AND line BETWEEN a AND a + 30 GROUP BY ALL),
z AS (SELECT DISTINCT run, d.id, line, line + k AS t, bhit FROM x JOIN d ON d.f = x.f AND line BETWEEN a AND a + 30),
r AS (SELECT run, id, count(*) AS bt FROM z GROUP BY ALL), m AS (SELECT id, line, t, count(DISTINCT run) AS n FROM z WHERE NOT bhit GROUP BY ALL),
c AS (SELECT id, count(DISTINCT run) AS runs, max(lh) AS lh, max(lt) AS lt, max(bt) AS bt FROM l JOIN r USING (run, id) GROUP BY id),
g AS (SELECT c.id, count(m.id) AS missing FROM c LEFT JOIN m ON m.id = c.id AND m.n = c.runs GROUP BY c.id)
SELECT id AS node_id, lh AS lines_hit, lt AS lines_total, greatest(bt - missing, 0) AS branches_hit, bt AS branches_total, missing FROM c JOIN g USING (id)""")  # fmt: skip


def _tests(spark: SparkSession, sf_dir: str) -> Run:
    t = _sold(spark, sf_dir)
    marks = F.expr("map_from_arrays(filter(array('slow', 'level'), m -> m = 'level' or k % 2 = 0), filter(array('yes', cast(k as string)), v -> v <> 'yes' or k % 2 = 0))")
    rows = t.select(F.expr("k * 100000000L + line").alias("seq"), F.expr("concat('n', k)").alias("nodeid"), "file", "line", marks.alias("markers"))
    return runs.overlay_tests("collected", rows, _definitions(spark, sf_dir))


plain(
    "overlay_tests", lambda s, d: _tests(s, d).markers.select("node_id", F.coalesce(F.col("markers")["slow"], F.lit("")).alias("slow"), F.col("markers")["level"].alias("level"), F.array_join("pytest_ids", ",").alias("ids")),
    f"WITH {_SOLD}, {_BOUND}, t AS (SELECT id, k, line FROM s JOIN b USING (f, line) WHERE id IS NOT NULL) SELECT id AS node_id, CASE WHEN bool_or(k % 2 = 0) THEN 'yes' ELSE '' END AS slow, CAST(min(k) AS VARCHAR) AS level, string_agg(DISTINCT 'n' || k, ',' ORDER BY 'n' || k) AS ids FROM t GROUP BY id",
)


# questions about runs over the star graph
def _dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of more than 25 pieces call parts, and so do their customers, which no static call tells."""
    t = star.table(spark, sf_dir, "lineitem").filter("l_quantity > 25").join(star.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    part = F.concat(F.lit("item:function:"), "l_partkey")
    rows = t.select(F.concat(F.lit("sale:order:"), "o_orderkey").alias("caller"), part.alias("callee")).unionByName(t.select(F.concat(F.lit("cust:function:"), "o_custkey").alias("caller"), part.alias("callee")))
    return rows.groupBy("caller", "callee").agg(F.count("*").alias("count"))


_DYN = "t AS (SELECT 'sale:order:' || o_orderkey AS o, 'cust:function:' || o_custkey AS c, 'item:function:' || l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 25)"
plain("runtime_edges", lambda s, d: runs.edges(star.graph(s, d), _dynamic(s, d), limit=0), f"WITH {_DYN} SELECT c AS caller, p AS callee, count(*) AS count, false AS in_static, false AS accessor FROM t GROUP BY ALL")
plain("runtime_edges_fired", lambda s, d: runs.edges(star.graph(s, d), _dynamic(s, d), mode="fired", limit=0), f"WITH {_DYN} SELECT o AS caller, p AS callee, count(*) AS count, true AS in_static, false AS accessor FROM t GROUP BY ALL")
plain(
    "runtime_edges_dead", lambda s, d: runs.edges(star.graph(s, d), _dynamic(s, d), mode="dead", limit=0),
    f"""WITH {_DYN}, ran AS (SELECT o AS id FROM t UNION SELECT c FROM t UNION SELECT p FROM t),
e AS (SELECT 'cust:function:' || o_custkey AS a, 'sale:order:' || o_orderkey AS b FROM orders UNION SELECT 'sale:order:' || l_orderkey, 'item:function:' || l_partkey FROM lineitem)
SELECT a AS caller, b AS callee, CAST(0 AS BIGINT) AS count, true AS in_static, false AS accessor FROM e WHERE a IN (SELECT id FROM ran) AND b IN (SELECT id FROM ran) AND NOT EXISTS (SELECT 1 FROM t WHERE o = a AND p = b)""",
)


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = star.table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("cust:function:"), "user_id").alias("node_id"), "ts", "event_type", "value", "event_id", "user_id")


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _users(spark, sf_dir).groupBy("node_id").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("first_ts"), F.count("*").alias("count"), F.min(F.expr("cast(event_id % 4 as int)")).alias("min_depth"))
    return runs.timeline(star.graph(spark, sf_dir), rows, 0, 0)


plain("runtime_timeline", _timeline, "SELECT 'cust:function:' || user_id AS node_id, epoch_us(min(ts)) AS first_ts, count(*) AS count, CAST(min(event_id % 4) AS INTEGER) AS min_depth FROM events GROUP BY user_id HAVING min(event_id % 4) <= 0")
plain(
    "runtime_exercisers", lambda s, d: runs.exercisers(star.graph(s, d), star.table(s, d, "orders").select(F.concat(F.lit("sale:order:"), "o_orderkey").alias("node_id"), F.concat(F.lit("cust:function:"), "o_custkey").alias("test_id")).unionByName(star.table(s, d, "lineitem").select(F.concat(F.lit("item:function:"), "l_partkey").alias("node_id"), F.concat(F.lit("sale:order:"), "l_orderkey").alias("test_id"))), limit=0),
    "SELECT 'sale:order:' || o_orderkey AS node_id, CAST(1 AS BIGINT) AS tests, 'cust:function:' || o_custkey AS first_test FROM orders UNION ALL SELECT 'item:function:' || l_partkey, count(DISTINCT l_orderkey), min('sale:order:' || l_orderkey) FROM lineitem GROUP BY l_partkey",
)


def _markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _users(spark, sf_dir).groupBy("node_id", "event_type").agg(F.count("*").cast("string").alias("n"))
    marks = by.groupBy("node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("markers"), F.array_sort(F.collect_list("event_type")).alias("pytest_ids"))
    return runs.markers(star.graph(spark, sf_dir), marks, limit=0)


plain("runtime_markers", _markers, "SELECT 'cust:function:' || user_id AS node_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS markers, CAST(count(DISTINCT event_type) AS INTEGER) AS n_markers, 'pytest ' || array_to_string(list_sort(list(DISTINCT event_type)), ' ') AS invocation FROM events GROUP BY user_id")
plain(
    "runtime_branches", lambda s, d: runs.branches(star.graph(s, d), star.table(s, d, "lineitem").groupBy(F.concat(F.lit("item:function:"), "l_partkey").alias("node_id")).agg(F.count_if(F.col("l_returnflag") != "N").alias("lines_hit"), F.count("*").alias("lines_total"), F.count_if(F.col("l_linestatus") == "F").alias("branches_hit"), F.count("*").alias("branches_total")), limit=0),
    "SELECT 'item:function:' || l_partkey AS node_id, count(*) FILTER (l_returnflag <> 'N') AS lines_hit, count(*) AS lines_total, count(*) FILTER (l_linestatus = 'F') AS branches_hit, count(*) AS branches_total, any_value(p_type) AS discriminates FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey HAVING count(*) >= 2 AND count(*) FILTER (l_linestatus = 'F') < count(*)",
)


def _stored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile written, written again under its name, and listed with a run of coverage."""
    path = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    for run in (coverage_run(spark, sf_dir), coverage_run(spark, sf_dir, "gone"), coverage_run(spark, sf_dir)):
        runs.write_run(run, path)
    runs.delete_run(spark, path, "gone")
    return runs.list_runs(spark, path)


plain("runtime_runs", _stored_runs, f"WITH {_SOLD}, {_COVERED} SELECT 'coverage' AS run, 'coverage' AS family, count(*) AS rows FROM l UNION ALL SELECT 'coverage', 'about', 1 UNION ALL SELECT 'coverage', 'exercised', count(*) FROM (SELECT DISTINCT d.id, s.f % 7, k FROM s JOIN d ON d.f = s.f AND line BETWEEN a AND a + 30 WHERE k <= 5)")

# evidence with a run: test customers ran the parts that they bought more than 25 pieces of
_SEEN = "seen AS (SELECT DISTINCT 'item:function:' || l_partkey AS node_id, 'cust:function:' || o_custkey AS test FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 25 AND o_custkey % 5 = 0)"


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = star.table(spark, sf_dir, "lineitem").filter("l_quantity > 25").join(star.table(spark, sf_dir, "orders").filter("o_custkey % 5 = 0"), F.col("l_orderkey") == F.col("o_orderkey"))
    return t.select(F.concat(F.lit("item:function:"), "l_partkey").alias("node_id"), F.concat(F.lit("cust:function:"), "o_custkey").alias("test_id")).distinct()


def _with_run(f):
    return lambda s, d: f(star.graph(s, d), _seen(s, d))


_VERDICT = f"""{_SEEN}, claim AS (SELECT DISTINCT source AS test, target AS equation FROM edges WHERE type = 'tests'),
verdicts AS (SELECT c.test, c.equation, CASE WHEN c.test NOT IN (SELECT test FROM seen) THEN 'out_of_capture' WHEN EXISTS (SELECT 1 FROM seen s JOIN edges i ON i.type = 'implements' AND i.source = s.node_id WHERE s.test = c.test AND i.target = c.equation) THEN 'corroborated' ELSE 'refuted' END AS verdict FROM claim c)"""
register("claim_verdicts", _with_run(lambda g, seen: verify.verdicts(g.typed("tests").select(F.col("source").alias("test"), F.col("target").alias("equation")), g.typed("implements").select(F.col("source").alias("code"), F.col("target").alias("equation")), seen.withColumnRenamed("test_id", "test"), seen.select(F.col("test_id").alias("test")))), "SELECT * FROM verdicts", _VERDICT)
register(
    "code_coverage", graph_of(lambda g: verify.code_coverage(g, g.typed("calls").join(g.nodes.filter("is_test").select(F.col("id").alias("source")), "source", "left_semi").join(g.typed("calls").select(F.col("source").alias("mid"), F.col("target").alias("far")), F.col("target") == F.col("mid")).select(F.col("far").alias("node_id"), F.col("source").alias("test_id")).unionByName(g.typed("contains").select(F.col("source").alias("node_id"), F.col("target").alias("test_id"))))),
    """SELECT n.id AS code, CASE WHEN count(x.test) > 0 THEN 'tested' ELSE 'orphan_code' END AS status, count(x.test) AS tests, CASE WHEN count(x.test) = 0 THEN 'none' ELSE 'executed' END AS tier FROM nodes n
LEFT JOIN (SELECT source AS code, target AS test FROM edges WHERE type = 'contains') x ON x.code = n.id WHERE n.type IN ('function', 'method', 'class') AND n.id NOT IN (SELECT source FROM edges WHERE type = 'implements') GROUP BY n.id""",
)
register(
    "verification_summary", _with_run(lambda g, seen: verify.summary(g, seen)),
    """SELECT status AS key, count(*) AS n FROM (SELECT CASE WHEN t.target IS NOT NULL THEN 'verified' WHEN i.target IS NOT NULL THEN 'implemented' ELSE 'documented' END AS status FROM nodes n LEFT JOIN (SELECT DISTINCT target FROM edges WHERE type = 'tests') t ON t.target = n.id LEFT JOIN (SELECT DISTINCT target FROM edges WHERE type = 'implements') i ON i.target = n.id WHERE n.type = 'equation') GROUP BY 1
UNION ALL SELECT 'orphan_code', count(*) FROM nodes WHERE type IN ('function', 'method', 'class') AND id NOT IN (SELECT source FROM edges WHERE type = 'implements') UNION ALL SELECT 'claims_' || verdict, count(*) FROM verdicts GROUP BY verdict""",
    _VERDICT,
)
register("verification_audit_gaps", graph_of(lambda g: verify.audit_gaps(PropertyGraph(g.nodes, g.edges.filter("type <> 'tests' and type <> 'calls'")), "module")), "SELECT target AS equation, 'implemented' AS status, count(DISTINCT source) AS implementers, 'unassigned' AS level, split_part(arg_min(name, source), '.', 1) AS module, split_part(arg_min(name, source), '.', 1) AS bucket FROM edges e JOIN nodes n ON n.id = e.source WHERE e.type = 'implements' GROUP BY target")
register("brief_summary", graph_of(lambda g: lookup.brief_summary(g, "type/ECONOMY")), """, f AS (SELECT id, is_test FROM nodes WHERE file_path = 'type/ECONOMY'), q AS (SELECT DISTINCT target FROM edges WHERE type = 'implements' AND source IN (SELECT id FROM f)),
p AS (SELECT source, count(*) AS refs FROM edges JOIN nodes n ON n.id = source AND n.type = 'file' WHERE edges.type IN ('documents', 'contains') AND target IN (SELECT id FROM f) GROUP BY source)
SELECT (SELECT count(*) FROM f) AS nodes, (SELECT count(*) FROM q) AS equations, (SELECT count(*) FROM edges WHERE type = 'tests' AND target IN (SELECT target FROM q)) AS tests, (SELECT count(*) FROM p) AS pages, (SELECT source FROM p ORDER BY refs DESC, source LIMIT 1) AS first_page,
(SELECT count(*) FROM f WHERE is_test) AS gate_tests, '' AS levels, CAST(0 AS BIGINT) AS claimed, CAST(0 AS BIGINT) AS caught""")  # fmt: skip
register(
    "ranked_neighbors", graph_of(lambda g: lookup.ranked_neighbors(g, PART, limit=20, offset=5)),
    f"""SELECT neighbor, edge_type, direction, times, degree, total FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY is_test, degree DESC, neighbor, edge_type, direction) AS k FROM (
SELECT target AS neighbor, type AS edge_type, 'out' AS direction, count(*) AS times FROM edges WHERE source = '{PART}' GROUP BY ALL UNION ALL SELECT source, type, 'in', count(*) FROM edges WHERE target = '{PART}' GROUP BY ALL) x
JOIN (SELECT n.id AS neighbor, is_test, degree FROM nodes n JOIN deg USING (id)) USING (neighbor)) WHERE k BETWEEN 6 AND 25""",
)
register("test_facts", graph_of(lookup.test_facts), "SELECT id, file_path || '::' || name AS runnable, CAST(NULL AS VARCHAR) AS vv_level, '' AS verifies, '' AS catches FROM nodes WHERE is_test")
_HUBS = "hubs AS (SELECT id FROM deg JOIN nodes USING (id) ORDER BY degree DESC, id LIMIT 10), median AS (SELECT degree AS m FROM (SELECT coalesce(degree, 0) AS degree, row_number() OVER (ORDER BY coalesce(degree, 0)) AS k, count(*) OVER () AS n FROM nodes LEFT JOIN deg USING (id)) WHERE k = n // 2 + 1)"
register("hot_nodes", graph_of(lambda g: change.hot_nodes(g, g.nodes.filter("type = 'function'"), 50)), "SELECT id, degree FROM nodes JOIN deg USING (id) WHERE type = 'function' AND id NOT IN (SELECT id FROM hubs) AND degree >= (SELECT m FROM median) ORDER BY degree DESC, id LIMIT 50", _HUBS)
register(
    "session_briefing", graph_of(lambda g: verify.briefing(g, g.nodes.filter("type = 'function'")).filter("section <> 'grammar'")),
    """SELECT 'size' AS section, 'nodes' AS item, count(*) AS n FROM nodes UNION ALL SELECT 'size', 'edges', count(*) FROM edges UNION ALL (SELECT 'hubs', id, degree FROM deg ORDER BY degree DESC, id LIMIT 10)
UNION ALL SELECT 'gaps', 'total', count(*) FROM nodes n WHERE type = 'equation' AND id NOT IN (SELECT target FROM edges WHERE type = 'tests')
UNION ALL (SELECT 'changed', id, degree FROM nodes JOIN deg USING (id) WHERE type = 'function' AND id NOT IN (SELECT id FROM hubs) AND degree >= (SELECT m FROM median) ORDER BY degree DESC, id LIMIT 5)""",
    _HUBS,
)
register("callers_blind_spots", graph_of(lambda g: lookup.callers_with_blind_spots(g, PART)), f"SELECT source AS id, 'caller' AS kind, count(*) AS calls FROM edges WHERE type = 'calls' AND target = '{PART}' GROUP BY source")
register("doc_impact_of_order", graph_of(lambda g: verify.doc_impact(PropertyGraph(g.nodes, g.edges.withColumn("source", F.when(F.col("type") == "implements", F.lit(CUSTOMER)).otherwise(F.col("source")))), PART)), f"SELECT DISTINCT target AS equation, CAST(2 AS INTEGER) AS depth FROM edges WHERE type = 'implements' AND EXISTS (SELECT 1 FROM edges a JOIN edges b ON b.target = a.source AND b.type = 'calls' WHERE a.type = 'calls' AND a.target = '{PART}' AND b.source = '{CUSTOMER}')")
register("top_nodes_edges", graph_of(lambda g: g.induced(lookup.god_nodes(g, 50)).edges.groupBy("source", "target", "type").agg(F.count("*").alias("n"))), ", t AS (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 50) SELECT source, target, type, count(*) AS n FROM edges WHERE source IN (SELECT id FROM t) AND target IN (SELECT id FROM t) GROUP BY ALL")
register(
    "path_edges", graph_of(lambda g: traverse.path_edges(g, traverse.shortest_path(g, "geo:file:0", "math:equation:Brand#1")).agg(F.count("*").alias("edges"))),
    "SELECT CAST(min(d) AS BIGINT) AS edges FROM sp WHERE id = 'math:equation:Brand#1'",
    "both_ways AS (SELECT DISTINCT source AS a, target AS b FROM edges UNION SELECT DISTINCT target, source FROM edges), sp AS (SELECT 'geo:file:0' AS id, 0 AS d UNION SELECT b, d + 1 FROM sp JOIN both_ways ON a = sp.id WHERE d < 2)",
)


# names: orders refer to offers by their last part only, or by a path that begins alike
def _references(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    part, line = star.table(spark, sf_dir, "part"), star.table(spark, sf_dir, "lineitem")
    real = part.select(F.expr("concat('py:function:b', p_size % 5, '.m.f', p_partkey)").alias("id"), F.lit("function").alias("type"), F.expr("concat('b', p_size % 5, '.m.f', p_partkey)").alias("name"), F.lit("x.py").alias("file_path"))
    called = line.select("l_orderkey", F.expr("case l_linenumber % 3 when 0 then concat('f', l_partkey) when 1 then concat('b', l_suppkey % 5, '.f', l_partkey) else concat('m.f', l_partkey) end").alias("name"))
    open_ = called.select("name").distinct().select(F.concat(F.lit("py:function:"), "name").alias("id"), F.lit("unresolved").alias("type"), "name", F.lit(None).cast("string").alias("file_path"))
    orders = line.select("l_orderkey").distinct().select(F.concat(F.lit("py:method:o.x"), "l_orderkey").alias("id"), F.lit("method").alias("type"), F.concat(F.lit("o.x"), "l_orderkey").alias("name"), F.lit("o.py").alias("file_path"))
    e = called.select(F.concat(F.lit("py:method:o.x"), "l_orderkey").alias("source"), F.concat(F.lit("py:function:"), "name").alias("target"), F.lit("calls").alias("type"))
    return PropertyGraph.of(real.unionByName(open_).unionByName(orders), e)


_MEANT = "c AS (SELECT l_orderkey AS o, CASE l_linenumber % 3 WHEN 0 THEN 'f' || l_partkey WHEN 1 THEN 'b' || (l_suppkey % 5) || '.f' || l_partkey ELSE 'm.f' || l_partkey END AS name, l_linenumber % 3 AS w, l_partkey AS p, l_suppkey % 5 AS b FROM lineitem), r AS (SELECT p_partkey AS p, p_size % 5 AS b, 'b' || (p_size % 5) || '.m.f' || p_partkey AS name FROM part)"
plain("canonicalize", lambda s, d: names.canonicalize(_references(s, d)).edges.groupBy("target").agg(F.count("*").alias("n")), f"WITH {_MEANT} SELECT 'py:function:' || CASE WHEN w <> 1 OR c.b = r.b THEN r.name ELSE c.name END AS target, count(*) AS n FROM c JOIN r USING (p) GROUP BY 1")
plain("fold_candidates", lambda s, d: names.fold_candidates(_references(s, d)), f"WITH {_MEANT} SELECT DISTINCT 'py:function:' || c.name AS old, 'py:function:' || r.name AS new FROM c JOIN r USING (p) WHERE w <> 1 OR c.b = r.b")
plain(
    "resolve_targets", lambda s, d: names.resolve_targets(_references(s, d), star.table(s, d, "lineitem").select(F.concat_ws(".", "l_orderkey", "l_partkey").alias("ref"), F.lit("py").alias("domain"), F.lit("func").alias("reftype"), F.concat(F.lit("m.f"), "l_partkey").alias("target"), F.array(F.lit("function")).alias("objtypes")).distinct()),
    f"WITH {_MEANT} SELECT DISTINCT o || '.' || p AS ref, 'py:function:' || r.name AS id FROM c JOIN r USING (p)",
)
plain(
    "classify", lambda s, d: lookup.count_by(names.classify(PropertyGraph.of(star.table(s, d, "part").select(F.expr("concat('py:function:t', p_size % 6, '.f', p_partkey)").alias("id")).unionByName(s.range(2).select(F.concat(F.lit("py:module:t"), "id").alias("id"))).withColumn("type", F.when(F.startswith("id", F.lit("py:module")), "module")).withColumn("name", F.expr("substring_index(id, ':', -1)")), s.createDataFrame([], "source string, target string, type string")), s.createDataFrame([("t0",), ("t2",), ("t3",)], "name string")).nodes, "type"),
    "SELECT CASE WHEN p_size % 6 IN (2, 3) THEN 'external' ELSE 'unresolved' END AS type, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT 'module', 2",
)
plain("undeclared_types", lambda s, d: names.check_node_types(star.graph(s, d), ["function", "method", "class", "module", "file", "equation"]), f"WITH RECURSIVE {star.SQL} SELECT split_part(id, ':', 2) AS segment, count(*) AS n, min(id) AS example FROM nodes WHERE split_part(id, ':', 2) NOT IN ('function', 'method', 'class', 'module', 'file', 'equation') GROUP BY 1")
plain("minting_files", lambda s, d: structure.minting_files(_references(s, d)), f"WITH {_MEANT} SELECT DISTINCT 'py:function:' || name AS target, 'o.py' AS files FROM c")
