"""Registered graph queries over the whole star graph, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.functions.text import k_grams
from strandline.graph import PropertyGraph
from strandline.operators import change, lookup, runtime, structure, traverse, verify
from strandline.plans.pattern import graph_query
from strandline.sources import star

PART, SUPPLIER, CUSTOMER, ORDER, EQUATION = "item:function:0", "sup:class:0", "cust:function:0", "sale:order:0", "math:equation:Brand#1"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def graph_of(f: Callable[[PropertyGraph], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(star.graph(spark, sf_dir))


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None, recursive: str = "") -> None:
    """``sql`` follows the graph's own WITH clause; without it the query is tested against brute force only."""
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = f"WITH RECURSIVE {star.SQL}{', ' + recursive if recursive else ''} {sql}"


def plain(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    """A query on the tables themselves."""
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def walk_sql(seed: str, types: str, against: bool, depth: int | None) -> str:
    """A recursive view ``walk`` of (id, d)."""
    frm, to = ("target", "source") if against else ("source", "target")
    bound = f" AND d < {depth}" if depth is not None else ""
    d = "d + 1" if depth is not None else "0"
    return f"walk AS (SELECT id, 0 AS d FROM nodes WHERE {seed} UNION SELECT e.{to}, {d} FROM walk JOIN edges e ON e.{frm} = walk.id WHERE {types}{bound})"


# lookups
register("get_node", graph_of(lambda g: lookup.get_node(g, PART)), f"SELECT n.id, n.type, n.name, split_part(n.id, ':', 1) AS domain, file_path, is_test, degree FROM nodes n JOIN deg USING (id) WHERE n.id = '{PART}'")
register("neighbors", graph_of(lambda g: lookup.neighbors(g, PART)), f"SELECT target AS neighbor, type AS edge_type, 'out' AS direction, count(*) AS times FROM edges WHERE source = '{PART}' GROUP BY ALL UNION ALL SELECT source, type, 'in', count(*) FROM edges WHERE target = '{PART}' GROUP BY ALL")
register(
    "context", graph_of(lambda g: lookup.context(g, PART, 5)),
    f"""SELECT direction, edge_type, CAST(place AS INTEGER) AS place, neighbor, times, degree, greatest(total - 5, 0) AS omitted FROM (
SELECT *, row_number() OVER (PARTITION BY direction, edge_type ORDER BY is_test, degree DESC, neighbor) AS place, count(*) OVER (PARTITION BY direction, edge_type) AS total FROM (
SELECT target AS neighbor, type AS edge_type, 'out' AS direction, count(*) AS times FROM edges WHERE source = '{PART}' GROUP BY ALL UNION ALL SELECT source, type, 'in', count(*) FROM edges WHERE target = '{PART}' GROUP BY ALL) x
JOIN (SELECT n.id AS neighbor, is_test, degree FROM nodes n JOIN deg USING (id)) USING (neighbor)) WHERE place <= 5""",
)
register("search", graph_of(lambda g: lookup.search(g, "red widget", limit=0)), "SELECT n.id, n.type, n.name, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN deg USING (id) WHERE contains(lower(n.id || ' ' || n.name), 'red') AND contains(lower(n.id || ' ' || n.name), 'widget')")
register("graph_query", graph_of(lambda g: graph_query(g, "class -contains-> method WHERE name=1*", 0)), "SELECT source, e.type AS edge_type, target, CAST(NULL AS VARCHAR) AS error FROM edges e JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target WHERE e.type = 'contains' AND s.type = 'class' AND t.type = 'method' AND (starts_with(lower(s.name), '1') OR starts_with(lower(t.name), '1'))")
register("stats", graph_of(lambda g: lookup.stats(g)), "SELECT n AS nodes, e AS edges, CAST(0 AS BIGINT) AS loops, e - p AS parallel, round(e / (n * (n - 1.0::DOUBLE)), 9) AS density FROM (SELECT count(*) AS n FROM nodes), (SELECT count(*) AS e FROM edges), (SELECT count(*) AS p FROM (SELECT DISTINCT source, target, type FROM edges))")
register("nodes_by_type", graph_of(lambda g: lookup.count_by(g.nodes, "type", "domain")), "SELECT type, split_part(id, ':', 1) AS domain, count(*) AS n FROM nodes GROUP BY ALL")
register("edges_by_type", graph_of(lambda g: lookup.count_by(g.edges, "type")), "SELECT type, count(*) AS n FROM edges GROUP BY ALL")
register("degree", graph_of(lambda g: g.degree()), "SELECT id, degree FROM deg")
register("god_nodes", graph_of(lambda g: lookup.god_nodes(g, 10)), "SELECT id, type, degree FROM deg JOIN nodes USING (id) ORDER BY degree DESC, id LIMIT 10")
register("id_grammar", graph_of(lookup.id_grammar), "SELECT domain, type, id AS example, n FROM (SELECT split_part(n.id, ':', 1) AS domain, type, n.id, row_number() OVER (PARTITION BY split_part(n.id, ':', 1), type ORDER BY coalesce(degree, 0), n.id) AS k, count(*) OVER (PARTITION BY split_part(n.id, ':', 1), type) AS n FROM nodes n LEFT JOIN deg USING (id)) WHERE k = n // 2 + 1")
register(
    "file_brief", graph_of(lambda g: lookup.file_brief(g, "type/ECONOMY")),
    """, f AS (SELECT id, type FROM nodes WHERE file_path = 'type/ECONOMY')
SELECT f.id, f.type, coalesce(degree, 0) AS degree, coalesce(x, 0) AS external_callers, coalesce(q, 0) AS equations FROM f LEFT JOIN deg USING (id)
LEFT JOIN (SELECT target AS id, count(DISTINCT source) AS x FROM edges WHERE type = 'calls' AND source NOT IN (SELECT id FROM f) GROUP BY 1) USING (id) LEFT JOIN (SELECT source AS id, count(DISTINCT target) AS q FROM edges WHERE type = 'implements' GROUP BY 1) USING (id)""",
)

# walks
register("impact", graph_of(lambda g: traverse.impact(g, PART)), "SELECT id, CAST(min(d) AS INTEGER) AS depth FROM walk GROUP BY id HAVING min(d) > 0", walk_sql(f"id = '{PART}'", "true", True, 3))
register("impact_downstream", graph_of(lambda g: traverse.impact(g, CUSTOMER, "downstream", 3, ("calls", "implements"))), "SELECT id, CAST(min(d) AS INTEGER) AS depth FROM walk GROUP BY id HAVING min(d) > 0", walk_sql(f"id = '{CUSTOMER}'", "type IN ('calls', 'implements')", False, 3))
register("callers", graph_of(lambda g: traverse.callers(g, PART)), f"SELECT DISTINCT source AS id, CAST(1 AS INTEGER) AS depth FROM edges WHERE type = 'calls' AND target = '{PART}'")
register("callers_transitive", graph_of(lambda g: traverse.callers(g, PART, True, -1)), f"SELECT id, CAST(CASE WHEN starts_with(id, 'cust:') THEN 2 ELSE 1 END AS INTEGER) AS depth FROM walk WHERE id <> '{PART}'", walk_sql(f"id = '{PART}'", "type = 'calls'", True, None))
register("callees", graph_of(lambda g: traverse.callees(g, CUSTOMER, True, 2)), "SELECT id, CAST(min(d) AS INTEGER) AS depth FROM walk GROUP BY id HAVING min(d) > 0", walk_sql(f"id = '{CUSTOMER}'", "type = 'calls'", False, 2))
register("shortest_path_length", graph_of(lambda g: traverse.shortest_path(g, "geo:file:0", "math:equation:Brand#1").agg(F.max("hop").alias("hops"))), "SELECT CAST(min(d) AS INTEGER) AS hops FROM sp WHERE id = 'math:equation:Brand#1'", "both_ways AS (SELECT DISTINCT source AS a, target AS b FROM edges UNION SELECT DISTINCT target, source FROM edges), sp AS (SELECT 'geo:file:0' AS id, 0 AS d UNION SELECT b, d + 1 FROM sp JOIN both_ways ON a = sp.id WHERE d < 2)")
register("components", graph_of(lambda g: traverse.components(g).groupBy("component").agg(F.count("*").alias("n"))), "SELECT min(id) AS component, count(*) AS n FROM (SELECT id FROM reach UNION ALL SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM reach)) GROUP BY CASE WHEN id IN (SELECT id FROM reach) THEN '' ELSE id END", "both_ways AS (SELECT DISTINCT source AS a, target AS b FROM edges UNION SELECT DISTINCT target, source FROM edges), reach AS (SELECT min(a) AS id FROM both_ways UNION SELECT b FROM reach JOIN both_ways ON a = reach.id)")
register("trace_error", graph_of(lambda g: traverse.trace_error(g, CUSTOMER)), "SELECT id, CAST(min(d) AS INTEGER) AS depth, target AS equation FROM (SELECT id, min(d) AS d FROM walk GROUP BY id) LEFT JOIN (SELECT DISTINCT source, target FROM edges WHERE type = 'implements') ON source = id GROUP BY id, target", walk_sql(f"id = '{CUSTOMER}'", "type = 'calls'", False, 10))
register("processes", graph_of(lambda g: traverse.processes(g)))
register("communities", graph_of(lambda g: traverse.communities(g).groupBy("community").agg(F.count("*").alias("n"))))
register("bridges", graph_of(lambda g: traverse.bridges(g)))

# structure
register("discriminations", graph_of(lambda g: structure.discriminations(g, limit=0)), "SELECT 'item:tag:' || p_type AS tag, count(DISTINCT p_partkey) AS sites, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS cases FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_type HAVING count(DISTINCT p_partkey) >= 2")
plain("native_place", lambda s, d: structure.native_place(star.offer_graph(s, d), limit=0), """
WITH c AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s, o_orderkey AS o, o_custkey AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT p, s, count(*) FILTER (k % 5 <> 0) AS callers, count(*) FILTER (k % 5 = 0) AS excluded, count(DISTINCT k) FILTER (k % 5 <> 0) AS owners, min(k) FILTER (k % 5 <> 0) AS k FROM c GROUP BY p, s)
SELECT 'py:function:' || p || '.' || s AS function, 'py:class:' || k AS owner, callers, p % 7 <> k % 7 AS cross_module, s % 3 = 0 AS private, excluded AS excluded_callers FROM f WHERE owners = 1""")  # fmt: skip
register(
    "dead_functions", graph_of(lambda g: structure.dead_functions(g, 0)),
    """SELECT n.id, NOT starts_with(list_last(string_split(n.name, '.')), '_') AS public, false AS decorated, n.type = 'method' AS is_method, CAST(0 AS BIGINT) AS unresolved_calls FROM nodes n
WHERE type IN ('function', 'method') AND NOT is_test AND NOT EXISTS (SELECT 1 FROM called WHERE called.target = n.id)""",
    "called AS (SELECT DISTINCT e.target FROM edges e JOIN nodes s ON s.id = e.source WHERE e.type = 'calls' AND NOT s.is_test)",
)
plain("protocol_conformers", lambda s, d: structure.protocol_conformers(star.basket_graph(s, d)), """
WITH m AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), z AS (SELECT o, count(*) AS n FROM m GROUP BY o HAVING count(*) >= 2)
SELECT 'sale:class:' || a.o AS protocol, 'sale:class:' || b.o AS conformer, any_value(n) AS methods FROM m a JOIN m b ON a.p = b.p AND a.o <> b.o JOIN z ON z.o = a.o GROUP BY a.o, b.o HAVING count(*) = any_value(n)""")  # fmt: skip
register("migration_plan", graph_of(lambda g: structure.migration_plan(PropertyGraph(g.nodes.withColumn("name", F.when(F.col("id") == PART, F.lit("dep.x")).otherwise(F.col("name"))), g.edges), "dep")), f", u AS (SELECT DISTINCT source AS id FROM edges WHERE type = 'calls' AND target = '{PART}'), one AS (SELECT DISTINCT u.id AS root, e.source AS id FROM u JOIN edges e ON e.target = u.id), two AS (SELECT root, id FROM one UNION SELECT one.root, e.source FROM one JOIN edges e ON e.target = one.id), r AS (SELECT u.id, count(two.id) AS radius FROM u LEFT JOIN two ON two.root = u.id AND two.id <> u.id GROUP BY u.id), k AS (SELECT *, row_number() OVER (ORDER BY radius, id) AS k, count(*) OVER () AS n FROM r) SELECT id, radius, CAST(least(3, (k - 1) // greatest(1, n // 3) + 1) AS INTEGER) AS phase, false AS moved FROM k")


def twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = star.table(spark, sf_dir, "documents").filter("text is not null")
    grams = docs.select(F.col("doc_id").alias("id"), F.explode(k_grams(F.split("text", " ", -1))).alias("shingle"))
    return structure.twin_paths(grams)


plain("twin_paths", twins, """
WITH s AS (SELECT DISTINCT doc_id AS id, array_to_string(w[i:i + 3], chr(31)) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))),
z AS (SELECT id, count(*) AS n FROM s GROUP BY id), few AS (SELECT g FROM s GROUP BY g HAVING count(*) BETWEEN 2 AND 40),
p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM s a JOIN few USING (g) JOIN s b ON a.g = b.g AND a.id < b.id),
c AS (SELECT p.a, p.b, count(*) AS c FROM p JOIN s x ON x.id = p.a JOIN s y ON y.id = p.b AND x.g = y.g GROUP BY p.a, p.b)
SELECT a, b, round(c / (x.n + y.n - c)::DOUBLE, 4) AS similarity FROM c JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE round(c / (x.n + y.n - c)::DOUBLE, 4) >= 0.7""")  # fmt: skip

# verification; every implementer is called by orders only, whose callers are customers
_COVER = """eqs AS (SELECT id AS equation FROM nodes WHERE type = 'equation'),
code AS (SELECT target AS equation, source AS code, max(CASE WHEN evidence = 'inferred' THEN 1 ELSE 0 END) AS inferred FROM edges WHERE type = 'implements' GROUP BY 1, 2),
dec AS (SELECT target AS equation, count(DISTINCT source) AS declared FROM edges WHERE type = 'tests' GROUP BY 1),

hop AS (SELECT code.equation, code AS node, 0 AS d FROM code UNION SELECT hop.equation, e.source, d + 1 FROM hop JOIN edges e ON e.target = hop.node AND e.type = 'calls' WHERE d < 3),
reached AS (SELECT equation, node, min(d) AS d FROM hop JOIN nodes n ON n.id = node AND n.is_test GROUP BY 1, 2), far AS (SELECT equation, count(*) FILTER (d = 1) AS near, count(*) AS far FROM reached GROUP BY 1),
imp AS (SELECT equation, count(*) AS implementers, sum(inferred) AS inferred FROM code GROUP BY 1),
cover AS (SELECT equation, coalesce(implementers, 0) AS implementers, CASE WHEN coalesce(declared, 0) > 0 THEN declared WHEN coalesce(near, 0) > 0 THEN near ELSE coalesce(far, 0) END AS tests,
  CASE WHEN coalesce(declared, 0) > 0 THEN 'declared' WHEN coalesce(near, 0) > 0 THEN 'caller' WHEN coalesce(far, 0) > 0 THEN 'multihop' ELSE 'none' END AS test_tier,
  CASE WHEN coalesce(implementers, 0) = 0 THEN '' WHEN inferred = 0 THEN 'declared' WHEN inferred = implementers THEN 'inferred' ELSE 'mixed' END AS code_evidence FROM eqs LEFT JOIN imp USING (equation) LEFT JOIN dec USING (equation) LEFT JOIN far USING (equation)),
covered AS (SELECT equation, CASE WHEN tests > 0 THEN 'verified' WHEN implementers > 0 THEN 'implemented' ELSE 'documented' END AS status, implementers, tests, test_tier,
  CASE test_tier WHEN 'declared' THEN 1.0::DOUBLE WHEN 'caller' THEN 0.7::DOUBLE WHEN 'multihop' THEN 0.5::DOUBLE END AS confidence, code_evidence FROM cover)"""
register("verification_coverage", graph_of(verify.coverage), "SELECT * FROM covered", _COVER)
register("verification_audit", graph_of(verify.audit), "SELECT status, test_tier, count(*) AS n FROM covered GROUP BY ALL", _COVER)
register("verification_gaps", graph_of(verify.gaps), "SELECT 'untagged_test' AS kind, id FROM nodes WHERE is_test AND id NOT IN (SELECT source FROM edges WHERE type IN ('tests', 'catches')) UNION ALL SELECT 'unverified_equation', equation FROM covered WHERE status <> 'verified' UNION ALL SELECT 'uncaught_error', id FROM nodes WHERE type = 'error' AND id NOT IN (SELECT target FROM edges WHERE type = 'catches')", _COVER)
register("errors", graph_of(lambda g: verify.errors(g, 3)), "SELECT n.id AS error, count(DISTINCT source) AS catchers, coalesce(array_to_string(list_sort(list_distinct(list(source)))[1:3], ','), '') AS first FROM nodes n LEFT JOIN edges e ON e.target = n.id AND e.type = 'catches' WHERE n.type = 'error' GROUP BY 1")
register("retest", graph_of(lambda g: verify.retest(g, g.nodes.filter(F.col("id").isin(PART, ORDER)).select("id"))), "SELECT id AS test, CASE WHEN d <= 1 THEN 'must' WHEN d IS NOT NULL THEN 'should' ELSE 'safe_to_skip' END AS bucket FROM nodes LEFT JOIN (SELECT id, min(d) AS d FROM walk GROUP BY id) USING (id) WHERE is_test", walk_sql(f"id IN ('{PART}', '{ORDER}')", "type = 'calls'", True, 5))
register("doc_impact", graph_of(lambda g: verify.doc_impact(g, PART)), f"SELECT target AS equation, CAST(0 AS INTEGER) AS depth FROM edges WHERE type = 'implements' AND source = '{PART}'")
register(
    "provenance_chain", graph_of(lambda g: verify.provenance_chain(g, PART)),
    f"""SELECT 'target' AS step, id, CAST(NULL AS INTEGER) AS inferred, CAST(0 AS INTEGER) AS depth FROM nodes WHERE id = '{PART}'
UNION ALL SELECT 'implements', target, CAST(min(CASE WHEN evidence = 'inferred' THEN 1 ELSE 0 END) AS INTEGER), 1 FROM edges WHERE type = 'implements' AND source = '{PART}' GROUP BY target
UNION ALL SELECT DISTINCT 'also_on', source, NULL, 1 FROM edges JOIN nodes p ON p.id = source AND p.type = 'file' WHERE edges.type = 'documents' AND target = '{PART}'""",
)
register(
    "provenance_of_statement", graph_of(lambda g: verify.provenance_chain(g, EQUATION)),
    f"""SELECT 'target' AS step, id, CAST(NULL AS INTEGER) AS inferred, CAST(0 AS INTEGER) AS depth FROM nodes WHERE id = '{EQUATION}'
UNION ALL SELECT 'implemented_by', source, CAST(min(CASE WHEN evidence = 'inferred' THEN 1 ELSE 0 END) AS INTEGER), 1 FROM edges WHERE type = 'implements' AND target = '{EQUATION}' GROUP BY source""",
)
register("detect_changes", graph_of(lambda g: change.detect_changes(g, g.nodes.filter(F.col("id") == PART).select("file_path"))), "SELECT id, CAST(min(d) AS INTEGER) AS depth FROM walk GROUP BY id", walk_sql(f"file_path = (SELECT file_path FROM nodes WHERE id = '{PART}')", "type <> 'contains'", True, 2))
register("rename", graph_of(lambda g: change.rename(g, "widget", "gadget")), "SELECT id AS \"where\", 'high' AS confidence, name AS before, replace(name, 'widget', 'gadget') AS after FROM nodes WHERE contains(name, 'widget')")


def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, line = star.table(spark, sf_dir, "orders"), star.table(spark, sf_dir, "lineitem")
    links = line.select(F.col("l_orderkey").alias("page"), F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("code"), F.col("l_shipdate").alias("code_ts"))
    code = links.groupBy("code").agg(F.max("code_ts").alias("code_ts"))
    return verify.staleness(links, o.select(F.col("o_orderkey").alias("page"), F.col("o_orderdate").alias("page_ts")), code)


plain("staleness", stale, "SELECT o_orderkey AS page, max(o_orderdate) AS page_ts, max(l_shipdate) AS code_ts, count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_shipdate)) AS newer FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate GROUP BY o_orderkey")


plain("dead_references", lambda s, d: structure.dead_references(star.page_graph(s, d)), """
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS p FROM pages)
SELECT 'py:page:site.' || p AS target, 'python' AS kind, count(*) AS sites, count(DISTINCT page_id) AS sources, 'dead' AS verdict FROM l
WHERE p NOT IN (SELECT regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) FROM pages WHERE url IS NOT NULL) AND EXISTS (SELECT 1 FROM pages WHERE regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) <> '') GROUP BY p""")  # fmt: skip


# runs: an event type is a run, a user a node
def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = star.table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("node_id")).agg(F.count("*").alias("ncalls"), F.sum("value").alias("tottime"), F.max("value").alias("cumtime"))


plain(
    "runtime_hotspots", lambda s, d: runtime.hotspots(_calls(s, d).withColumn("tottime", F.round("tottime", 4)), star.table(s, d, "customer").select(F.col("c_custkey").alias("id")), "ncalls", 0),
    "SELECT event_type AS run, user_id AS node_id, count(*) AS ncalls, round(sum(value), 4) AS tottime, max(value) AS cumtime FROM events WHERE user_id IN (SELECT c_custkey FROM customer) GROUP BY ALL",
)


def _depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = star.table(spark, sf_dir, "events")
    return runtime.depths(e.select(F.col("user_id").alias("trace"), F.col("event_id").alias("event"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), (F.floor(F.col("value") * 1000) * F.lit(100_000)).cast("bigint").alias("dur")))


# a stack isn't a count of open intervals where they cross; tested against brute force
plain("trace_depth", _depths, None)
def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, line = star.table(spark, sf_dir, "orders"), star.table(spark, sf_dir, "lineitem")
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    defs = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file_path"), day("o_orderdate").alias("first_line"), (day("o_orderdate") + 30).alias("end_line"))
    asked = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("file_path"), day("l_shipdate").alias("line"))
    return lookup.bind_lines(defs, asked)


plain("node_at", spans, """
WITH d AS (SELECT o_orderkey AS id, o_custkey AS f, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS a FROM orders),
q AS (SELECT DISTINCT o_custkey AS f, datediff('day', DATE '1970-01-01', l_shipdate::DATE) AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
i AS (SELECT q.f, q.line, arg_min(d.id, (-d.a) * 1000000000 + d.id) AS id FROM q JOIN d ON d.f = q.f AND q.line BETWEEN d.a AND d.a + 30 GROUP BY ALL),
n AS (SELECT q.f, q.line, arg_min(d.id, d.a * 1000000000 + d.id) AS id FROM q JOIN d ON d.f = q.f AND d.a BETWEEN q.line + 1 AND q.line + 8 GROUP BY ALL)
SELECT q.f AS file_path, CAST(q.line AS INTEGER) AS line, coalesce(i.id, n.id) AS id FROM q LEFT JOIN i ON i.f = q.f AND i.line = q.line LEFT JOIN n ON n.f = q.f AND n.line = q.line""")  # fmt: skip
register(
    "execution_ledger", graph_of(lambda g: runtime.ledger(g.typed("calls").select(F.col("source").alias("node_id"), F.col("target").alias("test_id")), g.nodes, g.typed("contains"))),
    "SELECT source AS node_id, target AS test_id FROM edges WHERE type = 'calls' UNION SELECT c.source, e.target FROM edges e JOIN edges c ON c.type = 'contains' AND c.target = e.source WHERE e.type = 'calls'",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from strandline import catalog_runs  # noqa: F401  registers more

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from strandline import catalog_runs  # noqa: F401

    return dict(_SQL)
