"""The star schema as a property graph: roles from the tables, edges from their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandline.graph import PropertyGraph, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, *keys: str) -> Column:
    return F.concat(F.lit(prefix), F.concat_ws(".", *(F.col(k).cast("string") for k in keys)))


def graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    t = lambda name: table(spark, sf_dir, name)
    region, nation, supplier, customer, part = (t(x) for x in ("region", "nation", "supplier", "customer", "part"))
    orders, line = t("orders"), t("lineitem")
    sold = spread(line.select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey").distinct()

    def nodes(df: DataFrame, id_: Column, kind: str, name: Column, test: Column | None = None, path: Column | None = None) -> DataFrame:
        return df.select(id_.alias("id"), F.lit(kind).alias("type"), name.cast("string").alias("name"), name.cast("string").alias("display_name"), F.substring_index(id_, ":", 1).alias("domain"), (F.lit(False) if test is None else test).alias("is_test"), (F.lit(None).cast("string") if path is None else path).alias("file_path"))

    n = nodes(region, _id("geo:file:", "r_regionkey"), "file", F.col("r_name"))
    for more in (
        nodes(nation, _id("geo:module:", "n_nationkey"), "module", F.col("n_name")),
        nodes(supplier, _id("sup:class:", "s_suppkey"), "class", F.col("s_name"), path=_id("nation/", "s_nationkey")),
        nodes(sold, _id("sup:method:", "l_suppkey", "l_partkey"), "method", F.concat_ws(".", "l_suppkey", "l_partkey")),
        nodes(part, _id("item:function:", "p_partkey"), "function", F.col("p_name"), path=_id("type/", "p_type")),
        nodes(customer, _id("cust:function:", "c_custkey"), "function", F.col("c_name"), F.expr("c_custkey % 5 = 0"), _id("nation/", "c_nationkey")),
        nodes(orders, _id("sale:order:", "o_orderkey"), "order", _id("order.", "o_orderkey")),
        nodes(part.select("p_brand").distinct(), _id("math:equation:", "p_brand"), "equation", F.col("p_brand")),
        nodes(part.select("p_type").distinct(), _id("item:tag:", "p_type"), "tag", F.col("p_type")),
        nodes(orders.select("o_orderpriority").distinct(), _id("vv:error:", "o_orderpriority"), "error", F.col("o_orderpriority")),
        nodes(t("events").filter("event_type is not null").select("event_type").distinct(), _id("vv:error:event.", "event_type"), "error", F.col("event_type")),
    ):
        n = n.unionByName(more)

    def edges(df: DataFrame, source: Column, target: Column, kind: str, **more: Column) -> DataFrame:
        return df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), *(more.get(c, F.lit(None)).cast(k).alias(c) for c, k in (("evidence", "string"), ("confidence", "double"), ("lineno", "int"), ("cases", "array<string>"))))

    item = _id("item:function:", "l_partkey")
    bought = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    tested = bought.filter("o_orderstatus = 'F' and o_custkey % 5 = 0").join(part, F.col("l_partkey") == F.col("p_partkey")).select("o_custkey", "p_brand")
    tested = spread(tested, "o_custkey", "p_brand").distinct()
    inferred = F.when(F.expr("p_size % 2 = 0"), "directive").otherwise("inferred")
    cases = line.select("l_partkey", "l_returnflag").distinct().groupBy("l_partkey").agg(F.array_sort(F.collect_list("l_returnflag")).alias("cases")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    told = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_regionkey", "l_partkey")
    told = spread(told, "n_regionkey", "l_partkey").distinct()
    e = edges(nation, _id("geo:file:", "n_regionkey"), _id("geo:module:", "n_nationkey"), "contains")
    for more in (
        edges(supplier, _id("geo:module:", "s_nationkey"), _id("sup:class:", "s_suppkey"), "contains"),
        edges(sold, _id("sup:class:", "l_suppkey"), _id("sup:method:", "l_suppkey", "l_partkey"), "contains"),
        edges(orders, _id("cust:function:", "o_custkey"), _id("sale:order:", "o_orderkey"), "calls"),
        edges(line, _id("sale:order:", "l_orderkey"), item, "calls", lineno=F.col("l_linenumber")),
        edges(sold, _id("sup:method:", "l_suppkey", "l_partkey"), item, "calls"),
        edges(part, _id("item:function:", "p_partkey"), _id("math:equation:", "p_brand"), "implements", evidence=inferred, confidence=F.when(F.expr("p_size % 2 = 0"), 1.0).otherwise(0.7)),
        edges(tested, _id("cust:function:", "o_custkey"), _id("math:equation:", "p_brand"), "tests", confidence=F.lit(1.0)),
        edges(orders.filter("o_custkey % 5 = 0").select("o_custkey", "o_orderpriority").distinct(), _id("cust:function:", "o_custkey"), _id("vv:error:", "o_orderpriority"), "catches"),
        edges(cases, _id("item:function:", "p_partkey"), _id("item:tag:", "p_type"), "discriminates_on", cases=F.col("cases")),
        edges(told, _id("geo:file:", "n_regionkey"), item, "documents"),
    ):
        e = e.unionByName(more)
    return PropertyGraph.of(n, e, {"root": sf_dir})


def _typed(df: DataFrame, source: Column, target: Column, kind: str) -> DataFrame:
    return df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"))


def basket_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Orders as classes, the parts in them as methods: an order conforms to another if it holds all of its parts."""
    held = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey").distinct()
    cls, method = _id("sale:class:", "l_orderkey"), _id("sale:method:", "l_orderkey", "l_partkey")
    n = held.select("l_orderkey").distinct().select(cls.alias("id"), F.lit("class").alias("type"), F.col("l_orderkey").cast("string").alias("name"))
    n = n.unionByName(held.select(method.alias("id"), F.lit("method").alias("type"), F.concat_ws(".", "l_orderkey", "l_partkey").alias("name")))
    return PropertyGraph.of(n, _typed(held, cls, method, "contains"))


def offer_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers as classes, their orders as methods, which call offers (part and supplier) as functions; a fifth of customers are tests."""
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    cls, method, fn = _id("py:class:", "o_custkey"), _id("py:method:", "o_orderkey"), _id("py:function:", "l_partkey", "l_suppkey")
    test = F.expr("o_custkey % 5 = 0")
    n = orders.select("o_custkey").distinct().select(cls.alias("id"), F.lit("class").alias("type"), F.expr("concat('m', o_custkey % 7, '.C', o_custkey)").alias("name"), F.lit(False).alias("is_test"))
    n = n.unionByName(orders.select(method.alias("id"), F.lit("method").alias("type"), F.col("o_orderkey").cast("string").alias("name"), test.alias("is_test")))
    offers = line.select("l_partkey", "l_suppkey").distinct()
    n = n.unionByName(offers.select(fn.alias("id"), F.lit("function").alias("type"), F.expr("concat('m', l_partkey % 7, '.', if(l_suppkey % 3 = 0, '_f', 'f'), l_partkey)").alias("name"), F.lit(False).alias("is_test")))
    e = _typed(orders, cls, method, "contains").unionByName(_typed(line, _id("py:method:", "l_orderkey"), fn, "calls"))
    return PropertyGraph.of(n, e)


def page_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Web pages as modules by their path, and what they link to; a link that no page answers to is a placeholder."""
    pages = table(spark, sf_dir, "pages")
    path = F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1)
    link = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    own = pages.filter(path != "").select(path.alias("path")).distinct()
    links = pages.select("page_id", link.alias("path"))
    missing = links.select("path").distinct().join(own, "path", "left_anti")
    target = F.concat(F.lit("py:page:site."), "path")
    n = own.select(target.alias("id"), F.lit("module").alias("type"), F.concat(F.lit("site."), "path").alias("name"))
    n = n.unionByName(missing.select(target.alias("id"), F.lit("unresolved").alias("type"), F.concat(F.lit("site."), "path").alias("name")))
    n = n.unionByName(pages.select("page_id").distinct().select(_id("doc:file:", "page_id").alias("id"), F.lit("file").alias("type"), F.col("page_id").cast("string").alias("name")))
    return PropertyGraph.of(n, links.select(_id("doc:file:", "page_id").alias("source"), target.alias("target"), F.lit("references").alias("type")))


#: The same graph in DuckDB, as the head of a WITH clause.
SQL = """
sold AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
nodes AS (
  SELECT 'geo:file:' || r_regionkey AS id, 'file' AS type, r_name AS name, false AS is_test, NULL AS file_path FROM region
  UNION ALL SELECT 'geo:module:' || n_nationkey, 'module', n_name, false, NULL FROM nation
  UNION ALL SELECT 'sup:class:' || s_suppkey, 'class', s_name, false, 'nation/' || s_nationkey FROM supplier
  UNION ALL SELECT 'sup:method:' || l_suppkey || '.' || l_partkey, 'method', l_suppkey || '.' || l_partkey, false, NULL FROM sold
  UNION ALL SELECT 'item:function:' || p_partkey, 'function', p_name, false, 'type/' || p_type FROM part
  UNION ALL SELECT 'cust:function:' || c_custkey, 'function', c_name, c_custkey % 5 = 0, 'nation/' || c_nationkey FROM customer
  UNION ALL SELECT 'sale:order:' || o_orderkey, 'order', 'order.' || o_orderkey, false, NULL FROM orders
  UNION ALL SELECT DISTINCT 'math:equation:' || p_brand, 'equation', p_brand, false, NULL FROM part
  UNION ALL SELECT DISTINCT 'item:tag:' || p_type, 'tag', p_type, false, NULL FROM part
  UNION ALL SELECT DISTINCT 'vv:error:' || o_orderpriority, 'error', o_orderpriority, false, NULL FROM orders
  UNION ALL SELECT DISTINCT 'vv:error:event.' || event_type, 'error', event_type, false, NULL FROM events WHERE event_type IS NOT NULL),
edges AS (
  SELECT 'geo:file:' || n_regionkey AS source, 'geo:module:' || n_nationkey AS target, 'contains' AS type, NULL AS evidence FROM nation
  UNION ALL SELECT 'geo:module:' || s_nationkey, 'sup:class:' || s_suppkey, 'contains', NULL FROM supplier
  UNION ALL SELECT 'sup:class:' || l_suppkey, 'sup:method:' || l_suppkey || '.' || l_partkey, 'contains', NULL FROM sold
  UNION ALL SELECT 'cust:function:' || o_custkey, 'sale:order:' || o_orderkey, 'calls', NULL FROM orders
  UNION ALL SELECT 'sale:order:' || l_orderkey, 'item:function:' || l_partkey, 'calls', NULL FROM lineitem
  UNION ALL SELECT 'sup:method:' || l_suppkey || '.' || l_partkey, 'item:function:' || l_partkey, 'calls', NULL FROM sold
  UNION ALL SELECT 'item:function:' || p_partkey, 'math:equation:' || p_brand, 'implements', CASE WHEN p_size % 2 = 0 THEN 'directive' ELSE 'inferred' END FROM part
  UNION ALL (SELECT DISTINCT 'cust:function:' || o_custkey, 'math:equation:' || p_brand, 'tests', NULL FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'F' AND o_custkey % 5 = 0)
  UNION ALL (SELECT DISTINCT 'cust:function:' || o_custkey, 'vv:error:' || o_orderpriority, 'catches', NULL FROM orders WHERE o_custkey % 5 = 0)
  UNION ALL (SELECT DISTINCT 'item:function:' || p_partkey, 'item:tag:' || p_type, 'discriminates_on', NULL FROM part JOIN lineitem ON l_partkey = p_partkey)
  UNION ALL (SELECT DISTINCT 'geo:file:' || n_regionkey, 'item:function:' || l_partkey, 'documents', NULL FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)),
deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id)
"""
