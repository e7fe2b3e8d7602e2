"""Points, neighbourhoods, search, statistics and hubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandline.graph import PropertyGraph, cut, is_placeholder, leaf, spread


def uncapped(df: DataFrame, limit: int) -> DataFrame:
    """A limit of 0 or less means all."""
    return df.limit(limit) if limit > 0 else df


def degree_of(g: PropertyGraph, ids: DataFrame) -> DataFrame:
    """(id, degree) of the nodes in ``ids``: edges are filtered by them before they are counted."""
    few = ids.select("id").distinct()
    ends = [g.edges.select(F.col(end).alias("id")).join(few, "id", "left_semi") for end in ("source", "target")]
    return ends[0].unionByName(ends[1]).groupBy("id").agg(F.count("*").alias("degree"))


def get_node(g: PropertyGraph, node_id: str) -> DataFrame:
    """The node with its degree; no row if there is none."""
    hit = g.nodes.filter(F.col("id") == node_id)
    ends = g.edges.filter((F.col("source") == node_id) | (F.col("target") == node_id))
    degree = ends.agg(F.coalesce(F.sum((F.col("source") == node_id).cast("long") + (F.col("target") == node_id).cast("long")), F.lit(0)).alias("degree"))
    return hit.select("id", "type", "name", "domain", "file_path", "is_test").crossJoin(degree)


def neighbors(g: PropertyGraph, node_id: str, direction: str = "both", edge_types: tuple[str, ...] = ()) -> DataFrame:
    """(neighbor, edge_type, direction, times): incident edges, parallel ones counted; a loop appears both ways."""
    e = g.typed(*edge_types)
    out = e.filter(F.col("source") == node_id).select(F.col("target").alias("neighbor"), F.col("type").alias("edge_type"), F.lit("out").alias("direction"))
    back = e.filter(F.col("target") == node_id).select(F.col("source").alias("neighbor"), F.col("type").alias("edge_type"), F.lit("in").alias("direction"))
    rows = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return rows.groupBy("neighbor", "edge_type", "direction").agg(F.count("*").alias("times"))


def ranked(g: PropertyGraph, rows: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with place, test and degree, by which answers are ordered: placeholders and tests last, hubs first."""
    facts = g.nodes.select(F.col("id").alias(id_col), is_placeholder(F.col("type")).alias("is_placeholder"), F.coalesce("in_test_file", "is_test", F.lit(False)).alias("is_test_tree"))
    return rows.join(facts, id_col, "left").join(degree_of(g, rows.select(F.col(id_col).alias("id"))).withColumnRenamed("id", id_col), id_col, "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def context(g: PropertyGraph, node_id: str, per_type_limit: int = 25) -> DataFrame:
    """Neighbours by direction and edge type, the best of each, with how many were left out."""
    rows = ranked(g, neighbors(g, node_id), "neighbor")
    bucket = W.partitionBy("direction", "edge_type")
    order = bucket.orderBy("is_placeholder", "is_test_tree", F.desc("degree"), "neighbor")
    out = rows.withColumn("place", F.row_number().over(order)).withColumn("of", F.count("*").over(bucket))
    out = out.filter(F.col("place") <= per_type_limit) if per_type_limit > 0 else out
    return out.select("direction", "edge_type", "place", "neighbor", "times", "degree", (F.greatest(F.col("of") - per_type_limit, F.lit(0)) if per_type_limit > 0 else F.lit(0)).cast("long").alias("omitted"))


def tokens_of(text: str) -> list[str]:
    import re

    return [t for t in re.split(r"[\s_.:]+", text.lower()) if t]


def search(g: PropertyGraph, text: str, node_types: tuple[str, ...] = (), limit: int = 20) -> DataFrame:
    """Nodes whose id, name or display name hold every token; an empty question finds nothing."""
    tokens = tokens_of(text)
    hay = F.regexp_replace(F.lower(F.concat_ws(" ", "id", "name", "display_name")), "[_.:]+", " ")
    hit = F.lit(bool(tokens))
    for t in tokens:
        hit = hit & F.contains(hay, F.lit(t))
    n = g.nodes.filter(hit)
    n = n.filter(F.col("type").isin(*node_types)) if node_types else n
    n = n.join(degree_of(g, n), "id", "left").select("id", "type", "name", F.coalesce("degree", F.lit(0)).alias("degree"))
    return uncapped(n.orderBy(F.desc("degree"), "id"), limit)


def count_by(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def stats(g: PropertyGraph) -> DataFrame:
    """One row: nodes, edges, density of the directed multigraph, loops and parallel edges."""
    e = g.edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum((F.col("source") == F.col("target")).cast("long")), F.lit(0)).alias("loops"))
    pairs = spread(g.edges.select("source", "target", "type"), "source", "target").distinct().agg(F.count("*").alias("pairs"))
    n = g.nodes.agg(F.count("*").alias("nodes"))
    density = F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    return n.crossJoin(e).crossJoin(pairs).select("nodes", "edges", "loops", (F.col("edges") - F.col("pairs")).alias("parallel"), F.round(density, 9).alias("density"))


def node_degrees(g: PropertyGraph) -> DataFrame:
    """(id, domain, type, degree) of every node, written once for those that ask several things of it."""
    return cut(g.nodes.join(g.degree(), "id", "left").select("id", F.coalesce("domain", F.lit("")).alias("domain"), "type", F.coalesce("degree", F.lit(0)).alias("degree")))


def god_nodes(g: PropertyGraph, top_n: int = 10, include_placeholders: bool = False, degrees: DataFrame | None = None) -> DataFrame:
    """The nodes of highest degree, placeholders left out unless they are asked for."""
    keep = F.lit(True) if include_placeholders else ~is_placeholder(F.col("type"))
    d = g.degree().join(g.nodes.filter(keep).select("id", "type"), "id") if degrees is None else degrees.filter(keep & (F.col("degree") > 0))
    return uncapped(d.select("id", "type", "degree").orderBy(F.desc("degree"), "id"), top_n)


def id_grammar(g: PropertyGraph, degrees: DataFrame | None = None) -> DataFrame:
    """(domain, type, example, n): the middle node by degree of each kind.

    Its degree is found by counts, its place among equals by counts of ranges of
    ids: only the nodes of one range of each kind are sorted.
    """
    d = node_degrees(g) if degrees is None else degrees
    kind = W.partitionBy("domain", "type")

    def holding(counts: DataFrame, by: str, place: Column) -> DataFrame:
        """The row of each kind that holds ``place``, counted from 0 in the order of ``by``, with the place in that row."""
        before = F.coalesce(F.sum("c").over(kind.orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        t = counts.withColumn("n", F.sum("c").over(kind)).withColumn("before", before).withColumn("k", place - F.col("before"))
        return t.filter("k between 0 and c - 1")

    def within(rows: DataFrame, few: DataFrame, by: str) -> DataFrame:
        few = F.broadcast(few.select(F.col("domain").alias("__domain"), F.col("type").alias("__type"), F.col(by).alias("__by"), "k", "n"))  # a row for each kind
        return rows.join(few, (F.col("domain") == F.col("__domain")) & F.col("type").eqNullSafe(F.col("__type")) & (F.col(by) == F.col("__by"))).drop("__domain", "__type", "__by")

    same = within(d, holding(d.groupBy("domain", "type", "degree").agg(F.count("*").alias("c")), "degree", F.expr("n div 2")), "degree")
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut(same.select("domain", "type", "id", F.col("k").alias("place"), F.col("n").alias("of")).repartitionByRange(parts, "domain", "type", "id").withColumn("part", F.spark_partition_id()))
    counts = ranges.groupBy("domain", "type", "part").agg(F.count("*").alias("c"), F.first("place").alias("place"))
    last = within(ranges, holding(counts, "part", F.col("place")), "part")
    return last.withColumn("i", F.row_number().over(kind.orderBy("id"))).filter("i = k + 1").select("domain", "type", F.col("id").alias("example"), F.col("of").alias("n"))


def unresolved_callers(g: PropertyGraph) -> DataFrame:
    """(leaf, calls, spellings): calls of placeholders by the last part of their name."""
    ends = g.nodes.filter(is_placeholder(F.col("type"))).select(F.col("id").alias("target"), "name")
    by = g.typed("calls").join(ends, "target").groupBy(leaf(F.col("name")).alias("leaf"), "name").agg(F.count("*").alias("n"))
    return by.groupBy("leaf").agg(F.sum("n").alias("calls"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("name").alias("v")))), lambda x: x["v"]), ", ").alias("spellings"))


def file_brief(g: PropertyGraph, file_path: str) -> DataFrame:
    """(id, type, degree, external_callers, equations) of a file's nodes."""
    inside = g.nodes.filter(F.col("file_path") == file_path).select("id", "type")
    ext = g.typed("calls").join(inside.select(F.col("id").alias("target")), "target", "left_semi").join(inside.select(F.col("id").alias("source")), "source", "left_anti").groupBy(F.col("target").alias("id")).agg(F.count_distinct("source").alias("external_callers"))
    eq = g.typed("implements").groupBy(F.col("source").alias("id")).agg(F.count_distinct("target").alias("equations"))
    return inside.join(degree_of(g, inside), "id", "left").join(ext, "id", "left").join(eq, "id", "left").fillna(0, ["degree", "external_callers", "equations"])


def brief_summary(g: PropertyGraph, file_path: str) -> DataFrame:
    """One row on a file: nodes, equations its code implements, declared tests of them, pages that document it, and what its tests claim."""
    inside = g.nodes.filter(F.col("file_path") == file_path)
    ids = inside.select("id").distinct()
    eq = g.typed("implements").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("equation")).distinct()
    tests = g.typed("tests").join(eq.withColumnRenamed("equation", "target"), "target", "left_semi")
    pages = g.typed("documents", "contains").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").join(g.nodes.filter("type = 'file'").select(F.col("id").alias("source")), "source", "left_semi")
    by_page = pages.groupBy("source").agg(F.count("*").alias("refs"))
    claims = inside.filter("is_test")
    gate = claims.agg(F.count("*").alias("gate_tests"), F.array_join(F.array_sort(F.collect_set("vv_level")), ",").alias("levels"), F.size(F.array_distinct(F.flatten(F.collect_list(F.coalesce("verifies", F.array().cast("array<string>")))))).cast("long").alias("claimed"))
    caught = g.typed("catches").join(claims.select(F.col("id").alias("source")), "source", "left_semi")
    parts = (
        ids.agg(F.count("*").alias("nodes")), eq.agg(F.count("*").alias("equations")), tests.agg(F.count("*").alias("tests")),
        by_page.agg(F.count("*").alias("pages"), F.min_by("source", F.struct(-F.col("refs"), "source")).alias("first_page")), gate, caught.agg(F.count_distinct("target").alias("caught")),
    )
    out = parts[0]
    for one in parts[1:]:  # one row each
        out = out.crossJoin(F.broadcast(one))
    return out


def test_facts(g: PropertyGraph) -> DataFrame:
    """(id, runnable, vv_level, verifies, catches) of test functions and methods; the runnable id is what a runner takes."""
    stem = F.regexp_extract("file_path", r"([^/]+)\.py$", 1)
    at = F.expr("instr(concat('.', name), concat('.', __stem, '.'))")
    rest = F.when((F.col("__stem") != "") & (at > 0), F.expr("substring(name, instr(concat('.', name), concat('.', __stem, '.')) + length(__stem) + 1)")).otherwise(leaf(F.col("name")))
    t = g.nodes.filter("is_test and type in ('function', 'method')").withColumn("__stem", F.coalesce(stem, F.lit("")))
    runnable = F.when(F.col("file_path").isNotNull(), F.concat("file_path", F.lit("::"), F.replace(rest, F.lit("."), F.lit("::"))))
    none = F.array().cast("array<string>")
    return t.select("id", runnable.alias("runnable"), "vv_level", F.array_join(F.coalesce("verifies", none), ",").alias("verifies"), F.array_join(F.coalesce("catches", none), ",").alias("catches"))


def ranked_neighbors(g: PropertyGraph, node_id: str, direction: str = "both", edge_types: tuple[str, ...] = (), limit: int = 0, offset: int = 0) -> DataFrame:
    """``neighbors`` in the order of answers, with place and total: placeholders last, tests last unless a test asks, hubs first."""
    rows = ranked(g, neighbors(g, node_id, direction, edge_types), "neighbor")
    asks = g.nodes.filter(F.col("id") == node_id).agg(F.coalesce(F.max(F.coalesce("in_test_file", "is_test")), F.lit(False)).alias("__asks"))
    rows = rows.crossJoin(F.broadcast(asks)).withColumn("is_test_tree", F.col("is_test_tree") & ~F.col("__asks"))
    order = ["is_placeholder", "is_test_tree", F.desc("degree"), "neighbor", "edge_type", "direction"]
    return page(rows.select("neighbor", "edge_type", "direction", "times", "degree", "is_placeholder", "is_test_tree"), order, limit, offset).drop("is_placeholder", "is_test_tree")


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """``limit`` rows (0 or less: all) after ``offset`` in ``order``, each with the ``total`` of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    some = rows.orderBy(*order).offset(offset) if offset else rows.orderBy(*order)
    return uncapped(some, limit).crossJoin(F.broadcast(total))


def callers_with_blind_spots(g: PropertyGraph, node_id: str) -> DataFrame:
    """(id, kind, calls): a node's direct callers, and calls of placeholders that have its last name."""
    own = g.nodes.filter(F.col("id") == node_id).select(leaf(F.col("name")).alias("leaf"))
    direct = g.typed("calls").filter(F.col("target") == node_id).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("calls")).withColumn("kind", F.lit("caller"))
    blind = unresolved_callers(g).join(own, "leaf").select(F.col("spellings").alias("id"), F.lit("unresolved").alias("kind"), "calls")
    return direct.select("id", "kind", "calls").unionByName(blind)


def bind_lines(definitions: DataFrame, lines: DataFrame, window: int = 8) -> DataFrame:
    """(file_path, line, id): the innermost definition around each line; else the nearest that begins within ``window`` lines below; else null.

    ``definitions`` has id, file_path, first_line and end_line.  The smallest
    extent wins, of equals the latest to begin.
    """
    asked = lines.select("file_path", "line").distinct()
    inside = asked.join(definitions, "file_path").filter("line between first_line and end_line")
    inner = inside.groupBy("file_path", "line").agg(F.min_by("id", F.struct(F.col("end_line") - F.col("first_line"), -F.col("first_line"), F.col("id"))).alias("inner"))
    ahead = asked.join(inner, ["file_path", "line"], "left_anti").join(definitions, "file_path").filter(F.col("first_line").between(F.col("line") + 1, F.col("line") + window))
    near = ahead.groupBy("file_path", "line").agg(F.min_by("id", F.struct("first_line", "id")).alias("near"))
    return asked.join(inner, ["file_path", "line"], "left").join(near, ["file_path", "line"], "left").select("file_path", "line", F.coalesce("inner", "near").alias("id"))
