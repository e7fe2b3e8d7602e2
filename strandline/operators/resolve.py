"""Merging graphs, resolving placeholders, and edges declared or inferred from markers and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from strandline.graph import EDGE_SCHEMA, NODE_SCHEMA, TYPE_RANK, PropertyGraph, conform, is_placeholder, leaf


def type_rank(kind):
    return reduce(lambda acc, kv: F.when(F.coalesce(kind, F.lit("")) == kv[0], kv[1]).otherwise(acc), TYPE_RANK.items(), F.lit(99))


def merge_graphs(doc: PropertyGraph, code: PropertyGraph) -> PropertyGraph:
    """One node for each id: code's values where it has any, the more concrete type; all edges of both."""
    a, b = doc.nodes.alias("a"), code.nodes.alias("b")
    full = a.join(b, F.col("a.id") == F.col("b.id"), "full_outer")

    def pick(f):
        old, new = F.col(f"a.{f.name}"), F.col(f"b.{f.name}")
        if f.name == "type":
            return F.when(type_rank(new) <= type_rank(old), F.coalesce(new, old)).otherwise(F.coalesce(old, new)).alias("type")
        return (F.when(new.isNotNull() & (new != ""), new).otherwise(F.coalesce(old, new)) if f.dataType.simpleString() == "string" else F.coalesce(new, old)).alias(f.name)

    return PropertyGraph(full.select(*(pick(f) for f in NODE_SCHEMA.fields)), doc.edges.unionByName(code.edges), {**doc.metadata, **code.metadata})


def remap(g: PropertyGraph, mapping: DataFrame) -> PropertyGraph:
    """Fold nodes ``old`` into ``new``: edges move, the old nodes go."""
    m = mapping.select("old", "new")
    e = g.edges
    for end in ("source", "target"):
        e = e.join(m.select(F.col("old").alias(end), F.col("new").alias("__new")), end, "left").withColumn(end, F.coalesce("__new", end)).drop("__new")
    return PropertyGraph(g.nodes.join(m.select(F.col("old").alias("id")), "id", "left_anti"), e.select(*EDGE_SCHEMA.fieldNames()), g.metadata)


def reconcile(g: PropertyGraph) -> PropertyGraph:
    """Fold unresolved nodes into the node of the same full name, else of a dotted suffix, unless several are equally good.

    A node of the test tree is only taken if all that refer to it are tests.
    """
    real = g.nodes.filter(~is_placeholder(F.col("type")))
    parts = F.split("name", r"\.")
    suffixes = real.select("id", "type", "name", "file_path", F.coalesce("in_test_file", F.lit(False)).alias("in_test"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("suffix"))
    open_ = g.nodes.filter("type = 'unresolved'").select(F.col("id").alias("old"), F.col("name").alias("suffix"))
    outside = g.edges.join(real.select(F.col("id").alias("source"), F.coalesce("in_test_file", F.lit(False)).alias("t")), "source", "left").groupBy(F.col("target").alias("old")).agg(F.max(~F.coalesce("t", F.lit(False))).alias("outside"))
    cand = open_.join(suffixes, "suffix").join(outside, "old", "left").filter(~(F.col("in_test") & F.coalesce("outside", F.lit(False))))
    first = F.struct((F.col("name") != F.col("suffix")).alias("partial"), type_rank(F.col("type")).alias("rank"), F.col("file_path").isNull().alias("nofile"))
    w = W.partitionBy("old")
    best = cand.withColumn("k", first).withColumn("best", F.min("k").over(w)).filter("k = best").withColumn("n", F.count("*").over(w)).filter("n = 1")
    return remap(g, best.select("old", F.col("id").alias("new")))


def chase(reexports: DataFrame, most: int = 10) -> DataFrame:
    """(public, defining) with chains of re-exports followed; cycles end where they began."""
    now = reexports.select("public", "defining").dropDuplicates(["public"])
    step = now.select(F.col("public").alias("defining"), F.col("defining").alias("further"))
    for _ in range(most):
        now = now.join(step, "defining", "left").select("public", F.when(F.col("further").isNotNull() & (F.col("further") != F.col("public")), F.col("further")).otherwise(F.col("defining")).alias("defining"))
    return now


def marker_edges(g: PropertyGraph, marker: str, kind: str, prefix: str) -> DataFrame:
    """Edges for marker arrays (verifies, catches) whose target exists and that aren't there yet."""
    rows = g.nodes.select(F.col("id").alias("source"), F.explode(marker).alias("label")).select("source", F.concat(F.lit(prefix), "label").alias("target"), F.lit(kind).alias("type"), F.lit("marker").alias("evidence"), F.lit(1.0).alias("confidence"))
    rows = rows.distinct().join(g.nodes.select(F.col("id").alias("target")), "target", "left_semi").join(g.edges.select("source", "target", "type"), ["source", "target", "type"], "left_anti")
    return conform(rows, EDGE_SCHEMA)


def infer_implements(g: PropertyGraph, pages: DataFrame, least: int = 3) -> DataFrame:
    """Equations and code of one page whose names share a token of at least three letters.

    ``pages`` has page and id.  Declared equations, tests and the test tree are left out.
    """
    tokens = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), r"[-_.:\s]+")), lambda t: F.length(t) >= least)
    n = g.nodes.join(pages, "id").select("page", "id", "type", F.explode(tokens(leaf(F.col("name")))).alias("token"), F.coalesce("in_test_file", "is_test", F.lit(False)).alias("test"))
    eq = n.filter("type in ('equation', 'proof_object')").join(g.typed("implements").select(F.col("target").alias("id")), "id", "left_anti").select("page", F.col("id").alias("target"), "token")
    code = n.filter("type in ('function', 'method', 'class') and not test").select("page", F.col("id").alias("source"), "token")
    found = eq.join(code, ["page", "token"]).groupBy("source", "target").agg(F.array_sort(F.collect_set("token")).alias("cases"))
    return conform(found.join(g.typed("tests").select("source", "target"), ["source", "target"], "left_anti").withColumns({"type": F.lit("implements"), "evidence": F.lit("inferred"), "confidence": F.lit(0.7)}), EDGE_SCHEMA)


def drop_inline_math(g: PropertyGraph) -> PropertyGraph:
    """Without references of inline mathematics to equations that nothing declares, and what only they held."""
    undeclared = g.nodes.filter(is_placeholder(F.col("type"))).select(F.col("id").alias("target"))
    bad = g.edges.filter("reftype = 'math'").join(undeclared, "target", "left_semi")
    kept = g.edges.join(bad.select("source", "target", "type", "reftype").distinct(), ["source", "target", "type", "reftype"], "left_anti").select(*EDGE_SCHEMA.fieldNames())
    orphans = bad.select(F.col("target").alias("id")).distinct().join(kept.select(F.explode(F.array("source", "target")).alias("id")), "id", "left_anti")
    return PropertyGraph(g.nodes.join(orphans, "id", "left_anti"), kept, g.metadata)


def check_edges(g: PropertyGraph, ontology: DataFrame) -> DataFrame:
    """(type, end, kind, n): edges whose ends aren't of the types that ``ontology`` (type, domain, range) allows; null allows all."""
    e = g.edges.join(ontology, "type")
    kinds = g.nodes.select("id", F.col("type").alias("kind"))
    out = None
    for end, allowed in (("source", "domain"), ("target", "range")):
        bad = e.join(kinds.withColumnRenamed("id", end), end).filter(F.col(allowed).isNotNull() & ~F.array_contains(allowed, F.col("kind"))).groupBy("type", F.lit(end).alias("end"), "kind").agg(F.count("*").alias("n"))
        out = bad if out is None else out.unionByName(bad)
    return out
