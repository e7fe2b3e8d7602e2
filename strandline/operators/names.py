"""Finding what a name means: ranked candidates, relative references, folding placeholders, re-exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandline.functions.text import module_of, prefixes_of, top_segment
from strandline.graph import EDGE_SCHEMA, PropertyGraph, cut, is_placeholder, leaf, name_of
from strandline.operators.resolve import remap, type_rank

#: Types of definitions that a placeholder may be folded into.
DEFINED = ("class", "function", "method", "module", "attribute", "type", "data")
#: Prefixes of ids in the order of a lookup that has no preference.
PREFIXES = tuple(f"py:{t}:" for t in ("class", "exception", "method", "function", "attribute", "data", "type", "module"))


def candidate_rank(kind: Column, file_path: Column, name: Column, node_id: Column, preference: Column | None = None) -> Column:
    """Order of candidates, the least is the best.

    A definition before a placeholder, what the role asks for, the more concrete
    type, one with a file; these four decide.  The shorter name and the id only
    make the order total.
    """
    kind_of = F.struct(is_placeholder(kind).cast("int").alias("p"), (F.lit(0) if preference is None else preference).alias("o"), type_rank(kind).alias("t"), file_path.isNull().cast("int").alias("f"))
    return F.struct(kind_of.alias("what"), F.length(name).alias("n"), node_id.alias("id"))


def overlap(a: Column, b: Column) -> Column:
    """Whether the modules of two dotted names begin or end alike: one is the other's head or tail."""
    p, c = (F.when(F.contains(x, F.lit(".")), F.split(module_of(x), r"\.")).otherwise(F.array().cast("array<string>")) for x in (a, b))
    n, m = F.size(p), F.size(c)
    short, long, k, most = F.when(n <= m, p).otherwise(c), F.when(n <= m, c).otherwise(p), F.least(n, m), F.greatest(n, m)
    return (k > 0) & ((F.slice(long, F.lit(1), F.greatest(k, F.lit(1))) == short) | (F.slice(long, F.greatest(most - k + 1, F.lit(1)), F.greatest(k, F.lit(1))) == short))


def chase(names: DataFrame, reexports: DataFrame, most: int = 32) -> DataFrame:
    """(name, resolved): names with re-exports followed, of the whole name or of its longest exported prefix.

    ``reexports`` has public and defining.  A chain that comes back ends there.
    """
    step = reexports.select("public", "defining").dropDuplicates(["public"])
    now = cut(names.select("name").distinct().select("name", F.col("name").alias("at"), F.array("name").alias("seen"), F.lit(False).alias("done")))
    for _ in range(most):
        tries = now.filter("not done").select("name", "at", F.posexplode(F.concat(F.array("at"), prefixes_of(F.col("at")))).alias("place", "public"))
        hit = tries.join(step, "public").groupBy("name").agg(F.min_by(F.concat("defining", F.expr("substring(at, length(public) + 1)")), "place").alias("next"))
        if hit.isEmpty():
            break
        to = F.coalesce("next", "at")
        now = cut(now.join(hit, "name", "left").select("name", to.alias("at"), F.array_append("seen", to).alias("seen"), (F.col("done") | F.col("next").isNull() | F.array_contains("seen", to)).alias("done")))
    return now.select("name", F.col("at").alias("resolved"))


def resolve_targets(g: PropertyGraph, refs: DataFrame) -> DataFrame:
    """(ref, id): the node that each reference means; null if there is none.

    ``refs`` has ref, domain, reftype, target and objtypes (those of the role, the
    preferred first).  Pages, equations, numbers and statements have ids of their
    own; else a definition of that very name, then the best whose name ends in it,
    then a placeholder of that name.  A reference needs an answer: of equally good
    candidates the first by name and id is taken.
    """
    r = refs.select("ref", "domain", "reftype", "target", F.array_distinct(F.concat(F.array("reftype"), F.coalesce("objtypes", F.array().cast("array<string>")))).alias("objtypes"))
    eq, section = F.concat(F.lit("math:equation:"), "target"), F.concat(F.lit("std:section:"), "target")
    own = (
        F.when(F.col("reftype") == "doc", F.array(F.concat(F.lit("doc:file:"), "target"))).when(F.col("reftype") == "eq", F.array(eq))
        .when(F.col("reftype") == "numref", F.array(eq, section)).when(F.col("domain") == "prf", F.array(F.concat(F.lit("prf:proof_object:"), "target")))
    )
    ids = g.nodes.select("id")
    special = r.select("ref", F.posexplode(own).alias("place", "id")).join(ids, "id", "left_semi").groupBy("ref").agg(F.min_by("id", "place").alias("own"))
    closed = F.col("reftype").isin("doc", "eq") | (F.col("domain") == "prf")
    asked = r.filter(~closed).select("ref", "domain", "target", F.posexplode("objtypes").alias("o", "objtype"))
    n = g.nodes.select("id", "type", "file_path", F.split("id", ":", 3).alias("__parts")).filter(F.size("__parts") == 3)
    n = n.select("id", "type", "file_path", F.col("__parts")[0].alias("domain"), F.col("__parts")[1].alias("objtype"), F.col("__parts")[2].alias("name"))
    parts = F.split("name", r"\.")
    tails = n.withColumn("target", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))))
    cand = asked.join(tails, ["domain", "objtype", "target"]).withColumn("exact", F.col("name") == F.col("target"))
    real = ~is_placeholder(F.col("type"))
    key = candidate_rank(F.col("type"), F.col("file_path"), F.col("name"), F.col("id"), F.col("o"))
    best = cand.groupBy("ref").agg(
        F.min_by("id", F.when(F.col("exact") & real, F.col("o"))).alias("same"), F.min(F.when(real, key)).alias("real"), F.min_by("id", F.when(F.col("exact") & ~real, F.col("o"))).alias("tomb"), F.min(key).alias("any")
    )
    return r.select("ref").distinct().join(special, "ref", "left").join(best, "ref", "left").select("ref", F.coalesce("own", "same", F.col("real")["id"], "tomb", F.col("any")["id"]).alias("id"))


def namespaces(g: PropertyGraph, most: int = 4) -> DataFrame:
    """(id, module, class): what a relative name in a node's text is relative to, up the ``contains`` edges of code."""
    n = g.nodes.select(F.col("id").alias("at"), "type", "name")
    up = g.typed("contains").filter(F.startswith("source", F.lit("py:"))).groupBy(F.col("target").alias("at")).agg(F.min("source").alias("parent"))
    now = g.nodes.select("id", F.col("id").alias("at"), F.lit("").alias("module"), F.lit("").alias("class"))
    for _ in range(most):
        t = now.join(n, "at", "left").join(up, "at", "left")
        module = F.when((F.col("module") == "") & (F.col("type") == "module"), F.coalesce("name", F.lit(""))).otherwise(F.col("module"))
        cls = F.when((F.col("module") == "") & (F.col("type") == "class"), leaf(F.col("name"))).otherwise(F.col("class"))
        now = t.select("id", F.when(module == "", F.col("parent")).alias("at"), module.alias("module"), cls.alias("class"))
    return now.select("id", "module", "class")


def resolve_relative(g: PropertyGraph) -> PropertyGraph:
    """Edges to placeholders of code led to what the name means where it stands.

    ``module.class.name``, ``module.name`` and the name as it is are tried, each
    with the prefixes of ids, that of the role first.  The edge moves, not the
    node: others may mean something else by it.  Placeholders left alone go.
    """
    open_ = g.nodes.filter(is_placeholder(F.col("type")) & F.startswith("id", F.lit("py:")) & (F.coalesce("name", F.lit("")) != "")).select(F.col("id").alias("target"), "name")
    asked = g.edges.select("source", "target").distinct().join(open_, "target").join(namespaces(g).withColumnRenamed("id", "source"), "source").filter("module <> ''")
    prefix = F.regexp_extract("target", r"^(py:[^:]*:)", 1)
    known = F.array(*(F.lit(p) for p in PREFIXES))
    prefixes = F.when(F.array_contains(known, prefix), F.concat(F.array(prefix), F.array_remove(known, prefix))).otherwise(known)
    dotted = lambda *x: F.concat_ws(".", *x)
    names = F.concat(F.when(F.col("class") != "", F.array(dotted("module", "class", "name"))).otherwise(F.array().cast("array<string>")), F.array(dotted("module", "name"), F.col("name")))
    tries = asked.select("source", "target", F.posexplode(F.flatten(F.transform(names, lambda x: F.transform(prefixes, lambda p: F.concat(p, x))))).alias("place", "id"))
    real = g.nodes.filter(~is_placeholder(F.col("type"))).select("id")
    found = cut(tries.join(real, "id", "left_semi").groupBy("source", "target").agg(F.min_by("id", "place").alias("__to")))
    e = g.edges.join(found, ["source", "target"], "left").withColumn("target", F.coalesce("__to", "target")).select(*EDGE_SCHEMA.fieldNames())
    left = found.select(F.col("target").alias("id")).distinct().join(e.select(F.explode(F.array("source", "target")).alias("id")), "id", "left_anti")
    return PropertyGraph(g.nodes.join(left, "id", "left_anti"), e, g.metadata)


def upgrade_types(g: PropertyGraph) -> PropertyGraph:
    """Nodes whose id names a kind of definition and that have a file are of that kind, whatever an earlier step called them."""
    kind = F.regexp_extract("id", rf"^py:({'|'.join(DEFINED)}):", 1)
    type_ = F.when((F.coalesce("file_path", F.lit("")) != "") & (kind != "") & ~F.coalesce(F.col("type").isin(*DEFINED), F.lit(False)), kind).otherwise(F.col("type"))
    return PropertyGraph(g.nodes.withColumn("type", type_), g.edges, g.metadata)


def fold_candidates(g: PropertyGraph, reexports: DataFrame | None = None) -> DataFrame:
    """(old, new): placeholders with the one definition that they can mean.

    The definition at the end of the name's re-exports; else one with the same
    last part whose module begins or ends alike, for a bare name any.  Test code
    isn't taken if other code refers to the name.  Of candidates that differ in
    name and id only, none is.
    """
    open_ = g.nodes.filter(is_placeholder(F.col("type")) & (F.coalesce("name", F.lit("")) != "")).select(F.col("id").alias("old"), "name")
    real = g.nodes.filter(F.col("type").isin(*DEFINED) & (F.coalesce("name", F.lit("")) != "")).select("id", "type", "file_path", F.col("name").alias("full"), F.coalesce("in_test_file", F.lit(False)).alias("in_test"))
    near = open_.join(real.withColumn("leaf", leaf(F.col("full"))), leaf(F.col("name")) == F.col("leaf")).filter(~F.contains("name", F.lit(".")) | overlap(F.col("name"), F.col("full"))).drop("leaf")
    if reexports is not None:
        chased = chase(open_, reexports).filter("resolved <> name")
        exact = open_.join(chased, "name").join(real, F.col("resolved") == F.col("full")).drop("resolved")
        near = exact.unionByName(near.join(exact.select("old").distinct(), "old", "left_anti"))
    tests = g.nodes.select(F.col("id").alias("source"), F.coalesce("in_test_file", F.lit(False)).alias("t"))
    outside = g.edges.join(tests, "source", "left").groupBy(F.col("target").alias("old")).agg(F.max(~F.coalesce("t", F.lit(False))).alias("outside"))
    cand = near.join(outside, "old", "left").filter(~(F.col("in_test") & F.coalesce("outside", F.lit(False))))
    w = W.partitionBy("old")
    cand = cand.withColumn("key", candidate_rank(F.col("type"), F.col("file_path"), F.col("full"), F.col("id")))
    best = cand.withColumn("best", F.min("key.what").over(w)).filter("key.what = best").groupBy("old").agg(F.count("*").alias("n"), F.min("id").alias("new"))
    return best.filter("n = 1").select("old", "new")


def canonicalize(g: PropertyGraph, reexports: DataFrame | None = None, most: int = 10) -> PropertyGraph:
    """Placeholders folded into the definitions that they mean, until none can be.

    A fold may take away the other code that kept a test definition from being
    meant, so it is repeated.
    """
    g = upgrade_types(g)
    for _ in range(most):
        found = cut(fold_candidates(g, reexports))
        if found.isEmpty():
            break
        g = remap(g, found)
        g = PropertyGraph(cut(g.nodes), cut(g.edges), g.metadata)
    return g


def project_tops(g: PropertyGraph) -> DataFrame:
    """(top): the first parts of the names of modules, which are the project's own."""
    return g.nodes.filter("type = 'module'").select(top_segment(F.coalesce("name", F.lit(""))).alias("top")).filter("top <> ''").distinct()


def classify(g: PropertyGraph, external: DataFrame) -> PropertyGraph:
    """Nodes without a type are unresolved if the project has their first part, external if ``external`` (name) has it, else unresolved."""
    name = name_of(F.col("id"))
    tops, names = project_tops(g).withColumn("__own", F.lit(True)), external.select(F.col("name").alias("__top")).distinct().withColumn("__out", F.lit(True))
    t = g.nodes.withColumn("__t", top_segment(name)).join(tops, F.col("__t") == F.col("top"), "left").join(names, F.col("__t") == F.col("__top"), "left")
    open_ = F.coalesce("type", F.lit("")).isin("", "unknown")
    kind = F.when(F.col("__own").isNull() & F.col("__out"), "external").otherwise("unresolved")
    first = F.when(F.contains("id", F.lit(":")), F.substring_index("id", ":", 1)).otherwise("py")
    t = t.withColumns({
        "name": F.when(open_, name).otherwise(F.col("name")), "display_name": F.when(open_, name).otherwise(F.col("display_name")),
        "domain": F.when(open_, first).otherwise(F.col("domain")), "type": F.when(open_, kind).otherwise(F.col("type")),
    })
    return PropertyGraph(t.select(*g.nodes.columns), g.edges, g.metadata)


def check_node_types(g: PropertyGraph, declared: list[str]) -> DataFrame:
    """(segment, n, example): type parts of ids that no vocabulary declares."""
    segment = F.split("id", ":", 3).getItem(1)
    t = g.nodes.filter(F.size(F.split("id", ":", 3)) == 3).select(segment.alias("segment"), "id").filter(~F.col("segment").isin(*declared))
    return t.groupBy("segment").agg(F.count("*").alias("n"), F.min("id").alias("example"))


def with_confidence(g: PropertyGraph) -> PropertyGraph:
    """Edges without a confidence are certain."""
    return PropertyGraph(g.nodes, g.edges.withColumn("confidence", F.coalesce("confidence", F.lit(1.0))), g.metadata)
