"""Verification evidence: what implements an equation, what tests it, and whether it ran."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from strandline.graph import PropertyGraph, cut, is_placeholder
from strandline.operators.traverse import layers


def _code(g: PropertyGraph) -> DataFrame:
    """(equation, code, inferred): distinct claims; one that anybody declared isn't inferred."""
    return g.typed("implements").groupBy(F.col("target").alias("equation"), F.col("source").alias("code")).agg(F.min((F.coalesce("evidence", F.lit("")) == "inferred").cast("int")).alias("inferred"))


def evidence(g: PropertyGraph) -> DataFrame:
    """(equation, test, tier, confidence): the tests of each equation, of the best tier that it has.

    Declared ones with their edge's confidence; only without any, tests that call an
    implementer (0.7), else those up to three calls away (0.5).
    """
    declared = g.typed("tests").groupBy(F.col("target").alias("equation"), F.col("source").alias("test")).agg(F.max(F.coalesce("confidence", F.lit(1.0))).alias("confidence"))
    is_test = g.nodes.filter("is_test").select("id")
    code = _code(g).join(declared.select("equation").distinct(), "equation", "left_anti")
    up = layers(g.typed("calls"), code.select(F.col("code").alias("root"), F.col("code").alias("id")).distinct(), "in", 3, stop=is_test)
    reached = up.filter("depth > 0").join(is_test, "id", "left_semi").select(F.col("root").alias("code"), F.col("id").alias("test"), "depth")
    called = code.join(reached, "code").groupBy("equation", "test").agg(F.min("depth").alias("depth"))
    near = called.filter("depth = 1").select("equation", "test", F.lit("caller").alias("tier"), F.lit(0.7).alias("confidence"))
    far = called.join(near.select("equation").distinct(), "equation", "left_anti").select("equation", "test", F.lit("multihop").alias("tier"), F.lit(0.5).alias("confidence"))
    return declared.select("equation", "test", F.lit("declared").alias("tier"), "confidence").unionByName(near).unionByName(far)


def coverage(g: PropertyGraph, status: str | None = None, found: DataFrame | None = None) -> DataFrame:
    """(equation, status, implementers, tests, test_tier, confidence, code_evidence) of each equation, or of those of one status.

    Status: verified, implemented, no_implementation, documented, in that order.
    ``confidence`` is the best of its tests; null without any.  ``found`` is the
    evidence, if it is at hand.
    """
    eq = g.nodes.filter("type in ('equation', 'proof_object')").select(F.col("id").alias("equation"), F.col("no_implementation_kind").alias("kind"))
    by_code = _code(g).groupBy("equation").agg(F.count("*").alias("implementers"), F.sum("inferred").alias("inferred"))
    by_test = (evidence(g) if found is None else found).groupBy("equation").agg(F.count("*").alias("tests"), F.min("tier").alias("tier"), F.max("confidence").alias("confidence"))
    t = eq.join(by_code, "equation", "left").join(by_test, "equation", "left").fillna(0, ["implementers", "inferred", "tests"])
    state = F.when(F.col("tests") > 0, "verified").when(F.col("implementers") > 0, "implemented").when(F.col("kind").isNotNull(), "no_implementation").otherwise("documented")
    code_evidence = F.when(F.col("implementers") == 0, "").when(F.col("inferred") == 0, "declared").when(F.col("inferred") == F.col("implementers"), "inferred").otherwise("mixed")
    out = t.select("equation", state.alias("status"), "implementers", "tests", F.coalesce("tier", F.lit("none")).alias("test_tier"), "confidence", code_evidence.alias("code_evidence"))
    return out.filter(F.col("status") == status) if status else out


def code_coverage(g: PropertyGraph, ledger: DataFrame | None = None) -> DataFrame:
    """(code, status, tests, tier): functions, methods and classes that implement no equation.

    tested, if a test calls it (tier caller) or, by ``ledger`` (node_id, test_id),
    ran it (executed); else orphan_code.
    """
    code = g.nodes.filter("type in ('function', 'method', 'class')").select(F.col("id").alias("code")).join(g.typed("implements").select(F.col("source").alias("code")), "code", "left_anti")
    tests = g.nodes.filter("is_test").select(F.col("id").alias("source"))
    rows = g.typed("calls").join(tests, "source", "left_semi").select(F.col("target").alias("code"), F.col("source").alias("test"), F.lit(0).alias("seen"))
    if ledger is not None:
        rows = rows.unionByName(ledger.select(F.col("node_id").alias("code"), F.col("test_id").alias("test"), F.lit(1).alias("seen")))
    by = rows.groupBy("code", "test").agg(F.min("seen").alias("seen")).groupBy("code").agg(F.count("*").alias("tests"), F.min("seen").alias("seen"))
    t = code.join(by, "code", "left").fillna(0, ["tests"])
    tier = F.when(F.col("seen") == 0, "caller").when(F.col("seen") == 1, "executed").otherwise("none")
    return t.select("code", F.when(F.col("tests") > 0, "tested").otherwise("orphan_code").alias("status"), "tests", tier.alias("tier"))


def summary(g: PropertyGraph, ledger: DataFrame | None = None, captured: DataFrame | None = None) -> DataFrame:
    """(key, n): how many rows have each status and, with a run, each verdict.

    Rows that the run alone makes are no claims: they count as executed_unclaimed.
    """
    found, code = cut(evidence(g)), cut(code_coverage(g, ledger))
    rows = coverage(g, found=found).select(F.col("status").alias("key")).unionByName(code.select(F.col("status").alias("key")))
    if ledger is not None:
        by_test = found.select("test", "equation")
        seen = ledger.select("node_id", F.col("test_id").alias("test"))
        judged = verdicts(by_test, _code(g).select("equation", "code"), seen, captured if captured is not None else seen.select("test"))
        rows = rows.unionByName(judged.filter("verdict <> ''").select(F.concat(F.lit("claims_"), "verdict").alias("key")))
        unclaimed = ledger.select(F.col("node_id").alias("code"), F.col("test_id").alias("test")).distinct().join(code.filter("tier <> 'none'").select("code"), "code", "left_semi")
        direct = g.typed("calls").select(F.col("target").alias("code"), F.col("source").alias("test"))
        rows = rows.unionByName(unclaimed.join(direct, ["code", "test"], "left_anti").select(F.lit("executed_unclaimed").alias("key")))
    return rows.groupBy("key").agg(F.count("*").alias("n"))


def audit(g: PropertyGraph) -> DataFrame:
    """(status, test_tier, n): how far the equations are covered."""
    return coverage(g).groupBy("status", "test_tier").agg(F.count("*").alias("n"))


def audit_gaps(g: PropertyGraph, group_by: str | None = None) -> DataFrame:
    """(equation, status, implementers, level, module, bucket): equations that somebody could still verify, the implemented ones first.

    ``module`` is the first part of the name of the first implementer by id, ``level``
    that of the first test with one; ``bucket`` is what ``group_by`` (level, module or
    equation) names.
    """
    if group_by not in (None, "level", "module", "equation"):
        raise ValueError(f"group_by must be level, module, equation or None, not {group_by!r}")
    found = cut(evidence(g))
    open_ = coverage(g, found=found).filter("status in ('implemented', 'documented')").select("equation", "status", "implementers")
    names = g.nodes.select(F.col("id").alias("code"), "name")
    module = _code(g).join(names, "code").groupBy("equation").agg(F.min_by(F.substring_index("name", ".", 1), "code").alias("module"))
    levels = g.nodes.filter("vv_level is not null").select(F.col("id").alias("test"), "vv_level")
    level = found.join(levels, "test").groupBy("equation").agg(F.min_by("vv_level", "test").alias("level"))
    t = open_.join(module, "equation", "left").join(level, "equation", "left").fillna("unassigned", ["module", "level"])
    bucket = F.lit("") if group_by is None else F.col(group_by)
    return t.select("equation", "status", "implementers", "level", "module", bucket.alias("bucket")).orderBy(F.desc("status"), "equation")


def gaps(g: PropertyGraph, module: str = "", level: str = "") -> DataFrame:
    """(kind, id): tests without a declared target, equations not verified, errors nothing catches; tests of one module or level if asked."""
    tests = g.nodes.filter("is_test and type in ('function', 'method')")
    tests = tests.filter(F.startswith("name", F.lit(module))) if module else tests
    tests = tests.filter(F.col("vv_level") == level) if level else tests
    tests = tests.select("id").join(g.typed("tests", "catches").select(F.col("source").alias("id")), "id", "left_anti")
    eq = coverage(g).filter("status in ('implemented', 'documented')").select(F.col("equation").alias("id"))
    err = g.nodes.filter("type = 'error'").select("id").join(g.typed("catches").select(F.col("target").alias("id")), "id", "left_anti")
    return tests.select(F.lit("untagged_test").alias("kind"), "id").unionByName(eq.select(F.lit("unverified_equation").alias("kind"), "id")).unionByName(err.select(F.lit("uncaught_error").alias("kind"), "id"))


def errors(g: PropertyGraph, max_catchers: int = 25) -> DataFrame:
    """(error, catchers, first): the error catalogue; ``first`` names up to ``max_catchers`` that catch it."""
    e = g.typed("catches").select(F.col("target").alias("error"), "source").distinct()
    by = e.groupBy("error").agg(F.count("*").alias("catchers"))
    w = W.partitionBy("error").orderBy("source")
    some = e.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= max_catchers).groupBy("error").agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("first"))
    t = g.nodes.filter("type = 'error'").select(F.col("id").alias("error")).join(by, "error", "left").join(some, "error", "left")
    return t.select("error", F.coalesce("catchers", F.lit(0)).alias("catchers"), F.coalesce("first", F.lit("")).alias("first"))


def undeclared_errors(g: PropertyGraph, prefix: str = "vv:error:") -> DataFrame:
    """(label, tests): what markers say that tests catch though no catalogue has it."""
    marks = g.nodes.select("id", F.explode("catches").alias("label")).withColumn("error", F.concat(F.lit(prefix), "label"))
    return marks.join(g.nodes.filter("type = 'error'").select(F.col("id").alias("error")), "error", "left_anti").groupBy("label").agg(F.count_distinct("id").alias("tests"))


def verdicts(claims: DataFrame, implements: DataFrame, exercised: DataFrame, captured: DataFrame) -> DataFrame:
    """(test, equation, verdict) of each claim under a run; the order of the guards is the meaning.

    No implementers: no_implementation; test not captured: out_of_capture; the
    test ran an implementer: corroborated; else refuted.  Without any captured
    test the verdict is empty.
    """
    has = implements.select("equation").distinct().withColumn("has", F.lit(True))
    ran = exercised.join(implements, F.col("node_id") == F.col("code")).select("test", "equation").distinct().withColumn("ran", F.lit(True))
    seen = captured.select("test").distinct().withColumn("seen", F.lit(True))
    any_ = captured.agg((F.count("*") > 0).alias("any"))
    t = claims.select("test", "equation").distinct().join(has, "equation", "left").join(seen, "test", "left").join(ran, ["test", "equation"], "left").crossJoin(any_)
    return t.select("test", "equation", F.when(~F.col("any"), "").when(F.col("has").isNull(), "no_implementation").when(F.col("seen").isNull(), "out_of_capture").when(F.col("ran"), "corroborated").otherwise("refuted").alias("verdict"))


def retest(g: PropertyGraph, changed: DataFrame, proven: DataFrame | None = None) -> DataFrame:
    """(test, bucket): must (one step, or proven to run a changed node) or should (deeper); other tests may be skipped.

    ``proven`` has test and node_id, what a run saw.
    """
    cone = layers(g.typed("calls", "type_uses", "inherits"), changed.select(F.lit("").alias("root"), "id"), "in", -1)
    tests = g.nodes.filter("is_test").select("id")
    near = tests.join(cone.select("id", "depth"), "id", "left")
    if proven is not None:
        near = near.join(proven.join(changed.select(F.col("id").alias("node_id")), "node_id", "left_semi").select(F.col("test").alias("id")).distinct().withColumn("proven", F.lit(True)), "id", "left")
    else:
        near = near.withColumn("proven", F.lit(None).cast("boolean"))
    return near.select(F.col("id").alias("test"), F.when(F.col("proven") | (F.col("depth") <= 1), "must").when(F.col("depth").isNotNull(), "should").otherwise("safe_to_skip").alias("bucket"))


def doc_impact(g: PropertyGraph, node_id: str) -> DataFrame:
    """(equation, depth): claims implemented in the upstream cone of a node."""
    seed = g.nodes.filter(F.col("id") == node_id).select(F.col("id").alias("root"), "id")
    cone = layers(g.typed("calls", "type_uses", "inherits"), seed, "in", -1).select("id", "depth")
    return g.typed("implements").select(F.col("source").alias("id"), F.col("target").alias("equation")).join(cone, "id").groupBy("equation").agg(F.min("depth").alias("depth"))


#: Edges between statements.
RELATIONS = ("discretizes", "derives_from", "approximates")
STATEMENTS = ("equation", "proof_object")


def statement_relations(g: PropertyGraph, roots: DataFrame, max_depth: int = 4) -> DataFrame:
    """(source, relation, target): edges between statements, both ways, up to ``max_depth`` steps from the roots (id)."""
    e = g.typed(*RELATIONS)
    near = layers(e, roots.select(F.lit("").alias("root"), "id").distinct(), "both", max_depth - 1).select("id").distinct()
    out, back = (e.join(near.select(F.col("id").alias(end)), end, "left_semi").select("source", F.col("type").alias("relation"), "target") for end in ("source", "target"))
    return out.unionByName(back).distinct()


def provenance_chain(g: PropertyGraph, node_id: str) -> DataFrame:
    """(step, id, inferred, depth): where a symbol or a statement comes from.

    target; implements (or implemented_by, of a statement), which a declaration
    makes a fact even if a guess stands beside it; contained_by: the pages with
    those statements; cites: what these pages cite; relation: statements linked to
    them; also_on: pages that merely document the node.
    """
    node = g.nodes.filter(F.col("id") == node_id).select("id", "type")
    kinds = g.nodes.select("id", "type")
    is_statement = F.col("type").isin(*STATEMENTS)
    inferred = F.min((F.coalesce("evidence", F.lit("")) == "inferred").cast("int"))
    claims = g.typed("implements")
    ahead = claims.filter(F.col("source") == node_id).groupBy(F.col("target").alias("id")).agg(inferred.alias("inferred")).join(kinds.filter(is_statement), "id", "left_semi")
    behind = claims.filter(F.col("target") == node_id).groupBy(F.col("source").alias("id")).agg(inferred.alias("inferred")).join(node.filter(is_statement).select(F.lit(True).alias("__is")), F.lit(True), "left_semi")
    statements = ahead.select("id").unionByName(node.filter(is_statement).select("id")).distinct()
    files = kinds.filter("type = 'file'").select(F.col("id").alias("source"))
    pages = g.typed("contains").join(statements.withColumnRenamed("id", "target"), "target", "left_semi").join(files, "source", "left_semi").select(F.col("source").alias("id")).distinct()
    cited = g.typed("cites").join(pages.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id")).distinct()
    related = statement_relations(g, statements).select(F.explode(F.array("source", "target")).alias("id")).distinct().join(statements, "id", "left_anti")
    also = g.typed("documents", "contains").filter(F.col("target") == node_id).join(files, "source", "left_semi").select(F.col("source").alias("id")).distinct()
    also = also.join(node.filter(~is_statement).select(F.lit(True).alias("__is")), F.lit(True), "left_semi")
    no = F.lit(None).cast("int")
    steps = [("target", node, no, 0), ("implements", ahead, F.col("inferred"), 1), ("implemented_by", behind, F.col("inferred"), 1), ("contained_by", pages, no, 2), ("cites", cited, no, 3), ("relation", related, no, 2), ("also_on", also, no, 1)]
    out = None
    for step, rows, guess, depth in steps:
        part = rows.select(F.lit(step).alias("step"), "id", guess.alias("inferred"), F.lit(depth).alias("depth"))
        out = part if out is None else out.unionByName(part)
    return out


def briefing(g: PropertyGraph, changed: DataFrame | None = None, stale: DataFrame | None = None, hubs: int = 10, gaps_: int = 10, pages: int = 10) -> DataFrame:
    """(section, item, n): where to begin with a graph: sizes, hubs, gaps, stale pages (page, newer), placeholders, changed hubs.

    Each section is cut to a few items; ``total`` items say how many there are.
    """
    from strandline.operators import change, lookup

    def section(name: str, rows: DataFrame, item: str, n) -> DataFrame:
        return rows.select(F.lit(name).alias("section"), F.col(item).cast("string").alias("item"), n.cast("long").alias("n"))

    degrees = lookup.node_degrees(g)
    size = g.nodes.agg(F.count("*").alias("n")).withColumn("item", F.lit("nodes")).unionByName(g.edges.agg(F.count("*").alias("n")).withColumn("item", F.lit("edges")))
    open_ = cut(coverage(g, "implemented").select("equation", "implementers"))
    holes = g.nodes.filter(is_placeholder(F.col("type"))).groupBy(F.coalesce("type", F.lit("")).alias("item")).agg(F.count("*").alias("n"))
    parts = [
        section("size", size, "item", F.col("n")), section("hubs", lookup.god_nodes(g, hubs, degrees=degrees), "id", F.col("degree")),
        section("gaps", open_.orderBy("equation").limit(gaps_), "equation", F.col("implementers")), section("gaps", open_.agg(F.count("*").alias("n")).withColumn("item", F.lit("total")), "item", F.col("n")),
        section("placeholders", holes, "item", F.col("n")), section("grammar", lookup.id_grammar(g, degrees).filter(~is_placeholder(F.col("type"))), "example", F.col("n")),
    ]
    if stale is not None:
        parts.append(section("stale", stale.orderBy(F.desc("newer"), "page").limit(pages), "page", F.col("newer")))
        parts.append(section("stale", stale.agg(F.count("*").alias("n")).withColumn("item", F.lit("total")), "item", F.col("n")))
    if changed is not None:
        parts.append(section("changed", change.hot_nodes(g, changed, 5, hubs, degrees), "id", F.col("degree")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def staleness(links: DataFrame, page_ts: DataFrame, code_ts: DataFrame) -> DataFrame:
    """(page, page_ts, code_ts, newer): pages older than any code they link to."""
    t = links.select("page", "code").distinct().join(page_ts, "page").join(code_ts, "code").filter("code_ts > page_ts")
    return t.groupBy("page").agg(F.max("page_ts").alias("page_ts"), F.max("code_ts").alias("code_ts"), F.count("*").alias("newer"))
