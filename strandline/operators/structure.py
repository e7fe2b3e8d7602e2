"""Structural findings: misplaced and dead code, twins, discriminations, conformers, migrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from strandline.functions.text import is_dunder, module_of, top_segment
from strandline.graph import PropertyGraph, cut, is_placeholder, leaf, spread
from strandline.operators.lookup import uncapped, unresolved_callers
from strandline.operators.traverse import closure, layers


def _plain(g: PropertyGraph, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Nodes that aren't tests and whose id has none of the parts of ``exclude``."""
    n = g.nodes.filter(~F.coalesce("is_test", "in_test_file", F.lit(False)))
    for part in exclude:
        n = n.filter(~F.contains("id", F.lit(part)))
    return n


def discriminations(g: PropertyGraph, min_sites: int = 2, limit: int = 50, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(tag, sites, cases): tags that several functions branch on, both orders descending."""
    e = g.typed("discriminates_on").join(_plain(g, exclude).select(F.col("id").alias("source")), "source", "left_semi")
    by = e.groupBy(F.col("target").alias("tag")).agg(F.count_distinct("source").alias("sites"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cases")))), ",").alias("cases"))
    return uncapped(by.filter(F.col("sites") >= min_sites).orderBy(F.desc("sites"), F.desc("tag")), limit)


def native_place(g: PropertyGraph, min_callers: int = 1, limit: int = 50, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(function, owner, callers, cross_module, private, excluded_callers): functions all of whose plain callers are methods of one class.

    Tests, and ids with a part of ``exclude``, are neither functions nor callers
    here; ``excluded_callers`` counts the latter.  Those that tests call directly
    are likely free primitives and come last; then those of another module, private
    ones, fewer excluded and more plain callers come first.
    """
    plain = _plain(g, exclude)
    fn = plain.filter("type = 'function'").select(F.col("id").alias("target"), "name")
    method = g.nodes.filter("type = 'method'").select(F.col("id").alias("source"))
    cls = g.nodes.filter("type = 'class'").select(F.col("id").alias("owner"), F.col("name").alias("owner_name"))
    owner = g.typed("contains").select(F.col("source").alias("owner"), F.col("target").alias("source")).join(cls, "owner").join(method, "source", "left_semi").groupBy("source").agg(F.min("owner").alias("owner"))
    calls = g.typed("calls").select("source", "target").distinct().join(fn.select("target"), "target", "left_semi")
    calls = calls.join(plain.select(F.col("id").alias("source"), F.lit(True).alias("plain")), "source", "left").join(owner, "source", "left")
    by = calls.groupBy("target").agg(
        F.count_if("plain").alias("callers"), F.count_if(F.col("plain").isNull()).alias("excluded_callers"), F.count_distinct(F.when(F.col("plain"), F.col("owner"))).alias("owners"),
        F.min(F.when(F.col("plain"), F.col("owner"))).alias("owner"), F.count_if(F.col("plain") & F.col("owner").isNull()).alias("free"),
    )
    found = by.filter((F.col("owners") == 1) & (F.col("free") == 0) & (F.col("callers") >= min_callers)).join(fn, "target").join(cls, "owner")
    found = found.select(F.col("target").alias("function"), "owner", "callers", (module_of(F.col("name")) != module_of(F.col("owner_name"))).alias("cross_module"), F.startswith(leaf(F.col("name")), F.lit("_")).alias("private"), "excluded_callers")
    order = [F.col("excluded_callers") > 0, F.desc("cross_module"), F.desc("private"), "excluded_callers", F.desc("callers"), "function"]
    return uncapped(found.orderBy(*order), limit)


def dead_functions(g: PropertyGraph, limit: int = 50, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(id, public, decorated, is_method, unresolved_calls): functions and methods that no plain node calls, dunders left out.

    A call of itself is a call.  ``unresolved_calls`` of its name may well be calls
    of it: those rows come last; private, undecorated, plain functions first.
    """
    plain = _plain(g, exclude)
    called = g.typed("calls").join(plain.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
    dead = plain.filter(F.col("type").isin("function", "method") & ~is_dunder(F.col("name"))).join(called, "id", "left_anti")
    own = leaf(F.col("name"))
    dead = dead.withColumn("leaf", own).join(unresolved_callers(g).select("leaf", "calls"), "leaf", "left")
    decorated = F.size(F.coalesce("decorators", F.array().cast("array<string>"))) > 0
    found = dead.select("id", (~F.startswith("leaf", F.lit("_"))).alias("public"), decorated.alias("decorated"), (F.col("type") == "method").alias("is_method"), F.coalesce("calls", F.lit(0)).cast("long").alias("unresolved_calls"), "name")
    return uncapped(found.orderBy(F.col("unresolved_calls") > 0, "public", "decorated", "is_method", "name", "id"), limit).drop("name")


def protocol_conformers(g: PropertyGraph, min_methods: int = 2) -> DataFrame:
    """(protocol, conformer, methods): classes that have all methods of another class and don't inherit from it."""
    m = g.typed("contains").join(g.nodes.filter("type = 'class'").select(F.col("id").alias("source")), "source", "left_semi").join(g.nodes.filter("type = 'method'").select(F.col("id").alias("target"), leaf(F.col("name")).alias("method")), "target").select(F.col("source").alias("cls"), "method")
    m = spread(m, "cls").distinct().withColumn("key", F.xxhash64("method"))
    # a class's methods as 128 bits: one that lacks a bit of another lacks a method of it
    of, bits = W.partitionBy("cls"), ("key & 63", "shiftright(key, 6) & 63")
    m = m.withColumn("methods", F.count("*").over(of)).withColumns({f"bits{i}": F.expr(f"bit_or(shiftleft(1L, cast({x} as int)))").over(of) for i, x in enumerate(bits)})
    m = cut(m)
    # candidates have the protocol's rarest method, so that a common name proposes few pairs
    often = m.groupBy("key").agg(F.count("*").alias("often"))
    large = m.filter(F.col("methods") >= min_methods)
    rare = large.select("cls", "key", "methods", "bits0", "bits1").join(often, "key").groupBy(F.col("cls").alias("protocol"), "methods", "bits0", "bits1").agg(F.min(F.struct("often", "key")).alias("least"))
    rare = rare.select("protocol", F.col("least.key").alias("key"), F.col("methods").alias("n"), F.col("bits0").alias("all0"), F.col("bits1").alias("all1"))
    proposed = rare.join(m.select(F.col("cls").alias("conformer"), "key", "methods", "bits0", "bits1"), "key").filter("protocol <> conformer and methods >= n and (bits0 & all0) = all0 and (bits1 & all1) = all1")
    proposed = cut(proposed.select("protocol", "conformer", F.col("n").alias("methods")))
    own = m.select("cls", "method")
    common = proposed.join(own.withColumnRenamed("cls", "protocol"), "protocol").join(own.withColumnRenamed("cls", "conformer"), ["conformer", "method"]).groupBy("protocol", "conformer", "methods").agg(F.count("*").alias("common"))
    found = common.filter("common = methods").select("protocol", "conformer", "methods")
    up = closure(g.typed("inherits")).select(F.col("id").alias("conformer"), F.col("ancestor").alias("protocol"))
    return found.join(up, ["protocol", "conformer"], "left_anti")


def twin_paths(shingles: DataFrame, calls: DataFrame | None = None, min_similarity: float = 0.7, max_bucket: int = 40, bodies: DataFrame | None = None, min_tokens: int = 35, exclude: tuple[str, ...] = (), limit: int = 0) -> DataFrame:
    """(a, b, similarity) of bodies with much in common, by an inverted index of their shingles.

    ``shingles`` has id and shingle.  Shingles in more than ``max_bucket`` bodies
    propose no pair, but count in the similarity.  Pairs that call each other are left
    out, as are ids with a part of ``exclude`` and, where ``bodies`` (id, ntokens) is
    given, bodies of fewer than ``min_tokens``.

    Only a body's rarest shingles propose: two bodies that are similar enough share
    one of those that remain when as many as they must share are taken away.
    Shingles other than integers are told apart by 64 bit hashes.
    """
    whole = dict(shingles.dtypes)["shingle"] in ("int", "bigint")
    s = shingles.select("id", F.col("shingle").cast("bigint").alias("key") if whole else F.xxhash64("shingle").alias("key"))
    for part in exclude:
        s = s.filter(~F.contains(F.col("id").cast("string"), F.lit(part)))
    if bodies is not None:
        s = s.join(bodies.filter(F.col("ntokens") >= min_tokens).select("id"), "id", "left_semi")
    s = cut(spread(s, "id").distinct().withColumn("n", F.count("*").over(W.partitionBy("id"))))
    often = s.groupBy("key").agg(F.count("*").alias("often")).filter("often > 1")
    least = max(min_similarity - 0.00005, 0.0) - 1e-9  # rounded up to min_similarity
    place = F.row_number().over(W.partitionBy("id").orderBy(F.coalesce("often", F.lit(1)), "key"))
    few = s.join(often, "key", "left").withColumn("left", F.col("n") - place).filter(F.col("often").between(2, max_bucket) & (F.col("left") + 1 >= F.col("n") * least))
    few = cut(few.select("id", "key", "n", "left"))
    a, b = (few.select("key", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("left").alias(f"left{x}")) for x in "ab")
    enough = F.least("lefta", "leftb") + 1 >= (F.col("na") + F.col("nb")) * (least / (1 + least))
    proposed = cut(a.join(b, "key").filter((F.col("a") < F.col("b")) & enough).select("a", "b").distinct())
    asked = proposed.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = s.join(asked, "id", "left_semi").groupBy("id").agg(F.collect_list("key").alias("s"))
    both = proposed.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    found = both.withColumn("similarity", F.round(common / (F.size("sa") + F.size("sb") - common), 4)).filter(F.col("similarity") >= min_similarity).select("a", "b", "similarity")
    if calls is not None:
        either = calls.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
        found = found.join(either, ["a", "b"], "left_anti")
    return uncapped(found.orderBy(F.desc("similarity"), "a", "b"), limit) if limit > 0 else found


def migration_plan(g: PropertyGraph, dependency: str, successor: str = "") -> DataFrame:
    """(id, radius, phase, moved): users of a dependency by how much depends on them within two steps, in thirds.

    ``moved`` says that a user uses ``successor`` as well.
    """

    def users_of(dep: str) -> DataFrame:
        name = g.nodes.filter((F.col("name") == dep) | F.startswith("name", F.lit(dep + "."))).select(F.col("id").alias("target"))
        return g.typed("calls", "type_uses", "imports").join(name, "target", "left_semi").select(F.col("source").alias("id")).distinct()

    users = cut(users_of(dependency))
    reach = layers(g.edges, users.select(F.col("id").alias("root"), "id"), "in", 2).filter("depth > 0").groupBy(F.col("root").alias("id")).agg(F.count("*").alias("radius"))
    rows = cut(users.join(reach, "id", "left").select("id", F.coalesce("radius", F.lit(0)).alias("radius")))
    # a place among equals, shifted by the number of smaller radii: no task has all rows
    sizes = rows.groupBy("radius").agg(F.count("*").alias("c"))
    before = F.sum("c").over(W.orderBy("radius").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("radius", F.coalesce(before, F.lit(0)).alias("earlier"), F.sum("c").over(W.partitionBy()).alias("n"))
    place = rows.withColumn("k", F.row_number().over(W.partitionBy("radius").orderBy("id"))).join(sizes, "radius").withColumn("k", F.col("k") + F.col("earlier"))
    third = F.greatest(F.lit(1), F.expr("n div 3"))
    place = place.select("id", "radius", F.least(F.lit(3), F.floor((F.col("k") - 1) / third) + 1).cast("int").alias("phase"))
    if not successor:
        return place.withColumn("moved", F.lit(False))
    return place.join(users_of(successor).withColumn("__moved", F.lit(True)), "id", "left").withColumn("moved", F.coalesce("__moved", F.lit(False))).drop("__moved")


#: Bases that add no members a user could mean.
TRANSPARENT = ("object", "builtins.object", "typing.Generic", "typing_extensions.Generic", "typing.Protocol", "typing_extensions.Protocol", "abc.ABC")


def inherited_members(g: PropertyGraph, asked: DataFrame) -> DataFrame:
    """(owner, member, verdict): whether an ancestor of a class has a member: live, undecidable or dead.

    ``asked`` has owner (a name) and member.  Only ancestors above which nothing is
    unknown are decided; transparent bases hide nothing.
    """
    n = g.nodes.select("id", "name", is_placeholder(F.col("type")).alias("open"))
    cls = asked.distinct().join(n.filter(F.startswith("id", F.lit("py:class:"))).select(F.col("id").alias("root"), F.expr("substring(id, 10)").alias("owner")), "owner")
    stop = n.filter("open").select("id")
    up = layers(g.typed("inherits"), cls.select("root", F.col("root").alias("id")).distinct(), "out", -1, stop=stop).filter("depth > 0")
    base = up.join(n, "id").select("root", F.coalesce("name", F.expr("substring_index(id, ':', -1)")).alias("base"), "open")
    concrete = n.filter("not open and name is not null").select(F.col("name").alias("full"), F.lit(True).alias("has")).distinct()
    t = cls.join(base, "root", "left").withColumn("full", F.concat_ws(".", "base", "member")).join(concrete, "full", "left")
    live = F.max(F.coalesce("has", F.lit(False)) & ~F.coalesce("open", F.lit(True)))
    opaque = F.max(F.coalesce("open", F.lit(False)) & ~F.col("base").isin(*TRANSPARENT))
    by = t.groupBy("owner", "member").agg(live.alias("live"), F.coalesce(opaque, F.lit(False)).alias("opaque"))
    return by.select("owner", "member", F.when(F.col("live"), "live").when(F.col("opaque"), "undecidable").otherwise("dead").alias("verdict"))


def dead_references(g: PropertyGraph, reexports: DataFrame | None = None) -> DataFrame:
    """(target, kind, sites, sources, verdict): references whose target no longer exists.

    Placeholders of the project's own modules, and equations that ``eq`` references
    name, are judged.  A name is live if a definition has it, as written or with
    re-exports followed, if it is a dunder of one, or if an ancestor of its class
    has the member; undecidable if an ancestor is unknown; else dead.
    """
    from strandline.operators.names import chase, project_tops

    ends = g.nodes.filter(is_placeholder(F.col("type"))).select(F.col("id").alias("target"), F.coalesce("name", F.element_at(F.split("id", ":", 3), -1)).alias("name"))
    e = g.typed("references", "documents", "type_uses", "equation_ref").join(ends, "target")
    eq = F.startswith("target", F.lit("math:equation:"))
    e = e.withColumn("kind", F.when(eq, "equation").when(F.startswith("target", F.lit("py:")), "python"))
    e = e.filter("kind is not null").filter(~eq | (F.col("type") == "equation_ref") | (F.col("reftype") == "eq"))
    own = e.join(project_tops(g), top_segment(F.col("name")) == F.col("top"), "left").filter("kind = 'equation' or top is not null")
    by = cut(own.groupBy("target", "name", "kind").agg(F.count("*").alias("sites"), F.count_distinct("source").alias("sources")))
    names = by.filter("kind = 'python'").select("name").distinct()
    spelled = names.withColumn("as", F.col("name"))
    if reexports is not None:
        spelled = spelled.unionByName(chase(names, reexports).filter("resolved <> name").select("name", F.col("resolved").alias("as")))
    concrete = g.nodes.filter(~is_placeholder(F.col("type")) & F.col("name").isNotNull()).select(F.col("name").alias("as")).distinct()
    classes = g.nodes.filter(F.startswith("id", F.lit("py:class:"))).select(F.expr("substring(id, 10)").alias("as"))
    same = spelled.join(concrete, "as", "left_semi").select("name", F.lit("live").alias("verdict"))
    split = spelled.filter(F.contains("as", F.lit("."))).select("name", F.regexp_replace("as", r"\.[^.]*$", "").alias("owner"), leaf(F.col("as")).alias("member"))
    owners = concrete.unionByName(classes).distinct().withColumnRenamed("as", "owner")
    dunder = split.filter(is_dunder(F.col("member"))).join(owners, "owner", "left_semi").select("name", F.lit("live").alias("verdict"))
    above = split.join(inherited_members(g, split.select("owner", "member")), ["owner", "member"]).select("name", "verdict")
    rank = F.when(F.col("verdict") == "live", 0).when(F.col("verdict") == "undecidable", 1).otherwise(2)
    verdict = same.unionByName(dunder).unionByName(above).groupBy("name").agg(F.min_by("verdict", rank).alias("verdict"))
    found = by.join(verdict, "name", "left").withColumn("verdict", F.when(F.col("kind") == "equation", "dead").otherwise(F.coalesce("verdict", F.lit("dead"))))
    return found.select("target", "kind", "sites", "sources", "verdict")


def minting_files(g: PropertyGraph, limit: int = 5) -> DataFrame:
    """(target, files): of each placeholder, the first files by name whose code names it."""
    ends = g.nodes.filter(is_placeholder(F.col("type"))).select(F.col("id").alias("target"))
    e = g.typed("imports", "calls", "type_uses", "inherits").join(ends, "target", "left_semi").join(g.nodes.select(F.col("id").alias("source"), "file_path"), "source").filter("file_path is not null")
    w = W.partitionBy("target").orderBy("file_path")
    e = e.select("target", "file_path").distinct().withColumn("k", F.row_number().over(w)).filter(F.col("k") <= limit)
    return e.groupBy("target").agg(F.array_join(F.array_sort(F.collect_list("file_path")), ",").alias("files"))
