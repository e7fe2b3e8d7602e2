"""Breadth-first walks as frontier loops, closures, components and paths.

Each round is one join of the frontier with the edges and one anti-join with
what was visited; the frontier is written every round, so plans stay short and
a lost executor costs no recomputation of earlier rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from strandline.graph import PropertyGraph, cut, free, is_placeholder, spread


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """(frm, to): ``out`` along edges, ``in`` against them, ``both``; parallel ones are kept."""
    out = edges.select(F.col("source").alias("frm"), F.col("target").alias("to"))
    back = edges.select(F.col("target").alias("frm"), F.col("source").alias("to"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].filter("frm <> to")


def arcs(edges: DataFrame, direction: str) -> DataFrame:
    """``steps``, each once."""
    return spread(steps(edges, direction), "frm", "to").distinct()


def layers(edges: DataFrame, seeds: DataFrame, direction: str = "out", max_depth: int = 3, stop: DataFrame | None = None) -> DataFrame:
    """(root, id, depth): each node once per root, at its least depth; -1 walks to the end.

    ``seeds`` has root and id.  Nodes of ``stop`` are reached but not left.
    """
    visited = cut(seeds.select("root", "id").distinct().withColumn("depth", F.lit(0)))
    if visited.isEmpty():
        return visited
    step = cut(steps(edges, direction))
    frontier, depth = visited, 0
    while max_depth < 0 or depth < max_depth:
        leaving = frontier if stop is None else frontier.join(stop.select("id"), "id", "left_anti")
        depth += 1
        found = leaving.join(step, F.col("id") == F.col("frm")).select("root", F.col("to").alias("id")).distinct()
        frontier = cut(found.join(visited, ["root", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        if depth % 8 == 0:
            visited = cut(visited)
    return visited


def impact(g: PropertyGraph, target: str, direction: str = "upstream", max_depth: int = 3, edge_types: tuple[str, ...] = (), only: tuple[str, ...] = ()) -> DataFrame:
    """(id, depth) that a change of ``target`` reaches; ``only`` filters the answer, not the walk."""
    seed = g.nodes.filter(F.col("id") == target).select(F.col("id").alias("root"), "id")
    found = layers(g.typed(*edge_types), seed, "in" if direction == "upstream" else "out", max_depth).filter("depth > 0").select("id", "depth")
    return found.join(g.nodes.filter(F.col("type").isin(*only)), "id", "left_semi") if only else found


def callers(g: PropertyGraph, target: str, transitive: bool = False, max_depth: int = 3) -> DataFrame:
    return impact(g, target, "upstream", max_depth if transitive else 1, ("calls",))


def callees(g: PropertyGraph, target: str, transitive: bool = False, max_depth: int = 3) -> DataFrame:
    return impact(g, target, "downstream", max_depth if transitive else 1, ("calls",))


def shortest_path(g: PropertyGraph, a: str, b: str, max_hops: int = 8) -> DataFrame:
    """(hop, id) of an undirected shortest path, or no rows; of equals the least parent is taken."""
    step = cut(steps(g.edges, "both"))
    visited = cut(g.nodes.filter(F.col("id") == a).select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("hop")))
    frontier, hop, hit = visited, 0, not visited.filter(F.col("id") == b).isEmpty()
    while hop < max_hops and not hit:
        hop += 1
        # the round that reaches b is no more than b
        last = cut(frontier.join(step.filter(F.col("to") == b), F.col("id") == F.col("frm")).groupBy(F.col("to").alias("id")).agg(F.min("frm").alias("parent")).withColumn("hop", F.lit(hop)))
        if hit := not last.isEmpty():
            visited = visited.unionByName(last)
            break
        found = frontier.join(step, F.col("id") == F.col("frm")).groupBy(F.col("to").alias("id")).agg(F.min("frm").alias("parent"))
        frontier = cut(found.join(visited, "id", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    path = visited.filter(F.col("id") == b)
    at = path
    for _ in range(hop):
        at = cut(visited.alias("v").join(F.broadcast(at.select(F.col("parent").alias("id"))), "id").select("id", "v.parent", "v.hop"))  # a row
        path = path.unionByName(at)
    return path.select("hop", "id")


def path_edges(g: PropertyGraph, path: DataFrame) -> DataFrame:
    """(hop, source, target, type) of the edges along ``path`` (hop, id): the forward one before the backward one, then by type."""
    path = cut(path)
    step = path.select("hop", F.col("id").alias("a")).join(path.select((F.col("hop") - 1).alias("hop"), F.col("id").alias("b")), "hop")
    ends = step.select("hop", F.col("a").alias("source"), F.col("b").alias("target"), F.lit(0).alias("back")).unionByName(step.select("hop", F.col("b").alias("source"), F.col("a").alias("target"), F.lit(1).alias("back")))
    both = g.edges.select("source", "target", "type").join(F.broadcast(ends), ["source", "target"]).groupBy("hop").agg(F.min(F.struct("back", "type", "source", "target")).alias("e"))
    return both.select("hop", "e.source", "e.target", "e.type")


#: Edges that one task links at a time.
CHUNK = 2_000_000


def _linker(chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from edges (a, b) to (v, r): every end with the least end of its component within a chunk."""

    def least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        root = np.arange(n)
        while True:
            a, b = root[a], root[b]
            apart = a != b
            if not apart.any():
                return root
            a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(root, b, a)
            while ((up := root[root]) != root).any():
                root = up

    def linked(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in some]) for i in (0, 1))
        v, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(v), pa.array(v[least(at[: len(a)], at[len(a) :], len(v))])], names=["v", "r"])

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, rows = [], 0
        for x in batches:
            some.append(x)
            rows += x.num_rows
            if rows >= chunk:
                yield linked(some)
                some, rows = [], 0
        if rows:
            yield linked(some)

    return stars


def components(g: PropertyGraph) -> DataFrame:
    """(id, component): the least id of each weakly connected component.

    Tasks link the edges that they have, of 64 bit hashes of the ids, into stars; a
    node of several stars links their centres to the least of them. These links are
    the edges of the next round, until one task takes the rest.
    """
    e = g.edges.filter("source <> target").select(F.xxhash64("source").alias("a"), F.xxhash64("target").alias("b"))
    rounds, last = [], False
    while not last:
        stars = cut(spread(e.mapInArrow(_linker(CHUNK), "v bigint, r bigint"), "v").distinct().withColumn("low", F.min("r").over(W.partitionBy("v"))))
        rounds.append(stars.filter("r = low").select("v", F.col("low").alias("r")))
        e = cut(stars.filter("r <> low").select(F.col("r").alias("a"), F.col("low").alias("b")).distinct())
        if last := e.count() <= CHUNK:
            rounds.append(cut(e.repartition(1).mapInArrow(_linker(CHUNK + 1), "v bigint, r bigint")))
    label = rounds.pop()
    while rounds:
        label = rounds.pop().join(label.select(F.col("v").alias("r"), F.col("r").alias("to")), "r", "left").select("v", F.coalesce("to", "r").alias("r"))
    own = g.nodes.select("id", F.xxhash64("id").alias("v"))
    both = cut(own.join(label, "v", "full_outer").select("id", "v", F.coalesce("r", "v").alias("r")))
    named = labelled = both.filter("id is not null")
    # ends without a node count in their component's least id
    bare = both.filter("id is null").select("v", "r")
    if not bare.isEmpty():
        ends = g.edges.select(F.explode(F.array("source", "target")).alias("id")).withColumn("v", F.xxhash64("id"))
        named = labelled.select("id", "r").unionByName(ends.join(bare, "v").select("id", "r"))
    least = cut(named.groupBy("r").agg(F.min("id").alias("component")))
    least = F.broadcast(least) if least.count() <= 10_000 else least
    return labelled.join(least, "r").select("id", "component")


def closure(edges: DataFrame) -> DataFrame:
    """(id, ancestor) reachable along ``edges``; cycles are safe."""
    seeds = edges.select(F.col("source").alias("root"), F.col("source").alias("id")).distinct()
    return layers(edges, seeds, "out", -1).filter("root <> id").select(F.col("root").alias("id"), F.col("id").alias("ancestor"))


def trace_error(g: PropertyGraph, test: str, max_depth: int = 10) -> DataFrame:
    """(id, depth, equation): what a test calls, with what that implements."""
    seed = g.nodes.filter(F.col("id") == test).select(F.col("id").alias("root"), "id")
    walked = layers(g.typed("calls"), seed, "out", max_depth).select("id", "depth")
    claims = g.typed("implements").select(F.col("source").alias("id"), F.col("target").alias("equation")).distinct()
    return walked.join(claims, "id", "left")


def processes(g: PropertyGraph, min_length: int = 3, most: int = 21) -> DataFrame:
    """(root, length, path): from functions nobody calls, always to the successor that calls most."""
    calls = cut(g.typed("calls").filter("source <> target").select("source", "target").distinct())
    out = calls.groupBy(F.col("source").alias("target")).agg(F.count("*").alias("out"))
    callable_ = g.nodes.filter(F.col("type").isin("function", "method")).select("id")
    roots = callable_.join(calls.select(F.col("target").alias("id")), "id", "left_anti")
    step = cut(calls.join(out, "target", "left").select("source", "target", F.coalesce("out", F.lit(0)).alias("out")))
    walks = cut(roots.select(F.col("id").alias("root"), F.col("id").alias("at"), F.array("id").alias("path")))
    done = walks.limit(0)
    for _ in range(most - 1):
        nexts = walks.join(step, F.col("at") == F.col("source")).filter(~F.array_contains("path", F.col("target")))
        best = nexts.groupBy("root", "path").agg(F.min_by("target", F.struct(-F.col("out"), F.col("target"))).alias("at"))
        moved = cut(best.select("root", "at", F.concat("path", F.array("at")).alias("path")))
        done = done.unionByName(walks.join(moved.select("root"), "root", "left_anti"))
        if moved.isEmpty():
            walks = moved
            break
        walks = moved
    return done.unionByName(walks).select("root", F.size("path").alias("length"), F.array_join("path", " > ").alias("path")).filter(F.col("length") >= min_length)


def communities(g: PropertyGraph) -> DataFrame:
    """(id, community) by label propagation on undirected, weighted pairs; ties go to the greatest label.

    It runs until no label moves, or until each is what it was two rounds before:
    weights are the same both ways, so labels can't alternate in a longer cycle.
    """
    both = cut(g.edges.filter("source <> target").select(F.col("source").alias("frm"), F.col("target").alias("to")).unionByName(g.edges.filter("source <> target").select(F.col("target").alias("frm"), F.col("source").alias("to"))).groupBy("frm", "to").agg(F.count("*").alias("w")))
    label = cut(g.nodes.select("id", F.col("id").alias("community"), F.lit(None).cast("string").alias("before")))
    while True:
        votes = both.join(label.select(F.col("id").alias("to"), "community"), "to").groupBy("frm", "community").agg(F.sum("w").alias("w"))
        won = votes.groupBy(F.col("frm").alias("id")).agg(F.max_by("community", F.struct("w", "community")).alias("won"))
        new = F.coalesce("won", "community")
        moved = cut(label.join(won, "id", "left").select("id", new.alias("community"), F.col("community").alias("before"), (new != F.col("community")).alias("moved"), (~new.eqNullSafe(F.col("before"))).alias("fresh")))
        free(label)
        label = moved.select("id", "community", "before")
        if moved.filter("moved").isEmpty() or moved.filter("fresh").isEmpty():
            return label.select("id", "community")


def bridges(g: PropertyGraph, pivots: int = 100, top_n: int = 10, least: float = 0.001) -> DataFrame:
    """(id, score): betweenness from hash-chosen pivots, by path counts and dependencies of BFS layers.

    Of nodes that score ``least`` or more and lie, with their neighbours, in two
    or more communities.  A graph of ``pivots`` nodes or fewer is scored exactly.
    """
    step = cut(arcs(g.edges, "both"))
    n = g.nodes.count()
    pivots = min(pivots, n)
    roots = g.nodes.orderBy(F.xxhash64("id"), "id").limit(pivots).select(F.col("id").alias("root"), "id")
    seen = cut(layers(g.edges, roots, "both", -1))
    deepest = seen.agg(F.max("depth")).first()[0] or 0
    down = cut(seen.select("root", F.col("id").alias("frm"), "depth").join(step, "frm").join(seen.select("root", F.col("id").alias("to"), F.col("depth").alias("below")), ["root", "to"]).filter("below = depth + 1").select("root", "frm", "to", "depth"))
    sigma = cut(roots.withColumn("sigma", F.lit(1.0)))
    for d in range(deepest):
        new = down.filter(F.col("depth") == d).join(sigma.withColumnRenamed("id", "frm"), ["root", "frm"]).groupBy("root", F.col("to").alias("id")).agg(F.sum("sigma").alias("sigma"))
        sigma = cut(sigma.unionByName(new))
    delta = seen.filter(F.col("depth") == deepest).select("root", "id", F.lit(0.0).alias("delta"))
    for d in range(deepest - 1, -1, -1):
        part = down.filter(F.col("depth") == d).join(sigma.select("root", F.col("id").alias("frm"), F.col("sigma").alias("sf")), ["root", "frm"]).join(sigma.select("root", F.col("id").alias("to"), F.col("sigma").alias("st")), ["root", "to"]).join(delta.select("root", F.col("id").alias("to"), "delta"), ["root", "to"])
        up = part.groupBy("root", F.col("frm").alias("id")).agg(F.sum(F.col("sf") / F.col("st") * (1 + F.col("delta"))).alias("delta"))
        rest = seen.filter(F.col("depth") == d).select("root", "id").join(up, ["root", "id"], "left").select("root", "id", F.coalesce("delta", F.lit(0.0)).alias("delta"))
        delta = cut(delta.unionByName(rest))
    scale = F.lit(float(max(1, (n - 1) * (n - 2))) * max(1, pivots) / max(1, n))
    scored = delta.filter("root <> id").groupBy("id").agg((F.sum("delta") / scale).alias("raw")).filter(F.col("raw") >= least)
    group = communities(g)
    around = step.select(F.col("frm").alias("id"), "to").unionByName(g.nodes.select("id", F.col("id").alias("to"))).join(group.select(F.col("id").alias("to"), "community"), "to")
    between = around.groupBy("id").agg(F.count_distinct("community").alias("touched")).filter("touched >= 2")
    return scored.join(between, "id", "left_semi").select("id", F.round("raw", 6).alias("score")).orderBy(F.desc("score"), "id").limit(top_n)


def members(g: PropertyGraph) -> DataFrame:
    """(owner, name) of methods and attributes with those of all ancestors; ``opaque`` if an ancestor is a placeholder."""
    own = g.typed("contains").join(g.nodes.select(F.col("id").alias("target"), "name"), "target").select(F.col("source").alias("owner"), F.substring_index("name", ".", -1).alias("name"))
    up = closure(g.typed("inherits"))
    inherited = up.join(own.withColumnRenamed("owner", "ancestor"), "ancestor").select(F.col("id").alias("owner"), "name")
    opaque = up.join(g.nodes.select(F.col("id").alias("ancestor"), "type"), "ancestor", "left").groupBy(F.col("id").alias("owner")).agg(F.max(is_placeholder(F.col("type"))).alias("opaque"))
    return own.unionByName(inherited).distinct().join(opaque, "owner", "left").withColumn("opaque", F.coalesce("opaque", F.lit(False)))
