"""Near-duplicate embeddings by a robust-pruned flat graph.

1. Equal vectors are represented by the one of lowest id.  Directions (vectors of
   length 1) are clustered; each goes to its ``overlap`` nearest centres, so that
   shards overlap where clusters meet.  The number of centres follows the table's
   size up to ``MOST_CENTRES``; the overlap grows with it, since more centres part
   more pairs.  A shard larger than ``SHARD_MOST`` is cut into blocks, and every
   pair of blocks is a task, so that a task's vectors are bounded at any size.
2. A task finds each member's nearest others and prunes them robustly: a neighbour
   is dropped when one already kept is nearer to it by the factor ``ALPHA``.  The
   lists are united with their reverses.
3. Every vector is a query in all of its shards, so a pair is lost only if its
   vectors share none.  Where its nearest others go beyond the radius, its range is
   closed and they answer it.  Else a greedy search over the graph starts from the
   query and the medoids and widens its range: the beam grows with the nodes found
   within the radius, and those are always expanded.
4. Answers are verified by the exact cosine.  A pair belongs to the lowest shard
   that both vectors are in; a task tells how many links each of its vectors has,
   weighted by copies, and only those pairs that join groups not joined before.
   Recall is audited on a hash sample of queries against all vectors.  Below
   ``RECALL``, the overlap is doubled and the search repeated.

Lists of different shards aren't brought together in one graph: each vector's
answers are united instead.  (A graph over shards has to carry the neighbours'
vectors as well, 11 times the table where it was tried.)
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandline.llm.common import join_told, own_prints, stored
from strandline.llm.ngram_join import groups

#: Cosine from which two vectors are near duplicates.
THRESHOLD = 0.9
SHARD_ROWS, OVERLAP, DEGREE, ALPHA, BEAM, SEED = 2000, 3, 24, 1.2, 32, 5
#: Rows of a shard from which it is cut into blocks, and centres at most.
SHARD_MOST, MOST_CENTRES = 8000, 16_384
#: Recall that the audit asks for, and how often the overlap is doubled for it.
RECALL, WIDENINGS = 0.995, 3
#: Vectors that the centres are fitted on, at most.
FIT_ROWS = 100_000


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(a):
        return np.zeros((0, 1), np.float32)
    flat = a.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(a), -1).astype(np.float32)


def centres(x: np.ndarray, k: int, seed: int = SEED, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; an empty cluster keeps its last centre."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        some = np.bincount(near, minlength=len(c)) > 0
        c[some] = unit(total[some])
    return c


def robust_prune(ids: np.ndarray, x: np.ndarray, me: int, order: np.ndarray, alpha: float, degree: int) -> list[int]:
    """Kept neighbours of ``me`` among ``order`` (nearest first)."""
    kept: list[int] = []
    # squared distances of unit vectors: 2 - 2 cos
    near = x[order]
    between, mine = alpha * (2 - 2 * (near @ near.T)), 2 - 2 * (near @ x[me])
    left = np.ones(len(order), bool)
    for p in range(len(order)):
        if left[p]:
            kept.append(int(order[p]))
            if len(kept) == degree:
                break
            left &= between[p] > mine
    return kept


def build_shard(ids: np.ndarray, x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, radius: float = THRESHOLD) -> tuple[list[np.ndarray], list[np.ndarray | None]]:
    """Adjacency (indexes) of one shard, and of each vector the others within ``radius``, None where they may be more."""
    n = len(ids)
    lists: list[np.ndarray] = []
    closed: list[np.ndarray | None] = []
    width = min(n - 1, 4 * degree)
    for s in range(0, n, 1024):
        sim = x[s : s + 1024] @ x.T
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -2
        top = np.argpartition(-sim, width - 1, axis=1)[:, :width] if width > 0 else np.zeros((len(sim), 0), np.int64)
        for r in range(len(sim)):
            c = top[r][np.lexsort((ids[top[r]], -sim[r, top[r]]))]
            near = sim[r, c] >= radius
            closed.append(c[near] if width == n - 1 or not near.all() else None)
            lists.append(np.array(robust_prune(ids, x, s + r, c, alpha, degree), np.int64))
    return lists, closed


def range_search(x: np.ndarray, adj: list[np.ndarray], starts: np.ndarray, q: np.ndarray, radius: float, beam: int = BEAM) -> np.ndarray:
    """Indexes of nodes within ``radius`` (cosine) of ``q`` that the greedy search reaches."""
    seen = np.zeros(len(x), bool)
    seen[starts] = True
    nodes, sims = np.asarray(starts), x[starts] @ q
    done = np.zeros(len(x), bool)
    while True:
        # the beam widens to hold everything within the radius
        width = max(beam, 2 * int((sims >= radius).sum()))
        if len(nodes) > width:
            top = np.argpartition(-sims, width - 1)[:width]
            nodes, sims = nodes[top], sims[top]
        open_ = ~done[nodes]
        if not open_.any():
            return nodes[sims >= radius]
        at = np.flatnonzero(open_)
        at = at[np.argsort(-sims[at], kind="stable")[:8]]
        done[nodes[at]] = True
        new = np.unique(np.concatenate([adj[i] for i in nodes[at].tolist()]))
        new = new[~seen[new]]
        seen[new] = True
        nodes, sims = np.concatenate([nodes, new]), np.concatenate([sims, x[new] @ q])


def _clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows that can have a partner."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("v"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda e: e != 0))
    common = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).select("n").first()
    return v.filter(F.size("v") == (common.n if common else 0))


def overlap_for(n: int, shard_rows: int = SHARD_ROWS) -> int:
    """Shards a vector goes to: ``OVERLAP`` where one shard holds the table, one more at each doubling."""
    return OVERLAP + max(0, math.ceil(math.log2(n / shard_rows)))


def links_both_ways(adj: list[np.ndarray]) -> list[np.ndarray]:
    """Adjacency with each link's reverse, so that no vector is out of reach."""
    src, dst = np.repeat(np.arange(len(adj)), [len(a) for a in adj]), np.concatenate(adj)
    both = np.unique(np.stack([np.concatenate([src, dst]), np.concatenate([dst, src])], 1), axis=0)
    return np.split(both[:, 1], np.searchsorted(both[:, 0], np.arange(1, len(adj))))


def near_classes(vectors: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, overlap: int | None = None, degree: int = DEGREE, beam: int = BEAM, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, class_id, links, recall) for each id of ``vectors``.

    ``links`` is the number of other ids whose vectors have a cosine of
    ``threshold`` or more with the id's, as far as the search finds them, copies
    included; ``class_id`` is the lowest id that is reached over links, the id
    itself without any.  ``recall`` is the audit's, the same in every row.

    ``overlap`` follows the number of rows if none is given; either way it is
    doubled while the audit finds less than ``RECALL``, and a warning says so if
    it still does at the end.

    A null vector, a vector of zeros, one with a null, NaN or infinite value, and
    one of another length than most (of the greatest such length) has no links.
    A null id has a row with a null class and no links, as often as it occurs.
    Rows that repeat an id and a vector are one; vectors of one id that differ are
    compared one by one, and its links are added.  Ids must be integers; others
    raise a TypeError.  An empty table gives an empty result; other columns are
    ignored.
    """
    kind = vectors.schema[id_col].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"ids must be integers, not {kind}")
    keys = ["fa", "fb", "own"]
    print_of = [F.xxhash64(F.lit(s), F.col("v")).alias(c) for s, c in ((1, "fa"), (2, "fb"))]
    own = _clean(vectors, id_col, vec_col).select(F.col("vec_id").alias("doc_id"), "v", *print_of)
    prints = own_prints(stored(own.select("doc_id", "fa", "fb").distinct(), "prints"))
    reps = stored(prints.groupBy(keys).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "representatives")
    # a representative's row is found by its id and print; rows that repeat them are one
    chosen = own.join(reps.withColumnRenamed("fa", "__fa").withColumnRenamed("fb", "__fb"), (F.col("doc_id") == F.col("rep")) & (F.col("fa") == F.col("__fa")) & (F.col("fb") == F.col("__fb")))
    v = stored(chosen.groupBy("doc_id", "fa", "fb").agg(F.first("v").alias("v"), F.max("copies").alias("copies")).select(F.col("doc_id").alias("vec_id"), "v", "copies"), "vectors")
    n = v.count()
    overlap = overlap or overlap_for(max(n, 1), shard_rows)
    recall, rows = 1.0, None
    for widening in range(WIDENINGS + 1 if n else 0):
        rows = stored(_search(v, n, threshold, shard_rows, overlap, degree, beam, seed), "links")
        seen = audit(v, rows, threshold, seed=seed)
        recall = seen["recall"]
        if recall >= RECALL:
            break
        if widening == WIDENINGS:
            warnings.warn(f"near_classes: audit found {seen['found']} of {seen['expected']} links with an overlap of {overlap}", stacklevel=2)
        overlap *= 2
    if rows is None:
        rows = vectors.sparkSession.createDataFrame([], "a bigint, b bigint, links bigint")
    links = rows.filter("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    of_group = groups(rows.filter("a < b").select("a", "b")).select(F.col("doc_id").alias("rep"), F.col("group").alias("class_id"))
    told = reps.join(links, "rep", "left").join(of_group, "rep", "left").filter("copies > 1 or links is not null")
    told = stored(told.select(*keys, F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "copies"), "classes")
    known = join_told(prints, told, keys).groupBy(F.col("doc_id").alias("__id")).agg(F.min("class_id").alias("class_id"), F.max("links").alias("links"))
    ids = vectors.select(F.col(id_col).alias("vec_id"))
    every = ids.filter("vec_id is not null").distinct().join(known, F.col("vec_id") == F.col("__id"), "left").select("vec_id", F.coalesce("class_id", F.col("vec_id").cast("long")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    none = ids.filter("vec_id is null").select("vec_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return every.unionByName(none).withColumn("recall", F.lit(float(recall)))


def _search(v: DataFrame, n: int, threshold: float, shard_rows: int, overlap: int, degree: int, beam: int, seed: int) -> DataFrame:
    """(a, b, links): a = b with a vector's links in one task, a < b for pairs that join groups."""
    k = max(1, min(-(-n * overlap // shard_rows), MOST_CENTRES))
    fraction = min(1.0, FIT_ROWS / n)
    sample = v.filter(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000)) if fraction < 1 else v
    fit_x = sample.orderBy("vec_id").select("v").toArrow()
    spark = v.sparkSession
    c = spark.sparkContext.broadcast(centres(unit(matrix(fit_x["v"])), k, seed))

    def nearest(column: pa.Array) -> np.ndarray:
        some = min(overlap, len(c.value))
        sim = unit(matrix(column)) @ c.value.T
        top = np.argpartition(-sim, some - 1, axis=1)[:, :some] if some < sim.shape[1] else np.tile(np.arange(some), (len(sim), 1))
        return np.sort(top, axis=1).astype(np.int32)

    def count(batches):
        total = np.zeros(len(c.value), np.int64)
        for b in batches:
            total += np.bincount(nearest(b.column(0)).ravel(), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["shard", "m"])

    sizes = v.select("v").mapInArrow(count, "shard bigint, m bigint").groupBy("shard").agg(F.sum("m").alias("m")).toArrow()
    blocks = np.ones(k, np.int64)
    blocks[sizes["shard"].to_numpy()] = np.maximum(1, -(-sizes["m"].to_numpy() // SHARD_MOST))
    cut = spark.sparkContext.broadcast(blocks)

    def assign(batches):
        for b in batches:
            ids, top = b.column(0).to_numpy(), nearest(b.column(1))
            row, shard = np.repeat(np.arange(len(ids)), top.shape[1]), top.ravel()
            mine = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % cut.value[shard]
            times = cut.value[shard]
            at = np.repeat(np.arange(len(row)), times)
            other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            row, shard, mine = row[at], shard[at], mine[at]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, top.shape[1]), pa.int32()), pa.array(top.ravel()))
            take = pa.array(row)
            columns = [pa.array(shard), pa.array(np.minimum(mine, other)), pa.array(np.maximum(mine, other)), pa.array(mine), b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), lists.take(take)]
            for s in range(0, len(row), 20_000):
                yield pa.RecordBatch.from_arrays([x.slice(s, 20_000) for x in columns], ["shard", "ba", "bb", "block", "vec_id", "v", "copies", "shards"])

    def search(group: pa.Table) -> pa.Table:
        ids, x = group["vec_id"].to_numpy(), unit(matrix(group["v"]))
        order = np.lexsort((*x.T[:1], ids))
        ids, x = ids[order], x[order]
        block, copies = group["block"].to_numpy()[order], group["copies"].to_numpy()[order]
        shards = group["shards"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        me, apart = group["shard"][0].as_py(), group["ba"][0].as_py() != group["bb"][0].as_py()
        lists, closed = build_shard(ids, x, degree, radius=threshold - 1e-6)
        adj = starts = None
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        a, b = [], []
        for q in range(len(x)):
            hit = closed[q]
            if hit is None:
                if adj is None:
                    adj = links_both_ways(lists)
                    # medoids: of the whole graph, and of its coarse parts
                    parts = centres(x, max(1, int(np.sqrt(len(x)) / 4)), seed, 3)
                    starts = np.unique(np.concatenate([[int((x @ unit(x.mean(0, keepdims=True))[0]).argmax())], (x @ parts.T).argmax(0)]))
                hit = range_search(x, adj, np.union1d(starts, [q]), x[q], threshold - 1e-6, beam)
            hit = hit[ids[hit] != ids[q]]
            if not len(hit):
                continue
            ok = x[hit].astype(float) @ x[q].astype(float) >= threshold
            if apart:
                ok &= block[hit] != block[q]
            # a lower shard that both are in has the pair
            lower = shards[q][shards[q] < me]
            if len(lower):
                ok &= ~np.isin(shards[hit], lower).any(1)
            hit = hit[ok]
            links[q] = copies[hit].sum()
            groups_of, first = np.unique(label[hit], return_index=True)
            new = groups_of != label[q]
            for y, g in zip(hit[first[new]], groups_of[new]):
                a.append(min(ids[q], ids[y]))
                b.append(max(ids[q], ids[y]))
                label[label == g] = label[q]
        some = np.flatnonzero(links)
        return pa.table({
            "a": pa.array(np.concatenate([np.array(a, np.int64), ids[some]])), "b": pa.array(np.concatenate([np.array(b, np.int64), ids[some]])),
            "links": pa.array(np.concatenate([np.zeros(len(a), np.int64), links[some]])),
        })

    rows = v.select("vec_id", "v", "copies").mapInArrow(assign, "shard int, ba bigint, bb bigint, block bigint, vec_id bigint, v array<float>, copies bigint, shards array<int>")
    return rows.groupBy("shard", "ba", "bb").applyInArrow(search, "a bigint, b bigint, links bigint")


def audit(v: DataFrame, rows: DataFrame, threshold: float = THRESHOLD, queries: int = 500, seed: int = SEED) -> dict:
    """expected, found and recall of links: hash-chosen vectors of ``v`` (vec_id, v, copies) against all by brute force."""
    asked = v.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(queries).toArrow()
    q_ids, q = asked["vec_id"].to_numpy(), unit(matrix(asked["v"])).astype(float)

    def brute(batches):
        total = np.zeros(len(q_ids), np.int64)
        for batch in batches:
            x, ids, copies = unit(matrix(batch.column(1))).astype(float), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for s in range(0, len(x), 2000):
                near = (q @ x[s : s + 2000].T >= threshold) & (q_ids[:, None] != ids[None, s : s + 2000])
                total += near @ copies[s : s + 2000]
        yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(total)], ["a", "want"])

    want = v.select("vec_id", "v", "copies").mapInArrow(brute, "a bigint, want bigint").groupBy("a").agg(F.sum("want").alias("want"))
    got = rows.filter("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    seen = want.join(got, "a", "left").agg(F.sum("want").alias("expected"), F.sum(F.least("want", F.coalesce("links", F.lit(0)))).alias("found")).first()
    expected, found = seen.expected or 0, seen.found or 0
    return {"expected": expected, "found": found, "recall": found / expected if expected else 1.0}
