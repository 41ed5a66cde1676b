"""Approximate nearest neighbours: a robust-pruned directed graph for each shard, searched by beam.

Equal vectors are one point of the index, which keeps the smallest ids of each; the points are dealt to shards by a hash of
their components, so a vector that a third of all rows hold is one point of one shard. In a shard, points join the graph in batches: a greedy
search from the shard's medoid proposes neighbours, and pruning keeps an edge to the nearest and drops those that a kept
one brings nearer by the factor `alpha`. Queries go to every shard; each shard returns its nearest, and the overall
nearest are taken by exact distance. A task reads its shard's points, builds the graph, and then lets the queries stream through it in
blocks, so it holds a shard and a block whatever the number of queries. Shards grow with the square root of the number of points
(up to a bound by memory), so that queries meet fewer of them: what is exchanged grows with the power 1.5 of the table, not 2.

Vectors null, zero, or with a null or non-finite component take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import checkpointed

#: Points of a shard: so many times the square root of all points, but no more than memory holds.
SHARD_FACTOR, MOST_SHARD_POINTS = 32, 400_000
DEGREE = 32
ALPHA = 1.2
BUILD_BEAM = 56
SEARCH_BEAM = 112
#: Points that join a graph, or queries that search it, at once.
BATCH = 256
NEAREST = 10


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, sound) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _distances(points: np.ndarray, to: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of points[ids] (a row for each of `to`) to the rows of `to`; ids below 0: infinite."""
    out = np.full(ids.shape, np.inf)
    row, column = np.nonzero(ids >= 0)
    gap = points[ids[row, column]] - to[row]
    out[row, column] = np.einsum("ij,ij->i", gap, gap)
    return out


def beam_search(points: np.ndarray, edges: np.ndarray, start: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of the best `beam` points met from `start`, for all queries at once; -1 where there are fewer."""
    n, many = len(points), len(queries)
    rows = np.arange(many)[:, None]
    seen = np.zeros((many, n + 1), bool)  # the last column is for -1
    ids = np.full((many, beam), -1)
    ids[:, : len(start)] = start[:beam]
    far = np.full((many, beam), np.inf)
    far[:, : len(start)] = _distances(points, queries, ids[:, : len(start)])
    seen[:, start] = True
    done = np.zeros((many, beam), bool)
    live = np.arange(many)
    while len(live):
        waiting = np.where(done[live] | (ids[live] < 0), np.inf, far[live])
        pick = np.argsort(waiting, axis=1, kind="stable")[:, :2]
        best = np.take_along_axis(waiting, pick, 1)
        going = np.isfinite(best[:, 0])
        live, pick, best = live[going], pick[going], best[going]
        if not len(live):
            break
        at = np.where(np.isfinite(best), np.take_along_axis(ids[live], pick, 1), -1)
        done[live[:, None], pick] = True
        new = np.where(at[:, :, None] >= 0, edges[at], -1).reshape(len(live), -1)
        new[seen[live[:, None], new]] = -1
        seen[live[:, None], new] = True
        seen[:, n] = False
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        both = np.concatenate([far[live], _distances(points, queries[live], new)], axis=1)
        keep = np.argsort(both, axis=1, kind="stable")[:, :beam]
        ids[live] = np.take_along_axis(np.concatenate([ids[live], new], axis=1), keep, 1)
        far[live] = np.take_along_axis(both, keep, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(new.shape, bool)], axis=1), keep, 1)
        ids[~np.isfinite(far)] = -1
    return ids[rows, np.arange(beam)], far


#: Numbers in the tables of products that pruning makes at once.
PRODUCTS = 1 << 21


def robust_prune(points: np.ndarray, own: np.ndarray, options: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point of own, up to `degree` of its options (-1: none), -1 behind them."""
    rows_at_once = max(1, PRODUCTS // max(1, options.shape[1]) ** 2)
    if len(own) > rows_at_once:
        cuts = range(0, len(own), rows_at_once)
        return np.concatenate([robust_prune(points, own[a : a + rows_at_once], options[a : a + rows_at_once], degree, alpha) for a in cuts])
    options = np.where(options == own[:, None], -1, options)
    options = np.sort(options, axis=1)
    options[:, 1:][options[:, 1:] == options[:, :-1]] = -1
    far = _distances(points, points[own], options)
    order = np.argsort(far, axis=1, kind="stable")
    options, far = np.take_along_axis(options, order, 1), np.take_along_axis(far, order, 1)
    used = int(np.isfinite(far).sum(axis=1).max(initial=0))
    options, far = options[:, :used], far[:, :used]
    vectors = points[options]
    products = vectors @ vectors.transpose(0, 2, 1)
    squares = np.einsum("ijj->ij", products)
    kept = np.full((len(own), degree), -1)
    rows = np.arange(len(own))
    for k in range(degree if used else 0):
        first = far.argmin(axis=1)
        some = np.isfinite(far[rows, first])
        if not some.any():
            break
        kept[some, k] = options[rows, first][some]
        gap = squares + squares[rows, first][:, None] - 2 * products[rows, first]
        far[(alpha * alpha * gap <= far) & some[:, None]] = np.inf
        far[rows, first] = np.inf
    return kept


def build(points: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The graph's edges (-1: none) and its starting points."""
    n = len(points)
    edges = np.full((n, degree), -1)
    start = np.array([int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())])
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([start, order[order != start[0]]])
    first = order[: min(n, 2 * degree)]
    edges[first] = robust_prune(points, first, np.tile(first, (len(first), 1)), degree, alpha)
    at, size = len(first), 32
    while at < n:
        new = order[at : at + size]
        at, size = at + len(new), min(BATCH, size * 2)
        # points that join together may be neighbours too
        near = ((points[new] ** 2).sum(axis=1)[:, None] + (points[new] ** 2).sum(axis=1)[None] - 2 * points[new] @ points[new].T).argsort(axis=1)[:, 1:9]
        found, _ = beam_search(points, edges, start, points[new], beam)
        edges[new] = robust_prune(points, new, np.concatenate([found, new[near]], axis=1), degree, alpha)
        source, target = np.repeat(new, degree), edges[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        distinct, begin, count = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(distinct), int(count.max()) if len(count) else 0), -1)
        back[np.repeat(np.arange(len(distinct)), count), np.arange(len(target)) - np.repeat(begin, count)] = source
        free = (edges[distinct] >= 0).sum(axis=1) + count > degree
        roomy = distinct[~free]
        for t, own in zip(roomy, back[~free], strict=True):
            own = own[(own >= 0) & ~np.isin(own, edges[t])]
            used = int((edges[t] >= 0).sum())
            edges[t, used : used + len(own)] = own
        if free.any():
            edges[distinct[free]] = robust_prune(points, distinct[free], np.concatenate([edges[distinct[free]], back[free]], axis=1), degree, alpha)
    return edges, start


def _stacked(vectors: pa.Array) -> np.ndarray:
    """Arrays of one length as rows."""
    return pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _search_shards(nearest: int, beam: int):
    """For batches sorted by shard, size and kind (points before queries): the points found for each query."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, parts, graph, points = None, [], [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("shard", "size", "kind")], axis=1)
            cuts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True])))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                shard, kind, rows = tuple(keys[a, :2]), keys[a, 2], batch.slice(a, b - a)
                if shard != now:
                    now, names, parts, graph = shard, [], [], None
                if kind == 0:
                    names.append(rows.column("id").to_numpy())
                    parts.append(_stacked(rows.column("vector")))
                    continue
                if not parts:
                    continue  # no points of this length
                if graph is None:
                    points, every = np.concatenate(parts), np.concatenate(names)
                    order = np.argsort(every, kind="stable")
                    points, names, parts = points[order], [every[order]], [points[:1]]
                    graph = build(points)
                ids, wanted = rows.column("id").to_numpy(), _stacked(rows.column("vector"))
                for at in range(0, len(ids), BATCH):
                    found, _ = beam_search(points, *graph, wanted[at : at + BATCH], max(beam, nearest + 1))
                    i, j = np.nonzero(found[:, : nearest + 1] >= 0)
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[at + i]), "point": pa.array(names[0][found[i, j]])})

    return search


def shards_of(points: int) -> int:
    return max(1, math.ceil(points / min(MOST_SHARD_POINTS, max(2500, SHARD_FACTOR * math.isqrt(points)))))


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, beam: int = SEARCH_BEAM, shards: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score: each query's nearest rows of vectors but its own, by Euclidean distance.

    vectors: vec_id and embedding; queries: query_id and embedding; whole numbers and arrays of numbers, and any columns more. Embeddings
    of different lengths never meet. Rows of vec_ids that repeat count once for each distinct vector; of several vectors of one query_id the
    least counts.
    """
    part = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = vectors.where(F.col("vec_id").isNotNull()).select("vec_id", part.alias("vector")).where(usable(F.col("vector"))).dropDuplicates()
    # the point of a vector is its smallest id; of the rest as many ids as a result may take
    first = Window.partitionBy("vector").orderBy("vec_id")
    members = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= nearest + 1)
    members = checkpointed(members.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("point", F.xxhash64("vector")))
    shards = shards or shards_of(members.count())
    shard = F.pmod(F.xxhash64("vector", F.lit(1)), F.lit(shards)).cast("int")
    asked = queries.where(F.col("query_id").isNotNull()).select("query_id", part.alias("vector")).where(usable(F.col("vector")))
    asked = checkpointed(asked.groupBy("query_id").agg(F.min("vector").alias("vector")))
    size = F.size("vector").alias("size")
    everywhere = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), size, F.lit(1).alias("kind"), F.col("query_id").alias("id"), "vector")
    indexed = members.select(shard.alias("shard"), size, F.lit(0).alias("kind"), F.col("point").alias("id"), "vector")
    # by ranges of the shards' numbers, which a hash would throw together
    dealt = indexed.unionByName(everywhere).repartitionByRange(shards, "shard", "size").sortWithinPartitions("shard", "size", "kind")
    candidates = dealt.mapInArrow(_search_shards(nearest, beam), "query_id long, point long")
    # only the points' vectors are fetched, and the queries' own
    scored = candidates.join(members, "point").join(asked.withColumnRenamed("vector", "_asked"), "query_id")
    gap = F.aggregate(F.zip_with("vector", "_asked", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y)
    scored = scored.where(F.size("vector") == F.size("_asked")).select("query_id", F.explode("ids").alias("vec_id"), F.sqrt(gap).alias("score")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return scored.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", rank.cast("int")).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    queries = vectors.where(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "query_id")
    return search(vectors, queries)
