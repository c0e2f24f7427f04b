"""Approximate nearest neighbours with a robust-pruned directed graph per shard.

Vectors are dealt to shards of bounded size. In each shard points enter the graph in growing
batches: a greedy beam search from the entry point proposes neighbours, and relaxed distance pruning
(a candidate goes if a kept one is ``RELAX`` times closer to it than the point is) keeps diverse
edges, which are also added backwards and pruned again where a point has too many. Queries go
through every shard's graph by beam search, in blocks, and the shards' best are merged.

Nearness is the inner product. For the graph, vectors get one more coordinate that makes all norms
equal, so that Euclidean order is inner-product order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.storage import Scratch

SHARD = 16_384  # vectors in one graph
QUERY_BLOCK = 65_536  # queries that meet a shard in one task
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 128
RELAX = 1.2
_BATCH = 512


def _search(points, graph, entry: int, queries, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query the ids (-1: none) and squared distances of the ``beam`` nearest points met."""
    n, rows = len(queries), np.arange(len(queries))
    ids = np.full((n, beam), -1, np.int64)
    far = np.full((n, beam), np.inf, np.float32)
    ids[:, 0] = entry
    far[:, 0] = ((queries - points[entry]) ** 2).sum(axis=1)
    done = ids < 0
    seen = np.zeros((n, len(points)), bool)
    seen[:, entry] = True
    active = rows
    while len(active):
        first = np.argmin(done[active], axis=1)
        node = ids[active, first]
        done[active, first] = True
        near = graph[node].astype(np.int64)
        fresh = (near >= 0) & ~seen[active[:, None], near]
        seen[np.broadcast_to(active[:, None], near.shape)[fresh], near[fresh]] = True
        gap = points[near] - queries[active][:, None, :]
        distance = np.where(fresh, np.einsum("ijk,ijk->ij", gap, gap), np.inf).astype(np.float32)
        all_far = np.concatenate([far[active], distance], axis=1)
        keep = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        far[active] = np.take_along_axis(all_far, keep, 1)
        new = np.take_along_axis(np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1), keep, 1)
        seen_done = np.concatenate([done[active], ~fresh], axis=1)
        ids[active] = new
        done[active] = np.take_along_axis(seen_done, keep, 1) | (new < 0)
        active = active[~done[active].all(axis=1)]
    return ids, far


def _prune(points, own: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """Robust pruning of each row's candidates (-1: none) around the points ``own``."""
    valid = (candidates >= 0) & (candidates != own[:, None])
    vectors = points[np.maximum(candidates, 0)]
    gap = vectors - points[own][:, None, :]
    distance = np.where(valid, np.einsum("ijk,ijk->ij", gap, gap), np.inf)
    order = np.argsort(distance, axis=1, kind="stable")
    candidates, distance = np.take_along_axis(candidates, order, 1), np.take_along_axis(distance, order, 1)
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    square = np.einsum("ijk,ijk->ij", vectors, vectors)
    between = square[:, :, None] + square[:, None, :] - 2 * (vectors @ vectors.transpose(0, 2, 1))
    alive = np.isfinite(distance)
    alive[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    kept = np.full((len(own), degree), -1, np.int32)
    rows = np.arange(len(own))
    for slot in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        pick = np.argmax(alive, axis=1)
        kept[some, slot] = candidates[rows, pick][some]
        alive &= RELAX**2 * between[rows, pick] > distance
        alive[rows, pick] = False
    return kept


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> tuple[np.ndarray, int]:
    """Out-edges per point (-1: none) and the entry point of distinct ``points``."""
    n = len(points)
    if n <= degree + 1:  # every edge fits
        full = np.tile(np.arange(n, dtype=np.int32), (n, 1))
        return full[~np.eye(n, dtype=bool)].reshape(n, n - 1) if n > 1 else np.full((1, 1), -1, np.int32), 0
    room = degree + degree // 2  # backward edges fill this much before a point is pruned again
    graph = np.full((n, room), -1, np.int32)
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(0).permutation(n)
    order = order[order != entry]
    done = 0
    while done < len(order):
        batch = order[done : done + min(_BATCH, max(1, done))]
        found, _ = _search(points, graph, entry, points[batch], beam)
        graph[batch, :degree] = _prune(points, batch, found, degree)
        source = np.repeat(batch, degree)
        target = graph[batch, :degree].ravel()
        source, target = source[target >= 0], target[target >= 0]
        gap = points[source] - points[target]
        near_first = np.lexsort((np.einsum("ij,ij->i", gap, gap), target))
        source, target = source[near_first], target[near_first]
        nodes, begins, counts = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(begins, counts)
        fits = place < 2 * degree  # the nearest new edges of a point compete with its old ones
        extra = np.full((len(nodes), int(min(counts.max(), 2 * degree))), -1, np.int64)
        extra[np.repeat(np.arange(len(nodes)), counts)[fits], place[fits]] = source[fits]
        for a in range(0, len(nodes), _BATCH):
            own = nodes[a : a + _BATCH]
            both = np.concatenate([graph[own].astype(np.int64), extra[a : a + _BATCH]], axis=1)
            roomy = (both >= 0).sum(axis=1) <= room
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :room]
            graph[own] = np.where(roomy[:, None], packed, -1)
            if (~roomy).any():
                graph[own[~roomy], :degree] = _prune(points, own[~roomy], both[~roomy], degree)
        done += len(batch)
    return graph, entry


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    array = column.combine_chunks()
    array = array.chunk(0) if isinstance(array, pa.ChunkedArray) else array
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1)


def _lifted(vectors: np.ndarray) -> np.ndarray:
    """Distinct vectors with the extra coordinate."""
    square = (vectors.astype(float) ** 2).sum(axis=1)
    last = np.sqrt(np.maximum(square.max() - square, 0))
    return np.concatenate([vectors.astype(float), last[:, None]], axis=1).astype(np.float32)


_INDEX = "shard int, place int, vec_id long, vector array<double>, edges array<int>, entry boolean"
_INDEX_TYPES = pa.schema(
    [
        ("shard", pa.int32()),
        ("place", pa.int32()),
        ("vec_id", pa.int64()),
        ("vector", pa.list_(pa.float64())),
        ("edges", pa.list_(pa.int32())),
        ("entry", pa.bool_()),
    ]
)


def _index(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The shard's rows; those with equal vectors share a place, the first of which has edges."""
    table = table.sort_by("vec_id")
    vectors = _matrix(table["vector"])
    distinct, place = np.unique(vectors, axis=0, return_inverse=True)
    place = place.ravel()
    graph, entry = build_graph(_lifted(distinct))
    first = np.zeros(len(place), bool)
    first[np.unique(place, return_index=True)[1]] = True
    edges = [graph[p][graph[p] >= 0] if f else None for p, f in zip(place, first, strict=True)]
    return pa.Table.from_arrays(
        [
            pa.array(np.full(len(place), key[0].as_py(), np.int32)),
            pa.array(place.astype(np.int32)),
            table["vec_id"].combine_chunks(),
            table["vector"].combine_chunks(),
            pa.array(edges, pa.list_(pa.int32())),
            pa.array(place == entry),
        ],
        schema=_INDEX_TYPES,
    )


def _answer(k: int, beam: int):
    def answer(_key: tuple[pa.Scalar, ...], index: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "query", "vec_id", "score"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        if not index.num_rows or not queries.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names=names)
        index = index.sort_by([("place", "ascending"), ("vec_id", "ascending")])
        place, ids = index["place"].to_numpy(), index["vec_id"].to_numpy()
        vectors, starts = _matrix(index["vector"]), np.flatnonzero(np.diff(place, prepend=-1))
        ends = np.append(starts[1:], len(place))
        points, lists = vectors[starts], index["edges"].to_pylist()
        edges = [next(lists[i] for i in range(a, b) if lists[i] is not None) for a, b in zip(starts, ends, strict=True)]
        graph = np.full((len(points), max(1, *map(len, edges))), -1, np.int32)
        for i, own in enumerate(edges):
            graph[i, : len(own)] = own
        entry = int(place[np.argmax(index["entry"].to_numpy(zero_copy_only=False))])
        lifted = _lifted(points)
        wanted, asked = _matrix(queries["vector"]), queries["query_id"].to_numpy()
        number = queries["query"].to_numpy()
        out = []
        for a in range(0, len(wanted), _BATCH):
            own = wanted[a : a + _BATCH]
            padded = np.concatenate([own, np.zeros((len(own), 1))], axis=1).astype(np.float32)
            found, _ = _search(lifted, graph, entry, padded, max(beam, 2 * k))
            score = np.einsum("ijk,ik->ij", points[np.maximum(found, 0)], own)
            score[found < 0] = -np.inf
            for i, near in enumerate(np.argsort(-score, axis=1, kind="stable")):
                rows, least, got = [], None, 0
                for j in near.tolist():
                    at = found[i, j]
                    if at < 0 or (got > k and score[i, j] < least):
                        break
                    copies = ids[starts[at] : ends[at]][: k + 1]
                    rows += [(int(v), score[i, j]) for v in copies.tolist()]
                    got, least = len(rows), score[i, j]
                rows = sorted((-s, v) for v, s in rows if v != asked[a + i])[:k]
                out += [(asked[a + i], number[a + i], v, -s) for s, v in rows]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return answer


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, vector`` in double precision, without vectors that are null, zero or hold null or
    non-finite components, and without lengths other than the most frequent (smaller at a tie).
    Repeated rows count once."""
    rows = vectors.select(
        F.col("vec_id").cast("long"), F.col(vector).cast("array<double>").alias("vector")
    ).where(
        F.col("vec_id").isNotNull()
        & F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
        & F.exists("vector", lambda x: x != 0)
    )
    length = F.size("vector")
    usual = rows.groupBy(length.alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(length == (usual.d if usual else 0)).dropDuplicates(["vec_id", "vector"])


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, shard: int = SHARD, beam: int = SEARCH_BEAM
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` the ``k`` nearest rows of
    ``vectors`` that the graphs find, without the query's own id; ties go to the smaller id.

    Both come from :func:`usable`. With fewer candidates all are returned; without any, none.
    A query id with several vectors is answered per vector, and the answers are merged by score.
    """
    scratch = Scratch(vectors.sparkSession, "graph")
    stored = scratch.store(vectors)
    shards = -(-max(stored.count(), 1) // shard)
    dealt = stored.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int"))
    index = scratch.store(dealt.groupBy("shard").applyInArrow(_index, _INDEX))
    asked = queries.select(F.col("vec_id").alias("query_id"), "vector", F.xxhash64("vector").alias("query"))
    blocks = -(-max(asked.count(), 1) // QUERY_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("block", every(blocks)).groupBy("shard", "block")
    right = (
        asked.withColumn("block", F.pmod(F.xxhash64("query_id", "vector"), F.lit(blocks)).cast("int"))
        .withColumn("shard", every(shards))
        .groupBy("shard", "block")
    )
    found = left.cogroup(right).applyInArrow(
        _answer(k, beam), "query_id long, query long, vec_id long, score double"
    )
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
