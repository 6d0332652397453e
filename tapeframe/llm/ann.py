"""Approximate nearest neighbours by a robust-pruned directed graph in every shard.

Vectors are dealt by hash over shards of about ``SHARD`` different vectors.  A shard's graph is built in batches: a
beam search over what is there already proposes neighbours for the new points, and relaxed distance pruning keeps an
edge only if no kept neighbour is ``alpha`` times closer to its end, so few but diverse edges remain; edges are added
in both directions and full lists pruned again.  Every query is searched in every shard with a beam, what it finds is
measured again in double precision on the original vectors, and the shards' lists are merged.

Equal vectors are one point of the graph.  A point carries the k + 1 smallest ids of its copies, which is all that a
list of k neighbours can use, so a vector that a third of all rows share costs one point.

A task streams its shards: index rows come first, then the queries in bounded batches.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows without an id, take no
part; vectors of another length than the query's are no candidates; a query id that occurs more than once is asked
once, with its smallest vector; ties go to the smaller id; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.runtime import stage

SHARD, DEGREE, BEAM, ALPHA, BATCH = 4096, 24, 64, 1.2, 256
EXPANDED_AT_ONCE = 4
ENTRIES = 8


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("...d,...d->...", a - b, a - b)


class Graph:
    """Directed neighbour lists over the vectors of one shard."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 5):
        self.vectors, self.degree, self.beam, self.alpha = np.ascontiguousarray(vectors, dtype=np.float32), degree, beam, np.float32(alpha)
        n = len(vectors)
        self.edges = np.full((n, degree), -1, dtype=np.int32)
        centre = self.vectors.mean(axis=0)
        order = np.random.default_rng(seed).permutation(n)
        middle = int(np.argmin(squared(self.vectors, centre)))
        order = np.concatenate(([middle], order[order != middle]))
        self.entries = order[:ENTRIES].astype(np.int32)
        at = min(n, ENTRIES)
        self.connect(order[:at], np.tile(order[:at], (at, 1)))
        while at < n:
            new = order[at:at + min(BATCH, at)]
            found, _ = self.search(self.vectors[new], beam)
            self.connect(new, np.concatenate([found, self.neighbours_of(found[:, :2])], axis=1))
            at += len(new)

    def neighbours_of(self, points: np.ndarray) -> np.ndarray:
        return np.where(points[..., None] >= 0, self.edges[points], -1).reshape(len(points), -1)

    def pruned(self, points: np.ndarray, proposed: np.ndarray) -> np.ndarray:
        """Diverse neighbours of each point from its proposals (-1: none)."""
        own = self.vectors[points]
        ordered = np.sort(proposed, axis=1)
        repeated = np.zeros(ordered.shape, dtype=bool)
        repeated[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
        alive = (ordered >= 0) & (ordered != points[:, None]) & ~repeated
        ends = self.vectors[ordered]
        distance = np.where(alive, squared(ends, own[:, None]), np.inf).astype(np.float32)
        norm = np.einsum("bcd,bcd->bc", ends, ends)
        between = np.maximum(norm[:, :, None] + norm[:, None, :] - 2 * ends @ ends.transpose(0, 2, 1), 0)
        kept, rows = np.full((len(points), self.degree), -1, dtype=np.int32), np.arange(len(points))
        for i in range(self.degree):
            pick = np.argmin(distance, axis=1)
            good = np.isfinite(distance[rows, pick])
            if not good.any():
                break
            kept[good, i] = ordered[rows, pick][good]
            covered = self.alpha * self.alpha * between[rows, pick] <= distance
            distance[covered & good[:, None]] = np.inf
            distance[rows, pick] = np.inf
        return kept

    def connect(self, points: np.ndarray, proposed: np.ndarray) -> None:
        self.edges[points] = self.pruned(points, proposed)
        source = np.repeat(points, self.degree)
        target = self.edges[points].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        ends, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        back = np.full((len(ends), count.max(initial=0)), -1, dtype=np.int32)
        back[np.repeat(np.arange(len(ends)), count), place] = source
        for at in range(0, len(ends), BATCH):
            some = ends[at:at + BATCH]
            self.edges[some] = self.pruned(some, np.concatenate([self.edges[some], back[at:at + BATCH]], axis=1))

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries at once: points (-1: none) and squared distances, nearest first."""
        queries = queries.astype(np.float32)
        n, rows = len(queries), np.arange(len(queries))[:, None]
        seen = np.zeros((n, len(self.vectors) + 1), dtype=bool)
        points = np.full((n, beam), -1, dtype=np.int32)
        distance, open_ = np.full((n, beam), np.inf, dtype=np.float32), np.zeros((n, beam), dtype=bool)
        new = np.tile(self.entries, (n, 1))
        while True:
            new = np.where(seen[rows, new], -1, new)
            ordered = np.sort(new, axis=1)
            ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
            seen[rows, ordered] = True
            seen[:, -1] = False
            far = np.where(ordered >= 0, squared(self.vectors[ordered], queries[:, None]), np.inf).astype(np.float32)
            points, distance = np.concatenate([points, ordered], axis=1), np.concatenate([distance, far], axis=1)
            open_ = np.concatenate([open_, np.isfinite(far)], axis=1)
            best = np.argsort(distance, axis=1, kind="stable")[:, :beam]
            points, distance, open_ = points[rows, best], distance[rows, best], open_[rows, best]
            if not open_.any():
                return points, distance
            turn = np.cumsum(open_, axis=1)
            chosen = open_ & (turn <= EXPANDED_AT_ONCE)
            place = np.argsort(~chosen, axis=1, kind="stable")[:, :EXPANDED_AT_ONCE]
            taken = chosen[rows, place]
            open_ &= ~chosen
            new = np.where(taken[..., None], self.edges[points[rows, place]], -1).reshape(n, -1)


def nearest_in_shard(vectors: np.ndarray, ids: list[list], graph: Graph, names: list, queries: np.ndarray, k: int, beam: int) -> Iterator[tuple]:
    """(query, id, distance) of the k nearest ids that the graph finds, measured in double precision."""
    found, _ = graph.search(queries, beam)
    for name, query, points in zip(names, queries, found):
        points = points[points >= 0]
        if len(points) < min(k + 1, len(vectors)):
            points = np.arange(len(vectors))  # a part of a tiny graph that no edge leads to
        score = np.sqrt(squared(vectors[points], query))
        order = np.argsort(score, kind="stable")
        listed: list[tuple[float, object]] = []
        for i in order.tolist():
            if len(listed) >= k and score[i] > listed[k - 1][0]:
                break
            listed = sorted([*listed, *((float(score[i]), v) for v in ids[points[i]] if v != name)])
        yield from ((name, v, s) for s, v in listed[:k])


def shard_search(k: int, degree: int, beam: int, alpha: float, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, graph, vectors, ids = None, None, [], []

        def answered(names, queries):
            nonlocal graph, vectors
            if graph is None:
                vectors = np.array(vectors, dtype=np.float64)
                graph = Graph(vectors, degree, beam, alpha)
            rows = list(nearest_in_shard(vectors, ids, graph, names, np.array(queries, dtype=np.float64), k, beam))
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), pa.array(columns[1], id_type), pa.array(columns[2], pa.float64())],
                                                 names=["query_id", "vec_id", "score"])

        for batch in batches:
            names, queries = [], []
            for row in batch.to_pylist():
                here = (row["dim"], row["shard"])
                if here != shard:
                    if names:
                        yield from answered(names, queries)
                        names, queries = [], []
                    shard, graph, vectors, ids = here, None, [], []
                if row["kind"] == 0:
                    vectors.append(row["vector"])
                    ids.append(row["ids"])
                elif len(vectors):
                    names.append(row["ids"][0])
                    queries.append(row["vector"])
                    if len(names) == BATCH:
                        yield from answered(names, queries)
                        names, queries = [], []
            if names:
                yield from answered(names, queries)

    return run


def search(base: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", shard_size: int = SHARD,
           degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of base found for each row of queries, its own id left out."""
    key_type = base.schema[key].dataType
    double = F.col(vector).cast("array<double>")
    clean = lambda frame: frame.select(F.col(key).alias("id"), double.alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    by_vector = Window.partitionBy("vector").orderBy("id")
    few = clean(base).withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)  # all that k neighbours can need
    points = stage(few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
    shards = max(1, -(-points.count() // shard_size))
    dim = F.size("vector").alias("dim")
    indexed = points.select(dim, F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "vector", "ids")
    asked = clean(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    asked = asked.select(dim, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vector", F.array("id").alias("ids"))
    together = indexed.union(asked).repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    arrow_type = pa.string() if key_type.simpleString() == "string" else pa.int64()
    kind = key_type.simpleString()
    found = together.mapInArrow(shard_search(k, degree, beam, alpha, arrow_type), f"query_id {'string' if kind == 'string' else 'bigint'}, "
                                f"vec_id {'string' if kind == 'string' else 'bigint'}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(
        F.col("query_id").cast(key_type), "rank", F.col("vec_id").cast(key_type).alias("vec_id"), "score")
