"""Centroid clustering of whole-number vectors, nearest centroids found in Walsh-Hadamard coefficients.

The transform is exact in whole numbers and keeps squared distances up to the factor ``width``.  Coefficients are in
the order of their sign changes, coarse to fine.  For every vector the squared differences to each centroid are added
up block by block; a first guess after the coarse blocks gives a full distance, and a centroid whose sum so far is
already strictly greater goes.  What is left after all coefficients is compared exactly, ties to the smaller number.

Rounds read one staged table.  A task adds up its vectors per centroid; centroids x width sums reach the driver.

Defined results: vectors that are null, of another length than ``width``, or hold null or non-finite components take
no part, nor do those with a scaled component of 2^62 or more.  Fewer vectors than centroids make fewer centroids.
Equal start hashes (a repeated id) go by the smaller vector; rows without an id are clustered but start nothing, unless
all ids are missing (then there are no centroids and no rows).  Repeated rows count each.  Distances and sums
beyond a long are null; the clusters stay exact.  Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.llm.exact import first_rows, floored, matrix, position_sums, usable
from tapeframe.runtime import stage

SCALE, WIDTH, CENTROIDS, ROUNDS, SEED = 1024, 64, 8, 10, 3
FIRST = 8  # coefficients before the guess
ROWS = 4096
LONG = 1 << 63


def sequency(width: int) -> np.ndarray:
    """Order of the natural Hadamard rows by their number of sign changes."""
    rows = np.array([[1 - 2 * ((i & j).bit_count() & 1) for j in range(width)] for i in range(width)])
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(axis=1), kind="stable")


def transform(values: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of the rows, coarse first; Python integers where longs could overflow."""
    width = values.shape[1]
    largest = int(np.abs(values).max(initial=0)) if values.dtype != object else max((abs(v) for v in values.ravel().tolist()), default=0)
    out = values.astype(object if (2 * width * largest) ** 2 * width >= LONG else np.int64)
    half = 1
    while half < width:
        pairs = out.reshape(len(out), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), width)
        half *= 2
    return out[:, sequency(width)]


def nearest(points: np.ndarray, centres: np.ndarray, first: int = FIRST) -> tuple[np.ndarray, np.ndarray]:
    """(number, distance * width) of the nearest centre of each row; both given as coefficients."""
    n, width = points.shape
    if object in (points.dtype, centres.dtype):
        points, centres = points.astype(object), centres.astype(object)

    def part(rows, numbers, low, high):
        apart = points[rows, low:high] - centres[numbers, low:high]
        return (apart * apart).sum(axis=1)

    rows, numbers = np.divmod(np.arange(n * len(centres)), len(centres))
    total = part(rows, numbers, 0, first)
    guess = total.reshape(n, -1).argmin(axis=1)
    least = total.reshape(n, -1)[np.arange(n), guess] + part(np.arange(n), guess, first, width)
    low = first
    while low < width:
        left = total <= least[rows]
        rows, numbers, total = rows[left], numbers[left], total[left]
        high = min(width, 2 * low)
        total = total + part(rows, numbers, low, high)
        low = high
    order = np.lexsort((numbers, total, rows)) if total.dtype != object else np.array(
        sorted(range(len(rows)), key=lambda i: (rows[i], total[i], numbers[i])), dtype=np.int64)
    begin = order[np.searchsorted(rows[order], np.arange(n))]
    return numbers[begin], total[begin]


def labelled(values: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = [nearest(transform(values[at:at + ROWS]), centres) for at in range(0, len(values), ROWS)]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def cluster(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE,
            width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """key, cluster, distance (squared), cluster_inertia, inertia, centroid (array<decimal(38,0)>), centroid_sha256; one row for each usable row.

    ``width`` is a power of two of at least 8.
    """
    if width < FIRST or width & (width - 1):
        raise ValueError("width must be a power of two of at least 8")
    key_type = rows.schema[key].dataType.simpleString()
    kept = stage(rows.where(usable(F.col(vector), scale) & (F.size(vector) == width))
                 .select(F.col(key).alias("key"), floored(F.col(vector), scale).alias("v")), "vectors")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    starts = first_rows(kept.where(F.col("key").isNotNull()).select(drawn.alias("draw"), "v"), [F.col("draw"), F.col("v")], centroids, "starts")
    centres = [list(row.v) for row in starts]
    if not centres:
        return rows.sparkSession.createDataFrame([], f"{key} {key_type}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, "
                                                     "centroid array<decimal(38,0)>, centroid_sha256 string")

    def coefficients(now: list[list[int]]) -> np.ndarray:
        return transform(np.array(now, dtype=np.int64))

    for _ in range(rounds):
        fixed = coefficients(centres)
        counts, sums = position_sums(kept.select("v"), lambda values, fixed=fixed: labelled(values, fixed)[0], len(centres), width)
        centres = [[s // n for s in own] if n else old for n, own, old in zip(counts, sums, centres)]
    fixed = coefficients(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, total = labelled(matrix(batch.column(1), width), fixed)
            distance = [t // width for t in total.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int32()), pa.array([d if d < LONG else None for d in distance], pa.int64())],
                                             names=["key", "cluster", "distance"])

    placed = stage(kept.mapInArrow(run, f"key {key_type}, cluster int, distance bigint"), "placed")
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r.cluster: r.total for r in placed.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), whole).alias("total")).collect()}
    total = None if None in inertia.values() else sum(inertia.values())
    known = lambda v: F.lit(int(v) if v is not None and v < LONG else None).cast("long")
    text = [",".join(map(str, c)) for c in centres]
    digest = F.array(*[F.lit(hashlib.sha256(t.encode()).hexdigest()) for t in text])
    lists = F.array(*[F.split(F.lit(t), ",").cast("array<decimal(38,0)>") for t in text])
    at = F.col("cluster") + 1
    return placed.select(F.col("key").alias(key), "cluster", "distance",
                         F.element_at(F.array(*[known(inertia.get(c)) for c in range(len(centres))]), at).alias("cluster_inertia"),
                         known(total).alias("inertia"), F.element_at(lists, at).alias("centroid"), F.element_at(digest, at).alias("centroid_sha256"))


def checking_sql(centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: int = SEED) -> str:
    """The same rows from all distances: one pair of CTEs for each round."""
    square = f"CAST(list_sum(list_transform(range(1, {width + 1}), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) AS BIGINT)"
    parts = [f"""
p AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""", f"""
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v FROM p WHERE vec_id IS NOT NULL ORDER BY c LIMIT {centroids})"""]
    for k in range(rounds + 1):
        parts.append(f"""
a{k} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT p.r, p.vec_id, p.v, c.c, {square} AS d FROM p CROSS JOIN c{k} c) GROUP BY r)""")
        if k < rounds:
            parts.append(f"""
c{k + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.v, c.v) AS v FROM c{k} c LEFT JOIN (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
    SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, {width + 1})) AS i FROM a{k}) GROUP BY c, i) GROUP BY c) n ON n.c = c.c)""")
    return f"""WITH {','.join(parts)}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"""
