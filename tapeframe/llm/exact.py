"""Whole-number vectors: from float columns, and sums of them that are exact at any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeframe.runtime import stage

LARGEST = float(1 << 62)


def floored(vector: Column, scale: int, offset: int = 0) -> Column:
    """floor(scale * x) + offset of every component, as longs."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * float(scale)) + F.lit(offset).cast("long"))


def usable(vector: Column, scale: int) -> Column:
    """Not null, no null or non-finite component, and every scaled component within a long (under 2^62)."""
    fits = F.forall(vector.cast("array<double>"), lambda x: F.coalesce(F.abs(x * float(scale)) < LARGEST, F.lit(False)))
    return F.coalesce(vector.isNotNull() & fits, F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list<long> column as an array of shape (rows, width)."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def position_sums(frame: DataFrame, label: Callable[[np.ndarray], np.ndarray], labels: int, width: int) -> tuple[list[int], list[list[int]]]:
    """Rows per label and the exact sum of each position over them; ``frame`` has one list<long> column.

    Tasks add the upper and the lower 32 bits apart, Spark adds the tasks' sums as decimals, and
    labels x width numbers reach the driver, whatever the number of rows and tasks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, lower = np.zeros((labels, width), dtype=object), np.zeros((labels, width), dtype=object)
        rows = np.zeros(labels, dtype=np.int64)
        for batch in batches:
            values = matrix(batch.column(0), width)
            owner = label(values)
            for k in np.unique(owner):
                own = values[owner == k]
                rows[k] += len(own)
                upper[k] += (own >> 32).sum(axis=0).astype(object)
                lower[k] += (own & 0xFFFFFFFF).sum(axis=0).astype(object)
        if rows.any():
            grid = np.indices((labels, width)).reshape(2, -1)
            whole = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grid[0], pa.int32()), pa.array(grid[1], pa.int32()), pa.array(np.repeat(rows, width)),
                 pa.array(upper.ravel().tolist(), whole), pa.array(lower.ravel().tolist(), whole)],
                names=["label", "at", "n", "upper", "lower"])

    parts = frame.mapInArrow(run, "label int, at int, n bigint, upper decimal(38,0), lower decimal(38,0)")
    summed = parts.groupBy("label", "at").agg(F.sum("n").alias("n"), F.sum("upper").alias("upper"), F.sum("lower").alias("lower"))
    counts, sums = [0] * labels, [[0] * width for _ in range(labels)]
    for row in summed.collect():
        counts[row.label] = row.n
        sums[row.label][row.at] = int(row.upper) * (1 << 32) + int(row.lower)
    return counts, sums


def first_rows(frame: DataFrame, order: list[Column], n: int, name: str) -> list:
    """The n first rows in order; tasks' candidates meet in a task, so n rows reach the driver."""
    return stage(frame.orderBy(*order).limit(n), name).orderBy(*order).collect()
