"""SimHash near-duplicates, linked through a Gray-ordered hierarchical index.

Fingerprints are made once per document.  Equal fingerprints are one vertex.  To find those that differ in few bits
without comparing everything, a fingerprint is sent to every choice of two of ``distance + 2`` blocks of its bits:
two fingerprints within the distance agree on at least two blocks.  The shared blocks are the topmost masked pattern
of an index; below it the fingerprints of a group are sorted by Gray rank and cut into runs, each run's common bits
are factored out into its node, and nodes hold only the bits that their parent has not got.  A search adds up the
differences from the top down and drops a whole subtree once they exceed the distance, or once the subtree is known
to be in the query's own component.

Groups over ``limit`` fingerprints are split again: any five-way split of the bit positions has a class without a
difference (for distance 4), so their members move to five finer groups each.  After three splits nearly all
positions are fixed and what is left is small.  Per group only enough links to connect it leave the task.

Defined results: null and wordless texts have fingerprint 0 and link like any other; texts under the shingle length
count as one shingle; repeated rows each get a row; a component has the smallest key that can be reached (null keys
are ignored for it); other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.llm.components import connected
from tapeframe.runtime import stage

SHINGLE, SEED, DISTANCE = 4, 42, 4
CHUNK = 1 << 15
FAN_OUT = 8
QUERIES_AT_ONCE = 1024
RUN_ROWS = 50_000
FULL = (1 << 64) - 1


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Majority bits of the XXH64 values of all word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > size:
        ends, starts = ends[size - 1:], starts[:len(words) - size + 1]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts, hasher = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        s, e = starts[at:at + CHUNK].tolist(), ends[at:at + CHUNK].tolist()
        counts += bit_counts(np.array([hasher(joined[i:j], SEED) for i, j in zip(s, e)], dtype=np.uint64))
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (64 bits as a long); one row for each row of docs."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py() or b"") for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["key", "fingerprint"])

    out = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    return out.mapInArrow(run, f"key {key_type}, fingerprint bigint").withColumnRenamed("key", key)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence: a running xor over the bits from the top."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Index over fingerprints that are sorted by (group, Gray rank); level 0 holds the fingerprints."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray):
        self.codes, self.groups = codes, groups
        all_or, all_and, group = codes, codes, groups
        self.common, self.pattern, self.start, self.last = [np.full(len(codes), FULL, np.uint64)], [codes], [None], [np.arange(len(codes))]
        while True:
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            if len(self.start) > 1 and len(first) == len(group):
                break
            place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            start = np.flatnonzero(place % FAN_OUT == 0)
            all_or, all_and = np.bitwise_or.reduceat(all_or, start), np.bitwise_and.reduceat(all_and, start)
            ends = np.append(start[1:], len(group))
            self.start.append(np.append(start, len(group)))
            self.last.append(self.last[-1][ends - 1])
            same = ~(all_or ^ all_and)
            parent = np.repeat(np.arange(len(start)), ends - start)
            self.common[-1] = self.common[-1] & ~same[parent]
            self.pattern.append(all_and)
            self.common.append(same)
            group = group[start]
        self.top_of = np.cumsum(np.concatenate(([0], groups[1:] != groups[:-1]))).astype(np.int64)

    def uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """Per level the label that all members of a node share, else -1."""
        low = high = labels
        out = [labels]
        for start in self.start[1:]:
            low, high = np.minimum.reduceat(low, start[:-1]), np.maximum.reduceat(high, start[:-1])
            out.append(np.where(low == high, low, -1))
        return out

    def search(self, queries: np.ndarray, distance: int, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, later fingerprint of its group) within the distance whose labels differ."""
        shared, level = self.uniform(labels), len(self.start) - 1
        query, node = queries, self.top_of[queries]
        differing = np.bitwise_count((self.codes[query] ^ self.pattern[level][node]) & self.common[level][node])
        while True:
            keep = (differing <= distance) & (self.last[level][node] > query) & (shared[level][node] != labels[query])
            query, node, differing = query[keep], node[keep], differing[keep]
            if level == 0:
                return query, node
            start = self.start[level]
            width = start[node + 1] - start[node]
            query, differing = np.repeat(query, width), np.repeat(differing, width)
            node = np.repeat(start[node] - np.cumsum(width) + width, width) + np.arange(len(query))
            level -= 1
            differing = differing + np.bitwise_count((self.codes[query] ^ self.pattern[level][node]) & self.common[level][node])


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest-index labels after joining the ends of all given pairs."""
    while True:
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            return labels
        a, b = a[open_], b[open_]
        np.minimum.at(labels, np.maximum(la, lb)[open_], np.minimum(la, lb)[open_])
        while not np.array_equal(labels, up := labels[labels]):
            labels = up


def link_groups(codes: np.ndarray, groups: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints that connect each group's parts as all pairs within the distance would."""
    order = np.lexsort((gray_rank(codes), groups))
    codes, groups = codes[order], groups[order]
    labels = np.arange(len(codes))
    near = np.flatnonzero((groups[1:] == groups[:-1]) & (np.bitwise_count(codes[1:] ^ codes[:-1]) <= distance))
    labels = unite(labels, near, near + 1)
    index = GrayIndex(codes, groups)
    for at in range(0, len(codes), QUERIES_AT_ONCE):
        a, b = index.search(np.arange(at, min(at + QUERIES_AT_ONCE, len(codes))), distance, labels)
        if len(a):
            labels = unite(labels, a, b)
    member = np.flatnonzero(labels != np.arange(len(codes)))
    return codes[labels[member]], codes[member]


def links_of_runs(distance: int):
    """Streams rows sorted by group; whole groups are gathered into runs and linked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def linked(mask, part, code):
            new = np.concatenate(([True], (mask[1:] != mask[:-1]) | (part[1:] != part[:-1])))
            a, b = link_groups(code.view(np.uint64), np.cumsum(new), distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            rows += batch.num_rows
            if rows >= RUN_ROWS:
                mask, part, code = (np.concatenate(c) for c in zip(*held))
                cut = np.flatnonzero((mask != mask[-1]) | (part != part[-1]))
                whole = cut[-1] + 1 if len(cut) else 0
                if whole:
                    yield linked(mask[:whole], part[:whole], code[:whole])
                held, rows = [[mask[whole:], part[whole:], code[whole:]]], 0
        if held:
            columns = [np.concatenate(c) for c in zip(*held)]
            if len(columns[0]):
                yield linked(*columns)

    return run


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(distance: int) -> list[int]:
    """Every choice of two of ``distance + 2`` nearly equal blocks of bits."""
    blocks = distance + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    single = [((1 << (z - a)) - 1) << a for a, z in zip(edges, edges[1:])]
    return [signed(a | b) for a, b in combinations(single, 2)]


def class_masks(level: int, distance: int) -> list[int]:
    """Bit positions by one digit of their number in base ``distance + 1``."""
    base = distance + 1
    return [signed(sum(1 << i for i in range(64) if i // base**level % base == j)) for j in range(base)]


def hamming_links(codes: DataFrame, distance: int = DISTANCE, limit: int = 4096) -> DataFrame:
    """codes (fingerprint, distinct) -> a, b: links with the same components as all pairs within the distance."""
    code = F.col("fingerprint")

    def keyed(rows: DataFrame, masks) -> DataFrame:
        out = rows.select(F.explode(masks).alias("mask"), "fingerprint")
        return out.withColumn("part", code.bitwiseAND(F.col("mask"))).select("mask", "part", "fingerprint")

    found, level = [], 0
    rows = keyed(codes, F.array(*map(F.lit, block_masks(distance))))
    while True:
        large = stage(rows.groupBy("mask", "part").count().where(F.col("count") > limit).select("mask", "part"), "groups")
        split = level < 3 and not large.isEmpty()
        small = rows.join(large, ["mask", "part"], "left_anti") if split else rows
        grouped = small.repartition("mask", "part").sortWithinPartitions("mask", "part")
        found.append(stage(grouped.mapInArrow(links_of_runs(distance), "a bigint, b bigint"), "links"))
        if not split:
            break
        finer = F.array(*(F.col("mask").bitwiseOR(F.lit(m)) for m in class_masks(level, distance)))
        rows = keyed(stage(rows.join(large, ["mask", "part"], "left_semi").select("mask", "fingerprint").withColumn("finer", finer).select(
            F.explode("finer").alias("mask"), "fingerprint").distinct(), "finer"), F.array("mask"))
        level += 1
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, limit: int = 4096) -> DataFrame:
    """key, fingerprint (long), component_id (smallest key reachable); one row for each row of docs."""
    made = stage(fingerprints(docs, key, text).withColumnRenamed(key, "__key"), "fingerprints")
    codes = stage(made.groupBy("fingerprint").agg(F.min("__key").alias("least")), "codes")
    roots = connected(hamming_links(codes.select("fingerprint"), distance, limit))
    rooted = codes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    rooted = stage(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fingerprint", "root").join(least, "root").select("fingerprint", "component_id")
    return made.join(named, "fingerprint").select(F.col("__key").alias(key), "fingerprint", "component_id")
