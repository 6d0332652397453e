"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over a window of tokens; positions the mask leaves out are not hashed, so a replaced
word there does not hide a match.  Every window of every benchmark item and of every text is hashed under each mask.
A text window whose hash an item has too is a hit; it fixes how the two are aligned.  Around the hit the longest
stretch with at least ``similarity`` equal tokens is taken, and it counts if it covers ``coverage`` of the item.

The join of the hashes needs no shuffle of the texts: items are sent to the tasks in blocks of at most
``BLOCK_TOKENS`` tokens (a proven bound), and a benchmark over that is worked off block by block.

Defined results: tokens are runs of word characters, lower-cased; items of equal tokens are one class, named by its
smallest item_id; items under ``MIN_TOKENS`` tokens, null and empty ones match nothing; items shorter than the seeds
must occur as a whole; null and empty texts have no matches; repeated rows are judged one by one; of several
alignments of a text and an item the one with most equal tokens is reported (ties: the earliest).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.runtime import stage

# 1: hashed, 0: ignored.  Weight 6, so that one replaced word in five leaves hits in texts of item length.
MASKS = ("111111", "1110010011", "1101001011", "1011010101", "110011000101")
SIMILARITY, COVERAGE, MIN_TOKENS = 0.8, 0.5, 5
BLOCK_TOKENS = 1_000_000
TOKENS_AT_ONCE = 1 << 17
FILTER_BITS = 22
CACHED_TOKENS = 300_000
CACHED_LENGTH = 40
TOKEN = re.compile(r"\w+")
SPAN = max(map(len, MASKS))
NO_WINDOW = np.uint64(0)


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


class TokenHashes(dict):
    def __missing__(self, token: str) -> int:
        value = xxhash.xxh64_intdigest(token.encode("utf-8", "replace"))
        if len(token) <= CACHED_LENGTH:
            if len(self) >= CACHED_TOKENS:
                self.clear()
            self[token] = value
        return value

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def seeds_for(lengths: set[int]) -> list[tuple[int, ...]]:
    """Hashed positions of the masks, and whole windows for items that are shorter than the longest mask."""
    masks = [tuple(i for i, bit in enumerate(m) if bit == "1") for m in MASKS]
    return masks + [tuple(range(n)) for n in sorted(lengths) if n < SPAN and tuple(range(n)) not in masks]


def window_hashes(tokens: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """One hash for each window start; the multipliers are odd constants drawn from the place in the mask."""
    count = len(tokens) - seed[-1]
    total = np.full(max(0, count), len(seed), dtype=np.uint64)
    for place in seed:
        if count > 0:
            factor = np.uint64(xxhash.xxh64_intdigest(place.to_bytes(4, "little"), 7) | 1)
            total = (total ^ (total >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + tokens[place:place + count] * factor
    return total


def before(made: np.ndarray) -> np.ndarray:
    """The hash of the window one place earlier."""
    return np.concatenate(([NO_WINDOW], made[:-1])) if len(made) else made


def longest_stretch(equal: np.ndarray, similarity: float) -> tuple[int, int]:
    """Bounds of the longest stretch in which at least this share of positions is equal."""
    limit = np.float64(similarity)
    total = np.concatenate(([0.0], np.cumsum(np.where(equal, 1 - limit, -limit))))
    lowest = np.minimum.accumulate(total)
    start = np.searchsorted(-lowest, -(total + 1e-9), side="left")
    width = np.arange(len(total)) - start
    end = int(np.argmax(width))
    return int(start[end]), end


class Block:
    """Items of one block with their window hashes."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, coverage: float):
        self.similarity, self.coverage = similarity, coverage
        hashes = TokenHashes()
        self.items = [(i, h) for i, h in ((i, hashes.of(tokens_of(t))) for i, t in items) if len(h) >= MIN_TOKENS]
        self.seeds = seeds_for({len(h) for _, h in self.items})
        rows = []
        for number, (_, tokens) in enumerate(self.items):
            for s, seed in enumerate(self.seeds):
                if s < len(MASKS) or len(seed) == len(tokens):
                    made = window_hashes(tokens, seed)
                    rows.append((made, before(made), np.full(len(made), number), np.arange(len(made))))
        none = np.zeros(0, np.uint64)
        keys, prior, owner, at = (np.concatenate(c) for c in zip(*rows)) if rows else (none, none, np.zeros(0, int), np.zeros(0, int))
        order = np.lexsort((prior, keys))
        self.keys, self.prior, self.owner, self.at = keys[order], prior[order], owner[order], at[order]
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self.keys >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, tokens: np.ndarray, starts: np.ndarray | None = None) -> set[tuple[int, int, int]]:
        """(item, text position of the item's first token, hit position) from all seeds.

        A hit whose windows follow those of another hit of the same seed says nothing new about how text and item are
        aligned, so of each such run only the first hit is made: repeated tokens give a hit for each alignment and not
        for each pair of windows.  ``starts`` are positions at which a text begins and a run can't go on.
        """
        found = set()
        for seed in self.seeds:
            made = window_hashes(tokens, seed)
            prior = before(made)
            if starts is not None:
                prior[starts[starts < len(prior)]] = NO_WINDOW
            maybe = np.flatnonzero(self.filter[made >> np.uint64(64 - FILTER_BITS)])
            low, high = np.searchsorted(self.keys, made[maybe], "left"), np.searchsorted(self.keys, made[maybe], "right")
            hit = low < high
            starting: dict[tuple[int, int], list[tuple[int, int]]] = {}  # repeated tokens ask for the same window and prior again
            for place, a, b, p in zip(maybe[hit].tolist(), low[hit].tolist(), high[hit].tolist(), prior[maybe[hit]].tolist()):
                if (a, p) not in starting:
                    own = np.uint64(p)
                    i, j = (np.searchsorted(self.prior[a:b], own, side) for side in ("left", "right")) if own != NO_WINDOW else (0, 0)
                    starting[a, p] = [pair for first, last in ((a, a + i), (a + j, b)) for pair in zip(self.owner[first:last].tolist(), self.at[first:last].tolist())]
                for o, at in starting[a, p]:
                    found.add((o, place - at, place))
        return found

    def matches(self, tokens: np.ndarray, hits: set[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """(item_id, equal tokens, item tokens, text position) of items that the text overlaps enough."""
        best: dict[int, tuple[int, int, int, int]] = {}
        for owner, offset in sorted(hits):
            item, want = self.items[owner]
            if owner in best and best[owner][1] == len(want):
                continue  # a later alignment can't have more
            a, z = max(0, -offset), min(len(want), len(tokens) - offset)
            equal = tokens[offset + a:offset + z] == want[a:z]
            i, j = longest_stretch(equal, self.similarity)
            same = int(equal[i:j].sum())
            whole = len(want) >= SPAN or same == len(want)
            if whole and j - i >= max(MIN_TOKENS, self.coverage * len(want)) and (owner not in best or same > best[owner][1]):
                best[owner] = (item, same, len(want), offset + a + i)
        return list(best.values())

    def scan(self, texts: list[str | None], hashes: TokenHashes) -> Iterator[list[tuple[int, int, int, int]]]:
        """Matches of each text, in order; texts are hashed together up to a number of tokens."""
        held: list[np.ndarray] = []
        size = 0
        for text in texts:
            held.append(hashes.of(tokens_of(text)))
            size += len(held[-1])
            if size >= TOKENS_AT_ONCE:
                yield from self.scan_tokens(held)
                held, size = [], 0
        yield from self.scan_tokens(held)

    def scan_tokens(self, held: list[np.ndarray]) -> Iterator[list[tuple[int, int, int, int]]]:
        if not held:
            return
        ends = np.cumsum([len(h) for h in held])
        found: dict[int, set[tuple[int, int]]] = {}
        starts = ends - [len(h) for h in held]
        for owner, offset, place in self.hits(np.concatenate(held), starts):
            n = int(np.searchsorted(ends, place, side="right"))
            found.setdefault(n, set()).add((owner, offset - int(ends[n] - len(held[n]))))
        for n, tokens in enumerate(held):
            inside = {(o, at) for o, at in found.get(n, ()) if -len(self.items[o][1]) < at < len(tokens)}
            yield self.matches(tokens, inside) if inside else []


def item_blocks(items: DataFrame, key: str, text: str, block_tokens: int) -> Iterator[list[tuple[int, str]]]:
    """Item classes in blocks of about ``block_tokens`` tokens; an item over that is a block of its own."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)(\w+)"), F.lit(1))
    classes = (items.where(F.col(text).isNotNull() & F.col(key).isNotNull()).groupBy(words.alias("words")).agg(F.min(F.struct(F.col(key).alias("item"), F.col(text).alias("text"))).alias("least"))
               .select("least.item", "least.text", F.size("words").alias("n")).where(F.col("n") >= MIN_TOKENS))
    classes = stage(classes, "items")
    total = classes.agg(F.sum("n"), F.max("n")).first()
    if not total[0]:
        return
    blocks = math.ceil(total[0] / block_tokens)
    placed = classes.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    for number in range(blocks):
        rows = placed.where(F.col("block") == number).select("item", "text").collect()
        if rows:
            yield [(r.item, r.text) for r in rows]


def scan_rows(docs: DataFrame, text: str, block: Block, emit, schema: str, row) -> DataFrame:
    """Applies ``emit(row column, matches of each text)`` to every batch of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for batch in batches:
            yield emit(batch.column(0), list(block.scan(batch.column(1).to_pylist(), hashes)))

    return docs.select(row.alias("row"), F.col(text).alias("text")).mapInArrow(run, schema)


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
            similarity: float = SIMILARITY, coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """key, item_id, matched_tokens, item_tokens, position: every text that overlaps an item class, with that class."""
    key_type, item_type = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"key {key_type}, item_id {item_type}, matched_tokens int, item_tokens int, position bigint"

    def emit(rows, found):
        flat = [(n, *m) for n, ms in enumerate(found) for m in ms]
        columns = list(zip(*flat)) or [()] * 5
        return pa.RecordBatch.from_arrays([rows.take(pa.array(columns[0], pa.int64())), pa.array(columns[1]) if flat else pa.array([], pa.int64()),
                                           pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int64())],
                                          names=["key", "item_id", "matched_tokens", "item_tokens", "position"])

    parts = [scan_rows(docs, text, Block(block, similarity, coverage), emit, schema, F.col(key))
             for block in item_blocks(items, item_key, item_text, block_tokens)]
    if not parts:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out.withColumnRenamed("key", key)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
          similarity: float = SIMILARITY, coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of docs that overlap no item, with all their columns."""
    whole = F.struct(*(F.col(c) for c in docs.columns))
    kind = docs.select(whole.alias("row")).schema["row"].dataType.simpleString()

    def emit(rows, found):
        kept = [n for n, ms in enumerate(found) if not ms]
        return pa.RecordBatch.from_arrays([rows.take(pa.array(kept, pa.int64()))], names=["row"])

    out = docs
    for block in item_blocks(items, item_key, item_text, block_tokens):
        out = scan_rows(out, text, Block(block, similarity, coverage), emit, f"row {kind}", whole).select("row.*")
    return out
