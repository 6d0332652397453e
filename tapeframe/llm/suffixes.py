"""Removal of repeated substrings by suffix sorting of content-addressed shards.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier in the corpus.

* Cutting: every window of ``length`` bytes is named by the least hash of its ``KMER``-byte strings.  Equal windows
  have equal names, so all of them meet in the shard of their name; neighbouring windows of one name form a context.
  Names that occur once in the corpus are dropped, and of equal contexts only the first goes on: the later ones are repeats as
  a whole.
* Sorting: the contexts of a shard are suffix-sorted by induction (``InducedSorter``).  The order of the leftmost-S
  suffixes comes from the string of their names, one level down; L-type and then S-type suffixes are induced from
  them through one queue per symbol.  Queues hold suffix positions with the common prefix shared with the entry
  before, the prefix values are carried along (one more than the least value passed since the queue's last entry),
  and queues beyond a memory limit go to a scratch file of the task, so a shard may be larger than memory.
* Marking: suffixes in a row that share ``length`` bytes are equal windows; all but the first in the corpus are marked.

The level below works on pairs of ranks (doubling) instead of another induction: its alphabet has as many symbols as
there are names, and one queue per name would be mostly overhead.  Orders and prefixes are exact up to ``length``.

Defined results: null texts are empty; rows are ordered by key (null first), then by a hash of the text; of exactly
repeated rows the later copies are repeats as a whole; texts under ``length`` bytes lose nothing; other columns are
not read; an empty table gives an empty one.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.runtime import stage

LENGTH, KMER = 100, 20
MOST_WINDOWS = 256
BUFFER_BYTES = 1 << 19
SHARD_BYTES = 1 << 21
QUEUE_BYTES = 64 << 20
PACKED = 7  # symbols in one 63-bit word
SYMBOL_BITS = 9
NO_VALUE = 255
BATCH_ENTRIES = 1 << 20
MIX = np.uint64(0xBF58476D1CE4E5B9)
BASE = np.uint64(0x9E3779B97F4A7C15)


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed polynomial hashes of all KMER-byte strings, by doubling their width."""
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    by_width = {1: (h, BASE)}
    while width * 2 <= KMER:
        h = h[:-width] * by_width[width][1] + h[width:]
        width *= 2
        by_width[width] = h, np.uint64(pow(int(BASE), width, 1 << 64))
    total, done = None, 0
    for part in sorted(by_width, reverse=True):
        if done + part <= KMER:
            piece, power = by_width[part]
            shifted = piece[done:]
            total = shifted if total is None else total[:len(shifted)] * power + shifted
            done += part
    total = total[:len(data) - KMER + 1]
    total = (total ^ (total >> np.uint64(31))) * MIX
    return total ^ (total >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    least, done = values, 1
    while done * 2 <= width:
        least, done = np.minimum(least[:-done], least[done:]), done * 2
    rest = width - done
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


def contexts_of(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, name, content hash, whether the naming string occurs again) of all contexts."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    ends = np.cumsum(sizes)
    hashes = kmer_hashes(data)
    name = sliding_least(hashes, length - KMER + 1)
    at = np.arange(len(name))
    owner = np.repeat(np.arange(len(texts)), sizes)[:len(name)]
    valid = at + length <= ends[owner]
    change = np.concatenate(([True], (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])))
    start = np.flatnonzero(change)
    run = np.repeat(start, np.diff(np.append(start, len(name))))
    start = np.flatnonzero(change | ((at - run) % MOST_WINDOWS == 0))
    stop = np.append(start[1:], len(name))
    count = np.add.reduceat(valid.astype(np.int64), start)  # valid windows come first in a run
    start, count = start[count > 0], count[count > 0]
    powers = np.multiply.accumulate(np.full(len(hashes) + 1, BASE, dtype=np.uint64))
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    down = np.multiply.accumulate(np.full(len(hashes) + 1, inverse, dtype=np.uint64))
    total = np.concatenate(([np.uint64(0)], np.cumsum(hashes * powers[:-1], dtype=np.uint64)))
    content = (total[start + count + length - KMER] - total[start]) * down[start]
    content ^= content >> np.uint64(32)
    # Strings that name a window; a context that holds its own twice may repeat a window within itself.
    wide = length - KMER
    around = np.concatenate([np.zeros(wide, np.uint64), name, np.zeros(wide, np.uint64)])
    naming = np.flatnonzero(hashes == ~sliding_least(~around, wide + 1))
    low, high = np.searchsorted(naming, start), np.searchsorted(naming, start + count + wide)
    context = np.repeat(np.arange(len(start)), high - low)
    place = np.arange(len(context)) + np.repeat(low - np.cumsum(high - low) + (high - low), high - low)
    again = np.bincount(context[hashes[naming[place]] == name[start][context]], minlength=len(start)) > 1
    owners = owner[start]
    return owners, start - (ends - sizes)[owners], count, name[start], content, again


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def contexts(docs: DataFrame, length: int) -> DataFrame:
    """docs (doc, h, body) -> name, content, doc, h, start, windows."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(doc, h, texts, rows):
            owner, start, count, name, content, again = contexts_of(texts, length)
            taken = pa.array(np.array(rows, dtype=np.int64)[owner])
            return pa.RecordBatch.from_arrays([signed(name), signed(content), doc.take(taken), h.take(taken), pa.array(start), pa.array(count),
                                               pa.array(again)], names=["name", "content", "doc", "h", "start", "windows", "again"])

        for batch in batches:
            texts, rows, size = [], [], 0
            for n, value in enumerate(batch.column(2)):
                text = value.as_py()
                if text is not None and len(text) >= length:
                    texts.append(text)
                    rows.append(n)
                    size += len(text)
                if size >= BUFFER_BYTES:
                    yield made(batch.column(0), batch.column(1), texts, rows)
                    texts, rows, size = [], [], 0
            if texts:
                yield made(batch.column(0), batch.column(1), texts, rows)

    return docs.select("doc", "h", "body").mapInArrow(run, f"name bigint, content bigint, doc {kind}, h bigint, start bigint, windows bigint, again boolean")


class DiskQueues:
    """First-in-first-out queues of (positions, prefix values), one per symbol; beyond a limit they go to a scratch file."""

    def __init__(self, symbols: int, limit: int):
        self.queues: list[list] = [[] for _ in range(symbols)]
        self.limit, self.held, self.file = limit, 0, None

    def put(self, symbol: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        if not len(positions):
            return
        size = positions.nbytes + prefixes.nbytes
        if self.held + size <= self.limit:
            self.held += size
            self.queues[symbol].append((positions.copy(), prefixes.copy()))
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # private to the task, gone when it is closed
        at = self.file.seek(0, 2)
        self.file.write(positions.tobytes())
        self.file.write(prefixes.tobytes())
        self.queues[symbol].append((at, len(positions)))

    def get(self, symbol: int, i: int) -> tuple[np.ndarray, np.ndarray]:
        first, second = self.queues[symbol][i]
        if isinstance(first, np.ndarray):
            return first, second
        self.file.seek(first)
        return np.frombuffer(self.file.read(4 * second), np.int32), np.frombuffer(self.file.read(second), np.uint8)

    def joined(self, symbol: int, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.get(symbol, i) for i in range(start, stop)]
        return (np.concatenate([p for p, _ in parts]), np.concatenate([v for _, v in parts])) if len(parts) > 1 else parts[0]

    def size(self, symbol: int, i: int) -> int:
        first, second = self.queues[symbol][i]
        return len(first) if isinstance(first, np.ndarray) else second

    def batches(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Entries in order, in batches of bounded size; also what is put into the queue while it is read."""
        start = 0
        while start < len(self.queues[symbol]):
            stop, count = start, 0
            while stop < len(self.queues[symbol]) and (stop == start or count + self.size(symbol, stop) <= BATCH_ENTRIES):
                count += self.size(symbol, stop)
                stop += 1
            yield self.joined(symbol, start, stop)
            start = stop

    def backwards(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches from the last to the first, each in order."""
        stop = len(self.queues[symbol])
        while stop:
            start, count = stop, 0
            while start and (start == stop or count + self.size(symbol, start - 1) <= BATCH_ENTRIES):
                count += self.size(symbol, start - 1)
                start -= 1
            yield self.joined(symbol, start, stop)
            stop = start

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Passed:
    """Per symbol the least prefix value passed since the queue's last entry."""

    def __init__(self, symbols: int):
        self.least = np.full(symbols, NO_VALUE, dtype=np.uint8)
        self.fresh = np.ones(symbols, dtype=bool)

    def deal(self, prefixes: np.ndarray, index: np.ndarray, symbol: np.ndarray, cap: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(symbol, places in the batch, carried prefixes) for entries at ``index`` that go to ``symbol``."""
        smallest = prefixes.min(initial=NO_VALUE)
        if not len(index):
            self.least = np.minimum(self.least, smallest)
            return
        order = np.argsort(symbol, kind="stable")
        index, symbol = index[order], symbol[order]
        first = np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1])))
        stop = np.append(first[1:], len(symbol))
        before = np.concatenate(([-1], index[:-1]))
        before[first] = index[first] - 1
        levels = [prefixes]
        widest = int((index - before).max()).bit_length() - 1
        for k in range(widest):
            levels.append(np.minimum(levels[-1][:-(1 << k)], levels[-1][1 << k:]))
        width = index - before
        k = np.frexp(width.astype(np.float64))[1] - 1
        carried = np.empty(len(index), dtype=np.uint8)
        for level in range(widest + 1):
            some = np.flatnonzero(k == level)
            if len(some):
                carried[some] = np.minimum(levels[level][before[some] + 1], levels[level][index[some] - (1 << level) + 1])
        from_start, to_end = np.minimum.accumulate(prefixes), np.append(np.minimum.accumulate(prefixes[::-1])[::-1], NO_VALUE)
        symbols = symbol[first]
        carried[first] = np.minimum(self.least[symbols], from_start[index[first]])
        carried = np.minimum(carried, cap - 1) + 1
        carried[first[self.fresh[symbols]]] = 0
        self.fresh[symbols] = False
        self.least = np.minimum(self.least, smallest)
        self.least[symbols] = to_end[index[stop - 1] + 1]
        for s, a, z in zip(symbols.tolist(), first.tolist(), stop.tolist()):
            yield s, index[a:z], carried[a:z]


class InducedSorter:
    """Suffix order of a text of small symbols, with common prefixes, both exact up to ``depth``.

    The text ends with symbol 0, which occurs nowhere else.
    """

    def __init__(self, text: np.ndarray, depth: int, queue_bytes: int = QUEUE_BYTES):
        self.text, self.depth, self.symbols = text, depth, int(text.max()) + 1
        if depth > NO_VALUE - 10 or self.symbols > 1 << SYMBOL_BITS:
            raise ValueError("depth or alphabet too large")
        self.cap = depth + 8
        n = len(text)
        ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
        rises = np.append(text[ends[:-1]] < text[ends[:-1] + 1], True)
        self.is_s = np.repeat(rises, np.diff(np.concatenate(([-1], ends))))
        padded = np.concatenate([text.astype(np.uint64), np.zeros(PACKED, dtype=np.uint64)])
        self.words = np.zeros(n, dtype=np.uint64)
        for i in range(PACKED):
            self.words = (self.words << np.uint64(SYMBOL_BITS)) | padded[i:i + n]
        self.lower, self.upper = DiskQueues(self.symbols, queue_bytes // 2), DiskQueues(self.symbols, queue_bytes // 2)

    def prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of suffix pairs, up to the cap."""
        n, out = len(self.text), np.zeros(len(a), dtype=np.int64)
        open_ = np.arange(len(a))
        for step in range(0, self.cap, PACKED):
            pa_, pb = np.minimum(a[open_] + step, n - 1), np.minimum(b[open_] + step, n - 1)
            differ = self.words[pa_] ^ self.words[pb]
            stop = (differ != 0) | (a[open_] + step >= n) | (b[open_] + step >= n)
            bits = np.frexp(differ[stop].astype(np.float64))[1]
            out[open_[stop]] = step + np.where(bits > 0, PACKED - 1 - (bits - 1) // SYMBOL_BITS, 0)
            open_ = open_[~stop]
            if not len(open_):
                break
        out[open_] = self.cap
        return np.minimum(out, self.cap).astype(np.uint8)

    def sorted_seeds(self) -> np.ndarray:
        """Leftmost-S positions in suffix order: names of the pieces between them, then ranks of ever longer pieces."""
        seeds = np.flatnonzero(self.is_s[1:] & ~self.is_s[:-1]) + 1
        after = np.append(seeds[1:], len(self.text) - 1)
        width = after - seeds + 1  # a piece includes the next seed's first symbol
        rank, step, longest = np.zeros(len(seeds), dtype=np.int64), 0, min(int(width.max()), self.depth)
        while step < longest:
            part = self.words[np.minimum(seeds + step, len(self.text) - 1)]
            # Where one piece ends and another goes on with the same symbols, the shorter is followed by the larger suffix.
            free = ((PACKED - np.clip(width - step, 0, PACKED)) * SYMBOL_BITS).astype(np.uint64)
            part = part | ((np.uint64(1) << free) - np.uint64(1))
            going = np.flatnonzero(width > step)
            values, number = np.unique(part[going], return_inverse=True)
            second = np.full(len(seeds), len(values), dtype=np.int64)  # pieces that have ended come last
            second[going] = number
            rank = self.ranked(rank, second)
            step += PACKED
        hop = 1
        while hop * 2 <= 2 * self.depth:
            next_ = np.concatenate([rank[hop:] + 1, np.zeros(min(hop, len(rank)), dtype=np.int64)])[:len(rank)]
            new = self.ranked(rank, next_)
            if new.max() == rank.max():
                break
            rank, hop = new, hop * 2
        return seeds[np.argsort(rank, kind="stable")]

    @staticmethod
    def ranked(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Dense ranks of pairs of numbers below 2 ** 32."""
        pairs = (first << 32) | second
        order = np.argsort(pairs)
        pairs = pairs[order]
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate(([False], pairs[1:] != pairs[:-1])))
        return rank

    def induce(self, queues: DiskQueues, passed: Passed, positions: np.ndarray, prefixes: np.ndarray, s_type: bool) -> None:
        """Puts the suffixes one symbol longer into the queues of their symbols."""
        longer = positions - 1
        good = np.flatnonzero((positions > 0) & (self.is_s[longer] == s_type))
        longer = longer[good]
        for symbol, places, carried in passed.deal(prefixes, good, self.text[longer], self.cap):
            queues.put(symbol, positions[places] - 1, carried)

    def run(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, common prefix with the suffix before) in suffix order, in batches."""
        seeds = self.sorted_seeds().astype(np.int32)
        shared = np.zeros(len(seeds), dtype=np.uint8)
        shared[1:] = self.prefix(seeds[:-1].astype(np.int64), seeds[1:].astype(np.int64))
        first = np.searchsorted(self.text[seeds], np.arange(self.symbols + 1))
        passed, last = Passed(self.symbols), np.full(self.symbols, -1, dtype=np.int64)
        for c in range(self.symbols):
            for positions, prefixes in self.lower.batches(c):
                self.induce(self.lower, passed, positions, prefixes, False)
                last[c] = positions[-1]
            own, own_shared = seeds[first[c]:first[c + 1]], shared[first[c]:first[c + 1]].copy()
            if len(own):
                own_shared[0] = self.prefix(last[c:c + 1], own[:1].astype(np.int64))[0] if last[c] >= 0 else 0
                self.induce(self.lower, passed, own, own_shared, False)
        passed, joint = Passed(self.symbols), np.zeros(self.symbols, dtype=np.uint8)
        self.upper.put(0, np.array([len(self.text) - 1], dtype=np.int32), np.zeros(1, dtype=np.uint8))
        for c in range(self.symbols - 1, -1, -1):
            end = -1
            for positions, prefixes in self.upper.batches(c):  # from the largest down; a prefix is shared with the larger neighbour
                self.induce(self.upper, passed, positions, prefixes, True)
                end = int(positions[-1])
            above = 0
            if end >= 0 and last[c] >= 0:
                above = joint[c] = self.prefix(last[c:c + 1], np.array([end]))[0]
            for positions, prefixes in self.lower.backwards(c):
                down = np.concatenate(([above], prefixes[:0:-1])).astype(np.uint8)
                self.induce(self.upper, passed, positions[::-1], down, True)
                above = prefixes[0]
        for c in range(self.symbols):
            yield from self.lower.batches(c)
            below = int(joint[c])
            for positions, prefixes in self.upper.backwards(c):
                yield positions[::-1], np.concatenate(([below], prefixes[:0:-1])).astype(np.uint8)
                below = int(prefixes[0])
        self.lower.close()
        self.upper.close()


def repeated_windows(bodies: list[bytes], order: np.ndarray, length: int, queue_bytes: int = QUEUE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) of all windows that an earlier one equals; ``order`` (context, 2): text rank and first window."""
    sizes = np.array([len(b) + 1 for b in bodies], dtype=np.int64)
    text = np.empty(int(sizes.sum()) + 1, dtype=np.int16)
    data = np.frombuffer(b"\0".join([*bodies, b""]), dtype=np.uint8)
    text[:-1], text[-1] = data.astype(np.int16) + 2, 0
    stops = np.cumsum(sizes) - 1
    text[stops] = 1
    group, number, places = 0, [], []
    for positions, prefixes in InducedSorter(text, length, queue_bytes).run():
        ids = group + np.cumsum(prefixes < length)
        group = int(ids[-1])
        number.append(ids)
        places.append(positions)
    number, places = np.concatenate(number), np.concatenate(places).astype(np.int64)
    sizes_of = np.bincount(number)
    some = sizes_of[number] > 1
    number, places = number[some], places[some]
    owner = np.searchsorted(stops, places, side="left")
    inside = (owner < len(bodies)) & (stops[np.minimum(owner, len(bodies) - 1)] - places >= length)
    number, places, owner = number[inside], places[inside], owner[inside]
    window = places - (stops - sizes + 1)[owner]
    by = np.lexsort((order[owner, 1] + window, order[owner, 0], number))
    number, owner, window = number[by], owner[by], window[by]
    later = np.concatenate(([False], number[1:] == number[:-1]))[:len(number)]
    return owner[later], window[later]


def intervals(owner: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first window, windows) of runs of consecutive windows."""
    by = np.lexsort((window, owner))
    owner, window = owner[by], window[by]
    start = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (window[1:] != window[:-1] + 1)))[:len(owner)])
    return owner[start], window[start], np.diff(np.append(start, len(owner)))


def sort_shards(length: int, shard_bytes: int, queue_bytes: int):
    """Streams contexts sorted by name and text; names are gathered into shards of about ``shard_bytes``, never cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def marked(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            doc = table["doc"].combine_chunks() if table.num_rows else table["doc"]
            h, start = table["h"].to_numpy(), table["start"].to_numpy()
            codes = doc.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            rank = np.cumsum(np.concatenate(([0], (h[1:] != h[:-1]) | (codes[1:] != codes[:-1]))))
            owner, window = repeated_windows(table["body"].to_pylist(), np.column_stack([rank, start]), length, queue_bytes)
            owner, window, count = intervals(owner, window)
            return pa.RecordBatch.from_arrays([doc.take(pa.array(owner)), pa.array(h[owner]), pa.array(start[owner] + window), pa.array(count)],
                                              names=["doc", "h", "start", "windows"])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= shard_bytes:
                table = pa.Table.from_batches(held)
                name = table["name"].to_numpy()
                other = np.flatnonzero(name != name[-1])
                cut = int(other[-1]) + 1 if len(other) else 0
                if cut:
                    yield marked(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = sum(b.nbytes for b in held)
        if held and (table := pa.Table.from_batches(held)).num_rows:
            yield marked(table)

    return run


def cut_contexts(length: int):
    """(doc, h, body, parts) -> one row per context with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lists = part.column(3)
                flat = lists.flatten()
                owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy() - lists.offsets[0].as_py()))
                name, start, count = (flat.field(i) for i in range(3))
                texts = part.column(2).to_pylist()
                bodies = [texts[o][s:s + c + length - 1] for o, s, c in zip(owner.tolist(), start.to_pylist(), count.to_pylist())]
                taken = pa.array(owner)
                yield pa.RecordBatch.from_arrays([name, part.column(0).take(taken), part.column(1).take(taken), start, pa.array(bodies, pa.binary())],
                                                 names=["name", "doc", "h", "start", "body"])

    return run


def removed_spans(parts: list[tuple[int, int]], length: int, size: int, copy: int) -> list[tuple[int, int]]:
    """Merged byte spans of the marked windows."""
    if copy > 1 and size >= length:
        return [(0, size)]
    out: list[list[int]] = []
    for start, count in sorted(parts):
        end = start + count + length - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, z) for a, z in out]


def strip(length: int):
    """(doc, body, parts, copy) -> doc, n_bytes, spans, kept."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, spans, kept = [], [], []
                for body, parts, copy in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                    cut = removed_spans([(p["start"], p["windows"]) for p in parts or ()], length, len(body), copy)
                    edges = [0, *(e for s in cut for e in s), len(body)]
                    sizes.append(len(body))
                    spans.append([{"start": a, "end": z} for a, z in cut])
                    kept.append(b"".join(body[a:z] for a, z in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                                                 names=["doc", "n_bytes", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES,
                   queue_bytes: int = QUEUE_BYTES) -> DataFrame:
    """key, n_bytes, spans (removed, as byte offsets), kept (remaining bytes); one row for each row of docs."""
    if length < 2 * KMER:
        raise ValueError(f"length must be at least {2 * KMER}")
    body = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(body).alias("h"), body.alias("body"))
    kind = rows.schema["doc"].dataType.simpleString()
    found = contexts(rows, length)
    order = [F.col(c) for c in ("doc", "h", "start")]
    same, named = Window.partitionBy("name", "content").orderBy(*order), Window.partitionBy("name")
    where = F.struct("doc", "h", "start")
    classed = found.withColumn("first", F.first(where).over(same)).withColumn("n", F.row_number().over(same)).withColumn("total", F.count("*").over(named))
    classed = classed.where("total > 1 or again").withColumn("is_first", F.col("n") == 1).where(F.col("is_first") | ~where.eqNullSafe(F.col("first")))
    classed = stage(classed.select("is_first", "name", "doc", "h", "start", "windows"), "contexts")
    lists = classed.where("is_first").groupBy("doc", "h").agg(F.collect_list(F.struct("name", "start", "windows")).alias("parts"))
    here = lists.select(F.col("doc").alias("d"), F.col("h").alias("g"), "parts")
    match = F.col("doc").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))
    cut = rows.where(F.octet_length("body") >= length).join(here, match).select("doc", "h", "body", "parts").mapInArrow(
        cut_contexts(length), f"name bigint, doc {kind}, h bigint, start bigint, body binary")
    ordered = cut.repartition("name").sortWithinPartitions("name", "doc", "h", "start")
    marked = stage(ordered.mapInArrow(sort_shards(length, shard_bytes, queue_bytes), f"doc {kind}, h bigint, start bigint, windows bigint"), "repeats")
    every = classed.where("not is_first").select("doc", "h", "start", "windows").union(marked)
    spans = every.groupBy(F.col("doc").alias("d"), F.col("h").alias("g")).agg(F.collect_list(F.struct("start", "windows")).alias("parts"))
    copies = F.row_number().over(Window.partitionBy("doc", "h").orderBy("h"))
    joined = rows.withColumn("copy", copies).join(spans, match, "left").select("doc", "body", "parts", "copy")
    out = joined.mapInArrow(strip(length), f"doc {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.withColumnRenamed("doc", key)
