"""BPE encoding and decoding of whole texts with a public word-level vocabulary.

A word is merged on a contiguous rank array: one list holds the parts between the remaining boundaries, one the
merge rank of each adjacent pair.  The minimum is found by a scan, its boundary deleted and the two neighbouring
ranks refreshed.  Words are short, so the scan beats a heap; words over ``SCAN_LIMIT`` symbols use a heap with the
same order (lowest rank, then leftmost), which keeps very long words from becoming quadratic.

Defined results: null and empty texts have no tokens and decode to the empty string; repeated rows are encoded one
by one; other columns of the input are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Code points that the installed pattern engine takes for letters or numbers and the tokenizers library,
# whose patterns follow an earlier Unicode, does not; a test compares all code points.
NOT_YET_WORDS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE),
    (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81),
    (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F))
# Lower-case letters of capitals that are younger than Python's tables; the last two are (first, last, distance).
YOUNG_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
YOUNG_CAPITAL_ROWS = ((0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B))
LOWER = YOUNG_CAPITALS | {c: c + d for a, z, d in YOUNG_CAPITAL_ROWS for c in range(a, z + 1)}
SCAN_LIMIT = 200
CACHED_WORDS = 200_000
CACHED_LENGTH = 40
ROWS_OUT = 500
NO_RANK = 1 << 60


def byte_alphabet() -> list[str]:
    """Printable stand-ins for the 256 bytes: printable Latin-1 stays, the rest is moved above 255 in order."""
    kept = {b for a, z in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(a), ord(z) + 1)}
    moved = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(moved)) for b in range(256)]


def char_class(ranges: tuple[tuple[int, int], ...]) -> str:
    return "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in ranges)


YOUNG = re.compile(f"[{char_class(NOT_YET_WORDS + tuple((c, c) for c in sorted(LOWER)))}]")


class Vocabulary:
    """What the public vocabulary file says: symbols, merges, special strings, and the pattern of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.id_of: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of = {i: t for t, i in (*self.id_of.items(), *self.specials.items())}
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            self.merges[self.id_of[left] << 32 | self.id_of[right]] = rank, self.id_of[left + right]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(pattern)
        for kind in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(kind, f"[{kind}--[{char_class(NOT_YET_WORDS)}]]")
        self.word_of_all = regex.compile(pattern, regex.V1)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        letters = byte_alphabet()
        self.inner = [self.id_of.get(c, -1) for c in letters]
        self.last = [self.id_of.get(c + self.suffix, -1) for c in letters]

    def words(self, text: str) -> list[str]:
        return (self.word if plain(text) else self.word_of_all).findall(text)

    def symbols(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "replace")
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return [i for i in ids if i >= 0]

    def merge_scan(self, parts: list[int]) -> list[int]:
        merges = self.merges
        ranks = [merges.get(a << 32 | b, (NO_RANK,))[0] for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            parts[i] = merges[parts[i] << 32 | parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = merges.get(parts[i - 1] << 32 | parts[i], (NO_RANK,))[0]
            if i < len(ranks):
                ranks[i] = merges.get(parts[i] << 32 | parts[i + 1], (NO_RANK,))[0]
        return parts

    def merge_heap(self, parts: list[int]) -> list[int]:
        """Same merges for a very long word, in n log n steps."""
        merges, n = self.merges, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := merges.get(parts[i] << 32 | parts[j])):
                heapq.heappush(heap, (found[0], i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            if parts[i] != left or after[i] >= n or parts[after[i]] != right:
                continue
            j = after[i]
            parts[i], parts[j] = merges[left << 32 | right][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p >= 0]

    def word_ids(self, word: str) -> bytes:
        parts = self.symbols(word)
        merged = self.merge_scan(parts) if len(parts) <= SCAN_LIMIT else self.merge_heap(parts)
        return np.array(merged, dtype="<u4").tobytes()


class WordCache(dict):
    """Bounded memo of the ids of short words."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        ids = self.vocabulary.word_ids(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids


def plain(text: str) -> bool:
    """Whether no code point needs the tables above; Latin-1 texts are told apart without a search."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return YOUNG.search(text) is None


def normalise(text: str) -> str:
    """Composed and lower-cased letter by letter, so that a final sigma is not treated apart."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    if not plain(text):
        text = text.translate(LOWER)
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def encode_text(text: str, vocabulary: Vocabulary, cache: WordCache) -> bytes:
    out = []
    for piece in vocabulary.special.split(text) if "<|" in text else (text,):
        special = vocabulary.specials.get(piece)
        if special is not None:
            out.append(np.array([special], dtype="<u4").tobytes())
        else:
            out.extend(map(cache.__getitem__, vocabulary.words(normalise(piece))))
    return b"".join(out)


def encode(docs: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (binary: unsigned 32-bit little-endian, one per token), n_tokens; one row for each row of docs."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(vocabulary_path)
        cache = WordCache(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                ids = [encode_text(t.as_py() or "", vocabulary, cache) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())],
                                                 names=["key", "ids", "n_tokens"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return out.mapInArrow(run, f"key {key_type}, ids binary, n_tokens bigint").withColumnRenamed("key", key)


def decode(encoded: DataFrame, vocabulary_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, ids, text: the tokens joined by a space, as the vocabulary (which names no decoder) has it; unknown ids are left out."""
    key_type = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_of = Vocabulary(vocabulary_path).token_of
        known = np.zeros(max(token_of) + 1, dtype=bool)
        known[list(token_of)] = True
        names = [token_of.get(i, "") for i in range(len(known))]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                texts = []
                for raw in part.column(1):
                    found = np.frombuffer(raw.as_py() or b"", dtype="<u4")
                    found = found[found < len(known)]
                    texts.append(" ".join(map(names.__getitem__, found[known[found]].tolist())))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["key", "ids", "text"])

    out = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return out.mapInArrow(run, f"key {key_type}, ids binary, text string").withColumnRenamed("key", key)
