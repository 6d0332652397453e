import hashlib
import random

import numpy as np
import pytest

from tapeframe.llm import suffixes
from tests.conftest import FOLDER


def brute(texts, length=100):
    """Removed spans of (key, text) rows in corpus order, and what is left."""
    seen, out = set(), []
    for raw in texts:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            piece = raw[i:i + length]
            if piece in seen:
                gone[i:i + length] = b"\1" * length
            else:
                seen.add(piece)
        edges = [i for i in range(len(raw)) if gone[i] != (gone[i - 1] if i else 0)] + ([len(raw)] if raw and gone[-1] else [])
        out.append((list(zip(edges[::2], edges[1::2])), bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def sorter_cases():
    rng = random.Random(11)
    yield b"mississippi" * 30
    yield b"a" * 700
    yield bytes(rng.choice(b"ab") for _ in range(2000))
    piece = bytes(rng.choice(b"abcdefg ") for _ in range(150))
    yield piece + b"xyz" + piece[:120] + bytes(rng.choice(b"abcdefgh") for _ in range(800)) + piece
    yield bytes(range(256)) * 4
    yield b"q"


@pytest.mark.parametrize("raw", list(sorter_cases()))
@pytest.mark.parametrize("queue_bytes", [0, 1 << 20])
def test_induced_order_and_prefixes(raw, queue_bytes):
    text = np.append(np.frombuffer(raw, np.uint8).astype(np.int16) + 2, 0).astype(np.int16)
    runs = list(suffixes.InducedSorter(text, 100, queue_bytes).run())
    positions, prefixes = np.concatenate([p for p, _ in runs]), np.concatenate([v for _, v in runs])
    assert sorted(positions.tolist()) == list(range(len(text)))
    words = text.tolist()
    for a, b, shared in zip(positions.tolist(), positions[1:].tolist(), prefixes[1:].tolist()):
        assert words[a:a + 100] <= words[b:b + 100]
        true = next((i for i in range(100) if a + i >= len(words) or b + i >= len(words) or words[a + i] != words[b + i]), 100)
        assert min(shared, 100) == true, (a, b)


def test_query_against_brute_force(spark):
    from tapeframe.llm.queries import op6_suffixes
    docs = sorted((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    want = {d: (len(t), spans, kept) for (d, t), (spans, kept) in zip(docs, brute([t for _, t in docs]))}
    rows = op6_suffixes(spark, FOLDER).collect()
    assert len(rows) == len(docs) and any(spans for _, spans, _ in want.values())
    for r in rows:
        size, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (size, size - len(kept), len(spans)), r.doc_id
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def fixture_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(40) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [prose(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            piece = rng.choice(shared)
            a = rng.randint(0, 60)
            parts += [piece[a:a + rng.randint(60, 200)], prose(rng.randint(0, 20))]
        rows.append((i, " ".join(parts)))
    rows += [(100, "na " * 900), (101, "x" + "na " * 300), (102, "z" * 3000), (103, shared[0] * 9), (104, None), (105, ""), (106, "short"), (107, "é" * 49), (108, "é" * 51)]
    return rows + [(109 + i, rows[5][1] + shared[1]) for i in range(30)]


@pytest.mark.parametrize("shard_bytes, queue_bytes", [(1 << 21, 1 << 26), (3000, 100)])
def test_fixture_against_brute_force(spark, shard_bytes, queue_bytes):
    rows = fixture_rows(shard_bytes)
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, n_bytes int, spans string").repartition(7)
    got = {r.doc_id: ([(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in
           suffixes.remove_repeats(docs, shard_bytes=shard_bytes, queue_bytes=queue_bytes).collect()}
    want = brute([(t or "").encode() for _, t in sorted(rows)])
    assert got == {i: w for (i, _), w in zip(sorted(rows), want)}


def test_edges(spark):
    long = "".join(chr(97 + (i * i) % 23) for i in range(400))
    docs = spark.createDataFrame([(1, long), (1, long), (None, long), (2, "few"), (2, "few"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), len(r.kept), r.n_bytes) for r in suffixes.remove_repeats(docs).collect())
    whole = len(brute([long.encode()])[0][1])
    assert got == sorted([(0, whole, 400), (0, 0, 0), (1, 0, 400), (1, 0, 400), (2, 3, 3), (2, 3, 3)])
    assert suffixes.remove_repeats(docs.limit(0)).collect() == []
