import random
import re
import time
import tracemalloc

import numpy as np
import pytest

from tapeframe.llm import decontamination as dc
from tests.conftest import FOLDER


def brute(docs, items, similarity=0.8, coverage=0.5):
    """Every alignment of every text and item, without seeds."""
    tokens = lambda t: re.findall(r"\w+", (t or "").lower())
    classes = {}
    for i, t in items:
        if i is not None and len(tokens(t)) >= 5:
            key = tuple(tokens(t))
            classes[key] = min(classes.get(key, i), i)
    found = set()
    for d, t in docs:
        words = tokens(t)
        for want, item in classes.items():
            best = 0
            for offset in range(-len(want) + 1, len(words)):
                a, z = max(0, -offset), min(len(want), len(words) - offset)
                equal = [words[offset + k] == want[k] for k in range(a, z)]
                if sum(equal) < 4:
                    continue
                lengths = [(j - i, sum(equal[i:j])) for i in range(len(equal)) for j in range(i + 1, len(equal) + 1)
                           if sum(equal[i:j]) >= similarity * (j - i) - 1e-9]
                if lengths:
                    length = max(lengths)[0]
                    same = max(s for n, s in lengths if n == length)
                    if length >= max(5, coverage * len(want)) and (len(want) >= dc.SPAN or same == len(want)):
                        best = max(best, same)
            if best:
                found.add((d, item))
    return found


def replaced(words, rng, share):
    return [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def fixture():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 40
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(5, 50)))) for i in range(25)]
    items += [(100, items[0][1].upper()), (101, None), (102, ""), (103, "too short"), (None, "no key at all in here")]
    docs = []
    for n in range(60):
        words = text(rng.randint(0, 80))
        if n % 2:
            item = items[rng.randrange(25)][1].split()
            kept = replaced(item, rng, rng.choice([0, 0, 0.1, 0.15]))
            words[len(words) // 2:len(words) // 2] = kept[:rng.choice([len(kept), len(kept), len(kept) // 3])]
        docs.append((n, " ".join(words)))
    return items, docs + [(60, None), (61, ""), (1, docs[1][1]), (62, "x " * 40000 + items[3][1])]


def test_against_brute_force(spark, fixture):
    items, docs = fixture
    frame = spark.createDataFrame([(d, t, "c") for d, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs[:-1], items) | {(62, 3)}
    for block_tokens in (200, 10**6):
        rows = dc.matches(frame, bench, block_tokens=block_tokens).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want
        assert len({(r.doc_id, r.item_id) for r in rows if r.doc_id != 1}) == len([r for r in rows if r.doc_id != 1])
        left = dc.clean(frame, bench, block_tokens=block_tokens)
        assert left.columns == frame.columns
        dirty = {d for d, _ in want}
        assert sorted((r.doc_id, r.text or "") for r in left.collect()) == sorted((d, t or "") for d, t in docs if d not in dirty)


def test_substitutions_are_tolerated():
    rng = random.Random(9)
    item = [f"t{i}" for i in range(30)]
    block = dc.Block([(1, " ".join(item))], dc.SIMILARITY, dc.COVERAGE)
    found = 0
    for _ in range(300):
        words = list(item)
        for at in rng.sample(range(30), 4):
            words[at] = "other"
        found += bool(list(block.scan([" ".join(["lead"] * rng.randint(0, 9) + words)], dc.TokenHashes()))[0])
    assert found == 300


def test_query_finds_all_whole_passages(spark):
    from tapeframe.llm.queries import op1_decontamination
    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet").collect()
    docs, items = [(r.doc_id, r.text) for r in read("documents")], [(r.item_id, r.text) for r in read("benchmark")]
    got = {(r.doc_id, r.item_id) for r in op1_decontamination(spark, FOLDER).collect()}
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    whole = {(d, i) for d, t in docs for i, b in items if plain(b) in plain(t)}
    assert whole and whole <= got
    short = [(d, t) for d, t in docs if len(t) < 1500]
    assert {p for p in got if p[0] in {d for d, _ in short}} == brute(short, items)


def test_empty_tables(spark, fixture):
    items, docs = fixture
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert dc.matches(frame.limit(0), bench).collect() == [] and dc.matches(frame, bench.limit(0)).collect() == []
    assert dc.clean(frame, bench.limit(0)).count() == len(docs)


def test_longest_stretch():
    rng = np.random.default_rng(1)
    for _ in range(300):
        equal = rng.random(rng.integers(1, 25)) < 0.7
        i, j = dc.longest_stretch(equal, 0.8)
        want = max([0] + [b - a for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if equal[a:b].mean() >= 0.8 - 1e-9])
        assert j - i == want and (j == i or equal[i:j].mean() >= 0.8 - 1e-9)


def all_hits(block, tokens):
    """Every pair of equal windows, as the definition has it."""
    out = set()
    for seed in block.seeds:
        for place, key in enumerate(dc.window_hashes(tokens, seed).tolist()):
            for i in np.flatnonzero(block.keys == np.uint64(key)).tolist():
                out.add((int(block.owner[i]), place - int(block.at[i])))
    return out


def test_hits_give_every_alignment_of_periodic_texts():
    rng = random.Random(8)
    hashes = dc.TokenHashes()
    for _ in range(60):
        word = lambda: rng.choice(["a", "b", "c", "d"])
        period = [word() for _ in range(rng.randint(1, 5))]
        some = lambda n: " ".join((period * n)[:n]) if rng.random() < 0.7 else " ".join(word() for _ in range(n))
        block = dc.Block([(i, some(rng.randint(5, 40))) for i in range(3)], 0.8, 0.5)
        tokens = hashes.of(dc.tokens_of(some(rng.randint(0, 60))))
        assert {(o, at) for o, at, _ in block.hits(tokens)} == all_hits(block, tokens)
        texts = [some(rng.randint(0, 40)) for _ in range(4)]
        together = list(block.scan(texts, hashes))
        assert together == [next(block.scan([t], hashes)) for t in texts]


def test_repeated_tokens_stay_linear():
    block = dc.Block([(1, "x " * 1000), (2, "x y z " * 300)], 0.8, 0.5)
    tracemalloc.start()
    began = time.perf_counter()
    found = list(block.scan(["x " * 20_000, "x y z " * 7_000, "q " * 20_000], dc.TokenHashes()))
    took, peak = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [{m[0]: m[1] for m in ms} for ms in found] == [{1: 1000}, {2: 900}, {}]
    assert took < 20 and peak < 200_000_000
