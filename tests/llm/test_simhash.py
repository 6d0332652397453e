import random
import re

import numpy as np
import xxhash

from tapeframe.llm import simhash
from tapeframe.llm.components import connected
from tests.conftest import FOLDER


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_components(prints):
    parent = {k: k for k in prints}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(prints)
    codes = np.array([prints[k] for k in keys], dtype=np.uint64)
    for i, k in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1:] ^ codes[i]) <= 4):
            a, b = find(k), find(keys[i + 1 + j])
            parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_query_against_brute_force(spark):
    from tapeframe.llm.queries import op2_simhash
    prints = {r.doc_id: brute_fingerprint(r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    want = brute_components(prints)
    rows = op2_simhash(spark, FOLDER).collect()
    assert len(rows) == len(prints) and len(set(want.values())) < len(want)
    for r in rows:
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])


def test_edges(spark):
    rows = [(5, None, "x"), (3, " \t\n", "y"), (9, "One two", "z"), (8, "one  TWO", "z"), (8, "one  TWO", "z"), (7, "word " * 30000, "w"),
            (None, "one two", "q"), (6, " é É", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.component_id) for r in got}
    assert {(5, 3), (3, 3), (9, 8), (8, 8), (None, 8)} <= by
    texts = {r[0]: r[1] for r in rows}
    assert all(r.fingerprint % (1 << 64) == brute_fingerprint(texts[r.doc_id]) for r in got)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def clustered(count, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(12)]
    codes = {rng.getrandbits(64) for _ in range(count)}
    while len(codes) < 3 * count:
        code = rng.choice(centres)
        for _ in range(rng.randint(0, 9)):
            code ^= 1 << rng.randrange(64)
        codes.add(code)
    return sorted(codes)


def test_splitting_large_groups_keeps_components(spark):
    codes = clustered(300, 1)
    want = brute_components(dict(enumerate(codes)))
    frame = spark.createDataFrame([(simhash.signed(c),) for c in codes], "fingerprint long")
    number = {simhash.signed(c): i for i, c in enumerate(codes)}
    for limit in (5, 4096):
        roots = {number[r.node]: number[r.root] for r in connected(simhash.hamming_links(frame, limit=limit)).collect()}
        groups = {}
        for i in range(len(codes)):
            groups.setdefault(roots.get(i, i), set()).add(i)
        wanted = {}
        for i, root in want.items():
            wanted.setdefault(root, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_index_finds_every_pair_of_a_group():
    codes = np.array(clustered(400, 2), dtype=np.uint64)
    order = np.lexsort((simhash.gray_rank(codes),))
    codes = codes[order]
    index = simhash.GrayIndex(codes, np.zeros(len(codes), dtype=np.int64))
    a, b = index.search(np.arange(len(codes)), 4, np.arange(len(codes)))
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near))) if i < j}


def test_components_of_chain_star_and_ring(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, i) for i in range(1001, 1050)]
    ring = [(2000 + i, 2000 + (i + 1) % 30) for i in range(30)]
    edges = spark.createDataFrame(chain + star + ring + [(7, 7)], "a long, b long")
    groups = {}
    for r in connected(edges).collect():
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(len(g) for g in groups.values()) == [30, 50, 61]
