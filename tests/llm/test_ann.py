import math

import numpy as np
import pytest

from tapeframe.llm import ann


def brute(rows, asked, k=10):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in asked:
        own = [v for i, v in good if i == q]
        if own:
            ranked = sorted((float(np.sqrt(((v - own[0]) ** 2).sum())), i) for i, v in good if i != q and len(v) == len(own[0]))
            out[q] = ranked[:k]
    return out


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_query_recall(spark, folder):
    from tapeframe.llm.queries import op4_ann
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 100 == 0])
    got = {}
    for r in op4_ann(spark, folder).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = sum(len({v for _, v, _ in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    for q, found in got.items():
        found.sort()
        assert [n for n, _, _ in found] == list(range(1, len(want[q]) + 1))
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        vectors = dict(rows)
        assert all(abs(s - math.dist(vectors[q], vectors[v])) < 1e-12 for _, v, s in found)


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    vectors = (centres[rng.integers(0, 40, 6000)] + 0.4 * rng.normal(size=(6000, 24))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    asked = list(range(0, 6000, 60))
    want = brute(rows, asked)
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(base, base.where("vec_id % 60 = 0"), shard_size=1500).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for _, i in want[q]}) for q in asked) >= 0.95 * 10 * len(asked)


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (None, [1.0, 1.0]),
            (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [3.0, 1.0]), (100, [1.0, 2.0]), (200, []), (300, [5.0, 5.0])] + [(i, [1.0, 0.5]) for i in range(1000, 1200)]
    base = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int").repartition(5)
    asked = {i for i, _ in rows if i is not None and i % 100 == 0}
    got = {}
    for r in ann.search(base, base.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = brute(rows, asked)
    assert {q: [(s, v) for _, s, v in sorted(f)] for q, f in got.items()} == want
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(few, few.where("vec_id = 0")).collect()) == [(0, 1, 1), (0, 2, 2)]
    assert ann.search(few.limit(0), few.limit(0)).collect() == []


def test_pruning_keeps_diverse_edges():
    vectors = np.array([[0, 0], [1, 0], [1.1, 0], [0, 1], [-3, 0]], dtype=np.float32)
    graph = ann.Graph(vectors)
    kept = graph.pruned(np.array([0]), np.array([[1, 2, 3, 4, 1, -1, 0]]))[0]
    assert kept[kept >= 0].tolist() == [1, 3, 4]
