import hashlib
import math

import numpy as np
import pytest

from tapeframe.llm import centroids

FOLDER = "/root/testdata/sf0.001"


def brute(rows, k=8, rounds=10, width=64, scale=1024):
    """rows (id, whole-number vector) in Python integers."""
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)
    centres = [v for _, v in named[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        own = {}
        for _, v in rows:
            own.setdefault(place(v)[1], []).append(v)
        centres = [[sum(column) // len(own[n]) for column in zip(*own[n])] if n in own else c for n, c in enumerate(centres)]
    found = [place(v) for _, v in rows]
    inertia = [sum(d for d, n in found if n == c) for c in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((str(i), n, d, inertia[n], sum(inertia), digest[n]) for (i, _), (d, n) in zip(rows, found))


def whole(rows, scale=1024):
    return [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows]


def collected(frame):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in frame.collect())


def test_query_against_brute_force(spark):
    from tapeframe.llm.queries import op12_centroids
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    assert collected(op12_centroids(spark, FOLDER)) == brute(whole(rows))


@pytest.mark.parametrize("size", [3, 5_000, 1 << 40])
def test_search_equals_all_distances(size):
    rng = np.random.default_rng(size)
    points = rng.integers(-size, size + 1, (300, 16))
    centres = np.concatenate([points[:5], points[:2], rng.integers(-size, size + 1, (3, 16))])
    number, total = centroids.nearest(centroids.transform(points), centroids.transform(centres))
    apart = (points[:, None].astype(object) - centres[None].astype(object))
    distance = (apart * apart).sum(axis=2)
    assert number.tolist() == [min(range(len(centres)), key=lambda c: (row[c], c)) for row in distance]
    assert [int(t) for t in total] == [16 * min(row) for row in distance]


def test_transform_is_exact_and_coarse_first():
    rng = np.random.default_rng(3)
    v = rng.integers(-1000, 1000, (20, 64))
    h = centroids.transform(v)
    assert h[:, 0].tolist() == v.sum(axis=1).tolist()
    assert ((h * h).sum(axis=1) == 64 * (v * v).sum(axis=1)).all()
    unit = centroids.transform(np.eye(64, dtype=np.int64))
    changes = (unit.T[:, 1:] != unit.T[:, :-1]).sum(axis=1)
    assert changes.tolist() == list(range(64))


def test_edges(spark):
    base = [1.0, -2.0, 0.25, 0.0, 3.0, 1e-9, -1e-9, 0.5]
    shifted = lambda d: [x + d for x in base]
    good = [(1, base), (1, shifted(2.0)), (2, shifted(0.5)), (None, shifted(9.0)), (3, base)] + [(7, shifted(4.0))] * 30 + [(8, [1e9] * 8), (9, [-1e12] * 8)]
    bad = [(10, None), (11, base[:7]), (12, [*base, 1.0]), (13, [None, *base[1:]]), (14, [float("nan"), *base[1:]]), (15, [float("-inf"), *base[1:]]), (16, [])]
    frame = spark.createDataFrame([(i, v, 5, "x") for i, v in good + bad], "vec_id int, embedding array<double>, cluster int, key string").repartition(5)
    big = 1 << 63
    want = sorted((i, n, d if d < big else None, c if c < big else None, t if t < big else None, h) for i, n, d, c, t, h in brute(whole(good), k=3))
    got = collected(centroids.cluster(frame, centroids=3, width=8))
    assert len(got) == len(good) and {r[:3] for r in got} == {r[:3] for r in want} and {r[5] for r in got} == {r[5] for r in want}
    few = frame.where("vec_id in (1, 2, 3)")
    assert collected(centroids.cluster(few, centroids=30, width=8)) == brute(whole(good[:3] + good[4:5]), k=30)
    assert centroids.cluster(frame.where("vec_id is null"), width=8).collect() == []
    assert centroids.cluster(frame.limit(0)).collect() == [] and centroids.cluster(frame.where("vec_id = 10"), width=8).collect() == []
