import math

import numpy as np
import pytest

from tapeframe.llm import whitening

FOLDER = "/root/testdata/sf0.001"


def brute(vectors, count=16):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    z = fit - s / n
    values, components = np.linalg.eigh(z.T @ z / n)
    values, components = values[::-1], components[:, ::-1]
    white = (x - s / n) @ components[:, :count] / np.sqrt(values[:count])
    return n, ((n * x - s) ** 2).sum(axis=1), white, values[:count] / values.sum()


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.1"])
def test_query_against_brute_force(spark, folder):
    from tapeframe.llm.queries import op11_whitening
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    n, deviation, white, explained = brute([r.embedding for r in rows])
    got = op11_whitening(spark, folder).toPandas()
    assert len(got) == 16 * len(rows) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[[r.vec_id for r in rows]].to_numpy()
    for k in range(16):
        sign = np.sign(table[:, k] @ white[:, k])
        assert np.abs(table[:, k] - sign * white[:, k]).max() < 1e-8
    first = got[got["component"] == 1].set_index("vec_id")["deviation"]
    assert [first[r.vec_id] for r in rows] == deviation.tolist()
    assert np.allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-12)


@pytest.mark.parametrize("spectrum", [np.linspace(5, 1, 40), np.r_[np.full(20, 3.0), np.full(20, 1.0)], np.r_[1e6, np.full(39, 1.0)], np.r_[7.0, 7.0 - 1e-13, np.zeros(38)],
                                      np.geomspace(1e4, 1e-8, 40), np.full(40, 2.0), np.r_[np.linspace(9, 8, 12), np.full(10, 5.0), np.linspace(4, 0, 18)]])
def test_components_of_known_spectra(spectrum):
    turn, _ = np.linalg.qr(np.random.default_rng(2).standard_normal((40, 40)))
    v = turn * spectrum @ turn.T
    v = (v + v.T) / 2
    values, vectors = whitening.largest_components(v, 16)
    assert np.abs(values - np.sort(spectrum)[::-1][:16]).max() < 1e-13 * 40 * spectrum.max()
    assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-12
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * spectrum.max() * 40


def test_inertia_counts():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    spectrum, values = whitening.Spectrum(a), np.linalg.eigvalsh(a)
    for shift in np.r_[rng.uniform(-20, 20, 50), values + 1e-9, values - 1e-9]:
        assert spectrum.above(shift) == (values > shift).sum()


def test_projection_is_made_by_the_contour():
    v = np.diag([9.0, 5.0, 4.0, 0.5])
    out = whitening.project(v, np.eye(4), 3.0, 6.0, nodes=16)
    assert np.allclose(np.diag(out), [0, 1, 1, 0], atol=1e-3) and np.abs(out - np.diag(np.diag(out))).max() < 1e-12


def test_exact_sums_of_large_numbers(spark):
    rng = np.random.default_rng(4)
    rows = [[int(x) for x in rng.integers(-(1 << 60), 1 << 60, 3)] for _ in range(50)]
    frame = spark.createDataFrame([(r,) for r in rows], "x array<long>").repartition(4)
    got = whitening.product_sums(frame, [5, -7, 0], 3)
    moved = [[a - b for a, b in zip(r, [5, -7, 0])] for r in rows]
    assert got == [[sum(r[i] * r[j] for r in moved) for j in range(3)] for i in range(3)]


def test_edges(spark):
    good = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (2, [0.0, 1.0, 0.25]), (None, [3.0, -1.0, 0.5]), (4, [2.0, 2.0, 8.0])] + [(9, [5.0, 5.0, 5.0])] * 40
    bad = [(5, None), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (10, []), (11, [1.0]), (12, [1e30, 0.0, 0.0])]
    base = spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in good + bad], "vec_id int, embedding array<double>, n int, whitened double, key string").repartition(6)
    got = whitening.whiten(base).toPandas()
    n, deviation, white, explained = brute([v for _, v in good], 3)
    assert len(got) == 3 * len(good) and set(got["n"]) == {5} and got["identity_error"][0] < 1e-9
    for (i, _), d, w in zip(good, deviation, white):
        own = got[got["vec_id"].isna() if i is None else got["vec_id"] == i]
        assert {int(x) for x in own["deviation"]} == {int(d)}
        for k in range(3):
            assert np.allclose(np.abs(own[own["component"] == k + 1]["whitened"]), abs(w[k]))
    alone = whitening.whiten(base.where("vec_id = 9"))
    assert {(r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in alone.collect()} == {(k, 1, 0, None, None, None) for k in (1, 2, 3)}
    two = whitening.whiten(base.where("vec_id in (1, 2)")).collect()  # variance along one line only
    assert all((r.whitened is None) == (r.component > 1) for r in two) and len(two) == 9
    assert whitening.whiten(base.where("vec_id in (5, 6, 10)")).collect() == [] and whitening.whiten(base.limit(0)).collect() == []
    assert {r.n for r in whitening.whiten(base, width=1).collect()} == {1}
