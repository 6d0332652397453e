import itertools
import random
import re

import pytest

from tapeframe.llm import mixing

FOLDER = "/root/testdata/sf0.001"


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def wanted(sizes, words, share=1.5, limit=2):
    """Targets by the contract's own steps: share, cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, left = set(), share * words
    while True:
        open_ = [s for s in names if s not in full]
        if not open_:
            return {s: float(limit * sizes[s]) for s in names}
        rest = left - sum(limit * sizes[s] for s in full)
        part = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if part[s] > limit * sizes[s]}
        if not over:
            return {s: part.get(s, float(limit * sizes[s])) for s in names}
        full |= over


def check(rows, allowed=0.002):
    """rows (source, size, source_size, target, taken)."""
    sizes, taken, given = {}, {}, {}
    for source, size, source_size, target, took in rows:
        assert 0 <= took <= 2 * size and (size == 0 or took % size == 0)
        sizes[source] = sizes.get(source, 0) + size
        taken[source] = taken.get(source, 0) + took
        given[source] = (source_size, target)
    target = wanted(sizes, sum(sizes.values()))
    for s in sizes:
        assert given[s][0] == sizes[s] and abs(given[s][1] - target[s]) < 1e-6 * max(1, target[s])
        assert abs(taken[s] - target[s]) <= allowed * target[s] + 1


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_query(spark, folder):
    from tapeframe.llm.queries import op13_mixing
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op13_mixing(spark, folder).collect()
    assert len(got) == len(docs) and all(r["size"] == size_of(docs[r.doc_id].text) for r in got)
    check([(docs[r.doc_id].source, r["size"], r.source_size, r.target, r.taken) for r in got])
    if folder == FOLDER:
        assert sorted(got) == sorted(op13_mixing(spark, folder).collect())


def test_edges_and_hot_rows(spark):
    rows = [(i, "w " * (1 + i * 7 % 23), f"s{i % 4}") for i in range(400)] + [(9999, "a b c", "s1")] * 500 + [(None, "x y", None)] * 30
    rows += [(5000, None, "s2"), (5001, "", "s3"), (5002, " \t\n", None), (5003, "nbsp joined é", ""), (5004, "w " * 5000, "s0"), (5005, None, "empty")]
    docs = spark.createDataFrame([(i, t, s, 1, "p") for i, t, s in rows], "doc_id long, text string, source string, size int, pattern string").repartition(7)
    mixed, sources = mixing.mix(docs)
    known = {r.source: r for r in sources.collect()}
    got = mixed.collect()
    assert sorted((str(r.doc_id), r["size"], r.sources) for r in got) == sorted((str(i), size_of(t), [s]) for i, t, s in rows)
    check([(r.sources[0], r["size"], known[r.sources[0]]["size"], known[r.sources[0]].target, r.taken) for r in got])
    assert all(r.used_for == r.sources * r.copies and r.taken == r.copies * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3))[0].collect()))
    mixed, sources = mixing.mix(docs.limit(0))
    assert mixed.collect() == [] and sources.collect() == []
    mixed, sources = mixing.mix(docs.where("text is null"))
    assert {(r["size"], r.taken) for r in mixed.collect()} == {(0, 0)} and {r.target for r in sources.collect()} == {0.0}


def test_overlapping_sources(spark):
    from pyspark.sql import functions as F
    rows = [(i, "w " * (5 + i % 30), m) for i, m in enumerate(itertools.islice(itertools.cycle([["a"], ["a", "b"], ["b", "c"], ["c"], ["d"], [], None, ["b", "a", "b"]]), 1600))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, of array<string>").repartition(5)
    mixed, sources = mixing.mix(docs, F.col("of"), share=1.2)
    got, known = mixed.collect(), {r.source: r for r in sources.collect()}
    used = {}
    for r in got:
        assert r.copies <= 2 and len(r.used_for) == r.copies and set(r.used_for) <= set(r.sources)
        for s in r.used_for:
            used[s] = used.get(s, 0) + r["size"]
    assert set(used) == {"a", "b", "c", "d"}
    for s, words in used.items():
        assert known[s].taken == words and abs(words - known[s].target) < 0.02 * known[s].target
    assert all(r.taken == 0 for r in got if not r.sources)


def least_cost(patterns, quotas, limit, slices):
    """Largest flow and its least cost by trying every division in whole slices of tiny sizes."""
    best = (0, 0)
    names = sorted(quotas)
    choices = []
    for sources, size in patterns:
        own = [range(limit * size + 1) if s in sources else (0,) for s in names]
        choices.append([c for c in itertools.product(*own) if sum(c) <= limit * size])
    step_cost = lambda size, used: sum(next(k for k in range(1, limit * slices + 1) if size * k // slices > u) for u in range(used))
    for division in itertools.product(*choices):
        if all(sum(c[i] for c in division) <= quotas[s] for i, s in enumerate(names)):
            flow = sum(map(sum, division))
            cost = sum(step_cost(size, sum(c)) for (_, size), c in zip(patterns, division))
            best = max(best, (flow, -cost))
    return best[0], -best[1], step_cost


def test_subset_is_the_nearest_sum():
    rng = random.Random(4)
    for _ in range(300):
        sizes = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(rng.randint(0, 4))}
        goal = rng.randint(1, 30)
        sums = {sum(s * n for s, n in zip(sizes, c)) for c in itertools.product(*(range(n + 1) for n in sizes.values()))}
        taken = mixing.subset(sizes, goal)
        assert all(0 < n <= sizes[s] for s, n in taken.items())
        assert abs(sum(s * n for s, n in taken.items()) - goal) == min(abs(x - goal) for x in sums)


@pytest.mark.parametrize("patterns, quotas", [
    ([(["a"], 2), (["a", "b"], 2), (["b"], 1)], {"a": 4, "b": 3}),
    ([(["a", "b"], 3), (["b", "c"], 2)], {"a": 5, "b": 3, "c": 3}),
    ([(["a"], 1), (["a", "b"], 3)], {"a": 2, "b": 6}),
    ([(["a"], 4)], {"a": 3, "z": 9}),
])
def test_route_is_a_largest_flow_of_least_cost(patterns, quotas):
    sent = mixing.route(patterns, quotas, limit=2, slices=2)
    flow, cost, step_cost = least_cost(patterns, quotas, 2, 2)
    assert all(set(own) <= set(sources) and sum(own.values()) <= 2 * size for own, (sources, size) in zip(sent, patterns))
    assert all(sum(own.get(s, 0) for own in sent) <= quotas[s] for s in quotas)
    assert sum(sum(own.values()) for own in sent) == flow
    assert sum(step_cost(size, sum(own.values())) for own, (_, size) in zip(sent, patterns)) == cost
