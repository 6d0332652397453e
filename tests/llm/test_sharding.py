import math
import zlib
from collections import defaultdict

import xxhash

from tapeframe.llm import sharding
from tests.conftest import FOLDER


def score(key, shard, weight):
    seed = 42 if key is None else xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), 42)
    bits = xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), seed) >> 11
    return -math.log((bits + 0.5) / 2**53) / weight


def winner(key, weights):
    return min((score(key, s, w), s) for s, w in enumerate(weights) if w)[1]


def check_slots(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query_against_brute_force(spark):
    from tapeframe.llm.queries import op8_sharding
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = op8_sharding(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r.shard == winner(r.doc_id, [1.0] * 24)
        assert r.grown_shard in (r.shard, 24) and r.grown_shard == winner(r.doc_id, [1.0] * 25)
    check_slots(rows)


def test_edges(spark):
    rows = [(None, None, 1), (None, "x", 1), (7, "same", 2), (7, "same", 2), (8, "", 3)] + [(9, "hot", 4)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(7)
    got = sharding.place(docs, 5).collect()
    assert len(got) == len(rows)
    assert all(r.shard == winner(r.doc_id, [1.0] * 5) for r in got)
    check_slots(got)
    assert sharding.place(docs.limit(0), 5).collect() == []


def test_weights_share_the_rows(spark):
    docs = spark.range(20000).selectExpr("id doc_id", "'t' text")
    got = {r["shard"]: r["count"] for r in sharding.place(docs, 3, weights=[1.0, 3.0, 0.0]).groupBy("shard").count().collect()}
    assert set(got) == {0, 1} and abs(got[1] / 20000 - 0.75) < 0.02
