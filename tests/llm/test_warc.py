import base64
import gzip
import hashlib
import os

import pytest

from tapeframe.llm import warc
from tests.conftest import FOLDER


def base32(raw):
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def test_query_against_brute_force(spark):
    from tapeframe.llm.queries import op7_warc
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    first = {}
    for p in pages:
        first[p.html] = min(first.get(p.html, p.page_id), p.page_id)
    want = sorted((p.page_id, len((p.html or "").encode()), base32((p.html or "").encode()), "response" if first[p.html] == p.page_id else "revisit",
                   None if first[p.html] == p.page_id else first[p.html]) for p in pages)
    got = sorted(tuple(r) for r in op7_warc(spark, FOLDER).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert got == want


@pytest.fixture(scope="module")
def written(spark):
    rows = [(3, "http://a/\r\nx", "same", 1), (1, "http://b/%20é", "same", 1), (1, "http://b/%20é", "same", 1), (2, None, None, 1), (4, "u", "", 1),
            (None, "n", "same", 1), (None, None, "alone", 1), (5, "big", "ä" * 3_000_000, 1)] + [(i, "copy", "hot page", 1) for i in range(100, 400)]
    folder = warc.archive_folder(spark)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(5)
    return rows, folder, warc.write(pages, folder)


def test_round_trip_and_edges(spark, written):
    rows, folder, index = written
    got = warc.read(index, folder).collect()
    assert len(got) == len(rows) and sorted((r.key or "", r.url or "") for r in got) == sorted((str(k) if k else "", u or "") for k, u, *_ in rows)
    by = {}
    for r in got:
        by.setdefault((r.key, r.record_type), []).append(r)
    assert [r.payload for r in by["1", "response"]] == [b"same"] and [r.refers_to for r in by["1", "revisit"]] == ["1"]
    assert by["3", "revisit"][0].refers_to == "1" and by["3", "revisit"][0].payload is None and by["3", "revisit"][0].payload_bytes == 4
    assert by["2", "response"][0].payload == b"" and by["4", "revisit"][0].refers_to == "2"
    assert {r.url: r.record_type for k, v in by.items() if k[0] is None for r in v} == {"n": "revisit", None: "response"}
    assert by["5", "response"][0].payload == ("ä" * 3_000_000).encode()
    assert len(by["100", "response"]) == 1 and all(len(by[str(i), "revisit"]) == 1 for i in range(101, 400))
    assert all(r.digest == base32(r.payload) for r in got if r.payload is not None)


def test_index_points_at_whole_members(written):
    _, folder, index = written
    for r in index.collect():
        with open(os.path.join(folder, r.archive), "rb") as file:
            file.seek(r.offset)
            assert gzip.decompress(file.read(r.length)).startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())


def test_selected_records_only(spark, written):
    _, folder, index = written
    got = warc.read(index.where("key in ('100', '250', '5')"), folder, block_bytes=1000, gap_bytes=10).collect()
    assert sorted(r.key for r in got) == ["100", "250", "5"]


def test_short_payloads_are_all_responses(spark):
    folder = warc.archive_folder(spark)
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.key: r.record_type for r in warc.read(warc.write(pages, folder, least_bytes=5), folder).collect()}
    assert got == {"1": "response", "2": "response", "3": "response", "4": "revisit"}
    assert warc.read(warc.write(pages.limit(0), folder), folder).collect() == []


def test_ranges_are_merged():
    spans = [("a", 0, 10), ("a", 10, 5), ("a", 30, 5), ("a", 500, 5), ("b", 505, 5), ("b", 510, 200)]
    assert list(warc.coalesced(iter(spans), 20, 100)) == [("a", 0, 35, [(0, 10), (10, 5), (30, 5)]), ("a", 500, 505, [(500, 5)]),
                                                         ("b", 505, 510, [(505, 5)]), ("b", 510, 710, [(510, 200)])]
