import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tapeframe.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "Hello, World's END", "it's they'LL we'd 123 4x5", "naïve café\tÉCOLE\n\nßtraße ΣΑΣ ΟΔΟΣ", "a" * 30, "日本語 テスト 🙂🙂 x",
         "<|endoftext|>start<|startoftext|> <|endoftext|", "été    \x1c\x85​ x", "İstanbul ǅ", "!!!??? ...'s", "x" * 5000,
         "ab" * 700 + " tail", "\u0000\u0001 á", " ", "१२३ ½ ² ⅷ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_equals_library(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    for row in got:
        ids, text = expected(library, TEXTS[row.doc_id])
        assert [int.from_bytes(row.ids[i:i + 4], "little") for i in range(0, len(row.ids), 4)] == ids, TEXTS[row.doc_id][:40]
        assert row.text == text


def test_random_words_equal_library(library):
    vocabulary = bpe.Vocabulary(PATH)
    cache = bpe.WordCache(vocabulary)
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice("abcdetnr sioéüñß'.,!19 \n") for _ in range(rng.randint(0, 60)))
        raw = bpe.encode_text(text, vocabulary, cache)
        assert [int.from_bytes(raw[i:i + 4], "little") for i in range(0, len(raw), 4)] == library.encode(text, add_special_tokens=False).ids, text


def test_scan_and_heap_merge_alike():
    vocabulary = bpe.Vocabulary(PATH)
    rng = random.Random(5)
    for _ in range(200):
        word = "".join(rng.choice("abthein") for _ in range(rng.randint(1, 80)))
        assert vocabulary.merge_scan(vocabulary.symbols(word)) == vocabulary.merge_heap(vocabulary.symbols(word))


def test_query_over_table(spark, library):
    from tapeframe.llm.queries import op10_bpe
    from tests.conftest import FOLDER
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = op10_bpe(spark, FOLDER).collect()
    assert len(got) == len(texts)
    for row in got:
        ids, text = expected(library, texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert bpe.decode(bpe.encode(docs, PATH), PATH).collect() == []


def test_every_code_point_equals_library(library):
    """Alone, doubled, next to letters and to a number."""
    vocabulary = bpe.Vocabulary(PATH)
    cache = bpe.WordCache(vocabulary)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    wrong = []
    for at in range(0, len(points), 20_000):
        texts = [f"a{chr(c)}b {chr(c)}{chr(c)}1{chr(c)}" for c in points[at:at + 20_000]]
        for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
            if bpe.encode_text(text, vocabulary, cache) != b"".join(i.to_bytes(4, "little") for i in want.ids):
                wrong.append(text)
    assert not wrong, [hex(ord(t[1])) for t in wrong[:20]]


def test_random_code_points_equal_library(library):
    vocabulary = bpe.Vocabulary(PATH)
    cache = bpe.WordCache(vocabulary)
    rng = random.Random(9)
    young = [c for a, z in bpe.NOT_YET_WORDS for c in (a, z)] + sorted(bpe.LOWER)
    points = [*range(0x20, 0x250), *range(0x370, 0x600), *range(0x4E00, 0x4E40), *range(0x1E00, 0x2000)]
    texts = ["".join(chr(rng.choice(young if rng.random() < 0.2 else points)) if rng.random() < 0.8 else rng.choice(" aB1\n.") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert bpe.encode_text(text, vocabulary, cache) == b"".join(i.to_bytes(4, "little") for i in want.ids), text
