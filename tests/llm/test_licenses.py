import duckdb

from tapeframe.llm import licenses
from tests.conftest import FOLDER


def brute(text):
    pieces = {text, *text.split("\n"), *__import__("re").split(r"\n\s*\n", text), *__import__("re").split(r"[.!?]\s+|\n", text)}
    found = {}
    for piece in pieces:
        own = set(licenses.bigrams_of(piece))
        for name, template in licenses.TEMPLATES.items():
            want = set(licenses.bigrams_of(template))
            score = 2 * len(own & want) / (len(own) + len(want)) if own else 0
            if score >= licenses.THRESHOLD:
                found[name] = max(score, found.get(name, 0))
    return found


def test_query_against_sql(spark, duck):
    from tapeframe.llm.queries import op3_licenses
    from tapeframe.llm.registry import ORACLES
    for folder in (FOLDER, "/root/testdata/sf0.01"):
        db = duckdb.connect()
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        columns = ["doc_id", "license", "score", "segments"]
        got = sorted(tuple(r) for r in op3_licenses(spark, folder).select(columns).collect())
        assert got == sorted(db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['op3_licenses']})").fetchall()) and got


def test_edges(spark):
    mit = licenses.TEMPLATES["MIT"]
    texts = [None, "", "license", "Released under the MIT License.", "released UNDER\tthe  (MIT) license", "Prose first.\n" + mit + "\n\nmore prose",
             mit.replace("charge", "cost").replace("sell", "vend"), "x " * 200000 + "\nReleased under the MIT License.\n" + "y " * 1000,
             "Licensed under CC BY-NC 4.0. Words follow here.", "nothing at all"]
    rows = [(i, t, "c", 1.0) for i, t in enumerate(texts)] + [(3, texts[3], "c", 1.0), (None, texts[3], "c", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string, score double")
    got = {(r.doc_id, r.license): r for r in licenses.scan(docs).collect()}
    want = {(i, name): score for i, t in enumerate(texts) if t for name, score in brute(t).items()}
    assert {k for k in got if k[0] is not None} == set(want)
    assert all(abs(got[k].score - s) < 1e-12 for k, s in want.items())
    assert (None, "MIT (line)") in got and got[3, "MIT (line)"].segments == 2
    assert licenses.scan(docs.limit(0)).collect() == []


def test_anchors_cover_every_template():
    anchors = set(licenses.anchor_words(licenses.TEMPLATES, licenses.THRESHOLD))
    for template in licenses.TEMPLATES.values():
        pairs = licenses.bigrams_of(template)
        free = [p for p in pairs if not anchors & set(p.split())]
        assert len(free) < len(pairs) * licenses.THRESHOLD / (2 - licenses.THRESHOLD)


def test_plan_is_native(spark):
    from tapeframe.llm.queries import op3_licenses
    plan = op3_licenses(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian"))
