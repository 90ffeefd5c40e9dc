"""The pipeline over a small table: every stage's decisions take effect on what the stage before it kept."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    make = lambda parts, n=60: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(n))
    rows = []
    for i in range(240):
        lang = ("aa", "bb")[i % 2]
        parts = {"aa": ["the", "ing", "wh", "on"], "bb": ["sch", "ei", "ung", "ü"]}[lang]
        rows.append([i, make(parts) if i % 8 else "BUY!! NOW!! $$$ " * 40, lang, "s", 0])
    rows[50][1] = rows[49][1] + " tail"
    passage = make(["the", "wh"], 20)
    rows[61][1], rows[63][1] = f"{rows[61][1]} {passage}", f"{passage} {rows[63][1]}"
    rows.append([240, "1234 5678", "aa", "s", 0])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 8 > 0)) for i in range(240)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    junk = {i for i in range(240) if i % 8 == 0}
    assert not ids[0] & junk and len(ids[0]) >= 200
    assert 240 not in ids[1] and len(ids[1]) >= 195
    assert 49 in ids[2] and 50 not in ids[2] and len(ids[1]) - len(ids[2]) == 1
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "stage3")).collect()}
    assert passage in texts[61] and passage not in texts[63]
    assert ids[4] == ids[3]
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.count() == docs.count()


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty and repeated rows, one doc_id with two texts, columns that operators make, an empty table."""
    rng = random.Random(4)
    make = lambda n=60: " ".join("".join(rng.choice(["the", "ing", "wh", "on"]) for _ in range(3)) for _ in range(n))
    a, b, c = make(), make(), make()
    names = ["kept", "n_words", "n_removed", "spans", "score", "predicted", "lang_pred", "stays", "component_id", "others", "own"]
    rows = [(0, a), (1, b), (1, c), (1, c), (2, a + " more"), (3, None), (4, ""), (None, a), (None, None), (5, f"{make(20)} {b}"), (6, "word " * 30000), (7, "é")]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names)
    table = spark.createDataFrame([(i, t, "aa", *[f"{n}{k}" for n in names]) for k, (i, t) in enumerate(rows)], schema)
    spark.createDataFrame([(0, 1), (2, 0), (None, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for docs in (table, table.limit(0)):
            docs.write.mode("overwrite").parquet(str(tmp_path / "docs"))
            out = stage(spark, spark.read.parquet(str(tmp_path / "docs")), str(tmp_path))
            if k == 4:
                assert (out.count() == 0) == (docs is not table)
                continue
            assert out.columns == docs.columns
            got = out.collect()
            at = {f"score{k}": k for k in range(len(rows))}
            assert all(r[n] == f"{n}{at[r['score']]}" for r in got for n in names)
            if docs is not table:
                assert not got
            elif name == "n-gram Jaccard join":
                assert sorted(map(str, [(r["doc_id"], r["text"]) for r in got])) == sorted(map(str, [rows[i] for i in (0, 1, 2, 5, 6, 7, 8, 9, 10, 11)]))
            elif name == "substring dedup":
                assert len(got) == len(rows) and {r["text"] for r in got if r["doc_id"] == 2} == {"more"}
