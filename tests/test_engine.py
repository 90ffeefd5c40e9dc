"""The engine on small fixtures with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from granary import registry
from granary.config import EngineConfig
from granary.functions import stem
from granary.functions import text as T
from granary.operators import answer, corpus, evaluate, graph, itemsets, minhash, retrieve, simhash, together, weights

CHUNKS = [
    (0, "The harbour pilot boards every tanker at the outer buoy. Smaller boats enter alone.", "a"),
    (1, "Lamp oil is kept in the north shed, away from the ropes and the tar.", "a"),
    (2, "Gulls nest on the breakwater until the last week of June.", "b"),
    (3, "", "b"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id long, text string, source_file string").cache()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "Where does the harbour pilot board a tanker?"), (2, "zzz unknown")], "query_id long, text string").cache()


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column("t").alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.tokenize, "The café x_y 9a Foo bar9, FOO") == ["foo", "bar9", "foo"]
    assert one(spark, T.tokenize, None) == []
    t = spark.createDataFrame([(["a"],), ([],), (["a", "b", "c", "a", "b", "c"],)], "t array<string>")
    assert [r[0] for r in t.select(T.shingles_k("t", 3)).collect()] == [["a"], [], ["a b c", "b c a", "c a b"]]
    assert [r[0] for r in t.select(T.shingles_ub("t")).collect()] == [["a"], [], ["a", "b", "c", "a b", "b c", "c a"]]


def test_clean(spark):
    text = "light-\nhouse is\nlit\n\nAnnual Harbour Manual 1931 | Page 7\n\n42\n\nthe ﬁrst  of\tMay"
    assert one(spark, T.clean, text) == "lighthouse is lit\n\nthe first of May"
    assert one(spark, T.extracted, "oﬃ-\ncer") == "officer" and one(spark, T.clean, None) is None


def test_clean_trims_spaces_of_every_part(spark):
    assert one(spark, T.clean, " 0 items cost 10\n\n 1 is 11 \n\n2 or 22") == "0 items cost 10\n\n1 is 11\n\n2 or 22"


def test_spans(spark):
    pairs = spark.createDataFrame([(i, 0, *r) for i, r in enumerate([("aaaa", "aa"), ("see the RED", "red the"), ("abab", "ab ba"), ("x", ""), (r"a\E.b", r"\E. zz")])], "query_id long, chunk_id long, text string, query string")
    got = {r["query_id"]: [(s["start"], s["end"]) for s in r["highlight_spans"]] for r in retrieve.highlights(pairs).collect()}
    assert got == {0: [(0, 4)], 1: [(4, 7), (8, 11)], 2: [(0, 4)], 4: [(1, 4)]}


def test_porter():
    words = "caresses ponies relational hopping falling vietnamization electrical adjustable controll roll sky"
    assert [stem.stem(w) for w in words.split()] == "caress poni relat hop fall vietnam electr adjust control roll sky".split()


def test_rankers(spark, chunks, queries):
    c = retrieve.build(chunks, EngineConfig(min_df=1))
    for method in ("tfidf", "minhash", "simhash", "hybrid"):
        rows = retrieve.retrieve(c, queries, method, 2).collect()
        first = {r["query_id"]: r for r in rows if r["rank"] == 1}
        assert first[1]["chunk_id"] == 0, method
    found = retrieve.retrieve(c, queries, "minhash", 2).where("query_id = 2").collect()
    assert {r["fallback_to"] for r in found} == {"tfidf"}
    found = retrieve.retrieve(c, queries, "hybrid", 2).where("query_id = 2").collect()
    assert {r["fallback_to"] for r in found} == {"simhash_scan"}
    found = retrieve.retrieve(c, queries, "tfidf", 50, source_file="b").collect()
    assert {r["chunk_id"] for r in found} == {2, 3}
    with pytest.raises(ValueError):
        retrieve.retrieve(c, queries, "nothing")
    with pytest.raises(ValueError):
        retrieve.retrieve(c, queries, "tfidf", 51)


def test_near_duplicates_are_lossless(spark):
    import random

    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = base + base[:5] + [0, 0, 0] + [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(3)]
    rows = [(i, f >> 32, f & 0xFFFFFFFF) for i, f in enumerate(fps)]
    got = {(r["a"], r["b"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "chunk_id long, fp_hi long, fp_lo long")).collect()}
    assert got == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= 4}


def test_pagerank(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "chunk_id long")
    edges = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "src long, dst long")
    got = {r["chunk_id"]: r["rank"] for r in graph.pagerank(nodes, edges, iterations=30, tolerance=0.0).collect()}
    rank, out = [0.2] * 5, {0: [1], 1: [0], 2: [1]}
    for _ in range(30):
        base = 0.15 / 5 + 0.85 * (rank[3] + rank[4]) / 5
        rank = [base + 0.85 * sum(rank[s] / len(d) for s, d in out.items() if n in d) for n in range(5)]
    assert all(abs(got[i] - rank[i]) < 1e-9 for i in range(5))


def test_pagerank_of_near_duplicates_by_classes(spark):
    fps = [0] * 5 + [1, 3, 3, 7 << 40, 7 << 40, (7 << 40) + 1, 1 << 60 | 0xFFFF, 0xF0F0F0F0F0F0]
    fp = spark.createDataFrame([(i, f >> 32, f & 0xFFFFFFFF) for i, f in enumerate(fps)], "chunk_id long, fp_hi long, fp_lo long")
    edges = graph.both_ways(simhash.near_duplicates(fp))
    assert edges.count() > 30
    want = {r["chunk_id"]: r["rank"] for r in graph.pagerank(fp, edges).collect()}
    got = {r["chunk_id"]: r["rank"] for r in graph.near_pagerank(fp).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want) and abs(sum(got.values()) - 1) < 1e-9
    assert {r["rank"] for r in graph.near_pagerank(fp.where("chunk_id > 10")).collect()} == {0.5}


def test_near_duplicates_broadcast_nothing(spark):
    fp = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 0, 1)], "chunk_id long, fp_hi long, fp_lo long")
    assert "Broadcast" not in simhash.near_duplicates(fp)._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_and_weighed_in_the_row(spark, monkeypatch):
    import random

    from granary.operators import lexical
    from granary.plans.engine import materialised

    rng = random.Random(7)
    texts = [" ".join(rng.choice("ab cd ef gh Äb x été ij kl".split()) for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["", None, "solo", "ab " * 9]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").withColumn("source_file", F.lit("s"))
    monkeypatch.setattr(lexical, "STRETCH", 100)
    near = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    for most in (3, 12, 1000):
        config = EngineConfig(max_features=most)
        grams = weights.grams(rows)
        known = weights.vocabulary(grams, 44, config)
        c = materialised(rows, config)
        assert near(c.vocabulary) == near(known)
        assert near(c.vectors.select("chunk_id", "term", "w")) == near(weights.vectors(grams, known))
        assert "Exchange" not in c.vectors._jdf.queryExecution().executedPlan().toString()
        q = retrieve.encode(spark.createDataFrame([(1, "ab cd"), (2, "zz"), (3, "ete ij kl ij kl")], "query_id long, text string"), c, config)
        every = c.vectors.join(q.vectors.withColumnRenamed("w", "qw"), "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * F.col("qw")).alias("cosine"))
        assert near(retrieve.tfidf_scores(c, q)) == near(every)
        assert near(retrieve.top(retrieve.tfidf_scores(c, q, k=4), "cosine", 4)) == near(retrieve.top(every, "cosine", 4))
    monkeypatch.setattr(lexical, "MOST_WORDS", 2)
    monkeypatch.setattr(lexical, "MOST_QUERIES", 1)
    c = materialised(rows, config)
    assert near(c.vocabulary) == near(known) and c.scores(rows, q, None) is None


def test_itemsets(spark):
    baskets = [(1, "abc"), (2, "abc"), (3, "abd"), (4, "cd")]
    rows = spark.createDataFrame([(i, t) for i, s in baskets for t in s], "chunk_id long, term string")
    pairs = itemsets.pairs(rows, 2)
    assert {tuple(r) for r in pairs.collect()} == {("a", "b", 3), ("a", "c", 2), ("b", "c", 2)}
    triples = itemsets.triples(rows, pairs, 2)
    assert [tuple(r) for r in triples.collect()] == [("a", "b", "c", 2)]
    idf = spark.createDataFrame([("a", 4.0), ("b", 3.5), ("c", 1.0)], "term string, idf double")
    cooc = itemsets.cooccurrence(pairs, triples, idf)
    assert {(r["term"], r["co_term"]): r["support"] for r in cooc.collect()}[("a", "b")] == 5
    q = spark.createDataFrame([(1, ["a"]), (2, ["c", "a"]), (3, [])], "query_id long, terms array<string>")
    assert {r["query_id"]: r["expansions"] for r in itemsets.expand(q, cooc).collect()} == {1: ["b"], 2: ["b"], 3: []}


def some_sets(n=90, seed=7):
    import random

    draw = random.Random(seed)
    return [(i, [f"t{x}" for x in range(24) if draw.random() < 1 / (1 + x / 4)]) for i in range(n)]


def counted(sets, size, support):
    import collections
    import itertools

    found = collections.Counter(c for _, s in sets for c in itertools.combinations(sorted(set(s)), size))
    return {c: n for c, n in found.items() if n >= support}


def test_pairs_and_triples_are_counted_without_rows_of_them(spark):
    """F7 to F11: every pair inside a text was a row before it was counted."""
    rows = some_sets()
    twice = rows + [(0, ["t23", "t22"]), (None, ["t0", "t23"]), (500, [])]
    rows[0] = (0, rows[0][1] + ["t23", "t22"])
    df = spark.createDataFrame(twice, "chunk_id long, terms array<string>")
    pairs, triples = itemsets.pairs(df, 3), itemsets.triples(df, None, 5)
    assert {(r["a"], r["b"]): r["support"] for r in pairs.collect()} == counted(rows, 2, 3)
    assert {(r["a"], r["b"], r["c"]): r["support"] for r in triples.collect()} == counted(rows, 3, 5)
    assert all("Generate" not in plan and "HashAggregate" not in plan for plan in (x._jdf.queryExecution().toString() for x in (pairs, triples)))
    idf = weights.idf(df.where("chunk_id is not null").select("chunk_id", F.explode("terms").alias("term")).distinct(), len(rows) + 1)
    key = ["term", "co_term", "support", "place"]
    slow = itemsets.cooccurrence(pairs, triples, idf).where("idf >= 1.2")
    fast = together.partners(together.numbered(together.sets(df), 3), 3, 5, len(rows) + 1)
    assert sorted(map(tuple, fast.where("idf >= 1.2").select(key).collect())) == sorted(map(tuple, slow.select(key).collect()))
    asked = spark.createDataFrame([(1, ["t3", "t9", "none"]), (2, ["t15"]), (3, [])], "query_id long, terms array<string>")
    some = itemsets.partners(together.sets(df), asked, 3, 5, len(rows) + 1, 3, 1.2)
    assert {r["term"] for r in some.collect()} == {"t3", "t9", "t15"}
    want = {r["query_id"]: r["expansions"] for r in itemsets.expand(asked, slow, 3, 1.2).collect()}
    assert {r["query_id"]: r["expansions"] for r in itemsets.expand(asked, some, 3, 1.2).collect()} == want and len(want[1]) == 6


def test_triples_in_small_pieces(monkeypatch):
    import numpy as np

    rows = some_sets()
    one = counted(rows, 1, 1)
    names = [t for (t,) in sorted(one, key=lambda t: (one[t], t))]
    sets = [sorted(names.index(t) for t in s) for _, s in rows]
    data = [(together.packed(np.array([len(s) for s in sets], np.int32)), together.packed(np.array(sum(sets, []), np.int32)), None)]
    for stretch in (1 << 22, 40, 3):
        monkeypatch.setattr(together, "STRETCH", stretch)
        found, got = together.Sets(data, np.zeros(len(names), np.int16), 0), {}
        for i, a in enumerate(found.heads.tolist()):
            for good, j, table in together.tripled(found, i, len(names), 5):
                for x, y in zip(*np.nonzero(table)):
                    got[tuple(sorted((names[a], names[good[j + x]], names[good[j + y]])))] = int(table[x, y])
        assert got == counted(rows, 3, 5)


def test_sets_and_sums_move_in_few_bytes():
    import zlib

    import numpy as np

    dice = np.random.default_rng(7)
    sets = [np.unique(dice.integers(0, 20_000, 190)) for _ in range(200)]
    ids = np.concatenate(sets).astype(np.int32)
    for values in (ids, ids[:0], np.array([0, 1 << 40, -5, 300], np.int64), np.sort(dice.integers(0, 1 << 50, 1000))):
        assert np.array_equal(together.unpacked(together.packed(values), values.dtype.type), values)
        assert np.array_equal(together.released(together.squeezed(values), values.dtype.type), values)
    assert len(together.packed(ids)) < 0.8 * len(zlib.compress(np.diff(ids, prepend=np.int32(0)).tobytes(), 1))


def test_texts_of_cooccurrence_stay_where_files_are_enough(spark, tmp_path):
    from granary import registry
    from granary.session import spread

    cores = spark.sparkContext.defaultParallelism
    spark.range(40).select(F.col("id").alias("doc_id"), F.lit("zebra quagga okapi").alias("text"), F.lit("s").alias("source")).repartition(cores).write.parquet(str(tmp_path / "documents.parquet"))
    rows = registry.chunks(spark, str(tmp_path))
    assert spread(rows, "chunk_id", 1) is rows and spread(rows, "chunk_id") is not rows
    moved = []
    keep = registry.weights.tokens
    registry.weights.tokens = lambda r: moved.append("Exchange" in r._jdf.queryExecution().toString()) or keep(r)
    try:
        found = registry.fim_cooccurrence(spark, str(tmp_path)).collect()
    finally:
        registry.weights.tokens = keep
    assert moved == [False] and {(r["term"], r["co_term"], r["support"]) for r in found} >= {("okapi", "quagga", 40), ("quagga", "okapi", 40)}


def test_tables_of_triples_are_small():
    import tracemalloc

    import numpy as np

    n, sets = 3000, 12
    data = [(together.packed(np.full(sets, n, np.int32)), together.packed(np.tile(np.arange(n, dtype=np.int32), sets)), None)]
    found = together.Sets(data, np.where(np.arange(n) == 0, 0, -1).astype(np.int16), 0)
    tracemalloc.start()
    try:
        total = sum(int((table >= sets).sum()) for _, _, table in together.tripled(found, 0, n, sets))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert total == (n - 1) * (n - 2) // 2
    assert peak < 60e6


def test_blocks_of_triples_have_equal_work(spark, monkeypatch):
    """fim_triples: terms that keep together have more triples than independent ones, so their blocks took much longer."""
    import math
    import random

    import numpy as np

    draw = random.Random(7)
    sets = [(i, [f"t{x:03}" for x in range(256) if i % 16 == x % 4] + [f"u{x}" for x in range(600) if draw.random() < 0.08]) for i in range(960)]  # t: four groups, each whole in 60 sets
    known = together.numbered(together.sets(spark.createDataFrame(sets, "chunk_id long, terms array<string>")), 40)
    seen, keep = [], together.dealt
    monkeypatch.setattr(together, "dealt", lambda known, block_of, *a: seen.append(block_of) or keep(known, block_of, *a))
    got = {(r["a"], r["b"], r["c"]): r["support"] for r in together.triples(known, 40).collect()}
    assert len(got) == 4 * math.comb(64, 3) and set(got.values()) == {60}
    number = {t: i for i, t in enumerate(known.terms)}
    in_block = np.bincount([seen[-1][min(number[t] for t in names)] for names in got])
    assert in_block.max() <= 0.2 * len(got)  # of 16 blocks


def test_triples_come_in_the_order_of_their_names(monkeypatch):
    import numpy as np

    dice = np.random.default_rng(7)
    for stretch in (1 << 22, 40, 3):
        monkeypatch.setattr(together, "STRETCH", stretch)
        for v, a in ((9, 0), (9, 55), (9, 200), (1, 5), (30, 100)):
            p = np.sort(dice.choice(np.setdiff1d(np.arange(201), [a]), v, replace=False)).astype(np.int32)
            whole, got = np.triu(dice.integers(0, 3, (v, v)), 1).astype(np.float32), []
            for j in range(0, v, 4):
                for columns in together.hits(whole[j : j + 4, j:], p, j, a):
                    got += zip(*(c.tolist() for c in columns))
            assert sorted(got) == sorted((*sorted((a, int(p[x]), int(p[y]))), int(whole[x, y])) for x, y in zip(*np.nonzero(whole)))


def test_itemset_support_does_not_grow_with_the_corpus(spark, tmp_path):
    texts = [f"w{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]} filler" + (" zebra okapi quagga" if i < 3 else "") for i in range(60)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a zebra")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = registry.queries()
    assert {r["a"]: r["support"] for r in found["fim_singletons"](spark, str(tmp_path)).collect()} == {"filler": 60, "okapi": 3, "quagga": 3, "zebra": 3}
    rows = registry.baskets(spark, str(tmp_path))
    assert ("okapi", "zebra", 3) in {tuple(r) for r in itemsets.pairs(rows, registry.CONFIG.fim_support).collect()}
    assert not found["fim_pairs"](spark, str(tmp_path)).count()
    assert ("okapi", "quagga", "zebra", 3) in {tuple(r) for r in itemsets.triples(rows, itemsets.pairs(rows, 3), 3).collect()}
    assert {r["query_id"]: r["expansions"] for r in found["expand_query"](spark, str(tmp_path)).collect()} == {1: ["okapi", "quagga"]}


def test_metrics(spark, queries):
    results = spark.createDataFrame([(1, "m", 1, 7, 1.0), (1, "m", 2, 8, 0.5), (1, "m", 3, 9, 0.4)], "query_id long, method string, rank int, chunk_id long, score double")
    qrels = spark.createDataFrame([(1, 7), (1, 9), (1, 10)], "query_id long, chunk_id long")
    rows = {r["query_id"]: r for r in evaluate.per_query(results, qrels, queries, spark.createDataFrame([("m",)], "method string"), 5).collect()}
    assert rows[1]["precision"] == pytest.approx(2 / 5) and rows[1]["recall"] == pytest.approx(2 / 3)
    assert rows[1]["average_precision"] == pytest.approx((1 + 2 / 3) / 3)
    assert rows[2]["precision"] == rows[2]["recall"] == rows[2]["average_precision"] == 0


def test_relevant_by_a_word_inside(spark, monkeypatch):
    texts = ["so the old pier stands", "bold pier stand", "the old pier standing", "a-b", "", None, "née_à côté-d'or x", "pier"]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    asked = ["the old pier stand", "old pier", "pier", "a-b", "", None, "e_à côté-d", "d pier s", "\\\\E.*"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    want = {(i, j) for i, p in enumerate(asked) for j, t in enumerate(texts) if p is not None and t is not None and p in t}
    got = [tuple(r) for r in evaluate.relevant(q, rows).collect()]
    assert set(got) == want and len(got) == len(want)
    assert "array_contains" in evaluate.relevant(q, rows)._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(evaluate, "MOST_ANCHORS", 1)
    assert {tuple(r) for r in evaluate.relevant(q, rows).collect()} == want


def test_answers(spark, chunks, queries):
    results = spark.createDataFrame([(1, 1, 0)], "query_id long, rank int, chunk_id long")
    got = {r["query_id"]: (r["answer"], r["chunk_id"]) for r in answer.extractive(results, chunks, queries).collect()}
    assert got[1] == ("The harbour pilot boards every tanker at the outer buoy.", 0)
    assert got[2] == (answer.NOTHING, None)


def test_only_texts_of_hits_move(spark, queries):
    """all texts were shuffled to meet a few results."""
    chunks = spark.range(200).select(F.col("id").alias("chunk_id"), F.concat(F.lit("pilot boards a tanker "), F.col("id").cast("string")).alias("text"), F.lit("a").alias("source_file"))
    results = graph.shared(spark.createDataFrame([(1, "tfidf", 1, 7), (1, "tfidf", 2, 999)], "query_id long, method string, rank int, chunk_id long"))
    for found in (answer.extractive(results, chunks, queries), answer.prompts(results, chunks, queries), evaluate.mine(results, chunks, queries), retrieve.hydrated(results, chunks, queries)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join LeftSemi" in plan and "rightHint=(strategy=broadcast)" in plan
    assert {r["chunk_id"]: r["text"] for r in found.collect()} == {7: "pilot boards a tanker 7", 999: ""}


def test_stems_of_null_and_sliced_rows(spark):
    from granary.functions import stem

    rows = [(1, ["cats", "running"]), (2, None), (3, []), (4, ["cats", "ponies"])]
    df = spark.createDataFrame(rows, "chunk_id int, terms array<string>").coalesce(1)
    assert {r[0]: r[1] for r in stem.stemmed(df).collect()} == {1: ["cat", "run"], 2: None, 3: [], 4: ["cat", "poni"]}


def test_windows(spark):
    rows = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, ""), (3, None)], "chunk_id long, text string")
    got = [(r["window"], r["text"]) for r in corpus.windows(rows, 4, 1).orderBy("window").collect()]
    assert got == [(0, "0 1 2 3"), (1, "3 4 5 6"), (2, "6 7 8 9"), (3, "9")]
    text = "One two three. Four five. Six seven eight nine. Ten."
    got = [r["text"] for r in corpus.sentence_windows(spark.createDataFrame([(1, text)], "chunk_id long, text string"), 6, 2).orderBy("window").collect()]
    assert got == ["One two three. Four five.", "Four five. Six seven eight nine.", "Ten."]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_rankers_write_no_index_of_terms_or_slots(spark, queries, monkeypatch, kind):
    """F17 to F21: tokens, stems, counts and signatures of all chunks were written side by side."""
    import random

    from granary.operators import lexical
    from granary.plans.engine import Materialised

    rng = random.Random(5)
    texts = [" ".join(rng.choice("pilot harbour tankers boarding buoy boats café lamp x1 ropes the gulls".split()) for _ in range(rng.randint(0, 12))) for _ in range(40)] + ["", None, "solo", "pilot " * 9]
    rows = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "chunk_id long, text string, source_file string").withColumn("chunk_id", F.col("chunk_id").cast(kind)).cache()
    config = EngineConfig(min_df=1, preselect=7)
    plain = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.collect())

    def found(c):
        q = retrieve.encode(queries, c, config)
        out = [plain(retrieve.retrieve(c, queries, "all", 3, config, s)) for s in (None, "b")] + [plain(retrieve.lsh(c, q, config).select("query_id", "chunk_id", "bands", "sig_jaccard"))]
        return out + [plain(c.fingerprints), plain(c.idf)]

    c = Materialised(rows, config)
    got = found(c)
    assert not {"tokens", "stems", "frequencies", "signatures", "vectors"} & set(vars(c))
    monkeypatch.setattr(lexical, "MOST_QUERIES", 0)
    monkeypatch.setattr(Materialised, "named", property(lambda self: False))
    c = Materialised(rows, config)
    assert found(c) == got and "signatures" in vars(c) and "frequencies" in vars(c)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_nearest_fingerprints_without_a_row_for_each_pair(spark, kind):
    import random

    from granary.plans.engine import materialised

    dice = random.Random(3)
    at = [dice.getrandbits(64) for _ in range(9)]
    fp = [(i, at[i % 9] ^ (1 << dice.randrange(64)) ^ (1 << dice.randrange(64))) for i in range(600)]
    table = spark.createDataFrame([(i, x >> 32, x & 0xFFFFFFFF) for i, x in fp], "chunk_id long, fp_hi long, fp_lo long").withColumn("chunk_id", F.col("chunk_id").cast(kind))
    asked = spark.createDataFrame([(i, x >> 32, x & 0xFFFFFFFF) for i, x in enumerate(at[:7])], "query_id long, fp_hi long, fp_lo long")
    chunks = table.select("chunk_id", F.lit("zebra").alias("text"), F.lit("s").alias("source_file"))
    corpus = materialised(chunks)
    corpus.__dict__["fingerprints"] = table.repartition(3)
    queries = retrieve.Queries(asked.select("query_id", F.lit("zebra").alias("text")), corpus, corpus.config)
    queries.__dict__["fingerprints"] = asked
    for k, threshold in ((5, 10), (50, 10), (5, 0), (1000, 12), (4, None)):
        found = retrieve.simhash_ranked(corpus, queries, k, threshold)
        plan = found._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        slow = retrieve.top(simhash.query_distances(asked, table).withColumn("similarity", 1 - F.col("hamming") / 64.0), "similarity", k)
        least = {r["query_id"]: r["h"] for r in slow.groupBy("query_id").agg(F.min("hamming").alias("h")).collect()}
        want = {(r["query_id"], r["rank"], r["chunk_id"], r["similarity"]) for r in slow.collect() if threshold is None or least[r["query_id"]] > threshold or r["hamming"] <= threshold}
        assert {(r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in found.collect()} == want and want
    none = retrieve.Queries(queries.rows.limit(0), corpus, corpus.config)
    none.__dict__["fingerprints"] = asked.limit(0)
    assert not retrieve.simhash_ranked(corpus, none, 5, 10).collect()


def test_fingerprints_of_chunks_that_share_an_id(spark):
    from granary.plans.engine import materialised

    c = materialised(spark.createDataFrame([(1, "tar ropes"), (1, "tar"), (2, "buoy"), (None, "tar")], "chunk_id long, text string"))
    tf = weights.term_frequency(weights.tokens(c.chunks))
    want = simhash.fingerprints(tf, weights.idf(tf, 4), c.chunks)
    assert not c.named and sorted(map(str, c.fingerprints.collect())) == sorted(map(str, want.collect()))


def test_signatures_estimate_jaccard(spark):
    rows = spark.createDataFrame([(i, [f"t{j}" for j in range(i * 50, i * 50 + 100)]) for i in (0, 1)] + [(2, []), (3, None)], "chunk_id long, terms array<string>")
    sig = {(r["chunk_id"], r["slot"]): r["value"] for r in minhash.signatures(rows, 128).collect()}
    least = {}
    for r in minhash.shingle_rows(rows).select("chunk_id", minhash.md5_part(F.col("shingle"), 0).alias("h")).collect():
        for i, (a, b) in enumerate(minhash.coefficients(j) for j in range(128)):
            least[r["chunk_id"], i] = min(least.get((r["chunk_id"], i), 1 << 62), (a * (r["h"] % minhash.PRIME) + b) % minhash.PRIME)
    assert sig == least and {k for k, _ in sig} == {0, 1}
    assert abs(sum(sig[0, s] == sig[1, s] for s in range(128)) / 128 - 1 / 3) < 0.15


def test_engine_builds_and_answers(spark, chunks, queries, tmp_path):
    from granary.plans.engine import Engine

    engine = Engine(spark, str(tmp_path), EngineConfig(min_df=1))
    version, status = engine.build(chunks)
    assert {r["action"] for r in status.collect()} == {"built"}
    assert {r["action"] for r in engine.build(chunks)[1].collect()} == {"skipped"}
    rows = engine.query(version, queries, "tfidf", 2).where("query_id = 1 and rank = 1").collect()
    assert rows[0]["chunk_id"] == 0 and rows[0]["highlight_spans"]
    with pytest.raises(ValueError):
        engine.query(version, spark.createDataFrame([(1, " ")], "query_id long, text string"))


def test_stream_appends(spark, tmp_path):
    from granary.streaming.ingest import documents_stream, start

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    idf = weights.idf(spark.createDataFrame([(1, "alpha")], "chunk_id long, term string"), 1)
    for i in range(2):
        spark.createDataFrame([(i, "alpha beta", "en", "s", 10)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        start(documents_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), idf).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/chunks")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out/signatures")).select("chunk_id").distinct().count() == 2


def test_reference_edges(spark):
    from granary.registry import TITLED

    edges = graph.reference_edges(spark.createDataFrame(TITLED, "chunk_id long, section_title string, text string"))
    assert {tuple(r) for r in edges.collect()} == {(2, 1), (2, 3), (3, 2)}


def test_store(spark, tmp_path):
    from granary.sources import store

    rows = corpus.full_chunks(spark.createDataFrame([(1, "some text", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long"))
    store.write_chunks(rows, str(tmp_path / "c"))
    assert store.read_chunks(spark, str(tmp_path / "c")).collect() == rows.collect()
    with pytest.raises(Exception):
        store.write_chunks(rows, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c_positions")).collect()[0]["position"] == 0
    (tmp_path / "p.txt").write_text("a first page that is long enough to be kept in the corpus\fshort")
    assert [r["page_number"] for r in store.read_pages(spark, str(tmp_path / "p.txt")).collect()] == [1]


def test_pages(spark):
    assert one(spark, T.is_contents_page, "a ... 1\nb ... 2\nc ... 3\nd ... 4\ne ... 5") and not one(spark, T.is_contents_page, "plain")
    assert one(spark, T.word_count, " a  b\n") == 2 and one(spark, T.word_count, None) == 0
    assert spark.range(1).select(F.size(T.title_keys(F.lit("Section 3.2 of 9a, 7"))).alias("n")).first()["n"] == 2


def test_chunks_by_title(spark):
    rows = [("f", 0, "Title", "One", 1), ("f", 1, "Text", "word " * 60, 1), ("f", 2, "Title", "Two", 2), ("f", 3, "Text", "short", 2), ("f", 4, "Title", "Three", 3), ("f", 5, "Text", "other " * 70, 4), ("g", 0, "Text", "x" * 4500 + " y" * 60, 1)]
    got = corpus.chunk_by_title(spark.createDataFrame(rows, "file string, position long, kind string, text string, page int")).orderBy("id").collect()
    assert [(r["id"], r["section_title"], r["page_start"], r["page_end"], r["word_count"]) for r in got if r["source_file"] == "f"] == [("f_000000", "One", 1, 1, 61), ("f_000001", "Two", 2, 4, 73)]
    assert all(r["char_count"] <= 2000 and r["word_count"] >= 50 for r in got) and [r["id"] for r in got if r["source_file"] == "g"] == ["g_000002"]


def test_files_pages_and_uploads(spark, tmp_path):
    from granary.sources import store

    with pytest.raises(FileNotFoundError):
        store.check_file(spark, str(tmp_path / "none.pdf"))
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError):
        store.read_pdf(spark, str(tmp_path / "a.txt"))
    rows = spark.createDataFrame([(1, " ", "a"), (2, None, "a")], "chunk_id long, text string, source_file string")
    with pytest.raises(ValueError):
        store.check_upload(rows)
    with pytest.raises(ValueError):
        store.check_upload(rows.drop("text"))
    assert store.check_upload(rows.union(spark.createDataFrame([(3, "t", "b")], rows.schema))).count() == 1
    pages = spark.createDataFrame([("a", 1, "Ropes\n\nAll ropes are dry.\n\n2 Tar\n\nTar is not."), ("a", 2, "More of it.")], "file string, page_number int, text string")
    assert [(r["kind"], r["text"], r["page"]) for r in store.page_elements(pages).orderBy("position").collect()] == [("Title", "Ropes", 1), ("Text", "All ropes are dry.", 1), ("Title", "2 Tar", 1), ("Text", "Tar is not.", 1), ("Text", "More of it.", 2)]
    spans = spark.createDataFrame([("a", 3), ("a", 5), ("b", None), ("c", 2)], "source_file string, page_end int")
    assert tuple(store.page_counts(spans).first()) == (3, 7)


def test_evidence_and_prompts(spark, chunks, queries):
    rows = [(1, "hybrid", 1, 0, 0.5), (1, "tfidf", 1, 1, 0.9), (2, "tfidf", 1, 2, 0.4), (3, "simhash", 1, 1, 0.3), (3, "minhash", 1, 0, 0.6)]
    results = spark.createDataFrame(rows, "query_id long, method string, rank int, chunk_id long, score double")
    assert {tuple(r) for r in answer.best_evidence(results, 1).collect()} == {(1, 1, 0), (2, 1, 2), (3, 1, 0)}
    long = "whole " * 100
    named = spark.createDataFrame([(0, long, "", 4), (1, "b", "Ropes", None)], "chunk_id long, text string, section_title string, page_start int")
    both = spark.createDataFrame([(1, 1, 0), (1, 2, 1)], "query_id long, rank int, chunk_id long")
    got = {r["query_id"]: r["prompt"] for r in answer.prompts(both, named, queries).collect()}
    assert got[1] == f"Excerpt 1 (Unknown section, page 4):\n{long.strip()}\n\nExcerpt 2 (Ropes, page 1):\nb\n\nQuestion: Where does the harbour pilot board a tanker?"


def test_queries_are_expanded_before_ranking(spark, queries):
    from granary.plans.engine import materialised

    config = EngineConfig(min_df=1, expand_queries=True, fim_min_idf=1.0)
    rows = [(i, t, "a") for i, t in enumerate(["pilot anchors", "pilot anchors", "pilot anchors", "anchor only", "nothing here", "else there"])]
    c = materialised(spark.createDataFrame(rows, "chunk_id long, text string, source_file string"), config)
    q = spark.createDataFrame([(1, "pilots")], "query_id long, text string")
    found = {r["chunk_id"] for r in retrieve.retrieve(c, q, "minhash", 5, config).collect()}
    plain = {r["chunk_id"] for r in retrieve.retrieve(c, q, "minhash", 5, EngineConfig(min_df=1)).collect()}
    assert plain == {0, 1, 2} and found == {0, 1, 2, 3}


def test_stated_sets_in_blocks(spark, monkeypatch):
    from granary import session

    monkeypatch.setattr(session, "BROADCAST_ROWS", 3)
    got = session.against(spark.range(4).toDF("a"), spark.range(10).toDF("b"))
    assert got.columns == ["a", "b"] and {tuple(r) for r in got.collect()} == {(a, b) for a in range(4) for b in range(10)}


def test_report(spark, chunks, queries, tmp_path):
    from granary.plans import report

    rows = report.scalability(spark, chunks, queries, str(tmp_path), (2,), ("tfidf",), EngineConfig(min_df=1))
    assert rows[0]["chunks"] == 8 and rows[0]["query_tfidf"] > 0 and rows[0]["build_signatures"] > 0
    report.dump(spark, {"scaling": rows, "none": []}, str(tmp_path / "out"))
    text = (tmp_path / "out/report.md").read_text()
    assert "| scale | chunks |" in text and "No rows." in text and (tmp_path / "out/results.json").exists()
    report.worksheet(spark, evaluate.worksheet(queries, spark.createDataFrame([("tfidf",)], "method string")), str(tmp_path / "sheet.md"))
    assert (tmp_path / "sheet.md").read_text().count("unscored") == 2
