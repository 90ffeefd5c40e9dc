"""One query for each corpus operator: the operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import ann, bpe, embedding_dedup, language_id, license_scan, ngram_jaccard, packing, quality_classifier, substring_dedup, warc
from granary.llm.common import read

HELD_OUT = f"{quality_classifier.HELD_OUT} AS held_out"


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.join(read(spark, sf_dir, "documents"), ngram_jaccard.JaccardParams(words=3, percent=90))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), digests=True).drop("text")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = language_id.fit(documents)
    return language_id.predict(documents.select("doc_id", "text", F.expr(HELD_OUT)), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(read(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = quality_classifier.fit(documents, read(spark, sf_dir, "labels"))
    return quality_classifier.score(documents.select("doc_id", "text", F.expr(HELD_OUT)), model).select("doc_id", "held_out", "score", "predicted")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.fresh_folder(spark)
    warc.write(read(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Components of link (a, b): the smallest node that each node reaches.
REACH = "reach(a, b) AS (SELECT id, id FROM node UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b), root AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY 1)"
LEADS = ", ".join(f"lead(word, {i}) OVER o" for i in range(1, 13))

ORACLES = {
    "op1_ngram_jaccard": rf"""
        WITH RECURSIVE node AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             word AS (SELECT id, unnest(w) AS word, unnest(range(len(w))) AS i FROM node),
             run AS (SELECT id, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o) AS s, i, count(*) OVER (PARTITION BY id) AS n FROM word WINDOW o AS (PARTITION BY id ORDER BY i)),
             shingle AS MATERIALIZED (SELECT DISTINCT id, s FROM run WHERE i + 3 <= n OR (n < 3 AND i = 0)),
             size AS MATERIALIZED (SELECT id, count(*) AS n FROM shingle GROUP BY 1),
             half AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM shingle x JOIN shingle y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2),
             pair AS MATERIALIZED (SELECT a, b FROM half JOIN size p ON p.id = a JOIN size q ON q.id = b WHERE 100 * shared >= 90 * (p.n + q.n - shared)),
             link AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
             {REACH}
        SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id FROM root LEFT JOIN size USING (id)""",
    "op5_embedding_dedup": f"""
        WITH RECURSIVE node AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
             able AS (SELECT id, x FROM node WHERE len(x) > 0 AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND list_dot_product(x, x) > 0),
             link AS MATERIALIZED (SELECT p.id AS a, q.id AS b FROM able p JOIN able q ON p.id <> q.id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.9),
             {REACH}
        SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM root LEFT JOIN (SELECT a AS id, count(*) AS n FROM link GROUP BY 1) USING (id)""",
    "op10_substring_dedup": rf"""
        WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             word AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM doc),
             run AS (SELECT doc_id, i, concat_ws(' ', word, {LEADS}) AS s, lead(word, 12) OVER o AS last FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
             seen AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS hit FROM run WHERE last IS NOT NULL),
             gone AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS i FROM seen WHERE hit),
             kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM doc LEFT JOIN kept USING (doc_id)""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest,
                          max(page_id) OVER (PARTITION BY html) AS last FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
        FROM d""",
}


def oracle_sql() -> dict[str, str]:
    return ORACLES
