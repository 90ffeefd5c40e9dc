"""Answers: quality filter, extractive answers, prompts, citations, and a hook for a language model of the user's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import retrieve

NOTHING = "No sufficiently clean evidence was found for this question."


def extractive(results: DataFrame, chunks: DataFrame, queries: DataFrame, least_quality: float = 0.25) -> DataFrame:
    """(query_id, answer, cited): of each query's best clean chunk the sentence with most of the query's terms, the
    earliest of several; a fixed text and no citation without any clean chunk."""
    rows = results.select("query_id", "rank", "chunk_id").join(retrieve.hit(chunks, results).select("chunk_id", "text"), "chunk_id").where(T.text_quality("text") >= least_quality)
    top = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id"))).where("place = 1")
    q = queries.select("query_id", T.answer_terms("text").alias("q"))
    each = top.join(q, "query_id").select("query_id", "chunk_id", "q", F.posexplode(T.sentences(F.trim("text"))).alias("pos", "sentence"))
    each = each.withColumn("overlap", F.size(F.array_intersect(T.answer_terms("sentence"), F.col("q"))))
    best = each.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), "pos"))).where("place = 1")
    found = best.select("query_id", F.trim("sentence").alias("answer"), "chunk_id")
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("answer", F.lit(NOTHING)).alias("answer"), "chunk_id")


def best_evidence(results: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, chunk_id) that each query's answer is made from: what hybrid found, else what tfidf found, else the
    best k of all methods' results."""
    merged = retrieve.merged(results, k).select("query_id", "rank", "chunk_id")
    found = None
    for method, rows in [(m, results.where((F.col("method") == m) & (F.col("rank") <= k)).select("query_id", "rank", "chunk_id")) for m in ("hybrid", "tfidf")] + [("merged", merged)]:
        found = rows if found is None else found.union(rows.join(found.select("query_id").distinct(), "query_id", "left_anti"))
    return found


def prompts(results: DataFrame, chunks: DataFrame, queries: DataFrame, longest: int | None = None) -> DataFrame:
    """(query_id, prompt): the question under its numbered excerpts, each whole with its section and page. longest: cut
    excerpts after so many characters. Chunks without section_title or page_start have an unknown section, page 1."""
    optional = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in chunks.columns else F.lit(default)
    named = retrieve.hit(chunks, results).select("chunk_id", "text", optional("section_title", "").alias("section"), optional("page_start", 1).alias("page"))
    rows = results.select("query_id", "rank", "chunk_id").join(named, "chunk_id")
    section = F.when(F.col("section") == "", "Unknown section").otherwise(F.col("section"))
    line = F.concat(F.lit("Excerpt "), F.col("rank").cast("string"), F.lit(" ("), section, F.lit(", page "), F.col("page").cast("string"), F.lit("):\n"), F.trim("text") if longest is None else T.snippet("text", longest))
    blocks = rows.withColumn("line", line).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n\n").alias("excerpts"))
    return queries.join(blocks, "query_id", "left").select("query_id", F.concat(F.coalesce("excerpts", F.lit("")), F.lit("\n\nQuestion: "), "text").alias("prompt"))


def cited_chunks(answers: DataFrame) -> DataFrame:
    """answers (query_id, answer, chunk_ids) with cited: the chunks of the excerpts an answer cites, else the first."""
    numbers = T.citations("answer", F.size("chunk_ids"))
    found = F.transform(numbers, lambda n: F.get("chunk_ids", n - 1))
    return answers.withColumn("numbers", numbers).withColumn("cited", F.when(F.size("numbers") > 0, found).otherwise(F.slice("chunk_ids", 1, 1)))


def generated(prompts: DataFrame, extractive: DataFrame, model: Callable[[str], str] | None = None) -> list[dict]:
    """Answers of a driver-side model for a bounded table of prompts; the extractive answer without a model or on failure."""
    plain = {r["query_id"]: r["answer"] for r in extractive.collect()}
    out = []
    for r in prompts.collect():
        answer = plain.get(r["query_id"], NOTHING)
        if model is not None:
            try:
                answer = model(r["prompt"]) or answer
            except Exception:  # noqa: BLE001  a model that fails must not fail the query
                pass
        out.append({"query_id": r["query_id"], "answer": answer})
    return out
