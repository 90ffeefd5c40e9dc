"""Effectiveness: precision, recall, average precision, comparisons, sensitivity, candidate mining, label counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators.retrieve import hit
from granary.session import against

LABELS = ("correct", "partial", "incorrect", "unscored")


#: Queries whose words are looked up in each text; more are met one by one.
MOST_ANCHORS = 1_000


def relevant(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id): chunks that contain the query's text.

    A word inside a passage, with other characters on both sides, is a whole word of each text that contains the passage:
    texts are searched only for passages whose longest such word they have. Passages without one are sent to every chunk.
    """
    q = queries.select("query_id", F.col("text").alias("passage"))
    inner = F.regexp_extract_all(F.coalesce("passage", F.lit("")), F.lit(r"(?<=[^\p{L}\p{N}_])([\p{L}\p{N}_]+)(?=[^\p{L}\p{N}_])"), F.lit(1))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("size"), w.alias("word"))))["word"]
    named = q.withColumn("anchor", longest)
    rows = chunks.select("chunk_id", "text")
    found = lambda met: met.where(F.expr("contains(text, passage)")).select("query_id", "chunk_id")
    anchors = [r[0] for r in named.where("anchor is not null").select("anchor").distinct().limit(MOST_ANCHORS + 1).collect()]
    if not anchors or len(anchors) > MOST_ANCHORS:
        return found(against(rows, q))
    has = F.array_intersect(T.word_runs("text"), F.array(*map(F.lit, anchors)))
    met = against(rows.withColumn("has", has).where(F.size("has") > 0), named.where("anchor is not null"))
    plain = against(rows, named.where("anchor is null and passage is not null").select("query_id", "passage"))
    return found(met.where(F.expr("array_contains(has, anchor)"))).union(found(plain))


def judged(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """results with hit (1 or 0)."""
    return results.join(qrels.withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def per_query(results: DataFrame, qrels: DataFrame, queries: DataFrame, methods: DataFrame, k: int) -> DataFrame:
    """(method, query_id, precision, recall, average_precision) at k; a query without relevant chunks has 0 in all."""
    rows = judged(results.where(F.col("rank") <= k), qrels)
    hits = F.sum("hit").over(Window.partitionBy("method", "query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    total = qrels.groupBy("query_id").agg(F.count("*").alias("relevant"))
    sums = rows.withColumn("gain", F.col("hit") * hits / F.col("rank")).groupBy("method", "query_id").agg(F.sum("hit").alias("hits"), F.sum("gain").alias("gain"))
    every = queries.select("query_id").crossJoin(methods)
    found = every.join(sums, ["method", "query_id"], "left").join(total, "query_id", "left")
    share = lambda c, by: F.when(F.col("relevant") > 0, F.coalesce(F.col(c), F.lit(0)) / by).otherwise(F.lit(0.0))
    return found.select("method", "query_id", share("hits", F.lit(float(k))).alias("precision"), share("hits", F.col("relevant")).alias("recall"), share("gain", F.col("relevant")).alias("average_precision"))


def summary(per_query: DataFrame) -> DataFrame:
    """(method, precision, recall, map): means over queries."""
    return per_query.groupBy("method").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("average_precision").alias("map"))


def rollup(per_query: DataFrame, categories: DataFrame) -> DataFrame:
    """Means of precision by method and category, by method, and over all."""
    return per_query.join(categories, "query_id").rollup("method", "category").agg(F.count("*").alias("queries"), F.avg("precision").alias("precision"))


def fallback_rates(results: DataFrame) -> DataFrame:
    """(method, fallback_rate): the share of queries with a fallback."""
    each = results.groupBy("method", "query_id").agg(F.max(F.col("fallback_to").isNotNull().cast("int")).alias("f"))
    return each.groupBy("method").agg(F.avg("f").alias("fallback_rate"))


def precision_curve(results: DataFrame, qrels: DataFrame, queries: DataFrame, methods: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(method, k, precision): mean precision at several k, from one ranked result."""
    rows = judged(results, qrels)
    n = queries.agg(F.count("*").alias("n"))
    at = methods.select("method", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    hits = at.join(rows.select("method", "rank", "hit"), "method", "left").groupBy("method", "k").agg(F.sum(F.when(F.col("rank") <= F.col("k"), F.col("hit")).otherwise(0)).alias("hits"))
    return hits.crossJoin(F.broadcast(n)).select("method", "k", F.coalesce(F.col("hits") / F.col("k") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)).alias("precision"))


def mine(results: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates for labelling: (query_id, chunk_id, found_by, best_rank, term_overlap, snippet, place)."""
    each = results.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("method", "rank"))).alias("m"), F.min("rank").alias("best_rank"))
    rows = each.join(hit(chunks, results).select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    rows = rows.withColumn("term_overlap", T.term_overlap("text", "query")).withColumn("snippet", T.snippet("text"))
    order = Window.partitionBy("query_id").orderBy(F.desc("term_overlap"), "best_rank", "chunk_id")
    by = F.array_join(F.transform("m", lambda x: F.concat(x["method"], F.lit(":"), x["rank"].cast("string"))), ",")
    return rows.select("query_id", "chunk_id", by.alias("found_by"), "best_rank", "term_overlap", "snippet", F.row_number().over(order).alias("place"))


def label_counts(scores: DataFrame) -> DataFrame:
    """(method, correct, partial, incorrect, unscored) from (query, method, score); unknown labels are unscored."""
    known = F.when(F.col("score").isin(*LABELS), F.col("score")).otherwise("unscored")
    return scores.withColumn("label", known).groupBy("method").pivot("label", list(LABELS)).agg(F.count(F.lit(1))).na.fill(0)


def worksheet(queries: DataFrame, methods: DataFrame) -> DataFrame:
    """(query_id, method, score): one unscored row for each query and method, to be labelled."""
    return queries.select("query_id").crossJoin(methods).withColumn("score", F.lit("unscored"))


def candidate_rates(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """One row from (query_id, candidates): the share of queries with a candidate and their mean number over all queries."""
    each = queries.select("query_id").join(candidates.groupBy("query_id").agg(F.max("candidates").alias("c")), "query_id", "left")
    return each.agg(F.avg((F.coalesce("c", F.lit(0)) > 0).cast("int")).alias("candidate_rate"), F.avg(F.coalesce("c", F.lit(0))).alias("mean_candidates"))
