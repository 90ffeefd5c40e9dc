"""Frequent itemsets of terms (one to three), the co-occurrence map, and query expansion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.stem import stemmed
from granary.operators import together
from granary.operators.graph import shared


def singletons(transactions: DataFrame, support: int) -> DataFrame:
    """(a, support) of terms in at least `support` chunks; transactions are distinct (chunk_id, term)."""
    return transactions.groupBy(F.col("term").alias("a")).agg(F.count("*").alias("support")).where(F.col("support") >= support)


def pairs(transactions: DataFrame, support: int) -> DataFrame:
    """(a, b, support), a < b, of terms in `support` chunks or more; transactions are distinct (chunk_id, term), or
    chunks' (chunk_id, terms)."""
    return together.pairs(together.numbered(together.sets(transactions), support), support)


def triples(transactions: DataFrame, pairs: DataFrame | None, support: int) -> DataFrame:
    """(a, b, c, support), a < b < c, of terms in `support` chunks or more, with (a, b) among the pairs, if these are given."""
    found = together.triples(together.numbered(together.sets(transactions), support), support)
    return found if pairs is None else found.join(pairs.select("a", "b"), ["a", "b"], "left_semi").select("a", "b", "c", "support")


def partners(sets: DataFrame, asked: DataFrame, support: int, triple_support: int, documents: int, top_n: int = 3, min_idf: float = 3.0) -> DataFrame:
    """The rows of cooccurrence that expand can need for queries (query_id, terms), written once.

    A query of m terms passes over its own terms and what was added before, so a list is read to (top_n + 1) * m at most.
    """
    terms = [r["term"] for r in asked.select(F.explode("terms").alias("term")).distinct().collect()]
    longest = asked.agg(F.coalesce(F.max(F.size("terms")), F.lit(0))).first()[0]
    known = together.numbered(sets, support)
    return shared(together.partners(known, support, max(support, triple_support), documents, terms, min_idf, (top_n + 1) * max(0, longest)))


def cooccurrence(pairs: DataFrame, triples: DataFrame, idf: DataFrame) -> DataFrame:
    """(term, co_term, support, weight, place): each itemset adds its support to every ordered pair of its members.

    Partners are ranked by support times idf, then by name.
    """
    two = pairs.select(F.array("a", "b").alias("items"), "support")
    three = triples.select(F.array("a", "b", "c").alias("items"), "support")
    each = two.union(three).select("items", "support", F.explode("items").alias("term")).select("term", "support", F.explode("items").alias("co_term")).where("term != co_term")
    total = each.groupBy("term", "co_term").agg(F.sum("support").alias("support"))
    rated = total.join(idf.select(F.col("term").alias("co_term"), "idf"), "co_term", "left").withColumn("weight", F.col("support") * F.coalesce("idf", F.lit(1.0)))
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc(F.round("weight", 9)), "co_term"))
    return rated.withColumn("place", place).select("term", "co_term", "support", "weight", "place", F.coalesce("idf", F.lit(0.0)).alias("idf"))


def expand(query_terms: DataFrame, cooccurrence: DataFrame, top_n: int = 3, min_idf: float = 3.0) -> DataFrame:
    """(query_id, expansions): for each of the query's terms (array, in order) its first top_n partners that are not in
    the query or added for an earlier term, among those with enough idf. Exact and sequential, inside one row."""
    partners = cooccurrence.where(F.col("idf") >= min_idf).groupBy("term").agg(F.array_sort(F.collect_list(F.struct("place", "co_term"))).alias("p"))
    asked = query_terms.select("query_id", "terms", F.posexplode_outer("terms").alias("pos", "term")).join(partners, "term", "left")
    lists = asked.groupBy("query_id").agg(F.first("terms").alias("terms"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda x: F.transform(F.coalesce(x["p"], F.array().cast("array<struct<place:int,co_term:string>>")), lambda y: y["co_term"])).alias("lists"))
    step = lambda acc, partner: F.concat(acc, F.slice(F.filter(partner, lambda t: ~F.array_contains(acc, t) & ~F.array_contains(F.col("terms"), t)), F.lit(1), F.lit(top_n)))
    return lists.select("query_id", F.aggregate("lists", F.array().cast("array<string>"), step).alias("expansions"))


def expanded(queries: DataFrame, cooccurrence: DataFrame | Callable[[DataFrame], DataFrame], top_n: int = 3, min_idf: float = 3.0) -> DataFrame:
    """queries (query_id, text) with their expansions after the text. cooccurrence: the map, or what makes the part of it
    that queries (query_id, terms) need."""
    terms = stemmed(queries.select("query_id", T.tokenize("text").alias("terms")))
    found = expand(terms, cooccurrence(terms) if callable(cooccurrence) else cooccurrence, top_n, min_idf)
    return queries.join(found, "query_id").select("query_id", F.concat_ws(" ", "text", F.array_join("expansions", " ")).alias("text"))
