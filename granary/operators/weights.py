"""Term frequencies, document frequencies, and TF-IDF vectors as plain rows of (chunk_id, term, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.config import EngineConfig
from granary.functions import text as T


def tokens(chunks: DataFrame) -> DataFrame:
    """chunk_id, terms (without stopwords, in order)."""
    return chunks.select("chunk_id", T.tokenize("text").alias("terms"))


def term_frequency(tokens: DataFrame) -> DataFrame:
    return tokens.select("chunk_id", F.explode("terms").alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def idf(tf: DataFrame, documents: int) -> DataFrame:
    """term, df, idf = ln((1 + n) / (1 + df)) + 1; tf has a row for each term of a chunk."""
    return rated(tf.groupBy("term").agg(F.count("*").alias("df")), documents)


def rated(counts: DataFrame, documents: int) -> DataFrame:
    """(term, df) with idf."""
    return counts.withColumn("idf", F.log((1.0 + documents) / (1 + F.col("df"))) + 1)


def grams(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, term, tf) of one- and two-word terms of the vectorizer."""
    words = rows.select(key, T.vectorizer_tokens("text").alias("w"))
    return words.select(key, F.explode(F.concat("w", T.adjacent("w"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(corpus_grams: DataFrame, documents: int, config: EngineConfig = EngineConfig()) -> DataFrame:
    """term, df, cf, idf of the max_features most frequent terms within the bounds of document frequency."""
    counted = corpus_grams.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    kept = counted.where((F.col("df") >= config.min_df) & (F.col("df") <= config.max_df * documents))
    return kept.orderBy(F.desc("cf"), "term").limit(config.max_features).withColumn("idf", F.log((1.0 + documents) / (1 + F.col("df"))) + 1)


def vectors(grams: DataFrame, vocabulary: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, term, w): sublinear tf times idf, of length 1 for each key. The vocabulary, of at most max_features rows, is
    broadcast; the norm is a window over the key's rows, which one shuffle brings together."""
    raw = grams.join(F.broadcast(vocabulary.select("term", "idf")), "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("w"))
