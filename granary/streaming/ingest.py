"""Structured Streaming ingest: new documents become chunks, tokens and signatures; fingerprints under a frozen idf.

Signatures are functions of a row, so each micro-batch appends to its tables. Corpus-wide tables (idf, PageRank,
itemsets) are refreshed by Engine.build. A micro-batch writes under its own number, so one that is repeated after a
failure replaces its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.config import EngineConfig
from granary.functions.stem import stemmed
from granary.operators import corpus, minhash, simhash, weights


def documents_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def start(stream: DataFrame, folder: str, frozen_idf: DataFrame, config: EngineConfig = EngineConfig()) -> StreamingQuery:
    """Ingest what is there and stop (availableNow); call again for more. Tables: folder/{chunks,signatures,fingerprints}/batch=N."""

    def batch(rows: DataFrame, number: int) -> None:
        chunks = corpus.chunks(rows).where("text is not null and trim(text) != ''").dropDuplicates(["chunk_id"])
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        put(chunks, "chunks")
        chunks = rows.sparkSession.read.parquet(f"{folder}/chunks/batch={number}")
        tokens = weights.tokens(chunks)
        put(minhash.signatures(stemmed(tokens), config.num_perm), "signatures")
        put(simhash.fingerprints(weights.term_frequency(tokens), frozen_idf, chunks), "fingerprints")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by type and tumbling window, with a watermark; the same on a stream and on a table."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
