"""Packing into optimal length buckets: dynamic programming over the global length histogram, then token-budget batches.

The histogram of all lengths goes to the driver. Lengths are at most max_tokens (longer texts are cut to pieces), so it
is bounded by that parameter. Dynamic programming finds the bucket boundaries of least padding, exactly. Inside a
bucket, rows form batches of as many rows as the token budget holds at the bucket's length.

Batches are numbered inside streams: a bucket's rows are dealt by a hash to as many streams as keep a stream at
stream_rows, so a bucket with a third of all rows is many tasks' work. Each stream leaves at most one batch unfilled.

Defined cases: null and empty texts, and those without words, are one piece of no tokens, in the first bucket (of length
1 at least); a null doc_id is packed like any; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PackingParams:
    max_tokens: int = 2048
    buckets: int = 8
    budget: int = 16384
    stream_rows: int = 4096


def words(text: str = "text") -> Column:
    """The number of words of a text: runs without 0x20 and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0))


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The boundaries (largest lengths of the buckets, ascending) that minimise padding; fewer buckets win ties."""
    lengths, counts = np.maximum(np.asarray(lengths, np.int64), 0), np.asarray(counts, np.int64)
    n = len(lengths)
    if not n:
        return []
    rows, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    # cost of a bucket over lengths i..j: every row is padded to lengths[j]
    best = [lengths * rows[1:] - tokens[1:]]
    cut = [np.zeros(n, np.int64)]
    for _ in range(1, min(buckets, n)):
        before, now, at = best[-1], best[-1].copy(), np.full(n, -1)
        for j in range(1, n):
            cost = before[:j] + lengths[j] * (rows[j + 1] - rows[1 : j + 1]) - (tokens[j + 1] - tokens[1 : j + 1])
            i = int(cost.argmin())
            if cost[i] < now[j]:
                now[j], at[j] = cost[i], i
        best.append(now)
        cut.append(at)
    k = int(np.argmin([b[-1] for b in best]))
    found, j = [], n - 1
    while True:
        found.append(int(lengths[j]))
        while k and cut[k][j] < 0:
            k -= 1
        if not k:
            return sorted(found)
        j, k = int(cut[k][j]), k - 1


def pack(documents: DataFrame, params: PackingParams = PackingParams(), tokens: Column | None = None) -> DataFrame:
    """doc_id, piece, start, n_tokens, bucket (its length), stream, batch, slot for each piece of each row.

    A batch is named by (bucket, stream, batch); its rows are padded to the bucket's length, and slots count from 0.
    tokens: the number of tokens of a row, words by default.
    """
    size = F.greatest(F.lit(0), (words() if tokens is None else tokens)).cast("long")
    top = params.max_tokens
    # the salt tells rows of one doc_id apart by their texts, so that these have no stream in common
    salt = F.xxhash64("text") if "text" in documents.columns else F.lit(0).cast("long")
    counted = documents.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("total"), salt.alias("salt"))
    pieces = counted.select("doc_id", "total", "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.expr(f"(total - 1) div {top}")).cast("long"))).alias("piece"))
    pieces = pieces.select("doc_id", "salt", F.col("piece").cast("int").alias("piece"), (F.col("piece") * top).alias("start"), F.least(F.lit(top), F.col("total") - F.col("piece") * top).cast("int").alias("n_tokens"))
    histogram = pieces.groupBy("n_tokens").count().orderBy("n_tokens").toPandas()  # at most max_tokens + 1 rows
    lengths, counts = histogram["n_tokens"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64)
    ends = boundaries(lengths, counts, params.buckets) or [0]
    inside = np.diff(np.concatenate([[0], [counts[lengths <= e].sum() for e in ends]])).astype(int)
    bucket, streams = F.lit(max(1, ends[-1])), F.lit(max(1, -(-int(inside[-1]) // params.stream_rows)))
    for e, rows in list(zip(ends, inside, strict=True))[-2::-1]:
        fits = F.col("n_tokens") <= e
        bucket, streams = F.when(fits, max(1, e)).otherwise(bucket), F.when(fits, max(1, -(-int(rows) // params.stream_rows))).otherwise(streams)
    dealt = pieces.withColumn("bucket", bucket.cast("int")).withColumn("stream", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens", "salt"), streams).cast("int"))
    place = F.row_number().over(Window.partitionBy("bucket", "stream").orderBy("doc_id", "piece", "n_tokens", "salt")) - 1
    held = F.greatest(F.lit(1), F.expr(f"{params.budget} div bucket"))
    return dealt.withColumn("place", place).select("doc_id", "piece", "start", "n_tokens", "bucket", "stream", F.expr(f"cast(place div greatest(1, {params.budget} div bucket) as int)").alias("batch"), F.pmod(F.col("place"), held).cast("int").alias("slot"))
