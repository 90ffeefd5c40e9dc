"""Approximate nearest neighbours by inner product: an inverted file of coarse centroids with product-quantised residuals.

Coarse centroids and codebooks are fitted by k-means on a bounded sample; every row is indexed. A query takes the lists
whose centroids have the largest inner products with it, of those that have rows. In a list, asymmetric distance tables (the query's products
with every codeword) rate each row by its centroid and codes. What each row's codes leave of it is stored as a length, so
that the rating's error has a known spread; rows that may be among the k best of their slab are recomputed exactly in
double precision, few where ratings tell rows apart, all of a group of near copies.

Lists are cut to slabs of bounded size, so a list with a third of all rows is many tasks' work; queries come in blocks.

Defined cases: vectors that are null, zero, of a dimension other than most vectors have, or that hold null or non-finite
components take no part, nor does a null vec_id; several rows with one vec_id are one vector (the smallest); queries have
fewer than k rows if there are fewer candidates in all; equal scores are ranked by vec_id; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import prepare, settle
from granary.llm.vectors import matrix, usable


@dataclass(frozen=True)
class AnnParams:
    """sample: rows that k-means sees; reached: the share of true neighbours whose lists shall be probed, by which fit sets
    the share of lists that a query takes (vectors without clusters need most of them, clustered ones few), unless
    probe_share gives it; rerank, sigmas: a slab's rows are recomputed if rated among so many best, or if the error of their
    codes, so many times its spread, could hide that they are among the k best."""

    k: int = 20
    sample: int = 16384
    max_lists: int = 4096
    reached: float = 0.97
    probe_share: float | None = None
    subspaces: int = 16
    codewords: int = 256
    slab: int = 4096
    rerank: int = 32
    sigmas: float = 3.0
    trials: int = 256
    queries: int = 512
    seed: int = 9


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # lists x d
    codebooks: list[np.ndarray]  # for each subspace: codewords x its width
    cuts: list[int]
    probe_share: float  # of the lists that a query takes


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    distinct = np.unique(x, axis=0)  # centroids that coincide would leave all but one of them empty
    k = min(k, len(distinct))
    c = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        own = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=k)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def foremost(score: np.ndarray, k: int) -> np.ndarray:
    """The columns of each row's k largest scores, of equal ones the first."""
    n, m = score.shape
    if m <= k:
        return np.broadcast_to(np.arange(m), score.shape)
    last = np.partition(score, m - k, 1)[:, m - k, None]
    above, equal = score > last, score == last
    return np.nonzero(above | (equal & (np.cumsum(equal, 1) <= k - above.sum(1, keepdims=True))))[1].reshape(n, k)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def fit(vectors: DataFrame, n: int, params: AnnParams = AnnParams()) -> Index:
    """From the rows first by a hash of vec_id, at most params.sample; copies count once."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(params.sample).toArrow()
    x = np.unique(matrix(rows.column("embedding")), axis=0)
    rng = np.random.default_rng(params.seed)
    centroids = k_means(x, int(max(1, min(params.max_lists, round(n**0.5 / 2)))), rng)
    rest = x - centroids[nearest(x, centroids)]
    d = x.shape[1]
    cuts = [round(i * d / min(params.subspaces, d)) for i in range(min(params.subspaces, d) + 1)]
    share = params.probe_share if params.probe_share is not None else needed(x, centroids, params, rng)
    return Index(centroids, [k_means(rest[:, a:b], params.codewords, rng) for a, b in zip(cuts, cuts[1:], strict=False)], cuts, share)


def needed(x: np.ndarray, centroids: np.ndarray, params: AnnParams, rng: np.random.Generator) -> float:
    """The least share of lists, best ones first, with the wanted share of true neighbours, for some rows of the sample as
    queries against all of it."""
    q = x[rng.choice(len(x), min(params.trials, len(x)), replace=False)]
    near = np.argpartition(-(q @ x.T), min(params.k, len(x) - 1), 1)[:, : params.k + 1]
    place = np.empty((len(q), len(centroids)), np.int64)
    np.put_along_axis(place, np.argsort(-(q @ centroids.T), 1), np.arange(len(centroids))[None, :], 1)
    taken = np.take_along_axis(place, nearest(x, centroids)[near], 1) + 1
    return float(np.quantile(taken, params.reached) / len(centroids))


def search(embeddings: DataFrame, queries: Column, params: AnnParams = AnnParams()) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows found nearest to each usable row for which queries holds, itself left out."""
    spark = embeddings.sparkSession
    prepare(spark)
    rows = settle(usable(embeddings), "vectors")
    n = rows.count()
    schema = "query_id long, vec_id long, score double"
    if n < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sent = spark.sparkContext.broadcast(fit(rows, n, params))  # at most max_lists centroids and 256 codewords
    lists = len(sent.value.centroids)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in batches:
            x = matrix(b.column(1))
            own = nearest(x, index.centroids)
            rest = x - index.centroids[own] if len(x) else x
            codes = np.stack([nearest(rest[:, a:z], c) for a, z, c in zip(index.cuts, index.cuts[1:], index.codebooks, strict=False)], 1).astype(np.uint8) if len(x) else np.zeros((0, 1), np.uint8)
            coded = np.concatenate([c[codes[:, j]] for j, c in enumerate(index.codebooks)], 1) if len(x) else rest
            left = np.sqrt(((rest - coded) ** 2).sum(1)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left.astype(np.float32)), b.column(1)], names=["list", "vec_id", "codes", "error", "embedding"])

    coded = settle(rows.select("vec_id", "embedding").mapInArrow(encode, "list long, vec_id long, codes binary, error float, embedding array<double>"), "coded")
    sizes = {r[0]: r[1] for r in coded.groupBy("list").count().collect()}  # at most max_lists rows
    empty = np.array([i not in sizes for i in range(lists)])
    probes = max(1, int(np.ceil(len(sizes) * sent.value.probe_share)))
    slabs = F.array(*[F.lit(-(-sizes.get(i, 0) // params.slab) or 1) for i in range(lists)])

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table.column("vec_id")))
        ids, x = np.asarray(table.column("vec_id"))[order], matrix(table.column("embedding"))[order]
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
        error = np.asarray(table.column("error")).astype(np.float32)[order]
        return pa.table({"list": [key[0].as_py()], "ids": [ids.tobytes()], "codes": [codes.tobytes()], "errors": [error.tobytes()], "x": [x.tobytes()]})

    slab = F.pmod(F.xxhash64("vec_id"), F.element_at(slabs, (F.col("list") + 1).cast("int")))
    packed = coded.withColumn("slab", slab).groupBy("list", "slab").applyInArrow(pack, "list long, ids binary, codes binary, errors binary, x binary")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in batches:
            q, ids = matrix(b.column(1)), np.asarray(b.column(0))
            if not len(ids):
                continue
            rate = q @ index.centroids.T
            rate[:, empty] = -np.inf
            take = np.zeros(rate.shape, bool)
            np.put_along_axis(take, np.argpartition(-rate, probes - 1, 1)[:, :probes], True, 1)
            for at in range(0, len(ids), params.queries):
                some = [(i, np.flatnonzero(take[at : at + params.queries, i]) + at) for i in range(lists)]
                some = [(i, r) for i, r in some if len(r)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array([ids[r].tobytes() for _, r in some], pa.binary()), pa.array([q[r].tobytes() for _, r in some], pa.binary())], names=["list", "query_ids", "q"])

    asked = rows.where(queries).mapInArrow(probe, "list long, query_ids binary, q binary")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for r in batch.to_pylist():
                qids, ids = np.frombuffer(r["query_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q, x = np.frombuffer(r["q"]).reshape(len(qids), -1), np.frombuffer(r["x"]).reshape(len(ids), -1)
                codes = np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1)
                score = np.repeat((q @ index.centroids[r["list"]]).astype(np.float32)[:, None], len(ids), 1)
                for j, (a, z, c) in enumerate(zip(index.cuts, index.cuts[1:], index.codebooks, strict=False)):
                    score += (q[:, a:z] @ c.T).astype(np.float32).take(codes[:, j], axis=1)  # the asymmetric table of this subspace
                score[qids[:, None] == ids[None, :]] = -np.inf
                spread = params.sigmas / np.sqrt(x.shape[1]) * np.frombuffer(r["errors"], np.float32) * np.sqrt((q * q).sum(1))[:, None].astype(np.float32)
                m = len(ids)
                last = np.partition(score, m - params.k, 1)[:, m - params.k, None] if m > params.k else np.full((len(qids), 1), -np.inf)
                may = score + spread >= last
                np.put_along_axis(may, foremost(score, params.rerank), True, 1)
                may &= qids[:, None] != ids[None, :]
                row, at = np.nonzero(may)
                exact = np.concatenate([np.zeros(0)] + [np.einsum("ij,ij->i", x[at[i : i + 65536]], q[row[i : i + 65536]]) for i in range(0, len(at), 65536)])
                order = np.lexsort((ids[at], -exact, row))
                row, at, exact = row[order], at[order], exact[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < params.k
                yield pa.RecordBatch.from_arrays([pa.array(qids[row[kept]]), pa.array(ids[at[kept]]), pa.array(exact[kept])], names=["query_id", "vec_id", "score"])

    found = asked.join(packed, "list").mapInArrow(rate, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= params.k).select("query_id", "rank", "vec_id", "score")
