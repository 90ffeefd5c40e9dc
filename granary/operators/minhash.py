"""MinHash signatures in long form, banding, candidates and Jaccard similarities.

One family for every engine: h is the first 31 bits or so of an md5 modulo p, slot i keeps the least (a_i h + b_i) mod p.
Products stay under 2**62, so nothing overflows in ANSI mode. The long form (one row a slot) is the band table at one
row a band, and its matches counted are the signature's similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.stem import known
from granary.operators import lexical

PRIME = (1 << 31) - 1


def coefficients(i: int) -> tuple[int, int]:
    """a and b of slot i, by a rule that SQL can repeat."""
    return (i * 1103515245 + 12345) % PRIME, (i * 22695477 + 1) % PRIME


def md5_part(value: Column, part: int) -> Column:
    """32 bits of an md5, from the front."""
    return F.conv(F.substring(F.md5(value), part * 8 + 1, 8), 16, 10).cast("long")


def shingle_rows(tokens: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, shingle): distinct terms and pairs of adjacent terms."""
    return tokens.select(key, F.explode(T.shingles_ub("terms")).alias("shingle"))


def signatures(tokens: DataFrame, num_perm: int, key: str = "chunk_id") -> DataFrame:
    """(key, slot, value) of rows with terms; no row without any. A row's shingles are hashed in the JVM and reduced to
    num_perm minima in place, a batch of rows at a time: nothing is shuffled and no shingle becomes num_perm rows."""
    hashed = hashes(tokens, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, out in minima(batches, num_perm):
            named = keys.take(pa.array(np.repeat(np.arange(len(keys)), num_perm)))
            yield pa.RecordBatch.from_arrays([named, pa.array(np.tile(np.arange(num_perm, dtype=np.int32), len(keys))), pa.array(out.ravel())], names=[key, "slot", "value"])

    return hashed.mapInArrow(run, f"{key} {hashed.schema[key].dataType.simpleString()}, slot int, value long")


def hashes(tokens: DataFrame, key: str) -> DataFrame:
    """(key, h): a hash of each shingle."""
    return tokens.select(key, F.transform(T.shingles_ub("terms"), lambda s: md5_part(s, 0) % PRIME).alias("h"))


def minima(batches: Iterator[pa.RecordBatch], num_perm: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Keys of rows with shingles, and a signature of each; a filter on shingles in the JVM would make them twice."""
    for batch in batches:
        batch = batch.filter(pc.fill_null(pc.greater(pc.list_value_length(batch.column(1)), 0), False))
        size = np.asarray(pc.list_value_length(batch.column(1))).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < len(size):  # about a million shingles at a time
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
            h = np.asarray(batch.column(1).slice(at, to - at).flatten()).astype(np.int64)
            yield batch.column(0).slice(at, to - at), least(h, np.concatenate([[0], np.cumsum(size[at : to - 1])]), num_perm)
            at = to


def least(h: np.ndarray, begin: np.ndarray, num_perm: int) -> np.ndarray:
    """Each slot's least value over the hashes from each begin to the next."""
    prime, out = np.int64(PRIME), np.empty((len(begin), num_perm), np.int64)
    for i, (a, b) in enumerate(coefficients(i) for i in range(num_perm)):
        v = a * h + b
        for _ in range(2):  # the remainder of a prime one below a power of two
            v = (v & prime) + (v >> 31)
        v[v == prime] = 0
        out[:, i] = np.minimum.reduceat(v, begin)
    return out


def stemmed_minima(batches: Iterator[pa.RecordBatch], num_perm: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Keys of rows with terms, and a signature of each over its terms' stems: stems, shingles and hashes are made in one
    Python worker, each distinct one of a stretch once."""
    part = lambda s: int.from_bytes(hashlib.md5(s.encode()).digest()[:4], "big") % PRIME
    for keys, row, flat in lexical.stretches(batches, 1 << 19):
        if not len(row):
            continue
        coded, place = flat.dictionary_encode(), {}
        code = np.array([place.setdefault(known(t), len(place)) for t in coded.dictionary.to_pylist()], np.int64)
        ids, stems, n = code[np.asarray(coded.indices)], list(place), len(place)
        both = np.flatnonzero(row[1:] == row[:-1])
        pairs, at = np.unique(ids[both] * n + ids[both + 1], return_inverse=True)
        one = np.array([part(s) for s in stems], np.int64)[ids]
        two = np.array([part(f"{stems[c // n]} {stems[c % n]}") for c in pairs.tolist()], np.int64)[at]
        of = np.concatenate([row, row[both]])
        order = np.argsort(of, kind="stable")
        of = of[order]
        begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        yield keys.take(pa.array(of[begin])), least(np.concatenate([one, two])[order], begin, num_perm)


def matches(tokens: DataFrame, num_perm: int, asked: list[tuple], kind: str, k: int | None = None) -> DataFrame:
    """(query_id, chunk_id, bands) as candidates at one row a band, from terms that are not stemmed yet, and queries'
    signatures `asked` (query_id, slot, value) whose query_id is of type `kind`. One pass: no signature is written or
    joined. k: only rows that can be among a query's k first by bands and chunk_id."""
    rows = tokens.select("chunk_id", "terms")
    ids = list(dict.fromkeys(q for q, _, _ in asked))
    place = {q: i for i, q in enumerate(ids)}
    slots = {}
    for q, slot, value in asked:
        slots.setdefault(slot, []).append((value, place[q]))
    sent = rows.sparkSession.sparkContext.broadcast({i: tuple(np.array(x, np.int64) for x in zip(*sorted(v))) for i, v in slots.items() if i < num_perm})
    id_type, n, of = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64(), max(1, len(ids)), rows.schema["chunk_id"].dataType.simpleString()

    def first(q: np.ndarray, count: np.ndarray, chunk: np.ndarray | None) -> np.ndarray:
        """Places of each query's k first; of all as good as the k-th, where chunks have no number."""
        order = np.lexsort((-count, q) if chunk is None else (chunk, -count, q))
        q, count = q[order], count[order]
        begin = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        size = np.diff(np.append(begin, len(q)))
        if chunk is not None:
            return order[np.arange(len(q)) - np.repeat(begin, size) < k]
        return order[count >= np.repeat(np.where(size > k, count[begin + np.minimum(size, k) - 1], 0), size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(ids, id_type)
        for keys, out in stemmed_minima(batches, num_perm):
            codes = []
            for i, (values, queries) in sent.value.items():
                begin, end = np.searchsorted(values, out[:, i], "left"), np.searchsorted(values, out[:, i], "right")
                row = np.repeat(np.arange(len(out)), end - begin)
                within = np.arange(len(row)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin)
                codes.append(row * n + queries[begin[row] + within])
            code, count = lexical.runs(np.concatenate([np.zeros(0, np.int64), *codes]))
            if k is not None and len(code):
                mine = first(code % n, count, np.asarray(keys).astype(np.int64)[code // n] if of in ("int", "bigint") else None)
                code, count = code[mine], count[mine]
            if len(code):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(code % n)), keys.take(pa.array(code // n)), pa.array(count)], names=["query_id", "chunk_id", "bands"])

    return rows.mapInArrow(run, f"query_id {kind}, chunk_id {of}, bands long")


def bands(signatures: DataFrame, rows: int, key: str = "chunk_id") -> DataFrame:
    """(key, band, bucket): the values of each band's slots, hashed together where there are several."""
    if rows == 1:
        return signatures.select(key, F.col("slot").alias("band"), F.col("value").cast("string").alias("bucket"))
    grouped = signatures.groupBy(key, F.expr(f"slot div {rows}").cast("int").alias("band")).agg(F.array_sort(F.collect_list(F.struct("slot", "value"))).alias("v"))
    return grouped.select(key, "band", F.array_join(F.transform("v", lambda x: x["value"].cast("string")), "-").alias("bucket"))


def candidates(query_bands: DataFrame, chunk_bands: DataFrame) -> DataFrame:
    """(query_id, chunk_id, bands): chunks that share a bucket, and how many."""
    return query_bands.join(chunk_bands, ["band", "bucket"]).groupBy("query_id", "chunk_id").agg(F.count("*").alias("bands"))


def signature_jaccard(pairs: DataFrame, query_sig: DataFrame, chunk_sig: DataFrame, num_perm: int) -> DataFrame:
    """pairs (query_id, chunk_id) with sig_jaccard: the share of equal slots."""
    equal = query_sig.join(chunk_sig, ["slot", "value"]).groupBy("query_id", "chunk_id").agg(F.count("*").alias("equal"))
    return pairs.join(equal, ["query_id", "chunk_id"], "left").withColumn("sig_jaccard", F.coalesce(F.col("equal"), F.lit(0)) / F.lit(float(num_perm))).drop("equal")


def exact_jaccard(pairs: DataFrame, query_shingles: DataFrame, chunk_shingles: DataFrame) -> DataFrame:
    """pairs (query_id, chunk_id) with jaccard over distinct shingles; 0 if either has none. Sizes by counts, no sets."""
    q_size = query_shingles.groupBy("query_id").agg(F.count("*").alias("qn"))
    wanted = chunk_shingles.join(pairs.select("chunk_id").distinct(), "chunk_id", "left_semi")
    c_size = wanted.groupBy("chunk_id").agg(F.count("*").alias("cn"))
    asked = pairs.select("query_id", "chunk_id").distinct().join(query_shingles, "query_id")
    both = asked.join(wanted, ["chunk_id", "shingle"]).groupBy("query_id", "chunk_id").agg(F.count("*").alias("both"))
    found = pairs.join(both, ["query_id", "chunk_id"], "left").join(q_size, "query_id", "left").join(c_size, "chunk_id", "left")
    n = F.coalesce("both", F.lit(0))
    union = F.coalesce("qn", F.lit(0)) + F.coalesce("cn", F.lit(0)) - n
    return found.withColumn("jaccard", F.when(union > 0, n / union).otherwise(F.lit(0.0))).drop("both", "qn", "cn")
