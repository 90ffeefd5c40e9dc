"""SimHash fingerprints (two 32-bit halves as longs), Hamming distances, and a lossless blocked near-duplicate join.

Weights are integers (tf times idf in millionths), so sums don't depend on their order and bits are reproducible.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators import lexical
from granary.operators.minhash import md5_part
from granary.session import against

#: Seven blocks of the 64 bits (first bit, width).
BLOCKS = tuple((9 * i, 9 if i < 6 else 10) for i in range(7))
#: Terms of two or more chunks whose weights are sent to every task, 12 bytes each; more are joined.
MOST_TERMS = 8_000_000


def fingerprints(tf: DataFrame, idf: DataFrame, keys: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, fp_hi, fp_lo) for each row of keys; without weighted terms both are 0. One aggregation with 64 sums."""
    weighted = tf.join(idf.select("term", F.round(F.col("idf") * 1e6).cast("long").alias("u")), "term").select(key, (F.col("tf") * F.col("u")).alias("w"), md5_part(F.col("term"), 0).alias("hi"), md5_part(F.col("term"), 1).alias("lo"))
    bit = lambda half, i: F.sum(F.when(F.col(half).bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.col("w")).otherwise(-F.col("w")))
    sums = weighted.groupBy(key).agg(*[bit(half, i).alias(f"{half}{i}") for half in ("hi", "lo") for i in range(32)])
    joined = lambda half: sum((F.when(F.col(f"{half}{i}") > 0, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(32)), F.lit(0).cast("long"))
    found = sums.select(key, joined("hi").alias("fp_hi"), joined("lo").alias("fp_lo"))
    zero = F.lit(0).cast("long")
    return keys.select(key).join(found, key, "left").select(key, F.coalesce("fp_hi", zero).alias("fp_hi"), F.coalesce("fp_lo", zero).alias("fp_lo"))


@dataclass(frozen=True)
class Units:
    """Weights of terms in millionths: sorted hashes of those in two or more chunks, the place of each one's weight, the
    weights, and that of any other term of the corpus."""

    keys: np.ndarray
    places: np.ndarray
    units: np.ndarray
    rest: int


def units(idf: DataFrame) -> Units | None:
    """From (term, df, idf), where a term's weight depends on df alone; None where terms are too many, or two share a hash."""
    known = idf.select(F.shiftleft(md5_part(F.col("term"), 0), 32).bitwiseOR(md5_part(F.col("term"), 1)).alias("k"), "df", F.round(F.col("idf") * 1e6).cast("long").alias("u"))
    n, distinct, several = known.agg(F.count("*"), F.count_distinct("k"), F.coalesce(F.sum((F.col("df") > 1).cast("long")), F.lit(0))).first()
    if n != distinct or several > MOST_TERMS:
        return None
    of = {r["df"]: r["u"] for r in known.select("df", "u").distinct().collect()}
    dfs = sorted(of)
    rows = known.where("df > 1").select("k", F.col("df").cast("int").alias("df")).toArrow()
    keys, df = (rows.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(keys)
    return Units(keys[order], np.searchsorted(dfs, df[order]).astype(np.int32), np.array([of[x] for x in dfs], np.int64), of.get(1, 0))


def fingerprints_in_rows(tokens: DataFrame, known: Units) -> DataFrame:
    """As fingerprints, of the corpus that the weights are of, in one pass: no term of a chunk is shuffled or written."""
    sent = tokens.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for keys, row, flat in lexical.stretches(batches, 1 << 19):
            out = np.zeros(len(keys), np.uint64)
            if len(row):
                coded = flat.dictionary_encode()
                code, term = np.asarray(coded.indices), np.frombuffer(b"".join(hashlib.md5(t.encode()).digest()[:8] for t in coded.dictionary.to_pylist()), ">u8").astype(np.uint64)
                at = np.minimum(np.searchsorted(known.keys, term.view(np.int64)), max(0, len(known.keys) - 1))
                unit = np.where(known.keys[at] == term.view(np.int64), known.units[known.places[at]], known.rest) if len(known.keys) else np.full(len(term), known.rest)
                begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                for i in range(64):
                    sums = np.add.reduceat(np.where(term >> np.uint64(i) & np.uint64(1), unit, -unit)[code], begin)
                    out[row[begin]] |= (sums > 0).astype(np.uint64) << np.uint64(i)
            halves = [pa.array(x.astype(np.int64)) for x in (out >> np.uint64(32), out & np.uint64(0xFFFFFFFF))]
            yield pa.RecordBatch.from_arrays([keys, *halves], names=["chunk_id", "fp_hi", "fp_lo"])

    return tokens.select("chunk_id", "terms").mapInArrow(run, f"chunk_id {tokens.schema['chunk_id'].dataType.simpleString()}, fp_hi long, fp_lo long")


def hamming(hi: Column, lo: Column, hi_2: Column, lo_2: Column) -> Column:
    return F.bit_count(hi.bitwiseXOR(hi_2)) + F.bit_count(lo.bitwiseXOR(lo_2))


def query_distances(query_fp: DataFrame, chunk_fp: DataFrame) -> DataFrame:
    """(query_id, chunk_id, hamming) of every query against every chunk: a stated query set, scanned chunk by chunk."""
    q = query_fp.select("query_id", F.col("fp_hi").alias("q_hi"), F.col("fp_lo").alias("q_lo"))
    return against(chunk_fp, q).select("query_id", "chunk_id", hamming(F.col("q_hi"), F.col("q_lo"), F.col("fp_hi"), F.col("fp_lo")).alias("hamming"))


def nearest(chunk_fp: DataFrame, asked: list[tuple], kind: str, k: int) -> DataFrame:
    """Rows of query_distances that can be among a query's k first by hamming and chunk_id, from queries' fingerprints `asked`
    (query_id, fp_hi, fp_lo) whose query_id is of type `kind`. One pass: a stretch of chunks sends k rows for each query at
    most, so no row for each pair is sorted or spilled."""
    rows = chunk_fp.select("chunk_id", "fp_hi", "fp_lo")
    sent = rows.sparkSession.sparkContext.broadcast(asked)
    id_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    whole = lambda hi, lo: np.asarray(hi).astype(np.uint64) << np.uint64(32) | np.asarray(lo).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = pa.array([x[0] for x in sent.value], id_type), whole([x[1] for x in sent.value], [x[2] for x in sent.value])
        for batch in batches:
            for at in range(0, len(batch) if len(q) else 0, 1 << 13):
                part = batch.slice(at, 1 << 13)
                part = part.take(pc.sort_indices(part.column(0), null_placement="at_start"))
                fp, n = whole(part.column(1), part.column(2)), len(part)
                for i in range(0, len(q), 1 << 8):
                    order = np.bitwise_count(q[i : i + (1 << 8), None] ^ fp).astype(np.int32) * n + np.arange(n, dtype=np.int32)
                    first = np.partition(order, k - 1, axis=1)[:, :k] if n > k else order
                    mine = pa.array(np.repeat(np.arange(i, i + len(first)), first.shape[1]))
                    yield pa.RecordBatch.from_arrays([names.take(mine), part.column(0).take(pa.array((first % n).ravel())), pa.array((first // n).ravel())], names=["query_id", "chunk_id", "hamming"])

    return rows.mapInArrow(run, f"query_id {kind}, chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, hamming int")


def block(i: int) -> Column:
    """The bits of a block as a long; blocks may lie across both halves."""
    first, width = BLOCKS[i]
    low = F.shiftrightunsigned("fp_lo", first) if first < 32 else F.lit(0).cast("long")
    high = F.shiftright("fp_hi", first - 32) if first >= 32 else F.shiftleft("fp_hi", 32 - first)
    return low.bitwiseOR(high).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def classes(fp: DataFrame) -> DataFrame:
    """(cls, n, fp_hi, fp_lo): chunks with one fingerprint are a class, named by its smallest chunk_id."""
    return fp.groupBy("fp_hi", "fp_lo").agg(F.min("chunk_id").alias("cls"), F.count("*").alias("n"))


def near_classes(kinds: DataFrame, most: int = 4) -> DataFrame:
    """(a, b, a_n, b_n, hamming) of classes a and b (in either order, each pair once) at most `most` (up to 4) bits apart.

    Classes that differ in at most four bits agree on three of seven blocks: they meet under one of 35 keys of 27 bits or
    more, and each pair under its first common key only, so nothing is made twice. Joins are merged: a broadcast of
    fingerprints would grow with the corpus on the driver.
    """
    if most > 4:
        raise ValueError("three of seven blocks are lossless for at most four bits")
    triples = list(itertools.combinations(range(len(BLOCKS)), 3))
    keys = F.array(*[sum((F.shiftleft(block(i), 10 * k) for k, i in enumerate(t)), F.lit(j << 40).cast("long")) for j, t in enumerate(triples)])
    keyed = kinds.select(F.struct("cls", "n", "fp_hi", "fp_lo").alias("x"), F.explode(keys).alias("k"))
    met = keyed.hint("merge").join(keyed.withColumnRenamed("x", "y"), "k")
    met = met.where("x.fp_hi < y.fp_hi or (x.fp_hi = y.fp_hi and x.fp_lo < y.fp_lo)")
    met = met.withColumn("hamming", hamming(F.col("x.fp_hi"), F.col("x.fp_lo"), F.col("y.fp_hi"), F.col("y.fp_lo"))).where(F.col("hamming") <= most)
    equal = F.array(*[F.when(block(i) == 0, 1).otherwise(0) for i in range(len(BLOCKS))])
    met = met.withColumns({"fp_hi": F.col("x.fp_hi").bitwiseXOR(F.col("y.fp_hi")), "fp_lo": F.col("x.fp_lo").bitwiseXOR(F.col("y.fp_lo"))}).withColumn("equal", equal)
    # the first common key is that of the first three equal blocks
    rank = {t: j for j, t in enumerate(triples)}
    three = F.slice(F.filter(F.transform("equal", lambda e, i: F.when(e == 1, i)), lambda i: i.isNotNull()), 1, 3)
    number = F.create_map(*[F.lit(x) for t, j in rank.items() for x in ("-".join(map(str, t)), j)])
    first = F.element_at(number, F.array_join(F.transform(three, lambda i: i.cast("string")), "-"))
    met = met.where(F.shiftright("k", 40) == first)
    return met.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), F.col("x.n").alias("a_n"), F.col("y.n").alias("b_n"), "hamming")


def near_duplicates(fp: DataFrame, most: int = 4) -> DataFrame:
    """(a, b, hamming) with a < b and at most `most` (up to 4) bits apart: near classes, and classes of several, with
    their members."""
    kinds = classes(fp)
    several = kinds.where("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(0).alias("hamming"))
    member = fp.hint("merge").join(kinds, ["fp_hi", "fp_lo"]).select("chunk_id", "cls")
    one, two = (member.select(F.col("chunk_id").alias(name), F.col("cls").alias(cls)) for name, cls in (("one", "a"), ("two", "b")))
    found = near_classes(kinds, most).select("a", "b", "hamming").union(several).hint("merge").join(one, "a").hint("merge").join(two, "b").where("hamming > 0 or one < two")
    return found.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"), "hamming")
