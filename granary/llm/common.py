"""What the corpus operators share: the shared folder, word and shingle hashes, packed key exchange, components.

Hashes are 64 bit and seeded by constants, so every executor and every rerun of a lost task derives the same keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import shared_folder, ship

U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
MULTIPLIERS = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | U(1)
_powers: dict[int, np.ndarray] = {}


# ---------------------------------------------------------------- session and shared folder


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches: a batch of long texts must fit beside a JVM heap. Values that the user set stay."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where that is unset and all runs in one process."""
    return shared_folder(spark)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/granary-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---------------------------------------------------------------- hashes


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds), on a copy."""
    x = x ^ (x >> U(31))
    x *= U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(1, U)
        with np.errstate(over="ignore"):
            while len(have) < size:
                have = np.concatenate([have, have * U(pow(base, len(have), 2**64))])
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


class Words:
    """Words (runs without 0x20 and 0x09-0x0D) of a batch of texts; null texts have none.

    hashes: 64 bit a word; first: index of each text's first word, and the total; starts, ends: byte positions in data.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, chunk: int = 1 << 21):
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if len(texts) else None
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        self.data, self.offsets = data, offsets
        starts, ends, hashes = [], [], []
        at = 0
        while at < len(texts):  # a chunk of whole texts at a time, small enough for the caches
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk, "right")) - 1)
            lo, hi = int(offsets[at]), int(offsets[to])
            s, e, h = self._spans(LOWER[data[lo:hi]] if lower else data[lo:hi], offsets[at:to] - lo)
            starts.append(s + lo)
            ends.append(e + lo)
            hashes.append(h)
            at = to
        join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        self.starts, self.ends, self.hashes = join(starts, np.int64), join(ends, np.int64), join(hashes, U)
        self.first = np.searchsorted(self.starts, offsets)

    @staticmethod
    def _spans(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
        word = ~SEPARATOR[data]
        begins, stops = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        stops[:-1] &= ~word[1:]
        cut = breaks[(breaks > 0) & (breaks < n)]
        begins[cut] |= word[cut]
        stops[cut - 1] |= word[cut - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        total = np.zeros(n + 1, U)
        np.cumsum(BYTE[data] * powers(n, BASE), out=total[1:])
        hashes = (total[ends] - total[starts]) * powers(n, BASE_INVERSE)[starts]
        return starts, ends, mix(hashes + (ends - starts).astype(U))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rolling(self, k: int, seed: int = 0) -> np.ndarray:
        """The hash of the k words from each word on; runs over the ends of texts are left to the caller to mask."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, U)
        out = self.hashes[:n] * MULTIPLIERS[seed]
        for j in range(1, k):
            out += self.hashes[j : n + j] * MULTIPLIERS[seed + j]
        return mix(out)

    def inside(self, k: int) -> np.ndarray:
        """Whether the k words from each word on stand in one text; as long as rolling(k)."""
        n = max(0, len(self.hashes) - k + 1)
        left = np.repeat(self.first[1:], self.counts())[:n] - np.arange(n)
        return left >= k


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text, end to end, and the offsets. Shorter texts: all words as one."""
    rolled, ok = words.rolling(k), words.inside(k)
    parts, sizes = [], np.zeros(len(words.first) - 1, np.int64)
    for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            s = mix(np.sum(words.hashes[a:b] * MULTIPLIERS[32 : 32 + b - a], keepdims=True, dtype=U) + U(b - a))
        else:
            continue
        parts.append(s)
        sizes[i] = len(s)
    del ok
    return np.concatenate(parts) if parts else np.zeros(0, U), np.concatenate([[0], np.cumsum(sizes)])


def summed(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of the stretches between the offsets."""
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


# ---------------------------------------------------------------- packed exchange


def by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, indices) for the parts that occur: keys are dealt by their high bits."""
    if not len(keys):
        return
    part = ((keys >> U(32)) * U(parts)) >> U(32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
        yield int(part[a]), order[a:b]


def parts_for(total: int, each: int, least: int = 128) -> int:
    """How many parts hold total keys with about so many in each; grows with the data."""
    return max(least, -(-int(total or 0) // each))


# ---------------------------------------------------------------- connected components


def afresh(df: DataFrame, column: str) -> DataFrame:
    """df with column (a long) computed anew, so that a join on it shuffles df again and AQE can split a hot key of the other side."""
    return df.withColumn(column, F.col(column).bitwiseXOR(F.lit(0).cast("long")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node reachable over edges (a, b), whatever their direction; nulls and loops go.

    Alternates the large-star and small-star steps: each node links its larger, then its smaller neighbours, to the
    smallest one. Every step is a map-side combined min and one join, so a hub costs no task its whole neighbourhood.
    Each round is written to the shared folder, so the lineage stays short and lost executors cost one round.
    """
    at = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = at.union(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = afresh(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "a")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(afresh(small_least, "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").union(small_least.select("a", F.col("m").alias("b"))).distinct()
        at = settle(small, "edges")
        now = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    roots = at.select(F.col("b").alias("node")).distinct().join(at.select(F.col("a").alias("node")).distinct(), "node", "left_anti")
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
