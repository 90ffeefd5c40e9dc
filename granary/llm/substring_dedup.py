"""Substring dedup by fixed-block anchors: passages that a document with a smaller doc_id has as well are removed.

Every document is a reference, cut into non-overlapping blocks of (window + 1) // 2 words; any window of `window` words
holds a whole block. All rolling block-sized windows probe the blocks. Where a probe hits, the windows around it are
extended: their full word sequences, under two independent hashes of 64 and 32 bits, are looked up, and what neighbouring
repeated windows cover together is a maximal repeat.

Texts are dealt to buckets of bounded size by a hash of the row. Buckets send their distinct keys, packed, to the parts
of the key space, so a passage in a third of all documents costs a part one entry a bucket, never one an occurrence, and
no pairs of documents are made. The number of buckets and parts follows the size of the input.

Defined cases: words are runs without 0x20 and 0x09-0x0D; null and empty texts have none, so they keep an empty text;
texts shorter than a window stay as they are (words joined by one space); rows with equal doc_id are no smaller than each
other, so both keep a passage; rows with a null doc_id keep all and remove nothing from others; further columns pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.llm.common import U, Words, by_part, parts_for, prepare

ADDED = "n_words long, n_removed long, kept string, spans array<struct<start: int, end: int>>"
LOW, FLAGS = U(38), 2


@dataclass(frozen=True)
class SubstringParams:
    """bucket_bytes of text are worked on together, part_keys of packed keys compared together."""

    window: int = 13
    bucket_bytes: int = 6 << 20
    part_keys: int = 1_000_000


def packed(keys: np.ndarray, flags: np.ndarray) -> bytes:
    """The low 38 bits of the keys and two flags, five bytes each."""
    v = ((keys & U((1 << 38) - 1)) << U(FLAGS)) | flags.astype(U)
    return (v & U(0xFFFFFFFF)).astype(np.uint32).tobytes() + (v >> U(32)).astype(np.uint8).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // 5
    return np.frombuffer(blob, np.uint32, n).astype(U) | (np.frombuffer(blob, np.uint8, n, 4 * n).astype(U) << U(32))


def stowed(one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> bytes:
    """Windows (64 and 32 bits of hash) with doc_ids, as offsets of four bytes where their range allows."""
    base, wide = int(ids.min()), int(ids.max()) - int(ids.min()) >= 1 << 32
    rest = (ids.view(U) - U(base & (1 << 64) - 1)).astype(U if wide else np.uint32)
    return np.array([len(ids), base], np.int64).tobytes() + one.tobytes() + two.astype(np.uint32).tobytes() + rest.tobytes()


def unstowed(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, doc_ids and index of the blob, of all blobs end to end."""
    one, two, ids, sizes = [], [], [], []
    for b in blobs:
        n, base = np.frombuffer(b, np.int64, 2).tolist()
        one.append(np.frombuffer(b, U, n, 16))
        two.append(np.frombuffer(b, np.uint32, n, 16 + 8 * n))
        rest = np.frombuffer(b, np.uint32 if len(b) == 16 + 16 * n else U, n, 16 + 12 * n).astype(U)
        ids.append((rest + U(base & (1 << 64) - 1)).view(np.int64))
        sizes.append(n)
    return np.concatenate(one), np.concatenate(two), np.concatenate(ids), np.repeat(np.arange(len(blobs)), sizes)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def filled(runs_at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.concatenate([runs_at, [n]])))


def rows_of(table: pa.Table) -> pa.StructArray:
    column = table.column("row").combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index in the sorted table of each value, or -1."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def as_table(schema: pa.Schema, *columns: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Batch:
    """A bucket's rows with their words."""

    def __init__(self, table: pa.Table, window: int):
        self.rows = rows_of(table)
        self.texts = self.rows.field("text").cast(pa.large_binary())
        if self.rows.null_count:  # never so: struct(*) is not null
            raise ValueError("null row")
        ids = self.rows.field("doc_id")
        self.known = ~np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        self.words, self.window = Words(self.texts), window
        self.owner = np.repeat(np.arange(len(self.ids)), self.words.counts())

    def probes(self, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each block-sized rolling window that stands in one text, its first word, whether it is a block."""
        at = np.flatnonzero(self.words.inside(block))
        within = at - self.words.first[self.owner[at]]
        return self.words.rolling(block, 40)[at], at, within % block == 0

    def full(self, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes of the windows (of those that begin at the words marked), and their first words."""
        ok = self.words.inside(self.window)
        ok &= self.known[self.owner[: len(ok)]]
        at = np.flatnonzero(ok if only is None else ok & only[: len(ok)])
        return self.words.rolling(self.window, 0)[at], self.words.rolling(self.window, self.window)[at].astype(np.uint32), at


def dedup(documents: DataFrame, params: SubstringParams = SubstringParams()) -> DataFrame:
    """documents with n_words, n_removed, kept (the words kept, joined by one space) and spans (of words removed)."""
    spark = documents.sparkSession
    prepare(spark)
    window, block = params.window, (params.window + 1) // 2
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, parts = parts_for(size, params.bucket_bytes), parts_for(size // 6, params.part_keys)
    names = [c for c in documents.columns if c not in ("n_words", "n_removed", "kept", "spans")]
    docs = documents.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).alias("bucket"), F.struct(*names).alias("row"))
    sent = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("blob", pa.binary())])

    def probe(key: tuple, table: pa.Table) -> pa.Table:
        """A bucket's distinct probes for each part; flags: 1 it is a block of some text here, 2 in several texts here."""
        batch = Batch(table, window)
        keys, at, is_block = batch.probes(block)
        order = np.argsort(keys, kind="stable")
        sorted_keys, begin = keys[order], runs(keys[order])
        end = np.concatenate([begin[1:], [len(order)]]) - 1 if len(begin) else begin
        owner = batch.owner[at[order]]
        flags = np.bitwise_or.reduceat(is_block[order].astype(np.uint8), begin) if len(begin) else np.zeros(0, np.uint8)
        flags = flags | ((owner[begin] != owner[end]).astype(np.uint8) << 1)
        distinct = sorted_keys[begin]
        found = [(p, packed(distinct[i], flags[i])) for p, i in by_part(distinct, parts)]
        return as_table(sent, [p for p, _ in found], [key[0].as_py()] * len(found), [b for _, b in found])

    def match(key: tuple, table: pa.Table) -> pa.Table:
        """To each bucket, those of its probes that are some text's block and occur in several texts."""
        who, blobs = table.column("bucket").to_pylist(), [unpacked(b.as_py()) for b in table.column("blob")]
        values, source = np.concatenate(blobs), np.repeat(np.arange(len(blobs)), [len(b) for b in blobs])
        order = np.argsort(values >> U(FLAGS), kind="stable")
        values, source = values[order], source[order]
        keys = values >> U(FLAGS)
        begin = runs(keys)
        flags = np.bitwise_or.reduceat(values & U(3), begin)
        hit = filled(begin, (flags & U(1) == 1) & ((flags & U(2) != 0) | (np.diff(np.concatenate([begin, [len(keys)]])) > 1)), len(keys))
        keys, source = keys[hit], source[hit]
        order = np.argsort(source, kind="stable")
        keys, source = keys[order], source[order]
        begin = runs(source)
        cut = np.split(keys, begin[1:]) if len(begin) else []
        return as_table(sent, [key[0].as_py()] * len(cut), [who[source[b]] for b in begin], [k.tobytes() for k in cut])

    def extend(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The full windows around a bucket's hits, distinct, with the smallest doc_id here, for each part."""
        if not left.num_rows or not right.num_rows:
            return sent.empty_table()
        batch = Batch(left, window)
        keys, at, _ = batch.probes(block)
        hits = np.sort(np.concatenate([np.frombuffer(b.as_py(), U) | (U(p.as_py()) << LOW) for p, b in zip(right.column("part"), right.column("blob"), strict=True)]))
        part = ((keys >> U(32)) * U(parts)) >> U(32)
        hit = np.zeros(len(batch.words.hashes) + window, np.int64)
        hit[at[in_sorted((keys & U((1 << 38) - 1)) | (part << LOW), hits) >= 0]] = 1
        total = np.concatenate([[0], np.cumsum(hit)])
        near = total[window - block + 1 :] - total[: -(window - block + 1)] > 0
        one, two, at = batch.full(near)
        ids = batch.ids[batch.owner[at]]
        order = np.lexsort((ids, two, one))
        one, two, ids = one[order], two[order], ids[order]
        first = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else np.zeros(0, bool)
        one, two, ids = one[first], two[first], ids[first]
        found = [(p, stowed(one[i], two[i], ids[i])) for p, i in by_part(one, parts)]
        return as_table(sent, [p for p, _ in found], [key[0].as_py()] * len(found), [b for _, b in found])

    def least(key: tuple, table: pa.Table) -> pa.Table:
        """To each bucket, the windows that a smaller doc_id elsewhere has, with the smallest one."""
        who = table.column("bucket").to_pylist()
        one, two, ids, source = unstowed([b.as_py() for b in table.column("blob")])
        order = np.lexsort((ids, two, one))
        one, two, ids, source = one[order], two[order], ids[order], source[order]
        begin = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
        smallest = filled(begin, ids[begin], len(ids))
        tell = np.flatnonzero(smallest < ids)
        tell = tell[np.argsort(source[tell], kind="stable")]
        begin = runs(source[tell])
        cut = np.split(tell, begin[1:]) if len(begin) else []
        return as_table(sent, [key[0].as_py()] * len(cut), [who[source[c[0]]] for c in cut], [stowed(one[c], two[c], smallest[c]) for c in cut])

    result = StructType([*documents.select(*names).schema.fields, *StructType.fromDDL(ADDED).fields])

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """A bucket's rows without what smaller doc_ids have, here or, as told, elsewhere."""
        if not left.num_rows:
            return None
        batch = Batch(left, window)
        one, two, at = batch.full()
        ids = batch.ids[batch.owner[at]]
        order = np.lexsort((ids, two, one))
        begin = np.flatnonzero(np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])) if len(one) else np.zeros(0, np.int64)
        smallest = np.empty(len(one), np.int64)
        smallest[order] = filled(begin, ids[order][begin], len(one))
        if right.num_rows:
            k1, k2, low, _ = unstowed([b.as_py() for b in right.column("blob")])
            o = np.lexsort((k2, k1))
            k1, k2, low = k1[o], k2[o], low[o]
            i = np.minimum(np.searchsorted(k1, one), len(k1) - 1)
            # windows of one first and another second hash: a step further for each, until none is left
            while (step := (k1[i] == one) & (k2[i] < two) & (i + 1 < len(k1))).any():
                i = i + step
            same = (k1[i] == one) & (k2[i] == two)
            smallest[same] = np.minimum(smallest[same], low[i[same]])
        gone = at[smallest < ids]
        edge = np.zeros(len(batch.words.hashes) + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.subtract.at(edge, gone + window, 1)
        covered = np.cumsum(edge[:-1]) > 0
        first = batch.words.first
        removed = np.concatenate([[0], np.cumsum(covered)])
        kept, spans = [], []
        for i, text in enumerate(batch.texts):
            a, b = int(first[i]), int(first[i + 1])
            words = (text.as_py() or b"").split()
            mask = covered[a:b]
            if removed[b] > removed[a]:
                words = compress(words, (~mask).tolist())
                turns = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                spans.append([{"start": s, "end": e} for s, e in turns.reshape(-1, 2).tolist()])
            else:
                spans.append([])
            kept.append(b" ".join(words).decode())
        columns = [batch.rows.field(n) for n in names]
        made = [pa.array(np.diff(first), pa.int64()), pa.array(removed[first[1:]] - removed[first[:-1]], pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
        return pa.Table.from_arrays([*columns, *made], names=result.names)

    ddl = "part long, bucket long, blob binary"
    grouped = docs.groupBy("bucket")
    hits = grouped.applyInArrow(probe, ddl).groupBy("part").applyInArrow(match, ddl)
    windows = grouped.cogroup(hits.groupBy("bucket")).applyInArrow(extend, ddl)
    told = windows.groupBy("part").applyInArrow(least, ddl)
    return grouped.cogroup(told.groupBy("bucket")).applyInArrow(cut, result)

