"""Terms that occur together: pairs, triples and partners, counted over whole texts as sorted numbers.

Terms are numbered from the rarest to the most frequent. A task counts for a block of terms, and gets the chunks that have
one of them as compressed numbers: what is shuffled grows with texts and blocks, never with the pairs inside the texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators import graph, lexical

#: Numbers that are looked at together, numbers of texts for which there is a block at least, rows of a batch of results,
#: how many of the most frequent terms have their sums in a table of all their pairs, numbers of a part of a head's table,
#: and how many heads' triples are counted beforehand, so that blocks get equal work.
STRETCH, BLOCK, BATCH, TABLE, TILE, TRIED = 1 << 22, 1 << 24, 1 << 17, 4096, 1 << 22, 256


def sets(tokens: DataFrame) -> DataFrame:
    """(chunk_id, terms) of distinct terms, one row for each chunk_id, written once; from (chunk_id, terms), or from
    transactions (chunk_id, term). Rows without a chunk_id are in no set."""
    if "terms" not in tokens.columns:
        return graph.shared(tokens.where("chunk_id is not null").groupBy("chunk_id").agg(F.collect_set("term").alias("terms")))
    rows = graph.shared(tokens.where("chunk_id is not null").select("chunk_id", F.array_distinct("terms").alias("terms")))  # a filter on terms would be run before they are dealt out, and again
    n, distinct = rows.agg(F.count("*"), F.count_distinct("chunk_id")).first()
    if n == distinct:
        return rows
    return graph.shared(rows.groupBy("chunk_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")))


def squeezed(values: np.ndarray) -> bytes:
    """Numbers compressed: first the lowest bytes of all, then the next; those of small numbers are runs of one value."""
    coder = zlib.compressobj(1, strategy=zlib.Z_RLE)
    return coder.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)) + coder.flush()


def released(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def packed(values: np.ndarray) -> bytes:
    return squeezed(np.diff(values, prepend=values.dtype.type(0)))


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(released(data, kind), dtype=kind)


def joined(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The values from each begin to before its end, one after the other."""
    return np.concatenate([values[i:j] for i, j in zip(begin.tolist(), end.tolist())] or [values[:0]])


@dataclass(frozen=True)
class Numbered:
    """Sets as numbers of their terms, ascending; rows (size, ids) hold many sets each."""

    rows: DataFrame
    sets: int
    terms: list[str]
    support: np.ndarray
    total: int

    @property
    def alphabet(self) -> tuple[list[str], np.ndarray]:
        """The terms in the order of their names, and each number's place in it."""
        order = sorted(range(len(self.terms)), key=self.terms.__getitem__)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return [self.terms[i] for i in order], place


def numbered(sets: DataFrame, support: int) -> Numbered:
    """The sets without terms of fewer than `support` sets."""
    single = sets.select(F.explode("terms").alias("a")).groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    found = single.orderBy("n", "a").toArrow()
    terms, counts = found.column(0).to_pylist(), np.asarray(found.column(1).to_pylist(), np.int64)
    sent = sets.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        for keys, row, flat in lexical.stretches(batches):
            ids = lexical.numbers(flat, known)
            row, ids = row[ids >= 0], ids[ids >= 0]
            ids = ids[np.lexsort((ids, row))].astype(np.int32)
            size = np.bincount(row, minlength=len(keys)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([packed(size)]), pa.array([packed(ids)])], names=["size", "ids"])

    rows = graph.shared(sets.select("chunk_id", "terms").mapInArrow(run, "size binary, ids binary"))
    return Numbered(rows, sets.count(), terms, counts, int(counts.sum()))


def dealt(known: Numbered, block_of: np.ndarray, first: int, whole: bool) -> DataFrame:
    """(block, size, ids): to each block the sets with one of its terms, whole or from the first such term on. Only terms
    from number `first` on are looked at; block_of has their blocks, or -1."""
    sent = known.rows.sparkSession.sparkContext.broadcast(block_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block_of = sent.value
        for batch in batches:
            for size, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size, ids = unpacked(size, np.int32), unpacked(ids, np.int32)
                row = np.repeat(np.arange(len(size)), size)
                row, ids = row[ids >= first], ids[ids >= first] - np.int32(first)
                ptr = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(size)))])
                of = block_of[ids]
                order = np.argsort(of, kind="stable")
                ends = np.searchsorted(of[order], np.arange(block_of.max(initial=-1) + 2))
                for k in range(len(ends) - 1):
                    at = order[ends[k] : ends[k + 1]]
                    if not len(at):
                        continue
                    at = at[np.concatenate([[True], row[at][1:] != row[at][:-1]])]
                    begin, end = ptr[row[at]] if whole else at, ptr[row[at] + 1]
                    data = [[k], [packed((end - begin).astype(np.int32))], [packed(joined(ids, begin, end))], [None]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "size", "ids", "sums"])

    return known.rows.mapInArrow(run, BLOCKED)


BLOCKED = "block int, size binary, ids binary, sums binary"


def in_blocks(rows: DataFrame, blocks: int, work: Callable[[int, list[tuple[bytes, bytes, bytes | None]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work on each block's rows, a task for a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for k, *data in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(k, []).append(tuple(data))
        for k in sorted(held):
            yield from work(k, held.pop(k))

    return rows.repartitionById(blocks, "block").mapInArrow(run, schema)


class Sets:
    """A block's sets, and for each of its terms the places where it stands."""

    def __init__(self, data: list[tuple[bytes, bytes, bytes | None]], block_of: np.ndarray, k: int):
        docs = [x for x in data if x[2] is None]
        self.ids = np.concatenate([np.zeros(0, np.int32)] + [unpacked(x[1], np.int32) for x in docs])
        size = np.concatenate([np.zeros(0, np.int32)] + [unpacked(x[0], np.int32) for x in docs])
        self.ptr = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        at = np.flatnonzero(block_of[self.ids] == k)
        self.at = at[np.argsort(self.ids[at], kind="stable")]
        self.row = np.searchsorted(self.ptr, self.at, "right") - 1
        self.heads, self.first = np.unique(self.ids[self.at], return_index=True)
        self.end = np.append(self.first[1:], len(self.at))

    def parts(self, i: int, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
        """Of about STRETCH terms at a time that stand with head i, or after it: the terms, how many there are of each
        set, and the first set's place among the head's."""
        at, row = (x[self.first[i] : self.end[i]] for x in (self.at, self.row))
        begin, end = self.ptr[row] if whole else at + 1, self.ptr[row + 1]
        stop, j = np.cumsum(end - begin), 0
        while j < len(at):
            to = max(j + 1, int(np.searchsorted(stop, (stop[j - 1] if j else 0) + STRETCH, "right")))
            yield joined(self.ids, begin[j:to], end[j:to]), end[j:to] - begin[j:to], j
            j = to

    def counts(self, i: int, n: int, whole: bool, parts: Iterable[tuple] | None = None) -> np.ndarray:
        """How many sets each of the terms shares with head i; those after it, from the next number on."""
        low = 0 if whole else int(self.heads[i]) + 1
        out = np.zeros(n - low, np.int64)
        for ids, _, _ in self.parts(i, whole) if parts is None else parts:
            got = np.bincount(ids - low if low else ids)
            out[: len(got)] += got
        return out


def ranges(work: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each term: runs of terms of about equal work."""
    done = np.cumsum(work)
    return np.minimum(done * blocks / max(1e-9, done[-1]) if len(done) else done, blocks - 1).astype(np.int16)


def block_count(known: Numbered, waves: int) -> int:
    return min(30_000, max(waves * known.rows.sparkSession.sparkContext.defaultParallelism, -(-known.total // BLOCK)))


class Rows:
    """Columns of numbers, given out as batches of about BATCH rows."""

    def __init__(self, make: Callable[..., pa.RecordBatch]):
        self.make, self.held, self.size = make, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(columns[0]), BATCH):
            part = tuple(c[i : i + BATCH] for c in columns)
            self.held.append(part)
            self.size += len(part[0])
            if self.size >= BATCH:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            yield self.make(*map(np.concatenate, zip(*self.held)))
        self.held, self.size = [], 0


def pairs(known: Numbered, support: int) -> DataFrame:
    """(a, b, support), a < b, of terms that share `support` sets or more."""
    n, (names, place) = len(known.terms), known.alphabet
    later = np.cumsum(known.support[::-1])[::-1] - known.support
    blocks = block_count(known, 4)
    block_of = ranges(known.support * (later / max(1, known.sets)) + np.arange(n, 0, -1) / 8, blocks)
    sent = known.rows.sparkSession.sparkContext.broadcast((names, place, block_of))

    def work(k: int, data: list) -> Iterator[pa.RecordBatch]:
        names, place, block_of = sent.value
        text, found = pa.array(names, pa.string()), Sets(data, block_of, k)
        out = Rows(lambda x, y, s: pa.RecordBatch.from_arrays([text.take(pa.array(np.minimum(x, y))), text.take(pa.array(np.maximum(x, y))), pa.array(s)], names=["a", "b", "support"]))
        for i, a in enumerate(found.heads.tolist()):
            count = found.counts(i, n, False)
            good = np.flatnonzero(count >= support)
            if len(good):
                yield from out.add(np.full(len(good), place[a]), place[good + a + 1], count[good])
        yield from out.rest()

    return in_blocks(dealt(known, block_of, 0, False), blocks, work, "a string, b string, support long")


def tripled(found: Sets, i: int, n: int, support: int, place: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(good, j, table) for the terms `good` after head i that share `support` sets with it, in the order of their places,
    if these are given: table[x, y] is the support of the head, good[j + x] and good[j + y], where x < y and it is
    `support` at least, else 0."""
    parts = found.parts(i, False)
    if found.end[i] - found.first[i] <= STRETCH >> 10:  # few sets are put together once
        parts = list(parts)
    count = found.counts(i, n, False, parts)
    good = np.flatnonzero(count >= support)
    if len(good) < 2:
        return
    low, slot, v = int(found.heads[i]) + 1, np.full(len(count), -1, np.int32), len(good)
    if place is not None:
        good = good[np.argsort(place[good + low])]
    slot[good] = np.arange(v)
    rows, slots = [], []
    for ids, size, j in parts if isinstance(parts, list) else found.parts(i, False):
        s = slot[ids - low]
        kept = np.flatnonzero(s >= 0)
        rows.append(np.repeat(np.arange(j, j + len(size), dtype=np.int32), size)[kept])
        slots.append(s[kept])
    row, s = np.concatenate(rows), np.concatenate(slots)
    m, high = int(row[-1]) + 1, max(1, min(TILE, 4 * STRETCH) // v)
    cuts = np.searchsorted(row, np.arange(0, m + high, high))
    for j in range(0, v, high):
        wide = min(v, j + high) - j
        table = np.zeros((wide, v - j), np.float32 if m < 1 << 24 else np.float64)
        for c in range(len(cuts) - 1):
            mine = slice(cuts[c], cuts[c + 1])
            flags = np.zeros((v, min(high, m - c * high)), np.float32)
            flags[s[mine], row[mine] - c * high] = 1
            for x in range(0, wide, 256):
                y = min(wide, x + 256)
                table[x:y, x:] += flags[j + x : j + y] @ flags[j + x :].T
        flags = None  # not held while the table is read
        for x in range(wide):
            table[x, x & -256 : x + 1] = 0
        table[table < support] = 0
        yield good + low, j, table


def hits(table: np.ndarray, p: np.ndarray, j: int, a: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The triples of a table of tripled, whose terms are in the order of their places p, with a head of place a: places,
    ascending, and supports. What stands before, around and after the head is read apart, so nothing is compared."""
    cut, (wide, v) = int(np.searchsorted(p, a)) - j, table.shape
    rows = max(1, min(TILE >> 3, STRETCH) // v)
    middle = min(max(cut, 0), wide)
    for r, end in [(r, min(r + rows, to)) for fro, to in ((0, middle), (middle, wide)) for r in range(fro, to, rows)]:
        for begin, to in ((r, cut), (cut, v)) if r < cut else ((r, v),):
            part = table[r:end, begin:to].ravel()
            at = np.flatnonzero(part)
            if not len(at):
                continue
            many = np.diff(np.searchsorted(at, np.arange(end - r + 1) * (to - begin)))
            x, y = np.repeat(p[j + r : j + end], many), p[j + begin : j + to][at - np.repeat(np.arange(end - r) * (to - begin), many)]
            head = np.full(len(at), a, p.dtype)
            yield *((head, x, y) if r >= cut else (x, head, y) if begin == cut else (x, y, head)), part[at].astype(np.int64)


def guessed(known: Numbered, support: int) -> tuple[int, np.ndarray]:
    """The first term of that support, and the likely work of the triples of each from it on, as if terms were independent."""
    first = int(np.searchsorted(known.support, support))
    df = known.support[first:].astype(float)
    n, sets = len(df), max(1, known.sets)
    near = n - np.maximum(np.searchsorted(df, support * sets / (2.2 * np.maximum(df, 1))), np.arange(n))  # sets with a term are larger than others
    return first, 18 * df * (np.cumsum(df[::-1])[::-1] / sets + 1) + np.square(np.maximum(near, 0.0)) * (1.6 + 0.003 * df)  # in tens of nanoseconds, as measured


def weighed(known: Numbered, support: int, waves: int) -> tuple[int, np.ndarray, int]:
    """The first term of that support, the blocks of those from it on by the work of their triples, how many blocks."""
    (first, work), blocks = guessed(known, support), block_count(known, waves)
    return first, ranges(work, blocks), blocks


def tried(known: Numbered, support: int) -> tuple[int, np.ndarray]:
    """As guessed, but the triples of some terms are counted, those between them are taken to lie between; rows that are
    written count most. Only the blocks depend on it, not what is found."""
    first, guess = guessed(known, support)
    n = len(guess)
    if n <= 1:
        return first, guess
    level = np.cumsum(guess / max(1e-9, guess.sum()) + 1 / n)
    heads = np.unique(np.searchsorted(level, (np.arange(TRIED) + 0.5) * level[-1] / TRIED))
    blocks = min(len(heads), known.rows.sparkSession.sparkContext.defaultParallelism)
    block_of = np.full(n, -1, np.int16)
    block_of[heads] = np.arange(len(heads)) % blocks
    sent = known.rows.sparkSession.sparkContext.broadcast(block_of)

    def work(k: int, data: list) -> Iterator[pa.RecordBatch]:
        found, costs = Sets(data, sent.value, k), []
        for i in range(len(found.heads)):
            mine, m = slice(found.first[i], found.end[i]), found.end[i] - found.first[i]
            cost = 2e4 + 40.0 * (found.ptr[found.row[mine] + 1] - found.at[mine]).sum()
            for _, _, table in tripled(found, i, n, support):
                cost += 800.0 * np.count_nonzero(table) + table.size * (8 + 0.025 * m) + len(table) * 8.0 * m
            costs.append(cost)  # in nanoseconds, as measured; most of the 800 are spent where rows are written
        yield pa.RecordBatch.from_arrays([pa.array(found.heads.astype(np.int64)), pa.array(np.array(costs, float))], names=["head", "cost"])

    got = sorted(in_blocks(dealt(known, block_of, first, False), blocks, work, "head long, cost double").collect())
    return first, np.interp(np.arange(n), [r["head"] for r in got], [r["cost"] for r in got])


def triples(known: Numbered, support: int) -> DataFrame:
    """(a, b, c, support), a < b < c, of terms that share `support` sets or more: counted at the rarest of the three."""
    (first, cost), blocks = tried(known, support), block_count(known, 4)
    block_of = ranges(cost, blocks)
    n, (names, place) = len(block_of), known.alphabet
    sent = known.rows.sparkSession.sparkContext.broadcast((names, place[first:].astype(np.int32), block_of))

    def work(k: int, data: list) -> Iterator[pa.RecordBatch]:
        names, place, block_of = sent.value
        text, found = pa.array(names, pa.string()), Sets(data, block_of, k)
        out = Rows(lambda *columns: pa.RecordBatch.from_arrays([*(text.take(pa.array(x)) for x in columns[:3]), pa.array(columns[3])], names=["a", "b", "c", "support"]))
        for i, a in enumerate(found.heads.tolist()):
            for good, j, table in tripled(found, i, n, support, place):
                for columns in hits(table, place[good], j, int(place[a])):
                    yield from out.add(*columns)
        yield from out.rest()

    return in_blocks(dealt(known, block_of, first, False), blocks, work, "a string, b string, c string, support long")


def triple_sums(known: Numbered, support: int, to: np.ndarray) -> DataFrame:
    """(block, ..., sums) for partners: of each term with a block in `to` and each other, the sum of the supports of
    their triples. A task sends a block its sums once, as sorted codes; with fewer blocks less is sent to and from them."""
    first, block_of, blocks = weighed(known, support, 2)
    n, every = len(block_of), len(known.terms)
    table_from = max(0, n - TABLE)
    sent = known.rows.sparkSession.sparkContext.broadcast((block_of, to))

    def work(k: int, data: list) -> Iterator[pa.RecordBatch]:
        block_of, to = sent.value
        found, held, size = Sets(data, block_of, k), [], 0
        dense = np.zeros((n - table_from, n - table_from), np.int64)

        def put(codes: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            held.append((codes, sums))
            size += len(codes)
            if size >= STRETCH:
                held = [lexical.summed(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size >= STRETCH:
                    yield from send(*held[0])
                    held, size = [], 0

        def send(codes: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
            x, y = codes // n + first, codes % n + first
            for head, other in ((x, y), (y, x)):
                of = to[head]
                for b in np.unique(of[of >= 0]).tolist():
                    mine = np.flatnonzero(of == b)
                    code = head[mine] * every + other[mine]
                    order = np.argsort(code)
                    whole = [[b], [packed(code[order])], [b""], [squeezed(sums[mine[order]])]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(whole, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "size", "ids", "sums"])

        for i, a in enumerate(found.heads.tolist()):
            own = None
            for good, j, table in tripled(found, i, n, support):
                own = np.zeros(len(good), np.int64) if own is None else own
                own[j : j + len(table)] += table.sum(1, dtype=np.float64).astype(np.int64)
                own[j:] += table.sum(0, dtype=np.float64).astype(np.int64)
                old = min(len(table), max(0, int(np.searchsorted(good, table_from)) - j))
                x, y = np.nonzero(table[:old])
                yield from put(good[j + x] * n + good[j + y], table[x, y].astype(np.int64))
                if old < len(table):
                    g = good[j + old :] - table_from
                    dense[np.ix_(g[: len(table) - old], g)] += table[old:, old:].astype(np.int64)
            if own is not None:
                yield from put(a * n + good[own > 0], own[own > 0])
        if held:
            yield from send(*lexical.summed(*map(np.concatenate, zip(*held))))
        step = max(1, STRETCH // max(1, len(dense)))
        for r in range(0, len(dense), step):
            x, y = np.nonzero(dense[r : r + step])
            if len(x):
                yield from send((x + r + table_from) * n + y + table_from, dense[x + r, y])

    return in_blocks(dealt(known, block_of, first, False), blocks, work, BLOCKED)


def partners(known: Numbered, support: int, triple_support: int, documents: int, terms: list[str] | None = None, least_idf: float | None = None, most: int | None = None) -> DataFrame:
    """(term, co_term, support, weight, place, idf) as itemsets.cooccurrence makes them from all pairs and triples, a
    term's partners in one task. terms: only of these. least_idf, most: of each term's partners with that idf the first."""
    n, (names, place) = len(known.terms), known.alphabet
    asked = None if terms is None else set(terms)
    heads = np.array([i for i, t in enumerate(known.terms) if asked is None or t in asked], np.int64)
    blocks = block_count(known, 1)
    block_of = np.full(n, -1, np.int16)
    block_of[heads] = np.arange(len(heads)) % blocks
    idf = np.log((1.0 + documents) / (1 + known.support)) + 1
    sent = known.rows.sparkSession.sparkContext.broadcast((names, place, block_of, idf))

    def work(k: int, data: list) -> Iterator[pa.RecordBatch]:
        names, place, block_of, idf = sent.value
        text, found = pa.array(names, pa.string()), Sets(data, block_of, k)
        code, more = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for c, _, s in (x for x in data if x[2] is not None):
            code, more = lexical.summed(np.concatenate([code, unpacked(c, np.int64)]), np.concatenate([more, released(s, np.int64)]))
        data.clear()

        def make(a: np.ndarray, b: np.ndarray, s: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
            columns = [text.take(pa.array(place[a])), text.take(pa.array(place[b])), pa.array(s), pa.array(s * idf[b]), pa.array(p.astype(np.int32)), pa.array(idf[b])]
            return pa.RecordBatch.from_arrays(columns, names=["term", "co_term", "support", "weight", "place", "idf"])

        out = Rows(make)
        for i, a in enumerate(found.heads.tolist()):
            count = found.counts(i, n, True)
            count[a] = 0
            count[count < support] = 0
            cut = slice(*np.searchsorted(code, [a * n, (a + 1) * n]))
            count[code[cut] - a * n] += more[cut]
            b = np.flatnonzero(count)
            b = b[np.lexsort((place[b], -np.round(count[b] * idf[b], 9)))]
            at = np.arange(1, len(b) + 1)
            if least_idf is not None:
                b, at = b[idf[b] >= least_idf], at[idf[b] >= least_idf]
            b, at = b[:most], at[:most]
            if len(b):
                yield from out.add(np.full(len(b), a), b, count[b], at)
        yield from out.rest()

    sums = triple_sums(known, triple_support, block_of)
    return in_blocks(dealt(known, block_of, 0, True).union(sums), blocks, work, "term string, co_term string, support long, weight double, place int, idf double")
