"""N-gram Jaccard join: exact connected components of the self-join of shingle sets in the Jaccard metric space.

Distances between unrelated documents are all 1, so cells around document pivots alone would split nothing, and each
document would stand in every cell. The join therefore goes down three levels, all exact.

Regions. A set of n shingles is dealt by hash into S slices, where S is twice the largest symmetric difference d that a
linked pair of its size class can have (and two more). Linked sets agree on all slices but d, so in any common order of slice values they
agree on one of their d + 1 first ones. Values are ordered by the frequency of their rarest shingle, so passages and
phrases that many documents share stand last and join no unrelated ones. The first holder of a slice value is the pivot
of its region, and a set belongs to the regions of all its slices, so sets near a border stand in each; size classes
overlap by the window 1 / threshold.

Sketches. A slice's content is hashed to four bits. Unequal slices are a metric that no symmetric difference is below, so
members of a region whose sketches are further apart than a linked pair may be are ruled out before any text moves. What
is left of a region is a spanning forest of its sketch graph, not a list of pairs; the components of all forests are the
clusters in which every linked pair lies.

Clusters. The members' differences from the cluster's first document are the points of a metric space (sizes of
symmetric differences). A cluster is cut into Voronoi cells around pivots that lie far apart; a member stands in each
cell whose pivot is at most twice its widest link further than the nearest one (triangle inequality); cells are cut
again until they are small or no longer shrink. There, members of the components but the largest are compared with the
cell. Links within a component are never looked for, so a group of near copies costs little more than one comparison a
member. Found is a spanning set of links, hence exact components: neither the pairs nor the number of links.

Hot groups. Equal sets of a batch send one member. A slice value reaches its part as one entry a batch. Regions and
clusters beyond `block` members (`block_bytes` of text) are cut into blocks; blocks settle themselves first, and only members outside
the first document's component are then compared with the other blocks.

Defined cases: null and empty texts, and texts without words, have an empty set and link with nothing; with fewer words
than a shingle the whole sequence is one shingle; rows with equal doc_id are one node (each text's links count for it);
rows with a null doc_id keep n_shingles and get a null component_id; other columns are not read. Equal sets are told by
128 bits, shingles by 64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import MULTIPLIERS, U, Words, afresh, components, discard, mix, parts_for, prepare, settle, shingle_sets, summed


@dataclass(frozen=True)
class JaccardParams:
    """Pairs link when their Jaccard similarity is at least percent / 100. part_keys: slices compared in one task; block,
    block_bytes: members, and bytes of texts, of a region or cluster that one task holds; leaf: cells that are not cut."""

    words: int = 5
    percent: int = 80
    part_keys: int = 500_000
    class_ratio: float = 1.5
    block: int = 4096
    block_bytes: int = 32 << 20
    leaf: int = 64
    pivots: int = 8


# ---------------------------------------------------------------- slices and sketches


class Classes:
    """Size classes: of sizes low[c] up to low[c + 1], with slices[c] slices; a set of the class before, within the
    window of the threshold, belongs to the next smaller class as well."""

    def __init__(self, params: JaccardParams):
        p, q = params.percent, 100
        ratio = max(params.class_ratio, q / p)
        low = [-(-p // (q - p))]  # below, a difference of one breaks the threshold: only equal sets link
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, int(low[-1] * ratio)))
        self.low = np.array(low, np.int64)
        largest = self.low[1:] - 1
        self.difference = largest * (q - p) // p  # of x and y at most, if x is in the class and not the larger
        self.slices = 2 * self.difference + 2
        self.window = largest * q // p  # largest partner

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, "right") - 1


BUCKETS = 20  # bits of a shingle's hash by which frequencies are counted


def frequencies(documents: DataFrame, params: JaccardParams) -> tuple[np.ndarray, int]:
    """A level (0 to 254) for each bucket of shingle hashes, by the documents that hold them, and the number of shingles.

    A task reports the buckets that stand out among its own; at most 2**20 numbers reach the driver. Levels decide in
    which order slices are taken, never what is found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << BUCKETS, np.int64)
        for b in batches:
            values, _ = shingle_sets(Words(b.column(0), lower=True), params.words)
            count += np.bincount((values >> U(64 - BUCKETS)).astype(np.int64), minlength=len(count))
        mean = count.mean()
        out = np.flatnonzero(count > mean + 8 * np.sqrt(mean) + 8)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(out, -1)), pa.array(np.append(count[out], count.sum()))], names=["bucket", "n"])

    counted = documents.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long")
    found = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = (np.asarray(c).astype(np.int64) for c in (found.column("bucket"), found.column("n")))
    level = np.zeros(1 << BUCKETS, np.uint8)
    level[bucket[bucket >= 0]] = 1 + np.minimum(253, 6 * np.log2(np.maximum(1, n[bucket >= 0]))).astype(np.uint8)
    return level, int(n[bucket < 0].sum())


def sliced(values: np.ndarray, offsets: np.ndarray, classes: Classes, lower: int, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the sets end to end in values that have slices in their own class, or the one below it: their indices, the set
    (index) and key of each of their first slices, and their sketches, half a byte a slice, end to end with offsets."""
    sizes = np.diff(offsets)
    c = classes.of(sizes) - lower
    take = np.flatnonzero((c >= 0) & ((sizes <= classes.window[np.maximum(c, 0)]) if lower else True))
    if not len(take):
        return take, np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    c = c[take]
    n, k = sizes[take], classes.slices[c]
    base = np.concatenate([[0], np.cumsum(k)])
    index = np.repeat(offsets[take] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    held = values[index]
    spread = mix(held ^ MULTIPLIERS[48]) >> U(32)
    slot = np.repeat(base[:-1], n) + ((spread * np.repeat(k, n).astype(U)) >> U(32)).astype(np.int64)
    total, rarest = np.zeros(base[-1], U), np.full(base[-1], 255, np.uint8)  # empty slices come last
    np.add.at(total, slot, mix(held + MULTIPLIERS[49]))
    np.minimum.at(rarest, slot, level[(held >> U(64 - BUCKETS)).astype(np.int64)])
    nibble = (mix(total) >> U(60)).astype(np.uint8)
    place = (np.arange(base[-1]) - np.repeat(base[:-1], k)).astype(U)
    key = mix(total + mix((place << U(8)) + np.repeat(c, k).astype(U) + MULTIPLIERS[50]))
    order = (rarest.astype(U) << U(56)) | (key >> U(8))
    first = [a + np.argpartition(order[a:b], d)[: d + 1] for a, b, d in zip(base[:-1], base[1:], classes.difference[c], strict=True)]
    return take, np.repeat(take, classes.difference[c] + 1), key[np.concatenate(first)], (nibble[::2] << 4) | nibble[1::2], base // 2


def set_ids(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, the same for equal ones."""
    n = np.diff(offsets).astype(U)
    return tuple(mix(summed(mix(values + MULTIPLIERS[i]), offsets) + n * MULTIPLIERS[i + 2]).view(np.int64) for i in (51, 52))


SENT = "part long, batch long, blob binary, idx int, doc_id long, n long, h1 long, h2 long, class int, own binary, lower binary"
LARGEST_BATCH = 1 << 15  # an index has 15 bits, one more tells that the batch has the key several times


def send(documents: DataFrame, params: JaccardParams, level: np.ndarray, parts: int, most: int = 16 << 20) -> DataFrame:
    """A row a document (part null), with sketches where its set is the first of its batch; a row for each part that a
    batch has keys of (the batch's first holder of each); a row (part -1) with the keys that a batch has several times."""
    none = lambda k, kind: pa.nulls(k, kind)
    levels = documents.sparkSession.sparkContext.broadcast(level)  # 2**20 bytes

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size, rows = [], 0, 0
        for b in batches:
            for at in range(0, len(b), LARGEST_BATCH):
                piece = b.slice(at, LARGEST_BATCH)
                if held and (size + piece.nbytes > most or rows + len(piece) > LARGEST_BATCH):
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, size, rows = [], 0, 0
                held.append(piece)
                size, rows = size + piece.nbytes, rows + len(piece)
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(params)
        for number, t in enumerate(gathered(batches)):
            batch = (TaskContext.get().partitionId() << 24) + number
            doc_ids, texts = (x.chunk(0) if x.num_chunks else pa.array([], x.type) for x in t.columns)
            values, offsets = shingle_sets(Words(texts, lower=True), params.words)
            (h1, h2), n, m = set_ids(values, offsets), np.diff(offsets), len(t)
            # the smallest doc_id of equal sets stands for them
            ids = np.asarray(doc_ids.fill_null(0)).astype(np.int64)
            known = np.asarray(doc_ids.is_valid()) & (n > 0)
            order = np.lexsort((ids, h2, h1, ~known))
            first = np.zeros(m, bool)
            first[order] = np.concatenate([[True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])])[:m]
            stands = np.flatnonzero(first & known)
            ends = np.concatenate([[0], np.cumsum(n[stands])])
            own_values = values[np.repeat(offsets[stands] - ends[:-1], n[stands]) + np.arange(ends[-1])]
            sketches, sets, keys = [[None] * m, [None] * m], [], []
            for lower in (0, 1):
                take, owner, key, sketch, base = sliced(own_values, ends, classes, lower, levels.value)
                for j, i in enumerate(take):
                    sketches[lower][stands[i]] = sketch[base[j] : base[j + 1]].tobytes()
                sets.append(stands[owner])
                keys.append(key)
            yield pa.RecordBatch.from_arrays([none(m, pa.int64()), pa.array(np.full(m, batch)), none(m, pa.binary()), pa.array(np.arange(m, dtype=np.int32)), doc_ids, pa.array(n), pa.array(h1), pa.array(h2), pa.array(classes.of(n).astype(np.int32)), *[pa.array(s, pa.binary()) for s in sketches]], schema=ARROW)
            sets, keys = np.concatenate(sets), np.concatenate(keys)
            if not len(keys):
                continue
            part = ((keys >> U(32)) * U(parts)) >> U(32)
            code = (part << U(32)) | (keys & U(0xFFFFFFFF))
            order = np.lexsort((ids[sets], code))
            code, sets = code[order], sets[order]
            begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            size = np.diff(np.concatenate([begin, [len(code)]]))
            several = np.repeat(size > 1, size)
            blobs = [(-1, code[several].tobytes() + sets[several].astype(np.uint16).tobytes())] if several.any() else []
            key, idx, part = (code[begin] & U(0xFFFFFFFF)).astype(np.uint32), (sets[begin] + LARGEST_BATCH * (size > 1)).astype(np.uint16), (code[begin] >> U(32)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            blobs += [(int(part[a]), key[a:b].tobytes() + idx[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True)]
            k = len(blobs)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in blobs], pa.int64()), pa.array(np.full(k, batch)), pa.array([x for _, x in blobs], pa.binary()), *[none(k, f.type) for f in list(ARROW)[3:]]], schema=ARROW)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SENT)


ARROW = pa.schema([(name, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[kind]) for name, kind in (c.split() for c in SENT.split(", "))])


def regions(sent: DataFrame) -> DataFrame:
    """(region, row): the members of each region, its pivot among them; a row is numbered by batch and index."""

    def pivots(key: tuple, table: pa.Table) -> pa.Table:
        """For each batch, its holders of keys that several batches sent with the key's pivot; with the key, if the batch
        has several holders."""
        part = U(key[0].as_py())
        blobs = [x.as_py() for x in table.column("blob")]
        count = np.array([len(x) // 6 for x in blobs])
        keys = np.concatenate([np.frombuffer(x, np.uint32, k) for x, k in zip(blobs, count, strict=True)])
        idx = np.concatenate([np.frombuffer(x, np.uint16, k, 4 * k) for x, k in zip(blobs, count, strict=True)]).astype(np.int64)
        batch = np.repeat(np.asarray(table.column("batch")), count)
        row = batch * LARGEST_BATCH + idx % LARGEST_BATCH
        order = np.lexsort((row, keys))
        keys, idx, batch, row = keys[order], idx[order], batch[order], row[order]
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.concatenate([begin, [len(keys)]]))
        some = np.repeat(size > 1, size)
        pivot, keys, idx, batch = np.repeat(row[begin], size)[some], keys[some].astype(U) | (part << U(32)), idx[some], batch[some]
        order = np.lexsort((idx, pivot, batch))
        out = []
        for at in np.split(order, np.flatnonzero(np.diff(batch[order])) + 1):
            if len(at):
                plain, twice = at[idx[at] < LARGEST_BATCH], at[idx[at] >= LARGEST_BATCH]
                pairs = np.unique(np.stack([pivot[plain], idx[plain]]), axis=1)
                out.append((int(batch[at[0]]), pairs.astype(np.int64).tobytes(), keys[twice].tobytes() + pivot[twice].tobytes()))
        return pa.table({"batch": pa.array([x[0] for x in out], pa.int64()), "pairs": pa.array([x[1] for x in out], pa.binary()), "keyed": pa.array([x[2] for x in out], pa.binary())})

    def members(key: tuple, inner: pa.Table, across: pa.Table) -> pa.Table:
        batch = key[0].as_py()
        pairs = [np.frombuffer(x.as_py(), np.int64).reshape(2, -1) for x in across.column("pairs")]
        keyed = [np.frombuffer(x.as_py(), np.int64).reshape(2, -1) for x in across.column("keyed")]
        found = [np.stack([p[0], batch * LARGEST_BATCH + p[1]]) for p in pairs if p.shape[1]]
        keyed = np.concatenate(keyed, axis=1) if keyed else np.zeros((2, 0), np.int64)
        known, pivot = keyed[0].view(U), keyed[1]
        order = np.argsort(known, kind="stable")
        known, pivot = known[order], pivot[order]
        for x in inner.column("blob"):
            raw = x.as_py()
            k = len(raw) // 10
            code, idx = np.frombuffer(raw, U, k), np.frombuffer(raw, np.uint16, k, 8 * k).astype(np.int64) + batch * LARGEST_BATCH
            begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            region = idx[begin]
            if len(known):
                at = np.minimum(np.searchsorted(known, code[begin]), len(known) - 1)
                region = np.where(known[at] == code[begin], pivot[at], region)
            found.append(np.stack([np.repeat(region, np.diff(np.concatenate([begin, [k]]))), idx]))
        both = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        both = both[:, both[0] != both[1]]
        both = np.concatenate([both, np.stack([np.unique(both[0])] * 2)], axis=1)
        return pa.table({"region": both[0], "row": both[1]})

    across = sent.where("part >= 0").select("part", "batch", "blob").groupBy("part").applyInArrow(pivots, "batch long, pairs binary, keyed binary")
    inner = sent.where("part = -1").select("batch", "blob")
    return inner.groupBy("batch").cogroup(across.groupBy("batch")).applyInArrow(members, "region long, row long").distinct()


# ---------------------------------------------------------------- forests


def near(n: np.ndarray | int, m: np.ndarray | int, difference: np.ndarray | int, percent: int) -> np.ndarray | bool:
    """Whether sets of n and m elements may have that symmetric difference and link."""
    return (n + m) * (100 - percent) >= difference * (100 + percent)


class Forest:
    """Components of some members, and the links that joined them."""

    def __init__(self, members: int):
        self.label = np.arange(members)
        self.links: list[tuple[int, int]] = []

    def link(self, y: int, others: np.ndarray) -> None:
        for label in np.unique(self.label[others]):
            if label != self.label[y]:
                self.links.append((y, int(others[self.label[others] == label][0])))
                self.label[self.label == label] = self.label[y]

    def close(self, among: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> None:
        """Find all components among some members: linked(y, among) tells who of them links to y. Members of the largest
        component come last, and need no look once all others were looked at."""
        undone = among
        while len(undone):
            labels, count = np.unique(self.label[undone], return_counts=True)
            if len(labels) < 2:
                return
            y = int(undone[np.flatnonzero(self.label[undone] == labels[np.argmin(count)])[0]])
            self.link(y, among[linked(y, among)])
            undone = undone[undone != y]


PAIRS = np.array([(x > 15) + (x % 16 > 0) for x in range(256)], np.uint8)


class Sketches:
    """Sketched sets of a region: their sizes, size classes and sketches in their own class and the one below."""

    def __init__(self, n: np.ndarray, kind: np.ndarray, own: list[bytes], lower: list[bytes | None], percent: int):
        self.n, self.kind, self.own, self.lower, self.percent = n, kind, own, lower, percent
        self.at = np.zeros(len(n), np.int64)
        self.stacks: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for c in np.unique(kind):
            rows = np.flatnonzero(kind == c)
            self.stacks[c, 0] = rows, np.stack([np.frombuffer(own[i], np.uint8) for i in rows])
            rows = rows[[lower[i] is not None for i in rows]]
            if len(rows):
                self.stacks[c, 1] = rows, np.stack([np.frombuffer(lower[i], np.uint8) for i in rows])

    def linked(self, y: int, among: np.ndarray) -> np.ndarray:
        """Whose sketch is no further from y's than a link may be. Sets of one class are compared in it, sets of two in
        the lower one; between others, sizes alone rule a link out."""
        out, c = np.zeros(len(self.n), bool), self.kind[y]
        for stack, mine in (((c, 0), self.own[y]), ((c + 1, 1), self.own[y]), ((c - 1, 0), self.lower[y])):
            if mine is not None and stack in self.stacks:
                rows, sketches = self.stacks[stack]
                apart = PAIRS[sketches ^ np.frombuffer(mine, np.uint8)].sum(axis=1, dtype=np.int64)
                out[rows] = near(self.n[rows], self.n[y], apart, self.percent)
        out &= (100 * np.minimum(self.n, self.n[y]) >= self.percent * np.maximum(self.n, self.n[y])) & (np.arange(len(out)) != y)
        return out[among]


class Differences:
    """Sets of a cluster as differences from one of them, end to end in codes."""

    def __init__(self, n: np.ndarray, differences: list[np.ndarray], params: JaccardParams):
        self.n, self.params, self.size = n, params, np.array([len(d) for d in differences], np.int64)
        values = np.concatenate(differences) if differences else np.zeros(0, U)
        self.codes = np.unique(values, return_inverse=True)[1] if len(values) else np.zeros(0, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.size)])
        self.mark = np.zeros(int(self.codes.max()) + 1 if len(values) else 1, bool)
        self.widest = n * (100 - params.percent) // params.percent  # of a difference between the set and a partner

    def apart(self, y: int, among: np.ndarray) -> np.ndarray:
        """The symmetric differences between y and others."""
        own = self.codes[self.offsets[y] : self.offsets[y + 1]]
        self.mark[own] = True
        size = self.size[among]
        ends = np.cumsum(size)
        index = np.repeat(self.offsets[among] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        total = np.concatenate([[0], np.cumsum(self.mark[self.codes[index]])])
        self.mark[own] = False
        return size + len(own) - 2 * (total[ends] - total[ends - size])

    def linked(self, y: int, among: np.ndarray) -> np.ndarray:
        # sizes and, by the triangle inequality, the differences from the first set rule out most before any is compared
        may = near(self.n[among], self.n[y], np.abs(self.size[among] - self.size[y]), self.params.percent) & (among != y)
        out = np.zeros(len(among), bool)
        at = np.flatnonzero(may)
        out[at] = near(self.n[among[at]], self.n[y], self.apart(y, among[at]), self.params.percent)
        return out

    def join(self, forest: Forest, among: np.ndarray) -> None:
        """All components among some members: cells around pivots, their borders widened by the triangle inequality."""
        if len(np.unique(forest.label[among])) < 2:
            return
        if len(among) > self.params.leaf:
            far, distances = among[0], []
            for _ in range(self.params.pivots):
                d = self.apart(far, among)
                forest.link(int(far), among[near(self.n[among], self.n[far], d, self.params.percent) & (among != far)])
                distances.append(d)
                nearest = np.min(distances, axis=0)
                far = among[np.argmax(nearest)]
            if len(np.unique(forest.label[among])) < 2:
                return
            cells = [among[d <= nearest + 2 * self.widest[among]] for d in distances]
            home = np.argmin(distances, axis=0)
            cells = [c for i, c in enumerate(cells) if (home == i).any()]
            if max(map(len, cells)) <= 0.7 * len(among):
                for c in cells:
                    self.join(forest, c)
                return
        forest.close(among, self.linked)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The symmetric difference of two sorted sets, sorted."""
    d = np.sort(np.concatenate([a, b]))
    twin = d[1:] == d[:-1]
    once = np.ones(len(d), bool)
    once[1:] &= ~twin
    once[:-1] &= ~twin
    return d[once]


def small_forests(table: pa.Table, begin: np.ndarray, size: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (rows of the table) of a sketch forest of each of some small groups, all of whose pairs are compared at once."""
    n, kind = (np.asarray(table.column(c)).astype(np.int64) for c in ("n", "class"))
    data, start = [], []
    for c in ("own", "lower"):
        a = table.column(c).chunk(0)
        offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
        start.append(offsets[:-1] + sum(map(len, data)))
        data.append(np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8))
        length = np.diff(offsets) if c == "own" else length
    data, lowered = np.concatenate(data), np.asarray(table.column("lower").chunk(0).is_valid())
    pairs = [(begin[size == s][:, None] + np.stack(np.triu_indices(s, 1))[:, None, :]).reshape(2, -1) for s in np.unique(size)]
    i, j = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    i, j = np.where(kind[i] <= kind[j], i, j), np.where(kind[i] <= kind[j], j, i)
    step = kind[j] - kind[i]
    may = ((step == 0) | ((step == 1) & lowered[j])) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
    i, j, step = i[may], j[may], step[may]
    ends = np.cumsum(length[i])
    root, links, at = {}, [], 0

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            x = up
        return x

    while at < len(i):  # some megabytes of sketches at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (4 << 20))))
        a, b, k = i[at:to], j[at:to], length[i[at:to]]
        before = np.cumsum(k) - k
        inside = np.arange(k.sum()) - np.repeat(before, k)
        x = np.repeat(start[0][a], k) + inside
        y = np.repeat(np.where(step[at:to] == 0, start[0][b], start[1][b]), k) + inside
        apart = np.add.reduceat(PAIRS[data[x] ^ data[y]], before, dtype=np.int64)
        hit = near(n[a], n[b], apart, percent)
        for p, q in zip(a[hit].tolist(), b[hit].tolist(), strict=True):
            r, t = find(p), find(q)
            if r != t:
                root[max(r, t)] = min(r, t)
                links.append((p, q))
        at = to
    return links


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], least: int = 1 << 13) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, rows that follow each other with equal values, and where groups begin."""
    held: list[pa.Table] = []

    def cut(t: pa.Table) -> np.ndarray:
        keys = [np.asarray(t.column(c)) for c in by]
        return np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))

    for b in batches:
        if len(b):
            held.append(pa.Table.from_batches([b]))
        if sum(map(len, held)) >= least:
            t = pa.concat_tables(held).combine_chunks()
            begin = cut(t)
            if len(begin) > 1:
                yield t.slice(0, int(begin[-1])), begin[:-1]
                t = t.slice(int(begin[-1]))
            held = [t]
    if held:
        t = pa.concat_tables(held).combine_chunks()
        yield t, cut(t)


def runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[list[dict]]:
    """Rows that follow each other with equal values in some columns."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and any(row[c] != held[0][c] for c in by):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


# ---------------------------------------------------------------- groups in blocks


def blocked(rows: DataFrame, group: str, weight: str, params: JaccardParams) -> DataFrame:
    """rows with blocks, how many their group is cut into, and block, the one that a row goes to."""
    sizes = rows.groupBy(group).agg(F.greatest(F.ceil(F.count("*") / params.block), F.ceil(F.sum(weight) / params.block_bytes)).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    return rows.join(afresh(sizes.where("blocks > 1"), group), group, "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))


def across_blocks(points: DataFrame, fields: list[str], links: Callable[[list[dict], list[dict]], list[tuple[int, int]]]) -> DataFrame:
    """(a, b): links between the blocks of each group, of points (group, block, open, fields): each block's open members
    against the other blocks, two blocks in a task at a time."""
    item = F.struct(*fields)
    whole = points.groupBy("group", F.col("block").alias("other")).agg(F.collect_list(item).alias("y"))
    probes = points.where("open").groupBy("group", "block").agg(F.collect_list(item).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                found = links(b.column("x")[i].as_py(), b.column("y")[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in (0, 1)], names=["a", "b"])

    pairs = probes.join(whole, "group").where("block != other")
    return pairs.repartition("group", "block", "other").select("x", "y").mapInArrow(run, "a long, b long")


def column(rows: list[dict], name: str) -> np.ndarray:
    return np.array([r[name] for r in rows], np.int64)


# ---------------------------------------------------------------- regions


def sketch_links(members: DataFrame, sent: DataFrame, params: JaccardParams) -> DataFrame:
    """(a, b): a spanning forest of each region's sketch graph, as doc_ids."""
    sets = sent.where("own is not null").withColumn("row", F.col("batch") * LARGEST_BATCH + F.col("idx"))
    light = blocked(members.join(sets.select("row", "doc_id", "n"), "row"), "region", "n", params)
    fields = ["doc_id", "n", "class", "own", "lower"]
    # the pivot stands in each block of its region
    places = F.when(F.col("row") == F.col("region"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    rows = light.select("region", "blocks", "row", F.explode(places).alias("block")).join(sets.select("row", *fields), "row")

    def sketched(rows: list[dict]) -> Sketches:
        return Sketches(column(rows, "n"), column(rows, "class"), [r["own"] for r in rows], [r["lower"] for r in rows], params.percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in whole_groups(batches, ["region", "block"]):
            size = np.diff(np.concatenate([begin, [len(table)]]))
            cut, doc_ids = np.asarray(table.column("blocks"))[begin] > 1, np.asarray(table.column("doc_id"))
            small = (size <= 16) & ~cut
            links = small_forests(table, begin[small & (size > 1)], size[small & (size > 1)], params.percent)
            if links:
                a, b = doc_ids[np.array(links)].T.tolist()
                yield frame([a, b, *[[None] * len(a)] * 8], SKETCHED)
            for at in np.flatnonzero(~small):
                rows = table.slice(int(begin[at]), int(size[at])).to_pylist()
                ids, forest = column(rows, "doc_id"), Forest(len(rows))
                forest.close(np.arange(len(rows)), sketched(rows).linked)
                a, b = ([int(ids[x[i]]) for x in forest.links] for i in (0, 1))
                if cut[at]:
                    pivot = next(i for i, r in enumerate(rows) if r["row"] == r["region"])
                    opened = (forest.label != forest.label[pivot]).tolist()
                    yield frame([*([*x, *[None] * len(rows)] for x in (a, b)), *[[*[None] * len(a), *x] for x in ([rows[0]["region"]] * len(rows), [rows[0]["block"]] * len(rows), opened, *([r[f] for r in rows] for f in fields))]], SKETCHED)
                elif a:
                    yield frame([a, b, *[[None] * len(a)] * 8], SKETCHED)

    found = settle(rows.repartition("region", "block").sortWithinPartitions("region", "block").mapInArrow(run, SKETCHED), "sketched")
    links = found.where("a is not null").select("a", "b")
    points = found.where("group is not null")
    if points.isEmpty():
        return links

    def between(x: list[dict], y: list[dict]) -> list[tuple[int, int]]:
        sketches, ids, forest = sketched([*x, *y]), column([*x, *y], "doc_id"), Forest(len(x) + len(y))
        others = np.arange(len(x), len(ids))
        for i in range(len(x)):
            forest.link(i, others[sketches.linked(i, others)])
        return [(int(ids[i]), int(ids[j])) for i, j in forest.links]

    return links.union(across_blocks(points, fields, between))


SKETCHED = "a long, b long, group long, block int, open boolean, doc_id long, n long, class int, own binary, lower binary"
KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def frame(columns: list[list], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


# ---------------------------------------------------------------- clusters


def cluster_links(documents: DataFrame, clusters: DataFrame, sent: DataFrame, params: JaccardParams) -> tuple[DataFrame, bool]:
    """(a, b): the exact components in each cluster (doc_id, root): documents with the smallest of their component; and
    whether these are final, no cluster being cut into blocks."""
    sizes = sent.where("own is not null").groupBy("doc_id").agg((8 * F.sum("n")).alias("weight"))
    light = blocked(clusters.join(sizes, "doc_id"), "root", "weight", params)
    # the smallest document of a cluster is what differences are taken from, in each of its blocks
    places = F.when(F.col("doc_id") == F.col("root"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    light = light.select("doc_id", "root", "blocks", F.explode(places).alias("block"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = light.join(texts, "doc_id").select("root", "block", "blocks", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["root", "block"]):
            root, sets = rows[0]["root"], {}
            for at in range(0, len(rows), 256):
                some = rows[at : at + 256]
                values, offsets = shingle_sets(Words(pa.array([r["text"] for r in some], pa.string()), lower=True), params.words)
                for i, r in enumerate(some):
                    if offsets[i + 1] > offsets[i]:
                        sets.setdefault((r["doc_id"] != root, r["doc_id"], values[offsets[i] : offsets[i + 1]].tobytes()), None)
            keys = sorted(sets)
            if not keys:
                continue
            ids, n = np.array([k[1] for k in keys], np.int64), np.array([len(k[2]) // 8 for k in keys], np.int64)
            first = np.frombuffer(keys[0][2], U)
            differences = [apart(first, np.frombuffer(k[2], U)) for k in keys]
            del sets, keys
            forest, everyone = Forest(len(ids)), np.arange(len(ids))
            for i in np.flatnonzero(ids[1:] == ids[:-1]):  # several texts under one doc_id
                forest.link(int(i), everyone[i + 1 : i + 2])
            points = Differences(n, differences, params)
            forest.link(0, np.flatnonzero(near(n, n[0], points.size, params.percent) & (everyone > 0)))
            points.join(forest, everyone)
            least = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(least, forest.label, ids)
            least = least[forest.label]
            a, b = ids[least != ids].tolist(), least[least != ids].tolist()
            if rows[0]["blocks"] > 1:
                k = len(ids)
                opened = (forest.label != forest.label[0]).tolist()
                yield frame([*([*x, *[None] * k] for x in (a, b)), *[[*[None] * len(a), *x] for x in ([root] * k, [rows[0]["block"]] * k, opened, ids.tolist(), n.tolist(), [d.tobytes() for d in differences])]], COMPARED)
            elif a:
                yield frame([a, b, *[[None] * len(a)] * 6], COMPARED)

    found = settle(rows.repartition("root", "block").sortWithinPartitions("root", "block").mapInArrow(run, COMPARED), "compared")
    links = found.where("a is not null").select("a", "b")
    points = found.where("group is not null")
    if points.isEmpty():
        return links, True

    def between(x: list[dict], y: list[dict]) -> list[tuple[int, int]]:
        ids, forest = column([*x, *y], "doc_id"), Forest(len(x) + len(y))
        points = Differences(column([*x, *y], "n"), [np.frombuffer(r["difference"], U) for r in [*x, *y]], params)
        others = np.arange(len(x), len(ids))
        for i in range(len(x)):
            forest.link(i, others[points.linked(i, others)])
        return [(int(ids[i]), int(ids[j])) for i, j in forest.links]

    return links.union(across_blocks(points, ["doc_id", "n", "difference"], between)), False


COMPARED = "a long, b long, group long, block int, open boolean, doc_id long, n long, difference binary"


def join(documents: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: the smallest doc_id reachable by links, itself included."""
    prepare(documents.sparkSession)
    level, total = frequencies(documents, params)
    # a set sends a slice for two to five of its shingles
    sent = settle(send(documents, params, level, parts_for(total // 4, params.part_keys)), "sent")
    members = settle(regions(sent), "members")
    edges = sketch_links(members, sent, params)
    clusters = settle(components(edges).select(F.col("node").alias("doc_id"), "root"), "clusters")
    links, final = cluster_links(documents, clusters, sent, params)
    roots = links.select(F.col("a").alias("doc_id"), F.col("b").alias("root")) if final else components(links).select(F.col("node").alias("doc_id"), "root")
    rows = settle(sent.where("part is null").select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2"), "rows")
    known = rows.where("n_shingles > 0 and doc_id is not null")
    sets = known.join(roots.groupBy("doc_id").agg(F.min("root").alias("root")), "doc_id", "left").groupBy("h1", "h2").agg(F.min(F.coalesce("root", "doc_id")).alias("component_id"))
    sets = settle(sets, "sets")
    # several texts under one doc_id tie their components together
    several = known.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("a"), F.max(F.struct("h1", "h2")).alias("b")).where("a != b").select("doc_id")
    ties = settle(known.join(several, "doc_id").join(sets, ["h1", "h2"]).select("doc_id", "component_id").distinct(), "ties")
    if not ties.isEmpty():
        tied = components(ties.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
        sets = sets.join(tied.select(F.col("node").alias("component_id"), "root"), "component_id", "left").select("h1", "h2", F.coalesce("root", "component_id").alias("component_id"))
    discard(sent, members, clusters)
    found = rows.join(sets, ["h1", "h2"], "left")
    whose = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return found.select("doc_id", "n_shingles", whose.alias("component_id"))
