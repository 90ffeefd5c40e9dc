"""Embedding near-dedup: randomised-rotation binary codes with stored correction factors decide which pairs need exact recomputation.

Vectors are scaled to length 1 and turned by a random rotation. A vector's code is its signs; its correction factor is
the inner product between the vector and the unit vector along its signs. The signs' inner product with another vector,
over the factor, is an unbiased estimate of the cosine, with a confidence bound. The other vector travels in bytes (its
turned components, rounded; the rounding is part of the bound).

Equal vectors are one class with a weight. Classes are dealt to cells around pivots, centroids of a bounded sample, and
each cell knows how far it reaches (the largest angle to its pivot). By the triangle inequality a vector has partners in
those cells only whose pivot is within that reach and the threshold's angle, and it visits those after its own. Cells are
cut to blocks, so a cell with a third of all vectors is many tasks' work. Only codes, factors and bytes travel to the
comparisons; exact vectors go where an estimate's confidence interval touches the threshold, and decide in double precision.
In data without clusters all cells are within reach of each other, and the codes of all pairs are compared.

Defined cases: vectors that are null, zero, of a dimension other than most vectors have, or that hold null or non-finite
components link with nothing; several rows with one vec_id are one vector (the smallest) and one row of the result; a
null vec_id gives a row with no links and a null component; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.ann import k_means
from granary.llm.common import MULTIPLIERS, U, components, mix, prepare, settle
from granary.llm.vectors import matrix, unit, usable


@dataclass(frozen=True)
class EmbeddingParams:
    """block: classes that a task compares at once; sample: rows that pivots are fitted on; sigmas: width of the confidence bound; a linked pair beyond it (about one in 10**8 at 6) would be missed."""

    cosine: float = 0.9
    block: int = 2048
    max_cells: int = 1024
    sample: int = 16384
    sigmas: float = 6.0
    seed: int = 3


def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction factors of vectors of length 1."""
    y = x @ turn
    return np.packbits(y >= 0, axis=1), np.abs(y).sum(1) / np.sqrt(x.shape[1])


def bytes_of(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turned vectors as whole numbers between -127 and 127, and the scale of each."""
    scale = np.abs(y).max(1) / 127
    return np.rint(y / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def near(codes: np.ndarray, factors: np.ndarray, rounded: np.ndarray, scales: np.ndarray, params: EmbeddingParams) -> tuple[np.ndarray, np.ndarray]:
    """(rows of codes, rows of rounded) whose estimate's confidence interval reaches the threshold."""
    d = rounded.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))
    estimate = signs @ (rounded.astype(np.float32) * scales[:, None]).T
    f = np.clip(factors.astype(float), 1e-6, 1)
    margin = params.sigmas * np.sqrt(max(0.0, 1 - params.cosine**2)) * np.sqrt(np.maximum(0, 1 - f * f)) / f / np.sqrt(max(1, d - 1)) + 1e-4
    rounding = 0.5 * np.sqrt(d) * float(scales.max(initial=0))
    return np.nonzero(estimate >= (f * (params.cosine - margin) - rounding).astype(np.float32)[:, None])


def forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest id in each position's component over edges between positions a and b."""
    root = ids.copy()
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (root == before).all():
            return root


def cells(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles to the pivots, and the nearest one."""
    angle = np.arccos(np.clip(x @ pivots.T, -1, 1))
    return angle, angle.argmin(1) if len(x) else np.zeros(0, np.int64)


def classes_of(rows: DataFrame) -> DataFrame:
    """vec_id (the smallest), embedding and weight of each class of equal vectors; h1, h2 name it."""
    best = rows.groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "embedding")).alias("first"), F.count("*").alias("weight"))
    return best.select(F.col("first.vec_id").alias("vec_id"), F.col("first.embedding").alias("embedding"), "weight", "h1", "h2")


def links(classes: DataFrame, params: EmbeddingParams = EmbeddingParams()) -> DataFrame:
    """(vec_id, n, root): of each pair of blocks, its linked classes, the vectors that they link to in it and the smallest
    vec_id that they reach in it."""
    spark = classes.sparkSession
    n = classes.count()
    schema = "vec_id long, n long, root long"
    if not n:
        return spark.createDataFrame([], schema)
    sample = unit(matrix(classes.orderBy(F.xxhash64("vec_id"), "vec_id").limit(params.sample).select("embedding").toArrow().column(0)))
    pivots = k_means(sample, max(1, min(params.max_cells, n // params.block)), np.random.default_rng(params.seed), 4)
    pivots = pivots / np.maximum(1e-30, np.sqrt((pivots * pivots).sum(1, keepdims=True)))
    sent = spark.sparkContext.broadcast(pivots)  # at most max_cells vectors
    theta = float(np.arccos(min(1.0, params.cosine))) + 1e-6

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            angle, home = cells(unit(matrix(b.column(0))) if len(b) else np.zeros((0, sent.value.shape[1])), sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int64()), pa.array(angle[np.arange(len(home)), home])], names=["cell", "angle"])

    found = classes.select("embedding").mapInArrow(reach, "cell long, angle double").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()  # at most max_cells rows
    reaches, blocks = np.full(len(pivots), -10.0), np.ones(len(pivots), np.int64)
    for r in found:
        reaches[r["cell"]], blocks[r["cell"]] = r["angle"] + 1e-6, -(-r["n"] // params.block)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to its own cell and to those after it that may hold partners, packed by block of origin."""
        turn = rotation(pivots.shape[1], params.seed)
        for b in batches:
            if not len(b):
                continue
            ids, x = np.asarray(b.column(0)), unit(matrix(b.column(1)))
            angle, home = cells(x, sent.value)
            block = (mix(ids.astype(U) + MULTIPLIERS[60]) % blocks[home].astype(U)).astype(np.int64)
            (codes, factors), (rounded, scales) = encode(x, turn), bytes_of(x @ turn)
            factors = factors.astype(np.float32)
            goes = (angle <= reaches + theta) & (np.arange(len(reaches)) > home[:, None])
            goes[np.arange(len(ids)), home] = True
            row, cell = np.nonzero(goes)
            order = np.lexsort((block[row], home[row], cell))
            row, cell = row[order], cell[order]
            cuts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (home[row][1:] != home[row][:-1]) | (block[row][1:] != block[row][:-1])]))
            at = [row[i:j] for i, j in zip(cuts, [*cuts[1:], len(row)], strict=True)]
            first = row[cuts]
            packs = [[pa.array([v[r].tobytes() for r in at], pa.binary())] for v in (ids, codes, factors, rounded, scales)]
            yield pa.RecordBatch.from_arrays([pa.array(cell[cuts]), pa.array(home[first]), pa.array(block[first]), *[p[0] for p in packs]], names=["cell", "home", "block", "ids", "codes", "factors", "rounded", "scales"])

    fields = ["ids", "codes", "factors", "rounded", "scales"]
    joined = lambda c: F.aggregate(F.transform("all", lambda p: p[c]), F.unhex(F.lit("")), lambda a, b: F.concat(a, b)).alias(c)
    packed = classes.select("vec_id", "embedding").mapInArrow(visits, "cell long, home long, block long, " + ", ".join(f"{c} binary" for c in fields))
    packed = settle(packed.groupBy("cell", "home", "block").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("all")).select("cell", "home", "block", *[joined(c) for c in fields]), "codes")
    # each pack goes to every block of the cell; blocks of one cell meet once
    counts = F.array(*[F.lit(int(b)) for b in blocks])
    into = packed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.element_at(counts, (F.col("cell") + 1).cast("int")).cast("long") - 1)).alias("to")).where("home < cell or to <= block")
    residents = packed.where("home = cell").select("cell", F.col("block").alias("to"), F.col("ids").alias("ids_2"), F.col("codes").alias("codes_2"), F.col("factors").alias("factors_2"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                r = batch.slice(i, 1).to_pylist()[0]
                ids, ids_2 = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["ids_2"], np.int64)
                a, b = near(np.frombuffer(r["codes_2"], np.uint8).reshape(len(ids_2), -1), np.frombuffer(r["factors_2"], np.float32), np.frombuffer(r["rounded"], np.int8).reshape(len(ids), -1), np.frombuffer(r["scales"], np.float32), params)
                same = ids_2[a] == ids[b]
                one, two = np.unique(ids_2[a[~same]]), np.unique(ids[b[~same]])
                if r["home"] == r["cell"] and r["block"] == r["to"]:
                    one = two = np.union1d(one, two)
                pair = f"{r['cell']} {r['to']} {r['home']} {r['block']}"
                who = np.concatenate([one, two])
                yield pa.RecordBatch.from_arrays([pa.array([pair] * len(who), pa.string()), pa.array([0] * len(one) + [1] * len(two), pa.int32()), pa.array(who)], names=["pair", "side", "vec_id"])

    wanted = settle(into.join(residents, ["cell", "to"]).select("cell", "to", "home", "block", *fields[:1], *fields[3:], "ids_2", "codes_2", "factors_2").mapInArrow(compare, "pair string, side int, vec_id long"), "candidates")

    def exact(key: tuple, table: pa.Table) -> pa.Table:
        side, ids, weight = (np.asarray(table.column(c)) for c in ("side", "vec_id", "weight"))
        x = unit(matrix(table.column("embedding")))
        at, to = (np.flatnonzero(side == s) for s in (0, 1))
        at, to = at[np.argsort(ids[at])], to[np.argsort(ids[to])]
        count, a, b = np.zeros(len(ids), np.int64), [], []
        within = len(at) == len(to) and (ids[at] == ids[to]).all()
        for i in range(0, len(at), 512):
            hit = np.nonzero(x[at[i : i + 512]] @ x[to].T >= params.cosine - 1e-9)
            p, q = at[i : i + 512][hit[0]], to[hit[1]]
            keep = (ids[p] < ids[q]) if within else np.ones(len(p), bool)
            p, q = p[keep], q[keep]
            keep = np.concatenate([np.zeros(0, bool)] + [np.einsum("ij,ij->i", x[p[j : j + 65536]], x[q[j : j + 65536]]) >= params.cosine for j in range(0, len(p), 65536)])
            a.append(p[keep])
            b.append(q[keep])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        np.add.at(count, a, weight[b])
        np.add.at(count, b, weight[a])
        names, place = np.unique(ids, return_inverse=True)
        n, root = np.bincount(place, count, len(names)).astype(np.int64), forest(names, place[a], place[b])
        some = n > 0
        return pa.table({"vec_id": names[some], "n": n[some], "root": root[some]})

    return wanted.join(classes.select("vec_id", "embedding", "weight"), "vec_id").groupBy("pair").applyInArrow(exact, schema)


def dedup(embeddings: DataFrame, params: EmbeddingParams = EmbeddingParams()) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vec_id."""
    prepare(embeddings.sparkSession)
    rows = settle(usable(embeddings).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")}), "vectors")
    classes = settle(classes_of(rows), "classes")
    found = settle(links(classes, params), "links")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("vec_id"), "root")
    named = classes.select("vec_id", "weight", "h1", "h2").join(counts, "vec_id", "left").join(roots, "vec_id", "left")
    named = named.select("h1", "h2", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "vec_id").alias("root"))
    linked = rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select("vec_id", "n_links", "root")
    ids = embeddings.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    component = F.coalesce("root", "vec_id")
    return ids.join(linked, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
