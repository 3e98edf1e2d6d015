"""Embedding near-duplicates by a subspace pigeonhole join.

cos(u, v) >= c means |u - v|^2 <= 2 - 2c on unit vectors. Vectors are rotated and split into
blocks; if the pair is within the total, some block is within the share of it that is proportional to
its dimensions. Each block is a range join on a grid over its leading axes, with cells as wide as the block's
budget reaches: vectors meet in the same cell and in neighbouring ones. The union of the
blocks' candidates is verified exactly on the original components; a pair counts in the first block
that finds it.

Equal vectors are one class, compared once. A label with few classes is joined in one task. Larger ones are dealt
by block and by cells along a few axes, a vector also to the next cell where a partner may lie, and what is
still large in tiles.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, table, written
from .components import connected

COSINE = 0.98
#: Dimensions of a block; its axes that have a grid; vectors that are joined in one task.
BLOCK, AXES, TILE = 16, 6, 8192
#: Axes, at most, along which large labels are dealt, and the width of their cells in budgets (square roots).
MOST_CUTS, CUT = 3, 2.0
#: Room for rounding in rotated differences.
SLACK = 1e-9
#: Pairs that are looked at together.
_CHUNK = 200_000


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def _blocks(dims: int, block: int) -> list[tuple[int, int]]:
    return [(a, min(dims, a + block)) for a in range(0, dims, block)]


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares may overflow or vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def grid_pairs(y: np.ndarray, reach: float, axes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the rows of y that are in the same or in neighbouring cells, of width `reach`, along the
    leading axes: each pair once, all that are within reach of each other among them."""
    cell = np.floor(y[:, :axes] / reach).astype(np.int64)
    cell -= cell.min(0)
    sizes = [int(x) + 3 for x in cell.max(0)]
    while math.prod(sizes) >= 1 << 62:
        cell, sizes = cell[:, :-1], sizes[:-1]
    code = cell[:, 0].copy()
    for k in range(1, cell.shape[1]):
        code = code * sizes[k] + cell[:, k]
    order = np.argsort(code, kind="stable")
    kinds, begin, count = np.unique(code[order], return_index=True, return_counts=True)
    left, right = [np.arange(len(kinds))], [np.arange(len(kinds))]
    for step in itertools.product((-1, 0, 1), repeat=cell.shape[1]):
        by = 0
        for k, o in enumerate(step):
            by = by * sizes[k] + o if k else o
        if step > (0,) * len(step):  # each two cells once
            at = np.minimum(np.searchsorted(kinds, kinds + by), len(kinds) - 1)
            hit = np.flatnonzero(kinds[at] == kinds + by)
            left.append(hit)
            right.append(at[hit])
    left, right = np.concatenate(left), np.concatenate(right)
    ends = np.cumsum(count[left] * count[right])
    for first in range(0, int(ends[-1]), _CHUNK):
        place = np.arange(first, min(first + _CHUNK, int(ends[-1])))
        k = np.searchsorted(ends, place, "right")
        rest = place - (ends[k] - count[left[k]] * count[right[k]])
        i, j = begin[left[k]] + rest // count[right[k]], begin[right[k]] + rest % count[right[k]]
        once = (left[k] != right[k]) | (i < j)
        yield order[i[once]], order[j[once]]


def _prepare(cosine: float, block: int, kind: str):
    """A row for each vector of a small label; for each block and cell it goes to where the label is dealt along `cuts` axes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations: dict[int, np.ndarray] = {}
        total = 2 - 2 * cosine + SLACK
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids, labels, vectors, weights, cuts = (part.column(k).to_pylist() for k in range(5))
                out: list[tuple] = []
                for dims in {len(v) for v in vectors}:
                    at = [k for k, v in enumerate(vectors) if len(v) == dims]
                    raw = np.array([vectors[k] for k in at], kind)
                    data = [a.tobytes() for a in raw]
                    out += [(ids[k], labels[k], dims, -1, 0, 0, weights[k], x) for k, x in zip(at, data, strict=True) if not cuts[k]]
                    large = [n for n, k in enumerate(at) if cuts[k]]
                    if not large:
                        continue
                    if dims not in rotations:
                        rotations[dims] = rotation(dims)
                    y = unit(raw[large]) @ rotations[dims]
                    for b, (lo, hi) in enumerate(_blocks(dims, block)):
                        reach = math.sqrt(total * (hi - lo) / dims)
                        own = np.floor(y[:, lo:hi] / (CUT * reach)).astype(np.int64)
                        last = np.floor((y[:, lo:hi] + reach) / (CUT * reach)).astype(np.int64)
                        for n, row in enumerate(large):
                            k = at[row]
                            for ups in itertools.product(*[range(last[n, c] - own[n, c] + 1) for c in range(min(cuts[k], hi - lo))]):
                                cell = 0
                                for c, up in enumerate(ups):
                                    cell = cell * (1 << 20) + int(own[n, c]) + up + (1 << 19)
                                out.append((ids[k], labels[k], dims, b, cell, sum((up > 0) << c for c, up in enumerate(ups)), weights[k], data[row]))
                columns = list(zip(*out, strict=True)) if out else [[]] * 8
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["vec_id", "label", "dims", "block", "cell", "up", "weight", "data"])

    return run


def linked_pairs(raw: np.ndarray, cosine: float, block: int, axes: int, only: int = -1, meets=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the rows whose cosine is at least `cosine`, each once: all of them, or those of which
    `only` is the first block within its budget. meets(i, j) says which pairs are to be looked at."""
    x = unit(raw)
    dims = x.shape[1]
    y, blocks, total = x @ rotation(dims), _blocks(dims, block), 2 - 2 * cosine + SLACK
    budget = [total * (hi - lo) / dims for lo, hi in blocks]
    for b in range(len(blocks)) if only < 0 else [only]:
        lo, hi = blocks[b]
        for i, j in grid_pairs(y[:, lo:hi], math.sqrt(budget[b]), axes):
            if meets is not None:
                at = meets(i, j)
                i, j = i[at], j[at]
            near = ((y[i, lo:hi] - y[j, lo:hi]) ** 2).sum(1) <= budget[b]
            i, j = i[near], j[near]
            good = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            i, j = i[good], j[good]
            first = np.ones(len(i), bool)
            for e, (begin, end) in enumerate(blocks[:b]):
                first &= ((y[i, begin:end] - y[j, begin:end]) ** 2).sum(1) > budget[e]
            yield i[first], j[first]


def _pairs(cosine: float, block: int, axes: int, kind: str):
    """Link counts, and the links found in one tile of a cell as stars around their smallest ids. A pair is found in
    the cell that along each axis is the upper one of its two: there, no axis has both beyond their own cell."""

    def of(rows: list[tuple]) -> tuple[list, list]:
        dims, b, i, j = rows[0][1], rows[0][2], rows[0][4], rows[0][5]
        if len(rows) < 2:
            return [], []
        tile, ids, up, weight = (np.array([r[k] for r in rows]) for k in (6, 7, 8, 9))
        raw = np.frombuffer(b"".join(r[10] for r in rows), kind).reshape(len(rows), dims)
        counts = np.zeros(len(rows), np.int64)
        parent: dict[int, int] = {}

        def root(a: int) -> int:
            while parent.setdefault(a, a) != a:
                parent[a] = a = parent[parent[a]]
            return a

        meets = None if i == j and b < 0 else lambda p, q: ((up[p] & up[q]) == 0) & ((tile[p] != tile[q]) if i != j else True)
        for p, q in linked_pairs(raw, cosine, block, axes, b, meets):
            np.add.at(counts, p, weight[q])
            np.add.at(counts, q, weight[p])
            for v, w in zip(ids[p].tolist(), ids[q].tolist(), strict=True):
                rv, rw = root(v), root(w)
                parent[max(rv, rw)] = min(rv, rw)
        forest = [(v, r) for v in parent if (r := root(v)) != v]
        some = np.flatnonzero(counts)
        return list(zip(ids[some].tolist(), counts[some].tolist(), strict=True)), forest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def out(rows):
            counts, forest = of(rows)
            columns = [[v for v, _ in counts] + [v for v, _ in forest], [None] * len(counts) + [w for _, w in forest], [n for _, n in counts] + [0] * len(forest)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "n"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][:6] != row[:6]:
                    yield out(group)
                    group = []
                group.append(row)
        if group:
            yield out(group)

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, axes: int = AXES, tile: int = TILE) -> DataFrame:
    """One row per row of vectors(vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors are compared when their labels are equal and not null and their lengths are equal.
    Null and zero vectors, and those that hold null or non-finite components, link with nothing, nor do
    rows without vec_id (component null, kept false). Rows that repeat a vec_id are one node whose
    equal vectors are no links, and whose other vectors' links add up; other columns are ignored; an empty table gives no rows.
    """
    kind = "f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<float>" if kind == "f4" else "array<double>").alias("v"))
    # cast keeps NaN and infinities; x - x = 0 holds of finite numbers only
    sound = F.forall("v", lambda x: F.coalesce(x - x == 0, F.lit(False))) & F.exists("v", lambda x: x != 0)
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    # equal vectors of a label, by 96 bits of hashes, are a class
    keyed = good.select("vec_id", "label", F.xxhash64("v").alias("x"), F.hash("v").alias("y"), "v")
    same = ["label", "x", "y"]
    classes = written(keyed.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("weight")), "classes")
    member = written(keyed.select("vec_id", *same).join(classes, same).groupBy("vec_id").agg(F.collect_set(F.struct("rep", "weight")).alias("of")), "members")
    reps = keyed.join(classes.withColumnRenamed("rep", "vec_id"), ["vec_id", *same]).dropDuplicates(["vec_id", *same])
    # at most one label in `tile` vectors is large
    large = classes.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > tile)
    large = large.select("label", F.least(F.ceil(F.log(F.col("n") / tile) / math.log(4)), F.lit(MOST_CUTS)).cast("int").alias("cuts"))
    source = reps.join(F.broadcast(large), "label", "left").select("vec_id", "label", "v", "weight", F.coalesce("cuts", F.lit(0)).alias("cuts"))
    spread = written(source.mapInArrow(_prepare(cosine, block, kind), "vec_id long, label long, dims int, block int, cell long, up int, weight long, data binary"), "cells")
    keys = ["label", "dims", "block", "cell"]
    sizes = spread.groupBy(*keys).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    tiled = (
        spread.join(sizes, keys)
        .withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(*keys, F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "tile", "vec_id", "up", "weight", "data")
        .repartition(*keys, "i", "j")
        .sortWithinPartitions(*keys, "i", "j", "vec_id")
    )
    found = written(tiled.mapInArrow(_pairs(cosine, block, axes, kind), "a long, b long, n long"), "links")
    # classes that share a vec_id are one node
    shared = member.filter(F.size("of") > 1).select(F.explode("of.rep").alias("a"), F.array_min("of.rep").alias("b"))
    component = connected(found.filter("b is not null").select("a", "b").union(shared))
    of_rep = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    each = member.select("vec_id", F.array_min("of.rep").alias("least"), F.explode("of").alias("c")).select("vec_id", "least", "c.rep", "c.weight")
    counts = each.join(of_rep, "rep", "left").groupBy("vec_id", "least").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    drop_written(spread)
    known = counts.join(component.withColumnRenamed("node", "least"), "least", "left").withColumn("component", F.coalesce("component", "least"))
    return rows.select("vec_id").join(known, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id, vec_id AS r FROM e UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(max(n.n), 0)::BIGINT AS n_links, min(r) AS component_id, e.vec_id = min(r) AS kept
FROM e JOIN reach ON reach.vec_id = e.vec_id LEFT JOIN n ON n.a = e.vec_id GROUP BY e.vec_id
"""
