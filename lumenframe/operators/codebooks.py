"""Product quantisation: all codebooks trained by one aggregate a round, searched by tables of distances; frames by assignment to centres."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import r6


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows; they have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _codes(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """[vector, part]: the nearest centre of each piece, the first of equals."""
    parts, _, width = books.shape
    pieces = x.reshape(len(x), parts, width)
    return np.stack([((pieces[:, p, None, :] - books[p]) ** 2).sum(-1).argmin(1) for p in range(parts)], 1)


def trained(v: DataFrame, parts: int = 8, centres: int = 16, rounds: int = 10) -> np.ndarray | None:
    """Codebooks [part, centre, width] of v(vec_id, embedding) by Lloyd's rounds, or None of an empty table.

    A round is one pass: tasks assign the pieces of their vectors in all parts and give sums by (part, centre), which are the rows that
    are shuffled and collected: parts x centres of them, whatever v holds. The first centres are the vectors of smallest hash; an empty one stays.
    """
    v = v.filter("embedding is not null").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    first = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(centres).toPandas()
    if first.empty:
        return None
    start = np.stack(first["embedding"].to_list())
    if start.shape[1] % parts:
        raise ValueError(f"{start.shape[1]} dimensions don't divide into {parts} parts")
    start = start[np.arange(centres) % len(start)]
    books = start.reshape(centres, parts, -1).transpose(1, 0, 2).copy()

    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(books), np.zeros(books.shape[:2], int)
            for batch in batches:
                if not len(batch):
                    continue
                x = _matrix(batch.column(0))
                code = _codes(x, books)
                pieces = x.reshape(len(x), books.shape[0], -1)
                for p in range(books.shape[0]):
                    np.add.at(total[p], code[:, p], pieces[:, p])
                    n[p] += np.bincount(code[:, p], minlength=books.shape[1])
            part, centre = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(centre, pa.int32()), pa.array(n[part, centre], pa.int64()), pa.array(list(total[part, centre]), pa.list_(pa.float64()))], ["part", "centre", "n", "sums"])

        width = books.shape[2]
        found = v.select("embedding").mapInArrow(sums, "part int, centre int, n long, sums array<double>").groupBy("part", "centre").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)]).toPandas()
        moved = books.copy()
        moved[found["part"], found["centre"]] = found[[f"s{k}" for k in range(width)]].to_numpy() / found[["n"]].to_numpy()
        still = np.abs(moved - books).max() < 1e-9
        books = moved
        if still:
            break
    return books


def pq_topk(v: DataFrame, queries: DataFrame, books: np.ndarray, top_k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, sim) by the distance of the query to the vector's code, 1 / (1 + d). A task keeps the best of each query
    for its batch, so rows that are shuffled don't grow with v times queries. queries(query_id, q) is a small, stated set."""
    asked = queries.toPandas().sort_values("query_id")
    q = np.stack([np.asarray(x, float) for x in asked["q"]])
    parts, _, width = books.shape
    tables = ((q.reshape(len(q), parts, 1, width) - books) ** 2).sum(-1)  # [query, part, centre]
    ids = asked["query_id"].to_numpy()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            code, own = _codes(_matrix(batch.column(1)), books), batch.column(0).to_numpy()
            rows = []
            for k in range(len(ids)):
                d = np.round(tables[k][np.arange(parts), code].sum(1), 9)
                at = np.lexsort((own, d))[:top_k]
                rows.append((np.full(len(at), ids[k]), own[at], d[at]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], ["query_id", "vec_id", "d"])

    near = v.filter("embedding is not null").select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: x.cast("double")).alias("e")).mapInArrow(best, "query_id long, vec_id long, d double")
    w = Window.partitionBy("query_id").orderBy("d", "vec_id")
    return near.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= top_k).select("query_id", "rank", "vec_id", r6(1 / (1 + F.col("d"))).alias("sim"))


def gated_search(v: DataFrame, queries: DataFrame, parts: int = 8, bits: int = 4, min_train: int = 100, top_k: int = 5) -> DataFrame:
    """Codes where there are at least max(min_train, 2^bits) vectors to train on, else the exact inner product; `kind` says which (pq, flat)."""
    from .vector import tiered_exact

    if v.limit(max(min_train, 2**bits)).count() >= max(min_train, 2**bits):
        return pq_topk(v, queries, trained(v, parts, 2**bits), top_k).withColumn("kind", F.lit("pq"))
    return tiered_exact(v.withColumn("tier", F.lit("CANDIDATE")), queries, top_k).select("query_id", "rank", "vec_id", "sim", F.lit("flat").alias("kind"))


def recall_at(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query, the share of the exact vectors that were found."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def assigned(cost: np.ndarray) -> np.ndarray:
    """For each row of cost (no more rows than columns) a column of its own, at the least sum: one shortest augmenting path a row."""
    rows, columns = cost.shape
    u, v = np.zeros(rows + 1), np.zeros(columns + 1)
    of = np.zeros(columns + 1, int)  # row (from 1) of a column; column 0 holds the row to be placed
    for i in range(1, rows + 1):
        of[0], at = i, 0
        least, seen, way = np.full(columns + 1, np.inf), np.zeros(columns + 1, bool), np.zeros(columns + 1, int)
        while of[at]:
            seen[at] = True
            open_ = np.flatnonzero(~seen[1:]) + 1
            reduced = cost[of[at] - 1, open_ - 1] - u[of[at]] - v[open_]
            shorter = reduced < least[open_]
            least[open_[shorter]], way[open_[shorter]] = reduced[shorter], at
            after = int(open_[least[open_].argmin()])
            step = least[after]
            u[of[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            at = after
        while at:
            of[at], at = of[way[at]], way[at]
    out = np.zeros(rows, int)
    for j in np.flatnonzero(of[1:]) + 1:
        out[of[j] - 1] = j - 1
    return out


def _lloyd(x: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """k centres: the first vector, then always the one farthest from those before it; then Lloyd's rounds."""
    centres = x[:1]
    while len(centres) < k:
        far = ((x[:, None] - centres[None]) ** 2).sum(-1).min(1)
        centres = np.vstack([centres, x[far.argmax()]])
    for _ in range(rounds):
        near = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        moved = np.stack([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(k)])
        if np.abs(moved - centres).max() < 1e-12:
            break
        centres = moved
    return centres


def diverse_frames(f: DataFrame, k: int = 8) -> DataFrame:
    """(video_id, frame_idx, is_fill): k frames a video that stand for k centres of its vectors, each for one, at the least sum of distances.
    Candidates are every max(3, n / 2k)-th frame and the last; those without a vector don't count. Where there are fewer
    than k, frames at even steps among the others fill up. A video is one group: k x candidates distances, at most about 2k or a third of its frames."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("frame_idx")
        every = g["frame_idx"].to_numpy()
        step = max(3, len(g) // (2 * k))
        at = sorted({*range(0, len(g), step), len(g) - 1})
        some = g.iloc[at]
        some = some[some["e"].notna()]
        picked = np.empty(0, int)
        if len(some):
            x = np.stack(some["e"].to_list())
            centres = _lloyd(x, min(k, len(x)))
            picked = some["frame_idx"].to_numpy()[assigned(np.linalg.norm(centres[:, None] - x[None], axis=-1))]
        rest = np.setdiff1d(every, picked)
        need = min(k - len(picked), len(rest))
        fill = rest[[i * len(rest) // need for i in range(need)]] if need > 0 else np.empty(0, int)
        out = pd.DataFrame({"frame_idx": [*picked, *fill], "is_fill": [False] * len(picked) + [True] * len(fill)})
        return out.assign(video_id=g["video_id"].iloc[0])[["video_id", "frame_idx", "is_fill"]]

    return f.select("video_id", "frame_idx", F.transform("clip_embedding", lambda x: x.cast("double")).alias("e")).groupBy("video_id").applyInPandas(one, "video_id long, frame_idx long, is_fill boolean")
