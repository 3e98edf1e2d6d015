"""Coarse-to-fine retrieval: scenes by centroid, the frames of the best of them, then PageRank over their graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import by_video, cosine, edge_weight, motion_similarity, norm, r6, temporal_proximity
from ..sources.shared import written
from .graph import _SIDE, TILE, cosines, ppr_seed, unit_vectors
from .ranking import pagerank_rounds
from .retrieval import scene_centroids, with_similarity

MODES = ("all", "threshold", "rep_only")


def valid_queries(queries: DataFrame, on_invalid: str = "raise") -> DataFrame:
    """queries(query_id, q) with a direction. One that is null or all but zero raises, or with "drop" has no results."""
    sound = F.coalesce(norm(F.col("q")) >= 1e-8, F.lit(False))
    if on_invalid == "drop":
        return queries.filter(sound)
    return queries.filter(F.when(sound, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("Invalid query embedding: query "), F.col("query_id").cast("string"))).cast("boolean")))


def check_graph_mode(of_index: str | None, of_query: str) -> None:
    """An index answers queries of the graph mode that it was built with."""
    if (of_index or "flat") != of_query:
        raise ValueError(f"graph mode {of_query} of the query is not {of_index or 'flat'} of the index")


def shortlisted(n: DataFrame, queries: DataFrame, scene: str = "label", width: int | None = None, floor: float = 0.2) -> DataFrame:
    """J16, T7 and the fall back to all scenes: n(video_id, frame_idx, clip_embedding, scene, ...) with each query, its
    similarity `sem` and `survives`: a vector, and a scene among the best max(4, ceil(sqrt(scenes))) by centroid. Where these hold nothing
    at least as similar as `floor`, all scenes survive."""
    centroids = scene_centroids(n, scene)
    all_of = Window.partitionBy("video_id", "query_id")
    ranked = centroids.crossJoin(F.broadcast(queries)).withColumn("score", r6(cosine(F.col("centroid"), F.col("q"))))
    most = F.lit(width) if width else F.greatest(F.lit(4), F.ceil(F.sqrt(F.count(F.lit(1)).over(all_of))))
    best = ranked.withColumn("place", F.row_number().over(all_of.orderBy(F.desc("score"), "scene_id"))).withColumn("most", most).select("video_id", "query_id", F.col("scene_id").alias(scene), (F.col("place") <= F.col("most")).alias("listed"))
    sim = with_similarity(n.filter(F.col("clip_embedding").isNotNull()), queries).join(best, ["video_id", "query_id", scene], "left")
    reached = F.max(F.when(F.col("listed"), F.col("sem"))).over(all_of)
    return sim.withColumn("survives", F.col("listed").isNotNull() & (F.col("listed") | F.coalesce(reached < floor, F.lit(True)))).drop("listed")


def gated(sim: DataFrame, scene: str = "label", tau: float = 0.015) -> DataFrame:
    """shortlisted() rows with the branch of their video and query and its anchor, the most similar survivor. The
    anchor's scene has to lead the next one by more than tau for a shortcut; one scene alone always does."""
    all_of = Window.partitionBy("video_id", "query_id")
    in_scene = Window.partitionBy("video_id", "query_id", scene).orderBy(F.desc("survives"), F.desc("sem"), "frame_idx")
    firsts = sim.withColumn("of_scene", F.when(F.col("survives"), F.row_number().over(in_scene)))
    heads = F.sort_array(F.collect_list(F.when(F.col("of_scene") == 1, F.struct((-F.col("sem")).alias("less"), F.col(scene).cast("long").alias("scene"), F.col("frame_idx").alias("frame")))).over(all_of))
    margin = F.get(heads, F.lit(1))["less"] - F.get(heads, F.lit(0))["less"]
    return firsts.select(*sim.columns, F.get(heads, F.lit(0))["frame"].alias("anchor"), F.coalesce(margin, F.lit(float("inf"))).alias("margin")).withColumn("branch", F.when(F.col("margin") > tau, "shortcut").otherwise("descend"))


def pools(gate: DataFrame, scene: str = "label", window: int = 30) -> DataFrame:
    """The survivors of descending queries and the frames within `window` of their anchor; `is_rep` marks each scene's most similar frame."""
    pool = gate.filter((F.col("branch") == "descend") & (F.col("survives") | (F.abs(F.col("frame_idx") - F.col("anchor")) <= window)))
    best = Window.partitionBy("video_id", "query_id", scene).orderBy(F.desc("sem"), "frame_idx")
    return pool.withColumn("is_rep", F.row_number().over(best) == 1)


def _sides(u: DataFrame, v: DataFrame) -> DataFrame:
    """Pairs of frames of a video of different scenes that some query has in its pool, with these queries. A pair is made and
    weighed once, for however many queries."""
    pairs = u.select("video_id", "score_range", *[F.col(c).alias(f"u_{c}") for c in [*_SIDE, "scene", "queries"]]).join(v.select("video_id", *[F.col(c).alias(f"v_{c}") for c in [*_SIDE, "scene", "queries"]]), "video_id")
    return pairs.filter("u_frame_idx < v_frame_idx and u_scene != v_scene and arrays_overlap(u_queries, v_queries)")


def cross_scene_edges(pool: DataFrame, n: DataFrame, mode: str, percentile: float = 75.0, scene: str = "label") -> DataFrame:
    """Edges (video_id, query_id, src, dst, weight) between frames of a pool in different scenes: `all` of them, those whose weight
    reaches the pool's percentile (`threshold`; weights to nine digits, linear interpolation), or those between the scenes' most similar frames (`rep_only`)."""
    if mode not in MODES:
        raise ValueError(f"unknown cross-scene mode {mode}")
    members = pool.filter("is_rep") if mode == "rep_only" else pool
    of_frame = members.groupBy("video_id", "frame_idx").agg(F.collect_set("query_id").alias("queries"))
    side = n.select("video_id", "score_range", *_SIDE, F.col(scene).alias("scene")).join(of_frame, ["video_id", "frame_idx"])
    pairs = _sides(side, side)
    motion = motion_similarity(F.col("u_action_score"), F.col("v_action_score"), F.col("score_range"))
    weight = edge_weight(F.lit("fully_connected"), F.greatest(F.lit(0.0), cosine(F.col("u_clip_embedding"), F.col("v_clip_embedding"))), motion, temporal_proximity(F.col("u_timestamp") - F.col("v_timestamp")))
    edges = pairs.select("video_id", F.explode(F.array_intersect("u_queries", "v_queries")).alias("query_id"), F.col("u_frame_idx").alias("src"), F.col("v_frame_idx").alias("dst"), F.round(weight, 9).alias("weight"))
    if mode == "threshold":
        cut = F.percentile("weight", F.lit(percentile / 100))
        edges = edges.join(edges.groupBy("video_id", "query_id").agg(cut.alias("cut")), ["video_id", "query_id"]).filter("weight >= cut").drop("cut")
    return edges


def induced(edges: DataFrame, pool: DataFrame, scene: str = "label") -> DataFrame:
    """The index's edges inside scenes, for every query that has both ends in its pool."""
    of_frame = pool.groupBy("video_id", "frame_idx").agg(F.collect_set("query_id").alias("queries"), F.first(scene).alias("scene"))
    u, v = (of_frame.select("video_id", F.col("frame_idx").alias(end), F.col("queries").alias(f"q_{end}"), F.col("scene").alias(f"s_{end}")) for end in ("src", "dst"))
    inside = edges.select("video_id", "src", "dst", "weight").join(u, ["video_id", "src"]).join(v, ["video_id", "dst"]).filter("s_src = s_dst")
    return inside.select("video_id", F.explode(F.array_intersect("q_src", "q_dst")).alias("query_id"), "src", "dst", F.round("weight", 9).alias("weight"))


#: A frame without a scene. Scenes that can be shortlisted are numbers from 0 on.
_NONE = -(2**62)


def _tied_ranks(x: np.ndarray) -> np.ndarray:
    """Average-tied ranks in 0..1; one value alone is 0.5."""
    if len(x) < 2:
        return np.full(len(x), 0.5)
    _, at, count = np.unique(x, return_inverse=True, return_counts=True)
    first = np.cumsum(count) - count
    return (first + (count - 1) / 2)[at] / (len(x) - 1)


def _ranked_links(link: np.ndarray, seed: np.ndarray, damping: float, rounds: int) -> np.ndarray:
    """G5 on a dense graph of one pool: the seeds take the mass of nodes without links."""
    s = np.maximum(seed, 0)
    s = s / s.sum() if s.sum() > 0 else np.full(len(s), 1 / len(s))
    out = link.sum(axis=1)
    step = np.divide(link, out[:, None], out=np.zeros_like(link), where=out[:, None] > 0).T
    x, hangs = s, out == 0
    for _ in range(rounds):
        x = damping * (step @ x + x[hangs].sum() * s) + (1 - damping) * s
    return x


def _of_videos(n: DataFrame, queries: DataFrame, edges: DataFrame, mode: str, percentile: float, scene: str, width: int | None, floor: float, tau: float, window: int, top_k: int, weight: float, damping: float, rounds: int) -> DataFrame:
    """scene_sparse_retrieve() of videos of up to TILE frames, each in one group: its vectors are sent once, for all queries, and neither
    similarities by query nor pairs of frames are shuffled. The queries are the small set that they are everywhere."""
    asked = sorted((r.query_id, np.array([float(x) for x in r.q])) for r in queries.collect())
    ids = [k for k, _ in asked]
    wanted = np.array([q / np.sqrt(np.einsum("i,i->", q, q)) for _, q in asked])

    def found(g: dict, e: np.ndarray, raw: np.ndarray, inside: np.ndarray, cross: np.ndarray, frames: np.ndarray, q: np.ndarray):
        sem, of, conf = cosines(e, q[None])[:, 0], g["label"], g["conf"]
        scenes = [(k, raw[of == k].sum(axis=0) / (of == k).sum()) for k in np.unique(of[of >= 0])]
        lengths = [np.sqrt(np.einsum("i,i->", c, c)) for _, c in scenes]
        near = sorted((-round(float(np.einsum("i,i->", c, q) / m) if m > 0 else 0.0, 6), k) for (k, c), m in zip(scenes, lengths, strict=True))
        most = width or max(4, int(np.ceil(np.sqrt(len(near)))))
        listed = np.isin(of, [k for _, k in near[:most]])
        survives = listed if listed.any() and sem[listed].max() >= floor else of >= 0
        if not survives.any():
            return "shortcut", np.zeros(0, int), np.zeros(0)
        live = np.flatnonzero(survives)
        by_best = live[np.lexsort((frames[live], -sem[live]))]
        heads = by_best[np.unique(of[by_best], return_index=True)[1]]
        heads = heads[np.lexsort((of[heads], -sem[heads]))]
        if len(heads) < 2 or sem[heads[0]] - sem[heads[1]] > tau:
            return "shortcut", live, sem[live]
        pool = np.flatnonzero(survives | (np.abs(frames - frames[heads[0]]) <= window))
        link = np.where(of[pool][:, None] != of[pool], cross[np.ix_(pool, pool)], 0.0)
        upper = np.triu(of[pool][:, None] != of[pool], 1)
        some = of[pool] != _NONE
        upper &= some[:, None] & some
        if mode == "threshold" and upper.any():
            cut = np.sort(link[upper])
            at = (len(cut) - 1) * percentile / 100
            low = int(at)
            upper &= link >= cut[low] + (cut[min(low + 1, len(cut) - 1)] - cut[low]) * (at - low)
        elif mode == "rep_only":
            ordered = pool[np.lexsort((frames[pool], -sem[pool]))]
            rep = np.isin(pool, ordered[np.unique(of[ordered], return_index=True)[1]])
            upper &= rep[:, None] & rep
        link = np.where(upper, link, 0.0)
        link = link + link.T + np.where((of[pool][:, None] == of[pool]) & some[:, None], inside[np.ix_(pool, pool)], 0.0)
        seed = weight * _tied_ranks(sem[pool]) + (1 - weight) * _tied_ranks(conf[pool])
        return "descend", pool, _ranked_links(link, seed, damping, rounds)

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.filter(left["clip_embedding"].is_valid()) if len(left) else left
        out = {c: [] for c in ("video_id", "query_id", "branch", "frame_idx", "value")}
        if len(left):
            left = left.sort_by("frame_idx")
            frames = left["frame_idx"].to_numpy()
            g = {"label": left[scene].fill_null(_NONE).to_numpy(), "conf": left["codec_conf"].to_numpy()}
            e = unit_vectors(left["clip_embedding"])
            raw = np.array(left["clip_embedding"].to_pylist(), float)
            score, span = left["action_score"].to_numpy(), left["score_range"][0].as_py()
            motion = np.ones((len(e), len(e))) if span == 0 else np.maximum(0.0, 1 - np.abs(score[:, None] - score) / span)
            cross = np.round(0.4 * np.maximum(0.0, cosines(e, e)) + 0.3 * motion, 9)
            inside = np.zeros(cross.shape)
            src, dst, w = (right[c].to_numpy() for c in ("src", "dst", "weight"))
            sound = np.isin(src, frames) & np.isin(dst, frames) & (w > 0)
            a, b, w = np.searchsorted(frames, src[sound]), np.searchsorted(frames, dst[sound]), np.round(w[sound], 9)
            np.add.at(inside, (a, b), w)
            np.add.at(inside, (b, a), w)
            for k, q in zip(ids, wanted, strict=True):
                branch, at, value = found(g, e, raw, inside, cross, frames, q)
                # a few more than asked for, as values that differ after the sixth digit tie
                keep = np.sort(np.lexsort((frames[at], -np.round(value, 6)))[: top_k + 3])
                out["video_id"] += [left["video_id"][0].as_py()] * len(keep)
                out["query_id"] += [k] * len(keep)
                out["branch"] += [branch] * len(keep)
                out["frame_idx"] += frames[at[keep]].tolist()
                out["value"] += value[keep].tolist()
        return pa.table(out, schema=pa.schema([("video_id", pa.int64()), ("query_id", pa.int64()), ("branch", pa.string()), ("frame_idx", pa.int64()), ("value", pa.float64())]))

    side = n.select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.col(scene).cast("long").alias(scene), F.col("codec_conf").cast("double").alias("codec_conf"), F.col("action_score").cast("double").alias("action_score"), F.col("score_range").cast("double").alias("score_range"), "clip_embedding")
    links = edges.select(F.col("video_id").alias("video_id"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"))
    ranked = side.groupBy("video_id").cogroup(links.groupBy("video_id")).applyInArrow(one, "video_id long, query_id long, branch string, frame_idx long, value double")
    return ranked.select("video_id", "query_id", "branch", "frame_idx", r6(F.col("value")).alias("score"))


def scene_sparse_retrieve(
    n: DataFrame, queries: DataFrame, edges: DataFrame, mode: str = "rep_only", percentile: float = 75.0, scene: str = "label", width: int | None = None,
    floor: float = 0.2, tau: float = 0.015, window: int = 30, top_k: int = 5, weight: float = 0.5, damping: float = 0.5, ranker=None, rounds: int | None = None,
) -> DataFrame:
    """(video_id, query_id, branch, rank, frame_idx, score) of nodes n (graph.nodes() rows with codec_conf and a scene).

    Shortcuts return the most similar survivors. Queries that descend rank their pool by PageRank from seeds in the pool, over the edges inside
    scenes and those of `mode` between them. Ties go to the earlier frame. `ranker(seeds, edges, damping)` replaces the
    loop of joins; both take any number of queries. A query without direction raises. With a number of `rounds`, videos of up to TILE frames are
    one group each, and only larger ones go by joins; the results are the same.
    """
    if mode not in MODES:
        raise ValueError(f"unknown cross-scene mode {mode}")
    queries, best = valid_queries(queries), Window.partitionBy("video_id", "query_id").orderBy(F.desc("score"), "frame_idx")

    def joined(n: DataFrame, edges: DataFrame) -> DataFrame:
        found = gated(shortlisted(n, queries, scene, width, floor), scene, tau)
        gate = written(found.select("video_id", "query_id", "frame_idx", scene, "sem", "codec_conf", "survives", "anchor", "branch"), "gate")
        pool = pools(gate, scene, window)
        linked = induced(edges, pool, scene).unionByName(cross_scene_edges(pool, n, mode, percentile, scene))
        seeds = ppr_seed(pool, weight=weight).select("video_id", "query_id", "frame_idx", "seed")
        by_rounds = ranker or (lambda s, e, d: pagerank_rounds(s, e, ["video_id", "query_id"], "seed", d))
        descended = by_rounds(seeds, linked, damping).select("video_id", "query_id", "frame_idx", r6(F.col("pagerank")).alias("score"), F.lit("descend").alias("branch"))
        short = gate.filter("branch = 'shortcut' and survives").select("video_id", "query_id", "frame_idx", r6(F.col("sem")).alias("score"), "branch")
        return short.unionByName(descended)

    if rounds is None:
        found = joined(n, edges)
    else:
        large = F.broadcast(written(n.groupBy("video_id").count().filter(F.col("count") > TILE).select("video_id"), "large"))
        some = not large.isEmpty()
        rest = (lambda df: df.join(large, "video_id", "left_anti")) if some else (lambda df: df)
        found = _of_videos(rest(n), queries, rest(edges), mode, percentile, scene, width, floor, tau, window, top_k, weight, damping, rounds)
        if some:
            more = joined(n.join(large, "video_id", "left_semi"), edges.join(large, "video_id", "left_semi"))
            found = found.unionByName(more.select(*found.columns))
    return found.withColumn("rank", F.row_number().over(best).cast("bigint")).filter(F.col("rank") <= top_k).select("video_id", "query_id", "branch", "rank", "frame_idx", "score")


#: Numbers in a table of vectors up to which every task holds it; frames meet a larger one in a shuffle and carry its rows.
A_TABLE = 4_000_000
#: Videos whose pools are ranked at once.
AT_ONCE = 512
_REPS = "video_id long, query_id long, branch string, scene_id int, frame_idx long, value double"


def _padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of numbers as rows, with zeros for what they lack; which numbers they have, and their sizes (0 for null)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, values = column.value_lengths().fill_null(0).to_numpy(False).astype(int), column.flatten()
    held = np.arange(width) < sizes[:, None]
    x = np.zeros(held.shape)
    x[held] = values.to_numpy(False)
    if values.null_count:
        held[held] = values.is_valid().to_numpy(False)
        x[~held] = 0.0
    return x, held, sizes


def _likeness(e: np.ndarray, sizes: np.ndarray, sound: np.ndarray, asked: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """F1 of every vector and query; 0 where the vector lacks a number or has another length than the query. Not a matrix product: see graph.cosines()."""
    norms = np.sqrt(np.einsum("ik,ik->i", e, e))[:, None] * np.sqrt(np.einsum("qk,qk->q", asked, asked))
    cos = np.divide(np.einsum("ik,qk->iq", e, asked), norms, out=np.zeros_like(norms), where=(norms > 0) | np.isnan(norms))
    return np.where(sound[:, None] & (sizes[:, None] == lengths), cos, 0.0)


def _merged(g: dict) -> dict:
    """Rows of scenes (a frame is one, too) to one row a scene, in order of videos and scenes: sums and counts of vectors, and of each query the most similar frame, the
    earlier of equals. `at` is that frame's vector among `e`."""
    order = np.lexsort((g["scene"], g["video"]))
    video, scene = g["video"][order], g["scene"][order]
    first = np.flatnonzero(np.r_[True, (video[1:] != video[:-1]) | (scene[1:] != scene[:-1])])
    of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
    sem = g["sem"][order]
    top = np.maximum.reduceat(sem, first)
    frame = np.where(sem == top[of], g["frame"][order], np.iinfo(np.int64).max)
    row = np.where(frame == np.minimum.reduceat(frame, first)[of], np.arange(len(order))[:, None], len(order))
    row, query = order[np.minimum.reduceat(row, first)], np.arange(sem.shape[1])
    best = {c: g[c][row, query] for c in ("frame", "conf", "action", "at")}
    sums = {c: np.add.reduceat(g[c][order], first) for c in ("sum", "count")}
    return {"video": video[first], "scene": scene[first], "span": g["span"][order][first], "size": np.maximum.reduceat(g["size"][order], first), "sem": top, "e": g["e"], **best, **sums}


def _joined(a: dict, b: dict) -> dict:
    return {c: np.concatenate([a[c], b[c] + len(a["e"]) if c == "at" else b[c]]) for c in a}


def _some(g: dict, rows: np.ndarray) -> dict:
    """Rows of scenes with the vectors that they refer to."""
    at, place = np.unique(g["at"][rows], return_inverse=True)
    return {**{c: x[rows] for c, x in g.items() if c != "e"}, "at": place.reshape(g["at"][rows].shape), "e": g["e"][at]}


def _percent(x: np.ndarray, real: np.ndarray) -> np.ndarray:
    """W6 of every row's real values."""
    less, same = (f(x[..., None, :], x[..., :, None]) & real[..., None, :] for f in (np.less, np.equal))
    n = real.sum(axis=-1, keepdims=True)
    return np.where(n > 1, (less.sum(axis=-1) + (same.sum(axis=-1) - 1) / 2) / np.maximum(n - 1, 1), 0.5)


def _shortlisted_scenes(g: dict, asked: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each video and query the places of the best scenes by centroid, and how many are real."""
    known = g["count"] > 0
    centre = np.divide(g["sum"], g["count"], out=np.zeros_like(g["sum"]), where=known)
    sound = (known | (np.arange(known.shape[1]) >= g["size"][:, None])).all(axis=1)
    score = np.round(_likeness(centre, g["size"], sound, asked, lengths), 6) + 0.0
    score = np.where(np.isnan(score), np.inf, score)
    _, first, n = np.unique(g["video"], return_index=True, return_counts=True)
    slots = np.minimum(first[:, None] + np.arange(width), len(score) - 1)
    return np.stack([np.lexsort((g["scene"], -score[:, k], g["video"]))[slots] for k in range(len(asked))], axis=1), n


def _descended(g: dict, slots: np.ndarray, n: np.ndarray, floor: float, margin: float, weight: float, damping: float, rounds: int) -> tuple[np.ndarray, ...]:
    """Branch and value of the pools at `slots`(video, query, place): a pool's frames are all linked, and all pools do their rounds at once."""
    query = np.arange(slots.shape[1])[:, None]
    real = np.broadcast_to((np.arange(slots.shape[2]) < n[:, None])[:, None], slots.shape)
    sem, conf, action, at = (g[c][slots, query] for c in ("sem", "conf", "action", "at"))
    ordered = -np.sort(-np.where(real, sem, -np.inf), axis=-1)
    best, second = ordered[..., 0], ordered[..., 1] if slots.shape[2] > 1 else np.full(slots.shape[:2], -np.inf)
    lead = np.where(np.isinf(best), np.inf, best - np.where(np.isinf(best), 0.0, second))
    branch = np.where(best < floor, "fallback", np.where(lead >= margin, "shortcut", "descend"))

    seed = np.where(real, weight * _percent(sem, real) + (1 - weight) * _percent(conf, real), 0.0)
    mass, count = seed.sum(axis=-1, keepdims=True), real.sum(axis=-1, keepdims=True)
    seed = np.where(mass > 0, seed / np.where(mass > 0, mass, 1), real / count)
    e = g["e"][at]
    length = np.sqrt(np.einsum("...k,...k->...", e, e))[..., None]
    e = np.divide(e, length, out=np.zeros_like(e), where=(length > 0) | np.isnan(length))
    span = g["span"][slots[:, :1, :1]][..., None]
    motion = np.where(span == 0, 1.0, np.maximum(0.0, 1 - np.abs(action[..., :, None] - action[..., None, :]) / np.where(span == 0, 1.0, span)))
    link = 0.4 * np.maximum(0.0, np.einsum("vqik,vqjk->vqij", e, e)) + 0.3 * motion
    link = np.where(real[..., :, None] & real[..., None, :] & ~np.eye(slots.shape[2], dtype=bool) & (link > 0), link, 0.0)
    out = link.sum(axis=-1, keepdims=True)
    step, hangs = np.divide(link, out, out=np.zeros_like(link), where=out > 0), out[..., 0] == 0
    x = seed
    for _ in range(rounds):
        x = damping * (np.einsum("vqi,vqij->vqj", x, step) + (x * hangs).sum(axis=-1, keepdims=True) * seed) + (1 - damping) * seed
    return real, branch, np.where((branch == "descend")[..., None], x, np.where(np.isinf(sem), np.nan, sem))


def descend_reps(
    n: DataFrame, queries: DataFrame, vectors: DataFrame, width: int = 4, floor: float = 0.20, margin: float = 0.05, weight: float = 0.5, damping: float = 0.5, rounds: int = 30
) -> DataFrame:
    """G8 over one frame a scene: (video_id, query_id, branch, scene_id, frame_idx, score) of the most similar frames of the `width` best scenes by centroid. A query that
    descends ranks them by PageRank on all edges between them (J12, rep_only); otherwise the score is the similarity.

    n(video_id, frame_idx, label, vec_id, action_score, score_range, codec_conf) refer to vectors(vec_id, embedding). Frames are shuffled once, by video, and read in
    order of videos, in batches; what is kept of an unfinished video is a row a scene, so neither its length nor the number of videos and queries makes a group.
    """
    asked = queries.orderBy("query_id").collect()
    ids, size = [r.query_id for r in asked], vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    d = max(size["d"] or 0, 1)
    plain = [r.q is not None and 0 < len(r.q) <= d and None not in r.q for r in asked]
    wanted = np.array([[*map(float, r.q), *[0.0] * (d - len(r.q))] if ok else [0.0] * d for r, ok in zip(asked, plain, strict=True)]).reshape(-1, d)
    lengths = np.array([len(r.q) if ok else -1 for r, ok in zip(asked, plain, strict=True)])
    held_by = vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = n.filter(F.col("video_id").isNotNull() & (F.col("label") >= 0)).select(F.col("video_id").cast("long").alias("video_id"), F.col("frame_idx").cast("long").alias("frame_idx"), F.col("label").cast("int").alias("label"), F.col("vec_id").cast("long").alias("vec_id"), *[F.col(c).cast("double").alias(c) for c in ("action_score", "score_range", "codec_conf")])

    def parsed(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
        e, held, sizes = _padded(t["embedding"], d)
        whole = held.sum(axis=1) == sizes
        return e, held, sizes, whole, _likeness(e, sizes, whole, wanted, lengths)

    if size["n"] * d <= A_TABLE:
        t = held_by.toArrow().sort_by("vec_id")
        # one row more, without a vector, for frames that refer to none
        known = [np.concatenate([x, np.zeros((1, *x.shape[1:]), x.dtype)]) for x in parsed(t)]
        table = n.sparkSession.sparkContext.broadcast((t["vec_id"].to_numpy(), known))
    else:
        table = None
        rows = rows.join(held_by, "vec_id", "left")

    def of_batch(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        if table is None:
            return parsed(b)
        keys, known = table.value
        if not len(keys):
            return tuple(x[np.zeros(b.num_rows, int)] for x in known)
        key = b["vec_id"].fill_null(0).to_numpy(False)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        at = np.where((keys[at] == key) & b["vec_id"].is_valid().to_numpy(False), at, len(keys))
        return tuple(x[at] for x in known)

    def frames_of(b: pa.RecordBatch) -> dict:
        e, held, sizes, whole, sem = of_batch(b)
        one = lambda x: np.broadcast_to(x[:, None], sem.shape)
        col = lambda c: b[c].to_numpy(False)
        # a vector that holds a null counts for its scene's centroid, but is like no other
        alone = e if whole.all() else np.where(whole[:, None], e, 0.0)
        # in order, NaN is above all numbers
        near = np.where(np.isnan(sem), np.inf, sem)
        return {"video": col("video_id"), "scene": col("label"), "span": col("score_range"), "size": sizes, "sem": near, "frame": one(col("frame_idx")), "conf": one(col("codec_conf")), "action": one(col("action_score")), "at": one(np.arange(b.num_rows)), "sum": e, "count": held.astype(float), "e": alone}

    def finished(g: dict) -> Iterator[pa.RecordBatch]:
        listed = g["size"] > 0
        if not listed.any():
            return
        g = {c: x if c == "e" else x[listed] for c, x in g.items()}
        slots, scenes = _shortlisted_scenes(g, wanted, lengths, width)
        for begin in range(0, len(slots), AT_ONCE):
            s = slots[begin : begin + AT_ONCE]
            real, branch, value = _descended(g, s, scenes[begin : begin + AT_ONCE], floor, margin, weight, damping, rounds)
            v, q, _ = np.nonzero(real)
            yield pa.RecordBatch.from_arrays([pa.array(g["video"][s[real]]), pa.array(np.array(ids, np.int64)[q]), pa.array(branch[v, q]), pa.array(g["scene"][s[real]], pa.int32()), pa.array(g["frame"][s[real], q]), pa.array(value[real])], names=[c.strip().split(" ")[0] for c in _REPS.split(",")])

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if not b.num_rows or not ids:
                continue
            g = _merged(frames_of(b))
            g = _merged(_joined(rest, g)) if rest else g
            last = g["video"] == g["video"][-1]
            if not last.all():
                yield from finished({c: x if c == "e" else x[~last] for c, x in g.items()})
            rest = _some(g, last)
        if rest:
            yield from finished(rest)

    found = rows.repartition("video_id").sortWithinPartitions("video_id").mapInArrow(ranked, _REPS)
    return found.select("video_id", "query_id", "branch", "scene_id", "frame_idx", r6(F.col("value")).alias("score"))


#: Vectors of a video up to which its scenes are halved in one group; those of larger ones meet in shuffles.
A_VIDEO = 20_000


def _mean_cosine(e: np.ndarray, centre: np.ndarray) -> np.ndarray:
    lengths = np.sqrt(np.einsum("ik,ik->i", e, e)) * np.sqrt(np.einsum("k,k->", centre, centre))
    return np.divide(np.einsum("ik,k->i", e, centre), lengths, out=np.zeros(len(e)), where=lengths > 0)


def _halved(t: pa.Table) -> pa.Table:
    """scene_bimodality()'s sums of one video's scenes; vectors are of one length and finite."""
    t = t.sort_by([("scene_id", "ascending"), ("frame_idx", "ascending")])
    scenes, begin = np.unique(t["scene_id"].to_numpy(), return_index=True)
    every = t["e"].combine_chunks()
    every = (pa.concat_arrays(every.chunks) if isinstance(every, pa.ChunkedArray) else every).flatten().to_numpy(False).astype(float).reshape(len(t), -1)
    out = []
    for e in np.split(every, begin[1:]):
        n, centre = len(e), e.mean(axis=0)
        x = np.round(e[:, np.argmax(np.round(((e - centre) ** 2).mean(axis=0), 9))], 9)
        order, k = np.argsort(x, kind="stable"), np.arange(1, n)
        left, total = np.cumsum(x[order])[:-1], x.sum()
        cut = int(np.argmax(np.round(left * left / k + (total - left) * (total - left) / (n - k), 9))) + 1 if n > 1 else n
        halves = [e[order[:cut]], e[order[cut:]]]
        out.append((n, _mean_cosine(e, centre).mean(), sum(_mean_cosine(h, h.mean(axis=0)).sum() for h in halves if len(h)) / n))
    frames, mean, within = zip(*out, strict=True)
    return pa.table([pa.repeat(t["video_id"][0], len(scenes)), pa.array(scenes), pa.array(frames, pa.int64()), pa.array(mean, pa.float64()), pa.array(within, pa.float64())], names=["video_id", "scene_id", "frames", "mean_cosine", "within"])


def scene_bimodality(f: DataFrame, scene: str = "label", improvement: float = 0.05, least: int = 6, a_video: int = A_VIDEO) -> DataFrame:
    """(video_id, scene_id, frames, mean_cosine, within_cosine, bimodal): whether two clusters hold a scene's vectors more tightly than its
    centroid, by more than `improvement` of mean cosine. Fewer than `least` vectors have no verdict.

    The clusters are the exact two-means of the vectors' values on the axis of largest variance (ties: the first): a sort and prefix
    sums find the best cut, at costs to nine digits, the earliest among equals. No iteration and no seed, so a scene may have any size.
    A video of up to `a_video` vectors of one length is one group, to which they are sent once; others go by shuffles of their components.
    """
    key = ["video_id", "scene_id"]
    v = f.filter(F.col("video_id").isNotNull() & F.col("clip_embedding").isNotNull() & (F.col(scene) >= 0)).select(F.col("video_id").cast("long").alias("video_id"), F.col(scene).cast("long").alias("scene_id"), F.col("frame_idx").cast("long").alias("frame_idx"), F.col("clip_embedding").alias("e"))
    inf = F.lit(float("inf"))
    # array_contains is null for an array with a null that does not hold the value
    plain = (F.array_max("e") < inf) & (F.array_min("e") > -inf) & F.array_contains("e", inf.cast(f.schema["clip_embedding"].dataType.elementType)).isNotNull()
    size = F.size("e")
    others = v.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("a"), F.max(size).alias("b"), F.bool_and(F.coalesce(plain, F.lit(False))).alias("plain"))
    others = F.broadcast(written(others.filter((F.col("n") > a_video) | (F.col("a") < F.col("b")) | ~F.col("plain")).select("video_id"), "others"))
    some = not others.isEmpty()
    found = (v.join(others, "video_id", "left_anti") if some else v).groupBy("video_id").applyInArrow(_halved, "video_id long, scene_id long, frames long, mean_cosine double, within double")
    if some:
        found = found.unionByName(_halved_by_joins(f.join(others, "video_id", "left_semi"), scene))
    enough = F.col("frames") >= least
    return found.select("video_id", F.col("scene_id").cast(f.schema[scene].dataType).alias("scene_id"), "frames", r6(F.col("mean_cosine")).alias("mean_cosine"), F.when(enough, r6(F.col("within"))).alias("within_cosine"), F.when(enough, F.round(F.col("within") - F.col("mean_cosine"), 9) > improvement).alias("bimodal"))


def _halved_by_joins(f: DataFrame, scene: str) -> DataFrame:
    """_halved() of videos with scenes of any size and vectors of any kind."""
    key = ["video_id", "scene_id"]
    v = f.filter(F.col("clip_embedding").isNotNull() & (F.col(scene) >= 0)).select("video_id", F.col(scene).alias("scene_id"), "frame_idx", F.transform("clip_embedding", lambda y: y.cast("double")).alias("e"))
    cells = v.select(*key, F.posexplode("e").alias("pos", "x")).groupBy(*key, "pos").agg(F.avg("x").alias("mean"), F.round(F.var_pop("x"), 9).alias("var"))
    of_scene = cells.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "mean"))).alias("means"), F.max(F.struct("var", (-F.col("pos")).alias("neg"))).alias("top"))
    of_scene = of_scene.select(*key, F.transform("means", lambda s: s["mean"]).alias("centroid"), (-F.col("top.neg")).alias("axis"))
    at = v.join(of_scene, key).select(*key, "frame_idx", "e", cosine(F.col("e"), F.col("centroid")).alias("to_centroid"), F.round(F.get("e", F.col("axis")), 9).alias("x"))
    whole, so_far = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("x", "frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    n, k = F.count(F.lit(1)).over(whole), F.count(F.lit(1)).over(so_far)
    left, total = F.sum("x").over(so_far), F.sum("x").over(whole)
    # of the cost, only what the cut changes: the sums' squares by their counts
    gain = F.when(k < n, left * left / k + (total - left) * (total - left) / (n - k))
    cut = at.withColumn("n", n).withColumn("k", k).withColumn("gain", F.round(gain, 9))
    cut = cut.withColumn("best", F.max(F.when(F.col("gain").isNotNull(), F.struct("gain", (-F.col("k")).alias("neg")))).over(whole)).withColumn("side", F.coalesce((F.col("k") <= -F.col("best.neg")).cast("int"), F.lit(0)))
    halves = cut.select(*key, "side", F.posexplode("e").alias("pos", "y")).groupBy(*key, "side", "pos").agg(F.avg("y").alias("mean")).groupBy(*key, "side").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("centre"))
    return cut.join(halves, [*key, "side"]).groupBy(*key).agg(F.count(F.lit(1)).alias("frames"), F.avg("to_centroid").alias("mean_cosine"), F.avg(cosine(F.col("e"), F.col("centre"))).alias("within"))


def time_subsample(f: DataFrame, step: float = 2.0, most: int = 50) -> DataFrame:
    """Of f(video_id, frame_idx, timestamp) the frames that a reader keeps which wants the next frame at or after 0, step, 2 * step, ...
    seconds, one frame a target and up to `most` a video. Frames are read in order of time (ties: by frame); those without are passed over.

    After a gap the reader takes every frame until it has caught up, so a pick depends on the one before. It has a closed form: with
    first(j) the first frame at or after j * step, pick k is k + max over j <= k of (first(j) - j). So a running maximum replaces the sequential pass.
    """
    t = f.filter("timestamp is not null").withColumn("pos", F.row_number().over(by_video().orderBy("timestamp", "frame_idx")) - 1)
    before = F.max("timestamp").over(by_video().orderBy("timestamp", "frame_idx").rowsBetween(Window.unboundedPreceding, -1))
    reached = F.least(F.floor(F.col("timestamp") / step), F.lit(most - 1))
    since = F.greatest(F.coalesce(F.floor(F.col("before") / step) + 1, F.lit(0)), F.lit(0))
    first = t.withColumn("before", before).withColumn("since", since).withColumn("reached", reached).filter("since <= reached").select("video_id", "pos", F.explode(F.sequence("since", "reached")).alias("target"))
    picks = first.select("video_id", F.col("target").alias("pick"), (F.col("target") + F.max(F.col("pos") - F.col("target")).over(by_video().orderBy("target"))).cast("int").alias("pos"))
    return picks.join(t.select("video_id", "frame_idx", "timestamp", "pos"), ["video_id", "pos"]).select("video_id", "pick", "frame_idx", "timestamp")
