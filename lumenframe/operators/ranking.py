"""Personalised PageRank: many seeds of a small graph in one group, and graphs of any size as a loop of joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, written
from .graph import pagerank

#: Edges of a node that one task reads; a node with more is split over several.
EDGES_A_PART = 10_000
#: Nodes and edges up to which a whole graph is one group of a task; larger ones go by a loop of joins.
A_GROUP = 200_000


def pagerank_seeds(seeds: DataFrame, edges: DataFrame, damping: float, rounds: int) -> DataFrame:
    """PageRank of every video's undirected graph for all of its queries at once: seeds(video_id, query_id, frame_idx,
    seed), edges(video_id, src, dst, weight). The graph is sent once a video and a round multiplies it with one column a query. A
    query ranks the frames that it has seeds for, all frames of the video being nodes of its graph; a video is one group (a few thousand nodes)."""

    def one(s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if s.empty:
            return pd.DataFrame({"video_id": [], "query_id": [], "frame_idx": [], "pagerank": []})
        wide = s.pivot_table(index="frame_idx", columns="query_id", values="seed", aggfunc="first")
        x = np.maximum(np.nan_to_num(wide.to_numpy(float)), 0)
        mass = x.sum(axis=0)
        x = np.where(mass > 0, x / np.where(mass > 0, mass, 1), 1 / len(x))
        start, place = x.copy(), pd.Series(range(len(x)), index=wide.index)
        e = e[(e["weight"] > 0) & e["src"].isin(place.index) & e["dst"].isin(place.index)]
        a, b = place[e["src"]].to_numpy(int), place[e["dst"]].to_numpy(int)
        step = np.zeros((len(x), len(x)))
        np.add.at(step, (a, b), e["weight"].to_numpy(float))
        np.add.at(step, (b, a), e["weight"].to_numpy(float))
        out = step.sum(axis=1, keepdims=True)
        step = np.divide(step, out, out=np.zeros_like(step), where=out > 0).T
        hangs = out[:, 0] == 0
        for _ in range(rounds):
            x = damping * (step @ x + x[hangs].sum(axis=0) * start) + (1 - damping) * start
        got = pd.DataFrame(x, index=wide.index, columns=wide.columns).where(wide.notna()).stack().rename("pagerank").reset_index()
        return got.assign(video_id=s["video_id"].iloc[0])[["video_id", "query_id", "frame_idx", "pagerank"]]

    left = seeds.select("video_id", "query_id", "frame_idx", "seed").groupBy("video_id")
    return left.cogroup(edges.select(F.col("video_id").alias("video_id"), "src", "dst", "weight").groupBy("video_id")).applyInPandas(one, "video_id long, query_id long, frame_idx long, pagerank double")


def pagerank_rounds(nodes: DataFrame, edges: DataFrame, keys: list[str], seed: str, damping: float = 0.85, tolerance: float = 1e-9, most: int = 300, a_part: int = EDGES_A_PART, a_group: int = A_GROUP) -> DataFrame:
    """G5, G6 for graphs of any size: keys and frame_idx of nodes with their pagerank. nodes(keys, frame_idx, seed) are distinct,
    edges(keys, src, dst, weight) undirected; those without weight or with an end that is no node don't count.

    A round is a join of ranks and shares and a sum by target, which starts before the shuffle. A node of many edges is dealt over
    parts, its rank being copied to each. Every round's ranks are written; it ends when no graph's ranks moved by
    more than `tolerance` together (L1), or after `most` rounds. Mass of nodes without edges goes to the seeds, which are uniform where they sum to 0.
    Graphs of up to `a_group` nodes and edges have no use for that: each is one group of a task, is shuffled once and does its rounds there.
    """
    nodes = nodes.select(*keys, "frame_idx", F.col(seed).cast("double").alias(seed))
    edges = written(edges.filter("weight > 0").select(*keys, "src", "dst", F.col("weight").cast("double").alias("weight")), "edges")
    sizes = nodes.select(*keys).unionByName(edges.select(*keys)).groupBy(*keys).count()
    large = written(sizes.filter(F.col("count") > a_group).select(*keys), "large")
    alone = lambda df, how: df.join(F.broadcast(large), keys, how)
    if large.isEmpty():
        return pagerank(nodes, edges, seed, damping, most, tuple(keys), tolerance)
    small = pagerank(alone(nodes, "left_anti"), alone(edges, "left_anti"), seed, damping, most, tuple(keys), tolerance)
    return small.unionByName(_by_joins(alone(nodes, "left_semi"), alone(edges, "left_semi"), keys, seed, damping, tolerance, most, a_part))


def _by_joins(nodes: DataFrame, edges: DataFrame, keys: list[str], seed: str, damping: float, tolerance: float, most: int, a_part: int) -> DataFrame:
    totals = nodes.groupBy(*keys).agg(F.sum(F.greatest(F.col(seed).cast("double"), F.lit(0.0))).alias("mass"), F.count(F.lit(1)).alias("n"))
    seeds = nodes.join(totals, keys).select(*keys, "frame_idx", F.when(F.col("mass") > 0, F.greatest(F.col(seed).cast("double"), F.lit(0.0)) / F.col("mass")).otherwise(1 / F.col("n")).alias("s"))
    ids = nodes.select(*keys, "frame_idx")
    sound = edges.filter("weight > 0").select(*keys, F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").cast("double").alias("weight"))
    sound = sound.join(ids.withColumnRenamed("frame_idx", "a"), [*keys, "a"], "left_semi").join(ids.withColumnRenamed("frame_idx", "b"), [*keys, "b"], "left_semi")
    both = sound.select(*keys, F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"), "weight").select(*keys, "e.a", "e.b", "weight")
    out = both.groupBy(*keys, "a").agg(F.sum("weight").alias("out"), F.ceil(F.count(F.lit(1)) / a_part).cast("int").alias("parts"))
    links = written(both.join(out, [*keys, "a"]).select(*keys, "a", "b", (F.col("weight") / F.col("out")).alias("share"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")), "links")
    ranks = written(seeds.join(out.select(*keys, F.col("a").alias("frame_idx"), "parts"), [*keys, "frame_idx"], "left").select(*keys, "frame_idx", "s", "parts", F.col("s").alias("x")), "ranks")

    def moved(x: DataFrame) -> DataFrame:
        """One round. A node's own row and what flows to it meet in one sum."""
        sent = x.filter("parts is not null").select(*keys, F.col("frame_idx").alias("a"), "x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        flows = sent.join(links, [*keys, "a", "part"]).select(*keys, F.col("b").alias("frame_idx"), F.lit(None).cast("double").alias("s"), F.lit(None).cast("int").alias("parts"), F.lit(None).cast("double").alias("before"), (F.col("x") * F.col("share")).alias("flow"))
        own = x.select(*keys, "frame_idx", "s", "parts", F.col("x").alias("before"), F.lit(0.0).alias("flow"))
        here = own.unionByName(flows).groupBy(*keys, "frame_idx").agg(F.max("s").alias("s"), F.max("parts").alias("parts"), F.max("before").alias("before"), F.sum("flow").alias("flow"))
        hanging = x.filter("parts is null").groupBy(*keys).agg(F.sum("x").alias("hanging"))
        new = damping * (F.col("flow") + F.coalesce("hanging", F.lit(0.0)) * F.col("s")) + (1 - damping) * F.col("s")
        return here.join(hanging, keys, "left").select(*keys, "frame_idx", "s", "parts", new.alias("x"), "before")

    for _ in range(most):
        after = written(moved(ranks), "ranks")
        dropped(ranks)
        ranks = after
        change = ranks.groupBy(*keys).agg(F.sum(F.abs(F.col("x") - F.col("before"))).alias("c")).agg(F.max("c").alias("c")).first()["c"]
        if change is None or change <= tolerance:
            break
    dropped(links)
    return ranks.select(*keys, "frame_idx", F.col("x").alias("pagerank"))
