"""Scene-sparse retrieval, PageRank of any size, sampling and evidence against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import evidence as E
from lumenframe.operators import graph as G
from lumenframe.operators import metrics as M
from lumenframe.operators import scene_sparse as P
from lumenframe.operators.ranking import pagerank_rounds, pagerank_seeds

NODE = "video_id long, frame_idx long, timestamp double, action_score double, clip_embedding array<double>, label int, pos long, score_range double, codec_conf double"


def scenes(spark, vectors, labels, video=1):
    """A frame a vector; null vectors are frames without one."""
    rows = [(video, i, float(i), 0.1 * (i % 7), v, s, i, 0.6, 0.5 + 0.01 * (i % 5)) for i, (v, s) in enumerate(zip(vectors, labels, strict=True))]
    return spark.createDataFrame(rows, NODE)


def asked(spark, *vectors):
    return spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "query_id long, q array<double>")


def grouped(seeds, edges, damping):
    return G.pagerank(seeds, edges, "seed", damping, 60, ("video_id", "query_id"))


def no_edges(spark):
    return spark.createDataFrame([], "video_id long, src long, dst long, weight double")


def test_a_query_without_direction(spark):
    n = scenes(spark, [[1.0, 0.0]], [0])
    for bad in ([0.0, 0.0], [1e-9, 0.0], None):
        with pytest.raises(Exception, match="Invalid query embedding"):
            P.scene_sparse_retrieve(n, asked(spark, [1.0, 0.0], bad), no_edges(spark), ranker=grouped).collect()
    assert [r.query_id for r in P.valid_queries(asked(spark, [0.0, 0.0], [0.0, 1.0]), "drop").collect()] == [1]
    P.check_graph_mode(None, "flat")
    with pytest.raises(ValueError, match="scene_sparse"):
        P.check_graph_mode("flat", "scene_sparse")


def test_all_scenes_where_the_shortlist_holds_nothing(spark):
    # the centroid of scene 0 is nearest, as its two frames cancel in all but the query's direction; none of them is similar
    n = scenes(spark, [[0.1, 1.0, 0.0], [0.1, -1.0, 0.0], [0.9, 0.0, -5.0], [0.9, 0.0, 1.0]], [0, 0, 1, 2])
    got = P.shortlisted(n, asked(spark, [1.0, 0.0, 0.0]), width=1).orderBy("frame_idx").collect()
    assert [r.survives for r in got] == [True] * 4
    got = P.shortlisted(n, asked(spark, [1.0, 0.0, 0.0]), width=1, floor=0.05).orderBy("frame_idx").collect()
    assert [r.survives for r in got] == [True, True, False, False]


def test_branches(spark):
    n = scenes(spark, [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], None], [0, 0, 1, 1])
    got = P.scene_sparse_retrieve(n, asked(spark, [1.0, 0.0], [1.0, 1.0]), no_edges(spark), ranker=grouped).orderBy("query_id", "rank").collect()
    first = [r for r in got if r.query_id == 0]
    assert [(r.branch, r.frame_idx) for r in first] == [("shortcut", 0), ("shortcut", 1), ("shortcut", 2)] and first[0].score == 1.0
    assert {r.branch for r in got if r.query_id == 1} == {"shortcut"}  # 0.78 against 0.71
    tied = P.scene_sparse_retrieve(n, asked(spark, [1.0, 1.0]), no_edges(spark), tau=0.1, ranker=grouped).collect()
    assert {r.branch for r in tied} == {"descend"} and {r.frame_idx for r in tied} == {0, 1, 2}


@pytest.fixture(scope="module")
def pool(spark):
    r = np.random.default_rng(2)
    labels = [int(x) for x in r.integers(0, 5, 40)]
    n = scenes(spark, [[float(y) for y in r.normal(size=4)] for _ in range(40)], labels)
    q = asked(spark, *[[float(y) for y in r.normal(size=4)] for _ in range(3)])
    gate = P.gated(P.shortlisted(n, q), tau=9.0)
    return n, q, labels, P.pools(gate, window=3)


def test_cross_scene_modes(spark, pool):
    n, _, labels, p = pool
    members = p.collect()
    every = {m: {(r.query_id, r.src, r.dst): r.weight for r in P.cross_scene_edges(p, n, m).collect()} for m in P.MODES}
    for q in range(3):
        frames = sorted(r.frame_idx for r in members if r.query_id == q)
        assert len(frames) > 20
        pairs = {(q, a, b) for a, b in itertools.combinations(frames, 2) if labels[a] != labels[b]}
        assert {k for k in every["all"] if k[0] == q} == pairs
        cut = np.percentile([every["all"][k] for k in pairs], 75)
        assert {k for k in every["threshold"] if k[0] == q} == {k for k in pairs if every["all"][k] >= cut}
        reps = {max((r for r in members if r.query_id == q and r.label == s), key=lambda r: (r.sem, -r.frame_idx)).frame_idx for s in {labels[f] for f in frames}}
        assert {k for k in every["rep_only"] if k[0] == q} == {k for k in pairs if {k[1], k[2]} <= reps}
        assert sum(k[0] == q for k in every["rep_only"]) == len(reps) * (len(reps) - 1) // 2
    with pytest.raises(ValueError):
        P.cross_scene_edges(p, n, "some")


@pytest.mark.parametrize("mode", ["threshold"])
def test_both_rankers_agree(spark, pool, mode):
    n, q, _, _ = pool
    edges = G.edges_complete(n, "label")
    far = P.scene_sparse_retrieve(n, q, edges, mode, tau=9.0, window=3)
    near = P.scene_sparse_retrieve(n.repartition(7), q, edges, mode, tau=9.0, window=3, ranker=grouped)
    assert sorted(map(tuple, far.collect())) == sorted(map(tuple, near.collect()))


def brute_pagerank(seed, edges, damping, rounds=400):
    at = {f: k for k, f in enumerate(sorted(seed))}
    s = np.maximum(np.array([seed[f] for f in sorted(seed)], float), 0)
    s = s / s.sum() if s.sum() > 0 else np.full(len(s), 1 / len(s))
    pairs = [(at[a], at[b], w) for a, b, w in edges if w > 0 and a in at and b in at]
    frm, to, w = (np.array(x) for x in zip(*[(a, b, w) for a, b, w in pairs], *[], *[(b, a, w) for a, b, w in pairs], strict=False)) if pairs else ([], [], [])
    frm, to = np.array(frm, int), np.array(to, int)
    out = np.bincount(frm, weights=w, minlength=len(s)) if len(frm) else np.zeros(len(s))
    x = s
    for _ in range(rounds):
        flow = np.bincount(to, weights=w / out[frm] * x[frm], minlength=len(s)) if len(frm) else 0
        x = damping * (flow + x[out == 0].sum() * s) + (1 - damping) * s
    return dict(zip(sorted(seed), x, strict=True))


def test_pagerank_by_joins(spark):
    """A hub whose edges are dealt over parts, frames without edges, an edge to nowhere, a video without seeds."""
    r = random.Random(4)
    seeds = {v: {i: (r.random() if v else 0.0) for i in range(60)} for v in (0, 1)}
    edges = {v: [(0, i, r.random()) for i in range(1, 50)] + [(r.randrange(1, 30), r.randrange(30, 50), r.random()) for _ in range(40)] + [(3, 999, 1.0), (51, 52, 0.0)] for v in (0, 1)}
    n = spark.createDataFrame([(v, i, s) for v in seeds for i, s in seeds[v].items()], "video_id long, frame_idx long, seed double")
    e = spark.createDataFrame([(v, *x) for v in edges for x in edges[v]], "video_id long, src long, dst long, weight double")
    want = {(v, f): p for v in seeds for f, p in brute_pagerank(seeds[v], edges[v], 0.3).items()}
    got = pagerank_rounds(n.repartition(8), e.repartition(8), ["video_id"], "seed", 0.3, 1e-10, a_part=10).collect()
    assert {(x.video_id, x.frame_idx): x.pagerank for x in got} == pytest.approx(want, abs=1e-9) and len(got) == 120
    assert pagerank_rounds(n.limit(0), e, ["video_id"], "seed").collect() == []


def test_pagerank_of_a_graph_larger_than_a_group(spark):
    """A ring with spokes: its ranks have a closed relation, and no group ever holds it."""
    size = 30_000
    n = spark.range(size).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("frame_idx"), F.lit(1.0).alias("seed"))
    ring = spark.range(1, size).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("src"), (F.when(F.col("id") == size - 1, 1).otherwise(F.col("id") + 1)).cast("long").alias("dst"), F.lit(1.0).alias("weight"))
    spokes = spark.range(1, size).select(F.lit(1).cast("long").alias("video_id"), F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    got = {r.frame_idx: r.pagerank for r in pagerank_rounds(n, ring.union(spokes), ["video_id"], "seed", 0.5, 1e-6, a_part=1000).collect()}
    # of the hub h and each rim node x: h = d/3 (m x) + (1-d)/n and h + m x = 1
    m = size - 1
    rim = (1 - 0.5 / size) / (m * (1 + 0.5 / 3))
    assert got[0] == pytest.approx(1 - m * rim, rel=1e-4) and got[7] == pytest.approx(rim, rel=1e-4) and len(got) == size


def test_many_seeds_at_once(spark):
    r = random.Random(1)
    edges = [(a, b, r.random()) for a, b in itertools.combinations(range(9), 2) if r.random() < 0.4]
    seeds = {q: {f: r.random() if q else 0.0 for f in range(9)} for q in range(3)}
    s = spark.createDataFrame([(1, q, f, x) for q in seeds for f, x in seeds[q].items()], "video_id long, query_id long, frame_idx long, seed double")
    got = pagerank_seeds(s, spark.createDataFrame([(1, *e) for e in edges], "video_id long, src long, dst long, weight double"), 0.5, 80).collect()
    for q in seeds:
        assert {x.frame_idx: x.pagerank for x in got if x.query_id == q} == pytest.approx(brute_pagerank(seeds[q], edges, 0.5), abs=1e-9)


def reader(times, step, most):
    wanted, kept = 0.0, []
    for k, t in enumerate(times):
        if t is not None and t >= wanted:
            kept.append(k)
            wanted += step
            if len(kept) >= most:
                break
    return kept


def test_time_subsample(spark):
    r = random.Random(9)
    videos = {0: [0.0, 0.5, 11.0, 11.1, 11.2, 11.3, 11.4, 30.0], 1: [None, 3.0, None, 3.5], 2: [float(i) / 3 for i in range(400)], 3: [-5.0, -1.0, 0.0], 4: [5.0, 5.0, 5.0, 9.0, 9.0, 9.0], 5: [None]}
    videos |= {k: sorted(r.random() * 60 for _ in range(50)) for k in range(6, 20)}
    f = spark.createDataFrame([(v, i, t) for v, ts in videos.items() for i, t in enumerate(ts)], "video_id long, frame_idx long, timestamp double")
    for parts in (1, 8):
        got = P.time_subsample(f.repartition(parts), 2.0, 50).collect()
        assert {v: [x.frame_idx for x in sorted(got, key=lambda x: x.pick) if x.video_id == v] for v in videos} == {v: reader(ts, 2.0, 50) for v, ts in videos.items()}


def test_bimodality(spark):
    r = np.random.default_rng(1)
    two = [[float(s) + float(r.normal() / 20), 1.0, float(r.normal() / 20)] for s in (1, -1) for _ in range(8)]
    one = [[1.0, float(r.normal() / 20), float(r.normal() / 20)] for _ in range(16)]
    n = scenes(spark, two + one + [[1.0, 0.0, 0.0]] * 3 + [None, [0.5, 0.5, 0.5]], [0] * 16 + [1] * 16 + [2] * 3 + [2, 3])
    got = {x.scene_id: x for x in P.scene_bimodality(n).collect()}
    assert (got[0].bimodal, got[1].bimodal, got[2].bimodal, got[3].bimodal) == (True, False, None, None)
    assert got[0].within_cosine > 0.99 > got[0].mean_cosine and (got[2].frames, got[3].frames) == (3, 1)


def test_stems_and_topics(spark):
    rows = [(1, "The puppies were jumping over fences."), (2, "A class of glasses"), (3, "is it on?"), (4, "")]
    got = spark.createDataFrame(rows, "id long, t string").select("id", E.stems(F.col("t")).alias("s")).orderBy("id").collect()
    assert [list(r.s) for r in got] == [["puppy", "jump", "over", "fence"], ["class", "glasse"], [], []]
    claims = spark.createDataFrame([(1, 10, "The puppy jumps."), (1, 11, "Nothing else"), (2, 12, "fence")], "session long, claim_id long, text string")
    facts = spark.createDataFrame([(1, 20, "puppies jumped"), (1, 21, "a fence"), (2, 22, "fences; Fence"), (2, 23, None)], "session long, fact_id long, text string")
    pairs = E.topical_pairs(claims, facts)
    assert {(r.claim_id, r.fact_id, r.shared) for r in pairs.collect()} == {(10, 20, 2), (12, 22, 1)}
    got = {r.claim_id: r.verdict for r in E.topical_verdicts(claims, pairs.withColumn("label", F.when(F.col("claim_id") == 10, "entailment").otherwise("contradiction"))).collect()}
    assert got == {10: "verified", 11: "unverifiable", 12: "rejected"}


def test_citations(spark):
    claims = spark.createDataFrame([(1, 1, "Frame 3 and frames 4, at 7.5s"), (1, 2, "at 2s, 2s"), (1, 3, "nothing"), (2, 4, "Frame 3"), (1, 5, "Frame 99999999999999999999")], "session long, claim_id long, text string")
    facts = spark.createDataFrame([(1, 30, 3, 7.25), (1, 31, 4, 8.0), (1, 32, 5, 7.79), (1, 33, 6, 1.75), (1, 34, 7, 2.25), (1, 35, 8, 2.31)], "session long, fact_id long, frame_idx long, timestamp double")
    got = {(r.claim_id, r.fact_id): r.cited_by for r in E.citations(claims, facts).collect()}
    assert got == {(1, 30): "frame", (1, 31): "frame", (1, 32): "time", (2, 33): "time", (2, 34): "time"}


def test_citation_buckets_lose_nothing(spark):
    r = random.Random(3)
    times, cited = [round(r.random() * 9, 2) for _ in range(300)], [round(r.random() * 9, 2) for _ in range(40)]
    claims = spark.createDataFrame([(1, k, f"at {t}s") for k, t in enumerate(cited)], "session long, claim_id long, text string")
    facts = spark.createDataFrame([(1, k, 1000 + k, t) for k, t in enumerate(times)], "session long, fact_id long, frame_idx long, timestamp double")
    assert {(x.claim_id, x.fact_id) for x in E.citations(claims, facts).collect()} == {(i, j) for i, t in enumerate(cited) for j, u in enumerate(times) if abs(t - u) <= 0.3}


def test_scopes_equal_the_cross_join(spark):
    r = random.Random(5)
    labels, verdicts = ["entailment", "contradiction", "neutral"], ["verified", "rejected", "unverifiable"]
    votes = [(c, 100 * c + k, r.choice([0.5, 0.55, 0.6, r.random(), None]), r.choice(labels)) for c in range(60) for k in range(r.randrange(0, 8))]
    now = {c: r.choice(verdicts) for c in range(70)}
    pairs = spark.createDataFrame(votes, "claim_id long, fact_id long, similarity double, label string")
    current = spark.createDataFrame(list(now.items()), "claim_id long, verdict string")
    want = set()
    for tau, k in itertools.product([0.0, 0.5, 0.55, 0.9, 2.0], [1, 3, 5]):
        scoped = {}
        for c in now:
            near = sorted((-s, f, label) for v, f, s, label in votes if v == c and s is not None and s >= tau)[:k]
            e, x = (sum(y[2] == label for y in near) for label in labels[:2])
            scoped[c] = "rejected" if x > e else "verified" if e else "unverifiable"
        want.add((tau, k, *[sum(s == v for s in scoped.values()) for v in verdicts], sum(scoped[c] != now[c] for c in now)))
    for parts in (1, 8):
        assert {tuple(x) for x in E.scoped_sweep(pairs.repartition(parts), current, [0.0, 0.5, 0.55, 0.9, 2.0], [1, 3, 5]).collect()} == want


def test_fidelity_is_own_frame_against_the_others(spark):
    r = np.random.default_rng(6)
    cap, vis = r.normal(size=(7, 5)), r.normal(size=(7, 5))
    rows = [(1, i, [float(x) for x in cap[i]], [float(x) for x in vis[i]]) for i in range(7)] + [(2, 0, [1.0, 0.0], [1.0, 0.0]), (1, 9, None, [1.0] * 5)]
    got = {(x.video_id, x.frame_idx): x.margin for x in M.fidelity_margin(spark.createDataFrame(rows, "video_id long, frame_idx long, caption_embedding array<double>, clip_embedding array<double>")).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    c = unit(cap) @ unit(vis).T
    assert got == {**{(1, i): pytest.approx(c[i, i] - np.delete(c[i], i).mean()) for i in range(7)}, (2, 0): None}
