"""Hand-computed cases of the operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions.exprs import cosine, edge_weight, interval_hit, rank_pct
from lumenframe.operators import claims as C
from lumenframe.operators import graph as G
from lumenframe.operators import metrics as M
from lumenframe.operators import retrieval as R
from lumenframe.operators import signal as S
from lumenframe.operators import vector as V
from lumenframe.sources.frames import packet_curve, read_index, write_index


def frame_rows(spark, values):
    return spark.createDataFrame([(1, i, float(i), float(v), float(v), float(v), 0.0, "P") for i, v in enumerate(values)], "video_id long, frame_idx long, timestamp double, packet_size double, motion_magnitude double, luma_entropy double, luma_diff_energy double, pict_type string")


def test_rank_percentile_of_ties(spark):
    df = spark.createDataFrame([(1, x) for x in (1, 2, 2, 5)] + [(2, 7)], "g int, x int")
    w = Window.partitionBy("g")
    rows = df.select("g", "x", rank_pct(F.col("x"), w, w.orderBy("x"), Window.partitionBy("g", "x")).alias("p")).orderBy("g", "x").collect()
    assert [r.p for r in rows] == [0, 0.5, 0.5, 1, 0.5]


@pytest.mark.parametrize(
    "values, distance, threshold, expected",
    [
        ([0.1, 0.2, 0.3, 0.9, 0.3, 0.2, 0.1], 2, 0.4, {3: 1.0}),
        ([0.1] * 3 + [0.9] + [0.1] * 6, 2, 0.4, {3: 1.0}),
        ([0.1] * 3 + [0.25] + [0.1] * 2 + [0.9] + [0.1] * 3, 2, 0.4, {3: 0.1875, 6: 1.0}),
        ([0.2] * 30, 5, 0.4, {}),
    ],
)
def test_persistence(spark, values, distance, threshold, expected):
    rows = S.persistence(S.action_score(frame_rows(spark, values)), distance, 0.05, threshold).collect()
    got = {r.frame_idx: round(r.persistence_value, 6) for r in rows if r.persistence_value > 0}
    assert got == expected
    assert {r.frame_idx for r in rows if r.is_peak} == {k for k, v in expected.items() if v >= threshold}


def test_plateau_is_its_middle_and_distance_keeps_the_higher():
    assert S.find_peaks(np.array([0, 1, 1, 1, 0.0]), 1, 0)[0].tolist() == [2]
    assert S.find_peaks(np.array([0, 1, 0, 2, 0, 1.0, 0]), 3, 0)[0].tolist() == [3]


def test_codec_confidence_by_type_and_overall(spark):
    df = spark.createDataFrame([(1, i, float(p), t) for i, (p, t) in enumerate([(100, "I"), (200, "I"), (300, "I"), (500, "P"), (400, "P")])], "video_id long, frame_idx long, packet_size double, pict_type string")
    of = lambda by: [round(r.codec_conf, 4) for r in S.codec_conf(df, by).orderBy("frame_idx").collect()]
    assert of(True) == [0.1, 0.55, 1.0, 1.0, 0.1]
    assert of(False) == [0.1, 0.325, 0.55, 1.0, 0.775]


def test_long_scenes_are_cut(spark):
    spans = S.valley_scenes(frame_rows(spark, [5.0] * 1000)).orderBy("start_idx").collect()
    assert [(r.start_idx, r.end_idx) for r in spans] == [(0, 300), (300, 600), (600, 900), (900, 1000)]


def test_complete_edges(spark):
    rows = [(1, 1, 0.0, 0.8, [1.0, 0.0]), (1, 2, 1.0, 0.4, [0.6, 0.8])]
    n = G.nodes(spark.createDataFrame(rows, "video_id long, frame_idx long, timestamp double, action_score double, clip_embedding array<float>"))
    assert G.edges_complete(n, alpha=0.4, beta=0.6).first().weight == pytest.approx(0.24)


def test_pagerank_of_one_node_and_of_two(spark):
    n = spark.createDataFrame([(1, 5, 0.3), (2, 1, 0.9), (2, 2, 0.1)], "video_id long, frame_idx long, s double")
    e = spark.createDataFrame([(2, 1, 2, 1.0)], "video_id long, src long, dst long, weight double")
    p = {(r.video_id, r.frame_idx): r.pagerank for r in G.pagerank(n, e, "s", 0.85, 60).collect()}
    assert p[1, 5] == pytest.approx(1) and p[2, 1] > p[2, 2] and p[2, 1] + p[2, 2] == pytest.approx(1)


def test_pagerank_does_not_depend_on_partitions(spark):
    n = spark.createDataFrame([(v, i, float(i % 7)) for v in range(3) for i in range(40)], "video_id long, frame_idx long, s double")
    e = spark.createDataFrame([(v, i, (i * 7 + 1) % 40, 1.0 + i % 3) for v in range(3) for i in range(40) if i != (i * 7 + 1) % 40], "video_id long, src long, dst long, weight double")
    run = lambda k: sorted((r.video_id, r.frame_idx, round(r.pagerank, 12)) for r in G.pagerank(n.repartition(k), e.repartition(k), "s", 0.5, 30).collect())
    assert run(1) == run(8)


def test_fusion(spark):
    lists = spark.createDataFrame([(1, 0, 10, 0), (1, 0, 20, 1), (1, 1, 20, 0), (1, 1, 30, 1)], "video_id long, list_id int, frame_idx long, rank int")
    rows = R.rrf(lists, k=0).orderBy("place").collect()
    assert [r.frame_idx for r in rows] == [20, 10, 30] and rows[0].hits == 2


def test_expansion_marks_seeds(spark):
    f = spark.createDataFrame([(1, i) for i in (0, 10, 20, 30, 40)], "video_id long, frame_idx long")
    rows = R.temporal_expansion(f, spark.createDataFrame([(1, 20, 1)], "video_id long, frame_idx long, rank int")).orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.expanded) for r in rows] == [(10, True), (20, False), (30, True)]


@pytest.mark.parametrize("text, letter", [("A boy sits. I choose B.", None), ("x\nANSWER: B because", 1), ("final answer: E", 4), ("ANSWER: option D", 3), ("ANSWER: (C)", 2)])
def test_strict_choice(spark, text, letter):
    assert spark.range(1).select(C.mc_strict(F.lit(text)).alias("c")).first().c == letter


@pytest.mark.parametrize("t, hit", [(5.0, True), (4.0, True), (6.0, True), (3.9, False), (6.1, False)])
def test_interval(spark, t, hit):
    assert spark.range(1).select(interval_hit(F.lit(t), F.lit(4.0), F.lit(6.0)).alias("h")).first().h is hit


def test_missing_truth_is_null_and_empty_selection_is_not(spark):
    events = spark.createDataFrame([(1, 0, "C", None, 2.0), (1, 1, "C", -1.0, 2.0), (2, 0, "C", 1.0, 2.0)], "video_id long, qid long, family string, start_time double, end_time double")
    chosen = spark.createDataFrame([(1, 1.5)], "video_id long, timestamp double")
    rows = {(r.video_id, r.qid): r for r in M.selection_coverage(chosen, events).collect()}
    assert rows[1, 0].window_coverage is None and rows[1, 1].min_temp_dist is None
    assert (rows[2, 0].window_coverage, rows[2, 0].min_temp_dist, rows[2, 0].best_iou, rows[2, 0].zero_overlap) == (0, 999.0, 0.0, 1)


@pytest.mark.parametrize(
    "verdicts, badge",
    [(["verified"], "verified"), (["unverifiable"], "unverified"), (["rejected"], "unverified"), (["verified", "rejected"], "flagged"), (["verified", "unverifiable"], "partial"), (["verified", "verified"], "verified")],
)
def test_badges(spark, verdicts, badge):
    df = spark.createDataFrame([(1, i == 0, v) for i, v in enumerate(verdicts)], "answer_id long, is_core boolean, verdict string")
    assert C.badges(df).first().badge == badge


@pytest.mark.parametrize("keyframes, expected_fill", [(0, 8), (3, 5), (12, 0)])
def test_budgets(spark, keyframes, expected_fill):
    f = spark.createDataFrame([(1, i, "I" if i < keyframes else "P") for i in range(40)], "video_id long, frame_idx long, pict_type string")
    rows = M.iframe_fill(f, 8).collect()
    assert len(rows) == 8 == len({r.frame_idx for r in rows}) and sum(r.is_fill for r in rows) == expected_fill
    assert M.uniform(f, 8).count() == 8
    assert sorted(M.random_sample(f, 8, 1).collect()) == sorted(M.random_sample(f.repartition(5), 8, 1).collect())


def test_cache_evicts_for_higher_scores_only(spark):
    f = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.6), (1, 2, 0.4), (1, 3, 0.9)], "video_id long, frame_idx long, score double")
    assert {(r.frame_idx, r.admitted_at) for r in V.cache_fold(f, 2).collect()} == {(1, 1), (3, 2)}


def test_packets(spark):
    p = spark.createDataFrame([(1, 30, 5.0, False), (1, 10, 7.0, True), (1, 20, 0.0, False)], "video_id long, pts long, size double, is_keyframe boolean")
    assert [(r.display_idx, r.size) for r in packet_curve(p).orderBy("display_idx").collect()] == [(0, 7.0), (1, 5.0)]
    with pytest.raises(Exception, match="repeated pts"):
        packet_curve(p.union(p)).collect()


def test_motion_geometry_of_a_source(spark):
    v = pd.DataFrame([(1, 0, x * 16 + 8, y * 16 + 8, float(x), float(y)) for x in range(4) for y in range(4)], columns=["video_id", "frame_idx", "dst_x", "dst_y", "motion_x", "motion_y"])
    r = S.motion_geometry(spark.createDataFrame(v), 64, 64).first()
    assert r.divergence == pytest.approx(2) and r.curl == pytest.approx(0)


def test_index_round_trip(spark, tmp_path):
    f = spark.createDataFrame([(1, 0, 0.5), (2, 1, None)], "video_id long, frame_idx long, codec_conf double")
    e = spark.createDataFrame([(1, 0, 1, 0.3)], "video_id long, src long, dst long, weight double")
    write_index(f, e, str(tmp_path))
    back, edges = read_index(spark, str(tmp_path), f.schema, e.schema)
    assert {tuple(r) for r in back.select(f.columns).collect()} == {(1, 0, 0.5), (2, 1, 0.5)} and edges.count() == 1


def test_empty_vectors(spark):
    r = spark.range(1).select(cosine(F.lit(None).cast("array<float>"), F.array(F.lit(1.0))).alias("a"), cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("b"), edge_weight(F.lit("temporal"), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("w")).first()
    assert (r.a, r.b, r.w) == (0.0, 0.0, 1e-6)
