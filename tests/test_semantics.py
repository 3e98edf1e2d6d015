"""Hand-computed cases of verdicts, badges, cache scores, curves and evaluation metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions.exprs import keep_score
from lumenframe.operators import claims as C
from lumenframe.operators import export as X
from lumenframe.operators import graph as G
from lumenframe.operators import metrics as M
from lumenframe.operators import signal as S


@pytest.mark.parametrize(
    "verdicts, badge",
    [
        (["checked_pass"], "verified"),
        (["verified_absent"], "verified"),
        (["checked_fail"], "unverified"),
        (["field_unavailable"], "unverified"),
        (["verified", "checked_fail"], "flagged"),
        (["checked_pass", "rejected", "unverifiable"], "flagged"),
        (["verified", "field_unavailable"], "partial"),
        (["verified", "verified_absent", "checked_pass"], "verified"),
    ],
)
def test_badges_by_class_of_verdict(spark, verdicts, badge):
    df = spark.createDataFrame([(1, i == 0, v) for i, v in enumerate(verdicts)], "answer_id long, is_core boolean, verdict string")
    assert C.badges(df).first().badge == badge


def test_off_topic_facts_do_not_vote(spark):
    rows = [(1, "entailment", True), (1, "contradiction", False), (1, "contradiction", False), (2, "entailment", False), (3, "contradiction", True), (3, "entailment", True), (4, "contradiction", True), (5, "neutral", True)]
    got = {r.claim_id: r.verdict for r in C.majority(spark.createDataFrame(rows, "claim_id long, label string, overlap boolean")).collect()}
    assert got == {1: "verified", 2: "unverifiable", 3: "verified", 4: "rejected", 5: "unverifiable"}


def test_absence_without_captions_is_unverifiable(spark):
    claims = spark.createDataFrame([(1,), (2,), (3,)], "claim_id long")
    votes = spark.createDataFrame([(1, 7, "entailment", 0.9), (1, 8, "entailment", 0.95), (2, 7, "neutral", 0.4)], "claim_id long, fact_id long, label string, score double")
    got = {r.claim_id: (r.verdict, r.witness) for r in C.absence(claims, votes).collect()}
    assert got == {1: ("rejected", 8), 2: ("verified_absent", None), 3: ("unverifiable", None)}


def test_flags_are_whole_words_and_phrases(spark):
    said = lambda t: spark.range(1).select(C.confabulation_flags(F.lit(t).cast("string")).alias("x")).first().x
    assert said("The car, it was there BEFORE; no longer.") == ["no longer", "before", "was there"]
    assert said("snowfall beforehand nowhere") == [] and said("") == [] and said(None) == []


@pytest.mark.parametrize("claim, entities, value", [("", 1, 0.0), ("it might be red", 1, 0.4), ("it seems to be red", 0, 0.65), ("probably red", 0, 0.4), ("red red car", 1, 0.3), ("a red car", 1, 0.85)])
def test_claim_confidence(spark, claim, entities, value):
    assert spark.range(1).select(C.claim_confidence(F.lit(claim), F.lit(entities)).alias("x")).first().x == value


def test_keep_score_weights(spark):
    one = lambda k: spark.range(1).select(keep_score(*[F.lit(1.0 if i == k else 0.0) for i in range(6)], F.lit(9 if k == 6 else 0), F.lit(10)).alias("x")).first().x
    assert [round(one(k), 6) for k in range(7)] == [0.30, 0.20, 0.15, 0.10, 0.10, 0.10, 0.05]


def curve(spark, sizes, keys=()):
    rows = [(1, i, float(x), "I" if i in keys else "P") for i, x in enumerate(sizes)]
    return spark.createDataFrame(rows, "video_id long, frame_idx long, packet_size double, pict_type string")


def test_keyframes_do_not_hide_extrema(spark):
    # the keyframe at 4 is larger than the maximum at 5 beside it, that at 9 smaller than the minimum at 8
    f = curve(spark, [5, 1, 2, 3, 90, 9, 4, 3, 0.5, 0.1, 6, 7, 8, 9], keys=(0, 4, 9))
    top = [r.frame_idx for r in f.withColumn("m", S.local_extrema(F.col("packet_size"), 3)).filter("m").collect()]
    low = [r.frame_idx for r in f.withColumn("m", S.local_extrema(F.col("packet_size"), 3, highest=False)).filter("m").collect()]
    assert (top, low) == ([5], [8])


def test_bursts_are_high_peaks_apart(spark):
    sizes = [1.0] * 60
    for at, x in ((5, 10), (10, 12), (30, 9), (50, 11), (52, 10)):
        sizes[at] = x
    spans = spark.createDataFrame([(1, 0, 0, 40), (1, 1, 40, 60), (1, 2, 59, 60)], "video_id long, scene_id long, start_idx long, end_idx long")
    got = {r.scene_id: r.bursts for r in X.bursts(curve(spark, sizes), spans).collect()}
    assert got == {0: 2, 1: 1, 2: 0}


def test_semantic_edges_join_salient_nodes_alone(spark):
    rows = [(1, i, float(i), 0.5, [1.0, 0.1 * i], t, i, 1.0) for i, t in enumerate(["L1_PEAK", "L2_SALIENT", "L2_SALIENT", "L3_CANDIDATE"])]
    n = spark.createDataFrame(rows, "video_id long, frame_idx long, timestamp double, action_score double, clip_embedding array<double>, tier string, pos long, score_range double")
    assert [(r.src, r.dst) for r in G.edges_semantic(n).collect()] == [(1, 2)]


def test_best_tradeoff_takes_recall_then_compression(spark):
    rows = [(0.1, 0.1, 0.80, 0.1), (0.2, 0.1, 0.90, 0.3), (0.3, 0.1, 0.900004, 0.2), (0.4, 0.1, 0.5, 0.9)]
    r = M.best_tradeoff(spark.createDataFrame(rows, "action_t double, persistence_t double, recall double, compression double")).first()
    assert (r.action_t, r.compression) == (0.2, 0.3)


def test_event_metrics(spark):
    events = spark.createDataFrame([(1, 0, 2, 4), (1, 1, 4, 6), (1, 2, 9, 9), (2, 0, 0, 1)], "video_id long, event_id long, start_frame long, end_frame long")
    f = spark.createDataFrame([(v, i) for v in (1, 2) for i in range(10)], "video_id long, frame_idx long")
    got = {r.video_id: r for r in M.event_metrics(events, spark.createDataFrame([(1, 4), (1, 0), (1, 4)], "video_id long, frame_idx long"), f).collect()}
    assert got[1].event_recall == pytest.approx(2 / 3) and got[1].frame_recall == pytest.approx(1 / 6) and got[1].survivor_precision == 0.5
    assert (got[2].event_recall, got[2].frame_recall, got[2].survivor_precision) == (0.0, 0.0, None)


@pytest.mark.parametrize("lead, passes", [(0.5, True), (0.0, False)])
def test_claim_gate(spark, lead, passes):
    r = np.random.default_rng(1)
    rows = [(v, m, float(r.random() < p)) for v in range(300) for m, p in (("mine", 0.4 + lead), ("a", 0.4), ("b", 0.1))]
    g = M.claim_gate(spark.createDataFrame(rows, "video_id long, method_name string, window_coverage double"), "mine").first()
    assert g.baseline == "a" and g.passes is passes and g.ci_lower < g.improvement < g.ci_upper
