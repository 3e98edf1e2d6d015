import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import export as X


@pytest.mark.parametrize("raw, found", [('so {"a": {"b": "}"}} end', '{"a": {"b": "}"}}'), ("```json\n{\"x\": 1}\n``` {}", '{"x": 1}'), ("none {", None), ("", None), (None, None)])
def test_json_object(spark, raw, found):
    assert spark.range(1).select(X.json_object(F.lit(raw).cast("string")).alias("j")).first().j == found


def test_reformulation(spark):
    q = spark.createDataFrame([(1, "why did the boy stretch his arm in the middle of the video")], "qid long, question string")
    rows = X.reformulated(q).orderBy("place").collect()
    assert rows[0].relation == "middle" and len(rows) == 4 and rows[1].query == "boy stretch arm middle video"


def test_feature_matrix_pads(spark):
    f = spark.createDataFrame([(1, 2, 0.5, [1.0, 2.0], None), (1, 1, None, None, [1.0, 2.0, 3.0])], "video_id long, frame_idx long, s double, m array<double>, e array<float>")
    rows = {r.frame_idx: r.features for r in X.feature_matrix(f, ["s"], "m", "e").collect()}
    assert rows == {2: [0.5, 1.0, 2.0, 0.0, 0.0, 0.0], 1: [0.0, 0.0, 0.0, 1.0, 2.0, 3.0]}


def test_bootstrap_holds_the_mean(spark):
    v = spark.createDataFrame([(i, float(i % 2)) for i in range(200)], "video_id long, x double")
    r = X.bootstrap_interval(v, "x").first()
    assert r.mean == 0.5 and 0.4 < r.ci_lower < 0.5 < r.ci_upper < 0.6
    assert r == X.bootstrap_interval(v.repartition(7), "x").first()


def _split_spans(curve, spans, cap):
    """One span after the other, by lists."""
    todo, done = list(spans), []
    while todo:
        a, b = todo.pop()
        sizes = [v for i, v in curve if a <= i < b]
        if not sizes or sum(v >= np.percentile(sizes, 90) for v in sizes) <= cap:
            done.append((a, b))
            continue
        inside = [(v, i) for i, v in curve if a < i < b]
        cut = min(inside)[1] if len(inside) >= 3 else (a + b) // 2
        todo += [(a, cut), (cut, b)]
    return sorted(done)


@pytest.mark.parametrize("cap", [1, 2, 5])
def test_oversized_spans_are_split_by_survivors(spark, cap):
    r = np.random.default_rng(cap)
    sizes = r.integers(1, 9, 120).astype(float)  # many ties
    kinds = ["I" if i % 17 == 0 else "P" for i in range(120)]
    f = spark.createDataFrame([(1, i, float(sizes[i]), kinds[i]) for i in range(120)], "video_id long, frame_idx long, packet_size double, pict_type string")
    spans = [(0, 70), (70, 118), (118, 119), (119, 120)]
    got = X.split_oversized(f, spark.createDataFrame([(1, a, b) for a, b in spans], "video_id long, start_idx long, end_idx long"), cap).collect()
    want = _split_spans([(i, sizes[i]) for i in range(120) if kinds[i] != "I"], spans, cap)
    assert sorted((r.start_idx, r.end_idx) for r in got) == want and sorted(r.scene_id for r in got) == list(range(len(want)))


def test_a_span_needs_a_survivor(spark):
    with pytest.raises(ValueError):
        X.split_oversized(None, None, 0)
