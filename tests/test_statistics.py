"""Hand-computed cases of the descriptive operators, and their independence of partitions."""

import pytest
from conftest import DATA
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumenframe.operators import statistics as T
from lumenframe.sources.frames import frames


def test_buckets_are_closed_on_the_right_and_empty_ones_count(spark):
    v = spark.createDataFrame([(0.0,), (10.0,), (10.5,), (31.0,), (None,)], "x double")
    assert [(r.bucket, r.n) for r in T.bucket_histogram(v, "x", [10, 20, 30]).orderBy("place").collect()] == [("<=10", 2), ("<=20", 1), ("<=30", 0), (">30", 1)]


def test_a_descriptive_question_with_gold_raises(spark):
    gold = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 0.0, 1.0)], "video_id long, qid long, start_time double, end_time double")
    asked = lambda family: T.matched_gold(spark.createDataFrame([("1", "0", family), ("2", "0", "D")], "video_id string, qid string, family string"), gold)
    assert asked("C").count() == 1
    with pytest.raises(PySparkException):
        asked("D").collect()


def test_jaccard_of_few_and_empty_lists(spark):
    rows = [(1, 0, [1, 2]), (1, 1, [2, 3]), (1, 2, [1, 2]), (2, 0, [5]), (3, 0, []), (3, 1, [])]
    got = {r.video_id: r.jaccard for r in T.mean_pairwise_jaccard(spark.createDataFrame(rows, "video_id long, list_id int, items array<long>")).collect()}
    assert got == {1: pytest.approx((1 / 3 + 1 + 1 / 3) / 3), 2: 1.0, 3: 1.0}


def test_grounding_without_frames_or_segments(spark):
    r = spark.createDataFrame([(1, 0.5), (1, 5.0), (2, 1.0)], "video_id long, timestamp double")
    g = spark.createDataFrame([(1, 0.0, 1.0), (1, 2.0, 3.0), (3, 0.0, 1.0)], "video_id long, start_time double, end_time double")
    assert {x.video_id: (x.precision, x.recall) for x in T.grounding(r, g).collect()} == {1: (0.5, 0.5), 2: (0.0, 0.0), 3: (0.0, 0.0)}


@pytest.mark.parametrize("total, fps, frames_", [(100, 25.0, 4), (10, 25.0, 1), (7, 0.0, 7), (5, 2.0, 2), (7, 2.0, 4)])
def test_baseline_frames(spark, total, fps, frames_):
    assert spark.range(1).select(T.baseline_frames(F.lit(total), F.lit(fps)).alias("n")).first().n == frames_


@pytest.mark.parametrize("types, sizes, status", [("IPP", [100, 900, 10], "PASS"), ("III", [100, 900, 10], "SUSPECT"), ("IPP", [100, 101, 102], "SUSPECT"), ("IPP", [100, 150, 220], "SUSPECT")])
def test_codec_sanity(spark, types, sizes, status):
    f = spark.createDataFrame([(1, t, float(x)) for t, x in zip(types, sizes, strict=True)], "video_id long, pict_type string, packet_size double")
    assert T.codec_sanity(f).first().status == status


def test_one_and_eight_partitions_agree(spark):
    f = frames(spark, DATA)
    top = f.filter("packet_size > 50")
    gold = f.groupBy("video_id").agg((F.max("timestamp") / 4).alias("start_time"), (F.max("timestamp") / 2).alias("end_time"))
    for of in (lambda x: T.codec_sanity(x).select("video_id", "i", "status"), lambda x: T.temporal_coverage(x.filter("packet_size > 50"), x), lambda x: T.grounding(x.filter("packet_size > 50"), gold), lambda x: T.bucket_histogram(x, "packet_size", [10, 50])):
        assert sorted(of(f.coalesce(1)).collect()) == sorted(of(f.repartition(8)).collect())
    assert top.count() > 0
