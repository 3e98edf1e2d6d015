"""Descriptive statistics, sanity verdicts, set comparisons and grounding scores over relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_label(value: Column, edges: list[float]) -> Column:
    """The first edge that the value does not exceed, as `<=e`, else `>last`; null values have none."""
    out = None
    for e in edges:
        out = F.when(value <= e, f"<={e}") if out is None else out.when(value <= e, f"<={e}")
    return F.when(value.isNotNull(), out.otherwise(f">{edges[-1]}"))


def bucket_histogram(values: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Counts per bucket, empty buckets included."""
    labels = [f"<={e}" for e in edges] + [f">{edges[-1]}"]
    every = values.sparkSession.createDataFrame([(i, x) for i, x in enumerate(labels)], "place long, bucket string")
    n = values.groupBy(bucket_label(F.col(column), edges).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, "bucket", "left").select("place", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def distribution(values: DataFrame, by: str, column: str) -> DataFrame:
    """Per label n, mean, population standard deviation, minimum, quartiles and maximum; nulls are left out."""
    c = F.col(column)
    p = F.percentile(c, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
    g = values.filter(c.isNotNull()).groupBy(by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), p.alias("p"))
    return g.select(by, "n", "mean", "std", "min", F.col("p")[0].alias("q25"), F.col("p")[1].alias("median"), F.col("p")[2].alias("q75"), "max")


def pearson(values: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Correlation per group; null where a side is constant."""
    return values.groupBy(by).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n")).withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def diversity(captions: DataFrame, text: str, normalized: Column) -> DataFrame:
    """The shares of distinct captions, as they are and normalised, and the mean length."""
    t = captions.filter(F.col(text).isNotNull()).select(F.col(text).alias("t"), normalized.alias("u"))
    return t.agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("t") / F.count(F.lit(1))).alias("unique_ratio"), (F.count_distinct("u") / F.count(F.lit(1))).alias("normalized_ratio"), F.avg(F.length("t")).alias("mean_length"))


def most_repeated(captions: DataFrame, text: str, n: int = 5) -> DataFrame:
    """The n most frequent captions, ties by text."""
    return captions.filter(F.col(text).isNotNull()).groupBy(text).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), text).limit(n)


def codec_sanity(f: DataFrame) -> DataFrame:
    """Per video picture types and packet sizes; SUSPECT where all frames are keyframes or none has a type, the sample deviation is
    below 10, or the largest packet is less than 5 times the smallest (at least 1)."""
    kind = lambda k: F.count_if(F.col("pict_type") == k)
    size = F.col("packet_size")
    g = f.groupBy("video_id").agg(kind("I").alias("i"), kind("P").alias("p"), kind("B").alias("b"), F.avg(size).alias("mean"), F.coalesce(F.stddev_samp(size), F.lit(0.0)).alias("std"), (F.max(size) / F.greatest(F.min(size), F.lit(1.0))).alias("spread"))
    status = F.when((F.col("p") + F.col("b") == 0) | (F.col("std") < 10) | (F.col("spread") < 5), "SUSPECT").otherwise("PASS")
    return g.withColumn("status", status)


def first_per_group(rows: DataFrame, by: list[str], order: list, n: int = 3) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def temporal_coverage(picked: DataFrame, f: DataFrame) -> DataFrame:
    """(last - first picked frame) / (frames - 1) per video; 0 where nothing is picked or the video has one frame."""
    total = f.groupBy("video_id").agg(F.count(F.lit(1)).alias("total"))
    span = picked.groupBy("video_id").agg((F.max("frame_idx") - F.min("frame_idx")).alias("span"))
    value = F.when((F.col("total") > 1) & F.col("span").isNotNull(), F.col("span") / (F.col("total") - 1)).otherwise(F.lit(0.0))
    return total.join(span, "video_id", "left").select("video_id", value.alias("coverage"))


def matched_stems(left: DataFrame, right: DataFrame) -> DataFrame:
    """Stems of both tables(stem) by where they are: both, left or right."""
    l, r = left.select("stem").distinct().withColumn("l", F.lit(1)), right.select("stem").distinct().withColumn("r", F.lit(1))
    where = F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both")
    return l.join(r, "stem", "full_outer").select("stem", where.alias("side"))


def mean_pairwise_jaccard(lists: DataFrame) -> DataFrame:
    """Per video the mean Jaccard of lists(video_id, list_id, items) over their combinations (a stated, small set of lists a video); 1 for
    fewer than two lists; two empty lists are equal."""
    a = lists.select("video_id", F.col("list_id").alias("i"), F.array_distinct("items").alias("x"))
    b = lists.select("video_id", F.col("list_id").alias("j"), F.array_distinct("items").alias("y"))
    both, either = F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))
    pairs = a.join(b, "video_id").filter("i < j").select("video_id", F.when(either == 0, F.lit(1.0)).otherwise(both / either).alias("jaccard"))
    mean = pairs.groupBy("video_id").agg(F.avg("jaccard").alias("jaccard"))
    return lists.select("video_id").distinct().join(mean, "video_id", "left").select("video_id", F.coalesce("jaccard", F.lit(1.0)).alias("jaccard"))


def overlap(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that two parts of a split share; a sound split has none."""
    return one.select(*keys).intersect(other.select(*keys))


def matched_gold(questions: DataFrame, gold: DataFrame) -> DataFrame:
    """Questions joined to gold spans on (video, qid) as strings; a descriptive question that has a span raises."""
    g = gold.select(F.col("video_id").cast("string").alias("video_id"), F.col("qid").cast("string").alias("qid"), "start_time", "end_time")
    q = questions.withColumn("video_id", F.col("video_id").cast("string")).withColumn("qid", F.col("qid").cast("string"))
    # the gold side is part of the condition, so it is asked after the join
    sound = F.when((F.col("family") == "D") & (F.col("start_time") >= float("-inf")), F.raise_error(F.lit("a descriptive question has a gold span")).cast("boolean")).otherwise(F.lit(True))
    return q.join(g, ["video_id", "qid"]).filter(sound)


def uniform_timestamps(durations: DataFrame, k: int) -> DataFrame:
    """the middles of k equal parts of each duration."""
    return durations.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select("video_id", F.col("i").cast("long").alias("i"), ((F.col("i") + 0.5) / k * F.col("duration")).alias("timestamp"))


def baseline_frames(total: Column, fps: Column, sample_fps: float = 1.0) -> Column:
    """frames of a fixed-rate sampler, at least 1 and half-even; all frames without a frame rate."""
    return F.when(fps <= 0, total).otherwise(F.greatest(F.lit(1), F.bround(total / fps * sample_fps).cast("long")))


def grounding(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """Per video of retrieved(video_id, timestamp) or gold(video_id, start_time, end_time): the share of retrieved frames in a
    segment and of segments with a retrieved frame; 0 where there are none of the one or the other."""
    inside = F.col("timestamp").between(F.col("start_time"), F.col("end_time"))
    r = retrieved.select("video_id", "timestamp").withColumn("k", F.monotonically_increasing_id())
    hit = F.coalesce(F.max(inside.cast("int")), F.lit(0)).alias("hit")
    precision = r.join(gold, "video_id", "left").groupBy("video_id", "k").agg(hit).groupBy("video_id").agg(F.avg("hit").alias("p"))
    covered = gold.join(r, "video_id", "left").groupBy("video_id", "start_time", "end_time").agg(hit).groupBy("video_id").agg(F.avg("hit").alias("q"))
    return precision.join(covered, "video_id", "full_outer").select("video_id", F.coalesce("p", F.lit(0.0)).alias("precision"), F.coalesce("q", F.lit(0.0)).alias("recall"))
