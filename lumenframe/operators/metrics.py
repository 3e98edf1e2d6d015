"""Samplers and evaluation metrics over (video, frame), (video, method, frame) and (video, event) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import by_video, dot, in_order, interval_distance, interval_hit, interval_iou, valid_interval
from .export import bootstrap_interval


def uniform(f: DataFrame, k: int) -> DataFrame:
    """K frames at half-even rounded even spacing."""
    n = F.count(F.lit(1)).over(by_video())
    pos = f.select("video_id", "frame_idx", (F.row_number().over(in_order()) - 1).alias("pos"), n.alias("n"))
    at = F.when(F.col("i") == 0, F.lit(0)).otherwise(F.bround(F.col("i") * (F.col("n") - 1) / (k - 1 if k > 1 else 1))).cast("long")
    wanted = pos.select("video_id", "n").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select("video_id", at.alias("pos")).distinct()
    return pos.join(wanted, ["video_id", "pos"]).select("video_id", "frame_idx")


def iframe_fill(f: DataFrame, k: int) -> DataFrame:
    """The first k I-frames, filled up evenly from the rest."""
    first = f.withColumn("rn", F.row_number().over(Window.partitionBy("video_id", "pict_type").orderBy("frame_idx")))
    keys = first.filter((F.col("pict_type") == "I") & (F.col("rn") <= k)).select("video_id", "frame_idx", F.lit(False).alias("is_fill"))
    missing = f.select("video_id").distinct().join(keys.groupBy("video_id").agg(F.count(F.lit(1)).alias("have")), "video_id", "left").select("video_id", (k - F.coalesce("have", F.lit(0))).alias("need"))
    rest = f.join(keys, ["video_id", "frame_idx"], "left_anti").select("video_id", "frame_idx", (F.row_number().over(in_order()) - 1).alias("pos"), F.count(F.lit(1)).over(by_video()).alias("n"))
    spread = rest.join(missing, "video_id").filter("need > 0")
    # position pos is the i-th pick just if floor((i * n) / need) = pos for some i
    pick = F.floor((F.floor((F.col("pos") * F.col("need") + F.col("n") - 1) / F.col("n")) * F.col("n")) / F.col("need")) == F.col("pos")
    inside = F.floor((F.col("pos") * F.col("need") + F.col("n") - 1) / F.col("n")) < F.col("need")
    return keys.union(spread.filter(pick & inside).select("video_id", "frame_idx", F.lit(True).alias("is_fill")))


def top_k(f: DataFrame, column: str, k: int) -> DataFrame:
    """The k largest by a column, the earlier of equals."""
    w = by_video().orderBy(F.desc(column), "frame_idx")
    return f.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k).select("video_id", "frame_idx", "rank")


def strided(f: DataFrame, step: int = 3) -> DataFrame:
    """Every step-th frame and the last."""
    pos = F.row_number().over(in_order()) - 1
    return f.select("video_id", "frame_idx", pos.alias("pos"), F.count(F.lit(1)).over(by_video()).alias("n")).filter((F.col("pos") % step == 0) | (F.col("pos") == F.col("n") - 1)).select("video_id", "frame_idx")


def random_sample(f: DataFrame, k: int, seed: int) -> DataFrame:
    """K frames by a seeded hash: the same for the same seed, however the rows are partitioned."""
    w = by_video().orderBy(F.xxhash64(F.lit(seed), "video_id", "frame_idx"), "frame_idx")
    return f.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).select("video_id", "frame_idx")


def spans(f: DataFrame, part: float = 0.05) -> DataFrame:
    """F16: three questions a video, of the families C, T and D, with their spans; widths are parts of the
    video's duration."""
    d = f.groupBy("video_id").agg(F.max("timestamp").alias("duration"))
    q = d.withColumn("qid", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("family", F.element_at(F.array(F.lit("C"), F.lit("T"), F.lit("D")), F.col("qid") + 1))
    t = F.col("duration")
    start = F.when(F.col("family") == "C", t / 4).when(F.col("family") == "T", t * (F.col("video_id") % 3) / 3).otherwise(F.lit(0.0))
    end = F.when(F.col("family") == "C", t / 4 + t * part * 2).when(F.col("family") == "T", t * (F.col("video_id") % 3) / 3 + t * part).otherwise(t)
    return q.select("video_id", F.col("qid").cast("bigint").alias("qid"), "family", start.alias("start_time"), end.alias("end_time"))


def selection_coverage(selected: DataFrame, events: DataFrame) -> DataFrame:
    """selected(video_id, timestamp) against events(video_id, qid, start_time, end_time). No truth: all null; an
    empty selection: 0, 999, 0 and 1."""
    s, e = F.col("start_time"), F.col("end_time")
    t = F.col("timestamp")
    j = events.join(selected.select("video_id", "timestamp"), "video_id", "left")
    a = j.groupBy("video_id", "qid", "family", "start_time", "end_time").agg(
        F.max(interval_hit(t, s, e).cast("int")).alias("hit"), F.min(interval_distance(t, s, e)).alias("dist"), F.max(interval_iou(t - 0.5, t + 0.5, s, e)).alias("iou")
    )
    ok = valid_interval(s, e)
    hit = F.coalesce(F.col("hit"), F.lit(0))
    return a.select("video_id", "qid", "family", F.when(ok, hit).cast("bigint").alias("window_coverage"), F.when(ok, F.coalesce("dist", F.lit(999.0))).alias("min_temp_dist"), F.when(ok, F.coalesce("iou", F.lit(0.0))).alias("best_iou"), F.when(ok, 1 - hit).cast("bigint").alias("zero_overlap"))


def ranked_retrieval(ranked: DataFrame, events: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """ranked(video_id, timestamp, rank from 1): recall at k, and the reciprocal rank of the first hit over
    all ranks."""
    hit = F.col("timestamp").between(F.col("start_time"), F.col("end_time"))
    first = events.filter(valid_interval(F.col("start_time"), F.col("end_time"))).join(ranked.select("video_id", "timestamp", "rank"), "video_id", "left").groupBy("video_id", "qid", "family").agg(F.min(F.when(hit, F.col("rank"))).alias("first"))
    return first.select("video_id", "qid", "family", *[F.coalesce((F.col("first") <= k).cast("bigint"), F.lit(0).cast("bigint")).alias(f"recall_at_{k}") for k in ks], F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def frames_in_window(selected: DataFrame, events: DataFrame) -> DataFrame:
    """E5: share of selected frames inside the span, and the share of the predicted range that it covers."""
    hit = F.col("timestamp").between(F.col("start_time"), F.col("end_time"))
    a = events.join(selected.select("video_id", "timestamp"), "video_id").groupBy("video_id", "qid", "family", "start_time", "end_time").agg(F.avg(hit.cast("double")).alias("fiw"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    both = F.greatest(F.least("hi", "end_time") - F.greatest("lo", "start_time"), F.lit(0.0))
    return a.select("video_id", "qid", "family", "fiw", F.coalesce(F.try_divide(both, F.col("hi") - F.col("lo")), F.lit(0.0)).alias("iop"))


def overall_and_by(df: DataFrame, key: str, **aggregates) -> DataFrame:
    """Totals and groups in one pass by grouping sets."""
    names = [F.expr(e).alias(n) for n, e in aggregates.items()]
    return df.rollup(key).agg(*names).select(F.coalesce(key, F.lit("overall")).alias(key), *aggregates)


def threshold_grid(scored: DataFrame, actions: list[float], persistences: list[float]) -> DataFrame:
    """Frames kept by each pair of thresholds, with the compression; the grid is a small stated set."""
    spark = scored.sparkSession
    grid = spark.createDataFrame([(a, p) for a in actions for p in persistences], "action_t double, persistence_t double")
    kept = (F.col("action_score") >= F.col("action_t")) | (F.col("persistence_value") >= F.col("persistence_t"))
    g = scored.crossJoin(F.broadcast(grid)).groupBy("action_t", "persistence_t").agg(F.count_if(kept).alias("kept"), F.count(F.lit(1)).alias("total"))
    return g.select("action_t", "persistence_t", "kept", (1 - F.col("kept") / F.col("total")).alias("compression"))


def grid_recall(scored: DataFrame, events: DataFrame, actions: list[float], persistences: list[float], k: int = 5) -> DataFrame:
    """For each pair of thresholds the share of events that one of the k best kept frames of the video hits, with
    the compression."""
    grid = scored.sparkSession.createDataFrame([(a, p) for a in actions for p in persistences], "action_t double, persistence_t double")
    kept = (F.col("action_score") >= F.col("action_t")) | (F.col("persistence_value") >= F.col("persistence_t"))
    best = Window.partitionBy("video_id", "action_t", "persistence_t").orderBy(F.desc("action_score"), "frame_idx")
    top = scored.crossJoin(F.broadcast(grid)).filter(kept).withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k)
    asked = events.crossJoin(F.broadcast(grid)).join(top.select("video_id", "action_t", "persistence_t", "timestamp"), ["video_id", "action_t", "persistence_t"], "left")
    hit = F.coalesce(F.max(F.col("timestamp").between(F.col("start_time"), F.col("end_time")).cast("int")), F.lit(0))
    recall = asked.groupBy("video_id", "qid", "action_t", "persistence_t").agg(hit.alias("hit")).groupBy("action_t", "persistence_t").agg(F.avg("hit").alias("recall"))
    return recall.join(threshold_grid(scored, actions, persistences), ["action_t", "persistence_t"])


def best_tradeoff(rows: DataFrame, tie: float = 1e-5) -> DataFrame:
    """Of rows(action_t, persistence_t, recall, compression) the one with the largest recall; of those within `tie` of it the
    one with the largest compression, then the least thresholds."""
    best = rows.agg(F.max("recall").alias("most"))
    return rows.crossJoin(F.broadcast(best)).filter(F.col("recall") >= F.col("most") - tie).drop("most").orderBy(F.desc("compression"), "action_t", "persistence_t").limit(1)


def event_frames(f: DataFrame, events: DataFrame) -> DataFrame:
    """Events as ranges of frames: the first and last frame in the event's time; events without frames are left out."""
    j = events.join(f.select("video_id", "frame_idx", "timestamp"), "video_id").filter(F.col("timestamp").between(F.col("start_time"), F.col("end_time")))
    return j.groupBy("video_id", F.col("qid").alias("event_id")).agg(F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"))


def event_metrics(events: DataFrame, sampled: DataFrame, f: DataFrame) -> DataFrame:
    """Per video with events: the share of events that a sampled frame hits, of the events' frames (their union) that
    are sampled, and of sampled frames that are in an event (null without samples)."""
    inside = F.col("frame_idx").between(F.col("start_frame"), F.col("end_frame"))
    chosen = sampled.select("video_id", "frame_idx").distinct()
    hits = events.join(chosen, "video_id", "left").groupBy("video_id", "event_id").agg(F.coalesce(F.max(inside.cast("int")), F.lit(0)).alias("hit"))
    recall = hits.groupBy("video_id").agg(F.avg("hit").alias("event_recall"))
    union = f.select("video_id", "frame_idx").join(events, "video_id").filter(inside).select("video_id", "frame_idx").distinct()
    both = union.withColumn("in_event", F.lit(1)).join(chosen.withColumn("chosen", F.lit(1)), ["video_id", "frame_idx"], "full_outer")
    n = both.groupBy("video_id").agg(F.count("in_event").alias("frames"), F.count("chosen").alias("samples"), F.sum(F.col("in_event") * F.col("chosen")).alias("common"))
    common = F.coalesce("common", F.lit(0))
    return recall.join(n, "video_id", "left").select("video_id", "event_recall", F.try_divide(common, F.col("frames")).alias("frame_recall"), F.try_divide(common, F.col("samples")).alias("survivor_precision"))


def strongest_baseline(coverage: DataFrame, proposed: str) -> DataFrame:
    """From coverage(method_name, window_coverage) the proposed method's mean, the best other method and its mean, and the improvement."""
    m = coverage.groupBy("method_name").agg(F.avg("window_coverage").alias("c"))
    other = F.col("method_name") != proposed
    row = m.agg(F.max(F.when(~other, F.col("c"))).alias("proposed"), F.max(F.when(other, F.struct("c", "method_name"))).alias("b"))
    return row.select("proposed", F.col("b.method_name").alias("baseline"), F.col("b.c").alias("baseline_coverage"), (F.col("proposed") - F.col("b.c")).alias("improvement"))


def claim_gate(coverage: DataFrame, proposed: str, least: float = 0.03, replicates: int = 500) -> DataFrame:
    """strongest_baseline with the bootstrap interval, over videos, of the difference: the gate passes where the interval leaves
    out 0 and the improvement is at least `least`."""
    best = strongest_baseline(coverage, proposed)
    j = coverage.join(F.broadcast(best.select("baseline")))
    sign = F.when(F.col("method_name") == proposed, 1).when(F.col("method_name") == F.col("baseline"), -1)
    side = lambda s: F.avg(F.when(sign == s, F.col("window_coverage")))
    diff = j.groupBy("video_id").agg((side(1) - side(-1)).alias("diff"))
    ci = bootstrap_interval(diff, "diff", replicates).select("ci_lower", "ci_upper")
    sure = (F.col("ci_lower") > 0) | (F.col("ci_upper") < 0)
    return best.join(F.broadcast(ci)).withColumn("passes", sure & (F.col("improvement") >= least))


def stratified_allocation(groups: DataFrame, key: str, n: int) -> DataFrame:
    """Half-even rounded shares of n; the remainder goes to the largest group."""
    w = Window.partitionBy()
    c = groups.groupBy(key).count().withColumn("share", F.bround(F.lit(n) * F.col("count") / F.sum("count").over(w)).cast("bigint"))
    largest = F.row_number().over(w.orderBy(F.desc("count"), key)) == 1
    return c.select(key, F.col("count").alias("available"), (F.col("share") + F.when(largest, n - F.sum("share").over(w)).otherwise(0)).alias("allocated"))


def mean_pairwise_cosine(v: DataFrame, key: str, column: str) -> DataFrame:
    """A30 without pairs: (|sum of units|^2 - n) / (n (n - 1))."""
    units = v.select(key, F.transform(F.col(column), lambda x: x.cast("double")).alias("x")).withColumn("x", F.transform("x", lambda y: y / F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, z: s + z * z))))
    sums = units.select(key, F.posexplode("x").alias("pos", "y")).groupBy(key, "pos").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.groupBy(key).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q")).select(key, "n", F.when(F.col("n") > 1, (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cosine"))


def spearman(f: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average-tied ranks, per video."""
    rank = lambda c: F.rank().over(by_video().orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("video_id", c)) - 1) / 2
    return f.select("video_id", rank(a).alias("ra"), rank(b).alias("rb")).groupBy("video_id").agg(F.corr("ra", "rb").alias("rho"))


def fidelity_margin(f: DataFrame) -> DataFrame:
    """f(video_id, frame_idx, caption_embedding, clip_embedding): the cosine of a frame's caption to its own frame minus its mean cosine to all
    other frames of the video. The latter is one product with the sum of the video's unit vectors, so no pairs are made. Rows without one of the
    vectors are left out; a frame that is alone in its video has a null margin."""

    def unit(c: str) -> Column:
        # the length as an array beside the vector: inside the lambda it would be computed anew for every component
        length = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, z: s + z.cast("double") * z.cast("double")))
        return F.zip_with(c, F.array_repeat(length, F.size(c)), lambda y, n: y.cast("double") / n)

    u = f.filter("caption_embedding is not null and clip_embedding is not null").select("video_id", "frame_idx", unit("caption_embedding").alias("cap"), unit("clip_embedding").alias("vis"))
    sums = u.select("video_id", F.posexplode("vis").alias("pos", "y")).groupBy("video_id", "pos").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    sums = sums.groupBy("video_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("total"), F.max("n").alias("n"))
    own = dot(F.col("cap"), F.col("vis"))
    return u.join(sums, "video_id").select("video_id", "frame_idx", F.when(F.col("n") > 1, own - (dot(F.col("cap"), F.col("total")) - own) / (F.col("n") - 1)).alias("margin"))
