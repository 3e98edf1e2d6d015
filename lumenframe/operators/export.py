"""Exports, health reports, bootstrap intervals, scene splitting and text extraction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .signal import find_peaks

#: Words that no query phrase keeps (fixed values).
STOP_WORDS = "a an and are as at be by did do does for from had has have he her his how i in is it its of on or she that the their them they this to was were what when where which who why with you".split()


def feature_matrix(f: DataFrame, scalars: list[str], motion: str | None = None, embedding: str | None = None) -> DataFrame:
    """One vector a frame: scalars, then the arrays, padded with zeros to the widest."""
    parts = [F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in scalars])]
    widths = f.agg(*[F.coalesce(F.max(F.size(c)), F.lit(0)).alias(c) for c in (motion, embedding) if c]).first() if motion or embedding else {}
    for c in (motion, embedding):
        if c:
            x = F.coalesce(F.transform(c, lambda y: y.cast("double")), F.array().cast("array<double>"))
            parts.append(F.concat(x, F.array_repeat(F.lit(0.0), F.lit(widths[c]) - F.size(x))))
    return f.select("video_id", "frame_idx", F.concat(*parts).alias("features"))


def embedding_health(v: DataFrame, key: str, column: str) -> DataFrame:
    """Vectors, distinct ones at six decimals, norms, and the mean deviation of a dimension."""
    n = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double")))
    flat = F.concat_ws(",", F.transform(column, lambda y: F.format_number(y.cast("double"), 6)))
    whole = v.groupBy(key).agg(F.count(F.lit(1)).alias("vectors"), F.countDistinct(flat).alias("distinct_vectors"), F.min(n).alias("min_norm"), F.max(n).alias("max_norm"))
    dims = v.select(key, F.posexplode(column).alias("pos", "y")).groupBy(key, "pos").agg(F.stddev_pop("y").alias("s")).groupBy(key).agg(F.avg("s").alias("mean_std"))
    return whole.join(dims, key)


def bootstrap_interval(values: DataFrame, column: str, replicates: int = 500, seed: int = 1, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean over videos, values(video_id, ...) first averaged per video. A
    video's weight in a replicate is Poisson(1) by a seeded hash, so all replicates are one pass without
    drawing or collecting; the replicates are a stated, fixed set."""
    v = values.groupBy("video_id").agg(F.avg(column).alias("m"))
    r = v.crossJoin(F.broadcast(values.sparkSession.range(replicates).withColumnRenamed("id", "replicate")))
    u = F.pmod(F.xxhash64(F.lit(seed), "video_id", "replicate"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    steps = np.cumsum(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720.0]))
    weight = sum((F.when(u >= float(s), 1).otherwise(0) for s in steps), F.lit(0))
    means = r.groupBy("replicate").agg(F.try_divide(F.sum(weight * F.col("m")), F.sum(weight)).alias("mean"))
    tail = (1 - level) / 2
    interval = means.agg(F.percentile("mean", F.array(F.lit(tail), F.lit(1 - tail))).alias("p"), F.count(F.lit(1)).alias("replicates"))
    return v.agg(F.avg("m").alias("mean"), F.count(F.lit(1)).alias("videos")).crossJoin(interval).select("mean", "videos", "replicates", F.col("p")[0].alias("ci_lower"), F.col("p")[1].alias("ci_upper"))


def split_oversized(f: DataFrame, spans: DataFrame, cap: int, column: str = "packet_size") -> DataFrame:
    """Spans with more than `cap` likely survivors are split until none has: frames that are no keyframes and reach the 90th percentile of the
    span's own curve. A split is at the lowest such frame inside the span (the earliest of equals), in its middle if fewer than three are
    inside. Each choice depends on the one before, so a span is one row (300 frames at most where valley_scenes made it)."""
    if cap < 1:
        raise ValueError("a span has to be allowed one survivor")

    def upper(x: np.ndarray) -> float:
        """np.percentile(x, 90), without its overhead on a few values."""
        x, at = np.sort(x), (len(x) - 1) * 0.9
        low, t = int(at), at - int(at)
        a, b = x[low], x[min(low + 1, len(x) - 1)]
        return a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t)

    def one(start: int, end: int, at: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
        todo, done = [(start, end)], []
        while todo:
            a, b = todo.pop()
            x = v[np.searchsorted(at, a) : np.searchsorted(at, b)]
            if not len(x) or (x >= upper(x)).sum() <= cap:
                done.append((a, b))
                continue
            i, j = np.searchsorted(at, a, "right"), np.searchsorted(at, b)
            cut = int(at[i + v[i:j].argmin()]) if j - i >= 3 else (a + b) // 2
            todo += [(a, cut), (cut, b)]
        return done

    def run(batches):
        for g in batches:
            rows = []
            for video, start, end, at, v in g.itertuples(index=False):
                rows += [(video, a, b) for a, b in one(start, end, np.asarray(at, int), np.asarray(v, float))]
            yield pd.DataFrame(rows, columns=["video_id", "start_idx", "end_idx"])

    at = spans.select("video_id", "start_idx", "end_idx", F.explode(F.sequence("start_idx", F.col("end_idx") - 1)).alias("frame_idx"))
    curve = f.filter("pict_type != 'I'").select("video_id", "frame_idx", F.col(column).cast("double").alias("v"))
    # a span's curve is one short row, and tasks read many of them at once: a Python group for each cost far more than its work
    curves = at.join(curve, ["video_id", "frame_idx"], "left").groupBy("video_id", "start_idx", "end_idx").agg(F.sort_array(F.collect_list(F.when(F.col("v").isNotNull() & ~F.isnan("v"), F.struct("frame_idx", "v")))).alias("c"))
    split = curves.select("video_id", "start_idx", "end_idx", "c.frame_idx", "c.v").mapInPandas(run, "video_id long, start_idx long, end_idx long")
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("start_idx")) - 1
    return split.select("video_id", number.cast("bigint").alias("scene_id"), "start_idx", "end_idx")


def bursts(f: DataFrame, spans: DataFrame, column: str = "packet_size", percentile: float = 75, distance: int = 15) -> DataFrame:
    """Peaks per scene on the curve of its frames that are no keyframes: of at least the scene's percentile and
    `distance` frames of that curve apart. A scene is one group (300 frames at most); one with fewer than two such frames has none."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values("frame_idx")[column].dropna().to_numpy(float)
        found = len(find_peaks(x, distance, -np.inf, float(np.percentile(x, percentile)))[0]) if len(x) > 1 else 0
        return pd.DataFrame({"video_id": g["video_id"].iloc[:1], "scene_id": g["scene_id"].iloc[:1], "bursts": [found]})

    at = spans.select("video_id", "scene_id", F.explode(F.sequence("start_idx", F.col("end_idx") - 1)).alias("frame_idx"))
    plain = f.select("video_id", "frame_idx", F.when(F.col("pict_type") != "I", F.col(column)).alias(column))
    return at.join(plain, ["video_id", "frame_idx"]).groupBy("video_id", "scene_id").applyInPandas(one, "video_id long, scene_id long, bursts long")


def query_phrase(question: Column, most: int = 8) -> Column:
    """the question's first words that say something, lower-cased."""
    words = F.filter(F.split(F.lower(question), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(STOP_WORDS))
    return F.array_join(F.slice(words, 1, most), " ")


def reformulated(questions: DataFrame, most: int = 5) -> DataFrame:
    """questions(qid, question) to query variants: the question, its phrase, the phrase in the middle, start or
    end where it names one; without case-insensitive repeats, up to `most`."""
    q = F.lower("question")
    place = F.when(q.rlike(r"\b(middle|during)\b"), "middle").when(q.rlike(r"\b(start|beginning|before|first)\b"), "start").when(q.rlike(r"\b(end|after|finally|last)\b"), "end")
    phrase = query_phrase(F.col("question"))
    every = F.array_compact(F.array(F.trim("question"), phrase, F.concat(phrase, F.lit(" at the "), place), F.when(q.rlike(r"^\s*(why|how)\b"), F.concat(F.lit("reason "), phrase))))
    v = questions.select("qid", place.alias("relation"), F.posexplode(every).alias("pos", "query")).filter("query != ''")
    first = Window.partitionBy("qid", F.lower("query")).orderBy("pos")
    kept = v.withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    place_of = F.row_number().over(Window.partitionBy("qid").orderBy("pos"))
    return kept.withColumn("place", place_of.cast("bigint")).filter(F.col("place") <= most).select("qid", "relation", "place", "query")


def first_object(text: str | None) -> str | None:
    """The first balanced {...} of a text, of its fenced block where it has one."""
    if not text:
        return None
    text = text.partition("```json")[2].partition("```")[0] or text
    begin = text.find("{")
    depth, quoted, skip = 0, False, False
    for k in range(max(begin, 0), len(text)):
        c = text[k]
        if skip:
            skip = False
        elif c == "\\":
            skip = quoted
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[begin : k + 1]
    return None


def json_object(raw: Column) -> Column:
    """brace counting is no regular expression, so it is an Arrow-batched function."""

    def of(texts: pd.Series) -> pd.Series:
        return texts.map(first_object)

    return F.pandas_udf(of, "string")(raw)
