"""Frame tables from event tables, and readers and writers of indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors with a smaller id are query embeddings.
QUERIES = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What frames(embeddings="ids") refer to by vec_id."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def frames(spark: SparkSession, sf_dir: str, embeddings: bool | str = False) -> DataFrame:
    """The frame model over events: a video is a user, frames are ordered by (ts, event_id). With embeddings they have vec_id, label and
    clip_embedding; with "ids" the vectors themselves stay in their table."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "B").otherwise("P")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    f = e.select(
        F.col("user_id").alias("video_id"),
        (F.row_number().over(order) - 1).cast("bigint").alias("frame_idx"),
        "event_id",
        ((micros - F.min(micros).over(Window.partitionBy("user_id"))) / F.lit(1e6)).alias("timestamp"),
        F.col("value").alias("packet_size"),
        F.get_json_object("props", "$.k").cast("double").alias("motion_magnitude"),
        (F.col("event_id") * 7919 % 1000 / F.lit(1000.0)).alias("luma_entropy"),
        (F.col("event_id") * 104729 % 1000 / F.lit(1000.0)).alias("luma_diff_energy"),
        kind.alias("pict_type"),
    )
    if embeddings:
        v = table(spark, sf_dir, "embeddings")
        n = v.count()
        f = f.withColumn("vec_id", F.col("event_id") % n).join(v.select("vec_id", *([] if embeddings == "ids" else [F.col("embedding").alias("clip_embedding")]), F.col("label").cast("int").alias("label")), "vec_id", "left")
    return f


def queries_of(spark: SparkSession, sf_dir: str, n: int = QUERIES) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") < n).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def packet_curve(packets: DataFrame, flush: bool = True) -> DataFrame:
    """packets(video_id, pts, size, is_keyframe) numbered 0.. by pts. Empty (flush) packets are dropped, unless the stream
    has none (`flush` is False) and a size of 0 is that of a frame; a null or repeated pts raises, as such a stream cannot be ordered."""
    p = packets.filter("size > 0") if flush else packets
    ordered = Window.partitionBy("video_id").orderBy("pts")
    sound = F.when(F.col("pts").isNull(), F.raise_error(F.lit("null pts"))).when(F.lag("pts").over(ordered) == F.col("pts"), F.raise_error(F.lit("repeated pts"))).otherwise(F.lit(True))
    return p.withColumn("sound", sound).filter("sound").select("video_id", (F.row_number().over(ordered) - 1).cast("bigint").alias("display_idx"), "pts", "size", "is_keyframe")


def validation(packets: DataFrame, probe: int = 240) -> DataFrame:
    """Verdict and reasons per video from its first packets."""
    first = packets.withColumn("k", F.row_number().over(Window.partitionBy("video_id").orderBy("pts"))).filter(F.col("k") <= probe)
    reasons = F.array_compact(F.array(F.when(F.count(F.lit(1)) == 0, "empty"), F.when(~F.bool_or("is_keyframe"), "no keyframe"), F.when(~F.bool_and(F.col("pts").isNotNull()), "missing pts"), F.when(F.count(F.lit(1)) < 2, "single packet")))
    v = first.groupBy("video_id").agg(reasons.alias("reasons"))
    return v.withColumn("verdict", F.when(F.array_contains("reasons", "missing pts"), "reject").when(F.size("reasons") > 0, "warn").otherwise("ok"))


def write_index(frame_rows: DataFrame, edges: DataFrame, path: str) -> None:
    """An index is a set of tables, partitioned by video for pruning."""
    frame_rows.write.mode("overwrite").partitionBy("video_id").parquet(f"{path}/frames")
    edges.write.mode("overwrite").partitionBy("video_id").parquet(f"{path}/edges")


def read_index(spark: SparkSession, path: str, frame_schema, edge_schema) -> tuple[DataFrame, DataFrame]:
    """Reads with explicit schemas; columns that older files lack have their defaults."""
    f = spark.read.schema(frame_schema).parquet(f"{path}/frames")
    if "codec_conf" in f.columns:
        f = f.fillna({"codec_conf": 0.5})
    return f, spark.read.schema(edge_schema).parquet(f"{path}/edges")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Multiple-choice questions with casts, family and answer text."""
    schema = "video string, frame_count int, width int, height int, question string, answer int, qid int, type string, a0 string, a1 string, a2 string, a3 string, a4 string"
    q = spark.read.schema(schema).option("header", True).csv(path)
    return q.withColumn("family", F.upper(F.substring("type", 1, 1))).withColumn("answer_text", F.element_at(F.array("a0", "a1", "a2", "a3", "a4"), F.col("answer") + 1))


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """{video: {location: {qid: [[s, e], ...]}, duration, fps}} to rows; a bare [s, e] is one span."""
    inner = "map<string,struct<location:map<string,string>,duration:double,fps:double>>"
    videos = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", inner)).alias("video", "v"))
    spans = F.coalesce(F.from_json("spans", "array<array<double>>"), F.array(F.from_json("spans", "array<double>")))
    return videos.select("video", "v.duration", "v.fps", F.explode("v.location").alias("qid", "spans")).select("video", "duration", "fps", "qid", F.explode(spans).alias("s")).select("video", "duration", "fps", F.col("qid").cast("int").alias("qid"), F.col("s")[0].alias("start"), F.col("s")[1].alias("end"))


def read_events_txt(spark: SparkSession, path: str) -> DataFrame:
    """Ten-column whitespace text to one interval per event."""
    parts = spark.read.text(path).select(F.input_file_name().alias("file"), F.split(F.trim("value"), r"\s+").alias("c")).filter(F.size("c") >= 10)
    return parts.groupBy("file", F.col("c")[0].cast("int").alias("event_id"), F.col("c")[1].cast("int").alias("event_type")).agg(F.min(F.col("c")[5].cast("int")).alias("start_frame"), F.max(F.col("c")[5].cast("int")).alias("end_frame"))
