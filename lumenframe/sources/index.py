"""Versions of an index: written apart, checked by hashes, and switched to at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frames of a shard: its files are hashed whole, each in one task.
SHARD = 200_000
#: What frames of older versions lack (fixed values).
DEFAULTS = {"divergence": 0.0, "curl": 0.0, "jacobian_frobenius": 0.0, "hessian_max_eigenvalue": 0.0, "motion_entropy": 0.0, "packet_size": 0.0, "pict_type": "?", "codec_conf": 0.5, "scene_id": -1}
PARTS = ("frames", "edges")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there wholly or not: written beside and renamed over what was there."""
    at, fs = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(at, spark._jvm.org.apache.hadoop.fs.Path(path), options)


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """(part, file, bytes, sha256) of a version's files; executors read them, one a task at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    some = [files.load(f"{path}/{p}").select(F.lit(p).alias("part"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")) for p in PARTS]
    return some[0].unionByName(some[1])


def write_index(frames: DataFrame, edges: DataFrame, path: str, config: dict | None = None, shards: int | None = None) -> str:
    """Writes a new version and switches to it; its name is returned. A video's rows lie together and sorted, in one of `shards` files of many
    videos (more of them for more frames, so that a file stays small enough to be hashed in one task). Readers see the old version until all files of the new one and their hashes are there; a job that dies leaves the old one."""
    spark = frames.sparkSession
    version = uuid.uuid4().hex
    at = f"{path}/versions/{version}"
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-frames.count() // SHARD))
    frames.repartition(shards, "video_id").sortWithinPartitions("video_id", "frame_idx").write.parquet(f"{at}/frames")
    edges.repartition(shards, "video_id").sortWithinPartitions("video_id", "src", "dst").write.parquet(f"{at}/edges")
    hashes(spark, at).repartition(1).write.parquet(f"{at}/manifest")
    _put(spark, f"{path}/CURRENT", json.dumps({"version": version, "config": config or {}}))
    return version


def current(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(f"{path}/CURRENT", wholetext=True).collect()
    return json.loads(rows[0]["value"])


def damaged(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """(part, file) of files whose hash is not the manifest's, that are missing, or that it does not name."""
    at = f"{path}/versions/{version or current(spark, path)['version']}"
    noted = spark.read.parquet(f"{at}/manifest").select("part", "file", F.col("sha256").alias("noted"))
    return noted.join(hashes(spark, at), ["part", "file"], "full_outer").filter(~F.col("noted").eqNullSafe(F.col("sha256"))).select("part", "file")


def read_index(spark: SparkSession, path: str, version: str | None = None, check: bool = True) -> tuple[DataFrame, DataFrame, dict]:
    """Frames, edges and configuration of the current (or a named) version. Columns that an older version lacks have their defaults; edges with an end
    that is no frame are left out. With `check`, files that are not what was written raise."""
    now = current(spark, path)
    version = version or now["version"]
    if check:
        bad = damaged(spark, path, version).limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0].part}/{bad[0].file} of version {version} is not what was written")
    at = f"{path}/versions/{version}"
    frames = spark.read.parquet(f"{at}/frames")
    frames = frames.withColumns({c: F.lit(x) for c, x in DEFAULTS.items() if c not in frames.columns}).fillna({c: x for c, x in DEFAULTS.items() if c in frames.columns})
    known = frames.select("video_id", "frame_idx")
    edges = spark.read.parquet(f"{at}/edges")
    edges = edges.join(known.withColumnRenamed("frame_idx", "src"), ["video_id", "src"], "left_semi").join(known.withColumnRenamed("frame_idx", "dst"), ["video_id", "dst"], "left_semi")
    return frames, edges, now["config"]


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (side, copies, ...) that one table has more often than the other; none if they are equal."""
    names = a.columns
    here = a.exceptAll(b.select(*names)).withColumn("side", F.lit("first"))
    there = b.select(*names).exceptAll(a).withColumn("side", F.lit("second"))
    return here.unionByName(there).groupBy("side", *names).agg(F.count(F.lit(1)).alias("copies"))
