from pyspark.sql import functions as F

from lumenframe.streaming.packets import cached, packet_energy


def _run(df, spark, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_packet_energy(spark, tmp_path):
    spark.range(10).select(F.lit(1).cast("long").alias("video_id"), F.timestamp_seconds(F.col("id") / 4).alias("ts"), F.lit(2.0).alias("size")).write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("video_id long, ts timestamp, size double").parquet(str(tmp_path / "p"))
    rows = _run(packet_energy(stream), spark, "energy", "complete").orderBy("start").collect()
    assert [r.energy for r in rows] == [8.0, 8.0, 4.0]


def test_cache_state(spark, tmp_path):
    spark.createDataFrame([(1, i, s) for i, s in enumerate([0.5, 0.6, 0.4, 0.9])], "video_id long, frame_idx long, score double").coalesce(1).write.parquet(str(tmp_path / "f"))
    stream = spark.readStream.schema("video_id long, frame_idx long, score double").parquet(str(tmp_path / "f"))
    assert {(r.frame_idx, r.admitted_at) for r in _run(cached(stream, 2), spark, "cache", "append").collect()} == {(0, 0), (1, 1), (3, 2)}
