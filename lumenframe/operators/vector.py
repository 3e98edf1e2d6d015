"""Vector search by tiers, product quantisation, diversity, and the scored cache."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import by_video, cosine


def tiered_exact(v: DataFrame, queries: DataFrame, top_k: int = 5) -> DataFrame:
    """Exact cosine within each tier, merged; v(vec_id, embedding, tier). All tiers use the
    same measure and every vector is searched."""
    s = v.crossJoin(F.broadcast(queries)).withColumn("sim", F.round(cosine(F.col("embedding"), F.col("q")), 6) + F.lit(0.0))
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    return s.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= top_k).select("query_id", "rank", "vec_id", "tier", "sim")


def tier_memory(v: DataFrame, m: int = 8) -> DataFrame:
    """Bytes of each tier flat (4 a dimension) and as codes (m a vector)."""
    t = v.groupBy("tier").agg(F.count(F.lit(1)).alias("vectors"), F.sum(4 * F.size("embedding")).alias("flat_bytes"))
    return t.select("tier", "vectors", F.col("flat_bytes").cast("bigint").alias("flat_bytes"), (F.col("vectors") * m).alias("code_bytes"), (F.col("flat_bytes") / (F.col("vectors") * m)).alias("reduction"))


def lsh_neighbours(v: DataFrame, queries: DataFrame, radius: float = 1.0) -> DataFrame:
    """G10, salient tier: approximate range join by random projections."""
    vec = lambda df, k, c: df.select(F.col(k), array_to_vector(F.transform(c, lambda x: x.cast("double"))).alias("x"))
    a, b = vec(v, "vec_id", "embedding"), vec(queries, "query_id", "q")
    model = BucketedRandomProjectionLSH(inputCol="x", outputCol="h", bucketLength=1.0, numHashTables=4, seed=7).fit(a)
    j = model.approxSimilarityJoin(a, b, radius, "distance")
    return j.select(F.col("datasetB.query_id").alias("query_id"), F.col("datasetA.vec_id").alias("vec_id"), F.round("distance", 6).alias("distance"))


def pq_search(v: DataFrame, queries: DataFrame, parts: int = 8, centres: int = 16, top_k: int = 5) -> DataFrame:
    """G10, F11, candidate tier: k-means codes per subspace and a table of distances a query; 1 / (1 + d)."""
    width = F.size("embedding") / parts
    split = lambda df, k, c: df.select(k, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(c, (i * width).cast("int") + 1, width.cast("int")))).alias("part", "piece"))
    total = None
    for p in range(parts):
        x = split(v, "vec_id", "embedding").filter(F.col("part") == p).select("vec_id", array_to_vector(F.transform("piece", lambda y: y.cast("double"))).alias("features"))
        model = KMeans(k=centres, seed=11 + p, maxIter=10).fit(x)
        codes = model.transform(x).select("vec_id", F.col("prediction").alias("code"))
        spark = v.sparkSession
        book = spark.createDataFrame([(i, [float(y) for y in c]) for i, c in enumerate(model.clusterCenters())], "code int, centre array<double>")
        q = queries.withColumnRenamed("q", "embedding")
        qs = split(q, "query_id", "embedding").filter(F.col("part") == p).select("query_id", "piece")
        table = qs.crossJoin(F.broadcast(book)).select("query_id", "code", F.aggregate(F.zip_with("piece", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, y: s + y).alias("d"))
        part = codes.join(F.broadcast(table), "code").select("query_id", "vec_id", "d")
        total = part if total is None else total.union(part)
    d = total.groupBy("query_id", "vec_id").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("query_id").orderBy("d", "vec_id")
    return d.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= top_k).select("query_id", "rank", "vec_id", F.round(1 / (1 + F.col("d")), 6).alias("sim"))


def kmeans_diversity(v: DataFrame, k: int = 8) -> DataFrame:
    """The member closest to each of k centres."""
    x = v.select("vec_id", array_to_vector(F.transform("embedding", lambda y: y.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=3, maxIter=20).fit(x)
    book = v.sparkSession.createDataFrame([(i, [float(y) for y in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, centre array<double>")
    a = model.transform(x).join(v.select("vec_id", "embedding"), "vec_id").join(F.broadcast(book), "prediction")
    d = F.aggregate(F.zip_with("embedding", "centre", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, y: s + y)
    return a.groupBy(F.col("prediction").cast("bigint").alias("cluster")).agg(F.min_by("vec_id", F.struct(d, F.col("vec_id"))).alias("vec_id"), F.count(F.lit(1)).alias("members"))


def motion_embedding(*channels: Column) -> Column:
    """F8: unit vector of the motion channels, zeros where they are all but zero."""
    x = F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in channels])
    n = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y))
    return F.when(n < 1e-8, F.transform(x, lambda y: F.lit(0.0))).otherwise(F.transform(x, lambda y: y / n))


def dual_similarity(visual: Column, motion: Column) -> Column:
    """F9."""
    return 0.7 * visual + 0.3 * motion


def cache_fold(f: DataFrame, capacity: int) -> DataFrame:
    """ST1: the cache after its admissions in frame order: a known frame is refreshed and keeps its place; a full
    cache evicts its lowest score just if the newcomer's is strictly higher. Order decides, so a video is
    one group, and its state has `capacity` rows."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, tuple[float, int]] = {}
        admitted = 0
        for frame, score in g.sort_values("frame_idx")[["frame_idx", "score"]].itertuples(index=False):
            if frame in held:
                held[frame] = (score, held[frame][1])
                continue
            if len(held) >= capacity:
                low = min(held, key=lambda k: (held[k][0], k))
                if score <= held[low][0]:
                    continue
                del held[low]
            held[frame] = (score, admitted)
            admitted += 1
        return pd.DataFrame([(g["video_id"].iloc[0], k, s, a) for k, (s, a) in held.items()], columns=["video_id", "frame_idx", "score", "admitted_at"])

    return f.select("video_id", "frame_idx", "score").groupBy("video_id").applyInPandas(one, "video_id long, frame_idx long, score double, admitted_at long")


def kept_top(f: DataFrame, score: Column, k: int) -> DataFrame:
    """T9."""
    w = by_video().orderBy(F.desc("keep_score"), "frame_idx")
    return f.withColumn("keep_score", score).withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
