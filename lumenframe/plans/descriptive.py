"""Descriptive queries and their SQL: name to (query, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import r6
from ..operators import claims as C
from ..operators import metrics as M
from ..operators import statistics as T
from ..sources.frames import frames, table
from .oracle import FRAMES, w

_PICKS = "pk AS (SELECT video_id, frame_idx, timestamp, rn FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY packet_size DESC, frame_idx) AS rn FROM f) WHERE rn <= 8)"
_GOLD = "du AS (SELECT video_id, max(timestamp) AS t FROM f GROUP BY ALL), go AS (SELECT video_id, qid, family, CASE family WHEN 'C' THEN t / 4 ELSE t * (video_id % 3) / 3 END AS s, CASE family WHEN 'C' THEN t / 4 + t * 0.05 * 2 ELSE t * (video_id % 3) / 3 + t * 0.05 END AS e FROM du CROSS JOIN (VALUES (0::BIGINT, 'C'), (1::BIGINT, 'T')) q(qid, family))"


def _r(df, *columns):
    return df.withColumns({c: r6(F.col(c)) for c in columns})


def _top(s, d):
    f = frames(s, d)
    return M.top_k(f, "packet_size", 8).join(f.select("video_id", "frame_idx", "timestamp"), ["video_id", "frame_idx"])


def _gold(s, d):
    return M.spans(frames(s, d)).filter("family != 'D'")


def jaccard(s, d):
    f = frames(s, d)
    rows = None
    for k, column in enumerate(("packet_size", "motion_magnitude", "luma_entropy")):
        part = M.top_k(f, column, 8).groupBy("video_id").agg(F.collect_list("frame_idx").alias("items")).select("video_id", F.lit(k).alias("list_id"), "items")
        rows = part if rows is None else rows.union(part)
    return _r(T.mean_pairwise_jaccard(rows), "jaccard")


_LISTS = ", ".join(f"l{k} AS (SELECT video_id, {k} AS k, list(frame_idx) AS items FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY {c} DESC, frame_idx) AS rn FROM f) WHERE rn <= 8 GROUP BY ALL)" for k, c in enumerate(("packet_size", "motion_magnitude", "luma_entropy")))

QUERIES = {
    "bucket_histogram": (
        lambda s, d: T.bucket_histogram(frames(s, d).groupBy("video_id").count(), "count", [50, 60, 70]),
        w(FRAMES, "c AS (SELECT count(*) AS n FROM f GROUP BY video_id), b(place, bucket, lo, hi) AS (VALUES (0, '<=50', -1, 50), (1, '<=60', 50, 60), (2, '<=70', 60, 70), (3, '>70', 70, 1000000000))", "SELECT place::BIGINT AS place, bucket, (SELECT count(*) FROM c WHERE n > lo AND n <= hi) AS n FROM b"),
    ),
    "distribution_stats": (
        lambda s, d: _r(T.distribution(frames(s, d), "pict_type", "packet_size"), "mean", "std", "min", "q25", "median", "q75", "max"),
        w(FRAMES, "SELECT pict_type, count(*) AS n, round(avg(packet_size), 6) AS mean, round(stddev_pop(packet_size), 6) AS std, round(min(packet_size), 6) AS min, round(quantile_cont(packet_size, 0.25), 6) AS q25, round(quantile_cont(packet_size, 0.5), 6) AS median, round(quantile_cont(packet_size, 0.75), 6) AS q75, round(max(packet_size), 6) AS max FROM f GROUP BY ALL"),
    ),
    "pearson": (lambda s, d: _r(T.pearson(frames(s, d), "video_id", "packet_size", "luma_entropy"), "r"), w(FRAMES, "SELECT video_id, round(corr(packet_size, luma_entropy), 6) + 0.0 AS r, count(*) AS n FROM f GROUP BY ALL")),
    "caption_diversity": (
        lambda s, d: _r(T.diversity(table(s, d, "documents"), "text", F.lower("text")), "unique_ratio", "normalized_ratio", "mean_length"),
        "SELECT count(*) AS n, round(count(DISTINCT text) / count(*), 6) AS unique_ratio, round(count(DISTINCT lower(text)) / count(*), 6) AS normalized_ratio, round(avg(length(text)), 6) AS mean_length FROM documents WHERE text IS NOT NULL",
    ),
    "most_repeated": (lambda s, d: T.most_repeated(table(s, d, "documents").withColumn("caption", C.caption_normalized(F.substring_index("text", ".", 1))), "caption"), r"SELECT caption, count(*) AS n FROM (SELECT trim(regexp_replace(regexp_replace(lower(split_part(text, '.', 1)), '[^\p{L}\p{N} \n\t]', '', 'g'), '[ \n\t]+', ' ', 'g')) AS caption FROM documents WHERE text IS NOT NULL) GROUP BY caption ORDER BY n DESC, caption LIMIT 5"),
    "codec_sanity": (
        lambda s, d: _r(T.codec_sanity(frames(s, d)), "mean", "std", "spread"),
        w(FRAMES, "g AS (SELECT video_id, count(*) FILTER (pict_type = 'I') AS i, count(*) FILTER (pict_type = 'P') AS p, count(*) FILTER (pict_type = 'B') AS b, avg(packet_size) AS mean, coalesce(stddev_samp(packet_size), 0.0) AS std, max(packet_size) / greatest(min(packet_size), 1.0) AS spread FROM f GROUP BY ALL)", "SELECT video_id, i, p, b, round(mean, 6) AS mean, round(std, 6) AS std, round(spread, 6) AS spread, CASE WHEN p + b = 0 OR std < 10 OR spread < 5 THEN 'SUSPECT' ELSE 'PASS' END AS status FROM g"),
    ),
    "first_per_group": (
        lambda s, d: T.first_per_group(table(s, d, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "role"),
        "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3",
    ),
    "temporal_coverage": (
        lambda s, d: _r(T.temporal_coverage(_top(s, d), frames(s, d)), "coverage"),
        w(FRAMES, _PICKS, "n AS (SELECT video_id, count(*) AS n FROM f GROUP BY ALL)", "SELECT n.video_id, round(CASE WHEN n > 1 AND count(pk.video_id) > 0 THEN (max(frame_idx) - min(frame_idx)) / (n - 1) ELSE 0.0 END, 6) AS coverage FROM n LEFT JOIN pk ON pk.video_id = n.video_id GROUP BY n.video_id, n"),
    ),
    "matched_stems": (
        lambda s, d: T.matched_stems(table(s, d, "events").filter("event_id % 2 = 0").select(F.col("user_id").alias("stem")), table(s, d, "events").filter("event_type = 'error'").select(F.col("user_id").alias("stem"))),
        "SELECT stem, CASE WHEN l IS NULL THEN 'right' WHEN r IS NULL THEN 'left' ELSE 'both' END AS side FROM (SELECT DISTINCT user_id AS stem, 1 AS l FROM events WHERE event_id % 2 = 0) FULL JOIN (SELECT DISTINCT user_id AS stem, 1 AS r FROM events WHERE event_type = 'error') USING (stem)",
    ),
    "mean_pairwise_jaccard": (
        jaccard,
        w(FRAMES, _LISTS, "al AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)", "SELECT a.video_id, round(avg(len(list_intersect(a.items, b.items)) / len(list_distinct(list_concat(a.items, b.items)))), 6) AS jaccard FROM al a JOIN al b ON a.video_id = b.video_id AND a.k < b.k GROUP BY ALL"),
    ),
    "split_overlap": (
        lambda s, d: T.overlap(table(s, d, "conversations").filter("conv_id % 3 = 0"), table(s, d, "conversations").filter("conv_id % 2 = 0"), ["conv_id", "turn"]),
        "SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id % 6 = 0",
    ),
    "matched_gold": (
        lambda s, d: _r(T.matched_gold(_gold(s, d).filter("video_id % 2 = 0").select("video_id", "qid", "family"), _gold(s, d)), "start_time", "end_time"),
        w(FRAMES, _GOLD, "SELECT video_id::VARCHAR AS video_id, qid::VARCHAR AS qid, family, round(s, 6) + 0.0 AS start_time, round(e, 6) + 0.0 AS end_time FROM go WHERE video_id % 2 = 0"),
    ),
    "uniform_timestamps": (
        lambda s, d: T.uniform_timestamps(frames(s, d).groupBy("video_id").agg(F.max("timestamp").alias("duration")), 8).withColumn("timestamp", F.round("timestamp", 3)),
        w(FRAMES, "SELECT video_id, i, round((i + 0.5) / 8 * t, 3) AS timestamp FROM (SELECT video_id, max(timestamp) AS t FROM f GROUP BY ALL) CROSS JOIN range(0, 8) r(i)"),
    ),
    "baseline_frames": (
        lambda s, d: frames(s, d).groupBy("video_id").agg(F.count(F.lit(1)).alias("total")).select("video_id", T.baseline_frames(F.col("total"), (F.col("video_id") % 4).cast("double")).cast("long").alias("frames")),
        w(FRAMES, "SELECT video_id, CASE WHEN video_id % 4 = 0 THEN n ELSE greatest(1, round_even(n / (video_id % 4), 0)) END::BIGINT AS frames FROM (SELECT video_id, count(*) AS n FROM f GROUP BY video_id)"),
    ),
    "grounding": (
        lambda s, d: _r(T.grounding(_top(s, d), _gold(s, d)), "precision", "recall"),
        w(
            FRAMES, _PICKS, _GOLD,
            "p AS (SELECT video_id, avg(hit) AS p FROM (SELECT pk.video_id, rn, coalesce(max((timestamp BETWEEN s AND e)::INT), 0) AS hit FROM pk LEFT JOIN go USING (video_id) GROUP BY ALL) GROUP BY ALL), q AS (SELECT video_id, avg(hit) AS q FROM (SELECT go.video_id, qid, coalesce(max((timestamp BETWEEN s AND e)::INT), 0) AS hit FROM go LEFT JOIN pk USING (video_id) GROUP BY ALL) GROUP BY ALL)",
            "SELECT video_id, round(coalesce(p, 0.0), 6) AS precision, round(coalesce(q, 0.0), 6) AS recall FROM p FULL JOIN q USING (video_id)",
        ),
    ),
}
