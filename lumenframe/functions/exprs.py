"""Column builders for vectors, ranks and scores. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

TINY = 1e-8


def by_video() -> WindowSpec:
    return Window.partitionBy("video_id")


def in_order() -> WindowSpec:
    return by_video().orderBy("frame_idx")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """cosine similarity in DOUBLE; 0 where a side is null or has no length."""
    lengths = norm(a) * norm(b)
    return F.coalesce(F.when(lengths > 0, dot(a, b) / lengths), F.lit(0.0))


def r6(x: Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def rank_pct(x: Column, within: WindowSpec, ordered: WindowSpec, ties: WindowSpec) -> Column:
    """Average-tied rank in 0..1; one row alone is 0.5. `ordered` and `ties` partition as `within`
    does; they order and partition by x as well."""
    n = F.count(F.lit(1)).over(within)
    rank = F.rank().over(ordered) - 1 + (F.count(F.lit(1)).over(ties) - 1) / 2
    return F.when(n > 1, rank / (n - 1)).otherwise(F.lit(0.5))


def robust_minmax(x: Column, within: WindowSpec) -> Column:
    """To 0..1 by minimum and maximum (fewer than 50 rows) or the 2nd and 98th percentile; those
    that collapse fall back to the former; constant signals are 0.5."""
    cuts = F.array(*[F.lit(p) for p in (0.0, 0.02, 0.98, 1.0)])
    return robust_scaled(x, F.count(F.lit(1)).over(within), F.percentile(x, cuts).over(within))


def robust_scaled(x: Column, n: Column, cuts: Column) -> Column:
    """robust_minmax from the number of rows and their percentiles 0, 2, 98 and 100."""
    lo, p, q, hi = (cuts[k] for k in range(4))
    use = (n < 50) | (q - p < TINY)
    low, high = F.when(use, lo).otherwise(p), F.when(use, hi).otherwise(q)
    scaled = (x - low) / (high - low)
    return F.when(hi - lo < TINY, F.lit(0.5)).otherwise(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))


def motion_similarity(a: Column, b: Column, span: Column) -> Column:
    """F2: closeness of two action scores relative to their range."""
    return F.when(span == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / span))


def temporal_proximity(seconds: Column) -> Column:
    """F3."""
    return 1 / (1 + F.abs(seconds))


def edge_weight(kind: Column, semantic: Column, motion: Column, temporal: Column, alpha: float = 0.4, beta: float = 0.3) -> Column:
    """weight by edge type; all but complete edges have a floor of 1e-6."""
    floor = F.lit(1e-6)
    return (
        F.when(kind == "fully_connected", alpha * semantic + beta * motion)
        .when(kind == "peak_salient", F.greatest(temporal * F.greatest(semantic, motion), floor))
        .when(kind == "salient_candidate", F.greatest(temporal * F.greatest(motion, semantic / 2), floor))
        .when(kind == "temporal", F.greatest(0.7 * temporal + 0.3 * motion, floor))
        .when(kind == "semantic", F.greatest(0.8 * semantic + 0.2 * temporal, floor))
        .otherwise(F.greatest(0.8 * motion + 0.2 * temporal, floor))
    )


def interval_hit(t: Column, start: Column, end: Column) -> Column:
    """closed interval; null where there is no ground truth."""
    return F.when(valid_interval(start, end), t.between(start, end))


def valid_interval(start: Column, end: Column) -> Column:
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0)
    return sound(start) & sound(end)


def interval_distance(t: Column, start: Column, end: Column) -> Column:
    return F.when(t.isNotNull(), F.greatest(start - t, t - end, F.lit(0.0)))


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    both = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))
    either = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(a0.isNull() | b0.isNull(), F.lit(None)).when(either > 0, both / either).otherwise(F.lit(0.0))


def verification_mode(action: Column) -> Column:
    """How a claim is checked, by the frame's action score."""
    return F.when(action >= 0.70, "full").when(action >= 0.35, "filtered").otherwise("ner")


def duration_bucket(seconds: Column) -> Column:
    """F15."""
    return F.when(seconds < 2, "short").when(seconds <= 5, "medium").otherwise("long")


def keep_score(action: Column, query: Column, persistence: Column, pagerank: Column, entropy: Column, hessian: Column, admitted: Column, total: Column, weights: tuple[float, ...] = (0.30, 0.20, 0.15, 0.10, 0.10, 0.10, 0.05)) -> Column:
    """seven-signal score of a cached frame; recency is 1 for the last admitted."""
    last = F.greatest(total - 1, F.lit(1))
    recency = F.least(F.greatest(1 - (total - 1 - admitted) / last, F.lit(0.0)), F.lit(1.0))
    return sum((w * x for w, x in zip(weights, (action, query, persistence, pagerank, entropy, hessian, recency), strict=True)), F.lit(0.0))
