"""Per-frame signals: tiers, extrema, scenes, scores. Keyed by video_id; one shuffle by video serves
all windows of an operator."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import TINY, by_video, in_order, rank_pct, robust_scaled

#: Weights of residual, motion and entropy in the action score.
WEIGHTS = (0.5, 0.3, 0.2)


def iframe_scene_id(f: DataFrame) -> DataFrame:
    """Running count of I-frames after the first frame."""
    starts = F.when((F.col("pict_type") == "I") & (F.col("frame_idx") > 0), 1).otherwise(0)
    return f.withColumn("iframe_scene_id", F.sum(starts).over(in_order().rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))


def scene_thresholds(f: DataFrame) -> DataFrame:
    """A2: per scene the 90th and 95th percentile of non-keyframe sizes, at least 1.0; a scene
    without such frames has the video's, else 0."""
    s = iframe_scene_id(f)
    plain = F.when(F.col("pict_type") != "I", F.col("packet_size"))
    pick = lambda: F.percentile(plain, F.array(F.lit(0.9), F.lit(0.95)))
    own = s.groupBy("video_id", "iframe_scene_id").agg(pick().alias("p"))
    pool = s.groupBy("video_id").agg(pick().alias("g"))
    level = lambda k: F.coalesce(F.greatest(F.lit(1.0), F.coalesce(F.col("p")[k], F.col("g")[k])), F.lit(0.0))
    return own.join(pool, "video_id").select("video_id", "iframe_scene_id", level(0).alias("candidate_thresh"), level(1).alias("salient_thresh"))


def local_extrema(x: Column, order: int, highest: bool = True) -> Column:
    """Frames strictly above (below) all within `order` frames on either side on the curve of the frames that are no
    keyframes, whose larger packets would warp it; the curve's first and last frame never are, nor are keyframes."""
    key = F.col("pict_type") == "I"
    curve = Window.partitionBy("video_id", key).orderBy("frame_idx")
    best = F.max if highest else F.min
    before, after = best(x).over(curve.rowsBetween(-order, -1)), best(x).over(curve.rowsBetween(1, order))
    return F.coalesce(~key & ((x > before) & (x > after) if highest else (x < before) & (x < after)), F.lit(False))


def codec_tiers(f: DataFrame, order: int = 3) -> DataFrame:
    """I_FRAME, PEAK (local maximum of at least the salient threshold), SALIENT (above it),
    CANDIDATE (at least the candidate threshold) or SKIP."""
    s = iframe_scene_id(f).withColumn("is_max", local_extrema(F.col("packet_size"), order))
    t = s.join(scene_thresholds(f), ["video_id", "iframe_scene_id"])
    tier = (
        F.when(F.col("pict_type") == "I", "I_FRAME")
        .when(F.col("is_max") & (F.col("packet_size") >= F.col("salient_thresh")), "PEAK")
        .when(F.col("packet_size") > F.col("salient_thresh"), "SALIENT")
        .when(F.col("packet_size") >= F.col("candidate_thresh"), "CANDIDATE")
        .otherwise("SKIP")
    )
    return t.withColumn("tier", tier)


def survivors(f: DataFrame) -> DataFrame:
    """P2."""
    return codec_tiers(f).filter("tier != 'SKIP'")


def valley_scenes(f: DataFrame, order: int = 3, percentile: float = 0.25, longest: int = 300) -> DataFrame:
    """Scene spans [start, end) between strict minima below the percentile, cut into pieces
    of at most `longest` frames; numbered per video."""
    low = F.percentile(F.when(F.col("pict_type") != "I", F.col("packet_size")), F.lit(percentile)).over(by_video())
    cut = (F.col("frame_idx") == 0) | (local_extrema(F.col("packet_size"), order, highest=False) & (F.col("packet_size") < low))
    n = F.count(F.lit(1)).over(by_video())
    spans = f.select("video_id", "frame_idx", cut.alias("cut"), n.alias("n")).filter("cut").select("video_id", F.col("frame_idx").alias("a"), F.lead("frame_idx").over(in_order()).alias("next"), "n")
    pieces = spans.withColumn("b", F.coalesce("next", "n")).withColumn("start_idx", F.explode(F.sequence("a", F.col("b") - 1, F.lit(longest).cast("bigint"))))
    number = F.row_number().over(by_video().orderBy("start_idx")) - 1
    return pieces.select("video_id", number.cast("bigint").alias("scene_id"), "start_idx", F.least(F.col("start_idx") + longest, F.col("b")).alias("end_idx"))


def action_score(f: DataFrame, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """Weighted mean of the robustly scaled channels, within 0..1. The channels' ranges are one aggregate per video."""
    total = sum(weights)
    if total <= 0:
        raise ValueError("action score weights must have a positive sum")
    names = ("packet_size", "motion_magnitude", "luma_entropy")
    cuts = F.array(*[F.lit(x) for x in (0.0, 0.02, 0.98, 1.0)])
    ranges = f.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"), *[F.percentile(c, cuts).alias(f"_{c}") for c in names])
    channels = [robust_scaled(F.col(c), F.col("_n"), F.col(f"_{c}")) for c in names]
    score = sum((w * c for w, c in zip(weights, channels, strict=True)), F.lit(0.0)) / total
    return f.join(ranges, "video_id").select(*[F.col(c) for c in f.columns], F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("action_score"))


def peak_prominence(f: DataFrame, column: str = "action_score") -> DataFrame:
    """W9 in SQL: the prominence of each strict local maximum. The bases lie between it and the nearest
    higher frame on each side, found on the video's own list of values."""
    x = F.col(column)
    top = F.coalesce((x > F.lag(x).over(in_order())) & (x > F.lead(x).over(in_order())), F.lit(False))
    all_values = F.sort_array(F.collect_list(F.struct("frame_idx", x.alias("v"))).over(by_video()))
    at = f.select("video_id", "frame_idx", x.alias("v"), top.alias("top"), F.transform(all_values, lambda s: s["v"]).alias("values")).filter("top")
    before = F.slice("values", F.lit(1), F.col("frame_idx").cast("int"))
    after = F.slice("values", F.col("frame_idx").cast("int") + 2, F.size("values"))
    # minimum from the peak outwards, until something higher
    walk = lambda values, v: F.aggregate(values, F.struct(v.alias("low"), F.lit(False).alias("done")), lambda s, y: F.struct(F.when(s["done"] | (y > v), s["low"]).otherwise(F.least(s["low"], y)).alias("low"), (s["done"] | (y > v)).alias("done")))["low"]
    left, right = walk(F.reverse(before), F.col("v")), walk(after, F.col("v"))
    return at.select("video_id", "frame_idx", (F.col("v") - F.greatest(left, right)).alias("prominence"))


def find_peaks(x: np.ndarray, distance: int, prominence: float, height: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Local maxima (middle of a plateau) of at least the height, thinned greedily by height to a distance, then those with the
    prominence; (places, prominences)."""
    n, at, peaks = len(x), 1, []
    while at < n - 1:
        if x[at - 1] < x[at]:
            end = at
            while end + 1 < n and x[end + 1] == x[at]:
                end += 1
            if end + 1 < n and x[end + 1] < x[at]:
                peaks.append((at + end) // 2)
            at = end
        at += 1
    peaks = [p for p in peaks if x[p] >= height]
    keep = np.ones(len(peaks), bool)
    for k in np.argsort(x[peaks], kind="stable")[::-1] if peaks else []:
        if keep[k]:
            for step in (-1, 1):
                j = k + step
                while 0 <= j < len(peaks) and abs(peaks[j] - peaks[k]) < distance:
                    keep[j] = False
                    j += step
    out, found = [], []
    for p in np.array(peaks, int)[keep]:
        left = np.flatnonzero(x[:p] > x[p])
        right = np.flatnonzero(x[p + 1 :] > x[p])
        lo = x[(left[-1] + 1 if len(left) else 0) : p + 1].min()
        hi = x[p : (p + 1 + right[0] if len(right) else n)].min()
        if x[p] - max(lo, hi) >= prominence:
            out.append(p)
            found.append(x[p] - max(lo, hi))
    return np.array(out, int), np.array(found)


def persistence(f: DataFrame, distance: int = 5, prominence: float = 0.05, threshold: float = 0.4) -> DataFrame:
    """Prominence relative to the video's largest, 0 off the peaks; is_peak from the threshold.
    Greedy thinning depends on order, so a video is one group (a few thousand rows)."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("frame_idx")
        places, found = find_peaks(g["action_score"].to_numpy(), distance, prominence)
        value = np.zeros(len(g))
        if len(places):
            most = found.max() if found.max() >= TINY else 1.0
            value[places] = np.clip(found / most, 0, 1)
        return g.assign(persistence_value=value, is_peak=value >= threshold)

    return f.select("video_id", "frame_idx", "action_score").groupBy("video_id").applyInPandas(one, "video_id long, frame_idx long, action_score double, persistence_value double, is_peak boolean")


def peak_nms(scored: DataFrame, window: int = 10) -> DataFrame:
    """By score, a peak within `window` frames of an accepted one is no peak any more."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        taken: list[int] = []
        for i in g[g["is_peak"]].sort_values(["action_score", "frame_idx"], ascending=[False, True])["frame_idx"]:
            if all(abs(i - t) > window for t in taken):
                taken.append(i)
        return g.assign(is_peak=g["frame_idx"].isin(taken))

    return scored.groupBy("video_id").applyInPandas(one, scored.schema)


def codec_conf(f: DataFrame, by_type: bool = True) -> DataFrame:
    """0.1 + 0.9 * average-tied rank of the packet size, within the picture type or the video;
    groups of one are 0.55 by their rank of 0.5."""
    keys = ["video_id", "pict_type"] if by_type else ["video_id"]
    group = Window.partitionBy(*keys)
    pct = rank_pct(F.col("packet_size"), group, group.orderBy("packet_size"), Window.partitionBy(*keys, "packet_size"))
    value = F.when(F.count(F.lit(1)).over(group) < 2, F.lit(0.5)).otherwise(0.1 + 0.9 * pct)
    return f.withColumn("codec_conf", value)


def histogram_entropy(f: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """A5: Shannon entropy (bits) of the video's histogram over [0, max]."""
    top = F.max(column).over(by_video())
    at = F.when(top > 0, F.least(F.floor(F.col(column) / top * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("bigint")
    counts = f.select("video_id", at.alias("bin")).groupBy("video_id", "bin").count()
    p = F.col("count") / F.sum("count").over(by_video())
    return counts.select("video_id", (-p * F.log2(p)).alias("h")).groupBy("video_id").agg(F.sum("h").alias("entropy"))


def gap_difference(f: DataFrame) -> DataFrame:
    """Change of the diff energy against the previous frame that survives."""
    s = survivors(f)
    return s.select("video_id", "frame_idx", (F.col("luma_diff_energy") - F.lag("luma_diff_energy").over(in_order())).alias("gap"))


def index_scalars(f: DataFrame) -> DataFrame:
    """Per video the largest score, counts and the two ratios with their zero guards."""
    t = codec_tiers(action_score(f))
    a = t.groupBy("video_id").agg(F.max("action_score").alias("m"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("tier") == "SKIP").alias("skipped"), F.count_if(F.col("tier") == "PEAK").alias("peaks"))
    kept = F.col("total") - F.col("skipped")
    return a.select("video_id", F.coalesce("m", F.lit(0.5)).alias("index_action_score"), F.col("total").alias("frames_processed"), F.col("peaks").alias("peak_count"), (F.col("skipped") / F.col("total")).alias("skipped_frames_ratio"), F.when(kept > 0, F.col("total") / kept).otherwise(F.lit(0.0)).alias("storage_reduction_factor"))


def motion_geometry(vectors: DataFrame, width: int, height: int, cell: int = 16) -> DataFrame:
    """Motion vectors (video_id, frame_idx, dst_x, dst_y, motion_x, motion_y) to mean fields on a
    grid and from those divergence, curl, Jacobian norm and largest Hessian eigenvalue (absolute
    means). Cells are averaged in the JVM; Python sees one small grid a frame."""
    gx, gy = max(1, width // cell), max(1, height // cell)
    place = lambda c, n: F.least(F.greatest(F.floor(F.col(c) / cell), F.lit(0)), F.lit(n - 1)).cast("int")
    cells = vectors.groupBy("video_id", "frame_idx", place("dst_y", gy).alias("y"), place("dst_x", gx).alias("x")).agg(F.avg("motion_x").alias("u"), F.avg("motion_y").alias("v"))
    grids = cells.groupBy("video_id", "frame_idx").agg(F.collect_list(F.struct("y", "x", "u", "v")).alias("cells"))

    def run(batches):
        for g in batches:
            rows = []
            for video, frame, cs in g.itertuples(index=False):
                u, v = np.zeros((gy, gx)), np.zeros((gy, gx))
                for c in cs:
                    u[c["y"], c["x"]], v[c["y"], c["x"]] = c["u"], c["v"]
                if min(gy, gx) < 2:
                    rows.append((video, frame, 0.0, 0.0, 0.0, 0.0))
                    continue
                (uy, ux), (vy, vx) = np.gradient(u), np.gradient(v)
                m = np.sqrt(u**2 + v**2)
                my, mx = np.gradient(m)
                (myy, myx), (_, mxx) = np.gradient(my), np.gradient(mx)
                root = np.sqrt(np.maximum(((mxx - myy) / 2) ** 2 + myx**2, 0))
                rows.append((video, frame, float(np.abs(ux + vy).mean()), float(np.abs(vx - uy).mean()), float(np.sqrt(ux**2 + uy**2 + vx**2 + vy**2).mean()), float(np.abs((mxx + myy) / 2 + root).mean())))
            yield pd.DataFrame(rows, columns=["video_id", "frame_idx", "divergence", "curl", "jacobian_frobenius", "hessian_max_eigenvalue"])

    return grids.mapInPandas(run, "video_id long, frame_idx long, divergence double, curl double, jacobian_frobenius double, hessian_max_eigenvalue double")
