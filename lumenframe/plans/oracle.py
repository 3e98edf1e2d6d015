"""SQL for DuckDB of the frame queries: shared common table expressions and one statement a query."""

from __future__ import annotations

FRAMES = """
f AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, event_id,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6::DOUBLE AS timestamp, value AS packet_size,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS motion_magnitude,
  (event_id * 7919 % 1000) / 1000.0::DOUBLE AS luma_entropy, (event_id * 104729 % 1000) / 1000.0::DOUBLE AS luma_diff_energy,
  CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'B' ELSE 'P' END AS pict_type FROM events)"""
EMBEDDED = (
    FRAMES
    + """,
fe AS (SELECT f.*, e.embedding::DOUBLE[] AS emb, e.label::INT AS label FROM f LEFT JOIN embeddings e ON e.vec_id = f.event_id % (SELECT count(*) FROM embeddings)),
qs AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < 8)"""
)


def _channel(c: str) -> str:
    lo, hi = f"min({c}) OVER v", f"max({c}) OVER v"
    p2, p98 = f"quantile_cont({c}, 0.02) OVER v", f"quantile_cont({c}, 0.98) OVER v"
    use = f"(count(*) OVER v < 50 OR {p98} - {p2} < 1e-8)"
    low, high = f"(CASE WHEN {use} THEN {lo} ELSE {p2} END)", f"(CASE WHEN {use} THEN {hi} ELSE {p98} END)"
    return f"CASE WHEN {hi} - {lo} < 1e-8 THEN 0.5 ELSE least(greatest(({c} - {low}) / ({high} - {low}), 0.0), 1.0) END"


def _scored(source: str) -> str:
    return f"a AS (SELECT *, least(greatest((0.5 * {_channel('packet_size')} + 0.3 * {_channel('motion_magnitude')} + 0.2 * {_channel('luma_entropy')}) / 1.0, 0.0), 1.0) AS action_score FROM {source} WINDOW v AS (PARTITION BY video_id))"


SCORED = f"{FRAMES},\n{_scored('f')}"
SCORED_E = f"{EMBEDDED},\n{_scored('fe')}"
SCENES = """s AS (SELECT *, sum(CASE WHEN pict_type = 'I' AND frame_idx > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS iframe_scene_id FROM {0})"""
THRESHOLDS = """
th AS (SELECT o.video_id, o.iframe_scene_id,
  coalesce(greatest(1.0, coalesce(o.p90, g.p90)), 0.0) AS candidate_thresh, coalesce(greatest(1.0, coalesce(o.p95, g.p95)), 0.0) AS salient_thresh
  FROM (SELECT video_id, iframe_scene_id, quantile_cont(packet_size, 0.9) FILTER (pict_type <> 'I') AS p90, quantile_cont(packet_size, 0.95) FILTER (pict_type <> 'I') AS p95 FROM s GROUP BY ALL) o
  JOIN (SELECT video_id, quantile_cont(packet_size, 0.9) FILTER (pict_type <> 'I') AS p90, quantile_cont(packet_size, 0.95) FILTER (pict_type <> 'I') AS p95 FROM s GROUP BY ALL) g USING (video_id))"""
MAXIMA = "coalesce(pict_type <> 'I' AND packet_size > max(packet_size) OVER (PARTITION BY video_id, pict_type = 'I' ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AND packet_size > max(packet_size) OVER (PARTITION BY video_id, pict_type = 'I' ORDER BY frame_idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), false)"
MINIMA = "coalesce(pict_type <> 'I' AND packet_size < min(packet_size) OVER (PARTITION BY video_id, pict_type = 'I' ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AND packet_size < min(packet_size) OVER (PARTITION BY video_id, pict_type = 'I' ORDER BY frame_idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), false)"
TIERS = f"""
x AS (SELECT *, {MAXIMA} AS is_max FROM s),{THRESHOLDS},
t AS (SELECT x.*, candidate_thresh, salient_thresh, CASE WHEN pict_type = 'I' THEN 'I_FRAME' WHEN is_max AND packet_size >= salient_thresh THEN 'PEAK'
  WHEN packet_size > salient_thresh THEN 'SALIENT' WHEN packet_size >= candidate_thresh THEN 'CANDIDATE' ELSE 'SKIP' END AS tier
  FROM x JOIN th USING (video_id, iframe_scene_id))"""
TIERED = f"{FRAMES},\n{SCENES.format('f')},{TIERS}"

#: Nodes: all frames, peaks from 0.8 on, salient from 0.35 on.
NODES = f"""{SCORED_E},
n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, frame_idx) - 1 AS pos, max(action_score) OVER (PARTITION BY video_id) - min(action_score) OVER (PARTITION BY video_id) AS span,
  CASE WHEN round(action_score, 6) >= 0.8 OR pict_type = 'I' THEN 'L1_PEAK' WHEN round(action_score, 6) >= 0.35 THEN 'L2_SALIENT' ELSE 'L3_CANDIDATE' END AS tier FROM a)"""
_COS = "CASE WHEN {0} IS NULL OR {1} IS NULL THEN 0.0 ELSE coalesce(list_cosine_similarity({0}, {1}), 0.0) END"


def _edge(kind: str) -> str:
    s, m, t = "s", "m", "t"
    w = {
        "fully_connected": f"0.4 * {s} + 0.3 * {m}",
        "peak_salient": f"greatest({t} * greatest({s}, {m}), 1e-6)",
        "salient_candidate": f"greatest({t} * greatest({m}, {s} / 2), 1e-6)",
        "temporal": f"greatest(0.7 * {t} + 0.3 * {m}, 1e-6)",
        "semantic": f"greatest(0.8 * {s} + 0.2 * {t}, 1e-6)",
        "motion": f"greatest(0.8 * {m} + 0.2 * {t}, 1e-6)",
    }
    return w[kind]


_STM = f"""greatest(0.0, {_COS.format('u.emb', 'w.emb')}) AS s, CASE WHEN u.span = 0 THEN 1.0 ELSE greatest(0.0, 1 - abs(u.action_score - w.action_score) / u.span) END AS m, 1 / (1 + abs(u.timestamp - w.timestamp)) AS t"""
_ENDS = "u.video_id, least(u.frame_idx, w.frame_idx) AS src, greatest(u.frame_idx, w.frame_idx) AS dst"
COMPLETE = f"ec AS (SELECT video_id, src, dst, 'fully_connected' AS edge_type, {_edge('fully_connected')} AS weight FROM (SELECT {_ENDS}, {_STM} FROM n u JOIN n w ON u.video_id = w.video_id AND u.frame_idx < w.frame_idx))"
TEMPORAL = f"et AS (SELECT video_id, src, dst, 'temporal' AS edge_type, {_edge('temporal')} AS weight FROM (SELECT {_ENDS}, {_STM} FROM n u JOIN n w ON u.video_id = w.video_id AND w.pos - u.pos = 1))"
#: Topology G14.
TEMPORAL_2 = f"et AS (SELECT video_id, src, dst, 'temporal' AS edge_type, {_edge('temporal')} AS weight FROM (SELECT {_ENDS}, {_STM} FROM n u JOIN n w ON u.video_id = w.video_id AND w.pos - u.pos BETWEEN 1 AND 2))"
SEMANTIC = f"""es AS (SELECT DISTINCT video_id, src, dst, 'semantic' AS edge_type, {_edge('semantic')} AS weight FROM (
  SELECT {_ENDS}, {_STM}, row_number() OVER (PARTITION BY u.video_id, u.frame_idx ORDER BY list_cosine_similarity(u.emb, w.emb) DESC, w.frame_idx DESC) AS rn
  FROM n u JOIN n w ON u.video_id = w.video_id AND u.frame_idx <> w.frame_idx WHERE u.tier = 'L2_SALIENT' AND w.tier = 'L2_SALIENT' AND list_cosine_similarity(u.emb, w.emb) >= 0.5) WHERE rn <= 4)"""
MOTION = f"""em AS (SELECT DISTINCT video_id, src, dst, 'motion' AS edge_type, {_edge('motion')} AS weight FROM (SELECT *, row_number() OVER (PARTITION BY video_id, me ORDER BY far, other DESC) AS rn FROM (
  SELECT {_ENDS}, {_STM}, u.frame_idx AS me, w.frame_idx AS other, round(abs(round(u.action_score, 9) - round(w.action_score, 9)), 9) AS far FROM n u JOIN n w ON u.video_id = w.video_id AND u.frame_idx <> w.frame_idx)) WHERE rn <= 2)"""


def _nearest(kind: str, probe: str, anchor: str) -> str:
    return f"""SELECT video_id, src, dst, '{kind}' AS edge_type, {_edge(kind)} AS weight FROM (SELECT *, row_number() OVER (PARTITION BY video_id, me ORDER BY dt, df, wpos) AS rn FROM (
  SELECT {_ENDS}, {_STM}, u.frame_idx AS me, abs(u.timestamp - w.timestamp) AS dt, abs(u.frame_idx - w.frame_idx) AS df, w.pos AS wpos FROM n u JOIN n w ON u.video_id = w.video_id AND u.frame_idx <> w.frame_idx
  LEFT JOIN (SELECT video_id, bool_or(tier = 'L2_SALIENT') AS has_salient FROM n GROUP BY ALL) h ON h.video_id = u.video_id WHERE {probe} AND {anchor})) WHERE rn = 1"""


HIERARCHY = f"eh AS ({_nearest('peak_salient', chr(117) + '.tier = ' + repr('L2_SALIENT'), 'w.tier = ' + repr('L1_PEAK'))} UNION ALL {_nearest('salient_candidate', 'u.tier = ' + repr('L3_CANDIDATE'), 'w.tier = CASE WHEN h.has_salient THEN ' + repr('L2_SALIENT') + ' ELSE ' + repr('L1_PEAK') + ' END')})"
DEDUPED = f"""{TEMPORAL}, {HIERARCHY}, {SEMANTIC}, {MOTION},
ed AS (SELECT video_id, src, dst, edge_type, weight FROM (SELECT *, row_number() OVER (PARTITION BY video_id, src, dst ORDER BY round(weight, 9) DESC, CASE edge_type WHEN 'temporal' THEN 0 WHEN 'peak_salient' THEN 1 WHEN 'salient_candidate' THEN 2 WHEN 'semantic' THEN 3 ELSE 4 END) AS rn
  FROM (SELECT * FROM et UNION ALL SELECT * FROM eh UNION ALL SELECT * FROM es UNION ALL SELECT * FROM em)) WHERE rn = 1)"""
_E6 = "video_id, src, dst, edge_type, round(weight, 6) + 0.0 AS weight"
SIMILAR = f"sq AS (SELECT a.*, query_id, {_COS.format('a.emb', 'q')} AS sem FROM a CROSS JOIN qs)"
BEST = "bs AS (SELECT video_id, query_id, label AS scene_id, arg_max(frame_idx, (sem, -frame_idx)) AS frame_idx, max(sem) AS sem FROM sq GROUP BY ALL)"
_HYBRID = """h AS (SELECT video_id, query_id, frame_idx, round(0.4 * sem + 0.3 * CASE WHEN span = 0 THEN 1.0 ELSE greatest(0.0, 1 - abs(action_score - 0.5) / span) END, 6) + 0.0 AS score
  FROM (SELECT *, max(action_score) OVER (PARTITION BY video_id) - min(action_score) OVER (PARTITION BY video_id) AS span FROM sq)),
hk AS (SELECT video_id, query_id, row_number() OVER (PARTITION BY video_id, query_id ORDER BY score DESC, frame_idx) AS rank, frame_idx, score FROM h QUALIFY rank <= 5)"""
HYBRID = f"{SCORED_E}, {SIMILAR}, {_HYBRID}"
CENTROIDS = "c AS (SELECT video_id, scene_id, list(x ORDER BY pos) AS centroid FROM (SELECT video_id, label AS scene_id, pos, avg(x) AS x FROM (SELECT video_id, label, unnest(emb) AS x, generate_subscripts(emb, 1) AS pos FROM a WHERE label >= 0) GROUP BY ALL) GROUP BY ALL)"


def _pct(c: str, keys: str) -> str:
    return f"CASE WHEN count(*) OVER (PARTITION BY {keys}) > 1 THEN (rank() OVER (PARTITION BY {keys} ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2) / (count(*) OVER (PARTITION BY {keys}) - 1) ELSE 0.5 END"


def _ranked(seed: str, edges: str, damping: float, rounds: int) -> str:
    """PageRank CTEs over nodes sd(video_id, frame_idx, seed) and an edge table, to pr(k, video_id, frame_idx, p)."""
    return f"""{seed},
sn AS (SELECT video_id, frame_idx, CASE WHEN sum(greatest(seed, 0)) OVER (PARTITION BY video_id) > 0 THEN greatest(seed, 0) / sum(greatest(seed, 0)) OVER (PARTITION BY video_id) ELSE 1.0 / count(*) OVER (PARTITION BY video_id) END AS s FROM sd),
de AS (SELECT video_id, src AS a, dst AS b, weight FROM {edges} WHERE weight > 0 UNION ALL SELECT video_id, dst, src, weight FROM {edges} WHERE weight > 0),
sh AS (SELECT video_id, a, b, weight / sum(weight) OVER (PARTITION BY video_id, a) AS share FROM de),
dang AS (SELECT sn.*, NOT EXISTS (SELECT 1 FROM de WHERE de.video_id = sn.video_id AND de.a = sn.frame_idx) AS hangs FROM sn),
pr AS (SELECT 0 AS k, video_id, frame_idx, s AS p FROM sn UNION ALL
  SELECT k + 1, d.video_id, d.frame_idx, {damping} * (coalesce(i.p, 0) + coalesce(z.p, 0) * d.s) + {1 - damping} * d.s FROM (SELECT DISTINCT k FROM pr) ks JOIN dang d ON true
  LEFT JOIN (SELECT sh.video_id, sh.b, sum(sh.share * pr.p) AS p FROM pr JOIN sh ON pr.video_id = sh.video_id AND pr.frame_idx = sh.a GROUP BY ALL) i ON i.video_id = d.video_id AND i.b = d.frame_idx
  LEFT JOIN (SELECT pr.video_id, sum(pr.p) AS p FROM pr JOIN dang ON dang.video_id = pr.video_id AND dang.frame_idx = pr.frame_idx WHERE hangs GROUP BY ALL) z ON z.video_id = d.video_id WHERE k < {rounds})"""


def w(*parts: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts[:-1]) + "\n" + parts[-1]


SQL = {
    "packet_curve": w(FRAMES, "SELECT video_id, frame_idx AS display_idx, packet_size AS size FROM f"),
    "iframe_scene_id": w(FRAMES, SCENES.format("f"), "SELECT video_id, frame_idx, iframe_scene_id FROM s"),
    "scene_thresholds": w(FRAMES, SCENES.format("f"), THRESHOLDS, "SELECT video_id, iframe_scene_id, round(candidate_thresh, 6) AS candidate_thresh, round(salient_thresh, 6) AS salient_thresh FROM th"),
    "local_maxima": w(FRAMES, f"SELECT video_id, frame_idx FROM (SELECT *, {MAXIMA} AS m FROM f) WHERE m"),
    "local_minima_scenes": w(
        FRAMES,
        f"""cutt AS (SELECT video_id, frame_idx, n FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n, frame_idx = 0 OR ({MINIMA} AND packet_size < quantile_cont(packet_size, 0.25) FILTER (pict_type <> 'I') OVER (PARTITION BY video_id)) AS cut FROM f) WHERE cut),
sp AS (SELECT video_id, frame_idx AS x, coalesce(lead(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx), n) AS y FROM cutt),
pc AS (SELECT video_id, unnest(range(x, y, 300)) AS start_idx, y FROM sp)""",
        "SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_idx) - 1 AS scene_id, start_idx, least(start_idx + 300, y) AS end_idx FROM pc",
    ),
    "codec_tier": w(TIERED, "SELECT video_id, frame_idx, tier FROM t"),
    "tier_counts": w(TIERED, "SELECT video_id, tier, count(*) AS frames FROM t GROUP BY ALL"),
    "action_score": w(SCORED, "SELECT video_id, frame_idx, round(action_score, 6) + 0.0 AS action_score FROM a"),
    "peak_prominence": w(
        SCORED,
        """tp AS (SELECT video_id, frame_idx, action_score AS v, coalesce(action_score > lag(action_score) OVER o AND action_score > lead(action_score) OVER o, false) AS top FROM a WINDOW o AS (PARTITION BY video_id ORDER BY frame_idx)),
hl AS (SELECT p.video_id, p.frame_idx, p.v, max(q.frame_idx) FILTER (q.frame_idx < p.frame_idx AND q.v > p.v) AS l, min(q.frame_idx) FILTER (q.frame_idx > p.frame_idx AND q.v > p.v) AS r FROM tp p JOIN tp q USING (video_id) WHERE p.top GROUP BY ALL)""",
        """SELECT h.video_id, h.frame_idx, round(h.v - greatest(min(q.v) FILTER (q.frame_idx <= h.frame_idx AND q.frame_idx > coalesce(h.l, -1)), min(q.v) FILTER (q.frame_idx >= h.frame_idx AND q.frame_idx < coalesce(h.r, 1000000000))), 6) + 0.0 AS prominence
FROM hl h JOIN tp q USING (video_id) GROUP BY h.video_id, h.frame_idx, h.v""",
    ),
    "codec_conf": w(FRAMES, f"SELECT video_id, frame_idx, round(CASE WHEN count(*) OVER (PARTITION BY video_id, pict_type) < 2 THEN 0.5 ELSE 0.1 + 0.9 * {_pct('packet_size', 'video_id, pict_type')} END, 6) AS codec_conf FROM f"),
    "histogram_entropy": w(FRAMES, "b AS (SELECT video_id, CASE WHEN m > 0 THEN least(floor(packet_size / m * 10), 9) ELSE 0 END AS bin FROM (SELECT *, max(packet_size) OVER (PARTITION BY video_id) AS m FROM f))", "p AS (SELECT video_id, count(*) / sum(count(*)) OVER (PARTITION BY video_id) AS p FROM b GROUP BY video_id, bin)", "SELECT video_id, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM p GROUP BY ALL"),
    "gap_difference": w(TIERED, "SELECT video_id, frame_idx, round(luma_diff_energy - lag(luma_diff_energy) OVER (PARTITION BY video_id ORDER BY frame_idx), 6) + 0.0 AS gap FROM t WHERE tier <> 'SKIP'"),
    "index_scalars": w(SCORED, SCENES.format("a"), TIERS, "g AS (SELECT video_id, max(action_score) AS m, count(*) AS total, count(*) FILTER (tier = 'SKIP') AS skipped, count(*) FILTER (tier = 'PEAK') AS peaks FROM t GROUP BY ALL)", "SELECT video_id, round(m, 6) AS index_action_score, total AS frames_processed, peaks AS peak_count, round(skipped / total, 6) AS skipped_frames_ratio, round(CASE WHEN total > skipped THEN total / (total - skipped) ELSE 0.0 END, 6) AS storage_reduction_factor FROM g"),
    "node_tiers": w(NODES, "SELECT video_id, frame_idx, tier FROM n"),
    "edges_complete": w(NODES, COMPLETE, f"SELECT {_E6} FROM ec"),
    "edges_temporal": w(NODES, TEMPORAL, f"SELECT {_E6} FROM et"),
    "edges_hierarchy": w(NODES, HIERARCHY, f"SELECT {_E6} FROM eh"),
    "edges_semantic_topk": w(NODES, SEMANTIC, f"SELECT {_E6} FROM es"),
    "edges_motion_knn": w(NODES, MOTION, f"SELECT {_E6} FROM em"),
    "edges_dedup": w(NODES, DEDUPED, f"SELECT {_E6} FROM ed"),
    "edges_block_diagonal": w(NODES, COMPLETE, f"SELECT ec.{_E6.replace('video_id, ', 'video_id, ', 1)} FROM ec JOIN n u ON u.video_id = ec.video_id AND u.frame_idx = src JOIN n w ON w.video_id = ec.video_id AND w.frame_idx = dst WHERE u.label = w.label"),
    "edge_projection": w(NODES, "g AS (SELECT video_id, label, count(*) AS c FROM n GROUP BY ALL)", "SELECT video_id, sum(c * (c - 1) // 2)::BIGINT AS scene_edges, (sum(c) * (sum(c) - 1) // 2)::BIGINT AS complete_edges, round(CASE WHEN sum(c) > 1 THEN sum(c * (c - 1) // 2) / (sum(c) * (sum(c) - 1) // 2) END, 6) AS ratio FROM g GROUP BY ALL"),
    "pagerank_static": w(NODES, TEMPORAL_2, _ranked("sd AS (SELECT video_id, frame_idx, action_score AS seed FROM n)", "et", 0.85, 60), "SELECT video_id, frame_idx, round(p, 6) + 0.0 AS pagerank FROM pr WHERE k = 60", recursive=True),
    "retrieve_hybrid": w(HYBRID, "SELECT video_id, query_id, rank, frame_idx, score FROM hk"),
    "retrieve_ppr": w(
        NODES,
        TEMPORAL_2,
        f"nc AS (SELECT n.*, q, {_COS.format('emb', 'q')} AS sem, CASE WHEN count(*) OVER (PARTITION BY video_id, pict_type) < 2 THEN 0.5 ELSE 0.1 + 0.9 * {_pct('packet_size', 'video_id, pict_type')} END AS conf FROM n JOIN qs ON query_id = 0)",
        _ranked(f"sd AS (SELECT video_id, frame_idx, 0.5 * {_pct('sem', 'video_id')} + 0.5 * {_pct('conf', 'video_id')} AS seed FROM nc)", "et", 0.5, 30),
        "fin AS (SELECT video_id, frame_idx, round(p, 6) + 0.0 AS score FROM pr WHERE k = 30)",
        "SELECT * FROM (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_idx) AS rank, frame_idx, score FROM fin) WHERE rank <= 8",
        recursive=True,
    ),
    "fallback_topk": w(SCORED, "SELECT * FROM (SELECT video_id, frame_idx, row_number() OVER (PARTITION BY video_id ORDER BY action_score DESC, luma_diff_energy DESC, frame_idx) AS rank FROM a) WHERE rank <= 5"),
    "scene_centroids": w(SCORED_E, CENTROIDS, "SELECT video_id, scene_id, round(list_sum(centroid), 6) + 0.0 AS total, round(centroid[1], 6) + 0.0 AS first, len(centroid)::BIGINT AS dims FROM c"),
    "scene_shortlist": w(SCORED_E, CENTROIDS, f"sl AS (SELECT video_id, query_id, scene_id, round({_COS.format('centroid', 'q')}, 6) + 0.0 AS score, count(*) OVER (PARTITION BY video_id, query_id) AS n FROM c CROSS JOIN qs)", "SELECT video_id, query_id, scene_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id, query_id ORDER BY score DESC, scene_id) AS rank FROM sl) WHERE rank <= greatest(4, ceil(sqrt(n)))"),
    "maxsim_topk": w(SCORED_E, SIMILAR, BEST, "SELECT video_id, query_id, scene_id, frame_idx, round(sem, 6) + 0.0 AS sem FROM bs"),
    "margin_gate": w(SCORED_E, SIMILAR, BEST, "m AS (SELECT video_id, query_id, max(sem) AS s1, max(sem) FILTER (rn = 2) AS s2 FROM (SELECT *, row_number() OVER (PARTITION BY video_id, query_id ORDER BY sem DESC, scene_id) AS rn FROM bs) GROUP BY ALL)", "SELECT video_id, query_id, round(s1, 6) + 0.0 AS best_sim, round(coalesce(s1 - s2, 1e9), 6) + 0.0 AS margin, CASE WHEN s1 < 0.2 THEN 'fallback' WHEN s2 IS NULL OR s1 - s2 >= 0.05 THEN 'shortcut' ELSE 'descend' END AS branch FROM m"),
    "rrf_fusion": w(HYBRID, "r AS (SELECT video_id, frame_idx, round(sum(1.0 / (60 + (rank - 1) + 1)), 9) AS rrf, count(*) AS hits, min(rank - 1) AS best_rank FROM hk GROUP BY ALL)", "SELECT video_id, frame_idx, rrf, hits, best_rank, place FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY rrf DESC, best_rank, frame_idx) AS place FROM r) WHERE place <= 10"),
    "temporal_expansion": w(
        SCORED,
        "sd AS (SELECT video_id, frame_idx, rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY action_score DESC, luma_diff_energy DESC, frame_idx) AS rank FROM a) WHERE rank <= 3), x AS (SELECT video_id, frame_idx, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 AS pos FROM a WHERE action_score >= 0.4), sp AS (SELECT sd.*, pos FROM sd JOIN x USING (video_id, frame_idx))",
        "SELECT video_id, frame_idx, seed, seed_rank, distance, frame_idx <> seed AS expanded FROM (SELECT x.video_id, x.frame_idx, sp.frame_idx AS seed, sp.rank AS seed_rank, abs(x.pos - sp.pos) AS distance, row_number() OVER (PARTITION BY x.video_id, x.frame_idx ORDER BY sp.rank, sp.frame_idx) AS rn FROM sp JOIN x ON x.video_id = sp.video_id AND abs(x.pos - sp.pos) <= 2) WHERE rn = 1",
    ),
    "divergence_metrics": w(
        HYBRID,
        "fb AS (SELECT video_id, query_id, frame_idx, rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id, query_id ORDER BY round(sem, 6) DESC, frame_idx) AS rank FROM sq) WHERE rank <= 5)",
        "SELECT coalesce(x.video_id, y.video_id) AS video_id, coalesce(x.query_id, y.query_id) AS query_id, round(count(*) FILTER (x.rank IS NOT NULL AND y.rank IS NOT NULL) / count(*), 6) AS jaccard, round(avg(abs(x.rank - y.rank)), 6) AS mean_displacement FROM hk x FULL JOIN fb y ON x.video_id = y.video_id AND x.query_id = y.query_id AND x.frame_idx = y.frame_idx GROUP BY 1, 2",
    ),
    "select_strategies": w(
        SCORED,
        "p AS (SELECT *, action_score >= 0.8 AS is_peak FROM a), nb AS (SELECT *, bool_or(is_peak) OVER (PARTITION BY video_id ORDER BY frame_idx RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near, row_number() OVER (PARTITION BY video_id ORDER BY action_score DESC, frame_idx) AS rn FROM p)",
        "SELECT 'peak_only' AS strategy, video_id, count(*) AS frames, sum(frame_idx)::BIGINT AS total FROM nb WHERE is_peak GROUP BY ALL UNION ALL SELECT 'top_k_action', video_id, count(*), sum(frame_idx)::BIGINT FROM nb WHERE rn <= 15 GROUP BY ALL UNION ALL SELECT 'peak_neighbors', video_id, count(*), sum(frame_idx)::BIGINT FROM nb WHERE near GROUP BY ALL UNION ALL SELECT 'hybrid', video_id, count(*), sum(frame_idx)::BIGINT FROM nb GROUP BY ALL",
    ),
    "anchor_neighbors": w(SCORED, "an AS (SELECT video_id, frame_idx FROM a WHERE action_score >= 0.9)", "SELECT DISTINCT a.video_id, a.frame_idx FROM a JOIN an ON an.video_id = a.video_id AND abs(an.frame_idx - a.frame_idx) <= 3 WHERE NOT EXISTS (SELECT 1 FROM an x WHERE x.video_id = a.video_id AND x.frame_idx = a.frame_idx)"),
}
