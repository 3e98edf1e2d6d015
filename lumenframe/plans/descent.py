"""Queries of scene-sparse retrieval, PageRank of any size, sampling and evidence, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.exprs import r6
from ..operators import codebooks as K
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import scene_sparse as P
from ..operators import signal as S
from ..operators import vector as V
from ..operators.export import STOP_WORDS
from ..operators.ranking import pagerank_rounds
from ..sources.frames import frames, queries_of, table, vectors_of
from ..sources.index import read_index, write_index
from ..sources.shared import shared_dir, written
from ..streaming.cache import cache_fold, merged
from .evaluation import _VOTES, _votes
from .oracle import _COS, CENTROIDS, DEDUPED, EMBEDDED, FRAMES, NODES, SCORED_E, SIMILAR, SQL, _edge, _pct, _ranked, w
from .queries import _dedup, _nodes, _nodes_once, _scored


def _grouped(seeds, edges, damping):
    return G.pagerank(seeds, edges, "seed", damping, 30, ("video_id", "query_id"))


def scene_descend(mode, ranker=_grouped):
    def run(s, d):
        n = S.codec_conf(_nodes_once(s, d))
        return P.scene_sparse_retrieve(n, queries_of(s, d), _dedup(n), mode, ranker=ranker, rounds=30)

    return run


def _descend_sql(mode):
    members = "AND u.is_rep AND w.is_rep" if mode == "rep_only" else ""
    cut = "QUALIFY weight >= quantile_cont(weight, 0.75) OVER (PARTITION BY video_id)" if mode == "threshold" else ""
    return w(
        NODES,
        DEDUPED,
        CENTROIDS,
        f"sl AS (SELECT video_id, query_id, scene_id, row_number() OVER g <= greatest(4, ceil(sqrt(count(*) OVER (PARTITION BY video_id, query_id)))) AS listed FROM (SELECT video_id, query_id, scene_id, round({_COS.format('centroid', 'q')}, 6) + 0.0 AS score FROM c CROSS JOIN qs) WINDOW g AS (PARTITION BY video_id, query_id ORDER BY score DESC, scene_id))",
        f"nc AS (SELECT n.*, CASE WHEN count(*) OVER (PARTITION BY video_id, pict_type) < 2 THEN 0.5 ELSE 0.1 + 0.9 * {_pct('packet_size', 'video_id, pict_type')} END AS conf FROM n)",
        f"""sx AS (SELECT nc.*, qs.query_id, {_COS.format('emb', 'q')} AS sem, listed FROM nc CROSS JOIN qs LEFT JOIN sl ON sl.video_id = nc.video_id AND sl.query_id = qs.query_id AND sl.scene_id = nc.label WHERE emb IS NOT NULL),
sv AS (SELECT *, listed IS NOT NULL AND (listed OR coalesce(max(sem) FILTER (listed) OVER (PARTITION BY video_id, query_id) < 0.2, true)) AS survives FROM sx),
hd AS (SELECT video_id, query_id, label, max(sem) AS sem, arg_max(frame_idx, (sem, -frame_idx)) AS frame_idx FROM sv WHERE survives GROUP BY ALL),
gt AS (SELECT video_id, query_id, max(frame_idx) FILTER (rn = 1) AS anchor, CASE WHEN coalesce(max(sem) FILTER (rn = 1) - max(sem) FILTER (rn = 2), 1e9) > 0.015 THEN 'shortcut' ELSE 'descend' END AS branch
  FROM (SELECT *, row_number() OVER (PARTITION BY video_id, query_id ORDER BY sem DESC, label) AS rn FROM hd) GROUP BY ALL),
pool AS (SELECT sv.* EXCLUDE (video_id), sv.video_id AS video, sv.video_id * 1000 + sv.query_id AS video_id, row_number() OVER (PARTITION BY sv.video_id, sv.query_id, label ORDER BY sem DESC, sv.frame_idx) = 1 AS is_rep
  FROM sv JOIN gt USING (video_id, query_id) WHERE branch = 'descend' AND (survives OR abs(sv.frame_idx - anchor) <= 30)),
cr AS (SELECT video_id, src, dst, round({_edge('fully_connected')}, 9) AS weight FROM (SELECT u.video_id, u.frame_idx AS src, w.frame_idx AS dst, greatest(0.0, {_COS.format('u.emb', 'w.emb')}) AS s, CASE WHEN u.span = 0 THEN 1.0 ELSE greatest(0.0, 1 - abs(u.action_score - w.action_score) / u.span) END AS m, 0 AS t
  FROM pool u JOIN pool w ON u.video_id = w.video_id AND u.frame_idx < w.frame_idx AND u.label <> w.label {members}) {cut}),
le AS (SELECT u.video_id, src, dst, round(weight, 9) AS weight FROM ed JOIN pool u ON u.video = ed.video_id AND u.frame_idx = src JOIN pool w ON w.video_id = u.video_id AND w.frame_idx = dst WHERE u.label = w.label UNION ALL SELECT * FROM cr)""",
        _ranked(f"sd AS (SELECT video_id, frame_idx, 0.5 * {_pct('sem', 'video_id')} + 0.5 * {_pct('conf', 'video_id')} AS seed FROM pool)", "le", 0.5, 30),
        """fin AS (SELECT video_id // 1000 AS video_id, video_id % 1000 AS query_id, 'descend' AS branch, frame_idx, round(p, 6) + 0.0 AS score FROM pr WHERE k = 30
  UNION ALL SELECT sv.video_id, sv.query_id, branch, sv.frame_idx, round(sem, 6) + 0.0 FROM sv JOIN gt USING (video_id, query_id) WHERE branch = 'shortcut' AND survives)""",
        "SELECT video_id, query_id, branch, rank, frame_idx, score FROM (SELECT *, row_number() OVER (PARTITION BY video_id, query_id ORDER BY score DESC, frame_idx) AS rank FROM fin) WHERE rank <= 5",
        recursive=True,
    )


def _turns(s, d):
    t = table(s, d, "conversations").filter("text is not null")
    at = (F.col("conv_id") * 1000 + F.col("turn")).alias
    said = F.col("role") == "assistant"
    return t.filter(said).select(F.col("conv_id").alias("session"), at("claim_id"), "text"), t.filter(~said).select(F.col("conv_id").alias("session"), at("fact_id"), "text")


def claim_vote_topical(s, d):
    claims, facts = _turns(s, d)
    pairs = E.topical_pairs(claims, facts)
    draw = (F.col("claim_id") * 7 + F.col("fact_id") * 13) % 5
    return E.topical_verdicts(claims, pairs.withColumn("label", F.when(draw < 2, "entailment").when(draw == 2, "contradiction").otherwise("neutral")))


def _stem_sql(x):
    for pattern, left in E.ENDINGS:
        x = f"regexp_replace({x}, '{pattern}', '{left}')"
    return x


_TOPICAL = f"""tu AS (SELECT conv_id AS session, conv_id * 1000 + turn AS id, role = 'assistant' AS said, list_filter(regexp_extract_all(lower(text), '\\p{{L}}+'), lambda x: len(x) > 2 AND NOT list_contains({STOP_WORDS}, x)) AS ws FROM conversations WHERE text IS NOT NULL),
st AS (SELECT DISTINCT session, id, said, {_stem_sql('x')} AS stem FROM (SELECT session, id, said, unnest(ws) AS x FROM tu)),
tp AS (SELECT c.session, c.id AS claim_id, f.id AS fact_id, count(*) AS shared FROM st c JOIN st f ON c.session = f.session AND c.stem = f.stem AND c.said AND NOT f.said GROUP BY ALL)"""


def _cited(s, d):
    """Facts of frames, a second for 40,000; every fifth event cites a frame and a time."""
    facts = frames(s, d).select(F.col("video_id").alias("session"), F.col("event_id").alias("fact_id"), "frame_idx", F.round(F.col("timestamp") / 40000, 2).alias("timestamp"))
    e = table(s, d, "events").filter("event_id % 5 = 0")
    t = F.col("event_id") * 37 % 6500
    text = F.concat(F.lit("Frames "), (F.col("event_id") % 70).cast("string"), F.lit(" show it at "), F.expr("cast(event_id * 37 % 6500 div 100 as string)"), F.lit("."), F.lpad((t % 100).cast("string"), 2, "0"), F.lit("s, as do 7s."))
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("claim_id"), text.alias("text")), facts


def _scopes(s, d):
    pairs = _votes(s, d).select("claim_id", "fact_id", (F.col("fact_id") * 7919 % 1000 / F.lit(1000.0)).alias("similarity"), "label")
    now = F.when(F.col("claim_id") % 3 == 0, "verified").when(F.col("claim_id") % 3 == 1, "rejected").otherwise("unverifiable")
    return pairs, table(s, d, "events").select((F.col("event_id") % 2600).alias("claim_id")).distinct().withColumn("verdict", now)


def hybrid_full(s, d):
    """F5 with all four terms: persistence is the prominence of peaks, the graph's that of topology G14."""
    n = written(_nodes(s, d, "ids").select("video_id", "frame_idx", "timestamp", "pos", "score_range", "action_score", "vec_id"), "nodes")
    peaks = S.peak_prominence(n).select("video_id", "frame_idx", r6(F.col("prominence")).alias("persistence_value"))
    # temporal edges weigh time and action only
    edges = G.edges_temporal(n.withColumn("clip_embedding", F.lit(None).cast("array<float>")), 2)
    ranks = G.pagerank(n, edges, "action_score", 0.85, 60).select("video_id", "frame_idx", r6(F.col("pagerank")).alias("pagerank"))
    f = n.join(peaks, ["video_id", "frame_idx"], "left").join(ranks, ["video_id", "frame_idx"]).fillna(0.0, ["persistence_value"])
    return R.hybrid(f, P.valid_queries(queries_of(s, d)), 0.5, 5, 0.4, 0.3, 0.3, 0.1, contributions=True, vectors=vectors_of(s, d))


def cache_answers(s, d):
    """ST1 to ST3: a video's frames in order, after every tenth a pushed rank of the frame before it, after every twentieth a query."""
    f = _scored(s, d, True)
    seq = (F.col("frame_idx") * 3).alias("seq")
    admitted = f.select("video_id", seq, "frame_idx", F.col("action_score").alias("action"), F.lit(0.0).alias("persistence"), F.col("luma_entropy").alias("entropy"), F.col("clip_embedding").alias("embedding"))
    ranks = f.filter("frame_idx % 10 = 9").select("video_id", (seq + 1).alias("seq"), (F.col("frame_idx") - 1).alias("frame_idx"), F.col("luma_diff_energy").alias("pagerank"))
    q = queries_of(s, d)
    asked = f.filter("frame_idx % 20 = 19").select("video_id", (seq + 2).alias("seq"), (F.floor(F.col("frame_idx") / 20) % 8).alias("query_id")).join(F.broadcast(q), "query_id").select("video_id", "seq", F.col("q").alias("embedding"), F.lit(5).alias("top_k"))
    return cache_fold(merged(admitted, ranks, asked), 16).withColumn("keep_score", r6(F.col("keep_score")))


def pq_recall(s, d):
    """Recall of the trained codes against the exact search, per query."""
    v, q = table(s, d, "embeddings"), queries_of(s, d)
    found = K.gated_search(v, q, 16, 6, top_k=20)
    return K.recall_at(found, V.tiered_exact(v.withColumn("tier", F.lit("CANDIDATE")), q, 5))


def index_contents(s, d):
    """An index of all videos, written as a version, checked by its hashes and read back."""
    n = _nodes_once(s, d)
    at = f"{shared_dir(s)}/frame-indexes/{uuid.uuid4().hex}"
    write_index(n.select("video_id", "frame_idx", "timestamp", "action_score", "packet_size", "pict_type", "clip_embedding"), _dedup(n).select("video_id", "src", "dst", "weight", "edge_type"), at, {"graph_mode": "flat"})
    f, e, _ = read_index(s, at)
    ends = e.groupBy("video_id").agg(F.count(F.lit(1)).alias("edges"), r6(F.sum(F.round("weight", 6))).alias("weight"))
    return f.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames"), F.max("codec_conf").alias("codec_conf"), F.max("scene_id").cast("bigint").alias("scene_id")).join(ends, "video_id")


_FLOORS, _MOST = [round(0.5 + 0.05 * i, 2) for i in range(9)], [1, 3, 5]

QUERIES = {
    **{f"scene_descend_{mode}": (scene_descend(mode), _descend_sql(mode)) for mode in P.MODES},
    "pagerank_rounds": (
        lambda s, d: (lambda n: pagerank_rounds(n, _dedup(n), ["video_id"], "action_score", 0.5, 1e-9))(_nodes_once(s, d)).withColumn("pagerank", r6(F.col("pagerank"))),
        w(NODES, DEDUPED, _ranked("sd AS (SELECT video_id, frame_idx, action_score AS seed FROM n)", "ed", 0.5, 40), "SELECT video_id, frame_idx, round(p, 6) + 0.0 AS pagerank FROM pr WHERE k = 40", recursive=True),
    ),
    "retrieve_hybrid_full": (
        hybrid_full,
        w(
            SCORED_E,
            SIMILAR,
            f"pp AS ({SQL['peak_prominence']})",
            f"pg AS ({SQL['pagerank_static']})",
            """x AS (SELECT sq.video_id, query_id, sq.frame_idx, 0.4 * sem AS semantic, 0.3 * CASE WHEN span = 0 THEN 1.0 ELSE greatest(0.0, 1 - abs(action_score - 0.5) / span) END AS motion_query, 0.3 * coalesce(prominence, 0.0) AS persistence, 0.1 * pagerank AS graph
  FROM (SELECT *, max(action_score) OVER (PARTITION BY video_id) - min(action_score) OVER (PARTITION BY video_id) AS span FROM sq) sq LEFT JOIN pp ON pp.video_id = sq.video_id AND pp.frame_idx = sq.frame_idx JOIN pg ON pg.video_id = sq.video_id AND pg.frame_idx = sq.frame_idx),
y AS (SELECT *, round(semantic + motion_query + persistence + graph, 6) + 0.0 AS score FROM x)""",
            "SELECT video_id, query_id, rank, frame_idx, score, round(semantic, 9) + 0.0 AS semantic, round(motion_query, 9) + 0.0 AS motion_query, round(persistence, 9) + 0.0 AS persistence, round(graph, 9) + 0.0 AS graph FROM (SELECT *, row_number() OVER (PARTITION BY video_id, query_id ORDER BY score DESC, frame_idx) AS rank FROM y) WHERE rank <= 5",
        ),
    ),
    "cache_answers": (cache_answers, None),
    "pq_recall": (pq_recall, None),
    "diverse_frames": (lambda s, d: K.diverse_frames(frames(s, d, True)), None),
    "index_contents": (
        index_contents,
        w(NODES, DEDUPED, "fc AS (SELECT video_id, count(*) AS frames FROM n GROUP BY ALL)", "ec AS (SELECT video_id, count(*) AS edges, round(sum(round(weight, 6)), 6) + 0.0 AS weight FROM ed GROUP BY ALL)", "SELECT video_id, frames, edges, weight, 0.5::DOUBLE AS codec_conf, -1::BIGINT AS scene_id FROM fc JOIN ec USING (video_id)"),
    ),
    "scene_bimodality": (
        lambda s, d: P.scene_bimodality(frames(s, d, True)),
        w(
            EMBEDDED,
            """e AS (SELECT video_id, label AS scene_id, frame_idx, emb FROM fe WHERE emb IS NOT NULL AND label >= 0),
cell AS (SELECT video_id, scene_id, pos, avg(x) AS mean, round(var_pop(x), 9) AS var FROM (SELECT video_id, scene_id, unnest(emb) AS x, generate_subscripts(emb, 1) AS pos FROM e) GROUP BY ALL),
sc AS (SELECT video_id, scene_id, list(mean ORDER BY pos) AS centroid, arg_max(pos, (var, -pos)) AS axis FROM cell GROUP BY ALL),
p AS (SELECT e.*, list_cosine_similarity(emb, centroid) AS tc, round(emb[axis], 9) AS x FROM e JOIN sc USING (video_id, scene_id)),
g AS (SELECT *, count(*) OVER v AS n, row_number() OVER o AS k, sum(x) OVER (PARTITION BY video_id, scene_id ORDER BY x, frame_idx ROWS UNBOUNDED PRECEDING) AS l, sum(x) OVER v AS t FROM p WINDOW v AS (PARTITION BY video_id, scene_id), o AS (PARTITION BY video_id, scene_id ORDER BY x, frame_idx)),
h AS (SELECT *, CASE WHEN k < n THEN round(l * l / k + (t - l) * (t - l) / (n - k), 9) END AS gain FROM g),
b AS (SELECT video_id, scene_id, arg_max(k, (gain, -k)) FILTER (gain IS NOT NULL) AS cut FROM h GROUP BY ALL),
sd AS (SELECT h.*, coalesce(k <= cut, false) AS side FROM h JOIN b USING (video_id, scene_id)),
ce AS (SELECT video_id, scene_id, side, list(mean ORDER BY pos) AS centre FROM (SELECT video_id, scene_id, side, pos, avg(x) AS mean FROM (SELECT video_id, scene_id, side, unnest(emb) AS x, generate_subscripts(emb, 1) AS pos FROM sd) GROUP BY ALL) GROUP BY ALL),
r AS (SELECT video_id, scene_id, count(*) AS frames, avg(tc) AS mean_cosine, avg(list_cosine_similarity(emb, centre)) AS within FROM sd JOIN ce USING (video_id, scene_id, side) GROUP BY ALL)""",
            "SELECT video_id, scene_id, frames, round(mean_cosine, 6) + 0.0 AS mean_cosine, CASE WHEN frames >= 6 THEN round(within, 6) + 0.0 END AS within_cosine, CASE WHEN frames >= 6 THEN round(within - mean_cosine, 9) > 0.05 END AS bimodal FROM r",
        ),
    ),
    "time_subsample": (
        lambda s, d: P.time_subsample(frames(s, d), 43200.0).select("video_id", "pick", "frame_idx"),
        w(
            FRAMES,
            """p AS (SELECT video_id, 0::BIGINT AS pick, min(frame_idx) AS frame_idx FROM f WHERE timestamp >= 0 GROUP BY video_id UNION ALL
  SELECT p.video_id, any_value(p.pick) + 1, min(f.frame_idx) FROM p JOIN f ON f.video_id = p.video_id AND f.frame_idx > p.frame_idx AND f.timestamp >= (p.pick + 1) * 43200.0 WHERE p.pick < 49 GROUP BY p.video_id)""",
            "SELECT video_id, pick, frame_idx FROM p",
            recursive=True,
        ),
    ),
    "topical_pairs": (lambda s, d: E.topical_pairs(*_turns(s, d)), w(_TOPICAL, "SELECT * FROM tp")),
    "claim_vote_topical": (
        claim_vote_topical,
        w(
            _TOPICAL,
            """tv AS (SELECT claim_id, count(*) FILTER (draw < 2) AS entailed, count(*) FILTER (draw = 2) AS contradicted, count(*) AS facts FROM (SELECT claim_id, (claim_id * 7 + fact_id * 13) % 5 AS draw FROM tp) GROUP BY ALL),
al AS (SELECT DISTINCT id AS claim_id FROM tu WHERE said),
cv AS (SELECT claim_id, coalesce(entailed, 0) AS entailed, coalesce(contradicted, 0) AS contradicted, coalesce(facts, 0) AS facts FROM al LEFT JOIN tv USING (claim_id))""",
            "SELECT *, CASE WHEN contradicted > entailed THEN 'rejected' WHEN entailed > 0 THEN 'verified' ELSE 'unverifiable' END AS verdict FROM cv",
        ),
    ),
    "citations": (
        lambda s, d: E.citations(*_cited(s, d)),
        w(
            FRAMES,
            """fa AS (SELECT video_id AS session, event_id AS fact_id, frame_idx, round(timestamp / 40000, 2) AS ts FROM f),
cl AS (SELECT user_id AS session, event_id AS claim_id, event_id % 70 AS n, event_id * 37 % 6500 / 100.0::DOUBLE AS t FROM events WHERE event_id % 5 = 0),
hit AS (SELECT session, claim_id, fact_id, 0 AS how FROM cl JOIN fa USING (session) WHERE frame_idx = n UNION ALL SELECT session, claim_id, fact_id, 1 FROM cl JOIN fa USING (session) WHERE abs(ts - t) <= 0.3::DOUBLE OR abs(ts - 7.0::DOUBLE) <= 0.3::DOUBLE)""",
            "SELECT session, claim_id, fact_id, CASE WHEN min(how) = 0 THEN 'frame' ELSE 'time' END AS cited_by FROM hit GROUP BY ALL",
        ),
    ),
    "scoped_sweep": (
        lambda s, d: E.scoped_sweep(*_scopes(s, d), _FLOORS, _MOST),
        w(
            _VOTES,
            f"""cu AS (SELECT claim_id, CASE claim_id % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'rejected' ELSE 'unverifiable' END AS now FROM (SELECT DISTINCT event_id % 2600 AS claim_id FROM events)),
gr AS (SELECT unnest({_FLOORS})::DOUBLE AS tau, k FROM (SELECT unnest({_MOST}) AS k)),
sp AS (SELECT tau, k, claim_id, label, row_number() OVER (PARTITION BY tau, k, claim_id ORDER BY sim DESC, fact_id) AS rn FROM (SELECT *, fact_id * 7919 % 1000 / 1000.0::DOUBLE AS sim FROM vo) JOIN gr ON sim >= tau),
ag AS (SELECT tau, k, claim_id, count(*) FILTER (label = 'entailment') AS e, count(*) FILTER (label = 'contradiction') AS c FROM sp WHERE rn <= k GROUP BY ALL),
ve AS (SELECT gr.tau, gr.k, now, CASE WHEN c > e THEN 'rejected' WHEN e > 0 THEN 'verified' ELSE 'unverifiable' END AS scoped FROM gr CROSS JOIN cu LEFT JOIN ag ON ag.tau = gr.tau AND ag.k = gr.k AND ag.claim_id = cu.claim_id)""",
            "SELECT tau, k::BIGINT AS k, count(*) FILTER (scoped = 'verified') AS verified, count(*) FILTER (scoped = 'rejected') AS rejected, count(*) FILTER (scoped = 'unverifiable') AS unverifiable, count(*) FILTER (scoped <> now) AS flips FROM ve GROUP BY tau, k",
        ),
    ),
}

#: SQL of queries of the other modules, where it needs what is here.
SQL_OF_OTHERS = {
    "pagerank_union": w(NODES, DEDUPED, _ranked("sd AS (SELECT video_id, frame_idx, action_score AS seed FROM n)", "ed", 0.85, 60), "SELECT video_id, frame_idx, round(p, 6) + 0.0 AS pagerank FROM pr WHERE k = 60", recursive=True),
    "retrieve_ppr_union": w(
        NODES,
        DEDUPED,
        f"nc AS (SELECT n.*, query_id, video_id * 1000 + query_id AS vq, {_COS.format('emb', 'q')} AS sem, CASE WHEN count(*) OVER (PARTITION BY video_id, query_id, pict_type) < 2 THEN 0.5 ELSE 0.1 + 0.9 * {_pct('packet_size', 'video_id, query_id, pict_type')} END AS conf FROM n CROSS JOIN qs)",
        "qe AS (SELECT video_id * 1000 + query_id AS video_id, src, dst, weight FROM ed CROSS JOIN qs)",
        _ranked(f"sd AS (SELECT vq AS video_id, frame_idx, 0.5 * {_pct('sem', 'vq')} + 0.5 * {_pct('conf', 'vq')} AS seed FROM nc)", "qe", 0.5, 30),
        "fin AS (SELECT video_id // 1000 AS video_id, video_id % 1000 AS query_id, frame_idx, round(p, 6) + 0.0 AS score FROM pr WHERE k = 30)",
        "SELECT video_id, query_id, rank, frame_idx, score FROM (SELECT *, row_number() OVER (PARTITION BY video_id, query_id ORDER BY score DESC, frame_idx) AS rank FROM fin) WHERE rank <= 8",
        recursive=True,
    ),
}
