"""Queries of the vector, cache, claim and metric operators, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprs import cosine, duration_bucket, keep_score, r6, verification_mode
from ..operators import claims as C
from ..operators import export as X
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import retrieval as R
from ..operators import signal as S
from ..operators import vector as V
from ..sources.frames import frames, queries_of, table
from .oracle import COMPLETE, EMBEDDED, FRAMES, NODES, SCORED, SCORED_E, SIMILAR, TIERED, w


def _scored(s, d, e=False):
    return S.action_score(frames(s, d, e))


def _r(df, *columns):
    return df.withColumns({c: r6(F.col(c)) for c in columns})


def _vectors(s, d):
    x = F.col("vec_id") % 100 / F.lit(100.0)
    return table(s, d, "embeddings").select("vec_id", "embedding", G.index_tier(x, F.col("vec_id") % 10 == 0).alias("tier"))


_VECTORS = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, CASE WHEN vec_id % 10 = 0 THEN 'PEAK' WHEN vec_id % 100 / 100.0 >= 0.35 THEN 'SALIENT' ELSE 'CANDIDATE' END AS tier FROM embeddings), qs AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < 8)"


def _votes(s, d):
    e = table(s, d, "events")
    label = F.when(F.col("event_type") == "purchase", "entailment").when(F.col("event_type") == "error", "contradiction").otherwise("neutral")
    return e.select((F.col("event_id") % 2500).alias("claim_id"), F.col("event_id").alias("fact_id"), label.alias("label"), F.col("value").alias("score"), (F.col("event_id") % 7 != 0).alias("overlap"))


def _claims(s, d):
    """Ids of claims, some of which have no votes."""
    return table(s, d, "events").select((F.col("event_id") % 2600).alias("claim_id")).distinct()


def _labelled(s, d):
    """Verdicts of all layers: by votes, of metadata checks and of absence claims."""
    v = C.majority(_votes(s, d))
    other = F.element_at(F.array(*[F.lit(x) for x in ("checked_fail", "checked_pass", "verified_absent", "field_unavailable")]), (F.col("claim_id") % 11 + 1).cast("int"))
    verdict = F.when(F.col("claim_id") % 11 < 4, other).otherwise(F.col("verdict"))
    return v.select(F.expr("claim_id div 5").alias("answer_id"), (F.col("claim_id") % 5 == 0).alias("is_core"), verdict.alias("verdict"))


_VOTES = "vo AS (SELECT event_id % 2500 AS claim_id, event_id AS fact_id, CASE event_type WHEN 'purchase' THEN 'entailment' WHEN 'error' THEN 'contradiction' ELSE 'neutral' END AS label, value AS score, event_id % 7 <> 0 AS overlap FROM events)"
_MAJORITY = "ma AS (SELECT claim_id, count(*) FILTER (overlap AND label = 'entailment') AS entailed, count(*) FILTER (overlap AND label = 'contradiction') AS contradicted, count(*) FILTER (overlap) AS facts FROM vo GROUP BY ALL), mv AS (SELECT *, CASE WHEN contradicted > entailed THEN 'rejected' WHEN entailed > 0 THEN 'verified' ELSE 'unverifiable' END AS verdict FROM ma)"


_SAYINGS = ["it was there before", "probably a car is gone now", "No longer snow", "beforehand, nowhere", "maybe, after all"]


def _captions():
    """Texts with phrases that the flag words and hedges are in."""
    return F.concat_ws(" ", "text", F.element_at(F.array(*[F.lit(x) for x in _SAYINGS]), (F.col("doc_id") % 5 + 1).cast("int")))


_CAPTIONS = "cap AS (SELECT *, concat_ws(' ', text, list_extract([" + ", ".join(f"'{x}'" for x in _SAYINGS) + "], (doc_id % 5 + 1)::INT)) AS caption FROM documents)"


def _uniform(s, d, k=8):
    f = frames(s, d)
    return M.uniform(f, k).join(f.select("video_id", "frame_idx", "timestamp"), ["video_id", "frame_idx"])


_UNIFORM = """po AS (SELECT video_id, frame_idx, timestamp, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 AS pos, count(*) OVER (PARTITION BY video_id) AS n FROM f),
un AS (SELECT DISTINCT po.video_id, frame_idx, timestamp FROM po JOIN range(0, 8) r(i) ON pos = round_even(i * (n - 1) / 7, 0)::BIGINT)"""
_SPANS = """du AS (SELECT video_id, max(timestamp) AS t FROM f GROUP BY ALL),
sp AS (SELECT video_id, qid, family, CASE family WHEN 'C' THEN t / 4 WHEN 'T' THEN t * (video_id % 3) / 3 ELSE 0.0 END AS s,
  CASE family WHEN 'C' THEN t / 4 + t * 0.05 * 2 WHEN 'T' THEN t * (video_id % 3) / 3 + t * 0.05 ELSE t END AS e FROM du CROSS JOIN (VALUES (0::BIGINT, 'C'), (1::BIGINT, 'T'), (2::BIGINT, 'D')) q(qid, family))"""


def _ranked(s, d):
    f = _scored(s, d)
    return M.top_k(f, "action_score", 10).join(f.select("video_id", "frame_idx", "timestamp"), ["video_id", "frame_idx"])


_RANKED = "ra AS (SELECT video_id, frame_idx, timestamp, rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY action_score DESC, frame_idx) AS rank FROM a) WHERE rank <= 10)"
_RR = "fi AS (SELECT sp.video_id, qid, family, min(rank) FILTER (ra.timestamp BETWEEN s AND e) AS first FROM sp LEFT JOIN ra USING (video_id) GROUP BY ALL), rr AS (SELECT video_id, qid, family, coalesce(first <= 1, false)::BIGINT AS recall_at_1, coalesce(first <= 5, false)::BIGINT AS recall_at_5, coalesce(first <= 10, false)::BIGINT AS recall_at_10, round(coalesce(1.0 / first, 0.0), 6) AS mrr FROM fi)"


def _rank_rows(s, d):
    return M.ranked_retrieval(_ranked(s, d), M.spans(frames(s, d)))


def _coverages(s, d):
    f = frames(s, d)
    e = M.spans(f)
    stamps = f.select("video_id", "frame_idx", "timestamp")
    rows = None
    for name, picked in (("uniform", M.uniform(f, 8)), ("strided", M.strided(f, 9)), ("packet_topk", M.top_k(f, "packet_size", 8).drop("rank"))):
        m = M.selection_coverage(picked.join(stamps, ["video_id", "frame_idx"]), e).withColumn("method_name", F.lit(name))
        rows = m if rows is None else rows.union(m)
    return rows


def method_summary(s, d):
    rows = _coverages(s, d)
    return _r(rows.groupBy("method_name").agg(F.avg("window_coverage").alias("window_coverage"), F.avg("min_temp_dist").alias("min_temp_dist"), F.count(F.lit(1)).alias("events")), "window_coverage", "min_temp_dist")


_METHOD_PICKS = """st AS (SELECT video_id, frame_idx, timestamp FROM po WHERE pos % 9 = 0 OR pos = n - 1),
pk AS (SELECT video_id, frame_idx, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY packet_size DESC, frame_idx) AS rn FROM f) WHERE rn <= 8),
al AS (SELECT 'uniform' AS method_name, * FROM un UNION ALL SELECT 'strided', * FROM st UNION ALL SELECT 'packet_topk', * FROM pk),
cv AS (SELECT method_name, sp.video_id, qid, max((al.timestamp BETWEEN s AND e)::INT) AS hit, min(greatest(s - al.timestamp, al.timestamp - e, 0.0)) AS dist FROM sp JOIN al USING (video_id) GROUP BY ALL)"""


def stability(s, d):
    """Two passes over the same claims, classed as stable, shifted or in one pass only."""
    v = C.majority(_votes(s, d)).select("claim_id", "verdict")
    one, two = v.filter("claim_id % 11 != 0"), C.any_entailed(_votes(s, d)).filter("claim_id % 13 != 0").select("claim_id", F.col("verdict").alias("other"))
    j = one.join(two, "claim_id", "full_outer")
    kind = F.when(F.col("verdict").isNull() | F.col("other").isNull(), "missing").when(F.col("verdict") == F.col("other"), "stable").otherwise("shifted")
    return j.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("claims"))


def claim_gate(s, d):
    return _r(M.claim_gate(_coverages(s, d), "packet_topk"), "proposed", "baseline_coverage", "improvement", "ci_lower", "ci_upper")


_GRID = ([0.3, 0.5, 0.7], [0.5, 0.7, 0.9])


def best_tradeoff(s, d):
    scored = _scored(s, d).withColumn("persistence_value", F.col("luma_diff_energy"))
    return _r(M.best_tradeoff(M.grid_recall(scored, M.spans(scored), *_GRID)).select("action_t", "persistence_t", "recall", "compression"), "recall", "compression")


def event_metrics(s, d):
    f = frames(s, d)
    events = M.event_frames(f, M.spans(f).filter("family != 'D'"))
    return _r(M.event_metrics(events, S.survivors(f), f), "event_recall", "frame_recall", "survivor_precision")


def _answers(s, d):
    text = F.concat("text", F.lit("\nFinal answer: ("), F.substring(F.lit("ABCDEFG"), (F.col("conv_id") % 7 + 1).cast("int"), F.lit(1)), F.lit(")"))
    return table(s, d, "conversations").select("conv_id", "turn", F.coalesce(text, F.lit("")).alias("text"))


def _wire(s, d):
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("visual", "metadata", "absence", "global", "odd")]), (F.col("event_id") % 5 + 1).cast("int"))
    frame = F.when(F.col("event_id") % 4 == 0, F.lit(-1)).otherwise(F.col("user_id"))
    text = F.when(F.col("event_id") % 9 == 0, "none").otherwise(F.col("event_type"))
    return table(s, d, "events").select(F.col("event_id").alias("claim_id"), F.to_json(F.struct(kinds.alias("claim_type"), frame.alias("frame_idx"), (F.col("event_id") % 3 == 0).alias("is_core"), F.when(F.col("event_id") % 6 == 0, -1.0).otherwise(F.col("value")).alias("stated_value"), text.alias("text"))).alias("wire"))


def keep_topk(s, d):
    f = _scored(s, d)
    total = F.count(F.lit(1)).over(Window.partitionBy("video_id"))
    score = r6(keep_score(F.col("action_score"), F.col("luma_diff_energy"), F.lit(0.0), F.lit(0.0), F.col("luma_entropy"), F.lit(0.0), F.col("frame_idx"), total))
    return V.kept_top(f, score, 10).select("video_id", "frame_idx", "keep_score", "rank")


def _captioned(s, d):
    """Frames with a second vector, which stands for their caption's."""
    f, v = frames(s, d, True), table(s, d, "embeddings")
    at = (F.col("event_id") * 31 + 7) % v.count()
    return f.withColumn("caption_vec", at).join(v.select(F.col("vec_id").alias("caption_vec"), F.col("embedding").alias("caption_embedding")), "caption_vec")


def dual_all(s, d):
    """The similarity to every query; dual_similarity is that to query 0."""
    q = queries_of(s, d)
    f = R.with_similarity(_scored(s, d, True), q)
    m = V.motion_embedding(F.col("packet_size"), F.col("motion_magnitude"), F.col("luma_entropy"))
    x = f.withColumn("m", m).withColumn("motion", cosine(F.col("m"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))))
    return x.select("video_id", "query_id", "frame_idx", r6(V.dual_similarity(F.greatest("sem", F.lit(0.0)), F.col("motion"))).alias("similarity"))


def dual(s, d):
    return dual_all(s, d).filter("query_id = 0").drop("query_id")


QUERIES = {
    "tiered_exact": (lambda s, d: V.tiered_exact(_vectors(s, d), queries_of(s, d)), w(_VECTORS, "t AS (SELECT query_id, vec_id, tier, round(list_cosine_similarity(e, q), 6) + 0.0 AS sim FROM v CROSS JOIN qs)", "SELECT query_id, rank, vec_id, tier, sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM t) WHERE rank <= 5")),
    "tier_memory": (lambda s, d: _r(V.tier_memory(_vectors(s, d)), "reduction"), w(_VECTORS, "SELECT tier, count(*) AS vectors, sum(4 * len(e))::BIGINT AS flat_bytes, count(*) * 8 AS code_bytes, round(sum(4 * len(e)) / (count(*) * 8), 6) AS reduction FROM v GROUP BY ALL")),
    "lsh_candidates": (lambda s, d: V.lsh_neighbours(table(s, d, "embeddings"), queries_of(s, d)), None),
    "pq_adc": (lambda s, d: V.pq_search(table(s, d, "embeddings"), queries_of(s, d)), None),
    "kmeans_diversity": (lambda s, d: V.kmeans_diversity(table(s, d, "embeddings")), None),
    "l1_admit_fold": (lambda s, d: V.cache_fold(_scored(s, d).withColumn("score", r6(F.col("action_score"))), 10), None),
    "keep_score_topk": (
        keep_topk,
        w(SCORED, "k AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM a), ks AS (SELECT video_id, frame_idx, round(0.30 * action_score + 0.20 * luma_diff_energy + 0.10 * luma_entropy + 0.05 * least(greatest(1 - (n - 1 - frame_idx) / greatest(n - 1, 1), 0.0), 1.0), 6) + 0.0 AS keep_score FROM k)", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY keep_score DESC, frame_idx) AS rank FROM ks) WHERE rank <= 10"),
    ),
    "dual_similarity_all": (dual_all, w(SCORED_E, SIMILAR, "SELECT video_id, query_id, frame_idx, round(0.7 * greatest(sem, 0.0) + 0.3 * CASE WHEN sqrt(packet_size ** 2 + motion_magnitude ** 2 + luma_entropy ** 2) < 1e-8 THEN 0.0 ELSE packet_size / sqrt(packet_size ** 2 + motion_magnitude ** 2 + luma_entropy ** 2) END, 6) + 0.0 AS similarity FROM sq")),
    "dual_similarity": (dual, w(SCORED_E, SIMILAR, "SELECT video_id, frame_idx, round(0.7 * greatest(sem, 0.0) + 0.3 * CASE WHEN sqrt(packet_size ** 2 + motion_magnitude ** 2 + luma_entropy ** 2) < 1e-8 THEN 0.0 ELSE packet_size / sqrt(packet_size ** 2 + motion_magnitude ** 2 + luma_entropy ** 2) END, 6) + 0.0 AS similarity FROM sq WHERE query_id = 0")),
    "motion_embedding": (
        lambda s, d: frames(s, d).withColumn("m", V.motion_embedding(F.col("packet_size"), F.col("motion_magnitude"), F.col("luma_entropy"))).select("video_id", "frame_idx", *[r6(F.col("m")[k]).alias(f"m{k}") for k in range(3)]),
        w(FRAMES, "l AS (SELECT *, sqrt(packet_size ** 2 + motion_magnitude ** 2 + luma_entropy ** 2) AS n FROM f)", "SELECT video_id, frame_idx, round(packet_size / n, 6) + 0.0 AS m0, round(motion_magnitude / n, 6) + 0.0 AS m1, round(luma_entropy / n, 6) + 0.0 AS m2 FROM l"),
    ),
    "token_budget_fifo": (lambda s, d: C.token_fifo(table(s, d, "conversations"), 300), w("t AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda x: x <> ''))::BIGINT AS tokens FROM conversations)", "SELECT * FROM (SELECT conv_id, turn, tokens, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM t) WHERE used <= 300")),
    "fact_trim": (
        lambda s, d: C.fact_trim(table(s, d, "events").select(F.col("user_id").alias("set_id"), F.col("event_id").alias("fact_id"), F.col("value").alias("score"), (F.col("event_id") % 40 + 10).alias("tokens")), 100),
        "SELECT set_id, fact_id, score, used FROM (SELECT user_id AS set_id, event_id AS fact_id, value AS score, sum(event_id % 40 + 10) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE used <= 100 OR rn <= 2",
    ),
    "claim_split": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(C.claim_split(F.col("text"))).alias("pos", "claim")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.md5("claim").alias("claim_md5")),
        w(r"""c AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(text, '\*\*[^*\n]*\*\*:?', '', 'g'), '(?m)^[ \t]*(?:[-*•]|\d+[.)])[ \t]+', '', 'g'), '\n+', ' ', 'g')), '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 12) AS cs FROM documents)""", "SELECT doc_id, unnest(generate_series(0, len(cs) - 1)) AS pos, md5(unnest(cs)) AS claim_md5 FROM c WHERE len(cs) > 0"),
    ),
    "caption_normalize": (lambda s, d: table(s, d, "benchmark").select("item_id", C.caption_normalized(F.col("text")).alias("caption")), r"SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N} \n\t]', '', 'g'), '[ \n\t]+', ' ', 'g')) AS caption FROM benchmark"),
    "confabulation_flags": (lambda s, d: table(s, d, "documents").select("doc_id", F.concat_ws(",", C.confabulation_flags(_captions())).alias("flags")), w(_CAPTIONS, r"SELECT doc_id, coalesce(array_to_string(list_filter([" + ", ".join(f"'{x}'" for x in C.FLAG_WORDS) + r"], lambda x: regexp_matches(lower(caption), '(^|[^\p{L}\p{N}_])' || x || '($|[^\p{L}\p{N}_])')), ','), '') AS flags FROM cap")),
    "mc_parse_strict": (
        lambda s, d: _answers(s, d).select("conv_id", "turn", C.mc_strict(F.col("text")).alias("choice")),
        w(r"t AS (SELECT conv_id, turn, upper(regexp_extract(coalesce(text || chr(10) || 'Final answer: (' || substr('ABCDEFG', conv_id::INT % 7 + 1, 1) || ')', ''), '(?im)^[ \t]*(?:FINAL[ \t]+)?ANSWER[ \t]*:[ \t]*(?:OPTION[ \t]+)?\(?([A-E])\b', 1)) AS l FROM conversations)", "SELECT conv_id, turn, CASE WHEN l <> '' THEN (ascii(l) - 65)::BIGINT END AS choice FROM t"),
    ),
    "mc_parse_lenient": (
        lambda s, d: _answers(s, d).select("conv_id", "turn", C.mc_lenient(F.col("text")).alias("choice")),
        w(r"t AS (SELECT conv_id, turn, upper(regexp_extract(coalesce(text || chr(10) || 'Final answer: (' || substr('ABCDEFG', conv_id::INT % 7 + 1, 1) || ')', ''), '(?:^|[^\p{L}\p{N}_])([A-Fa-fXx])(?:$|[^\p{L}\p{N}_])', 1)) AS l FROM conversations)", "SELECT conv_id, turn, CASE WHEN l = 'X' THEN -1 WHEN l IN ('A', 'B', 'C', 'D', 'E') THEN (ascii(l) - 65)::BIGINT END AS choice FROM t"),
    ),
    "family_map": (lambda s, d: table(s, d, "events").groupBy(C.family(F.col("event_type")).alias("family")).agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN upper(event_type[1]) IN ('C', 'T', 'D') THEN upper(event_type[1]) END AS family, count(*) AS n FROM events GROUP BY 1"),
    "claim_confidence": (
        lambda s, d: table(s, d, "documents").select("doc_id", C.claim_confidence(_captions(), F.col("doc_id") % 2).alias("confidence")),
        w(_CAPTIONS, r"SELECT doc_id, CASE WHEN trim(caption) = '' THEN 0.0 WHEN list_has_any(regexp_split_to_array(lower(caption), '\s+'), ['maybe', 'probably', 'possibly', 'could', 'might', 'perhaps', 'approximate', 'approximately']) THEN 0.4 WHEN len(list_distinct(list_filter(regexp_split_to_array(lower(caption), '\s+'), lambda x: x <> ''))) < 3 THEN 0.3 WHEN doc_id % 2 >= 1 THEN 0.85 ELSE 0.65 END::DOUBLE AS confidence FROM cap"),
    ),
    "verification_mode": (lambda s, d: _scored(s, d).groupBy(verification_mode(r6(F.col("action_score"))).alias("mode")).agg(F.count(F.lit(1)).alias("frames")), w(SCORED, "SELECT CASE WHEN round(action_score, 6) >= 0.70 THEN 'full' WHEN round(action_score, 6) >= 0.35 THEN 'filtered' ELSE 'ner' END AS mode, count(*) AS frames FROM a GROUP BY 1")),
    "claim_vote": (lambda s, d: C.majority(_votes(s, d)), w(_VOTES, _MAJORITY, "SELECT * FROM mv")),
    "sentence_verdict": (
        lambda s, d: C.any_entailed(_votes(s, d)),
        w(_VOTES, "b AS (SELECT *, CASE label WHEN 'entailment' THEN 2 WHEN 'contradiction' THEN 1 ELSE 0 END AS r FROM vo), o AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY r DESC, score DESC, fact_id DESC) AS rn FROM b)", "SELECT claim_id, CASE r WHEN 2 THEN 'verified' WHEN 1 THEN 'rejected' ELSE 'unverifiable' END AS verdict, CASE WHEN r > 0 THEN fact_id END AS fact_id, CASE WHEN r > 0 THEN score END AS score FROM o WHERE rn = 1"),
    ),
    "absence_verdict": (lambda s, d: C.absence(_claims(s, d), _votes(s, d)), w(_VOTES, "cl AS (SELECT DISTINCT event_id % 2600 AS claim_id FROM events)", "SELECT cl.claim_id, CASE WHEN count(vo.claim_id) = 0 THEN 'unverifiable' WHEN count(*) FILTER (label = 'entailment') > 0 THEN 'rejected' ELSE 'verified_absent' END AS verdict, arg_max(fact_id, (score, fact_id)) FILTER (label = 'entailment') AS witness FROM cl LEFT JOIN vo ON vo.claim_id = cl.claim_id GROUP BY ALL")),
    "answer_badge": (
        lambda s, d: C.badges(_labelled(s, d)),
        w(_VOTES, _MAJORITY, "lv AS (SELECT claim_id, CASE claim_id % 11 WHEN 0 THEN 'checked_fail' WHEN 1 THEN 'checked_pass' WHEN 2 THEN 'verified_absent' WHEN 3 THEN 'field_unavailable' ELSE verdict END AS verdict FROM mv), kl AS (SELECT *, verdict IN ('verified', 'verified_absent', 'checked_pass') AS pass, verdict IN ('rejected', 'checked_fail') AS rejected FROM lv), g AS (SELECT claim_id // 5 AS answer_id, bool_or(claim_id % 5 = 0 AND pass) AS ok, bool_or(claim_id % 5 = 0 AND NOT pass) AS bad, bool_or(rejected) AS rej, bool_or(claim_id % 5 <> 0 AND NOT pass AND NOT rejected) AS open FROM kl GROUP BY ALL)", "SELECT answer_id, CASE WHEN NOT ok OR bad THEN 'unverified' WHEN rej THEN 'flagged' WHEN open THEN 'partial' ELSE 'verified' END AS badge FROM g"),
    ),
    "metadata_check": (
        lambda s, d: C.metadata_checked(table(s, d, "events").select(F.col("user_id").alias("video_id"), (F.col("event_id") % 80).alias("frame_idx"), F.col("event_id"), (F.col("event_id") % 500 / F.lit(1.0)).alias("stated")), frames(s, d).withColumn("p", F.floor("packet_size").cast("double")), "p").select("video_id", "event_id", "verdict"),
        w(FRAMES, "SELECT e.user_id AS video_id, e.event_id, CASE WHEN f.packet_size IS NULL THEN 'unverifiable' WHEN floor(f.packet_size) = (e.event_id % 500)::DOUBLE THEN 'checked_pass' ELSE 'checked_fail' END AS verdict FROM events e LEFT JOIN f ON f.video_id = e.user_id AND f.frame_idx = e.event_id % 80"),
    ),
    "wire_decode": (
        lambda s, d: C.wire_decoded(_wire(s, d)),
        w("x AS (SELECT event_id AS claim_id, CASE event_id % 5 WHEN 0 THEN 'visual' WHEN 1 THEN 'metadata' WHEN 2 THEN 'absence' WHEN 3 THEN 'global' ELSE 'odd' END AS claim_type, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS frame_idx, event_id % 3 = 0 AS is_core, CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS stated_value, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS text FROM events)", "SELECT *, CASE WHEN claim_type = 'odd' THEN 'unknown_claim_type' WHEN claim_type IN ('visual', 'metadata') AND frame_idx IS NULL THEN 'claim_field_shape' WHEN text IS NULL THEN 'claim_field_shape' END AS error FROM x"),
    ),
    "citation_gate": (
        lambda s, d: C.ungrounded(table(s, d, "events").select(F.col("event_id").alias("claim_id"), F.col("user_id").alias("video_id"), (F.col("event_id") % 60).alias("frame_idx")), _ranked(s, d)).select("claim_id", "video_id", "frame_idx"),
        w(SCORED, _RANKED, "SELECT event_id AS claim_id, user_id AS video_id, event_id % 60 AS frame_idx FROM events WHERE NOT EXISTS (SELECT 1 FROM ra WHERE ra.video_id = user_id AND ra.frame_idx = event_id % 60)"),
    ),
    "sampler_uniform": (lambda s, d: M.uniform(frames(s, d), 8), w(FRAMES, _UNIFORM, "SELECT video_id, frame_idx FROM un")),
    "sampler_iframe_fill": (
        lambda s, d: M.iframe_fill(frames(s, d), 8),
        w(FRAMES, "k AS (SELECT video_id, frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY video_id, pict_type ORDER BY frame_idx) AS rn FROM f) WHERE pict_type = 'I' AND rn <= 8), r AS (SELECT video_id, frame_idx, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 AS pos, count(*) OVER (PARTITION BY video_id) AS n FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.video_id = f.video_id AND k.frame_idx = f.frame_idx)), need AS (SELECT v.video_id, 8 - count(k.frame_idx) AS need FROM (SELECT DISTINCT video_id FROM f) v LEFT JOIN k USING (video_id) GROUP BY ALL)", "SELECT video_id, frame_idx, false AS is_fill FROM k UNION ALL SELECT DISTINCT r.video_id, r.frame_idx, true FROM r JOIN need USING (video_id) JOIN range(0, 8) g(i) ON i < need AND pos = (i * n) // need"),
    ),
    "sampler_topk": (lambda s, d: M.top_k(frames(s, d), "luma_diff_energy", 5), w(FRAMES, "SELECT * FROM (SELECT video_id, frame_idx, row_number() OVER (PARTITION BY video_id ORDER BY luma_diff_energy DESC, frame_idx) AS rank FROM f) WHERE rank <= 5")),
    "sampler_strided": (lambda s, d: M.strided(frames(s, d)), w(FRAMES, "SELECT video_id, frame_idx FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM f) WHERE frame_idx % 3 = 0 OR frame_idx = n - 1")),
    "sampler_random": (lambda s, d: M.random_sample(frames(s, d), 8, 1), None),
    "selection_coverage": (
        lambda s, d: _r(M.selection_coverage(_uniform(s, d), M.spans(frames(s, d))), "min_temp_dist", "best_iou"),
        w(FRAMES, _UNIFORM, _SPANS, "SELECT sp.video_id, qid, family, max((un.timestamp BETWEEN s AND e)::INT)::BIGINT AS window_coverage, round(min(greatest(s - un.timestamp, un.timestamp - e, 0.0)), 6) + 0.0 AS min_temp_dist, round(max(greatest(least(un.timestamp + 0.5, e) - greatest(un.timestamp - 0.5, s), 0.0) / (greatest(un.timestamp + 0.5, e) - least(un.timestamp - 0.5, s))), 6) + 0.0 AS best_iou, 1 - max((un.timestamp BETWEEN s AND e)::INT)::BIGINT AS zero_overlap FROM sp JOIN un USING (video_id) GROUP BY ALL"),
    ),
    "ranked_retrieval": (lambda s, d: _r(_rank_rows(s, d), "mrr"), w(SCORED, _SPANS, _RANKED, _RR, "SELECT * FROM rr")),
    "fiw_iop": (
        lambda s, d: _r(M.frames_in_window(_uniform(s, d), M.spans(frames(s, d))), "fiw", "iop"),
        w(FRAMES, _UNIFORM, _SPANS, "SELECT sp.video_id, qid, family, round(avg((un.timestamp BETWEEN s AND e)::INT), 6) + 0.0 AS fiw, round(coalesce(greatest(least(max(un.timestamp), e) - greatest(min(un.timestamp), s), 0.0) / nullif(max(un.timestamp) - min(un.timestamp), 0), 0.0), 6) + 0.0 AS iop FROM sp JOIN un USING (video_id) GROUP BY sp.video_id, qid, family, s, e"),
    ),
    "method_summary": (method_summary, w(FRAMES, _UNIFORM, _SPANS, _METHOD_PICKS, "SELECT method_name, round(avg(hit), 6) AS window_coverage, round(avg(dist), 6) + 0.0 AS min_temp_dist, count(*) AS events FROM cv GROUP BY ALL")),
    "claim_gate": (claim_gate, None),
    "strongest_baseline": (
        lambda s, d: _r(M.strongest_baseline(_coverages(s, d), "packet_topk"), "proposed", "baseline_coverage", "improvement"),
        w(FRAMES, _UNIFORM, _SPANS, _METHOD_PICKS, "ms AS (SELECT method_name, avg(hit) AS c FROM cv GROUP BY ALL), p AS (SELECT c FROM ms WHERE method_name = 'packet_topk'), b AS (SELECT * FROM ms WHERE method_name <> 'packet_topk' ORDER BY c DESC, method_name DESC LIMIT 1)", "SELECT round(p.c, 6) + 0.0 AS proposed, b.method_name AS baseline, round(b.c, 6) + 0.0 AS baseline_coverage, round(p.c - b.c, 6) + 0.0 AS improvement FROM p, b"),
    ),
    "mc_accuracy_groupingsets": (
        lambda s, d: _r(M.overall_and_by(_rank_rows(s, d), "family", questions="count(1)", correct="sum(recall_at_5)", accuracy="avg(recall_at_5)"), "accuracy"),
        w(SCORED, _SPANS, _RANKED, _RR, "SELECT coalesce(family, 'overall') AS family, count(*) AS questions, sum(recall_at_5)::BIGINT AS correct, round(avg(recall_at_5), 6) AS accuracy FROM rr GROUP BY GROUPING SETS ((family), ())"),
    ),
    "threshold_grid": (
        lambda s, d: _r(M.threshold_grid(_scored(s, d).withColumn("persistence_value", F.col("luma_diff_energy")), [0.3, 0.5, 0.7], [0.5, 0.7, 0.9]), "compression"),
        w(SCORED, "SELECT action_t::DOUBLE AS action_t, persistence_t::DOUBLE AS persistence_t, count(*) FILTER (action_score >= action_t OR luma_diff_energy >= persistence_t) AS kept, round(1 - count(*) FILTER (action_score >= action_t OR luma_diff_energy >= persistence_t) / count(*), 6) AS compression FROM a CROSS JOIN (VALUES (0.3), (0.5), (0.7)) x(action_t) CROSS JOIN (VALUES (0.5), (0.7), (0.9)) y(persistence_t) GROUP BY ALL"),
    ),
    "duration_buckets": (lambda s, d: frames(s, d).select(duration_bucket(F.col("packet_size") / 20).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN value / 20 < 2 THEN 'short' WHEN value / 20 <= 5 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n FROM events GROUP BY 1"),
    "weighted_means": (
        lambda s, d: _r(frames(s, d).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.avg("packet_size").alias("m")).agg(F.avg("m").alias("mean"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("weighted"), F.avg(F.when(F.col("n") >= 60, F.col("m"))).alias("pooled")), "mean", "weighted", "pooled"),
        "SELECT round(avg(m), 6) AS mean, round(sum(m * n) / sum(n), 6) AS weighted, round(avg(m) FILTER (n >= 60), 6) AS pooled FROM (SELECT count(*) AS n, avg(value) AS m FROM events GROUP BY user_id)",
    ),
    "best_tradeoff": (
        best_tradeoff,
        w(
            SCORED,
            _SPANS,
            """grid AS (SELECT action_t::DOUBLE AS action_t, persistence_t::DOUBLE AS persistence_t FROM (VALUES (0.3), (0.5), (0.7)) x(action_t) CROSS JOIN (VALUES (0.5), (0.7), (0.9)) y(persistence_t)),
kp AS (SELECT a.video_id, a.frame_idx, a.timestamp, action_t, persistence_t, action_score >= action_t OR luma_diff_energy >= persistence_t AS kept, action_score FROM a CROSS JOIN grid),
co AS (SELECT action_t, persistence_t, 1 - count(*) FILTER (kept) / count(*) AS compression FROM kp GROUP BY ALL),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, action_t, persistence_t ORDER BY action_score DESC, frame_idx) AS rn FROM kp WHERE kept) WHERE rn <= 5),
hi AS (SELECT sp.video_id, sp.qid, grid.action_t, grid.persistence_t, coalesce(max((tp.timestamp BETWEEN s AND e)::INT), 0) AS hit FROM sp CROSS JOIN grid LEFT JOIN tp ON tp.video_id = sp.video_id AND tp.action_t = grid.action_t AND tp.persistence_t = grid.persistence_t GROUP BY ALL),
rc AS (SELECT action_t, persistence_t, avg(hit) AS recall FROM hi GROUP BY ALL)""",
            "SELECT action_t, persistence_t, round(recall, 6) + 0.0 AS recall, round(compression, 6) + 0.0 AS compression FROM rc JOIN co USING (action_t, persistence_t) WHERE recall >= (SELECT max(recall) FROM rc) - 1e-5 ORDER BY co.compression DESC, action_t, persistence_t LIMIT 1",
        ),
    ),
    "stratified_allocation": (lambda s, d: M.stratified_allocation(table(s, d, "events"), "event_type", 97).select("event_type", F.col("available"), F.col("allocated").cast("bigint").alias("allocated")), w("c AS (SELECT event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, round_even(97 * n / sum(n) OVER (), 0)::BIGINT AS sh, row_number() OVER (ORDER BY n DESC, event_type) AS rn FROM c)", "SELECT event_type, n AS available, (sh + CASE WHEN rn = 1 THEN 97 - sum(sh) OVER () ELSE 0 END)::BIGINT AS allocated FROM r")),
    "pairwise_cosine": (
        lambda s, d: _r(M.mean_pairwise_cosine(table(s, d, "embeddings"), "label", "embedding").select(F.col("label").cast("bigint").alias("label"), "n", "mean_cosine"), "mean_cosine"),
        "SELECT a.label::BIGINT AS label, (SELECT count(*) FROM embeddings c WHERE c.label = a.label) AS n, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) + 0.0 AS mean_cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label",
    ),
    "spearman": (
        lambda s, d: _r(M.spearman(frames(s, d), "packet_size", "motion_magnitude"), "rho"),
        w(FRAMES, "r AS (SELECT video_id, rank() OVER (PARTITION BY video_id ORDER BY packet_size) + (count(*) OVER (PARTITION BY video_id, packet_size) - 1) / 2 AS a, rank() OVER (PARTITION BY video_id ORDER BY motion_magnitude) + (count(*) OVER (PARTITION BY video_id, motion_magnitude) - 1) / 2 AS b FROM f)", "SELECT video_id, round(corr(a, b), 6) + 0.0 AS rho FROM r GROUP BY ALL"),
    ),
    "stability_classes": (
        stability,
        w(_VOTES, _MAJORITY, "o AS (SELECT claim_id, CASE WHEN bool_or(label = 'entailment') THEN 'verified' WHEN bool_or(label = 'contradiction') THEN 'rejected' ELSE 'unverifiable' END AS other FROM vo WHERE claim_id % 13 <> 0 GROUP BY ALL), m AS (SELECT claim_id, verdict FROM mv WHERE claim_id % 11 <> 0)", "SELECT CASE WHEN verdict IS NULL OR other IS NULL THEN 'missing' WHEN verdict = other THEN 'stable' ELSE 'shifted' END AS class, count(*) AS claims FROM m FULL JOIN o USING (claim_id) GROUP BY 1"),
    ),
    "length_buckets": (
        lambda s, d: _r(table(s, d, "documents").join(table(s, d, "labels"), "doc_id").groupBy(F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "medium").otherwise("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("rate")), "rate"),
        "SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n, round(avg(quality), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY 1",
    ),
    "fidelity_margin": (
        lambda s, d: _r(M.fidelity_margin(_captioned(s, d)), "margin"),
        w(
            EMBEDDED,
            "p AS (SELECT fe.*, e.embedding::DOUBLE[] AS cap FROM fe JOIN embeddings e ON e.vec_id = (event_id * 31 + 7) % (SELECT count(*) FROM embeddings) WHERE emb IS NOT NULL)",
            "o AS (SELECT u.video_id, u.frame_idx, avg(list_cosine_similarity(u.cap, x.emb)) AS other FROM p u JOIN p x ON u.video_id = x.video_id AND u.frame_idx <> x.frame_idx GROUP BY ALL)",
            "SELECT p.video_id, p.frame_idx, round(list_cosine_similarity(cap, emb) - other, 6) + 0.0 AS margin FROM p LEFT JOIN o ON o.video_id = p.video_id AND o.frame_idx = p.frame_idx",
        ),
    ),
    "event_recall": (
        event_metrics,
        w(
            TIERED,
            _SPANS,
            """ev AS (SELECT sp.video_id, qid, min(frame_idx) AS x, max(frame_idx) AS y FROM sp JOIN f USING (video_id) WHERE family <> 'D' AND timestamp BETWEEN s AND e GROUP BY ALL),
su AS (SELECT video_id, frame_idx FROM t WHERE tier <> 'SKIP'),
er AS (SELECT video_id, avg(hit) AS event_recall FROM (SELECT ev.video_id, qid, coalesce(max((su.frame_idx BETWEEN x AND y)::INT), 0) AS hit FROM ev LEFT JOIN su USING (video_id) GROUP BY ALL) GROUP BY ALL),
un AS (SELECT DISTINCT f.video_id, f.frame_idx FROM f JOIN ev ON ev.video_id = f.video_id AND f.frame_idx BETWEEN x AND y),
nu AS (SELECT un.video_id, count(*) AS frames, count(su.frame_idx) AS common FROM un LEFT JOIN su ON su.video_id = un.video_id AND su.frame_idx = un.frame_idx GROUP BY ALL),
ns AS (SELECT video_id, count(*) AS samples FROM su GROUP BY ALL)""",
            "SELECT er.video_id, round(event_recall, 6) + 0.0 AS event_recall, round(common / frames, 6) + 0.0 AS frame_recall, round(common / samples, 6) + 0.0 AS survivor_precision FROM er LEFT JOIN nu ON nu.video_id = er.video_id LEFT JOIN ns ON ns.video_id = er.video_id",
        ),
    ),
    "feature_matrix": (
        lambda s, d: X.feature_matrix(frames(s, d, True), ["packet_size", "motion_magnitude", "luma_entropy"], embedding="clip_embedding").select("video_id", "frame_idx", F.size("features").cast("bigint").alias("width"), r6(F.aggregate("features", F.lit(0.0), lambda a, x: a + x)).alias("total")),
        w(SCORED_E, "SELECT video_id, frame_idx, 67::BIGINT AS width, round(packet_size + motion_magnitude + luma_entropy + list_sum(emb), 6) + 0.0 AS total FROM fe"),
    ),
    "graph_export": (
        lambda s, d: G.export(G.edges_complete(G.nodes(_scored(s, d, True))).withColumn("weight", r6(F.col("weight"))), 3).select("video_id", F.col("rn").cast("bigint").alias("place"), F.get_json_object("edge", "$.src").cast("long").alias("src"), F.get_json_object("edge", "$.dst").cast("long").alias("dst")),
        w(NODES, COMPLETE, "SELECT video_id, place, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(weight, 6) DESC, src, dst) AS place FROM ec) WHERE place <= 3"),
    ),
    "embedding_health": (
        lambda s, d: _r(X.embedding_health(table(s, d, "embeddings").withColumn("label", F.col("label").cast("bigint")), "label", "embedding"), "min_norm", "max_norm", "mean_std"),
        "SELECT label::BIGINT AS label, vectors, distinct_vectors, min_norm, max_norm, mean_std FROM (SELECT label, count(*) AS vectors, count(DISTINCT embedding) AS distinct_vectors, round(min(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS min_norm, round(max(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS max_norm FROM embeddings GROUP BY ALL) JOIN (SELECT label, round(avg(s), 6) AS mean_std FROM (SELECT label, pos, stddev_pop(y) AS s FROM (SELECT label, unnest(embedding)::DOUBLE AS y, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY ALL) USING (label)",
    ),
    "scene_bursts": (lambda s, d: (lambda f: X.bursts(f, S.valley_scenes(f)))(frames(s, d)), None),
    "oversized_scenes": (lambda s, d: (lambda f: X.split_oversized(f, S.valley_scenes(f), 2))(frames(s, d)), None),
    "bootstrap_ci": (lambda s, d: X.bootstrap_interval(_rank_rows(s, d), "recall_at_5"), None),
    "query_phrase": (
        lambda s, d: table(s, d, "benchmark").select("item_id", X.query_phrase(F.col("text")).alias("phrase")),
        f"SELECT item_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND NOT list_contains({X.STOP_WORDS}, x))[1:8], ' ') AS phrase FROM benchmark",
    ),
}
