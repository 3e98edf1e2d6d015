"""Which facts speak to which claims: shared stems, cited frames and seconds, and verdicts under scopes of similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .export import STOP_WORDS

#: Seconds by which a cited time may miss a fact's.
TOLERANCE = 0.3
#: Endings that a stem loses, in this order: pattern and what is left (fixed values, used by the SQL as well).
ENDINGS = [(r"(\p{L}{2})ies$", r"\1y"), (r"(\p{L}{3})(ing|ed)$", r"\1"), (r"(\p{L}{2}[^s])s$", r"\1")]


def stems(text: Column) -> Column:
    """U8: the distinct words of a text, lower-cased, of more than two letters and no stop words, without the endings of number and
    tense. Stands in for a tagger's lemmas."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)), lambda x: (F.length(x) > 2) & ~x.isin(STOP_WORDS))

    def stem(x: Column) -> Column:
        for pattern, left in ENDINGS:
            x = F.regexp_replace(x, pattern, left.replace("\\", "$"))
        return x

    return F.array_distinct(F.transform(words, stem))


def topical_pairs(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """(session, claim_id, fact_id, shared) of claims(session, claim_id, text) and facts(session, fact_id, text) of one session that
    share stems. Facts that share none can't vote, so the cross join of a session is not made: claims and facts meet
    on the stem, and only pairs that meet go to a scorer."""
    c = claims.select("session", "claim_id", F.explode(stems(F.col("text"))).alias("stem"))
    f = facts.select("session", "fact_id", F.explode(stems(F.col("text"))).alias("stem"))
    return c.join(f, ["session", "stem"]).groupBy("session", "claim_id", "fact_id").agg(F.count(F.lit(1)).alias("shared"))


def verdict_of(entailed: Column, contradicted: Column) -> Column:
    return F.when(contradicted > entailed, "rejected").when(entailed > 0, "verified").otherwise("unverifiable")


def topical_verdicts(claims: DataFrame, pairs: DataFrame) -> DataFrame:
    """A13 over topical pairs(claim_id, fact_id, label): a verdict for every claim; those that no fact speaks to are unverifiable."""
    votes = pairs.groupBy("claim_id").agg(F.count_if(F.col("label") == "entailment").alias("entailed"), F.count_if(F.col("label") == "contradiction").alias("contradicted"), F.count(F.lit(1)).alias("facts"))
    v = claims.select("claim_id").distinct().join(votes, "claim_id", "left").fillna(0, ["entailed", "contradicted", "facts"])
    return v.withColumn("verdict", verdict_of(F.col("entailed"), F.col("contradicted")))


def citations(claims: DataFrame, facts: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(session, claim_id, fact_id, cited_by) of claims(session, claim_id, text) and facts(session, fact_id, frame_idx, timestamp). `Frame 7`
    cites the fact of that frame, `12.5s` all facts within the tolerance; a fact that is cited both ways counts as cited by its frame.

    Times meet in buckets a little wider than the tolerance, each with its neighbours, so there is no range join.
    """
    keys = ["session", "claim_id"]
    by_frame = claims.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(r"(?i)frames?\s+(\d+)"), F.lit(1))).alias("n")).select(*keys, F.expr("try_cast(n AS bigint)").alias("frame_idx"))
    framed = by_frame.join(facts.select("session", "fact_id", "frame_idx"), ["session", "frame_idx"]).select(*keys, "fact_id", F.lit(0).alias("how"))
    wide = tolerance * 1.01
    times = claims.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(r"(\d+\.?\d*)s"), F.lit(1))).alias("n")).select(*keys, F.col("n").cast("double").alias("t")).distinct()
    near = times.withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("t") / wide) + k)))
    timed = near.join(facts.select("session", "fact_id", "timestamp", F.floor(F.col("timestamp") / wide).alias("bucket")), ["session", "bucket"]).filter(F.abs(F.col("timestamp") - F.col("t")) <= tolerance)
    every = framed.union(timed.select(*keys, "fact_id", F.lit(1).alias("how")))
    return every.groupBy(*keys, "fact_id").agg(F.min("how").alias("how")).select(*keys, "fact_id", F.when(F.col("how") == 0, "frame").otherwise("time").alias("cited_by"))


def scoped_sweep(pairs: DataFrame, current: DataFrame, floors: list[float], most: list[int]) -> DataFrame:
    """(tau, k, verified, rejected, unverifiable, flips) over claims of current(claim_id, verdict), if of pairs(claim_id, fact_id, similarity, label)
    only those vote that are at least tau similar, and of them the k most similar (ties: the smaller fact_id).

    The vote of a scope is that of the first so many facts of a claim, in order. So running counts hold every scope's vote, and each scope is read at one row
    of a claim: where its k is full or the next fact is below tau. One sort a claim serves the whole grid. A null similarity doesn't vote.
    """
    order = Window.partitionBy("claim_id").orderBy(F.desc("similarity"), "fact_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    count = lambda label: F.sum((F.col("label") == label).cast("long")).over(so_far)
    ranked = pairs.filter("similarity is not null and similarity = similarity").select("claim_id", "similarity", F.row_number().over(order).alias("place"), F.lead("similarity").over(order).alias("next"), verdict_of(F.coalesce(count("entailment"), F.lit(0)), F.coalesce(count("contradiction"), F.lit(0))).alias("scoped"))
    grid = F.array(*[F.struct(F.lit(float(t)).alias("tau"), F.lit(int(k)).alias("k")) for t in floors for k in most])

    def ends_here(g: Column) -> Column:
        last = F.col("next").isNull() | (F.col("next") < g["tau"])
        return (F.col("similarity") >= g["tau"]) & ((F.col("place") == g["k"]) | ((F.col("place") < g["k"]) & last))

    read = ranked.select("claim_id", "scoped", F.explode(F.filter(grid, ends_here)).alias("g")).join(current.select("claim_id", F.col("verdict").alias("now")), "claim_id")
    cells = read.groupBy(F.col("g.tau").alias("tau"), F.col("g.k").alias("k")).agg(
        F.count_if(F.col("scoped") == "verified").alias("verified"), F.count_if(F.col("scoped") == "rejected").alias("rejected"), F.count_if(F.col("scoped") == "unverifiable").alias("open"),
        F.count_if(F.col("scoped") != F.col("now")).alias("flipped"), F.count_if(F.col("now") == "unverifiable").alias("open_now"), F.count(F.lit(1)).alias("n"),
    )
    of_all = current.agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("verdict") == "unverifiable").alias("open_all"))
    whole = current.sparkSession.range(1).select(F.explode(grid).alias("g")).select("g.*").join(cells, ["tau", "k"], "left").fillna(0).crossJoin(F.broadcast(of_all))
    # claims without a fact in scope are unverifiable
    return whole.select("tau", F.col("k").cast("bigint").alias("k"), "verified", "rejected", (F.col("open") + F.col("claims") - F.col("n")).alias("unverifiable"), (F.col("flipped") + (F.col("claims") - F.col("n")) - (F.col("open_all") - F.col("open_now"))).alias("flips"))
