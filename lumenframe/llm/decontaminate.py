"""Benchmark decontamination: size-partitioned MinHash containment search.

Containment is asymmetric, so only the short side is sketched. The items are partitioned
by their number of shingles; each partition has a sketch width of u - ceil(t * u) + 1 for
its upper size u, and an item's sketch is that many of its smallest shingle hashes
(bottom-k MinHash). By the pigeonhole principle a document that holds at least the share t
of an item's shingles holds one of its sketch, so the search loses nothing, however long the
document is. Only sketches are looked up among the documents' shingles; pairs that share other shingles alone are
refused. The pairs found are verified on the shingles themselves, word by word. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, SHINGLE_WORDS, drop_written, table, without, written

#: Share of an item's shingles that a document must hold.
CONTAINMENT = 0.8
#: Shingles of all sketches up to which they are broadcast (40 bytes each); beyond it the join shuffles.
BROADCAST_SHINGLES = 500_000
#: Items up to which their shingles are broadcast for the verification.
BROADCAST_ITEMS = 20_000
#: Shingles by which the sizes of two partitions differ.
SIZE_STEP = 8


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column, n: int) -> Column:
    """Hashes of all runs of n words; an empty array where there are fewer words."""
    return _runs(words, n, lambda w: F.xxhash64(*w))


def _runs(words: Column, n: int, of) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: of([F.element_at(words, i + k) for k in range(n)]))
    return F.when(F.size(words) >= n, runs).otherwise(F.filter(F.array(of([F.lit("")] * n)), lambda x: F.lit(False)))


def _texts_of(words: Column, n: int) -> Column:
    return _runs(words, n, lambda w: F.concat_ws(" ", *w))


def _by_width(width: Column, widths: list[int], of) -> Column:
    """of(k) for the width k that a row has."""
    out = None
    for k in widths:
        out = F.when(width == k, of(k)) if out is None else out.when(width == k, of(k))
    return out


def sketched(items: DataFrame, n: int = SHINGLE_WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """(item_key, item_id, width, texts, size, sketch): an item's distinct shingles and the hashes of its sketch.
    An item of fewer than n words has its whole sequence as one shingle of that width; one without words is left out.
    Rows that repeat an item_id with other words are other items."""
    w = items.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0).select("item_id", "w", F.least(F.size("w"), F.lit(n)).alias("width"))
    each = list(range(1, n + 1))
    texts = F.array_distinct(_by_width(F.col("width"), each, lambda k: _texts_of(F.col("w"), k)))
    hashes = F.array_sort(F.array_distinct(_by_width(F.col("width"), each, lambda k: shingles_of(F.col("w"), k))))
    s = w.select("item_id", "width", texts.alias("texts"), hashes.alias("hashes")).withColumn("size", F.size("texts"))
    upper = F.ceil(F.col("size") / SIZE_STEP) * SIZE_STEP
    sketch = F.slice("hashes", 1, (upper - F.ceil(upper * containment) + 1).cast("int"))
    return s.select(F.xxhash64("item_id", "texts").alias("item_key"), "item_id", "width", "texts", "size", sketch.alias("sketch")).dropDuplicates(["item_key"])


def candidates(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(doc_key, item_key) of the documents that hold a shingle of an item's sketch."""
    looked_up = sketches.select("item_key", F.explode("sketch").alias("h"))
    sizes = sketches.agg(F.sum(F.size("sketch")).alias("n"), F.collect_set("width").alias("widths")).first()
    if (sizes["n"] or 0) <= BROADCAST_SHINGLES:
        looked_up = F.broadcast(looked_up)
    # nothing is computed for the widths that no item has
    widths = sorted(sizes["widths"]) or [1]
    words = docs.select("doc_key", words_of(F.col("text")).alias("w"))
    hashes = [shingles_of(F.col("w"), k) for k in widths]
    held = words.select("doc_key", F.explode(F.concat(*hashes) if len(hashes) > 1 else hashes[0]).alias("h"))
    return held.join(looked_up, "h").select("doc_key", "item_key").distinct()


def contaminated(docs: DataFrame, items: DataFrame, n: int = SHINGLE_WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document and item with at least `containment` of the item's shingles in the
    document: doc_id, item_id, item_shingles, found_shingles.

    Null and empty texts hold and are held by nothing; each row of docs is judged by its own text, rows that
    repeat a doc_id (null too) with one that holds an item give one row, with the most that one of them holds; other
    columns are ignored; empty tables give no rows.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("doc_key"))
    sketches = written(sketched(items, n, containment), "sketches")
    found = written(candidates(docs, sketches), "candidates")
    # a key that two rows share by accident only adds a pair to verify
    pairs = F.broadcast(found) if found.count() <= BROADCAST_IDS else found
    known = sketches.select("item_key", "item_id", "width", "texts", "size")
    widths = sorted(r["width"] for r in known.select("width").distinct().collect()) or [n]  # at most n
    both = docs.join(pairs, "doc_key").join(F.broadcast(known) if known.count() <= BROADCAST_ITEMS else known, "item_key")
    both = both.select("doc_id", "item_id", "size", "texts", "width", words_of(F.col("text")).alias("w"))
    held = F.size(F.array_intersect("texts", _by_width(F.col("width"), widths, lambda k: _texts_of(F.col("w"), k))))
    enough = F.when(F.col("found") >= F.ceil(F.col("size") * containment), F.struct("found", "size"))
    # the condition stands in the aggregate: as a filter it would be pushed down with all that it is computed from
    verified = both.select("doc_id", "item_id", "size", held.alias("found")).groupBy("doc_id", "item_id").agg(F.max(enough).alias("best"))
    out = written(verified.filter("best is not null"), "contaminated")
    for df in (sketches, found):
        drop_written(df)
    return out.select("doc_id", "item_id", F.col("best.size").cast("long").alias("item_shingles"), F.col("best.found").cast("long").alias("found_shingles"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows that repeat a doc_id go together, those without stay."""
    return without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


_WORDS = r"(SELECT *, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM {table})"
ORACLE_SQL = f"""
WITH i AS (SELECT DISTINCT item_id, width, list_distinct(list_transform(range(1, len(w) - width + 2), lambda k: array_to_string(w[k:k+width-1], ' '))) AS s
  FROM (SELECT *, least(len(w), 5) AS width FROM {_WORDS.replace("{table}", "benchmark")}) WHERE len(w) > 0),
d AS (SELECT DISTINCT doc_id, text, width, unnest(list_transform(range(1, len(w) - width + 2), lambda k: array_to_string(w[k:k+width-1], ' '))) AS h
  FROM {_WORDS.replace("{table}", "documents")}, (SELECT DISTINCT width FROM i) WHERE len(w) >= width),
ih AS (SELECT item_id, width, s, len(s) AS size, unnest(s) AS h FROM i),
held AS (SELECT doc_id, text, item_id, s, size, count(*) AS found FROM d JOIN ih USING (width, h) GROUP BY ALL HAVING count(*) >= ceil(0.8 * size)),
best AS (SELECT doc_id, item_id, size, found, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY found DESC, size DESC) AS k FROM held)
SELECT doc_id, item_id, size::BIGINT AS item_shingles, found::BIGINT AS found_shingles FROM best WHERE k = 1
"""
