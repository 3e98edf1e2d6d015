"""MinHash near-duplicate detection: universal hash minima, banding, signature
verification, exact confirmation and star-contracted components.

Copies (equal shingle sets) form one class and only its smallest doc_id goes on. Shingles that no
other document of any bucket has can be in no intersection, so a document with too many of them links with nothing
and two documents' shares of them bound their similarity, exactly. Buckets are never expanded into
all pairs: first every document meets hubs of its buckets, among them the one with the least share of such
shingles (of edited copies, that nearest to what was copied), on full sets; then only pairs
of different components whose bound reaches the threshold meet, in tiles of bounded size, by signature,
and those that may reach the threshold are confirmed on full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, drop_written, table, text_blocks, texts_shingles, without, written
from .components import connected

#: 24 bands of 5 minima: a pair at similarity 0.85 shares no band with a chance of 8e-7.
BANDS, ROWS = 24, 5
MINIMA = BANDS * ROWS
#: Similarity of a link, in hundredths.
PERCENT = 85
#: Rows on either side of a tile of a bucket, and hubs of a bucket.
TILE, HUBS = 384, 3
#: Chance that a linked pair's equal minima fall short of those that are asked for.
MISSED = 1e-6
#: Parts of all hashes by which two sets' common ones are bounded.
PARTS = 256
#: Bits of the filter that tells the second scan which documents to keep.
MOST_FILTER_BITS = 1 << 27

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
_CHUNK = 32_768


def shingle_sets(texts: list[bytes | None], n: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    return [np.unique(s) for at in text_blocks(texts) for s in texts_shingles(texts[at], n)]


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The smallest value of each universal hash over each set; 0 for empty sets."""
    out = np.zeros((len(sets), MINIMA), np.uint32)
    chunk: list[int] = []
    size = 0
    for i, s in enumerate([*sets, None]):
        if chunk and (s is None or size + len(s) > _CHUNK):
            x = np.concatenate([sets[j] for j in chunk])
            starts = np.cumsum([0, *(len(sets[j]) for j in chunk[:-1])])
            t = np.empty_like(x)
            for k in range(MINIMA):
                np.multiply(x, _A[k], out=t)
                np.add(t, _B[k], out=t)
                out[chunk, k] = np.minimum.reduceat(t, starts) >> np.uint64(32)
            chunk, size = [], 0
        if s is not None and len(s):
            chunk.append(i)
            size += len(s)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    key = np.zeros((len(m), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ m[:, r::ROWS].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def part_sizes(s: np.ndarray) -> np.ndarray:
    """How many of a set's hashes are in each of PARTS equal parts of all hashes. Two sets have at most the sum of the
    lesser sizes in common."""
    return np.bincount((s.view(np.uint64) >> np.uint64(56)).astype(np.int64), minlength=PARTS).astype(np.uint32)


def _sketches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            sets = shingle_sets(batch.column(1).to_pylist(), n)
            m = minima(sets)
            keys = band_keys(m)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.md5(s.tobytes(), usedforsecurity=False).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel())),
                    pa.array([row.tobytes() for row in m], pa.binary()),
                    pa.array([part_sizes(s).tobytes() for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_id", "bands", "sig", "parts"],
            )

    return run


def _sets(n: int, bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            wanted = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            for part in np.array_split(wanted, max(1, len(wanted) // 256)):
                if len(part):
                    rows = batch.take(pa.array(part))
                    sets = [s.view(np.int64) for s in shingle_sets(rows.column(1).to_pylist(), n)]
                    offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["doc_id", "s"])

    return run


def bit_filter(rows: DataFrame, column: str) -> np.ndarray:
    """A bitmap with the places of the column's values, for scans that drop what is certainly not among
    them. Its size follows the rows up to MOST_FILTER_BITS; beyond that it lets more through."""
    count = rows.count()
    size = 1 << 16
    while size < min(16 * count, MOST_FILTER_BITS):
        size *= 2
    at = F.pmod(F.xxhash64(column), F.lit(size))
    words = rows.select(at.alias("at")).groupBy((F.col("at") / 64).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("v")).toArrow()
    flags = np.zeros(size // 64, np.int64)
    flags[words["w"].to_numpy()] = words["v"].to_numpy()
    return flags.view(np.uint8)


def filter_place(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of 64-bit keys in a bitmap over Spark's xxhash64 of them."""
    u = np.uint64
    x = keys.view(u) * u(0xC2B2AE3D27D4EB4F)
    x = ((x << u(31)) | (x >> u(33))) * u(0x9E3779B185EBCA87)
    x ^= u(42 + 0x27D4EB2F165667C5 + 8)
    x = ((x << u(27)) | (x >> u(37))) * u(0x9E3779B185EBCA87) + u(0x85EBCA77C2B2AE63)
    x ^= x >> u(33)
    x *= u(0xC2B2AE3D27D4EB4F)
    x ^= x >> u(29)
    x *= u(0x165667B19E3779F9)
    x ^= x >> u(32)
    return (x & u(len(bits) * 8 - 1)).astype(np.int64)


def wanted_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(doc_id, s) of the documents in wanted(doc_id), and few others: a filter of a fixed
    size goes to the scan in place of a shuffle of all texts."""
    bits = bit_filter(wanted, "doc_id")
    at = F.pmod(F.xxhash64("doc_id"), F.lit(len(bits) * 8))
    source = docs.filter("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("binary"), at.alias("at"))
    return source.mapInArrow(_sets(n, bits), "doc_id long, s array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def own_shingles(sets: DataFrame) -> DataFrame:
    """(doc, size, own) of the documents of sets(doc_id, s): own of the shingles are in no other document of sets. Rows
    that repeat a doc_id with other texts have no own ones."""
    alone = sets.select("doc_id", F.explode("s").alias("h")).groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")).filter("doc_id = last")
    own = alone.groupBy("doc_id").agg(F.count("*").alias("own"))
    rows = sets.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.size("s")).cast("long").alias("size"))
    return rows.join(own, "doc_id", "left").select(F.col("doc_id").alias("doc"), "size", F.when(F.col("rows") == 1, F.coalesce("own", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("own"))


def least_equal(percent: int) -> int:
    """The most minima that may be asked for: a pair at the similarity has fewer with a chance of at most MISSED."""
    t, k, below = percent / 100, 0, 0.0
    while k < MINIMA and (below := below + math.comb(MINIMA, k) * t**k * (1 - t) ** (MINIMA - k)) <= MISSED:
        k += 1
    return max(1, k)


def _tiles(percent: int):
    least = least_equal(percent)

    def pairs(rows: list[tuple]) -> list[tuple[int, int]]:
        _, i, j, band = rows[0][:4]
        own = [r for r in rows if r[4] == i]
        other = own if i == j else [r for r in rows if r[4] == j]
        sig = lambda rs: np.frombuffer(b"".join(r[7] for r in rs), np.uint32).reshape(len(rs), MINIMA)
        col = lambda rs, k: np.array([r[k] for r in rs], np.int64)
        out = []
        if not own or not other:
            return out
        s, sizes, shared, comps, ids = sig(other), col(other, 8), col(other, 8) - col(other, 9), col(other, 6), col(other, 5)
        parts = np.frombuffer(b"".join(r[10] for r in other), np.uint32).reshape(len(other), PARTS)
        for k, r in enumerate(own):
            at = slice(k + 1, None) if i == j else slice(None)
            most = np.minimum(shared[at], r[8] - r[9])  # of what the two can have in common
            maybe = (comps[at] != r[6]) & (100 * most >= percent * (sizes[at] + r[8] - most))
            hit = np.flatnonzero(maybe)
            if len(hit):
                equal = s[at][hit] == np.frombuffer(r[7], np.uint32)
                first = equal.reshape(len(hit), BANDS, ROWS).all(2).argmax(1)
                hit = hit[(first == band) & (equal.sum(1) >= least)]
                most = np.minimum(parts[at][hit], np.frombuffer(r[10], np.uint32)).sum(1, dtype=np.int64)
                for o in ids[at][hit[100 * most >= percent * (sizes[at][hit] + r[8] - most)]]:
                    out.append((min(r[5], int(o)), max(r[5], int(o))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, found = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][:3] != row[:3]:
                    found += pairs(group)
                    group = []
                group.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])
                found = []
        if group and (found := pairs(group)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased. A text of fewer than n words has
    its whole sequence as one shingle; null texts and those without words have none and link
    with nothing. Rows that repeat a doc_id are one node; a null doc_id has a null component
    and kept false. Other columns are ignored; an empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sketches = written(source.mapInArrow(_sketches(n), "doc_id long, n_shingles long, set_id binary, bands array<long>, sig binary, parts binary"), "sketches")
    own = sketches.filter("doc_id is not null and set_id is not null")
    classes = written(own.groupBy("set_id").agg(F.min("doc_id").alias("rep")), "classes")

    key = own.select("set_id", F.col("doc_id").alias("rep"), "bands").join(classes, ["set_id", "rep"]).select(F.col("rep").alias("doc"), F.posexplode("bands").alias("band", "key"))
    members = written(key.join(key.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "key"), "members")
    sets = written(wanted_sets(docs, members.select(F.col("doc").alias("doc_id")).distinct(), n), "sets")
    able = written(own_shingles(sets).filter(100 * (F.col("size") - F.col("own")) >= percent * F.col("size")), "able")
    known = members.join(able, "doc")

    hub = lambda *order: F.min(F.struct(*order, F.col("doc")))["doc"]
    random = [hub(F.xxhash64(F.col("doc"), F.lit(k))).alias(f"h{k}") for k in range(1, HUBS)]
    buckets = known.groupBy("key").agg(F.count("*").alias("n"), hub(F.col("own") / F.col("size"), F.xxhash64("doc")).alias("h0"), *random).filter("n > 1")
    to = F.explode(F.array(*[F.struct(F.lit(k == 0).alias("central"), F.col(f"h{k}").alias("b")) for k in range(HUBS)])).alias("to")
    met = known.join(buckets, "key").select(F.col("doc").alias("a"), to).select("a", "to.*").filter("a != b").groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(F.col("central").cast("int")).alias("central"))
    best = met.groupBy("a").agg(F.max(F.struct("n", -F.col("b"))).alias("x"), F.max(F.struct("central", -F.col("b"))).alias("y"))
    pairs = best.select("a", F.explode(F.array_distinct(F.array(-F.col("x")["col2"], -F.col("y")["col2"]))).alias("b"))
    links = confirmed(pairs, sets, percent)
    first = written(connected(links), "first")

    nodes = known.join(first.withColumnRenamed("node", "doc"), "doc", "left").select("key", "band", "doc", "own", F.coalesce("component", "doc").alias("comp"))
    mixed_buckets = nodes.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.countDistinct("doc").alias("n")).filter("lo != hi").select("key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    sketched = own.select(F.col("doc_id").alias("doc"), "set_id", "sig", "parts", "n_shingles").dropDuplicates(["doc", "set_id"])
    open_rows = nodes.join(mixed_buckets, "key").join(sketched, "doc")
    tile = F.pmod(F.xxhash64(F.col("doc"), F.lit(7)), F.col("tiles")).cast("int")
    spread = (
        open_rows.withColumn("tile", tile)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("key", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "band", "tile", "doc", "comp", "sig", "n_shingles", "own", "parts")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )
    candidates = written(spread.mapInArrow(_tiles(percent), "a long, b long").filter("a != b").distinct(), "candidates")
    more = confirmed(candidates, sets, percent)
    final = connected(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    for df in (members, sets, able, first, candidates):
        drop_written(df)
    of_set = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component"))
    return sketches.select("doc_id", "n_shingles", "set_id").join(of_set, "set_id", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(False)).alias("kept"),
    )


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 or more) stays: that with
    the smallest doc_id."""
    return without(docs, near_duplicates(docs, percent=80).filter("not kept").select("doc_id"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM d),
z AS (SELECT doc_id, len(s) AS n FROM s), h AS (SELECT doc_id, hash(x) AS x FROM (SELECT doc_id, unnest(s) AS x FROM s)),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h a JOIN h b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM common JOIN z sa ON sa.doc_id = a JOIN z sb ON sb.doc_id = b WHERE 100 * c >= 85 * (sa.n + sb.n - c)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r) AS component_id, s.doc_id = min(r) AS kept
FROM s JOIN reach ON reach.doc_id = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
