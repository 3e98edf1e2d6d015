"""How far the sources of a language are from each other: every two of them meet in a round-robin tournament.

A language's kept terms are cut into segments. In each segment the sources' vectors are dealt into blocks that stay in
their partition; compressed copies of the others' vectors come by, round after round (circle method), and each meeting
gives both directions. A task holds one block of one segment and one guest.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Documents of a language that a kept term is in at least; ranks of part `term`.
LEAST_DOCS, TOP_TERMS = 10, 10
#: Terms of a segment and sources of a block, on average (both are dealt by hashes).
SEGMENT_TERMS, BLOCK_SOURCES = 4096, 8
#: Different terms of a source that a task counts before it hands them on.
HELD_TERMS = 400_000

_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Steps of a partition's rows before the rounds: the language itself, then the block's own sources.
_LANGUAGE, _RESIDENT = -2, -1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = defaultdict(lambda: (Counter(), Counter()))

    def out():
        for (lang, source), (n, docs) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(n.keys(), pa.binary()).view(pa.string()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        total.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            terms = text.as_buffer().to_pybytes().translate(_TERMS).split()
            n, docs = total[lang, source]
            before = len(n)
            n.update(terms)
            docs.update(set(terms))
            held += len(n) - before
            if held > HELD_TERMS:
                yield from out()
                held = 0
    yield from out()


def p_of(count: np.ndarray, of: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / of), three decimal places at a time: exact while of is under 9 * 10^15."""
    rest, out = count.astype(np.int64) + 2, np.zeros(len(count), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // of
        rest %= of
    return out + 1


def f_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Steps between ascending ids, then the counts, compressed."""
    return zlib.compress(np.diff(ids, prepend=0).astype("<u4").tobytes() + counts.astype("<u8").tobytes(), 1)


def unpacked(raw: bytes | None, size: int) -> np.ndarray:
    """The counts of all ids below size."""
    out = np.zeros(size, np.int64)
    if raw:
        b = zlib.decompress(raw)
        k = len(b) // 12
        out[np.cumsum(np.frombuffer(b, "<u4", k))] = np.frombuffer(b, "<u8", k, 4 * k)
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the list columns ids, counts (and terms) makes binary ones."""
    for batch in batches:
        vecs, names = [], []
        for k in range(len(batch)):
            entries = batch.column("entries")[k].values
            ids, counts = (entries.field(x).to_numpy() for x in ("id", "n"))
            vecs.append(packed(ids, counts))
            names.append(zlib.compress(" ".join(entries.field("term").to_pylist()).encode(), 1) if "term" in entries.type.names else b"")
        rest = [c for c in batch.schema.names if c != "entries"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(vecs, pa.binary()), pa.array(names, pa.binary())], [*rest, "vec", "terms"])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition by (lang, segment, host, step): for each two sources the sum over the segment, for each resident its top terms."""
    here = None
    language, terms, block = None, [], []
    out: list[tuple] = []

    def batch_of():
        made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.string()] * 4 + [pa.int64()], strict=True)], ["lang", "source", "part", "item", "value"])
        out.clear()
        return made

    def meet(lang: str, x: tuple, y: tuple) -> None:
        value = int(f_of(x[1], y[1]).sum())
        out.append((lang, x[0], "pair", y[0], value))
        out.append((lang, y[0], "pair", x[0], value))

    for batch in batches:
        for row in (batch.slice(k, 1).to_pylist()[0] for k in range(len(batch))):
            key = row["lang"], row["segment"], row["host"]
            if key != here:
                here, block, language = key, [], None
            counts = unpacked(row["vec"], row["size"])
            p = p_of(counts, row["of"]) if row["of"] else counts
            if row["step"] == _LANGUAGE:
                language, terms = p, zlib.decompress(row["terms"]).decode().split(" ") if row["terms"] else []
                continue
            me = row["source"], p
            for other in block:
                meet(row["lang"], me, other)
            if row["step"] == _RESIDENT:
                block.append(me)
                over = np.flatnonzero((counts > 0) & (p > language))
                f = f_of(p[over], language[over])
                # ids ascend with the terms, so the smaller id is the smaller term
                out.extend((row["lang"], row["source"], "term", terms[i], v) for v, i in ((-a, b) for a, b in heapq.nsmallest(TOP_TERMS, zip((-f).tolist(), over.tolist(), strict=True))))
            if len(out) > 50_000:
                yield batch_of()
    if out:
        yield batch_of()


def _partner(block: str, round_: str, teams: str):
    """Whom a block meets in a round of teams - 1 rounds (teams is even): a + b = round modulo teams - 1, and the last team meets the one that is left over."""
    rounds = f"({teams} - 1)"
    return F.expr(f"CASE WHEN {block} = {rounds} THEN pmod({round_} * ({teams} div 2), {rounds}) WHEN pmod({round_} - {block}, {rounds}) = {block} THEN {rounds} ELSE pmod({round_} - {block}, {rounds}) END")


def divergence(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of docs(text, lang, source).

    Part `pair`: every other source of the language by its distance, part `term`: up to ten terms that the source has
    more often than the language. Null text, lang and source are ''; groups without kept terms are at distance from
    the others as their smoothed shares are, 0 in a language without kept terms. Equal values rank by item. Repeated rows are documents of
    their own, other columns are ignored, an empty table gives no rows.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    of_term = Window.partitionBy("lang", "term")
    kept = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn("in_docs", F.sum("docs").over(of_term)).filter(F.col("in_docs") >= LEAST_DOCS)
    counts = written(kept.select("lang", "term", "source", "n"), "counts")
    kept_terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    groups = docs.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = written(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")), "groups")
    size = kept_terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(size, "lang", "left").select(
        "lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), F.expr(f"greatest(1, ceil(v / {SEGMENT_TERMS}))").cast("int").alias("segments"), F.expr(f"ceil(sources / {BLOCK_SOURCES})").cast("int").alias("blocks")
    )
    langs = written(langs.withColumn("teams", F.expr("blocks + blocks % 2")), "langs")

    numbered = kept_terms.join(langs.select("lang", "segments"), "lang").select("lang", "term", "n", F.expr("pmod(xxhash64(term), segments)").cast("int").alias("segment"))
    numbered = written(numbered.withColumn("id", F.row_number().over(Window.partitionBy("lang", "segment").orderBy("term")) - 1), "terms")
    of_langs = numbered.groupBy("lang", "segment").agg(F.array_sort(F.collect_list(F.struct("id", "n", "term"))).alias("entries"), F.count("*").cast("int").alias("size"))
    of_langs = of_langs.mapInArrow(_pack, "lang string, segment int, size int, vec binary, terms binary")
    of_langs = langs.select("lang", "v", "lang_total", "blocks", "teams", F.explode(F.expr("sequence(0, segments - 1)")).alias("segment")).join(of_langs, ["lang", "segment"], "left")
    of_langs = written(of_langs.withColumn("size", F.coalesce("size", F.lit(0))), "languages")
    vectors = counts.join(numbered.select("lang", "term", "segment", "id"), ["lang", "term"]).groupBy("lang", "segment", "source").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("entries"))
    vectors = vectors.mapInArrow(_pack, "lang string, segment int, source string, vec binary, terms binary").select("lang", "segment", "source", "vec")
    every = groups.join(of_langs.select("lang", "segment", "size", "v", "blocks", "teams"), "lang").join(vectors, ["lang", "segment", "source"], "left")
    every = written(every.select("lang", "segment", "source", "size", "teams", "blocks", F.expr("total + 2 * v").alias("of"), "vec", F.expr("pmod(xxhash64(source), blocks)").cast("int").alias("block")), "vectors")

    none = F.lit(None).cast("binary").alias("terms")
    at_home = every.select("lang", "segment", F.col("block").alias("host"), F.lit(_RESIDENT).alias("step"), "source", "size", "of", "vec", none)
    rounds = every.select("*", F.explode(F.expr("sequence(0, teams - 2)")).alias("step")).withColumn("host", _partner("block", "step", "teams"))
    # of two blocks the lower one travels if their sum is even, so each of them is host about as often as guest
    guests = rounds.filter("host < blocks and (block < host) = ((block + host) % 2 = 0)").select("lang", "segment", "host", "step", "source", "size", "of", "vec", none)
    languages = of_langs.select("lang", "segment", F.explode(F.expr("sequence(0, blocks - 1)")).alias("host"), F.lit(_LANGUAGE).alias("step"), F.lit("").alias("source"), "size", F.expr("lang_total + 2 * v").alias("of"), "vec", "terms")
    stream = languages.unionByName(at_home).unionByName(guests).repartition("lang", "segment", "host").sortWithinPartitions("lang", "segment", "host", "step", "source")
    met = written(stream.mapInArrow(_meetings, "lang string, source string, part string, item string, value long"), "met")
    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = met.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(by_rank))
    tops = met.filter("part = 'term'").withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= TOP_TERMS)
    return pairs.unionByName(tops)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents")).select("lang", "source", "part", "item", "value", "rank")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT i, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + (1000000000 * (coalesce(c.n, 0)::HUGEINT + 2)) // (s.total + 2 * v.v) AS BIGINT) AS p,
    CAST(1 + (1000000000 * (k.n::HUGEINT + 2)) // (v.total + 2 * v.v) AS BIGINT) AS q
  FROM s JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pairs.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
