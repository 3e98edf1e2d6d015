"""URL filters by a Bloom filter cascade.

Rules are keys (host, path start). Every url has the keys of its host's suffixes and its path's starts
of the lengths that rules have; the corpus's distinct keys are the complete universe of what can ever be
asked. Level 1 of the cascade encodes the listed keys, level 2 the universe's false positives of
level 1, level 3 the listed keys that level 2 takes for those, and so on until a level has none
left. A key of the universe is listed just if the first level that lacks it is an even one, so membership is exact and needs
no join. The levels are literals whose size follows the list, not the corpus. DataFrame functions only.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: False positive rate of level 1, and of the levels after it.
FIRST_RATE, RATE = 0.01, 0.3
#: Listed keys of one cascade: a longer list is split by hash over more of them.
MOST_KEYS = 4_000_000
#: Levels after which something is wrong: each one holds about RATE of the one before the last.
MOST_LEVELS = 64
ALLOW, BLOCK = "allow", "block"

RULES = [
    (ALLOW, "org", "/"),
    (BLOCK, "example.org", "/es/"),
    (BLOCK, "example.org", "/en/1"),
    (ALLOW, "com", "/fr/"),
    (BLOCK, "com", "/de/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased; empty without ://."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")), F.lit(""))
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys of a url, longest first by host labels and path length: host suffix + path start."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    starts = F.filter(F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths]), lambda s: s.isNotNull())
    # no host: no key
    return F.when(host != "", F.flatten(F.transform(suffixes, lambda h: F.transform(starts, lambda p: F.concat(h, p))))).otherwise(F.array().cast("array<string>"))


class Level:
    """A Bloom filter in 64-bit words: k hashed positions of m bits."""

    def __init__(self, keys: DataFrame, count: int, rate: float, level: int):
        bits = max(64, math.ceil(-count * math.log(rate) / math.log(2) ** 2))
        self.words = -(-bits // 64)
        self.hashes, self.level = max(1, round(-math.log2(rate))), level
        at = F.explode(F.array(*self._positions(F.col("key"))))
        rows = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toArrow()
        values = np.zeros(self.words, np.int64)
        values[rows["word"].to_numpy()] = rows["bits"].to_numpy()
        self.literal = F.array(*[F.lit(x).cast("bigint") for x in values.tolist()]) if self.words <= 64 else F.from_json(F.lit(str(values.tolist())), "array<bigint>")

    def _positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.level), F.lit(k), key), F.lit(self.words * 64)) for k in range(self.hashes)]

    def has(self, key: Column) -> Column:
        test = None
        for at in self._positions(key):
            word = F.element_at(self.literal, F.floor(at / 64).cast("int") + 1)
            bit = F.call_function("getbit", word, (at % 64).cast("int")) == 1
            test = bit if test is None else test & bit
        return test


class Cascade:
    """Exact membership in `listed` for every key of `universe`, both (key)."""

    def __init__(self, universe: DataFrame, listed: DataFrame, most_keys: int = MOST_KEYS):
        listed = written(listed.distinct(), "listed")
        self.parts = max(1, math.ceil(listed.count() / most_keys))
        self.levels: list[list[Level]] = []
        for part in range(self.parts):
            here = self._part(F.col("key")) == part
            # of the listed keys, those that the universe lacks are never asked for
            self.levels.append(self._built(listed.filter(here), universe.filter(here).join(listed, "key", "left_anti")))

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(self.parts)) if self.parts > 1 else F.lit(0)

    def _built(self, inside: DataFrame, outside: DataFrame) -> list[Level]:
        levels: list[Level] = []
        rate = FIRST_RATE
        while count := inside.count():
            if len(levels) == MOST_LEVELS:
                raise RuntimeError("the cascade did not settle")
            level = Level(inside, count, rate, len(levels) + 1)
            levels.append(level)
            inside, outside, rate = written(outside.filter(level.has(F.col("key"))), "false-positives"), inside, RATE
        return levels

    def has(self, key: Column) -> Column:
        """Levels from the last to the first: in this one, and not in the exceptions after it."""
        out = F.lit(False)
        for part, levels in enumerate(self.levels):
            answer = F.lit(False)
            for level in reversed(levels):
                answer = level.has(key) & ~answer
            out = answer if self.parts == 1 else F.when(self._part(key) == part, answer).otherwise(out)
        return out


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = ALLOW) -> DataFrame:
    """One row per row of pages(page_id, url): page_id, host, path, rule, verdict.

    rules are (verdict, host, path start). A rule fits its host and all subdomains; the longest key
    wins, a block before an allow of the same key. Where none fits the key set has no listed key: rule is
    null and the verdict the default's. Null urls and those without :// have an empty host and path and
    fit no rule; repeated rows are judged alike; other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    parts = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    lengths = sorted({len(p) for _, _, p in rules})
    keyed = parts.withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths))
    universe = written(keyed.select(F.explode("keys").alias("key")).distinct(), "universe")
    cascades = {}
    for verdict in (BLOCK, ALLOW):
        listed = [(h.translate(str.maketrans(_UPPER, _LOWER)) + p,) for v, h, p in rules if v == verdict]
        cascades[verdict] = Cascade(universe, spark.createDataFrame(listed, "key string"))
    is_block, is_allow = cascades[BLOCK].has, cascades[ALLOW].has
    found = F.filter("keys", lambda k: is_block(k) | is_allow(k))
    longest = F.array_max(F.transform(found, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]
    return keyed.withColumn("rule", longest).select(
        "page_id", "host", "path", "rule", F.when(F.col("rule").isNull(), F.lit(default)).when(is_block(F.col("rule")), F.lit(BLOCK)).otherwise(F.lit(ALLOW)).alias("verdict")
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), RULES)


ORACLE_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN url IS NOT NULL AND position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, h, s) AS (VALUES {", ".join(str(r) for r in RULES)}),
f AS (SELECT p.*, r.h || r.s AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY len(r.h || r.s) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.s))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1
"""
