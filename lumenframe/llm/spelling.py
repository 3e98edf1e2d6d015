"""Spelling variants: words one edit apart, found by their three rarest positional bigrams.

One edit changes at most two bigrams of a word, so of any three at least one is left in the other word, at
the same place or one further. If both words keep their three rarest (in one order for all words), a bigram that
both keep is among them. Words meet on such a bigram, its place and their lengths, and are verified.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, table, written

#: Bigrams of a word that are looked up: two that one edit may change, and one.
RARE = 3
#: Code points and occurrences that make a word; one in SLIP of the runs loses a code point.
LEAST_LETTERS, LEAST_COUNT, SLIP = 5, 3, 97
#: Different words that a task counts before it hands them on.
HELD_WORDS = 400_000
#: Rounds after which something is wrong: each one doubles the steps followed, and n at least doubles with a step.
MOST_ROUNDS = 10

#: Latin-1 has one byte for each code point of [A-Za-zÀ-ÿ]; everything else separates.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def slipped(run: bytes, of: int) -> bytes:
    """The Latin-1 run, without one code point if 97 divides its crc32; `of` is the crc32 of what stands before it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), of)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[bytes] = Counter()

    def out():
        yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
        total.clear()

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            of = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            runs = Counter((text.as_py() or "").encode("latin-1", "replace").translate(_LETTERS).split())
            for run, n in runs.items():
                if len(run) >= LEAST_LETTERS:
                    word = slipped(run, of)
                    if len(word) >= LEAST_LETTERS:
                        total[word] += n
            if len(total) > HELD_WORDS:
                yield from out()
    yield from out()


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of docs(doc_id, text): the slipped runs of at least 5 code points with at least 3 occurrences."""
    return docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _bigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()
    for batch in batches:
        for w in batch.column(0).to_pylist():
            seen.update([w[i : i + 2] for i in range(len(w) - 1)])
    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["bigram", "n"])


def rarest(word: str, rank: dict[str, int]) -> list[tuple[int, int]]:
    """(rank, place) of the three rarest bigrams of a word, of a bigram that it has more often only the first and the last place.

    What stands before the edit and what stands behind it is equal in both words. So if a bigram is left at some place before the
    edit, its first places are equal; if behind it, its last places are, counted from the end.
    """
    grams = sorted((rank[word[i : i + 2]], i) for i in range(len(word) - 1))
    grams = [g for g in grams if g[0] <= grams[RARE - 1][0]]
    return [g for k, g in enumerate(grams) if k in (0, len(grams) - 1) or grams[k - 1][0] != g[0] or grams[k + 1][0] != g[0]]


def _entries(rank: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                letters = 0
                for c in w:
                    letters |= 1 << (ord(c) & 63)
                letters -= (letters >> 63) << 64
                out += [(w, n, letters, len(w), gram, place) for gram, place in rarest(w, rank)]
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()], strict=True)], ["word", "n", "letters", "length", "gram", "place"])

    return run


def near_pairs(known: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) once for each two words of known(word, n), all different, that one inserted, deleted or replaced code point apart.

    Both words have at least 5 code points. The order of the bigrams is a table of at most 90 x 90 rows, as runs have 90 letters.
    """
    bigrams = known.select("word").mapInArrow(_bigram_counts, "bigram string, n long").groupBy("bigram").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    rank = {g["bigram"]: k for k, g in enumerate(sorted(bigrams, key=lambda g: (g["n"], g["bigram"])))}
    entries = known.select("word", "n").mapInArrow(_entries(rank), "word string, n long, letters long, length int, gram int, place int")
    # words of one length share the bigram's place; in a word that is longer by one it stands there or one further
    meets = F.explode(F.array(*[F.struct((F.col("place") + p).alias("place"), (F.col("length") + more).alias("length"), F.lit(more).alias("more")) for p, more in ((0, 0), (0, 1), (1, 1))]))
    a = entries.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("letters").alias("letters_a"), "gram", meets.alias("at")).select("a", "n_a", "letters_a", "gram", "at.*")
    b = entries.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("letters").alias("letters_b"), "gram", "place", "length")
    few = F.bit_count(F.col("letters_a").bitwiseXOR(F.col("letters_b"))) <= 2
    once = (F.col("more") == 1) | (F.col("a") < F.col("b"))
    keys = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ("gram", "place", "length")]
    met = a.alias("x").join(b.alias("y"), [*keys, few & once & (F.levenshtein("a", "b", 1) == 1)])
    return met.select("a", "n_a", "b", "n_b").distinct()


def variants(known: DataFrame) -> DataFrame:
    """One row per row of known(word, n), words all different: word, n, n_near, form, form_n, root.

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that n is at least twice
    its own; its root is the last of the forms followed from it, itself without one. No words give no rows.
    """
    pairs = near_pairs(known)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("m")))).alias("e")).select("e.*")
    best = both.groupBy("word").agg(F.first("n").alias("own"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    formed = -F.col("best.less") >= 2 * F.col("own")
    near = written(best.select("word", "n_near", F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")), "near")
    return known.select("word", "n").join(near, "word", "left").join(roots(near), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows of forms(word, form) with a form: where following the forms ends. Steps double each round."""
    open_ = written(forms.filter("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    for _ in range(MOST_ROUNDS):
        if open_.filter("moved").isEmpty():
            return open_.select("word", "root")
        on = open_.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(open_.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop_written(open_)
        open_ = after
    raise RuntimeError("forms did not settle")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """variants() of the words of docs(doc_id, text): word, n, n_near, form, form_n, root.

    Null texts have no runs; a null doc_id stands as nothing before the colon. Repeated rows count again, other
    columns are ignored, an empty table gives no rows.
    """
    return variants(written(words(docs), "words"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
