"""Quality by the perplexity of an interpolated modified Kneser-Ney bigram model of trusted text.

The vocabulary is the most frequent words of trusted text, up to a bound; other words are the class of their shape.
Counts of trusted text are summed in shards by bigram; joins of the shards with their
contexts' and continuations' statistics give the probabilities. The most frequent bigrams, up to a bound, go to the
scan of all documents, whose texts are therefore not shuffled. The others have their probabilities, too: the scan
gives out what a document has of them, and only that meets their table in a join. A document is
kept if its log perplexity is within its language's quantile over trusted documents that the model was not counted on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, table, written
from .minhash import bit_filter, filter_place

#: Words of the vocabulary, shapes included, and bigrams that the scan holds (8 bytes each, 4 of one seen once, in each
#: Python worker; the others are joined): bounds of memory. A pair of words is a 32-bit number, so the vocabulary is 65,536 at most.
VOCABULARY, BIGRAMS = 65_536, 6_000_000
#: Quantile of trusted documents; width of a bin of the log perplexities in which quantiles are counted; of so many
#: trusted documents one is held out from the counts, for the quantiles.
QUANTILE, BIN, FOLDS = 0.995, 0.002, 5
#: Unit of the joined logs, whose sums are whole numbers and so the same in any order.
GAIN = 1e-9
_PLACES = 1 << 20
#: Trusted documents that a language needs for a quantile of its own: with fewer, that of all
#: languages holds.
LEAST_TRUSTED = 50
SHAPES = ["<edge>", "<lower>", "<Capital>", "<UPPER>", "<mixed>", "<digits>", "<alnum>", "<sign>", "<signs>"]
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


def shape(word: str) -> int:
    if word.isalpha():
        return 1 if word.islower() else 2 if word[0].isupper() and (len(word) == 1 or word[1:].islower()) else 3 if word.isupper() else 4
    if word.isalnum():
        return 5 if word.isdigit() else 6
    return 7 if len(word) == 1 else 8


class Ids(dict):
    """Vocabulary ids, shapes for other words; keeps as many other words as `most`."""

    def __init__(self, words: list[str], most: int = 300_000):
        super().__init__({w: k + len(SHAPES) for k, w in enumerate(words)})
        self.most = most

    def __missing__(self, word: str) -> int:
        value = shape(word)
        if len(self) < self.most:
            self[word] = value
        return value

    def of(self, text: str) -> np.ndarray:
        words = _TOKEN.findall(text)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.update(_TOKEN.findall(text))
            if len(held) > 500_000:
                yield out()
                held.clear()
    if held:
        yield out()


def _bigram_counts(words: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, size = Ids(words), len(SHAPES) + len(words)
        held, n = [], 0
        edge = np.zeros(1, np.int64)

        def out():
            x = np.concatenate([*held, edge])
            at, count = np.unique(x[:-1] * size + x[1:], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32)), pa.array(count)], ["a", "b", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held += [edge, ids.of(text)]
                n += len(held[-1]) + 1
                if n > 4_000_000:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    return run


def _discounts(counts: dict[int, int]) -> list[float]:
    """D1, D2, D3+ of Chen and Goodman from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = (max(counts.get(k, 0), 1) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.1), k + 0.95) for k, d in enumerate(raw)]


def kneser_ney(bigrams: DataFrame, size: int, most: int = BIGRAMS, rest: bool = False):
    """From bigrams(a, b, n): (cells a * size + b and p of the seen bigrams, up to `most`, the most frequent; the weight of each
    context's lower order; the lower order), by count shards that meet their words' statistics (`size` rows, broadcast). The mass of bigrams beyond `most` goes to the lower order. With `rest`
    nothing is cut: a pair of that, with the cells of the bigrams seen once and what such a one has of its own by context (these take half the room and count as half), and of the
    others as written rows (cell, gain), by how many GAIN their logs exceed those of the lower order, or None."""
    bigrams = written(bigrams, "bigrams")
    of_counts = lambda df: {r["n"]: r["k"] for r in df.filter("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
    d = _discounts(of_counts(bigrams))
    least = 2 if rest else 1
    while (above := bigrams.filter(F.col("n") >= least).count()) > most:
        least += 1 if least < 8 else least // 4
    # of a bigram without a probability of its own all is cut
    cut = F.when(F.lit(not rest) & (F.col("n") < least), F.col("n")).when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    contexts = written(bigrams.groupBy("a").agg(F.sum("n").alias("total"), F.sum(cut).alias("freed")), "contexts")
    follows = written(bigrams.groupBy("b").agg(F.count("*").alias("n")), "continuations")
    e = _discounts(of_counts(follows))
    kinds, freed = follows.agg(F.sum("n"), F.sum(F.when(F.col("n") == 1, e[0]).when(F.col("n") == 2, e[1]).otherwise(e[2]))).first()
    kinds, freed = kinds or 1, freed or 1.0
    off = F.when(F.col("n") == 1, e[0]).when(F.col("n") == 2, e[1]).otherwise(e[2])
    lower = follows.select("b", (F.greatest(F.col("n") - off, F.lit(0.0)) / kinds + freed / kinds / size).alias("q"))
    cell, own = (F.col("a").cast("long") * size + F.col("b")).alias("cell"), (F.col("n") - cut + F.col("freed") * F.col("q")) / F.col("total")
    known = lambda df: df.join(F.broadcast(contexts), "a").join(F.broadcast(lower), "b")
    seen = known(bigrams.filter(F.col("n") >= (max(least, 2) if rest else least))).select(cell, own.cast("float").alias("p"))
    # of those seen once as many as the room left holds
    room, ones = 2 * (most - above) if least == 2 else 0, bigrams.filter("n = 1").count() if rest else 0
    share = _PLACES if ones <= room else _PLACES * room // ones
    held = (F.col("n") == 1) & (F.pmod(F.xxhash64("a", "b"), F.lit(_PLACES)) < share)
    once = bigrams.filter(held if rest else F.lit(False)).select((cell - (1 << 31)).cast("int").alias("cell"))
    others = None
    if rest and (least > 2 or share < _PLACES):
        gain = F.log(own) - F.log(F.col("freed") / F.col("total")) - F.log("q")
        others = written(known(bigrams.filter((F.col("n") < least) & ~held)).select(cell, F.round(gain / GAIN).cast("long").alias("gain")), "rest")
    p, c, q, o = seen.toArrow(), contexts.toArrow(), lower.toArrow(), once.toArrow()  # at most `most`, size, size and twice `most` rows
    for df in (bigrams, follows, contexts):
        drop_written(df)
    back = np.ones(size)
    back[c["a"].to_numpy()] = c["freed"].to_numpy() / c["total"].to_numpy()
    base = np.full(size, freed / kinds / size)
    base[q["b"].to_numpy()] = q["q"].to_numpy()
    cells = p["cell"].to_numpy().astype(np.uint32)
    order = np.argsort(cells)
    tables = cells[order], p["p"].to_numpy()[order], back, base
    if not rest:
        return tables
    alone = np.zeros(size)
    alone[c["a"].to_numpy()] = (1 - d[0]) / c["total"].to_numpy()
    return (*tables, np.sort((o["cell"].to_numpy().astype(np.int64) + (1 << 31)).astype(np.uint32)), alone), others


class Model:
    """Logs of the probabilities of pairs of word numbers."""

    def __init__(self, cells: np.ndarray, p: np.ndarray, back: np.ndarray, base: np.ndarray, once: np.ndarray | None = None, alone: np.ndarray | None = None):
        self.cells, self.logs, self.size = cells, np.log(p), len(back)
        self.back, self.base, self.once, self.alone = np.log(back), np.log(base), once, alone

    def log(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        return self.found(before, after)[0]

    def found(self, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logs, and the cells that are in no table and have those of the lower order."""
        out, code = self.back[before] + self.base[after], before * self.size + after
        left = np.arange(len(code))
        if len(self.cells):
            at = np.minimum(np.searchsorted(self.cells, code.astype(np.uint32)), len(self.cells) - 1)
            hit = self.cells[at] == code
            out[hit] = self.logs[at[hit]]
            left = np.flatnonzero(~hit)
        if self.once is not None and len(self.once) and len(left):
            asked = code[left]
            hit = self.once[np.minimum(np.searchsorted(self.once, asked.astype(np.uint32)), len(self.once) - 1)] == asked
            seen = left[hit]
            out[seen] = np.log(self.alone[before[seen]] + np.exp(out[seen]))
            left = left[~hit]
        return out, code[left]


_SCORED = "doc_id long, lang string, place long, logs double, n long, cells array<struct<cell:long,times:long>>"


def _score(words: list[str], sent, bits: np.ndarray | None = None):
    """By row its place, tokens and log probability by the model's table, and the cells that may be among the others (bits over them), with their numbers."""
    kind = pa.list_(pa.struct([("cell", pa.int64()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, model = Ids(words), Model(*sent.value)
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            logs, n, cells = [], [], []
            for text in batch.column(2).to_pylist():
                x = ids.of(text) if text else ()
                n.append(len(x) + 1 if len(x) else None)
                cells.append([])
                if not len(x):
                    logs.append(None)
                    continue
                found, missed = model.found(np.concatenate([[0], x]), np.concatenate([x, [0]]))
                logs.append(float(found.sum()))
                if bits is not None and len(missed):
                    missed, times = np.unique(missed, return_counts=True)
                    at = filter_place(missed, bits)
                    some = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
                    cells[-1] = [{"cell": c, "times": k} for c, k in zip(missed[some].tolist(), times[some].tolist(), strict=True)]
            places = pa.array(np.arange(place, place + len(n)))
            place += len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), places, pa.array(logs, pa.float64()), pa.array(n, pa.int64()), pa.array(cells, kind)], ["doc_id", "lang", "place", "logs", "n", "cells"])

    return run


def _perplexities(scan: DataFrame, rest: DataFrame | None) -> DataFrame:
    """(doc_id, lang, log_perplexity) of _score() rows: what their cells gain among the others is added."""
    if rest is None:
        return scan.select("doc_id", "lang", (-F.col("logs") / F.col("n")).alias("log_perplexity"))
    asked = scan.select("place", F.explode("cells").alias("c")).select("place", "c.cell", "c.times")
    gained = asked.join(rest, "cell").groupBy("place").agg(F.sum(F.col("times") * F.col("gain")).alias("gained"))
    logs = F.col("logs") + F.coalesce("gained", F.lit(0)) * GAIN
    return scan.drop("cells").join(gained, "place", "left").select("doc_id", "lang", (-logs / F.col("n")).alias("log_perplexity"))


def quality(docs: DataFrame, labels: DataFrame, vocabulary: int = VOCABULARY, quantile: float = QUANTILE, most: int = BIGRAMS) -> DataFrame:
    """One row per row of docs(doc_id, text, lang): doc_id, lang, log_perplexity (per token), threshold, kept.

    Trusted text is that of the documents with quality 1 in labels. A null text and one without tokens has
    a null perplexity and is not kept; a null language is one of its own; a language with fewer than
    LEAST_TRUSTED trusted documents that are held out takes the threshold of all; without such everything with tokens is kept.
    `most` bigrams are held by the scan and the others joined; the results are the same. Repeated rows are scored alike; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    trusted = written(labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "trusted")
    bits = bit_filter(trusted, "doc_id")
    size = len(bits) * 8
    maybe = docs.filter("doc_id is not null and text is not null and text != ''").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(size)).alias("at")).mapInArrow(_in_filter(bits), "doc_id long, text string")
    held_out = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(FOLDS)) == 0
    source = written(maybe.join(trusted, "doc_id").filter(~held_out).select("text"), "trusted-text")
    top = source.mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(min(vocabulary, 65_536) - len(SHAPES))
    words = top.toArrow()["word"].to_pylist()
    kinds = len(SHAPES) + len(words)
    bigrams = source.mapInArrow(_bigram_counts(words), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    tables, rest = kneser_ney(bigrams, kinds, most, True)
    sent = docs.sparkSession.sparkContext.broadcast(tables)
    scored = written(docs.mapInArrow(_score(words, sent, None if rest is None else bit_filter(rest, "cell")), _SCORED), "scan")
    if rest is not None:
        scan, scored = scored, written(_perplexities(scored, rest), "scored")
        for df in (scan, rest):
            drop_written(df)
    else:
        scored = _perplexities(scored, None)

    drop_written(source)
    known = scored.filter("log_perplexity is not null").join(trusted, "doc_id").filter(held_out).select(F.coalesce("lang", F.lit("")).alias("l"), F.ceil(F.col("log_perplexity") / BIN).alias("bin"))
    bins = written(known.groupBy("l", "bin").agg(F.count("*").alias("n")), "bins")
    limits = _limits(bins, quantile).filter(F.col("of") >= LEAST_TRUSTED).select("l", "threshold")
    overall = _limits(bins.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("l", F.lit("")), quantile).first()
    overall = overall["threshold"] if overall else float("inf")
    return scored.withColumn("l", F.coalesce("lang", F.lit(""))).join(limits, "l", "left").select(
        "doc_id", "lang", "log_perplexity", F.coalesce("threshold", F.lit(overall)).alias("threshold"), F.coalesce(F.col("log_perplexity") <= F.coalesce("threshold", F.lit(overall)), F.lit(False)).alias("kept")
    )


def _limits(bins: DataFrame, quantile: float) -> DataFrame:
    """By language, the upper edge of the first bin up to which the share is the quantile's."""
    so_far = F.sum("n").over(Window.partitionBy("l").orderBy("bin"))
    of = F.sum("n").over(Window.partitionBy("l"))
    return bins.select("l", "bin", so_far.alias("so_far"), of.alias("of")).filter(F.col("so_far") >= F.col("of") * quantile).groupBy("l").agg((F.min("bin") * BIN).alias("threshold"), F.max("of").alias("of"))


def _in_filter(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            wanted = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            if len(wanted):
                rows = batch.take(pa.array(wanted))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1)], ["doc_id", "text"])

    return run


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
