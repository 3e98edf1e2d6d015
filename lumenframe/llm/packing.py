"""Sequence packing as a cutting-stock problem solved by column generation.

Documents are tokenized once and cut into whole sequences and one rest. The rests' length
histogram (a fixed number of length classes) is the demand of a linear program over
patterns; a knapsack dynamic program prices new patterns with the duals until none
improves. Rounded-down pattern counts plus a first-fit-decreasing tail give every class a list of
slots, and the pieces, ranked within their class, take them. The driver sees the histogram and the
patterns only; both are bounded by the number of classes.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Tokens of a sequence, and of a step of the length classes.
SEQUENCE, STEP = 2048, 8
#: The program is solved to within this share of its optimum (Farley's bound: objective / value of
#: the best pattern).
GAP = 2e-3
#: The id that ends each document.
END_ID = 1
#: Pieces of one class that are ranked together, about.
RANKED_TOGETHER = 5000
TOKENIZER = "byte_bpe_50k"
_SPECIAL = "<|endoftext|>"


class Encoder:
    """Token ids as the tokenizers library gives them for <name>.json, special tokens not added.

    tiktoken with the same vocabulary and pattern gives the same ids several times faster; texts
    that hold the special token's string go to the tokenizers library, which treats it apart."""

    def __init__(self, name: str = TOKENIZER, folder: str | None = None):
        import public_tokenizers
        import tiktoken

        path = (lambda f: f"{folder}/{f}") if folder else public_tokenizers.path
        with open(path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow_path, self.slow = path(f"{name}.json"), None

    def __call__(self, text: str) -> np.ndarray:
        if _SPECIAL not in text:
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.slow_path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def _cut(sequence: int, name: str, folder: str | None, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(name, folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                part = batch.slice(at, 512)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                    for start in range(0, len(ids), sequence):
                        piece = ids[start : start + sequence]
                        rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), *([piece.tolist()] if with_ids else [])))
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.list_(pa.int64())) for c in columns[5:]]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])

    return run


def _knapsack(price: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """By capacity, the value of the most valuable multiset of sizes and its last size's index."""
    value, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        fits = np.searchsorted(sizes, w, "right")
        value[w] = value[w - 1]
        if fits:
            gain = value[w - sizes[:fits]] + price[:fits]
            k = int(gain.argmax())
            if gain[k] > value[w] + 1e-12:
                value[w], took[w] = gain[k], k
    return value, took


def _priced(price: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best pattern's value, and for every size the best pattern that holds it (columns)."""
    value, took = _knapsack(price, sizes, capacity)
    patterns = np.zeros((len(sizes), len(sizes)))
    for k, size in enumerate(sizes):
        patterns[k, k] = 1
        w = capacity - int(size)
        while w > 0:
            if took[w] < 0:
                w -= 1
            else:
                patterns[took[w], k] += 1
                w -= int(sizes[took[w]])
    return float(value[capacity]), np.unique(patterns, axis=1)


def patterns_for(demand: dict[int, int], capacity: int, gap: float = GAP) -> list[tuple[int, dict[int, int]]]:
    """(times, {size: pieces}) whose pieces cover the demand {size: pieces} exactly.

    Revised simplex on the covering program. One knapsack under the duals prices, for every size,
    the best column that holds it; the program is solved over these before the next
    knapsack. The basis inverse is rebuilt now and then against rounding errors."""
    sizes = np.array(sorted(k for k, v in demand.items() if v > 0))
    if not len(sizes):
        return []
    need = np.array([float(demand[s]) for s in sizes])
    need = need + np.linspace(0.37, 0.11, len(sizes)) * 1e-3  # against ties in the ratio test
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.linalg.inv(columns)
    x = np.einsum("ij,j->i", inverse, need)
    pool = _priced(sizes / capacity, sizes, capacity)[1]
    pivots, done = 0, False
    while not done:
        while pivots < 200 * len(sizes) + 200:
            price = inverse.sum(0)
            values = np.einsum("i,ij->j", price, pool)
            best = int(values.argmax())
            if values[best] <= 1 + gap / 4:
                break
            along = np.einsum("ij,j->i", inverse, pool[:, best])
            ratio = np.where(along > 1e-9, x / np.where(along > 1e-9, along, 1), np.inf)
            leaving = int(ratio.argmin())
            columns[:, leaving] = pool[:, best]
            pivots += 1
            if pivots % 200 == 0:
                inverse = np.linalg.inv(columns)
            else:
                row = inverse[leaving] / along[leaving]
                inverse -= np.outer(along, row)
                inverse[leaving] = row
            x = np.maximum(np.einsum("ij,j->i", inverse, need), 0)
        value, new = _priced(np.maximum(inverse.sum(0), 0), sizes, capacity)
        done = value <= 1 + gap or pivots >= 200 * len(sizes) + 200
        keep = pool[:, np.einsum("i,ij->j", price, pool) > 0.97]
        pool = np.unique(np.hstack([keep, new]), axis=1)
    left = {int(s): int(demand[s]) for s in sizes}
    out = []
    for k in np.argsort(-x):
        pattern = {int(s): int(round(c)) for s, c in zip(sizes, columns[:, k], strict=True) if round(c) > 0}
        times = min(int(x[k] + 1e-6), *(left[s] // c for s, c in pattern.items()))
        if times > 0:
            out.append((times, pattern))
            for s, c in pattern.items():
                left[s] -= times * c
    while any(left.values()):  # at most one bin for each basic pattern, about
        room, pattern = capacity, {}
        for s in sorted((s for s in left if left[s]), reverse=True):
            if c := min(left[s], room // s):
                pattern[s] = c
                room -= c * s
        times = min(left[s] // c for s, c in pattern.items())
        out.append((times, pattern))
        for s, c in pattern.items():
            left[s] -= times * c
    return out


def _slots(patterns: list[tuple[int, dict[int, int]]]):
    """By size: where the ranks of a pattern begin, its pieces, its first sequence and the place of
    its first piece among the pattern's pieces."""
    by: dict[int, list[tuple[int, int, int, int]]] = {}
    base, filled = 0, {}
    for times, pattern in patterns:
        place = 0
        for s, c in sorted(pattern.items(), reverse=True):
            by.setdefault(s, []).append((filled.get(s, 0), c, base, place))
            filled[s] = filled.get(s, 0) + times * c
            place += c
        base += times
    return {s: np.array(v, np.int64) for s, v in by.items()}


def _assign(slots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("size", "rank"))
            sequence, place = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                rows = slots[int(s)]
                of = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                within = rank[at] - of[:, 0]
                sequence[at] = of[:, 2] + within // of[:, 1]
                place[at] = of[:, 3] + within % of[:, 1]
            keep = [i for i, c in enumerate(batch.schema.names) if c not in ("size", "rank")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence), pa.array(place)], [*(batch.schema.names[i] for i in keep), "sequence_id", "place"])

    return run


def packed(docs: DataFrame, sequence: int = SEQUENCE, step: int = STEP, tokenizer: str = TOKENIZER, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset; with_ids adds the piece's token ids.

    A null text is an empty one: the end id alone. Repeated rows and null ids are documents of
    their own; other columns are ignored; an empty table gives no rows.
    """
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    pieces = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(sequence, tokenizer, folder, with_ids), fields), "pieces")
    pieces = pieces.withColumn("size", F.ceil(F.col("length") / step).cast("long"))
    histogram = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}
    slots = _slots(patterns_for(histogram, sequence // step))

    parts = 64 + sum(histogram.values()) // RANKED_TOGETHER
    part = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts))
    dealt = pieces.withColumn("part", part)
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("size", "part").agg(F.count("*").alias("n")).select("size", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("size", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        dealt.withColumn("rank", F.row_number().over(within) - 1)
        .join(counts, ["size", "part"])
        .withColumn("rank", (F.col("rank") + F.col("base")).cast("long"))
        .drop("part", "base")
    )
    names = [f.split()[0] for f in fields.split(", ")]
    placed = ranked.select(*names, "size", "rank").mapInArrow(_assign(slots), fields + ", sequence_id long, place long")
    ahead = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long")).drop("place")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)
