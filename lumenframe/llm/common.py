"""What the corpus operators share: the shared folder, written tables, word shingles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a shingle, unless an operator's caller says otherwise.
SHINGLE_WORDS = 5

#: Ids up to which a table of them is broadcast (about 64 bytes each, as Spark holds it).
BROADCAST_IDS = 2_000_000

#: Rows of a batch for Python tasks that get texts, tokens or lists of windows.
TEXT_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the
    session. A temporary one is made only where the setting is absent and Spark runs in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="corpus-")
    return _own_dirs[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corpus-tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: cuts the lineage and
    outlives lost executors. Python tasks get at most `rows` rows at a time, where these are long: Spark holds a task's
    batch as vectors and as bytes, both in buffers that double, and Python holds it and the next one."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_BATCH)
    if rows:
        spark.conf.set(_BATCH, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if rows:
            spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_written(df: DataFrame) -> None:
    """Removes the files of a written() table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/corpus-tables/" in path:
            drop_path(df.sparkSession, path)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not in gone(doc_id); those without doc_id stay. Up to BROADCAST_IDS ids go to
    the scan, beyond it texts and ids meet in a shuffle."""
    gone = written(gone.filter("doc_id is not null").distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a block of text whose words are hashed at once; words longer than LONG_WORD are hashed one by one.
_BLOCK, LONG_WORD = 1 << 15, 256
_rng = np.random.default_rng(8)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_P = 0x9E3779B97F4A7C15
_POWERS = np.full(_BLOCK + LONG_WORD + 1, _P, np.uint64)
_INVERSES = np.full(_BLOCK + LONG_WORD + 1, pow(_P, -1, 1 << 64), np.uint64)
for _x in (_POWERS, _INVERSES):
    _x[0] = 1
    np.cumprod(_x, out=_x)


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and where each text's begin (and the
    last one's end). Words are runs without the six ASCII blanks, A-Z as a-z. A word's hash is the sum of a random value
    of each byte times a power of its place in the word."""
    raw = b" ".join([t or b"" for t in texts] + [b""])
    b = np.frombuffer(raw, np.uint8)
    blank = np.ones(len(b) + 2, bool)
    blank[1:-1] = (b == 32) | (b - np.uint8(9) < 5)
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    begin, end = edges[::2], edges[1::2]
    out = np.empty(len(begin), np.uint64)
    cuts = np.unique(np.searchsorted(begin, np.arange(0, len(b) + _BLOCK, _BLOCK)))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        at = begin[i]
        part = b[at : min(end[j - 1], at + len(_POWERS) - 1)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE.take(part) * _POWERS[: len(part)], out=sums[1:])
        x, y = begin[i:j] - at, np.minimum(end[i:j] - at, len(part))
        out[i:j] = (sums[y] - sums[x]) * _INVERSES[x] + (y - x).astype(np.uint64)
    for k in np.flatnonzero(end - begin > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(raw[begin[k] : end[k]].lower())
    places = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    return mixed(out), np.searchsorted(begin, places)


def texts_shingles(texts: list[bytes | None], n: int = SHINGLE_WORDS, whole: bool = True) -> Iterator[np.ndarray]:
    """For each text the hashes of its word shingles by position; of the whole sequence where it is shorter
    and `whole` is asked for; none where there are no words."""
    words, places = word_hashes(texts)
    runs = shingle_hashes(words, n) if len(words) >= n else words
    for a, b in zip(places[:-1], places[1:], strict=True):
        if b - a >= n:
            yield runs[a : b - n + 1]
        else:
            yield shingle_hashes(words[a:b], n) if whole else words[:0]


def text_blocks(texts: list[bytes | None], most: int = 1_000_000) -> Iterator[slice]:
    """Slices of texts of about `most` bytes together, or of one text."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or b"")
        if size > most:
            yield slice(at, k + 1)
            at, size = k + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def shingle_hashes(words: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of all runs of n words, by position; of the whole sequence where it is
    shorter; none where there are no words."""
    if not len(words):
        return words
    n = min(n, len(words))
    total = words[: len(words) - n + 1] * _MULTIPLIERS[0]
    for k in range(1, n):
        total = total + words[k : len(words) - n + 1 + k] * _MULTIPLIERS[k % 8]
    return mixed(total + np.uint64(n))
