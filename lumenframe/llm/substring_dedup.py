"""Near-duplicate passages by compact windows.

A text's tokens are its word shingles. Under each of K hashes a compact window (l, c, r) stands for all runs of at least T
tokens within l..r that hold c: the hash of c is the smallest of l..r, so all of them share that minimum. The
windows are the nodes of the Cartesian tree over the hashes that are at least T wide, and there are
about 2n / T of them. Passages of two documents that are alike have windows with equal minima under most
hashes; where the intervals of enough hashes overlap on both sides, the two ranges are compared shingle
by shingle and cut to what reaches the similarity.

Windows whose minimum is in the corpus once are dropped before anything but their keys is shuffled. In a
first round each minimum's windows meet its first and its last document's, not each other, so a passage in n
documents costs 2n pairs. Different hashes may send a document to different strangers that way. So in a second round
the ranges that no reported passage explains meet the first document that has the same minima under two, four and
all hashes on one range: a line or phrase that strangers have seldom gives all of them, and what is equal is
equal to the first as well, so the pairs stay in proportion to the windows. Strangers may hold a piece of a passage that is
too short to be one, but has all of its minima. So each run of a passage's length in those ranges also meets the first document that
has this very run: a hash of all of its tokens, which only true holders share. No exact repeat is lost to strangers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, SHINGLE_WORDS, TEXT_ROWS, drop_written, mixed, table, text_blocks, texts_shingles, written
from .minhash import bit_filter, filter_place

#: Words of a passage, at least; hashes; hashes that must agree; similarity of two passages. At
#: similarity 0.8, fewer than 2 of 8 minima agree with a chance of 8.5e-5.
LEAST_WORDS, HASHES, AGREE, SIMILARITY = 50, 8, 2, 0.8
#: Tokens by which the other side's range is widened before the comparison.
ROOM = 24
#: Tokens by which the range on which hashes agree may be shorter than a passage: an inserted or missing
#: token shifts the windows on either side of it against each other.
SLACK = 12
_CHUNK = 300_000

_rng = np.random.default_rng(61)
_A = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, 64, dtype=np.uint64)


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        values = best(values[:-done], values[done:])
        done *= 2
    return best(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def _before(values: np.ndarray, inner: np.ndarray, strict: bool) -> np.ndarray:
    """For each place, the nearest place before it with a smaller (or, not strict, no larger) value."""
    at = np.arange(len(values)) - 1
    active = inner
    while len(active):
        j = at[active]
        bad = values[j] >= values[active] if strict else values[j] > values[active]
        active, j = active[bad], j[bad]
        at[active] = at[j]
    return at


def compact_windows(tokens: list[np.ndarray], least: int, hashes: int) -> tuple[np.ndarray, ...]:
    """(minimum, document, hash, l, c, r) of all compact windows of at least `least` tokens."""
    use = [k for k, t in enumerate(tokens) if len(t) >= least]
    none = np.empty(0, np.int64)
    if not use:
        return none, none, none, none, none, none
    edge = np.zeros(1, np.uint64)
    joined = np.concatenate([x for k in use for x in (edge, tokens[k])] + [edge])
    begins = np.cumsum([0, *(len(tokens[k]) + 1 for k in use)])
    is_edge = np.zeros(len(joined), bool)
    is_edge[begins] = True
    out = []
    for h in range(hashes):
        v = mixed(joined * _A[h] + _B[h]) | np.uint64(1)
        v[is_edge] = 0
        lows = _sliding(v, least, np.minimum)
        pad = np.zeros(least - 1, np.uint64)
        centre = np.flatnonzero((_sliding(np.concatenate([pad, lows, pad]), least, np.maximum) == v) | is_edge)
        c = v[centre]
        inner = np.flatnonzero(c > 0)
        left = _before(c, inner, True)
        same = _before(c, inner, False)
        # from the right: the same on the mirror image
        right = len(c) - 1 - _before(c[::-1], len(c) - 1 - inner[::-1], True)[::-1]
        keep = inner[c[same[inner]] != c[inner]]  # of equal minima of one range, the first
        doc = np.searchsorted(begins, centre[keep], "right") - 1
        base = begins[doc] + 1
        l, r = centre[left[keep]] + 1, centre[right[keep]] - 1
        wide = r - l + 1 >= least
        out.append((c[keep].view(np.int64)[wide], doc[wide], np.full(int(wide.sum()), h), (l - base)[wide], (centre[keep] - base)[wide], (r - base)[wide]))
    key, doc, h, l, c, r = (np.concatenate(x) for x in zip(*out, strict=True))
    return key, np.array(use)[doc], h, l, c, r


def _chunks(batches: Iterator[pa.RecordBatch], n: int):
    """(ids, tokens) of a bounded number of tokens, or of one text."""
    ids, tokens, size = [], [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            own, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for at in text_blocks(texts):
                for i, found in zip(own[at], texts_shingles(texts[at], n, whole=False), strict=True):
                    ids.append(i)
                    tokens.append(found)
                    size += len(found)
                    if size > _CHUNK:
                        yield ids, tokens
                        ids, tokens, size = [], [], 0
    if ids:
        yield ids, tokens


def _keys(least: int, hashes: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            key, count = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.minimum(count, 2))], ["key", "n"])

        for _, tokens in _chunks(batches, n):
            held.append(compact_windows(tokens, least, hashes)[0])
            size += len(held[-1])
            if size > 500_000:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return run


def _windows(least: int, hashes: int, n: int, bits: np.ndarray):
    """A row for each document, with the windows whose minimum may be in the corpus more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens in _chunks(batches, n):
            key, doc, h, l, c, r = compact_windows(tokens, least, hashes)
            at = filter_place(key, bits)
            keep = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            keep = keep[np.argsort(doc[keep], kind="stable")]
            docs, begin = np.unique(doc[keep], return_index=True)
            offsets = pa.array(np.append(begin, len(keep)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (key[keep], *(x[keep].astype(np.int32) for x in (h, l, c, r)))]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[docs]), *lists], ["doc", "key", "h", "l", "c", "r"])

    return run


def _ranges(least: int, agree: int):
    """From the collisions of a pair of documents, the ranges on which enough hashes agree."""

    def of(rows: np.ndarray) -> list[tuple]:
        # each collision, cut to what both windows cover when their centres are put together
        x, y = rows[0, 0], rows[0, 1]
        h, lx, cx, rx, ly, cy, ry = rows[:, 2:].T
        shift = cy - cx
        begin, end = np.maximum(lx, ly - shift), np.minimum(rx, ry - shift)
        events = []
        for k in np.unique(h):
            at = np.flatnonzero(h == k)
            at = at[np.argsort(begin[at], kind="stable")]
            s, e = int(begin[at[0]]), int(end[at[0]])
            for i in at[1:]:
                if begin[i] <= e + 1:
                    e = max(e, int(end[i]))
                else:
                    events += [(s, 1), (e + 1, -1)]
                    s, e = int(begin[i]), int(end[i])
            events += [(s, 1), (e + 1, -1)]
        events.sort()
        out, depth, start = [], 0, None
        for k, (at, step) in enumerate(events):
            depth += step
            if k + 1 < len(events) and events[k + 1][0] == at:
                continue
            if depth >= agree and start is None:
                start = at
            elif depth < agree and start is not None:
                if at - start >= least - SLACK:
                    inside = (cx >= start) & (cx < at)
                    shifts = shift[inside] if inside.any() else shift
                    out.append((x, y, start, at, max(0, start + int(shifts.min()) - ROOM), at + int(shifts.max()) + ROOM))
                start = None
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((0, 9), np.int64)

        def out(rows: np.ndarray):
            cut = np.concatenate([[0], np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1, [len(rows)]])
            found = []
            for k in np.flatnonzero(np.diff(cut) >= agree):
                found += of(rows[cut[k] : cut[k + 1]])
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 6)], ["x", "y", "a", "b", "ya", "yb"])

        for batch in batches:
            rows = np.concatenate([rest, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], 1)])
            if not len(rows):
                continue
            last = np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 1] != rows[-1, 1]))
            done = int(last[-1]) + 1 if len(last) else 0
            if done:
                yield out(rows[:done])
            rest = rows[done:]
        if len(rest):
            yield out(rest)

    return run


def alike(x: np.ndarray, y: np.ndarray, least: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Ranges of x (begin, end) and of y that begin and end with common tokens, hold at least
    `least` tokens each and have the Jaccard similarity; cut at the widest gaps where they have not."""
    if least <= len(x) <= len(y):  # a copy as it stands is most of what there is
        raw, at = y.tobytes(), -1
        while (at := raw.find(x.tobytes(), at + 1)) >= 0:
            if at % y.itemsize == 0:
                c = at // y.itemsize
                return [(0, len(x), c, c + len(x), 1.0)]
    kinds, code = np.unique(np.concatenate([x, y]), return_inverse=True)
    code_x, code_y = code[: len(x)], code[len(x) :]

    def among(codes: np.ndarray) -> np.ndarray:
        there = np.zeros(len(kinds), bool)
        there[codes] = True
        return there

    out = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        in_y = np.flatnonzero(among(code_y[c:d])[code_x[a:b]])
        if not len(in_y):
            continue
        a, b = a + int(in_y[0]), a + int(in_y[-1]) + 1
        if b - a < least:
            continue
        of_x = among(code_x[a:b])
        in_x = np.flatnonzero(of_x[code_y[c:d]])
        c, d = c + int(in_x[0]), c + int(in_x[-1]) + 1
        if d - c < least:
            continue
        of_y = among(code_y[c:d])
        both = int((of_x & of_y).sum())
        j = both / int((of_x | of_y).sum())
        if j >= similarity:
            out.append((a, b, c, d, j))
            continue
        gap_x, gap_y = np.diff(in_y), np.diff(in_x)
        wide_x, wide_y = int(gap_x.max(initial=0)), int(gap_y.max(initial=0))
        if max(wide_x, wide_y) <= 1:
            continue
        if wide_x >= wide_y:
            cut = a + int(in_y[gap_x.argmax()]) - int(in_y[0]) + 1
            todo += [(a, cut, c, d), (cut, b, c, d)]
        else:
            cut = c + int(in_x[gap_y.argmax()]) - int(in_x[0]) + 1
            todo += [(a, b, c, cut), (a, b, cut, d)]
    return out


def _verify(least: int, similarity: float, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y, a, b, wide, ya, tx, ty in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tx, ty = np.frombuffer(tx, np.uint32), np.frombuffer(ty, np.uint32)
                at, hits = a, alike(tx[a - wide : b - wide], ty, least, similarity)
                if not hits:
                    at, hits = wide, alike(tx, ty, least, similarity)
                for begin, e, c, d, j in hits:
                    if j == 1.0 and e - begin == d - c:  # equal tokens beside an equal range belong to it
                        lo, hi = at + begin - wide, at + e - wide
                        while lo and c and tx[lo - 1] == ty[c - 1]:
                            lo, c, begin = lo - 1, c - 1, begin - 1
                        while hi < len(tx) and d < len(ty) and tx[hi] == ty[d]:
                            hi, d, e = hi + 1, d + 1, e + 1
                    found.append((x, at + begin, at + e + n - 1, y, ya + c, ya + d + n - 1, j))
            columns = zip(*found, strict=True) if found else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.float64() if k == 6 else pa.int64()) for k, c in enumerate(columns)], ["doc_id", "start_word", "end_word", "source_doc_id", "source_start", "source_end", "similarity"])

    return run


def _short_tokens(n: int, bits: np.ndarray):
    """Texts' tokens as 32-bit hashes, 4 bytes each, of the documents that the filter has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            wanted = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            for k in range(0, len(wanted), 256):
                rows = batch.take(pa.array(wanted[k : k + 256]))
                texts = rows.column(1).to_pylist()
                data = [(t >> np.uint64(32)).astype(np.uint32).tobytes() for at in text_blocks(texts) for t in texts_shingles(texts[at], n, whole=False)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(data, pa.binary())], ["doc", "t"])

    return run


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, hashes: int = HASHES, agree: int = AGREE, similarity: float = SIMILARITY, n: int = SHINGLE_WORDS) -> DataFrame:
    """One row per passage of a document that is like one of a document with a smaller doc_id: doc_id,
    start_word, end_word (exclusive), source_doc_id, source_start, source_end, similarity.

    Words are as in MinHash near-dedup. Null texts and those of fewer than least_words words have no
    passages; rows that repeat a doc_id are no sources of each other; null doc_ids are left out; other
    columns are ignored; an empty table gives no rows. A passage that is in many documents is
    reported for each against the first (and the last) of those that share its window minima, or, where those
    are no sources of it, against the first that shares several of them on one range and the first that has the same run of words.
    """
    least = least_words - n + 1
    source = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("binary").alias("text"))
    frequent = written(source.mapInArrow(_keys(least, hashes, n), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key"), "frequent", TEXT_ROWS)
    packed = written(source.mapInArrow(_windows(least, hashes, n, bit_filter(frequent, "key")), "doc long, key array<long>, h array<int>, l array<int>, c array<int>, r array<int>"), "windows", TEXT_ROWS)
    windows = packed.select("doc", F.inline(F.arrays_zip("key", "h", "l", "c", "r")))
    place = F.struct("doc", "l", "c", "r")
    ends = written(windows.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first.doc != last.doc"), "ends")
    own = F.struct("doc", "l", "c", "r")
    hub = F.explode(F.array(F.when(F.col("doc") != F.col("first.doc"), F.col("first")), F.when((F.col("doc") != F.col("first.doc")) & (F.col("doc") != F.col("last.doc")), F.col("last"))))
    met = windows.join(ends, "key").select("h", own.alias("own"), hub.alias("hub")).filter("hub is not null")
    later = F.col("own.doc") > F.col("hub.doc")
    pairs = met.select("h", F.when(later, F.col("own")).otherwise(F.col("hub")).alias("x"), F.when(later, F.col("hub")).otherwise(F.col("own")).alias("y")).select(
        F.col("x.doc").alias("x"), F.col("y.doc").alias("y"), "h", "x.l", "x.c", "x.r", F.col("y.l").alias("yl"), F.col("y.c").alias("yc"), F.col("y.r").alias("yr")
    )
    first = _compared(source, pairs, least, agree, similarity, n)
    # two minima or more make a code, so one code is enough
    asked, answers = _unexplained(packed, first, least, hashes, n)
    answer = answers.groupBy("code").agg(F.min(place).alias("first"))
    others = written(asked.join(answer, "code").filter("doc != first.doc"), "others")  # read twice
    met = others.select(F.col("doc").alias("x"), F.col("first.doc").alias("y"), "h", "l", "c", "r", F.col("first.l").alias("yl"), F.col("first.c").alias("yc"), F.col("first.r").alias("yr"))
    # of a code that only its first document asks for, that one is the first holder of its runs as well
    whole = len(_bands(hashes)) - 1
    needed = written(others.filter(F.col("h") == whole).select("code").distinct(), "needed")
    if needed.count() <= BROADCAST_IDS:
        needed = F.broadcast(needed)
    runs = _runs(source, *(df.filter(F.col("h") == whole).join(needed, "code", "left_semi") for df in (asked, answers)), least, n)
    answer = runs.groupBy("code").agg(F.min(F.struct("doc", "at")).alias("first"))
    last = least - 1
    equal = runs.filter("open").join(answer, "code").filter("doc != first.doc").select(F.col("doc").alias("x"), F.col("first.doc").alias("y"), F.lit(len(_bands(hashes))).alias("h"), F.col("at").alias("l"), F.col("at").alias("c"), (F.col("at") + last).alias("r"), F.col("first.at").alias("yl"), F.col("first.at").alias("yc"), (F.col("first.at") + last).alias("yr"))
    second = _compared(source, met.unionByName(equal), least, 1, similarity, n)
    for df in (frequent, packed, ends, asked, answers, others, runs):
        drop_written(df)
    return first.union(second)


_RANGES = "code long, doc long, h int, l int, c int, r int, s int, e int"


def _unexplained(packed: DataFrame, found: DataFrame, least: int, hashes: int, n: int) -> tuple[DataFrame, DataFrame]:
    """For each band of hashes the ranges, by the code of their minima, that the passages of found do not explain, and all ranges
    with those codes (and few others). A passage with `least` tokens outside of found has such a range. The documents' windows stay where
    they are: the passages' places go to them, up to a quarter of BROADCAST_IDS passages."""
    spans = found.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    spans = written(spans.select("doc", F.col("spans.start_word").alias("begin"), (F.col("spans.end_word")).alias("end")), "spans")
    few = found.count() <= BROADCAST_IDS // 4
    rows = packed.join(F.broadcast(spans) if few else spans, "doc", "left").select("doc", "key", "h", "l", "c", "r", "begin", "end")
    asked = written(rows.mapInArrow(_shared_ranges(least, _bands(hashes), n), _RANGES), "asked", TEXT_ROWS)
    drop_written(spans)
    bits = bit_filter(asked, "code")  # of repeated codes too: to find them would shuffle all codes twice
    nothing = F.lit(None).cast("array<long>")
    answers = packed.select("doc", "key", "h", "l", "c", "r", nothing.alias("begin"), nothing.alias("end")).mapInArrow(_shared_ranges(least, _bands(hashes), n, bits), _RANGES)
    return asked, written(answers, "answers", TEXT_ROWS)


def _runs(source: DataFrame, asked: DataFrame, answers: DataFrame, least: int, n: int) -> DataFrame:
    """(code, doc, at, open): hashes of the runs of `least` tokens in the ranges given, by where they begin; `open` are those that no
    reported passage explains. Only the documents of such ranges are read again."""
    of = lambda df, is_open: df.select("doc", "s", "e", F.lit(is_open).alias("open"))
    ranges = of(asked, True).union(of(answers, False)).groupBy("doc").agg(F.collect_set(F.struct("s", "e", "open")).alias("ranges"))
    ranges = written(ranges.select("doc", F.col("ranges.s").alias("s"), F.col("ranges.e").alias("e"), F.col("ranges.open").alias("open")), "open-ranges")
    bits = bit_filter(ranges.select("doc"), "doc")
    tokens = source.select("doc", "text", F.pmod(F.xxhash64("doc"), F.lit(len(bits) * 8)).alias("at")).mapInArrow(_short_tokens(n, bits), "doc long, t binary")
    runs = written(tokens.join(ranges, "doc").mapInArrow(_run_codes(least), "code long, doc long, at int, open boolean"), "runs", TEXT_ROWS)
    drop_written(ranges)
    return runs


def _run_codes(least: int):
    """A hash of each run: the sum of its tokens' hashes times powers of an odd number, by prefix sums."""
    base = 0x9E3779B97F4A7C15

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up = down = np.ones(1, np.uint64)
        for batch in batches:
            found = [[], [], [], []]
            for doc, t, first, last, is_open in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = mixed(np.frombuffer(t, np.uint32).astype(np.uint64) + np.uint64(1))
                if len(t) >= len(up):
                    up, down = (np.full(2 * len(t), b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
                    up[0] = down[0] = 1
                    np.cumprod(up, out=up)
                    np.cumprod(down, out=down)
                sums = np.zeros(len(t) + 1, np.uint64)
                np.cumsum(t * up[: len(t)], out=sums[1:])
                wanted, starts = np.zeros(len(t) + 1, np.int8), np.zeros(len(t) + 2, np.int64)
                for level, some in ((1, zip(first, last, strict=True)), (2, [(a, b) for a, b, o in zip(first, last, is_open, strict=True) if o])):
                    starts[:] = 0
                    for a, b in some:
                        b = min(b, len(t) - least) + 1
                        if a < b:
                            starts[a] += 1
                            starts[b] -= 1
                    wanted[np.cumsum(starts)[:-1] > 0] = level
                at = np.flatnonzero(wanted)
                found[0].append(mixed((sums[at + least] - sums[at]) * down[at]).view(np.int64))
                found[1].append(np.full(len(at), doc, np.int64))
                found[2].append(at.astype(np.int32))
                found[3].append(wanted[at] == 2)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], ["code", "doc", "at", "open"])

    return run


def _bands(hashes: int) -> list[list[int]]:
    """Neighbouring pairs and fours of the hashes, and all of them."""
    of = lambda size: [list(range(k, k + size)) for k in range(0, hashes - size + 1, size)]
    return of(2) + of(4) + ([list(range(hashes))] if hashes > 4 else [])


def _shared_ranges(least: int, bands: list[list[int]], n: int, bits: np.ndarray | None = None):
    """From documents' windows, for each band the ranges in which every run of `least` tokens has the same minima
    under the band's hashes: a code of those minima, the windows' common range, the first hash's centre, and where the first and the last of the runs begin. Without
    bits, those with a centre outside of the passages that begin and end with the words given; with bits, those whose code they have."""

    def flat(batch: pa.RecordBatch, names: str) -> tuple[np.ndarray, list[np.ndarray]]:
        lists = [batch.column(batch.schema.get_field_index(k)) for k in names.split()]
        size = np.diff(lists[0].offsets.to_numpy()) if lists[0].null_count == 0 else lists[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return np.repeat(np.arange(len(size)), size), [x.flatten().to_numpy().astype(np.int64) for x in lists]

    def of(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        number, (key, h, l, c, r) = flat(batch, "key h l c r")
        if not len(key):
            return
        doc = batch.column(0).to_numpy()
        step = int(r.max()) + 2
        base = number * step
        known = None
        if bits is None:  # the places of passages, from the first on, and how far any of them reaches
            of_doc, (begin, end) = flat(batch, "begin end")
            begin, end = of_doc * step + np.minimum(begin, step - 1), of_doc * step + np.minimum(end - (n - 1), step - 1)
            at = np.argsort(begin, kind="stable")
            begin, end = begin[at], np.maximum.accumulate(end[at])
            i = np.searchsorted(begin, base + c, "right") - 1
            known = (base + c < end[i]) & (i >= 0) if len(begin) else np.zeros(len(c), bool)
        for b, band in enumerate(bands):
            each = []
            for k in band:
                # the runs that begin here lie in the window and hold its centre, so each run has one window of a hash
                at = np.flatnonzero(h == k)
                begin, end = np.maximum(l[at], c[at] - least + 1), np.minimum(c[at], r[at] - least + 1)
                order = np.argsort(base[at] + begin, kind="stable")
                at, begin, end = at[order], begin[order], end[order]
                each.append((at, base[at] + begin, base[at] + end))
            if not all(len(at) for at, _, _ in each):
                continue
            start = np.unique(np.concatenate([x for _, begin, end in each for x in (begin, end + 1)]))
            inside, use, until = np.ones(len(start), bool), [], np.full(len(start), np.iinfo(np.int64).max)
            for at, begin, end in each:
                i = np.searchsorted(begin, start, "right") - 1
                inside &= (i >= 0) & (start <= end[i])
                until = np.minimum(until, end[i])
                use.append(at[i])
            use = np.array([u[inside] for u in use])
            start, until = start[inside], until[inside]
            code = np.full(use.shape[1], b, np.uint64)
            for u in use:
                code = mixed(code * _A[62] + key[u].view(np.uint64))
            if bits is None:
                keep = ~known[use].all(0)
            else:
                at = filter_place(code, bits)
                keep = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1) > 0
            use, code = use[:, keep], code[keep]
            yield [code.view(np.int64), doc[number[use[0]]], np.full(len(code), b), l[use].max(0), c[use[0]], r[use].min(0), start[keep] - base[use[0]], until[keep] - base[use[0]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for columns in of(batch.slice(at, 500)):
                    yield pa.RecordBatch.from_arrays([pa.array(x if k < 2 else x.astype(np.int32)) for k, x in enumerate(columns)], ["code", "doc", "h", "l", "c", "r", "s", "e"])

    return run


def _compared(source: DataFrame, pairs: DataFrame, least: int, agree: int, similarity: float, n: int) -> DataFrame:
    """Verified passages of the pairs' collisions, written."""
    pairs = pairs.repartition("x", "y").sortWithinPartitions("x", "y")
    ranges = written(pairs.mapInArrow(_ranges(least, agree), "x long, y long, a long, b long, ya long, yb long"), "ranges")
    wanted = ranges.select(F.col("x").alias("doc")).union(ranges.select(F.col("y").alias("doc"))).distinct()
    wanted = written(wanted, "wanted")
    bits = bit_filter(wanted, "doc")
    tokens = written(source.select("doc", "text", F.pmod(F.xxhash64("doc"), F.lit(len(bits) * 8)).alias("at")).mapInArrow(_short_tokens(n, bits), "doc long, t binary").dropDuplicates(["doc", "t"]), "tokens", TEXT_ROWS)
    cut = lambda t, a, b: F.expr(f"substring({t}, cast(4 * {a} + 1 as int), cast(4 * ({b} - {a}) as int))")
    wider = ranges.withColumn("wide", F.greatest(F.col("a") - SLACK, F.lit(0)))
    tx = wider.join(tokens.withColumnRenamed("doc", "x"), "x").select("x", "y", "a", "b", "wide", "ya", "yb", cut("t", "wide", f"(b + {SLACK})").alias("tx"))
    both = tx.join(tokens.withColumnRenamed("doc", "y"), "y").select("x", "y", "a", "b", "wide", "ya", "tx", cut("t", "ya", "yb").alias("ty"))
    found = written(both.mapInArrow(_verify(least, similarity, n), "doc_id long, start_word long, end_word long, source_doc_id long, source_start long, source_end long, similarity double"), "passages", TEXT_ROWS)
    for df in (ranges, wanted, tokens):
        drop_written(df)
    return found


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their ranges and the white space after those."""
    for batch in batches:
        texts = []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("_cut_ranges").to_pylist(), strict=True):
            raw, kept, at, word, spans = text.encode(), [], 0, 0, []
            begins, ends = word_places(raw)
            for a, b in sorted((r["start_word"], r["end_word"]) for r in ranges):
                if b > word:
                    a = max(a, word)
                    spans.append((begins[a], begins[b] if b < len(begins) else len(raw)))
                    word = b
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            texts.append(b"".join(kept).decode())
        k = batch.schema.get_field_index("text")
        columns = [pa.array(texts, pa.string()) if i == k else c for i, c in enumerate(batch.columns)]
        keep = [i for i, name in enumerate(batch.schema.names) if name != "_cut_ranges"]
        yield pa.RecordBatch.from_arrays([columns[i] for i in keep], [batch.schema.names[i] for i in keep])


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end, in bytes."""
    b = np.frombuffer(raw, np.uint8)
    blank = np.concatenate([[True], (b == 32) | ((b >= 9) & (b <= 13)), [True]])
    return np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])


def stage_substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each repeated passage stays in the document with the smallest doc_id and is cut out of the others;
    n_chars follows the text. Only the texts that are cut are shuffled, up to BROADCAST_IDS of them; beyond it all are."""
    found = written(repeated_passages(docs).groupBy(F.col("doc_id").alias("_cut_id")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("_cut_ranges")), "cuts")
    few = found.count() <= BROADCAST_IDS
    ids = F.broadcast(found.select("_cut_id")) if few else found.select("_cut_id")
    other = docs.join(ids, F.col("doc_id") == F.col("_cut_id"), "left_anti")
    maybe = docs.join(ids, F.col("doc_id") == F.col("_cut_id"), "left_semi")
    joined = maybe.join(found, F.col("doc_id") == F.col("_cut_id")).drop("_cut_id")
    whole = joined.filter("_cut_ranges is null or text is null").drop("_cut_ranges")
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    cut = joined.filter("_cut_ranges is not null and text is not null").mapInArrow(_without, names)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return other.union(whole.select(*docs.columns)).union(cut.select(*docs.columns))
