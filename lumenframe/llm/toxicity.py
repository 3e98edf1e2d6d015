"""Toxicity with noisy-channel deobfuscation.

A character language model over a fixed alphabet is counted on all documents. A token that may be
disguised (digits or signs among letters, long repetitions, look-alike letters, letters set apart)
is a lattice: each written character may stand for some letters or for nothing, at a cost of the
channel. Viterbi under the language model decodes it. A token with one reading is that reading, so
plain words pass as they are. A lexicon of word and word-start features, learned on the restored
texts of labelled rows, scores each document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, without, written

#: Letters of the language model; all others are one symbol. 0 is the edge of a word.
LETTERS = "abcdefghijklmnopqrstuvwxyzßäöüéèêëàâçîïôûùñóíáúæœ"
ALPHABET = len(LETTERS) + 2
ORDER = 4
#: Cells of the dense count table: its size is fixed by the alphabet, whatever the corpus.
CELLS = ALPHABET**ORDER
#: Labelled rows that the lexicon is fitted on, about, at most (chosen by a hash of the id).
FIT_ROWS = 20_000
#: Rounds of hash folds: rows with crc32(doc_id) % FOLDS = 0 are held out.
FOLDS = 5
#: Word starts that are features, besides the whole word.
STARTS = (4, 5, 6)
#: Chance per run that a feature of the lexicon is there by accident, as a log.
LOG_FALSE = math.log(0.05)
#: Bounds of memory of a Python worker, for speed alone: readings of tokens, parts of words and counted features that are held at once, and texts of a batch.
READINGS, PARTS, COUNTED, TEXTS = 100_000, 100_000, 100_000, 500
#: Different words of a text with the same start that make further features.
MOST_MARKS = 3
#: Ridge penalty of the lexicon's weights; score where there is nothing to learn from, as log odds.
RIDGE, NOTHING = 0.2, -3.5
#: Jaccard similarity of the words of near copies among the rows that the lexicon is fitted on.
ALIKE = 0.7
#: Share of toxic rows, at least, with which a feature is evidence alone.
ALONE = 0.93

#: What a written sign may stand for (fixed values of common substitution alphabets).
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "%": "x",
    "&": "e", "#": "h", "?": "q", "}": "d", "¡": "i", "§": "s", "µ": "u", "ø": "o",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ԁ": "d", "т": "t", "м": "m", "к": "k", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "κ": "k",
}
#: Signs that may stand for nothing, between letters.
SEPARATORS = ".,-_*~'’·:;/\\|^`\"=+ ­​‌‍⁠﻿"
#: Costs of the channel, in nats.
COST_STANDS, COST_SKIP, COST_COLLAPSE, COST_KEEP_SIGN = 1.0, 0.7, 0.6, 9.0
#: Cost of an edge of a word within a run of letters set apart, and of a blank within a word.
COST_EDGE = 1.0
#: Log chance of a word's end below which the word may go on behind the blank.
LOG_BROKEN = math.log(0.005)

_CODE = np.full(0x10000, ALPHABET - 1, np.int32)
for _i, _c in enumerate(LETTERS):
    _CODE[ord(_c)] = _i + 1
for _c in " \t\n\r\x0b\x0c":
    _CODE[ord(_c)] = 0
_INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
_WIDE = {i: i - 0xFEE0 for i in range(0xFF01, 0xFF5F)}

#: Tokens with one reading: letters only, no letter three times in a row.
_PLAIN = re.compile(r"[^\W\d_]+")
_TRIPLE = re.compile(r"(.)\1\1")
_LONG = re.compile(r"(.)\1{3,}", re.S)
_DISGUISED = re.compile("[" + re.escape("".join(STANDS_FOR) + SEPARATORS.replace(" ", "")) + "]")
#: Signs that stand for a letter within a run of letters set apart, where they are set apart themselves.
_SIGNS = "@$!|+(<"
_ITEM = rf"(?:(?<![^\W_])[^\W_](?![^\W_])|(?<![^\s.\-_*])[{re.escape(_SIGNS)}](?![^\s.\-_*]))"
#: Three or more single signs, set apart by any blanks, line ends and punctuation.
_APART = re.compile(rf"{_ITEM}(?:[\W_]+?{_ITEM}){{2,}}")
_SINGLE = re.compile(_ITEM)
#: What a text has, at least, that has such a run without signs.
_ROUGHLY_APART = re.compile(r"\b\w\b\W+\w\b\W+\w\b")
_SIGN_TOKENS = set(_SIGNS)
#: Signs that may stand for a word's first letter, or before the word.
_OPENING = tuple(_SIGNS + "€£?")
_EDGE = re.compile(r"^[^\w@$!|+(<€£]+|[^\w@$|+€£]+$")


def count_cells(text: str, total: np.ndarray) -> None:
    """Adds the counts of all runs of ORDER symbols of the lower-cased text to a dense vector."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _CODE[np.minimum(raw, 0xFFFF)]
    # runs of blanks are one edge, so words meet as at the edges of the text
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    if len(codes) >= ORDER:
        cell = codes[: len(codes) - ORDER + 1].copy()
        for k in range(1, ORDER):
            cell *= ALPHABET
            cell += codes[k : len(codes) - ORDER + 1 + k]
        np.add.at(total, cell, 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS, np.int64)
    texts, size = [], 0
    for batch in _slices(batches):
        for text in batch.column(0).to_pylist():
            if text:
                texts.append(text)
                size += len(text)
                if size > 2_000_000:
                    count_cells("\n".join(texts), total)
                    texts, size = [], 0
    count_cells("\n".join(texts), total)
    cells = np.flatnonzero(total)
    for at in range(0, len(cells), 100_000):
        part = cells[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["cell", "n"])


class CharacterModel:
    """log p(symbol | ORDER - 1 symbols before), lower orders interpolated (Witten-Bell)."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray):
        full = np.zeros(CELLS, np.float32)
        full[cells] = counts
        p = np.full(ALPHABET, 1 / ALPHABET, np.float32)

        def smoothed(c: np.ndarray, lower: np.ndarray) -> np.ndarray:
            total, kinds = c.sum(1, keepdims=True), np.maximum((c > 0).sum(1, keepdims=True), 1)
            return (c + kinds * np.tile(lower, (c.shape[0] // lower.shape[0], 1))) / (total + kinds)

        for order in range(1, ORDER):
            p = smoothed(full.reshape([ALPHABET ** (ORDER - order), ALPHABET ** (order - 1), ALPHABET]).sum(0), p.reshape(-1, ALPHABET))
        # the highest order by its first symbol and in place, as double copies of all cells would be a worker's largest arrays
        p, self.log = p.reshape(-1, ALPHABET), full.reshape(-1, ALPHABET)
        for at in range(0, len(self.log), len(p)):
            self.log[at : at + len(p)] = np.log(smoothed(self.log[at : at + len(p)], p))


class Restorer:
    """Restores tokens; keeps the readings of as many tokens as `most`, besides those of one text."""

    def __init__(self, model: CharacterModel, most: int = READINGS):
        self.log, self.most = model.log, most
        #: Readings of tokens, further ones without the signs before them, tokens that may go on, those known for one text only, pairs, endings.
        self.kept, self.bare, self.broken, self.passing, self.joined, self.breaks = {}, {}, set(), [], {}, {}

    def word(self, token: str) -> str:
        """The reading of a token. Signs before its letters may be letters or punctuation; bare has the latter reading."""
        word = self.kept.get(token)
        if word is None:
            special = False
            if token.isalpha() and token.isascii() and not _TRIPLE.search(token):
                word = token
            else:
                core = _EDGE.sub("", token)
                word = self._read(core)
                if core.startswith(_OPENING) and (bare := core.strip("".join(_OPENING))):
                    self.bare[token], special = self._read(bare), True
            if word and token[-1].isalnum() and self._breaks(word[1 - ORDER :]):
                self.broken.add(token)
                special = True
            if len(self.kept) < self.most:
                self.kept[token] = word
            elif special:
                self.passing.append(token)
        return word

    def _breaks(self, last: str) -> bool:
        """Whether words hardly ever end with these letters."""
        breaks = self.breaks.get(last)
        if breaks is None:
            context = 0
            for c in last:
                context = context * ALPHABET + _INDEX.get(c, ALPHABET - 1)
            breaks = bool(self.log[context, 0] < LOG_BROKEN)
            if len(self.breaks) < self.most:
                self.breaks[last] = breaks
        return breaks

    def _read(self, core: str) -> str:
        if _PLAIN.fullmatch(core) and not _TRIPLE.search(core) and not _DISGUISED.search(core):
            return core
        if not any(c.isalpha() or c in STANDS_FOR and not c.isdigit() for c in core):
            return core  # numbers, dates and rulers
        # the model might take a very long repetition for one of its own
        return self.viterbi(_LONG.sub(r"\1\1\1", core))

    def _at(self, letters: str) -> list[float]:
        """The log chance of each letter, a blank being an edge, and of the edge behind them."""
        size, context, out = ALPHABET, 0, []
        for c in letters + " ":
            code = 0 if c == " " else _INDEX.get(c, size - 1)
            out.append(float(self.log[context, code]))
            context = context % size ** (ORDER - 2) * size + code
        return out

    def _join(self, a: str, b: str) -> str:
        """The word that a blank has split into a and b, where it is likelier than the two; else nothing."""
        key = (a, b)
        word = self.joined.get(key)
        if word is None:
            x, y = self.bare.get(a, self.word(a)), self.word(b)
            word = x + y if x and y and sum(self._at(x + y)) > sum(self._at(f"{x} {y}")) + COST_EDGE else ""
            self.joined[key] = word
        return word

    def split_words(self, tokens: list[str]) -> Iterator[str]:
        """Words that blanks have split, where a piece ends as words hardly ever do. Pieces of one
        word follow each other, so each is put behind what the ones before it have become."""
        behind, last = "", -1
        for k, t in enumerate(tokens[:-1]):
            if t in self.broken and tokens[k + 1][0].isalnum():
                word = self._join(t, tokens[k + 1])
                if word:
                    yield word
                    if last == k - 1 and behind:
                        word = behind + self.word(tokens[k + 1])
                        yield word
                    behind, last = word, k

    def viterbi(self, token: str, edges: bool = False) -> str:
        """The likeliest letters behind the written ones; with edges, blanks may stand between them."""
        size, edge = ALPHABET, 0
        start = (edge * size + edge) * size + edge  # the symbols before
        keep = size ** (ORDER - 2)
        beam: dict = {(start, ""): (0.0, None)}  # (context, sign that a repetition would repeat) -> (score, (letters before, letter))
        n = len(token)
        for k, c in enumerate(token):
            nexts: dict = {}
            if edges and k:
                ended: dict = {}
                for (context, _), (score, letters) in beam.items():
                    if letters is not None and letters[1] != " ":
                        key, s = (context % keep * size + edge, ""), score - COST_EDGE + float(self.log[context % size ** (ORDER - 1), edge])
                        if key not in ended or ended[key][0] < s:
                            ended[key] = (s, (letters, " "))
                for key, x in ended.items():
                    if key not in beam or beam[key][0] < x[0]:
                        beam[key] = x
            readings = [(c, 0.0 if c in _INDEX else COST_KEEP_SIGN)] if c.isalnum() and not c.isdigit() else [(c, COST_KEEP_SIGN)]
            readings += [(x, COST_STANDS) for x in STANDS_FOR.get(c, "")]
            skip = COST_SKIP if c in SEPARATORS and 0 < k < n - 1 else None
            for (context, last), (score, letters) in beam.items():
                for x, cost in readings:
                    code = _INDEX.get(x, size - 1)
                    s = score - cost + float(self.log[context % size ** (ORDER - 1), code])
                    key = (context % keep * size + code, x)
                    if key not in nexts or nexts[key][0] < s:
                        nexts[key] = (s, (letters, x))
                    if x == last:  # one more of the same letter says nothing
                        s = score - COST_COLLAPSE - cost
                        key = (context, last)
                        if key not in nexts or nexts[key][0] < s:
                            nexts[key] = (s, letters)
                if skip is not None:
                    key, s = (context, last), score - skip
                    if key not in nexts or nexts[key][0] < s:
                        nexts[key] = (s, letters)
            beam = nexts  # one state for each context of ORDER - 1 letters that the last signs can stand for
        letters = max(((score + float(self.log[context % size ** (ORDER - 1), edge]), letters) for (context, _), (score, letters) in beam.items()), key=lambda x: x[0])[1]
        out = []
        while letters is not None:
            letters, x = letters
            out.append(x)
        return "".join(reversed(out))

    def words(self, text: str) -> set[str]:
        """The distinct restored words of a text."""
        text = text.lower()
        if not text.isascii():
            text = text.translate(_WIDE)
        tokens = text.split()
        distinct = set(tokens)
        get, kept = self.word, self.kept
        found = {kept[t] if t in kept else get(t) for t in distinct}
        if not self.bare.keys().isdisjoint(distinct):
            found.update(self.bare[t] for t in distinct if t in self.bare)
        if not self.broken.isdisjoint(distinct):
            found.update(self.split_words(tokens))
        if self.passing or len(self.joined) > self.most:
            for t in self.passing:
                self.bare.pop(t, None)
                self.broken.discard(t)
            self.passing, self.joined = [], {}
        if not _SIGN_TOKENS.isdisjoint(distinct) or _ROUGHLY_APART.search(text.replace("_", " ")):
            found.update(self.apart_words(text))
        found.discard("")
        return found

    def apart_words(self, text: str) -> Iterator[str]:
        """Words whose letters are set apart."""
        for m in _APART.finditer(text):
            run = _LONG.sub(r"\1\1\1", "".join(_SINGLE.findall(m[0])))
            if not any(c.isalpha() or c in _SIGNS for c in run):
                continue
            # signs at its ends may be punctuation, and it may hold more than one word or begin with a word of one letter
            for r in {run, run.strip(_SIGNS)} - {""}:
                yield self.viterbi(r)
                for a in range(1, min(3, len(r) - 3)):
                    yield self.viterbi(r[a:])
                yield from self.viterbi(r, True).split()


def features(words: set[str]) -> set[str]:
    """Whole words; starts that one, two or three different words of the text have (so many marks)."""
    starts = Counter(w[:k] for w in words for k in STARTS if len(w) > k)
    out = set(words)
    for start, n in starts.items():
        out.update(start + "*" * k for k in range(1, min(n, MOST_MARKS) + 1))
    return out


def _unpack(model) -> CharacterModel:
    cells, counts = model.value
    return CharacterModel(cells, counts)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), TEXTS):
            yield batch.slice(at, TEXTS)


def _feature_counts(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(_unpack(model))
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out():
            for toxic, held in enumerate(seen):
                if held:
                    n, none = pa.array(list(held.values()), pa.int64()), pa.array(np.zeros(len(held), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *((n, none) if toxic else (none, n))], ["feature", "toxic", "clean"])
                    held.clear()

        for batch in _slices(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update(features(restorer.words(text or "")))
                if len(seen[0]) + len(seen[1]) > COUNTED:
                    yield from out()
        yield from out()

    return run


class Lexicon:
    """A logistic model over the features that are not there by accident. A feature that is
    hardly ever in clean rows is evidence alone, however many others a toxic row mostly has."""

    def __init__(self, bias: float, weights: dict[str, float], alone: dict[str, float]):
        self.bias, self.weights, self.alone = bias, weights, alone
        self.starts = {x.rstrip("*") for x in weights if x.endswith("*")}
        self.kept: dict[str, tuple] = {}

    def _parts(self, word: str) -> tuple:
        return (word if word in self.weights else None, *(word[:k] for k in STARTS if len(word) > k and word[:k] in self.starts))

    def found(self, words: set[str]) -> list[str]:
        """The lexicon's features of a text's restored words."""
        kept, out, starts = self.kept, [], Counter()
        for w in words:
            parts = kept.get(w)
            if parts is None:
                parts = self._parts(w)
                parts = () if parts == (None,) else parts
                if len(kept) < PARTS:
                    kept[w] = parts
            if parts:
                if parts[0]:
                    out.append(parts[0])
                starts.update(parts[1:])
        for start, n in starts.items():
            out += [f for k in range(1, min(n, MOST_MARKS) + 1) if (f := start + "*" * k) in self.weights]
        return out

    def score(self, words: set[str]) -> float:
        found = self.found(words)
        z = self.bias + sum(self.weights[f] for f in found)
        return max(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), *(self.alone.get(f, 0.0) for f in found), 0.0)


def _logistic(rows: list[list[int]], toxic: np.ndarray, n: int, ridge: float = RIDGE, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Ridge-penalised logistic regression on binary features, by accelerated gradient steps."""
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.array([f for r in rows for f in r], np.int64)
    w, bias = np.zeros(n + 1), n
    v = w.copy()
    # a bound of the curvature: a quarter of the largest row sum of the Gram matrix
    widest = np.bincount(of, minlength=len(rows)) + 1.0
    grain = np.bincount(at, weights=widest[of], minlength=n + 1)
    grain[bias] = widest.sum()
    step = 1 / (grain / 4 + ridge)
    for k in range(rounds):
        z = v[bias] + np.bincount(of, weights=v[at], minlength=len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic
        gradient = np.bincount(at, weights=error[of], minlength=n + 1)
        gradient[:n] += ridge * v[:n]
        gradient[bias] = error.sum()
        after = v - step * gradient
        v, w = after + k / (k + 3) * (after - w), after
    return float(w[bias]), w[:n]


def _scores(model, lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, known = Restorer(_unpack(model)), Lexicon(*lexicon.value)
        for batch in _slices(batches):
            scores = [known.score(restorer.words(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def _hits(model, lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, known = Restorer(_unpack(model)), Lexicon(*lexicon.value)
        for batch in _slices(batches):
            found = [known.found(restorer.words(t or "")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.string()))], ["toxic", "found"])

    return run


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


def language_model(docs: DataFrame):
    """Broadcast (cells, counts) of the character model, counted over all documents."""
    cells = docs.select("text").mapInArrow(_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = cells.toArrow()  # at most CELLS rows, whatever the corpus
    return docs.sparkSession.sparkContext.broadcast((rows["cell"].to_numpy(), rows["n"].to_numpy()))


def fit(docs: DataFrame, labels: DataFrame, model) -> tuple[float, dict[str, float], dict[str, float]]:
    """The lexicon, from the labelled rows that are not held out. Near copies count once: of rows that share
    their smallest word hashes, one stays with those that do not have ALIKE of its words."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = known.count()
    if count > FIT_ROWS:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * FIT_ROWS / count))
    # FIT_ROWS ids, so the texts of all other rows are neither shuffled nor kept
    known = docs.join(F.broadcast(known), "doc_id")
    # candidates of near copies: rows that share their smallest word hashes
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")
    group = F.xxhash64(*[F.array_min(F.transform(words, lambda w, k=k: F.xxhash64(w, F.lit(k)))) for k in range(2)])
    rows = written(known.select("text", F.col("toxic").cast("int").alias("toxic"), group.alias("g")), "labelled")
    one = rows.groupBy("g", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("one"))
    of = lambda c: F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"))
    both = rows.join(one, ["g", "toxic"]).select("text", "toxic", "one", of("text").alias("x"), of("one").alias("y"))
    alike = F.size(F.array_intersect("x", "y")) >= ALIKE * F.size(F.array_union("x", "y"))
    rows = written(both.filter(F.col("text").eqNullSafe(F.col("one")) | ~alike).select("text", "toxic").distinct(), "fit")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return NOTHING, {}, {}
    base = toxic / (toxic + clean)
    found = written(rows.mapInArrow(_feature_counts(model), "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")), "features")
    tried = found.filter("t + c > 1").count()
    # Chernoff: so many toxic rows of t + c are that unlikely at the base rate
    share = F.col("t") / (F.col("t") + F.col("c"))
    gain = F.col("t") * F.log(share / base) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    strong = found.filter((share > base) & (gain > math.log(max(tried, 1)) - LOG_FALSE)).collect()
    if not strong:
        return math.log(base / (1 - base)), {}, {}
    index = {f: k for k, f in enumerate(sorted(r["feature"] for r in strong))}
    # the rule of three bounds the clean rows that were not seen
    alone = {r["feature"]: (r["t"] + 0.5) / (r["t"] + r["c"] + 1) for r in strong if r["t"] >= ALONE * (r["t"] + r["c"] + 3) or r["c"] == 0 and r["t"] >= max(8, 0.1 * toxic)}
    sent = docs.sparkSession.sparkContext.broadcast((0.0, dict.fromkeys(index, 0.0), {}))
    hits = rows.mapInArrow(_hits(model, sent), "toxic int, found array<string>").toArrow()  # FIT_ROWS rows, about
    bias, weights = _logistic([[index[f] for f in x] for x in hits["found"].to_pylist()], hits["toxic"].to_numpy().astype(float), len(index))
    return bias, {f: float(weights[k]) for f, k in index.items()}, alone


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, score, predicted.

    Labels are read from rows that are not held out only. A null text is an empty one and has the
    score of a document without features; a null doc_id is never labelled; with no labelled rows of
    both kinds every score is that one. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = language_model(docs)
    lexicon = spark.sparkContext.broadcast(fit(docs, labels.select("doc_id", "toxic"), model))
    scored = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(_scores(model, lexicon), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go. Rows that repeat a doc_id go together."""
    return without(docs, toxicity_scores(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select("doc_id"))
