"""License scans, source divergence and spelling variants against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import divergence, licenses, spelling
from tests.conftest import DATA

DOC = "doc_id long, text string, lang string, source string, word string, n int, term string, segment int, host string, places int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, "z", 1, "t", 2, "h", 3) for i, t, lang, source in rows], DOC)


# --- spelling variants


def brute_words(rows):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 3}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_variants(counts):
    without = defaultdict(set)  # words by what is left without one letter: those one apart share one
    for w in counts:
        for i in range(len(w)):
            without[w[:i] + w[i + 1 :]].add(w)
        without[w].add(w)
    near = defaultdict(set)
    for group in without.values():
        for a in group:
            near[a] |= {b for b in group if one_apart(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), form[w] and counts[form[w]]))
    return rows


def test_variants_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    want = brute_variants(brute_words(docs.collect()))
    got = spelling.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(want) > 1000
    assert {tuple(r) for r in got} == want


def test_variants_of_repeated_bigrams(spark):
    """Words of two letters: bigrams repeat, so the third of a word's rarest is often tied with further places."""
    rng = np.random.default_rng(3)
    counts = {}
    while len(counts) < 600:
        counts["".join(rng.choice(list("ab×"), rng.integers(5, 9)))] = int(rng.integers(3, 40))
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == brute_variants(counts)


def test_variants_edges(spark):
    long = "q" * 3_000
    rows = [(None, "wordy wordy"), (1, None), (2, ""), (3, "WORDY Écoles écoles Écoles Écoles"), (3, "WORDY"), (4, f"{long} {long} {long}r {long}r {long}r abc abc abc"), (5, f"{long} {long} {long}")]
    got = spelling.spelling_variants(frame(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert {tuple(r) for r in got} == {(w, n, k, f, m, r) for w, f, r, n, k, m in brute_variants(brute_words(rows))}
    assert {"wordy", long} <= {r.word for r in got}
    assert spelling.spelling_variants(frame(spark, [])).collect() == []


def test_forms_are_followed_to_the_last(spark):
    chain = [f"w{k}" for k in range(21)]
    forms = spark.createDataFrame([(a, b) for a, b in zip(chain, chain[1:], strict=False)] + [("x", None)], "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {(w, "w20") for w in chain[:-1]}


# --- source divergence


def brute_divergence(rows):
    terms = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    docs, counts, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in terms:
        docs[lang].update(set(words))
        counts[lang, source].update(words)
        langs[lang].add(source)
    out = set()
    for lang, sources in langs.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= 10)

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}

        def ranked(part, s, values, lang=lang):
            for k, (item, value) in enumerate(sorted(values, key=lambda x: (-x[1], x[0].encode())), 1):
                if part == "pair" or k <= 10:
                    out.add((lang, s, part, item, value, k))

        for s in sources:
            ranked("pair", s, [(o, sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept)) for o in sources - {s}])
            ranked("term", s, [(t, (p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]])
    return out


def audited(docs):
    rows = [tuple(r) for r in divergence.divergence(docs).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("sources", "block", "segment"), [(1, 8, 4096), (2, 8, 4096), (7, 2, 16), (23, 3, 8)])
def test_divergence_equals_brute_force(spark, monkeypatch, sources, block, segment):
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", block)
    monkeypatch.setattr(divergence, "SEGMENT_TERMS", segment)
    rng = np.random.default_rng(sources)
    words = [f"{a}{b}" for a in ("Ab", "é", "日", "z") for b in "abcdefghijklmnop"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 30), p=None)) + " 7x", ["en", "fr", None][k % 3], f"s{int(rng.integers(0, sources))}") for k in range(240)]
    docs = frame(spark, [(k, *r) for k, r in enumerate(rows)])
    assert audited(docs) == brute_divergence(rows)


def test_every_two_blocks_meet_once(spark):
    for blocks in range(1, 12):
        teams = blocks + blocks % 2
        met = spark.range(blocks).selectExpr("id AS block", f"explode(sequence(0, {teams} - 2)) AS step").withColumn("host", divergence._partner("block", "step", str(teams))).collect()
        met = [(r.block, r.host, r.step) for r in met if r.host < blocks]
        assert sorted((a, b) for a, b, _ in met) == [(a, b) for a in range(blocks) for b in range(blocks) if a != b]
        assert all(len({x for m in met if m[2] == s for x in m[:2]}) == sum(m[2] == s for m in met) for s in range(teams))


def test_divergence_edges(spark):
    rows = [(None, None, None), ("", "", "a"), ("same words here", "xx", "a"), ("same words here", "xx", "a"), ("other", "xx", None)]
    assert audited(frame(spark, [(k, *r) for k, r in enumerate(rows)])) == brute_divergence(rows)
    rows = [("tie\x00tie TieÉ", "en", "ab"[k % 2]) for k in range(24)] + [("x " * 30_000, "en", "c")] * 10
    assert audited(frame(spark, [(k, *r) for k, r in enumerate(rows)])) == brute_divergence(rows)
    assert audited(frame(spark, [])) == set()


def test_shares_are_exact():
    counts = np.array([0, 1, 5, 10**9, 4 * 10**14], np.int64)
    for of in (7 * 10**14 + 1, 9 * 10**14, 8 * 10**15):
        assert divergence.p_of(counts, of).tolist() == [1 + 10**9 * (int(c) + 2) // of for c in counts]
    ids = np.array([0, 3, 4096])
    assert divergence.unpacked(divergence.packed(ids, np.array([2, 1 << 40, 1])), 4097)[ids].tolist() == [2, 1 << 40, 1]


# --- license scans

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice{next} shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", {kind}EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE {who} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def scanned(spark, texts):
    got = licenses.license_labels(frame(spark, [(k, t, "en", "s") for k, t in enumerate(texts)]))
    return [r for r in got.orderBy("doc_id").collect()]


def test_optional_and_replaceable_regions(spark):
    kind, who = "WITHOUT WARRANTY OF ANY KIND, ", "AUTHORS OR COPYRIGHT HOLDERS"
    full = MIT.format(next="", kind=kind, who=who)
    texts = [
        full,
        MIT.format(next=" (including the next paragraph)", kind="", who="X CONSORTIUM"),
        full.replace("sublicense", "sublicence"),
        full.replace("free of charge", "for a charge"),  # mandatory wording differs
        full.replace("THE AUTHORS OR COPYRIGHT HOLDERS BE", "THE BE"),  # one to twenty words stand there
        full.replace("AUTHORS OR COPYRIGHT HOLDERS", "A " * 21),
        "Licensed under the Apache License, Version 2.0.",
        "licenced under the apache licence 2.0",
        "released under the terms of the MIT License",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under CC BY-NC 4.0.",
        "licensed, he said, under the general public, License",
    ]
    want = ["MIT", "MIT", "MIT", "", "", "", "Apache-2.0,apache", "Apache-2.0", "MIT,mit", "GPL-3.0,gpl", "LGPL-3.0-or-later,gpl", "CC-BY-NC-4.0", "gpl"]
    assert [r.labels for r in scanned(spark, texts)] == want


def test_base_phrases_are_all_counted(spark):
    texts = ["mit license mit License MIT-LICENSE mitlicense mit licence", "GNU general public\n\nlicense; apache license Apache License", None, "", "mit license" + " w" * 60_000 + " mit license", "mit" + "\x00" + "license"]
    got = [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in scanned(spark, texts)]
    assert got == [(9, 3, 0, 4, "mit"), (7, 2, 1, 5, "apache,gpl"), (0, 0, None, None, ""), (0, 0, None, None, ""), (60_004, 2, 0, 60_002, "mit"), (2, 1, 0, 0, "mit")]
    scores = [r.score for r in scanned(spark, texts)]
    assert all(0 <= s <= 1 for s in scores) and scores[2] == 0 and scores[1] > scores[0] > 0
    assert scanned(spark, []) == []


def test_automaton_accepts_what_the_pattern_does():
    rng = np.random.default_rng(5)
    templates = ['a <<beginOptional>>b <<beginOptional>>c<<endOptional>> <<endOptional>> d', 'b <<var;match=".{1,3}">> a', 'c <<var;match="(a b|d|.{0,1})">> c', "d d"]
    parts = [licenses.parse(t) for t in templates]
    machine = licenses.Automaton(parts)
    begins = machine.first_words()
    for _ in range(400):
        words = list(rng.choice(list("abcdx"), rng.integers(1, 12)))
        ids = [machine.number.get(w, 0) for w in words]
        for start in range(len(words)):
            left = " ".join(words[start:]) + " "
            want = {}
            for k, p in enumerate(parts):
                ends = [e for e in range(1, len(words) - start + 1) if re.fullmatch(licenses.as_pattern(p), " ".join(words[start : start + e]) + " ")]
                if ends:
                    want[k] = start + max(ends)
            assert machine.places(ids, start) == want, left
            if want:
                assert begins[ids[start], (ids + [0])[start + 1]]


@pytest.mark.parametrize("bad", ["a <<beginOptional>>b", "a <<endOptional>>", 'a <<var;match="x+">>', "a <<what>>", "<<beginOptional>>a<<endOptional>>"])
def test_bad_markup_is_an_error(bad):
    with pytest.raises(ValueError):
        licenses.Automaton([licenses.parse(bad)])


def test_registered_columns(spark):
    from lumenframe.llm import registry

    q = registry.queries()
    assert q["op11_license_scan"](spark, DATA).columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert q["op13_spelling_variants"](spark, DATA).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert q["op12_source_divergence"](spark, DATA).filter(F.col("rank") > 0).columns == ["lang", "source", "part", "item", "value", "rank"]
