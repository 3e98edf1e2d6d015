"""Decontamination, toxicity, quality, packing, HTML, urls, WARC."""

import hashlib
import json
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from lumenframe.llm import decontaminate, html_text, packing, quality, toxicity, url_filter, warc
from lumenframe.llm.common import fresh_path

from .conftest import edited, prose


def test_contaminated_by_exact_containment(spark, docs_of):
    items = [(1, prose(30, 1)), (2, prose(60, 2)), (3, "just three words"), (4, None), (5, ""), (1, prose(30, 1))]
    inside = lambda t: prose(4000, 7) + " " + t + " " + prose(4000, 8)
    rows = [(1, inside(prose(30, 1))), (2, inside(prose(30, 1).upper().replace(" ", ", "))), (3, prose(60, 2)), (4, edited(prose(60, 2), 59, 1)), (5, edited(prose(60, 2), 6, 1)), (6, "these are just three words here"), (7, None), (8, ""), (9, prose(300, 9)), (1, inside(prose(30, 1)))]
    df = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(rows), df).collect())
    assert got == [(1, 1), (2, 1), (3, 2), (4, 2), (6, 3)]
    assert decontaminate.contaminated(docs_of(rows), df.limit(0)).count() == 0
    assert decontaminate.contaminated(docs_of(rows).limit(0), df).count() == 0


def test_rows_without_or_with_the_same_id_are_judged_by_their_own_text(spark, docs_of):
    words = prose(16, 3).split()
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    part = lambda a, b: " ".join(words[a:b])
    rows = [(None, part(0, 8)), (None, part(8, 16)), (5, part(0, 8)), (5, part(8, 16)), (6, part(0, 14)), (6, part(0, 2)), (None, part(0, 16))]
    got = sorted((r.doc_id or -1, r.item_id, r.item_shingles, r.found_shingles) for r in decontaminate.contaminated(docs_of(rows), items).collect())
    assert got == [(-1, 1, 12, 12), (6, 1, 12, 10)]
    out = decontaminate.contaminated(docs_of([]), items)
    assert out.count() == 0


def test_sketch_refuses_pairs_that_share_other_shingles(spark, docs_of):
    words = prose(60, 4).split()
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    sketch = decontaminate.sketched(items)
    rows = [(k, " ".join(words[k : k + 5])) for k in range(56)]
    found = decontaminate.candidates(docs_of(rows).withColumn("doc_key", F.col("doc_id")), sketch).count()
    assert found == sketch.first()["sketch"].__len__() == 12  # of 56 shingles, 56 - ceil(0.8 * 56) + 1


def test_decontamination_equals_its_sql_with_short_items(spark, docs_of):
    items = [(1, prose(30, 1)), (2, "just three words"), (3, None), (4, "one"), (1, prose(9, 5)), (5, "a b c d e")]
    rows = [(1, prose(50, 2) + " " + prose(30, 1)), (1, "one, JUST three  words"), (2, prose(9, 5)), (3, None), (None, "one"), (4, "x a b c d e f"), (4, "x a b c d e f")]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(-1 if v is None else v for v in r) for r in decontaminate.contaminated(docs_of(rows), df).collect())
    c = duckdb.connect()
    documents, benchmark = docs_of(rows).select("doc_id", "text").toPandas(), df.toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    c.register("documents", documents), c.register("benchmark", benchmark)
    want = sorted(tuple(-1 if v is None else v for v in r) for r in c.execute(decontaminate.ORACLE_SQL).fetchall())
    assert got == want and len(got) == 6, (got, want)


@pytest.fixture(scope="module")
def restorer(spark):
    model = toxicity.language_model(spark.read.parquet(f"{DATA}/documents.parquet"))
    return toxicity.Restorer(toxicity._unpack(model))


@pytest.mark.parametrize("written", ["1d10t", "i d i o t", "idiiiiot", "i.d.i.o.t", "IDIOT!!!", "1 d 1 0 t", "ｉｄｉｏｔ", "idi0tttt", "i-d-i-o-t"])
def test_restored(restorer, written):
    assert "idiot" in restorer.words(f"the {written} was")


@pytest.mark.parametrize("written", ["y o u a r e a n i d i o t", "y o u  a r e  a n  i d i o t", "y.o.u.a.r.e.a.n.i.d.i.o.t", "w h a t a n 1 d 1 0 t"])
def test_words_within_a_run_are_restored(restorer, written):
    assert "idiot" in restorer.words(f"so, {written} then")


APART = ["i d i o t!", "xx i d i o t, you", "(i d i o t)", "i   d   i   o   t", "i\nd\ni\no\nt", "i\u00a0d\u00a0i\u00a0o\u00a0t", "i . d . i . o . t", "i, d, i, o, t", "i d i o t !", "i d ! o t?", "\"1 d 1 0 t\"", "i" + " " * 70 + "d i o t"]


@pytest.mark.parametrize("written", [*APART, "idi ot", "idi ot.", "id1 0t", "(idiot)", "!idiot!", "|1d10t|", "idio" + "o" * 55 + "t", "idio" + "o" * 70 + "t"])
def test_restored_whatever_stands_between_and_around(restorer, written):
    assert "idiot" in restorer.words(f"the {written} was")


@pytest.mark.parametrize("written", ["@$$", "he is an @$$!", "@ $ $", "$|!+"])
def test_signs_alone_are_read(restorer, written):
    assert all(w.isalpha() for w in restorer.words(written)) and restorer.words(written)


def test_readings_do_not_depend_on_what_is_kept(restorer):
    text = "an idi ot, 1d10t (idiot) of 10:30 and i d i o t!"
    small = toxicity.Restorer(type("Model", (), {"log": restorer.log}), 1)
    assert small.words("other text") and small.words(text) == restorer.words(text)
    assert restorer.words("10:30 2024-05-01 1, 2, 3, 4") == {"10:30", "2024-05-01", "1", "2", "3", "4"}


@pytest.mark.parametrize("token", ["1d10t", "a.b.c", "s-+a8", "w00t", "e33", "(l0ver", "p|g"])
def test_viterbi_finds_the_best_of_all_readings(restorer, token):
    size, log = toxicity.ALPHABET, restorer.log
    step = lambda context, code: float(log[context % size ** (toxicity.ORDER - 1), code])
    keep = size ** (toxicity.ORDER - 2)

    def readings(k, context, last):
        """(score, letters) of everything that the signs from k on can stand for."""
        if k == len(token):
            yield step(context, 0), ""
            return
        c = token[k]
        plain = c.isalnum() and not c.isdigit()
        choices = [(c, 0.0 if plain and c in toxicity._INDEX else toxicity.COST_KEEP_SIGN)] + [(x, toxicity.COST_STANDS) for x in toxicity.STANDS_FOR.get(c, "")]
        for x, cost in choices:
            code = toxicity._INDEX.get(x, size - 1)
            for score, rest in readings(k + 1, context % keep * size + code, x):
                yield score - cost + step(context, code), x + rest
            if x == last:
                for score, rest in readings(k + 1, context, last):
                    yield score - cost - toxicity.COST_COLLAPSE, rest
        if c in toxicity.SEPARATORS and 0 < k < len(token) - 1:
            for score, rest in readings(k + 1, context, last):
                yield score - toxicity.COST_SKIP, rest

    every = list(readings(0, 0, ""))
    best = max(score for score, _ in every)
    got = restorer.viterbi(token)
    assert max(score for score, letters in every if letters == got) == pytest.approx(best, abs=1e-4)


LETTERS_BEFORE = "theweatherwasniceyesterdayandtheysaidthatheisan"


@pytest.mark.parametrize("written", ["idi" + "o" * 90 + "t", "i" * 200 + "d1" + "0" * 50 + "t", ".".join(LETTERS_BEFORE + "idiot"), " ".join(LETTERS_BEFORE + "idiot"), "-".join(LETTERS_BEFORE + "1d10t")])
def test_long_tokens_and_runs_are_restored(restorer, written):
    assert "idiot" in restorer.words(f"so {written} then")


def test_plain_words_are_left_alone(restorer):
    assert restorer.words("The nation, of 1999 — ändern!") >= {"the", "nation", "of", "1999", "ändern"}
    assert restorer.words("") == set()


def test_toxicity_learns_from_its_folds_only(spark, docs_of):
    rows = [(i, prose(40, i) + (" vile" if i % 4 == 0 else "")) for i in range(400)] + [(1000, None), (1001, ""), (1002, prose(20, 5) + " v1le"), (1003, prose(20, 6) + " v i l e"), (None, "x"), (0, "vile")]
    labels = [(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (7, None)]
    flipped = [(i, 1 - t if t is not None and i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    run = lambda ls: [(r.doc_id, r.held_out, r.score, r.predicted) for r in toxicity.toxicity_scores(docs_of(rows), spark.createDataFrame(ls, "doc_id long, toxic int")).collect()]
    got = run(labels)
    assert len(got) == len(rows) and sorted(got, key=repr) == sorted(run(flipped), key=repr)
    for i, held, score, predicted in got:
        assert held == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= score <= 1 and predicted == int(score >= 0.5)
        assert predicted == int(i is not None and (i < 400 and i % 4 == 0 or i in (1002, 1003))), i
    none = toxicity.toxicity_scores(docs_of(rows), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.filter("predicted = 1").count() == 0


def test_quality_tells_prose_from_junk(spark):
    good = [(i, prose(80, i), "en") for i in range(300)]
    junk = [(1000 + i, " | ".join(prose(60, 500 + i).upper().split()), "en") for i in range(30)]
    rows = good + junk + [(2000, None, "en"), (2001, "", None), (2002, prose(80, 77), None), (2003, prose(80, 78), "xx")]
    labels = spark.createDataFrame([(i, 1) for i in range(200)] + [(None, 1), (1001, 0)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("bin", F.lit(1))
    kept = {r.doc_id: r.kept for r in quality.quality(df, labels).collect()}
    assert len(kept) == len(rows) and not any(kept[i] for i, _, _ in junk) and not kept[2000] and not kept[2001]
    assert sum(kept[i] for i in range(200, 300)) >= 95 and kept[2002] and kept[2003]
    assert quality.quality(df.limit(0), labels).count() == 0


COUNTS = [(0, 1, 5), (1, 2, 3), (1, 3, 1), (2, 1, 1), (3, 0, 2), (2, 3, 2), (0, 2, 1), (3, 1, 4)]


@pytest.mark.parametrize("most", [100, 5])
def test_kneser_ney_is_a_distribution(spark, most):
    model = quality.Model(*quality.kneser_ney(spark.createDataFrame(COUNTS, "a int, b int, n long"), 5, most))
    a, b = np.divmod(np.arange(25), 5)
    p = np.exp(model.log(a, b)).reshape(5, 5)
    assert p.sum(1) == pytest.approx(np.ones(5), abs=1e-5) and (p > 0).all() and len(model.cells) <= most


def test_kneser_ney_equals_the_formula(spark):
    model = quality.Model(*quality.kneser_ney(spark.createDataFrame(COUNTS, "a int, b int, n long"), 5))
    n = {(a, b): c for a, b, c in COUNTS}
    kinds = lambda k: max(1, sum(c == k for c in n.values()))
    follow = {b: sum(y == b for _, y in n) for b in range(5)}
    follow_kinds = lambda k: max(1, sum(c == k for c in follow.values()))

    def discount(of, c):
        y = of(1) / (of(1) + 2 * of(2))
        k = min(c, 3)
        return min(max(k - (k + 1) * y * of(k + 1) / of(k), 0.1), k - 0.05) if c else 0

    total = sum(follow.values())
    lower = {b: max(follow[b] - discount(follow_kinds, follow[b]), 0) / total + sum(discount(follow_kinds, c) for c in follow.values()) / total / 5 for b in range(5)}
    for a in range(4):
        row = {b: c for (x, b), c in n.items() if x == a}
        freed = sum(discount(kinds, c) for c in row.values())
        for b in range(5):
            c = row.get(b, 0)
            want = (c - discount(kinds, c) + freed * lower[b]) / sum(row.values())
            assert np.exp(model.log(np.array([a]), np.array([b])))[0] == pytest.approx(want, rel=1e-5), (a, b)


def test_bigrams_seen_once_take_half_the_room(spark):
    counts = spark.createDataFrame(COUNTS, "a int, b int, n long")
    ones = sum(n == 1 for *_, n in COUNTS)
    tables, others = quality.kneser_ney(counts, 5, len(COUNTS) - ones // 2, True)
    assert ones > 1 and others is None and len(tables[0]) == len(COUNTS) - ones and len(tables[4]) == ones
    before, after = (x.ravel() for x in np.divmod(np.arange(25), 5))
    assert quality.Model(*tables).log(before, after) == pytest.approx(quality.Model(*quality.kneser_ney(counts, 5)).log(before, after), rel=1e-6)
    for most in range(len(COUNTS) - ones, len(COUNTS) - ones // 2):
        tables, others = quality.kneser_ney(counts, 5, most, True)
        assert len(tables[4]) + (others.count() if others else 0) == ones


def test_quality_does_not_depend_on_the_bigrams_that_the_scan_holds(spark):
    rows = [(i, prose(40, i), "en") for i in range(150)] + [(200, None, "en"), (201, "one two", "en"), (7, prose(40, 7), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    whole, few, none = ({(r.doc_id, r.log_perplexity and round(r.log_perplexity, 5), r.kept) for r in quality.quality(df, labels, most=most).collect()} for most in (10**6, 200, 0))
    assert whole == few == none and len(whole) == 152


@pytest.mark.parametrize("seed, n", [(0, 1), (1, 40), (2, 3000)])
def test_patterns_cover_the_demand(seed, n):
    r = np.random.default_rng(seed)
    demand = dict(zip(*np.unique(r.integers(1, 65, n), return_counts=True), strict=True))
    patterns = packing.patterns_for({int(k): int(v) for k, v in demand.items()}, 64)
    filled: dict = {}
    for times, p in patterns:
        assert sum(s * c for s, c in p.items()) <= 64 and times > 0
        for s, c in p.items():
            filled[s] = filled.get(s, 0) + times * c
    assert filled == {int(k): int(v) for k, v in demand.items()}
    least = -(-sum(int(k) * int(v) for k, v in demand.items()) // 64)
    assert sum(t for t, _ in patterns) <= least * 1.03 + 3


def test_packing_round_trip(spark, docs_of):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["", None, "a", "déjà vu 😀\n\n  x", "<|endoftext|> in text", prose(1500, 3), " " * 50, *(prose(n, n) for n in range(1, 300, 7))]
    rows = [(i, x) for i, x in enumerate(texts)] + [(2, "a"), (None, "b")]
    got = packing.packed(docs_of(rows), sequence=256, with_ids=True).toPandas()
    for i, x in enumerate(texts):
        if i == 2:
            continue
        mine = got[got.doc_id == i].sort_values("start")
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        assert [y for p in mine.ids for y in p] == ids and set(mine.doc_tokens) == {len(ids)}
        assert [zlib.crc32(np.array(p, "<u4").tobytes()) for p in mine.ids] == list(mine.ids_crc32)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 256
    assert len(got[got.doc_id == 2]) == 2
    assert packing.packed(docs_of(rows).limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a = "</p>";</script></head><body>
<header class="site-header"><p>My site</p></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div id="cookie-banner"><p>We use cookies, please accept them.</p></div>
<main><article><h1>A &lt;real&gt;
 title</h1><p>First  para&nbsp;graph &amp; more<br>text. It is long enough, surely.<div class="ad">Buy now! Cheap.</div><p><b>Second<!-- no --> one.</b></p>
<ul><li>Item one<li>Item two</ul></article><section class="comments"><div class="comment"><p>Great post, I loved it. Really.</p></div></section></main>
<aside class="sidebar"><h3>More</h3><p>Side text, you know.</p></aside><form><label>Name</label><p>Fill this in.</p></form><footer>&copy; 2020 site. All rights.</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>open <i>text<p>two <a hr"), (None, "u", "no tags & all"), (1, "u", PAGE), (5, "u", "<div>" * 3000 + "deep enough, is it not. Yes.")]
    got = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.main_text(got).collect()]
    want = "A <real> title\nFirst para graph & more text. It is long enough, surely.\nSecond one.\nItem one\nItem two"
    assert (1, want, len(want)) in got and got.count((1, want, len(want))) == 2
    assert (2, "", 0) in got and (3, "", 0) in got and (4, "open text\ntwo", 13) in got and (None, "no tags & all", 13) in got and len(got) == 7


@pytest.mark.parametrize("tag", ["div", "body"])
def test_attributes_after_a_long_one(tag):
    nodes, _ = html_text.parse(f'<{tag} style="{"margin: 0; " * 100}" data-x="{"y" * 400}" class="cookie-banner"><p>text</p></{tag}>')
    assert next(n for n in nodes if n.tag == tag).words == ("cookie", "banner")


def test_marginals_equal_enumeration():
    model = html_text.default_model()
    nodes, _ = html_text.parse("<body><div class=menu><ul><li>a</ul></div><article><p>Some text, it is. Long enough.</p></article></body>")
    html_text._add_up(nodes)
    got = model.marginals(nodes)
    n, total, one = len(nodes), 0.0, [0.0] * len(nodes)
    for bits in range(2**n):
        x = [bits >> k & 1 for k in range(n)]
        e = -8.0 * (x[0] == 0) + sum(sum(model.ratio.get(f, 0.0) for f in html_text.features(v)) * x[k] for k, v in enumerate(nodes) if k)
        e += sum(model.step(nodes[v.parent], v)[x[v.parent]][x[k]] for k, v in enumerate(nodes) if k)
        total += (w := np.exp(e))
        for k in range(n):
            one[k] += w * x[k]
    assert got == pytest.approx([o / total for o in one], abs=1e-6)


def test_held_out_labelled_pages():
    model, right, all_ = html_text.default_model(), 0, 0
    for page in html_text.labelled_pages(60, seed=77):
        nodes, blocks = html_text.parse(page)
        for v in nodes[1:]:
            v.gold = nodes[v.parent].gold if v.gold is None else v.gold
        html_text._add_up(nodes)
        chance = model.marginals(nodes)
        right += sum(len(t) for k, t in blocks if (chance[k] >= 0.5) == (nodes[k].gold != 0))
        all_ += sum(len(t) for _, t in blocks)
    assert right / all_ > 0.95


def test_urls(spark):
    urls = ["http://Sub.Example.ORG/es/1?x", "https://example.org/en/12", "https://example.org/en/2", "http://notexample.org/es/", "http://a.com/de/x#y", "http://a.com/fr/", "http://a.com/en/", "http://net", "nothing", None, "", "http:///path", "x://h?q=/de/", "http://com/de/", "http://a.com/de", "http://É.org/", "a://b://c.org/x"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(0, urls[0], 1), (None, urls[1], 1)], "page_id long, url string, keys int")
    got = url_filter.judged(df, url_filter.RULES)
    con = duckdb.connect()
    pages = df.select("page_id", "url").toPandas()  # noqa: F841
    rows = con.execute(url_filter.ORACLE_SQL.replace("PARTITION BY page_id", "PARTITION BY page_id, url").replace("SELECT page_id, CASE WHEN url", "SELECT page_id, url, CASE WHEN url").replace("SELECT page_id, translate", "SELECT page_id, url, translate"))
    names = [x[0] for x in rows.description]
    want = sorted({tuple(r[names.index(c)] if r[names.index(c)] == r[names.index(c)] else None for c in got.columns) for r in rows.fetchall()}, key=repr)
    assert sorted({tuple(r) for r in got.collect()}, key=repr) == want and got.count() == len(urls) + 2
    assert url_filter.judged(df.limit(0), url_filter.RULES).count() == 0


@pytest.mark.parametrize("most_keys, parts", [(1_000_000, 1), (1_000, 3)])
def test_cascade_is_exact_over_its_universe(spark, most_keys, parts):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 20_000, 7).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = url_filter.Cascade(universe, listed, most_keys)
    assert len(cascade.levels) == parts and all(len(x) > 2 for x in cascade.levels)
    wrong = universe.filter(cascade.has(F.col("key")) != (F.substring("key", 2, 9).cast("int") % 7 == 0))
    assert wrong.count() == 0


def test_warc(spark):
    big = "x" * 1500 + "é\r\n\r\nWARC/1.1\r\n\r\n"
    rows = [(1, "http://a\r\nb", big), (2, None, big), (2, None, big), (3, "u", None), (None, "z", "small"), (4, "q", "small"), (5, "q", big + "1"), (6, "q", "y" * 999), (7, "q", "y" * 999), (8, "q", "y" * 1000), (9, "q", "y" * 1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.revisits_resolved(df).collect()), key=repr)
    of = lambda i, t, kind, to=None: (i, len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest(), kind, to)
    want = [of(1, big, "revisit", 2), of(2, big, "revisit", 2), of(2, big, "response"), of(8, "y" * 1000, "revisit", 9)]
    want += [of(i, t, "response") for i, _, t in rows if i in (None, 3, 4, 5, 6, 7, 9)]
    assert got == sorted(want, key=repr)
    assert warc.revisits_resolved(df.limit(0)).count() == 0


def test_warc_of_any_bytes(spark):
    payload = bytes(range(256)) * 5
    none = F.lit(None).cast("string")
    b = spark.createDataFrame([(payload,)], "p binary")
    v = warc.record(F.lit("response"), F.lit("<x>"), F.lit("u"), F.lit(7), F.sha1("p"), F.col("p").cast("string"), F.octet_length("p"), none, none)
    path = fresh_path(spark, "bytes")
    warc.write_archives(b.select(v.alias("value")), path)
    assert warc.read_archives(spark, path, True).first().payload == payload


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == names, name
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept <= {r.doc_id for r in docs.select("doc_id").collect()} and len(kept) > 0.5 * docs.count(), name
        docs = out
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, DATA).toPandas()
    docs = pieces.sort_values("start").groupby("doc_id")
    assert (docs.length.sum() == docs.doc_tokens.first()).all()
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert set(pieces.doc_id) <= set(texts)


def test_toxicity_does_not_depend_on_what_is_held_at_once(spark, docs_of, monkeypatch):
    rows = [(i, prose(30, i) + (" vrolumb" if i % 4 == 0 else "") + (" v r o l u m b" if i % 9 == 0 else " vr0lumb" if i % 11 == 0 else "")) for i in range(300)]
    df, labels = docs_of(rows), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    want = toxicity.toxicity_scores(df, labels).collect()
    sizes = []
    cells = toxicity.CharacterModel(np.arange(100), np.ones(100))
    monkeypatch.setattr(toxicity, "COUNTED", 50)
    monkeypatch.setattr(toxicity, "_unpack", lambda model: cells)
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows]), pa.array([i % 2 for i, _ in rows])], ["text", "toxic"])
    counted = Counter()
    for out in toxicity._feature_counts(None)(iter([batch])):
        sizes.append(len(out))
        for f, t, c in zip(*(out.column(k).to_pylist() for k in range(3)), strict=True):
            counted[f, 1] += t
            counted[f, 0] += c
    restorer, seen = toxicity.Restorer(cells), Counter()
    for i, t in rows:
        seen.update((f, i % 2) for f in toxicity.features(restorer.words(t)))
    assert +counted == +seen and max(sizes) < 600
    small = toxicity.Restorer(cells, 5)
    assert [small.words(t) for _, t in rows] == [restorer.words(t) for _, t in rows]
    assert len(want) == 300 and {r.predicted for r in want if r.doc_id % 4 == 0} == {1}


def test_the_character_model_needs_few_copies_of_its_cells():
    cells = np.random.default_rng(3).choice(toxicity.CELLS, 50_000, False)
    tracemalloc.start()
    log = toxicity.CharacterModel(cells, np.arange(50_000) % 40 + 1).log
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * log.nbytes and log.dtype == np.float32
    # every context's chances sum to 1
    assert np.exp(log[::997].astype(float)).sum(1) == pytest.approx(np.ones(len(log[::997])), abs=1e-5)
