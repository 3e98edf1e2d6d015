"""MinHash, embeddings, passages and components against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from lumenframe.llm import embedding_dedup, minhash, substring_dedup
from lumenframe.llm.common import mixed
from lumenframe.llm.components import connected
from lumenframe.llm.embedding_dedup import near_vectors

from .conftest import components, edited, links_of, prose, shingles


def test_components_of_a_chain_a_ring_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)]
    df = spark.createDataFrame(edges + edges, "a long, b long")
    got = {r.node: r.component for r in connected(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert connected(df.filter("a > 1000")).count() == 0


def test_near_duplicates_equal_brute_force(spark, docs_of):
    base = prose(150, 1)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE two"), (5, "one"), (6, "a b c d e"), (7, "A b\tc d\ne")]
    rows += [(10 + k, edited(base, every, k)) for k, every in enumerate([1000, 150, 90, 70, 60, 50, 45, 40, 30, 20, 10] * 6)]
    rows += [(200 + k, base) for k in range(5)] + [(300 + k, prose(60, 900 + k)) for k in range(20)] + [(400, prose(9000, 5)), (401, edited(prose(9000, 5), 300, 3)), (10, rows[8][1]), (None, base)]
    texts = {i: t for i, t in rows if i is not None}
    sets = {i: shingles(t) for i, t in texts.items()}
    want = components(sets, links_of(sets, 85))
    got = minhash.near_duplicates(docs_of(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id), r
    assert minhash.near_duplicates(docs_of(rows).limit(0)).count() == 0


@pytest.mark.parametrize("percent, equal", [(80, 74), (85, 82)])
def test_tiles_keep_pairs_whose_minima_fall_short_by_chance(percent, equal):
    # at the threshold, so few equal minima or fewer have a chance of about 1e-6
    x = np.arange(minhash.MINIMA, dtype=np.uint32)
    y = np.where(x < equal, x, x + 1000).astype(np.uint32)
    parts = minhash.part_sizes(x.astype(np.uint64)).tobytes()
    rows = [(1, 0, 0, 0, 0, d, d, s.tobytes(), 100, 0, parts) for d, s in ((5, x), (9, y))]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], "key i j band tile doc comp sig n own parts".split())
    assert [b.to_pylist() for b in minhash._tiles(percent)([batch])] == [[{"a": 5, "b": 9}]]


def test_near_dedup_stage_keeps_columns_and_one_of_each_group(spark, docs_of):
    docs = docs_of([(1, prose(80, 1)), (2, prose(80, 1)), (3, edited(prose(80, 1), 80, 1)), (4, prose(80, 2)), (None, None)])
    out = minhash.stage_near_dedup(spark, docs, DATA)
    assert out.columns == docs.columns and sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 4]


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(30, 16))
    rows, n = [], 0
    for k in range(400):
        v = base[k % 30] + r.normal(size=16) * r.choice([0.01, 0.05, 0.1, 0.2])
        rows.append((n, [float(np.float32(x)) for x in v * r.uniform(0.5, 3)], int(k % 3)))
        n += 1
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] + [1.0] * 15, 1), (n + 3, [None] + [1.0] * 15, 1), (n + 4, [float("inf")] + [1.0] * 15, 1), (n + 5, rows[0][1], None), (n + 6, rows[0][1], rows[0][2]), (n + 7, [1.0, 2.0], 1), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("block", F.lit(1)).withColumn("v", F.lit(2))
    good = {i: (np.array(v, float), l) for i, v, l in rows if l is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    ids = list(good)
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            (u, l), (w, m) = good[a], good[b]
            if l == m and len(u) == len(w) and u @ w / np.sqrt((u @ u) * (w @ w)) >= 0.98:
                links.append((a, b))
    count = {i: sum(i in p for p in links) for i in {r[0] for r in rows}}
    want = components({r[0] for r in rows}, links)
    for tile in (1000, 20):  # labels joined in one task; dealt by block, cells and tiles
        got = near_vectors(df, block=4, axes=3, tile=tile).collect()
        assert len(got) == len(rows)
        for g in got:
            assert (g.n_links, g.component_id, g.kept) == (count[g.vec_id], want[g.vec_id], want[g.vec_id] == g.vec_id), (tile, g)
    assert near_vectors(df.limit(0)).count() == 0


def test_few_pairs_of_vectors_meet(spark):
    rows = spark.read.parquet(f"{DATA}/../sf0.1/embeddings.parquet").toPandas()
    met = every = 0
    for _, group in rows.groupby("label"):
        raw = np.array(group["embedding"].tolist(), "f4")
        y = embedding_dedup.unit(raw) @ embedding_dedup.rotation(raw.shape[1])
        blocks = embedding_dedup._blocks(raw.shape[1], embedding_dedup.BLOCK)
        for lo, hi in blocks:
            met += sum(len(i) for i, _ in embedding_dedup.grid_pairs(y[:, lo:hi], (0.04 * (hi - lo) / raw.shape[1]) ** 0.5, embedding_dedup.AXES))
        every += len(raw) * (len(raw) - 1) // 2
    print(f"pairs met {met} of {every}")
    assert met < 0.2 * every


@pytest.mark.parametrize("least", [3, 7])
def test_compact_windows_are_the_wide_ranges_of_each_minimum(least):
    r = np.random.default_rng(0)
    tokens = [r.integers(0, 12, n).astype(np.uint64) for n in (0, 2, 3, 9, 40, 25)]
    key, doc, h, left, centre, right = substring_dedup.compact_windows(tokens, least, 2)
    want = set()
    for d, t in enumerate(tokens):
        for k in range(2):
            v = mixed(t * substring_dedup._A[k] + substring_dedup._B[k]) | np.uint64(1)
            for i in range(len(v)):
                a = b = i
                while a > 0 and v[a - 1] >= v[i]:
                    a -= 1
                while b + 1 < len(v) and v[b + 1] >= v[i]:
                    b += 1
                if b - a + 1 >= least:
                    want.add((int(v[i].view(np.int64)), d, k, a, b))
    assert set(zip(key.tolist(), doc.tolist(), h.tolist(), left.tolist(), right.tolist(), strict=True)) == want and len(key) == len(want)


def test_repeated_passages(spark, docs_of):
    passage = prose(70, 9)
    near = edited(passage, 35, 1)
    rows = [(1, prose(200, 1) + " " + passage + " " + prose(90, 2)), (2, prose(30, 3) + "\n" + passage + "\t" + prose(300, 4)), (3, near + " " + prose(100, 5)), (4, prose(400, 6)), (5, " ".join(passage.split()[:40]) + " " + prose(100, 7)), (6, None), (7, ""), (8, "the " * 900), (9, passage), (9, passage), (None, passage), (10, prose(5000, 8))]
    got = substring_dedup.repeated_passages(docs_of(rows)).collect()
    words = {i: (t or "").encode().lower().split() for i, t in rows if i is not None}
    for r in got:
        a, b = shingles(None, words=words[r.doc_id][r.start_word : r.end_word]), shingles(None, words=words[r.source_doc_id][r.source_start : r.source_end])
        assert r.source_doc_id < r.doc_id and len(a & b) / len(a | b) == pytest.approx(r.similarity) and r.similarity >= 0.8
    assert {r.doc_id for r in got} == {2, 3, 9} and {r.source_doc_id for r in got} <= {1, 2, 3}
    for i in (2, 9):
        assert any(r.doc_id == i and r.end_word - r.start_word >= 70 for r in got)
    assert substring_dedup.repeated_passages(docs_of(rows).limit(0)).count() == 0


@pytest.mark.parametrize("step", ["_chunks", "_short_tokens"])
def test_passages_hand_few_texts_at_once_to_a_worker(spark, monkeypatch, step):
    real = getattr(substring_dedup, step)

    def few(batches):
        for batch in batches:
            assert batch.num_rows <= 1000
            yield batch

    def checked(*args):  # of _chunks the rows, of the others a function of them
        return real(few(args[0]), *args[1:]) if step == "_chunks" else lambda batches: real(*args)(few(batches))

    monkeypatch.setattr(substring_dedup, step, checked)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    same = prose(60, 5)
    rows = spark.range(0, 1300, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit(same + " "), F.col("id").cast("string")).alias("text"))
    assert substring_dedup.repeated_passages(rows).count() >= 1299
    assert spark.conf.get(key) == before


def test_near_passages_of_least_length_equal_brute_force(spark, docs_of):
    rows = []
    for k in range(400):  # 50 words with one changed (0.804), or 51 with one missing (0.824)
        words = [f"w{k}x{i}" for i in range(50 if k % 2 else 51)]
        near = words[:]
        if k % 2:
            near[10 + k % 30] = "other"
        else:
            del near[10 + k % 30]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(near))]
    sets = {i: shingles(t) for i, t in rows}
    want = {(i, i - 1) for i in range(1, 800, 2) if len(sets[i] & sets[i - 1]) >= 0.8 * len(sets[i] | sets[i - 1])}
    lost = want - {(r.doc_id, r.source_doc_id) for r in substring_dedup.repeated_passages(docs_of(rows)).collect()}
    assert len(want) == 400 and not lost, (len(want), len(lost))


def test_passage_of_frequent_lines(spark, docs_of):
    rows = []
    for k in range(8):
        lines = [prose(14, 7000 + 10 * k + i) for i in range(5)]
        rows += [(1000 + k, prose(60, 8000 + k) + " " + " ".join(lines) + " " + prose(60, 8100 + k)), (2000 + k, prose(60, 8200 + k) + " " + " ".join(lines) + " " + prose(60, 8300 + k))]
        for i, line in enumerate(lines):  # each line alone in earlier and later documents
            rows += [(base + 100 * k + 10 * i + m, prose(50, base + 9000 + 100 * k + 10 * i + m) + " " + line + " " + prose(50, base + 20000 + 100 * k + 10 * i + m)) for base in (0, 50000) for m in range(3)]
    got = substring_dedup.repeated_passages(docs_of(rows)).collect()
    assert {(r.doc_id, r.source_doc_id) for r in got} == {(2000 + k, 1000 + k) for k in range(8)}
    assert all(r.similarity == 1.0 and r.end_word - r.start_word >= 50 for r in got)


@pytest.mark.parametrize(("before", "after", "piece"), [(6, 6, 45), (30, 30, 30), (15, 15, 42), (30, 30, 45)])
def test_passage_whose_pieces_strangers_have(spark, docs_of, before, after, piece):
    """Earlier and later documents hold pieces of a passage that are too short to be passages, and so all of its minima."""
    rows = []
    for k in range(15):
        passage = prose(60, 100 + k).split()
        for m in range(before + after):
            at = (7 * m + k) % (60 - piece + 1)
            rows.append((1000 * (k + 1) + m + (500 if m >= before else 0), " ".join([prose(40, 10**6 + 1000 * k + m), *passage[at : at + piece], prose(40, 2 * 10**6 + 1000 * k + m)])))
        rows += [(1000 * (k + 1) + 400 + c, " ".join([prose(50, 3 * 10**6 + 10 * k + c), *passage, prose(50, 4 * 10**6 + 10 * k + c)])) for c in (0, 1)]
    got = substring_dedup.repeated_passages(docs_of(rows)).collect()
    found = {(r.doc_id, r.source_doc_id) for r in got if r.similarity == 1.0 and r.end_word - r.start_word >= 50}
    assert found >= {(1000 * (k + 1) + 401, 1000 * (k + 1) + 400) for k in range(15)}
    assert {(r.doc_id % 1000, r.source_doc_id % 1000) for r in got} <= {(401, 400)}


def test_substring_stage_cuts_the_later_copies(spark, docs_of):
    passage, a, b = prose(70, 9), prose(60, 1), prose(60, 2)
    docs = docs_of([(1, f"{a} {passage}"), (2, f"{b}\n {passage} end é"), (3, None), (None, passage)])
    out = {r.doc_id: r.text for r in substring_dedup.stage_substring_dedup(spark, docs, DATA).collect()}
    assert out == {1: f"{a} {passage}", 2: f"{b}\n end é", 3: None, None: passage}
