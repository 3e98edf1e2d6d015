"""The scored cache as state, codebooks, assignment and versions of an index."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import codebooks as K
from lumenframe.operators import vector as V
from lumenframe.sources import index as I
from lumenframe.streaming.cache import ANSWER, EVENT, Cache, cache_fold, cache_stream, merged


def events(seed, videos=3, n=60):
    r = np.random.default_rng(seed)
    rows = []
    for v in range(videos):
        for s in range(n):
            kind = r.choice(["frame", "frame", "frame", "rank", "query"])
            vec = [float(x) for x in r.normal(size=3)] if kind != "rank" and r.random() < 0.9 else None
            rows.append((v, s, str(kind), int(r.integers(0, 12)), *(float(x) for x in r.random(4)), vec, 3))
    return rows


def test_cache_events_by_hand():
    c = Cache(2)
    c.admit(1, 0.5, 0, 0, [1.0, 0.0])
    c.admit(2, 0.4, 0, 0, [0.0, 1.0])
    c.admit(1, 0.6, 0, 0, [1.0, 0.0])
    assert (c.hits, c.misses, c.admitted, c.frames[1][5]) == (1, 2, 2, 0)
    c.admit(3, 0.1, 0, 0, None)  # 0.08 against frame 2's 0.17
    assert set(c.frames) == {1, 2} and c.misses == 3
    c.rank(3, 9.0)
    c.rank(2, 1.0)
    # 0.3 * 0.6 against 0.3 * 0.4 + 0.1 + 0.05, then the query adds 0.2 to frame 1
    assert [k for k, _ in c.ask([0.0, 0.0], 5)] == [2, 1]
    assert [(k, round(s, 6)) for k, s in c.ask([1.0, 0.0], 1)] == [(1, 0.38)]
    c.admit(4, 0.9, 1.0, 1.0, None)
    assert set(c.frames) == {1, 4}


def test_stream_equals_fold(spark, tmp_path):
    rows = events(1)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in range(3):  # three batches
            batch = spark.createDataFrame([r for r in rows if r[1] // 20 == part], EVENT)
            batch.coalesce(1).write.parquet(str(tmp_path / f"{part}"))
            os.makedirs(tmp_path / "in", exist_ok=True)
            name = next(x for x in os.listdir(tmp_path / f"{part}") if x.endswith(".parquet"))
            os.rename(tmp_path / f"{part}" / name, tmp_path / "in" / f"{part}.parquet")
            os.utime(tmp_path / "in" / f"{part}.parquet", (part + 1, part + 1))
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = cache_stream(stream, 4).writeStream.format("memory").queryName("held").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        got = {tuple(r) for r in spark.table("held").collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = {tuple(r) for r in cache_fold(spark.createDataFrame(rows, EVENT).repartition(5), 4).collect()}
    assert got == want and len(want) > 50


def test_events_of_three_tables(spark):
    f = spark.createDataFrame([(1, 0, 5, 0.5, 0.0, 0.0, [1.0, 0.0])], "video_id long, seq long, frame_idx long, action double, persistence double, entropy double, embedding array<double>")
    r = spark.createDataFrame([(1, 1, 5, 1.0), (1, 1, 6, 1.0)], "video_id long, seq long, frame_idx long, pagerank double")
    q = spark.createDataFrame([(1, 2, [1.0, 0.0], 2)], "video_id long, seq long, embedding array<double>, top_k int")
    got = cache_fold(merged(f, r, q), 4).collect()
    assert [(x.frame_idx, x.rank, round(x.keep_score, 9), x.context, x.hits, x.misses) for x in got] == [(5, 1, 0.5, 1, 0, 1)]
    assert cache_fold(merged(f.limit(0), r.limit(0), q), 4).schema.simpleString() == spark.createDataFrame([], ANSWER).schema.simpleString()
    assert cache_fold(merged(f.limit(0), r.limit(0), q), 4).collect() == []


def vectors(spark, n, dims=8, seed=0):
    r = np.random.default_rng(seed)
    spots = r.normal(size=(6, dims)) * 3
    return spark.createDataFrame([(i, [float(x) for x in spots[i % 6] + r.normal(size=dims) / 4]) for i in range(n)], "vec_id long, embedding array<double>")


def test_all_books_are_trained_at_once(spark):
    v = vectors(spark, 300)
    x = np.stack([r.embedding for r in v.orderBy("vec_id").collect()])
    books = K.trained(v.repartition(5), 4, 8, 15)
    assert books.shape == (4, 8, 2)
    for p in range(4):  # each centre is the mean of what is nearest to it, or keeps its place without any
        piece = x[:, 2 * p : 2 * p + 2]
        near = ((piece[:, None] - books[p]) ** 2).sum(-1).argmin(1)
        cost = ((piece - books[p][near]) ** 2).sum()
        better = np.stack([piece[near == c].mean(0) if (near == c).any() else books[p][c] for c in range(8)])
        assert cost <= ((piece - better[near]) ** 2).sum() * 1.05
    assert np.allclose(books, K.trained(v.repartition(1), 4, 8, 15))
    assert K.trained(v.limit(0)) is None
    with pytest.raises(ValueError):
        K.trained(v, 3)


def test_code_search_equals_brute_force(spark):
    v, q = vectors(spark, 200), vectors(spark, 5, seed=3).withColumnsRenamed({"vec_id": "query_id", "embedding": "q"})
    books = K.trained(v, 4, 8, 5)
    got = {(r.query_id, r.rank): r.vec_id for r in K.pq_topk(v.repartition(6), q, books, 4).collect()}
    rows = v.collect()
    for a in q.collect():
        code = K._codes(np.stack([r.embedding for r in rows]), books)
        near = [(round(float(sum(((np.array(a.q).reshape(4, 2)[p] - books[p][code[i, p]]) ** 2).sum() for p in range(4))), 9), r.vec_id) for i, r in enumerate(rows)]
        assert [got[a.query_id, k + 1] for k in range(4)] == [i for _, i in sorted(near)[:4]]


def test_training_gate(spark):
    q = vectors(spark, 2, seed=3).withColumnsRenamed({"vec_id": "query_id", "embedding": "q"})
    for n, kind in ((15, "flat"), (16, "pq")):
        assert {r.kind for r in K.gated_search(vectors(spark, n), q, 4, 4, 10).collect()} == {kind}
    assert {r.kind for r in K.gated_search(vectors(spark, 99), q, 4, 4, 100).collect()} == {"flat"}
    v = vectors(spark, 400)
    exact = V.tiered_exact(v.withColumn("tier", F.lit("x")), q, 5)
    assert all(0 <= r.recall <= 1 for r in K.recall_at(K.gated_search(v, q, 4, 6), exact).collect())
    assert {r.recall for r in K.recall_at(exact, exact).collect()} == {1.0}


@pytest.mark.parametrize("k", range(1, 7))
def test_assignment_equals_enumeration(k):
    r = np.random.default_rng(k)
    for n in (k, k + 1, k + 2):
        for cost in (r.random((k, n)), r.integers(0, 3, (k, n)).astype(float)):
            at = K.assigned(cost)
            assert len(set(at)) == k
            assert cost[np.arange(k), at].sum() == pytest.approx(min(sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(n), k)))


def test_diverse_frames(spark):
    r = np.random.default_rng(2)
    rows = [(1, i, [float(i // 30), float(r.random() / 50)]) for i in range(120)] + [(2, i, None) for i in range(10)] + [(3, i, [0.0, 0.0]) for i in range(2)]
    got = K.diverse_frames(spark.createDataFrame(rows, "video_id long, frame_idx long, clip_embedding array<double>"), 4).collect()
    of = {v: sorted(x.frame_idx for x in got if x.video_id == v) for v in (1, 2, 3)}
    assert [f // 30 for f in of[1]] == [0, 1, 2, 3] and of[2] == [0, 2, 5, 7] and of[3] == [0, 1]
    assert {x.is_fill for x in got if x.video_id == 2} == {True}


def test_versions_of_an_index(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    frames = spark.createDataFrame([(v, i, float(i), None if i == 1 else 2.0) for v in (1, 2) for i in range(4)], "video_id long, frame_idx long, timestamp double, packet_size double")
    edges = spark.createDataFrame([(1, 0, 1, 0.5), (2, 2, 3, 0.7), (2, 2, 9, 0.1)], "video_id long, src long, dst long, weight double")
    old = I.write_index(frames, edges, at, {"graph_mode": "flat"}, 2)
    f, e, config = I.read_index(spark, at)
    assert config == {"graph_mode": "flat"} and I.parity(edges.filter("dst < 9"), e).isEmpty()
    assert {(r.codec_conf, r.scene_id, r.pict_type) for r in f.collect()} == {(0.5, -1, "?")} and {r.packet_size for r in f.collect()} == {0.0, 2.0}
    diff = I.parity(frames.fillna(0.0), f.select("video_id", "frame_idx", "timestamp", "packet_size"))
    assert diff.isEmpty()
    new = I.write_index(frames.filter("video_id = 1"), edges, at, {"graph_mode": "scene_sparse"}, 2)
    assert I.current(spark, at)["version"] == new != old
    assert I.read_index(spark, at)[0].count() == 4 and I.read_index(spark, at, old)[0].count() == 8
    lost = I.parity(I.read_index(spark, at, old)[0], I.read_index(spark, at)[0])
    assert {(r.side, r.video_id, r.copies) for r in lost.collect()} == {("first", 2, 1)}
    # a part that is replaced is found
    part = next(p for p in sorted((tmp_path / "index" / "versions" / new / "edges").glob("*.parquet")))
    other = next(p for p in sorted((tmp_path / "index" / "versions" / old / "frames").glob("*.parquet")))
    part.write_bytes(other.read_bytes())
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    assert [r.part for r in I.damaged(spark, at).collect()] == ["edges"]
    with pytest.raises(ValueError, match="not what was written"):
        I.read_index(spark, at)
