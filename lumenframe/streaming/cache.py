"""The scored cache of a video as state that frames, ranks and queries change (ST1 to ST3, A37), on a stream or as a batch fold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Weights of action, query similarity, persistence, PageRank, entropy, Hessian, recency.
WEIGHTS = (0.30, 0.20, 0.15, 0.10, 0.10, 0.10, 0.05)
EVENT = "video_id long, seq long, kind string, frame_idx long, action double, persistence double, entropy double, pagerank double, embedding array<double>, top_k int"
ANSWER = "video_id long, seq long, rank long, frame_idx long, keep_score double, context long, hits long, misses long"
_FRAME = "action double, persistence double, entropy double, pagerank double, similarity double, admitted long, embedding array<double>"


class Cache:
    """One video's frames: what each event does to them. A frame is [action, persistence, entropy, pagerank, similarity, admitted, embedding]."""

    def __init__(self, capacity: int, frames: dict[int, list] | None = None, admitted: int = 0, hits: int = 0, misses: int = 0):
        self.capacity, self.frames, self.admitted, self.hits, self.misses = capacity, frames or {}, admitted, hits, misses
        self.touched: set[int] = set()

    def score(self, f: list) -> float:
        last = max(self.admitted - 1, 1)
        recency = min(max(1 - (self.admitted - 1 - f[5]) / last, 0.0), 1.0)
        return sum(w * x for w, x in zip(WEIGHTS, (f[0], f[4], f[1], f[3], f[2], 0.0, recency), strict=True))

    def admit(self, frame: int, action: float, persistence: float, entropy: float, embedding: list | None) -> None:
        """ST1: a known frame is a hit and refreshed in its place; a full cache evicts its lowest score just if the newcomer's is higher."""
        new = [action, persistence, entropy, 0.0, 0.0, self.admitted, embedding]
        if frame in self.frames:
            self.hits += 1
            new[5] = self.frames[frame][5]
        else:
            self.misses += 1
            if len(self.frames) >= self.capacity:
                low = min(self.frames, key=lambda k: (self.score(self.frames[k]), self.frames[k][5]))
                if self.score(new) <= self.score(self.frames[low]):
                    return
                del self.frames[low]
                self.touched.add(low)
            self.admitted += 1
        self.frames[frame] = new
        self.touched.add(frame)

    def rank(self, frame: int, pagerank: float) -> None:
        """ST3: a pushed PageRank; frames that are not held are ignored."""
        if frame in self.frames:
            self.frames[frame][3] = pagerank
            self.touched.add(frame)

    def ask(self, query: list | None, top_k: int) -> list[tuple[int, float]]:
        """ST2: every held frame keeps its similarity to the query, within 0..1, and the best by score answer (ties: admitted first)."""
        q = np.asarray(query if query is not None else [], float)
        for k, f in self.frames.items():
            e = np.asarray(f[6] if f[6] is not None else [], float)
            lengths = np.linalg.norm(q), np.linalg.norm(e)
            f[4] = float(np.clip(q @ e / (lengths[0] * lengths[1]), 0, 1)) if len(q) and len(q) == len(e) and min(lengths) >= 1e-8 else 0.0
            self.touched.add(k)
        best = sorted(self.frames, key=lambda k: (-self.score(self.frames[k]), self.frames[k][5]))
        return [(k, self.score(self.frames[k])) for k in best[:top_k]]

    def apply(self, events: pd.DataFrame) -> list[tuple]:
        """The answers to a video's events, in their order."""
        out = []
        for e in events.sort_values("seq").itertuples(index=False):
            if e.kind == "frame":
                self.admit(int(e.frame_idx), float(e.action), float(e.persistence), float(e.entropy), None if e.embedding is None else [float(x) for x in e.embedding])
            elif e.kind == "rank":
                self.rank(int(e.frame_idx), float(e.pagerank))
            elif e.kind == "query":
                answer = self.ask(e.embedding, int(e.top_k))
                out += [(int(e.video_id), int(e.seq), n + 1, k, s, len(self.frames), self.hits, self.misses) for n, (k, s) in enumerate(answer)]
            else:
                raise ValueError(f"unknown event {e.kind}")
        return out


_COLUMNS = [c.split()[0] for c in ANSWER.split(", ")]


def cache_fold(events: DataFrame, capacity: int) -> DataFrame:
    """Answers to the queries among a video's events(EVENT), folded in order of seq. Order decides, so a video is one group; what it holds besides its events is `capacity` frames."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(Cache(capacity).apply(g), columns=_COLUMNS)

    return events.groupBy("video_id").applyInPandas(one, ANSWER)


class _Held(StatefulProcessor):
    """Frames in a MapState, so that an event rewrites the frames it touches alone; counters in a ValueState. A video without events for
    `idle_ms` is forgotten."""

    def __init__(self, capacity: int, idle_ms: int | None):
        self.capacity, self.idle_ms = capacity, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getMapState("frames", "frame_idx long", _FRAME)
        self.counts = handle.getValueState("counts", "admitted long, hits long, misses long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {int(k[0]): [*(float(x) for x in v[:5]), int(v[5]), None if v[6] is None else list(v[6])] for k, v in self.frames.iterator()} if self.frames.exists() else {}
        before = set(held)
        cache = Cache(self.capacity, dict(sorted(held.items(), key=lambda x: x[1][5])), *(int(x) for x in (self.counts.get() if self.counts.exists() else (0, 0, 0))))
        answers = cache.apply(pd.concat(list(rows)))
        for k in cache.touched:
            if k in cache.frames:
                self.frames.updateValue((k,), tuple(cache.frames[k]))
            elif k in before:
                self.frames.removeKey((k,))
        self.counts.update((cache.admitted, cache.hits, cache.misses))
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(answers, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.frames.clear()
        self.counts.clear()
        return iter([])

    def close(self) -> None:
        pass


def cache_stream(events: DataFrame, capacity: int, idle_ms: int | None = None) -> DataFrame:
    """cache_fold() on a stream of events: frames, ranks and queries may be streams of their own, united by name. Events of a video
    have to arrive in order of seq between batches; within a batch they are sorted. Needs the RocksDB state store. With `idle_ms` timers
    are pending while a video is held, so such a stream runs on a processing-time trigger (an availableNow one waits for them)."""
    return events.groupBy("video_id").transformWithStateInPandas(_Held(capacity, idle_ms), ANSWER, "append", "ProcessingTime" if idle_ms is not None else "None")


def merged(frames: DataFrame, ranks: DataFrame, queries: DataFrame) -> DataFrame:
    """Events of frames(video_id, seq, frame_idx, action, persistence, entropy, embedding), ranks(video_id, seq, frame_idx, pagerank) and
    queries(video_id, seq, embedding, top_k)."""

    def of(df: DataFrame, kind: str) -> DataFrame:
        names = [c.split() for c in EVENT.split(", ")]
        return df.select(*[F.lit(kind).alias("kind") if n == "kind" else (F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in names])

    return of(frames, "frame").unionByName(of(ranks, "rank")).unionByName(of(queries, "query"))
