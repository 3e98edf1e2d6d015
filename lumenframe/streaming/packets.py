"""Streams: windowed packet energy with late data, and the scored cache as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def packet_energy(packets: DataFrame, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Energy of packets(video_id, ts, size) per tumbling window; packets later than `late` are dropped."""
    return packets.withWatermark("ts", late).groupBy("video_id", F.window("ts", width)).agg(F.sum("size").alias("energy"), F.count(F.lit(1)).alias("packets")).select("video_id", F.col("window.start").alias("start"), "energy", "packets")


def cached(frames: DataFrame, capacity: int) -> DataFrame:
    """ST1 on a stream of frames(video_id, frame_idx, score): state is the cache of a video, at most `capacity`
    rows; every batch yields the rows it admitted."""

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ids, scores, places, n = state.get if state.exists else ([], [], [], 0)
        held = {i: (s, p) for i, s, p in zip(ids, scores, places, strict=True)}
        new = []
        for g in batches:
            for frame, score in g.sort_values("frame_idx")[["frame_idx", "score"]].itertuples(index=False):
                if frame in held:
                    held[frame] = (score, held[frame][1])
                    continue
                if len(held) >= capacity:
                    low = min(held, key=lambda k: (held[k][0], k))
                    if score <= held[low][0]:
                        continue
                    del held[low]
                held[frame] = (score, n)
                new.append((key[0], frame, score, n))
                n += 1
        state.update((list(held), [s for s, _ in held.values()], [p for _, p in held.values()], n))
        yield pd.DataFrame(new, columns=["video_id", "frame_idx", "score", "admitted_at"])

    state = "ids array<long>, scores array<double>, places array<long>, n long"
    return frames.groupBy("video_id").applyInPandasWithState(admit, "video_id long, frame_idx long, score double, admitted_at long", state, "append", GroupStateTimeout.NoTimeout)
