"""Streams that remember: frames brought into order across batches, and a pool that swaps its entries.

Both keep their state in the state store, by video or by pool, so a query that is stopped goes on from
its checkpoint with the same frames and entries. They need the RocksDB store, which :func:`ready` asks
for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ready(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _InOrder(StatefulProcessor):
    """Frames of a video leave in the order of their numbers, each once; those that come early wait."""

    def __init__(self, first: int):
        self.first = first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "n long")
        self.waiting = handle.getMapState("waiting", "frame_idx long", "content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.next.get()[0] if self.next.exists() else self.first
        for batch in rows:
            for i, content in zip(batch["frame_idx"].tolist(), batch["content"].tolist(), strict=True):
                # what has left, or waits already, is a repeat
                if i >= n and not self.waiting.containsKey((i,)):
                    self.waiting.updateValue((i,), (content,))
        out = []
        while self.waiting.containsKey((n,)):
            out.append((key[0], n, self.waiting.getValue((n,))[0]))
            self.waiting.removeKey((n,))
            n += 1
        self.next.update((n,))
        yield pd.DataFrame(out, columns=["video_id", "frame_idx", "content"]).astype({"video_id": "int64", "frame_idx": "int64"})

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, first: int = 0) -> DataFrame:
    """Frames (video_id, frame_idx, content) of a stream in order and without gaps or repeats, whatever batches they come in.

    A frame leaves with the batch that closes the gap before it; frames behind a gap that is never closed stay in the state."""
    ready(stream.sparkSession)
    rows = stream.select(F.col("video_id").cast("long").alias("video_id"), F.col("frame_idx").cast("long").alias("frame_idx"), F.col("content").cast("string").alias("content"))
    return rows.groupBy("video_id").transformWithStateInPandas(_InOrder(first), "video_id long, frame_idx long, content string", "Append", "None")


class _Pool(StatefulProcessor):
    def __init__(self, size: int, seed: int):
        self.size, self.seed = size, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")
        self.slots = handle.getMapState("slots", "slot long", "item string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.seen.get()[0] if self.seen.exists() else 0
        out = []
        arrived = sorted((r for batch in rows for r in zip(batch["place"].tolist(), batch["item"].tolist(), strict=True)))
        for _, item in arrived:
            if n < self.size:
                self.slots.updateValue((n,), (item,))
                out.append((key[0], n, item, item))
            else:
                # the same draw for the same arrival, however arrivals fall into batches
                slot = int(np.random.default_rng([self.seed, int(key[0]), n]).integers(self.size))
                out.append((key[0], n, item, self.slots.getValue((slot,))[0]))
                self.slots.updateValue((slot,), (item,))
            n += 1
        self.seen.update((n,))
        yield pd.DataFrame(out, columns=["pool", "arrival", "entered", "left"]).astype({"pool": "int64", "arrival": "int64"})

    def close(self) -> None:
        pass


def pooled(stream: DataFrame, size: int, pools: int = 1, seed: int = 0) -> DataFrame:
    """(pool, arrival, entered, left) of items (place, item): a pool keeps ``size`` items. While it fills, every item leaves at once
    as well; once it is full, an item that enters takes the slot of a random entry, which leaves in its place.

    Items are dealt to pools by a hash of their place, so that pools work side by side."""
    ready(stream.sparkSession)
    rows = stream.select(F.pmod(F.xxhash64("place"), F.lit(pools)).alias("pool"), F.col("place").cast("long").alias("place"), F.col("item").cast("string").alias("item"))
    return rows.groupBy("pool").transformWithStateInPandas(_Pool(size, seed), "pool long, arrival long, entered string, left string", "Append", "None")
