"""Frames in order and pools across batches, and after a restart."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from gridloom.streaming import frames, stateful

FRAMES = "video_id long, frame_idx long, content string"


def arrive(spark, folder, batches, schema):
    """Files that are taken one a batch, in order of their times."""
    os.makedirs(f"{folder}/in", exist_ok=True)
    for rows in batches:
        k = len(os.listdir(f"{folder}/in"))
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/tmp{k}")
        name = next(n for n in os.listdir(f"{folder}/tmp{k}") if n.startswith("part"))
        os.rename(f"{folder}/tmp{k}/{name}", f"{folder}/in/{k:03d}.parquet")
        os.utime(f"{folder}/in/{k:03d}.parquet", (1_700_000_000 + 60 * k,) * 2)


def run(spark, folder, schema, work, name):
    """Everything that is new in the folder, one file a batch, from the checkpoint of before."""
    stream = frames.arriving(spark, f"{folder}/in", schema, files=1)
    query = work(stream).writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.read.parquet(f"{folder}/{name}")


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_frames_leave_in_order(spark, tmp_path):
    rng = random.Random(7)
    rows = [(v, i, f"{v}-{i}") for v in (1, 2, 3) for i in range(12)]
    rng.shuffle(rows)
    rows += rows[:5]  # frames that come twice
    batches = [rows[:10], rows[10:25], rows[25:]]
    folder = str(tmp_path)
    arrive(spark, folder, batches[:2], FRAMES)
    first = run(spark, folder, FRAMES, stateful.in_order, "out").collect()
    have = {(v, i) for v, i, _ in rows[:25]}
    ready = {(v, i) for v in (1, 2, 3) for i in range(next(k for k in range(13) if (v, k) not in have))}
    assert {(r["video_id"], r["frame_idx"]) for r in first} == ready and len(first) == len(ready)
    # a new query goes on from the checkpoint: what waited leaves once its gap is closed, and nothing leaves twice
    arrive(spark, folder, batches[2:], FRAMES)
    every = run(spark, folder, FRAMES, stateful.in_order, "out").collect()
    assert sorted((r["video_id"], r["frame_idx"], r["content"]) for r in every) == sorted(set(rows))


def test_another_order_of_arrival_gives_the_same_frames(spark, tmp_path):
    rows = [(1, i, str(i)) for i in range(9)]
    for k, order in enumerate((rows, rows[::-1])):
        arrive(spark, f"{tmp_path}/{k}", [order[:3], order[3:6], order[6:]], FRAMES)
    out = [sorted(map(tuple, run(spark, f"{tmp_path}/{k}", FRAMES, stateful.in_order, "out").collect())) for k in (0, 1)]
    assert out[0] == out[1] == rows


def test_pool(spark, tmp_path):
    schema = "place long, item string"
    items = [(i, f"item{i}") for i in range(60)]
    arrive(spark, f"{tmp_path}/a", [items[:7], items[7:30]], schema)
    work = lambda s: stateful.pooled(s, 8, seed=3)
    run(spark, f"{tmp_path}/a", schema, work, "out")
    arrive(spark, f"{tmp_path}/a", [items[30:]], schema)
    got = sorted(run(spark, f"{tmp_path}/a", schema, work, "out").collect(), key=lambda r: r["arrival"])
    assert [r["entered"] for r in got] == [i for _, i in items]
    assert all(r["entered"] == r["left"] for r in got[:8])
    # what leaves a full pool was in it, and is not any more
    pool = {r["entered"] for r in got[:8]}
    for r in got[8:]:
        assert r["left"] in pool
        pool = pool - {r["left"]} | {r["entered"]}
    assert len(pool) == 8 and sum(r["left"] != r["entered"] for r in got) == 52
    # the same arrivals in other batches leave the same entries
    arrive(spark, f"{tmp_path}/b", [items[:30], items[30:31], items[31:]], schema)
    again = sorted(run(spark, f"{tmp_path}/b", schema, work, "out").collect(), key=lambda r: r["arrival"])
    assert [r["left"] for r in again] == [r["left"] for r in got]


def test_late_events_are_dropped(spark, tmp_path):
    """A window is finished once the watermark has passed it; what comes for it later counts nowhere."""
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    schema = "ts timestamp, event_type string"
    batches = [[(at(1), "a"), (at(1, 30), "a"), (at(2), "b")], [(at(6), "a")], [(at(6, 5), "b")], [(at(1, 45), "a"), (at(6, 10), "a")], [(at(12), "b")]]
    arrive(spark, str(tmp_path), batches, schema)
    out = run(spark, str(tmp_path), schema, lambda s: frames.rates(s), "out")
    got = {(r["start"].hour, r["event_type"]): r["n"] for r in out.withColumn("start", F.col("start").cast("timestamp")).collect()}
    assert got == {(1, "a"): 2, (2, "b"): 1, (6, "a"): 2, (6, "b"): 1}
