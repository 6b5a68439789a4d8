"""Tiers, many arrivals, empty ones, lost and raced commits of operator 3."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.llm import sharding


def lot(spark, n, start=0):
    return spark.range(start, start + n).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"), F.lit(None).cast("int").alias("file"))


def contents(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=2 << 20, shard_rows=700, fan_in=3)


def test_arrivals_rise_through_tiers(spark, store):
    want, merged_from = Counter(), []
    merge = store._merge
    store._merge = lambda runs, schema: merged_from.append({f["tier"] for f in runs}) or merge(runs, schema)
    for i in range(7):
        rows = lot(spark, 2000, i * 1500).repartition(2)  # lots overlap: repeated rows
        want += contents(rows)
        store.append(rows)
        store.compact()
        assert contents(store.read()) == want
    assert merged_from and all(len(t) == 1 for t in merged_from) and len({min(t) for t in merged_from}) > 1
    assert store.due(store.manifest()["files"]) == [] or all(f["bytes"] < 2 << 20 for f in store.manifest()["files"])
    before = store.manifest()
    assert store.vacuum() > 0 and store.manifest() == before and contents(store.read()) == want


def test_empty_arrival(spark, store):
    store.append(lot(spark, 0))
    assert store.manifest()["version"] == 1 and store.read().collect() == [] and store.read().columns == ["doc_id", "text", "file"]
    store.append(lot(spark, 10))
    store.append(lot(spark, 0))
    store.compact()
    assert contents(store.read()) == contents(lot(spark, 10))


def test_run_lost_before_its_commit(spark, store):
    store.append(lot(spark, 3000).repartition(3))
    before, want = store.manifest(), contents(store.read())

    def lost(*_):
        raise RuntimeError("lost")

    commit, store.commit = store.commit, lost
    for run in (lambda: store.append(lot(spark, 5)), store.compact):
        with pytest.raises(RuntimeError, match="lost"):
            run()
        assert store.manifest() == before and contents(store.read()) == want
    store.commit = commit
    assert store.vacuum() > 0  # what the lost runs wrote
    store.compact()
    assert contents(store.read()) == want and store.manifest()["version"] > before["version"]


def test_raced_commits(spark, store):
    store.append(lot(spark, 10))
    base = store.manifest()
    store.append(lot(spark, 10, 100))
    with pytest.raises(sharding.Conflict):
        store.commit(base, base["files"], base["schema"])
    # an append that lost the race starts again from the version that won
    manifest, calls = store.manifest, []
    store.manifest = lambda version=None: calls.append(1) or (base if len(calls) == 1 else manifest(version))
    store.append(lot(spark, 10, 200))
    store.manifest = manifest
    assert contents(store.read()) == contents(lot(spark, 10)) + contents(lot(spark, 10, 100)) + contents(lot(spark, 10, 200))
    # runs that another writer has merged meanwhile are not merged again
    with pytest.raises(sharding.Conflict):
        store._commit_change({"data/none"}, [], base["schema"])
