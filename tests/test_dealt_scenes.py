"""Scenes of one small file, of which each makes many rows."""

from gridloom.operators import tiling
from gridloom.sources import virtual


def test_patches_are_made_by_all_tasks(spark, sf):
    scenes = virtual.scene_catalog(spark, sf).coalesce(1)
    patches = tiling.training_patches(scenes)
    assert patches.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = [n for n in patches.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(made) > 1 and sum(made) == patches.count()
