"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import color, geometry, scene
from gridloom.operators import blend, chunks, components, distance, mask, segments, skeleton, stencil, stretch, tiling
from gridloom.plans import change, extract, lists
from gridloom.sources import files, virtual
from gridloom.sql import SQL

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["shape_filter"](spark, sf_dir)


# --- inputs


def _scene(spark, sf) -> DataFrame:
    return virtual.table(spark, sf, "embeddings").agg(F.lit(0).cast("long").alias("raster_id"), F.max(F.size("embedding")).alias("width"), (F.max("vec_id") + 1).cast("int").alias("height"))


def _prob(spark, sf) -> DataFrame:
    return stretch.percentile_stretch(virtual.embedding_raster(spark, sf)).select("raster_id", "r", "c", "p")


def _mask(spark, sf) -> DataFrame:
    return mask.threshold(_prob(spark, sf), 0.60)


def _raster(spark, sf) -> DataFrame:
    return virtual.embedding_raster(spark, sf)


def _unit(spark, sf) -> DataFrame:
    """The stretched raster as values."""
    return _prob(spark, sf).withColumnRenamed("p", "v")


def _rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


def _labels(spark, sf) -> DataFrame:
    return components.label(_mask(spark, sf))


def _distances(spark, sf) -> DataFrame:
    return distance.distance(_mask(spark, sf), _scene(spark, sf))


def _rgb(spark, sf) -> DataFrame:
    """Mean event values by day and hour as three bands in 0..1; cells that lack a band are left out."""
    bands = stretch.minmax_stretch(virtual.event_rasters(spark, sf)).groupBy("r", "c").pivot("raster_id", [4, 0, 2]).agg(F.first("p"))
    return bands.select(F.col("r").alias("day"), F.col("c").alias("hour"), F.col("4").alias("r"), F.col("0").alias("g"), F.col("2").alias("b")).na.drop()


def _metrics(spark, sf) -> DataFrame:
    return segments.segment_metrics(_labels(spark, sf), _distances(spark, sf), _prob(spark, sf), 0.5, width_m=1.0, length_m=3.0, coords=False)


def _feet(spark, sf) -> DataFrame:
    return segments.feet_metrics(_labels(spark, sf), _distances(spark, sf), gsd=3.0, width_ft=20.0)


def _world(spark, sf) -> DataFrame:
    x, y = geometry.pixel_to_world(F.lit(10), F.lit(20))
    return virtual.affine_catalog(spark, sf).select("raster_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), *(F.round(v, 6).alias(k) for k, v in geometry.bounds().items()))


def _changes(spark, sf) -> DataFrame:
    return change.compare(virtual.roads(spark, sf, "before"), virtual.roads(spark, sf, "after")).drop("geom")


def _masks(spark, sf) -> tuple[DataFrame, DataFrame]:
    p = _prob(spark, sf)
    return mask.threshold(p, 0.60), mask.threshold(p.withColumn("p", 1 - F.col("p")), 0.35)


def _paths(spark, sf) -> DataFrame:
    return virtual.image_paths(spark, sf).filter(F.col("path").isNotNull()).select("path")


def _workers(spark, sf) -> DataFrame:
    f = virtual.frames(spark, sf)
    n = f.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    return f.join(n, "video_id").select("video_id", "frame_idx", lists.worker_of(F.col("frame_idx"), F.col("n"), 3).cast("long").alias("worker"), lists.time_slice_of(F.col("frame_idx"), F.col("n"), 2).cast("long").alias("slice"))


def _weights(spark, sf) -> DataFrame:
    e = virtual.table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("w"), "label")
    mean = e.select("label", F.posexplode("w").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    mean = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    other = e.join(mean, "label").select("key", F.col("m").alias("w"))
    mixed = lists.interpolated(e.select("key", "w"), other, 0.7, 0.3)
    return mixed.select("key", F.posexplode("w").alias("i", "w")).withColumn("w", F.round("w", 6))


def _settings(spark, sf) -> DataFrame:
    base = virtual.table(spark, sf, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    over = virtual.table(spark, sf, "region").select(F.col("r_name").alias("key"), F.lit("region").alias("value"))
    more = virtual.table(spark, sf, "nation").filter("n_nationkey % 5 = 0").select(F.col("n_name").alias("key"), F.lit("override").alias("value"))
    return lists.merged_settings(base, over.unionByName(more))


def _bridged(spark, sf) -> DataFrame:
    p = _prob(spark, sf)
    return skeleton.bridged(skeleton.skeleton(mask.threshold(p, 0.6)), p, gap=28.0)


def _sub_images(spark, sf) -> DataFrame:
    """Sub-images of 240 pixels, of which every scene has some, and of 480 pixels, the reference's default."""
    scenes = virtual.scene_catalog(spark, sf)
    sizes = ((240, 120, 60), (480, 240, 0))
    small, large = (tiling.crops(scenes, *size).withColumn("crop_size", F.lit(size[0])) for size in sizes)
    return small.unionByName(large)


#: Side of the tiles into which the raster of these queries, 64 columns wide, is cut.
SIDE = 32


def _mask_tiles(spark, sf) -> chunks.Chunks:
    return chunks.from_pixels(_mask(spark, sf), _scene(spark, sf), tile=SIDE)


def _unit_tiles(spark, sf) -> chunks.Chunks:
    return chunks.from_pixels(_unit(spark, sf), _scene(spark, sf), "v", SIDE)


def _ridges(spark, sf) -> DataFrame:
    """Bright and dark ridges over all scales, the stronger of both."""
    return _rounded(chunks.to_pixels(chunks.frangi(_unit_tiles(spark, sf), dark=True)), "v")


def _gradient_tiles(spark, sf) -> DataFrame:
    names = ("gx", "gy", "magnitude")
    return _rounded(chunks.to_pixels(chunks.gradient(_unit_tiles(spark, sf)), names), *names)


def _label_tiles(spark, sf) -> DataFrame:
    return chunks.to_pixels(chunks.components(_mask_tiles(spark, sf)), ("label",)).withColumn("label", F.col("label") - 1)


QUERIES: dict[str, Query] = {
    # tiles
    "tile_windows": lambda s, d: tiling.windows(virtual.scene_catalog(s, d)),
    "tile_windows_sliding": lambda s, d: tiling.sliding(virtual.scene_catalog(s, d), 256, 64),
    "tile_windows_tail": lambda s, d: tiling.sliding(virtual.scene_catalog(s, d), 256, 64, "append"),
    "subimage_grid": _sub_images,
    "tile_batches": lambda s, d: tiling.batches(tiling.windows(virtual.scene_catalog(s, d))).groupBy("raster_id", "batch_id").agg(F.count(F.lit(1)).alias("tiles")),
    "pad_sizes": lambda s, d: tiling.pad_sizes(virtual.scene_catalog(s, d), 32),
    "training_patches": lambda s, d: tiling.training_patches(virtual.scene_catalog(s, d), 128, 32),
    "scaled_sizes": lambda s, d: lists.scaled_sizes(virtual.scene_catalog(s, d)).withColumns({"out_w": F.col("out_w").cast("long"), "out_h": F.col("out_h").cast("long")}),
    "read_window": lambda s, d: _rounded(tiling.read_window(_raster(s, d), _scene(s, d), 40, 10, 32, 16), "v"),
    "tile_halo": lambda s, d: tiling.halo_tiles(_raster(s, d), 32, 4).groupBy("tile_r", "tile_c").agg(F.count(F.lit(1)).alias("pixels"), F.count_if("inner").alias("own")),
    # stretches and fusion
    "percentile_stretch": lambda s, d: _rounded(_prob(s, d), "p"),
    "minmax_stretch": lambda s, d: _rounded(stretch.minmax_stretch(_raster(s, d)).select("raster_id", "r", "c", "p"), "p"),
    "percentile_stretch_by_band": lambda s, d: _rounded(stretch.percentile_stretch(virtual.event_rasters(s, d)).select("raster_id", "r", "c", "p"), "p"),
    "percentile_scale": lambda s, d: _rounded(stretch.percentile_scale(_raster(s, d)).select("raster_id", "r", "c", "p"), "p"),
    "to_uint8": lambda s, d: stretch.to_uint8(_raster(s, d)).select("raster_id", "r", "c", "u8"),
    "fuse_prob": lambda s, d: _rounded(stretch.fuse(_prob(s, d), stretch.minmax_stretch(_raster(s, d)).select("raster_id", "r", "c", "p"), 0.65, 0.35), "p"),
    "predict_tiles": lambda s, d: _rounded(extract.probability(_raster(s, d), _scene(s, d), 32, 8), "p"),
    "blend_uniform": lambda s, d: _rounded(extract.probability(_raster(s, d), _scene(s, d), 32, 8, uniform=True), "p"),
    # masks
    "threshold_mask": _mask,
    "dilate_rect": lambda s, d: mask.dilate(_mask(s, d), _scene(s, d), 1),
    "erode_rect": lambda s, d: mask.erode(mask.threshold(_prob(s, d), 0.35), _scene(s, d), 1),
    "close_open": lambda s, d: mask.close_open(_mask(s, d), _scene(s, d), 2, 1),
    "dilate_2x2": lambda s, d: mask.dilate_down_right(_mask(s, d), _scene(s, d)),
    "dilate_plus": lambda s, d: mask.dilate_plus(_mask(s, d), _scene(s, d)),
    "erode_plus": lambda s, d: mask.erode_plus(mask.threshold(_prob(s, d), 0.35), _scene(s, d)),
    "mask_union": lambda s, d: mask.union(*_masks(s, d)),
    "mask_intersect": lambda s, d: mask.intersect(*_masks(s, d)),
    "mask_except": lambda s, d: mask.subtract(*_masks(s, d)),
    "raster_change": lambda s, d: mask.raster_change(*_masks(s, d)),
    "crop_border": lambda s, d: mask.crop_border(_mask(s, d), _scene(s, d)),
    "mask_boundary": lambda s, d: mask.boundary(_mask(s, d)),
    "corridor_area": lambda s, d: segments.corridor_area(_mask(s, d), 0.3),
    "overlay": lambda s, d: _rounded(mask.overlay(_unit(s, d), _mask(s, d), 1.0), "v"),
    # neighbourhoods
    "gaussian_smooth": lambda s, d: _rounded(stencil.gaussian(_unit(s, d), _scene(s, d), 0.8, radius=1), "v"),
    "box_mean": lambda s, d: _rounded(stencil.box_mean(_unit(s, d), _scene(s, d)), "v"),
    "median_filter": lambda s, d: _rounded(stencil.median(_unit(s, d), _scene(s, d), 3), "v"),
    "sobel_gradient": lambda s, d: _rounded(stencil.gradient(_unit(s, d)).select("raster_id", "r", "c", "gx", "gy", "magnitude"), "gx", "gy", "magnitude"),
    "endpoints": lambda s, d: stencil.endpoints(_mask(s, d)),
    "neighbour_count": lambda s, d: stencil.neighbour_count(_mask(s, d)),
    "distance_transform": lambda s, d: _rounded(_distances(s, d), "dist"),
    "width_band": lambda s, d: _rounded(mask.width_band(distance.widths(_distances(s, d), 2.0)), "dist", "w"),
    "nms_ridges": lambda s, d: _rounded(stencil.ridges(stencil.gaussian(_unit(s, d), _scene(s, d), 1.0)), "v"),
    "ribbon_energy": lambda s, d: _rounded(stencil.ribbon_energy(_unit(s, d)), "v"),
    "frangi_ridge": _ridges,
    "contrast_equalised": lambda s, d: stencil.clahe(_unit(s, d).withColumn("v", F.col("v") * 255), _scene(s, d)),
    "edges": lambda s, d: stencil.edges(_unit(s, d).withColumn("v", F.col("v") * 255)),
    # the same on tables of tiles
    "tiles_dilate": lambda s, d: chunks.to_pixels(chunks.dilate(_mask_tiles(s, d), 1), ()),
    "tiles_erode": lambda s, d: chunks.to_pixels(chunks.erode(chunks.from_pixels(mask.threshold(_prob(s, d), 0.35), _scene(s, d), tile=SIDE), 1), ()),
    "tiles_close_open": lambda s, d: chunks.to_pixels(chunks.close_open(_mask_tiles(s, d), 2, 1), ()),
    "tiles_plus": lambda s, d: chunks.to_pixels(chunks.plus(_mask_tiles(s, d), True), ()),
    "tiles_gaussian": lambda s, d: _rounded(chunks.to_pixels(chunks.gaussian(_unit_tiles(s, d), 0.8, 1)), "v"),
    "tiles_sobel": _gradient_tiles,
    "tiles_median": lambda s, d: _rounded(chunks.to_pixels(chunks.median(_unit_tiles(s, d), 3)), "v"),
    "tiles_neighbours": lambda s, d: chunks.to_pixels(chunks.neighbour_count(_mask_tiles(s, d)), ("n",)).withColumn("n", F.col("n").cast("long")),
    "tiles_components": _label_tiles,
    "tiles_distance": lambda s, d: _rounded(chunks.to_pixels(chunks.distance(_mask_tiles(s, d)), ("dist",)).filter("dist > 0"), "dist"),
    # components and segments
    "components": _labels,
    "component_stats": lambda s, d: _rounded(components.stats(_labels(s, d)), "diagonal", "aspect"),
    "shape_filter": lambda s, d: _rounded(components.shape_filter(components.stats(_labels(s, d))), "diagonal", "aspect"),
    "area_filter": lambda s, d: components.write_back(*(lambda x: (x, components.area_filter(components.stats(x))))(_labels(s, d))),
    "hysteresis": lambda s, d: components.hysteresis(_prob(s, d), 0.60, 0.85),
    "branch_hysteresis": lambda s, d: _rounded(components.branch_hysteresis(_prob(s, d), 0.60, 0.85), "max_p"),
    "segment_widths": _metrics,
    "qualify_20ft": lambda s, d: segments.qualifying(_metrics(s, d)),
    "road_filter": lambda s, d: segments.road_filter(_metrics(s, d), 1.0, 3.0, 0.7),
    "qualify_permissive": lambda s, d: _rounded(_feet(s, d), "mean_ft", "median_ft", "max_ft", "length_km"),
    "width_classes": lambda s, d: _rounded(segments.width_classes(_feet(s, d)), "length_km"),
    "segment_totals": lambda s, d: _rounded(segments.totals(_feet(s, d)), "length_km"),
    "dice_score": lambda s, d: _rounded(segments.dice(_prob(s, d), _raster(s, d).withColumn("v", (F.col("v") > 0).cast("double"))), "dice_loss"),
    "skeleton": lambda s, d: skeleton.skeleton(_mask(s, d)),
    "bridged_skeleton": _bridged,
    # scenes, colours, geometry
    "gsd_table": lambda s, d: _rounded(scene.described(virtual.affine_catalog(s, d)).select("raster_id", "gsd", "road_px", "reliable"), "gsd", "road_px"),
    "scene_checks": lambda s, d: scene.checked(virtual.affine_catalog(s, d)),
    "pixel_to_world": _world,
    "spectral_mask": lambda s, d: _rgb(s, d).filter(color.spectral_mask(F.col("r"), F.col("g"), F.col("b"))).select("day", "hour"),
    "spectral_index": lambda s, d: _rgb(s, d).select("day", "hour", F.round(color.gray(F.col("r"), F.col("g"), F.col("b")), 6).alias("gray"), F.round(color.vegetation(F.col("r"), F.col("g")), 6).alias("vegetation"), F.round(color.asphalt_score(F.col("r"), F.col("g"), F.col("b")), 6).alias("asphalt")),
    "road_features": lambda s, d: files.features(virtual.roads(s, d, "after"), ["road_id", "mean_width_m"], geographic=False),
    "road_lengths": lambda s, d: virtual.roads(s, d, "after").select("road_id", F.round(geometry.line_length(F.col("geom")), 6).alias("length_m"), geometry.is_line(F.col("geom")).alias("valid")),
    # change
    "change_all": _changes,
    "change_new": lambda s, d: _changes(s, d).filter("change_type = 'NEW_ROAD'"),
    "change_removed": lambda s, d: _changes(s, d).filter("change_type = 'REMOVED_ROAD'"),
    # lists, frames, weights
    "meta_paths": lambda s, d: lists.meta_paths(_paths(s, d).withColumnRenamed("path", "value"), "gt"),
    "path_keys": lambda s, d: lists.keys(_paths(s, d).withColumnRenamed("path", "value")),
    "pair_meta": lambda s, d: lists.meta_pairs(_paths(s, d).select(F.concat_ws(", ", "path", F.concat(F.lit("x4/"), "path")).alias("value")), "gt", "lq"),
    "pair_zip": lambda s, d: lists.zip_sorted(_paths(s, d), _paths(s, d).select(F.concat(F.lit("LQ/"), "path").alias("path"))),
    "worker_partition": _workers,
    "config_merge": _settings,
    "checkpoint_keys": lambda s, d: lists.weight_keys(virtual.table(s, d, "supplier").select(F.concat(F.lit("module."), "s_name").alias("key"), "s_acctbal")),
    "weight_interp": _weights,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in QUERIES}
