"""Queries of colour evidence, outlines, image data sets, enhancement and export, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import registry as base
from gridloom.functions import color, scene
from gridloom.operators import chunks, components, distance, mask, polygon, segments, skeleton, stencil, stretch
from gridloom.plans import degrade, enhance, evidence, heatmap, items, lists, network
from gridloom.sources import files, virtual
from gridloom.sql import _PARTS, _SQUARE, _dilated, _with


def _bands(spark, sf) -> DataFrame:
    """Three bands of the embedding raster: a component and the two after it."""
    e = virtual.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("c", "red"), "embedding")
    n = F.size("embedding")
    return e.select(F.lit(0).cast("long").alias("raster_id"), F.col("vec_id").cast("int").alias("r"), "c", F.col("red").cast("double").alias("red"), *(F.get("embedding", F.pmod(F.col("c") + k, n).cast("int")).cast("double").alias(b) for k, b in ((1, "green"), (2, "blue"))))


def _rgb8(spark, sf) -> DataFrame:
    """The event bands as bytes."""
    return base._rgb(spark, sf).select("day", "hour", *(F.floor(F.col(c) * 255).cast("double").alias(c) for c in "rgb"))


def _asphalt(spark, sf) -> DataFrame:
    r, g, b = (F.col(c) for c in "rgb")
    _, s, v = color.hsv8(r, g, b)
    light, a, bb = color.lab8(r, g, b)
    return _rgb8(spark, sf).select("day", "hour", color.asphalt_hsv(s, v).alias("by_hsv"), color.asphalt_lab(light, a, bb).alias("by_lab"))


def _lab_round_trip(spark, sf) -> DataFrame:
    back = color.from_lab(*color.lab(*(F.col(c) for c in "rgb")))
    return base._rgb(spark, sf).select("day", "hour", *(F.round(x, 3).alias(c) for c, x in zip("rgb", back, strict=True)))


def _images(spark, sf) -> DataFrame:
    """Sizes of the scenes as large images and their small partners at a quarter."""
    s = virtual.scene_catalog(spark, sf)
    side = lambda c: (F.floor(F.col(c) / 4) * 4).cast("int")
    return s.select("raster_id", side("width").alias("width"), side("height").alias("height"), (side("width") / 4).cast("int").alias("lq_width"), (side("height") / 4).cast("int").alias("lq_height"))


def _channels(spark, sf) -> DataFrame:
    """The embedding raster as an image of four channels: components in groups of four."""
    r = base._raster(spark, sf)
    return r.select("raster_id", "r", F.floor(F.col("c") / 4).cast("int").alias("c"), (F.col("c") % 4).cast("int").alias("ch"), "v")


def _keys(spark, sf) -> DataFrame:
    """Weights of a checkpoint: two thirds under a wrapper and the prefix of a parallel one, the others beside it."""
    prefix = F.when(F.col("s_suppkey") % 3 != 0, F.lit("model_state_dict.module.")).otherwise(F.lit("optimizer."))
    return virtual.table(spark, sf, "supplier").select(F.concat(prefix, "s_name").alias("key"), "s_acctbal")


def _wanted_keys(spark, sf) -> DataFrame:
    return virtual.table(spark, sf, "supplier").filter("s_suppkey % 6 in (1, 2)").select(F.col("s_name").alias("key"))


def _odd_scenes(spark, sf) -> DataFrame:
    """Scenes of which some have no pixels, no bands or no system, and some are coarse."""
    k = F.col("raster_id")
    a = virtual.affine_catalog(spark, sf).withColumns({"width": F.when(k % 7 == 0, 0).otherwise(F.col("width")), "count": F.when(k % 11 == 0, 0).otherwise(F.col("count"))})
    return a.withColumns({"srid": F.when(k % 5 != 0, F.col("srid")), "t_a": F.when(k % 13 == 0, F.col("t_a") * 4).otherwise(F.col("t_a")), "t_e": F.when(k % 13 == 0, F.col("t_e") * 4).otherwise(F.col("t_e"))})


def _resized(spark, sf) -> DataFrame:
    size = base._scene(spark, sf).first()
    return mask.resize_nearest(base._mask(spark, sf), size["height"], size["width"], size["height"] * 3 // 4, 100)


def _turned(spark, sf) -> DataFrame:
    """Every 64 vectors are a patch."""
    patches = base._raster(spark, sf).select(F.floor(F.col("r") / 64).alias("raster_id"), (F.col("r") % 64).alias("r"), "c", "v")
    return base._rounded(items.turned(patches, 64, F.lit(True), F.lit(1)), "v")


def _degraded(spark, sf) -> DataFrame:
    """Every 96 vectors are an image of 64 columns, three vectors a row: one for each colour, gray where there is none."""
    v = virtual.table(spark, sf, "embeddings").filter("vec_id is not null and embedding is not null").select("vec_id", F.posexplode("embedding").alias("c", "x"))
    place = F.pmod(F.col("vec_id"), F.lit(96))
    cells = v.select(F.floor(F.col("vec_id") / 96).alias("raster_id"), F.floor(place / 3).cast("int").alias("r"), "c", (place % 3).alias("ch"), F.least(F.greatest(F.lit(0.5) + F.col("x").cast("double"), F.lit(0.0)), F.lit(1.0)).alias("x"))
    colours = cells.groupBy("raster_id", "r", "c").agg(F.avg("x").alias("gray"), *(F.max(F.when(F.col("ch") == k, F.col("x"))).alias(f"x{k}") for k in range(3)))
    pixels = colours.select("raster_id", F.struct("r", "c", F.array(*(F.coalesce(f"x{k}", "gray") for k in range(3))).alias("x")).alias("p"))
    images = pixels.groupBy("raster_id").agg(F.array_sort(F.collect_list("p")).alias("p"), F.countDistinct("p.r").alias("height"), F.countDistinct("p.c").alias("width"))
    pairs = degrade.training_pairs(images.select("raster_id", "height", "width", F.flatten("p.x").alias("pixels")))
    return pairs.select("raster_id", "height", "width", "lq_height", "lq_width", F.transform("lq", lambda x: F.round(x, 6)).alias("lq"))


def _two_lists(spark, sf) -> DataFrame:
    more = virtual.table(spark, sf, "labels").join(virtual.image_paths(spark, sf), "doc_id").filter("path is not null")
    return files.union_of_lists(base._paths(spark, sf), more.select(F.when(F.col("quality") == 1, F.col("path")).otherwise(F.concat(F.lit("more/"), "path")).alias("path")))


def _band_tiles(spark, sf) -> chunks.Chunks:
    return chunks.from_pixels(_bands(spark, sf), base._scene(spark, sf), ("red", "green", "blue"), base.SIDE)


def _weights_for(spark, sf, net: network.Network, gain: float = 4.0) -> DataFrame:
    """Weights of a network from the components of the vectors, one after the other and from the start again; variances are positive."""
    starts, n = [], 0
    for key, shape in net.shapes.items():
        size = 1
        for x in shape:
            size *= x
        starts.append((key, list(shape), n, n + size - 1))
        n += size
    values = virtual.table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("c", "x"), "vec_id").select((F.col("vec_id") * 64 + F.col("c")).alias("place"), (F.col("x").cast("double") * gain).alias("x"))
    total = values.count()
    wanted = spark.createDataFrame(starts, "key string, shape array<int>, low long, high long").select("key", "shape", F.explode(F.sequence("low", "high")).alias("i"))
    found = wanted.withColumn("place", F.col("i") % total).join(values, "place")
    w = F.when(F.col("key").endswith("running_var"), F.abs("x") + 0.5).otherwise(F.col("x"))
    return found.groupBy("key", "shape").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", w.alias("w")))), lambda s: s["w"]).alias("w"))


def _one_layer(x, w):
    return network.relu(network.convolved(x, w["layer.weight"], w["layer.bias"]))


def _by_network(spark, sf, net: network.Network, names: tuple[str, ...]) -> DataFrame:
    weights = network.weights_of(_weights_for(spark, sf, net), net, "f8")
    return base._rounded(chunks.to_pixels(network.applied(_band_tiles(spark, sf), net, weights, kind="f8"), names), *names)


def _predicted(spark, sf) -> tuple[DataFrame, DataFrame]:
    return heatmap.predicted(evidence.bytes_of(_bands(spark, sf)), base._scene(spark, sf), tile=base.SIDE)


def _heatmap(spark, sf) -> DataFrame:
    return base._rounded(heatmap.surface(*_predicted(spark, sf), base._scene(spark, sf), base.SIDE), "v")


def _heatmap_roads(spark, sf) -> DataFrame:
    found = heatmap.roads(_predicted(spark, sf)[1], base._scene(spark, sf), tile=base.SIDE)
    return found["main"].withColumn("tier", F.lit("main")).unionByName(found["secondary"].withColumn("tier", F.lit("secondary")))


def _corridors(spark, sf) -> DataFrame:
    """Numbers of polygons and areas of the components of the mask."""
    labels = base._labels(spark, sf)
    return polygon.polygons(polygon.rings(labels), labels).groupBy("raster_id", "label").agg(F.count(F.lit(1)).alias("polygons"), F.sum("area").alias("area"))


def _wide_roads(spark, sf) -> DataFrame:
    return distance.widths(base._distances(spark, sf), 0.5)


def _discs_by_width(spark, sf) -> DataFrame:
    """Every pixel as a disc of its distance to the border, 2 to 6 pixels."""
    points = base._distances(spark, sf).withColumn("radius", F.least(F.greatest(F.round("dist"), F.lit(2)), F.lit(6)).cast("int"))
    return mask.stamp_discs(points, base._scene(spark, sf), 6)


def _features(spark, sf) -> DataFrame:
    rings = polygon.rings(base._labels(spark, sf)).filter("outer")
    both = files.feature_union(virtual.roads(spark, sf, "after"), rings)
    return both.groupBy("feature_type").agg(F.count(F.lit(1)).alias("features"), F.count("width_m").alias("with_width"))


def _gated(spark, sf) -> DataFrame:
    q = stretch.minmax_stretch(base._raster(spark, sf)).select("raster_id", "r", "c", F.col("p").alias("q"))
    return base._prob(spark, sf).join(q, ["raster_id", "r", "c"]).select("raster_id", "r", "c", F.round(stretch.gated(F.col("p"), F.col("q"), 0.65, 0.35, 0.5), 6).alias("p"))


def _replaced(spark, sf) -> DataFrame:
    unit = base._unit(spark, sf)
    return base._rounded(stretch.replace_annotated(unit, base._mask(spark, sf), stretch.minmax_stretch(base._raster(spark, sf)).select("raster_id", "r", "c", F.col("p").alias("v"))), "v")


QUERIES = {
    "road_evidence": lambda s, d: base._rounded(evidence.probability(_bands(s, d), base._scene(s, d)), "p"),
    "asphalt_masks": _asphalt,
    "yellow_mask": lambda s, d: base._rgb(s, d).filter(color.yellow(*(F.col(c) for c in "rgb"))).select("day", "hour"),
    "lab_round_trip": _lab_round_trip,
    "threshold_strict": lambda s, d: mask.threshold(base._prob(s, d), 0.60, strict=True),
    "line_dilation": lambda s, d: mask.dilate_line(base._mask(s, d), base._scene(s, d), 4),
    "disc_stamps": _discs_by_width,
    "mask_resize": _resized,
    "unsharp_mask": lambda s, d: base._rounded(stencil.unsharp(base._unit(s, d), base._scene(s, d)), "v"),
    "gated_fusion": _gated,
    "replace_annotated": _replaced,
    "polygon_rings": lambda s, d: polygon.rings(base._labels(s, d)),
    "polygon_measures": lambda s, d: polygon.measures(polygon.rings(base._labels(s, d))),
    "feature_union": _features,
    "corridor_polygons": _corridors,
    "exact_heatmap": _heatmap,
    "heatmap_roads": _heatmap_roads,
    "tiles_equalised": lambda s, d: chunks.to_pixels(chunks.clahe(chunks.from_pixels(base._unit(s, d).withColumn("v", F.col("v") * 255), base._scene(s, d), "v", base.SIDE))),
    "convolution": lambda s, d: _by_network(s, d, network.Network(_one_layer, {"layer.weight": (1, 3, 3, 3), "layer.bias": (1,)}, 1), ("v",)),
    "network_probability": lambda s, d: _by_network(s, d, network.fast_road_net((8, 12)), ("p",)),
    "unet_probability": lambda s, d: _by_network(s, d, network.u_net((4, 6, 8)), ("p",)),
    "network_enlarged": lambda s, d: _by_network(s, d, network.compact(3, 8, 2, 2), ("red", "green", "blue")),
    "odd_scene_checks": lambda s, d: scene.checked(_odd_scenes(s, d)),
    "bce_loss": lambda s, d: base._rounded(segments.bce(base._prob(s, d), base._raster(s, d).withColumn("v", (F.col("v") > 0).cast("double"))), "bce"),
    "contour_widths": lambda s, d: base._rounded(segments.contour_widths(base._labels(s, d), mask.boundary(base._mask(s, d)), _wide_roads(s, d)), "mean_w"),
    "heatmap_centerlines": lambda s, d: skeleton.centerlines(base._prob(s, d), 0.6, 20),
    "gsd_series": lambda s, d: virtual.affine_catalog(s, d).select("raster_id", F.round(scene.gsd_series(), 6).alias("gsd")),
    "scene_summary": lambda s, d: scene.summary(virtual.affine_catalog(s, d)).drop("bounds"),
    "fine_scenes": lambda s, d: scene.fine_enough(virtual.affine_catalog(s, d).filter((F.col("t_a") <= 0.8) & F.col("projected"))).select("raster_id", F.round("gsd", 6).alias("gsd")),
    "bands_kept": lambda s, d: scene.bands_kept(virtual.affine_catalog(s, d), [4, 2, 9]),
    "preview_windows": lambda s, d: scene.preview(virtual.scene_catalog(s, d), 2048),
    "frame_padding": lambda s, d: enhance.padding(virtual.scene_catalog(s, d), 2, 3),
    "pixel_shuffle": lambda s, d: base._rounded(enhance.pixel_shuffle(_channels(s, d), 2), "v"),
    "logistic_scores": lambda s, d: base._rounded(enhance.probability_of(base._raster(s, d)).select("raster_id", "r", "c", "p"), "p"),
    "model_weights": lambda s, d: enhance.model_weights(enhance.models(s).select(F.concat("name", F.lit(".pth")).alias("name")), 0.75),
    "output_names": lambda s, d: base._paths(s, d).select(F.regexp_replace("path", "png$", "jpg").alias("path")).select(enhance.output_name(F.col("path"), F.lit("RGBA")).alias("alpha"), enhance.output_name(F.col("path"), F.lit("RGB")).alias("plain")),
    "crop_plan": lambda s, d: items.crop_plan(virtual.scene_catalog(s, d)),
    "paired_crops": lambda s, d: items.paired_plan(_images(s, d), 128, 4),
    "channel_normalise": lambda s, d: base._rounded(items.normalised(_channels(s, d).filter("ch < 3")), "v"),
    "turned_patches": _turned,
    "degraded_images": _degraded,
    "pair_pool": lambda s, d: items.pool_plan(virtual.table(s, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_partkey").alias("raster_id")), 180).groupBy(F.floor(F.col("idx") / 180).alias("block")).agg(F.sum("raster_id").alias("entered"), F.sum("out").alias("left")),
    "blur_kernels": lambda s, d: items.kernels(virtual.table(s, d, "part").select(F.col("p_partkey").alias("raster_id"))).select("item", "stage", F.round(F.aggregate("kernel", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("kernel").alias("places")),
    "checkpoint_unwrap": lambda s, d: lists.checkpoint_entries(_keys(s, d)),
    "checkpoint_strict": lambda s, d: lists.required_keys(lists.checkpoint_entries(_keys(s, d)), _wanted_keys(s, d)),
    "name_slugs": lambda s, d: virtual.table(s, d, "part").select("p_partkey", lists.slug(F.col("p_name")).alias("slug")),
    "pairs_by_name": lambda s, d: lists.pairs_by_name(base._paths(s, d), base._paths(s, d).select(F.regexp_replace("path", r"^DF/(.*)/([0-9]+)\.png$", "LQ/$1/$2x4.png").alias("path")), "{}x4"),
    "list_union": _two_lists,
    "frames_joined": lambda s, d: lists.concatenated(virtual.frames(s, d).select("video_id", F.floor(F.col("frame_idx") / 3).alias("part"), (F.col("frame_idx") % 3).alias("frame_idx"))).select("video_id", F.col("part").cast("long").alias("part"), F.col("frame_idx").cast("long").alias("frame_idx"), F.col("frame_no").cast("long").alias("frame_no")),
}

_LIN = "CASE WHEN {0} / 255 > 0.04045 THEN pow(({0} / 255 + 0.055) / 1.055, 2.4) ELSE {0} / 255 / 12.92 END"
_F = "CASE WHEN {0} > 0.008856 THEN cbrt({0}) ELSE {0} * 7.787 + 16.0::DOUBLE / 116 END"
_LAB8 = f"""b8 AS (SELECT day, hour, floor(r * 255) AS r, floor(g * 255) AS g, floor(b * 255) AS b FROM rgb), lin8 AS (SELECT *, {_LIN.format('r')} AS lr, {_LIN.format('g')} AS lg, {_LIN.format('b')} AS lb, greatest(r, g, b) AS top, least(r, g, b) AS low FROM b8),
  xyz AS (SELECT *, (lr * 0.412453::DOUBLE + lg * 0.357580::DOUBLE + lb * 0.180423::DOUBLE) / 0.950456::DOUBLE AS x, lr * 0.212671::DOUBLE + lg * 0.715160::DOUBLE + lb * 0.072169::DOUBLE AS y, (lr * 0.019334::DOUBLE + lg * 0.119193::DOUBLE + lb * 0.950227::DOUBLE) / 1.088754::DOUBLE AS z FROM lin8),
  fs AS (SELECT *, {_F.format('x')} AS fx, {_F.format('y')} AS fy, {_F.format('z')} AS fz FROM xyz),
  lab8 AS (SELECT *, round(CASE WHEN y > 0.008856 THEN 116 * cbrt(y) - 16 ELSE y * 903.3::DOUBLE END * 255 / 100) AS l8, round(500 * (fx - fy) + 128) AS a8, round(200 * (fy - fz) + 128) AS b8v, round(CASE WHEN top = 0 THEN 0 ELSE (top - low) / top END * 255) AS s8, round(top) AS v8 FROM fs)"""
_DRAW = "(((({0} + {1}) % 2147483648) * 2654435761) % 4294967296 // 256) % ({2})"
_MM = "(v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ())"
_PATH = _PARTS["paths"]

SQL = {
    "asphalt_masks": _with("rgb", "#").replace(" #", f", {_LAB8} SELECT day, hour, s8 < 60 AND v8 > 40 AND v8 < 160 AS by_hsv, abs(a8 - 128) < 12 AND abs(b8v - 128) < 12 AND l8 > 50 AND l8 < 180 AS by_lab FROM lab8"),
    "yellow_mask": _with("hsv", "SELECT day, hour FROM (SELECT *, CASE WHEN top = least(r, g, b) THEN 0 WHEN top = r THEN 60 * ((g - b) / (top - least(r, g, b))) WHEN top = g THEN 60 * ((b - r) / (top - least(r, g, b)) + 2) ELSE 60 * ((r - g) / (top - least(r, g, b)) + 4) END AS h FROM hsv) WHERE CASE WHEN h < 0 THEN h + 360 ELSE h END BETWEEN 40 AND 70 AND sat >= 0.4 AND top >= 0.4"),
    "lab_round_trip": _with("rgb", "SELECT day, hour, round(r, 3) AS r, round(g, 3) AS g, round(b, 3) AS b FROM rgb"),
    "threshold_strict": _with("prob", "SELECT raster_id, r, c FROM prob WHERE p > 0.60"),
    "line_dilation": _with("mask scene", _dilated("mask", "(SELECT x.i - 2 AS dr, y.i - 2 AS dc FROM range(4) x(i), range(4) y(i))")),
    "disc_stamps": _with("dist scene", "SELECT DISTINCT raster_id, (d.r + x.i - 6)::INTEGER AS r, (d.c + y.i - 6)::INTEGER AS c FROM (SELECT *, least(greatest(round(dist), 2), 6) AS radius FROM dist) d, range(13) x(i), range(13) y(i), scene WHERE (x.i - 6) * (x.i - 6) + (y.i - 6) * (y.i - 6) <= radius * radius AND d.r + x.i - 6 BETWEEN 0 AND h - 1 AND d.c + y.i - 6 BETWEEN 0 AND w - 1"),
    "mask_resize": _with("mask scene", "SELECT raster_id, x.i::INTEGER AS r, y.i::INTEGER AS c FROM (SELECT unnest(range(h * 3 // 4)) AS i, h, h * 3 // 4 AS n, w FROM scene) x, range(100) y(i), mask m WHERE m.r = x.i * h // n AND m.c = y.i * w // 100"),
    "gated_fusion": _with("prob emb", f"SELECT raster_id, r, c, round(CASE WHEN q > 0.5 THEN 0.65 * p + 0.35 * q ELSE p END, 6) AS p FROM prob JOIN (SELECT r, c, {_MM} AS q FROM emb) USING (r, c)"),
    "replace_annotated": _with("prob emb mask", f"SELECT p.raster_id, p.r, p.c, round(CASE WHEN m.r IS NOT NULL THEN q ELSE p END, 6) AS v FROM prob p JOIN (SELECT r, c, {_MM} AS q FROM emb) USING (r, c) LEFT JOIN mask m ON m.r = p.r AND m.c = p.c"),
    "polygon_measures": _with("labels", "SELECT a.raster_id, a.label, sum(4 - n)::BIGINT AS perimeter, count(*)::DOUBLE AS area FROM (SELECT l.raster_id, l.label, l.r, l.c, count(k.r) AS n FROM labels l LEFT JOIN labels k ON abs(k.r - l.r) + abs(k.c - l.c) = 1 AND k.label = l.label GROUP BY ALL) a GROUP BY ALL"),
    "bce_loss": _with("prob", "SELECT raster_id, round(avg(-CASE WHEN v > 0 THEN ln(q) ELSE ln(1 - q) END), 6) AS bce FROM (SELECT raster_id, v, least(greatest(p, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS q FROM prob JOIN emb USING (raster_id, r, c)) GROUP BY 1"),
    "contour_widths": _with("labels dist plus", "SELECT raster_id, label, count(*) AS pixels, round(avg(2.0 * dist * 0.5), 6) AS mean_w FROM labels JOIN dist USING (raster_id, r, c) SEMI JOIN (SELECT m.r, m.c FROM mask m, plus o LEFT JOIN mask n ON n.r = m.r + dr AND n.c = m.c + dc GROUP BY ALL HAVING count(n.r) < 5) e USING (r, c) GROUP BY 1, 2"),
    "gsd_series": _with("affine", "SELECT raster_id, round(CASE WHEN projected THEN px ELSE (px * 111412.84::DOUBLE * cos(radians(y0 - px * 384)) + px * (111132.954::DOUBLE - 559.822::DOUBLE * cos(2 * radians(y0 - px * 384)))) / 2 END, 6) AS gsd FROM affine"),
    "scene_summary": _with("affine", "SELECT raster_id, '1024 x 768' AS dimensions, (1 + raster_id % 4)::INTEGER AS bands, CASE WHEN projected THEN 'EPSG:32643' ELSE 'EPSG:4326' END AS crs, projected, round(g, 4) AS gsd_m, round(6.096 / greatest(g, 1e-6), 2) AS pixels_for_6_1m_road, g <= 3.5 AS gsd_reliable FROM (SELECT *, CASE WHEN projected THEN px ELSE (px * 111139.0::DOUBLE * cos(radians(y0 - px * 384)) + px * 111139.0::DOUBLE) / 2 END AS g FROM affine)"),
    "fine_scenes": _with("affine", "SELECT raster_id, round(px, 6) AS gsd FROM affine WHERE projected AND px <= 0.8"),
    "bands_kept": "SELECT s_suppkey AS raster_id, unnest(CASE s_suppkey % 4 WHEN 3 THEN [4, 2] WHEN 0 THEN [1] ELSE [2] END)::INTEGER AS band FROM supplier",
    "preview_windows": _with("scenes", "SELECT raster_id, least(width, 2048)::INTEGER AS width, least(height, 2048)::INTEGER AS height FROM scenes"),
    "frame_padding": _with("scenes", "SELECT raster_id, (width + 3)::INTEGER AS width, (height + 3)::INTEGER AS height, ((width + 3) % 2)::INTEGER AS pad_w, ((height + 3) % 2)::INTEGER AS pad_h FROM scenes"),
    "pixel_shuffle": _with("emb", "SELECT raster_id, (r * 2 + c % 4 // 2)::INTEGER AS r, (c // 4 * 2 + c % 2)::INTEGER AS c, 0::INTEGER AS ch, round(v, 6) AS v FROM emb"),
    "logistic_scores": _with("emb", "SELECT raster_id, r, c, round(CASE WHEN min(v) OVER () < 0 OR max(v) OVER () > 1 THEN 1 / (1 + exp(-v)) ELSE v END, 6) AS p FROM emb"),
    "output_names": f"SELECT regexp_extract(path, '([0-9]+)\\.png$', 1) || '_out.png' AS alpha, regexp_extract(path, '([0-9]+)\\.png$', 1) || '_out.jpg' AS plain FROM ({_PATH})",
    "model_weights": "SELECT * FROM (VALUES ('residual_x4', 'residual_x4.pth', 1.0::DOUBLE), ('residual_x4_small', 'residual_x4_small.pth', 1.0), ('residual_x2', 'residual_x2.pth', 1.0), ('compact_x4', 'compact_x4.pth', 1.0), ('compact_x4_general', 'compact_x4_general.pth', 0.75), ('compact_x4_general', 'compact_x4_noisy.pth', 0.25)) t(name, file, weight)",
    "crop_plan": _with("scenes", f"SELECT raster_id, greatest(400 - width, 0)::INTEGER AS pad_w, greatest(400 - height, 0)::INTEGER AS pad_h, ({_DRAW.format('raster_id', 1, 'greatest(height - 400, 0) + 1')})::INTEGER AS top, ({_DRAW.format('raster_id', 7920, 'greatest(width - 400, 0) + 1')})::INTEGER AS \"left\", {_DRAW.format('raster_id', 15839, '2')} = 1 AS flip FROM scenes"),
    "paired_crops": _with("scenes", f"SELECT raster_id, t::INTEGER AS lq_top, l::INTEGER AS lq_left, (t * 4)::INTEGER AS gt_top, (l * 4)::INTEGER AS gt_left, {_DRAW.format('raster_id', 15839, '2')} = 1 AS flip, ({_DRAW.format('raster_id', 23758, '4')})::INTEGER AS turns FROM (SELECT raster_id, {_DRAW.format('raster_id', 1, 'height // 4 - 31')} AS t, {_DRAW.format('raster_id', 7920, 'width // 4 - 31')} AS l FROM scenes)"),
    "channel_normalise": _with("emb", "SELECT raster_id, r, (c // 4)::INTEGER AS c, (c % 4)::INTEGER AS ch, round((v - CASE c % 4 WHEN 0 THEN 0.485::DOUBLE WHEN 1 THEN 0.456::DOUBLE ELSE 0.406::DOUBLE END) / CASE c % 4 WHEN 0 THEN 0.229::DOUBLE WHEN 1 THEN 0.224::DOUBLE ELSE 0.225::DOUBLE END, 6) AS v FROM emb WHERE c % 4 < 3"),
    "turned_patches": _with("emb", "SELECT (r // 64)::BIGINT AS raster_id, c::INTEGER AS r, (r % 64)::INTEGER AS c, round(v, 6) AS v FROM emb"),
    "pair_pool": "SELECT p_partkey // 180 AS block, sum(p_partkey)::BIGINT AS entered, sum(p_partkey)::BIGINT AS \"left\" FROM part GROUP BY 1",
    "blur_kernels": "SELECT p_partkey AS item, unnest([1, 2, 3])::INTEGER AS stage, 1.0::DOUBLE AS total, 441::INTEGER AS places FROM part",
    "checkpoint_unwrap": "SELECT s_name AS key, s_acctbal FROM supplier WHERE s_suppkey % 3 <> 0",
    "checkpoint_strict": "SELECT s_name AS key, s_acctbal FROM supplier WHERE s_suppkey % 6 IN (1, 2)",
    "name_slugs": r"SELECT p_partkey, regexp_replace(lower(trim(p_name)), '\s+', '_', 'g') AS slug FROM part",
    "pairs_by_name": f"SELECT path AS gt_path, 'LQ/' || replace(substr(path, 4), '.png', 'x4.png') AS lq_path FROM ({_PATH})",
    "list_union": f"SELECT path FROM ({_PATH}) UNION SELECT CASE WHEN quality = 1 THEN path ELSE 'more/' || path END FROM labels JOIN (SELECT doc_id, concat('DF/', lang, '/', doc_id::VARCHAR, '.png') AS path FROM documents WHERE lang IS NOT NULL) USING (doc_id)",
    "frames_joined": "WITH f AS (SELECT conv_id AS video_id, turn // 3 AS part, turn % 3 AS frame_idx FROM conversations), n AS (SELECT video_id, part, max(frame_idx) + 1 AS n FROM f GROUP BY 1, 2) SELECT f.video_id, f.part::BIGINT AS part, f.frame_idx::BIGINT AS frame_idx, (f.frame_idx + coalesce((SELECT sum(n.n) FROM n WHERE n.video_id = f.video_id AND n.part < f.part), 0))::BIGINT AS frame_no FROM f",
    "corridor_polygons": _with("labels plus", "#").replace(" #", ", reach4 AS (SELECT r, c, r::BIGINT * 1048576 + c AS part FROM mask UNION SELECT m.r, m.c, x.part FROM reach4 x, plus o, mask m WHERE m.r = x.r + o.dr AND m.c = x.c + o.dc AND x.part < m.r::BIGINT * 1048576 + m.c), four AS (SELECT r, c, min(part) AS part FROM reach4 GROUP BY r, c) SELECT raster_id, label, count(DISTINCT part) AS polygons, count(*)::DOUBLE AS area FROM labels JOIN four USING (r, c) GROUP BY 1, 2"),
    "convolution": _with("emb scene around plus step", "#").replace(" #", ", layer AS (SELECT c AS k, v * 4 AS x FROM emb WHERE r = 0), tap AS (SELECT ch.i AS ch, a.d AS dr, b.d AS dc, x AS wt FROM range(3) ch(i), step a, step b, layer WHERE k = ch.i * 9 + (a.d + 1) * 3 + b.d + 1) SELECT e.raster_id, e.r, e.c, round(greatest(sum(n.v * wt) + (SELECT x FROM layer WHERE k = 27), 0), 6) AS v FROM emb e, tap t, scene JOIN emb n ON n.r = e.r + t.dr AND n.c = (e.c + t.dc + t.ch) % w WHERE e.c + t.dc BETWEEN 0 AND w - 1 GROUP BY 1, 2, 3"),
    "odd_scene_checks": _with("affine", "SELECT raster_id, raster_id % 7 <> 0 AND raster_id % 11 <> 0 AS ok, CASE WHEN raster_id % 7 = 0 THEN 'no pixels' WHEN raster_id % 11 = 0 THEN 'no bands' END AS error, CASE WHEN projected AND px * CASE WHEN raster_id % 13 = 0 THEN 4 ELSE 1 END > 5 THEN 'coarse' WHEN raster_id % 5 = 0 THEN 'no reference system' END AS warning FROM affine"),
}
