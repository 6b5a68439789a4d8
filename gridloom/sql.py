"""DuckDB SQL of the queries: an independent statement of their rows, for checks."""

from __future__ import annotations

_PARTS = {
    "emb": "SELECT 0::BIGINT AS raster_id, vec_id::INTEGER AS r, (unnest(generate_series(1, len(embedding))) - 1)::INTEGER AS c, unnest(embedding)::DOUBLE AS v FROM embeddings",
    "scene": "SELECT max(len(embedding))::INTEGER AS w, (max(vec_id) + 1)::INTEGER AS h FROM embeddings",
    "ends": "SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM emb",
    "prob": "SELECT raster_id, r, c, least(greatest((v - lo) / (hi - lo), 0), 1) AS p FROM emb, ends",
    "mask": "SELECT raster_id, r, c FROM prob WHERE p >= 0.60",
    "wide": "SELECT raster_id, r, c FROM prob WHERE p >= 0.35",
    "other": "SELECT raster_id, r, c FROM prob WHERE 1 - p >= 0.35",
    "step": "SELECT unnest([-1, 0, 1]) AS d",
    "around": "SELECT a.d AS dr, b.d AS dc FROM step a, step b WHERE a.d <> 0 OR b.d <> 0",
    "plus": "SELECT a.d AS dr, b.d AS dc FROM step a, step b WHERE a.d = 0 OR b.d = 0",
    "reach": "SELECT r, c, r::BIGINT * 1048576 + c AS label FROM mask UNION SELECT m.r, m.c, x.label FROM reach x, around o, mask m WHERE m.r = x.r + o.dr AND m.c = x.c + o.dc AND x.label < m.r::BIGINT * 1048576 + m.c",
    "labels": "SELECT 0::BIGINT AS raster_id, r, c, min(label) AS label FROM reach GROUP BY r, c",
    "stats": "SELECT raster_id, label, count(*) AS area, min(c) AS x, min(r) AS y, max(c) - min(c) + 1 AS bbox_w, max(r) - min(r) + 1 AS bbox_h, sqrt(power(max(c) - min(c) + 1, 2) + power(max(r) - min(r) + 1, 2)) AS diagonal, greatest(max(c) - min(c) + 1, max(r) - min(r) + 1)::DOUBLE / (least(max(c) - min(c) + 1, max(r) - min(r) + 1) + 1e-6) AS aspect FROM labels GROUP BY raster_id, label",
    "empty": "SELECT e.r, e.c FROM emb e ANTI JOIN mask m ON e.r = m.r AND e.c = m.c",
    "up": "SELECT m.r, m.c, min(abs(m.r - e.r)) AS g FROM mask m LEFT JOIN empty e ON e.c = m.c GROUP BY ALL",
    "ground": "SELECT r, c, g FROM up UNION ALL SELECT r, c, 0 FROM empty",
    "dist": "SELECT 0::BIGINT AS raster_id, m.r, m.c, sqrt(min((m.c - g.c) * (m.c - g.c) + g.g * g.g)::DOUBLE) AS dist FROM mask m JOIN ground g ON g.r = m.r GROUP BY ALL",
    "seg": "SELECT label, 2.0 * dist * 0.5 AS w, p FROM labels JOIN dist USING (r, c) JOIN prob USING (r, c)",
    "met": "SELECT 0::BIGINT AS raster_id, label AS segment_id, round(count(*) * 0.5, 2)::DOUBLE AS length_m, round(avg(w), 2) AS mean_width_m, round(median(w), 2) AS median_width_m, round(min(w), 2) AS min_width_m, round(max(w), 2) AS max_width_m, (avg(w) >= 1.0 OR median(w) >= 0.9) AND count(*) * 0.5 >= 3.0 AS qualifies, round(avg(p), 3) AS confidence FROM seg GROUP BY label HAVING count(*) >= 3",
    "feet0": "SELECT label, 2.0 * dist * 3.0 * 3.28084 AS w FROM labels JOIN dist USING (r, c)",
    "feet1": "SELECT 0::BIGINT AS raster_id, label, count(*) AS n, avg(w) AS mean_ft, median(w) AS median_ft, max(w) AS max_ft FROM feet0 GROUP BY label HAVING count(*) >= 4",
    "feet2": "SELECT *, n * 3.0::DOUBLE / 1000.0 AS length_km, mean_ft >= 20 OR median_ft >= 17 OR max_ft >= 25 AS qualifies FROM feet1",
    "feet": "SELECT *, CASE WHEN NOT qualifies THEN 'filtered' WHEN mean_ft >= 40 THEN 'highway' ELSE 'arterial' END AS width_class FROM feet2",
    "scenes": "SELECT p_partkey AS raster_id, (256 + p_partkey % 1800)::INTEGER AS width, (256 + (p_size * 37) % 1300)::INTEGER AS height FROM part",
    "affine": "SELECT s_suppkey AS raster_id, s_suppkey % 3 <> 0 AS projected, CASE WHEN s_suppkey % 3 <> 0 THEN 0.1::DOUBLE + (s_suppkey % 40) / 10.0::DOUBLE ELSE (1 + s_suppkey % 9) / 1000000.0::DOUBLE END AS px, CASE WHEN s_suppkey % 3 <> 0 THEN 500000.0::DOUBLE ELSE 72.0::DOUBLE END AS x0, CASE WHEN s_suppkey % 3 <> 0 THEN 2500000.0::DOUBLE ELSE (s_suppkey % 60)::DOUBLE END AS y0 FROM supplier",
    "evt": "SELECT CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE 5 END::BIGINT AS raster_id, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS r, hour(ts)::INTEGER AS c, avg(value) AS v FROM events GROUP BY ALL",
    "evtp": "SELECT raster_id, r, c, CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE 0 END AS p FROM evt WINDOW w AS (PARTITION BY raster_id)",
    "rgb": "SELECT a.r AS day, a.c AS hour, a.p AS r, b.p AS g, d.p AS b FROM evtp a JOIN evtp b ON a.r = b.r AND a.c = b.c JOIN evtp d ON a.r = d.r AND a.c = d.c WHERE a.raster_id = 4 AND b.raster_id = 0 AND d.raster_id = 2",
    "hsv": "SELECT *, greatest(r, g, b) AS top, CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) END AS sat FROM rgb",
    "paths": "SELECT concat('DF/', lang, '/', doc_id::VARCHAR, '.png') AS path FROM documents WHERE lang IS NOT NULL AND doc_id IS NOT NULL",
    "road": """SELECT o_orderkey AS road_id, o_orderstatus AS st, (4 + o_custkey % 9)::DOUBLE AS width_m, (o_custkey % 1000)::DOUBLE AS x0, (10 * (o_orderkey // 15))::DOUBLE AS y0, x0 + 10 + (floor(o_totalprice)::BIGINT % 50)::DOUBLE AS x1,
      y0 + (o_custkey % 7)::DOUBLE AS y1, x1 + 10 + (o_custkey % 41)::DOUBLE AS x2, y0 + (o_orderkey % 5)::DOUBLE AS y2 FROM orders""",
    "piece": """SELECT road_id, st, 0 AS k, x0 AS ax, y0 AS ay, x1 AS bx, y1 AS "by" FROM road UNION ALL SELECT road_id, st, 1, x1, y1, x2, y2 FROM road""",
    "pairs": """SELECT n.kind, a.road_id, a.k, c.ax AS cax, c.ay AS cay, c.bx AS cbx, c."by" AS cby, a.ax - c.ax AS ox, a.ay - c.ay AS oy, a.ax, a.ay, a.bx - a.ax AS dx, a."by" - a.ay AS dy, c.bx - c.ax AS ex, c."by" - c.ay AS ey, sqrt(power(c.bx - c.ax, 2) + power(c."by" - c.ay, 2)) AS cl
      FROM (VALUES ('NEW_ROAD', 'O', 'F'), ('REMOVED_ROAD', 'F', 'O')) n(kind, own, theirs), (SELECT *, unnest([-10, 0, 10]) AS d FROM piece) a JOIN piece c ON c.road_id // 15 = a.road_id // 15 + a.d // 10 WHERE a.st IN (n.own, 'P') AND c.st IN (n.theirs, 'P') AND a.ax <= c.bx + 4 AND c.ax <= a.bx + 4""",
    "lin": "SELECT *, (ox * ex + oy * ey) / cl AS s0, (dx * ex + dy * ey) / cl AS s1, (oy * ex - ox * ey) / cl AS h0, (dy * ex - dx * ey) / cl AS h1, dx * dx + dy * dy AS q, dx * ox + dy * oy AS m1, ox * ox + oy * oy - 12.25 AS n1, dx * (ax - cbx) + dy * (ay - cby) AS m2, power(ax - cbx, 2) + power(ay - cby, 2) - 12.25 AS n2 FROM pairs",
    "ivs": """SELECT kind, road_id, k, greatest(CASE WHEN abs(s1) < 1e-12 THEN CASE WHEN s0 BETWEEN 0 AND cl THEN 0 ELSE 2 END ELSE least(-s0 / s1, (cl - s0) / s1) END, CASE WHEN abs(h1) < 1e-12 THEN CASE WHEN h0 BETWEEN -3.5 AND 3.5 THEN 0 ELSE 2 END ELSE least((-3.5 - h0) / h1, (3.5 - h0) / h1) END) AS a0,
      least(CASE WHEN abs(s1) < 1e-12 THEN CASE WHEN s0 BETWEEN 0 AND cl THEN 1 ELSE -1 END ELSE greatest(-s0 / s1, (cl - s0) / s1) END, CASE WHEN abs(h1) < 1e-12 THEN CASE WHEN h0 BETWEEN -3.5 AND 3.5 THEN 1 ELSE -1 END ELSE greatest((-3.5 - h0) / h1, (3.5 - h0) / h1) END) AS a1,
      CASE WHEN m1 * m1 >= q * n1 THEN (-m1 - sqrt(greatest(m1 * m1 - q * n1, 0))) / q ELSE 2 END AS b0, CASE WHEN m1 * m1 >= q * n1 THEN (-m1 + sqrt(greatest(m1 * m1 - q * n1, 0))) / q ELSE -1 END AS b1,
      CASE WHEN m2 * m2 >= q * n2 THEN (-m2 - sqrt(greatest(m2 * m2 - q * n2, 0))) / q ELSE 2 END AS c0, CASE WHEN m2 * m2 >= q * n2 THEN (-m2 + sqrt(greatest(m2 * m2 - q * n2, 0))) / q ELSE -1 END AS c1 FROM lin""",
    "cov": "SELECT kind, road_id, k, greatest(0, least(CASE WHEN a1 >= a0 THEN a0 ELSE 2 END, CASE WHEN b1 >= b0 THEN b0 ELSE 2 END, CASE WHEN c1 >= c0 THEN c0 ELSE 2 END)) AS lo, least(1, greatest(CASE WHEN a1 >= a0 THEN a1 ELSE -1 END, CASE WHEN b1 >= b0 THEN b1 ELSE -1 END, CASE WHEN c1 >= c0 THEN c1 ELSE -1 END)) AS hi FROM ivs",
    "all_iv": "SELECT * FROM cov WHERE hi > lo UNION ALL SELECT 'NEW_ROAD', road_id, k, 1, 1 FROM piece WHERE st IN ('O', 'P') UNION ALL SELECT 'REMOVED_ROAD', road_id, k, 1, 1 FROM piece WHERE st IN ('F', 'P')",
    "gaps": "SELECT kind, road_id, k, coalesce(max(hi) OVER (PARTITION BY kind, road_id, k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g0, lo AS g1 FROM all_iv",
    "holes": "SELECT *, CASE WHEN k = 1 AND g0 = 0 AND lag(k) OVER w = 0 AND lag(g1) OVER w = 1 THEN 0 ELSE 1 END AS begins FROM gaps WHERE g1 > g0 WINDOW w AS (PARTITION BY kind, road_id ORDER BY k, g0)",
    "runs": "SELECT *, sum(begins) OVER (PARTITION BY kind, road_id ORDER BY k, g0)::INTEGER AS part FROM holes",
    "changed": """SELECT kind AS change_type, road_id AS source_id, part, sum((g1 - g0) * sqrt(power(bx - ax, 2) + power("by" - ay, 2))) AS length_m, max(width_m) AS width_m, 0.9::DOUBLE AS confidence FROM runs JOIN piece USING (road_id, k) JOIN road USING (road_id) GROUP BY 1, 2, 3""",
    "change": "SELECT change_type, source_id, part, round(length_m, 2) AS length_m, round(width_m, 2) AS width_m, confidence FROM changed WHERE length_m >= 20",
}

#: What each part is built from.
_NEEDS = {
    "ends": "emb", "prob": "emb ends", "mask": "prob", "wide": "prob", "other": "prob", "around": "step", "plus": "step", "reach": "mask around", "labels": "reach", "stats": "labels",
    "empty": "emb mask", "up": "mask empty", "ground": "up empty", "dist": "mask ground", "seg": "labels dist prob", "met": "seg", "feet0": "labels dist", "feet1": "feet0", "feet2": "feet1", "feet": "feet2",
    "evtp": "evt", "rgb": "evtp", "hsv": "rgb", "piece": "road", "pairs": "piece", "lin": "pairs", "ivs": "lin", "cov": "ivs", "all_iv": "cov piece", "gaps": "all_iv", "holes": "gaps", "runs": "holes", "changed": "runs piece road", "change": "changed",
}


def _with(needs: str, query: str) -> str:
    """The query after the parts it needs, in an order that defines each before its use."""
    seen: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, "").split():
            add(n)
        if name not in seen:
            seen.append(name)

    for n in needs.split():
        add(n)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({_PARTS[n]})" for n in seen) + " " + query


def _grid(rows: str, cols: str, select: str, first: int = 0) -> str:
    return _with("scenes", f"""SELECT {select} FROM (SELECT *, (row_number() OVER (PARTITION BY raster_id ORDER BY row_off, col_off) - 1 + {first})::INTEGER AS tile_id
      FROM (SELECT *, unnest({cols})::INTEGER AS col_off FROM (SELECT *, unnest({rows})::INTEGER AS row_off FROM scenes)))""")


def _clamped(n: str, tile: int, stride: int) -> str:
    return f"list_sort(list_distinct(list_transform(range(0, {n}, {stride}), lambda x: least(x, greatest({n} - {tile}, 0)))))"


def _sliding(n: str, tile: int, stride: int, tail: bool = False) -> str:
    plain = f"range(0, greatest({n} - {tile}, 0) + 1, {stride})"
    return f"list_sort(list_distinct(list_append({plain}, greatest({n} - {tile}, 0)::BIGINT)))" if tail else plain


def _crops(n: str, crop: int, step: int, thresh: int) -> str:
    starts = f"range(0, greatest({n} - {crop}, 0) + 1, {step})"
    return f"CASE WHEN {n} < {crop} THEN [] WHEN {n} - (list_last({starts}) + {crop}) > {thresh} THEN list_append({starts}, ({n} - {crop})::BIGINT) ELSE {starts} END"


def _sub_images(sizes: tuple[int, int, int]) -> str:
    suffix = "'_s' || CASE WHEN tile_id < 1000 THEN lpad(tile_id::VARCHAR, 3, '0') ELSE tile_id::VARCHAR END AS suffix"
    return _grid(_crops("height", *sizes), _crops("width", *sizes), f"raster_id, tile_id AS crop_id, col_off, row_off, {suffix}, {sizes[0]} AS crop_size", 1)


_TILE = "raster_id, tile_id, col_off, row_off, least({0}, width)::INTEGER AS tile_width, least({0}, height)::INTEGER AS tile_height"
_NEAR = "SELECT raster_id, r, c, {} FROM (SELECT b.raster_id, b.r, b.c, a.v, b.dr, b.dc FROM (SELECT e.raster_id, e.r, e.c, dr, dc, least(greatest(r + dr, 0), h - 1) AS r2, least(greatest(c + dc, 0), w - 1) AS c2 FROM emb e, scene, (SELECT x.d AS dr, y.d AS dc FROM step x, step y) o) b JOIN (SELECT r, c, p AS v FROM prob) a ON a.r = b.r2 AND a.c = b.c2) GROUP BY raster_id, r, c"
_GAUSS = "(CASE {0} WHEN 0 THEN 1 ELSE exp(-1 / 1.28) END / (1 + 2 * exp(-1 / 1.28)))"


def _dilated(source: str, offsets: str) -> str:
    return f"SELECT DISTINCT m.raster_id, (m.r + dr)::INTEGER AS r, (m.c + dc)::INTEGER AS c FROM {source} m, {offsets} o, scene WHERE m.r + dr BETWEEN 0 AND h - 1 AND m.c + dc BETWEEN 0 AND w - 1"


def _eroded(source: str, offsets: str) -> str:
    """Pixels without a neighbour inside the scene that is missing from the mask."""
    return f"SELECT m.raster_id, m.r, m.c FROM {source} m, {offsets} o, scene LEFT JOIN {source} n ON n.r = m.r + dr AND n.c = m.c + dc WHERE m.r + dr BETWEEN 0 AND h - 1 AND m.c + dc BETWEEN 0 AND w - 1 GROUP BY m.raster_id, m.r, m.c HAVING count(*) = count(n.r)"


_SQUARE5 = "(SELECT x.i - 2 AS dr, y.i - 2 AS dc FROM range(5) x(i), range(5) y(i))"
_SQUARE = "(SELECT x.d AS dr, y.d AS dc FROM step x, step y)"
_TILED = """, placed AS (SELECT e.*, t.tile_id, t.row_off, t.col_off FROM emb e JOIN (SELECT row_off, col_off, row_number() OVER (ORDER BY row_off, col_off) - 1 AS tile_id FROM (SELECT *, unnest(list_sort(list_distinct(list_transform(range(0, w, 24), lambda x: least(x, greatest(w - 32, 0)))))) AS col_off FROM (SELECT *, unnest(list_sort(list_distinct(list_transform(range(0, h, 24), lambda x: least(x, greatest(h - 32, 0)))))) AS row_off FROM scene))) t
  ON e.r >= row_off AND e.r < row_off + 32 AND e.c >= col_off AND e.c < col_off + 32), pred AS (SELECT *, CASE WHEN max(v) OVER t > min(v) OVER t THEN (v - min(v) OVER t) / (max(v) OVER t - min(v) OVER t) ELSE 0 END AS p FROM placed WINDOW t AS (PARTITION BY tile_id))"""
_W = "exp(-(power(r - row_off - 15.5, 2) + power(c - col_off - 15.5, 2)) / 128.0)"


def _tiled(query: str) -> str:
    return _with("emb scene", "#").replace(" #", _TILED + " " + query)


_STATS = "raster_id, label, area, x, y, bbox_w, bbox_h, round(diagonal, 6) AS diagonal, round(aspect, 6) AS aspect"

SQL = {
    "tile_windows": _grid(_clamped("height", 512, 384), _clamped("width", 512, 384), _TILE.format(512) + ", width AS source_width, height AS source_height"),
    "tile_windows_sliding": _grid(_sliding("height", 256, 64), _sliding("width", 256, 64), _TILE.format(256)),
    "tile_windows_tail": _grid(_sliding("height", 256, 64, True), _sliding("width", 256, 64, True), _TILE.format(256)),
    "subimage_grid": _sub_images((240, 120, 60)) + " UNION ALL " + f"SELECT * FROM ({_sub_images((480, 240, 0))})",
    "tile_batches": _grid(_clamped("height", 512, 384), _clamped("width", 512, 384), "raster_id, (tile_id // 4)::INTEGER AS batch_id, count(*) AS tiles") + " GROUP BY ALL",
    "pad_sizes": _with("scenes", "SELECT raster_id, ((32 - width % 32) % 32)::INTEGER AS pad_w, ((32 - height % 32) % 32)::INTEGER AS pad_h FROM scenes"),
    "training_patches": _grid(_sliding("height", 128, 32), _sliding("width", 128, 32), _TILE.format(128) + ", unnest([false, true]) AS flipped"),
    "scaled_sizes": _with("scenes", "SELECT raster_id, k AS n, floor(width * s)::BIGINT AS out_w, floor(height * s)::BIGINT AS out_h FROM scenes, (VALUES (0, 0.75::DOUBLE), (1, 0.5::DOUBLE), (2, 1::DOUBLE / 3)) t(k, s) UNION ALL SELECT raster_id, 3, floor(width * 400 / least(width, height)::DOUBLE)::BIGINT, floor(height * 400 / least(width, height)::DOUBLE)::BIGINT FROM scenes"),
    "read_window": _with("emb scene", "SELECT 0::BIGINT AS raster_id, a.i::INTEGER AS wr, b.i::INTEGER AS wc, round(v, 6) AS v FROM range(16) a(i), range(32) b(i), scene, emb e WHERE e.r = 10 + a.i AND e.c = 40 + CASE WHEN b.i < 24 THEN b.i ELSE 46 - b.i END"),
    "tile_halo": _with("emb", "SELECT (e.r // 32 + x.d)::INTEGER AS tile_r, (e.c // 32 + y.d)::INTEGER AS tile_c, count(*) AS pixels, count_if(x.d = 0 AND y.d = 0) AS own FROM emb e, (SELECT unnest([-1, 0, 1]) AS d) x, (SELECT unnest([-1, 0, 1]) AS d) y WHERE e.r // 32 + x.d >= 0 AND e.c // 32 + y.d >= 0 AND e.r >= (e.r // 32 + x.d) * 32 - 4 AND e.r < (e.r // 32 + x.d + 1) * 32 + 4 AND e.c >= (e.c // 32 + y.d) * 32 - 4 AND e.c < (e.c // 32 + y.d + 1) * 32 + 4 GROUP BY ALL"),
    "percentile_stretch": _with("prob", "SELECT raster_id, r, c, round(p, 6) AS p FROM prob"),
    "minmax_stretch": _with("emb", "SELECT raster_id, r, c, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS p FROM emb"),
    "percentile_stretch_by_band": _with("evt", "SELECT raster_id, r, c, round(CASE WHEN hi <= lo THEN 0 ELSE least(greatest((v - lo) / (hi - lo), 0), 1) END, 6) AS p FROM evt JOIN (SELECT raster_id, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM evt GROUP BY 1) USING (raster_id)"),
    "percentile_scale": _with("emb", "SELECT raster_id, r, c, round(least(greatest(v / (t + 1e-8), 0), 1), 6) AS p FROM emb, (SELECT quantile_cont(v, 0.99) AS t FROM emb)"),
    "to_uint8": _with("emb ends", "SELECT raster_id, r, c, trunc(least(greatest((v - lo) / (hi - lo + 1e-6) * 255, 0), 255))::INTEGER AS u8 FROM emb, ends"),
    "fuse_prob": _with("prob", "SELECT raster_id, r, c, round(0.65 * p + 0.35 * ((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ())), 6) AS p FROM prob JOIN emb USING (raster_id, r, c)"),
    "predict_tiles": _tiled(f"SELECT raster_id, r, c, round(least(greatest(sum(p * {_W}) / sum({_W}), 0), 1), 6) AS p FROM pred GROUP BY raster_id, r, c"),
    "blend_uniform": _tiled("SELECT raster_id, r, c, round(avg(p), 6) AS p FROM pred GROUP BY raster_id, r, c"),
    "threshold_mask": _with("mask", "SELECT * FROM mask"),
    "dilate_rect": _with("mask step scene", _dilated("mask", _SQUARE)),
    "erode_rect": _with("wide step scene", _eroded("wide", _SQUARE)),
    "close_open": _with("mask step scene", "#").replace(" #", f", d1 AS ({_dilated('mask', _SQUARE5)}), e1 AS ({_eroded('d1', _SQUARE5)}), e2 AS ({_eroded('e1', _SQUARE)}) {_dilated('e2', _SQUARE)}"),
    "dilate_2x2": _with("mask scene", _dilated("mask", "(SELECT x.i AS dr, y.i AS dc FROM range(2) x(i), range(2) y(i))")),
    "dilate_plus": _with("mask plus scene", _dilated("mask", "plus")),
    "erode_plus": _with("wide plus scene", _eroded("wide", "plus")),
    "mask_union": _with("mask other", "SELECT * FROM mask UNION SELECT * FROM other"),
    "mask_intersect": _with("mask other", "SELECT * FROM mask INTERSECT SELECT * FROM other"),
    "mask_except": _with("mask other", "SELECT * FROM mask EXCEPT SELECT * FROM other"),
    "raster_change": _with("mask other", "SELECT *, 'New_Road_Constructed' AS change_type FROM (SELECT * FROM other EXCEPT SELECT * FROM mask) UNION ALL SELECT *, 'Road_Decommissioned' FROM (SELECT * FROM mask EXCEPT SELECT * FROM other)"),
    "crop_border": _with("mask scene", "SELECT raster_id, (r - CASE WHEN h > 300 THEN 50 ELSE 0 END)::INTEGER AS r, (c - CASE WHEN h > 300 AND w > 300 THEN 15 ELSE 0 END)::INTEGER AS c FROM mask, scene WHERE h <= 300 OR (r >= 50 AND r < h - 45 AND (w <= 300 OR (c >= 15 AND c < w - 15)))"),
    "mask_boundary": _with("mask plus", "SELECT m.raster_id, m.r, m.c FROM mask m, plus o LEFT JOIN mask n ON n.r = m.r + dr AND n.c = m.c + dc GROUP BY ALL HAVING count(n.r) < 5"),
    "corridor_area": _with("mask", "SELECT raster_id, count(*) * (0.3::DOUBLE * 0.3::DOUBLE) AS area_m2 FROM mask GROUP BY 1"),
    "overlay": _with("prob", "SELECT raster_id, r, c, round(CASE WHEN p >= 0.60 THEN p * 0.3 + 0.7 ELSE p END, 6) AS v FROM prob"),
    "gaussian_smooth": _with("prob scene step", _NEAR.format(f"round(sum(v * {_GAUSS.format('dr')} * {_GAUSS.format('dc')}), 6) AS v")).replace("least(greatest(r + dr, 0), h - 1)", "CASE WHEN r + dr < 0 THEN 1 WHEN r + dr >= h THEN h - 2 ELSE r + dr END").replace("least(greatest(c + dc, 0), w - 1)", "CASE WHEN c + dc < 0 THEN 1 WHEN c + dc >= w THEN w - 2 ELSE c + dc END"),
    "box_mean": _with("prob scene step", _NEAR.format("round(avg(v), 6) AS v")),
    "median_filter": _with("prob scene step", _NEAR.format("round(median(v), 6) AS v").replace("(SELECT x.d AS dr, y.d AS dc FROM step x, step y)", "(SELECT x.i - 3 AS dr, y.i - 3 AS dc FROM range(7) x(i), range(7) y(i))")),
    "sobel_gradient": _with("prob scene step", "SELECT raster_id, r, c, round(gx, 6) AS gx, round(gy, 6) AS gy, round(sqrt(gx * gx + gy * gy), 6) AS magnitude FROM (" + _NEAR.format("sum(v * dc * (2 - abs(dr))) AS gx, sum(v * dr * (2 - abs(dc))) AS gy") + "), scene WHERE r > 0 AND c > 0 AND r < h - 1 AND c < w - 1"),
    "endpoints": _with("mask around", "SELECT m.raster_id, m.r, m.c FROM mask m, around o, mask n WHERE n.r = m.r + dr AND n.c = m.c + dc GROUP BY ALL HAVING count(*) = 1"),
    "neighbour_count": _with("mask around", "SELECT m.raster_id, m.r, m.c, count(n.r) AS n FROM mask m, around o LEFT JOIN mask n ON n.r = m.r + dr AND n.c = m.c + dc GROUP BY m.raster_id, m.r, m.c"),
    "distance_transform": _with("dist", "SELECT raster_id, r, c, round(dist, 6) AS dist FROM dist"),
    "width_band": _with("dist", "SELECT raster_id, r, c, round(dist, 6) AS dist, round(dist * 4, 6) AS w FROM dist WHERE dist * 4 BETWEEN 4.5 AND 7.5"),
    "components": _with("labels", "SELECT raster_id, r, c, label FROM labels"),
    "component_stats": _with("stats", f"SELECT {_STATS} FROM stats"),
    "shape_filter": _with("stats", f"SELECT {_STATS} FROM stats WHERE area >= 20 AND (diagonal >= 12 OR aspect >= 1.6)"),
    "area_filter": _with("stats", "SELECT raster_id, r, c FROM labels SEMI JOIN (SELECT label FROM stats WHERE area >= 20) k USING (label)"),
    "hysteresis": _with("labels prob", "SELECT raster_id, r, c, label FROM labels WHERE label IN (SELECT label FROM labels JOIN prob USING (r, c) WHERE p >= 0.85)"),
    "branch_hysteresis": _with("labels prob", "SELECT l.raster_id, label, count(*) AS area, round(max(p), 6) AS max_p FROM labels l JOIN prob USING (r, c) GROUP BY 1, 2 HAVING max(p) >= 0.85 AND count(*) >= 8"),
    "segment_widths": _with("met", "SELECT * FROM met"),
    "qualify_20ft": _with("met", "SELECT * FROM met WHERE qualifies"),
    "road_filter": _with("met", "SELECT * FROM met WHERE mean_width_m >= 1.0 AND length_m >= 3.0 AND confidence >= 0.7"),
    "qualify_permissive": _with("feet", "SELECT raster_id, label, n, round(mean_ft, 6) AS mean_ft, round(median_ft, 6) AS median_ft, round(max_ft, 6) AS max_ft, round(length_km, 6) AS length_km, qualifies, width_class FROM feet"),
    "width_classes": _with("feet", "SELECT raster_id, width_class, count(*) AS segments, round(sum(length_km), 6) AS length_km FROM feet GROUP BY 1, 2"),
    "segment_totals": _with("feet", "SELECT raster_id, count(*) AS total, count_if(qualifies) AS qualified, count_if(NOT qualifies) AS filtered, round(coalesce(sum(length_km) FILTER (qualifies), 0), 6) AS length_km FROM feet GROUP BY 1"),
    "dice_score": _with("prob", "SELECT raster_id, round(1 - (2 * sum(CASE WHEN v > 0 THEN p ELSE 0 END) + 1) / (sum(p) + count_if(v > 0) + 1), 6) AS dice_loss FROM prob JOIN emb USING (raster_id, r, c) GROUP BY 1"),
    "gsd_table": _with("affine", "SELECT raster_id, round(g, 6) AS gsd, round(6.096 / greatest(g, 1e-6), 6) AS road_px, g <= 3.5 AS reliable FROM (SELECT raster_id, CASE WHEN projected THEN (px + px) / 2 ELSE (px * 111139.0::DOUBLE * cos(radians(y0 - px * 768 / 2)) + px * 111139.0::DOUBLE) / 2 END AS g FROM affine)"),
    "scene_checks": _with("affine", "SELECT raster_id, true AS ok, NULL::VARCHAR AS error, CASE WHEN CASE WHEN projected THEN px ELSE 0 END > 5 THEN 'coarse' END AS warning FROM affine"),
    "pixel_to_world": _with("affine", "SELECT raster_id, round(px * 10.5::DOUBLE + x0, 6) AS x, round(y0 - px * 20.5::DOUBLE, 6) AS y, round(x0, 6) AS west, round(y0 - px * 768, 6) AS south, round(x0 + px * 1024, 6) AS east, round(y0, 6) AS north FROM affine"),
    "spectral_mask": _with("hsv", "SELECT day, hour FROM hsv WHERE sat < 0.28 AND top > 0.18 AND top < 0.94"),
    "spectral_index": _with("hsv", "SELECT day, hour, round(0.299 * r + 0.587 * g + 0.114 * b, 6) AS gray, round((g - r) / (g + r + 1e-6), 6) AS vegetation, round(CASE WHEN 0.299 * r + 0.587 * g + 0.114 * b > 0.2 THEN least(greatest(1 - (2.5 * ((g - r) / (g + r + 1e-6)) + 1.2 * sat), 0), 1) ELSE 0 END, 6) AS asphalt FROM hsv"),
    "road_lengths": _with("road", "SELECT road_id, round(sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) + sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)), 6) AS length_m, x2 > x0 AS valid FROM road WHERE st IN ('O', 'P')"),
    "change_all": _with("change", "SELECT * FROM change"),
    "change_new": _with("change", "SELECT * FROM change WHERE change_type = 'NEW_ROAD'"),
    "change_removed": _with("change", "SELECT * FROM change WHERE change_type = 'REMOVED_ROAD'"),
    "meta_paths": _with("paths", "SELECT 'gt/' || split_part(path, ' ', 1) AS path FROM paths"),
    "path_keys": _with("paths", "SELECT split_part(path, '.', 1) AS key FROM paths"),
    "pair_meta": _with("paths", "SELECT 'gt/' || path AS gt_path, 'lq/x4/' || path AS lq_path FROM paths"),
    "pair_zip": _with("paths", "SELECT row_number() OVER (ORDER BY path) - 1 AS idx, path AS gt_path, 'LQ/' || path AS lq_path FROM paths"),
    "worker_partition": "SELECT conv_id AS video_id, turn AS frame_idx, (turn // ceil(n / 3.0)::BIGINT)::BIGINT AS worker, least(turn // greatest(n // 2, 1), 1)::BIGINT AS slice FROM conversations JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) USING (conv_id)",
    "config_merge": "SELECT key, CASE WHEN o.v IS NOT NULL THEN o.v ELSE b.v END AS value FROM (SELECT n_name AS key, n_regionkey::VARCHAR AS v FROM nation) b FULL JOIN (SELECT r_name AS key, 'region' AS v FROM region UNION ALL SELECT n_name, 'override' FROM nation WHERE n_nationkey % 5 = 0) o USING (key)",
    "checkpoint_keys": "SELECT s_name AS key, s_acctbal FROM supplier",
    "weight_interp": "WITH x AS (SELECT vec_id AS key, label, (unnest(generate_series(1, len(embedding))) - 1)::INTEGER AS i, unnest(embedding)::DOUBLE AS w FROM embeddings) SELECT key, i, round(0.7 * w + 0.3 * avg(w) OVER (PARTITION BY label, i), 6) AS w FROM x",
}

#: Queries on tables of tiles have the rows of those on pixels.
_TILES = {"dilate": "dilate_rect", "erode": "erode_rect", "close_open": "close_open", "plus": "dilate_plus", "gaussian": "gaussian_smooth", "sobel": "sobel_gradient", "median": "median_filter", "neighbours": "neighbour_count", "components": "components", "distance": "distance_transform"}
SQL |= {f"tiles_{k}": SQL[v] for k, v in _TILES.items()}
