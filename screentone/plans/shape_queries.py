"""Queries over pixel tables: grids, lattices, resampling, separation and marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screentone import fixtures as fx
from screentone.functions import formulas as X
from screentone.operators import colour, grid, marks

R = X.rounded
REACH = grid.reach(fx.MIN_MARK, fx.MAX_MARK, fx.GRID_SCALE, grid.CIRCLE)
INKS = [f"ink_{i}" for i in "cmyk"]


def _r(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*keys, *[F.expr(R(v)).alias(v) for v in values])


def _sr(values: list[str]) -> str:
    return ", ".join(f"{R(v)} AS {v}" for v in values)


def _sized_images(spark, sf):
    return fx.images(spark, sf).withColumns({"src_w": F.lit(8), "src_h": F.lit(8)})


def _dims(spark, sf):
    """Native settings of each image."""
    return spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id AS image_id", *_DIMS)


_DIMS = [
    "8e0 AS width",
    "8e0 AS height",
    "0e0 + vec_id % 100 AS detail",
    "80e0 + vec_id % 40 AS coverage",
    "90e0 + vec_id % 50 AS contrast",
    "0e0 + vec_id % 30 AS angle",
    "CASE vec_id % 3 WHEN 0 THEN 'dots' WHEN 1 THEN 'squares' ELSE 'lines' END AS treatment",
]
DIMS_SQL = f"SELECT vec_id AS image_id, {', '.join(_DIMS)} FROM embeddings"
PART_DIMS = ["p_partkey AS image_id", "40e0 + p_size * 10 AS width", "30e0 + p_partkey % 200 AS height", "0e0 + p_partkey % 100 AS detail"]


def _cg(spark, sf):
    return grid.channel_grid(fx.images(spark, sf), colour.active_channels(fx.channels(spark)))


_G = X.grid("out_w", "out_h", "cells * greatest(5e-2, resolution_scale)")
CG = {
    "cg0": f"SELECT i.*, c.*, {_G['cols']} AS cols, {_G['rows']} AS rows FROM images i, channels c WHERE c.enabled",
    "cg": "SELECT *, out_w / cols AS cell_w, out_h / rows AS cell_h FROM cg0",
}


def _range_sql() -> dict[str, str]:
    flat = "abs(grid_rotation) <= 1e-4"
    corners = [grid._turn(x, y, "-") for x, y in (("-margin", "-margin"), ("(out_w + margin)", "-margin"), ("(out_w + margin)", "(out_h + margin)"), ("-margin", "(out_h + margin)"))]
    xs, ys = (", ".join(c[i] for c in corners) for i in (0, 1))
    at = lambda f, g, v, p, c: f"CAST({f}(({g}({v}) - {p}) / {c} - 5e-1) AS INT)"
    return CG | {
        "m": f"SELECT *, {REACH} AS margin, {X.wrap_signed('offset_x', 'cell_w')} AS phase_x, {X.wrap_signed('offset_y', 'cell_h')} AS phase_y FROM cg",
        "lr": f"SELECT *, CASE WHEN {flat} THEN 0 ELSE {at('floor', 'least', xs, 'phase_x', 'cell_w')} END AS col0, CASE WHEN {flat} THEN cols - 1 ELSE {at('ceil', 'greatest', xs, 'phase_x', 'cell_w')} END AS col1, "
        f"CASE WHEN {flat} THEN 0 ELSE {at('floor', 'least', ys, 'phase_y', 'cell_h')} END AS row0, CASE WHEN {flat} THEN rows - 1 ELSE {at('ceil', 'greatest', ys, 'phase_y', 'cell_h')} END AS row1 FROM m",
        "lat0": "SELECT *, CAST(unnest(range(col0, col1 + 1)) AS INT) AS col FROM lr",
        "lat": "SELECT *, CAST(unnest(range(row0, row1 + 1)) AS INT) AS \"row\" FROM lat0",
        "lp": f"SELECT *, CASE WHEN {flat} THEN {X.modulo('((col + 5e-1) * cell_w + phase_x)', 'out_w')} ELSE (col + 5e-1) * cell_w + phase_x END AS lx, CASE WHEN {flat} THEN {X.modulo('((row + 5e-1) * cell_h + phase_y)', 'out_h')} ELSE (\"row\" + 5e-1) * cell_h + phase_y END AS ly FROM lat".replace("(row +", '("row" +'),
        "pl": "SELECT *, {} AS x, {} AS y FROM lp".format(*grid._turn("lx", "ly", "")),
        "cu": "SELECT * FROM pl WHERE x >= -margin AND x <= out_w + margin AND y >= -margin AND y <= out_h + margin",
        "lk": "SELECT *, CAST(least(cols - 1, greatest(0, floor(x / cell_w))) AS INT) AS s_col, CAST(least(rows - 1, greatest(0, floor(y / cell_h))) AS INT) AS s_row FROM cu",
    }


RANGES = _range_sql()


def _upto(name: str) -> dict[str, str]:
    keys = list(RANGES)
    return {k: RANGES[k] for k in keys[: keys.index(name) + 1]}


def _taps_sql(src: str, dst: str) -> str:
    """Source taps of one axis under the triangle filter, by an interval join instead of a sequence."""
    return (
        f"SELECT t.image_id, t.{dst} AS size, o.o AS out, j.j AS tap, greatest(0e0, 1e0 - abs((j.j - (o.o + 5e-1) * (8e0 / t.{dst}) + 5e-1) / greatest(8e0 / t.{dst}, 1e0))) AS w "
        f"FROM (SELECT DISTINCT image_id, {dst} FROM targets) t JOIN (SELECT unnest(range(40)) AS o) o ON o.o < t.{dst} CROSS JOIN (SELECT unnest(range(8)) AS j) j "
        f"WHERE greatest(0e0, 1e0 - abs((j.j - (o.o + 5e-1) * (8e0 / t.{dst}) + 5e-1) / greatest(8e0 / t.{dst}, 1e0))) > 0"
    )


def _mean(w: str) -> str:
    return ", ".join(f"sum({w} * {p}) / sum({w}) AS {p}" for p in ("pr", "pg", "pb", "pa"))


RESAMPLE = {
    "wx": _taps_sql("src_w", "cols"),
    "wy": _taps_sql("src_h", "rows"),
    "pm": "SELECT image_id, x, y, r * a / 255e0 AS pr, g * a / 255e0 AS pg, b * a / 255e0 AS pb, CAST(a AS DOUBLE) AS pa FROM pixels",
    "ac": f"SELECT pm.image_id, wx.size AS cols, wx.out AS col, y, {_mean('w')} FROM pm JOIN wx ON pm.image_id = wx.image_id AND pm.x = wx.tap GROUP BY ALL",
    "dn": f"SELECT ac.image_id, ac.cols, t.rows, col, wy.out AS \"row\", {_mean('w')} FROM ac JOIN (SELECT DISTINCT image_id, cols, rows FROM targets) t ON ac.image_id = t.image_id AND ac.cols = t.cols JOIN wy ON wy.image_id = ac.image_id AND wy.size = t.rows AND wy.tap = ac.y GROUP BY ALL",
    "cells": f"SELECT image_id, cols, rows, CAST(col AS INT) AS col, CAST(\"row\" AS INT) AS \"row\", {', '.join(f'CASE WHEN {X.byte("pa")} = 0 THEN 0 ELSE {X.byte(f"p{i} * 255e0 / pa")} END AS {i}' for i in 'rgb')}, {X.byte('pa')} AS a FROM dn",
}
RESAMPLE["ac"] = RESAMPLE["ac"].replace("GROUP BY ALL", "GROUP BY pm.image_id, wx.size, wx.out, y")
RESAMPLE["dn"] = RESAMPLE["dn"].replace("GROUP BY ALL", "GROUP BY ac.image_id, ac.cols, t.rows, col, wy.out")

_G1 = X.grid("out_w", "out_h", "cells")
GRID1 = {"g0": f"SELECT *, {_G1['cols']} AS cols, {_G1['rows']} AS rows FROM images", "g1": "SELECT *, out_w / cols AS cell_w, out_h / rows AS cell_h FROM g0"}
TARGETS1 = GRID1 | {"targets": "SELECT image_id, 8 AS src_w, 8 AS src_h, cols, rows FROM g1"}
TARGETS2 = {"targets": "SELECT DISTINCT image_id, 8 AS src_w, 8 AS src_h, cols, rows FROM cg"}

CM = X.cmyk()
CMYK_SQL = ", ".join(f"{v} AS ink_{k}" for k, v in CM.items())
UNPIVOT = lambda src, keys: " UNION ALL ".join(f"SELECT {keys}, '{i}' AS channel, ink_{i} AS value FROM {src}" for i in "cmyk")


def c1_calculate_grid(spark, sf):
    return _r(grid.calculate_grid(fx.images(spark, sf)), ["image_id", "cols", "rows"], ["cell_w", "cell_h"])


def c2_channel_grid(spark, sf):
    return _r(_cg(spark, sf), ["image_id", "channel", "cols", "rows"], ["cell_w", "cell_h"])


def c3_native_grid(spark, sf):
    d = spark.read.parquet(f"{sf}/part.parquet").selectExpr(*PART_DIMS)
    return _r(grid.native_grid(d), ["image_id", "cols", "rows"], ["spacing"])


def _ranges(spark, sf):
    return grid.lattice_ranges(_cg(spark, sf), REACH)


def c4_lattice_ranges(spark, sf):
    return _r(_ranges(spark, sf), ["image_id", "channel", "col0", "col1", "row0", "row1"], ["margin", "phase_x", "phase_y"])


def c5_lattice(spark, sf):
    return grid.lattice(_ranges(spark, sf)).groupBy("image_id", "channel").agg(F.count("*").alias("n"), F.sum("col").alias("sum_col"), F.sum("row").alias("sum_row"))


def c6_place_lattice(spark, sf):
    return _r(grid.place_lattice(grid.lattice(_ranges(spark, sf))), ["image_id", "channel", "col", "row"], ["x", "y"])


def c7_cull(spark, sf):
    c = grid.cull(grid.place_lattice(grid.lattice(_ranges(spark, sf))))
    return c.groupBy("image_id", "channel").agg(F.count("*").alias("n"), F.min("col").alias("min_col"), F.max("row").alias("max_row"))


def c8_lookup_cell(spark, sf):
    c = grid.lookup_cell(grid.cull(grid.place_lattice(grid.lattice(_ranges(spark, sf)))))
    return c.select("image_id", "channel", "col", "row", "s_col", "s_row")


def c9_sample_nearest(spark, sf):
    hit = grid.sample_nearest(grid.native_cells(grid.native_grid(_dims(spark, sf))), fx.pixels(spark, sf))
    return hit.select("image_id", "col", "row", "r", "g", "b", "a")


def c10_resample_area(spark, sf):
    t = grid.calculate_grid(_sized_images(spark, sf)).select("image_id", "src_w", "src_h", "cols", "rows")
    return grid.resample(fx.pixels(spark, sf), t)


def _points(df):
    return df.selectExpr("image_id", "x + 10 * y AS point_id", "8 AS cols", "8 AS rows", "x * 11e-1 + 3e-1 AS u", "y * 9e-1 + 7e-1 AS v")


def c12_sample_bicubic(spark, sf):
    p = fx.pixels(spark, sf)
    tones = p.select("image_id", F.col("x").alias("col"), F.col("y").alias("row"), F.expr(X.darkness()).alias("value"))
    return _r(grid.sample_bicubic(_points(p), tones), ["image_id", "point_id"], ["value"])


_wx, _wy = grid._catmull("tx"), grid._catmull("ty")
C12_SQL = fx.with_sql(
    "pixels",
    f"SELECT p.image_id, p.point_id, {R(grid.TAPS.format(term='p.wx[i.i + 1] * p.wy[j.j + 1] * t.value'))} AS value FROM pw p, (SELECT unnest(range(4)) AS i) i, (SELECT unnest(range(4)) AS j) j, tones t "
    "WHERE t.image_id = p.image_id AND t.x = least(7, greatest(0, x0 + i.i - 1)) AND t.y = least(7, greatest(0, y0 + j.j - 1)) GROUP BY 1, 2",
    tones=f"SELECT image_id, x, y, {X.darkness()} AS value FROM pixels",
    pts="SELECT image_id, x + 10 * y AS point_id, x * 11e-1 + 3e-1 AS u, y * 9e-1 + 7e-1 AS v FROM pixels",
    p0="SELECT *, CAST(floor(u - 5e-1) AS INT) AS x0, CAST(floor(v - 5e-1) AS INT) AS y0 FROM pts",
    p1="SELECT *, u - 5e-1 - x0 AS tx, v - 5e-1 - y0 AS ty FROM p0",
    pw=f"SELECT *, [{', '.join(_wx)}] AS wx, [{', '.join(_wy)}] AS wy FROM p1",
)


def c13_premultiply(spark, sf):
    p = colour.premultiply(fx.pixels(spark, sf)).withColumn("pa", F.col("a").cast("double"))
    back = colour.unpremultiply(p.select("image_id", "x", "y", "pr", "pg", "pb", "pa"))
    return back.select("image_id", "x", "y", *[F.expr(R(v)).alias(v) for v in ("pr", "pg", "pb")], "r", "g", "b", "a")


def d1_to_cmyk(spark, sf):
    return _r(colour.to_cmyk(fx.raster(spark, sf)), ["image_id", "x", "y"], list(INKS))


def d2_to_rgb_screen(spark, sf):
    return _r(colour.to_rgb_screen(fx.pixels(spark, sf)), ["image_id", "x", "y"], ["v_r", "v_g", "v_b"])


def d3_to_luminance(spark, sf):
    return _r(colour.to_luminance(fx.pixels(spark, sf)), ["image_id", "x", "y"], list(INKS))


def d4_to_single_channel(spark, sf):
    return _r(colour.to_single_channel(fx.pixels(spark, sf), "m"), ["image_id", "x", "y"], list(INKS))


def d5_to_crosshatch_tones(spark, sf):
    return _r(colour.to_crosshatch_tones(fx.pixels(spark, sf), fx.channels(spark)), ["image_id", "x", "y", "channel"], ["value"])


def d6_to_inverted_luminance(spark, sf):
    return _r(colour.to_inverted_luminance(fx.pixels(spark, sf)), ["image_id", "x", "y"], list(INKS))


def _tones(spark, sf):
    return colour.unpivot_tones(colour.to_cmyk(fx.pixels(spark, sf)), ["image_id", "x", "y", "a"])


def d7_unpivot_tones(spark, sf):
    return _r(_tones(spark, sf), ["image_id", "x", "y", "channel"], ["value"])


def d8_apply_contrast(spark, sf):
    t = _tones(spark, sf).withColumn("contrast", F.expr("9e-1 + (image_id % 5) * 1e-1"))
    return _r(colour.apply_contrast(t), ["image_id", "x", "y", "channel"], ["value"])


def d9_apply_threshold(spark, sf):
    t = _tones(spark, sf).join(F.broadcast(fx.channels(spark).select("channel", "threshold")), "channel")
    return _r(colour.apply_threshold(t), ["image_id", "x", "y", "channel"], ["value"])


_OUTPUTS = ["p_partkey AS preset_id", "CASE WHEN p_size % 2 = 0 THEN 'rgb' WHEN p_size % 3 = 0 THEN 'cmyk' END AS output_mode", "CASE p_partkey % 4 WHEN 0 THEN 'crosshatch' WHEN 1 THEN 'rgb' WHEN 2 THEN 'luminance' END AS value_mode"]
_ALL_CHANNELS = "(VALUES ('c', 0, true, '#00AEEF'), ('m', 1, true, 'pink'), ('y', 2, false, '#fff200'), ('k', 3, true, NULL), ('red', 4, true, '#fe0102'), ('green', 5, false, '#00ff00'), ('blue', 6, true, '#12')) AS t(channel, ord, enabled, color)"


def d10_active_channels(spark, sf):
    """The inks or lights that each preset of the part table is put out in."""
    docs = spark.read.parquet(f"{sf}/part.parquet").selectExpr(*_OUTPUTS)
    return colour.output_channels(docs, spark.sql(f"SELECT * FROM {_ALL_CHANNELS}")).select("preset_id", "channel", "ord")


def e1_native_marks(spark, sf):
    return _r(marks.native_marks(fx.pixels(spark, sf), _dims(spark, sf)), ["image_id", "channel", "col", "row"], ["x", "y", "extent", "thickness", "angle"])


def e2_native_rgb_marks(spark, sf):
    return _r(marks.native_rgb_marks(fx.pixels(spark, sf), _dims(spark, sf)), ["image_id", "channel", "col", "row"], ["x", "y", "extent", "angle"])


def _marks(spark, sf):
    return marks.shape_marks(fx.pixels(spark, sf), _sized_images(spark, sf), fx.channels(spark), fx.MIN_MARK, fx.MAX_MARK, fx.GRID_SCALE)


def e3_shape_marks(spark, sf):
    """The flagship: marks and their total size in ten-thousandths for each image and ink."""
    size = lambda c: F.sum(F.expr(f"CAST(floor({c} * 1e4 + 5e-1 + 1e-9) AS BIGINT)")).alias(f"sum_{c}")
    return _marks(spark, sf).groupBy("image_id", "channel").agg(F.count("*").alias("n"), size("extent"), size("thickness"))


_LO = f"greatest({fx.MIN_MARK} / 100e0, 0e0)"
_SIZE = f"least(cell_w, cell_h) * ({_LO} + (greatest({fx.MAX_MARK} / 100e0, {_LO}) * (max_size / 100e0) - {_LO}) * value) * scale"
MARKS_SQL = RANGES | TARGETS2 | RESAMPLE | {
    "cc": f"SELECT image_id, cols, rows, col AS s_col, \"row\" AS s_row, {CMYK_SQL} FROM cells",
    "ct": UNPIVOT("cc", "image_id, cols, rows, s_col, s_row"),
    "mv": f"SELECT lk.*, {X.threshold('ct.value', 'lk.threshold')} AS value FROM lk JOIN ct ON lk.image_id = ct.image_id AND lk.cols = ct.cols AND lk.rows = ct.rows AND lk.s_col = ct.s_col AND lk.s_row = ct.s_row AND lk.channel = ct.channel",
    "mk0": f"SELECT *, {_SIZE} AS size FROM mv WHERE value > 0",
    "mk": f"SELECT image_id, channel, ord, col, \"row\", x, y, value, rotation AS angle, size * {fx.GRID_SCALE} / 100e0 * width_scale AS extent, size * {fx.GRID_SCALE} / 100e0 * height_scale AS thickness FROM mk0",
}


def e4_unit_shapes(spark, sf):
    s = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_size % 9 AS sides")
    return _r(marks.unit_shapes(s), ["sides", "vertex"], ["ux", "uy"])


def _vertices(spark, sf):
    m = marks.native_marks(fx.pixels(spark, sf), _dims(spark, sf)).withColumn("sides", F.expr("CAST(3 + image_id % 4 AS INT)")).withColumn("thickness", F.col("extent"))
    return marks.mark_vertices(m, marks.unit_shapes(m.select("sides")))


def e5_mark_vertices(spark, sf):
    return _r(_vertices(spark, sf), ["image_id", "channel", "col", "row", "vertex"], ["px", "py"])


def e6_polygon_to_cubic(spark, sf):
    return _r(marks.polygon_to_cubic(fx.poly_points(spark, sf)), ["poly_id", "seq"], ["c1x", "c1y", "c2x", "c2y", "ex", "ey"])


def e7_layers(spark, sf):
    """Layers of the inks or lights of each preset; colours that aren't any give the ink's own."""
    docs = spark.read.parquet(f"{sf}/part.parquet").selectExpr(*_OUTPUTS)
    shown = marks.layers(spark.sql(f"SELECT *, 1e0 AS opacity FROM {_ALL_CHANNELS}"))
    return colour.output_channels(docs, shown).select("preset_id", "channel", "ord", "enabled", "opacity", "blend", "red", "green", "blue")


def e8_scale_marks(spark, sf):
    m = marks.native_marks(fx.pixels(spark, sf), _dims(spark, sf))
    return _r(marks.scale_marks(m, "15e-1", "25e-1"), ["image_id", "channel", "col", "row"], ["x", "y", "extent", "thickness"])


def e9_index_marks(spark, sf):
    return marks.index_marks(marks.native_marks(fx.pixels(spark, sf), _dims(spark, sf))).select("image_id", "channel", "col", "row", "mark_idx")


def e10_mark_path_text(spark, sf):
    return marks.mark_path_text(_vertices(spark, sf), ["image_id", "channel", "col", "row"])


def e11_xml_escape(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", F.md5(marks.xml_escape(F.concat(F.lit("<'\"&>"), F.coalesce("text", F.lit("")))).cast("binary")).alias("escaped_md5"))


def s1_raster_shares(spark, sf):
    """Ink totals of the sparse line-item rasters: separation, unpivot, threshold and one partial aggregate."""
    t = colour.unpivot_tones(colour.to_cmyk(fx.raster(spark, sf)), ["image_id", "x", "y"])
    t = colour.apply_threshold(t.join(F.broadcast(fx.channels(spark).select("channel", "threshold")), "channel"))
    return t.groupBy("image_id", "channel").agg(F.count("*").alias("n"), F.sum(F.expr("CAST(floor(value * 1e6 + 5e-1 + 1e-9) AS BIGINT)")).alias("total"))


_NG = {
    "dims": DIMS_SQL,
    "ng0": f"SELECT *, {grid.SPACING} AS spacing FROM dims",
    "ng": "SELECT *, CAST(ceil(width / spacing) AS INT) AS cols, CAST(ceil(height / spacing) AS INT) AS rows FROM ng0",
    "nc0": "SELECT *, CAST(unnest(range(cols)) AS INT) AS col FROM ng",
    "nc1": "SELECT *, CAST(unnest(range(rows)) AS INT) AS \"row\" FROM nc0",
    "nc": "SELECT *, least((col + 5e-1) * spacing, width - 5e-1) AS cx, least((\"row\" + 5e-1) * spacing, height - 5e-1) AS cy FROM nc1",
    "hit": "SELECT nc.*, p.r, p.g, p.b, p.a FROM nc JOIN pixels p ON p.image_id = nc.image_id AND p.x = CAST(floor(cx) AS INT) AND p.y = CAST(floor(cy) AS INT) AND p.a > 0",
}
_K = "image_id, col, \"row\", cx, cy, spacing, coverage, contrast, angle, treatment, a"
_COV = "(coverage / 100e0)"
NATIVE = _NG | {
    "hc": f"SELECT {_K}, {CMYK_SQL} FROM hit",
    "ht": UNPIVOT("hc", _K),
    "hv": f"SELECT * REPLACE (least(1e0, greatest(0e0, (value - 5e-1) * (contrast / 100e0) + 5e-1)) * (a / 255e0) AS value) FROM ht",
    "nm": f"SELECT image_id, channel, col, \"row\", cx AS x, cy AS y, CASE treatment WHEN 'dots' THEN spacing * 47e-2 * {_COV} * sqrt(value) WHEN 'squares' THEN spacing * 86e-2 * {_COV} * sqrt(value) ELSE spacing * 112e-2 END AS extent, "
    f"CASE treatment WHEN 'lines' THEN spacing * 72e-2 * {_COV} * greatest(value, 25e-3) ELSE 0e0 END AS thickness, angle + {marks.ANGLE} AS angle, treatment FROM hv WHERE value > 6e-3",
}
_N = "least(6, greatest(3, sides))"
_TURN = f"(-90e0 + CASE WHEN {_N} % 2 = 0 THEN 180e0 / {_N} ELSE 0e0 END + vertex * 360e0 / {_N})"
SHAPES = {"us0": f"SELECT sides, CAST(unnest(range({_N})) AS INT) AS vertex FROM (SELECT DISTINCT sides FROM sd)", "us": f"SELECT *, 5e-1 * cos(radians({_TURN})) AS ux, 5e-1 * sin(radians({_TURN})) AS uy FROM us0"}
VERTICES = NATIVE | {
    "vm": "SELECT image_id, channel, col, \"row\", x, y, extent, extent AS thickness, angle, CAST(3 + image_id % 4 AS INT) AS sides FROM nm",
    "sd": "SELECT sides FROM vm",
} | SHAPES | {
    "vx": "SELECT image_id, channel, col, \"row\", vertex, x + (ux * extent) * cos(radians(angle)) - (uy * thickness) * sin(radians(angle)) AS px, y + (ux * extent) * sin(radians(angle)) + (uy * thickness) * cos(radians(angle)) AS py FROM vm JOIN us USING (sides)",
}
TONES = {"tc": f"SELECT image_id, x, y, a, {CMYK_SQL} FROM pixels", "tones": UNPIVOT("tc", "image_id, x, y, a")}
_ESC = "text"
for _a, _b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
    _ESC = f"replace({_ESC}, '{_a}', '{_b}')"
_ESC = _ESC.replace("replace(text,", "replace(concat('<''\"&>', coalesce(text, '')),", 1)
_W = "OVER (PARTITION BY poly_id ORDER BY seq)"
_FIRST = "OVER (PARTITION BY poly_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_LUM = f"CASE WHEN a = 0 THEN 0e0 ELSE (2126e-4 * r + 7152e-4 * g + 722e-4 * b) / 255e0 END"
_SUM = lambda c: f"CAST(sum(CAST(floor({c} * 1e4 + 5e-1 + 1e-9) AS BIGINT)) AS BIGINT) AS sum_{c}"

SQL = {
    "c1_calculate_grid": fx.with_sql("images", f"SELECT image_id, cols, rows, {_sr(['cell_w', 'cell_h'])} FROM g1", **GRID1),
    "c2_channel_grid": fx.with_sql("images channels", f"SELECT image_id, channel, cols, rows, {_sr(['cell_w', 'cell_h'])} FROM cg", **CG),
    "c3_native_grid": f"WITH d AS (SELECT {', '.join(PART_DIMS)} FROM part), s AS (SELECT *, {grid.SPACING} AS spacing FROM d) SELECT image_id, CAST(ceil(width / spacing) AS INT) AS cols, CAST(ceil(height / spacing) AS INT) AS rows, {_sr(['spacing'])} FROM s",
    "c4_lattice_ranges": fx.with_sql("images channels", f"SELECT image_id, channel, col0, col1, row0, row1, {_sr(['margin', 'phase_x', 'phase_y'])} FROM lr", **_upto("lr")),
    "c5_lattice": fx.with_sql("images channels", "SELECT image_id, channel, count(*) AS n, CAST(sum(col) AS BIGINT) AS sum_col, CAST(sum(\"row\") AS BIGINT) AS sum_row FROM lat GROUP BY 1, 2", **_upto("lat")),
    "c6_place_lattice": fx.with_sql("images channels", f"SELECT image_id, channel, col, \"row\", {_sr(['x', 'y'])} FROM pl", **_upto("pl")),
    "c7_cull": fx.with_sql("images channels", "SELECT image_id, channel, count(*) AS n, min(col) AS min_col, max(\"row\") AS max_row FROM cu GROUP BY 1, 2", **_upto("cu")),
    "c8_lookup_cell": fx.with_sql("images channels", "SELECT image_id, channel, col, \"row\", s_col, s_row FROM lk", **RANGES),
    "c9_sample_nearest": fx.with_sql("pixels", "SELECT image_id, col, \"row\", r, g, b, a FROM hit", **_NG),
    "c10_resample_area": fx.with_sql("pixels images", "SELECT image_id, cols, rows, col, \"row\", r, g, b, a FROM cells", **TARGETS1, **RESAMPLE),
    "c12_sample_bicubic": C12_SQL,
    "c13_premultiply": fx.with_sql(
        "pixels",
        f"SELECT image_id, x, y, {_sr(['pr', 'pg', 'pb'])}, {', '.join(f'CASE WHEN {X.byte("pa")} = 0 THEN 0 ELSE {X.byte(f"p{i} * 255e0 / pa")} END AS {i}' for i in 'rgb')}, {X.byte('pa')} AS a FROM pm",
        pm=RESAMPLE["pm"],
    ),
    "d1_to_cmyk": fx.with_sql("raster", f"SELECT image_id, x, y, {_sr(list(INKS))} FROM q", q=f"SELECT image_id, x, y, {CMYK_SQL} FROM raster"),
    "d2_to_rgb_screen": fx.with_sql("pixels", f"SELECT image_id, x, y, {', '.join(R(f'{i} / 255e0 * (a / 255e0)') + f' AS v_{i}' for i in 'rgb')} FROM pixels"),
    "d3_to_luminance": fx.with_sql("pixels", f"SELECT image_id, x, y, {', '.join(f'{R(X.darkness())} AS {i}' for i in INKS)} FROM pixels"),
    "d4_to_single_channel": fx.with_sql("pixels", f"SELECT image_id, x, y, 0e0 AS ink_c, {R(X.darkness())} AS ink_m, 0e0 AS ink_y, 0e0 AS ink_k FROM pixels"),
    "d5_to_crosshatch_tones": fx.with_sql(
        "pixels channels",
        f"SELECT image_id, x, y, channel, {_sr(['value'])} FROM q",
        o="SELECT channel, row_number() OVER (ORDER BY CASE channel WHEN 'k' THEN 0 WHEN 'c' THEN 1 WHEN 'm' THEN 2 ELSE 3 END) - 1 AS i, count(*) OVER () AS n FROM channels WHERE enabled",
        d=f"SELECT image_id, x, y, channel, n, i, least(1e0 / n, greatest(0e0, {X.darkness()} - i * (1e0 / n))) AS v FROM pixels, o",
        q="SELECT *, CASE WHEN v <= 1e-12 THEN 0e0 WHEN v >= 1e0 / n - 1e-12 THEN 1e0 / n ELSE v END AS value FROM d",
    ),
    "d6_to_inverted_luminance": fx.with_sql("pixels", f"SELECT image_id, x, y, {', '.join(f'{R(_LUM)} AS {i}' for i in INKS)} FROM pixels"),
    "d7_unpivot_tones": fx.with_sql("pixels", f"SELECT image_id, x, y, channel, {_sr(['value'])} FROM tones", **TONES),
    "d8_apply_contrast": fx.with_sql(
        "pixels", f"SELECT image_id, x, y, channel, {R('v')} AS value FROM q WHERE v > 6e-3", **TONES, q="SELECT *, least(1e0, greatest(0e0, (value - 5e-1) * (9e-1 + (image_id % 5) * 1e-1) + 5e-1)) * (a / 255e0) AS v FROM tones"
    ),
    "d9_apply_threshold": fx.with_sql("pixels channels", f"SELECT image_id, x, y, channel, {R('v')} AS value FROM q WHERE v > 0", **TONES, q=f"SELECT tones.*, {X.threshold('value', 'threshold')} AS v FROM tones JOIN channels USING (channel)"),
    "d10_active_channels": f"SELECT preset_id, channel, ord FROM (SELECT {', '.join(_OUTPUTS)} FROM part) d, {_ALL_CHANNELS} WHERE enabled AND (ord >= 4) = (NOT coalesce(value_mode = 'crosshatch', false) AND (coalesce(output_mode = 'rgb', false) OR coalesce(value_mode = 'rgb', false)))",
    "e1_native_marks": fx.with_sql("pixels", f"SELECT image_id, channel, col, \"row\", {_sr(['x', 'y', 'extent', 'thickness', 'angle'])} FROM nm", **NATIVE),
    "e2_native_rgb_marks": fx.with_sql(
        "pixels",
        f"SELECT image_id, channel, col, \"row\", {R('cx')} AS x, {R('cy')} AS y, {R(f'spacing * 47e-2 * {_COV} * sqrt(value)')} AS extent, {R('angle')} AS angle FROM t WHERE value > 6e-3",
        **_NG,
        t=" UNION ALL ".join(f"SELECT hit.*, '{n}' AS channel, {n[0]} / 255e0 * (a / 255e0) AS value FROM hit" for n in ("red", "green", "blue")),
    ),
    "e3_shape_marks": fx.with_sql("pixels images channels", f"SELECT image_id, channel, count(*) AS n, {_SUM('extent')}, {_SUM('thickness')} FROM mk GROUP BY 1, 2", **MARKS_SQL),
    "e4_unit_shapes": f"WITH sd AS (SELECT p_size % 9 AS sides FROM part), us0 AS ({SHAPES['us0']}), us AS ({SHAPES['us']}) SELECT sides, vertex, {_sr(['ux', 'uy'])} FROM us",
    "e5_mark_vertices": fx.with_sql("pixels", f"SELECT image_id, channel, col, \"row\", vertex, {_sr(['px', 'py'])} FROM vx", **VERTICES),
    "e6_polygon_to_cubic": fx.with_sql(
        "poly_points",
        "SELECT poly_id, seq, " + ", ".join(f"{R(f'{i} + (e{i} - {i}) / 3e0')} AS c1{i}, {R(f'e{i} - (e{i} - {i}) / 3e0')} AS c2{i}, {R(f'e{i}')} AS e{i}" for i in "xy") + " FROM q",
        q=f"SELECT *, coalesce(lead(x) {_W}, first_value(x) {_FIRST}) AS ex, coalesce(lead(y) {_W}, first_value(y) {_FIRST}) AS ey FROM poly_points",
    ),
    "e7_layers": "SELECT preset_id, channel, ord, true AS enabled, 1e0 AS opacity, blend, red, green, blue FROM (SELECT "
    + ", ".join(_OUTPUTS)
    + " FROM part) d, (VALUES ('c', 0, 'multiply', 0, 174, 239), ('m', 1, 'multiply', 236, 0, 140), ('k', 3, 'multiply', 20, 20, 24), ('red', 4, 'screen', 254, 1, 2), ('blue', 6, 'screen', 0, 0, 255)) AS t(channel, ord, blend, red, green, blue) "
    "WHERE (ord >= 4) = (CASE WHEN value_mode = 'crosshatch' THEN false WHEN output_mode = 'rgb' THEN true WHEN value_mode = 'rgb' THEN true ELSE false END)",
    "e8_scale_marks": fx.with_sql("pixels", f"SELECT image_id, channel, col, \"row\", {R('x * 15e-1')} AS x, {R('y * 25e-1')} AS y, {R('extent * (15e-1 + 25e-1) / 2e0')} AS extent, {R('thickness * (15e-1 + 25e-1) / 2e0')} AS thickness FROM nm", **NATIVE),
    "e9_index_marks": fx.with_sql("pixels", "SELECT image_id, channel, col, \"row\", row_number() OVER (PARTITION BY image_id, channel ORDER BY \"row\", col) AS mark_idx FROM nm", **NATIVE),
    "e10_mark_path_text": fx.with_sql(
        "pixels",
        f"SELECT image_id, channel, col, \"row\", concat(string_agg(concat(CASE WHEN vertex = 0 THEN 'M ' ELSE 'L ' END, {X.number_text('px')}, ' ', {X.number_text('py')}), ' ' ORDER BY vertex), ' Z') AS d FROM vx GROUP BY 1, 2, 3, 4",
        **VERTICES,
    ),
    "e11_xml_escape": f"SELECT doc_id, md5({_ESC}) AS escaped_md5 FROM documents",
    "s1_raster_shares": fx.with_sql(
        "raster channels",
        "SELECT image_id, channel, count(*) AS n, CAST(sum(CAST(floor(v * 1e6 + 5e-1 + 1e-9) AS BIGINT)) AS BIGINT) AS total FROM q WHERE v > 0 GROUP BY 1, 2",
        rc=f"SELECT image_id, x, y, {CMYK_SQL} FROM raster",
        rt=UNPIVOT("rc", "image_id, x, y"),
        q=f"SELECT rt.*, {X.threshold('value', 'threshold')} AS v FROM rt JOIN channels USING (channel)",
    ),
}
QUERIES = {name: globals()[name] for name in SQL}
