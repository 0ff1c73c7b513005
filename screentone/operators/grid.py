"""Cell grids, rotated lattices and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screentone.functions import formulas as X
from screentone.operators.colour import premultiply, unpremultiply


def _sized(df: DataFrame, cells: str) -> DataFrame:
    return df.withColumns({k: F.expr(v) for k, v in X.grid("out_w", "out_h", cells).items()}).withColumns({"cell_w": F.expr("out_w / cols"), "cell_h": F.expr("out_h / rows")})


def calculate_grid(images: DataFrame) -> DataFrame:
    """Adds cols, rows, cell_w, cell_h for out_w, out_h and cells."""
    return _sized(images, "cells")


def channel_grid(images: DataFrame, channels: DataFrame) -> DataFrame:
    """The grid of each image and enabled ink: cells scaled by the ink's resolution, 0.05 at least."""
    return _sized(images.crossJoin(F.broadcast(channels)), "cells * greatest(5e-2, resolution_scale)")


SPACING = "greatest(3e0, greatest(width, height) / (22e0 + detail * 92e-2))"


def native_grid(dims: DataFrame) -> DataFrame:
    """Adds spacing, cols, rows for width, height and detail."""
    return dims.withColumn("spacing", F.expr(SPACING)).withColumns({"cols": F.expr("CAST(ceil(width / spacing) AS INT)"), "rows": F.expr("CAST(ceil(height / spacing) AS INT)")})


def native_cells(grid: DataFrame) -> DataFrame:
    """One row per cell with its centre, which stays half a pixel inside the far edges."""
    g = grid.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1))).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    return g.withColumns({"cx": F.expr("least((col + 5e-1) * spacing, width - 5e-1)"), "cy": F.expr("least((row + 5e-1) * spacing, height - 5e-1)")})


#: Largest reach of a mark from its centre, for a shape of the given radius.
def reach(min_mark: str, max_mark: str, grid_scale: str, radius: str) -> str:
    return f"least(cell_w, cell_h) * (greatest({max_mark} / 100e0, greatest({min_mark} / 100e0, 0e0)) * max_size / 100e0) * scale * {grid_scale} / 100e0 * {radius}"


CIRCLE = "(5e-1 * greatest(width_scale, height_scale))"


def _turn(x: str, y: str, sign: str) -> tuple[str, str]:
    px, py = "(out_w / 2e0 + pivot_x)", "(out_h / 2e0 + pivot_y)"
    s, c = f"sin(radians({sign}grid_rotation))", f"cos(radians({sign}grid_rotation))"
    flat = "abs(grid_rotation) <= 1e-4"
    return (
        f"CASE WHEN {flat} THEN {x} ELSE {px} + ({x} - {px}) * {c} - ({y} - {py}) * {s} END",
        f"CASE WHEN {flat} THEN {y} ELSE {py} + ({x} - {px}) * {s} + ({y} - {py}) * {c} END",
    )


def lattice_ranges(grid: DataFrame, margin: str) -> DataFrame:
    """Adds margin, phase_x, phase_y and the index range col0..col1, row0..row1 that covers the artboard.

    The corners of the artboard, widened by the margin, are turned back by the grid's rotation; their
    bounds give the range. Unrotated grids have just their own cells.
    """
    g = grid.withColumn("margin", F.expr(margin)).withColumns({"phase_x": F.expr(X.wrap_signed("offset_x", "cell_w")), "phase_y": F.expr(X.wrap_signed("offset_y", "cell_h"))})
    corners = [("-margin", "-margin"), ("(out_w + margin)", "-margin"), ("(out_w + margin)", "(out_h + margin)"), ("-margin", "(out_h + margin)")]
    turned = [_turn(x, y, "-") for x, y in corners]
    lo_x, hi_x = (f"{f}({', '.join(t[0] for t in turned)})" for f in ("least", "greatest"))
    lo_y, hi_y = (f"{f}({', '.join(t[1] for t in turned)})" for f in ("least", "greatest"))
    flat = "abs(grid_rotation) <= 1e-4"
    return g.withColumns(
        {
            "col0": F.expr(f"CASE WHEN {flat} THEN 0 ELSE CAST(floor(({lo_x} - phase_x) / cell_w - 5e-1) AS INT) END"),
            "col1": F.expr(f"CASE WHEN {flat} THEN cols - 1 ELSE CAST(ceil(({hi_x} - phase_x) / cell_w - 5e-1) AS INT) END"),
            "row0": F.expr(f"CASE WHEN {flat} THEN 0 ELSE CAST(floor(({lo_y} - phase_y) / cell_h - 5e-1) AS INT) END"),
            "row1": F.expr(f"CASE WHEN {flat} THEN rows - 1 ELSE CAST(ceil(({hi_y} - phase_y) / cell_h - 5e-1) AS INT) END"),
        }
    )


def lattice(ranges: DataFrame) -> DataFrame:
    """One row per lattice point of the range."""
    return ranges.withColumn("col", F.explode(F.sequence("col0", "col1"))).withColumn("row", F.explode(F.sequence("row0", "row1")))


def place_lattice(points: DataFrame) -> DataFrame:
    """Adds x, y: the point in the artboard. Unrotated grids wrap round the edges, others turn about the pivot."""
    flat = "abs(grid_rotation) <= 1e-4"
    lx, ly = "((col + 5e-1) * cell_w + phase_x)", "((row + 5e-1) * cell_h + phase_y)"
    p = points.withColumns({"lx": F.expr(f"CASE WHEN {flat} THEN {X.modulo(lx, 'out_w')} ELSE {lx} END"), "ly": F.expr(f"CASE WHEN {flat} THEN {X.modulo(ly, 'out_h')} ELSE {ly} END")})
    x, y = _turn("lx", "ly", "")
    return p.withColumns({"x": F.expr(x), "y": F.expr(y)}).drop("lx", "ly")


def cull(placed: DataFrame) -> DataFrame:
    """Points whose marks can touch the artboard."""
    return placed.filter("x >= -margin AND x <= out_w + margin AND y >= -margin AND y <= out_h + margin")


def lookup_cell(placed: DataFrame) -> DataFrame:
    """Adds s_col, s_row: the nearest sample of a point."""
    return placed.withColumns(
        {"s_col": F.expr("CAST(least(cols - 1, greatest(0, floor(x / cell_w))) AS INT)"), "s_row": F.expr("CAST(least(rows - 1, greatest(0, floor(y / cell_h))) AS INT)")}
    )


def sample_nearest(cells: DataFrame, pixels: DataFrame) -> DataFrame:
    """The pixel under each cell centre, without clear ones: one equi-join."""
    c = cells.withColumns({"x": F.expr("CAST(floor(cx) AS INT)"), "y": F.expr("CAST(floor(cy) AS INT)")})
    return c.join(pixels.filter("a > 0"), ["image_id", "x", "y"])


def _taps(rows: DataFrame, at: str, src: str, dst: str, out: str, kernel: str, support: float) -> DataFrame:
    """rows once for each output position of an axis that position `at` has a part in: adds it as `out`, and its weight w.

    Every row works out its own output positions from the two sizes, so no table of taps is joined: made of so few
    rows, it would be taken for a small one and sent whole through the driver.
    """
    ratio = f"(CAST({src} AS DOUBLE) / {dst})"
    reach = f"greatest({ratio}, 1e0) * {support!r}"
    ends = [f"CAST({f}(({at} + 5e-1 {sign} {reach}) / {ratio} - 5e-1 {sign} 1e-6) AS INT)" for f, sign in (("floor", "-"), ("ceil", "+"))]
    t = rows.withColumn(out, F.explode(F.expr(f"CASE WHEN {at} >= 0 AND {at} < {src} THEN sequence(greatest(0, {ends[0]}), least({dst} - 1, {ends[1]})) END")))
    t = t.withColumns({"s": F.expr(f"greatest({ratio}, 1e0)"), "centre": F.expr(f"({out} + 5e-1) * {ratio}")}).withColumn("u", F.expr(f"({at} - centre + 5e-1) / s"))
    return t.withColumn("w", F.expr(kernel)).filter("w <> 0").drop("s", "centre", "u")


TRIANGLE = ("greatest(0e0, 1e0 - abs(u))", 1.0)
LANCZOS3 = ("CASE WHEN abs(u) < 1e-12 THEN 1e0 WHEN abs(u) >= 3e0 THEN 0e0 ELSE 3e0 * sin(pi() * u) * sin(pi() * u / 3e0) / (pi() * pi() * u * u) END", 3.0)


def resample(pixels: DataFrame, targets: DataFrame, kernel: tuple[str, float] = TRIANGLE) -> DataFrame:
    """Area resample of images to cols x rows: image_id, cols, rows, col, row, r, g, b, a.

    targets has image_id, src_w, src_h, cols, rows. Two passes, one for each axis, each a join with the
    images' sizes and a partial aggregate, on premultiplied colour; no pass multiplies rows by the square of the filter.
    """
    text, support = kernel
    mean = [F.expr(f"sum(w * {p}) / sum(w)").alias(p) for p in ("pr", "pg", "pb", "pa")]
    p = premultiply(pixels).withColumn("pa", F.col("a").cast("double"))
    across = _taps(p.join(targets.select("image_id", "src_w", "cols").distinct(), "image_id"), "x", "src_w", "cols", "col", text, support).groupBy("image_id", "cols", "col", "y").agg(*mean)
    down = _taps(across.join(targets.select("image_id", "src_h", "cols", "rows").distinct(), ["image_id", "cols"]), "y", "src_h", "rows", "row", text, support).groupBy("image_id", "cols", "rows", "col", "row").agg(*mean)
    return unpremultiply(down).select("image_id", "cols", "rows", "col", "row", "r", "g", "b", "a")


def downscale(pixels: DataFrame, dims: DataFrame, max_dim: int = 2400) -> DataFrame:
    """Lanczos downscale of images whose long edge is over max_dim; the others pass unchanged.

    dims has image_id, src_w, src_h. Returns image_id, x, y, r, g, b, a.
    """
    f = f"({max_dim}e0 / greatest(src_w, src_h))"
    sized = dims.withColumns({"cols": F.expr(f"CAST(greatest(1e0, floor(src_w * {f} + 5e-1)) AS INT)"), "rows": F.expr(f"CAST(greatest(1e0, floor(src_h * {f} + 5e-1)) AS INT)")})
    large = sized.filter(F.greatest("src_w", "src_h") > max_dim)
    small = pixels.join(large.select("image_id"), "image_id", "left_anti").select("image_id", "x", "y", "r", "g", "b", "a")
    done = resample(pixels.join(large.select("image_id"), "image_id", "left_semi"), large, LANCZOS3)
    return small.unionByName(done.select("image_id", F.col("col").alias("x"), F.col("row").alias("y"), "r", "g", "b", "a"))


def _catmull(t: str) -> list[str]:
    return [
        f"5e-1 * (-{t} + 2e0 * {t} * {t} - {t} * {t} * {t})",
        f"5e-1 * (2e0 - 5e0 * {t} * {t} + 3e0 * {t} * {t} * {t})",
        f"5e-1 * ({t} + 4e0 * {t} * {t} - 3e0 * {t} * {t} * {t})",
        f"5e-1 * (-{t} * {t} + {t} * {t} * {t})",
    ]


#: The taps are added as whole 1e-12ths, so their order doesn't matter.
TAPS = "least(1e0, greatest(0e0, sum(CAST(floor({term} * 1e12 + 5e-1) AS BIGINT)) / 1e12))"

#: Points are sampled from tiles of TILE x TILE cells that also hold the next three columns and rows.
TILE = 8


def tone_tiles(tones: DataFrame) -> DataFrame:
    """(image_id, tx, ty, held): the tones of each tile as an array by place, row by row, each a list (null where there is none)."""
    side = TILE + 3
    over = lambda v: F.explode(F.expr(f"sequence(greatest(0, CAST(floor(({v} - 3) / {TILE}e0) AS INT)), CAST(floor({v} / {TILE}e0) AS INT))"))
    t = tones.filter("image_id IS NOT NULL AND col >= 0 AND row >= 0").groupBy("image_id", "col", "row").agg(F.collect_list(F.struct("value")).alias("v"))
    t = t.withColumn("tx", over("col")).withColumn("ty", over("row")).withColumn("at", F.expr(f"CAST((row - ty * {TILE}) * {side} + col - tx * {TILE} AS INT)"))
    t = t.groupBy("image_id", "tx", "ty").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    return t.select("image_id", "tx", "ty", F.expr(f"transform(sequence(0, {side * side - 1}), k -> m[k])").alias("held"))


def sample_bicubic(points: DataFrame, tones: DataFrame) -> DataFrame:
    """Catmull-Rom sample of tones (image_id, col, row, value) at points (image_id, point_id, u, v).

    u, v are positions in cells; points also has cols and rows. A point's 16 taps, clamped at the edges, lie in
    one tile, so it is joined once and its taps are added before they are shuffled. The result is clamped to 0..1.
    """
    tile = lambda first, n: F.expr(f"CAST(floor(least({n} - 1, greatest(0, {first} - 1)) / {TILE}e0) AS INT)")
    p = points.withColumns({"x0": F.expr("CAST(floor(u - 5e-1) AS INT)"), "y0": F.expr("CAST(floor(v - 5e-1) AS INT)")})
    p = p.select("image_id", "point_id", "cols", "rows", "x0", "y0", F.expr("u - 5e-1 - x0").alias("dx"), F.expr("v - 5e-1 - y0").alias("dy"), tile("x0", "cols").alias("tx"), tile("y0", "rows").alias("ty"))
    # the weights are made after the join, so that they aren't shuffled
    p = p.join(tone_tiles(tones), ["image_id", "tx", "ty"])
    for weights, i, w in (("dx", "i", "a"), ("dy", "j", "b")):
        p = p.select("*", F.posexplode(F.array(*[F.expr(x) for x in _catmull(weights)])).alias(i, w))
    place = f"(least(rows - 1, greatest(0, y0 + j - 1)) - ty * {TILE}) * {TILE + 3} + least(cols - 1, greatest(0, x0 + i - 1)) - tx * {TILE}"
    p = p.select("image_id", "point_id", "a", "b", F.explode(F.expr(f"get(held, {place})")).alias("t"))
    return p.groupBy("image_id", "point_id").agg(F.expr(TAPS.format(term="a * b * t.value")).alias("value"))
