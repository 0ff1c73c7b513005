"""Marks of shape halftones, their layers, vertices and path text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screentone.functions import formulas as X
from screentone.operators import colour, grid

#: Angle of each ink against the treatment's own (fixed values).
ANGLE = "CASE channel WHEN 'c' THEN 15e0 WHEN 'm' THEN 75e0 WHEN 'k' THEN 45e0 ELSE 0e0 END"


def native_marks(pixels: DataFrame, dims: DataFrame) -> DataFrame:
    """Dots, squares or lines on the native grid; dims has width, height, detail, coverage, contrast, angle, treatment."""
    hit = grid.sample_nearest(grid.native_cells(grid.native_grid(dims)), pixels)
    keys = ["image_id", "col", "row", "cx", "cy", "spacing", "coverage", "contrast", "angle", "treatment", "a"]
    tones = colour.unpivot_tones(colour.to_cmyk(hit), keys)
    t = colour.apply_contrast(tones, "(contrast / 100e0)")
    cov = "(coverage / 100e0)"
    return t.withColumns(
        {
            "extent": F.expr(f"CASE treatment WHEN 'dots' THEN spacing * 47e-2 * {cov} * sqrt(value) WHEN 'squares' THEN spacing * 86e-2 * {cov} * sqrt(value) ELSE spacing * 112e-2 END"),
            "thickness": F.expr(f"CASE treatment WHEN 'lines' THEN spacing * 72e-2 * {cov} * greatest(value, 25e-3) ELSE 0e0 END"),
            "angle": F.expr(f"angle + {ANGLE}"),
        }
    ).select("image_id", "channel", "col", "row", F.col("cx").alias("x"), F.col("cy").alias("y"), "extent", "thickness", "angle", "treatment")


def native_rgb_marks(pixels: DataFrame, dims: DataFrame) -> DataFrame:
    """Dots of the light of each RGB ink on the native grid."""
    hit = colour.to_rgb_screen(grid.sample_nearest(grid.native_cells(grid.native_grid(dims)), pixels))
    keys = ["image_id", "col", "row", "cx", "cy", "spacing", "coverage", "angle"]
    t = hit.select(*keys, F.col("v_r").alias("ink_red"), F.col("v_g").alias("ink_green"), F.col("v_b").alias("ink_blue"))
    t = colour.unpivot_tones(t, keys, ("red", "green", "blue")).filter("value > 6e-3")
    return t.select("image_id", "channel", "col", "row", F.col("cx").alias("x"), F.col("cy").alias("y"), F.expr("spacing * 47e-2 * (coverage / 100e0) * sqrt(value)").alias("extent"), "angle")


def shape_marks(pixels: DataFrame, images: DataFrame, channels: DataFrame, min_mark: str, max_mark: str, grid_scale: str) -> DataFrame:
    """Marks on each enabled ink's lattice: image_id, channel, col, row, x, y, value, extent, thickness, angle.

    images has image_id, src_w, src_h, out_w, out_h, cells. Cells are resampled once for each
    distinct (image, cols, rows), not for each ink; lattice points are culled before the cell join.
    """
    g = grid.channel_grid(images, colour.active_channels(channels))
    cells = grid.resample(pixels, g.select("image_id", "src_w", "src_h", "cols", "rows").distinct())
    tones = colour.unpivot_tones(colour.to_cmyk(cells.withColumnsRenamed({"col": "s_col", "row": "s_row"})), ["image_id", "cols", "rows", "s_col", "s_row"])
    points = grid.lookup_cell(grid.cull(grid.place_lattice(grid.lattice(grid.lattice_ranges(g, grid.reach(min_mark, max_mark, grid_scale, grid.CIRCLE))))))
    t = colour.apply_threshold(points.join(tones, ["image_id", "cols", "rows", "s_col", "s_row", "channel"]))
    lo = f"greatest({min_mark} / 100e0, 0e0)"
    size = f"least(cell_w, cell_h) * ({lo} + (greatest({max_mark} / 100e0, {lo}) * (max_size / 100e0) - {lo}) * value) * scale"
    t = t.withColumn("size", F.expr(size))
    return t.select(
        "image_id", "channel", "ord", "col", "row", "x", "y", "value", F.expr(f"size * {grid_scale} / 100e0 * width_scale").alias("extent"), F.expr(f"size * {grid_scale} / 100e0 * height_scale").alias("thickness"), F.col("rotation").alias("angle")
    )


#: Colours of inks and lights where none is given, and of crosshatch (fixed values).
INK_COLOURS = {"c": "#00AEEF", "m": "#EC008C", "y": "#FFF200", "k": "#141418", "red": "#FF0000", "green": "#00FF00", "blue": "#0000FF"}
CROSSHATCH_COLOUR = "#111111"


def layers(channels: DataFrame, crosshatch: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Colour, opacity and blend of each ink's layer; lights are blended by screen, inks by multiply.

    A colour that isn't #RRGGBB (or null) gives the ink's own. With a crosshatch colour all layers have
    that one, or near black if it isn't a colour. keys are columns to keep, such as image_id.
    """
    usual = "CASE channel " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in INK_COLOURS.items()) + " ELSE '#000000' END"
    shown, usual = ("color", usual) if crosshatch is None else ("'" + crosshatch.replace("'", "") + "'", f"'{CROSSHATCH_COLOUR}'")
    hexed = f"CASE WHEN {shown} RLIKE '^#[0-9A-Fa-f]{{6}}$' THEN {shown} ELSE {usual} END"
    part = lambda i: F.expr(f"CAST(conv(substring({hexed}, {i}, 2), 16, 10) AS INT)")
    return channels.select(*keys, "channel", "ord", "enabled", part(2).alias("red"), part(4).alias("green"), part(6).alias("blue"), "opacity", F.expr("CASE WHEN channel IN ('red', 'green', 'blue') THEN 'screen' ELSE 'multiply' END").alias("blend"))


def unit_shapes(sides: DataFrame) -> DataFrame:
    """(sides, vertex, ux, uy): regular polygons of radius 0.5 from the top; even ones stand on an edge."""
    n = "least(6, greatest(3, sides))"
    turn = f"(-90e0 + CASE WHEN {n} % 2 = 0 THEN 180e0 / {n} ELSE 0e0 END + vertex * 360e0 / {n})"
    s = sides.select("sides").distinct().withColumn("vertex", F.explode(F.expr(f"sequence(0, {n} - 1)")))
    return s.withColumns({"ux": F.expr(f"5e-1 * cos(radians({turn}))"), "uy": F.expr(f"5e-1 * sin(radians({turn}))")})


#: Corners of the shapes that aren't regular polygons, and the circle as four cubics (fixed values).
RECTANGLE = ((-0.45, -0.45), (0.45, -0.45), (0.45, 0.45), (-0.45, 0.45))
TRIANGLE = ((0.0, -0.52), (0.5, 0.4), (-0.5, 0.4))
CIRCLE_PULL = 0.276


def named_shapes(shapes: DataFrame) -> DataFrame:
    """(shape, vertex, ux, uy) of rectangle, triangle, pentagon and hexagon; other names give no rows."""
    corners = lambda p: "array(" + ", ".join(f"struct({x!r}D AS ux, {y!r}D AS uy)" for x, y in p) + ")"
    turn = lambda n: f"radians(-90e0 + {180 / n if n % 2 == 0 else 0.0!r}D + i * 360e0 / {n})"
    ring = lambda n: f"transform(sequence(0, {n - 1}), i -> struct(5e-1 * cos({turn(n)}) AS ux, 5e-1 * sin({turn(n)}) AS uy))"
    points = f"CASE shape WHEN 'rectangle' THEN {corners(RECTANGLE)} WHEN 'triangle' THEN {corners(TRIANGLE)} WHEN 'pentagon' THEN {ring(5)} WHEN 'hexagon' THEN {ring(6)} END"
    return shapes.select("shape").distinct().select("shape", F.posexplode(F.expr(points)).alias("vertex", "p")).select("shape", "vertex", "p.ux", "p.uy")


def circle_cubics(keys: DataFrame) -> DataFrame:
    """Every row of keys with the four cubics of a circle of diameter 1: seg, x0, y0, c1x, c1y, c2x, c2y, x1, y1."""
    x, y = "element_at(array(0e0, 5e-1, 0e0, -5e-1, 0e0), {})", "element_at(array(-5e-1, 0e0, 5e-1, 0e0, -5e-1), {})"
    d = keys.withColumn("seg", F.explode(F.sequence(F.lit(1), F.lit(4))))
    d = d.withColumns({"x0": F.expr(x.format("seg")), "y0": F.expr(y.format("seg")), "x1": F.expr(x.format("seg + 1")), "y1": F.expr(y.format("seg + 1"))})
    # a quarter leaves each end along its tangent, towards the other end's axis
    pull = f"{CIRCLE_PULL / 0.5!r}D"
    return d.withColumns({"c1x": F.expr(f"x0 + x1 * {pull}"), "c1y": F.expr(f"y0 + y1 * {pull}"), "c2x": F.expr(f"x1 + x0 * {pull}"), "c2y": F.expr(f"y1 + y0 * {pull}")})


def mark_vertices(marks: DataFrame, shapes: DataFrame) -> DataFrame:
    """The corners of each mark: the unit shape scaled, turned and moved. Shapes are a broadcast of a few rows."""
    m = marks.join(F.broadcast(shapes), "sides")
    a, b = "(ux * extent)", "(uy * thickness)"
    return m.withColumns({"px": F.expr(f"x + {a} * cos(radians(angle)) - {b} * sin(radians(angle))"), "py": F.expr(f"y + {a} * sin(radians(angle)) + {b} * cos(radians(angle))")})


def polygon_to_cubic(points: DataFrame, key: str = "poly_id") -> DataFrame:
    """Closed polygon edges as cubics with handles at a third of the edge."""
    w = Window.partitionBy(key).orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = points.withColumns({"ex": F.coalesce(F.lead("x").over(w), F.first("x").over(whole)), "ey": F.coalesce(F.lead("y").over(w), F.first("y").over(whole))})
    return p.withColumns({f"c1{i}": F.expr(f"{i} + (e{i} - {i}) / 3e0") for i in "xy"} | {f"c2{i}": F.expr(f"e{i} - (e{i} - {i}) / 3e0") for i in "xy"})


def scale_marks(marks: DataFrame, sx: str, sy: str) -> DataFrame:
    """Marks in another artboard: positions by axis, sizes by the mean of both scales."""
    return marks.withColumns({"x": F.expr(f"x * {sx}"), "y": F.expr(f"y * {sy}"), "extent": F.expr(f"extent * ({sx} + {sy}) / 2e0"), "thickness": F.expr(f"thickness * ({sx} + {sy}) / 2e0")})


def index_marks(marks: DataFrame) -> DataFrame:
    """mark_idx within image and ink, in row order."""
    return marks.withColumn("mark_idx", F.row_number().over(Window.partitionBy("image_id", "channel").orderBy("row", "col")).cast("long"))


def mark_path_text(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """One closed path text for each mark, its corners in order."""
    one = F.expr(f"concat(CASE WHEN vertex = 0 THEN 'M ' ELSE 'L ' END, {X.number_text('px')}, ' ', {X.number_text('py')})")
    v = vertices.withColumn("step", one).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("vertex", "step"))).alias("steps"))
    return v.select(*keys, F.concat(F.array_join(F.transform("steps", lambda s: s["step"]), " "), F.lit(" Z")).alias("d"))


def xml_escape(c: F.Column) -> F.Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
