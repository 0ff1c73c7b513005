"""Compositing and coverage: exact integer blending, mark coverage, layers folded in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screentone.functions import formulas as X


def over_formulas(f: str, b: str, div: str = "div") -> dict[str, str]:
    """Source-over of colour columns {f}r.. on {b}r..: integers, rounded half up, clear where alpha is 0."""
    fa, ba = f"CAST({f}a AS BIGINT)", f"CAST({b}a AS BIGINT)"
    a = f"({fa} + ({ba} * (255 - {fa}) + 127) {div} 255)"
    c = lambda i: f"CASE WHEN {a} = 0 THEN 0 ELSE (CAST({f}{i} AS BIGINT) * {fa} * 255 + CAST({b}{i} AS BIGINT) * {ba} * (255 - {fa}) + {a} * 127) {div} ({a} * 255) END"
    return {i: f"CAST({c(i)} AS INT)" for i in "rgb"} | {"a": f"CAST({a} AS INT)"}


def over(df: DataFrame, f: str, b: str, out: str) -> DataFrame:
    """Adds {out}r, {out}g, {out}b, {out}a: {f} over {b}."""
    return df.withColumns({f"{out}{k}": F.expr(v) for k, v in over_formulas(f, b).items()})


CHECKER = "CASE WHEN (x div 12 + y div 12) % 2 = 0 THEN 232 ELSE 196 END"


def composite_preview(pixels: DataFrame, appearance: DataFrame) -> DataFrame:
    """Checkerboard, surface, export background and artwork, from back to front.

    appearance (image_id, sr, sg, sb, sa, er, eg, eb, ea) is a small table joined by image.
    """
    d = pixels.join(appearance, "image_id").withColumns({f"k{i}": F.expr(CHECKER) for i in "rgb"} | {"ka": F.lit(255)})
    d = over(d, "s", "k", "one_")
    d = over(d, "e", "one_", "two_")
    d = over(d.withColumnsRenamed({i: f"art_{i}" for i in "rgba"}), "art_", "two_", "")
    return d.select("image_id", "x", "y", "r", "g", "b", "a")


def composite_background(pixels: DataFrame, appearance: DataFrame) -> DataFrame:
    """Artwork over the export background; images without one stay as they are."""
    d = pixels.join(appearance.filter("has_background").select("image_id", "er", "eg", "eb", "ea"), "image_id", "left").withColumnsRenamed({i: f"art_{i}" for i in "rgba"})
    d = over(d, "art_", "e", "new_")
    return d.select("image_id", "x", "y", *[F.expr(f"CASE WHEN ea IS NULL THEN art_{i} ELSE new_{i} END").alias(i) for i in "rgba"])


def covers(px: str, py: str) -> str:
    """Whether a mark covers a point: dots are circles of radius extent, ellipses have the axes extent and
    thickness, squares and lines are rectangles turned by the mark's angle."""
    u = f"(({px} - x) * cos(radians(angle)) + ({py} - y) * sin(radians(angle)))"
    v = f"(({py} - y) * cos(radians(angle)) - ({px} - x) * sin(radians(angle)))"
    round_ = f"({px} - x) * ({px} - x) + ({py} - y) * ({py} - y) <= extent * extent"
    ellipse = f"{u} * {u} * thickness * thickness + {v} * {v} * extent * extent <= extent * extent * thickness * thickness / 4e0 AND extent * thickness > 0"
    box = f"abs({u}) <= extent / 2e0 AND abs({v}) <= CASE treatment WHEN 'squares' THEN extent ELSE thickness END / 2e0"
    return f"(CASE treatment WHEN 'dots' THEN {round_} WHEN 'ellipses' THEN {ellipse} ELSE {box} END)"


#: No point of a mark is farther from its centre.
REACH = "(CASE treatment WHEN 'dots' THEN extent WHEN 'squares' THEN extent * 75e-2 ELSE (extent + thickness) / 2e0 END)"


def _own_pixels(marks: DataFrame, width: int, height: int, x: tuple[str, str], y: tuple[str, str]) -> DataFrame:
    """Every mark with the pixels px, py of its own bounding box; there is no range join."""
    ends = {"x0": f"greatest(0, floor({x[0]}))", "x1": f"least({width - 1}, floor({x[1]}))", "y0": f"greatest(0, floor({y[0]}))", "y1": f"least({height - 1}, floor({y[1]}))"}
    m = marks.withColumns({k: F.expr(f"CAST({v} AS INT)") for k, v in ends.items()}).filter("x0 <= x1 AND y0 <= y1")
    return m.withColumn("px", F.explode(F.sequence("x0", "x1"))).withColumn("py", F.explode(F.sequence("y0", "y1")))


def _share(m: DataFrame, covered, n: int) -> DataFrame:
    """The pixels that n x n samples find covered: image_id, channel, col, row, px, py, coverage."""
    inside = F.lit(0)
    for i in range(n):
        for j in range(n):
            inside = inside + F.expr(f"CASE WHEN {covered(f'(px + {(i + 0.5) / n!r})', f'(py + {(j + 0.5) / n!r})')} THEN 1 ELSE 0 END")
    return m.withColumn("coverage", inside / F.lit(float(n * n))).filter("coverage > 0").select("image_id", "channel", "col", "row", "px", "py", "coverage")


def rasterize(marks: DataFrame, width: int, height: int, n: int = 1) -> DataFrame:
    """Coverage of pixels by marks: image_id, channel, col, row, px, py, coverage; n x n samples a pixel.

    Marks are drawn by their treatment (dots, ellipses, squares, lines); without such a column they are
    dots. Null or infinite marks cover nothing.
    """
    m = marks if "treatment" in marks.columns else marks.withColumn("treatment", F.lit("dots"))
    for c in ("angle", "thickness"):
        m = m if c in m.columns else m.withColumn(c, F.lit(0.0))
    m = m.filter("x + y + extent + thickness + angle BETWEEN -1e15 AND 1e15")
    m = _own_pixels(m, width, height, (f"x - {REACH}", f"x + {REACH}"), (f"y - {REACH}", f"y + {REACH}"))
    return _share(m, covers, n)


def rasterize_polygons(vertices: DataFrame, width: int, height: int, n: int = 1) -> DataFrame:
    """Coverage of pixels by polygon marks, by winding number; vertices are those of marks.mark_vertices.

    Marks with a null corner or fewer than three corners cover nothing. One row holds one mark's corners.
    """
    corner = F.struct("vertex", F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"))
    m = vertices.groupBy("image_id", "channel", "col", "row").agg(F.sort_array(F.collect_list(corner)).alias("p"), F.min(F.expr("px IS NOT NULL AND py IS NOT NULL")).alias("whole"))
    m = m.filter("whole AND size(p) >= 3").withColumns({f"{e}{v}": F.expr(f"array_{f}(transform(p, q -> q.{v}))") for e, f in (("lo_", "min"), ("hi_", "max")) for v in "xy"})

    def winds(px: str, py: str) -> str:
        a, b = "p[i]", "p[(i + 1) % size(p)]"
        side = f"(({b}.x - {a}.x) * ({py} - {a}.y) - ({px} - {a}.x) * ({b}.y - {a}.y))"
        turn = f"CASE WHEN {a}.y <= {py} AND {b}.y > {py} AND {side} > 0 THEN 1 WHEN {a}.y > {py} AND {b}.y <= {py} AND {side} < 0 THEN -1 ELSE 0 END"
        return f"aggregate(sequence(0, size(p) - 1), 0, (turns, i) -> turns + {turn}) <> 0"

    return _share(_own_pixels(m, width, height, ("lo_x", "hi_x"), ("lo_y", "hi_y")), winds, n)


def _blend(marked: DataFrame, white: bool) -> DataFrame:
    """Folds marks with their layers' colours in layer and mark order."""
    c = marked.withColumn("alpha", F.expr("floor(least(1e0, greatest(0e0, opacity)) * 255e0 + 5e-1) / 255e0 * coverage"))
    g = c.groupBy("image_id", "px", "py").agg(F.sort_array(F.collect_list(F.struct("ord", "row", "col", "alpha", "red", "green", "blue", "blend"))).alias("m"))

    def merge(acc, m):
        out = []
        for i, name in (("r", "red"), ("g", "green"), ("b", "blue")):
            s, d = m["alpha"] * m[name] / 255.0, acc[i]
            multiplied = s * (1.0 - acc["a"]) + d * (1.0 - m["alpha"]) + s * d
            out.append(F.when(m["blend"] == "screen", s + d - s * d).otherwise(multiplied).alias(i))
        return F.struct(*out, (m["alpha"] + acc["a"] - m["alpha"] * acc["a"]).alias("a"))

    g = g.select("image_id", "px", "py", F.aggregate("m", F.struct(*[F.lit(1.0 if white else 0.0).alias(i) for i in "rgba"]), merge).alias("v"))
    straight = {i: X.byte(f"CASE WHEN v.a > 0 THEN v.{i} / v.a ELSE 0e0 END * 255e0") for i in "rgb"} | {"a": X.byte("v.a * 255e0")}
    return g.select("image_id", "px", "py", *[F.expr(v).alias(k) for k, v in straight.items()])


def blend_on_clear(coverage: DataFrame, layers: DataFrame, channel: str | None = None) -> DataFrame:
    """Marks of enabled layers, or of one channel, on a clear base: image_id, px, py, r, g, b, a (not premultiplied).

    Each layer is blended by its `blend`: multiply or screen. Pixels without a mark have no row.
    """
    on = layers.filter("enabled") if channel is None else layers.filter("enabled").filter(F.col("channel") == channel)
    return _blend(coverage.join(on, "channel"), False)


def blend_documents(coverage: DataFrame, layers: DataFrame, white: bool) -> DataFrame:
    """As blend_on_clear with layers of each image's own (image_id, channel), on a clear or a white base."""
    return _blend(coverage.join(layers.filter("enabled"), ["image_id", "channel"]), white)


def blend_layers(coverage: DataFrame, layers: DataFrame) -> DataFrame:
    """Multiply blend of the marks of enabled layers on white, in layer and mark order: image_id, px, py, r, g, b.

    The fold holds the marks over one pixel only. Overlapping marks of one layer multiply twice.
    """
    c = coverage.join(F.broadcast(layers.filter("enabled")), "channel").withColumn("alpha", F.expr("floor(opacity * 255e0 + 5e-1) / 255e0 * coverage"))
    g = c.groupBy("image_id", "px", "py").agg(F.sort_array(F.collect_list(F.struct("ord", "row", "col", "alpha", "red", "green", "blue"))).alias("m"))
    fold = lambda c: F.aggregate("m", F.lit(1.0), lambda acc, m: acc * (1.0 - m["alpha"] + m["alpha"] * m[c] / 255.0))
    out = {i: fold(c) for i, c in (("r", "red"), ("g", "green"), ("b", "blue"))}
    return g.select("image_id", "px", "py", *[v.alias(f"f{i}") for i, v in out.items()]).select("image_id", "px", "py", *[F.expr(X.byte(f"f{i} * 255e0")).alias(i) for i in "rgb"])


def screen_layers(coverage: DataFrame, layers: DataFrame) -> DataFrame:
    """Screen blend of the marks of light on black, in layer and mark order: image_id, px, py, r, g, b."""
    c = coverage.join(F.broadcast(layers), "channel").withColumn("alpha", F.expr("floor(opacity * 255e0 + 5e-1) / 255e0 * coverage"))
    g = c.groupBy("image_id", "px", "py").agg(F.sort_array(F.collect_list(F.struct("ord", "row", "col", "alpha", "red", "green", "blue"))).alias("m"))
    fold = lambda c: F.aggregate("m", F.lit(0.0), lambda acc, m: acc + m["alpha"] * m[c] / 255.0 * (1.0 - acc))
    out = {i: fold(c) for i, c in (("r", "red"), ("g", "green"), ("b", "blue"))}
    return g.select("image_id", "px", "py", *[v.alias(f"f{i}") for i, v in out.items()]).select("image_id", "px", "py", *[F.expr(X.byte(f"f{i} * 255e0")).alias(i) for i in "rgb"])


#: The lights of RGB screens (fixed values).
LIGHTS = "(VALUES ('red', 0, 255, 0, 0), ('green', 1, 0, 255, 0), ('blue', 2, 0, 0, 255)) AS t(channel, ord, red, green, blue)"


def render_documents(docs: DataFrame, pixels: DataFrame, layers: DataFrame, width: int, height: int, n: int = 1, most: int = 64_000_000) -> DataFrame:
    """Rendered pixels of native documents of either output mode: image_id, x, y, r, g, b, a.

    docs has the native settings and output_mode (cmyk: ink on white; rgb: light on black). Pixels
    without a mark keep the base. Sizes over the cap are refused.
    """
    from screentone.operators import marks

    if width * height > most:
        raise ValueError(f"over {most} pixels")
    ink = blend_layers(rasterize(marks.native_marks(pixels, docs.filter("output_mode = 'cmyk'")), width, height, n), layers)
    lights = docs.sparkSession.sql(f"SELECT *, 1e0 AS opacity FROM {LIGHTS}")
    light = screen_layers(rasterize(marks.native_rgb_marks(pixels, docs.filter("output_mode = 'rgb'")), width, height, n), lights)
    every = docs.select("image_id", F.when(F.col("output_mode") == "rgb", 0).otherwise(255).alias("base")).withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    d = every.join(ink.unionByName(light), ["image_id", "px", "py"], "left")
    return d.select("image_id", F.col("px").alias("x"), F.col("py").alias("y"), *[F.coalesce(i, "base").alias(i) for i in "rgb"], F.lit(255).alias("a"))
