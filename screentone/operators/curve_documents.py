"""Curve documents end to end: every ink's lines in either layout, their outlines, and the drawn pixels.

Keys are (image, ink, line). A document's settings ride in the key of its lines, so no step joins them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screentone.functions import formulas as X
from screentone.operators import colour, curves, grid, marks, raster

#: Order of the layers, and of crosshatch (fixed values).
INK_ORDER = ("c", "m", "y", "k", "red", "green", "blue")
CROSSHATCH_ORDER = ("k", "c", "m", "y")

#: The tone that an ink takes from a mapping: lights take the place of the first three inks (fixed values).
SLOT = {"c": "c", "m": "m", "y": "y", "k": "k", "red": "c", "green": "m", "blue": "y"}


def _pick(of: str, table: dict[str, str]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " END"


def _place(order: tuple[str, ...]) -> str:
    return _pick("channel", {c: str(i) for i, c in enumerate(order)})


def jobs(docs: DataFrame, inks: DataFrame) -> DataFrame:
    """One row for each enabled ink of each document, with its grid, path and reach.

    docs: image_id, src_w, src_h, out_w, out_h, cells, min_mark, max_mark, value_mode (cmyk, rgb, luminance,
    single, crosshatch), single_channel, crosshatch_color, output_mode (cmyk, rgb), layout (full, motif), shared,
    shared_path_id, shared_close_ends, shared_smooth_join. inks: image_id, channel, enabled, color, opacity,
    threshold, scale, max_size, resolution_scale, offset_x, offset_y, grid_rotation, pivot_x, pivot_y, quality,
    path_id, close_ends, smooth_join, curve_scale, coverage (auto, manual), bleed, tile_count, tile_angle,
    tile_offset, stack_count, stack_spacing, stack_angle, stack_offset, stagger, alternate (none, flip, rotate).
    Rows without image_id are left out.
    """
    light = F.col("channel").isin(*colour.LIGHTS)
    j = docs.join(inks.filter("enabled"), "image_id").filter(F.expr(colour.uses_lights()) == light)
    j = j.withColumn("cells", F.expr("greatest(2e0, floor(cells * greatest(resolution_scale, 5e-2) + 5e-1))"))
    j = j.withColumns({k: F.expr(v) for k, v in X.grid("out_w", "out_h", "cells").items()}).withColumn("cell", F.expr("least(out_w / cols, out_h / rows)"))
    for c in ("path_id", "close_ends", "smooth_join"):
        j = j.withColumn(c, F.expr(f"CASE WHEN shared THEN shared_{c} ELSE {c} END"))
    hatch = "value_mode <=> 'crosshatch'"
    j = j.withColumn("ord", F.expr(f"CASE WHEN {hatch} THEN {_place(CROSSHATCH_ORDER)} ELSE {_place(INK_ORDER)} END"))
    image = Window.partitionBy("image_id")
    j = j.withColumns({"turn": F.row_number().over(image.orderBy("ord")) - 1, "inks": F.count("*").over(image)})
    low = "greatest(min_mark / 100e0, 0e0)"
    j = j.withColumn("most", F.expr(f"cell * greatest({low}, max_mark / 100e0) * max_size / 100e0 * scale"))
    return j.withColumn("job", F.struct("image_id", "channel")).withColumn("tolerance", F.expr("least(75e-2, greatest(15e-2, greatest(cell, 1e0) * 4e-2 / sqrt(greatest(quality, 1e-1))))"))


def tones(j: DataFrame, pixels: DataFrame) -> DataFrame:
    """job, col, row, value: the tone of each cell for each job; images are resampled once for each grid."""
    cells = grid.resample(pixels, j.select("image_id", "src_w", "src_h", "cols", "rows").distinct())
    slot = _pick("channel", {c: f"'{s}'" for c, s in SLOT.items()})
    dark = X.darkness()
    inks = _pick("slot", {i: x for i, x in X.cmyk().items()})
    lights = _pick("slot", {s: f"{i} / 255e0 * (a / 255e0)" for s, i in zip("cmy", "rgb")}).replace(" END", " ELSE 0e0 END")
    single = _pick("single_channel", {c: f"'{s}'" for c, s in SLOT.items()})
    share = f"least(1e0 / inks, greatest(0e0, {dark} - turn * (1e0 / inks)))"
    value = f"CASE WHEN a = 0 THEN 0e0 WHEN value_mode = 'cmyk' THEN {inks} WHEN value_mode = 'rgb' THEN {lights} WHEN value_mode = 'single' THEN IF(slot = {single}, {dark}, 0e0) WHEN value_mode = 'crosshatch' THEN IF({share} <= 1e-12, 0e0, {share}) ELSE {dark} END"
    some = j.select("job", "image_id", "cols", "rows", "value_mode", "single_channel", "turn", "inks", F.expr(slot).alias("slot"))
    return cells.join(some, ["image_id", "cols", "rows"]).select("job", "col", "row", F.expr(value).alias("value"))


def _turned(x: str, y: str, slide: bool) -> dict[str, str]:
    """A point turned about the pivot; with `slide` a pivot off the centre moves it across the lines only."""
    px, py, s, k = "(out_w / 2e0 + pivot_x)", "(out_h / 2e0 + pivot_y)", "sin(radians(grid_rotation))", "cos(radians(grid_rotation))"
    tx, ty = f"({px} + ({x} - {px}) * {k} - ({y} - {py}) * {s})", f"({py} + ({x} - {px}) * {s} + ({y} - {py}) * {k})"
    if not slide:
        return {"x": tx, "y": ty}
    along = f"((pivot_x - (pivot_x * {k} - pivot_y * {s})) * {k} + (pivot_y - (pivot_x * {s} + pivot_y * {k})) * {s})"
    flat = "abs(grid_rotation) <= 1e-4"
    return {"x": f"CASE WHEN {flat} THEN {x} ELSE {tx} - {k} * {along} END", "y": f"CASE WHEN {flat} THEN {y} ELSE {ty} - {s} * {along} END"}


SETTINGS = ("layout", "out_w", "out_h", "cols", "rows", "cell", "quality", "close_ends", "smooth_join", "grid_rotation", "pivot_x", "pivot_y", "offset_x", "offset_y", "curve_scale", "coverage", "bleed", "tile_count", "tile_angle", "tile_offset", "stack_count", "stack_spacing", "stack_angle", "stack_offset", "stagger", "alternate", "most", "tolerance", "threshold", "min_mark", "max_mark", "max_size", "scale")

#: Settings that widths and outlines need.
KEPT = ("out_w", "out_h", "cols", "rows", "cell", "threshold", "min_mark", "max_mark", "max_size", "scale", "most", "tolerance", "close_ends")


def _sampled(j: DataFrame, paths: DataFrame) -> DataFrame:
    """job, its settings, k, x, y: every job's path at equal steps, as many as its layout asks for."""
    s = j.select("path_id", F.struct("job", *SETTINGS).alias("key")).join(paths, "path_id").drop("path_id").withColumnRenamed("key", "path_id")
    full = "path_id.layout <> 'motif'"
    seam = f"coalesce({full} AND path_id.close_ends AND path_id.smooth_join, false)"
    s = curves.smooth_seam(s.withColumns({"own_x": F.col("c2x"), "own_y": F.col("c2y")})).withColumns({f"c2{v}": F.expr(f"IF({seam}, c2{v}, own_{v})") for v in "xy"})
    p = curves.flatten(s, f"CASE WHEN {full} THEN {curves.STEPS} ELSE 24 END")
    # a closed line comes back to its start
    twice = f"explode(IF(seg = 1 AND k = 0 AND {full} AND coalesce(path_id.close_ends, false), array(seg, {1 << 40}L), array(seg)))"
    p = p.select(F.col("path_id").alias("poly_id"), "k", "x", "y", F.expr(twice).alias("seg")).select("poly_id", F.struct("seg", "k").alias("seq"), "x", "y")
    nodes = "CASE WHEN poly_id.layout <> 'motif' THEN greatest(2, ceil(poly_id.out_w / greatest(poly_id.cell, 1e0) * greatest(poly_id.quality, 1e-1))) ELSE greatest(4, ceil(24e0 * greatest(poly_id.quality, 1e-1))) END"
    return curves.resample(p, nodes)


def _over_line(p: DataFrame, *names: str) -> DataFrame:
    """Adds lo, hi (bounds), s and e (ends) of each line to its points, for each of the named coordinates."""
    w = Window.partitionBy("poly_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return p.withColumns({f"{n}{v}": f(v).over(w) for v in names for n, f in (("lo", F.min), ("hi", F.max), ("s", F.first), ("e", F.last))})


def _full_width(sampled: DataFrame) -> DataFrame:
    """Baselines as wide as the turned artboard, repeated at every cell where they touch it: poly_id, copy, k, x, y.

    Copies are shifts of one turned line, so its bounds tell which ones touch. A line whose ends meet has
    no width and gives nothing.
    """
    p = _over_line(sampled.filter("poly_id.layout <> 'motif'"), "x", "y").withColumn("chord", F.expr("sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy))")).filter("chord > 1e-9").select("*", "poly_id.*")
    p = p.withColumn("size", F.expr("(abs(out_w * cos(radians(grid_rotation))) + abs(out_h * sin(radians(grid_rotation)))) / chord"))
    p = p.withColumns({f"b{v}": F.expr(f"({v} - lo{v}) * size + (out_{d} - (hi{v} - lo{v}) * size) / 2e0 + offset_{v}") for v, d in (("x", "w"), ("y", "h"))})
    p = _over_line(p.withColumns({f"t{v}": F.expr(e) for v, e in _turned("bx", "by", True).items()}), "tx", "ty")
    flat = "abs(grid_rotation) <= 1e-4"
    p = p.withColumns({"step": F.expr("greatest(cell, 1e0)"), "across": F.expr(f"IF({flat}, 0e0, -sin(radians(grid_rotation)))"), "down": F.expr(f"IF({flat}, 1e0, cos(radians(grid_rotation)))")})
    p = p.withColumns({"gx": F.expr("across * step"), "gy": F.expr("down * step"), "reach": F.expr("CAST(ceil(sqrt(out_w * out_w + out_h * out_h) / step) AS INT) + 2")})
    p = p.withColumn("copy", F.explode(F.expr("sequence(-reach, reach)")))
    p = p.filter("hitx + gx * copy >= -2e0 * step AND lotx + gx * copy <= out_w + 2e0 * step AND hity + gy * copy >= -2e0 * step AND loty + gy * copy <= out_h + 2e0 * step")
    return p.select("poly_id", "copy", "k", F.expr("tx + gx * copy").alias("x"), F.expr("ty + gy * copy").alias("y"))


def _motif_rows(sampled: DataFrame) -> DataFrame:
    """Chained rows of motifs that cover the artboard, at equal steps: poly_id, copy, k, x, y.

    Odd (tile + row) copies are mirrored or turned, and run backwards if they would lead away; each tile starts where
    the one before ended, and as there are only two ways of a tile, that place needs no running sum.
    """
    p = curves.normalize_motif(sampled.filter("poly_id.layout = 'motif'"), "poly_id.curve_scale")
    w = Window.partitionBy("poly_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = _over_line(p, "x", "y").select("*", "poly_id.*").withColumns({"radius": F.max(F.expr("sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy))")).over(w), "held": F.count("*").over(w)})
    p = p.withColumns({"radius": F.expr("greatest(1e0, radius)"), "ax": F.expr("ex - sx"), "ay": F.expr("ey - sy")}).withColumn("apart", F.expr("sqrt(ax * ax + ay * ay) > 1e-4"))
    p = p.withColumns({"rx": F.expr("IF(apart, ax, cos(radians(tile_angle)) * curve_scale)"), "ry": F.expr("IF(apart, ay, sin(radians(tile_angle)) * curve_scale)")}).withColumn("al", F.expr("sqrt(rx * rx + ry * ry)"))
    p = p.withColumns({"dx": F.expr("IF(al <= 1e-9, 1e0, rx / al)"), "dy": F.expr("IF(al <= 1e-9, 0e0, ry / al)"), "ux": F.expr("cos(radians(tile_angle + 90e0 + stack_angle))"), "uy": F.expr("sin(radians(tile_angle + 90e0 + stack_angle))")})
    p = p.withColumns({f"mid_{v}": F.expr(f"out_{z} / 2e0 + offset_{v} + d{v} * tile_offset + u{v} * stack_offset") for v, z in (("x", "w"), ("y", "h"))})
    turn = {"x": "({a}x * cos(radians(grid_rotation)) - {a}y * sin(radians(grid_rotation)))", "y": "({a}x * sin(radians(grid_rotation)) + {a}y * cos(radians(grid_rotation)))"}
    axes = {f"tile_{v}": turn[v].format(a="r") for v in "xy"} | {f"stack_{v}": turn[v].format(a="u") + " * stack_spacing" for v in "xy"} | {f"center_{v}": e for v, e in _turned("mid_x", "mid_y", False).items()}
    p = p.withColumns({k: F.expr(v) for k, v in axes.items()}).withColumn("footprint", F.expr("radius + most / 2e0 + greatest(bleed, 0e0) * greatest(cell, 1e0) + abs(stagger)"))
    p = curves.motif_counts(p).withColumns({k: F.expr(f"CAST(greatest({k}, IF(coverage = 'manual', {c}, 1)) AS INT)") for k, c in (("tiles", "tile_count"), ("stacks", "stack_count"))})
    # odd tiles: signs, whether they run backwards, and their way
    p = p.withColumns({"ox": F.expr("IF(alternate IN ('flip', 'rotate'), -1e0, 1e0)"), "oy": F.expr("IF(alternate = 'rotate', -1e0, 1e0)")}).withColumn("turned", F.expr("ox * ax * rx + oy * ay * ry < 0"))
    p = p.withColumns({f"v{v}": F.expr(f"IF(turned, -1e0, 1e0) * o{v} * a{v}") for v in "xy"})
    p = p.withColumn("stack", F.explode(F.expr("sequence(0, stacks - 1)"))).withColumn("tile", F.explode(F.expr("sequence(0, tiles - 1)")))
    p = p.withColumns({"odd": F.expr("(tile + stack) % 2 = 1"), "odds": F.expr("(tile + stack % 2) div 2")}).withColumn("ord", F.expr("IF(odd AND turned, held - 1 - k, k)")).filter("tile = 0 OR ord > 0")
    for v in "xy":
        first = f"mid_{v} + (stack - (stacks - 1) / 2e0) * u{v} * stack_spacing + d{v} * IF(stack % 2 = 1, stagger, 0e0) - (tiles - 1) / 2e0 * r{v}"
        begin = f"IF(odd, o{v}, 1e0) * ({v} - IF(odd AND turned, e{v}, s{v}))"
        p = p.withColumn(f"q{v}", F.expr(f"{first} + odds * v{v} + (tile - odds) * a{v} + {begin}"))
    put = _turned("qx", "qy", False)
    line = F.struct(*[F.col(f"poly_id.{c}").alias(c) for c in ("job", *SETTINGS)], "stack", (F.col("tiles") * (F.col("held") - 1) + 1).alias("points")).alias("poly_id")
    c = p.select(line, (F.col("tile").cast("long") * F.col("held") + F.col("ord")).alias("seq"), *[F.expr(put[v]).alias(v) for v in "xy"])
    steps = "least(20000, greatest(poly_id.points, ceil(cum / greatest(5e-1, greatest(poly_id.cell, 1e0) / greatest(poly_id.quality, 1e0))) + 1))"
    return curves.resample(c, steps).select("poly_id", F.col("poly_id.stack").alias("copy"), "k", "x", "y")


def lines(j: DataFrame, paths: DataFrame) -> DataFrame:
    """Placed lines of every job, of either layout: job, out_w, out_h, cols, rows, copy, seq, x, y."""
    sampled = _sampled(j, paths)
    named = lambda df: df.select("poly_id.job", *[f"poly_id.{c}" for c in ("out_w", "out_h", "cols", "rows")], "copy", F.col("k").cast("long").alias("seq"), "x", "y")
    return named(_full_width(sampled)).unionByName(named(_motif_rows(sampled)))


def outlines(points: DataFrame) -> DataFrame:
    """Outlines of lines (poly_id with a field closed, seq, x, y, width): poly_id, part, ord, op, x0, y0, c1x .. c2y, x, y.

    Open lines have one contour: left side, cap, right side backwards, cap, close; closed ones have a ring for
    each side. Rows carry where they start. Lines of one point have none. All from one pass over each line.
    """
    w = Window.partitionBy("poly_id").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = points.withColumns({"closed": F.expr("coalesce(poly_id.closed, false)"), "fx": F.first("x").over(w), "fy": F.first("y").over(w), "ended": F.lead("seq").over(w).isNull(), "begun": F.lag("seq").over(w).isNull()})
    p = p.filter("NOT (closed AND ended AND NOT begun AND sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy)) <= 1e-3)")
    p = p.withColumns({"ended": F.lead("seq").over(w).isNull(), "begun": F.lag("seq").over(w).isNull()}).filter("NOT (begun AND ended)")

    def beside(c: str, ahead: bool):
        step = F.lead(c).over(w) if ahead else F.lag(c).over(w)
        return F.coalesce(step, F.when(F.col("closed"), (F.first(c) if ahead else F.last(c)).over(whole)).otherwise(F.col(c)))

    def tangent(df: DataFrame, a: str, out: str) -> DataFrame:
        d = df.withColumns({f"{out}{v}": beside(f"{a}{v}", True) - beside(f"{a}{v}", False) for v in "xy"}).withColumn("tl", F.expr(f"sqrt({out}x * {out}x + {out}y * {out}y)"))
        return d.withColumns({f"{out}x": F.expr(f"IF(tl <= 1e-9, 1e0, {out}x / tl)"), f"{out}y": F.expr(f"IF(tl <= 1e-9, 0e0, {out}y / tl)"), f"{out}_": F.expr("tl <= 1e-9")})

    p = tangent(p, "", "t").withColumns({"lx": F.expr("x - ty * (width / 2e0)"), "ly": F.expr("y + tx * (width / 2e0)"), "rx": F.expr("x + ty * (width / 2e0)"), "ry": F.expr("y - tx * (width / 2e0)")})
    p = tangent(tangent(p, "l", "u"), "r", "v")
    p = p.withColumns({f"n{c}": beside(c, True) for c in ("lx", "ly", "rx", "ry", "ux", "uy", "vx", "vy", "v_")})
    none = "CAST(NULL AS DOUBLE)"

    def row(part: int, ord_: str, op: str, x0: str, y0: str, c: tuple | None, x: str, y: str) -> str:
        c1x, c1y, c2x, c2y = c or (none,) * 4
        return f"named_struct('part', {part}, 'ord', CAST({ord_} AS BIGINT), 'op', '{op}', 'x0', {x0}, 'y0', {y0}, 'c1x', {c1x}, 'c1y', {c1y}, 'c2x', {c2x}, 'c2y', {c2y}, 'x', {x}, 'y', {y})"

    left_h, right_h = "(sqrt((nlx - lx) * (nlx - lx) + (nly - ly) * (nly - ly)) / 3e0)", "(sqrt((nrx - rx) * (nrx - rx) + (nry - ry) * (nry - ry)) / 3e0)"
    left = ("lx", "ly", (f"lx + ux * {left_h}", f"ly + uy * {left_h}", f"nlx - nux * {left_h}", f"nly - nuy * {left_h}"), "nlx", "nly")
    # backwards, tangents point the other way, but for points that have none
    here, there = "IF(v_, -1e0, 1e0)", "IF(nv_, -1e0, 1e0)"
    right = ("nrx", "nry", (f"nrx - nvx * {there} * {right_h}", f"nry - nvy * {there} * {right_h}", f"rx + vx * {here} * {right_h}", f"ry + vy * {here} * {right_h}"), "rx", "ry")

    def cap(part: int, a: str, b: str) -> str:
        to = lambda p, v: f"{p}{v} + ({v} - {p}{v}) * 2e0 / 3e0"
        one = row(part, "0", "C", f"{a}x", f"{a}y", (to(a, "x"), to(a, "y"), to(b, "x"), to(b, "y")), f"{b}x", f"{b}y")
        return f"IF(sqrt((lx - rx) * (lx - rx) + (ly - ry) * (ly - ry)) <= 1e-3, array(), array({one}))"

    start = row(0, "0", "M", none, none, None, "lx", "ly")
    opened = f"concat(IF(begun, concat(array({start}, {row(6, '0', 'Z', 'rx', 'ry', None, 'lx', 'ly')}), {cap(5, 'r', 'l')}), array()), IF(ended, {cap(2, 'l', 'r')}, array({row(1, 'seq', 'C', *left)}, {row(4, '-seq', 'C', *right)})))"
    ring = f"concat(IF(begun, array({start}, {row(2, '0', 'Z', 'lx', 'ly', None, 'lx', 'ly')}), array()), IF(ended, array({row(3, '0', 'M', none, none, None, 'rx', 'ry')}, {row(6, '0', 'Z', 'rx', 'ry', None, 'rx', 'ry')}, {row(1, 'seq', 'C', *left)}, {row(5, '0', 'C', *right)}), array({row(1, 'seq', 'C', *left)}, {row(4, '-seq', 'C', *right)})))"
    return p.select("poly_id", F.expr(f"inline(IF(closed, {ring}, {opened}))"))


def curve_outlines(pixels: DataFrame, docs: DataFrame, inks: DataFrame, paths: DataFrame, channel: str | None = None) -> DataFrame:
    """Outlines of curve documents: image_id, channel, copy, contour (run, clip), part, ord, op, x0 .. y.

    All enabled inks in either layout: lines, widths from the tones under them, active runs, clipping to the
    artboard and its margin, simplification, outlines. Closed lines are outlined whole if they have any width.
    pixels, docs and inks as for `jobs`; paths are segments by path_id. An ink without a path has no lines.
    `channel` gives one ink's outlines alone.
    """
    j = jobs(docs, inks)
    j = j if channel is None else j.filter(F.col("channel") == channel)
    # a point's key holds its place, so no step joins the lines again; settings come from the few rows of jobs
    at = lines(j, paths).select(F.col("job").alias("image_id"), F.struct("copy", "seq", "x", "y").alias("point_id"), "cols", "rows", F.expr("x / (out_w / cols)").alias("u"), F.expr("y / (out_h / rows)").alias("v"))
    found = grid.sample_bicubic(at, tones(j, pixels).withColumnRenamed("job", "image_id"))
    p = curves.curve_width(found.select(F.col("image_id").alias("job"), "point_id.*", "value").join(j.select("job", *KEPT), "job"), "threshold", "cell", "min_mark", "max_mark", "max_size", "scale")
    closed = F.coalesce("close_ends", F.lit(False))
    margin = F.when(closed, 1e30).otherwise(F.expr("most * 15e-1 + 2e0"))
    p = p.select(F.struct("job.image_id", "job.channel", "copy", "out_w", "out_h", margin.alias("margin"), "tolerance", closed.alias("closed")).alias("poly_id"), "seq", "x", "y", "width")
    runs = curves.split_active(p, "poly_id.closed").select(F.struct("poly_id.*", "run").alias("poly_id"), "seq", "x", "y", "width")
    c = curves.clip_polylines(runs, "poly_id.out_w", "poly_id.out_h", "poly_id.margin")
    # each step gives its end, and the first one of a run its start too
    c = c.withColumn("first", F.expr("coalesce(lag(run) OVER (PARTITION BY poly_id ORDER BY seq) <> run, true)"))
    ends = "named_struct('seq', 2 * seq + 1, 'x', x1, 'y', y1, 'width', w1)"
    every = c.select(*[f"poly_id.{k}" for k in ("image_id", "channel", "copy", "run", "closed", "tolerance")], F.col("run").alias("clip"), F.expr(f"inline(IF(first, array(named_struct('seq', 2 * seq, 'x', x0, 'y', y0, 'width', w0), {ends}), array({ends})))"))
    s = curves.simplify(every, "tolerance", ("image_id", "channel", "copy", "run", "clip", "closed"))
    o = outlines(s.select(F.struct("image_id", "channel", "copy", "run", "clip", "closed").alias("poly_id"), "seq", "x", "y", "width"))
    return o.select("poly_id.image_id", "poly_id.channel", "poly_id.copy", F.struct("poly_id.run", "poly_id.clip").alias("contour"), "part", "ord", "op", "x0", "y0", "c1x", "c1y", "c2x", "c2y", "x", "y")


def rasterize_outlines(commands: DataFrame, width: int, height: int, n: int = 4, scale: tuple[str, str] = ("1e0", "1e0"), flatness: float = 0.02) -> DataFrame:
    """Coverage of pixels by outlines of any number of contours, by nonzero winding: image_id, channel, copy, px, py, coverage.

    commands as from `outlines` with image_id, channel and copy (one filled shape each); scale gives pixels for a
    unit on either axis, as SQL. Cubics become steps off by `flatness` of a pixel at most; each step meets n scan lines a pixel
    row; between crossings, in order, a running sum of directions tells what is inside, and a pixel's share of
    each span is exact along x. Rows without finite coordinates are left out.
    """
    sx, sy = scale
    d = commands.filter("op <> 'M'").select("image_id", "channel", "copy", *[F.expr(f"{c} * {sx if 'x' in c else sy}").alias(c) for c in ("x0", "y0", "c1x", "c1y", "c2x", "c2y", "x", "y")])
    d = d.filter("x0 + y0 + x + y + coalesce(c1x + c1y + c2x + c2y, 0e0) BETWEEN -1e15 AND 1e15")
    bend = " , ".join(f"abs({a}{v0} - 2e0 * {b}{v} + {c}{v}{e})" for v in "xy" for a, b, c, v0, e in (("", "c1", "c2", f"{v}0", ""), ("c1", "c2", "", v, "")))
    d = d.withColumn("m", F.expr(f"IF(c1x IS NULL, 1, CAST(least(256e0, greatest(1e0, ceil(sqrt(106e-2 * greatest({bend}) / {flatness!r})))) AS INT))"))
    at = lambda v, t: f"IF(c1x IS NULL, {v}0 + ({v} - {v}0) * ({t}), {curves._cubic(v, f'({t})').replace(f'{v}1', v)})"
    d = d.withColumn("i", F.explode(F.expr("sequence(1, m)")))
    d = d.select("image_id", "channel", "copy", *[F.expr(at(v, t)).alias(f"{v}{k}") for v in "xy" for k, t in (("a", "(i - 1) / CAST(m AS DOUBLE)"), ("b", "i / CAST(m AS DOUBLE)"))])
    d = d.withColumns({"s0": F.expr(f"CAST(greatest(0e0, ceil(least(ya, yb) * {n} - 5e-1)) AS INT)"), "s1": F.expr(f"CAST(least({n * height}e0, ceil(greatest(ya, yb) * {n} - 5e-1)) AS INT) - 1")}).filter("s0 <= s1")
    d = d.withColumn("s", F.explode(F.expr("sequence(s0, s1)"))).withColumn("cut", F.expr(f"xa + ((s + 5e-1) / {n} - ya) * (xb - xa) / (yb - ya)")).withColumn("way", F.expr("IF(yb > ya, 1, -1)"))
    line = Window.partitionBy("image_id", "channel", "copy", "s").orderBy("cut")
    d = d.withColumns({"turns": F.sum("way").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "to": F.lead("cut").over(line)})
    d = d.filter("turns <> 0").select("image_id", "channel", "copy", F.expr(f"s div {n}").cast("int").alias("py"), F.expr("greatest(cut, 0e0)").alias("lo"), F.expr(f"least(to, {float(width)!r}D)").alias("hi")).filter("lo < hi")
    d = d.withColumn("px", F.explode(F.expr("sequence(CAST(floor(lo) AS INT), CAST(ceil(hi) AS INT) - 1)")))
    # shares are added as whole 1e-9ths, so their order doesn't matter
    return d.groupBy("image_id", "channel", "copy", "px", "py").agg(F.expr(f"least(1e0, sum(CAST(floor((least(hi, px + 1e0) - greatest(lo, px)) * 1e9 + 5e-1) AS BIGINT)) / {n}e9)").alias("coverage")).filter("coverage > 0")


def document_layers(docs: DataFrame, inks: DataFrame) -> DataFrame:
    """image_id, channel, ord, enabled, red, green, blue, opacity, blend of each ink of each document; crosshatches have one colour."""
    hatch = f"CASE WHEN crosshatch_color RLIKE '^#[0-9A-Fa-f]{{6}}$' THEN crosshatch_color ELSE '{marks.CROSSHATCH_COLOUR}' END"
    return marks.layers(jobs(docs, inks).withColumn("color", F.expr(f"CASE WHEN value_mode <=> 'crosshatch' THEN {hatch} ELSE color END")), keys=("image_id",))


def render_curve_documents(pixels: DataFrame, docs: DataFrame, inks: DataFrame, paths: DataFrame, width: int, height: int, n: int = 4, white: bool = True, channel: str | None = None, most: int = 64_000_000) -> DataFrame:
    """Drawn curve documents, all scaled to width x height: image_id, x, y, r, g, b, a.

    Inks are blended by multiply and lights by screen, layer by layer and line by line, on white or on a clear
    base; `channel` draws one ink alone. Every document has all its pixels. Sizes over the cap are refused.
    """
    if width <= 0 or height <= 0 or width * height > most:
        raise ValueError(f"sizes must be positive and at most {most} pixels")
    o = curve_outlines(pixels, docs, inks, paths, channel)
    o = o.join(docs.select("image_id", "out_w", "out_h"), "image_id")
    c = rasterize_outlines(o, width, height, n, (f"({width}e0 / out_w)", f"({height}e0 / out_h)"))
    c = c.withColumnRenamed("copy", "row").withColumn("col", F.lit(0))
    drawn = raster.blend_documents(c, document_layers(docs, inks), white)
    every = docs.select("image_id").distinct().withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    base = F.lit(255 if white else 0)
    d = every.join(drawn, ["image_id", "px", "py"], "left")
    return d.select("image_id", F.col("px").alias("x"), F.col("py").alias("y"), *[F.coalesce(i, base).alias(i) for i in "rgba"])
