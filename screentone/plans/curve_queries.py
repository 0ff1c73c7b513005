"""Queries over polylines, paths and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from screentone import fixtures as fx
from screentone.functions import formulas as X
from screentone.operators import curves, marks, raster
from screentone.plans import shape_queries as sq

R, _r, _sr = X.rounded, sq._r, sq._sr
W = "OVER (PARTITION BY poly_id ORDER BY seq)"
ALL = "OVER (PARTITION BY poly_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
L = curves._length
SEG = ["x0", "y0", "c1x", "c1y", "c2x", "c2y", "x1", "y1"]


def _segments(spark, sf):
    return curves.path_segments(fx.path_strings(spark, sf))


def f1_path_segments(spark, sf):
    return _r(_segments(spark, sf), ["path_id", "seg"], SEG)


_NUM = curves.NUMBER.replace("\\.", "[.]")
_C = lambda v, i: (
    f"CASE op WHEN 'C' THEN n[{i + 1}] WHEN 'Q' THEN {v}0 + (n[{i + 1}] - {v}0) * 2e0 / 3e0 ELSE {v}0 + ({v}1 - {v}0) / 3e0 END AS c1{v}, "
    f"CASE op WHEN 'C' THEN n[{i + 3}] WHEN 'Q' THEN {v}1 + (n[{i + 1}] - {v}1) * 2e0 / 3e0 ELSE {v}0 + ({v}1 - {v}0) * 2e0 / 3e0 END AS c2{v}"
)
SEGMENTS = {
    "tk": f"SELECT path_id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT path_id, regexp_extract_all(d, '{curves.TOKEN}', 1) AS t FROM path_strings)",
    "tn": f"SELECT path_id, pos, substr(token, 1, 1) AS op, list_transform(regexp_extract_all(token, '{_NUM}', 1), lambda z: CAST(z AS DOUBLE)) AS n FROM tk",
    "ts": "SELECT *, CASE WHEN op = 'Z' THEN first_value(n[1]) OVER (PARTITION BY path_id ORDER BY pos) ELSE n[len(n) - 1] END AS x1, CASE WHEN op = 'Z' THEN first_value(n[2]) OVER (PARTITION BY path_id ORDER BY pos) ELSE n[len(n)] END AS y1 FROM tn",
    "tl": "SELECT *, lag(x1) OVER (PARTITION BY path_id ORDER BY pos) AS x0, lag(y1) OVER (PARTITION BY path_id ORDER BY pos) AS y0 FROM ts",
    "seg": f"SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY pos) AS seg, x0, y0, x1, y1, {_C('x', 0)}, {_C('y', 1)} FROM tl WHERE op <> 'M'",
}


def f2_flatten(spark, sf):
    return _r(curves.flatten(_segments(spark, sf)), ["path_id", "seg", "k"], ["x", "y"])


def f3_resample(spark, sf):
    return _r(curves.resample(fx.poly_points(spark, sf), 16), ["poly_id", "k"], ["x", "y"])


def f4_length_bounds(spark, sf):
    p = fx.poly_points(spark, sf)
    return _r(curves.length(p).join(curves.bounds(p), "poly_id"), ["poly_id"], ["length", "min_x", "max_x", "min_y", "max_y"])


_ROT = "(0e0 + poly_id % 90)"


def f5_fit_baseline(spark, sf):
    return _r(curves.fit_baseline(fx.poly_points(spark, sf), "300e0", "200e0", _ROT, "5e0", "-7e0"), ["poly_id", "seq"], ["x", "y"])


def f6_repeat_curves(spark, sf):
    p = curves.resample(fx.poly_points(spark, sf), 8).withColumnRenamed("k", "seq")
    return curves.repeat_curves(p, 300.0, 200.0, 25.0, _ROT).groupBy("poly_id", "copy").agg(F.count("*").alias("n"), F.expr(f"{R('min(x)', 4)}").alias("min_x"), F.expr(f"{R('max(y)', 4)}").alias("max_y"))


def f7_normalize_motif(spark, sf):
    return _r(curves.normalize_motif(fx.poly_points(spark, sf), "50e0"), ["poly_id", "seq"], ["x", "y"])


_MOTIF = "SELECT p_partkey AS motif_id, 3e0 + p_partkey % 40 AS tile_x, 0e0 + p_size % 7 AS tile_y, 0e0 - p_size % 5 AS stack_x, 0e0 + p_partkey % 23 AS stack_y, 150e0 + p_size AS center_x, 100e0 AS center_y, 5e0 + p_size / 4e0 AS footprint, 300e0 AS out_w, 200e0 AS out_h FROM {}"


def f8_motif_counts(spark, sf):
    cfg = spark.sql(_MOTIF.format("{part}"), part=spark.read.parquet(f"{sf}/part.parquet"))
    return curves.motif_counts(cfg).select("motif_id", "tiles", "stacks")


_CHAIN = ["poly_id", "CAST(2 + poly_id % 3 AS INT) AS tiles", "CAST(1 + poly_id % 4 AS INT) AS stacks", "2e0 AS stack_x", "9e0 AS stack_y", "15e-1 AS stagger", "150e0 AS center_x", "100e0 AS center_y", "CASE poly_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'flip' ELSE 'rotate' END AS alternate"]


def f9_chain_motif(spark, sf):
    p = fx.poly_points(spark, sf)
    c = curves.chain_motif(p, p.select("poly_id").distinct().selectExpr(*_CHAIN))
    return c.select("poly_id", "stack", "tile", "seq", *[F.expr(R(v, 4)).alias(v) for v in "xy"])


def f20_node_types(spark, sf):
    return curves.node_types(fx.poly_points(spark, sf))


def f21_curve_geometry(spark, sf):
    """Every stage in turn; counts by outline are stable, coordinates are tested stage by stage."""
    paths = fx.path_strings(spark, sf)
    # every image has a path of its own, by its number; every third path is open
    last = paths.agg(F.max("path_id")).first()[0]
    images = fx.images(spark, sf).selectExpr("image_id", f"3 * (pmod(image_id, {last // 3}) + 1) AS path_id", "8 AS src_w", "8 AS src_h")
    path = curves.path_segments(paths.join(images.select("path_id").distinct(), "path_id", "left_semi"))
    p = fx.pixels(spark, sf).join(images.select("image_id"), "image_id", "left_semi")
    return curves.curve_geometry(p, images, path, 4.0, 120.0, 80.0, samples=16)


def f10_curve_width(spark, sf):
    t = sq._tones(spark, sf)
    return _r(curves.curve_width(t, "1e-1", "5e0", "10e0", "120e0", "90e0", "11e-1"), ["image_id", "x", "y", "channel"], ["width"])


def f11_split_active(spark, sf):
    return _r(curves.split_active(fx.poly_points(spark, sf)), ["poly_id", "run", "seq"], ["x", "y", "width"])


def _clipped(spark, sf):
    return curves.clip_polylines(fx.poly_points(spark, sf), 400.0, 30.0, 2.0)


def f12_clip_polylines(spark, sf):
    return _r(_clipped(spark, sf), ["poly_id", "run", "seq"], ["x0", "y0", "w0", "x1", "y1", "w1"])


def f13_simplify(spark, sf):
    """Douglas-Peucker; recursive, so it has no SQL here and is tested against a direct version."""
    return curves.simplify(fx.poly_points(spark, sf), 0.75)


def f14_offset_rails(spark, sf):
    return _r(curves.offset_rails(fx.poly_points(spark, sf)), ["poly_id", "seq"], ["lx", "ly", "rx", "ry"])


def f15_smooth_boundary(spark, sf):
    return _r(curves.smooth_boundary(fx.poly_points(spark, sf)), ["poly_id", "seq"], ["c1x", "c1y", "c2x", "c2y", "ex", "ey"])


def f16_outline(spark, sf):
    """Outlines as command rows; tested for closure and against a direct version."""
    return curves.outline(fx.poly_points(spark, sf))


def f17_outline_text(spark, sf):
    return curves.outline_text(curves.outline(fx.poly_points(spark, sf)))


def f18_smooth_seam(spark, sf):
    return _r(curves.smooth_seam(_segments(spark, sf)), ["path_id", "seg"], ["c2x", "c2y"])


def _nodes(spark, sf):
    w = "OVER (PARTITION BY path_id ORDER BY seg)"
    s = _segments(spark, sf).selectExpr("path_id", "seg", f"lag(c2x) {w} - x0 AS ix", f"lag(c2y) {w} - y0 AS iy", "c1x - x0 AS ox", "c1y - y0 AS oy")
    return curves.classify_nodes(s.filter("seg > 1"))


def f19_classify_nodes(spark, sf):
    return _nodes(spark, sf).groupBy("path_id", "seg").agg(F.max("kind").alias("kind"))


def f22_transform_paths(spark, sf):
    s = curves.transform_paths(_segments(spark, sf), "2e0", "5e-1", "-5e-1", "2e0", "10e0", "-3e0")
    return curves.segment_text(s)


def f23_path_bounds(spark, sf):
    return _r(curves.path_bounds(_segments(spark, sf)), ["path_id"], ["min_x", "max_x", "min_y", "max_y"])


def f24_constrain_handles(spark, sf):
    n = _nodes(spark, sf).withColumn("kind", F.expr("CASE path_id % 3 WHEN 0 THEN 'smooth' WHEN 1 THEN 'symmetrical' ELSE 'free' END"))
    return _r(curves.constrain_handles(n), ["path_id", "seg", "kind"], ["nix", "niy", "nox", "noy"])


def f25_connect_endpoints(spark, sf):
    return _r(curves.connect_endpoints(_segments(spark, sf), "path_id % 2 = 0"), ["path_id", "seg"], SEG)


def b5_validate_polygons(spark, sf):
    return _r(curves.validate_polygons(fx.poly_points(spark, sf)), ["poly_id", "n", "ok"], ["area2"])


def b6_validate_paths(spark, sf):
    return curves.validate_paths(_segments(spark, sf), 1, 4)


_BACK = "SELECT image_id, 7 - x AS x, y, r AS br, g AS bg, b AS bb, a AS ba FROM {}"


def g1_over(spark, sf):
    p = fx.pixels(spark, sf)
    b = p.selectExpr("image_id", "7 - x AS x", "y", "r AS br", "g AS bg", "b AS bb", "a AS ba")
    d = raster.over(p.withColumnsRenamed({i: f"f{i}" for i in "rgba"}).join(b, ["image_id", "x", "y"]), "f", "b", "")
    return d.select("image_id", "x", "y", "r", "g", "b", "a")


_LOOK = ["image_id % 256 AS sr", "40 AS sg", "image_id % 7 * 30 AS sb", "image_id % 3 * 127 AS sa", "200 AS er", "image_id % 200 AS eg", "0 AS eb", "64 + image_id % 190 AS ea", "image_id % 2 = 0 AS has_background"]


def _look(spark, sf):
    return fx.images(spark, sf).selectExpr("image_id", *_LOOK)


def g2_composite_preview(spark, sf):
    return raster.composite_preview(fx.pixels(spark, sf).withColumns({"x": F.col("x") * 5, "y": F.col("y") * 5}), _look(spark, sf))


def g3_composite_background(spark, sf):
    return raster.composite_background(fx.pixels(spark, sf), _look(spark, sf))


def _coverage(spark, sf):
    m = marks.native_marks(fx.pixels(spark, sf), sq._dims(spark, sf))
    return raster.rasterize(m, 8, 8, 1)


def g4_rasterize(spark, sf):
    return _coverage(spark, sf)


def g6_render_documents(spark, sf):
    """Both output modes end to end; single steps have SQL of their own."""
    docs = sq._dims(spark, sf).withColumns({"treatment": F.lit("dots"), "output_mode": F.expr("CASE WHEN image_id % 2 = 0 THEN 'cmyk' ELSE 'rgb' END")})
    return raster.render_documents(docs, fx.pixels(spark, sf), marks.layers(fx.channels(spark)), 8, 8)


def g5_blend_layers(spark, sf):
    return raster.blend_layers(_coverage(spark, sf), marks.layers(fx.channels(spark)))


_PAIRS = [("(-dx)", "(x - -2e0)"), ("dx", "(402e0 - x)"), ("(-dy)", "(y - -2e0)"), ("dy", "(32e0 - y)")]
_T0 = "greatest(0e0, " + ", ".join(f"CASE WHEN {a} < -1e-6 THEN {q} / {a} ELSE 0e0 END" for a, q in _PAIRS) + ")"
_T1 = "least(1e0, " + ", ".join(f"CASE WHEN {a} > 1e-6 THEN {q} / {a} ELSE 1e0 END" for a, q in _PAIRS) + ")"
_OUT = " OR ".join(f"(abs({a}) <= 1e-6 AND {q} < 0)" for a, q in _PAIRS)
_TAN = f"SELECT *, coalesce(lead(x) {W}, x) - coalesce(lag(x) {W}, x) AS tx, coalesce(lead(y) {W}, y) - coalesce(lag(y) {W}, y) AS ty FROM "
_UNIT = f"SELECT *, CASE WHEN {L('tx', 'ty')} <= 1e-9 THEN 1e0 ELSE tx / {L('tx', 'ty')} END AS ux, CASE WHEN {L('tx', 'ty')} <= 1e-9 THEN 0e0 ELSE ty / {L('tx', 'ty')} END AS uy FROM "
RESAMPLED = lambda n: {
    "rs0": f"SELECT *, lag(x) {W} AS px, lag(y) {W} AS py FROM poly_points",
    "rs1": f"SELECT *, coalesce({L('x - px', 'y - py')}, 0e0) AS step FROM rs0",
    "rs2": "SELECT *, sum(step) OVER (PARTITION BY poly_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM rs1",
    "rt": f"SELECT poly_id, total, k, CASE WHEN k = {n - 1} THEN total ELSE total * k / {n - 1}e0 END AS target FROM (SELECT poly_id, max(cum) AS total FROM rs2 GROUP BY 1), (SELECT unnest(range({n})) AS k)",
    "rs3": f"SELECT *, coalesce(lag(cum) {W}, 0e0) AS lo FROM rs2",
    "rs": "SELECT rt.poly_id, k, px + (x - px) * ((target - lo) / greatest(step, 1e-12)) AS x, py + (y - py) * ((target - lo) / greatest(step, 1e-12)) AS y FROM rt JOIN rs3 ON rt.poly_id = rs3.poly_id AND px IS NOT NULL AND ((target > lo AND target <= cum) OR (target = 0 AND seq = 2))",
}
_ROW = "abs(300e0 * cos(radians({0}))) + abs(200e0 * sin(radians({0})))".format(_ROT)
_s, _k, _sy = f"sin(radians({_ROT}))", f"cos(radians({_ROT}))", "(y + copy * 25e0)"
_flat = f"abs({_ROT}) <= 1e-4"
_RADIUS = 17
_NW = "OVER (PARTITION BY path_id ORDER BY seg)"
_NODES = SEGMENTS | {"nd": f"SELECT path_id, seg, lag(c2x) {_NW} - x0 AS ix, lag(c2y) {_NW} - y0 AS iy, c1x - x0 AS ox, c1y - y0 AS oy FROM seg"}
_li, _lo = L("ix", "iy"), L("ox", "oy")
_line = f"abs(ix * oy - iy * ox) <= 1e-4 * {_li} * {_lo} AND ix * ox + iy * oy < 0"
_NT = lambda c: X.number_text(c)
_AFF = ", ".join(f"2e0 * {x} + -5e-1 * {y} + 10e0 AS {x}, 5e-1 * {x} + 2e0 * {y} + -3e0 AS {y}" for x, y in (("x0", "y0"), ("c1x", "c1y"), ("c2x", "c2y"), ("x1", "y1")))
_SPACED = ", ' ', "
_OV = lambda f, b: ", ".join(f"{v} AS {k}" for k, v in raster.over_formulas(f, b, "//").items())
_STEP1 = ", ".join(f"{v} AS one_{k}" for k, v in raster.over_formulas("s", "k", "//").items())
_STEP2 = ", ".join(f"{v} AS two_{k}" for k, v in raster.over_formulas("e", "one_", "//").items())
_det = "(tile_x * stack_y - tile_y * stack_x)"
_mc = [(w, h) for w in ("0e0", "out_w") for h in ("0e0", "out_h")]
_te = "greatest(0e0, " + ", ".join(f"abs((({w} - center_x) * stack_y - ({h} - center_y) * stack_x) / {_det})" for w, h in _mc) + ")"
_se = "greatest(0e0, " + ", ".join(f"abs((tile_x * ({h} - center_y) - tile_y * ({w} - center_x)) / {_det})" for w, h in _mc) + ")"
_ts, _ss = L("tile_x", "tile_y"), L("stack_x", "stack_y")
_deg = f"{_ts} < 1e0 OR {_ss} < 1e0 OR abs({_det}) <= {_ts} * {_ss} * 1e-6"
COVER = sq.NATIVE | {
    "bx": "SELECT * FROM nm",
    "cv": "SELECT image_id, channel, col, \"row\", px, py, 1e0 AS coverage FROM bx, (SELECT CAST(unnest(range(8)) AS INT) AS px), (SELECT CAST(unnest(range(8)) AS INT) AS py) WHERE " + raster.covers("(px + 5e-1)", "(py + 5e-1)"),
}

SQL = {
    "f1_path_segments": fx.with_sql("path_strings", f"SELECT path_id, seg, {_sr(SEG)} FROM seg", **SEGMENTS),
    "f2_flatten": fx.with_sql(
        "path_strings",
        f"SELECT path_id, seg, k, {R(curves._cubic('x', 't'))} AS x, {R(curves._cubic('y', 't'))} AS y FROM fl WHERE k > 0 OR seg = 1",
        **SEGMENTS,
        fl="SELECT seg.*, CAST(k AS INT) AS k, CAST(k AS DOUBLE) / 24 AS t FROM seg, (SELECT unnest(range(25)) AS k)",
    ),
    "f3_resample": fx.with_sql("poly_points", f"SELECT poly_id, CAST(k AS INT) AS k, {_sr(['x', 'y'])} FROM rs", **RESAMPLED(16)),
    "f4_length_bounds": fx.with_sql(
        "poly_points",
        f"SELECT poly_id, {R('sum(step)')} AS length, {R('min(x)')} AS min_x, {R('max(x)')} AS max_x, {R('min(y)')} AS min_y, {R('max(y)')} AS max_y FROM rs1 GROUP BY 1",
        rs0=RESAMPLED(2)["rs0"],
        rs1=RESAMPLED(2)["rs1"],
    ),
    "f5_fit_baseline": fx.with_sql(
        "poly_points",
        f"SELECT poly_id, seq, {R('x - min(x) OVER w + (300e0 - (max(x) OVER w - min(x) OVER w)) / 2e0 + 5e0')} AS x, {R('y - min(y) OVER w + (200e0 - (max(y) OVER w - min(y) OVER w)) / 2e0 + -7e0')} AS y FROM sc WINDOW w AS (PARTITION BY poly_id)",
        en=f"SELECT *, first_value(x) {ALL} AS fx, first_value(y) {ALL} AS fy, last_value(x) {ALL} AS lx, last_value(y) {ALL} AS ly FROM poly_points",
        sc=f"SELECT poly_id, seq, (x - fx) * (({_ROW}) / greatest({L('lx - fx', 'ly - fy')}, 1e-9)) AS x, (y - fy) * (({_ROW}) / greatest({L('lx - fx', 'ly - fy')}, 1e-9)) AS y FROM en",
    ),
    "f6_repeat_curves": fx.with_sql(
        "poly_points",
        f"SELECT poly_id, copy, count(*) AS n, {R('min(nx)', 4)} AS min_x, {R('max(ny)', 4)} AS max_y FROM cp GROUP BY 1, 2 HAVING max(nx) >= -50 AND min(nx) <= 350 AND max(ny) >= -50 AND min(ny) <= 250",
        **RESAMPLED(8),
        c0=f"SELECT rs.*, CAST(copy AS INT) AS copy FROM rs, (SELECT unnest(range(-{_RADIUS}, {_RADIUS + 1})) AS copy)",
        cp=f"SELECT poly_id, copy, k, CASE WHEN {_flat} THEN x ELSE 150e0 + (x - 150e0) * {_k} - ({_sy} - 100e0) * {_s} END AS nx, CASE WHEN {_flat} THEN {_sy} ELSE 100e0 + (x - 150e0) * {_s} + ({_sy} - 100e0) * {_k} END AS ny FROM c0",
    ),
    "f7_normalize_motif": fx.with_sql(
        "poly_points",
        f"SELECT poly_id, seq, {R('(x - (x0 + (x1 - x0) / 2e0)) * (50e0 / greatest(x1 - x0, y1 - y0, 1e-4))')} AS x, {R('(y - (y0 + (y1 - y0) / 2e0)) * (50e0 / greatest(x1 - x0, y1 - y0, 1e-4))')} AS y FROM poly_points JOIN bb USING (poly_id)",
        bb="SELECT poly_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM poly_points GROUP BY 1",
    ),
    "f8_motif_counts": f"WITH m AS ({_MOTIF.format('part')}) SELECT motif_id, CASE WHEN {_deg} THEN 1 ELSE CAST(least(10000, greatest(1, ceil(greatest({_te} + footprint * {_ss} / abs({_det}), 0e0) * 2e0 + 1e0))) AS INT) END AS tiles, CASE WHEN {_deg} THEN 1 ELSE CAST(least(10000, greatest(1, ceil(greatest({_se} + footprint * {_ts} / abs({_det}), 0e0) * 2e0 + 1e0))) AS INT) END AS stacks FROM m",
    "f9_chain_motif": fx.with_sql(
        "poly_points",
        "SELECT g.poly_id, stack, tile, CAST(tile * n + CASE WHEN back THEN n + 1 - seq ELSE seq END AS BIGINT) AS seq, "
        + ", ".join(R(f"o{v} + f{v} * p.{v} - f{v} * (CASE WHEN back THEN e{v} ELSE s{v} END)", 4) + f" AS {v}" for v in "xy")
        + " FROM g JOIN pp p ON p.poly_id = g.poly_id WHERE tile = 0 OR (CASE WHEN back THEN n + 1 - seq ELSE seq END) > 1",
        pp="SELECT * FROM poly_points",
        en="SELECT poly_id, arg_min(x, seq) AS sx, arg_min(y, seq) AS sy, arg_max(x, seq) AS ex, arg_max(y, seq) AS ey, count(*) AS n FROM pp GROUP BY 1",
        cf=f"SELECT {', '.join(_CHAIN)} FROM (SELECT DISTINCT poly_id FROM pp)",
        ti=f"SELECT *, ex - sx AS ax, ey - sy AS ay, {L('ex - sx', 'ey - sy')} AS al FROM cf JOIN en USING (poly_id), (SELECT CAST(unnest(range(5)) AS INT) AS stack), (SELECT CAST(unnest(range(5)) AS INT) AS tile) WHERE stack < stacks AND tile < tiles",
        fl="SELECT *, CASE WHEN (tile + stack) % 2 = 1 AND alternate <> 'none' THEN -1e0 ELSE 1e0 END AS fx, CASE WHEN (tile + stack) % 2 = 1 AND alternate = 'rotate' THEN -1e0 ELSE 1e0 END AS fy FROM ti",
        bk="SELECT *, fx * ax * ax + fy * ay * ay < 0 AS back FROM fl",
        vv="SELECT *, CASE WHEN back THEN -fx * ax ELSE fx * ax END AS vx, CASE WHEN back THEN -fy * ay ELSE fy * ay END AS vy FROM bk",
        g="SELECT *, "
        + ", ".join(
            f"center_{v} + (stack - (stacks - 1) / 2e0) * stack_{v} + (CASE WHEN al <= 1e-9 THEN {1 if v == 'x' else 0}e0 ELSE a{v} / al END) * CASE WHEN stack % 2 = 1 THEN stagger ELSE 0e0 END - (tiles - 1) / 2e0 * a{v} + coalesce(sum(v{v}) OVER (PARTITION BY poly_id, stack ORDER BY tile ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS o{v}"
            for v in "xy"
        )
        + " FROM vv",
    ),
    "f20_node_types": fx.with_sql(
        "poly_points",
        "SELECT poly_id, concat('c', repeat('s', n - 2), 'c', CASE WHEN e0 THEN '' ELSE 'c' END, repeat('s', n - 2), CASE WHEN s0 THEN 's' ELSE 'c' END) AS types FROM q WHERE n >= 2",
        q="SELECT poly_id, count(*) AS n, arg_min(width, seq) <= 1e-3 AS s0, arg_max(width, seq) <= 1e-3 AS e0 FROM poly_points GROUP BY 1",
    ),
    "f10_curve_width": fx.with_sql(
        "pixels", f"SELECT image_id, x, y, channel, {R('CASE WHEN v <= 0 THEN 0e0 ELSE 5e0 * (1e-1 + (12e-1 * 90e0 / 100e0 - 1e-1) * v) * 11e-1 END')} AS width FROM q", **sq.TONES, q=f"SELECT image_id, x, y, channel, {X.threshold('value', '1e-1')} AS v FROM tones"
    ),
    "f11_split_active": fx.with_sql(
        "poly_points",
        f"SELECT poly_id, CAST(run AS BIGINT) AS run, seq, {_sr(['x', 'y', 'width'])} FROM ex",
        fl=f"SELECT *, width > 0 AS act, coalesce(lag(width) {W} > 0, false) AS was, coalesce(lead(width) {W} > 0, false) AS nxt FROM poly_points",
        rn=f"SELECT *, sum(CASE WHEN act AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY poly_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS runs FROM fl",
        ex="SELECT poly_id, runs AS run, seq, x, y, width FROM rn WHERE act OR was UNION ALL SELECT poly_id, runs + 1, seq, x, y, width FROM rn WHERE NOT act AND nxt",
    ),
    "f12_clip_polylines": fx.with_sql(
        "poly_points",
        f"SELECT poly_id, CAST(sum(CASE WHEN abs(px - x0) <= 1e-3 AND abs(py - y0) <= 1e-3 AND abs(pw - w0) <= 1e-3 THEN 0 ELSE 1 END) OVER (PARTITION BY poly_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run, seq, {_sr(['x0', 'y0', 'w0', 'x1', 'y1', 'w1'])} FROM c3",
        c0=f"SELECT *, lead(x) {W} - x AS dx, lead(y) {W} - y AS dy, lead(width) {W} - width AS dw FROM poly_points",
        c1=f"SELECT *, {_T0} AS t0, {_T1} AS t1 FROM c0 WHERE dx IS NOT NULL AND NOT ({_OUT})",
        c2="SELECT poly_id, seq, x + dx * t0 AS x0, y + dy * t0 AS y0, width + dw * t0 AS w0, x + dx * t1 AS x1, y + dy * t1 AS y1, width + dw * t1 AS w1 FROM c1 WHERE t0 <= t1",
        c3=f"SELECT *, lag(x1) {W} AS px, lag(y1) {W} AS py, lag(w1) {W} AS pw FROM c2",
    ),
    "f14_offset_rails": fx.with_sql(
        "poly_points",
        f"SELECT poly_id, seq, {R('x - uy * (width / 2e0)')} AS lx, {R('y + ux * (width / 2e0)')} AS ly, {R('x + uy * (width / 2e0)')} AS rx, {R('y - ux * (width / 2e0)')} AS ry FROM un",
        tn=_TAN + "poly_points",
        un=_UNIT + "tn",
    ),
    "f15_smooth_boundary": fx.with_sql(
        "poly_points",
        f"SELECT poly_id, seq, {R('x + ux * h')} AS c1x, {R('y + uy * h')} AS c1y, {R('ex - vx * h')} AS c2x, {R('ey - vy * h')} AS c2y, {_sr(['ex', 'ey'])} FROM hd",
        tn=_TAN + "poly_points",
        un=_UNIT + "tn",
        nx=f"SELECT *, lead(x) {W} AS ex, lead(y) {W} AS ey, lead(ux) {W} AS vx, lead(uy) {W} AS vy FROM un",
        hd=f"SELECT *, {L('ex - x', 'ey - y')} / 3e0 AS h FROM nx WHERE ex IS NOT NULL",
    ),
    "f18_smooth_seam": fx.with_sql(
        "path_strings",
        f"SELECT path_id, seg, {R('CASE WHEN lst AND hl > 1e-9 THEN x1 - (CASE WHEN fl <= 1e-9 THEN 1e0 ELSE fx / fl END) * hl ELSE c2x END')} AS c2x, {R('CASE WHEN lst AND hl > 1e-9 THEN y1 - (CASE WHEN fl <= 1e-9 THEN 0e0 ELSE fy / fl END) * hl ELSE c2y END')} AS c2y FROM q2",
        **SEGMENTS,
        q1=f"SELECT *, first_value(c1x - x0) {_NW} AS fx, first_value(c1y - y0) {_NW} AS fy, lead(seg) {_NW} IS NULL AS lst FROM seg",
        q2=f"SELECT *, {L('fx', 'fy')} AS fl, {L('c2x - x1', 'c2y - y1')} AS hl FROM q1",
    ),
    "f19_classify_nodes": fx.with_sql(
        "path_strings",
        f"SELECT path_id, seg, CASE WHEN {_li} <= 1e-4 OR {_lo} <= 1e-4 THEN 'vector' WHEN {_line} THEN CASE WHEN abs({_li} - {_lo}) <= 1e-4 * greatest({_li}, {_lo}) THEN 'symmetrical' ELSE 'smooth' END ELSE 'free' END AS kind FROM nd WHERE seg > 1",
        **_NODES,
    ),
    "f22_transform_paths": fx.with_sql(
        "path_strings",
        f"SELECT path_id, string_agg(concat(CASE WHEN seg = 1 THEN concat('M ', {_NT('x0')}, ' ', {_NT('y0')}, ' ') ELSE '' END, 'C ', {_SPACED.join(_NT(c) for c in ('c1x', 'c1y', 'c2x', 'c2y', 'x1', 'y1'))}), ' ' ORDER BY seg) AS d FROM af GROUP BY 1",
        **SEGMENTS,
        af=f"SELECT path_id, seg, {_AFF} FROM seg",
    ),
    "f23_path_bounds": fx.with_sql(
        "path_strings",
        "SELECT path_id, " + ", ".join(f"{R(f'{n}({g}({v}0, c1{v}, c2{v}, {v}1))')} AS {n}_{v}" for v in "xy" for n, g in (("min", "least"), ("max", "greatest"))) + " FROM seg GROUP BY 1",
        **SEGMENTS,
    ),
    "f24_constrain_handles": fx.with_sql(
        "path_strings",
        "SELECT path_id, seg, kind, " + ", ".join(
            R(f"CASE WHEN kind <> 'free' THEN {sign}(CASE WHEN tl <= 1e-9 THEN {1 if v == 'x' else 0}e0 ELSE (o{v} - i{v}) / tl END) * (CASE WHEN kind = 'symmetrical' THEN (li + lo) / 2e0 ELSE l{s} END) ELSE {s}{v} END") + f" AS n{s}{v}" for s, sign in (("i", "-"), ("o", "")) for v in "xy"
        ) + " FROM q",
        **_NODES,
        q=f"SELECT *, CASE path_id % 3 WHEN 0 THEN 'smooth' WHEN 1 THEN 'symmetrical' ELSE 'free' END AS kind, {_li} AS li, {_lo} AS lo, {L('ox - ix', 'oy - iy')} AS tl FROM nd WHERE seg > 1",
    ),
    "f25_connect_endpoints": fx.with_sql(
        "path_strings",
        f"SELECT path_id, seg, {_sr(SEG)} FROM (SELECT path_id, seg, {', '.join(SEG)} FROM seg UNION ALL SELECT path_id, seg + 1, x1 AS x0, y1 AS y0, x1 + (sx - x1) * 1e0 / 3e0 AS c1x, y1 + (sy - y1) * 1e0 / 3e0 AS c1y, x1 + (sx - x1) * 2e0 / 3e0 AS c2x, y1 + (sy - y1) * 2e0 / 3e0 AS c2y, sx AS x1, sy AS y1 FROM en WHERE lst AND path_id % 2 = 0 AND {L('x1 - sx', 'y1 - sy')} > 1e-3)",
        **SEGMENTS,
        en=f"SELECT *, first_value(x0) {_NW} AS sx, first_value(y0) {_NW} AS sy, lead(seg) {_NW} IS NULL AS lst FROM seg",
    ),
    "b5_validate_polygons": fx.with_sql(
        "poly_points",
        f"SELECT poly_id, count(*) AS n, count(*) >= 3 AND abs(sum(cr)) > 1e-9 AS ok, {R('sum(cr)')} AS area2 FROM q GROUP BY 1",
        q=f"SELECT poly_id, x * coalesce(lead(y) {W}, first_value(y) {ALL}) - coalesce(lead(x) {W}, first_value(x) {ALL}) * y AS cr FROM poly_points",
    ),
    "b6_validate_paths": fx.with_sql("path_strings", f"SELECT path_id, count(*) AS n, count(*) BETWEEN 1 AND 4 AND NOT bool_or({' OR '.join(f'{c} IS NULL' for c in SEG)}) AS ok FROM seg GROUP BY 1", **SEGMENTS),
    "g1_over": f"WITH pixels AS MATERIALIZED ({fx.SQL['pixels']}), q AS MATERIALIZED (SELECT p.image_id, p.x, p.y, p.r AS fr, p.g AS fg, p.b AS fb, p.a AS fa, q.r AS br, q.g AS bg, q.b AS bb, q.a AS ba FROM pixels p JOIN pixels q ON p.image_id = q.image_id AND q.x = 7 - p.x AND p.y = q.y) SELECT image_id, x, y, {_OV('f', 'b')} FROM q",
    "g2_composite_preview": fx.with_sql(
        "pixels images",
        f"SELECT image_id, x, y, {_OV('art_', 'two_')} FROM q2",
        lk=f"SELECT image_id, {', '.join(_LOOK)} FROM images",
        q0="SELECT image_id, x * 5 AS x, y * 5 AS y, r AS art_r, g AS art_g, b AS art_b, a AS art_a, lk.* EXCLUDE (image_id), CASE WHEN (x * 5 // 12 + y * 5 // 12) % 2 = 0 THEN 232 ELSE 196 END AS kr, kr AS kg, kr AS kb, 255 AS ka FROM pixels JOIN lk USING (image_id)",
        q1=f"SELECT *, {_STEP1} FROM q0",
        q2=f"SELECT *, {_STEP2} FROM q1",
    ),
    "g3_composite_background": fx.with_sql(
        "pixels images",
        "SELECT image_id, x, y, " + ", ".join(f"CASE WHEN has_background THEN {v} ELSE art_{k} END AS {k}" for k, v in raster.over_formulas("art_", "e", "//").items()) + " FROM q0",
        lk=f"SELECT image_id, {', '.join(_LOOK)} FROM images",
        q0="SELECT image_id, x, y, r AS art_r, g AS art_g, b AS art_b, a AS art_a, lk.* EXCLUDE (image_id) FROM pixels JOIN lk USING (image_id)",
    ),
    "g4_rasterize": fx.with_sql("pixels", "SELECT * FROM cv", **COVER),
    "g5_blend_layers": fx.with_sql(
        "pixels channels",
        "SELECT image_id, px, py, " + ", ".join(f"{X.byte(f'product(1e0 - al + al * {c} / 255e0) * 255e0')} AS {i}" for i, c in (("r", "red"), ("g", "green"), ("b", "blue"))) + " FROM q GROUP BY 1, 2, 3",
        **COVER,
        q="SELECT cv.*, floor(opacity * 255e0 + 5e-1) / 255e0 * coverage AS al, CAST(('0x' || substr(color, 2, 2)) AS INT) AS red, CAST(('0x' || substr(color, 4, 2)) AS INT) AS green, CAST(('0x' || substr(color, 6, 2)) AS INT) AS blue FROM cv JOIN channels USING (channel) WHERE enabled",
    ),
}
QUERIES = {name: globals()[name] for name in SQL} | {f.__name__: f for f in (f13_simplify, f16_outline, f17_outline_text, f21_curve_geometry, g6_render_documents)}
