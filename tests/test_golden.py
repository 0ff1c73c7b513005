"""Golden values and invariants of single operators."""

import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from screentone.operators import colour, curves, grid, marks, raster, settings
from screentone.sources import artwork

PIXEL = "image_id int, x int, y int, r int, g int, b int, a int"


def px(spark, *rows):
    return spark.createDataFrame([(0, i, 0, *r) for i, r in enumerate(rows)], PIXEL)


def test_cmyk(spark):
    r = colour.to_cmyk(px(spark, (0, 0, 0, 255), (255, 0, 0, 255), (128, 128, 128, 255), (9, 9, 9, 0), (0, 0, 0, 1))).orderBy("x").collect()
    got = [[x[f"ink_{i}"] for i in "cmyk"] for x in r]
    assert got[0] == [0, 0, 0, 1] and got[1] == [0, 1, 1, 0] and got[2] == pytest.approx([0, 0, 0, 127 / 255]) and got[3] == [0] * 4 and got[4] == [0, 0, 0, 1]


def test_rgb_luminance_single(spark):
    assert colour.to_rgb_screen(px(spark, (255, 0, 0, 128))).first()["v_r"] == pytest.approx(128 / 255)
    gray = px(spark, (192, 192, 192, 255))
    assert [colour.to_luminance(gray).first()[f"ink_{i}"] for i in "cmyk"] == pytest.approx([63 / 255] * 4)
    assert [colour.to_single_channel(gray, "m").first()[f"ink_{i}"] for i in "cmyk"] == pytest.approx([0, 63 / 255, 0, 0])


def test_crosshatch_adds_up(spark):
    p = px(spark, (0, 0, 0, 255), (200, 30, 90, 255), (10, 200, 90, 255))
    ink = lambda on: spark.createDataFrame([(c, c in on) for c in "cmyk"], "channel string, enabled boolean")
    assert {r["channel"]: r["value"] for r in colour.to_crosshatch_tones(p, ink("cmyk")).filter("x = 0").collect()} == dict.fromkeys("cmyk", 0.25)
    assert {r["channel"]: r["value"] for r in colour.to_crosshatch_tones(p, ink("ck")).filter("x = 0").collect()} == {"c": 0.5, "k": 0.5}
    sums = colour.to_crosshatch_tones(p, ink("cmk")).groupBy("x").agg(F.sum("value").alias("s")).collect()
    want = {r["x"]: r["ink_c"] for r in colour.to_luminance(p).collect()}
    assert all(r["s"] == pytest.approx(want[r["x"]], abs=1e-9) for r in sums)


def test_grid_sizes(spark):
    d = spark.createDataFrame([(0, 900.0, 620.0, 92.0)], "image_id int, out_w double, out_h double, cells double")
    assert grid.calculate_grid(d).select("cols", "rows").first() == (92, 63)
    two = spark.createDataFrame([("c", 2.0)], "channel string, resolution_scale double")
    assert grid.channel_grid(d, two).select("cols", "rows").first() == (184, 127)


def test_threshold(spark):
    d = spark.createDataFrame([(0.49, 0.5), (0.75, 0.5), (1.0, 0.999)], "value double, threshold double")
    assert sorted(r["value"] for r in colour.apply_threshold(d).collect()) == pytest.approx([0.5, 1.0])


def test_resample_alpha_edge_and_constant(spark):
    t = spark.createDataFrame([(0, 2, 1, 1, 1)], "image_id int, src_w int, src_h int, cols int, rows int")
    assert grid.resample(px(spark, (0, 0, 0, 0), (255, 255, 255, 255)), t).select("r", "g", "b", "a").first() == (255, 255, 255, 128)
    rows = [(0, x, y, 80, 90, 100, 255) for x in range(9) for y in range(7)]
    t = spark.createDataFrame([(0, 9, 7, 4, 3)], "image_id int, src_w int, src_h int, cols int, rows int")
    d = spark.createDataFrame(rows, PIXEL)
    assert {tuple(r) for r in grid.resample(d, t).select("r", "g", "b", "a").collect()} == {(80, 90, 100, 255)}
    dims = spark.createDataFrame([(0, 9, 7)], "image_id int, src_w int, src_h int")
    small = grid.downscale(d, dims, 5)
    assert small.count() == 5 * 4 and {tuple(r) for r in small.select("r", "g", "b", "a").collect()} == {(80, 90, 100, 255)}
    assert grid.downscale(d, dims, 9).count() == 63


CH = "channel string, grid_rotation double, offset_x double, offset_y double, pivot_x double, pivot_y double, resolution_scale double, max_size double, scale double, width_scale double, height_scale double"


@pytest.mark.parametrize("turn, off, pivot, want", [(0.0, 0.0, 0.0, (25, 25)), (0.0, 60.0, 0.0, (35, 25)), (90.0, 0.0, 0.0, (75, 25)), (90.0, 0.0, 10.0, (85, 15))])
def test_lattice_positions(spark, turn, off, pivot, want):
    d = spark.createDataFrame([(0, 100.0, 100.0, 2.0)], "image_id int, out_w double, out_h double, cells double")
    c = spark.createDataFrame([("k", turn, off, 0.0, pivot, 0.0, 1.0, 100.0, 1.0, 1.0, 1.0)], CH)
    p = grid.place_lattice(grid.lattice(grid.lattice_ranges(grid.channel_grid(d, c), grid.reach("100e0", "100e0", "100e0", grid.CIRCLE))))
    r = p.filter("col = 0 AND row = 0").select("x", "y").first()
    assert tuple(r) == pytest.approx(want)


def test_offsets_repeat_by_a_cell(spark):
    d = spark.createDataFrame([(0, 100.0, 80.0, 5.0)], "image_id int, out_w double, out_h double, cells double")
    got = []
    for off in (3.0, 23.0, -17.0):
        c = spark.createDataFrame([("k", 0.0, off, 0.0, 0.0, 0.0, 1.0, 100.0, 1.0, 1.0, 1.0)], CH)
        p = grid.place_lattice(grid.lattice(grid.lattice_ranges(grid.channel_grid(d, c), "0e0")))
        got.append(sorted((round(r["x"], 6), round(r["y"], 6)) for r in p.collect()))
    assert got[0] == got[1] == got[2]


def test_marks_of_black(spark):
    black = spark.createDataFrame([(0, x, y, 0, 0, 0, 255) for x in range(8) for y in range(4)], PIXEL)
    d = spark.createDataFrame([(0, 8, 4, 100.0, 50.0, 4.0)], "image_id int, src_w int, src_h int, out_w double, out_h double, cells double")
    c = spark.createDataFrame([("k", 0.0, 0.0, 0.0, 0.0, 0.0, 2.0, 100.0, 1.0, 1.0, 1.0, 3, 0.0, 0.0, True)], CH + ", ord int, rotation double, threshold double, enabled boolean")
    assert marks.shape_marks(black, d, c, "100e0", "100e0", "100e0").count() == 32


def test_compositing(spark):
    look = spark.createDataFrame([(0, 20, 40, 60, 128, 10, 20, 30, 255, True)], "image_id int, sr int, sg int, sb int, sa int, er int, eg int, eb int, ea int, has_background boolean")
    assert raster.composite_preview(px(spark, (200, 100, 0, 128)), look).select("r", "g", "b", "a").first() == (105, 60, 15, 255)
    clear = look.withColumns({"sa": F.lit(0), "ea": F.lit(0)})
    assert raster.composite_preview(px(spark, (0, 0, 0, 0)), clear).select("r", "g", "b", "a").first() == (232, 232, 232, 255)


def test_supersampled_coverage(spark):
    m = spark.createDataFrame([(0, "k", 0, 0, 4.0, 4.0, 3.0)], "image_id int, channel string, col int, row int, x double, y double, extent double")
    assert raster.rasterize(m, 8, 8, 8).agg(F.sum("coverage")).first()[0] == pytest.approx(math.pi * 9, rel=0.02)


def poly(spark, points):
    return spark.createDataFrame([(0, i + 1, *map(float, p)) for i, p in enumerate(points)], "poly_id int, seq long, x double, y double, width double")


def test_arc_length(spark):
    wave = [(i, 8 * math.sin(i / 12), 1) for i in range(100)]
    r = curves.resample(poly(spark, wave), 25).orderBy("k").collect()
    assert (r[0]["x"], r[0]["y"]) == pytest.approx(wave[0][:2]) and (r[-1]["x"], r[-1]["y"]) == pytest.approx(wave[-1][:2])
    gaps = [math.dist((a["x"], a["y"]), (b["x"], b["y"])) for a, b in zip(r, r[1:])]
    assert max(gaps) <= 1.08 * np.mean(gaps) and min(gaps) >= 0.92 * np.mean(gaps)


def simplify_direct(p, tol):
    def far(q, a, b):
        d = b - a
        n = d @ d
        if n <= 1e-6:
            return np.linalg.norm(q - a)
        return np.linalg.norm(q - (a + d * min(1, max(0, (q - a) @ d / n))))

    def run(lo, hi):
        if hi <= lo + 1:
            return []
        k = max(range(lo + 1, hi), key=lambda i: far(p[i], p[lo], p[hi]))
        return run(lo, k) + [k] + run(k, hi) if far(p[k], p[lo], p[hi]) > tol else []

    return [0, *run(0, len(p) - 1), len(p) - 1]


def test_simplify(spark):
    rng = np.random.default_rng(3)
    p = np.cumsum(rng.normal(size=(200, 3)), axis=0)
    got = [r["seq"] - 1 for r in curves.simplify(poly(spark, p), 0.75).orderBy("seq").collect()]
    assert got == simplify_direct(p, 0.75)


def test_outline_is_closed(spark):
    c = curves.outline(poly(spark, [(0, 0, 0), (10, 0, 4), (20, 5, 4), (30, 5, 2)])).orderBy("part", "ord").collect()
    assert [r["op"] for r in c] == ["M"] + ["C"] * 3 + ["C"] + ["C"] * 3 + ["Z"]
    assert (c[-2]["x"], c[-2]["y"]) == pytest.approx((c[0]["x"], c[0]["y"]))
    text = curves.outline_text(curves.outline(poly(spark, [(0, 0, 2), (10, 0, 2)]))).first()["d"]
    assert text.startswith("M 0 1 C ") and text.endswith("Z") and "nan" not in text.lower()


def png(w, h, phys=None):
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    raw = b"".join(b"\0" + bytes([10 * y + x, 20, 30, 255 - x]) * 1 * w for y in range(h) for x in [0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + (chunk(b"pHYs", struct.pack(">IIB", phys, phys, 1)) if phys else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_artwork_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(3, 2, 11811))
    (tmp_path / "b.svg").write_text('<svg width="2in"/>')
    a = artwork.read_artwork(spark, str(tmp_path))
    assert {r["name"]: r["media_type"] for r in a.collect()} == {"a.png": "image/png", "b.svg": "image/svg+xml"}
    r = artwork.probe_physical_size(artwork.probe_dimensions(a)).filter("name = 'a.png'").first()
    assert (r["width"], r["height"]) == (3, 2) and r["dpi"] == pytest.approx(300, abs=0.1)
    p = artwork.image_to_pixels(spark.read.format("image").load(str(tmp_path / "a.png"))).orderBy("y", "x").collect()
    assert len(p) == 6 and (p[0]["r"], p[0]["g"], p[0]["b"], p[0]["a"]) == (0, 20, 30, 255) and p[3]["r"] == 10


def test_editor_import(spark):
    text = '{"document":{"paths":[{"id":"a","closed":true,"nodes":[{"position":{"x":0,"y":0}},{"position":{"x":1,"y":1}}]},{"id":"b","closed":false,"nodes":[{"position":{"x":0,"y":0},"handleOut":{"x":1,"y":2}},{"position":{"x":9,"y":0},"handleIn":{"x":-1,"y":3}}]}]}}'
    r = artwork.import_editor_paths(spark.createDataFrame([(1, text), (2, "{}"), (3, None)], "text_id int, content string")).collect()
    assert len(r) == 1 and tuple(r[0][c] for c in ("x0", "c1x", "c1y", "c2x", "c2y", "x1")) == (0, 1, 2, 8, 3, 9)


def test_editor_nodes_keep_their_constraints(spark):
    node = lambda x, y, i=(0, 0), o=(0, 0), **more: {"position": {"x": x, "y": y}, "handleIn": {"x": i[0], "y": i[1]}, "handleOut": {"x": o[0], "y": o[1]}} | more
    smooth, mirrored, one = node(10, 0, (-3, 4), (2, 0), pairConstraint="smooth"), node(20, 0, (-3, 4), (1, 0), pairConstraint="symmetrical"), node(30, 0, (0, -2), pairConstraint="symmetrical")
    given = [
        {"document": {"paths": [{"closed": False, "nodes": [node(0, 0), smooth, mirrored, one]}]}},
        {"paths": [{"closed": True, "nodes": [node(0, 0), node(1, 1), node(0, 1)]}]},
        {"document": {"paths": [{"nodes": [node(7, 7), node(8, 8)]}, {"closed": False, "nodes": [node(0, 0)]}, {"closed": False, "nodes": [node(0, 0, handleOutBehavior="vector"), node(3, 6, (1, 1), handleInBehavior="vector")]}]}},
        {"document": {"paths": []}},
    ]
    d = artwork.import_editor_paths(spark.createDataFrame([(i, json.dumps(g)) for i, g in enumerate(given)], "text_id int, content string"))
    got = {(r.text_id, r.seg): tuple(r)[2:] for r in d.collect()}
    assert set(got) == {(0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 1)}
    # smooth: lengths 5 and 2 along the outgoing handle; symmetrical: 3 on both sides; with one handle alone its length goes for both
    assert got[0, 1] == (0, 0, 0, 0, 5, 0, 10, 0)
    assert got[0, 2] == (10, 0, 12, 0, 17, 0, 20, 0)
    assert got[0, 3] == (20, 0, 23, 0, 30, -2, 30, 0)
    assert got[1, 3][:2] == (0, 1) and got[1, 3][-2:] == (0, 0)
    assert got[2, 1] == (0, 0, 1, 2, 2, 4, 3, 6)


def test_round_trips(spark, sf_dir, tmp_path):
    from screentone import fixtures as fx

    p = artwork.parse_presets(fx.preset_json(spark, sf_dir)).filter("accepted")
    again = artwork.parse_presets(artwork.preset_json(p))
    cols = ["preset_id", "min_mark", "max_mark", "value_mode", "output_width"]
    assert again.filter("NOT accepted").count() == 0
    assert p.select(cols).exceptAll(again.select(cols)).count() == 0
    d = settings.migrate_documents(artwork.parse_documents(fx.documents_json(spark, sf_dir)).filter("accepted"))
    back = artwork.parse_documents(artwork.document_json(d))
    cols = ["document_id", "version", "name", "payload", "width", "surface", "output_mode"]
    assert d.select(cols).exceptAll(back.select(cols)).count() == 0
    artwork.write_json_texts(artwork.preset_json(p.limit(5)), str(tmp_path / "presets"))
    assert spark.read.text(str(tmp_path / "presets")).count() == 5


def test_sinks(spark, sf_dir, tmp_path):
    from screentone.plans import settings_queries

    t = settings_queries.a11_svg_texts(spark, sf_dir)
    artwork.write_svg(t, str(tmp_path / "svg"))
    assert spark.read.text(str(tmp_path / "svg")).count() == t.count()
    artwork.write_raster(px(spark, (1, 2, 3, 4)).withColumn("channel", F.lit("k")), str(tmp_path / "raster"), True)
    assert spark.read.parquet(str(tmp_path / "raster")).first()["channel"] == "k"
    lines = spark.createDataFrame([(0, 1, "Layer <1>", "#000000", 1.0, "M 0 0 Z")], "image_id int, ord int, label string, color string, opacity double, d string")
    out = artwork.curve_svg_texts(lines, spark.createDataFrame([(0, 10.0, 5.5)], "image_id int, out_w double, out_h double")).first()["svg"]
    assert 'id="Layer &lt;1&gt;"' in out and "nonzero" in out and 'height="5.5"' in out


def test_validation_splits(spark):
    d = spark.createDataFrame([(1, 5.0), (2, None), (3, 99.0), (4, float("nan"))], "id int, v double")
    bad = settings.validate_settings(d, spark.createDataFrame([("v", 0.0, 10.0, "range")], "field string, lo double, hi double, message string"), "id", ["v"])
    good, held = settings.split_by_violations(d, bad, "id")
    assert {r["id"] for r in good.collect()} == {1} and {r["id"] for r in held.collect()} == {2, 3, 4}


def test_sanitize(spark):
    d = spark.createDataFrame([(float("nan"), 500.0, float("inf"), -999.0)], "detail double, coverage double, contrast double, angle double")
    assert tuple(settings.sanitize_settings(d).first()) == (58.0, 160.0, 100.0, -180.0)




def test_render_modes(spark):
    d = "image_id int, width double, height double, detail double, coverage double, contrast double, angle double, treatment string, output_mode string"
    docs = spark.createDataFrame([(0, 8.0, 8.0, 0.0, 160.0, 100.0, 0.0, "dots", "cmyk"), (1, 8.0, 8.0, 0.0, 160.0, 100.0, 0.0, "dots", "rgb"), (2, 8.0, 8.0, 0.0, 160.0, 100.0, 0.0, "dots", "cmyk")], d)
    p = spark.createDataFrame([(i, x, y, v, v, v, 255) for i, v in ((0, 0), (1, 255), (2, 255)) for x in range(8) for y in range(8)], PIXEL)
    layers = spark.createDataFrame([("k", 0, True, 20, 20, 24, 1.0)], "channel string, ord int, enabled boolean, red int, green int, blue int, opacity double")
    r = raster.render_documents(docs, p, layers, 8, 8).groupBy("image_id").agg(F.min("r").alias("lo"), F.max("b").alias("hi"), F.count("*").alias("n")).orderBy("image_id").collect()
    assert [x["n"] for x in r] == [64] * 3
    assert r[0]["lo"] < 30 and r[1]["hi"] == 255 and (r[2]["lo"], r[2]["hi"]) == (255, 255)
    with pytest.raises(ValueError):
        raster.render_documents(docs, p, layers, 9000, 9000)


def test_resample_merges_steps_and_targets(spark):
    rng = __import__("random").Random(5)
    given = {i: [(rng.randint(0, 3), rng.randint(0, 3)) for _ in range(n)] for i, n in enumerate([2, 3, 9, 40])} | {7: [(1, 1)], 8: [(2, 5), (2, 5), (2, 5)], 9: [(0, 0), (0, 0), (3, 4), (3, 4)]}
    d = spark.createDataFrame([(i, j + 1, float(x), float(y)) for i, pts in given.items() for j, (x, y) in enumerate(pts)], "poly_id int, seq long, x double, y double")
    out = curves.resample(d, 11)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = {(r.poly_id, r.k): (r.x, r.y) for r in out.collect()}
    assert {i for i, _ in got} == set(given) - {7} and len(got) == 11 * (len(given) - 1)
    for i, pts in given.items():
        ends = [0.0]
        for (ax, ay), (bx, by) in zip(pts, pts[1:]):
            ends.append(ends[-1] + ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5)
        for k in range(11) if len(pts) > 1 else ():
            t = ends[-1] * k / 10 if k < 10 else ends[-1]
            j = next(j for j in range(1, len(pts)) if ends[j] >= t)
            f = (t - ends[j - 1]) / max(ends[j] - ends[j - 1], 1e-12)
            assert got[i, k] == pytest.approx(tuple(a + (b - a) * f for a, b in zip(pts[j - 1], pts[j])))
