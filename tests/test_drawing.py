"""Marks as they are drawn, output channels, sizes and headers, against plain Python."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from screentone.operators import colour, curves, marks, raster, settings
from screentone.sources import artwork
from screentone.streaming import requests

MARK = "image_id int, channel string, col int, row int, x double, y double, extent double, thickness double, angle double, treatment string"


def test_treatments_cover_what_they_should(spark):
    shapes = [("dots", 5.0, 0.0, 0.0), ("squares", 9.0, 0.0, 30.0), ("lines", 12.0, 4.0, -20.0), ("ellipses", 12.0, 6.0, 50.0)]
    m = spark.createDataFrame([(i, "k", 0, 0, 10.0, 11.0, e, t, a, k) for i, (k, e, t, a) in enumerate(shapes)] + [(9, "k", 0, 0, None, 1.0, 3.0, 3.0, 0.0, "lines")], MARK)
    got = {r["image_id"]: r["s"] for r in raster.rasterize(m, 24, 24, 6).groupBy("image_id").agg(F.sum("coverage").alias("s")).collect()}
    assert set(got) == {0, 1, 2, 3}
    for i, area in enumerate((math.pi * 25, 81.0, 48.0, math.pi * 18)):
        assert got[i] == pytest.approx(area, rel=0.02)


def test_each_pixel_of_a_turned_line(spark):
    m = spark.createDataFrame([(0, "k", 0, 0, 8.3, 7.9, 10.0, 3.0, 37.0, "lines")], MARK)
    got = {(r["px"], r["py"]) for r in raster.rasterize(m, 16, 16).collect()}
    c, s = math.cos(math.radians(37)), math.sin(math.radians(37))
    want = set()
    for x in range(16):
        for y in range(16):
            dx, dy = x + 0.5 - 8.3, y + 0.5 - 7.9
            if abs(dx * c + dy * s) <= 5 and abs(dy * c - dx * s) <= 1.5:
                want.add((x, y))
    assert got == want


def test_polygons_by_winding(spark):
    m = spark.createDataFrame([(0, "k", 0, 0, 12.0, 12.0, 16.0, 16.0, 15.0, "squares")], MARK).withColumn("sides", F.lit(6))
    v = marks.mark_vertices(m, marks.unit_shapes(m.select("sides")))
    area = 1.5 * math.sqrt(3) * 64
    assert raster.rasterize_polygons(v, 24, 24, 6).agg(F.sum("coverage")).first()[0] == pytest.approx(area, rel=0.02)
    star = [(2.0, 2.0), (14.0, 2.0), (14.0, 14.0), (2.0, 14.0)]
    both = spark.createDataFrame([(i, "k", 0, 0, j, x, y) for i, order in ((0, star), (1, star[::-1])) for j, (x, y) in enumerate(order)], "image_id int, channel string, col int, row int, vertex int, px double, py double")
    assert {(r["image_id"], r["n"]) for r in raster.rasterize_polygons(both, 16, 16).groupBy("image_id").agg(F.count("*").alias("n")).collect()} == {(0, 144), (1, 144)}
    few = both.filter("vertex < 2")
    assert raster.rasterize_polygons(few, 16, 16).count() == 0


def test_blend_on_a_clear_base(spark):
    cover = spark.createDataFrame([(0, c, 0, 0, 1, 1, v) for c, v in (("c", 1.0), ("k", 0.5), ("red", 1.0), ("blue", 0.25))], "image_id int, channel string, col int, row int, px int, py int, coverage double")
    rows = [("c", 0, True, 0, 174, 239, 1.0, "multiply"), ("k", 1, True, 20, 20, 24, 0.8, "multiply"), ("red", 2, True, 255, 0, 0, 1.0, "screen"), ("blue", 3, False, 0, 0, 255, 1.0, "screen")]
    layers = spark.createDataFrame(rows, "channel string, ord int, enabled boolean, red int, green int, blue int, opacity double, blend string")
    one = raster.blend_on_clear(cover, layers, "k").first()
    assert (one["r"], one["g"], one["b"], one["a"]) == (20, 20, 24, 102)
    got = raster.blend_on_clear(cover, layers).first()
    c, a = [0.0] * 3, 0.0
    for name, _, _, *rgb, op, blend in rows[:3]:
        alpha = op * (0.5 if name == "k" else 1.0)
        s = [alpha * v / 255 for v in rgb]
        c = [x + y - x * y if blend == "screen" else x * (1 - a) + y * (1 - alpha) + x * y for x, y in zip(s, c)]
        a = a + alpha - a * alpha
    assert [got[i] for i in "rgb"] == pytest.approx([255 * v / a for v in c], abs=1) and got["a"] == 255


def test_output_channels_and_layers(spark):
    names = [*"cmyk", "red", "green", "blue"]
    inks = spark.createDataFrame([(c, i, c != "y", 1.0, None) for i, c in enumerate(names)], "channel string, ord int, enabled boolean, opacity double, color string")
    docs = spark.createDataFrame([(0, "cmyk", "rgb"), (1, "rgb", "luminance"), (2, "rgb", "crosshatch"), (3, None, None)], "id int, output_mode string, value_mode string")
    got = {}
    for r in colour.output_channels(docs, inks).collect():
        got.setdefault(r["id"], set()).add(r["channel"])
    assert got == {0: {"red", "green", "blue"}, 1: {"red", "green", "blue"}, 2: set("cmk"), 3: set("cmk")}
    blends = {r["channel"]: (r["blend"], r["red"], r["green"], r["blue"]) for r in marks.layers(inks).collect()}
    assert blends["green"] == ("screen", 0, 255, 0) and blends["k"] == ("multiply", 20, 20, 24)
    assert {(r["red"], r["green"], r["blue"]) for r in marks.layers(inks, "no colour").collect()} == {(17, 17, 17)}


def test_named_shapes(spark):
    s = spark.createDataFrame([("rectangle",), ("triangle",), ("hexagon",), ("blob",)], "shape string")
    got = {}
    for r in marks.named_shapes(s).orderBy("shape", "vertex").collect():
        got.setdefault(r["shape"], []).append((r["ux"], r["uy"]))
    assert got["rectangle"][2] == (0.45, 0.45) and got["triangle"][0] == (0.0, -0.52) and len(got["hexagon"]) == 6 and "blob" not in got
    assert got["hexagon"][0] == pytest.approx((0.5 * math.cos(math.radians(-60)), 0.5 * math.sin(math.radians(-60))))
    c = marks.circle_cubics(spark.createDataFrame([(1,)], "id int")).orderBy("seg").collect()
    assert [(r["x0"], r["y0"]) for r in c] == [(0, -0.5), (0.5, 0), (0, 0.5), (-0.5, 0)]
    assert (c[0]["c1x"], c[0]["c1y"], c[0]["c2x"], c[0]["c2y"]) == pytest.approx((0.276, -0.5, 0.5, -0.276))


def test_physical_size_walks_the_chunks(spark):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + b"\0\0\0\0"
    png, phys = b"\x89PNG\r\n\x1a\n", struct.pack(">IIB", 11811, 11811, 1)
    fake = chunk(b"tEXt", b"....pHYs" + phys)
    jfif = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0\1\2" + b"\2" + struct.pack(">HH", 100, 100) + b"\0\0"
    rows = [(0, png + fake + chunk(b"pHYs", phys)), (1, png + fake + chunk(b"IDAT", b"x") + chunk(b"pHYs", phys)), (2, jfif), (3, None), (4, png), (5, b"\xff\xd8\xff\xe1\0\x0fxxJFIF\0\1\2\1\0\x48")]
    got = {r["id"]: r["dpi"] for r in artwork.probe_physical_size(spark.createDataFrame(rows, "id int, content binary")).collect()}
    assert got == pytest.approx({0: 11811 * 0.0254, 1: 96.0, 2: 254.0, 3: 96.0, 4: 96.0, 5: 96.0})


def test_svg_marks_and_background(spark):
    m = spark.createDataFrame([(0, "k", 0, 0, 5.0, 6.0, 4.0, 2.0, 15.0, "lines"), (0, "k", 1, 0, 9.0, 6.0, 4.0, 0.0, 0.0, "dots")], MARK)
    layers = marks.layers(spark.createDataFrame([("k", 0, "#141418", 1.0, True)], "channel string, ord int, color string, opacity double, enabled boolean"))
    docs = spark.createDataFrame([(0, "t", 10.0, 10.0, "#FFFFFF"), (1, "u", 10.0, 10.0, None)], "image_id int, title string, out_w double, out_h double, background string")
    got = {r["image_id"]: r["svg"] for r in artwork.svg_texts(m, layers, docs).collect()}
    assert '<g id="background"><rect width="10" height="10" fill="#ffffff"/></g>' in got[0] and "background" not in got[1]
    assert '<rect x="3" y="5" width="4" height="2" transform="rotate(15 5 6)"/><circle cx="9" cy="6" r="4"/>' in got[0]


def test_sizes(spark):
    d = spark.createDataFrame([(0, 400, 200, 800, 400), (1, 400, 200, 800, 401), (2, 1, 1, 9000, 9000), (3, 4, 4, 0, 0)], "id int, src_w long, src_h long, req_w long, req_h long")
    assert {r["id"]: r["problem"] for r in settings.check_output_size(d).collect()} == {0: None, 1: "other proportions", 2: "too many pixels", 3: "not positive"}
    assert spark.sql(f"SELECT {settings.pixels_of_inches('85e-1', '300e0')}").first()[0] == 2550
    c = spark.createDataFrame([(100, 90, 100, 50, 80, 80), (100, 50, 100, 50, None, None)], "out_w long, out_h long, src_w long, src_h long, shape_w long, shape_h long")
    got = [(r["lock_w"], r["lock_h"], r["changed"], r["shape_w"], r["shape_h"]) for r in settings.normalize_canvas(c).collect()]
    assert sorted(got, key=repr) == [(100, 50, False, None, None), (100, 50, True, 80, 40)]


def test_migration_rejects_and_clears(spark):
    d = spark.createDataFrame([(1, 4, "a"), (2, 5, "b"), (3, 6, "c"), (4, None, "d")], "document_id int, version int, inactive_rgb string").withColumns({"surface": F.lit(None).cast("string"), "output_mode": F.lit("rgb")})
    assert {(r["document_id"], r["inactive_rgb"], r["output_mode"]) for r in settings.migrate_documents(d).collect()} == {(1, None, "cmyk"), (2, "b", "rgb")}
    assert {r["document_id"]: r["reason"] for r in settings.rejected_documents(d).collect()} == {3: "unsupported version 6", 4: "unsupported version none"}


def test_infinite_paths_fail(spark):
    s = spark.createDataFrame([(i, *([0.0] * 7), v) for i, v in ((0, 1.0), (1, float("inf")), (2, float("nan")))], "path_id int, x0 double, y0 double, c1x double, c1y double, c2x double, c2y double, x1 double, y1 double")
    assert {r["path_id"]: r["ok"] for r in curves.validate_paths(s).collect()} == {0: True, 1: False, 2: False}


def test_stale_views_drop(spark):
    r = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (1, 1, "a"), (2, 5, None)], "document_id int, generation int, view string")
    now = spark.createDataFrame([(1, 2, "a"), (2, 5, None)], "document_id int, generation int, view string")
    assert requests.drop_stale(r, now).count() == 3
    assert {(x["document_id"], x["view"]) for x in requests.drop_stale(r, now, ["view"]).collect()} == {(1, "a"), (2, None)}
