import math
import random

import pytest

from screentone.operators import curve_documents as cd
from screentone.operators import curves

DOC = "image_id int, src_w int, src_h int, out_w double, out_h double, cells double, min_mark double, max_mark double, value_mode string, single_channel string, crosshatch_color string, output_mode string, layout string, shared boolean, shared_path_id int, shared_close_ends boolean, shared_smooth_join boolean"
INK = "image_id int, channel string, enabled boolean, color string, opacity double, threshold double, scale double, max_size double, resolution_scale double, offset_x double, offset_y double, grid_rotation double, pivot_x double, pivot_y double, quality double, path_id int, close_ends boolean, smooth_join boolean, curve_scale double, coverage string, bleed double, tile_count int, tile_angle double, tile_offset double, stack_count int, stack_spacing double, stack_angle double, stack_offset double, stagger double, alternate string"
PIXEL = "image_id int, x int, y int, r int, g int, b int, a int"
#: The soft wave and the motif of the golden cases (fixed values).
WAVE = "M -0.5 0 C -0.32 -0.12 -0.18 -0.12 0 0 C 0.18 0.12 0.32 0.12 0.5 0"
MOTIF = "M -0.5 -0.15 C -0.3 -0.4 0.1 0.3 0.5 0.05"


def doc(i, **k):
    d = dict(image_id=i, src_w=8, src_h=5, out_w=120.0, out_h=80.0, cells=8.0, min_mark=0.0, max_mark=85.0, value_mode="single", single_channel="k", crosshatch_color="#111111", output_mode="cmyk", layout="full", shared=True, shared_path_id=1, shared_close_ends=False, shared_smooth_join=False)
    return tuple((d | k).values())


def ink(i, channel, **k):
    d = dict(image_id=i, channel=channel, enabled=True, color="#141418", opacity=1.0, threshold=0.0, scale=1.0, max_size=100.0, resolution_scale=1.0, offset_x=0.0, offset_y=0.0, grid_rotation=0.0, pivot_x=0.0, pivot_y=0.0, quality=1.0, path_id=1, close_ends=False, smooth_join=False, curve_scale=32.0, coverage="auto", bleed=2.0, tile_count=2, tile_angle=0.0, tile_offset=0.0, stack_count=2, stack_spacing=36.0, stack_angle=0.0, stack_offset=0.0, stagger=0.0, alternate="none")
    return tuple((d | k).values())


def pixels(spark, colours, w=8, h=5):
    return spark.createDataFrame([(i, x, y, *c, 255) for i, c in colours.items() for x in range(w) for y in range(h)], PIXEL)


def paths(spark, *texts):
    return curves.path_segments(spark.createDataFrame(list(enumerate(texts, 1)), "path_id int, d string"))


def test_soft_wave_counts(spark):
    """Golden: the wave over black gives nine outlines; all are closed and finite."""
    docs = spark.createDataFrame([doc(1)], DOC)
    inks = spark.createDataFrame([ink(1, c, enabled=c == "k") for c in "cmyk"], INK)
    got = cd.curve_outlines(pixels(spark, {1: (0, 0, 0)}), docs, inks, paths(spark, WAVE)).collect()
    assert {r.channel for r in got} == {"k"} and len({r.copy for r in got}) == 9
    for c in {(r.copy, r.contour) for r in got}:
        ops = [r.op for r in sorted((r for r in got if (r.copy, r.contour) == c), key=lambda r: (r.part, r.ord))]
        assert ops[0] == "M" and ops[-1] == "Z" and set(ops[1:-1]) == {"C"}
    assert all(math.isfinite(r.x) and math.isfinite(r.y) for r in got)


def test_motif_branch(spark):
    """Motifs cover the artboard whatever is asked for; alternation changes them; a lone manual minimum adds copies."""
    docs = spark.createDataFrame([doc(i, layout="motif") for i in range(1, 6)], DOC)
    more = {1: {}, 2: {"alternate": "flip"}, 3: {"alternate": "rotate"}, 4: {"coverage": "manual", "tile_count": 3, "stack_count": 2}, 5: {"coverage": "manual", "tile_count": 30, "stack_count": 15}}
    inks = spark.createDataFrame([ink(i, "k", curve_scale=20.0, stack_spacing=28.0, **k) for i, k in more.items()], INK)
    p = paths(spark, MOTIF)
    rows = cd.lines(cd.jobs(docs, inks), p).collect()
    line = lambda i: sorted((r.copy, r.seq, round(r.x, 6), round(r.y, 6)) for r in rows if r.job.image_id == i)
    assert line(1) != line(2) and line(1) != line(3) and line(2) != line(3) and line(1) == line(4)
    # radius of the motif, half a full mark, bleed; the lattice's corners are 60 and 40 away from its middle
    seg = [(-0.5, -0.15), (-0.3, -0.4), (0.1, 0.3), (0.5, 0.05)]
    size = 20.0
    radius = max(math.dist((20 * (x + 0.5), 0), (0, 0)) for x, _ in seg)
    assert {r.copy for r in rows if r.job.image_id == 1} == set(range(max(r.copy for r in rows if r.job.image_id == 1) + 1))
    ax, ay = 20.0, 20.0 * 0.2
    det = ax * 28.0
    extent = max(abs((ax * y - ay * x) / det) for x in (-60, 60) for y in (-40, 40))
    far = radius if radius > size else math.hypot(ax, ay)
    stacks = math.ceil((extent + (far + 0.5 * 15 * 0.85 + 2 * 15) * math.hypot(ax, ay) / det) * 2 + 1)
    assert len({r.copy for r in rows if r.job.image_id == 1}) == stacks
    assert len({r.copy for r in rows if r.job.image_id == 5}) == max(15, stacks)
    got = cd.curve_outlines(pixels(spark, {i: (0, 0, 0) for i in range(1, 6)}), docs, inks, p).groupBy("image_id", "copy").count().collect()
    assert all(r["count"] > 6 for r in got) and {r.image_id for r in got} == set(range(1, 6))


def test_inks_of_each_mapping(spark):
    """Crosshatch gives four layers of one colour, RGB output three lights for a neutral mapping; a clear image nothing."""
    docs = spark.createDataFrame([doc(1, value_mode="crosshatch", crosshatch_color="#234567"), doc(2, value_mode="luminance", output_mode="rgb"), doc(3, value_mode="cmyk")], DOC)
    inks = spark.createDataFrame([ink(i, c, color="#ff0000", grid_rotation=r) for i in (1, 2, 3) for c, r in (("c", -45.0), ("m", 0.0), ("y", 90.0), ("k", 45.0), ("red", 15.0), ("green", 75.0), ("blue", 45.0))], INK)
    layers = cd.document_layers(docs, inks).collect()
    assert {(r.channel, r.red, r.green, r.blue) for r in layers if r.image_id == 1} == {(c, 0x23, 0x45, 0x67) for c in "cmyk"}
    assert {r.channel for r in layers if r.image_id == 2} == {"red", "green", "blue"} and {r.blend for r in layers if r.image_id == 2} == {"screen"}
    t = cd.tones(cd.jobs(docs, inks), pixels(spark, {1: (0, 0, 0), 2: (0, 0, 0), 3: (255, 0, 0)})).groupBy("job").agg({"value": "min"}).collect()
    tone = {(r.job.image_id, r.job.channel): r["min(value)"] for r in t}
    assert {tone[1, c] for c in "cmyk"} == {0.25} and {tone[2, c] for c in ("red", "green", "blue")} == {1.0}
    assert [tone[3, c] for c in "cmyk"] == [0.0, 1.0, 1.0, 0.0]
    got = cd.curve_outlines(pixels(spark, {1: (0, 0, 0), 2: (0, 0, 0), 3: (255, 0, 0)}), docs, inks, paths(spark, WAVE)).select("image_id", "channel").distinct().collect()
    assert {tuple(r) for r in got} == {(1, c) for c in "cmyk"} | {(2, c) for c in ("red", "green", "blue")} | {(3, "m"), (3, "y")}


def test_outlines_equal_the_stepwise_form(spark):
    """The one-pass outlines of open lines have the contours of curves.outline."""
    rng = random.Random(3)
    rows = [(i, j, rng.random() * 50, rng.random() * 50, rng.choice([0.0, 3.0, 6.0])) for i in range(12) for j in range(rng.choice([1, 2, 3, 9]))] + [(50, j, 1.0, 1.0, 2.0) for j in range(3)]
    p = spark.createDataFrame(rows, "poly_id int, seq long, x double, y double, width double")
    want = curves.outline(p).collect()
    got = cd.outlines(p.selectExpr("named_struct('id', poly_id, 'closed', false) AS poly_id", "seq", "x", "y", "width")).collect()
    line = lambda rs, key: [(key(r), r.op, *(None if v is None else round(v, 9) for v in (r.c1x, r.c1y, r.c2x, r.c2y, *((r.x, r.y) if r.op != "Z" else ())))) for r in sorted(rs, key=lambda r: (key(r), r.part, r.ord))]
    assert line(got, lambda r: r.poly_id.id) == line(want, lambda r: r.poly_id)


def test_rings_close(spark):
    """A ring of constant width: each side is one closed contour, and its area is the width times the way around."""
    n, radius, width = 64, 20.0, 4.0
    ring = [(j, 30 + radius * math.cos(2 * math.pi * j / n), 30 + radius * math.sin(2 * math.pi * j / n)) for j in range(n + 1)]
    p = spark.createDataFrame([(j, x, y, width) for j, x, y in ring], "seq long, x double, y double, width double").selectExpr("named_struct('id', 1, 'closed', true) AS poly_id", "*")
    o = cd.outlines(p)
    rows = sorted(o.collect(), key=lambda r: (r.part, r.ord))
    assert "".join(r.op for r in rows) == ("M" + "C" * n + "Z") * 2
    for a, b in zip(rows, rows[1:]):
        assert b.op == "M" or (b.x0, b.y0) == pytest.approx((a.x, a.y))
    c = cd.rasterize_outlines(o.selectExpr("1 AS image_id", "'k' AS channel", "0 AS copy", "*"), 60, 60, 8)
    area = c.agg({"coverage": "sum"}).first()[0]
    assert area == pytest.approx(2 * math.pi * radius * width, rel=0.01)


def test_winding_of_several_contours(spark):
    """Nonzero winding: two overlapping squares of one turn fill their union, an opposite one inside makes a hole."""
    def square(x, y, s, back=False):
        c = [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
        c = c[::-1] if back else c
        return [(*c[i], *c[(i + 1) % 4]) for i in range(4)]

    shapes = {1: square(2, 2, 6) + square(4.5, 4.25, 6), 2: square(2, 2, 8) + square(4, 4, 4, True), 3: square(2, 2, 8) + square(4, 4, 4), 4: square(-5, -5, 30)}
    rows = [(i, "k", 0, "Z", float(x0), float(y0), None, None, None, None, float(x), float(y)) for i, e in shapes.items() for x0, y0, x, y in e]
    d = spark.createDataFrame(rows, "image_id int, channel string, copy int, op string, x0 double, y0 double, c1x double, c1y double, c2x double, c2y double, x double, y double")
    got = {r.image_id: r for r in cd.rasterize_outlines(d, 12, 12, 4).groupBy("image_id").agg({"coverage": "sum", "px": "count"}).collect()}
    assert got[1]["sum(coverage)"] == pytest.approx(72 - 3.5 * 3.75) and got[2]["sum(coverage)"] == 48 and got[3]["sum(coverage)"] == 64 and got[4]["sum(coverage)"] == 144


def test_golden_pixels(spark):
    """A straight line across at full width: rows of cells drawn solid with a gap of 15 %; opacity, mapping and base."""
    docs = spark.createDataFrame([doc(1, max_mark=50.0), doc(2), doc(3, value_mode="cmyk")], DOC)
    inks = spark.createDataFrame([ink(1, "k", color="#000000"), ink(2, "k", color="#000000", opacity=0.5), ink(3, "c", color="#00FFFF", max_size=200.0), ink(3, "m", color="#FF00FF", max_size=200.0)], INK)
    pix = pixels(spark, {1: (0, 0, 0), 2: (0, 0, 0), 3: (0, 0, 255)})
    p = paths(spark, "M 0 0 L 1 0")
    got = {(r.image_id, r.x, r.y): tuple(r[3:]) for r in cd.render_curve_documents(pix, docs, inks, p, 120, 80, 4).collect()}
    assert len(got) == 3 * 120 * 80
    # lines lie at 40 + 16 k (five rows of 16, the shorter cell edge is 15) with half of the cell inked
    dark = [y for y in range(80) if got[1, 60, y] == (0, 0, 0, 255)]
    light = [y for y in range(80) if got[1, 60, y] == (255, 255, 255, 255)]
    assert all(any(abs(y + 0.5 - (40 + 15 * k)) < 3.75 for k in range(-3, 4)) for y in dark) and len(dark) >= 5 * 6 and len(light) >= 5 * 6
    assert got[2, 60, 40] == (127, 127, 127, 255)
    # pure blue is cyan and magenta; wide lines overlap and cover all
    assert {got[3, x, y] for x in range(20, 100) for y in range(20, 60)} == {(0, 0, 255, 255)}
    one = {(r.x, r.y): tuple(r[3:]) for r in cd.render_curve_documents(pix, docs.filter("image_id = 3"), inks, p, 60, 40, 2, white=False, channel="c").collect()}
    assert len(one) == 60 * 40 and one[30, 20] == (0, 255, 255, 255)
    bare = {tuple(r[3:]) for r in cd.render_curve_documents(pixels(spark, {1: (255, 255, 255)}), docs.filter("image_id = 1"), inks, p, 30, 20, 2, white=False).collect()}
    assert bare == {(0, 0, 0, 0)}
    with pytest.raises(ValueError):
        cd.render_curve_documents(pix, docs, inks, p, 9000, 9000)


def test_awkward_rows(spark):
    """No documents, unknown paths, null ids and closed full-width paths give no lines."""
    docs = spark.createDataFrame([doc(1), doc(None), doc(3), doc(4, shared_path_id=9)], DOC)
    inks = spark.createDataFrame([ink(1, "k"), ink(None, "k"), ink(3, "k", enabled=None), ink(4, "k")], INK)
    p = paths(spark, "M 0 0 L 1 0 L 0 1 Z")
    pix = pixels(spark, {1: (0, 0, 0), 4: (0, 0, 0)})
    assert cd.curve_outlines(pix, docs, inks, p).count() == 0
    assert cd.curve_outlines(pix, docs.limit(0), inks, p).count() == 0
    got = {tuple(r[3:]) for r in cd.render_curve_documents(pix, docs.filter("image_id = 4"), inks, p, 6, 4).collect()}
    assert got == {(255, 255, 255, 255)}
