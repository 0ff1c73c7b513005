"""Documents of versions 1 to 5: migration, defaults, validation and round trips, against values worked out by hand."""

import base64
import json

import pytest

from screentone.sources import documents

NATIVE = {"treatment": "squares", "detail": 73.0, "coverage": 101.0, "contrast": 123.0, "angle": 22.0}
PNG = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (16).to_bytes(4, "big") + (9).to_bytes(4, "big")


def doc(version, payload=b"\x09\x08\x07", **more):
    return {"format": "halftone-document", "version": version, "document_id": "d", "source": {"name": "s.png", "media_type": "image/png", "bytes": base64.b64encode(payload).decode()}, "settings": NATIVE} | more


def shape(**settings):
    return {"variant": "web-shape-v1", "settings": settings}


def curve(**settings):
    return {"variant": "web-curve-v1", "settings": settings}


def channels(**more):
    return {k: more.get(k, {}) for k in "cmyk"} | {k: v for k, v in more.items() if k in "rgb"}


def read(spark, *docs):
    rows = [(i, d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return [r.asDict(True) for r in documents.parse_documents(spark.createDataFrame(rows, "text_id long, content string")).orderBy("text_id").collect()]


WHITE = {"kind": "color", "color": {"red": 255, "green": 255, "blue": 255, "alpha": 255}}


def test_migration_of_each_version(spark):
    render = shape(output_width=100, channels=channels(m={"color": "#123456"}))
    look = {"preview_surface": {"kind": "checkerboard"}, "export_background": {"kind": "color", "color": {"red": 3, "green": 4, "blue": 5, "alpha": 99}}}
    cache = {"settings": NATIVE, "render": {"variant": "native-basic-v1"}}
    more = {"render": render, "saved_web_shape": {"output_width": 5}, "appearance": look, "output_mode": "rgb-screen", "inactive_cmyk": cache}
    got = read(spark, *[doc(v, **more) for v in range(1, 6)])
    assert [r["reason"] for r in got] == [None] * 5
    assert [r["variant"] for r in got] == ["native-basic-v1"] + ["web-shape-v1"] * 4
    assert [r["saved_shape"] is not None for r in got] == [False, False, True, True, True]
    assert [r["filled_appearance"] for r in got] == [True, True, True, False, False]
    assert [r["filled_output_mode"] for r in got] == [True] * 4 + [False]
    assert [r["output_mode"] for r in got] == ["cmyk-inks"] * 4 + ["rgb-screen"]
    assert [r["inactive_cmyk"] is not None for r in got] == [False] * 4 + [True]
    assert got[2]["appearance"] == {"preview_surface": WHITE, "export_background": WHITE}
    assert got[3]["appearance"]["export_background"]["color"] == {"red": 3, "green": 4, "blue": 5, "alpha": 99}
    assert got[0]["settings"] == NATIVE and got[0]["shape"] is None
    assert got[1]["shape"]["channels"]["m"]["color"] == "#123456" and got[1]["shape"]["channels"]["c"]["color"] == "#111111"


def test_defaults(spark):
    r, s, n = read(spark, doc(5, render=shape()), doc(5, render=curve()), doc(5))
    assert (r["shape"]["output_width"], r["shape"]["output_height"], r["shape"]["grid_scale"], r["shape"]["max_mark"]) == (900, 620, 92.0, 85.0)
    assert {k: (c["color"], c["grid_rotation"]) for k, c in r["shape"]["channels"].items()} == {k: (c, a) for k, (_, c, a) in documents.INKS.items()}
    assert r["shape"]["base_channel"]["opacity"] == 1.0 and s["curve"]["base_channel"]["opacity"] == 0.92
    assert (s["curve"]["long_edge_cells"], s["curve"]["channels"]["k"]["curve_scale"], s["curve"]["channels"]["k"]["tile_count"]) == (90.0, 32.0, 2)
    assert len(s["curve"]["shared_path"]["segments"]) == 2 and s["curve"]["shared_path"]["segments"][1]["end"] == {"x": 0.5, "y": 0.0}
    assert n["variant"] == "native-basic-v1" and n["appearance"]["export_background"]["kind"] == "none"


def test_native_settings_are_clamped(spark):
    (r,) = read(spark, doc(1, settings=NATIVE | {"detail": -5.0, "coverage": 900.0, "contrast": 1e999, "angle": -200.0}))
    assert r["settings"] == {"treatment": "squares", "detail": 0.0, "coverage": 160.0, "contrast": 108.0, "angle": -180.0} or r["reason"] is not None


def test_canvas_takes_the_artworks_proportions_in_all_records(spark):
    saved = {"saved_web_shape": {"output_width": 800, "output_height": 800}, "saved_web_curve": {"output_width": 700, "output_height": 700}}
    a, b, c = read(spark, doc(5, PNG, render=shape(output_width=1000, output_height=1000), **saved), doc(5, PNG, render=shape(output_width=160, output_height=90)), doc(5, PNG, render=shape(output_width=160, output_height=90), **saved))
    size = lambda s: (s["output_width"], s["output_height"])
    assert (size(a["shape"]), size(a["saved_shape"]), size(a["saved_curve"])) == ((1000, 563), (800, 450), (700, 394))
    assert [a["canvas_aspect"], b["canvas_aspect"], c["canvas_aspect"]] == [True, False, True]


def test_crosshatch_of_shapes_becomes_curves(spark):
    m = {"color": "#123456", "offset_y": -19.49, "resolution_scale": 2.0, "opacity": 0.37, "grid_rotation": 73.5, "shape": "pentagon"}
    (r,) = read(spark, doc(5, render=shape(value_mode="crosshatch-luminance", max_mark=90, min_mark=4, channels=channels(m=m, c={"enabled": False})), saved_web_shape={"value_mode": "crosshatch-luminance"}))
    assert r["reason"] is None and r["crosshatch_treatment"] and r["variant"] == "web-curve-v1" and r["shape"] is None
    c = r["curve"]["channels"]
    assert (c["m"]["color"], c["m"]["offset_y"], c["m"]["resolution_scale"], c["m"]["opacity"]) == ("#123456", -19.49, 2.0, 0.37)
    assert {k: c[k]["grid_rotation"] for k in "kcmy"} == {"k": 45.0, "c": -45.0, "m": 0.0, "y": 90.0}
    assert (r["curve"]["min_mark"], r["curve"]["max_mark"], r["curve"]["long_edge_cells"], c["c"]["enabled"]) == (4.0, 90.0, 92.0, True)
    assert len(c["k"]["path"]["segments"]) == 1 and r["saved_shape"]["value_mode"] == "luminance"


NODE = {"x": 0.0, "y": 0.0}
REASONS = [
    (None, "unreadable"),
    ("{", "unreadable"),
    ("[]", "unreadable"),
    (doc(6), "unsupported document version 6"),
    (doc(5) | {"format": "other"}, "not a halftone-document"),
    (doc(5) | {"source": None}, "missing source"),
    (doc(5, settings={"treatment": "dots"}), "missing settings detail"),
    (doc(5, b""), "document has no source artwork"),
    (doc(5, render={"variant": "web-shape-v1"}), "missing shape settings"),
    (doc(5, render={"variant": "other"}), "unknown variant other"),
    (doc(5, output_mode="lab"), "unknown output mode lab"),
    (doc(5, render=shape(value_mode="lab")), "unknown value mode lab"),
    (doc(5, render=shape(channels={"c": {}})), "missing shape settings"),
    (doc(5, render=shape(output_width=0)), "web shape artboard has no usable size"),
    (doc(5, render=shape(output_width=100_001)), "web shape artboard is too large"),
    (doc(5, render=shape(long_edge_cells=1.5)), "web shape grid is outside the supported range"),
    (doc(5, render=shape(grid_scale=0)), "web shape cell fill is outside the supported range"),
    (doc(5, render=shape(min_mark=9, max_mark=8)), "web shape mark range is outside the supported range"),
    (doc(5, render=shape(base_channel={"width_scale": 0.001})), "web shape base value is outside the supported range"),
    (doc(5, render=shape(channels=channels(m={"color": "#12345"}))), "invalid Magenta ink color"),
    (doc(5, render=shape(channels=channels(k={"resolution_scale": 0}))), "invalid Black channel resolution"),
    (doc(5, render=shape(channels=channels(y={"threshold": 2}))), "Yellow channel value is outside the supported range"),
    (doc(5, render=shape(channels=channels(c={"custom_shape_path": {"anchors": [{"point": NODE, "incoming": NODE, "outgoing": NODE}] * 3}}))), "user-defined mark has no usable area"),
    (doc(5, render=shape(channels=channels(c={"custom_shape_path": {"anchors": [{"point": NODE, "incoming": NODE, "outgoing": NODE}] * 65}}))), "a user-defined mark supports at most 64 nodes"),
    (doc(5, render=shape(polygon_sides=7)), "regular polygon must have between 3 and 6 sides"),
    (doc(5, render=shape(custom_nodes=[NODE, NODE])), "a user-defined mark needs at least three nodes"),
    (doc(5, render=curve(output_height=0)), "web curve artboard is outside the supported range"),
    (doc(5, render=curve(max_mark=1001)), "web curve global setting is outside the supported range"),
    (doc(5, render=curve(shared_path={"start": NODE, "segments": []})), "curve must contain between 1 and 64 segments"),
    (doc(5, render=curve(base_channel={"tile_count": 0})), "web curve base value is outside the supported range"),
    (doc(5, render=curve(channels=channels(c={"stack_spacing": 10_001}))), "Cyan curve channel value is outside the supported range"),
    (doc(5, output_mode="rgb-screen", render=curve(channels=channels(c={"opacity": 7}, r={"opacity": 7}))), "Red curve channel value is outside the supported range"),
    (doc(5, saved_web_curve={"long_edge_cells": 0}), "web curve global setting is outside the supported range"),
    (doc(5, saved_web_shape={"channels": {}}), "missing saved shape settings"),
]


def test_reasons(spark):
    got = read(spark, *[d for d, _ in REASONS])
    assert [r["reason"] for r in got] == [w for _, w in REASONS]
    assert got[-2]["problems"] == ["web curve global setting is outside the supported range"]


def test_round_trip(spark):
    cache = {"settings": NATIVE, "render": curve(layout="motif-pattern"), "saved_web_shape": {"output_width": 7}}
    motif = {"curve_scale": 47.0, "motif_coverage": "manual", "tile_count": 3, "alternate_tile_transform": "rotate180"}
    given = [doc(5), doc(4, render=shape(min_mark=3)), doc(5, render=curve(layout="motif-pattern", channels=channels(c=motif)), saved_web_shape={}, inactive_rgb=cache), doc(3, PNG, render=shape())]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(given)], "text_id long, content string")
    first = documents.parse_documents(rows)
    again = documents.parse_documents(documents.document_json(first))
    same = [c for c in first.columns if c not in ("version_read", "canvas_aspect", "crosshatch_treatment", "filled_appearance", "filled_output_mode", "inactive_cmyk", "inactive_rgb")]
    pick = lambda d: [r.asDict(True) for r in d.select(*same).orderBy("text_id").collect()]
    assert pick(first) == pick(again)
    rest = again.orderBy("text_id").collect()
    assert [r["version_read"] for r in rest] == [5] * 4 and not any(r["canvas_aspect"] or r["filled_output_mode"] for r in rest)
    assert json.loads(rest[2]["inactive_rgb"]["render"]["settings"])["layout"] == "motif-pattern"


def test_files_and_empty_table(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(doc(2), indent=1))
    (tmp_path / "b.json").write_text("nothing")
    accepted, rejected = documents.read_documents(spark, str(tmp_path))
    assert [r["version_read"] for r in accepted.collect()] == [2] and [r["reason"] for r in rejected.collect()] == ["unreadable"]
    assert documents.parse_documents(spark.createDataFrame([], "text_id long, content string")).count() == 0


if __name__ == "__main__":
    pytest.main([__file__])
