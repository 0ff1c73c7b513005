"""Presets of versions 1 and 2: defaults, deltas, paths, reasons and round trips, against values worked out by hand."""

import json

import pytest

from screentone.sources import presets

TRIANGLE = "M 0 0 L 0.4 0 L 0 0.4 Z"


def v1(settings=None, **more):
    return {"format": "halftone-preset", "version": 1, "name": "n", "settings": settings or {}} | more


def table(spark, *given, size=(20, 20)):
    rows = [(i, g if g is None or isinstance(g, str) else json.dumps(g), *(size or (None, None))) for i, g in enumerate(given)]
    return spark.createDataFrame(rows, "preset_id long, content string, src_w long, src_h long")


def read(spark, *given, size=(20, 20)):
    return [r.asDict(True) for r in presets.parse_presets(table(spark, *given, size=size)).orderBy("preset_id").collect()]


def test_defaults_percents_aspect_and_deltas(spark):
    (r,) = read(spark, v1({"markMode": "shape", "preserveAspect": True}, cmykDeltas={"thresholdDelta": 10, "opacityMultiplier": 2}, channels={"c": {"threshold": 4, "opacity": 50}}), size=(2, 1))
    s = r["shape"]
    assert r["reason"] is None and r["variant"] == "web-shape-v1"
    assert (s["output_width"], s["output_height"], s["long_edge_cells"]) == (900, 450, 90.0)
    assert [(s["channels"][k]["grid_rotation"], round(s["channels"][k]["threshold"], 12), s["channels"][k]["opacity"]) for k in "cm"] == [(0.0, 0.14, 1.0)] * 2
    # lights take no deltas
    assert (s["channels"]["r"]["threshold"], s["channels"]["r"]["opacity"]) == (0.0, 1.0)
    assert r["canvas_aspect"]


def test_all_deltas(spark):
    deltas = dict(rotationDelta=1, gridRotationDelta=2, gridPivotXDelta=3, gridPivotYDelta=4, scaleMultiplier=2, resolutionMultiplier=3, maxSizeMultiplier=0.5, offsetXDelta=5, offsetYDelta=6)
    more = dict(outputQualityMultiplier=2, curveScaleMultiplier=0.5, motifCoverageModeOverride="manual", motifBleedDelta=1, tileCountDelta=-1, tileSpacingDelta=7, tileAngleDelta=8, tileOffsetDelta=9, alternateTileTransformOverride="flip", stackCountDelta=4, stackSpacingDelta=-6, stackAngleDelta=10, stackOffsetDelta=11, alternateStackOffsetDelta=12)
    s, c = read(spark, v1({}, cmykDeltas=deltas, channels={"k": {"rotation": 10, "scale": 1.5}}), v1({"markMode": "curve"}, cmykDeltas=deltas | more, channels={"k": {"tileCount": 5, "motifCoverageMode": "auto"}}))
    k = s["shape"]["channels"]["k"]
    assert [k[f] for f in ("rotation", "grid_rotation", "grid_pivot_x", "grid_pivot_y", "scale", "resolution_scale", "max_size", "offset_x", "offset_y")] == [11, 2, 3, 4, 3, 3, 50, 5, 6]
    k, m = c["curve"]["channels"]["k"], c["curve"]["channels"]["m"]
    assert (k["tile_count"], m["tile_count"], k["stack_count"]) == (4, 1, 6)
    fields = ("output_quality", "curve_scale", "motif_bleed", "tile_spacing", "tile_angle", "tile_offset", "stack_spacing", "stack_angle", "stack_offset", "alternate_stack_offset", "motif_coverage", "alternate_tile_transform")
    assert [k[f] for f in fields] == [2, 16, 3, 7, 8, 9, 30, 10, 11, 12, "manual", "flip"]


def test_shapes(spark):
    ink = {"c": {"enabled": True, "preset": "triangle"}, "m": {"enabled": True, "preset": "pentagon"}, "y": {"enabled": True, "preset": "hexagon"}, "k": {"enabled": False, "preset": "circle"}}
    fixed = {"preserveAspect": False, "outputWidth": 100, "outputHeight": 100}
    shared, own, off, custom = read(
        spark,
        v1({"sharedPreset": "hexagon", "preserveAspect": False}, channels={}),
        v1({"geometryMode": "independent", "valueMode": "luminance", "longEdgeCells": 8} | fixed, channels=ink),
        v1({"geometryMode": "independent"}, channels={"c": {"enabled": False, "preset": "unknown", "customPath": "M0 0"}}),
        v1({"sharedPath": "M 0 0 L 0.3 0 Q 0.3 0.3 0 0.3 L 0 0 Z"} | fixed),
    )
    assert (shared["shape"]["shared_shape"], shared["shape"]["polygon_sides"]) == ("regularpolygon", 6)
    assert not own["shape"]["use_shared_mark"]
    assert [(own["shape"]["channels"][k]["shape"], own["shape"]["channels"][k]["polygon_sides"]) for k in "cmyk"] == [("triangle", 3), ("pentagon", 5), ("hexagon", 6), ("circle", 4)]
    assert off["reason"] is None and off["shape"]["channels"]["c"]["shape"] == "circle"
    anchors = custom["shape"]["custom_shape_path"]["anchors"]
    # the last line ends at the start, so closing adds nothing
    assert [(a["point"]["x"], a["point"]["y"]) for a in anchors] == [(0, 0), (0.3, 0), (0, 0.3)]
    assert anchors[1]["outgoing"]["x"] == pytest.approx(0.3) and anchors[1]["outgoing"]["y"] == pytest.approx(0.2)
    assert anchors[0]["incoming"] == {"x": 0, "y": pytest.approx(0.1)}


def test_curves_and_crosshatch(spark):
    shared, own, cross = read(
        spark,
        v1({"markMode": "curve", "sharedPreset": "v", "sharedConnectEndpoints": True}, channels={"c": {"connectEndpoints": False}}),
        v1({"markMode": "curve", "syncCurveChannels": False, "curveSpan": "motif-pattern"}, channels={"c": {"preset": "slash", "smoothSeamTangents": True}, "m": {"customPath": "M 0 0 C 1 2 3 4 5 6"}}),
        v1({"valueMode": "crosshatch-luminance"}, channels={"m": {"scale": 2.5}}),
    )
    c = shared["curve"]["channels"]
    assert [len(c[k]["path"]["segments"]) for k in "cmyk"] == [2] * 4 and all(c[k]["close_ends"] for k in "cmyk")
    c = own["curve"]["channels"]
    assert own["curve"]["layout"] == "motif-pattern" and c["c"]["smooth_join"] and not c["m"]["smooth_join"]
    assert c["c"]["path"]["start"] == {"x": -0.42, "y": 0.42}
    assert c["m"]["path"]["segments"] == [{"control_1": {"x": 1, "y": 2}, "control_2": {"x": 3, "y": 4}, "end": {"x": 5, "y": 6}}]
    assert c["y"]["path"]["start"] == {"x": -0.5, "y": 0.0}
    assert (cross["variant"], cross["shape"], cross["crosshatch_treatment"]) == ("web-curve-v1", None, True)
    assert {k: (v["grid_rotation"], v["scale"]) for k, v in cross["curve"]["channels"].items() if k in "cmyk"} == {"c": (-45, 1), "m": (0, 2.5), "y": (90, 1), "k": (45, 1)}


REASONS = [
    (None, "unreadable"),
    ("{", "unreadable"),
    ({"format": "halftone-preset", "version": 2}, "missing render"),
    (v1() | {"format": "other"}, "not a halftone-preset"),
    (v1() | {"version": 3}, "Unsupported treatment preset version 3"),
    (v1({"outputWidth": "wide"}), "unreadable field"),
    (v1({"markMode": "dots"}), "This preset uses unknown treatment mode 'dots'. Nothing was changed."),
    (v1({"geometryMode": "mixed"}), "This preset uses unknown geometry 'mixed'. Nothing was changed."),
    (v1({"sharedPreset": "star"}), "This preset uses unknown shape 'star'. Nothing was changed."),
    (v1({"outputWidth": 99999}), "Preset output width is outside the supported range"),
    (v1({"valueMode": "wat"}), "Preset has an unknown color interpretation"),
    (v1({"singleChannel": "r"}), "Preset has an unknown output ink"),
    (v1({"minMark": 90}), "Preset mark range is invalid"),
    (v1({"longEdgeCells": 7}), "Preset cell count is outside the supported range"),
    (v1(channels={"k": {"color": "red"}}), "Preset has an invalid Black color"),
    (v1(channels={"m": {"threshold": 101}}), "Preset threshold is outside the supported range"),
    (v1(channels={"m": {"scale": 6}, "c": {"opacity": -1}}), "Preset opacity is outside the supported range"),
    (v1(cmykDeltas={"scaleMultiplier": 0}), "Preset scale multiplier is outside the supported range"),
    (v1({"geometryMode": "independent"}, channels={"c": {"customPath": "M0 0"}}), "Preset custom shape must be closed"),
    (v1({"sharedPath": "M 0 0 L 1 0 L 0 1"}), "Preset custom shape must be closed"),
    (v1({"sharedPath": "M 0 0 L 1 0 L 0 1 Z M 2 2 L 3 2 L 2 3 Z"}), "Preset custom shape must contain one closed path"),
    (v1({"sharedPath": "M 0 0 A 1 1 0 0 0 1 1 Z"}), "Preset custom shape uses an unsupported SVG command"),
    (v1({"sharedPath": "M 0 0 L 1 0 Z"}), "Preset custom shape has an unsupported number of segments"),
    (v1({"sharedPath": "M 0 0 L 1 Z"}), "Preset custom shape path is invalid"),
    (v1({"markMode": "curve", "sharedPath": TRIANGLE}), "Closed preset curves are not available yet. Nothing was changed."),
    (v1({"markMode": "curve", "sharedPath": "L 1 1"}), "Preset curve must begin with a move"),
    (v1({"markMode": "curve", "sharedPath": "M 1 1 L 1 x"}), "Preset curve path is invalid"),
    (v1({"markMode": "curve", "sharedPreset": "zig"}), "This preset uses unknown curve profile 'zig'. Nothing was changed."),
    (v1({"markMode": "curve", "curveSpan": "half"}), "This preset uses unsupported curve coverage 'half'. Nothing was changed."),
    (v1({"markMode": "curve"}, channels={"y": {"motifCoverageMode": "some"}}), "Preset has an unknown motif coverage mode 'some'"),
    (v1({"markMode": "curve"}, cmykDeltas={"tileCountDelta": -2}), "Preset column count is outside the supported range"),
    (v1({"markMode": "curve"}, cmykDeltas={"alternateTileTransformOverride": "mirror"}), "Preset has an unknown alternate-copy transform 'mirror'"),
    (v1({"markMode": "curve"}, cmykDeltas={"motifBleedDelta": 99}), "Cyan curve channel value is outside the supported range"),
    (v1(nativeRender={"variant": "web-shape-v1"}), "missing shape settings"),
]


def test_reasons(spark):
    got = read(spark, *[g for g, _ in REASONS])
    assert [r["reason"] for r in got] == [w for _, w in REASONS]
    assert read(spark, v1(), size=None)[0]["reason"] == "Source artwork has no usable size"
    assert read(spark, v1({"preserveAspect": False}), size=None)[0]["reason"] is None
    assert read(spark) == []


def test_native(spark):
    plain = {"format": "halftone-preset", "version": 2, "render": {"variant": "native-basic-v1"}}
    a, b, c = read(spark, plain, plain | {"settings": {"treatment": "lines", "detail": 400, "coverage": 5, "contrast": 6, "angle": -200}}, v1({"markMode": "unheard"}, nativeRender={"variant": "web-curve-v1", "settings": {"output_width": 400, "output_height": 100}}))
    assert a["native"] == {"treatment": "dots", "detail": 52.0, "coverage": 92.0, "contrast": 108.0, "angle": 0.0}
    assert b["native"] == {"treatment": "lines", "detail": 100.0, "coverage": 5.0, "contrast": 6.0, "angle": -180.0}
    # the whole treatment wins over what stands beside it, and takes the artwork's proportions
    assert (c["reason"], c["curve"]["output_width"], c["curve"]["output_height"], c["canvas_aspect"]) == (None, 400, 400, True)


@pytest.mark.parametrize("with_render", [True, False])
def test_round_trip(spark, with_render):
    deltas = {"thresholdDelta": 3, "scaleMultiplier": 1.25, "opacityMultiplier": 0.5, "gridRotationDelta": 7.5, "tileCountDelta": 3, "stackSpacingDelta": 0.1}
    given = [
        v1({"sharedPreset": "circle", "minMark": 3.3}, cmykDeltas=deltas, channels={"c": {"scale": 1.1, "threshold": 0.2}}),
        v1({"sharedPath": TRIANGLE}, cmykDeltas=deltas, channels={k: {} for k in "cmyk"}),
        v1({"geometryMode": "independent"}, channels={"c": {"customPath": TRIANGLE}, "m": {"preset": "hexagon"}, "y": {}, "k": {"enabled": False}}),
        v1({"markMode": "curve", "sharedPreset": "wave"}, cmykDeltas=deltas),
        v1({"markMode": "curve", "syncCurveChannels": False, "singleChannel": "m", "sharedConnectEndpoints": True}, cmykDeltas=deltas, channels={k: {"preset": p, "tileAngle": 0.3} for k, p in zip("cmyk", ("loop", "arc", "v", "line"))}),
        {"format": "halftone-preset", "version": 2, "name": "p", "render": {"variant": "native-basic-v1"}, "settings": {"treatment": "lines", "detail": 4, "coverage": 5, "contrast": 6, "angle": 7}},
    ]
    first = presets.parse_presets(table(spark, *given))
    again = presets.parse_presets(presets.preset_json(first, with_render=with_render).selectExpr("preset_id", "content", "20 AS src_w", "20 AS src_h"))
    a, b = ([r.asDict(True) for r in d.orderBy("preset_id").collect()] for d in (first, again))
    assert len(a) == len(b) == 6 and all(r["reason"] is None for r in a + b)
    for x, y in zip(a, b):
        for f in ("variant", "native", "shape", "curve"):
            assert x[f] == y[f], (x["preset_id"], f)
    assert not any(r["canvas_aspect"] for r in b)
