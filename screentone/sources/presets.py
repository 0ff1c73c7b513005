"""Presets of versions 1 and 2: shape and curve settings for every ink with their deltas laid on, and back to text.

A version 1 preset names its settings, the deltas that all inks share and what single inks differ in; absent values
take a default of their own level. It may carry a whole treatment beside them, which then wins. A version 2 preset
is a native treatment. Everything is a projection over one row a preset; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screentone.operators import curves
from screentone.sources import documents as D

FORMAT = "halftone-preset"
SIDES = {"circle": 4, "rectangle": 4, "triangle": 3, "pentagon": 5, "hexagon": 6}

# Curve profiles by name, names of modes and inks, and ranges (field, text's name, default, least, most, what messages call it; no range: any finite number).
PROFILES = {
    "line": "M -0.45 0 L 0.45 0",
    "slash": "M -0.42 0.42 L 0.42 -0.42",
    "arc": "M -0.45 0.18 C -0.25 -0.35 0.25 -0.35 0.45 0.18",
    "wave": "M -0.5 0 C -0.32 -0.4 -0.18 -0.4 0 0 C 0.18 0.4 0.32 0.4 0.5 0",
    "curve": "M -0.45 0.32 C -0.22 -0.38 0.22 -0.38 0.45 0.32",
    "v": "M -0.42 -0.3 L 0 0.34 L 0.42 -0.3",
    "loop": "M -0.45 0 C -0.35 -0.35 -0.05 -0.35 0 0 C 0.05 0.35 0.35 0.35 0.45 0",
}
VALUE_MODES = ["cmyk", "luminance", "crosshatch-luminance", "single-channel"]
INK_NAMES = {"c": "cyan", "m": "magenta", "y": "yellow", "k": "black"}
GLOBALS = [("long_edge_cells", "longEdgeCells", 90, 8, 220, "cell count"), ("grid_scale", "gridScale", 92, 10, 160, "cell fill"), ("min_mark", "minMark", 0, 0, 100, "minimum mark"), ("max_mark", "maxMark", 85, 1, 200, "maximum mark")]
ROTATION = [("rotation", "rotation", 0, None, None, "mark rotation")]
CHANNEL = [
    ("grid_rotation", "gridRotation", 0, None, None, "screen angle"),
    ("grid_pivot_x", "gridPivotX", 0, -4000, 4000, "grid pivot"),
    ("grid_pivot_y", "gridPivotY", 0, -4000, 4000, "grid pivot"),
    ("scale", "scale", 1, 0, 5, "coverage"),
    ("threshold", "threshold", 0.04, "unit", None, "threshold"),
    ("max_size", "maxSize", 100, 0, 1000, "maximum size"),
    ("resolution_scale", "resolutionScale", 1, 0.1, 100, "detail"),
    ("offset_x", "offsetX", 0, -4000, 4000, "phase"),
    ("offset_y", "offsetY", 0, -4000, 4000, "phase"),
    ("opacity", "opacity", 0.92, "unit", None, "opacity"),
]
MOTIF = [
    ("output_quality", "outputQuality", 1, 0.1, 20, "output quality"),
    ("curve_scale", "curveScale", 32, 0.1, 500, "motif size"),
    ("motif_bleed", "motifBleed", 2, 0, 100, "edge overlap"),
    ("tile_count", "tileCount", 2, 1, 10_000, "column count"),
    ("tile_spacing", "tileSpacing", 0, -10_000, 10_000, "horizontal spacing"),
    ("tile_angle", "tileAngle", 0, None, None, "pattern angle"),
    ("tile_offset", "tileOffset", 0, -10_000, 10_000, "tile offset"),
    ("stack_count", "stackCount", 2, 1, 10_000, "row count"),
    ("stack_spacing", "stackSpacing", 36, -10_000, 10_000, "vertical spacing"),
    ("stack_angle", "stackAngle", 0, None, None, "layer turn"),
    ("stack_offset", "stackOffset", 0, -10_000, 10_000, "layer shift"),
    ("alternate_stack_offset", "alternateStackOffset", 0, -10_000, 10_000, "row stagger"),
]
#: Deltas (fixed values): the field, the text's name, + or *, the least of a factor (0 allowed or not), and what messages call it.
SHARED = [
    ("threshold", "thresholdDelta", "+", None, "threshold delta"),
    ("rotation", "rotationDelta", "+", None, "rotation delta"),
    ("grid_rotation", "gridRotationDelta", "+", None, "grid rotation delta"),
    ("grid_pivot_x", "gridPivotXDelta", "+", None, "pivot delta"),
    ("grid_pivot_y", "gridPivotYDelta", "+", None, "pivot delta"),
    ("scale", "scaleMultiplier", "*", ">", "scale multiplier"),
    ("resolution_scale", "resolutionMultiplier", "*", ">", "resolution multiplier"),
    ("max_size", "maxSizeMultiplier", "*", ">", "maximum size multiplier"),
    ("opacity", "opacityMultiplier", "*", ">=", "opacity multiplier"),
    ("offset_x", "offsetXDelta", "+", None, "phase delta"),
    ("offset_y", "offsetYDelta", "+", None, "phase delta"),
]
MOTIF_SHARED = [
    ("output_quality", "outputQualityMultiplier", "*", ">", "output quality multiplier"),
    ("curve_scale", "curveScaleMultiplier", "*", ">", "curve scale multiplier"),
    ("motif_bleed", "motifBleedDelta", "+", None, "edge overlap delta"),
    ("tile_count", "tileCountDelta", "+", None, "column count"),
    ("tile_spacing", "tileSpacingDelta", "+", None, "horizontal spacing delta"),
    ("tile_angle", "tileAngleDelta", "+", None, "pattern angle delta"),
    ("tile_offset", "tileOffsetDelta", "+", None, "tile offset delta"),
    ("stack_count", "stackCountDelta", "+", None, "row count"),
    ("stack_spacing", "stackSpacingDelta", "+", None, "vertical spacing delta"),
    ("stack_angle", "stackAngleDelta", "+", None, "layer turn delta"),
    ("stack_offset", "stackOffsetDelta", "+", None, "layer shift delta"),
    ("alternate_stack_offset", "alternateStackOffsetDelta", "+", None, "row stagger delta"),
]
COUNTS = ("tile_count", "stack_count")
OVERRIDES = {"motif_coverage": "motifCoverageModeOverride", "alternate_tile_transform": "alternateTileTransformOverride"}
COVERAGES, TRANSFORMS = ["auto", "manual"], ["none", "flip", "rotate-180"]


def _type(field: str) -> str:
    return "bigint" if field in COUNTS else "double"


SETTINGS_DDL = (
    "struct<outputWidth: bigint, outputHeight: bigint, " + ", ".join(f"{t}: double" for _, t, *_ in GLOBALS) + ", valueMode: string, singleChannel: string, markMode: string, curveSpan: string, "
    "syncCurveChannels: boolean, sharedConnectEndpoints: boolean, sharedSmoothSeamTangents: boolean, showBackground: boolean, geometryMode: string, sharedPreset: string, sharedPath: string, preserveAspect: boolean, "
    "treatment: string, detail: double, coverage: double, contrast: double, angle: double>"
)
DELTAS_DDL = "struct<" + ", ".join(f"{t}: {_type(f)}" for f, t, *_ in SHARED + MOTIF_SHARED) + "".join(f", {t}: string" for t in OVERRIDES.values()) + ">"
CHANNEL_DDL = (
    "struct<enabled: boolean, color: string, " + ", ".join(f"{t}: {_type(f)}" for f, t, *_ in ROTATION + CHANNEL + MOTIF) + ", preset: string, polygonSides: bigint, customPath: string, "
    "motifCoverageMode: string, alternateTileTransform: string, connectEndpoints: boolean, smoothSeamTangents: boolean>"
)
INKS_DDL = "struct<" + ", ".join(f"{k}: {CHANNEL_DDL}" for k in "cmyk") + ">"
PRESET_DDL = f"struct<format: string, version: bigint, name: string, settings: {SETTINGS_DDL}, cmykDeltas: {DELTAS_DDL}, channels: {INKS_DDL}, nativeRender: {D.RENDER_DDL}, render: {D.RENDER_DDL}, _bad: string>"


def _pick(value: str, names: dict[str, object]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{n}' THEN {v!r}" for n, v in names.items()) + " END"


def _among(value: str, names, message: str) -> str:
    return f"CASE WHEN {value} NOT IN ({', '.join(repr(n) for n in names)}) THEN {message} END"


def _unit(value: str) -> str:
    return f"if({value} > 1D, {value} / 100D, {value})"


def _number(given: str, rule: tuple) -> tuple[str, str]:
    """The value of a number by its rule, and what is wrong with it (null if nothing is), as SQL."""
    field, text, default, lo, hi, label = rule
    v = f"coalesce({given}.{text}, {default if field in COUNTS else f'{float(default)}D'})"
    if lo is None:
        return v, D._unless(D._finite(v), f"'Preset {label} is invalid'")
    v, lo, hi = (_unit(v), 0, 1) if lo == "unit" else (v, lo, hi)
    return v, f"CASE WHEN NOT {D._finite(v)} THEN 'Preset {label} is invalid' WHEN {v} NOT BETWEEN {float(lo)}D AND {float(hi)}D THEN 'Preset {label} is outside the supported range' END"


def _delta(deltas: str, rule: tuple) -> tuple[str, str]:
    """A delta or factor, neutral where absent, and what is wrong with it, as SQL."""
    field, text, how, least, label = rule
    v = f"coalesce({deltas}.{text}, {'0' if field in COUNTS else '1D' if how == '*' else '0D'})"
    if how == "+":
        return v, "NULL" if field in COUNTS else D._unless(D._finite(v), f"'Preset {label} is invalid'")
    return v, f"CASE WHEN NOT {D._finite(v)} THEN 'Preset {label} is invalid' WHEN NOT ({v} {least} 0D AND {v} <= 100D) THEN 'Preset {label} is outside the supported range' END"


def _laid(base: str, field: str, deltas: str) -> str:
    """A channel's value with the shared delta on it, as SQL."""
    rule = next((r for r in SHARED + MOTIF_SHARED if r[0] == field), None)
    if rule is None:
        return base
    v, _ = _delta(deltas, rule)
    if field == "threshold":
        return f"least(1D, greatest(0D, {base} + {v} / 100D))"
    if field == "opacity":
        return f"least(1D, greatest(0D, {base} * {v}))"
    return f"CAST({base} + {v} AS INT)" if field in COUNTS else f"{base} {rule[2]} {v}"


def _given(text: str) -> str:
    return f"CASE WHEN trim({text}) <> '' THEN {text} END"


def path_problem(q: str, closed: bool) -> str:
    """Why the path q (text t, commands ops, segments segs) is refused, null if it isn't, as SQL.

    A curve is one open path of 1 to 64 segments, a mark one closed path of 3 to 64.
    """
    kind = "custom shape" if closed else "curve"
    t, ops, n = f"{q}.t", f"{q}.ops", f"size({q}.segs)"
    number = curves.NUMBER.replace(chr(92), chr(92) * 2)
    stray = f"regexp_replace({t}, '{number}', '') RLIKE '[^MLHVCSQTZmlhvcsqtz, {chr(92) * 2}t{chr(92) * 2}r{chr(92) * 2}n]'"
    counted = f"forall({ops}, c -> if(upper(c.op) = 'Z', size(c.n) = 0, size(c.n) > 0 AND pmod(size(c.n), greatest(1, {curves.ARGUMENTS})) = 0))"
    uses = lambda op: f"size(filter({ops}, c -> upper(c.op) = '{op}'))"
    rules = [f"WHEN {t} RLIKE '[AaHhVvSsTt]' THEN 'Preset custom shape uses an unsupported SVG command'"] * closed
    rules += [
        f"WHEN {stray} OR NOT {counted} THEN 'Preset {kind} path is invalid'",
        f"WHEN coalesce(upper(get({ops}, 0).op), '') <> 'M' THEN 'Preset {kind} must begin with a move'",
        f"WHEN {uses('M')} > 1 OR {uses('Z')} > 1 THEN 'Preset {kind} must contain one {'closed' if closed else 'open'} path'",
    ]
    if closed:
        rules.append(f"WHEN upper(element_at({ops}, -1).op) <> 'Z' THEN 'Preset custom shape must be closed'")
        rules.append(f"WHEN {n} NOT BETWEEN 3 AND 64 THEN 'Preset custom shape has an unsupported number of segments' ELSE {D.shape_path_problem(f'{q}.closed')}")
    else:
        rules.append(f"WHEN {uses('Z')} > 0 THEN 'Closed preset curves are not available yet. Nothing was changed.'")
        rules.append(f"WHEN {n} NOT BETWEEN 1 AND 64 THEN 'Preset curve has an unsupported number of segments'")
    return f"CASE {' '.join(rules)} END"


def _at(of: str, x: str, y: str) -> str:
    return f"named_struct('x', {of}.{x}, 'y', {of}.{y})"


def _anchors(segs: str) -> str:
    """The anchors of a closed path: each segment's start with the controls on its two sides, as SQL."""
    before = f"get({segs}, CAST(pmod(i - 1, size({segs})) AS INT))"
    return f"named_struct('anchors', transform({segs}, (g, i) -> named_struct('point', {_at('g', 'x0', 'y0')}, 'incoming', {_at(before, 'c2x', 'c2y')}, 'outgoing', {_at('g', 'c1x', 'c1y')})))"


def _curve(segs: str) -> str:
    each = f"named_struct('control_1', {_at('g', 'c1x', 'c1y')}, 'control_2', {_at('g', 'c2x', 'c2y')}, 'end', {_at('g', 'x1', 'y1')})"
    return f"named_struct('start', {_at(f'get({segs}, 0)', 'x0', 'y0')}, 'segments', transform({segs}, g -> {each}))"


def _profile(name: str) -> str:
    return _pick(f"coalesce({name}, 'line')", PROFILES)


def _with_paths(d: DataFrame) -> DataFrame:
    """Adds `cut`, the paths a preset needs: at 0 the shared one, at 1 to 4 those of the inks; each as text,
    commands, segments and the settings' own form, closed for marks and open for curves."""

    def own(k: str) -> str:
        curve = f"CASE WHEN NOT synced AND chs['{k}'] IS NOT NULL THEN coalesce({_given(f'chs[{k!r}].customPath')}, {_profile(f'chs[{k!r}].preset')}) END"
        return f"CASE mode WHEN 'curve' THEN {curve} WHEN 'shape' THEN CASE WHEN NOT shared AND coalesce(chs['{k}'].enabled, true) THEN {_given(f'chs[{k!r}].customPath')} END END"

    common = f"CASE mode WHEN 'curve' THEN coalesce({_given('raw.sharedPath')}, {_profile('raw.sharedPreset')}) WHEN 'shape' THEN CASE WHEN shared THEN {_given('raw.sharedPath')} END END"
    d = d.withColumn("cut", F.expr(f"transform(array({', '.join([common, *map(own, 'cmyk')])}), t -> named_struct('t', t, 'ops', {curves.path_commands('t')}, 'segs', {curves.segment_array('t')}))"))
    last = "element_at(q.segs, -1)"
    # a mark's Z that is there already draws nothing
    idle = f"mode = 'shape' AND size(q.segs) > 0 AND upper(element_at(q.ops, -1).op) = 'Z' AND {last}.x0 = {last}.x1 AND {last}.y0 = {last}.y1"
    d = D._held(d.withColumn("cut", F.expr(f"transform(cut, q -> named_struct('t', q.t, 'ops', q.ops, 'segs', if({idle}, slice(q.segs, 1, greatest(0, size(q.segs) - 1)), q.segs)))")))
    d = D._held(d.withColumn("cut", F.expr(f"transform(cut, q -> named_struct('t', q.t, 'ops', q.ops, 'segs', q.segs, 'closed', CASE WHEN mode = 'shape' THEN {_anchors('q.segs')} END, 'open', CASE WHEN mode = 'curve' THEN {_curve('q.segs')} END))")))
    wrong = f"transform(cut, q -> CASE WHEN q.t IS NOT NULL THEN CASE mode WHEN 'shape' THEN {path_problem('q', True)} ELSE {path_problem('q', False)} END END)"
    return d.withColumn("path_problems", F.expr(wrong))


PLACE = "CAST(array_position(array('c', 'm', 'y', 'k'), {}) AS INT)"


def _channels(kind: str) -> str:
    """The channels of all inks: the four of the preset with the deltas laid on, the lights by default, as SQL."""
    numbers = {rule[0]: _laid(_number("r", rule)[0], rule[0], "deltas") for rule in (ROTATION + CHANNEL if kind == "shape" else CHANNEL + MOTIF)}
    path = f"get(cut, {PLACE.format('ink')})"
    new = numbers | {"enabled": "coalesce(r.enabled, true)", "color": f"coalesce(r.color, element_at(_{kind}_inks, ink).color)"}
    if kind == "shape":
        form = f"(CASE WHEN r IS NULL THEN 'circle' WHEN shared OR NOT coalesce(r.enabled, true) THEN shared_shape WHEN {path}.t IS NOT NULL THEN 'userdefined' ELSE coalesce(r.preset, 'circle') END)"
        new |= {"shape": form, "polygon_sides": f"CAST(greatest(3, least(6, coalesce(r.polygonSides, {_pick(form, SIDES)}, 4))) AS INT)"}
        new |= {"custom_shape_path": f"CASE WHEN r IS NOT NULL AND {path}.t IS NOT NULL THEN {path}.closed END"}
    else:
        for field, default, override in (("motif_coverage", "auto", "motifCoverageModeOverride"), ("alternate_tile_transform", "none", "alternateTileTransformOverride")):
            text = "motifCoverageMode" if field == "motif_coverage" else "alternateTileTransform"
            new[field] = f"coalesce(nullif(deltas.{override}, ''), r.{text}, '{default}')"
        new["path"] = f"CASE WHEN synced THEN get(cut, 0).open WHEN r IS NOT NULL THEN {path}.open ELSE _curve_channel.path END"
        new |= {"close_ends": "coalesce(if(synced, raw.sharedConnectEndpoints, r.connectEndpoints), false)", "smooth_join": "coalesce(if(synced, raw.sharedSmoothSeamTangents, r.smoothSeamTangents), false)"}
    fields = [f for f, _, _ in D.KINDS[kind][1]]
    four = f"transform_values(chs, (ink, r) -> {D._record({f: new.get(f, f'_{kind}_channel.{f}') for f in fields})})"
    return f"map_concat({four}, map_filter(_{kind}_inks, (ink, own) -> ink IN ('r', 'g', 'b')))"


def _built(kind: str) -> str:
    """The settings that a version 1 preset stands for, as SQL."""
    new = {f: _number("raw", rule)[0] for rule in GLOBALS for f in rule[:1]} | {"output_width": "out_w", "output_height": "out_h", "value_mode": "coalesce(raw.valueMode, 'cmyk')", "single_channel": _pick("coalesce(raw.singleChannel, 'k')", INK_NAMES)}
    if kind == "shape":
        path, given = "get(cut, 0)", "coalesce(raw.sharedPreset, 'circle')"
        sides = f"CASE WHEN shared AND {path}.t IS NULL THEN {_pick(given, SIDES)} ELSE 4 END"
        new |= {"use_shared_mark": "shared", "shared_shape": "shared_shape", "polygon_sides": f"CAST({sides} AS INT)", "custom_shape_path": f"CASE WHEN {path}.t IS NOT NULL THEN {path}.closed END"}
    else:
        new |= {"layout": "coalesce(raw.curveSpan, 'full-width')", "use_shared_curve": "synced", "shared_path": "get(cut, 0).open", "show_background": "coalesce(raw.showBackground, true)"}
        new |= {"shared_close_ends": "coalesce(raw.sharedConnectEndpoints, false)", "shared_smooth_join": "coalesce(raw.sharedSmoothSeamTangents, false)"}
    return D._record({f: new.get(f, f"_{kind}.{f}") for f, _, _ in D.KINDS[kind][0]} | {"base_channel": f"_{kind}_channel", "channels": _channels(kind)})


def _raw_reasons() -> list[str]:
    """What is wrong with a version 1 preset's own values, in the order in which they are read; nulls where nothing is."""
    per = lambda *e: f"coalesce({', '.join(e)})"
    quoted = lambda what, v: f"concat('This preset uses {what} ''', {v}, '''. Nothing was changed.')"
    path, wrong = f"get(cut, {PLACE.format('i.key')})", f"get(path_problems, {PLACE.format('i.key')})"
    color = "CASE WHEN NOT coalesce(i.value.color RLIKE '^#([0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$', true) THEN concat('Preset has an invalid ', element_at(labels, i.key), ' color') END"
    form = f"CASE WHEN mode = 'shape' AND NOT shared AND coalesce(i.value.enabled, true) AND {path}.t IS NULL THEN {_among('i.value.preset', SIDES, quoted('unknown shape', 'i.value.preset'))} END"
    profile = f"CASE WHEN mode = 'curve' AND NOT synced AND {_given('i.value.customPath')} IS NULL THEN {_among('i.value.preset', PROFILES, quoted('unknown curve profile', 'i.value.preset'))} END"
    own = {kind: per(*[_number("i.value", rule)[1] for rule in rules]) for kind, rules in (("shape", ROTATION + CHANNEL), ("curve", CHANNEL + MOTIF))}
    motif = per("NULL", _among("i.value.motifCoverageMode", COVERAGES, "concat('Preset has an unknown motif coverage mode ''', i.value.motifCoverageMode, '''')"), _among("i.value.alternateTileTransform", TRANSFORMS, "concat('Preset has an unknown alternate-copy transform ''', i.value.alternateTileTransform, '''')"))
    numbers = f"CASE mode WHEN 'shape' THEN {own['shape']} ELSE coalesce({own['curve']}, {motif}) END"
    ink = f"CASE WHEN i.value IS NOT NULL THEN {per(color, wrong, form, profile, numbers)} END"
    sized = "CASE WHEN out_h IS NULL THEN 'Source artwork has no usable size' WHEN mode = 'curve' AND (out_w NOT BETWEEN 32 AND 4000 OR out_h NOT BETWEEN 1 AND 4000) THEN 'Preset curve artboard is outside the supported range' WHEN out_w NOT BETWEEN 32 AND 4000 THEN 'Preset output width is outside the supported range' WHEN out_h NOT BETWEEN 1 AND 4000 THEN 'Preset output height is outside the supported range' END"
    lo, hi = (_number("raw", rule)[0] for rule in GLOBALS[2:])
    grid = f"CASE WHEN mode = 'shape' THEN {_number('raw', GLOBALS[1])[1]} END"
    counts = [f"CASE WHEN exists(chs_list, i -> {_number('i.value', rule)[0]} + coalesce(deltas.{text}, 0) NOT BETWEEN 1 AND 10000) THEN 'Preset {label} is outside the supported range' END" for rule in MOTIF for f, text, _, _, label in MOTIF_SHARED if f == rule[0] and f in COUNTS]
    override = [_among(f"nullif(deltas.{OVERRIDES[f]}, '')", names, f"concat('Preset has an unknown {what} ''', deltas.{OVERRIDES[f]}, '''')") for f, names, what in (("motif_coverage", COVERAGES, "motif coverage mode"), ("alternate_tile_transform", TRANSFORMS, "alternate-copy transform"))]
    return [
        "CASE WHEN raw.outputWidth < 0 OR raw.outputHeight < 0 OR exists(chs_list, i -> i.value.polygonSides NOT BETWEEN 0 AND 255) THEN 'unreadable field' END",
        _among("mode", ["shape", "curve"], quoted("unknown treatment mode", "mode")),
        f"CASE WHEN mode = 'shape' THEN {_among('raw.geometryMode', ['shared', 'independent'], quoted('unknown geometry', 'raw.geometryMode'))} END",
        f"CASE WHEN mode = 'curve' THEN {_among('raw.curveSpan', D.LAYOUTS, quoted('unsupported curve coverage', 'raw.curveSpan'))} END",
        f"CASE WHEN mode = 'shape' AND shared AND get(cut, 0).t IS NULL THEN {_among('raw.sharedPreset', SIDES, quoted('unknown shape', 'raw.sharedPreset'))} END",
        "CASE WHEN mode = 'shape' THEN get(path_problems, 0) END",
        sized,
        f"CASE WHEN mode = 'curve' THEN coalesce(CASE WHEN {_given('raw.sharedPath')} IS NULL THEN {_among('raw.sharedPreset', PROFILES, quoted('unknown curve profile', 'raw.sharedPreset'))} END, get(path_problems, 0)) END",
        f"get(filter(transform(chs_list, i -> {ink}), m -> m IS NOT NULL), 0)",
        _number("raw", GLOBALS[0])[1],
        grid,
        *[_number("raw", rule)[1] for rule in GLOBALS[2:]],
        _among("raw.valueMode", VALUE_MODES, "'Preset has an unknown color interpretation'"),
        _among("raw.singleChannel", INK_NAMES, "'Preset has an unknown output ink'"),
        f"CASE WHEN {lo} > {hi} THEN 'Preset mark range is invalid' END",
        *[_delta("deltas", rule)[1] for rule in SHARED],
        f"CASE WHEN mode = 'curve' THEN {per(*[_delta('deltas', rule)[1] for rule in MOTIF_SHARED], *counts, *override)} END",
    ]


def parse_presets(texts: DataFrame, fmt: str = FORMAT) -> DataFrame:
    """Presets of versions 1 and 2 as treatments: one row a text (preset_id, content; src_w and src_h of the artwork if known).

    variant says which of shape and curve holds the settings, with the deltas laid on every ink's own values; a native
    treatment (version 2) has its settings in native. canvas_aspect: the artboard the text names hasn't the artwork's proportions. reason is
    null for accepted presets, else the first thing wrong. Null and unreadable texts are rejected; a null value counts as absent.
    A preset that keeps the artwork's aspect (the default) needs its size.
    """
    size = {c: F.col(c).cast("bigint") if c in texts.columns else F.lit(None).cast("bigint") for c in ("src_w", "src_h")}
    d = texts.select("preset_id", *[v.alias(c) for c, v in size.items()], F.from_json("content", PRESET_DDL, {"columnNameOfCorruptRecord": "_bad"}).alias("j"))
    d = d.select("*", "j.version", F.col("j.settings").alias("raw"), F.col("j.cmykDeltas").alias("deltas"), F.expr("map('c', j.channels.c, 'm', j.channels.m, 'y', j.channels.y, 'k', j.channels.k)").alias("chs"))
    d = d.withColumns(
        {
            "chs_list": F.expr("map_entries(chs)"),
            "render": F.expr("CASE version WHEN 1 THEN j.nativeRender WHEN 2 THEN j.render END"),
            "mode": F.expr("CASE WHEN version = 1 AND j.nativeRender IS NULL THEN coalesce(raw.markMode, 'shape') END"),
            "shared": F.expr("coalesce(raw.geometryMode, 'shared') = 'shared'"),
            "synced": F.expr("coalesce(raw.syncCurveChannels, true)"),
            "out_w": F.expr("coalesce(raw.outputWidth, 900)"),
            "asked_h": F.expr("coalesce(raw.outputHeight, 600)"),
        }
    )
    aspect = "CASE WHEN src_w > 0 AND src_h > 0 THEN greatest(1, CAST(floor(out_w / (src_w / src_h) + 0.5D) AS BIGINT)) END"
    d = d.withColumn("out_h", F.expr(f"CASE WHEN coalesce(raw.preserveAspect, true) THEN {aspect} ELSE asked_h END"))
    d = D._held(D._with_constants(d).withColumn("labels", D._constant({k: name for k, (name, _, _) in D.INKS.items()}, "map<string, string>")))
    d = _with_paths(d).withColumn("shared_shape", F.expr(f"CASE WHEN NOT shared THEN 'circle' WHEN get(cut, 0).t IS NOT NULL THEN 'userdefined' WHEN coalesce(raw.sharedPreset, 'circle') = 'circle' THEN 'circle' ELSE 'regularpolygon' END"))
    d = D._held(d.withColumns({"variant": F.expr(f"coalesce(render.variant, CASE mode WHEN 'curve' THEN '{D.VARIANTS[2]}' WHEN 'shape' THEN '{D.VARIANTS[1]}' END)")}))
    told = lambda name, ddl: F.when(F.col("render.variant") == name, F.from_json(F.col("render.settings"), ddl))
    d = D._held(d.withColumns({"given_shape": told(D.VARIANTS[1], D.SHAPE_DDL), "given_curve": told(D.VARIANTS[2], D.CURVE_DDL)}))
    d = d.withColumn("raw_reason", F.expr(f"CASE WHEN mode IS NOT NULL THEN coalesce({', '.join(_raw_reasons())}) END"))
    d = D._held(d)
    d = D._held(d.withColumns({k: F.expr(f"CASE WHEN mode = '{k}' AND raw_reason IS NULL THEN {_built(k)} WHEN mode IS NULL THEN {D.with_defaults(f'given_{k}', k)} END") for k in D.KINDS}))
    sized = {k: D._sized(k, k) for k in D.KINDS}
    # a preset's own size counts as it is written, before the aspect is kept
    named = D._sized("named_struct('output_width', out_w, 'output_height', asked_h)", "shape")[1]
    d = D._held(d.withColumns({k: F.expr(new) for k, (new, _) in sized.items()} | {"canvas_aspect": F.expr(f"if(mode IS NULL, {' OR '.join(changed for _, changed in sized.values())}, {named})")}))
    d = d.withColumn("crosshatch_treatment", F.expr("coalesce(shape.value_mode = 'crosshatch-luminance', false)"))
    d = D._held(d.withColumns({"curve": F.expr(f"CASE WHEN crosshatch_treatment THEN {D.crosshatch_from_shape('shape')} ELSE curve END"), "variant": F.expr(f"if(crosshatch_treatment, '{D.VARIANTS[2]}', variant)")}))
    d = d.withColumns({"shape": F.expr("CASE WHEN NOT crosshatch_treatment THEN shape END"), "inks": F.expr("array('c', 'm', 'y', 'k')")})
    d = D._held(d)
    d = d.withColumn("problems", F.expr(f"filter(cast(concat({D.shape_problems('shape')}, {D.curve_problems('curve')}) AS array<string>), m -> m IS NOT NULL)"))
    unknown = lambda c, names, what: _among(c, names, f"concat('unknown {what} ', {c})")
    native = [f for f in ("treatment", *D.NATIVE)]
    reasons = [
        "CASE WHEN j.format IS NULL AND version IS NULL THEN 'unreadable' WHEN j.format IS NULL THEN 'missing format' END",
        f"CASE WHEN j.format <> '{fmt}' THEN 'not a {fmt}' WHEN version IS NULL THEN 'missing version' WHEN version NOT IN (1, 2) THEN concat('Unsupported treatment preset version ', version) WHEN j._bad IS NOT NULL THEN 'unreadable field' END",
        "CASE WHEN version = 2 AND render IS NULL THEN 'missing render' WHEN render IS NOT NULL AND variant IS NULL THEN 'missing variant' END",
        *[f"CASE WHEN version = 2 AND raw IS NOT NULL AND raw.{f} IS NULL THEN 'missing settings {f}' END" for f in native],
        unknown("render.variant", D.VARIANTS, "variant"),
        "raw_reason",
        *[f"CASE WHEN variant = '{v}' AND {k} IS NULL THEN 'missing {k} settings' END" for v, k in zip(D.VARIANTS[1:], D.KINDS)],
        *[unknown(f"{k}.value_mode", D.VALUE_MODES, "value mode") for k in D.KINDS],
        unknown("shape.shared_shape", D.SHAPES, "shape"),
        unknown("curve.layout", D.LAYOUTS, "layout"),
        "get(problems, 0)",
    ]
    absent = D._record({"treatment": "'dots'"} | {f: f"{v}D" for f, (v, _, _) in D.NATIVE.items()})
    given = D._sanitized("raw")
    return d.select("preset_id", "version", F.col("j.name").alias("name"), "variant", F.expr(f"CASE WHEN version = 2 THEN if(raw IS NULL, {absent}, {given}) END").alias("native"), "shape", "curve", "canvas_aspect", "crosshatch_treatment", "problems", F.expr(f"coalesce({', '.join(reasons)})").alias("reason"))


def read_presets(spark: SparkSession, path: str, fmt: str = FORMAT) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason) presets of the JSON files under path; they know no artwork."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("preset_id"), F.col("value").alias("content"))
    d = parse_presets(texts, fmt)
    return d.filter("reason IS NULL"), d.filter("reason IS NOT NULL").select("preset_id", "version", "reason", "problems")


def _text(*parts: str) -> str:
    return f"concat_ws(' ', {', '.join(parts)})"


def _numbers(*of: str) -> str:
    return _text(*[f"CAST({o}.{v} AS STRING)" for o in of for v in "xy"])


def shape_path_text(path: str) -> str:
    """A closed mark as path text, as SQL."""
    following = f"get({path}.anchors, CAST(pmod(i + 1, size({path}.anchors)) AS INT))"
    segs = f"transform({path}.anchors, (a, i) -> concat('C ', {_numbers('a.outgoing', f'{following}.incoming', f'{following}.point')}))"
    return _text("'M'", _numbers(f"get({path}.anchors, 0).point"), f"array_join({segs}, ' ')", "'Z'")


def curve_path_text(path: str) -> str:
    segs = f"transform({path}.segments, g -> concat('C ', {_numbers('g.control_1', 'g.control_2', 'g.end')}))"
    return _text("'M'", _numbers(f"{path}.start"), f"array_join({segs}, ' ')")


def _corners(nodes: str) -> str:
    """Straight-sided marks as anchors, each handle a third of the way to the neighbour, as SQL."""
    toward = lambda p, v: f"a.{v} + ({p}.{v} - a.{v}) / 3D"
    before, after = (f"get({nodes}, CAST(pmod(i {step} 1, size({nodes})) AS INT))" for step in "-+")
    handle = lambda p: f"named_struct('x', {toward(p, 'x')}, 'y', {toward(p, 'y')})"
    return f"named_struct('anchors', transform({nodes}, (a, i) -> named_struct('point', a, 'incoming', {handle(before)}, 'outgoing', {handle(after)})))"


def preset_json(presets: DataFrame, fmt: str = FORMAT, with_render: bool = True) -> DataFrame:
    """preset_id, content: accepted, named presets as JSON text. Shapes and curves are version 1, native treatments version 2.

    The values in force are written as every ink's own, with neutral deltas, so reading them lays nothing on twice; the
    whole treatment goes beside them (with_render). Without it, polygons of a shared mark are read as rectangles and scales of width and height are lost, as the form has no
    place for them, and values that deltas took out of an ink's own range are refused when read.
    """
    kept = presets.filter("reason IS NULL AND trim(name) <> ''").withColumn("custom", F.expr(f"coalesce(shape.custom_shape_path, {_corners('shape.custom_nodes')})"))
    ink = lambda c: _pick(c, {v: k for k, v in INK_NAMES.items()})
    form = lambda c: f"CASE {c} WHEN 'userdefined' THEN 'custom' WHEN 'regularpolygon' THEN 'rectangle' ELSE {c} END"
    neutral = D._record({t: ("0" if f in COUNTS else "1D" if how == "*" else "0D") for f, t, how, *_ in SHARED + MOTIF_SHARED} | {t: "''" for t in OVERRIDES.values()})
    size = {"outputWidth": "{s}.output_width", "outputHeight": "{s}.output_height", "longEdgeCells": "{s}.long_edge_cells", "minMark": "{s}.min_mark", "maxMark": "{s}.max_mark", "valueMode": "{s}.value_mode", "singleChannel": ink("{s}.single_channel"), "preserveAspect": "false"}
    tops = {
        "shape": {"markMode": "'shape'", "gridScale": "shape.grid_scale", "geometryMode": "if(shape.use_shared_mark, 'shared', 'independent')", "sharedPreset": form("shape.shared_shape"), "sharedPath": f"if(shape.shared_shape = 'userdefined', {shape_path_text('custom')}, '')"},
        "curve": {"markMode": "'curve'", "curveSpan": "curve.layout", "syncCurveChannels": "curve.use_shared_curve", "sharedConnectEndpoints": "curve.shared_close_ends", "sharedSmoothSeamTangents": "curve.shared_smooth_join", "showBackground": "curve.show_background", "sharedPreset": "'line'", "sharedPath": curve_path_text("curve.shared_path")},
    }
    channel = {
        "shape": {"preset": form("c.shape"), "polygonSides": "c.polygon_sides", "customPath": f"if(c.shape = 'userdefined', {shape_path_text('coalesce(c.custom_shape_path, custom)')}, '')"},
        "curve": {"preset": "'line'", "customPath": curve_path_text("c.path"), "motifCoverageMode": "c.motif_coverage", "alternateTileTransform": "c.alternate_tile_transform", "connectEndpoints": "c.close_ends", "smoothSeamTangents": "c.smooth_join"},
    }
    out = {}
    for kind, rules in (("shape", ROTATION + CHANNEL), ("curve", CHANNEL + MOTIF)):
        of = {"enabled": "c.enabled", "color": "c.color"} | {t: f"c.{f}" for f, t, *_ in rules} | channel[kind]
        inks = f"transform_values(map_filter({kind}.channels, (k, c) -> k IN ('c', 'm', 'y', 'k')), (k, c) -> {D._record(of)})"
        top = {t: e.replace("{s}", kind) for t, e in size.items()} | tops[kind]
        body = F.expr(f"to_json({D._record({'format': repr(fmt), 'version': '1', 'name': 'trim(name)', 'settings': D._record(top), 'cmykDeltas': neutral, 'channels': inks})})")
        beside = F.concat(F.lit(',"nativeRender":{"variant":"'), F.col("variant"), F.lit('","settings":'), F.to_json(kind), F.lit("}")) if with_render else F.lit("")
        out[kind] = F.concat(F.substring(body, F.lit(1), F.length(body) - 1), beside, F.lit("}"))
    plain = F.expr(f"to_json({D._record({'format': repr(fmt), 'version': '2', 'name': 'trim(name)', 'settings': 'native', 'render': D._record({'variant': 'variant'})})})")
    return kept.select("preset_id", F.when(F.col("shape").isNotNull(), out["shape"]).when(F.col("curve").isNotNull(), out["curve"]).otherwise(plain).alias("content"))
