"""Documents of versions 1 to 5 as a tagged union: read, migrated, validated, written.

A document's JSON is parsed once with a schema that all versions share; what depends on the version or the
variant is chosen by expressions. The variant's settings are kept as text until the variant is known, then parsed
by the schema it names. Everything is a projection over one row a document; nothing is shuffled.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screentone.sources.artwork import probe_dimensions

FORMAT = "halftone-document"
CURRENT = 5

# Names, defaults and inks of the settings as documents write them.
INKS = {"c": ("Cyan", "#00aeef", 15.0), "m": ("Magenta", "#ec008c", 75.0), "y": ("Yellow", "#ffd400", 0.0), "k": ("Black", "#111111", 45.0), "r": ("Red", "#ff0000", 0.0), "g": ("Green", "#00ff00", 0.0), "b": ("Blue", "#0000ff", 0.0)}
OUTPUT_INKS = {"cmyk-inks": ["c", "m", "y", "k"], "rgb-screen": ["r", "g", "b"]}
VALUE_MODES = ["cmyk", "rgb", "luminance", "crosshatch-luminance", "single-channel"]
SHAPES = ["circle", "regularpolygon", "userdefined", "rectangle", "triangle", "pentagon", "hexagon"]
VARIANTS = ["native-basic-v1", "web-shape-v1", "web-curve-v1"]
LAYOUTS = ["full-width", "motif-pattern"]
NATIVE = {"detail": (52.0, 0.0, 100.0), "coverage": (92.0, 0.0, 160.0), "contrast": (108.0, 0.0, 200.0), "angle": (0.0, -180.0, 180.0)}
CROSSHATCH_ANGLES = {"k": 45.0, "c": -45.0, "m": 0.0, "y": 90.0}
WHITE = {"kind": "color", "color": {"red": 255, "green": 255, "blue": 255, "alpha": 255}}

POINT = "struct<x: double, y: double>"
CLOSED = f"struct<anchors: array<struct<point: {POINT}, incoming: {POINT}, outgoing: {POINT}>>>"
CURVE_PATH = f"struct<start: {POINT}, segments: array<struct<control_1: {POINT}, control_2: {POINT}, end: {POINT}>>>"


def _point(x: float, y: float) -> dict:
    return {"x": x, "y": y}


def _path(start: tuple, *segments: tuple) -> dict:
    return {"start": _point(*start), "segments": [{"control_1": _point(*a), "control_2": _point(*b), "end": _point(*c)} for a, b, c in segments]}


# The default paths and nodes.
SOFT_WAVE = _path((-0.5, 0.0), ((-0.32, -0.12), (-0.18, -0.12), (0.0, 0.0)), ((0.18, 0.12), (0.32, 0.12), (0.5, 0.0)))
STRAIGHT = _path((-0.45, 0.0), ((-0.15, 0.0), (0.15, 0.0), (0.45, 0.0)))
SQUARE_NODES = [_point(x, y) for x, y in ((-0.45, -0.45), (0.45, -0.45), (0.45, 0.45), (-0.45, 0.45))]


def _doubles(**defaults: float) -> list[tuple[str, str, object]]:
    return [(f, "double", float(d)) for f, d in defaults.items()]


#: (field, type, default) of each settings record (fixed values); without a default a field is optional.
SHAPE_CHANNEL = [("enabled", "boolean", True), ("color", "string", "#111111")]
SHAPE_CHANNEL += _doubles(rotation=0, grid_rotation=0, grid_pivot_x=0, grid_pivot_y=0, scale=1, width_scale=1, height_scale=1, threshold=0, max_size=100, resolution_scale=1, offset_x=0, offset_y=0, opacity=1)
SHAPE_CHANNEL += [("shape", "string", "circle"), ("polygon_sides", "int", 4), ("custom_shape_path", CLOSED, None)]
CURVE_CHANNEL = [("enabled", "boolean", True), ("color", "string", "#111111")]
CURVE_CHANNEL += _doubles(grid_rotation=0, grid_pivot_x=0, grid_pivot_y=0, scale=1, threshold=0.04, max_size=100, resolution_scale=1, offset_x=0, offset_y=0, opacity=0.92, output_quality=1)
CURVE_CHANNEL += _doubles(curve_scale=32, motif_bleed=2, tile_spacing=0, tile_angle=0, tile_offset=0, stack_spacing=36, stack_angle=0, stack_offset=0, alternate_stack_offset=0)
CURVE_CHANNEL += [("motif_coverage", "string", "auto"), ("tile_count", "int", 2), ("stack_count", "int", 2), ("alternate_tile_transform", "string", "none"), ("path", CURVE_PATH, SOFT_WAVE), ("close_ends", "boolean", False), ("smooth_join", "boolean", False)]
SHAPE = [("output_width", "bigint", 900), ("output_height", "bigint", 620), *_doubles(long_edge_cells=92, grid_scale=92, min_mark=0, max_mark=85)]
SHAPE += [("value_mode", "string", "cmyk"), ("single_channel", "string", "black"), ("crosshatch_color", "string", "#111111"), ("use_shared_mark", "boolean", True), ("shared_shape", "string", "circle"), ("polygon_sides", "int", 4), ("custom_nodes", f"array<{POINT}>", SQUARE_NODES), ("custom_shape_path", CLOSED, None)]
CURVE = [("output_width", "bigint", 900), ("output_height", "bigint", 620), *_doubles(long_edge_cells=90, min_mark=0, max_mark=85)]
CURVE += [("value_mode", "string", "cmyk"), ("single_channel", "string", "black"), ("crosshatch_color", "string", "#111111"), ("layout", "string", "full-width"), ("use_shared_curve", "boolean", True), ("shared_path", CURVE_PATH, SOFT_WAVE), ("shared_close_ends", "boolean", False), ("shared_smooth_join", "boolean", False), ("show_background", "boolean", True)]


def _ddl(fields: list[tuple[str, str, object]], channel: list | None = None) -> str:
    more = [("base_channel", _ddl(channel)), ("channels", f"map<string, {_ddl(channel)}>")] if channel else []
    return f"struct<{', '.join(f'{n}: {t}' for n, t in [*((f[0], f[1]) for f in fields), *more])}>"


SHAPE_DDL, CURVE_DDL = _ddl(SHAPE, SHAPE_CHANNEL), _ddl(CURVE, CURVE_CHANNEL)
NATIVE_DDL = "struct<treatment: string, detail: double, coverage: double, contrast: double, angle: double>"
RENDER_DDL = "struct<variant: string, settings: string>"
SAVED_DDL = f"saved_web_shape: {SHAPE_DDL}, saved_web_curve: {CURVE_DDL}"
CACHE_DDL = f"struct<settings: {NATIVE_DDL}, render: {RENDER_DDL}, {SAVED_DDL}>"
SIDE_DDL = "struct<kind: string, color: struct<red: int, green: int, blue: int, alpha: int>>"
DOCUMENT_DDL = (
    f"struct<format: string, version: int, document_id: string, source: struct<name: string, media_type: string, bytes: string>, settings: {NATIVE_DDL}, "
    f"appearance: struct<preview_surface: {SIDE_DDL}, export_background: {SIDE_DDL}>, output_mode: string, render: {RENDER_DDL}, {SAVED_DDL}, "
    f"inactive_cmyk: {CACHE_DDL}, inactive_rgb: {CACHE_DDL}, _bad: string>"
)


def _constant(value: object, ddl: str) -> Column:
    """A literal of any type, given as JSON and folded once."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def _defaults(fields: list[tuple[str, str, object]]) -> Column:
    return _constant({f: d for f, _, d in fields if d is not None}, _ddl(fields))


def _record(values: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{f}', {v}" for f, v in values.items()) + ")"


def _filled(given: str, fields: list[tuple[str, str, object]], absent: str) -> dict[str, str]:
    return {f: f"{given}.{f}" if d is None else f"coalesce({given}.{f}, {absent}.{f})" for f, _, d in fields}


def _inks(fields: list[tuple[str, str, object]]) -> Column:
    """Every ink's channel by default, with its own colour and angle."""
    of = {ink: {f: d for f, _, d in fields if d is not None} | {"color": color, "grid_rotation": angle} for ink, (_, color, angle) in INKS.items()}
    return _constant(of, f"map<string, {_ddl(fields)}>")


def _held(df: DataFrame) -> DataFrame:
    """df with its columns computed here: later projections use them as they are instead of repeating their expressions."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


KINDS = {"shape": (SHAPE, SHAPE_CHANNEL), "curve": (CURVE, CURVE_CHANNEL)}


def _with_constants(df: DataFrame) -> DataFrame:
    """Adds the default records of both kinds as columns."""
    out = {}
    for kind, (fields, channel) in KINDS.items():
        out |= {f"_{kind}": _defaults(fields), f"_{kind}_channel": _defaults(channel), f"_{kind}_inks": _inks(channel)}
    return df.withColumns(out | {"_angles": _constant(CROSSHATCH_ANGLES, "map<string, double>"), "_straight": _constant(STRAIGHT, CURVE_PATH)})


def with_defaults(given: str, kind: str) -> str:
    """A settings record with the defaults of all absent fields and channels, as SQL; null stays null.

    Channels that are given without one of the four inks make the record null.
    """
    fields, channel = KINDS[kind]
    whole = " AND ".join(f"map_contains_key({given}.channels, '{k}')" for k in "cmyk")
    absent = f"if({given}.channels IS NULL, own, _{kind}_channel)"
    channels = f"transform_values(_{kind}_inks, (ink, own) -> {_record(_filled(f'try_element_at({given}.channels, ink)', channel, absent))})"
    base = _record(_filled(f"{given}.base_channel", channel, f"_{kind}_channel"))
    full = _record(_filled(given, fields, f"_{kind}") | {"base_channel": base, "channels": channels})
    return f"CASE WHEN {given} IS NOT NULL AND ({given}.channels IS NULL OR ({whole})) THEN {full} END"


def _finite(c: str) -> str:
    return f"coalesce(abs({c}) < double('infinity'), false)"


def _all(of: str, names: list[str]) -> str:
    return "(" + " AND ".join(_finite(f"{of}.{n}") for n in names) + ")"


#: Ranges a channel's values must keep: (field, least, most, whether the least itself is allowed) (fixed values).
SHAPE_RANGES = [("scale", 0, 100, True), ("width_scale", 0.01, 100, True), ("height_scale", 0.01, 100, True), ("threshold", 0, 1, True), ("max_size", 0, 10_000, True), ("opacity", 0, 1, True)]
RESOLUTION = [("resolution_scale", 0, 100, False)]
CURVE_RANGES = [("scale", 0, 100, True), ("threshold", 0, 1, True), ("max_size", 0, 10_000, True), ("resolution_scale", 0, 100, False), ("opacity", 0, 1, True), ("output_quality", 0, 100, False), ("curve_scale", 0.1, 500, True), ("motif_bleed", 0, 100, True), ("tile_count", 1, 10_000, True), ("tile_spacing", -10_000, 10_000, True), ("stack_count", 1, 10_000, True), ("stack_spacing", -10_000, 10_000, True)]


def _within(of: str, ranges: list[tuple]) -> str:
    return "(" + " AND ".join(f"{of}.{f} {'>=' if closed else '>'} {lo}D AND {of}.{f} <= {hi}D" for f, lo, hi, closed in ranges) + ")"


def nodes_problem(nodes: str) -> str:
    """Why the nodes of a mark are refused, null if they aren't."""
    cross = f"zip_with({nodes}, concat(slice({nodes}, 2, 1000000000), slice({nodes}, 1, 1)), (a, b) -> a.x * b.y - b.x * a.y)"
    return (
        f"CASE WHEN coalesce(size({nodes}), 0) < 3 THEN 'a user-defined mark needs at least three nodes' "
        f"WHEN NOT forall({nodes}, p -> {_finite('p.x')} AND {_finite('p.y')}) THEN 'user-defined mark contains an invalid node' "
        f"WHEN abs(aggregate({cross}, 0D, (acc, v) -> acc + v)) <= 1e-9D THEN 'user-defined mark has no usable area' END"
    )


def shape_path_problem(path: str) -> str:
    a = f"{path}.anchors"
    handles = " AND ".join(_finite(f"q.{h}.{v}") for h in ("incoming", "outgoing") for v in "xy")
    return (
        f"CASE WHEN {path} IS NULL THEN NULL WHEN coalesce(size({a}), 0) < 3 THEN 'a user-defined mark needs at least three nodes' "
        f"WHEN size({a}) > 64 THEN 'a user-defined mark supports at most 64 nodes' "
        f"ELSE coalesce({nodes_problem(f'transform({a}, q -> q.point)')}, CASE WHEN NOT forall({a}, q -> {handles}) THEN 'user-defined mark contains an invalid handle' END) END"
    )


def curve_path_problem(path: str) -> str:
    n = f"coalesce(size({path}.segments), 0)"
    points = " AND ".join(_finite(f"q.{h}.{v}") for h in ("control_1", "control_2", "end") for v in "xy")
    fine = f"coalesce({_finite(f'{path}.start.x')} AND {_finite(f'{path}.start.y')} AND forall({path}.segments, q -> {points}), false)"
    return f"CASE WHEN {n} < 1 OR {n} > 64 THEN 'curve must contain between 1 and 64 segments' WHEN NOT {fine} THEN 'curve contains an invalid point' END"


def _unless(ok: str, message: str) -> str:
    return f"CASE WHEN NOT coalesce({ok}, false) THEN {message} END"


def _by_ink(channels: str, rules: list[str]) -> str:
    """The rules about channel c of ink `label`, for each ink of the output mode in order."""
    made = f"transform(inks, k -> named_struct('c', element_at({channels}, k), 'label', element_at(labels, k)))"
    return f"flatten(transform({made}, i -> array({', '.join(rules)})))"


def shape_problems(s: str) -> str:
    """All messages about shape settings in the order of the rules, as SQL; nulls where a rule holds."""
    numbers = [f for f, t, _ in SHAPE_CHANNEL if t == "double"]
    first = [
        _unless(f"{s}.output_width > 0 AND {s}.output_height > 0", "'web shape artboard has no usable size'"),
        _unless(f"{s}.output_width <= 100000 AND {s}.output_height <= 100000", "'web shape artboard is too large'"),
        _unless(_all(s, ["long_edge_cells", "grid_scale", "min_mark", "max_mark"]), "'invalid web shape global setting'"),
        _unless(f"{s}.long_edge_cells BETWEEN 2D AND 10000D", "'web shape grid is outside the supported range'"),
        _unless(f"{s}.grid_scale > 0D AND {s}.grid_scale <= 1000D", "'web shape cell fill is outside the supported range'"),
        _unless(f"{s}.min_mark >= 0D AND {s}.max_mark >= {s}.min_mark AND {s}.max_mark <= 1000D", "'web shape mark range is outside the supported range'"),
        _unless(f"{_all(f'{s}.base_channel', numbers)} AND {_within(f'{s}.base_channel', SHAPE_RANGES + RESOLUTION)}", "'web shape base value is outside the supported range'"),
    ]
    ink = [
        _unless(_all("i.c", numbers), "concat('invalid ', i.label, ' channel setting')"),
        shape_path_problem("i.c.custom_shape_path"),
        _unless("i.c.color RLIKE '^#[0-9A-Fa-f]{6}$'", "concat('invalid ', i.label, ' ink color')"),
        _unless(_within("i.c", RESOLUTION), "concat('invalid ', i.label, ' channel resolution')"),
        _unless(_within("i.c", SHAPE_RANGES), "concat(i.label, ' channel value is outside the supported range')"),
    ]
    last = [
        _unless(f"{s}.polygon_sides BETWEEN 3 AND 6", "'regular polygon must have between 3 and 6 sides'"),
        nodes_problem(f"{s}.custom_nodes"),
        shape_path_problem(f"{s}.custom_shape_path"),
        f"CASE WHEN {s}.custom_shape_path IS NULL AND size({s}.custom_nodes) > 64 THEN 'a user-defined mark supports at most 64 nodes' END",
    ]
    return f"CASE WHEN {s} IS NULL THEN array() ELSE concat(array({', '.join(first)}), {_by_ink(f'{s}.channels', ink)}, array({', '.join(last)})) END"


def curve_problems(s: str) -> str:
    """All messages about curve settings in the order of the rules, as SQL; nulls where a rule holds."""
    numbers = [f for f, t, _ in CURVE_CHANNEL if t == "double"]
    cells = f"{_all(s, ['long_edge_cells', 'min_mark', 'max_mark'])} AND {s}.long_edge_cells BETWEEN 2D AND 10000D AND {s}.min_mark >= 0D AND {s}.max_mark >= {s}.min_mark AND {s}.max_mark <= 1000D"
    first = [
        _unless(f"{s}.output_width BETWEEN 1 AND 100000 AND {s}.output_height BETWEEN 1 AND 100000", "'web curve artboard is outside the supported range'"),
        _unless(cells, "'web curve global setting is outside the supported range'"),
        curve_path_problem(f"{s}.shared_path"),
        _unless(f"{_all(f'{s}.base_channel', numbers)} AND {_within(f'{s}.base_channel', CURVE_RANGES)}", "'web curve base value is outside the supported range'"),
    ]
    ink = [
        _unless(_all("i.c", numbers), "concat('invalid ', i.label, ' curve channel setting')"),
        _unless(f"i.c.color RLIKE '^#[0-9A-Fa-f]{{6}}$' AND {_within('i.c', CURVE_RANGES)}", "concat(i.label, ' curve channel value is outside the supported range')"),
        curve_path_problem("i.c.path"),
    ]
    return f"CASE WHEN {s} IS NULL THEN array() ELSE concat(array({', '.join(first)}), {_by_ink(f'{s}.channels', ink)}) END"


def _sanitized(given: str) -> str:
    clamp = {f: f"CASE WHEN {_finite(f'{given}.{f}')} THEN least({hi}D, greatest({lo}D, {given}.{f})) ELSE {d}D END" for f, (d, lo, hi) in NATIVE.items()}
    return _record({"treatment": f"{given}.treatment"} | clamp)


def _sized(s: str, kind: str) -> tuple[str, str]:
    """Settings with their artboard in the artwork's proportions, and whether that changed it."""
    long = f"CAST(least(100000, greatest(1, {s}.output_width, {s}.output_height)) AS BIGINT)"
    short = lambda a, b: f"least(100000, greatest(1, ({long} * {a} + {b} div 2) div {b}))"
    w, h = f"if(src_w >= src_h, {long}, {short('src_w', 'src_h')})", f"if(src_w >= src_h, {short('src_h', 'src_w')}, {long})"
    known = f"({s} IS NOT NULL AND coalesce(src_w, 0) > 0 AND coalesce(src_h, 0) > 0)"
    rest = [f for f, _, _ in KINDS[kind][0][2:]] + ["base_channel", "channels"]
    moved = _record({"output_width": w, "output_height": h} | {f: f"{s}.{f}" for f in rest})
    return f"CASE WHEN {known} THEN {moved} ELSE {s} END", f"coalesce({known} AND ({w} <> {s}.output_width OR {h} <> {s}.output_height), false)"


def crosshatch_from_shape(s: str) -> str:
    """The curve settings that a crosshatch of shapes becomes: straight layers at fixed angles, tones copied."""
    copied = ["color", "scale", "threshold", "max_size", "resolution_scale", "offset_x", "offset_y", "opacity"]
    new = {f: f"element_at({s}.channels, ink).{f}" for f in copied} | {"grid_rotation": "try_element_at(_angles, ink)", "path": "_straight"}
    channel = {f: f"CASE WHEN map_contains_key(_angles, ink) THEN {new[f]} ELSE own.{f} END" if f in new else f"own.{f}" for f, _, _ in CURVE_CHANNEL}
    fixed = {"value_mode": "'crosshatch-luminance'", "shared_path": "_straight"}
    fixed |= {f: f"{s}.{f}" for f in ("output_width", "output_height", "long_edge_cells", "min_mark", "max_mark", "single_channel", "crosshatch_color")}
    out = {f: fixed.get(f, f"_curve.{f}") for f, _, _ in CURVE}
    return _record(out | {"base_channel": "_curve_channel", "channels": f"transform_values(_curve_inks, (ink, own) -> {_record(channel)})"})


def parse_documents(texts: DataFrame, fmt: str = FORMAT) -> DataFrame:
    """Documents of the current version from JSON of versions 1 to 5: one row a text (text_id, content).

    reason is null for accepted documents, else the first thing wrong with a document; problems lists all that the rules say. Migration flags:
    canvas_aspect, crosshatch_treatment, filled_appearance, filled_output_mode. Null and unreadable texts are
    rejected; absent settings take their defaults, and a null value counts as absent.
    """
    d = texts.select("text_id", F.from_json("content", DOCUMENT_DDL, {"columnNameOfCorruptRecord": "_bad"}).alias("j"))
    d = d.withColumn("content", F.expr("unbase64(j.source.bytes)")).withColumn("version", F.col("j.version"))
    d = probe_dimensions(d).withColumnsRenamed({"content": "payload", "width": "src_w", "height": "src_h"})
    d = d.withColumn("variant", F.expr(f"coalesce(CASE WHEN version >= 2 THEN j.render.variant END, '{VARIANTS[0]}')"))
    named = lambda name, ddl: F.when(F.col("variant") == name, F.from_json(F.col("j.render.settings"), ddl))
    d = d.withColumns({"shape": named(VARIANTS[1], SHAPE_DDL), "curve": named(VARIANTS[2], CURVE_DDL)} | {f"saved_{k}": F.expr(f"CASE WHEN version >= 3 THEN j.saved_web_{k} END") for k in KINDS})
    kinds = {"shape": "shape", "curve": "curve", "saved_shape": "shape", "saved_curve": "curve"}
    d = _held(_held(_with_constants(d)).withColumns({name: F.expr(with_defaults(name, kind)) for name, kind in kinds.items()}))
    # the artboards take the artwork's proportions
    sized = {name: _sized(name, kind) for name, kind in kinds.items()}
    d = _held(d.withColumns({name: F.expr(new) for name, (new, _) in sized.items()} | {"canvas_aspect": F.expr(" OR ".join(changed for _, changed in sized.values()))}))
    # crosshatches of shapes become curves
    d = d.withColumns({"cross": F.expr("coalesce(shape.value_mode = 'crosshatch-luminance', false)"), "saved_cross": F.expr("coalesce(saved_shape.value_mode = 'crosshatch-luminance', false)")})
    d = d.withColumns(
        {
            "crosshatch_treatment": F.expr("cross OR saved_cross"),
            "curve": F.expr(f"CASE WHEN cross THEN {crosshatch_from_shape('shape')} ELSE curve END"),
            "variant": F.expr(f"CASE WHEN cross THEN '{VARIANTS[2]}' ELSE variant END"),
            "saved_shape": F.when(F.col("saved_cross"), F.col("saved_shape").withField("value_mode", F.lit("luminance"))).otherwise(F.col("saved_shape")),
        }
    )
    d = _held(d.withColumn("shape", F.expr("CASE WHEN NOT cross THEN shape END")))
    d = d.withColumns({"white": _constant(WHITE, SIDE_DDL), "none": _constant({"kind": "none"}, SIDE_DDL), "labels": _constant({k: name for k, (name, _, _) in INKS.items()}, "map<string, string>"), "modes": _constant(OUTPUT_INKS, "map<string, array<string>>")})
    d = d.withColumns(
        {
            "appearance": F.expr("CASE WHEN version < 4 THEN named_struct('preview_surface', white, 'export_background', white) ELSE coalesce(j.appearance, named_struct('preview_surface', white, 'export_background', none)) END"),
            "output_mode": F.expr("CASE WHEN version < 5 THEN 'cmyk-inks' ELSE coalesce(j.output_mode, 'cmyk-inks') END"),
            "settings": F.expr(_sanitized("j.settings")),
        }
        | {f"inactive_{k}": F.expr(f"CASE WHEN version >= 5 THEN j.inactive_{k} END") for k in ("cmyk", "rgb")}
    )
    d = _held(d.withColumn("inks", F.expr("coalesce(try_element_at(modes, output_mode), cast(array() AS array<string>))")))
    found = ["array(CASE WHEN NOT coalesce(octet_length(payload) > 0, false) THEN 'document has no source artwork' END)"]
    found += [f"cast({shape_problems(n) if k == 'shape' else curve_problems(n)} AS array<string>)" for n, k in kinds.items()]
    d = _held(d.withColumn("problems", F.expr(f"filter(concat({', '.join(found)}), m -> m IS NOT NULL)")))
    unknown = lambda c, names, what: f"CASE WHEN {c} NOT IN ({', '.join(repr(n) for n in names)}) THEN concat('unknown {what} ', {c}) END"
    needed = ["source", "source.name", "source.media_type", "source.bytes", "settings", "settings.treatment", "settings.detail", "settings.coverage", "settings.contrast", "settings.angle"]
    reasons = [
        "CASE WHEN j.format IS NULL AND version IS NULL THEN 'unreadable' WHEN j.format IS NULL THEN 'missing format' END",
        f"CASE WHEN j.format <> '{fmt}' THEN 'not a {fmt}' WHEN version IS NULL THEN 'missing version' END",
        f"CASE WHEN version NOT BETWEEN 1 AND {CURRENT} THEN concat('unsupported document version ', version) WHEN j._bad IS NOT NULL THEN 'unreadable field' END",
        *[f"CASE WHEN j.{n} IS NULL THEN 'missing {n.replace('.', ' ')}' END" for n in needed],
        unknown("variant", VARIANTS, "variant"),
        *[f"CASE WHEN variant = '{v}' AND {k} IS NULL THEN 'missing {k} settings' END" for v, k in zip(VARIANTS[1:], KINDS)],
        *[f"CASE WHEN version >= 3 AND j.saved_web_{k} IS NOT NULL AND saved_{k} IS NULL THEN 'missing saved {k} settings' END" for k in KINDS],
        unknown("output_mode", OUTPUT_INKS, "output mode"),
        *[unknown(f"{n}.value_mode", VALUE_MODES, "value mode") for n in kinds],
        unknown("shape.shared_shape", SHAPES, "shape"),
        unknown("curve.layout", LAYOUTS, "layout"),
        "get(problems, 0)",
    ]
    names = ["payload", "settings", "appearance", "output_mode", "variant", *kinds, "inactive_cmyk", "inactive_rgb", "canvas_aspect", "crosshatch_treatment"]
    flags = [F.expr(f"coalesce(version < {v}, false)").alias(f"filled_{n}") for n, v in (("appearance", 4), ("output_mode", 5))]
    given = [F.expr("coalesce(j.document_id, concat('legacy-', text_id))").alias("document_id"), F.col("version").alias("version_read"), F.col("j.source.name").alias("name"), F.col("j.source.media_type").alias("media_type")]
    return d.select("text_id", *given, *names, *flags, "problems", F.expr(f"coalesce({', '.join(reasons)})").alias("reason"))


def read_documents(spark: SparkSession, path: str, fmt: str = FORMAT) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason) documents of the JSON files under path."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("text_id"), F.col("value").alias("content"))
    d = parse_documents(texts, fmt)
    return d.filter("reason IS NULL"), d.filter("reason IS NOT NULL").select("text_id", "version_read", "reason", "problems")


def document_json(docs: DataFrame, fmt: str = FORMAT) -> DataFrame:
    """text_id, content: accepted documents as JSON of the current version; optional records are left out where null."""
    shape, curve = F.to_json("shape"), F.to_json("curve")
    body = F.coalesce(shape, curve)
    render = F.concat(F.lit('{"variant":"'), F.col("variant"), F.lit('"'), F.coalesce(F.concat(F.lit(',"settings":'), body), F.lit("")), F.lit("}"))
    head = F.to_json(
        F.struct(
            F.lit(fmt).alias("format"),
            F.lit(CURRENT).alias("version"),
            "document_id",
            F.struct("name", "media_type", F.base64("payload").alias("bytes")).alias("source"),
            "settings",
            "appearance",
            "output_mode",
            F.col("saved_shape").alias("saved_web_shape"),
            F.col("saved_curve").alias("saved_web_curve"),
        )
    )
    cache = lambda name: F.coalesce(F.concat(F.lit(f',"{name}":'), _cache_json(F.col(name))), F.lit(""))
    whole = F.concat(F.substring(head, 1, F.length(head) - 1), F.lit(',"render":'), render, cache("inactive_cmyk"), cache("inactive_rgb"), F.lit("}"))
    return docs.filter("reason IS NULL").select("text_id", whole.alias("content"))


def _cache_json(c: Column) -> Column:
    """A cached treatment: its variant's settings are kept as text, so they are put in as they are."""
    render = F.concat(F.lit('{"variant":"'), c["render"]["variant"], F.lit('"'), F.coalesce(F.concat(F.lit(',"settings":'), c["render"]["settings"]), F.lit("")), F.lit("}"))
    head = F.to_json(F.struct(c["settings"].alias("settings"), c["saved_web_shape"].alias("saved_web_shape"), c["saved_web_curve"].alias("saved_web_curve")))
    return F.when(c.isNotNull(), F.concat(F.substring(head, 1, F.length(head) - 1), F.lit(',"render":'), F.coalesce(render, F.lit('{"variant":"native-basic-v1"}')), F.lit("}")))
