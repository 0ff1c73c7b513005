"""Queries over settings, presets, documents, exports and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from screentone import fixtures as fx
from screentone.functions import formulas as X
from screentone.operators import marks, settings
from screentone.plans import shape_queries as sq
from screentone.sources import artwork, documents, presets
from screentone.streaming import requests

R, _sr = X.rounded, sq._sr


def _part(spark, sf, *cols):
    return spark.read.parquet(f"{sf}/part.parquet").selectExpr(*cols)


_PATHS = "concat('/art/', source, '/', CAST(doc_id AS STRING), CASE doc_id % 6 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.webp' WHEN 4 THEN '.svg' ELSE '' END)"


def a1_media_type(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", f"{_PATHS} AS path")
    return d.select("doc_id", artwork.media_type(F.col("path")).alias("media_type"))


def a3_probe_dimensions(spark, sf):
    c = "unhex(concat(CASE WHEN p_partkey % 9 = 0 THEN 'FFD8FF' ELSE '89504E470D0A1A0A' END, '0000000D49484452', lpad(hex(p_partkey * 7), 8, '0'), lpad(hex(p_size + 300), 8, '0')))"
    return artwork.probe_dimensions(_part(spark, sf, "p_partkey AS image_id", f"{c} AS content")).select("image_id", "width", "height")


def a5_svg_intrinsic_size(spark, sf):
    return sq._r(artwork.svg_intrinsic_size(fx.svg_texts(spark, sf)), ["text_id"], ["width", "height"])


def a6_parse_documents(spark, sf):
    d = artwork.parse_documents(fx.documents_json(spark, sf))
    return d.select("document_id", "accepted", "version", "name", "width", "surface", "output_mode")


def a7_parse_presets(spark, sf):
    return artwork.parse_presets(fx.preset_json(spark, sf)).drop("format")


def a8_decode_payload(spark, sf):
    return artwork.parse_documents(fx.documents_json(spark, sf)).select("document_id", F.col("payload").cast("string").alias("text"), F.base64("payload").alias("again"))


def a10_extract_path_data(spark, sf):
    return fx.svg_texts(spark, sf).select("text_id", artwork.extract_path_data(F.col("content")).alias("d"))


def a11_svg_texts(spark, sf):
    m = marks.native_marks(fx.pixels(spark, sf), sq._dims(spark, sf))
    docs = fx.images(spark, sf).withColumn("title", F.expr("concat('a<b & \"', CAST(image_id AS STRING))"))
    return artwork.svg_texts(m, marks.layers(fx.channels(spark)), docs)


def a14_plan_export_jobs(spark, sf):
    d = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS document_id", "o_orderkey % 3 = 0 AS separate")
    return artwork.plan_export_jobs(d, fx.channels(spark))


def a15_document_json(spark, sf):
    """Canonical JSON; key order is Spark's, so it is tested by a round trip."""
    return artwork.document_json(settings.migrate_documents(artwork.parse_documents(fx.documents_json(spark, sf)).filter("accepted")))


def a16_preset_json(spark, sf):
    """Presets written again; tested by a round trip."""
    return artwork.preset_json(artwork.parse_presets(fx.preset_json(spark, sf)).filter("accepted"))


_NAMES = "CASE WHEN o_orderkey % 7 = 0 THEN '***.png' ELSE concat(' ', o_orderpriority, '  Été_', CAST(o_orderkey AS STRING), '.final.PNG') END"


def a17_export_names(spark, sf):
    d = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS document_id", f"{_NAMES} AS name")
    return d.select("document_id", F.concat(artwork.export_name(F.col("name")), F.lit("-k")).alias("file"))


_RAW = "SELECT p_partkey AS preset_id, CASE p_partkey % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'm' ELSE 'k' END AS channel, CASE WHEN p_size % 2 = 0 THEN p_size / 50e0 END AS threshold, CASE WHEN p_size % 3 = 0 THEN 5e-1 END AS opacity FROM {}"


def b1_apply_channel_defaults(spark, sf):
    raw = spark.sql(_RAW.format("{part}"), part=spark.read.parquet(f"{sf}/part.parquet"))
    return settings.apply_channel_defaults(raw, fx.channels(spark).select("channel", "threshold", "opacity"), "preset_id", ["threshold", "opacity"])


_ENUM = "(VALUES ('cmyk', 0), ('luminance', 1), ('rgb', 2), ('single', 3)) AS t(name, code)"


def b2_decode_enums(spark, sf):
    p = artwork.parse_presets(fx.preset_json(spark, sf)).select("preset_id", "value_mode")
    good, bad = settings.decode_enums(p, "value_mode", spark.sql(f"SELECT * FROM {_ENUM}"))
    return good.select("preset_id", "value_mode", "code").unionByName(bad.withColumn("code", F.lit(None).cast("int")).select("preset_id", "value_mode", "code"))


def b3_unit_or_percent(spark, sf):
    return _part(spark, sf, "p_partkey AS preset_id", f"{R(settings.unit_or_percent('(p_partkey % 150 / 10e0 - 1e0)'))} AS share", f"{R(settings.unit_or_percent('(p_size * 3e0)'))} AS percent")


_RULES = "(VALUES ('min_mark', 0e0, 40e0, 'mark range'), ('max_mark', 1e0, 100e0, 'mark range'), ('output_width', 32e0, 4000e0, 'artboard')) AS t(field, lo, hi, message)"


def b4_validate_settings(spark, sf):
    p = artwork.parse_presets(fx.preset_json(spark, sf))
    return settings.validate_settings(p, spark.sql(f"SELECT * FROM {_RULES}"), "preset_id", ["min_mark", "max_mark", "output_width"])


_DELTAS = [
    "p_partkey AS preset_id",
    *[f"0e0 + p_size % {k} AS {c}_delta" for k, c in ((7, "rotation"), (5, "grid_rotation"), (3, "pivot_x"), (4, "pivot_y"), (6, "offset_x"), (8, "offset_y"))],
    *[f"5e-1 + p_size % {k} AS {c}_multiplier" for k, c in ((2, "scale"), (3, "resolution"), (4, "max_size"), (2, "opacity"))],
    "(p_size % 30 - 10) / 20e0 AS threshold_delta",
]
_DFIELDS = ["rotation", "grid_rotation", "pivot_x", "pivot_y", "offset_x", "offset_y", "scale", "resolution_scale", "max_size", "threshold", "opacity"]


def b7_apply_deltas(spark, sf):
    d = _part(spark, sf, *_DELTAS)
    c = d.select("preset_id").crossJoin(F.broadcast(fx.channels(spark)))
    return sq._r(settings.apply_deltas(c, d, "preset_id"), ["preset_id", "channel"], _DFIELDS)


_NATIVE = ["p_partkey AS preset_id", "CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_partkey % 300 - 50e0 END AS detail", "p_size * 5e0 AS coverage", "p_partkey % 400 - 100e0 AS contrast", "p_partkey % 800 - 400e0 AS angle"]


def b8_sanitize_settings(spark, sf):
    return settings.sanitize_settings(_part(spark, sf, *_NATIVE))


_ASPECT = ["p_partkey AS image_id", "CAST(p_partkey * 37 % 9000 AS BIGINT) - 50 AS requested", "CAST(1 + p_size * 13 AS BIGINT) AS src_w", "CAST(1 + p_partkey % 700 AS BIGINT) AS src_h"]


def b9_aspect_lock(spark, sf):
    return settings.aspect_lock(_part(spark, sf, *_ASPECT)).select("image_id", "lock_w", "lock_h")


_CANVAS = ["p_partkey AS image_id", "CAST(100 + p_size AS BIGINT) AS out_w", "CAST(90 + p_partkey % 60 AS BIGINT) AS out_h", "CAST(100 + p_size AS BIGINT) AS src_w", "CAST(90 + p_partkey % 30 AS BIGINT) AS src_h"]


_SAVED = ["CASE WHEN p_size % 3 = 0 THEN CAST(100 + p_size AS BIGINT) END AS shape_w", "CASE WHEN p_size % 3 = 0 THEN CAST(90 + p_partkey % 30 AS BIGINT) END AS shape_h", "CASE WHEN p_size % 5 = 0 THEN CAST(200 + p_partkey % 7 AS BIGINT) END AS curve_w", "CASE WHEN p_size % 5 = 0 THEN CAST(180 + p_size AS BIGINT) END AS curve_h"]


def b10_normalize_canvas(spark, sf):
    return settings.normalize_canvas(_part(spark, sf, *_CANVAS, *_SAVED)).select("image_id", "lock_w", "lock_h", "shape_w", "shape_h", "curve_w", "curve_h", "changed")


def b11_to_crosshatch(spark, sf):
    p = _part(spark, sf, "p_partkey AS preset_id", "CASE WHEN p_partkey % 3 = 0 THEN 'crosshatch' ELSE 'cmyk' END AS value_mode").crossJoin(F.broadcast(fx.channels(spark)))
    return settings.to_crosshatch(p, "preset_id")


def b12_migrate_documents(spark, sf):
    d = artwork.parse_documents(fx.documents_json(spark, sf)).filter("accepted")
    return settings.migrate_documents(d).select("document_id", "version", "surface", "output_mode", "filled_appearance", "filled_output_mode")


_MODES = ["p_partkey AS document_id", "CASE p_partkey % 4 WHEN 0 THEN 'cmyk' WHEN 1 THEN 'rgb' ELSE 'luminance' END AS value_mode", "CASE WHEN p_size % 2 = 0 THEN 'cmyk' ELSE 'rgb' END AS current_mode", "CASE WHEN p_size % 3 = 0 THEN concat('cache-', CAST(p_size AS STRING)) END AS cached_treatment", "concat('active-', CAST(p_partkey AS STRING)) AS active_treatment"]


def b13_resolve_output_mode(spark, sf):
    return settings.resolve_output_mode(_part(spark, sf, *_MODES)).select("document_id", "next_mode", "switched", "treatment")


_HEX = "CASE p_partkey % 4 WHEN 0 THEN concat('#', lpad(hex(p_partkey * 4099 % 16777216), 6, '0')) WHEN 1 THEN concat('#', lower(lpad(hex(p_partkey * 4099 % 16777216), 6, '0')), '7f') WHEN 2 THEN 'red' ELSE concat('#', CAST(p_size AS STRING)) END"


def b14_parse_hex_color(spark, sf):
    return _part(spark, sf, "p_partkey AS id", f"{_HEX} AS color").select("id", *settings.parse_hex_color("color"))


_LAYOUT = "CASE p_partkey % 6 WHEN 0 THEN ' Vertical' WHEN 1 THEN 'tile' WHEN 2 THEN 'MOTIF' WHEN 3 THEN 'row' WHEN 4 THEN 'full-height' END"


def b15_normalize_layout(spark, sf):
    return _part(spark, sf, "p_partkey AS id", f"{_LAYOUT} AS layout").select("id", settings.normalize_layout(F.col("layout")).alias("layout"))


_SIZES = ["p_partkey AS image_id", "10e0 + p_partkey * 11 % 20000 AS src_w", "10e0 + p_size * 300 AS src_h", "500e0 + p_partkey % 15000 AS max_dim", "72e0 + p_size AS dpi"]


def b16_plan_output_size(spark, sf):
    return settings.plan_output_size(_part(spark, sf, *_SIZES)).select("image_id", "fit_w", "fit_h", "inches_w", "ok")


_SHAPES = ["p_partkey AS id", "p_partkey % 4 = 0 AS use_shared", "'diamond' AS shared_shape", "CASE WHEN p_size % 5 = 0 THEN 'M 0 0 Z' END AS custom_path", "p_size % 7 AS nodes", "CASE WHEN p_partkey % 3 = 0 THEN 'square' END AS preset_shape"]


def b17_resolve_shapes(spark, sf):
    return settings.resolve_shapes(_part(spark, sf, *_SHAPES)).select("id", "shape")


def b18_describe_resolutions(spark, sf):
    return settings.describe_resolutions(fx.images(spark, sf).crossJoin(F.broadcast(fx.channels(spark))), "image_id")


def j1_latest_requests(spark, sf):
    return requests.latest_requests(fx.render_requests(spark, sf))


def _us(df, *cols):
    """Times as microseconds, which every engine writes alike."""
    return df.withColumns({c: F.unix_micros(c) for c in cols})


def j2_debounce(spark, sf):
    return _us(requests.debounce(fx.render_requests(spark, sf), "6 hours"), "first_ts", "last_ts")


def j3_coalesce_edits(spark, sf):
    return requests.coalesce_edits(fx.render_requests(spark, sf), "24 HOURS").withColumn("n", F.col("n"))


def j4_drop_stale(spark, sf):
    r = fx.render_requests(spark, sf)
    done = r.selectExpr("document_id", "generation", "value AS cost")
    return requests.drop_stale(done, requests.latest_requests(r))


_RESULT = "document_id, CAST(generation % 5 AS INT) AS version, CAST(floor(value) AS INT) AS max_dim, generation"


def j5_best_preview(spark, sf):
    return requests.best_preview(fx.render_requests(spark, sf).selectExpr(*[x.strip() for x in _RESULT.split(", ")]))


_n = X.number_text
_UNIT = lambda u: "CASE " + u + " " + " ".join(f"WHEN '{k}' THEN {f}" for k, f in artwork.UNITS.items()) + " ELSE 1e0 END"


def _svg_size(name: str, box: int) -> str:
    p = f"'<svg[^>]* {name}=\"([0-9.]+)(px|in|cm|mm|pt|pc)?\"'"
    return f"coalesce(CAST(nullif(regexp_extract(content, {p}, 1), '') AS DOUBLE) * ({_UNIT(f'regexp_extract(content, {p}, 2)')}), CAST(nullif(regexp_extract(content, 'viewBox=\"([-0-9.]+) ([-0-9.]+) ([-0-9.]+) ([-0-9.]+)\"', {box}), '') AS DOUBLE), 0e0)"


_PRESETS = (
    "SELECT preset_id, CAST(json_extract(content, '$.version') AS INT) AS version, coalesce(CAST(json_extract(content, '$.settings.minMark') AS DOUBLE), 0e0) AS min_mark, coalesce(CAST(json_extract(content, '$.settings.maxMark') AS DOUBLE), 100e0) AS max_mark, "
    "json_extract_string(content, '$.settings.valueMode') AS value_mode, CAST(json_extract(content, '$.settings.outputWidth') AS INT) AS output_width FROM preset_json"
)
_DOCS = (
    "SELECT document_id, json_extract_string(content, '$.format') = 'halftone-document' AS accepted, CAST(json_extract(content, '$.version') AS INT) AS version, json_extract_string(content, '$.source.name') AS name, json_extract_string(content, '$.source.bytes') AS bytes, "
    "CAST(json_extract(content, '$.width') AS INT) AS width, json_extract_string(content, '$.surface') AS surface, json_extract_string(content, '$.outputMode') AS output_mode FROM documents_json"
)
_ASP = settings.aspect_formulas("//")


def _canvas_sql() -> str:
    def lock(w: str, h: str, side: str) -> str:
        return _ASP[f"lock_{side}"].replace("requested", f"greatest({w}, {h})")

    pairs = {"lock": ("out_w", "out_h"), "shape": ("shape_w", "shape_h"), "curve": ("curve_w", "curve_h")}
    new = {f"{k}_{v}": f"CASE WHEN {w} IS NOT NULL THEN {lock(w, h, v)} END" for k, (w, h) in pairs.items() for v in "wh"}
    changed = " OR ".join(f"({w} IS NOT NULL AND ({new[f'{k}_w']} <> {w} OR {new[f'{k}_h']} <> {h}))" for k, (w, h) in pairs.items())
    return f"SELECT image_id, {', '.join(f'{v} AS {k}' for k, v in new.items())}, {changed} AS changed FROM (SELECT {', '.join(_CANVAS + _SAVED)} FROM part)"


# documents of all versions and variants from orders; what must come of each follows from its key
_DOC_KEY = "CAST(o_orderkey AS BIGINT)"
_DOC_JSON = (
    "CASE WHEN k % 23 = 0 THEN '{broken' ELSE concat('{\"format\":\"', CASE WHEN k % 17 = 0 THEN 'other' ELSE 'halftone-document' END, '\",\"version\":', CAST(1 + k % 6 AS STRING), ',\"document_id\":\"d', CAST(k AS STRING), '\",\"source\":{\"name\":\"a\",\"media_type\":\"image/png\",\"bytes\":\"', "
    "CASE WHEN k % 29 = 0 THEN '' ELSE base64(unhex(concat('89504E470D0A1A0A0000000D49484452', lpad(hex(16 * (1 + k % 5)), 8, '0'), '00000009'))) END, '\"},\"settings\":{\"treatment\":\"dots\",\"detail\":', CAST(k % 130 AS STRING), ',\"coverage\":50,\"contrast\":100,\"angle\":0},\"output_mode\":\"', "
    "CASE WHEN k % 2 = 0 THEN 'rgb-screen' ELSE 'cmyk-inks' END, '\",\"render\":', CASE k % 18 - k % 6 WHEN 0 THEN '{\"variant\":\"native-basic-v1\"}' WHEN 6 THEN concat('{\"variant\":\"web-shape-v1\",\"settings\":{\"output_width\":', CAST(100 + k % 900 AS STRING), ',\"output_height\":', CAST(100 + k % 700 AS STRING), ',\"value_mode\":\"', "
    "CASE WHEN k % 5 = 0 THEN 'crosshatch-luminance' ELSE 'luminance' END, '\",\"channels\":{\"c\":{},\"m\":{\"color\":\"', CASE WHEN k % 13 = 0 THEN '#12345' ELSE '#123456' END, '\"},\"y\":{},\"k\":{}}}}') ELSE concat('{\"variant\":\"web-curve-v1\",\"settings\":{\"long_edge_cells\":', CAST(k % 12000 AS STRING), '}}') END, "
    "CASE WHEN k % 4 = 0 THEN ',\"saved_web_shape\":{\"output_width\":800,\"output_height\":800}' ELSE '' END, '}') END"
)


def a18_document_union(spark, sf):
    texts = fx.spread(spark.read.parquet(f"{sf}/orders.parquet").selectExpr(f"{_DOC_KEY} AS k")).selectExpr("k AS text_id", f"{_DOC_JSON} AS content")
    d = documents.parse_documents(texts)
    settled = {"variant": "variant", "out_w": "coalesce(shape.output_width, curve.output_width)", "out_h": "coalesce(shape.output_height, curve.output_height)", "saved_h": "saved_shape.output_height", "detail": "settings.detail", "mode": "output_mode", "magenta": "coalesce(element_at(shape.channels, 'm').color, element_at(curve.channels, 'm').color)"}
    ok = {n: F.expr(f"CASE WHEN reason IS NULL THEN {e} END").alias(n) for n, e in settled.items()}
    return d.select("text_id", "reason", *ok.values(), *[F.expr(f"reason IS NULL AND {c}").alias(c) for c in ("canvas_aspect", "crosshatch_treatment", "filled_appearance", "filled_output_mode")])


def _document_sql() -> str:
    w, h = "CASE variant WHEN 'shape' THEN 100 + k % 900 ELSE 900 END", "CASE variant WHEN 'shape' THEN 100 + k % 700 ELSE 620 END"
    fit = "greatest(1, (longest * 9 + sw // 2) // sw)"
    saved_fit = "greatest(1, (800 * 9 + sw // 2) // sw)"
    reason = (
        "CASE WHEN k % 23 = 0 THEN 'unreadable' WHEN k % 17 = 0 THEN 'not a halftone-document' WHEN version = 6 THEN 'unsupported document version 6' "
        "WHEN k % 29 = 0 THEN 'document has no source artwork' "
        "WHEN variant = 'shape' AND NOT crossed AND k % 13 = 0 AND cmyk THEN 'invalid Magenta ink color' "
        "WHEN variant = 'shape' AND crossed AND k % 13 = 0 AND cmyk THEN 'Magenta curve channel value is outside the supported range' "
        "WHEN variant = 'curve' AND (k % 12000 < 2 OR k % 12000 > 10000) THEN 'web curve global setting is outside the supported range' END"
    )
    magenta = "CASE variant WHEN 'shape' THEN CASE WHEN k % 13 = 0 THEN '#12345' ELSE '#123456' END WHEN 'curve' THEN '#ec008c' END"
    name = "CASE WHEN variant = 'native' THEN 'native-basic-v1' WHEN variant = 'shape' AND NOT crossed THEN 'web-shape-v1' ELSE 'web-curve-v1' END"
    sized = f"((variant <> 'native' AND (ow <> longest OR oh <> {fit})) OR (saved AND {saved_fit} <> 800))"
    flags = {"canvas_aspect": sized, "crosshatch_treatment": "crossed", "filled_appearance": "version < 4", "filled_output_mode": "version < 5"}
    out = {"variant": name, "out_w": "CASE WHEN variant <> 'native' THEN longest END", "out_h": f"CASE WHEN variant <> 'native' THEN {fit} END", "saved_h": f"CASE WHEN saved THEN {saved_fit} END", "detail": "least(100e0, CAST(k % 130 AS DOUBLE))", "mode": "CASE WHEN cmyk THEN 'cmyk-inks' ELSE 'rgb-screen' END", "magenta": magenta}
    return (
        "WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS k, 1 + k % 6 AS version, 16 * (1 + k % 5) AS sw FROM orders), "
        "v AS (SELECT *, CASE WHEN version < 2 OR k % 18 - k % 6 = 0 THEN 'native' WHEN k % 18 - k % 6 = 6 THEN 'shape' ELSE 'curve' END AS variant, version < 5 OR k % 2 = 1 AS cmyk, version >= 3 AND k % 4 = 0 AS saved FROM o), "
        f"s AS (SELECT *, variant = 'shape' AND k % 5 = 0 AS crossed, {w} AS ow, {h} AS oh FROM v), l AS (SELECT *, greatest(ow, oh) AS longest FROM s), r AS (SELECT *, {reason} AS reason FROM l) "
        f"SELECT k AS text_id, reason, {', '.join(f'CASE WHEN reason IS NULL THEN {e} END AS {n}' for n, e in out.items())}, {', '.join(f'(reason IS NULL AND {e}) AS {n}' for n, e in flags.items())} FROM r"
    )


# presets of both versions from parts; what must come of each follows from its key
_PRESET_TEXT = (
    "CASE WHEN k % 31 = 0 THEN '{broken' WHEN k % 6 = 0 THEN concat('{\"format\":\"halftone-preset\",\"version\":2,\"name\":\"p\",\"settings\":{\"treatment\":\"lines\",\"detail\":', CAST(k % 130 AS STRING), ',\"coverage\":50,\"contrast\":100,\"angle\":0},\"render\":{\"variant\":\"native-basic-v1\"}}') "
    "ELSE concat('{\"format\":\"', CASE WHEN k % 29 = 0 THEN 'other' ELSE 'halftone-preset' END, '\",\"version\":', CASE WHEN k % 23 = 0 THEN '3' ELSE '1' END, ',\"name\":\"p', CAST(k AS STRING), '\",\"settings\":{\"markMode\":\"', CASE WHEN k % 6 >= 4 THEN 'curve' ELSE 'shape' END, "
    "'\",\"outputWidth\":', CAST(20 + k % 900 AS STRING), ',\"minMark\":', CAST(size AS STRING), ',\"maxMark\":', CAST(10 + k % 90 AS STRING), ',\"valueMode\":\"luminance\"', CASE k % 6 WHEN 2 THEN concat(',\"sharedPath\":\"M 0 0 L 1 0 L 0 1', CASE WHEN k % 4 = 0 THEN '' ELSE ' Z' END, '\"') "
    "WHEN 5 THEN concat(',\"sharedPreset\":\"', CASE WHEN k % 4 = 1 THEN 'zig' ELSE 'wave' END, '\"') ELSE '' END, '},\"cmykDeltas\":{\"scaleMultiplier\":1.5,\"thresholdDelta\":', CAST(k % 7 AS STRING), ',\"tileCountDelta\":', CAST(k % 5 - 3 AS STRING), '},\"channels\":{\"c\":{\"scale\":', CAST(k % 12 * 5e-1 AS STRING), "
    "',\"threshold\":', CAST(k % 40 AS STRING), '},\"m\":{},\"y\":{},\"k\":{\"opacity\":', CAST(k % 130 AS STRING), '}}}') END"
)


def _presets(spark, sf):
    texts = fx.spread(_part(spark, sf, "CAST(p_partkey AS BIGINT) AS k", "p_size AS size")).selectExpr("k AS preset_id", f"{_PRESET_TEXT} AS content", "16 * (1 + k % 5) AS src_w", "9 AS src_h")
    return presets.parse_presets(texts)


def a19_preset_union(spark, sf):
    """Presets of versions 1 and 2 with their deltas laid on, and why others are refused."""
    of = lambda k, f: f"coalesce(element_at(shape.channels, '{k}').{f}, element_at(curve.channels, '{k}').{f})"
    out = {"variant": "variant", "out_w": "coalesce(shape.output_width, curve.output_width)", "out_h": "coalesce(shape.output_height, curve.output_height)", "form": "coalesce(shape.shared_shape, concat('segments-', CAST(size(curve.shared_path.segments) AS STRING)))"}
    out |= {"cyan_scale": of("c", "scale"), "cyan_threshold": of("c", "threshold"), "black_opacity": of("k", "opacity"), "tiles": "CAST(element_at(curve.channels, 'y').tile_count AS BIGINT)", "detail": "native.detail"}
    return _presets(spark, sf).select("preset_id", "reason", *[F.expr(f"CASE WHEN reason IS NULL THEN {e} END").alias(n) for n, e in out.items()], F.expr("reason IS NULL AND canvas_aspect").alias("canvas_aspect"))


def a20_presets_again(spark, sf):
    """The inks of presets that were written with the values in force and read again: no delta is laid on twice.

    Values that the deltas took out of an ink's own range are refused on the second reading.
    """
    again = presets.parse_presets(presets.preset_json(_presets(spark, sf), with_render=False)).filter("reason IS NULL AND variant <> 'native-basic-v1'")
    cols = ["scale", "threshold", "opacity"]
    inks = {kind: again.filter(f"{kind} IS NOT NULL").select("preset_id", F.explode(f"{kind}.channels").alias("channel", "v")).select("preset_id", "channel", *[f"v.{c}" for c in cols]) for kind in ("shape", "curve")}
    return inks["shape"].unionByName(inks["curve"]).filter("channel IN ('c', 'm', 'y', 'k')")


def _preset_rows() -> str:
    """Common tables: r has every part's key, kind, size and reason."""
    reason = (
        "CASE WHEN k % 31 = 0 THEN 'unreadable' WHEN kind = 'native' THEN NULL WHEN k % 29 = 0 THEN 'not a halftone-preset' WHEN k % 23 = 0 THEN 'Unsupported treatment preset version 3' "
        "WHEN k % 6 = 2 AND k % 4 = 0 THEN 'Preset custom shape must be closed' WHEN ow < 32 AND kind = 'curve' THEN 'Preset curve artboard is outside the supported range' WHEN ow < 32 THEN 'Preset output width is outside the supported range' "
        "WHEN k % 6 = 5 AND k % 4 = 1 THEN 'This preset uses unknown curve profile ''zig''. Nothing was changed.' WHEN k % 12 = 11 THEN 'Preset coverage is outside the supported range' "
        "WHEN k % 130 > 100 THEN 'Preset opacity is outside the supported range' WHEN p_size > 10 + k % 90 THEN 'Preset mark range is invalid' WHEN kind = 'curve' AND k % 5 < 2 THEN 'Preset column count is outside the supported range' END"
    )
    share = lambda v: f"CASE WHEN {v} > 1 THEN {v} / 1e2 ELSE CAST({v} AS DOUBLE) END"
    laid = lambda base: f"least(1e0, greatest(0e0, {base} + CAST(k % 7 AS DOUBLE) / 1e2))"
    return (
        "WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS k, p_size, 20 + k % 900 AS ow, 16 * (1 + k % 5) AS sw, CASE WHEN k % 6 = 0 THEN 'native' WHEN k % 6 < 4 THEN 'shape' ELSE 'curve' END AS kind FROM part), "
        f"r AS (SELECT *, {reason} AS reason, {laid(share('(k % 40)'))} AS cyan_threshold, {laid('4e-2')} AS threshold, CAST(k % 12 AS DOUBLE) * 5e-1 * 15e-1 AS cyan_scale, {share('(k % 130)')} AS black_opacity FROM p)"
    )


def _preset_sql() -> str:
    made = "kind <> 'native'"
    out = {"variant": "CASE kind WHEN 'native' THEN 'native-basic-v1' WHEN 'shape' THEN 'web-shape-v1' ELSE 'web-curve-v1' END", "out_w": f"CASE WHEN {made} THEN ow END", "out_h": f"CASE WHEN {made} THEN greatest(1, (ow * 9 + sw // 2) // sw) END"}
    out |= {"form": "CASE WHEN k % 6 = 2 THEN 'userdefined' WHEN kind = 'shape' THEN 'circle' WHEN k % 6 = 5 THEN 'segments-2' WHEN kind = 'curve' THEN 'segments-1' END", "tiles": "CASE WHEN kind = 'curve' THEN k % 5 - 1 END", "detail": "CASE WHEN kind = 'native' THEN least(1e2, CAST(k % 130 AS DOUBLE)) END"}
    out |= {c: f"CASE WHEN {made} THEN {c} END" for c in ("cyan_scale", "cyan_threshold", "black_opacity")}
    return f"{_preset_rows()} SELECT k AS preset_id, reason, {', '.join(f'CASE WHEN reason IS NULL THEN {e} END AS {n}' for n, e in out.items())}, reason IS NULL AND {made} AS canvas_aspect FROM r"


def _again_sql() -> str:
    inks = "(VALUES ('c'), ('m'), ('y'), ('k')) AS i(channel)"
    return f"{_preset_rows()} SELECT k AS preset_id, channel, CASE WHEN channel = 'c' THEN cyan_scale ELSE 15e-1 END AS scale, CASE WHEN channel = 'c' THEN cyan_threshold ELSE threshold END AS threshold, CASE WHEN channel = 'k' THEN black_opacity ELSE 92e-2 END AS opacity FROM r, {inks} WHERE reason IS NULL AND kind <> 'native' AND cyan_scale <= 5"


_ISL = "PARTITION BY document_id ORDER BY ts, generation"

SQL = {
    "a1_media_type": f"SELECT doc_id, CASE WHEN lower(p) LIKE '%.png' THEN 'image/png' WHEN lower(p) LIKE '%.jpg' OR lower(p) LIKE '%.jpeg' THEN 'image/jpeg' WHEN lower(p) LIKE '%.webp' THEN 'image/webp' WHEN lower(p) LIKE '%.svg' THEN 'image/svg+xml' ELSE 'application/octet-stream' END AS media_type FROM (SELECT doc_id, {_PATHS} AS p FROM documents)",
    "a3_probe_dimensions": "SELECT p_partkey AS image_id, CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_partkey * 7 AS INT) END AS width, CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_size + 300 AS INT) END AS height FROM part",
    "a5_svg_intrinsic_size": fx.with_sql("svg_texts", f"SELECT text_id, {R(_svg_size('width', 3))} AS width, {R(_svg_size('height', 4))} AS height FROM svg_texts"),
    "a6_parse_documents": fx.with_sql("documents_json", "SELECT document_id, accepted, version, name, width, surface, output_mode FROM d", d=_DOCS),
    "a7_parse_presets": fx.with_sql("preset_json", "SELECT *, version IN (1, 2) AND min_mark <= max_mark AS accepted FROM p", p=_PRESETS),
    "a8_decode_payload": fx.with_sql("documents_json", "SELECT document_id, decode(from_base64(bytes)) AS text, bytes AS again FROM d", d=_DOCS),
    "a10_extract_path_data": fx.with_sql("svg_texts", "SELECT text_id, regexp_replace(regexp_extract(content, '<path[^>]* d=\"([^\"]*)\"', 1), '\\s*[Zz]\\s*$', '') AS d FROM svg_texts"),
    "a11_svg_texts": fx.with_sql(
        "pixels images channels",
        f"SELECT i.image_id, concat('<svg xmlns=\"http://www.w3.org/2000/svg\" viewBox=\"0 0 ', {_n('out_w')}, ' ', {_n('out_h')}, '\"><title>a&lt;b &amp; &quot;', CAST(i.image_id AS STRING), '</title>', coalesce(groups, ''), '</svg>') AS svg FROM images i LEFT JOIN gs ON i.image_id = gs.image_id",
        **sq.NATIVE,
        ly=f"SELECT image_id, channel, string_agg({artwork.mark_text()}, '' ORDER BY \"row\", col) AS body FROM nm GROUP BY 1, 2",
        gs=f"SELECT image_id, string_agg(concat('<g id=\"', channel, '\" fill=\"', lower(color), '\" fill-opacity=\"', {_n('opacity')}, '\" style=\"mix-blend-mode:multiply\">', body, '</g>'), '' ORDER BY ord) AS groups FROM ly JOIN channels USING (channel) WHERE enabled GROUP BY 1",
    ),
    "a14_plan_export_jobs": fx.with_sql("channels", "SELECT o_orderkey AS document_id, channel AS job FROM orders, channels WHERE enabled AND o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'combined' FROM orders WHERE o_orderkey % 3 <> 0"),
    "a17_export_names": f"SELECT o_orderkey AS document_id, concat(coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_replace({_NAMES}, '[.][^.]*$', '')), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'artwork'), '-k') AS file FROM orders",
    "b1_apply_channel_defaults": fx.with_sql("channels", "SELECT p.preset_id, c.channel, coalesce(r.threshold, c.threshold) AS threshold, coalesce(r.opacity, c.opacity) AS opacity FROM (SELECT DISTINCT preset_id FROM raw) p CROSS JOIN channels c LEFT JOIN raw r ON r.preset_id = p.preset_id AND r.channel = c.channel", raw=_RAW.format("part")),
    "b2_decode_enums": fx.with_sql("preset_json", f"SELECT preset_id, value_mode, code FROM p LEFT JOIN {_ENUM} ON name = value_mode", p=_PRESETS),
    "b3_unit_or_percent": f"SELECT p_partkey AS preset_id, {R(settings.unit_or_percent('(p_partkey % 150 / 10e0 - 1e0)'))} AS share, {R(settings.unit_or_percent('(p_size * 3e0)'))} AS percent FROM part",
    "b4_validate_settings": fx.with_sql("preset_json", f"SELECT preset_id, field, message FROM (SELECT preset_id, 'min_mark' AS f, min_mark AS v FROM p UNION ALL SELECT preset_id, 'max_mark', max_mark FROM p UNION ALL SELECT preset_id, 'output_width', output_width FROM p) JOIN {_RULES} ON f = field WHERE v < lo OR v > hi", p=_PRESETS),
    "b7_apply_deltas": fx.with_sql(
        "channels",
        "SELECT preset_id, channel, "
        + ", ".join(f"{R(f'{c} + {c}_delta')} AS {c}" for c in _DFIELDS[:6])
        + f", {R('scale * scale_multiplier')} AS scale, {R('resolution_scale * resolution_multiplier')} AS resolution_scale, {R('max_size * max_size_multiplier')} AS max_size, {R('least(1e0, greatest(0e0, threshold + threshold_delta))')} AS threshold, {R('least(1e0, greatest(0e0, opacity * opacity_multiplier))')} AS opacity FROM d, channels",
        d=f"SELECT {', '.join(_DELTAS)} FROM part",
    ),
    "b8_sanitize_settings": f"SELECT preset_id, {', '.join(f'coalesce(least({hi}e0, greatest({lo}e0, CASE WHEN {k} IS NOT NULL THEN {k} END)), {d}e0) AS {k}' if k != 'detail' else f'CASE WHEN detail IS NULL THEN {d}e0 ELSE least({hi}e0, greatest({lo}e0, detail)) END AS detail' for k, (d, lo, hi) in settings.NATIVE.items())} FROM (SELECT {', '.join(_NATIVE)} FROM part)",
    "b9_aspect_lock": f"SELECT image_id, {', '.join(f'{v} AS {k}' for k, v in _ASP.items())} FROM (SELECT {', '.join(_ASPECT)} FROM part)",
    "a18_document_union": _document_sql(),
    "a19_preset_union": _preset_sql(),
    "a20_presets_again": _again_sql(),
    "b10_normalize_canvas": _canvas_sql(),
    "b11_to_crosshatch": fx.with_sql("channels", "SELECT p_partkey AS preset_id, channel, CASE channel WHEN 'k' THEN 45e0 WHEN 'c' THEN -45e0 WHEN 'm' THEN 0e0 ELSE 90e0 END AS grid_rotation, true AS enabled, color, scale, threshold, max_size, resolution_scale, offset_x, offset_y, opacity FROM part, channels WHERE p_partkey % 3 = 0"),
    "b12_migrate_documents": fx.with_sql(
        "documents_json",
        "SELECT document_id, 5 AS version, CASE WHEN version < 4 THEN 'white' ELSE coalesce(surface, 'white') END AS surface, CASE WHEN version < 5 THEN 'cmyk' ELSE coalesce(output_mode, 'cmyk') END AS output_mode, version < 4 AS filled_appearance, version < 5 AS filled_output_mode FROM d WHERE version <= 5",
        d=_DOCS,
    ),
    "b13_resolve_output_mode": f"SELECT document_id, n AS next_mode, n <> current_mode AS switched, CASE WHEN n <> current_mode THEN coalesce(cached_treatment, active_treatment) ELSE active_treatment END AS treatment FROM (SELECT *, CASE WHEN value_mode IN ('cmyk', 'rgb') THEN value_mode ELSE current_mode END AS n FROM (SELECT {', '.join(_MODES)} FROM part))",
    "b14_parse_hex_color": "SELECT id, "
    + ", ".join(f"CASE WHEN regexp_full_match(color, '#([0-9A-Fa-f]{{6}}|[0-9A-Fa-f]{{8}})') THEN CAST(('0x' || substr(color, {i}, 2)) AS INT) END AS {n}" for n, i in (("red", 2), ("green", 4), ("blue", 6)))
    + f", CASE WHEN regexp_full_match(color, '#[0-9A-Fa-f]{{8}}') THEN CAST(('0x' || substr(color, 8, 2)) AS INT) END AS alpha FROM (SELECT p_partkey AS id, {_HEX.replace('lpad(hex(p_partkey * 4099 % 16777216)', 'lpad(upper(to_hex(p_partkey * 4099 % 16777216))')} AS color FROM part)",
    "b15_normalize_layout": f"SELECT id, CASE WHEN l IN ('full-height', 'vertical', 'column') THEN 'full-height' WHEN l IN ('motif', 'motif-pattern', 'pattern', 'tile') THEN 'motif-pattern' ELSE 'full-width' END AS layout FROM (SELECT p_partkey AS id, lower(trim({_LAYOUT})) AS l FROM part)",
    "b16_plan_output_size": f"SELECT image_id, fit_w, fit_h, {R('fit_w / dpi')} AS inches_w, fit_w * fit_h <= 64000000 AS ok FROM (SELECT *, CAST(greatest(1e0, floor(src_w * least(1e0, max_dim / greatest(src_w, src_h)) + 5e-1)) AS BIGINT) AS fit_w, CAST(greatest(1e0, floor(src_h * least(1e0, max_dim / greatest(src_w, src_h)) + 5e-1)) AS BIGINT) AS fit_h FROM (SELECT {', '.join(_SIZES)} FROM part))",
    "b17_resolve_shapes": f"SELECT id, CASE WHEN use_shared THEN shared_shape WHEN custom_path IS NOT NULL THEN custom_path WHEN nodes >= 3 THEN concat('polygon-', CAST(nodes AS STRING)) ELSE coalesce(preset_shape, 'circle') END AS shape FROM (SELECT {', '.join(_SHAPES)} FROM part)",
    "b18_describe_resolutions": fx.with_sql("images channels", "SELECT image_id, string_agg(concat(upper(channel), ' ', CAST(CAST(greatest(2e0, floor(cells * greatest(5e-2, resolution_scale) + 5e-1)) AS INT) AS STRING)), ', ' ORDER BY ord) AS summary FROM images, channels WHERE enabled GROUP BY 1"),
    "j1_latest_requests": fx.with_sql("render_requests", "SELECT document_id, max(generation) AS generation, arg_max(setting_key, generation) AS setting_key, arg_max(value, generation) AS value FROM render_requests GROUP BY 1"),
    "j2_debounce": fx.with_sql(
        "render_requests",
        "SELECT document_id, epoch_us(min(ts)) AS first_ts, epoch_us(max(ts)) AS last_ts, count(*) AS n, arg_max(generation, (ts, generation)) AS generation, arg_max(setting_key, (ts, generation)) AS setting_key FROM s GROUP BY document_id, k",
        i=f"SELECT *, CASE WHEN ts - lag(ts) OVER ({_ISL}) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM render_requests",
        s=f"SELECT *, sum(new) OVER ({_ISL} ROWS UNBOUNDED PRECEDING) AS k FROM i",
    ),
    "j3_coalesce_edits": fx.with_sql(
        "render_requests",
        "SELECT document_id, CAST(k AS BIGINT) AS gesture, min(setting_key) AS setting_key, arg_min(value, (ts, generation)) AS before, arg_max(value, (ts, generation)) AS after, count(*) AS n FROM s GROUP BY document_id, k HAVING count(*) = 1 OR arg_min(value, (ts, generation)) <> arg_max(value, (ts, generation))",
        i=f"SELECT *, CASE WHEN setting_key = lag(setting_key) OVER ({_ISL}) AND ts < lag(ts) OVER ({_ISL}) + INTERVAL 24 HOUR THEN 0 ELSE 1 END AS new FROM render_requests",
        s=f"SELECT *, sum(new) OVER ({_ISL} ROWS UNBOUNDED PRECEDING) AS k FROM i",
    ),
    "j4_drop_stale": fx.with_sql("render_requests", "SELECT document_id, generation, value AS cost FROM render_requests WHERE (document_id, generation) IN (SELECT document_id, max(generation) FROM render_requests GROUP BY 1)"),
    "j5_best_preview": fx.with_sql("render_requests", "SELECT document_id, version, max_dim, generation FROM q WHERE rn = 1", q=f"SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY version DESC, max_dim DESC, generation DESC) AS rn FROM (SELECT {_RESULT} FROM render_requests)"),
}
QUERIES = {name: globals()[name] for name in SQL} | {f.__name__: f for f in (a15_document_json, a16_preset_json)}
