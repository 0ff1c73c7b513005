"""Artwork, preset and document scans; SVG, raster, document and preset sinks."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screentone.functions import formulas as X
from screentone.operators.marks import xml_escape


def media_type(path: Column) -> Column:
    ext = F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1)
    return F.when(ext == "png", "image/png").when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "webp", "image/webp").when(ext == "svg", "image/svg+xml").otherwise("application/octet-stream")


def read_artwork(spark: SparkSession, path: str) -> DataFrame:
    """name, media_type, content of every file under path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), media_type(F.col("path")).alias("media_type"), "content")


def image_to_pixels(images: DataFrame) -> DataFrame:
    """Pixel rows of Spark's image source: image_id (its origin), x, y, r, g, b, a.

    Bytes come as gray, BGR or BGRA, row by row; each image is exploded in its own batch.
    """

    def run(batches):
        import numpy as np

        for b in batches:
            for origin, h, w, n, data in zip(*(b.column(i).to_pylist() for i in range(5))):
                v = np.frombuffer(data, dtype=np.uint8).reshape(h * w, n).astype(np.int32)
                rgb = [v[:, 0]] * 3 if n == 1 else [v[:, 2], v[:, 1], v[:, 0]]
                alpha = v[:, 3] if n == 4 else np.full(h * w, 255, np.int32)
                at = np.arange(h * w, dtype=np.int32)
                for lo in range(0, h * w, 1 << 20):
                    s = slice(lo, lo + (1 << 20))
                    yield pa.record_batch([pa.array([origin] * len(at[s])), *(pa.array(c[s]) for c in (at % w, at // w, *rgb, alpha))], names=["image_id", "x", "y", "r", "g", "b", "a"])

    d = images.filter("image.height > 0").select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return d.mapInArrow(run, "image_id string, x int, y int, r int, g int, b int, a int")


def probe_dimensions(artwork: DataFrame) -> DataFrame:
    """Adds width, height from a PNG's header bytes (null for other content)."""
    at = lambda i: F.expr(f"CASE WHEN hex(substring(content, 1, 8)) = '89504E470D0A1A0A' THEN CAST(conv(hex(substring(content, {i}, 4)), 16, 10) AS INT) END")
    return artwork.withColumns({"width": at(17), "height": at(21)})


def probe_physical_size(artwork: DataFrame) -> DataFrame:
    """Adds dpi: from a PNG's pHYs chunk (per metre) or a JPEG's JFIF segment, else 96 (null and broken files too).

    Chunks and segments are walked by their lengths, up to the image data; bytes inside a payload never count.
    """

    @F.pandas_udf("double")
    def probe(content: pd.Series) -> pd.Series:
        return content.map(lambda b: physical_size(bytes(b or b"")) or 96.0).astype("float64")

    return artwork.withColumn("dpi", probe("content"))


def physical_size(b: bytes) -> float | None:
    """Dots an inch that the headers of a PNG or JPEG state, if they do."""
    whole = lambda at, n: int.from_bytes(b[at : at + n], "big")
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 12 <= len(b) and b[at + 4 : at + 8] not in (b"IDAT", b"IEND"):
            if b[at + 4 : at + 8] == b"pHYs":
                return whole(at + 8, 4) * 0.0254 if b[at + 16 : at + 17] == b"\x01" else None
            at += 12 + whole(at, 4)
    elif b[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(b) and b[at] == 255 and b[at + 1] != 0xDA:
            if b[at + 1] == 0xE0 and b[at + 4 : at + 9] == b"JFIF\0":
                unit = b[at + 11 : at + 12]
                return whole(at + 12, 2) * {b"\x01": 1.0, b"\x02": 2.54}.get(unit, 0.0)
            at += 2 + whole(at + 2, 2)
    return None


#: CSS pixels of one unit (fixed values).
UNITS = {"px": "1e0", "in": "96e0", "cm": "96e0 / 254e-2", "mm": "96e0 / 254e-1", "pt": "96e0 / 72e0", "pc": "16e0"}


def svg_intrinsic_size(texts: DataFrame) -> DataFrame:
    """Adds width, height in pixels: the attributes with their unit, else the view box, else 0."""

    def size(name: str, box: int) -> str:
        v = f"regexp_extract(content, '<svg[^>]* {name}=\"([0-9.]+)(px|in|cm|mm|pt|pc)?\"', 1)"
        u = f"regexp_extract(content, '<svg[^>]* {name}=\"([0-9.]+)(px|in|cm|mm|pt|pc)?\"', 2)"
        unit = "CASE " + u + " " + " ".join(f"WHEN '{k}' THEN {f}" for k, f in UNITS.items()) + " ELSE 1e0 END"
        view = f"regexp_extract(content, 'viewBox=\"([-0-9.]+) ([-0-9.]+) ([-0-9.]+) ([-0-9.]+)\"', {box})"
        return f"coalesce(CAST(nullif({v}, '') AS DOUBLE) * ({unit}), CAST(nullif({view}, '') AS DOUBLE), 0e0)"

    return texts.withColumns({"width": F.expr(size("width", 3)), "height": F.expr(size("height", 4))})


def extract_path_data(content: Column) -> Column:
    """The first path's d attribute, without a closing Z at its end."""
    return F.regexp_replace(F.regexp_extract(content, '<path[^>]* d="([^"]*)"', 1), r"\s*[Zz]\s*$", "")


DOCUMENT_SCHEMA = "format string, version int, source struct<name: string, bytes: string>, width int, surface string, outputMode string"
PRESET_SCHEMA = "format string, version int, settings struct<minMark: double, maxMark: double, valueMode: string, outputWidth: int>"


def parse_documents(texts: DataFrame, fmt: str = "halftone-document") -> DataFrame:
    """JSON documents as columns; other formats and unreadable text give accepted = false."""
    d = texts.withColumn("j", F.from_json("content", DOCUMENT_SCHEMA))
    return d.select("document_id", F.coalesce(F.col("j.format") == fmt, F.lit(False)).alias("accepted"), "j.version", F.col("j.source.name").alias("name"), F.unbase64("j.source.bytes").alias("payload"), "j.width", "j.surface", F.col("j.outputMode").alias("output_mode"))


def read_documents(spark: SparkSession, path: str, fmt: str = "halftone-document") -> DataFrame:
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("document_id"), F.col("value").alias("content"))
    return parse_documents(texts, fmt)


def parse_presets(texts: DataFrame, fmt: str = "halftone-preset") -> DataFrame:
    """JSON presets as columns, absent marks by default; accepted: known format, version 1 or 2, min <= max."""
    d = texts.withColumn("j", F.from_json("content", PRESET_SCHEMA))
    d = d.select("preset_id", F.col("j.format").alias("format"), "j.version", F.coalesce("j.settings.minMark", F.lit(0.0)).alias("min_mark"), F.coalesce("j.settings.maxMark", F.lit(100.0)).alias("max_mark"), F.col("j.settings.valueMode").alias("value_mode"), F.col("j.settings.outputWidth").alias("output_width"))
    return d.withColumn("accepted", F.coalesce((F.col("format") == fmt) & F.col("version").isin(1, 2) & (F.col("min_mark") <= F.col("max_mark")), F.lit(False)))


def read_presets(spark: SparkSession, path: str, fmt: str = "halftone-preset") -> DataFrame:
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("preset_id"), F.col("value").alias("content"))
    return parse_presets(texts, fmt)


_NODE = "struct<position: struct<x: double, y: double>, handleIn: struct<x: double, y: double>, handleOut: struct<x: double, y: double>, pairConstraint: string, handleInBehavior: string, handleOutBehavior: string>"
_PATHS = f"paths: array<struct<id: string, closed: boolean, nodes: array<{_NODE}>>>"
EDITOR_SCHEMA = f"struct<document: struct<{_PATHS}>, {_PATHS}>"


def _settled_node(n: str) -> str:
    """A node whose handles obey its pair constraint, as SQL: one direction (the outgoing one's), lengths kept or, if symmetrical, shared."""
    x = {f"{h}{v}": f"coalesce({n}.handle{h}.{v}, 0D)" for h in ("In", "Out") for v in "xy"}
    li, lo = (f"sqrt({x[h + 'x']} * {x[h + 'x']} + {x[h + 'y']} * {x[h + 'y']})" for h in ("In", "Out"))
    shared = f"if({li} > 0D AND {lo} > 0D, ({li} + {lo}) / 2D, greatest({li}, {lo}))"
    toward = {v: f"CASE WHEN {lo} > 0D THEN {x['Out' + v]} / {lo} WHEN {li} > 0D THEN -{x['In' + v]} / {li} ELSE 0D END" for v in "xy"}

    def handle(h: str, own: str, sign: str) -> str:
        size = f"if({n}.pairConstraint = 'symmetrical', {shared}, {own})"
        return ", ".join(f"'{v}', CASE WHEN {n}.pairConstraint IN ('smooth', 'symmetrical') THEN {sign}({toward[v]}) * {size} ELSE {x[h + v]} END" for v in "xy")

    place = ", ".join(f"'{v}', coalesce({n}.position.{v}, 0D)" for v in "xy")
    return f"named_struct('at', named_struct({place}), 'into', named_struct({handle('In', li, '-')}), 'out', named_struct({handle('Out', lo, '')}), 'in_line', {n}.handleInBehavior <=> 'vector', 'out_line', {n}.handleOutBehavior <=> 'vector')"


def import_editor_paths(texts: DataFrame) -> DataFrame:
    """Cubic segments of the first usable path of an editor's JSON: the first that says it is open and has two nodes, else the first with two.

    Handles obey their node's pair constraint before they become absolute controls, in thousandths; missing ones count as none. Between two
    vector handles lies a line; closed paths end with the segment back to their start. text_id, seg, x0..y1.
    """
    j = F.from_json("content", EDITOR_SCHEMA)
    d = texts.select("text_id", F.posexplode(F.coalesce(j["document"]["paths"], j["paths"])).alias("place", "p")).filter("size(p.nodes) >= 2")
    first = d.groupBy("text_id").agg(F.min_by("p", F.struct(F.expr("NOT (p.closed <=> false)"), "place")).alias("p"))
    first = first.select("text_id", F.expr("coalesce(p.closed, false)").alias("closed"), F.expr(f"transform(p.nodes, n -> {_settled_node('n')})").alias("nodes"))
    n = first.select("text_id", F.posexplode("nodes").alias("seg", "n"), F.expr("if(closed, concat(nodes, slice(nodes, 1, 1)), nodes)").alias("all"))
    n = n.withColumn("m", F.get("all", F.col("seg") + 1)).filter("m IS NOT NULL")
    told = lambda e: f"floor(({e}) * 1000D + 0.5D) / 1000D"
    ends = {f"{v}{i}": told(f"{of}.at.{v}") for i, of in enumerate("nm") for v in "xy"}
    line = lambda v, share: f"{ends[v + '0']} + ({ends[v + '1']} - {ends[v + '0']}) * {share}D / 3D"
    controls = {f"c1{v}": f"if(n.out_line AND m.in_line, {line(v, 1)}, {told(f'n.at.{v} + n.out.{v}')})" for v in "xy"}
    controls |= {f"c2{v}": f"if(n.out_line AND m.in_line, {line(v, 2)}, {told(f'm.at.{v} + m.into.{v}')})" for v in "xy"}
    out = ends | controls
    return n.select("text_id", (F.col("seg") + 1).cast("long").alias("seg"), *[F.expr(out[c]).alias(c) for c in ("x0", "y0", "c1x", "c1y", "c2x", "c2y", "x1", "y1")])


CIRCLE_TEXT = f"concat('<circle cx=\"', {X.number_text('x')}, '\" cy=\"', {X.number_text('y')}, '\" r=\"', {X.number_text('extent')}, '\"/>')"


def mark_text() -> str:
    """The SVG element of a mark by its treatment."""
    n = X.number_text
    high = "(CASE treatment WHEN 'squares' THEN extent ELSE thickness END)"
    box = f"concat('<rect x=\"', {n('(x - extent / 2e0)')}, '\" y=\"', {n(f'(y - {high} / 2e0)')}, '\" width=\"', {n('extent')}, '\" height=\"', {n(high)}, '\" transform=\"rotate(', {n('angle')}, ' ', {n('x')}, ' ', {n('y')}, ')\"/>')"
    return f"CASE treatment WHEN 'dots' THEN {CIRCLE_TEXT} ELSE {box} END"


def svg_texts(marks: DataFrame, layers: DataFrame, docs: DataFrame) -> DataFrame:
    """One SVG text per image: header, a group for each enabled layer in order, its marks in row order.

    Dots are circles, squares and lines turned rectangles; marks without a treatment are dots. docs has
    image_id, title, out_w, out_h and perhaps background (#RRGGBB, null for none), a layer of its own at the back. Rows are joined into layer texts first, so no task holds
    more than the marks of one image.
    """
    n = X.number_text
    one = F.expr(mark_text() if "treatment" in marks.columns else CIRCLE_TEXT)
    m = marks.select("image_id", "channel", F.struct("row", "col", one.alias("t")).alias("t")).groupBy("image_id", "channel").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["t"]), "").alias("body"))
    g = m.join(F.broadcast(layers.filter("enabled")), "channel")
    hexed = F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(c), 2, "0") for c in ("red", "green", "blue")]))
    group = F.concat(F.lit('<g id="'), "channel", F.lit('" fill="'), hexed, F.lit('" fill-opacity="'), F.expr(n("opacity")), F.lit('" style="mix-blend-mode:'), "blend", F.lit('">'), "body", F.lit("</g>"))
    g = g.select("image_id", F.struct("ord", group.alias("t")).alias("t")).groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["t"]), "").alias("groups"))
    d = docs.join(g, "image_id", "left")
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), F.expr(n("out_w")), F.lit(" "), F.expr(n("out_h")), F.lit('"><title>'), xml_escape(F.col("title")), F.lit("</title>"))
    back = F.lit("")
    if "background" in docs.columns:
        back = F.coalesce(F.concat(F.lit('<g id="background"><rect width="'), F.expr(n("out_w")), F.lit('" height="'), F.expr(n("out_h")), F.lit('" fill="'), xml_escape(F.lower("background")), F.lit('"/></g>')), F.lit(""))
    return d.select("image_id", F.concat(head, back, F.coalesce("groups", F.lit("")), F.lit("</svg>")).alias("svg"))


def curve_svg_texts(outlines: DataFrame, docs: DataFrame) -> DataFrame:
    """One SVG per image of curve outlines (image_id, ord, label, color, opacity, d), clipped to the artboard."""
    n = X.number_text
    path = F.concat(F.lit('<path id="'), xml_escape(F.col("label")), F.lit('" fill="'), "color", F.lit('" fill-opacity="'), F.expr(n("opacity")), F.lit('" fill-rule="nonzero" d="'), "d", F.lit('"/>'))
    g = outlines.select("image_id", F.struct("ord", "d", path.alias("t")).alias("t")).groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["t"]), "").alias("body"))
    box = F.concat(F.lit('<clipPath id="artboard"><rect width="'), F.expr(n("out_w")), F.lit('" height="'), F.expr(n("out_h")), F.lit('"/></clipPath><g clip-path="url(#artboard)">'))
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), F.expr(n("out_w")), F.lit(" "), F.expr(n("out_h")), F.lit('">'))
    return docs.join(g, "image_id", "left").select("image_id", F.concat(head, box, F.coalesce("body", F.lit("")), F.lit("</g></svg>")).alias("svg"))


def write_svg(texts: DataFrame, path: str, buckets: int = 64) -> None:
    """SVG texts under path, partitioned by a hash bucket of the image; the committer makes it atomic."""
    texts.select(F.pmod(F.xxhash64("image_id"), F.lit(buckets)).alias("bucket"), F.col("svg").alias("value")).write.mode("overwrite").partitionBy("bucket").text(path)


def write_raster(pixels: DataFrame, path: str, separate_channels: bool = False) -> None:
    """Pixel rows as Parquet, partitioned by bucket of the image and, if asked, by channel."""
    d = pixels.withColumn("bucket", F.pmod(F.xxhash64("image_id"), F.lit(64)))
    d.write.mode("overwrite").partitionBy("bucket", *["channel"] * separate_channels).parquet(path)


def plan_export_jobs(docs: DataFrame, channels: DataFrame) -> DataFrame:
    """One job for each enabled channel of a document to be separated, else one combined job."""
    on = channels.filter("enabled").select("channel", "ord")
    d = docs.join(F.broadcast(on), F.col("separate"), "left")
    return d.select("document_id", F.coalesce("channel", F.lit("combined")).alias("job"))


def document_json(docs: DataFrame) -> DataFrame:
    """document_id, content: documents as JSON text of the current version."""
    return docs.select("document_id", F.to_json(F.struct(F.lit("halftone-document").alias("format"), "version", F.struct("name", F.base64("payload").alias("bytes")).alias("source"), "width", "surface", F.col("output_mode").alias("outputMode"))).alias("content"))


def preset_json(presets: DataFrame) -> DataFrame:
    """preset_id, content: presets as JSON text, version 1, with the values in force."""
    s = F.struct(F.col("min_mark").alias("minMark"), F.col("max_mark").alias("maxMark"), F.col("value_mode").alias("valueMode"), F.col("output_width").alias("outputWidth"))
    return presets.select("preset_id", F.to_json(F.struct(F.lit("halftone-preset").alias("format"), F.lit(1).alias("version"), s.alias("settings"))).alias("content"))


def write_json_texts(texts: DataFrame, path: str) -> None:
    texts.select("content").write.mode("overwrite").text(path)


def export_name(name: Column, fallback: str = "artwork") -> Column:
    """A file name's stem in lower case, other characters as single hyphens, none at the ends."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    clean = F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback))
