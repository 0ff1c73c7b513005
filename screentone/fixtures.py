"""Inputs derived from the star-schema tables: pixel tables, settings, polylines, path texts, presets, requests.

Each has a Spark form (a function) and the same rows as SQL text (for the oracle), named in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Per-ink settings; colours and order are those of the inks (fixed values).
CHANNEL_COLUMNS = "channel, ord, color, rotation, grid_rotation, threshold, scale, max_size, resolution_scale, offset_x, offset_y, pivot_x, pivot_y, width_scale, height_scale, opacity, enabled"
CHANNELS = """(VALUES
 ('c', 0, '#00AEEF', 15e0, 0e0, 5e-2, 1e0, 100e0, 1e0, 3e0, -2e0, 0e0, 0e0, 1e0, 1e0, 8e-1, true),
 ('m', 1, '#EC008C', 75e0, 30e0, 1e-1, 9e-1, 90e0, 75e-2, 1e0, 40e0, 5e0, -3e0, 1e0, 8e-1, 9e-1, true),
 ('y', 2, '#FFF200', 0e0, 0e0, 2e-1, 1e0, 80e0, 2e-2, -70e0, 0e0, 0e0, 0e0, 12e-1, 1e0, 1e0, false),
 ('k', 3, '#141418', 45e0, 45e0, 0e0, 11e-1, 100e0, 125e-2, 0e0, 0e0, -4e0, 6e0, 1e0, 1e0, 1e0, true)
)"""

#: Settings shared by all images.
MIN_MARK, MAX_MARK, GRID_SCALE = "10e0", "120e0", "100e0"


def spread(df: DataFrame) -> DataFrame:
    """df dealt over as many tasks as a shuffle has: small rows from which much is made, that a file or two would leave to a few tasks.

    The number is given, as adaptive plans would join partitions of so few bytes again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *df.columns)


def channels(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {CHANNELS} AS t({CHANNEL_COLUMNS})")


def _byte(e: str) -> str:
    return f"CAST(floor(least(255e0, greatest(0e0, (CAST({e} AS DOUBLE) + 5e-1) * 255e0))) AS INT)"


_ALPHA = "CASE WHEN label = 0 AND pos % 5 = 0 THEN 0 WHEN label = 1 THEN 128 ELSE 255 END"
_SETTINGS = "60e0 + (vec_id % 3) * 20 AS out_w, 40e0 + (vec_id % 2) * 24 AS out_h, 3e0 + (vec_id % 4) AS cells"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, r, g, b, a: an 8 x 8 image for each embedding."""
    e = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")).select("vec_id", "label", "embedding", F.posexplode("embedding").alias("pos", "v"))
    return e.selectExpr(
        "vec_id AS image_id", "pos % 8 AS x", "CAST(pos div 8 AS INT) AS y", f"{_byte('v')} AS r", f"{_byte('embedding[(pos + 21) % 64]')} AS g", f"{_byte('embedding[(pos + 42) % 64]')} AS b", f"{_ALPHA} AS a"
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, out_w, out_h, cells: output size and long-edge cells of each image."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id AS image_id", *[x.strip() for x in _SETTINGS.split(", ")])


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse 128 x 96 image for each line number."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    g = li.groupBy(F.expr("l_linenumber").alias("image_id"), F.expr("CAST(l_partkey % 128 AS INT)").alias("x"), F.expr("CAST(l_orderkey % 96 AS INT)").alias("y")).agg(
        F.expr("CAST(sum(CAST(l_quantity AS BIGINT)) % 256 AS INT)").alias("r"), F.expr("CAST(count(*) * 37 % 256 AS INT)").alias("g"), F.expr("CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) % 256 AS INT)").alias("b")
    )
    return g.withColumn("a", F.lit(255))


def poly_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """poly_id, seq, x, y, width: one polyline for each user of the event log, in time order."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.selectExpr(
        "user_id AS poly_id",
        "CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq",
        "CAST(unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000 AS DOUBLE) / 3600000000 AS x",
        "value AS y",
        "greatest(0e0, value - 15e0) AS width",
    )


def path_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path_id, d: a path text for each part."""
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")).selectExpr("p_partkey AS path_id", f"{_PATH} AS d")


_PATH = "concat('M ', CAST(p_size AS STRING), ' 0 L ', CAST(p_partkey % 50 AS STRING), ' 7 Q 3 -2 ', CAST(p_size AS STRING), ' 9.5 C 1 2 3 4 ', CAST(p_size AS STRING), ' -0.5', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' Z' END)"
_PRESET = (
    "concat('{\"format\":\"halftone-preset\",\"version\":', CAST(1 + p_partkey % 3 AS STRING), ',\"settings\":{\"minMark\":', CAST(p_size AS STRING), "
    "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat(',\"maxMark\":', CAST(p_partkey % 120 AS STRING)) END, "
    "',\"valueMode\":\"', CASE p_partkey % 5 WHEN 0 THEN 'cmyk' WHEN 1 THEN 'luminance' WHEN 2 THEN 'rgb' WHEN 3 THEN 'single' ELSE 'sepia' END, "
    "'\",\"outputWidth\":', CAST(p_partkey % 5000 AS STRING), '}}')"
)


def preset_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """preset_id, content: a preset document for each part; some are to be rejected."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS preset_id", f"{_PRESET} AS content")


def render_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, generation, setting_key, ts, value: the event log as edit and render requests."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id AS document_id", "event_id AS generation", "event_type AS setting_key", "CAST(ts AS TIMESTAMP) AS ts", "value")


_SVG = "concat('<svg width=\"', CAST(s_suppkey + 1 AS STRING), CASE s_suppkey % 5 WHEN 0 THEN 'mm' WHEN 1 THEN 'in' WHEN 2 THEN 'px' WHEN 3 THEN '%' ELSE 'pt' END, '\" height=\"', CAST(s_suppkey % 30 AS STRING), '.5cm\" viewBox=\"0 0 ', CAST(s_suppkey + 7 AS STRING), ' ', CAST(s_suppkey % 90 AS STRING), '\"><path d=\"M 0 0 L ', CAST(s_suppkey AS STRING), ' 5 Z\"/></svg>')"
_DOCUMENT = (
    "concat('{\"format\":\"halftone-document\",\"version\":', CAST(1 + o_orderkey % 6 AS STRING), ',\"source\":{\"name\":\"', o_orderpriority, '\",\"bytes\":\"', {b64}, '\"},\"width\":', CAST(o_orderkey % 400 AS STRING), "
    "CASE WHEN o_orderkey % 6 >= 3 THEN ',\"surface\":\"gray\"' ELSE '' END, CASE WHEN o_orderkey % 6 = 4 THEN ',\"outputMode\":\"rgb\"' ELSE '' END, '}}')"
)


def svg_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS text_id", f"{_SVG} AS content")


def documents_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, content: a document of version 1 to 6 for each order, its payload in base64."""
    sql = _DOCUMENT.replace("{b64}", "base64(CAST(o_orderpriority AS BINARY))").replace("'}}'", "'}'")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS document_id", f"{sql} AS content")


#: The same tables for DuckDB.
SQL = {
    "pixels": f"SELECT vec_id AS image_id, CAST(pos % 8 AS INT) AS x, CAST(pos // 8 AS INT) AS y, {_byte('embedding[pos + 1]')} AS r, {_byte('embedding[(pos + 21) % 64 + 1]')} AS g, {_byte('embedding[(pos + 42) % 64 + 1]')} AS b, {_ALPHA} AS a FROM embeddings, (SELECT unnest(range(64)) AS pos)",
    "images": f"SELECT vec_id AS image_id, {_SETTINGS} FROM embeddings",
    "channels": f"SELECT * FROM {CHANNELS} AS t({CHANNEL_COLUMNS})",
    "raster": "SELECT l_linenumber AS image_id, CAST(l_partkey % 128 AS INT) AS x, CAST(l_orderkey % 96 AS INT) AS y, CAST(sum(CAST(l_quantity AS BIGINT)) % 256 AS INT) AS r, CAST(count(*) * 37 % 256 AS INT) AS g, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) % 256 AS INT) AS b, 255 AS a FROM lineitem GROUP BY 1, 2, 3",
    "poly_points": "SELECT user_id AS poly_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) / 3600000000 AS x, value AS y, greatest(0e0, value - 15e0) AS width FROM events",
    "path_strings": f"SELECT p_partkey AS path_id, {_PATH} AS d FROM part",
    "preset_json": f"SELECT p_partkey AS preset_id, {_PRESET} AS content FROM part",
    "render_requests": "SELECT user_id AS document_id, event_id AS generation, event_type AS setting_key, ts, value FROM events",
    "svg_texts": f"SELECT s_suppkey AS text_id, {_SVG} AS content FROM supplier",
    "documents_json": f"SELECT o_orderkey AS document_id, {_DOCUMENT.replace('{b64}', 'base64(encode(o_orderpriority))').replace(chr(39) + '}}' + chr(39), chr(39) + '}' + chr(39))} AS content FROM orders",
}


def with_sql(names: str, body: str, **more: str) -> str:
    """SQL text with the named fixtures (and more common tables) in front of the body."""
    parts = [f"{n} AS ({SQL[n]})" for n in names.split()] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)} {body}"
