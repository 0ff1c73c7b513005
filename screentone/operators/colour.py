"""Colour separation and tone curves: pixels to ink shares, one row per pixel and ink."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screentone.functions import formulas as X

INKS = ("c", "m", "y", "k")


def to_cmyk(df: DataFrame) -> DataFrame:
    """ink_c, ink_m, ink_y, ink_k of each pixel: black is what all inks share; clear pixels have no ink."""
    return df.withColumns({f"ink_{i}": F.expr(x) for i, x in X.cmyk().items()})


def to_rgb_screen(df: DataFrame) -> DataFrame:
    """Light of each RGB ink, weighted by alpha."""
    return df.withColumns({f"v_{i}": F.expr(f"{i} / 255e0 * (a / 255e0)") for i in "rgb"})


def to_luminance(df: DataFrame) -> DataFrame:
    """The darkness of a pixel on every ink."""
    return df.withColumns({f"ink_{i}": F.expr(X.darkness()) for i in INKS})


def to_inverted_luminance(df: DataFrame) -> DataFrame:
    """The lightness of a pixel on every ink; clear pixels are 0."""
    return df.withColumns({f"ink_{i}": F.expr("CASE WHEN a = 0 THEN 0e0 ELSE (2126e-4 * r + 7152e-4 * g + 722e-4 * b) / 255e0 END") for i in INKS})


def to_single_channel(df: DataFrame, ink: str) -> DataFrame:
    """The darkness on one ink, nothing on the others."""
    return df.withColumns({f"ink_{i}": F.expr(X.darkness()) if i == ink else F.lit(0.0) for i in INKS})


def to_crosshatch_tones(df: DataFrame, layers: DataFrame) -> DataFrame:
    """Darkness dealt to the enabled inks in the order k, c, m, y: each takes its span in turn.

    One row per pixel and enabled ink; the values of a pixel add up to its darkness.
    """
    place = F.expr("CASE channel WHEN 'k' THEN 0 WHEN 'c' THEN 1 WHEN 'm' THEN 2 ELSE 3 END")
    on = layers.filter("enabled").select("channel", place.alias("p"))
    order = on.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("p")) - 1).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))
    d = df.withColumn("d", F.expr(X.darkness())).crossJoin(F.broadcast(order.select("channel", "i", "n")))
    v = "least(1e0 / n, greatest(0e0, d - i * (1e0 / n)))"
    snapped = f"CASE WHEN {v} <= 1e-12 THEN 0e0 WHEN {v} >= 1e0 / n - 1e-12 THEN 1e0 / n ELSE {v} END"
    return d.withColumn("value", F.expr(snapped)).drop("d", "i", "n")


def unpivot_tones(df: DataFrame, keys: list[str], inks: tuple[str, ...] = INKS) -> DataFrame:
    """One row per key and ink: channel, value. The tones stand in ink_c, ink_m and so on."""
    return df.select(*keys, *[F.col(f"ink_{i}").alias(f"__{i}") for i in inks]).unpivot(keys, [f"__{i}" for i in inks], "channel", "value").withColumn("channel", F.expr("substring(channel, 3)"))


def apply_contrast(df: DataFrame, contrast: str = "contrast") -> DataFrame:
    """Contrast about the middle tone, then alpha; tones of at most 0.006 drop out."""
    return df.withColumn("value", F.expr(f"least(1e0, greatest(0e0, (value - 5e-1) * {contrast} + 5e-1)) * (a / 255e0)")).filter("value > 6e-3")


def apply_threshold(df: DataFrame, threshold: str = "threshold") -> DataFrame:
    """Tones above the threshold, stretched to 0..1; the rest drops out."""
    return df.withColumn("value", F.expr(X.threshold("value", threshold))).filter("value > 0")


LIGHTS = ("red", "green", "blue")


def active_channels(channels: DataFrame) -> DataFrame:
    """Enabled rows of a table of inks; null counts as off."""
    return channels.filter("enabled")


def uses_lights(output_mode: str = "output_mode", value_mode: str = "value_mode") -> str:
    """Whether a document is put out in lights: crosshatch never, else by output mode or by mapping."""
    return f"(coalesce({value_mode}, '') <> 'crosshatch' AND (coalesce({output_mode}, '') = 'rgb' OR coalesce({value_mode}, '') = 'rgb'))"


def output_channels(documents: DataFrame, channels: DataFrame) -> DataFrame:
    """The enabled inks or lights of each document, with the columns of both tables.

    documents has output_mode and value_mode (null: inks), channels one row for each of the four inks
    and three lights. The join goes by kind and leaves its strategy to the size of the table.
    """
    kind = F.col("channel").isin(*LIGHTS).alias("is_light")
    on = active_channels(channels).select("*", kind)
    return documents.withColumn("is_light", F.expr(uses_lights())).join(on, "is_light").drop("is_light")


def premultiply(df: DataFrame) -> DataFrame:
    """Adds pr, pg, pb: colours times the share of alpha."""
    return df.withColumns({f"p{i}": F.expr(f"{i} * a / 255e0") for i in "rgb"})


def unpremultiply(df: DataFrame) -> DataFrame:
    """Integer colour from premultiplied sums pr, pg, pb and alpha pa; where alpha is 0, so is all."""
    a = X.byte("pa")
    return df.withColumns({i: F.expr(f"CASE WHEN {a} = 0 THEN 0 ELSE {X.byte(f'p{i} * 255e0 / pa')} END") for i in "rgb"} | {"a": F.expr(a)})
