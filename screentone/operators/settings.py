"""Settings tables: defaults, enums, rules as data, deltas, migration, sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screentone.functions import formulas as X


def apply_channel_defaults(raw: DataFrame, defaults: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Every key gets every default channel; given fields win, absent ones (or channels) take the default."""
    keys = raw.select(key).distinct().crossJoin(F.broadcast(defaults))
    given = raw.select(key, F.col("channel").alias("gc"), *[F.col(f).alias(f"g_{f}") for f in fields])
    d = keys.join(given.withColumnRenamed("gc", "channel"), [key, "channel"], "left")
    return d.select(key, "channel", *[F.coalesce(f"g_{f}", f).alias(f) for f in fields])


def decode_enums(df: DataFrame, column: str, lookup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted with `code`, rejected): lookup has `name` and `code`."""
    side = F.broadcast(lookup.select(F.col("name").alias(column), "code"))
    return df.join(side, column), df.join(side, column, "left_anti")


def unit_or_percent(v: str) -> str:
    """Shares given as 0..1 or as percent; what is still outside 0..1 is null."""
    s = f"(CASE WHEN {v} > 1e0 THEN {v} / 100e0 ELSE {v} END)"
    return f"CASE WHEN {s} BETWEEN 0e0 AND 1e0 THEN {s} END"


def validate_settings(df: DataFrame, rules: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Violations (key, field, message): rules (field, lo, hi, message) are a small broadcast table.

    Missing, infinite and out-of-range values all count; a record without violations is accepted.
    """
    long = df.select(key, *[F.col(f).cast("double").alias(f) for f in fields]).unpivot([key], fields, "field", "value")
    return long.join(F.broadcast(rules), "field").filter("value IS NULL OR isnan(value) OR value < lo OR value > hi").select(key, "field", "message")


def split_by_violations(df: DataFrame, violations: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine) rows of df."""
    bad = violations.select(key).distinct()
    return df.join(bad, key, "left_anti"), df.join(bad, key, "left_semi")


def apply_deltas(channels: DataFrame, deltas: DataFrame, key: str) -> DataFrame:
    """Shared deltas laid on every channel: sums, products, and clamped threshold and opacity."""
    d = channels.join(deltas, key)
    out = {c: f"{c} + {c}_delta" for c in ("rotation", "grid_rotation", "pivot_x", "pivot_y", "offset_x", "offset_y")}
    out |= {"scale": "scale * scale_multiplier", "resolution_scale": "resolution_scale * resolution_multiplier", "max_size": "max_size * max_size_multiplier"}
    out |= {"threshold": "least(1e0, greatest(0e0, threshold + threshold_delta))", "opacity": "least(1e0, greatest(0e0, opacity * opacity_multiplier))"}
    return d.withColumns({k: F.expr(v) for k, v in out.items()})


#: Default, least and most of the native settings (fixed values).
NATIVE = {"detail": (58.0, 0.0, 100.0), "coverage": (88.0, 0.0, 160.0), "contrast": (100.0, 0.0, 200.0), "angle": (0.0, -180.0, 180.0)}


def sanitize_settings(df: DataFrame) -> DataFrame:
    """Native settings within their ranges; missing and infinite ones take the default."""
    return df.withColumns({k: F.expr(f"CASE WHEN {k} IS NULL OR isnan({k}) OR abs({k}) = double('infinity') THEN {d}e0 ELSE least({hi}e0, greatest({lo}e0, {k})) END") for k, (d, lo, hi) in NATIVE.items()})


def aspect_lock(df: DataFrame, div: str = "div") -> DataFrame:
    """Adds lock_w, lock_h: the requested long edge (1..100000) in the source's proportions, whole numbers."""
    return df.withColumns({k: F.expr(v) for k, v in aspect_formulas(div).items()})


def aspect_formulas(div: str) -> dict[str, str]:
    long = "CAST(least(100000, greatest(1, requested)) AS BIGINT)"
    return {
        "lock_w": f"CASE WHEN src_w >= src_h THEN {long} ELSE greatest(1, ({long} * src_w + src_h {div} 2) {div} src_h) END",
        "lock_h": f"CASE WHEN src_w >= src_h THEN greatest(1, ({long} * src_h + src_w {div} 2) {div} src_w) ELSE {long} END",
    }


def normalize_canvas(docs: DataFrame) -> DataFrame:
    """Canvas in the artwork's proportions and whether anything changed; docs has out_w, out_h, src_w, src_h.

    Saved variants (shape_w, shape_h, curve_w, curve_h, where docs has them) are brought to the proportions
    too, and count for `changed`; null ones stay null and don't count.
    """
    changed = F.lit(False)
    for v in ("shape", "curve"):
        if f"{v}_w" in docs.columns:
            given = docs.columns
            d = aspect_lock(docs.withColumn("requested", F.greatest(f"{v}_w", f"{v}_h")))
            moved = F.col("requested").isNotNull() & ~(F.col("lock_w").eqNullSafe(F.col(f"{v}_w")) & F.col("lock_h").eqNullSafe(F.col(f"{v}_h")))
            d = d.withColumn(f"moved_{v}", moved)
            docs = d.select(*[F.when(F.col("requested").isNotNull(), F.col(f"lock_{c[-1]}")).alias(c) if c in (f"{v}_w", f"{v}_h") else F.col(c) for c in given], f"moved_{v}")
            changed = changed | F.col(f"moved_{v}")
    d = aspect_lock(docs.withColumn("requested", F.greatest("out_w", "out_h")))
    d = d.withColumn("changed", changed | ~(F.col("lock_w").eqNullSafe(F.col("out_w")) & F.col("lock_h").eqNullSafe(F.col("out_h"))))
    return d.drop("moved_shape", "moved_curve")


def to_crosshatch(shapes: DataFrame, key: str) -> DataFrame:
    """Four straight curve layers for each crosshatch shape: fixed angles, the tone fields copied."""
    angle = "CASE channel WHEN 'k' THEN 45e0 WHEN 'c' THEN -45e0 WHEN 'm' THEN 0e0 ELSE 90e0 END"
    d = shapes.filter("value_mode = 'crosshatch'")
    return d.select(key, "channel", F.expr(angle).alias("grid_rotation"), F.lit(True).alias("enabled"), "color", "scale", "threshold", "max_size", "resolution_scale", "offset_x", "offset_y", "opacity")


def migrate_documents(docs: DataFrame, current: int = 5) -> DataFrame:
    """Documents of version 1..current brought to the current one, with flags for what was filled in.

    Before 4 there is no appearance (white on white), before 5 no output mode (cmyk) and no cached other
    mode (inactive_cmyk, inactive_rgb, where given, become null). Other versions are rejected_documents.
    """
    d = docs.filter(f"version BETWEEN 1 AND {current}")
    d = d.withColumns({c: F.when(F.col("version") >= 5, F.col(c)) for c in ("inactive_cmyk", "inactive_rgb") if c in d.columns})
    return d.withColumns(
        {
            "surface": F.expr("CASE WHEN version < 4 THEN 'white' ELSE coalesce(surface, 'white') END"),
            "output_mode": F.expr("CASE WHEN version < 5 THEN 'cmyk' ELSE coalesce(output_mode, 'cmyk') END"),
            "filled_appearance": F.col("version") < 4,
            "filled_output_mode": F.col("version") < 5,
            "version": F.lit(current),
        }
    )


def rejected_documents(docs: DataFrame, current: int = 5) -> DataFrame:
    """Documents of no known version (null too), with a reason."""
    return docs.filter(f"version IS NULL OR version NOT BETWEEN 1 AND {current}").withColumn("reason", F.concat(F.lit("unsupported version "), F.coalesce(F.col("version").cast("string"), F.lit("none"))))


def resolve_output_mode(df: DataFrame) -> DataFrame:
    """The output mode a preset's value mode asks for (others keep the current one), and whether it switches."""
    d = df.withColumn("next_mode", F.expr("CASE value_mode WHEN 'cmyk' THEN 'cmyk' WHEN 'rgb' THEN 'rgb' ELSE current_mode END"))
    return d.withColumns({"switched": F.col("next_mode") != F.col("current_mode"), "treatment": F.expr("CASE WHEN next_mode <> current_mode THEN coalesce(cached_treatment, active_treatment) ELSE active_treatment END")})


def parse_hex_color(c: str) -> list[Column]:
    """red, green, blue, alpha of #RRGGBB or #RRGGBBAA; null for other text, alpha null for six digits."""
    ok = f"{c} RLIKE '^#([0-9A-Fa-f]{{6}}|[0-9A-Fa-f]{{8}})$'"
    part = lambda i: f"CAST(conv(substring({c}, {i}, 2), 16, 10) AS INT)"
    out = [F.expr(f"CASE WHEN {ok} THEN {part(i)} END").alias(n) for n, i in (("red", 2), ("green", 4), ("blue", 6))]
    return [*out, F.expr(f"CASE WHEN {ok} AND length({c}) = 9 THEN {part(8)} END").alias("alpha")]


def normalize_layout(c: Column) -> Column:
    """Layout names of old presets as today's; unknown ones are full-width."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("full-height", "vertical", "column"), "full-height").when(low.isin("motif", "motif-pattern", "pattern", "tile"), "motif-pattern").otherwise("full-width")


def plan_output_size(df: DataFrame, most: int = 64_000_000) -> DataFrame:
    """Adds fit_w, fit_h (within max_dim, whole, 1 at least), inches_w at dpi, and ok (within the pixel cap)."""
    f = "least(1e0, max_dim / greatest(src_w, src_h))"
    d = df.withColumns({"fit_w": F.expr(f"CAST(greatest(1e0, floor(src_w * {f} + 5e-1)) AS BIGINT)"), "fit_h": F.expr(f"CAST(greatest(1e0, floor(src_h * {f} + 5e-1)) AS BIGINT)")})
    return d.withColumns({"inches_w": F.expr(X.rounded("fit_w / dpi")), "ok": F.expr(f"fit_w * fit_h <= {most}")})


def check_output_size(df: DataFrame, most: int = 64_000_000) -> DataFrame:
    """Adds problem: why an asked size (req_w, req_h) of artwork src_w x src_h is refused, null if it isn't."""
    d = aspect_lock(df.withColumn("requested", F.greatest("req_w", "req_h")))
    problem = f"CASE WHEN coalesce(req_w, 0) <= 0 OR coalesce(req_h, 0) <= 0 THEN 'not positive' WHEN req_w * req_h > {most} THEN 'too many pixels' WHEN req_w <> lock_w OR req_h <> lock_h THEN 'other proportions' END"
    return d.withColumn("problem", F.expr(problem)).drop("requested", "lock_w", "lock_h")


def pixels_of_inches(inches: str, dpi: str) -> str:
    """Whole pixels, 1 at least, of a length in inches."""
    return f"CAST(greatest(1e0, floor({inches} * {dpi} + 5e-1)) AS BIGINT)"


def resolve_shapes(channels: DataFrame) -> DataFrame:
    """The mark shape in force: the shared one if sharing, else custom path, polygon nodes or the channel's name."""
    return channels.withColumn("shape", F.expr("CASE WHEN use_shared THEN shared_shape ELSE coalesce(custom_path, CASE WHEN nodes >= 3 THEN concat('polygon-', CAST(nodes AS STRING)) END, preset_shape, 'circle') END"))


def describe_resolutions(cfg: DataFrame, key: str) -> DataFrame:
    """One text per key: the enabled inks in order with their cell counts."""
    n = "CAST(greatest(2e0, floor(cells * greatest(5e-2, resolution_scale) + 5e-1)) AS INT)"
    d = cfg.filter("enabled").withColumn("part", F.struct("ord", F.expr(f"concat(upper(channel), ' ', CAST({n} AS STRING))").alias("text")))
    return d.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["text"]), ", ").alias("summary"))
