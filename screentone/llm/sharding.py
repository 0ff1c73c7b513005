"""Sharding by sampled splitters.

Records are ordered by (hash of the text, doc_id), so equal texts lie together. A size-weighted key
sample gives quantile boundaries; records are range-partitioned at them, and ranges that hold far more
than their share are subdivided by boundaries from a sample of their own. Equal rows too can be told apart, so a
range of copies is no single task's work. Exact byte sums of the ranges
place every record on one line from 0 to the total size, and shard s takes the s-th of equal lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screentone.llm.common import stored


def _uniform(*cols) -> F.Column:
    """A hash of the columns as a number from 0 to 1."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def splitters(keys: DataFrame, ranges: int, per_range: int = 32) -> np.ndarray:
    """Quantile boundaries of a size-weighted sample of keys: at most ranges-1 sorted (h, sub) pairs.

    Each record is drawn with probability min(1, size * ranges * per_range / total), by a hash, so
    the draw is the same when a task runs again. About ranges * per_range pairs reach the driver,
    however large the table is.
    """
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    want = ranges * per_range
    if not total:
        return np.zeros((0, 2), dtype=np.int64)
    chance = F.col("size") * F.lit(float(want) / float(total))
    # a record above the step counts as often as it is drawn
    drawn = keys.filter(_uniform("sub", "h", F.lit(7)) < chance).select("h", "sub", F.greatest(F.lit(1), F.floor(chance)).cast("long").alias("w"))
    s = np.array(drawn.collect(), dtype=np.int64).reshape(-1, 3)
    if not len(s):
        return np.zeros((0, 2), dtype=np.int64)
    s = s[np.lexsort((s[:, 1], s[:, 0]))]
    at = np.cumsum(s[:, 2])
    pick = np.searchsorted(at, at[-1] * np.arange(1, ranges) / ranges, side="left")
    return np.unique(s[np.minimum(pick, len(s) - 1)][:, :2], axis=0)


def _deal(bounds: np.ndarray):
    """Adds `part`, the range of (h, sub): the number of boundaries at or below it."""
    first, sub = (np.ascontiguousarray(bounds[:, k]) for k in (0, 1))

    def run(batches):
        for b in batches:
            h, s = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "sub"))
            # by h first, then by sub where h is a boundary's
            lo = np.searchsorted(first, h, side="left")
            hi = np.searchsorted(first, h, side="right")
            part = lo.astype(np.int64)
            for k in np.unique(lo[hi > lo]):
                at = np.flatnonzero((lo == k) & (hi > lo))
                part[at] = k + np.searchsorted(sub[k : hi[at[0]]], s[at], side="right")
            yield pa.record_batch([*b.columns, pa.array(part)], names=[*b.schema.names, "part"])

    return run


def dealt(keys: DataFrame, ranges: int, full: float = 2.0, rounds: int = 3) -> DataFrame:
    """keys plus `part`, the range: sampled splitters, then more of them inside ranges of over `full` times
    their share of bytes, until none is left that a boundary can cut or `rounds` are over."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema) + ", part long"
    bounds = splitters(keys, ranges)
    for _ in range(rounds):
        rows = keys.mapInArrow(_deal(bounds), schema)
        sizes = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # a row for each range
        share = sum(r["bytes"] for r in sizes) / ranges
        over = [r for r in sizes if r["bytes"] > full * share and r["n"] > 1]
        if not over:
            break
        inside = rows.filter(F.col("part").isin([r["part"] for r in over]))
        more = splitters(inside, int(2 * sum(r["bytes"] for r in over) / share) + 1)
        grown = np.unique(np.concatenate([bounds, more]), axis=0)
        if len(grown) == len(bounds):
            break
        bounds = grown
    return keys.mapInArrow(_deal(bounds), schema)


def shard(docs: DataFrame, shards: int = 40, fine: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size: UTF-8 bytes of the text (null: none) plus 16; shards differ by about a fiftieth or one
    record's bytes. Equal texts lie side by side: a group of at most a fiftieth of a shard stays
    whole, a larger one is cut only where a shard ends inside it. slot counts from
    0 in each shard, in order of (text hash, doc_id hash, doc_id). Ties (rows equal in all of these)
    are interchangeable. Null doc_id: sorted first in its group. An empty table gives an empty
    result; other columns are ignored. Texts, however long, are read once and never shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # the low bits tell rows of one doc_id apart, so that any number of equal rows can be dealt out
    tie = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 40)
    keys = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.xxhash64(F.col(id_col).cast("string")).bitwiseAND(F.lit(-(1 << 24))).bitwiseOR(tie).alias("sub"),
    )
    keys = stored(keys, "shard-keys")
    order = ["h", "sub", "doc_id", "size", "text_crc32"]
    inner = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt(keys, shards * fine).withColumn("upto", F.sum("size").over(inner)).withColumn("rank", F.count("*").over(inner))
    group = Window.partitionBy("part", "h")
    placed = placed.withColumns({"g_start": F.min(F.col("upto") - F.col("size")).over(group), "g_size": F.sum("size").over(group)})
    placed = stored(placed, "shard-places")
    # a row for each range, some shards * fine
    parts = placed.groupBy("part").agg(F.max("upto").alias("bytes"), F.max("rank").alias("rows"), F.min("h").alias("low"), F.max("h").alias("high"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("bytes").over(Window.partitionBy())
    offsets = parts.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("r0"), total.alias("total"))
    # groups that a boundary cuts: the first or last of some range
    edges = parts.select(F.explode(F.array("low", "high")).alias("h")).distinct()
    cut = placed.join(F.broadcast(edges), "h", "left_semi").groupBy("part", "h").agg(F.first("g_start").alias("g_start"), F.first("g_size").alias("g_size"))
    cut = cut.join(F.broadcast(offsets), "part").groupBy("h").agg(F.min(F.col("b0") + F.col("g_start")).alias("w_start"), F.sum("g_size").alias("w_size"), F.count("*").alias("n")).filter("n > 1")
    one = placed.join(F.broadcast(offsets), "part").join(F.broadcast(cut), "h", "left")
    # a group of at most a fiftieth of a shard goes whole where its middle lies
    size, start = F.coalesce("w_size", "g_size"), F.coalesce(F.col("w_start"), F.col("b0") + F.col("g_start"))
    middle = F.when(size * 50 * shards <= F.col("total"), start + size / 2).otherwise(F.col("b0") + F.col("upto") - F.col("size") / 2)
    one = one.select("doc_id", "size", "text_crc32", F.least(F.lit(shards - 1), F.floor(middle * shards / F.col("total"))).cast("int").alias("shard"), (F.col("r0") + F.col("rank")).alias("at"))
    first = one.groupBy("shard").agg(F.min("at").alias("first"))
    return one.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
