"""SimHash near-duplicate detection by covering locality-sensitive hashing.

Every document gets a 64-bit fingerprint: bit i is 1 if it is set in over half of the XXH64 hashes
(seed 42) of its word shingles. Documents link when their fingerprints differ in at most `radius` bits.

Covering tables: bit i carries a non-zero vector m(i) of radius+1 bits; table v (a non-zero vector)
keeps the bits with odd <m(i), v>. A pair that differs in at most radius bits gives at most radius
linear conditions on v, so some table keeps none of the differing bits and the pair meets there. No
link within the radius is lost.

Equal fingerprints collapse first, so groups of copies cost one row. In buckets of up to `bucket`
fingerprints all pairs are compared. Fingerprints of larger buckets (radius 2) are linked through
midpoints instead: two values differ in at most 2 bits exactly if some value is at most one bit away
from both. Each emits itself and its 64 one-bit neighbours, and a neighbour has at most 65
fingerprints around it, so the work is linear however large the bucket is, and still exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screentone.llm.common import connected_components, stored

_BYTE_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit value whose bit i is 1 if set in over half of the hashes (none: zero)."""
    n = len(hashes)
    if n == 0:
        return 0
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 255 * 256):
        part = hashes[at : at + 255 * 256]
        lanes = _BYTE_LANES[part.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)]
        full = -(-len(part) // 255)
        if full * 255 != len(part):
            lanes = np.concatenate([lanes, np.zeros((full * 255 - len(part), 8), dtype=np.uint64)])
        # up to 255 ones fit each 8-bit lane
        sums = lanes.reshape(full, 255, 8).sum(axis=1, dtype=np.uint64)
        total += sums.astype("<u8", copy=False).view(np.uint8).reshape(full, 64).sum(axis=0, dtype=np.int64)
    bits = (total * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text, repeats included; A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    if len(words) > width:
        first, last = start[: len(words) - width + 1].tolist(), end[width - 1 :].tolist()
    else:
        first, last = [0], [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], 42) for i, j in zip(first, last)), dtype=np.uint64, count=len(first))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of each row's whole text; null text counts as empty."""

    def run(batches):
        for b in batches:
            fp = np.fromiter((majority_bits(shingle_hashes(t, width)) for t in b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2^(radius+1)-1 masks such that any `radius` bit positions are all absent from at least one."""
    n = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(bits) if bin(((i % n) + 1) & v).count("1") % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint_links(fps: DataFrame, radius: int = 2, bucket: int = 64) -> DataFrame:
    """Links (a, b), a < b, that connect all distinct values of fps.fp within `radius` bits.

    Buckets of up to `bucket` values give every pair within the radius. Larger ones (radius 2 or
    less) go through midpoints, each giving a star: the same components, with no pairs of a group.
    """
    if radius > 2:
        raise ValueError("large buckets are exact up to radius 2")
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(covering_masks(radius))]))
    rows = fps.select("fp", tables.alias("x")).select("fp", "x.t", "x.k")
    sizes = rows.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    few = rows.join(sizes.filter(F.col("n") <= bucket), ["t", "k"], "left_semi")
    near = (
        few.groupBy("t", "k")
        .agg(F.collect_list("fp").alias("v"))
        .select(
            F.explode(
                F.expr(f"flatten(transform(v, x -> transform(filter(v, y -> y > x AND bit_count(x ^ y) <= {int(radius)}), y -> struct(x AS a, y AS b))))")
            ).alias("p")
        )
        .select("p.a", "p.b")
    )
    many = rows.join(sizes.filter(F.col("n") > bucket), ["t", "k"], "left_semi").select("fp").distinct()
    around = F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)]))
    # a value at most one bit from all of them: 65 members at most
    through = (
        many.select("fp", around.alias("mid"))
        .groupBy("mid")
        .agg(F.collect_list("fp").alias("v"))
        .filter("size(v) > 1")
        .select(F.expr("array_min(v)").alias("a"), F.explode("v").alias("b"))
        .filter("a < b")
    )
    if radius < 2:
        through = through.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return near.unionByName(through).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, bucket: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp (signed), component_id.

    component_id is the smallest doc_id reachable over links of at most `radius` differing bits,
    itself included. Null or empty text, or text without words: fingerprint zero, linked like any
    other. Null doc_id: the row is kept and linked, but never names a component (null if no other
    does). Repeated rows appear as often as given; an empty table gives an empty result; other
    columns, whatever their names, are ignored.
    """
    fps = stored(fingerprints(docs, width, id_col, text_col), "fingerprints")
    values = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = connected_components(fingerprint_links(values.select("fp"), radius, bucket))
    named = values.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "classes")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = named.join(lowest, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")
