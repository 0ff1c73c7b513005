"""Vector codes: product quantisation in exact integers, nearest entries by slice-and-intersect bitmasks.

Vectors are cut into equal parts; each part position has a codebook of at most 256 entries. For every
dimension of a codebook the entries' coordinates are sorted, and each sorted place carries the mask of the
entries before it. A radius around a query selects a range of places in each dimension; the two prefix masks
at its ends give the entries inside, and the AND over all dimensions (four uint64 words) the candidates. The first radius is the
codebook's own spacing, doubled while nothing is found; the nearest candidate's distance then bounds the radius
that must be looked through, so the result is the exact nearest entry, ties going to the lower index.

Assignment runs in tasks with the codebooks broadcast (at most 256 entries a part). What goes back to the driver
is one sum a codebook component, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screentone.llm.common import stored

ENTRIES = 256
#: Up to this size a coordinate's squares and their sums fit 64-bit integers; larger ones are Python integers.
SMALL = 1 << 26
LIMB = 40


def integers(rows: list[list[float]], scale: int) -> np.ndarray:
    """floor(scale * x) of equally long vectors, exact at any size."""
    x = np.floor(np.array(rows, dtype=np.float64) * scale)
    if not x.size or np.abs(x).max() < SMALL:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x.tolist()], dtype=object)


@dataclass
class Codebook:
    """Entries of one part position, with each dimension's sorted coordinates and prefix masks."""

    entries: np.ndarray

    def __post_init__(self):
        k, dims = self.entries.shape
        self.order = np.argsort(self.entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.entries, self.order, axis=0)
        self.masks = np.zeros((dims, k + 1, ENTRIES // 64), dtype=np.uint64)
        for d in range(dims):
            bit = np.zeros((k, ENTRIES // 64), dtype=np.uint64)
            at = self.order[:, d]
            bit[np.arange(k), at // 64] = np.uint64(1) << (at % 64).astype(np.uint64)
            self.masks[d, 1:] = np.bitwise_or.accumulate(bit, axis=0)
        apart = [np.abs(self.entries - e).max(axis=1) for e in self.entries]
        near = [int(a[a > 0].min()) for a in apart if (a > 0).any()]
        self.radius = sorted(near)[len(near) // 2] if near else 1

    def within(self, queries: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks (queries x 4 words) of the entries whose every coordinate is within the query's radius."""
        out = np.full((len(queries), ENTRIES // 64), ~np.uint64(0))
        for d in range(self.entries.shape[1]):
            lo = np.searchsorted(self.sorted[:, d], queries[:, d] - radius, side="left")
            hi = np.searchsorted(self.sorted[:, d], queries[:, d] + radius, side="right")
            out &= self.masks[d, hi] & ~self.masks[d, lo]
        return out

    def best(self, queries: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each query's nearest candidate; every mask has one at least.

        Queries with few candidates are compared pair by pair, those that keep an eighth of the entries and more by
        one matrix product, exact as long as its integers fit a double.
        """
        bits = np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(len(masks), -1), axis=1, bitorder="little")
        bits = bits[:, : len(self.entries)].astype(bool)
        entry, least = np.zeros(len(queries), np.int64), np.zeros(len(queries), queries.dtype)
        exact = queries.dtype != object and self.entries.dtype != object
        top = max(int(np.abs(queries).max(initial=0)), int(np.abs(self.entries).max())) if exact else 0
        many = bits.sum(axis=1) * 8 >= len(self.entries)
        many &= exact and 8 * top * top * self.entries.shape[1] < 1 << 53
        if many.any():
            q, e = queries[many].astype(float), self.entries.astype(float)
            apart = (q * q).sum(axis=1)[:, None] - 2.0 * (q @ e.T) + (e * e).sum(axis=1)
            apart[~bits[many]] = np.inf
            entry[many] = apart.argmin(axis=1)
            least[many] = apart.min(axis=1)
        few = np.flatnonzero(~many)
        if len(few):
            row, at = np.nonzero(bits[few])
            apart = queries[few][row] - self.entries[at]
            square = (apart * apart).sum(axis=1)
            cut = np.flatnonzero(np.diff(row, prepend=-1))
            low = np.minimum.reduceat(square, cut)
            hit = np.flatnonzero(square == low[row])
            entry[few] = at[hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]]
            least[few] = low
        return entry, least

    def nearest(self, queries: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each query's nearest entry, the lower index on ties."""
        found = [self._nearest(queries[i : i + block]) for i in range(0, len(queries), block)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def _nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = object if object in (queries.dtype, self.entries.dtype) else np.int64
        queries = queries.astype(kind)
        radius = np.full(len(queries), self.radius, dtype=kind)
        masks = self.within(queries, radius)
        while len(none := np.flatnonzero(~masks.any(axis=1))):
            radius[none] = radius[none] * 2
            masks[none] = self.within(queries[none], radius[none])
        entry, square = self.best(queries, masks)
        # every entry as near as the best found lies within its distance in every dimension
        root = np.array([math.isqrt(int(s)) for s in square], dtype=kind)
        wider = np.flatnonzero(root > radius)
        if len(wider):
            entry[wider], square[wider] = self.best(queries[wider], self.within(queries[wider], root[wider]))
        return entry, square


def _assign(x: np.ndarray, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, vectors x parts."""
    found = [book.nearest(part) for book, part in zip(books, np.split(x, len(books), axis=1))]
    return np.stack([c for c, _ in found], axis=1), np.stack([s for _, s in found], axis=1)


def _sums(kept: DataFrame, books: list[Codebook], scale: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> (count, componentwise sums) over all vectors; at most parts x 256 entries."""
    dims = books[0].entries.shape[1]

    def run(batches):
        count: dict[tuple[int, int], int] = {}
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            x = integers(b.column(0).to_pylist(), scale)
            code, _ = _assign(x, books)
            for p, part in enumerate(np.split(x, len(books), axis=1)):
                order = np.argsort(code[:, p], kind="stable")
                cut = np.flatnonzero(np.diff(code[order, p], prepend=-1))
                for lo, sums in zip(cut.tolist(), np.add.reduceat(part[order], cut, axis=0)):
                    key = (p, int(code[order[lo], p]))
                    total[key] = total[key] + sums.astype(object) if key in total else sums.astype(object)
                for e, n in zip(*np.unique(code[:, p], return_counts=True)):
                    count[(p, int(e))] = count.get((p, int(e)), 0) + int(n)
        rows = [(p, e, d, count[(p, e)], *_limbs(int(v))) for (p, e), sums in total.items() for d, v in enumerate(sums)]
        if rows:
            kinds = [pa.int32()] * 3 + [pa.int64()] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["p", "e", "d", "n", "l0", "l1", "l2", "l3"])

    part = kept.select("vec").mapInArrow(run, "p int, e int, d int, n long, l0 long, l1 long, l2 long, l3 long")
    agg = part.groupBy("p", "e", "d").agg(*(F.sum(c).alias(c) for c in ("n", "l0", "l1", "l2", "l3")))
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for p, e, d, n, *limbs in agg.collect():  # bounded: parts x entries x dimensions of a part
        out.setdefault((p, e), (n, [0] * dims))[1][d] = sum(v << (LIMB * i) for i, v in enumerate(limbs))
    return out


def _limbs(v: int) -> list[int]:
    """v as four signed limbs, so that sums of any size add up as longs."""
    sign, v = (-1 if v < 0 else 1), abs(v)
    return [sign * ((v >> (LIMB * i)) & ((1 << LIMB) - 1)) for i in range(3)] + [sign * (v >> (3 * LIMB))]


def train(kept: DataFrame, first: list[list[float]], parts: int, rounds: int, scale: int) -> list[Codebook]:
    """Codebooks after `rounds` of assigning all parts and moving entries to floor(sum / count); unused ones stay."""
    books = [Codebook(e) for e in np.split(integers(first, scale), parts, axis=1)]
    for _ in range(rounds):
        moved = [[list(e) for e in book.entries] for book in books]
        for (p, e), (n, sums) in _sums(kept, books, scale).items():
            moved[p][e] = [s // n for s in sums]
        big = max(abs(int(v)) for part in moved for e in part for v in e) >= SMALL
        books = [Codebook(np.array([[int(v) for v in e] for e in part], dtype=object if big else np.int64)) for part in moved]
    return books


def digest(books: list[Codebook]) -> str:
    """SHA-256 of all entries' components by part, entry and position, comma-joined decimals."""
    return hashlib.sha256(",".join(str(int(v)) for book in books for e in book.entries for v in e).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 4, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label, label_error, codebooks_sha256 of every kept vector.

    Dropped are vectors that are null, hold a null or non-finite component, or differ in length from the one
    with the smallest id (a table whose length `parts` does not divide has no kept vectors). Codebooks start as the parts of the 256 smallest
    ids (null ids come last, repeated ids are ordered by vector), or of all if there are fewer. Repeated rows each count and each get a row; null labels are one
    label; other columns are ignored, whatever their names. An error too large for a long is null. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_col).alias("vec_id"), v.alias("vec"), F.col(label_col).alias("label")).filter(F.col("vec").isNotNull() & fine & (F.size("vec") > 0))
    low = [F.col("vec_id").asc_nulls_last(), F.col("vec")]
    lead = kept.orderBy(*low).select(F.size("vec").alias("n")).first()
    if lead is None or lead["n"] % parts:
        shape = f"vec_id {kind}, label {vectors.schema[label_col].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string"
        return spark.createDataFrame([], shape)
    kept = kept.filter(F.size("vec") == lead["n"])
    books = train(kept, [r["vec"] for r in kept.orderBy(*low).limit(ENTRIES).collect()], parts, rounds, scale)

    def run(batches):
        for b in batches:
            code, square = _assign(integers(b.column("vec").to_pylist(), scale), books)
            error = [int(s) for s in square.sum(axis=1)]
            text = [bytes(c).hex() for c in code.astype(np.uint8)]
            yield pa.record_batch(
                [b.column("vec_id"), b.column("label"), pa.array(text, pa.string()), pa.array([e if e < 1 << 63 else None for e in error], pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    said = f"vec_id {kind}, label {vectors.schema[label_col].dataType.simpleString()}, code string, error long"
    coded = stored(kept.mapInArrow(run, said), "vector-codes")
    # null if the sum does not fit a long
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    total = F.when(F.col("total").between(-(1 << 63), (1 << 63) - 1), F.col("total").cast("long"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "label", "code", "error", total.alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))
