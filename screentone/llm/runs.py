"""Periodic runs of words: tiles for each octave of periods, boundary Z-functions, stitched by document and period.

Words q apart are equal over a whole run of period q, so a run is a maximal stretch of places i with
x[i] == x[i + q], of max(q, least - q) places at least. For the octave of periods 2^o <= q < 2^(o+1) boundaries
stand at every 2^o words: each such stretch holds one. Two Z-functions at a boundary, one of the words
after it and one of the words before it, give for every q of the octave how far the equality reaches to both
sides, up to the next boundaries; the fragments of neighbouring boundaries touch, and their union is the stretch.

A document of many words is exploded into overlapping tiles, larger ones for larger octaves; tiles are solved apart from each other, their fragments shuffled by
(document, period) and stitched. A document that fits one tile is stitched where it is. Only boundaries near a
six-word gram that comes again at a distance in the octave can lie in a run, so only those are solved.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 6
LEAST = 2 * GRAM
#: Words that fit one tile; tiles of longer documents have at least so many boundaries' worth of words.
TILE_WORDS = 1 << 13


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def planted(words: list[bytes], doc_id: object) -> list[bytes]:
    """The words with a periodic tail where crc32 of the decimal doc_id asks for one; a null id asks for none."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def codes_of(words: list[bytes], known: defaultdict) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def vocabulary() -> defaultdict:
    return defaultdict(itertools.count().__next__)


def z_function(s: list[int], upto: int) -> list[int]:
    """z[q] for q < upto: how many places s and s[q:] agree from their start."""
    n = len(s)
    z = [0] * upto
    lo = hi = 0
    for q in range(1, upto):
        k = 0
        if q < hi:
            k = z[q - lo]
            if k < hi - q:
                z[q] = k
                continue
            k = hi - q
        while q + k < n and s[k] == s[q + k]:
            k += 1
        z[q] = k
        lo, hi = q, q + k
    return z


def boundary(x: np.ndarray, at: int, width: int) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of the stretches x[i] == x[i + period] around place `at`, periods in [width, 2 width).

    Reaches at most `width` places to both sides of `at`.
    """
    ahead = z_function(x[at : at + 3 * width].tolist(), 2 * width)
    # backwards from at - 1: one mirrored text, the side before `at` compared with itself `period` further on
    lo = max(0, at - width)
    left = x[lo:at][::-1].tolist()
    right = x[at : at + 2 * width][::-1].tolist()
    back = z_function(left + [-1] + right + left, len(left) + 1 + len(right))
    for q in range(width, min(2 * width, len(x) - at + len(left) + 1)):
        fwd = min(ahead[q], width) if at + q < len(x) else 0
        # places at - 1, at - 2, ... against at + q - 1, at + q - 2, ...: mirrored, those stand at len(right) - q
        bwd = min(back[len(left) + 1 + len(right) - q], len(left)) if at + q <= len(x) else 0
        if fwd + bwd:
            yield q, at - bwd, at + fwd


def grams(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of the six-word grams at all places of x."""
    n = len(x) - GRAM + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(GRAM if n > 0 else 0):
        h = (h ^ x[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def boundaries(x: np.ndarray, octaves: Iterable[int]) -> Iterator[tuple[int, int]]:
    """(octave, boundary) of x that can lie in a run: a gram at or close before it comes again at a period of the octave."""
    h = grams(x)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]] if len(h) else np.zeros(0, bool)
    if not same.any():
        return
    again = np.zeros(len(h), bool)
    again[order[:-1][same]] = True
    place = np.flatnonzero(again)
    group = np.empty(len(h), np.int64)
    group[order] = np.concatenate([[0], np.cumsum(~same)])
    keys = group[order] * (len(x) + 1) + order  # ascending: grams of one kind by place
    for o in octaves:
        width = 1 << o
        i = place[(-place) % width < GRAM]  # a boundary stands in the gram
        first = np.searchsorted(keys, group[i] * (len(x) + 1) + i + width)
        ok = first < len(keys)
        hit = np.zeros(len(i), bool)
        hit[ok] = keys[first[ok]] < group[i[ok]] * (len(x) + 1) + i[ok] + 2 * width
        at = i[hit] + (-i[hit]) % width
        for at in np.unique((at[:, None] + np.arange(0, GRAM, width))[(at - i[hit])[:, None] + np.arange(0, GRAM, width) < GRAM]).tolist():
            yield o, at


def solve(x: np.ndarray, octaves: Iterable[int], lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, int, int]]:
    """Fragments (period, start, end) of equality around x's boundaries in [lo, hi)."""
    for o, at in boundaries(x, octaves):
        if lo <= at < (len(x) if hi is None else hi):
            yield from boundary(x, at, 1 << o)


def primitive(x: np.ndarray, q: int) -> bool:
    """Whether the q words of x have no smaller period that divides q."""
    m, r = q, 2
    primes = []
    while r * r <= m:
        if m % r == 0:
            primes.append(r)
            while m % r == 0:
                m //= r
        r += 1
    if m > 1:
        primes.append(m)
    return not any((x[: q - q // r] == x[q // r : q]).all() for r in primes)


def stitched(found: Iterable[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Fragments that touch, as one stretch for each period and place; those long enough for a run."""
    last: list[int] | None = None
    for q, s, e in itertools.chain(sorted(found), [(-1, 0, 0)]):
        if last and last[0] == q and s <= last[2]:
            last[2] = max(last[2], e)
            continue
        if last and last[2] - last[1] >= max(last[0], LEAST - last[0]):
            yield last[0], last[1], last[2]
        last = [q, s, e]


def octaves_of(n: int) -> range:
    return range(max(1, (n // 2).bit_length()))


def runs_of(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a document that fits one tile, by start, then period."""
    if len(x) < LEAST:
        return []
    return sorted((s, e - s + q, q) for q, s, e in stitched(solve(x, octaves_of(len(x)))) if primitive(x[s:], q))


def row(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """n_runs, the longest run and the two digests of one document."""
    drop = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        drop[s + q] += 1
        drop[s + n] -= 1
    keep = np.cumsum(drop[:-1]) == 0
    kept = words if keep.all() else list(itertools.compress(words, keep))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    longest = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (len(runs), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


OUT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
NAMES = [c.split()[0] for c in OUT.split(", ")]
KINDS = [pa.int64()] * 5 + [pa.string()] * 2


def _whole(batches):
    """Documents that fit one tile, from words to result."""
    known = vocabulary()
    for b in batches:
        rows = []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = planted(words_of(t), i)
            if len(known) > 1 << 20:
                known = vocabulary()
            rows.append(row(words, runs_of(codes_of(words, known))))
        yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), KINDS))] if rows else [b.column(0), *(pa.array([], k) for k in KINDS)], names=["doc_id", *NAMES])


def _tiles(batches):
    """Long documents as tiles: row key, octave, first word, the range of boundaries and the words' codes."""
    for b in batches:
        for key, i, t in zip(*(b.column(c).to_pylist() for c in range(3))):
            x = codes_of(planted(words_of(t), i), vocabulary())
            for o in octaves_of(len(x)):
                width = 1 << o
                size = max(TILE_WORDS, 8 * width)
                for at in range(0, len(x), size):
                    lo, hi = max(0, at - width), min(len(x), at + size)
                    # one boundary's width before the tile, three after it; grams shortly before a boundary belong to it
                    near = max(0, lo - GRAM)
                    part = x[near : hi + 3 * width + GRAM].astype("<i8").tobytes()
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.record_batch([pa.array([v], k) for v, k in zip((key, o, near, at - near, hi - near, part), kinds)], names=["key", "octave", "first", "lo", "hi", "codes"])


def _fragments(batches):
    for b in batches:
        for key, o, first, lo, hi, codes in zip(*(b.column(c).to_pylist() for c in range(6))):
            x = np.frombuffer(codes, "<i8")
            shift = first % (1 << o)  # boundaries stand at multiples of the width in the document
            found = list(_shifted(x, o, shift, lo, hi))
            yield pa.record_batch([pa.array([key] * len(found), pa.int64()), *(pa.array(c, pa.int64()) for c in (zip(*((q, s + first, e + first) for q, s, e in found)) if found else ([], [], [])))], names=["key", "q", "s", "e"])


def _shifted(x: np.ndarray, o: int, shift: int, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
    """Fragments around the boundaries in [lo, hi) of a tile whose first word stands `shift` words after a boundary."""
    padded = np.concatenate([np.arange(-2 - shift, -2), x])  # words that equal no other, up to the boundary before
    for q, s, e in solve(padded, [o], lo + shift, hi + shift):
        yield q, s - shift, e - shift


def _joined(batches):
    """Long documents with their runs' candidates (start, length, period): those with a smaller period go."""
    for b in batches:
        rows = []
        for i, t, runs in zip(*(b.column(c).to_pylist() for c in range(3))):
            words = planted(words_of(t), i)
            x = codes_of(words, vocabulary())
            runs = sorted((r["s"], r["n"], r["q"]) for r in runs or [])
            rows.append(row(words, [r for r in runs if primitive(x[r[0] :], r[2])]))
        yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), KINDS))] if rows else [b.column(0), *(pa.array([], k) for k in KINDS)], names=["doc_id", *NAMES])


def _stretches(fragments: DataFrame) -> DataFrame:
    """(key, runs): fragments that touch, stitched for each document and period, long enough for a run."""
    by = Window.partitionBy("key", "q").orderBy("s", "e")
    reach = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("s") <= reach, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    whole = fragments.withColumn("reach", reach).withColumn("island", island).groupBy("key", "q", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    whole = whole.filter(F.col("e") - F.col("s") >= F.greatest("q", LEAST - F.col("q")))
    return whole.groupBy("key").agg(F.collect_list(F.struct("s", (F.col("e") - F.col("s") + F.col("q")).alias("n"), "q")).alias("runs"))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_chars: int = 1 << 16, tasks: int | None = None) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every document.

    Null and empty texts have no word and no run. A null doc_id asks for no periodic tail. Repeated rows each get their row; of runs of equal length
    the earliest is the longest, then that of the smaller period. Texts of more than `long_chars` characters
    are solved tile by tile in tasks of their own, with the same result; an empty table gives an empty one, other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size: Column = F.coalesce(F.length("text"), F.lit(0))
    short = given.filter(size <= long_chars).mapInArrow(_whole, f"doc_id {kind}, {OUT}")
    # equal rows have equal results, so they may share a key
    long = given.filter(size > long_chars).withColumn("key", F.xxhash64("doc_id", "text"))
    tiles = long.select("key", "doc_id", "text").mapInArrow(_tiles, "key long, octave int, first long, lo long, hi long, codes binary")
    spread = tiles.repartition(*([tasks] if tasks else []), "key", "octave", "first")
    runs = _stretches(spread.mapInArrow(_fragments, "key long, q long, s long, e long").distinct())
    joined = long.join(runs, "key", "left").select("doc_id", "text", "runs")
    return short.unionByName(joined.mapInArrow(_joined, f"doc_id {kind}, {OUT}"))
