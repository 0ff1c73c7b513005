"""Long repeated substrings by a logarithmic family of sampled suffix arrays.

Which suffixes an index holds is decided by the text alone: of every `least` bytes in a row (a window) the gram of
GRAM bytes with the least hash is the window's anchor, so equal windows have equal anchors at equal places. A
suffix array has one entry for each anchor and the run of windows it stands for, ordered by the hash of the gram, then by that of the whole run.

Documents come in batches by ascending doc_id. A batch gets its own suffix array and is merge-scanned against
the levels that exist: a run known there, or earlier in the batch, is a long match at once. Where only the gram
is known, or a batch has several runs of one gram, the entries are marked as mixed. The batch's new entries become
a level of their own; levels of equal size merge before the next scan, so there are only logarithmically many.

At last the mixed entries are resolved to the byte: their texts are cut from the documents (a bitmap of bounded
size tells which entries), brought together by gram, and a suffix array of all their windows, to a depth
of `least` bytes by prefix doubling, gives each window's earliest equal. Grams with very many
different runs are dealt out window by window instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screentone.llm.common import dropped, stored

GRAM = 32
#: Bytes of text handled at a time in a task: what a core's cache holds with its hashes.
BLOCK = 1 << 14
#: Place, and the run's reach before and after the anchor, in one long; places up to 2^47.
REACH = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = [np.uint64(m) for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    if len(_POWERS.get(base, ())) < n:
        steps = np.full(max(n, 2 * BLOCK), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base][:n]


_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)


def _gram_hashes(text: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes at every place of text that has so many."""
    n = len(text) - 7
    words = np.ndarray((n,), "<u8", buffer=text, strides=(1,)).astype(np.uint64)
    words ^= words >> np.uint64(31)
    words *= _ODD
    words ^= words >> np.uint64(29)
    m = len(text) - GRAM + 1
    h = np.zeros(m, np.uint64)
    for k in range(GRAM // 8):
        h += words[8 * k : 8 * k + m] * _MIX[k]
    h ^= h >> np.uint64(32)
    h *= _ODD
    h ^= h >> np.uint64(29)
    return h


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` values in a row."""
    span = 1
    while 2 * span <= width:
        v = np.minimum(v[: len(v) - span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (width - span)], v[width - span :]) if width > span else v


def anchors(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(document, hash, run hash, first window, last window, anchor) of each run of windows with one anchor.

    Documents are text[starts:ends], one after the other and without gaps.
    """
    none = np.zeros(0, np.int64)
    if len(text) < least:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    h = _gram_hashes(text)
    bits = np.uint64(21)
    at = np.arange(len(h), dtype=np.uint64)
    packed = (h >> bits << bits) | at  # ties of the leading hash bits go to the leftmost
    low = _least(packed, least - GRAM + 1)
    window = np.arange(len(text) - least + 1)
    window = window[window + least <= np.repeat(ends, ends - starts)[: len(window)]]
    anchor = (low[window] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    cut = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(window, prepend=-2) != 1))
    first, last = window[cut], window[np.append(cut[1:], len(window)) - 1] if len(cut) else window[cut]
    anchor = anchor[cut]
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * _powers(len(h), _BASE))])
    whole = (total[last + least - GRAM + 1] - total[first]) * _powers(len(h), _BACK)[anchor]
    return np.searchsorted(starts, first, side="right") - 1, h[anchor], whole, first, last, anchor


def _blocks(column: pa.Array, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, places of their texts' parts, text, starts, ends): whole documents together, long ones in overlapping parts.

    A long document's parts depend on its own places alone.
    """
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], "<i8")[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        if offsets[i + 1] - offsets[i] > BLOCK:
            for lo in range(0, int(offsets[i + 1] - offsets[i]) - least + 1, BLOCK):
                part = data[offsets[i] + lo : min(offsets[i] + lo + BLOCK + least - 1, offsets[i + 1])]
                yield np.array([i]), np.array([lo]), part, np.array([0]), np.array([len(part)])
            i += 1
            continue
        j = i
        while j < len(column) and offsets[j + 1] - offsets[j] <= BLOCK and offsets[j + 1] - offsets[i] <= 2 * BLOCK:
            j += 1
        rows = np.arange(i, j)
        at = offsets[i : j + 1] - offsets[i]
        yield rows, np.zeros(j - i, np.int64), data[offsets[i] : offsets[j]], at[:-1], at[1:]
        i = j


def _places(batch: pa.RecordBatch, least: int) -> Iterator[tuple]:
    """For each block: row indexes, packed places, hashes, run hashes, slot hashes; and (text, firsts, lasts)."""
    key = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    for rows, shift, text, starts, ends in _blocks(batch.column(2), least):
        doc, h, whole, first, last, anchor = anchors(np.ascontiguousarray(text), starts, ends, least)
        place = anchor - starts[doc] + shift[doc]
        at = (place << 2 * REACH) | ((anchor - first) << REACH) | (anchor - last)
        slot = (key[rows[doc]] ^ (place.astype(np.uint64) * _MIX[0])) * _ODD
        slot = (slot ^ (slot >> np.uint64(32))) * _MIX[1]
        yield rows[doc], at, h.view(np.int64), whole.view(np.int64), (slot >> np.uint64(33)).astype(np.int64), text, first, last


def _later(batch: pa.RecordBatch, row: np.ndarray, at: np.ndarray, h: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Which entries have the same run as an earlier entry (by doc_id, key, place) of this batch."""
    out = np.zeros(len(h), bool)
    both = h ^ (whole * np.int64(-0x61C8864680B583EB))
    order = np.argsort(both)
    same = both[order[1:]] == both[order[:-1]]
    some = np.unique(np.concatenate([order[1:][same], order[:-1][same]])) if len(h) else order
    if len(some):
        ids = pa.table([batch.column(0), batch.column(1)], names=["doc_id", "key"])
        rank = np.empty(batch.num_rows, np.int64)
        by = pc.sort_indices(ids, sort_keys=[("doc_id", "ascending"), ("key", "ascending")], null_placement="at_start").to_numpy()
        key = batch.column(1).to_numpy(zero_copy_only=False)[by]
        rank[by] = np.cumsum(np.append(True, key[1:] != key[:-1]))
        by = some[np.lexsort((at[some], rank[row[some]], whole[some], h[some]))]
        new = np.append(True, (h[by[1:]] != h[by[:-1]]) | (whole[by[1:]] != whole[by[:-1]]))
        first = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
        out[by] = (rank[row[by]] != rank[row[first]]) | (at[by] != at[first])
    return out


def suffix_array(docs: DataFrame, least: int) -> DataFrame:
    """The entries (h, whole, doc_id, key, at, slot, later) of the anchors of all documents (doc_id, key, text).

    Entries that repeat a run of their own Arrow batch are matches already (`later`); in place of the gram's hash they carry
    one of their own, so that no gram gathers them.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [x[:5] for x in _places(b, least)]
            if found:
                row, at, h, whole, slot = (np.concatenate(c) for c in zip(*found))
                later = _later(b, row, at, h, whole)
                h = np.where(later, (h ^ (at << 20)) * np.int64(-0x61C8864680B583EB) ^ row ^ whole, h)
                h = np.where(later, h ^ b.column(1).to_numpy(zero_copy_only=False)[row], h)
                row = pa.array(row)
                yield pa.record_batch([pa.array(h), pa.array(whole), b.column(0).take(row), b.column(1).take(row), pa.array(at), pa.array(slot), pa.array(later)], names=["h", "whole", "doc_id", "key", "at", "slot", "later"])

    return docs.select("doc_id", "key", "text").mapInArrow(run, f"h long, whole long, doc_id {kind}, key long, at long, slot long, later boolean")


class Family:
    """Levels of sampled suffix arrays (h, whole, slot), each a stored table with its number of entries."""

    def __init__(self, least: int = 100):
        self.least = least
        self.levels: list[tuple[DataFrame, int]] = []
        self.scans: list[DataFrame] = []
        self.merged: list[DataFrame] = []

    def merge(self) -> None:
        """Levels of about equal size (by powers of two) become one, the smaller ones first."""
        self.levels.sort(key=lambda level: -level[1])
        while len(self.levels) > 1 and self.levels[-2][1].bit_length() <= self.levels[-1][1].bit_length():
            (a, n), (b, m) = self.levels.pop(-2), self.levels.pop(-1)
            # a level holds no run that an earlier one has, so the entries are disjoint
            one = stored(a.unionByName(b), "suffix-level")
            for gone in (a, b):
                if any(gone is x for x in self.merged):
                    dropped(gone)
            self.merged = [x for x in self.merged if x is not a and x is not b] + [one]
            self.levels.append((one, n + m))
            self.levels.sort(key=lambda level: -level[1])

    def add(self, docs: DataFrame) -> None:
        """Scan a batch, later than all before it, against the levels; then it becomes a level itself.

        One shuffle by gram brings the batch's entries and those of all levels into the order of one suffix array: the first entry
        of a run is the earliest, those after it are matches; grams with several runs, one of them new, are mixed.
        """
        self.merge()
        rows = suffix_array(docs, self.least).withColumn("new", F.lit(1))
        for level, _ in self.levels:
            rows = rows.unionByName(level.withColumn("new", F.lit(0)), allowMissingColumns=True)
        run, gram = Window.partitionBy("h", "whole"), Window.partitionBy("h")
        order = run.orderBy("new", "doc_id", "key", "at")
        running = order.rowsBetween(Window.unboundedPreceding, 0)
        earliest = F.first(F.struct("new", "key", "at")).over(running)
        rows = rows.repartition("h").withColumn("place", F.row_number().over(order)).withColumn("first", earliest)
        later = F.coalesce("later", F.lit(False))
        opens = F.when((F.col("place") == 1) & ~later, 1).otherwise(0)
        rows = rows.withColumn("runs", F.sum(opens).over(gram)).withColumn("fresh", F.sum(opens * F.col("new")).over(gram))
        same = (F.col("first.new") == 1) & (F.col("first.key") == F.col("key")) & (F.col("first.at") == F.col("at"))
        kinds = {
            "match": later | ((F.col("new") == 1) & ~same),
            "opens": (F.col("new") == 1) & (F.col("place") == 1) & ~later,
            "mixed": (F.col("place") == 1) & ~later & (F.col("runs") > 1) & (F.col("fresh") > 0),
        }
        rows = rows.withColumns(kinds | dict(zip("se", self._windows())))
        # each row keeps what its kind is asked for
        kept = [F.when(F.col("match"), F.col(c)).alias(c) for c in ("key", "s", "e")] + [F.when(F.col("opens"), F.col(c)).alias(c) for c in ("h", "whole")]
        rows = rows.select(*kept, F.when(F.col("opens") | F.col("mixed"), F.col("slot")).alias("slot"), *kinds)
        scanned = stored(rows.filter("match OR opens OR mixed"), "suffix-scan")
        self.scans.append(scanned)
        level = scanned.filter("opens").select("h", "whole", "slot")
        self.levels.append((level, level.count()))

    @property
    def matches(self) -> DataFrame:
        """(key, s, e): windows of whole runs that occur earlier."""
        return self._all("match", "key", "s", "e")

    @property
    def mixed(self) -> DataFrame:
        """(slot): entries of grams with several runs."""
        return self._all("mixed", "slot")

    def _all(self, kind: str, *names: str) -> DataFrame:
        out = self.scans[0].filter(kind).select(*names)
        for more in self.scans[1:]:
            out = out.unionByName(more.filter(kind).select(*names))
        return out

    def _windows(self):
        place = F.shiftright("at", 2 * REACH)
        before = F.shiftright("at", REACH).bitwiseAND(F.lit((1 << REACH) - 1))
        after = F.col("at").bitwiseAND(F.lit((1 << REACH) - 1))
        return [place - before, place - after]


def bitmap(slots: DataFrame, least_bits: int = 20, most_bits: int = 29) -> tuple[np.ndarray, int]:
    """The slots' leading bits as a bitmap, about one in 250 bits set, of 64 MB at most.

    A fuller bitmap only makes more entries be looked at.
    """
    n = slots.count()
    bits = min(most_bits, max(least_bits, (256 * n).bit_length()))
    part = min(bits, 20)  # a task's part of the bitmap: at most 2^20 bits

    def run(batches):
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(0).to_numpy() >> (31 - bits)
            for p in np.unique(at >> part):
                mine = parts.setdefault(int(p), np.zeros(1 << part, bool))
                mine[at[at >> part == p] & ((1 << part) - 1)] = True
        for p, m in parts.items():
            yield pa.record_batch([pa.array([p], pa.int32()), pa.array([np.packbits(m, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    if n:
        cut = slots.select("slot").distinct().repartition(1 << (bits - part), F.shiftright("slot", 31 - bits + part))
        for p, m in cut.mapInArrow(run, "part int, bits binary").collect():
            size = 1 << (part - 3)
            out[p * size : (p + 1) * size] |= np.frombuffer(m, np.uint8)
    return out, bits


def _ranked(v: np.ndarray) -> np.ndarray:
    """Dense ranks of the values; pairs of ranks in 32 bits each are packed closer, so that a place fits beside them."""
    place = np.uint64(max(len(v), 2).bit_length())
    low = np.uint64(32)
    if v.max(initial=0) >> np.uint64(64 - place):
        v = (v >> low << place) | (v & np.uint64(0xFFFFFFFF))
    if v.max(initial=0) >> np.uint64(64 - place):
        return np.unique(v, return_inverse=True)[1].astype(np.uint64)
    v = np.sort((v << place) | np.arange(len(v), dtype=np.uint64))
    out = np.empty(len(v), np.uint64)
    at = (v & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
    v >>= place
    out[at] = np.cumsum(np.append(False, v[1:] != v[:-1])) if len(v) else v
    return out


def _earliest(rows: list[tuple[bytes, int]], rank: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(row, first window, last window) of the windows that an earlier row, by rank, or place of it, has too.

    rows: text and number of windows (one at each of the text's first places). A suffix array of all places to a depth of `least` bytes.
    """
    text = np.frombuffer(b"".join(t for t, _ in rows) + bytes(8), np.uint8)
    size = np.array([len(t) for t, _ in rows])
    start = np.cumsum(size) - size
    count = np.array([n for _, n in rows])
    depth = 5
    order = _ranked(np.ndarray((len(text) - 7,), ">u8", buffer=text, strides=(1,)).astype(np.uint64) >> np.uint64(24))
    while depth < least:
        step = min(depth, least - depth)
        order = _ranked((order[:-step] << np.uint64(32)) | order[step:])
        depth += step
    row = np.repeat(np.arange(len(rows)), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    suffix = order[start[row] + offset]
    low = np.full(len(order) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, suffix, rank[row])
    dup = np.flatnonzero(low[suffix] < rank[row])
    cut = np.flatnonzero((np.diff(row[dup], prepend=-1) != 0) | (np.diff(offset[dup], prepend=-2) != 1))
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(dup)]):
        yield int(row[dup[lo]]), int(offset[dup[lo]]), int(offset[dup[hi - 1]])


def resolve(docs: DataFrame, slots: DataFrame, least: int, crowd: int = 5000, chunk: int = 1 << 20) -> DataFrame:
    """(key, s, e): windows of the marked entries that occur earlier, to the byte."""
    spark = docs.sparkSession
    found, bits = bitmap(slots)
    held = spark.sparkContext.broadcast(found)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        marks = held.value
        for b in batches:
            for row, at, h, _, slot, text, first, last in _places(b, least):
                slot = slot >> (31 - bits)
                hit = np.flatnonzero(marks[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                raw = text.tobytes()
                part = [raw[f : e + least] for f, e in zip(first[hit].tolist(), last[hit].tolist())]
                row = pa.array(row[hit])
                start = (at >> 2 * REACH) - ((at >> REACH) & ((1 << REACH) - 1))
                yield pa.record_batch([pa.array(h[hit]), b.column(0).take(row), b.column(1).take(row), pa.array(start[hit]), pa.array(part, pa.binary())], names=["h", "doc_id", "key", "s", "part"])

    cuts = stored(docs.select("doc_id", "key", "text").mapInArrow(cut, f"h long, doc_id {kind}, key long, s long, part binary"), "suffix-cuts")
    many = cuts.groupBy("h").count().filter(F.col("count") > crowd).select("h", F.lit(True).alias("many"))
    cuts = cuts.join(many, "h", "left")
    order = [F.col("doc_id").asc_nulls_first(), "key", "s"]

    def scan(batches):
        """Whole grams at a time: rows come sorted by gram, then by doc_id, key and place."""
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("h", "key", "s", "part"))):
                if rows and r[:3] == rows[-1][:3]:
                    continue  # a repeated row of the documents
                if size > chunk and r[0] != rows[-1][0]:
                    yield from solved(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[3])
        yield from solved(rows)

    def solved(rows):
        rows = [r for i, r in enumerate(rows) if any(0 <= k < len(rows) and rows[k][0] == r[0] for k in (i - 1, i + 1))]
        if rows:
            out = [(rows[i][1], rows[i][2] + lo, rows[i][2] + hi) for i, lo, hi in _earliest([(r[3], len(r[3]) - least + 1) for r in rows], np.arange(len(rows)), least)]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))], names=["key", "s", "e"])

    few = cuts.filter("many IS NULL").repartition("h").sortWithinPartitions("h", *order)
    some = few.select("h", "key", "s", "part").mapInArrow(scan, "key long, s long, e long")
    # grams in a crowd of different runs: window by window, equal windows pre-aggregated
    at = F.explode(F.sequence(F.lit(0), F.length("part") - least)).alias("o")
    windows = cuts.filter("many").select("doc_id", "key", "s", "part", at).select("doc_id", "key", (F.col("s") + F.col("o")).alias("s"), F.substring(F.col("part"), F.col("o") + 1, F.lit(least)).alias("w"))
    first = windows.groupBy("w").agg(F.min(F.struct("doc_id", "key", "s")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = windows.join(first, "w").filter((F.col("first.key") != F.col("key")) | (F.col("first.s") != F.col("s")))
    return some.unionByName(later.select("key", "s", F.col("s").alias("e")))


def _batches(docs: DataFrame, batches: int) -> list[DataFrame]:
    """Documents in batches of ascending doc_id; null ids are in the first."""
    if batches < 2:
        return [docs]
    # quantiles of a bounded sample, the ids with the least hashes: they set the sizes alone
    sample = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id")).limit(1000)
    known = sorted(r["doc_id"] for r in sample.collect())
    ids = [known[len(known) * i // batches] for i in range(1, batches)] if known else []
    cuts = sorted(set(ids))
    low = [None, *cuts]
    out = []
    for lo, hi in zip(low, [*cuts, None]):
        part = docs if lo is None else docs.filter(F.col("doc_id") > F.lit(lo))
        if hi is not None:
            inside = F.col("doc_id") <= F.lit(hi)
            part = part.filter(inside | F.col("doc_id").isNull() if lo is None else inside)
        out.append(part)
    return out


def repeated_windows(docs: DataFrame, least: int = 100, batches: int = 4) -> DataFrame:
    """(key, s, e) over documents (doc_id, key, text): windows s..e of `least` bytes that start earlier elsewhere too.

    Earlier: smaller doc_id (null first), then smaller key, then smaller place. Rows of one key count as one.
    """
    family = Family(least)
    for part in _batches(docs, batches):
        family.add(part)
    out = stored(family.matches.unionByName(resolve(docs, family.mixed, least)), "suffix-spans")
    for gone in [*family.scans, *family.merged]:
        dropped(gone)
    return out


def remove_repeats(docs: DataFrame, least: int = 100, batches: int = 4, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, spans and kept text as bytes.

    Removed is every byte covered by a string of `least` bytes that also starts earlier: in a document with a smaller
    doc_id, or earlier in the same one. Null ids come before all others. Rows of one doc_id are ordered by a hash of
    their text; of rows that repeat both, all but one lose everything if they have `least` bytes. Null texts are empty, and shorter texts than `least` stay whole.
    Long texts are handled in overlapping parts; an empty table gives an empty result; other columns are ignored. Texts are UTF-8 bytes, so a cut may fall inside a character.
    """
    if not GRAM < least < GRAM + (1 << REACH):
        raise ValueError(f"least must lie between {GRAM} and {GRAM + (1 << REACH)}")
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    given = given.withColumn("key", F.xxhash64("doc_id", "text"))
    found = repeated_windows(given.filter(F.octet_length("text") >= least), least, batches)
    spans = found.groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    copy = F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))
    rows = given.withColumn("copy", copy).join(spans, "key", "left")

    def run(batches):
        for b in batches:
            out = []
            for text, copy, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("copy").to_pylist(), b.column("spans")):
                n = len(text)
                if copy > 1 and n >= least:
                    cuts = [(0, n)]
                elif spans.is_valid:
                    v = spans.values
                    s, e = (v.field(i).to_numpy(zero_copy_only=False) for i in range(2))
                    by = np.argsort(s, kind="stable")
                    s, e = s[by], np.maximum.accumulate(e[by] + least)
                    new = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
                    cuts = list(zip(s[new].tolist(), e[np.append(new[1:], len(s)) - 1].tolist()))
                else:
                    cuts = []
                kept = b"".join(text[a:z] for a, z in zip([0, *(z for _, z in cuts)], [*(a for a, _ in cuts), n]))
                out.append((n, n - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), *([[{"start": a, "end": z} for a, z in cuts], kept] if with_text else [])))
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()})), pa.binary()] * with_text
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["spans", "kept"] * with_text
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds))], names=names)

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start: long, end: long>>, kept binary" * with_text
    return rows.select("doc_id", "text", "copy", "spans").mapInArrow(run, schema)
