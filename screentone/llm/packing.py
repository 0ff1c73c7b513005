"""Best-fit packing by a configuration linear program over the length histogram.

The histogram has at most `capacity` lengths, whatever the size of the corpus. Its configuration LP
(use as few patterns as possible, each a multiset of lengths that fits a sequence, covering every
length's count) is solved by multiplicative weights: prices on lengths, an exact bounded knapsack over all
lengths by dynamic programming as the pricing step, prices of covered lengths falling. The patterns of all rounds
are averaged; each round's prices also give a lower bound on the number of sequences. The average is
rounded down to whole sequences, then pattern by pattern while pieces last, and the few pieces that remain go
by best fit. The plan is a table of
(length, range of ranks) -> sequences; documents find their place in it by their rank within their
length, so no task ever holds all pieces.
"""

from __future__ import annotations

import bisect
import json
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screentone.llm.common import stored

_LOADED: dict[str, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level BPE files write for the 256 bytes (by their rule)."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """ids of a byte-level BPE file: the same ids as the tokenizers library gives, by a faster library.

    Texts that hold one of the file's special tokens go to the tokenizers library itself.
    """

    #: The file's splitting rule (fixed value).
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        self.exact = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        to_byte = _byte_alphabet()
        self.special = [x["content"] for x in said["added_tokens"]]
        model, split = said["model"], said["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not said["normalizer"] and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not (plain and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")):
            self.special = [""]  # some other kind of file: every text goes to the tokenizers library
            return
        ranks = {bytes(to_byte[c] for c in t): i for t, i in said["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=self.SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self.fast.encode_ordinary(text), dtype="<u4")


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document's ids are those of its whole text (null: empty) and end_id. Only documents longer
    than capacity are cut; their first piece takes what the full ones leave.
    """
    path = tokenizer or default_tokenizer()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(path)
        for b in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                x = np.append(enc(t or ""), np.uint32(end_id)).astype("<u4")
                at, k = 0, 0
                while at < len(x):
                    n = (len(x) % capacity or capacity) if k == 0 else capacity
                    part = x[at : at + n]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part.astype(np.int32))
                    at, k = at + n, k + 1
            out = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch(out + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def knapsack(prices: np.ndarray, lengths: np.ndarray, limits: np.ndarray, capacity: int, order: np.ndarray):
    """The bounded knapsack over the lengths of `order`: (best, last, item, used).

    best[c] is the highest price of pieces that fill c exactly. Row s of last says for each c which step up
    to s last raised it (-1: none); step s put used[s] pieces of length item[s].
    """
    left = np.minimum(capacity // lengths[order], limits[order])
    item, used = [], []
    for j, n in zip(order.tolist(), left.tolist()):
        k = 1
        while n > 0:
            k = min(k, n)
            item.append(j)
            used.append(k)
            n -= k
            k *= 2
    best = np.full(capacity + 1, -np.inf)
    best[0] = 0.0
    now, last = np.full(capacity + 1, -1, dtype=np.int32), np.empty((len(item), capacity + 1), dtype=np.int32)
    size, gain = (lengths[item] * used).tolist(), (prices[item] * used).tolist()
    for s, (u, v) in enumerate(zip(size, gain)):
        with_it, held = best[: capacity + 1 - u] + v, best[u:]
        more = with_it > held
        np.copyto(held, with_it, where=more)
        np.copyto(now[u:], s, where=more)
        last[s] = now
    return best, last, np.array(item), np.array(used)


@dataclass
class Solution:
    """A fractional solution: times of each pattern, ((length index, copies), ...), covering each length's
    count `cover` times (1 on average), and the largest lower bound on the number of sequences."""

    times: dict[tuple[tuple[int, int], ...], float]
    cover: np.ndarray
    bound: float


def first_prices(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Prices no pattern is worth more than 1 at, and the lower bound on sequences that they give.

    For a limit e up to half a sequence: pieces that leave less than e free count as a whole sequence, pieces
    under e as nothing, all others as their share (e = 0: every piece's share). The e of the best bound is taken.
    """
    limits = np.unique(np.concatenate([[0], lengths[2 * lengths <= capacity], capacity + 1 - lengths[2 * lengths > capacity]]))
    limits = limits[2 * limits <= capacity]
    at = lengths[None, :]
    prices = np.where(at > capacity - limits[:, None], 1.0, np.where(at < limits[:, None], 0.0, at / capacity))
    bounds = prices @ counts.astype(float)
    best = int(bounds.argmax())
    return prices[best], float(bounds[best])


def configuration_lp(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 300, rate: float = 4.0, width: float = 0.1, over: float = 0.03, value: float = 0.5, urge: float = 40.0, plain: float = 0.1) -> Solution:
    """The configuration LP by multiplicative weights; lengths ascending, all under capacity.

    The price of a length is its first price (its share of a sequence, or `plain` of that and else what gives the best first bound) times exp(-rate * how far it is covered beyond the
    mean). A round prices all lengths but those covered beyond the mean by `over`, and takes for each length
    under the mean the best pattern with it that fills the sequence, if worth `value` of the best
    pattern of all, else only the best one. Lengths that several patterns ask for are shared by
    exp(-urge * lag) of the length each pattern is there for, so no round covers a length by more than `width`. Orders come from a fixed seed.
    """
    rng = np.random.default_rng(0)
    m, n = len(lengths), counts.astype(float)
    tag = rng.integers(1, 1 << 40, m)  # tells patterns apart
    cover, weight = np.zeros(m), n * lengths / (n * lengths).sum()
    times: dict[tuple[tuple[int, int], ...], float] = {}
    first, bound = first_prices(lengths, counts, capacity)
    share = lengths / capacity
    # prices by share alone, unless they leave a gap to the bound
    first = (1 - plain) * first + plain * share if bound > 1.002 * float(n @ share) else share
    everything = np.arange(m)
    for turn in range(rounds):
        mean = float((weight * cover).sum())
        if mean >= 1:
            break
        lag = cover - mean
        prices = first * np.exp(-rate * lag)
        order = rng.permutation(np.flatnonzero(lag <= over))
        best, last, item, used = knapsack(prices, lengths, counts, capacity, order)
        reach = np.maximum.accumulate(best)
        if len(order) == m or turn % 4 == 0:
            top = best if len(order) == m else knapsack(prices, lengths, counts, capacity, everything)[0]
            bound = max(bound, float((n * prices).sum() / top.max()))
        through = np.flatnonzero(lag <= 0)
        if not len(through):
            through = np.array([lag.argmin()])
        room = capacity - lengths[through]
        at = np.maximum.accumulate(np.where(best >= reach, np.arange(capacity + 1), 0))
        full = prices[through] + best[room] >= value * reach[capacity]
        part = ~full & (prices[through] + reach[room] >= (1 - 1e-9) * reach[capacity])
        if not (full | part).any():
            part[lag[through].argmin()] = True
        room = np.where(full, room, at[room])[full | part]
        through = through[full | part]
        use = np.zeros((len(through), m), dtype=np.int32)
        row = np.arange(len(through))
        use[row, through] = 1
        step = last[-1, room]
        while (on := step >= 0).any():
            s = step[on]
            use[row[on], item[s]] += used[s].astype(np.int32)
            room[on] -= used[s] * lengths[item[s]]
            step[on] = np.where(s > 0, last[s - 1, room[on]], -1)
        # a pattern that needs more pieces of a length than there are gives its length a sequence of its own
        many = (use > counts).any(axis=1)
        use[many] = 0
        use[row[many], through[many]] = 1
        one = np.unique(use @ tag, return_index=True)[1]
        use, want = use[one], np.exp(-urge * (lag[through[one]] - lag.min()))
        row, col = np.nonzero(use)
        held = use[row, col]
        cut = np.flatnonzero(np.diff(row, prepend=-1))
        asked = np.bincount(col, weights=held * want[row], minlength=m)
        share = np.minimum.reduceat(n[col] / asked[col], cut) * want * width
        cover += np.bincount(col, weights=held * share[row], minlength=m) / n
        pairs = list(zip(col.tolist(), held.tolist()))
        for x, lo, hi in zip(share.tolist(), cut.tolist(), [*cut[1:].tolist(), len(row)]):
            key = tuple(pairs[lo:hi])
            times[key] = times.get(key, 0.0) + x
    mean = max(float((weight * cover).sum()), 1e-12)
    return Solution({k: x / mean for k, x in times.items()}, cover / mean, bound)


def rounded(found: Solution, lengths: np.ndarray, counts: np.ndarray, capacity: int, spare: float = 0.04) -> tuple[dict[tuple[tuple[int, int], ...], int], np.ndarray]:
    """Whole times of each pattern, and the pieces of each length that are left.

    About `spare` of each length (more where lengths have few pieces) is held back, so that what is left has a mixture
    of lengths that best fit packs well. First every pattern runs the whole part of its times; then those that fill a sequence one by one, largest
    remaining part first, while all their pieces last.
    """
    spare = min(0.5, spare + 0.3 * len(counts) / max(int(counts.sum()), 1))
    left = counts - np.floor(spare * counts + np.random.default_rng(1).random(len(counts))).astype(np.int64)
    held = counts - left
    left, size = left.tolist(), lengths.tolist()
    out: dict[tuple[tuple[int, int], ...], int] = {}
    items = [(k, x * (1 - spare)) for k, x in found.times.items()]
    for key, x in items:
        times = min(int(x), *(left[j] // u for j, u in key))
        if times > 0:
            out[key] = times
            for j, u in key:
                left[j] -= u * times
    for key, _ in sorted(items, key=lambda kx: (int(kx[1]) - kx[1], kx[0])):
        if all(left[j] >= u for j, u in key) and sum(size[j] * u for j, u in key) == capacity:
            out[key] = out.get(key, 0) + 1
            for j, u in key:
                left[j] -= u
    return out, np.array(left, dtype=np.int64) + held


def _best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Best fit of the remaining pieces, long ones first: sequences as tuples of length indices."""
    rooms: list[tuple[int, int]] = []
    held: list[list[int]] = []
    for j in range(len(lengths) - 1, -1, -1):
        n = int(lengths[j])
        for _ in range(int(counts[j])):
            at = bisect.bisect_left(rooms, (n, -1))
            if at < len(rooms):
                room, k = rooms.pop(at)
            else:
                room, k = capacity, len(held)
                held.append([])
            held[k].append(j)
            if room > n:
                bisect.insort(rooms, (room - n, k))
    return [tuple(x) for x in held]


def _remainder(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of what the patterns leave; the pieces of many sequences at a time, the rest in proportion."""
    out: list[tuple[tuple[int, ...], int]] = []
    while counts.any():
        scale = max(1, min(int(counts.sum()) // (32 * len(lengths)), int((counts * lengths).sum()) // (256 * capacity)))
        while not (counts // scale).any():
            scale //= 2
        part = counts // scale
        counts = counts - part * scale
        kept: dict[tuple[int, ...], int] = {}
        for key in _best_fit(lengths, part, capacity):
            kept[key] = kept.get(key, 0) + scale
        out += [(tuple(int(lengths[j]) for j in key), n) for key, n in kept.items()]
    return out


def plan(histogram: dict[int, int], capacity: int = 1024, rounds: int = 300, rate: float = 4.0, steps: int = 3, spare: float = 0.12) -> list[tuple[tuple[int, ...], int]]:
    """(pattern of lengths, number of sequences), using every piece of the histogram exactly once.

    Full pieces stand alone. Of the rest the LP's rounded patterns carry most; what they leave, about `spare` of it, is
    a smaller histogram with an LP of its own, `steps` times at most. After each step best fit (in proportion, so the work
    doesn't grow with the corpus) completes the plan; the plan of fewest sequences wins, that of best fit alone included.
    A plan that meets the lower bound ends the search.
    """
    rest = {n: c for n, c in histogram.items() if c > 0}
    out: list[tuple[tuple[int, ...], int]] = []
    if rest.get(capacity):
        out.append(((capacity,), rest.pop(capacity)))
    lengths = np.array(sorted(rest), dtype=np.int64)
    if len(lengths):
        counts = np.array([rest[int(n)] for n in lengths], dtype=np.int64)
        bound, done, tried = first_prices(lengths, counts, capacity)[1], [], []
        for _ in range(steps):
            tried.append(done + _remainder(lengths, counts, capacity))
            some = np.flatnonzero(counts)
            if not len(some) or sum(k for _, k in tried[-1]) <= math.ceil(bound - 1e-6):
                break
            found = configuration_lp(lengths[some], counts[some], capacity, rounds, rate)
            bound = max(bound, found.bound) if len(tried) == 1 else bound
            whole, left = rounded(found, lengths[some], counts[some], capacity, spare)
            if not whole:
                break
            done = done + [(tuple(int(lengths[some[j]]) for j, u in reversed(key) for _ in range(u)), times) for key, times in whole.items()]
            counts[some] = left
        out += min(tried, key=lambda x: sum(times for _, times in x))
    return out


def _layout(done: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, copies per sequence, first sequence, offset, step) by rank."""
    rank: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int, int]]] = {}
    sequence = 0
    for pattern, times in done:
        offset = 0
        at = 0
        while at < len(pattern):
            n = pattern[at]
            m = pattern.count(n)
            lo = rank.get(n, 0)
            rows.setdefault(n, []).append((lo, m, sequence, offset, n))
            rank[n] = lo + m * times
            offset += n * m
            at += m
        sequence += times
    return {n: np.array(r, dtype=np.int64) for n, r in rows.items()}


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None, rounds: int = 300, with_ids: bool = False, per_cell: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents with sequence_id and offset (gapless from 0 in each sequence).

    Null and empty texts are documents of end_id alone. Null doc_ids and repeated rows are packed
    like others; pieces of one length are interchangeable, so ties are settled by their rank. An
    empty table gives an empty result; other columns are ignored. Only the histogram (at most
    `capacity` rows) reaches the driver, and only the plan is sent back.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, capacity, end_id, tokenizer, with_ids, id_col, text_col), "pieces")
    # a rank within (length, cell) and the cells' offsets: no length has to fit one task
    cells = F.lit(64)
    for n, k in (tuple(r) for r in cut.groupBy("length").agg(F.count("*").alias("n")).filter(F.col("n") > 64 * per_cell).collect()):
        cells = F.when(F.col("length") == n, F.lit(-(-k // per_cell))).otherwise(cells)
    cell = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), cells).cast("int")
    order = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")
    cut = cut.withColumn("cell", cell)
    ranked = cut.withColumn("place", F.row_number().over(order) - 1)
    cells = cut.groupBy("length", "cell").agg(F.count("*").alias("n"))
    known = [tuple(r) for r in cells.collect()]  # at most capacity * 64 rows, and one for each `per_cell` pieces
    histogram: dict[int, int] = {}
    first: dict[tuple[int, int], int] = {}
    for n, c, k in sorted(known):
        first[(n, c)] = histogram.get(n, 0)
        histogram[n] = histogram.get(n, 0) + k
    lay = spark.sparkContext.broadcast((_layout(plan(histogram, capacity, rounds), capacity), first))

    def run(batches):
        rows, start = lay.value
        for b in batches:
            length, cells, place = (b.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "cell", "place"))
            sequence, offset = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for n in np.unique(length):
                at = np.nonzero(length == n)[0]
                t = rows[int(n)]
                r = place[at] + np.fromiter((start[(int(n), int(c))] for c in cells[at]), np.int64, len(at))
                j = np.searchsorted(t[:, 0], r, side="right") - 1
                d = r - t[j, 0]
                sequence[at] = t[j, 2] + d // t[j, 1]
                offset[at] = t[j, 3] + (d % t[j, 1]) * t[j, 4]
            keep = [x for x in b.schema.names if x not in ("cell", "place")]
            yield pa.record_batch([*(b.column(x) for x in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)
