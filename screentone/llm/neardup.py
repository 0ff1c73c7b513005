"""Near-duplicate removal by SimHash: word fingerprints for candidates, exact shingle similarity to decide.

Two texts are near copies if the Jaccard similarity of their five-word shingle sets is at least 0.8.
A fingerprint of the shingles themselves differs in 5 to 14 of 64 bits there, too far for covering
tables of any use; edits touch one word but five shingles, so fingerprints of the set of words
differ in about 4 bits. Several independent ones, each in the covering tables of `radius`, put
nearly all such pairs into a common bucket, and hardly any unrelated texts. Candidates are verified
on their whole texts.

Buckets have two leaders: the text nearest to the bucket's bitwise majority and the one with most
exact copies. Every text is first compared with the two leaders it meets most often; then with
those other leaders of its buckets, and in buckets of up to `bucket` texts with all members, whose
groups still differ. No pass makes all pairs of a large group.

What is left comes from an exact join of rarest-first prefixes. The first order of shingles comes from
a sample, which in a larger corpus knows fewer of those that many texts share. So shingles that turn
out to be in the prefixes of more than `few` texts go to the end of the order, and prefixes are filled
up with what follows them; texts that do not have enough are ordered anew by exact counts.
"""

from __future__ import annotations

import functools
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screentone.llm.common import connected_components, stored
from screentone.llm.simhash import _signed, covering_masks, majority_bits, shingle_hashes


def word_fingerprints(text: str | None, count: int) -> list[int]:
    """`count` fingerprints of the set of words of a text: bit majorities of differently mixed hashes."""
    w = set((text or "").encode("utf-8", "surrogatepass").lower().split())
    h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in w), dtype=np.uint64, count=len(w))
    out = []
    with np.errstate(over="ignore"):
        for k in range(count):
            x = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k + 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out.append(majority_bits(x ^ (x >> np.uint64(31))))
    return out


def bucket_rows(texts: DataFrame, count: int = 8, radius: int = 2) -> DataFrame:
    """(t, k, n, h, copies, fp): the texts of every bucket that holds more than one, with its size n."""
    masks = covering_masks(radius)
    keys = [F.struct(F.lit(i * len(masks) + j).alias("t"), F.col("fps")[i].bitwiseAND(F.lit(_signed(m))).alias("k")) for i in range(count) for j, m in enumerate(masks)]
    rows = texts.select("h", "copies", F.col("fps")[0].alias("fp"), F.explode(F.array(*keys)).alias("x")).select("h", "copies", "fp", "x.t", "x.k")
    sizes = rows.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    # a merge join at any size: buckets grow with the corpus, so no plan counts on a broadcast
    return rows.join(sizes.hint("merge"), ["t", "k"])


def bucket_leaders(rows: DataFrame) -> DataFrame:
    """(t, k, leaders): the two leaders of every bucket."""
    ones = [F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))).alias(f"s{i}") for i in range(64)]
    votes = rows.groupBy("t", "k").agg(F.count("*").alias("m"), *ones)
    middle = None
    for i in range(64):
        bit = F.when(F.col(f"s{i}") * 2 > F.col("m"), F.lit(_signed(1 << i))).otherwise(F.lit(0).cast("long"))
        middle = bit if middle is None else middle.bitwiseOR(bit)
    led = rows.join(votes.select("t", "k", middle.alias("middle")), ["t", "k"]).groupBy("t", "k").agg(
        F.min(F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("middle"))).alias("d"), "h")).alias("near"), F.min(F.struct((-F.col("copies")).alias("d"), "h")).alias("most")
    )
    return led.select("t", "k", F.array("near.h", "most.h").alias("leaders"))


def frequent_leaders(rows: DataFrame, led: DataFrame, most: int) -> DataFrame:
    """(h, leaders): of the leaders of a text's buckets, the `most` it meets most often."""
    met = rows.join(led, ["t", "k"]).groupBy("h").agg(F.flatten(F.collect_list("leaders")).alias("l"))
    often = "transform(array_distinct(l), o -> struct(size(filter(l, x -> x = o)) AS n, o AS o))"
    return met.select("h", F.expr(f"slice(transform(filter(sort_array({often}, false), x -> x.o <> h), x -> x.o), 1, {int(most)})").alias("leaders"))


def as_pairs(met: DataFrame) -> DataFrame:
    """(a, b), a < b: each text of (h, leaders) with each of its leaders, every pair once."""
    star = met.select("h", F.explode("leaders").alias("o"))
    return star.select(F.least("h", "o").alias("a"), F.greatest("h", "o").alias("b")).distinct()


def other_leaders(rows: DataFrame, led: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b), a < b: texts with those leaders of their buckets whose groups still differ.

    Groups are looked up once for each leader of a bucket and once for each text, before any pair is made.
    """
    groups = lambda k, r: roots.select(F.col("node").alias(k), F.col("root").alias(r))
    named = led.select("t", "k", F.explode(F.array_distinct("leaders")).alias("o")).join(groups("o", "ro"), "o", "left")
    named = named.groupBy("t", "k").agg(F.collect_list(F.struct("o", F.coalesce("ro", "o").alias("r"))).alias("leaders"))
    met = rows.join(named, ["t", "k"]).groupBy("h").agg(F.array_distinct(F.flatten(F.collect_set("leaders"))).alias("l"))
    met = met.join(groups("h", "rh"), "h", "left").withColumn("rh", F.coalesce("rh", "h"))
    return as_pairs(met.select("h", F.expr("transform(filter(l, x -> x.r <> rh), x -> x.o)").alias("leaders")))


def remaining_pairs(rows: DataFrame, roots: DataFrame, bucket: int) -> DataFrame:
    """(a, b), a < b: pairs of buckets of up to `bucket` texts whose groups still differ."""
    some = rows.filter(F.col("n") <= bucket).select("t", "k", "h").join(roots.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    pairs = "flatten(transform(v, (x, i) -> transform(filter(slice(v, i + 2, size(v)), y -> y.root <> x.root), y -> struct(x.h AS a, y.h AS b))))"
    return some.groupBy("t", "k").agg(F.sort_array(F.collect_list(F.struct("h", "root"))).alias("v")).select(F.explode(F.expr(pairs)).alias("p")).select("p.a", "p.b").distinct()


def common_shingles(texts: DataFrame, width: int, sample: int = 8000, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of shingles that occur in three or more of about `sample` texts, drawn by hash.

    They only order the shingles; the join is exact in any order.
    """
    share = min(1.0, sample / max(texts.count(), 1))
    drawn = texts.filter(F.shiftrightunsigned(F.xxhash64("h", F.lit(11)), 11) / F.lit(float(1 << 53)) < share).dropDuplicates(["h"])

    def run(batches):
        for b in batches:
            found = [np.unique(shingle_hashes(t, width)) for t in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, dtype=np.uint64), *found]).view(np.int64))], names=["s"])

    counts = drawn.select("text").mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).filter("n > 2")
    got = counts.orderBy(F.desc("n"), "s").limit(most).toArrow()
    s, n = got.column("s").to_numpy().astype(np.int64).view(np.uint64), got.column("n").to_numpy().astype(np.int64)
    order = np.argsort(s)
    return s[order], n[order]


def rarest_first(s: np.ndarray, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The distinct shingles s of a text, rarest first."""
    if not len(s) or not len(often):
        return s
    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
    return s[np.lexsort((s, np.where(often[at] == s, counts[at], 0)))]


def prefix_and_spare(n: int, similarity: float) -> int:
    """How many of the n shingles of a text are looked at: its prefix and a quarter more."""
    return ceil(1.25 * (n - ceil(similarity * n - 1e-9) + 1)) if n else 0


def prefix_length(similarity: float):
    """The length of the prefix of a text of `size` shingles, as a column."""
    return F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-9) + 1


def postings(texts: DataFrame, roots: DataFrame) -> DataFrame:
    """(s, h, root, size, at, held, n, usual): the prefix shingles that texts of different groups share, with the number n
    of their texts; held is how many shingles of a text were looked at, usual marks a shingle's most usual group."""
    rows = texts.join(roots.withColumnRenamed("node", "h"), "h", "left").select("h", F.coalesce("root", "h").alias("root"), "size", F.size("prefix").alias("held"), F.posexplode("prefix").alias("at", "s"))
    same = Window.partitionBy("s")
    some = rows.withColumn("low", F.min("root").over(same)).withColumn("high", F.max("root").over(same)).filter("low <> high")
    some = some.withColumn("usual", F.col("root") == F.mode("root").over(same)).withColumn("n", F.count("*").over(same))
    return stored(some.select("s", "h", "root", "size", "at", "held", "n", "usual"), "postings")


def meeting(x: DataFrame, y: DataFrame, similarity: float, more) -> DataFrame:
    """(a, b), a < b: the pairs of postings of one shingle that the size and positional filters leave, of texts whose groups differ."""
    x, y = (d.select("s", *[F.col(c).alias(c + k) for c in d.columns if c != "s"]).hint("merge") for d, k in ((x, "x"), (y, "y")))
    alike = F.least("sizex", "sizey") >= similarity * F.greatest("sizex", "sizey") - 1e-6
    enough = F.least(F.col("sizex") - F.col("atx"), F.col("sizey") - F.col("aty")) >= similarity / (1 + similarity) * (F.col("sizex") + F.col("sizey")) - 1e-6
    both = x.join(y, (x["s"] == y["s"]) & (F.col("rootx") != F.col("rooty")) & more & alike & enough)
    return both.select(F.least("hx", "hy").alias("a"), F.greatest("hx", "hy").alias("b")).distinct()


def met_within(some: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: pairs that meet in postings. One side of the join leaves out each shingle's most usual
    group, so that a large group is never paired with itself."""
    some = some.select("s", "h", "root", "size", "at", "usual")
    return meeting(some.filter("NOT usual"), some, similarity, F.col("usualy") | (F.col("hx") < F.col("hy")))


def prefix_pairs(texts: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: all pairs that the filters of the exact join leave, of texts whose groups still differ.

    texts has h, size and prefix of each distinct text.
    """
    return met_within(postings(texts, roots), similarity)


def light_first(some: DataFrame, similarity: float, few: int) -> DataFrame:
    """The postings with `heavy` and `short`, and `at` in an order that has all heavy shingles, of over `few` texts, last.

    A text is short if the shingles looked at do not fill its prefix without heavy ones; positions of its postings mean nothing.
    """
    text = Window.partitionBy("h")
    heavy = some.withColumn("heavy", F.col("n") > few)
    before = F.sum(F.col("heavy").cast("int")).over(text.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    short = F.col("held") - F.sum(F.col("heavy").cast("int")).over(text) < prefix_length(similarity)
    return heavy.withColumn("short", short).withColumn("at", F.col("at") - before)


def reordered(sets: DataFrame, heavies: DataFrame, similarity: float) -> DataFrame:
    """(h, size, prefix, lights) of texts given with all their shingles in the first order, as (h, s).

    prefix is by exact counts over these texts; lights is that of the order that has the heavy shingles last, without them.
    """
    rows = sets.select("h", F.size("s").alias("size"), F.posexplode("s").alias("at", "s"))
    # counted and looked up by joins that split: one shingle can be in all of these texts
    found = rows.groupBy("s").agg(F.count("*").alias("n")).filter("n > 1").select("s", "n", F.lit(False).alias("heavy"))
    known = found.unionByName(heavies.select("s", F.lit(1).cast("long").alias("n"), F.lit(True).alias("heavy"))).groupBy("s").agg(F.max("n").alias("n"), F.max("heavy").alias("heavy"))
    known = stored(known, "shingle-counts").hint("merge")
    each = rows.join(known, "s", "left").select("h", "size", "at", "s", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("heavy", F.lit(False)).alias("heavy"))
    each = each.groupBy("h").agg(F.first("size").alias("size"), F.collect_list(F.struct("n", "s")).alias("v"), F.collect_list(F.when(~F.col("heavy"), F.struct("at", "s"))).alias("l"))
    first = lambda c: F.transform(F.slice(F.sort_array(c), F.lit(1), prefix_length(similarity).cast("int")), lambda x: x["s"])
    return stored(each.select("h", "size", first("v").alias("prefix"), first("l").alias("lights")), "reordered")


def alike_or_near(texts: DataFrame, roots: DataFrame, similarity: float, whole, few: int = 8) -> list[DataFrame]:
    """(a, b), a < b, in parts: all pairs that the filters of the exact join leave, of texts whose groups still differ.

    texts has h, size and, as prefix, the first shingles of each distinct text, at least those of its prefix, in the first order;
    whole gives all of them, as (h, s), for a table of h. A shingle pairs at most `few` texts with each text that has it,
    except among short texts, which have exact counts for their order.
    """
    some = stored(light_first(postings(texts, roots), similarity, few), "light-first")
    lights = some.filter(~F.col("short") & ~F.col("heavy") & (F.col("at") < prefix_length(similarity)))
    parts = [met_within(lights, similarity)]
    short = stored(some.filter("short").select("h").distinct(), "short")
    if short.isEmpty():
        return parts
    anew = reordered(whole(short), some.filter("heavy").select("s").distinct(), similarity)
    own = anew.join(roots.withColumnRenamed("node", "h"), "h", "left").select("h", F.coalesce("root", "h").alias("root"), "size", F.posexplode("lights").alias("at", "s"))
    parts.append(meeting(own, lights.select("s", "h", "root", "size", "at"), similarity, F.lit(True)))
    return [*parts, prefix_pairs(anew.select("h", "size", "prefix"), roots, similarity)]


def parity_bits(s: np.ndarray) -> bytes:
    """For each place, the parity of how many of the distinct hashes fall there; two to four places for each hash."""
    n = max(64, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits(np.bincount((s & np.uint64(n - 1)).astype(np.int64), minlength=n).astype(np.uint8) & 1, bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """A lower bound on how many hashes are in one of two sets only: differing places, after folding to one length."""
    a, b = (np.frombuffer(v, dtype=np.uint64) for v in (x, y))
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def not_too_different(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs that their parities leave: an exact filter, as alike sets differ in few hashes."""

    def run(batches):
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("na", "pa", "nb", "pb")]
            keep = [differing(x, y) <= (1 - similarity) / (1 + similarity) * (n + m) + 1e-6 for n, x, m, y in zip(*cols)]
            yield pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (texts.select(F.col("h").alias(k), F.col("size").alias(f"n{k}"), F.col("parity").alias(f"p{k}")).hint("merge") for k in "ab")
    full = pairs.join(left, "a").join(right, "b")
    return full.select("a", "b", "na", "pa", "nb", "pb").mapInArrow(run, "a long, b long")


def picked(texts: DataFrame, wanted: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """(h, text) of each h of a stored table. Up to `broadcast_rows` texts, counted first, are picked where they are
    read; beyond, by a merge join."""
    wanted = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted.hint("merge")
    return texts.select("h", "text").join(wanted, "h", "left_semi").dropDuplicates(["h"]).select("h", "text")


def shingle_sets(texts: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(h, s): the sorted distinct shingle hashes, packed, of each text of the pairs; hashed once, however many pairs it is in."""

    def run(batches):
        for b in batches:
            packed = [np.unique(shingle_hashes(t, width)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("h"), pa.array(packed, pa.binary())], names=["h", "s"])

    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "candidates")
    return stored(picked(texts, wanted).mapInArrow(run, "h long, s binary"), "candidate-sets")


def similar(pairs: DataFrame, every: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have at least the given Jaccard similarity, on whole texts."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb")):
                held, other = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(both >= similarity * (len(held) + len(other) - both) - 1e-9)
            yield pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = stored(not_too_different(pairs, texts, similarity), "pairs")
    sets = shingle_sets(every, pairs, width)
    # merge joins at any size: what is compared grows with the corpus, so no plan counts on broadcasts
    left, right = (sets.select(F.col("h").alias(k), F.col("s").alias(f"s{k}")).hint("merge") for k in "ab")
    full = pairs.join(left, "a").join(right, "b")
    return full.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, width: int = 5, similarity: float = 0.8, count: int = 8, radius: int = 2, bucket: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, h (64-bit hash of the text), root (h of its group).

    Equal texts share a group (null counts as empty); so do texts linked over near copies, and texts
    without any word.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    every = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    often = docs.sparkSession.sparkContext.broadcast(common_shingles(every.select("h", "text"), width))

    def run(batches):
        longs = pa.list_(pa.int64())
        # a few texts at a time, as all their shingles are held together
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            texts = b.column("text").to_pylist()
            fps = [word_fingerprints(t, count) for t in texts]
            fps = np.array(fps, dtype=np.uint64).reshape(-1, count).view(np.int64)
            sets = [np.unique(shingle_hashes(t, width)) for t in texts]
            size, parity = pa.array([len(s) for s in sets], pa.int32()), pa.array([parity_bits(s) for s in sets], pa.binary())
            prefix = pa.array([rarest_first(s, *often.value)[: prefix_and_spare(len(s), similarity)].view(np.int64) for s in sets], longs)
            yield pa.record_batch([b.column("doc_id"), b.column("h"), pa.array(list(fps), longs), size, parity, prefix], names=["doc_id", "h", "fps", "size", "parity", "prefix"])

    def ordered(batches):
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            found = [rarest_first(np.unique(shingle_hashes(t, width)), *often.value).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("h"), pa.array(found, pa.list_(pa.int64()))], names=["h", "s"])

    rows = stored(every.mapInArrow(run, f"doc_id {kind}, h long, fps array<long>, size int, parity binary, prefix array<long>"), "word-fingerprints")
    texts = stored(rows.groupBy("h").agg(F.count("*").alias("copies"), F.first(F.struct("fps", "size", "parity", "prefix")).alias("x")).select("h", "copies", "x.*"), "texts")
    met = stored(bucket_rows(texts, count, radius), "buckets")
    alike = lambda pairs: similar(pairs, every, texts, width, similarity)
    # the leaders met most often first: most texts of a large group find it through one of them
    led = stored(bucket_leaders(met), "leaders")
    links = stored(alike(as_pairs(frequent_leaders(met, led, 2))), "links")
    roots = stored(connected_components(links), "first-groups")
    rest = other_leaders(met, led, roots)
    links = stored(links.unionByName(alike(remaining_pairs(met, roots, bucket).unionByName(rest).distinct())), "links")
    roots = connected_components(links)
    # then everything else that can be alike
    whole = lambda wanted: picked(every, wanted).mapInArrow(ordered, "h long, s array<long>")
    rest = functools.reduce(DataFrame.unionByName, alike_or_near(texts, roots, similarity, whole))
    roots = connected_components(links.unionByName(alike(rest)))
    return rows.select("doc_id", "h").join(roots.withColumnRenamed("node", "h"), "h", "left").select("doc_id", "h", F.coalesce("root", "h").alias("root"))


def deduplicate(docs: DataFrame, width: int = 5, similarity: float = 0.8, count: int = 8, radius: int = 2, bucket: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal or near texts: the smallest doc_id's (null ones last).

    All columns stay, whatever their names. Null and empty texts and those without words are one group. Of
    repeated rows one stays; of rows that share doc_id and text but differ elsewhere, any one.
    """
    found = stored(classes(docs, width, similarity, count, radius, bucket, id_col, text_col), "near-classes")
    # the first row of each group stays; a group is only ever a partial minimum, never one task's rows
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")).alias("first")
    kept = stored(found.groupBy("root").agg(first).select(F.col("first.doc_id").alias("doc_id"), F.col("first.h").alias("h")), "near-kept")
    again = found.groupBy("doc_id", "h").agg(F.count("*").alias("n")).filter("n > 1")
    h = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    side = kept.hint("merge")
    stay = docs.join(side, (h == side["h"]) & docs[id_col].eqNullSafe(side["doc_id"]), "left_semi")
    if again.isEmpty():
        return stay
    names = [f"c{i}" for i in range(len(docs.columns))]
    one = stay.toDF(*names).withColumn("h", F.xxhash64(F.coalesce(F.col(names[docs.columns.index(text_col)]).cast("string"), F.lit(""))))
    return one.dropDuplicates([names[docs.columns.index(id_col)], "h"]).drop("h").toDF(*docs.columns)
