"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

One pass over all labelled training texts counts, for each hashed n-gram, the documents of either
class that hold it; the log ratio of the smoothed shares, drawn towards zero by its uncertainty, scales the binary
features. So every n-gram whose ratio the counts support takes part, however many they are. The linear
classifier is fitted on a bounded sample of the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screentone.llm.common import stored
from screentone.llm.langid import held_out
from screentone.llm.ngrams import Distinct, hashed

SIZES = (4, 5, 6)
BITS = 19


@dataclass
class Model:
    kept: np.ndarray  # sorted hashes in use
    weights: np.ndarray  # for each of them, its naive Bayes ratio times its coefficient
    bias: float

    def table(self) -> np.ndarray:
        w = np.zeros(1 << BITS, dtype=np.float32)
        w[self.kept] = self.weights
        return w


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", broadcast_rows: int = 1_000_000) -> DataFrame:
    """(text, y) of the training rows: labelled, not held out. The labels are broadcast while they
    have at most `broadcast_rows` rows (16 bytes each); beyond that the join shuffles."""
    y = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, 3, 1)).groupBy(F.col(id_col).alias("i")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    if y.count() <= broadcast_rows:
        y = F.broadcast(y)
    return docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(y, "i")


def class_counts(rows: DataFrame) -> DataFrame:
    """(h, n0, n1): for each hashed n-gram the documents of either class that hold it, over all rows.

    Tasks add up their own rows and send one row per hash they met; the table has at most 2^BITS + 1
    rows, whatever the corpus. The row h = 2^BITS counts the documents themselves.
    """

    def run(batches):
        n = np.zeros((2, (1 << BITS) + 1), dtype=np.int64)
        distinct = Distinct(BITS)
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                n[y, distinct(hashed(t, SIZES, BITS))] += 1
                n[y, -1] += 1
        at = np.flatnonzero(n.sum(axis=0))
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(n[0, part]), pa.array(n[1, part])], names=["h", "n0", "n1"])

    counted = rows.select("text", "y").mapInArrow(run, "h int, n0 long, n1 long").groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return stored(counted, "class-counts")


def sure_ratios(n0: np.ndarray, n1: np.ndarray, docs0: int, docs1: int, errors: float = 2.0, least: int = 4) -> np.ndarray:
    """Naive Bayes log-count ratios, each nearer to zero by `errors` of its standard errors; zero if that
    crosses it or if fewer than `least` documents hold the n-gram."""
    ratio = np.log((n1 + 1) / (docs1 + 2)) - np.log((n0 + 1) / (docs0 + 2))
    sure = np.abs(ratio) - errors * np.sqrt(1 / (n0 + 1) + 1 / (n1 + 1))
    return np.where((sure > 0) & (n0 + n1 >= least), np.sign(ratio) * sure, 0.0).astype(np.float32)


def fit(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, prior: float, steps: int = 250, rate: float = 0.1, penalty: float = 3e-4, chunk: int = 1 << 21) -> tuple[np.ndarray, float]:
    """Logistic regression on binary rows (places of their ones) times ratio; the bias is moved half way
    (in log odds) from the sample's balance to the prior. Rows are taken about `chunk` ones at a time."""
    size = np.array([len(x) for x in rows])
    upto = np.append(0, np.cumsum(size))
    cuts = np.unique(np.searchsorted(upto, np.arange(0, upto[-1] + chunk, chunk))).clip(0, len(rows))
    parts = [(lo, hi, np.concatenate(rows[lo:hi]), np.repeat(np.arange(hi - lo), size[lo:hi])) for lo, hi in zip(cuts[:-1], cuts[1:])]
    w, b = np.zeros(len(ratio)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        scaled, gw, gb = w * ratio, penalty * w, 0.0
        for lo, hi, at, row in parts:
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=scaled[at], minlength=hi - lo) + b, -30, 30)))
            g = (p - y[lo:hi]) / len(y)
            gw += np.bincount(at, weights=g[row], minlength=len(w)) * ratio
            gb += float(g.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / a) / (np.sqrt(v / c) + 1e-8)
        b -= rate * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    return w * ratio, b + 0.5 * (np.log(prior) - np.log(share / (1 - share)))


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, errors: float = 2.0, least: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Count over all training rows, then fit on about `sample` of them (half of each class, by hash).

    Every n-gram with a ratio (see sure_ratios) takes part; at most 2^BITS of them reach the driver.
    Without rows of both classes the model scores the prior.
    """
    rows = labelled(docs, labels, id_col, text_col, label_col)
    got = class_counts(rows).toArrow()
    n = np.zeros((2, (1 << BITS) + 1), dtype=np.int64)
    for k in (0, 1):
        n[k, got.column("h").to_numpy()] = got.column(f"n{k}").to_numpy()
    docs0, docs1 = int(n[0, -1]), int(n[1, -1])
    if not docs0 or not docs1:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), -4.0 if not docs1 else 4.0)
    ratio = sure_ratios(n[0, :-1], n[1, :-1], docs0, docs1, errors, least)
    kept = np.flatnonzero(ratio)
    shared = docs.sparkSession.sparkContext.broadcast(kept)
    chance = F.when(F.col("y") == 1, F.lit(min(1.0, sample / 2 / docs1))).otherwise(F.lit(min(1.0, sample / 2 / docs0)))
    drawn = rows.filter(F.shiftrightunsigned(F.xxhash64("i", F.lit(5)), 11) / F.lit(float(1 << 53)) < chance)

    def run(batches):
        distinct = Distinct(BITS)
        place = np.full(1 << BITS, -1, dtype=np.int32)
        place[shared.value] = np.arange(len(shared.value), dtype=np.int32)
        for b in batches:
            x = []
            for t in b.column("text").to_pylist():
                p = place[distinct(hashed(t, SIZES, BITS))]
                x.append(p[p >= 0].tobytes())
            yield pa.record_batch([b.column("i").cast(pa.string()), b.column("y"), pa.array(x, pa.binary())], names=["i", "y", "x"])

    got = drawn.select(F.col("i").cast("string").alias("i"), "text", "y").mapInArrow(run, "i string, y int, x binary").collect()
    got = sorted((r["i"], r["y"], bytes(r["x"])) for r in got)
    if not got:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(docs1 / docs0)))
    w, b = fit([np.frombuffer(x, dtype=np.int32) for *_, x in got], np.array([y for _, y, _ in got], dtype=np.float64), ratio[kept].astype(np.float64), docs1 / docs0)
    return Model(kept, w.astype(np.float32), b)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs plus toxic_score (0 to 1) of each whole text; all columns stay, one of that name is replaced.

    Null and empty texts have no n-grams but their ends and get the model's bias alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop("toxic_score")

    def score(texts):
        m = shared.value
        w, distinct = m.table(), Distinct(BITS)
        for batch in texts:
            out = np.zeros(len(batch))
            for k, t in enumerate(batch):
                ids = hashed(t or "", SIZES, BITS)
                ids = ids[w[ids] != 0]
                out[k] = m.bias + float(w[distinct(ids)].sum(dtype=np.float64))
            yield 1 / (1 + np.exp(-np.clip(out, -50, 50)))

    def run(batches):
        def texts(held):
            for b in batches:
                held.append(b)
                yield b.column(b.schema.get_field_index(text_col)).to_pylist()

        held: list = []
        for s in score(texts(held)):
            b = held.pop()
            yield pa.record_batch([*b.columns, pa.array(s)], names=[*b.schema.names, "toxic_score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*base.schema.fields, StructField("toxic_score", DoubleType())])
    return base.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 if score >= threshold).

    held_out: crc32(doc_id as text) mod 3 is 1 (a null doc_id counts as empty text); such rows never
    train. Repeated labels of one document count once, the highest. Repeated rows get equal scores;
    an empty table gives an empty result; other columns are ignored.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # only the score comes back from Python
    found = scored(some, model).drop("text")
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= threshold).cast("int").alias("predicted"))
