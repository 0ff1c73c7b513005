"""Language identification by error-correcting output codes.

Every language gets a binary codeword. One linear classifier for each bit predicts it from character
n-gram frequencies; decoding weighs each bit's loss by how well that bit is predicted for the
language, picks the nearest codeword and flags texts whose two nearest lie close together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screentone.llm.ngrams import hashed


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """n codewords of -1 and +1 (rows). Up to 7 languages: the exhaustive code; more: the best of 200
    random codes of 8 * log2(n) bits by least distance between rows."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        cols = range(1, 2 ** (n - 1))
        return np.array([[1 if i == 0 else (-1 if (c >> (i - 1)) & 1 else 1) for c in cols] for i in range(n)], dtype=float)
    rng = np.random.default_rng(seed)
    width = int(8 * np.ceil(np.log2(n)))
    best, far = None, -1
    for _ in range(200):
        c = np.where(rng.random((n, width)) < 0.5, -1.0, 1.0)
        d = (width - c @ c.T) / 2 + np.eye(n) * width
        usable = (abs(c.sum(axis=0)) < n).all()
        if usable and d.min() > far:
            best, far = c, d.min()
    return best


@dataclass
class Model:
    sizes: tuple[int, ...] = (1, 2, 3)
    bits: int = 12
    languages: list[str] = field(default_factory=list)
    code: np.ndarray | None = None
    weights: np.ndarray | None = None  # hash x bit
    bias: np.ndarray | None = None
    trust: np.ndarray | None = None  # language x bit

    def features(self, text: str) -> np.ndarray:
        x = np.bincount(hashed(text, self.sizes, self.bits), minlength=1 << self.bits).astype(np.float32)
        x = np.sqrt(x)
        return x / max(float(np.linalg.norm(x)), 1e-9)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Probability of each language: softmax of minus the weighted logistic losses."""
        loss = np.logaddexp(0, -self.code[None] * margins[:, None, :])
        total = (loss * self.trust[None]).sum(axis=2) * self.code.shape[1]
        p = np.exp(-(total - total.min(axis=1, keepdims=True)))
        return p / p.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, str]], model: Model, steps: int = 150, penalty: float = 1e-4) -> Model:
    """Fit the bit classifiers on (features, language) rows by full-batch gradient steps."""
    model.languages = sorted({lang for _, lang in rows})
    if not model.languages:
        return model
    model.code = codewords(len(model.languages))
    x = np.stack([f for f, _ in rows])
    y = model.code[[model.languages.index(lang) for _, lang in rows]]
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        g = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) / len(x)
        gw, gb = (x.T @ g + penalty * w).astype(np.float32), g.sum(axis=0).astype(np.float32)
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.3 * (mw / a) / (np.sqrt(vw / c) + 1e-8)
        b -= 0.3 * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    model.weights, model.bias = w, b
    right = (y * (x @ w + b) > 0).astype(float)
    of = np.array([model.languages.index(lang) for _, lang in rows])
    trust = np.stack([right[of == k].mean(axis=0) for k in range(len(model.languages))])
    model.trust = trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9)
    return model


def held_out(id_col: str, mod: int, rest: int):
    """crc32 of the id's text modulo mod equals rest; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(mod)) == rest


def train(docs: DataFrame, sample: int = 2400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a bounded sample: about `sample` rows, in equal parts for each language, drawn by hash.

    Only rows with a language and a text, whose crc32(doc_id) mod 5 is not 0, are looked at.
    """
    model = Model()
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col, 5, 0)).select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return model
    each = max(1, sample // len(counts))
    chance = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))]), F.col("lang"))
    drawn = rows.filter(F.shiftrightunsigned(F.xxhash64("i", F.lit(3)), 11) / F.lit(float(1 << 53)) < chance)

    def run(batches):
        m = Model()
        for b in batches:
            x = [m.features(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("lang"), pa.array(x, pa.binary())], names=["lang", "x"])

    got = drawn.select("lang", "text").mapInArrow(run, "lang string, x binary").collect()
    got = sorted(((r["lang"], bytes(r["x"])) for r in got))
    return fit([(np.frombuffer(x, dtype=np.float32), lang) for lang, x in got], model)


def predict(docs: DataFrame, model: Model, margin: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, ambiguous.

    Text that is null or has no letter gives 'und' with score 0, as does a model without languages.
    ambiguous: the two nearest languages' probabilities differ by less than `margin`. Ties go to the
    first language by name. Repeated rows get equal answers; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            texts, lettered = b.column(1).to_pylist(), b.column(2).to_pylist()
            n = len(texts)
            lang, score, unsure = ["und"] * n, np.zeros(n), np.zeros(n, bool)
            at = [i for i in range(n) if lettered[i] and m.languages]
            for lo in range(0, len(at), 256):
                part = at[lo : lo + 256]
                p = m.decode(m.margins(np.stack([m.features(texts[i]) for i in part])))
                order = np.argsort(-p, axis=1, kind="stable")
                for k, i in enumerate(part):
                    lang[i] = m.languages[order[k, 0]]
                    score[i] = p[k, order[k, 0]]
                    unsure[i] = p.shape[1] > 1 and score[i] - p[k, order[k, 1]] < margin
            yield pa.record_batch([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    text = F.col(text_col).cast("string")
    lettered = F.coalesce(text.rlike("\\p{L}"), F.lit(False))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), lettered.alias("lettered")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
