"""Long repeats: every removed byte against brute force over all windows."""

import hashlib
import random

import pytest

from screentone.llm import suffixes


def brute(rows, least=100):
    """(n_bytes, n_removed, n_spans, sha256) by row number; rows: (doc_id, text), in any order."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = set(), {}
    for i in order:
        t = (rows[i][1] or "").encode()
        hit = bytearray(len(t))
        for s in range(len(t) - least + 1):
            w = t[s : s + least]
            if w in seen:
                hit[s : s + least] = b"\1" * least
            seen.add(w)
        spans = sum(1 for k in range(len(t)) if hit[k] and (k == 0 or not hit[k - 1]))
        kept = bytes(c for c, h in zip(t, hit) if not h)
        out[i] = (len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return [(rows[i][0], *out[i]) for i in range(len(rows))]


def case(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeßé漢") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    make = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passages = [make(rng.randint(15, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [make(rng.randint(0, 60)) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 3)
            parts.insert(rng.randint(0, len(parts)), p[cut : len(p) - rng.randint(0, len(p) // 3)])
        text = rng.choice([" ", "\n", ""]).join(parts)
        if rows and rng.random() < 0.2:
            old = rng.choice(rows)[1] or ""
            at = rng.randint(0, len(old))
            text = rng.choice([old, old[:at] + "x" + old[at:], old[at:], text + old])
        rows.append((i * 3 - 20, text))
    rng.shuffle(rows)
    return rows


ODD = [
    (None, "null id " * 30),
    (1000, None),
    (1001, ""),
    (1002, "short"),
    (1003, "a" * 99),
    (1004, "a" * 100),
    (1005, "a" * 101),
    (1006, "ab" * 700),
    (1006, "ab" * 700),
    (1007, "0123456789" * 11),
    (1008, "x" * 50 + "0123456789" * 10 + "é" * 60),
]


def found(spark, rows, **how):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, h int, key string")
    got = suffixes.remove_repeats(d, **how).collect()
    return sorted(map(tuple, got), key=repr)


@pytest.mark.parametrize("seed, batches", [(1, 1), (2, 2), (3, 5)])
def test_against_all_windows(spark, seed, batches):
    rows = case(seed) + ODD
    assert found(spark, rows, batches=batches) == sorted(brute(rows), key=repr)


def test_crowded_grams_and_long_texts(spark, monkeypatch):
    rng = random.Random(9)
    line = "one very common line of the whole corpus that is longer than one hundred bytes, so that it is found again and again"
    rows = [(i, "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 90))) + line + "".join(rng.choice("abcd ") for _ in range(80))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(doc_id, text) AS key")
    family = suffixes.Family()
    family.add(docs)
    marked = family.mixed
    spans = {}
    for crowd in (5, 10_000):
        spans[crowd] = set()
        for key, s, e in suffixes.resolve(docs, marked, 100, crowd=crowd).collect():
            spans[crowd] |= {(key, at) for at in range(s, e + 1)}
    assert spans[5] == spans[10_000] != set()
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    text = case(4, 8)[0][1] or ""
    column = suffixes.pa.array([text * 5, "b", text], suffixes.pa.string())
    assert sum(1 for _ in suffixes._blocks(column, 100)) > 2


def test_levels_merge_geometrically(spark):
    family = suffixes.Family()
    sizes = []
    for k in range(6):
        rows = [(100 * k + i, " ".join(f"w{(i * 7919 + j * 104729 + k * 1299709) % 99991}" for j in range(60))) for i in range(8)]
        family.add(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(doc_id, text) AS key"))
        sizes.append(len(family.levels))
    assert sizes == [1, 2, 2, 3, 2, 3] or max(sizes) <= 3
    total = sum(n for _, n in family.levels)
    assert total == sum(level.select("h", "whole").distinct().count() for level, _ in family.levels)


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(d).collect() == []
