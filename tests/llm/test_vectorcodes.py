"""Vector codes against plain Python integers over all entries."""

import hashlib
import math

import numpy as np
import pytest

from screentone.llm import vectorcodes


def brute(rows, parts=4, rounds=4):
    """(vec_id, label, code, error, label_error, digest) of rows (vec_id, vector, label)."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(1024 * float(np.float32(x))) for x in r[1]] for r in kept]
    d = len(ints[0]) // parts
    cut = [[v[p * d : (p + 1) * d] for v in ints] for p in range(parts)]
    books = [[list(v) for v in c[:256]] for c in cut]
    nearest = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            mine = {}
            for v in cut[p]:
                mine.setdefault(nearest(v, book)[1], []).append(v)
            for i, vs in mine.items():
                book[i] = [sum(c) // len(vs) for c in zip(*vs)]
    out, by_label = [], {}
    for k, r in enumerate(kept):
        found = [nearest(cut[p][k], books[p]) for p in range(parts)]
        error = sum(s for s, _ in found)
        by_label[r[2]] = by_label.get(r[2], 0) + error
        out.append([r[0], r[2], bytes(i for _, i in found).hex(), error])
    said = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((*o, by_label[o[1]], said) for o in out), key=repr)


def found(spark, rows):
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, code int, of int")
    return sorted(map(tuple, vectorcodes.compress(d).collect()), key=repr)


def test_against_all_entries(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=8).astype(np.float32).tolist(), int(rng.integers(3))) for i in rng.permutation(420)]
    rows += [(i + 1000, (np.round(rng.normal(size=8) * 2) / 2).tolist(), None) for i in range(60)]  # ties
    rows += [rows[5], rows[5], (7777, rows[6][1], 1), (None, rows[7][1], 2)]
    rows += [(-1, None, 1), (-2, [0.5, None] * 4, 1), (-3, [float("nan")] * 8, 1), (-4, [float("inf")] * 8, None), (-5, [], 0)]
    assert found(spark, rows) == brute(rows)


def test_few_equal_and_huge_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0], 0) for i in range(5)]
    assert found(spark, rows) == brute(rows)
    rows += [(9, [1e9, -2e9, 3.0, 4.0], 1), (10, [1.5e9, 0.0, -3.0, 4.0], 1), (11, [1.4e9, 1.0, -3.0, 5.0], 1)]
    assert found(spark, rows) == brute(rows)


def test_empty_and_indivisible(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0, 2.0, 3.0], 0)]) == []


@pytest.mark.parametrize("spread", [3, 200, 100_000])
def test_masks_lose_no_entry(spread):
    rng = np.random.default_rng(spread)
    entries, queries = rng.integers(-spread, spread, (256, 5)), rng.integers(-2 * spread, 2 * spread, (700, 5))
    code, square = vectorcodes.Codebook(entries).nearest(queries)
    apart = ((queries[:, None] - entries) ** 2).sum(axis=2)
    assert (code == apart.argmin(axis=1)).all() and (square == apart.min(axis=1)).all()
