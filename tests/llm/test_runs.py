"""Periodic runs against brute force over all periods and places."""

import hashlib
import random
import zlib

import pytest

from screentone.llm import runs


def brute_runs(x):
    out = []
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            n = i - s + q
            if i > s and n >= max(12, 2 * q) and all(any(x[s + k] != x[s + k + p] for k in range(n - p)) for p in range(1, q)):
                out.append((s, n, q))
            i += i == s
    return sorted(out)


def brute(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        if h % 10 == 0:
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    top = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1]
    longest = [top[0][0], top[0][1], top[0][2], 1000 * top[0][1] // top[0][2]] if top else [None] * 4
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *longest, sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in drop)))


def words(rng, n, k):
    x = [f"w{rng.randrange(k)}" for _ in range(n)]
    if n > 20 and rng.random() < 0.6:
        a = rng.randrange(n)
        p = rng.randint(1, (n - a) // 3 + 1)
        x[a:] = [x[a + (i - a) % p] for i in range(a, n)]
    if n > 60 and rng.random() < 0.5:
        b = rng.randrange(n - 40)
        x[b + 20 : b + 40] = x[b : b + 20]
    return x


def rows(seed, n=60):
    rng = random.Random(seed)
    out = [(i, rng.choice([" ", "\n", "\t "]).join(words(rng, rng.randint(0, 220), rng.choice([1, 2, 3, 9, 500])))) for i in range(n)]
    odd = [(None, "null id " * 9), (901, None), (902, ""), (903, " \n"), (904, "a\xa0b " * 8), (905, "é " * 11), (906, "é " * 12)]
    return out + odd + out[:2]


@pytest.mark.parametrize("tiled", [False, True])
def test_against_all_periods(spark, tiled):
    given = rows(4)
    d = spark.createDataFrame([(i, t, 5, "x") for i, t in given], "doc_id long, text string, start int, key string")
    got = runs.periodic_runs(d, long_chars=150 if tiled else 1 << 16).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute(i, t) for i, t in given), key=repr)


def test_tiles_of_long_documents(spark, monkeypatch):
    rng = random.Random(6)
    given = [(i, " ".join(sum((words(rng, rng.randint(100, 400), 40) for _ in range(3)), []))) for i in range(6)] + [(50, "z " * 700)]
    d = spark.createDataFrame(given, "doc_id long, text string")
    want = sorted((brute(i, t) for i, t in given), key=repr)
    assert sorted(map(tuple, runs.periodic_runs(d).collect()), key=repr) == want
    # small tiles: many of them for each octave, whose fragments meet only when stitched
    tiles = []
    for batch in runs._tiles([runs.pa.record_batch([runs.pa.array(range(len(given))), runs.pa.array([i for i, _ in given]), runs.pa.array([t for _, t in given])], names=list("kit"))]):
        tiles.append(batch)
    whole = len(tiles)
    monkeypatch.setattr(runs, "TILE_WORDS", 32)
    tiles = list(runs._tiles([runs.pa.record_batch([runs.pa.array(range(len(given))), runs.pa.array([i for i, _ in given]), runs.pa.array([t for _, t in given])], names=list("kit"))]))
    assert len(tiles) > 3 * whole
    fragments = spark.createDataFrame(runs.pa.Table.from_batches(list(runs._fragments(tiles))).to_pandas())
    stitched = {r["key"]: sorted((x["s"], x["n"], x["q"]) for x in r["runs"]) for r in runs._stretches(fragments).collect()}
    for k, (i, t) in enumerate(given):
        w = runs.planted(runs.words_of(t), i)
        x = runs.codes_of(w, runs.vocabulary())
        assert [r for r in stitched.get(k, []) if runs.primitive(x[r[0] :], r[2])] == brute_runs(w)


def test_z_function():
    rng = random.Random(3)
    for _ in range(300):
        s = [rng.randrange(2) for _ in range(rng.randint(1, 40))]
        z = runs.z_function(s, len(s))
        for q in range(1, len(s)):
            k = 0
            while q + k < len(s) and s[k] == s[q + k]:
                k += 1
            assert z[q] == k


def test_empty(spark):
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
