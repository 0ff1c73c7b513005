"""Near copies that word fingerprints do not bring together."""

import random

import numpy as np

from screentone.llm import neardup, simhash
from tests.llm import brute


def kept(spark, texts, **more):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in neardup.deduplicate(rows, **more).collect()}


def want(texts):
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    return set(brute.components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-9))


def test_appended_and_cut_copies(spark):
    rng = random.Random(31)
    texts = []
    for k in range(60):
        w = [f"w{int(rng.paretovariate(0.6)) % 4000}" for _ in range(rng.randint(80, 400))]
        n = max(1, int(len(w) * rng.choice([0.1, 0.15, 0.17, 0.19])))
        more = [f"w{int(rng.paretovariate(0.6)) % 4000}" if k % 2 else f"new{rng.randrange(10**6)}" for _ in range(n)]
        texts += [" ".join(w), " ".join(w + more), " ".join(w[:-n])]
    rng.shuffle(texts)
    assert kept(spark, texts) == want(texts)


def test_near_copies_in_a_bucket_of_many(spark):
    rng = random.Random(32)
    words, texts = [f"w{i}" for i in range(150)], []
    for _ in range(100):
        w = rng.sample(words, 150)
        texts.append(" ".join(w))
        at = rng.randrange(149)
        w[at], w[at + 1] = w[at + 1], w[at]
        texts.append(" ".join(w))
    # one set of words: all fingerprints are equal, so all texts share every bucket
    rng.shuffle(texts)
    assert len(want(texts)) == 100 and kept(spark, texts) == want(texts)


def test_pairs_of_shingles_with_a_usual_group(spark):
    rng = random.Random(33)
    base = [rng.sample(range(30), 20) for _ in range(6)]
    sets = [rng.sample(range(30), 1) + rng.choice(base)[1:] for _ in range(60)]
    sets = [s if len(set(s)) == 20 else base[0] for s in sets]
    root = [h if rng.random() < 0.4 else rng.choice([0, 1]) for h in range(60)]
    rows = [(h, 20, sorted(s)[:5]) for h, s in enumerate(sets)]
    pairs = neardup.prefix_pairs(spark.createDataFrame(rows, "h long, size int, prefix array<long>"), spark.createDataFrame(list(enumerate(root)), "node long, root long"), 0.8)
    alike = lambda a, b: root[a] != root[b] and len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and all(a < b and root[a] != root[b] for a, b in got)
    want = {(a, b) for b in range(60) for a in range(b) if alike(a, b)}
    assert want and want <= set(got)


def test_shingles_of_many_texts_pair_only_those_without_rarer_ones(spark, monkeypatch):
    rng = random.Random(34)
    base, texts = [f"w{i}" for i in range(300)], []
    for _ in range(150):
        w = list(base)
        for at in rng.sample(range(300), 30):
            w[at] = f"new{rng.randrange(10**9)}"
        texts.append(" ".join(w))
        if rng.random() < 0.1:
            # alike to its model, but with another tenth of the words at the end
            texts.append(" ".join(w + [f"new{rng.randrange(10**9)}" for _ in range(30)]))
    # no shingle is known to be frequent, as if the corpus were many times the sample
    empty = np.zeros(0, dtype=np.uint64)
    monkeypatch.setattr(neardup, "common_shingles", lambda *a, **k: (empty, empty.astype(np.int64)))
    compared, similar = [], neardup.similar

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(neardup, "similar", counted)
    rng.shuffle(texts)
    assert kept(spark, texts) == want(texts)
    assert compared[-1] <= 8 * len(texts)


def test_heavy_shingles_lose_no_pair(spark):
    rng = random.Random(35)
    sets = []
    for k in range(240):
        if k % 3 == 0 or not sets:
            pool = rng.sample(range(40), rng.choice([10, 20, 30]))
            s = {*pool, *(rng.randrange(100, 10**6) for _ in range(rng.choice([0, 2, 10, 30])))}
        else:
            s = set(rng.choice(sets))
            for x in rng.sample(sorted(s), rng.randint(0, max(1, len(s) // 9))):
                s.remove(x)
                s |= {rng.choice([rng.randrange(40), rng.randrange(100, 10**6)])} if rng.random() < 0.5 else set()
        sets.append(s)
    root = [h if rng.random() < 0.6 else rng.choice([0, 1, 2]) for h in range(len(sets))]
    roots = spark.createDataFrame(list(enumerate(root)), "node long, root long")
    # shared shingles first: the worst order
    full = spark.createDataFrame([(h, sorted(s)) for h, s in enumerate(sets)], "h long, s array<long>")
    rows = [(h, len(s), sorted(s)[: neardup.prefix_and_spare(len(s), 0.8)]) for h, s in enumerate(sets)]
    texts = spark.createDataFrame(rows, "h long, size int, prefix array<long>")
    alike = lambda a, b: root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = {(a, b) for b in range(len(sets)) for a in range(b) if alike(a, b)}
    for few in (1, 8):
        parts = neardup.alike_or_near(texts, roots, 0.8, lambda w: full.join(w, "h", "left_semi"), few)
        got = [tuple(r) for p in parts for r in p.collect()]
        assert len(parts) == 3 and len(got) == len(set(got)) and all(a < b and root[a] != root[b] for a, b in got)
        assert want and want <= set(got)
