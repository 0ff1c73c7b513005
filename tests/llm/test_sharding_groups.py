"""Groups of equal texts and repeated rows in shards."""

import random
from collections import Counter

from screentone.llm import sharding


def test_small_groups_stay_whole_and_large_ones_are_cut(spark):
    rng = random.Random(41)
    texts = [f"text {i} " + "x" * rng.randint(0, 300) for i in range(3000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for k in range(60):
        rows += [(10_000 + 10 * k + j, texts[k]) for j in range(rng.randint(1, 3))]
    rows += [(20_000 + j, "hot") for j in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    size = {i: len(t) + 16 for i, t in rows}
    total, text = sum(size.values()), dict(rows)
    load, held, places = Counter(), {}, {}
    for r in got:
        load[r["shard"]] += r["size"]
        held.setdefault(text[r["doc_id"]], Counter())[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    assert all(sum(c.values()) * 50 * 8 > total or len(c) == 1 for c in held.values())
    assert len(held["hot"]) > 1
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) - min(load.values()) <= total / 8 / 20 + 2 * max(size.values())


def test_repeated_rows_are_dealt_out(spark):
    rows = [(7, "same text")] * 20_000 + [(None, "no id")] * 10_000 + [(i, f"t{i}") for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sharding.shard(docs, shards=5)
    n = {r["shard"]: r["n"] for r in got.groupBy("shard").count().withColumnRenamed("count", "n").collect()}
    assert sum(n.values()) == 40_000 and len(n) == 5
    byte = {r["shard"]: r["b"] for r in got.groupBy("shard").sum("size").withColumnRenamed("sum(size)", "b").collect()}
    assert max(byte.values()) < 1.05 * min(byte.values())
    keys = docs.selectExpr("doc_id", "25L AS size", "0L AS text_crc32", "xxhash64(text) AS h", "xxhash64(cast(doc_id AS string)) & -16777216 | shiftrightunsigned(xxhash64(monotonically_increasing_id()), 40) AS sub")
    keys = sharding.stored(keys, "keys")
    parts = [r["count"] for r in sharding.dealt(keys, 80).groupBy("part").count().collect()]
    assert sum(parts) == 40_000 and max(parts) <= 2 * 40_000 / 80 + 1
