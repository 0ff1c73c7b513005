import random

import corpus_pipeline
from screentone.llm import decontamination


def test_stages_in_order(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    rows = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows[name] = docs
        if name != "packing":
            assert docs.columns == rows["input"].columns
    n = {k: v.count() for k, v in rows.items()}
    assert n["input"] > n["toxicity"] > n["near_dedup"] > n["decontamination"] == n["secrets"]
    texts = [r["text"] for r in rows["near_dedup"].select("text").collect()]
    assert len(texts) == len(set(texts))
    items = [b" ".join(decontamination.words(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = [b" ".join(decontamination.words(r["text"])) for r in rows["decontamination"].select("text").collect()]
    assert not any(i in t for i in items for t in left)
    packed = {r["doc_id"] for r in rows["packing"].select("doc_id").collect()}
    assert packed == {r["doc_id"] for r in rows["secrets"].select("doc_id").collect()}


def test_planted_cases(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    rng = random.Random(0)
    clean = [" ".join("".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(3)) for _ in range(150)) for _ in range(3)]
    near = clean[0].split()
    near[40] = "altered"
    planted = [(10**6, clean[0]), (10**6 + 1, " ".join(near)), (10**6 + 2, clean[1]), (10**6 + 3, clean[1]), (10**6 + 4, f"{clean[2]} {item} {clean[2]}"), (10**6 + 5, clean[2] + " password=abcdefghij123456")]
    more = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in planted], docs.schema)
    d = docs.unionByName(more)
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, d, sf_dir).write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
    left = {r["doc_id"]: r["text"] for r in d.filter("doc_id >= 1000000").collect()}
    assert set(left) == {10**6, 10**6 + 2, 10**6 + 5}
    assert left[10**6 + 5].endswith(" [SECRET]")
