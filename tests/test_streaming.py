"""Streams against the same functions on batches of their rows."""

from pyspark.sql import functions as F

from screentone import fixtures as fx
from screentone.operators import settings
from screentone.sources import artwork
from screentone.streaming import requests


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def test_latest(spark, sf_dir, tmp_path):
    s = requests.latest_requests(requests.read_requests(spark, sf_dir))
    got = requests.run_to_table(s, "latest", "complete", str(tmp_path))
    assert rows(got) == rows(requests.latest_requests(fx.render_requests(spark, sf_dir)))


def test_debounce_emits_closed_gaps(spark, sf_dir, tmp_path):
    s = requests.debounce(requests.read_requests(spark, sf_dir), "6 hours", "1 hour")
    got = requests.run_to_table(s, "debounced", "append", str(tmp_path))
    batch = requests.debounce(fx.render_requests(spark, sf_dir), "6 hours")
    end = fx.render_requests(spark, sf_dir).agg(F.max("ts")).first()[0]
    closed = batch.filter(F.col("last_ts") + F.expr("INTERVAL 6 HOURS") <= F.lit(end) - F.expr("INTERVAL 1 HOUR"))
    assert rows(got) == rows(closed) and got.count() > 0


def test_edit_sessions_equal_the_batch_form(spark, sf_dir, tmp_path):
    given = fx.render_requests(spark, sf_dir)
    # four files that overlap in time, then a request that moves the watermark past everything
    for i in range(4):
        given.filter(F.pmod(F.xxhash64("generation"), F.lit(4)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.sql("SELECT -1L AS document_id, -1L AS generation, 'end' AS setting_key, TIMESTAMP '2100-01-01' AS ts, 0e0 AS value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = requests.run_to_table(requests.coalesce_edits_stream(stream, "24 hours", "4000 days"), "edits", "append", str(tmp_path / "cp"))
    want = requests.coalesce_edits(given, "24 HOURS")
    assert got.count() > 0 and rows(got.filter("document_id >= 0")) == rows(want)


def test_edits_wait_for_the_watermark(spark, tmp_path):
    at = "CAST('2024-01-01' AS TIMESTAMP) + make_interval(0, 0, 0, 0, 0, {}, 0)"
    rows_of = [[(1, 1, "a", 0, 1.0), (1, 4, "a", 30, 9.0)], [(1, 3, "b", 20, 7.0), (1, 2, "a", 10, 2.0)], [(2, 5, "c", 200, 0.0)]]
    for i, part in enumerate(rows_of):
        d = spark.createDataFrame(part, "document_id long, generation long, setting_key string, minute int, value double")
        d.withColumn("ts", F.expr(at.format("minute"))).drop("minute").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema("document_id long, generation long, setting_key string, value double, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = requests.run_to_table(requests.coalesce_edits_stream(stream, "15 minutes", "60 minutes"), "late_edits", "append", str(tmp_path / "cp"))
    # the b between the two a's came later than both, and still ends the first gesture
    assert rows(got.select("gesture", "setting_key", "before", "after", "n")) == sorted([(2.0, 1.0, 1, 2, "a"), (7.0, 7.0, 2, 1, "b"), (9.0, 9.0, 3, 1, "a")], key=repr)


def test_ingest(spark, sf_dir, tmp_path):
    docs = fx.documents_json(spark, sf_dir).limit(200).unionByName(spark.createDataFrame([(-1, "not json"), (-2, '{"format":"other","version":1}')], "document_id long, content string"))
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("document_id long, content string").parquet(str(tmp_path / "in"))
    requests.ingest(stream, str(tmp_path / "ok"), str(tmp_path / "held"), str(tmp_path / "cp")).awaitTermination()
    want = settings.migrate_documents(artwork.parse_documents(docs).filter("accepted"))
    ok = spark.read.parquet(str(tmp_path / "ok"))
    assert ok.count() == want.count() and {r["version"] for r in ok.select("version").distinct().collect()} == {5}
    held = spark.read.parquet(str(tmp_path / "held"))
    assert ok.count() + held.count() == 202 and {-1, -2} <= {r["document_id"] for r in held.collect()}
