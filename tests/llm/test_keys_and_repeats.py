"""Rows whose id and text join to one string, and benchmarks of repeated rows."""

import pytest

from screentone.llm import decontamination, secrets
from tests.llm import brute


def test_rows_that_join_to_one_string_keep_their_own_spans(spark):
    login = "login: bob@example.org password=abcdefghijklmnop host db.example.org:5432 "
    rows = [("1", "2:" + login), ("1:2", login), (None, login), ("null", login), ("4:null", login)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(r["doc_id"]): r for r in secrets.digest(secrets.secret_spans(docs)).collect()}
    for i, t in rows:
        assert got[i]["base_sha256"] == brute.secrets(t)[3]
    alone = {i: secrets.redact(spark.createDataFrame([(i, t)], "doc_id string, text string")).first()["text"] for i, t in rows}
    assert {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()} == alone
    assert "abcdefghijklmnop" not in "".join(alone.values())


@pytest.mark.parametrize("most", [1, 2])
def test_repeated_benchmark_rows_end(spark, most):
    item = "the quick brown fox jumps over the lazy dog near the old river bank at dawn while seven birds sing loudly"
    other = "completely different words about gardening tools and watering schedules for tomato plants during dry summers in southern valleys"
    benchmark = spark.createDataFrame([(7, item)] * 5 + [(8, other)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before " + item + " after"), (2, other), (3, "nothing of the kind here at all")], "doc_id long, text string")
    got = decontamination.leaks(docs, benchmark, most=most).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 7), (2, 8)]
    assert [r["doc_id"] for r in decontamination.leaks(docs, benchmark, most=most, keep=["doc_id", "text"]).collect()] == [3]
