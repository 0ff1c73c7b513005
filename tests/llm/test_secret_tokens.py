"""Credentials of which a strong span is only a part, and long tokens."""

import pytest

from screentone.llm import secrets

HEX = "0123456789abcdef"


@pytest.mark.parametrize(
    "text, want",
    [
        (f"go postgres://user:{HEX}@host now", "go [SECRET] now"),
        (f"the Zk9-{HEX}-Qx7Lm2Pw9R end", "the [SECRET] end"),
        ("login=alice " + "a" * 60 + "B" + "c" * 50 + "7 end", "[SECRET] [SECRET] end"),
        (f"only {HEX} end", "only [SECRET] end"),
        ("password=Abcdefgh1jklmnopqrstu end", "[SECRET] end"),
    ],
)
def test_whole_token_is_redacted(spark, text, want):
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secrets.redact(rows).first()["text"] == want
