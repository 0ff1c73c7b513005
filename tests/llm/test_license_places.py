"""Where license notices stand, and which ones a place holds."""

import textwrap

import pytest

from screentone.llm import licenses


def labels(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["labels"] for r in licenses.licenses(rows).orderBy("doc_id").collect()]


@pytest.mark.parametrize("mark", ["", "// ", " * "])
def test_wrapped_notices(spark, mark):
    long = [(k, t) for k, t in licenses.TEMPLATES if len(t) > 90]
    texts = ["\n".join(mark + x for x in textwrap.wrap(t, 60)) for _, t in long]
    texts += ["some words\n" * 17 + t + "\nmore words" * 40 for t in texts]
    assert labels(spark, texts) == [k for k, _ in long] * 2


def test_every_notice_of_a_place(spark):
    bsd = next(t for k, t in licenses.TEMPLATES if k == "bsd")
    texts = [
        f"Licensed under CC BY 4.0. {bsd}.",
        "Licensed under CC BY-NC 4.0",
        "Licensed under CC BY 4.0",
        "Licensed under CC BY 4.0\nLicensed under CC BY-SA 4.0",
        "released under the BSD License",
        "released under the Columbia license",
        "Educational Community License, Version 2.0",
        "Licensed under the Educational Community License, Version 2.0",
        "Released under the MIT License",
    ]
    assert labels(spark, texts) == ["bsd,cc-by", "cc-by-nc", "cc-by", "cc-by,cc-by-sa", "", "", "", "", "mit"]
