"""The corpus pipeline: five stages, each on all that its predecessor kept.

toxicity: documents that the classifier rejects go.
near_dedup: one document of each group of equal and near texts stays.
decontamination: documents that hold a benchmark item go.
secrets: secrets in the remaining texts are replaced by a mark.
packing: the remaining documents are packed into token sequences.

All stages work on whole texts, take null texts as empty and null ids as they are, keep the columns
given to them whatever their names, and turn an empty table into an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screentone.llm import decontamination, neardup, packing, secrets, toxicity
from screentone.llm.common import stored, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """Documents that score under the threshold, with all their columns.

    Null and empty texts get the model's bias alone; repeated rows get equal scores; without labels
    everything stays. Columns have other names inside, so that a given toxic_score stays as it is.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_col, text_col = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    found = toxicity.scored(docs.toDF(*names), model, id_col, text_col)
    return found.filter(F.col("toxic_score") < threshold).drop("toxic_score").toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are at least 0.8 alike: the smallest doc_id's.

    Null, empty and wordless texts are one group; of repeated rows one stays.
    """
    return neardup.deduplicate(docs, width=5, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts and all repeats of clean rows stay."""
    return decontamination.leaks(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark; n_chars follows, null and clean texts stay."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents in sequences of 1024; null and empty texts are an end token alone."""
    return packing.pack(docs, capacity=1024)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: The classifier, the latent search and the tokenizer have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's rows are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
