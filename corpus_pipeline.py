"""The corpus pipeline: STAGES in order over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and
returns the columns of ``documents``; the last returns token pieces and their
places in sequences. ``run`` writes each stage's result into the shared folder,
so a lost executor costs the current stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from promptledger.llm import decontaminate, near_dups, packing, quality, secrets
from promptledger.llm.shared import table, written

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those that score under 0.5. A null or empty text has the score of no words; null ids are scored alike."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of the least id (then of the least key, of equal rows one). Rows without an id stay."""
    return near_dups.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go. Null and empty texts, and rows without an id, that hold none stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced; every document stays, null texts as they are."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places; see ``pack_documents`` for null, empty and repeated rows."""
    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY), CAPACITY)


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]

#: SQL cannot express the learned classifier, so there is none; tests compare the stages with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
