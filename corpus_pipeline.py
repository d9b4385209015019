"""Corpus preparation in five stages, each on all documents that the stage before it kept.

Every stage but the last returns the columns of ``documents``. Between stages the rows are written as Parquet
to the shared folder and read again, so a lost executor never costs more than a part of one stage; what a stage has written on its way goes with it.

Defined results: rows with null ids or texts and repeated rows pass through as the operators define; repeated rows are one document after
the near-duplicate stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontamination, packing, pii, shingles, simhash, toxicity
from vellum.llm.common import drop_tables, materialise, table, written
from vellum.llm.queries import word_tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("toxic_predicted") == 0).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts with a Jaccard similarity of 0.8 or more over shingles of five words."""
    return simhash.keep_one(docs, shingles.SHINGLE_WORDS, similarity=shingles.SIMILARITY)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced, and with it the terms that give it away."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences."""
    return packing.pack_documents(docs, word_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("personal data", hide_personal_data),
    ("packing", pack),
]

#: SQL expresses neither the classifier nor the tokenizer; the tests hold each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    since = written()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        drop_tables(spark, since, keep=(docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
