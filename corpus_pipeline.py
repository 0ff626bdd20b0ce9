"""A corpus from raw documents to packed sequences: each stage is written and read again before the next.

The stages read the columns doc_id, text, lang, source and n_chars; all others, whatever their names, are kept by
all but the last, which reads doc_id and text only. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clastix.deploy import ship
from clastix.llm import decontaminate, jaccard, language, packing, secrets
from clastix.llm.scratch import collected, drop, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a language was recognised in, by a model of the documents' own labels.

    A document with a null or empty text, or one without letters, goes, as no language is recognised in it;
    a null id or label and repeated rows don't matter. An empty table stays empty.
    """
    return language.kept(docs, language.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, the one of the least id, and all others.

    Rows without an id, a text or a word stay; of rows that repeat an id the one of the least text stays. An
    empty table stays empty.
    """
    return jaccard.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Rows without an id or a text stay, repeated rows share their fate; an empty table or benchmark drops nothing.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in them replaced and n_chars set anew.

    Null and empty texts stay as they are; repeated rows are redacted alike. An empty table stays empty.
    """
    return secrets.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of documents: (bin, fill, doc_ids, starts, lengths).

    Rows without an id, a text or a piece are in none; repeated rows are packed each. An empty table gives none.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Naive Bayes, components and a random forest are no SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins that the stages make of the documents table: (bin, fill, doc_ids, starts, lengths).

    A stage's table, and what it wrote on the way, goes when the next one's is written; only the bins stay.
    """
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last: list[DataFrame] = []
    for name, stage in STAGES:
        with collected() as made:
            docs = written(stage(spark, docs, sf_dir), name)
        drop(*last, *made[:-1])
        last = made[-1:]
    return docs
