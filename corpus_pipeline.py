"""From raw documents to training tokens in five stages, each one operator of ``codonlake.llm``.

A stage takes (spark, docs, sf_dir) and returns the documents that go on; the last one returns token ids. Stages meet in
Parquet tables in the shared checkpoint folder, so a lost executor costs one stage's open work at most. The only
columns that stages rely on are those of ``documents`` (doc_id, text, lang, source, n_chars); clashing extra columns
are dropped at the first stage. Empty tables give empty results.

SQL cannot say the second model's marginals or sampled pieces, so there is no SQL for the whole; each stage is tested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codonlake.llm import common, jaccard_join, pii_crf, piece_sampler, quality_ledger, source_mix
from codonlake.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy of the rule ledger."""
    return quality_ledger.apply_policy(quality_ledger.ledger(docs.select(COLUMNS))).where("kept").select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by five-word shingles at similarity 0.8 or more, repeated rows included, one with the least id."""
    return jaccard_join.one_of_each(docs.select(COLUMNS), k=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii_crf.redacted(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them."""
    return source_mix.mixed_documents(docs.select(COLUMNS)).select(COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (two bytes each) with what a trainer needs to know of the document."""
    return piece_sampler.encode(docs.select(COLUMNS), packed=True).select(
        "doc_id", "lang", "source", "ids", (F.octet_length("ids") / 2).cast("long").alias("n_pieces"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", one_of_each_group),
    ("personal data", without_personal_data),
    ("source mix", mixed_sources),
    ("piece sampling", pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ship_package(spark)
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.stored(docs)
    return docs
