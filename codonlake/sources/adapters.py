"""Turn a table of texts into contigs, so that every operator can run on the given tables.

A text keeps its letters only; each letter is mapped to a base by a fixed table (X -> N, so that
unknown bases occur). The whole text is used. A genome is one source, its contigs are the documents of
that source, its taxonomic group is one of four, by a hash of the source name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codonlake.functions.sequence import strip_to_letters

# --- fixed values: letter to base -----------------------------------------------------------------
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "ACGTTGCAACGTTGCAACGTTGCNAC"


def documents_as_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seq = F.translate(strip_to_letters(F.col("text")), LETTERS, BASES)
    return docs.select(
        F.col("source").alias("genome_id"),
        F.col("doc_id").cast("string").alias("contig_id"),
        F.concat(F.lit("group"), (F.conv(F.substring(F.md5("source"), 1, 8), 16, 10).cast("long") % 4).cast("string")).alias("tax_group"),
        seq.alias("seq"),
    ).select("*", F.length("seq").cast("long").alias("length"))
