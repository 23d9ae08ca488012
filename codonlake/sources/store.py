"""ORF store (parquet by genome), its statistics, batch input lists, training tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException


def stored_genomes(spark: SparkSession, path: str) -> DataFrame:
    """Genome ids of a store: distinct values of its folders, for which rows are counted but no column is read. An absent store has none."""
    try:
        return spark.read.parquet(path).select(F.col("genome_id").cast("string")).distinct()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], "genome_id string")


def new_contigs(contigs: DataFrame, path: str) -> DataFrame:
    """Contigs of genomes that the store does not hold yet."""
    return contigs.join(stored_genomes(contigs.sparkSession, path), "genome_id", "left_anti")


def append_by_genome(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("genome_id").parquet(path)


def store_statistics(orfs: DataFrame, contigs: DataFrame) -> DataFrame:
    """One row: genomes, ORFs, bases, mean ORFs per genome."""
    a = orfs.agg(F.count("*").alias("orfs"))
    b = contigs.agg(F.count_distinct("genome_id").alias("genomes"), F.sum("length").alias("bp"))
    return b.join(F.broadcast(a), how="cross").select(
        "genomes", "orfs", "bp", (F.col("orfs") / F.col("genomes")).alias("mean_orfs"))


def orfs_per_genome(orfs: DataFrame) -> DataFrame:
    return orfs.groupBy("genome_id").agg(F.count("*").alias("orfs"))


def batch_list(sources: list[DataFrame], available: DataFrame) -> DataFrame:
    """Union of input lists (column ``line``, in reading order): comments and blanks dropped, the first
    mention of an id kept, status ``queued`` or ``missing``."""
    rows = None
    for i, s in enumerate(sources):
        part = s.select(F.lit(i).alias("list_no"), F.monotonically_increasing_id().alias("line_no"),
                        F.trim("line").alias("genome_id"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.where((F.col("genome_id") != "") & ~F.col("genome_id").startswith("#"))
    first = rows.groupBy("genome_id").agg(F.min(F.struct("list_no", "line_no")).alias("at"))
    known = available.select("genome_id").distinct().withColumn("_known", F.lit(True))
    return first.join(known, "genome_id", "left").select(
        "genome_id", F.col("at.list_no").alias("list_no"), F.col("at.line_no").alias("line_no"),
        F.when(F.col("_known"), "queued").otherwise("missing").alias("status"))


def genome_status(contigs: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per genome: ok, no_genes or bad_input, so that one bad genome does not stop a batch."""
    bad = F.max((F.length(F.translate("seq", "ACGTNRYWSKMBDHV", "")) > 0).cast("int"))
    base = contigs.groupBy("genome_id").agg(bad.alias("_bad"), F.sum("length").alias("bp"))
    genes = predictions.groupBy("genome_id").agg(F.count("*").alias("genes"))
    return base.join(genes, "genome_id", "left").select(
        "genome_id", "bp", F.coalesce("genes", F.lit(0)).alias("genes"),
        F.when((F.col("_bad") == 1) | (F.col("bp") == 0), "bad_input")
        .when(F.col("genes").isNull(), "no_genes").otherwise("ok").alias("status"))


def batch_summary(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count("*").alias("genomes"), F.sum("genes").alias("genes"))
