"""FASTA as a Spark source: one row per record, plain or gzip, many records per file allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codonlake import constants as C
from codonlake.functions.sequence import invalid_letters

STEM = r"([^/]+?)(?:_predictions)?(?:\.(?:fasta|fa|fna|gff3?|txt))?(?:\.gz)?$"


def genome_of_file(path: Column) -> Column:
    """The folder ``genome_id=...`` of our own sinks, else the file name without extension and a ``_predictions`` ending."""
    own = F.regexp_extract(path, r"/genome_id=([^/]+)/", 1)
    named = F.url_decode(F.replace(own, F.lit("+"), F.lit("%2B")))
    return F.when(own != "", named).otherwise(F.regexp_extract(path, STEM, 1))


def gradable(genome_id: Column) -> Column:
    """Only results named by an accession can be graded against an annotation."""
    return genome_id.rlike(C.ACCESSION_PATTERN)


def parse_records(records: DataFrame, text: str = "value", path: str = "path") -> DataFrame:
    """Records split at line starts with ``>`` to contigs."""
    body = F.regexp_replace(F.col(text), r"^>", "")
    header = F.regexp_replace(F.substring_index(body, "\n", 1), r"\r$", "")
    letters = F.when(F.instr(body, "\n") > 0, F.substring(body, F.instr(body, "\n") + 1, F.length(body)))
    return (
        records.where(F.trim(F.col(text)) != "")
        .select(
            genome_of_file(F.col(path)).alias("genome_id"),
            F.substring_index(header, " ", 1).alias("contig_id"),
            F.trim(F.substring(header, F.length(F.substring_index(header, " ", 1)) + 1, F.length(header)))
            .alias("description"),
            F.upper(F.regexp_replace(F.coalesce(letters, F.lit("")), r"\s+", "")).alias("seq"),
        )
        .withColumn("length", F.length("seq").cast("long"))
    )


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The file is cut at ``\\n>``, so a record is a row and a large file is read by many tasks."""
    raw = spark.read.option("lineSep", "\n>").text(paths)
    return parse_records(raw.select("value", F.col("_metadata.file_path").alias("path")))


def write_fasta(contigs: DataFrame, path: str, width: int = 70) -> None:
    """One folder per genome, sequences wrapped at ``width``."""
    wrapped = F.regexp_replace("seq", "(.{%d})(?=.)" % width, "$1\n")
    about = F.col("description") if "description" in contigs.columns else F.lit("")
    line = F.concat(F.lit(">"), F.rtrim(F.concat_ws(" ", "contig_id", about)), F.lit("\n"), wrapped)
    contigs.select("genome_id", line.alias("value")).write.partitionBy("genome_id").text(path)


def alphabet_report(contigs: DataFrame) -> DataFrame:
    """Contigs with letters outside the IUPAC alphabet."""
    return contigs.select(
        "genome_id", "contig_id", "length", F.array_join(invalid_letters(F.col("seq")), "").alias("invalid_letters")
    ).withColumn("valid", F.col("invalid_letters") == "")
