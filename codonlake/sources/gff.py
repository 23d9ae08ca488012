"""GFF3 as source and sink."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from codonlake.operators.distribute import running_total
from codonlake.session import ensure_checkpoint_dir
from codonlake.sources.fasta import genome_of_file

SCHEMA = ("seqid string, source string, type string, start long, end long, score string, strand string, "
          "phase string, attributes string")


def read_gff(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    raw = spark.read.csv(paths, sep="\t", comment="#", schema=SCHEMA, quote="")
    return raw.select("*", genome_of_file(F.col("_metadata.file_path")).alias("genome_id"))


def reference_intervals(gff: DataFrame, fallback: bool = True) -> DataFrame:
    """Distinct coordinates of CDS rows; per genome without CDS its gene rows, else all its rows."""
    kind = F.when(F.col("type") == "CDS", 0).when(F.col("type") == "gene", 1).otherwise(2)
    rows = gff.withColumn("_kind", kind)
    if not fallback:
        rows = rows.where("_kind = 0")
    else:
        best = rows.groupBy("genome_id").agg(F.min("_kind").alias("_best"))
        rows = rows.join(best, "genome_id").where("_kind = _best or _best = 2")
    return rows.select("genome_id", F.col("seqid").alias("contig_id"), F.col("start").alias("genome_start"),
                       F.col("end").alias("genome_end")).distinct()


def reference_cds(gff: DataFrame) -> DataFrame:
    """CDS rows with strand and length."""
    return gff.where("type = 'CDS'").select(
        "genome_id", F.col("seqid").alias("contig_id"), F.col("start").alias("genome_start"),
        F.col("end").alias("genome_end"), F.when(F.col("strand") == "+", "forward").otherwise("reverse").alias("strand"),
        (F.col("end") - F.col("start") + 1).alias("length"))


def attribute_map(attributes: Column) -> Column:
    """``a=1;b=2`` as a map; the first value of a repeated key counts, pairs without ``=`` are skipped."""
    pairs = F.filter(F.split(attributes, ";"), lambda p: p.contains("="))
    keys = F.transform(pairs, lambda p: F.trim(F.substring_index(p, "=", 1)))
    values = F.transform(pairs, lambda p: F.get(F.split(p, "="), F.lit(1)))
    entries = F.arrays_zip(keys.alias("k"), values.alias("v"))
    first = F.filter(entries, lambda e, i: F.array_position(keys, e["k"]) == i + 1)
    return F.map_from_entries(first)


def biotype(attributes: Column) -> Column:
    """Value of the first ``gene_biotype=`` or ``gbkey=`` pair, else unknown."""
    pairs = F.filter(F.split(attributes, ";"),
                     lambda p: p.contains("gene_biotype=") | p.contains("gbkey="))
    value = F.get(F.split(F.get(pairs, F.lit(0)), "="), F.lit(1))
    return F.coalesce(value, F.lit("unknown"))


def biotype_counts(gff: DataFrame) -> DataFrame:
    genes = gff.where("type = 'gene'")
    return genes.groupBy("genome_id", biotype(F.col("attributes")).alias("biotype")).agg(F.count("*").alias("n"))


def noncoding_counts(gff: DataFrame) -> DataFrame:
    """Genes, genes with CDS, genes without, per genome."""
    c = gff.groupBy("genome_id").agg(F.count_if(F.col("type") == "gene").alias("genes"),
                                     F.count_if(F.col("type") == "CDS").alias("coding"))
    return c.withColumn("noncoding", F.col("genes") - F.col("coding"))


def read_predictions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Distinct coordinates of a result file: comments, short rows and non-integer rows are skipped."""
    raw = spark.read.text(paths).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("path"))
    f = F.split("line", "\t")
    rows = raw.where(~F.col("line").startswith("#") & (F.col("line") != "") & (F.size(f) >= 5))
    return rows.select(
        genome_of_file(F.col("path")).alias("genome_id"), f[0].alias("contig_id"),
        f[3].try_cast("long").alias("genome_start"), f[4].try_cast("long").alias("genome_end"),
    ).where("genome_start is not null and genome_end is not null").distinct()


def gene_numbers(predictions: DataFrame) -> DataFrame:
    """gene_no within the genome, by position. Exact for genomes of any size (no single-task window)."""
    order = ["contig_id", "genome_start", "genome_end", "strand"]
    return running_total(predictions.withColumn("_one", F.lit(1).cast("long")), ["genome_id"], order, "_one",
                         "gene_no").drop("_one")


def gff_lines(numbered: DataFrame, source: str = "codonlake") -> DataFrame:
    """genome_id, gene_no, line."""
    attrs = F.format_string("ID=gene_%d;rbs_score=%.2f;combined_score=%.2f", "gene_no", "rbs_score", "combined_score")
    line = F.concat_ws(
        "\t", F.col("contig_id"), F.lit(source), F.lit("CDS"), F.col("genome_start").cast("string"),
        F.col("genome_end").cast("string"), F.format_string("%.3f", "combined_score"),
        F.when(F.col("strand") == "forward", "+").otherwise("-"), F.lit("0"), attrs)
    return numbered.select("genome_id", "gene_no", line.alias("line"))


def write_gff(predictions: DataFrame, path: str, source: str = "codonlake") -> None:
    """One folder per genome. Every part file starts with the version line, so each is valid by itself."""
    lines = gff_lines(gene_numbers(predictions), source)
    placed = lines.repartition("genome_id", F.floor(F.col("gene_no") / 100_000)).sortWithinPartitions("genome_id", "gene_no")
    first = (F.col("gene_no") % 100_000 == 0) | (F.col("gene_no") == 1)
    text = F.when(first, F.concat(F.lit("##gff-version 3\n"), F.col("line"))).otherwise(F.col("line"))
    placed.select("genome_id", text.alias("value")).write.partitionBy("genome_id").text(path)


CSV_COLUMNS = ["Gene ID", "Start", "End", "Length", "Strand", "Combined Score", "RBS Score"]


def csv_table(numbered: DataFrame) -> DataFrame:
    """The result table as exported: a score of 0 or null in the last column reads N/A."""
    rbs = F.when(F.coalesce("rbs_score", F.lit(0.0)) == 0, "N/A").otherwise(F.col("rbs_score").cast("string"))
    return numbered.select(
        "genome_id", F.format_string("gene_%d", "gene_no").alias("Gene ID"), F.col("genome_start").alias("Start"),
        F.col("genome_end").alias("End"), F.col("length").alias("Length"), F.col("strand").alias("Strand"),
        F.col("combined_score").alias("Combined Score"), rbs.alias("RBS Score"))


def write_csv(predictions: DataFrame, path: str) -> None:
    csv_table(gene_numbers(predictions)).write.partitionBy("genome_id").csv(path, header=True)


# ---- result table view -----------------------------------------------------------------------------
def page(predictions: DataFrame, order: list[Column], number: int, size: int, strand: str | None = None) -> DataFrame:
    """One page of the result table: an ordered take with offset, which Spark runs as a bounded top-k."""
    rows = predictions if strand is None else predictions.where(F.col("strand") == strand)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


@dataclass(frozen=True)
class PageIndex:
    """Rows stored in range partitions along an order, with the number of rows of each."""

    rows: DataFrame
    order: list[Column]
    counts: list[int]

    @property
    def total(self) -> int:
        return sum(self.counts)

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 1): only the partitions that hold its rows are read, however deep it lies."""
        first, parts, before = (number - 1) * size, [], 0
        skip = first
        for part, n in enumerate(self.counts):
            if before + n > first and before < first + size:
                skip = skip if parts else first - before
                parts.append(part)
            before += n
        there = self.rows.where(F.col("_part").isin(parts)) if parts else self.rows.where("false")
        return there.orderBy(*self.order).drop("_part").offset(skip if parts else 0).limit(size)


def page_index(rows: DataFrame, order: list[Column], partitions: int | None = None) -> PageIndex:
    """Sorts rows into range partitions once; one count per partition comes back."""
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pages-{uuid.uuid4().hex}"
    rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).write.partitionBy("_part").parquet(path)
    kept = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(path)
    counts = {r["_part"]: r["count"] for r in kept.groupBy("_part").count().collect()}
    return PageIndex(kept, order, [counts.get(i, 0) for i in range(max(counts, default=-1) + 1)])


def strand_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("genome_id").agg(
        F.count_if(F.col("strand") == "forward").alias("forward"),
        F.count_if(F.col("strand") == "reverse").alias("reverse"))
