"""Labels of ORFs and groups from a reference annotation, and splits of genomes and groups.

A reference is a table genome_id, contig_id, genome_start, genome_end, strand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codonlake.operators.orf import CONTIG, GROUP, scan_orfs

COORDS = [*CONTIG, "genome_start", "genome_end"]


def longest_atg_genes(contigs: DataFrame, min_length: int = 75) -> DataFrame:
    """A reference made from the contigs themselves: per stop codon the longest ORF that starts with ATG."""
    atg = scan_orfs(contigs, min_length).where("start_codon = 'ATG'")
    return atg.groupBy(*GROUP).agg(
        F.min_by("genome_start", "start").alias("genome_start"),
        F.min_by("genome_end", "start").alias("genome_end"),
        F.min_by("length", "start").alias("length"),
    )


def label_orfs(orfs: DataFrame, reference: DataFrame, out: str = "label") -> DataFrame:
    """1 where the exact coordinates are in the reference; the strand is not compared."""
    genes = reference.select(*COORDS).distinct().withColumn("_hit", F.lit(1))
    return orfs.join(genes, COORDS, "left").select(
        *orfs.columns, F.coalesce("_hit", F.lit(0)).alias(out)
    )


def label_groups(orfs: DataFrame, reference: DataFrame, same_strand: bool = False) -> DataFrame:
    """1 for stop groups of which any ORF is in the reference, optionally on the same strand."""
    if same_strand:
        genes = reference.select(*COORDS, "strand").distinct().withColumn("_hit", F.lit(1))
        rows = orfs.join(genes, [*COORDS, "strand"], "left")
        hit = F.coalesce("_hit", F.lit(0))
    else:
        rows, hit = label_orfs(orfs, reference), F.col("label")
    return rows.groupBy(*GROUP).agg(F.max(hit).alias("label"))


def _order(keys: list[str], seed: int) -> Column:
    """A shuffled order that other engines can compute as well: hexadecimal MD5 of the seed and the keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def stratified_genome_split(genomes: DataFrame, n_val: int, n_test: int, seed: int) -> DataFrame:
    """train / val / test per taxonomic group: min(n_val + n_test, n // 3) genomes are held out."""
    order = Window.partitionBy("tax_group").orderBy(_order(["genome_id"], seed), "genome_id")
    size = F.count("*").over(Window.partitionBy("tax_group"))
    held = F.least(F.lit(n_val + n_test), F.floor(F.col("_n") / 3))
    return (
        genomes.withColumn("_r", F.row_number().over(order)).withColumn("_n", size)
        .withColumn("_held", held)
        .withColumn(
            "split",
            F.when(F.col("_r") <= F.floor(F.col("_held") / 2), "val")
            .when(F.col("_r") <= F.col("_held"), "test").otherwise("train"),
        )
        .drop("_r", "_n", "_held")
    )


def limit_per_group(genomes: DataFrame, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` genomes of each taxonomic group, chosen by a seeded hash (a sampling operator)."""
    order = Window.partitionBy("tax_group").orderBy(_order(["genome_id"], seed), "genome_id")
    return genomes.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")


def group_split(rows: DataFrame, test_share: float, seed: int, keys: list[str] = GROUP) -> DataFrame:
    """Random train / test split in which all rows of a group fall on the same side."""
    bucket = F.conv(F.substring(_order(keys, seed), 1, 8), 16, 10).cast("long") / 2.0 ** 32
    return rows.withColumn("split", F.when(bucket < test_share, "test").otherwise("train"))


def label_split(rows: DataFrame, test_share: float, seed: int, keys: list[str] = GROUP,
                label: str = "label") -> DataFrame:
    """Split with the same share of every label: the hash order is cut per label at its own quantile."""
    h = F.conv(F.substring(_order(keys, seed), 1, 8), 16, 10).cast("double")
    rows = rows.withColumn("_h", h)
    cuts = rows.groupBy(label).agg(F.percentile_approx("_h", test_share, 10000).alias("_cut"))
    split = F.when(F.col("_h") <= F.col("_cut"), "test").otherwise("train")
    return rows.join(F.broadcast(cuts), label).withColumn("split", split).drop("_h", "_cut")


def split_summary(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.sum(label).alias("positives"))


def start_choice_groups(orfs: DataFrame, reference: DataFrame) -> DataFrame:
    """Members of groups with several starts, one of which is in the reference.

    ``is_true`` marks the first matching start only.
    """
    labelled = label_orfs(orfs, reference)
    per_group = labelled.groupBy(*GROUP).agg(
        F.count("*").alias("_n"), F.min(F.when(F.col("label") == 1, F.col("start"))).alias("true_start")
    ).where("_n >= 2 and true_start is not null").drop("_n")
    return labelled.join(per_group, GROUP).withColumn(
        "is_true", (F.col("start") == F.col("true_start")).cast("int")
    )
