"""Interval algebra on (start, end) rows, 1-based and inclusive, per contig."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codonlake import constants as C
from codonlake.operators.orf import CONTIG, slice_forward


def number_islands(rows: DataFrame, keys: list[str], start: str, end: str, out: str) -> DataFrame:
    """Rows whose intervals overlap directly or through others get the same number within ``keys``.

    Of several equal intervals one opens the island; it is put first when the islands are counted.
    """
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = (
        Window.partitionBy(*keys).orderBy(F.col(start), F.col(end), F.col("_opens").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    reach = F.max(end).over(before)
    opens = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    return rows.withColumn("_opens", opens).withColumn(out, F.sum("_opens").over(upto)).drop("_opens")


def merge_intervals(rows: DataFrame, keys: list[str] = CONTIG, start: str = "start",
                    end: str = "end") -> DataFrame:
    """Union of overlapping intervals. Intervals that only touch stay apart."""
    return (
        number_islands(rows, keys, start, end, "_island")
        .groupBy(*keys, "_island")
        .agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("_island")
    )


def complement(occupied: DataFrame, contigs: DataFrame, min_length: int,
               label: str | None = None, labels: tuple[str, ...] = ()) -> DataFrame:
    """Gaps of at least ``min_length`` between the merged intervals and at both contig ends.

    A sentinel interval right after the contig turns the last gap into an ordinary one. With ``label``
    several interval sets are handled in one pass, one complement per value of that column.
    """
    keys = [*CONTIG, *([label] if label else [])]
    ends = contigs.select(*CONTIG, (F.col("length") + 1).alias("start"),
                          (F.col("length") + 1).alias("end"))
    if label:
        ends = ends.select("*", F.explode(F.array(*map(F.lit, labels))).alias(label))
    merged = merge_intervals(occupied.select(*keys, "start", "end"), keys)
    both = merged.unionByName(ends.select(*keys, "start", "end"))
    previous = F.lag("end").over(Window.partitionBy(*keys).orderBy("start"))
    lo = F.coalesce(previous + 1, F.lit(1).cast("long"))
    return (
        both.withColumn("_lo", lo)
        .where(F.col("start") - F.col("_lo") >= min_length)
        .select(*keys, F.col("_lo").alias("start"), (F.col("start") - 1).alias("end"))
    )


STRATEGIES = ("buffered_genes", "strong_site", "all_orfs")


def occupied_by_strategy(orfs: DataFrame) -> DataFrame:
    """What each of the three strategies regards as occupied, in one pass over the ORFs."""
    lo, hi, n = F.col("genome_start"), F.col("genome_end"), F.col("contig_length")
    wide = F.struct(
        F.lit("buffered_genes").alias("strategy"),
        F.greatest(F.lit(1).cast("long"), lo - C.INTERGENIC_BUFFER).alias("start"),
        F.least(n, hi + C.INTERGENIC_BUFFER).alias("end"),
    )
    plain = lambda name: F.struct(F.lit(name).alias("strategy"), lo.alias("start"), hi.alias("end"))
    choices = F.array(
        F.when(F.col("length") >= C.INTERGENIC_GENE_LENGTH, wide),
        F.when(F.col("rbs_score") >= C.INTERGENIC_RBS, plain("strong_site")),
        plain("all_orfs"),
    )
    return orfs.select(*CONTIG, F.inline(F.filter(choices, lambda x: x.isNotNull())))


def gaps_by_strategy(orfs: DataFrame, contigs: DataFrame,
                     min_length: int = C.INTERGENIC_MIN_LENGTH) -> DataFrame:
    return complement(occupied_by_strategy(orfs), contigs, min_length, "strategy", STRATEGIES)


def intergenic_regions(orfs: DataFrame, contigs: DataFrame,
                       min_length: int = C.INTERGENIC_MIN_LENGTH) -> DataFrame:
    """Merged union of the three gap sets."""
    union = merge_intervals(gaps_by_strategy(orfs, contigs, min_length).select(*CONTIG, "start", "end"))
    return union.withColumn("length", F.col("end") - F.col("start") + 1)


def with_region_sequence(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    return slice_forward(regions, contigs, F.col("start"), F.col("end"), "sequence")


def overlap_join(left: DataFrame, right: DataFrame, bin_width: int, keys: list[str] = CONTIG,
                 l: tuple[str, str] = ("start", "end"), r: tuple[str, str] = ("start", "end"),
                 how: str = "inner") -> DataFrame:
    """All pairs of overlapping intervals of the same contig, as an equi-join on position bins.

    Both sides are spread over the bins they touch; a pair is kept only in the bin that holds the later
    of the two starts, so it appears once without a distinct. Right columns get the prefix ``r_``.
    """
    def spread(df: DataFrame, s: str, e: str) -> DataFrame:
        first, last = F.floor(F.col(s) / bin_width), F.floor(F.col(e) / bin_width)
        return df.withColumn("_bin", F.explode(F.sequence(first, last)))

    rs, re_ = f"r_{r[0]}", f"r_{r[1]}"
    renamed = right.select(
        *keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys]
    )
    a, b = spread(left, *l), spread(renamed, rs, re_)
    a, b = a.alias("a"), b.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "_bin"]]
    hit = (
        (F.col(f"a.{l[0]}") <= F.col(f"b.{re_}"))
        & (F.col(f"b.{rs}") <= F.col(f"a.{l[1]}"))
        & (F.floor(F.greatest(F.col(f"a.{l[0]}"), F.col(f"b.{rs}")) / bin_width) == F.col("a._bin"))
    )
    cond = hit
    for c in on:
        cond = cond & c
    joined = a.join(b, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.select(*[F.col(f"a.{c}") for c in left.columns],
                         *[F.col(f"b.{c}") for c in renamed.columns if c not in keys])


def region_query(features: DataFrame, lo: int, hi: int, strand: str | None = None) -> DataFrame:
    """Features that touch [lo, hi], optionally of one strand. ``lo == hi`` is a point hit test."""
    found = (F.col("genome_end") >= lo) & (F.col("genome_start") <= hi)
    return features.where(found if strand is None else found & (F.col("strand") == strand))


def overlap_bp(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(e1, e2) - F.greatest(s1, s2) + 1)
