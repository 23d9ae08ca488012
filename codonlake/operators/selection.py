"""Greedy choice of training genes.

A greedy pass looks at candidates in priority order and takes those that do not conflict with one taken before: a priority
independent set of the graph of conflicting intervals. Conflicts need an overlap, so the pass splits exactly into
islands of overlapping candidates. Islands of at most ``FOLD_MOST`` candidates are folded by themselves. Larger ones
are worked off in rounds over position bins: a candidate that is first in priority in every bin it touches outranks all that
it could conflict with, so it is taken, and what it excludes is removed. A bin has one such winner at most, so
a round is linear in the candidates and never lists pairs. What is left falls into smaller islands, and the next
round begins with those. Both ways give the sequential result.

A cap per genome is an option and off by default (constants give the usual one); it is applied afterwards, as the first N
taken are the N best-ranked of an uncapped pass. Spark limits each map task to N rows per genome before the shuffle (window
group limit), so a genome with a third of all rows does not end in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codonlake import constants as C
from codonlake.functions.protein import amino_acid_entropy, translate_to_stop
from codonlake.operators.intervals import number_islands
from codonlake.operators.orf import CONTIG, with_sequence
from codonlake.session import cut_lineage

COORDS = [*CONTIG, "genome_start", "genome_end"]
#: Candidates of an island that one row may hold, and the width of a position bin of larger islands.
FOLD_MOST, BIN = 1024, 1024
#: The two choices; a row of either is told apart by this key and, where strands are chosen apart, by the strand.
LONGEST, ATG = "longest_first", "atg_first"
KEYS = ["choice", *CONTIG, "part"]


def _rank_struct(atg_first: bool) -> Column:
    """Priority as a sortable struct: longest first, then the order in which the scan lists ORFs."""
    tier = F.when(F.col("start_codon") == "ATG", 0).otherwise(1) if atg_first else F.lit(0)
    return F.struct(
        tier.alias("tier"), (-F.col("length")).alias("neg_length"),
        F.when(F.col("strand") == "forward", 0).otherwise(1).alias("strand_rank"),
        "frame", "end", "start", "genome_start", "genome_end", "length", "strand", "start_codon",
    )


def _conflict(taken: Column, later: Column, tolerance: Column) -> Column:
    """More than ``tolerance`` of the later candidate overlaps the one taken."""
    shared = F.least(taken["genome_end"], later["genome_end"]) - F.greatest(taken["genome_start"], later["genome_start"]) + 1
    return F.greatest(shared, F.lit(0)) / later["length"] > tolerance


def _folded(islands: DataFrame, keys: list[str], fold_most: int) -> DataFrame:
    """Greedy pass over each island: (keys, rank, tolerance, open). Candidates of islands above ``fold_most`` stay open, each in a row of its own."""
    alone = F.when(F.col("_size") > fold_most, F.col("rank"))
    lists = islands.groupBy(*keys, "_island", alone.alias("_alone")).agg(F.array_sort(F.collect_list("rank")).alias("items"),
                                                                         F.first("tolerance").alias("tolerance"))
    taken = F.aggregate(
        "items", F.filter("items", lambda x: F.lit(False)),
        lambda acc, x: F.when(F.exists(acc, lambda y: _conflict(y, x, F.col("tolerance"))), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return lists.select(*keys, F.explode(taken).alias("rank"), "tolerance", F.col("_alone").isNotNull().alias("open"))


def _round(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Candidates that outrank all others in their bins, and those that neither are such nor are excluded by one."""
    def binned(df: DataFrame) -> DataFrame:
        return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("rank.genome_start") / BIN), F.floor(F.col("rank.genome_end") / BIN))))

    each = binned(rows)
    best = each.groupBy(*keys, "_bin").agg(F.min("rank").alias("_best"))
    judged = cut_lineage(each.join(best, [*keys, "_bin"]).groupBy(*keys, "rank", "tolerance").agg(F.every(F.col("rank") == F.col("_best")).alias("_wins")))
    winners, others = judged.where("_wins").drop("_wins"), judged.where("NOT _wins").drop("_wins")
    over = binned(winners).select(*keys, "_bin", F.col("rank").alias("_winner"))
    lost = binned(others).join(over, [*keys, "_bin"]).where(_conflict(F.col("_winner"), F.col("rank"), F.col("tolerance")))
    return winners.select(*keys, "rank"), others.join(lost.select(*keys, "rank").distinct(), [*keys, "rank"], "left_anti")


def independent_set(candidates: DataFrame, keys: list[str], fold_most: int = FOLD_MOST) -> DataFrame:
    """Greedy choice within ``keys``: rows (keys, rank, tolerance) to the (keys, rank) taken; equal rows are taken once."""
    left, taken = candidates, []
    size = F.count("*").over(Window.partitionBy(*keys, "_island"))
    while True:
        ends = left.select(*keys, "rank", "tolerance", F.col("rank.genome_start").alias("_lo"), F.col("rank.genome_end").alias("_hi"))
        islands = number_islands(ends, keys, "_lo", "_hi", "_island").withColumn("_size", size)
        folded = cut_lineage(_folded(islands, keys, fold_most))
        taken.append(folded.where("NOT open").select(*keys, "rank"))
        still = folded.where("open").drop("open")
        if still.isEmpty():
            break
        winners, left = _round(still, keys)
        taken.append(winners)
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out


def _candidates(orfs: DataFrame, choice: str, tolerance: float) -> DataFrame:
    part = F.col("strand") if choice == ATG else F.lit("")
    return orfs.select(F.lit(choice).alias("choice"), *CONTIG, part.alias("part"), _rank_struct(choice == ATG).alias("rank"),
                       F.lit(tolerance).alias("tolerance"))


def _taken(chosen: DataFrame) -> DataFrame:
    return chosen.select(*CONTIG, *[F.col(f"rank.{c}").alias(c) for c in
                                    ("strand", "end", "start", "genome_start", "genome_end", "length", "frame", "start_codon")])


def _cap(taken: DataFrame, limit: int | None, atg_first: bool) -> DataFrame:
    if limit is None:
        return taken
    tier = [F.when(F.col("start_codon") == "ATG", 0).otherwise(1)] if atg_first else []
    order = Window.partitionBy("genome_id").orderBy(
        *tier, F.col("length").desc(), "contig_id",
        F.when(F.col("strand") == "forward", 0).otherwise(1), "frame", "end", "start",
    )
    return taken.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def _longest_pool(orfs: DataFrame, min_length: int) -> DataFrame:
    return _candidates(orfs.where(F.col("length") >= min_length), LONGEST, 0.0)


def _atg_pool(orfs: DataFrame, min_length: int, max_length: int | None, max_overlap: float) -> DataFrame:
    pool = orfs.where(F.col("length") >= min_length)
    return _candidates(pool if max_length is None else pool.where(F.col("length") <= max_length), ATG, max_overlap)


def longest_first(orfs: DataFrame, min_length: int = C.TRAIN_MIN_LENGTH,
                  limit: int | None = None, fold_most: int = FOLD_MOST) -> DataFrame:
    """Longest ORFs that do not overlap, both strands together."""
    return _cap(_taken(independent_set(_longest_pool(orfs, min_length), KEYS, fold_most)), limit, False)


def atg_first(orfs: DataFrame, min_length: int = C.TRAIN_MIN_LENGTH,
              max_length: int | None = None, max_overlap: float = C.TRAIN_MAX_OVERLAP,
              limit: int | None = None, fold_most: int = FOLD_MOST) -> DataFrame:
    """ATG starts before others, longest first; up to 30 % of an ORF may overlap one taken on its strand."""
    return _cap(_taken(independent_set(_atg_pool(orfs, min_length, max_length, max_overlap), KEYS, fold_most)), limit, True)


def training_set(orfs: DataFrame, limit: int | None = None) -> DataFrame:
    """ORFs whose coordinates are in both choices; the strand is not compared. Both choices are made in one pass."""
    pool = orfs.where(F.col("length") >= C.MIN_ORF_LENGTH)
    chosen = independent_set(_longest_pool(pool, C.TRAIN_MIN_LENGTH).unionByName(
        _atg_pool(pool, C.TRAIN_MIN_LENGTH, None, C.TRAIN_MAX_OVERLAP)), KEYS)
    first = _cap(_taken(chosen.where(F.col("choice") == LONGEST)), limit, False)
    second = _cap(_taken(chosen.where(F.col("choice") == ATG)), limit, True)
    both = first.select(*COORDS, F.lit(1).alias("_n")).unionByName(second.select(*COORDS, F.lit(2).alias("_n")))
    both = both.groupBy(*COORDS).agg(F.count_distinct("_n").alias("_n")).where("_n = 2").drop("_n")
    return pool.join(both, COORDS, "left_semi").select(*orfs.columns)


def add_entropy(orfs: DataFrame, contigs: DataFrame) -> DataFrame:
    """aa_entropy of the protein up to its first stop, for ORFs long enough to be training candidates."""
    long = with_sequence(orfs.where(F.col("length") >= C.TRAIN_MIN_LENGTH), contigs)
    return long.withColumn("aa_entropy", amino_acid_entropy(translate_to_stop(F.col("sequence")))).drop("sequence")


def low_entropy(orfs: DataFrame, contigs: DataFrame, max_entropy: float = C.TRAIN_MAX_ENTROPY) -> DataFrame:
    """Training candidates whose protein has at most ``max_entropy`` bits; input for either choice."""
    return add_entropy(orfs, contigs).where(F.col("aa_entropy") <= max_entropy)
