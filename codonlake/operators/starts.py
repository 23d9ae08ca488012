"""Filters, grouping by stop codon, choice of one start per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codonlake import constants as C
from codonlake.operators.orf import GROUP
from codonlake.operators.scoring import weighted_sum


def passes(thresholds: dict[str, float]) -> Column:
    """False when length, codon and Markov score are all too low, or the sum is. Nulls keep the row."""
    low = lambda c, t: F.coalesce(F.col(c) < F.lit(float(thresholds[t])), F.lit(False))
    weak = low("length_score", "length") & low("codon_score", "codon") & low("imm_score", "imm")
    return ~(weak | low("combined_score", "combined"))


def filter_candidates(scored: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    return scored.where(passes(thresholds))


def add_selection_score(rows: DataFrame, weights: dict[str, float] | None = None,
                        out: str = "selection_score") -> DataFrame:
    return rows.withColumn(out, weighted_sum(weights or C.START_SELECTION_WEIGHTS))


def rank_starts(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """start_rank within the stop group: highest selection score, then the most upstream start."""
    order = Window.partitionBy(*GROUP).orderBy(F.col("selection_score").desc(), F.col("start"))
    return add_selection_score(rows, weights).withColumn("start_rank", F.row_number().over(order))


def best_starts(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    return rank_starts(rows, weights).where("start_rank = 1").drop("start_rank")


def top_two(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per group: best and second start, their score gap (999 for a single start)."""
    ranked = rank_starts(rows, weights).where("start_rank <= 2")
    pick = lambda n, c: F.max(F.when(F.col("start_rank") == n, F.col(c)))
    return (
        ranked.groupBy(*GROUP)
        .agg(pick(1, "start").alias("start_1"), pick(2, "start").alias("start_2"),
             pick(1, "selection_score").alias("score_1"), pick(2, "selection_score").alias("score_2"))
        .withColumn("gap", F.coalesce(F.col("score_1") - F.col("score_2"), F.lit(C.SINGLETON_GAP)))
    )


def temper(prob: Column, temperature: float | None) -> Column:
    """Probability after dividing its logit by the temperature."""
    if temperature is None:
        return prob
    p = F.least(F.greatest(prob, F.lit(1e-7)), F.lit(1 - 1e-7))
    return 1.0 / (1.0 + F.exp(-F.log(p / (1.0 - p)) / F.lit(float(temperature))))


def settle_contest(pairs: DataFrame, prob_keep: str = "prob_keep", contest_gap: float = C.CONTEST_GAP,
                   flip_prob: float = C.FLIP_PROB, temperature: float | None = None) -> DataFrame:
    """chosen_start: the second start where the gap is small and the classifier is against the first."""
    flip = (
        (F.col("gap") < contest_gap)
        & F.col("start_2").isNotNull()
        & (temper(F.col(prob_keep), temperature) < 1.0 - flip_prob)
    )
    flip = F.coalesce(flip, F.lit(False))
    return pairs.withColumn("flipped", flip).withColumn(
        "chosen_start", F.when(flip, F.col("start_2")).otherwise(F.col("start_1"))
    )
