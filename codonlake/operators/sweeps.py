"""Threshold and weight studies. Candidate settings are a small table given by the caller, and every
setting is judged in one pass over the data: the settings ride along as a constant array."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from codonlake import constants as C
from codonlake.functions.sequence import ratio
from codonlake.operators.distribute import running_total
from codonlake.operators.grading import COORDS
from codonlake.operators.orf import GROUP

NORMS = [f"{c}_score_norm" for c in C.COMPONENTS]


def threshold_sweep(scored: DataFrame, prob: str, label: str, thresholds: list[float],
                    by: list[str] = []) -> DataFrame:
    """Precision, recall, F1 at every threshold."""
    t = F.explode(F.array(*map(F.lit, thresholds)))
    rows = scored.select(*by, prob, label, t.alias("threshold"))
    hit, true = F.col(prob) >= F.col("threshold"), F.col(label) == 1
    c = rows.groupBy(*by, "threshold").agg(
        F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"))
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    prec, rec = ratio(tp.cast("double"), tp + fp), ratio(tp.cast("double"), tp + fn)
    return c.select("*", prec.alias("precision"), rec.alias("recall"), ratio(2 * prec * rec, prec + rec).alias("f1"))


def same_recall(old: DataFrame, new: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Thresholds of the new sweep whose recall equals that of an old threshold within the tolerance."""
    o = old.select(F.col("threshold").alias("old_threshold"), F.col("recall").alias("old_recall"),
                   F.col("precision").alias("old_precision"))
    near = F.abs(F.col("recall") - F.col("old_recall")) <= tolerance
    return new.join(F.broadcast(o), near).select(
        "old_threshold", "threshold", "old_recall", "recall",
        (F.col("precision") - F.col("old_precision")).alias("precision_gain"))


def best_f1_threshold(scored: DataFrame, prob: str, label: str) -> DataFrame:
    """Threshold with the highest F1 among all distinct probabilities, the lowest one among equals.

    Equal probabilities are aggregated first, then cumulated by a range-partitioned running sum, so
    neither a popular value nor the global order ends in one task.
    """
    per = scored.groupBy(F.col(prob).alias("threshold")).agg(
        F.count("*").alias("n"), F.sum(label).cast("long").alias("pos"))
    cum = running_total(per, [], [-F.col("threshold")], "n", "called")
    cum = running_total(cum, [], [-F.col("threshold")], "pos", "tp")
    total = per.agg(F.sum("pos").alias("_pos"))
    rows = cum.join(F.broadcast(total), how="cross")
    prec, rec = F.col("tp") / F.col("called"), ratio(F.col("tp").cast("double"), F.col("_pos"))
    rows = rows.select("threshold", prec.alias("precision"), rec.alias("recall"),
                       ratio(2 * prec * rec, prec + rec).alias("f1"))
    return rows.orderBy(F.col("f1").desc(), "threshold").limit(1)


def constrained_choice(sweep: DataFrame, target: float, rule: str = "best_f1") -> DataFrame:
    """From a sweep: best F1, or the first threshold, among those with mean precision >= target."""
    mean = sweep.groupBy("threshold").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    ok = mean.where(F.col("precision") >= target)
    order = [F.col("f1").desc(), F.col("threshold")] if rule == "best_f1" else [F.col("threshold")]
    return ok.orderBy(*order).limit(1)


# ---- weights ---------------------------------------------------------------------------------------
def weight_vectors(base: dict[str, float], factors: tuple[float, ...] = (0.25, 0.5, 1.0, 2.0, 4.0)) -> list[dict]:
    """The base vector and every single-weight change by a factor."""
    out = [{"vector": "base", **base}]
    for c in C.COMPONENTS:
        for f in factors:
            if f != 1.0:
                out.append({"vector": f"{c}*{f:g}", **base, c: base[c] * f})
    return out


def group_hits(groups: DataFrame, vectors: list[dict]) -> DataFrame:
    """Per group and vector: 1 when the start with the highest sum (first among equals) is the true one.

    One aggregation over the groups holds the best row under every vector; rows are not copied per vector.
    """
    best = []
    for v in vectors:
        total = None
        for c in C.COMPONENTS:
            term = F.col(f"{c}_score_norm") * F.lit(float(v[c]))
            total = term if total is None else total + term
        best.append(F.max(F.struct(total.alias("score"), (-F.col("start")).alias("back"), "is_true"))["is_true"])
    per = groups.groupBy(*GROUP).agg(*[b.alias(f"_h{i}") for i, b in enumerate(best)])
    items = F.array(*[F.struct(F.lit(v["vector"]).alias("vector"), F.col(f"_h{i}").alias("hit")) for i, v in enumerate(vectors)])
    return per.select(*GROUP, F.inline(items))


def weight_accuracy(groups: DataFrame, vectors: list[dict], by: list[str] = []) -> DataFrame:
    """Start accuracy of every weight vector in one job."""
    hits = group_hits(groups, vectors)
    if by:
        hits = hits.join(groups.select(*GROUP, *[b for b in by if b not in GROUP]).distinct(), GROUP)
    return hits.groupBy(*by, "vector").agg(F.count("*").alias("groups"), F.avg("hit").alias("accuracy"))


def best_per_weight(accuracy: DataFrame) -> DataFrame:
    """For every component the change with the highest accuracy, base included."""
    base = F.max(F.when(F.col("vector") == "base", F.col("accuracy")))
    rows = accuracy.where("vector != 'base'").withColumn("component", F.substring_index("vector", "*", 1))
    top = rows.groupBy("component").agg(F.max_by("vector", F.struct("accuracy", "vector")).alias("vector"),
                                        F.max("accuracy").alias("accuracy"))
    b = accuracy.agg(base.alias("base_accuracy"))
    return top.join(F.broadcast(b), how="cross").withColumn("gain", F.col("accuracy") - F.col("base_accuracy"))


def softmax_loss(groups: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Mean cross-entropy of the true start under a softmax per group, and its gradient: one row.

    One window (maximum, for stability), one aggregation per group, one over groups.
    """
    score = None
    for c in C.COMPONENTS:
        term = F.col(f"{c}_score_norm") * F.lit(float(weights[c]))
        score = term if score is None else score + term
    w = Window.partitionBy(*GROUP)
    rows = groups.withColumn("_s", score).withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(w)))
    per = rows.groupBy(*GROUP).agg(
        F.sum("_e").alias("_z"), F.max(F.when(F.col("is_true") == 1, F.col("_e"))).alias("_t"),
        *[F.sum(F.col("_e") * F.col(n)).alias(f"_m_{n}") for n in NORMS],
        *[F.max(F.when(F.col("is_true") == 1, F.col(n))).alias(f"_t_{n}") for n in NORMS])
    loss = -F.log(F.greatest(F.col("_t") / F.col("_z"), F.lit(1e-300)))
    return per.agg(F.count("*").alias("groups"), F.avg(loss).alias("loss"),
                   *[F.avg(F.col(f"_m_{n}") / F.col("_z") - F.col(f"_t_{n}")).alias(f"grad_{c}")
                     for c, n in zip(C.COMPONENTS, NORMS)])


def descend(groups: DataFrame, start: dict[str, float], rate: float = 0.5, rounds: int = 10,
            bounds: tuple[float, float] = (0.01, 20.0)) -> tuple[dict[str, float], float]:
    """Projected gradient steps on the softmax loss; a step that does not improve halves the rate.

    One row comes back per round. The result is rescaled to the largest weight of the start vector.
    """
    current = dict(start)
    row = softmax_loss(groups, current).first()
    for _ in range(rounds):
        step = {c: min(max(current[c] - rate * row[f"grad_{c}"], bounds[0]), bounds[1]) for c in C.COMPONENTS}
        nxt = softmax_loss(groups, step).first()
        if nxt["loss"] < row["loss"]:
            current, row = step, nxt
        else:
            rate /= 2
    scale = max(start.values()) / max(current.values())
    return {c: v * scale for c, v in current.items()}, row["loss"]


def poisson_limits() -> list[int]:
    """Of 65536 equally likely numbers, those below the k-th limit draw at most k: Poisson with mean 1, to 16 bits."""
    limits, total, term, k = [], 0.0, math.exp(-1.0), 0
    while round((total + term) * 65536) < 65536:
        total += term
        limits.append(round(total * 65536))
        k += 1
        term /= k
    return limits


def bootstrap_sums(diff: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Per replicate the resampled sum of ``d`` and number of groups: (replicate, d, n), from rows (group key, d).

    A group is drawn 0, 1, 2, ... times, by 16 bits of the MD5 of seed, key and replicate, so a repeated task draws the
    same and other engines can repeat it. Each task adds its draws up in two arrays; rows are not copied per replicate.
    """
    limits = np.array(poisson_limits())
    blocks = -(-replicates // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, n = np.zeros(blocks * 8, dtype=np.int64), np.zeros(blocks * 8, dtype=np.int64)
        for b in batches:
            for key, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                start = hashlib.md5(f"{seed}:{key}:".encode())
                digests = []
                for block in range(blocks):
                    h = start.copy()
                    h.update(str(block).encode())
                    digests.append(h.digest())
                times = np.searchsorted(limits, np.frombuffer(b"".join(digests), dtype=">u2"), side="right")
                n += times
                if value:
                    d += value * times
        made = np.arange(1, replicates + 1)
        yield pa.RecordBatch.from_pydict({"replicate": pa.array(made, pa.int32()), "d": d[:replicates], "n": n[:replicates]})

    key = F.concat_ws(":", *[F.col(c).cast("string") for c in GROUP])
    rows = diff.select(key.alias("key"), F.col("d").cast("long")).mapInArrow(run, "replicate int, d long, n long")
    return rows.groupBy("replicate").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))


def bootstrap_delta(groups: DataFrame, old: dict[str, float], new: dict[str, float], replicates: int = 500,
                    seed: int = 42) -> DataFrame:
    """95 % interval of the accuracy difference by Poisson resampling of groups, and a verdict."""
    hits = group_hits(groups, [{"vector": "old", **old}, {"vector": "new", **new}])
    diff = hits.groupBy(*GROUP).agg(F.sum(F.when(F.col("vector") == "new", F.col("hit"))
                                          .otherwise(-F.col("hit"))).alias("d"))
    per = bootstrap_sums(diff, replicates, seed).select(ratio(F.col("d").cast("double"), F.col("n")).alias("delta"))
    ci = per.agg(F.avg("delta").alias("mean_delta"), F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    low, high = F.get("ci", F.lit(0)), F.get("ci", F.lit(1))
    return ci.select("mean_delta", low.alias("low"), high.alias("high"),
                     F.when(low > 0, "improvement").when(high < 0, "regression").otherwise("no difference").alias("verdict"))


def generalisation_gap(groups: DataFrame, splits: DataFrame, vectors: list[dict]) -> DataFrame:
    """Accuracy of every vector on train and validation genomes and the gap between them."""
    acc = weight_accuracy(groups.join(F.broadcast(splits.select("genome_id", "split")), "genome_id"), vectors, ["split"])
    side = lambda s: F.max(F.when(F.col("split") == s, F.col("accuracy")))
    return acc.groupBy("vector").agg(side("train").alias("train"), side("val").alias("val")).withColumn(
        "gap", F.col("train") - F.col("val"))


# ---- filters ---------------------------------------------------------------------------------------
def filter_grid(scored: DataFrame, reference: DataFrame, settings: list[dict], weights: dict[str, float] | None = None) -> DataFrame:
    """Objective of many pairs of filter thresholds, each run through filter, choice and filter.

    A setting has a name and two threshold maps ``first`` and ``second``. The objective is the geometric
    mean of sensitivity and precision, less a penalty when precision < .78 or sensitivity < .60.
    """
    from codonlake.operators.scoring import weighted_sum

    names = ("codon", "imm", "length", "combined")
    items = F.array(*[
        F.struct(F.lit(s["name"]).alias("setting"),
                 *[F.lit(float(s[k][n])).alias(f"_{k}_{n}") for k in ("first", "second") for n in names])
        for s in settings])
    def ok(k: str) -> Column:
        low = lambda n: F.col(f"{n}_score") < F.col(f"_{k}_{n}")
        return ~((low("length") & low("codon") & low("imm")) | low("combined"))
    ref = reference.select(*COORDS).distinct()
    slim = scored.select(*GROUP, "start", "genome_start", "genome_end",
                         *[f"{n}_score" for n in names],
                         weighted_sum(weights or C.START_SELECTION_WEIGHTS).alias("_sel"))
    rows = slim.select("*", F.inline(items)).where(ok("first"))
    best = Window.partitionBy(*GROUP, "setting").orderBy(F.col("_sel").desc(), "start")
    rows = rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").where(ok("second"))
    hits = rows.join(ref.withColumn("_hit", F.lit(1)), COORDS, "left").groupBy("setting").agg(
        F.count("*").alias("predicted"), F.count("_hit").alias("tp"))
    total = ref.agg(F.count("*").alias("n_ref"))
    sens, prec = ratio(F.col("tp").cast("double"), F.col("n_ref")), ratio(F.col("tp").cast("double"), F.col("predicted"))
    penalty = F.when(prec < 0.78, (0.78 - prec) * 2).otherwise(0.0) + F.when(sens < 0.60, 0.60 - sens).otherwise(0.0)
    return hits.join(F.broadcast(total), how="cross").select(
        "setting", "predicted", "tp", sens.alias("sensitivity"), prec.alias("precision"),
        (F.sqrt(sens * prec) - penalty).alias("objective"))


def gc_tier_grid(scored: DataFrame, reference: DataFrame, genome_gc: DataFrame, values: list[float],
                 base: dict[str, float] = C.FIRST_FILTER, high: float = 0.6) -> DataFrame:
    """First-filter combined threshold by GC tier: sensitivity and precision at every value and their
    change against the base threshold."""
    ref = reference.select(*COORDS).distinct().withColumn("_hit", F.lit(1))
    tier = genome_gc.select("genome_id", F.when(F.col("gc_pct") >= high, "high").otherwise("low").alias("tier"))
    rows = scored.join(ref, COORDS, "left").join(F.broadcast(tier), "genome_id")
    rows = rows.select("tier", "_hit", "length_score", "codon_score", "imm_score", "combined_score",
                       F.explode(F.array(*map(F.lit, sorted({*values, base["combined"]})))).alias("threshold"))
    low = lambda n: F.col(f"{n}_score") < base[n]
    kept = rows.where(~((low("length") & low("codon") & low("imm")) | (F.col("combined_score") < F.col("threshold"))))
    n_ref = reference.select(*COORDS).distinct().join(F.broadcast(tier), "genome_id").groupBy("tier").agg(
        F.count("*").alias("n_ref"))
    per = kept.groupBy("tier", "threshold").agg(F.count("*").alias("kept"), F.count("_hit").alias("tp"))
    per = per.join(F.broadcast(n_ref), "tier").select(
        "tier", "threshold", "kept", "tp", (F.col("tp") / F.col("n_ref")).alias("sensitivity"),
        (F.col("tp") / F.col("kept")).alias("precision"))
    at = per.where(F.col("threshold") == base["combined"]).select(
        "tier", F.col("sensitivity").alias("_s"), F.col("precision").alias("_p"))
    return per.join(F.broadcast(at), "tier").select(
        "tier", "threshold", "kept", "tp", "sensitivity", "precision",
        (F.col("sensitivity") - F.col("_s")).alias("delta_sensitivity"),
        (F.col("precision") - F.col("_p")).alias("delta_precision"))


def choose_gc_threshold(grid: DataFrame, max_loss: float = 0.02) -> DataFrame:
    """Value with the largest sensitivity gain of high-GC genomes whose low-GC precision loss is allowed."""
    pick = lambda t, c: F.max(F.when(F.col("tier") == t, F.col(c)))
    wide = grid.groupBy("threshold").agg(pick("high", "delta_sensitivity").alias("high_gain"),
                                         pick("low", "delta_precision").alias("low_change"))
    return wide.where(F.coalesce("low_change", F.lit(0.0)) >= -max_loss).orderBy(
        F.col("high_gain").desc_nulls_last(), "threshold").limit(1)


# ---- calibration -----------------------------------------------------------------------------------
def temperature_loss(scored: DataFrame, prob: str, label: str, temperatures: list[float]) -> DataFrame:
    """Log loss at every temperature, all in one pass."""
    p = F.least(F.greatest(F.col(prob), F.lit(1e-7)), F.lit(1 - 1e-7))
    rows = scored.select(F.log(p / (1 - p)).alias("z"), F.col(label).alias("y"),
                         F.explode(F.array(*map(F.lit, temperatures))).alias("temperature"))
    q = 1.0 / (1.0 + F.exp(-F.col("z") / F.col("temperature")))
    q = F.least(F.greatest(q, F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))
    return rows.groupBy("temperature").agg(F.avg(loss).alias("log_loss"))


def fit_temperature(scored: DataFrame, prob: str, label: str, low: float = 0.1, high: float = 10.0,
                    points: int = 25, rounds: int = 4) -> float:
    """Temperature with the lowest log loss: a log-spaced grid, refined around its best point."""
    best = 1.0
    for _ in range(rounds):
        step = (high / low) ** (1 / (points - 1))
        grid = [low * step**i for i in range(points)]
        best = temperature_loss(scored, prob, label, grid).orderBy("log_loss", "temperature").first()["temperature"]
        low, high = max(best / step, 0.1), min(best * step, 10.0)
    return best
