"""Comparison of predictions with a reference annotation.

Predictions and references are tables with genome_id, contig_id, genome_start, genome_end. All results
are one row per genome or less; the counting is a union of three small aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codonlake import constants as C
from codonlake.functions.sequence import ratio

COORDS = ["genome_id", "contig_id", "genome_start", "genome_end"]


def quality(tp: Column, fp: Column, fn: Column) -> list[Column]:
    sens, prec = ratio(tp.cast("double"), tp + fn), ratio(tp.cast("double"), tp + fp)
    return [sens.alias("sensitivity"), prec.alias("precision"),
            ratio(2 * sens * prec, sens + prec).alias("f1")]


def _count(df: DataFrame, by: list[str], name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.lit(name).alias("what"), "n")


def _metrics(parts: list[DataFrame], by: list[str], matched: bool = False) -> DataFrame:
    """Metrics from counts of predictions (p), references (r), hits (t) and matched references (m)."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    total = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0))
    cols = [total("t").alias("tp"), (total("p") - total("t")).alias("fp"),
            (total("r") - total("t")).alias("fn")]
    if matched:
        cols.append(total("m").alias("matched_refs"))
    out = rows.groupBy(*by).agg(*cols)
    return out.select("*", *quality(F.col("tp"), F.col("fp"), F.col("fn")))


def exact_metrics(predicted: DataFrame, reference: DataFrame, by: list[str] = ["genome_id"],
                  extra: list[str] = []) -> DataFrame:
    """Coordinates equal, strand not compared. Duplicate predictions count as rows.

    ``extra`` columns of the predictions (a stage or configuration name) are added to the result keys;
    the counts of the reference then stand beside each of their values (genomes times names: the rows of
    the result).
    """
    hits = predicted.select(*COORDS, *extra).join(reference.select(*COORDS), COORDS)
    refs = _count(reference, by, "r")
    if extra:
        refs = refs.join(F.broadcast(predicted.select(*extra).distinct()), how="cross")
    keys = [*by, *extra]
    return _metrics([_count(predicted, keys, "p"), refs, _count(hits, keys, "t")], keys)


def set_metrics(predicted: DataFrame, reference: DataFrame, by: list[str] = ["genome_id"]) -> DataFrame:
    """The same on distinct coordinates of both sides."""
    return exact_metrics(predicted.select(*COORDS).distinct(), reference.select(*COORDS).distinct(), by)


def near_hits(rows: DataFrame, others: DataFrame, start_tol: int, end_tol: int) -> DataFrame:
    """Rows that have any row of ``others`` within both tolerances.

    Starts are binned by the tolerance; the other side is put into every bin its tolerance reaches (two
    or three), so the join is an equi-join on contig and bin.
    """
    width = max(start_tol, 1)
    s = F.col("genome_start")
    spread = others.select(
        "genome_id", "contig_id", s.alias("_s"), F.col("genome_end").alias("_e"),
        F.explode(F.sequence(F.floor((s - start_tol) / width), F.floor((s + start_tol) / width)))
        .alias("_bin"),
    )
    near = (F.abs(s - F.col("_s")) <= start_tol) & (F.abs(F.col("genome_end") - F.col("_e")) <= end_tol)
    a, b = rows.withColumn("_bin", F.floor(s / width)).alias("a"), spread.alias("b")
    on = near
    for k in ("genome_id", "contig_id", "_bin"):
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, on, "left_semi").drop("_bin")


def tolerance_metrics(predicted: DataFrame, reference: DataFrame, start_tol: int, end_tol: int,
                      by: list[str] = ["genome_id"]) -> DataFrame:
    """A prediction counts when some reference lies within both tolerances. Several predictions may hit
    one reference, so fn = references - tp can be negative; matched_refs tells how many were hit."""
    hits = near_hits(predicted, reference, start_tol, end_tol)
    matched = near_hits(reference, predicted, start_tol, end_tol)
    return _metrics([_count(predicted, by, "p"), _count(reference, by, "r"), _count(hits, by, "t"),
                     _count(matched, by, "m")], by, True)


def missing_and_extra(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """Coordinates found on one side only."""
    p, r = predicted.select(*COORDS).distinct(), reference.select(*COORDS).distinct()
    miss = r.join(p, COORDS, "left_anti").withColumn("kind", F.lit("missing"))
    return miss.unionByName(p.join(r, COORDS, "left_anti").withColumn("kind", F.lit("extra")))


def batch_report(metrics: DataFrame, groups: DataFrame) -> DataFrame:
    """Genomes, macro means per taxonomic group and over all, in percent, with warning flags.

    A group is flagged when its F1 lies more than five points under the overall mean, and when it has
    fewer than ten genomes. Genomes without a group row are left out.
    """
    rows = metrics.join(groups, "genome_id")
    pct = [(F.col(c) * 100).alias(c) for c in ("sensitivity", "precision", "f1")]
    rows = rows.select("genome_id", "tax_group", *pct)
    mean = [F.avg(c).alias(c) for c in ("sensitivity", "precision", "f1")]
    overall = rows.agg(F.count("*").alias("n"), *mean)
    per_group = rows.groupBy("tax_group").agg(F.count("*").alias("n"), *mean)
    cols = ["level", "key", "n", "sensitivity", "precision", "f1"]
    single = rows.select(F.lit("genome").alias("level"), F.col("genome_id").alias("key"),
                         F.lit(1).cast("long").alias("n"), "sensitivity", "precision", "f1")
    union = single.unionByName(
        per_group.select(F.lit("group").alias("level"), F.col("tax_group").alias("key"), *cols[2:])
    ).unionByName(overall.select(F.lit("overall").alias("level"), F.lit("all").alias("key"), *cols[2:]))
    # the overall row is a single row by construction
    mark = overall.select(F.col("f1").alias("_all"))
    low = (F.col("level") == "group") & (F.col("f1") < F.col("_all") - C.GROUP_F1_GAP_PP)
    small = (F.col("level") == "group") & (F.col("n") < C.SMALL_BATCH)
    return union.join(F.broadcast(mark), how="cross").select(
        *cols, low.alias("flag_low_f1"), small.alias("flag_small"))


def benchmark_summary(metrics: DataFrame, groups: DataFrame, runtimes: DataFrame | None = None,
                      tax_group: str | None = None, limit: int | None = None) -> DataFrame:
    """Batch report of a benchmark run: optional taxonomic group, optional number of genomes per group (a
    sampling option of the benchmark), mean runtime beside the metrics where runtimes are given."""
    if tax_group is not None:
        groups = groups.where(F.col("tax_group") == tax_group)
    if limit is not None:
        rank = Window.partitionBy("tax_group").orderBy("genome_id")
        groups = groups.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= limit).drop("_r")
    report = batch_report(metrics, groups)
    if runtimes is None:
        return report
    timed = groups.join(runtimes, "genome_id")
    mean = timed.groupBy("tax_group").agg(F.avg("seconds").alias("seconds"))
    per = (
        timed.select(F.lit("genome").alias("level"), F.col("genome_id").alias("key"), "seconds")
        .unionByName(mean.select(F.lit("group").alias("level"), F.col("tax_group").alias("key"), "seconds"))
        .unionByName(timed.agg(F.avg("seconds").alias("seconds")).select(
            F.lit("overall").alias("level"), F.lit("all").alias("key"), "seconds"))
    )
    return report.join(per, ["level", "key"], "left")


def genome_report(metrics: DataFrame) -> DataFrame:
    """One text line per genome; exact halves in the last digit are rounded up."""
    pct = [F.col(c) * 100 + 1e-9 for c in ("sensitivity", "precision", "f1")]
    line = F.format_string("%s\tTP=%d FP=%d FN=%d sensitivity=%.2f%% precision=%.2f%% F1=%.2f%%", "genome_id", "tp", "fp", "fn", *pct)
    return metrics.select("genome_id", line.alias("line"))


def compare_runs(old: DataFrame, new: DataFrame, keys: list[str], threshold_pp: float = 0.5) -> DataFrame:
    """Differences of two metric tables with the same keys, in points, with a verdict."""
    o = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in ("tp", "sensitivity", "precision", "f1")])
    n = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in ("tp", "sensitivity", "precision", "f1")])
    d = lambda c: (F.col(f"new_{c}") - F.col(f"old_{c}")) * 100
    return o.join(n, keys).select(
        *keys, "old_tp", "new_tp", (F.col("new_tp") - F.col("old_tp")).alias("delta_tp"),
        d("sensitivity").alias("delta_sensitivity"), d("precision").alias("delta_precision"),
        d("f1").alias("delta_f1"),
        F.when(d("f1") > threshold_pp, "better").when(d("f1") < -threshold_pp, "worse").otherwise("same")
        .alias("verdict"),
    )


def stage_losses(stages: dict[str, DataFrame], reference: DataFrame) -> DataFrame:
    """Per genome and stage: rows, genes still present, sensitivity, genes lost since the stage before.

    Presence is by coordinates, so a stage that keeps a gene under another start has lost it.
    """
    order = {name: i for i, name in enumerate(stages)}
    parts = [
        df.select(*COORDS, F.lit(name).alias("stage"), F.lit(i).alias("stage_no"))
        for (name, df), i in zip(stages.items(), order.values())
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    ref = reference.select(*COORDS).distinct().withColumn("_hit", F.lit(1))
    n_ref = ref.groupBy("genome_id").agg(F.count("*").alias("n_ref"))
    per = rows.join(ref, COORDS, "left").groupBy("genome_id", "stage", "stage_no").agg(
        F.count("*").alias("total"), F.count("_hit").alias("tp"))
    names = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(i).alias("stage_no")) for s, i in order.items()])
    grid = n_ref.select("genome_id", "n_ref", F.inline(names))
    full = grid.join(per, ["genome_id", "stage", "stage_no"], "left").na.fill(0, ["total", "tp"])
    before = F.lag("tp").over(Window.partitionBy("genome_id").orderBy("stage_no"))
    return full.select(
        "genome_id", "stage", "stage_no", "total", "tp", "n_ref",
        ratio(F.col("tp").cast("double"), F.col("n_ref")).alias("sensitivity"),
        F.coalesce(before - F.col("tp"), F.col("n_ref") - F.col("tp")).alias("lost"),
    )


def stage_group_means(losses: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean share of genes lost per taxonomic group and stage."""
    return losses.join(groups, "genome_id").groupBy("tax_group", "stage", "stage_no").agg(
        F.avg(ratio(F.col("lost").cast("double"), F.col("n_ref"))).alias("mean_lost_share"),
        F.avg("sensitivity").alias("mean_sensitivity"))


def worst_losers(losses: DataFrame, top: int = 5) -> DataFrame:
    """The genomes that lose most in each stage (a top-k report)."""
    share = ratio(F.col("lost").cast("double"), F.col("n_ref"))
    rank = Window.partitionBy("stage").orderBy(F.col("lost_share").desc(), "genome_id")
    return losses.withColumn("lost_share", share).withColumn("rank", F.row_number().over(rank)).where(
        F.col("rank") <= top).select("stage", "rank", "genome_id", "lost", "lost_share")


# ---- run log ---------------------------------------------------------------------------------------
def append_run(metrics: DataFrame, run_id: str, path: str) -> None:
    metrics.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def regressions(log: DataFrame, drop_pp: float = C.RUN_REGRESSION_PP) -> DataFrame:
    """Genomes whose F1 fell between the two latest runs by more than ``drop_pp`` points."""
    runs = log.select("run_id").distinct().orderBy(F.col("run_id").desc()).limit(2)
    marked = runs.withColumn("_age", F.row_number().over(Window.orderBy(F.col("run_id").desc())))
    rows = log.join(F.broadcast(marked), "run_id")
    pick = lambda age: F.max(F.when(F.col("_age") == age, F.col("f1")))
    return (
        rows.groupBy("genome_id").agg(pick(2).alias("old_f1"), pick(1).alias("new_f1"))
        .withColumn("delta_pp", (F.col("new_f1") - F.col("old_f1")) * 100)
        .where(F.col("delta_pp") < -drop_pp)
    )
