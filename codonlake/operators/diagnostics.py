"""Why predictions are right or wrong: score distributions, missed genes, wrong starts, purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codonlake import constants as C
from codonlake.functions.sequence import ratio, reverse_complement
from codonlake.operators.intervals import merge_intervals, overlap_bp, overlap_join
from codonlake.operators.distribute import exact_percentiles
from codonlake.operators.labels import COORDS, label_orfs, start_choice_groups
from codonlake.operators.orf import CONTIG, GROUP, slice_forward
from codonlake.operators.scoring import weighted_sum

SCORES = [f"{c}_score" for c in C.COMPONENTS]


def long_scores(labelled: DataFrame, columns: list[str]) -> DataFrame:
    """component, label, value: one row per ORF and score."""
    pairs = F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("value")) for c in columns])
    return labelled.select("label", F.inline(pairs))


def score_distributions(labelled: DataFrame, columns: list[str] = SCORES) -> DataFrame:
    """Per component: mean, median, deviation, range of hits and others, separation and its class."""
    rows = long_scores(labelled, columns)
    stats = rows.groupBy("component", "label").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    medians = exact_percentiles(rows, ["component", "label"], "value", (0.5,)).select("component", "label", F.get("p", F.lit(0)).alias("median"))
    stats = stats.join(medians, ["component", "label"], "left")
    side = lambda lab, p: [F.max(F.when(F.col("label") == lab, F.col(c))).alias(f"{p}_{c}")
                           for c in ("n", "mean", "median", "std", "min", "max")]
    wide = stats.groupBy("component").agg(*side(1, "tp"), *side(0, "fp"))
    sep = ratio(F.abs(F.col("tp_mean") - F.col("fp_mean")), (F.col("tp_std") + F.col("fp_std")) / 2)
    return wide.withColumn("separation", sep).withColumn(
        "separation_class",
        F.when(F.col("separation") > 0.8, "good").when(F.col("separation") > 0.5, "moderate").otherwise("poor"))


def effect_sizes(labelled: DataFrame, columns: list[str] = SCORES) -> DataFrame:
    """Cohen's d with the pooled deviation sqrt((var1 + var2) / 2)."""
    stats = long_scores(labelled, columns).groupBy("component").agg(
        *[f(F.when(F.col("label") == lab, F.col("value"))).alias(f"{name}{lab}")
          for lab in (0, 1) for f, name in ((F.avg, "m"), (F.var_pop, "v"))])
    pooled = F.sqrt((F.col("v1") + F.col("v0")) / 2)
    return stats.select("component", ratio(F.col("m1") - F.col("m0"), pooled).alias("cohens_d"))


def score_percentiles(labelled: DataFrame, column: str = "combined_score",
                      points: tuple[float, ...] = (0.10, 0.25, 0.50, 0.75, 0.90)) -> DataFrame:
    """Exact percentiles with linear interpolation per label."""
    rows = exact_percentiles(labelled.select("label", column), ["label"], column, points)
    return rows.select("label", *[F.get("p", F.lit(i)).alias(f"p{round(q * 100)}") for i, q in enumerate(points)])


def histogram(labelled: DataFrame, columns: list[str], bins: int = 50) -> DataFrame:
    """Counts per component, label and bin. Bins are equal-width over the range of the component."""
    rows = long_scores(labelled, columns)
    span = rows.groupBy("component").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"),
                F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return rows.join(F.broadcast(span), "component").groupBy(
        "component", "label", at.cast("int").alias("bin"), (F.col("lo") + at * width).alias("bin_start")
    ).agg(F.count("*").alias("n"))


def suggested_cut(labelled: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of the two medians per component."""
    medians = exact_percentiles(long_scores(labelled, columns), ["component", "label"], "value", (0.5,))
    med = lambda lab: F.max(F.when(F.col("label") == lab, F.get("p", F.lit(0))))
    return medians.groupBy("component").agg(((med(1) + med(0)) / 2).alias("cut"))


def site_distribution(labelled_sites: DataFrame) -> DataFrame:
    """Share of each spacing, and of a full motif inside the site, per label."""
    has = F.lit(False)
    for m in C.RBS_MOTIFS:
        has = has | F.col("rbs_sequence").contains(m)
    rows = labelled_sites.groupBy("label", "rbs_spacing").agg(
        F.count("*").alias("n"), F.count_if(has).alias("n_with_motif"))
    total = F.sum("n").over(Window.partitionBy("label"))
    return rows.select("*", (F.col("n") / total).alias("share"))


def negative_scores(labelled: DataFrame, columns: tuple[str, str, str] = ("codon_score_norm", "imm_score_norm", "length_score_norm"),
                    limit: float = 0.2) -> DataFrame:
    """How many ORFs of each label have low scores: each, every pair, all three."""
    a, b, c = [F.col(x) < limit for x in columns]
    names = [x.split("_")[0] for x in columns]
    flags = {
        f"low_{names[0]}": a, f"low_{names[1]}": b, f"low_{names[2]}": c,
        f"low_{names[0]}_{names[1]}": a & b, f"low_{names[0]}_{names[2]}": a & c,
        f"low_{names[1]}_{names[2]}": b & c, "low_all": a & b & c,
        **{f"negative_{n}": F.col(x) < 0 for n, x in zip(names, columns)},
    }
    n = F.count("*")
    return labelled.groupBy("label").agg(
        n.alias("n"), *[F.count_if(v).alias(k) for k, v in flags.items()],
        (F.count_if(flags["low_all"]) / n).alias("low_all_share"))


# ---- missed genes ----------------------------------------------------------------------------------
def missed_genes(reference: DataFrame, found: DataFrame, contigs: DataFrame,
                 min_length: int = C.MIN_ORF_LENGTH) -> DataFrame:
    """Reference genes whose coordinates were not found, with the first reason that applies."""
    genes = reference.select(*COORDS, "strand").dropDuplicates(COORDS)
    missed = genes.join(found.select(*COORDS).distinct(), COORDS, "left_anti")
    rows = slice_forward(missed, contigs, F.col("genome_start"), F.col("genome_end"), "_s")
    seq = F.when(F.col("strand").isin("reverse", "-"), reverse_complement(F.col("_s"))).otherwise(F.col("_s"))
    n = F.col("genome_end") - F.col("genome_start") + 1
    rows = rows.select(*COORDS, "strand", n.alias("length"), F.left(seq, F.lit(3)).alias("first_codon"),
                       F.right(seq, F.lit(3)).alias("last_codon"))
    touching = overlap_join(
        rows.select(*COORDS), genes.select(*COORDS), 1000,
        l=("genome_start", "genome_end"), r=("genome_start", "genome_end"),
    ).where("genome_start != r_genome_start or genome_end != r_genome_end").select(*COORDS).distinct()
    rows = rows.join(touching.withColumn("_touches", F.lit(True)), COORDS, "left")
    reason = (
        F.when(F.col("length") < min_length, "too_short")
        .when(~F.col("first_codon").isin(*C.START_CODONS), "no_start_codon")
        .when(~F.col("last_codon").isin(*C.STOP_CODONS), "no_stop_codon")
        .when(F.col("length") % 3 != 0, "frameshifted")
        .when(F.col("_touches"), "overlapping").otherwise("other"))
    size = F.when(F.col("length") < 50, "0-49").when(F.col("length") < 75, "50-74").when(
        F.col("length") < 100, "75-99").otherwise("100+")
    return rows.select(*COORDS, "strand", "length", "first_codon", reason.alias("reason"), size.alias("length_bin"))


def missed_gene_summary(missed: DataFrame, reference: DataFrame) -> DataFrame:
    """Counts per reason, length bin and first codon, with the share of all missed genes and of all genes."""
    total = reference.select(*COORDS).distinct().agg(F.count("*").alias("_refs"))
    n_missed = missed.agg(F.count("*").alias("_missed"))
    counts = missed.groupBy("reason", "length_bin", "first_codon").agg(F.count("*").alias("n"))
    return (
        counts.join(F.broadcast(total), how="cross").join(F.broadcast(n_missed), how="cross")
        .select("reason", "length_bin", "first_codon", "n", (F.col("n") / F.col("_missed")).alias("share_of_missed"),
                (F.col("n") / F.col("_refs")).alias("share_of_genes")))


# ---- starts ----------------------------------------------------------------------------------------
NORMS = [f"{s}_norm" for s in SCORES]


def chosen_and_true(scored: DataFrame, reference: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Per group with a known start: z-scores of the chosen and of the true start side by side."""
    groups = start_choice_groups(scored, reference).withColumn("_w", weighted_sum(weights or C.START_SELECTION_WEIGHTS))
    order = Window.partitionBy(*GROUP).orderBy(F.col("_w").desc(), "start")
    rows = groups.withColumn("_r", F.row_number().over(order))
    chosen = lambda c: F.max(F.when(F.col("_r") == 1, F.col(c)))
    true = lambda c: F.max(F.when(F.col("is_true") == 1, F.col(c)))
    return rows.groupBy(*GROUP).agg(
        chosen("start").alias("chosen_start"), true("start").alias("true_start"),
        chosen("_w").alias("chosen_total"), true("_w").alias("true_total"),
        *[chosen(c).alias(f"chosen_{c}") for c in NORMS], *[true(c).alias(f"true_{c}") for c in NORMS])


def component_wins(pairs: DataFrame) -> DataFrame:
    """Over wrongly chosen starts: how often each component favours the true one, ties, mean difference.

    One row per component, plus the share of correct choices over all groups.
    """
    items = F.array(*[
        F.struct(F.lit(c).alias("component"), (F.col(f"true_{c}") - F.col(f"chosen_{c}")).alias("diff"),
                 F.lit(float(C.START_SELECTION_WEIGHTS[c.split("_")[0]])).alias("weight"))
        for c in NORMS])
    wrong = F.col("true_start") != F.col("chosen_start")
    rows = pairs.select(wrong.alias("wrong"), (F.col("chosen_total") - F.col("true_total")).alias("lead"), F.inline(items))
    d = F.when(F.col("wrong"), F.col("diff"))
    leads = exact_percentiles(rows.where("wrong"), ["component"], "lead", (0.5,)).select("component", F.get("p", F.lit(0)).alias("median_lead"))
    return rows.groupBy("component").agg(
        F.count("*").alias("groups"), F.count_if("wrong").alias("wrong"),
        (1 - F.count_if("wrong") / F.count("*")).alias("correct_share"),
        F.count_if(d > 0).alias("true_wins"), F.count_if(d < 0).alias("chosen_wins"), F.count_if(d == 0).alias("ties"),
        F.avg(d).alias("mean_diff"), F.avg(d * F.col("weight")).alias("mean_weighted_diff"),
        F.avg(F.when(F.col("wrong"), F.col("lead"))).alias("mean_lead")).join(leads, "component", "left")


# ---- purity of self-training sets ------------------------------------------------------------------
def training_purity(sets: DataFrame, reference: DataFrame) -> DataFrame:
    """strategy: size, genes with exact coordinates, percent; best first by ``strategy_rank``."""
    per = label_orfs(sets, reference).groupBy("genome_id", "strategy").agg(
        F.count("*").alias("n"), F.sum("label").alias("true_genes"))
    per = per.withColumn("purity", F.col("true_genes") / F.col("n") * 100)
    out = per.groupBy("strategy").agg(F.sum("n").alias("n"), F.sum("true_genes").alias("true_genes"),
                                      F.avg("purity").alias("mean_purity"))
    rank = Window.orderBy(F.col("mean_purity").desc(), "strategy")  # one row per strategy
    return out.withColumn("strategy_rank", F.row_number().over(rank))


def region_purity(regions: DataFrame, reference: DataFrame, contigs: DataFrame) -> DataFrame:
    """Per strategy: regions and bases free of reference genes and not, share of the genome."""
    genes = merge_intervals(reference.select(*CONTIG, F.col("genome_start").alias("start"),
                                             F.col("genome_end").alias("end")))
    keys = [*CONTIG, "strategy", "start", "end"]
    hit = overlap_join(regions.select(*keys), genes, 1000).groupBy(*keys).agg(
        F.sum(overlap_bp(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))).alias("gene_bp"))
    rows = regions.select(*keys).join(hit, keys, "left").na.fill(0, ["gene_bp"])
    n = F.col("end") - F.col("start") + 1
    clean = F.col("gene_bp") == 0
    total = contigs.agg(F.sum("length").alias("genome_bp"))
    return (
        rows.groupBy("strategy").agg(
            F.count("*").alias("regions"), F.count_if(clean).alias("pure_regions"),
            F.sum(n).alias("bp"), F.sum("gene_bp").alias("gene_bp"))
        .join(F.broadcast(total), how="cross")
        .select("strategy", "regions", "pure_regions", (F.col("regions") - F.col("pure_regions")).alias("contaminated_regions"),
                "bp", "gene_bp", (1 - F.col("gene_bp") / F.col("bp")).alias("pure_share"),
                (F.col("bp") / F.col("genome_bp")).alias("genome_share")))


# ---- table checks ----------------------------------------------------------------------------------
def completeness(table: DataFrame, expected: list[str]) -> DataFrame:
    """Per expected column: present, nulls, rows. Missing columns are reported, not raised."""
    have = [c for c in expected if c in table.columns]
    stats = table.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in have])
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(c in have).alias("present"),
                 (F.col(c) if c in have else F.lit(None)).cast("long").alias("nulls"))
        for c in expected]
    return stats.select("rows", F.inline(F.array(*cells)))


def confusion(scored: DataFrame, prob: str, label: str, threshold: float) -> DataFrame:
    """Confusion counts and metrics of a classifier at a threshold."""
    hit, true = F.col(prob) >= threshold, F.col(label) == 1
    c = scored.agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"),
                   F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    prec, rec = ratio(tp.cast("double"), tp + fp), ratio(tp.cast("double"), tp + fn)
    return c.select("*", ratio((tp + tn).cast("double"), tp + fp + fn + tn).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"), ratio(2 * prec * rec, prec + rec).alias("f1"))
