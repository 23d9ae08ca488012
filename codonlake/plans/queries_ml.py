"""Queries: classifiers. Fits depend on the engine, so those have no SQL; the tests check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codonlake.operators import diagnostics, features, labels, ml, starts, sweeps
from codonlake.operators.orf import GROUP
from codonlake.plans.context import context
from codonlake.plans.oracle_base import block, query
from codonlake.plans.suite import register, rounded, rsql
from codonlake.session import cut_lineage


def _groups(ctx) -> DataFrame:
    def make():
        f = features.group_features(ctx.candidates)
        split = labels.stratified_genome_split(ctx.genomes, 2, 2, 42)
        lab = labels.label_groups(ctx.candidates, ctx.reference)
        return f.join(lab, GROUP).join(F.broadcast(split), "genome_id")

    return ctx._keep("group_table", make)


def _group_scores(ctx) -> DataFrame:
    def make():
        t = _groups(ctx)
        model = ml.train_classifier(t.where("split != 'test'").withColumn("held", F.col("split") == "val"),
                                    features.GROUP_FEATURES, validation="held")
        return ml.score_table(model, t)

    return ctx._keep("group_scores", make)


block("group_labels", "candidates ref_set", """
SELECT c.genome_id, c.contig_id, c.strand, c."end", max(CASE WHEN r.genome_id IS NULL THEN 0 ELSE 1 END) AS label
FROM candidates c LEFT JOIN ref_set r USING (genome_id, contig_id, genome_start, genome_end) GROUP BY ALL
""")
block("genome_splits", "contigs", """
SELECT genome_id, tax_group, CASE WHEN r <= floor(held / 2) THEN 'val' WHEN r <= held THEN 'test' ELSE 'train' END AS split FROM (
  SELECT *, least(4, floor(count(*) OVER (PARTITION BY tax_group) / 3)) AS held,
         row_number() OVER (PARTITION BY tax_group ORDER BY md5('42:' || genome_id), genome_id) AS r
  FROM (SELECT DISTINCT genome_id, tax_group FROM contigs))
""")


@register("split_summary", query("""
SELECT split, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM group_labels JOIN genome_splits USING (genome_id) GROUP BY split""",
                                 "group_labels genome_splits"))
def split_summary_q(spark, sf_dir):
    return labels.split_summary(_groups(context(spark, sf_dir)))


@register("group_classifier")
def group_classifier_q(spark, sf_dir):
    return rounded(_group_scores(context(spark, sf_dir)).select(*GROUP, "split", "label", "prob"))


@register("group_filter")
def group_filter_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return ml.keep_groups(ctx.candidates, _group_scores(ctx)).select(*GROUP, "start")


@register("group_confusion")
def confusion_q(spark, sf_dir):
    s = _group_scores(context(spark, sf_dir)).where("split = 'test'")
    return rounded(diagnostics.confusion(s, "prob", "label", 0.5))


@register("group_threshold")
def group_threshold_q(spark, sf_dir):
    return rounded(sweeps.best_f1_threshold(_group_scores(context(spark, sf_dir)).where("split = 'val'"), "prob", "label"))


def _candidates(ctx) -> DataFrame:
    def make():
        f = features.candidate_features(starts.best_starts(ctx.candidates), ctx.contigs)
        split = labels.stratified_genome_split(ctx.genomes, 2, 2, 42)
        return labels.label_orfs(f, ctx.reference).join(F.broadcast(split), "genome_id")

    return ctx._keep("candidate_table", make)


@register("candidate_classifier")
def candidate_classifier_q(spark, sf_dir):
    """Tabular features and k-mers of the whole sequence; kept candidates with their probability."""
    t = _candidates(context(spark, sf_dir))
    model = ml.train_sequence_classifier(t.where("split = 'train'"), features.CANDIDATE_FEATURES)
    kept = ml.keep_candidates(ml.score_table(model, ml.with_kmers(t)))
    return rounded(kept.select(*GROUP, "start", "label", "hybrid_prob"))


def _all_pairs(ctx) -> DataFrame:
    """Every contested group with its features, whether its true start is known or not."""
    def make():
        sc = cut_lineage(features.start_context(ctx.candidates, ctx.contigs))
        p = features.pair_features(ctx.candidates, ctx.contigs, ctx.models, sc, contest_gap=None)
        return p.join(F.broadcast(labels.stratified_genome_split(ctx.genomes, 2, 2, 42)), "genome_id")

    return ctx._keep("all_pairs", make)


def _pairs(ctx) -> DataFrame:
    """Those whose true start is one of the two, with the label."""
    def make():
        true = labels.start_choice_groups(ctx.candidates, ctx.reference).select(*GROUP, "true_start").distinct()
        return ml.pair_labels(_all_pairs(ctx), true)

    return ctx._keep("pair_table", make)


@register("start_classifier")
def start_classifier_q(spark, sf_dir):
    """Best start per group of the held-out genomes. The classifier is fitted on labelled pairs of the training genomes
    and may flip any contested group, as the true starts of the held-out genomes are not looked at."""
    ctx = context(spark, sf_dir)
    cols = features.pair_columns(("nterm", "gc3", "groupnorm"))
    model = ml.train_classifier(_pairs(ctx).where("split = 'train'"), cols, scale=True)
    held = _all_pairs(ctx).where("split <> 'train'")
    scores = ml.score_table(model, held, "prob_keep")
    rows = ctx.candidates.join(F.broadcast(held.select("genome_id").distinct()), "genome_id", "left_semi")
    return ml.choose_starts(rows, scores).select(*GROUP, "start")


@register("leave_one_group_out")
def leave_out_q(spark, sf_dir):
    """One fold per taxonomic group."""
    return rounded(ml.leave_one_group_out(_pairs(context(spark, sf_dir)), features.PAIR_FEATURES))


@register("parameter_grid")
def grid_q(spark, sf_dir):
    """Three settings of the start classifier, one fold per taxonomic group."""
    grid = [{"maxIter": 5, "maxDepth": 2}, {"maxIter": 10, "maxDepth": 3}, {"maxIter": 20, "maxDepth": 2}]
    return rounded(ml.grid_search(_pairs(context(spark, sf_dir)), features.PAIR_FEATURES, grid))


@register("isotonic_calibration")
def isotonic_q(spark, sf_dir):
    s = _group_scores(context(spark, sf_dir))
    model = ml.isotonic(s.where("split = 'val'"))
    return rounded(model.transform(s).groupBy("split").agg(
        F.avg("prob").alias("mean_prob"), F.avg("calibrated").alias("mean_calibrated"), F.avg("label").alias("rate")))


@register("feature_importance")
def importance_q(spark, sf_dir):
    """Top ten of a forest over the group features."""
    from pyspark.ml.classification import RandomForestClassifier

    t = _groups(context(spark, sf_dir)).where("split = 'train'")
    forest = RandomForestClassifier(labelCol="label", weightCol="class_weight", numTrees=20, maxDepth=5, seed=42)
    top = ml.feature_importance(ml.train_classifier(t, features.GROUP_FEATURES, estimator=forest))
    return rounded(spark.createDataFrame(top, "feature string, importance double"))


block("squashed_cand", "candidates ref_set", """
SELECT c.genome_id, c.contig_id, c.strand, c."end", c.start, CASE WHEN r.genome_id IS NULL THEN 0 ELSE 1 END AS label,
 1 / (1 + exp(-combined_score)) AS prob
FROM candidates c LEFT JOIN ref_set r USING (genome_id, contig_id, genome_start, genome_end)
""")


@register("top_choice_report", query(f"""
SELECT groups, CAST(true_groups AS BIGINT) AS true_groups, {rsql('recall=hit / CAST(true_groups AS DOUBLE)', 'precision=hit / CAST(groups AS DOUBLE)',
 'fallback_recall=fall / CAST(true_groups AS DOUBLE)', 'fallback_precision=fall / CAST(groups AS DOUBLE)',
 *[f"share_{str(t).replace('.', '_')}=s{i}" for i, t in enumerate((0.01, 0.05, 0.1, 0.2, 0.3, 0.5))])} FROM (
 SELECT count(*) AS groups, sum(t) AS true_groups, sum(l1) AS hit, sum(CASE WHEN p1 - p2 < 0.05 THEN l2 ELSE l1 END) AS fall,
  {', '.join(f'avg(CASE WHEN p1 >= {t} THEN 1 ELSE 0 END) AS s{i}' for i, t in enumerate((0.01, 0.05, 0.1, 0.2, 0.3, 0.5)))} FROM (
  SELECT max(label) AS t, max(CASE WHEN r = 1 THEN prob END) AS p1, max(CASE WHEN r = 2 THEN prob END) AS p2,
   max(CASE WHEN r = 1 THEN label END) AS l1, max(CASE WHEN r = 2 THEN label END) AS l2
  FROM (SELECT *, row_number() OVER (PARTITION BY genome_id, contig_id, strand, "end" ORDER BY prob DESC, start) AS r FROM squashed_cand)
  GROUP BY genome_id, contig_id, strand, "end"))""", "squashed_cand"))
def top_choice_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    rows = labels.label_orfs(ctx.candidates, ctx.reference)
    return rounded(ml.top_choice_report(rows.withColumn("prob", 1 / (1 + F.exp(-F.col("combined_score"))))))


_EXPECTED = [*features.CANDIDATE_FEATURES, "absent_feature"]


@register("feature_completeness", query(f"""
SELECT (SELECT count(*) FROM candidates) AS rows, c AS "column", c <> 'absent_feature' AS present,
 CASE WHEN c <> 'absent_feature' THEN 0 END AS nulls FROM (VALUES {', '.join(f"('{c}')" for c in _EXPECTED)}) v(c)""", "candidates"))
def completeness_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return diagnostics.completeness(features.candidate_features(ctx.candidates, ctx.contigs), _EXPECTED)
