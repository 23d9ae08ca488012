"""Queries: grading, diagnostics, purity, sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from codonlake import constants as C
from codonlake.operators import descent, diagnostics as D, features, grading as G, intervals, labels, ml, rbs, selection, starts, sweeps
from codonlake.plans.context import context
from codonlake.plans.oracle_base import block, query
from codonlake.plans.oracle_models import FIRST, SECOND, keep
from codonlake.plans.suite import register, rounded, rsql

_CO = "genome_id, contig_id, genome_start, genome_end"
_Q = ("CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS sensitivity, "
      "CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS precision, "
      "CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1")


def _exact(pred: str, ref: str = "reference") -> str:
    return f"""
SELECT *, {_Q} FROM (
 SELECT g.genome_id, coalesce(t.n, 0) AS tp, coalesce(p.n, 0) - coalesce(t.n, 0) AS fp, coalesce(r.n, 0) - coalesce(t.n, 0) AS fn
 FROM (SELECT genome_id FROM {pred} UNION SELECT genome_id FROM {ref}) g
 LEFT JOIN (SELECT genome_id, count(*) AS n FROM {pred} GROUP BY 1) p USING (genome_id)
 LEFT JOIN (SELECT genome_id, count(*) AS n FROM {ref} GROUP BY 1) r USING (genome_id)
 LEFT JOIN (SELECT genome_id, count(*) AS n FROM {pred} JOIN {ref} USING ({_CO}) GROUP BY 1) t USING (genome_id))"""


block("graded", "predictions reference", _exact("predictions"))
block("groups", "contigs", "SELECT DISTINCT genome_id, tax_group FROM contigs")
_m = ("sensitivity", "precision", "f1")


@register("reference_genes", query(f'SELECT {_CO}, strand, "end", length FROM reference', "reference"))
def reference_q(spark, sf_dir):
    return context(spark, sf_dir).reference


@register("exact_metrics", query(f"SELECT genome_id, tp, fp, fn, {rsql(*_m)} FROM graded", "graded"))
def exact_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return rounded(G.exact_metrics(ctx.predictions, ctx.reference))


@register("tolerance_metrics", query(f"""
SELECT genome_id, tp, fp, fn, matched_refs, {rsql(*_m)} FROM (SELECT *, {_Q.replace('2.0 * tp / (2 * tp + fp + fn)', '2.0 * tp / (2 * tp + fp + fn)')} FROM (
 SELECT g.genome_id, coalesce(t.n, 0) AS tp, coalesce(p.n, 0) - coalesce(t.n, 0) AS fp, coalesce(r.n, 0) - coalesce(t.n, 0) AS fn, coalesce(m.n, 0) AS matched_refs
 FROM (SELECT genome_id FROM predictions UNION SELECT genome_id FROM reference) g
 LEFT JOIN (SELECT genome_id, count(*) AS n FROM predictions GROUP BY 1) p USING (genome_id)
 LEFT JOIN (SELECT genome_id, count(*) AS n FROM reference GROUP BY 1) r USING (genome_id)
 LEFT JOIN (SELECT genome_id, count(*) AS n FROM predictions p WHERE EXISTS (SELECT 1 FROM reference r WHERE r.genome_id = p.genome_id
   AND r.contig_id = p.contig_id AND abs(r.genome_start - p.genome_start) <= 30 AND abs(r.genome_end - p.genome_end) <= 12) GROUP BY 1) t USING (genome_id)
 LEFT JOIN (SELECT genome_id, count(*) AS n FROM reference r WHERE EXISTS (SELECT 1 FROM predictions p WHERE r.genome_id = p.genome_id
   AND r.contig_id = p.contig_id AND abs(r.genome_start - p.genome_start) <= 30 AND abs(r.genome_end - p.genome_end) <= 12) GROUP BY 1) m USING (genome_id)))""",
 "predictions reference"))
def tolerance_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return rounded(G.tolerance_metrics(ctx.predictions, ctx.reference, 30, 12))


block("ref_set", "reference", f"SELECT DISTINCT {_CO} FROM reference")
block("pred_set", "predictions", f"SELECT DISTINCT {_CO} FROM predictions")


@register("set_metrics", query(f"SELECT genome_id, tp, fp, fn, {rsql(*_m)} FROM ({_exact('pred_set', 'ref_set')})", "pred_set ref_set"))
def set_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return rounded(G.set_metrics(ctx.predictions, ctx.reference))


@register("missing_and_extra", query(f"""
SELECT *, 'missing' AS kind FROM (SELECT * FROM ref_set EXCEPT SELECT * FROM pred_set)
UNION ALL SELECT *, 'extra' FROM (SELECT * FROM pred_set EXCEPT SELECT * FROM ref_set)""", "pred_set ref_set"))
def missing_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return G.missing_and_extra(ctx.predictions, ctx.reference)


block("pct", "graded groups", """
SELECT genome_id, tax_group, sensitivity * 100 AS sensitivity, precision * 100 AS precision, f1 * 100 AS f1
FROM graded JOIN groups USING (genome_id)
""")


@register("batch_report", query(f"""
SELECT level, key, n, {rsql(*_m)}, level = 'group' AND f1 < (SELECT avg(f1) FROM pct) - 5 AS flag_low_f1,
       level = 'group' AND n < 10 AS flag_small FROM (
 SELECT 'genome' AS level, genome_id AS key, 1 AS n, sensitivity, precision, f1 FROM pct
 UNION ALL SELECT 'group', tax_group, count(*), avg(sensitivity), avg(precision), avg(f1) FROM pct GROUP BY tax_group
 UNION ALL SELECT 'overall', 'all', count(*), avg(sensitivity), avg(precision), avg(f1) FROM pct)""", "pct"))
def batch_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return rounded(G.batch_report(G.exact_metrics(ctx.predictions, ctx.reference), ctx.genomes))


def _stages(ctx):
    first = ctx.candidates
    return {"scored": ctx.scored, "first_filter": first, "start_choice": starts.best_starts(first),
            "second_filter": ctx.predictions}


block("stage_rows", "scored candidates best_starts predictions", " UNION ALL ".join(
    f"SELECT {_CO}, '{s}' AS stage, {i} AS stage_no FROM {t}" for i, (s, t) in enumerate(
        [("scored", "scored"), ("first_filter", "candidates"), ("start_choice", "best_starts"), ("second_filter", "predictions")])))
block("losses", "stage_rows ref_set", f"""
SELECT *, tp / CAST(n_ref AS DOUBLE) AS sensitivity,
  coalesce(lag(tp) OVER (PARTITION BY genome_id ORDER BY stage_no) - tp, n_ref - tp) AS lost FROM (
  SELECT g.genome_id, g.stage, g.stage_no, g.n_ref, coalesce(x.total, 0) AS total, coalesce(x.tp, 0) AS tp
  FROM (SELECT * FROM (SELECT genome_id, count(*) AS n_ref FROM ref_set GROUP BY 1), (SELECT DISTINCT stage, stage_no FROM stage_rows)) g
  LEFT JOIN (SELECT s.genome_id, stage, count(*) AS total, count(r.genome_id) AS tp FROM stage_rows s LEFT JOIN ref_set r USING ({_CO}) GROUP BY ALL) x
  USING (genome_id, stage))
""")


@register("stage_losses", query(
    f"SELECT genome_id, stage, stage_no, total, tp, n_ref, {rsql('sensitivity')}, lost FROM losses", "losses"))
def stage_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return rounded(G.stage_losses(_stages(ctx), ctx.reference))


@register("stage_group_means", query(f"""
SELECT tax_group, stage, stage_no, {rsql('mean_lost_share=avg(lost / CAST(n_ref AS DOUBLE))', 'mean_sensitivity=avg(sensitivity)')}
FROM losses JOIN groups USING (genome_id) GROUP BY tax_group, stage, stage_no""", "losses groups"))
def stage_means_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return rounded(G.stage_group_means(G.stage_losses(_stages(ctx), ctx.reference), ctx.genomes))


@register("worst_losers", query(f"""
SELECT stage, rank, genome_id, lost, {rsql('lost_share')} FROM (
  SELECT *, lost / CAST(n_ref AS DOUBLE) AS lost_share, row_number() OVER (PARTITION BY stage ORDER BY lost / CAST(n_ref AS DOUBLE) DESC, genome_id) AS rank
  FROM losses) WHERE rank <= 5""", "losses"))
def losers_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return rounded(G.worst_losers(G.stage_losses(_stages(ctx), ctx.reference)))


block("chosen_equal", "scored", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY genome_id, contig_id, strand, "end" ORDER BY combined_score DESC, start) AS rn
FROM scored WHERE """ + FIRST + ") WHERE rn = 1 AND " + SECOND)
block("graded_equal", "chosen_equal reference", _exact("chosen_equal"))


@register("start_choice_comparison", query(f"""
SELECT genome_id, o.tp AS old_tp, n.tp AS new_tp, n.tp - o.tp AS delta_tp,
 {rsql('delta_sensitivity=(n.sensitivity - o.sensitivity) * 100', 'delta_precision=(n.precision - o.precision) * 100', 'delta_f1=(n.f1 - o.f1) * 100')},
 CASE WHEN (n.f1 - o.f1) * 100 > 0.5 THEN 'better' WHEN (n.f1 - o.f1) * 100 < -0.5 THEN 'worse' ELSE 'same' END AS verdict
FROM graded_equal o JOIN graded n USING (genome_id)""", "graded_equal graded"))
def choice_q(spark, sf_dir):
    """Equal weights against the selection weights."""
    from codonlake.plans.predict import predict_from_scored

    ctx = context(spark, sf_dir)
    old = G.exact_metrics(predict_from_scored(ctx.scored, weights=C.SCORE_WEIGHTS), ctx.reference)
    return rounded(G.compare_runs(old, G.exact_metrics(ctx.predictions, ctx.reference), ["genome_id"]))


block("stage_configs", "best_starts predictions chosen_equal", " UNION ALL ".join(
    f"SELECT {_CO}, genome_id AS g, '{n}' AS config FROM {t}" for n, t in (
        ("first_filter_only", "best_starts"), ("both_filters", "predictions"), ("equal_weights", "chosen_equal"))))


@register("configuration_metrics", query(f"""
SELECT genome_id, config, tp, fp, fn, {rsql(*_m)} FROM (SELECT *, {_Q} FROM (
 SELECT r.genome_id, c.config, coalesce(t.tp, 0) AS tp, coalesce(t.p, 0) - coalesce(t.tp, 0) AS fp, r.n - coalesce(t.tp, 0) AS fn
 FROM (SELECT genome_id, count(*) AS n FROM reference GROUP BY 1) r, (SELECT DISTINCT config FROM stage_configs) c
 LEFT JOIN (SELECT s.genome_id, config, count(*) AS p, count(x.genome_id) AS tp FROM stage_configs s LEFT JOIN reference x USING ({_CO}) GROUP BY ALL) t
 ON t.genome_id = r.genome_id AND t.config = c.config))""", "stage_configs reference"))
def config_q(spark, sf_dir):
    """Several configurations graded in one job."""
    from codonlake.plans.predict import predict_from_scored

    ctx = context(spark, sf_dir)
    cols = ["genome_id", "contig_id", "genome_start", "genome_end"]
    runs = {"first_filter_only": starts.best_starts(ctx.candidates), "both_filters": ctx.predictions,
            "equal_weights": predict_from_scored(ctx.scored, weights=C.SCORE_WEIGHTS)}
    rows = None
    for name, df in runs.items():
        part = df.select(*cols, F.lit(name).alias("config"))
        rows = part if rows is None else rows.unionByName(part)
    return rounded(G.exact_metrics(rows, ctx.reference, extra=["config"]))


# ---- labels and distributions ----------------------------------------------------------------------
block("labelled", "scored ref_set", f"""
SELECT s.*, CASE WHEN r.genome_id IS NULL THEN 0 ELSE 1 END AS label FROM scored s LEFT JOIN ref_set r USING ({_CO})
""")


def _labelled(ctx):
    return labels.label_orfs(ctx.scored, ctx.reference)


@register("label_orfs", query('SELECT genome_id, contig_id, strand, start, "end", label FROM labelled', "labelled"))
def label_q(spark, sf_dir):
    return _labelled(context(spark, sf_dir)).select("genome_id", "contig_id", "strand", "start", "end", "label")


@register("label_groups", query("""SELECT genome_id, contig_id, strand, "end", max(label) AS label FROM (
SELECT c.*, l.label FROM candidates c JOIN labelled l USING (genome_id, contig_id, strand, start)) GROUP BY ALL""", "candidates labelled"))
def label_groups_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return labels.label_groups(ctx.candidates, ctx.reference)


block("long_scores", "labelled", " UNION ALL ".join(
    f"SELECT '{c}_score' AS component, label, {c}_score AS value FROM labelled" for c in C.COMPONENTS))
_st = {"n": "count(*)", "mean": "avg(value)", "median": "median(value)", "std": "stddev_pop(value)", "min": "min(value)", "max": "max(value)"}
block("dist", "long_scores", "SELECT component, " + ", ".join(
    f"{e.replace('count(*)', 'count(*)')} FILTER (WHERE label = {l}) AS {p}_{n}" for l, p in ((1, "tp"), (0, "fp")) for n, e in _st.items())
    + " FROM long_scores GROUP BY component")
_sep = "CASE WHEN tp_std + fp_std > 0 THEN abs(tp_mean - fp_mean) / ((tp_std + fp_std) / 2) ELSE 0 END"


@register("score_distributions", query(f"""
SELECT component, tp_n, fp_n, {rsql(*[f'{p}_{n}' for p in ('tp', 'fp') for n in list(_st)[1:]], 'separation=' + _sep)},
 CASE WHEN {_sep} > 0.8 THEN 'good' WHEN {_sep} > 0.5 THEN 'moderate' ELSE 'poor' END AS separation_class FROM dist""", "dist"))
def dist_q(spark, sf_dir):
    return rounded(D.score_distributions(_labelled(context(spark, sf_dir))))


@register("effect_sizes", query(f"""
SELECT component, {rsql('cohens_d=CASE WHEN tp_std + fp_std > 0 THEN (tp_mean - fp_mean) / sqrt((tp_std * tp_std + fp_std * fp_std) / 2) ELSE 0 END')} FROM dist""", "dist"))
def effect_q(spark, sf_dir):
    return rounded(D.effect_sizes(_labelled(context(spark, sf_dir))))


@register("score_percentiles", query(f"""
SELECT label, {rsql(*[f'p{p}=quantile_cont(combined_score, {p / 100})' for p in (10, 25, 50, 75, 90)])} FROM labelled GROUP BY label""", "labelled"))
def percentiles_q(spark, sf_dir):
    return rounded(D.score_percentiles(_labelled(context(spark, sf_dir))))


@register("score_histogram", query(f"""
SELECT component, label, CAST(b AS INTEGER) AS bin, {rsql('bin_start=lo + b * (hi - lo) / 50')}, count(*) AS n FROM (
 SELECT *, CASE WHEN hi > lo THEN least(floor((value - lo) / ((hi - lo) / 50)), 49) ELSE 0 END AS b FROM (
  SELECT *, min(value) OVER (PARTITION BY component) AS lo, max(value) OVER (PARTITION BY component) AS hi
  FROM long_scores))
GROUP BY component, label, b, lo, hi""", "long_scores"))
def histogram_q(spark, sf_dir):
    return rounded(D.histogram(_labelled(context(spark, sf_dir)), D.SCORES))


@register("suggested_cut", query(f"SELECT component, {rsql('cut=(tp_median + fp_median) / 2')} FROM dist", "dist"))
def cut_q(spark, sf_dir):
    return rounded(D.suggested_cut(_labelled(context(spark, sf_dir)), D.SCORES))


@register("site_distribution", query(f"""
SELECT label, rbs_spacing, n, n_with_motif, {rsql('share=n / CAST(sum(n) OVER (PARTITION BY label) AS DOUBLE)')} FROM (
 SELECT label, CAST(spacing AS INTEGER) AS rbs_spacing, count(*) AS n,
  count(*) FILTER (WHERE regexp_matches(word, 'AGGAGG|GGAGG|AGGAG|GAGG|AGGA|GGAG')) AS n_with_motif
 FROM (SELECT *, row_number() OVER (PARTITION BY genome_id, contig_id, strand, start ORDER BY site_score DESC, site_start, site_length) AS rn FROM site_hits)
 JOIN labelled USING (genome_id, contig_id, strand, start) WHERE rn = 1 GROUP BY label, spacing)""", "site_hits labelled"))
def site_dist_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    lab = labels.label_orfs(ctx.orfs, ctx.reference)
    return rounded(D.site_distribution(rbs.best_sites(lab, ["genome_id", "contig_id", "strand", "start", "label"])))


_low = {"low_codon": "a", "low_imm": "b", "low_length": "c", "low_codon_imm": "a AND b", "low_codon_length": "a AND c",
        "low_imm_length": "b AND c", "low_all": "a AND b AND c", "negative_codon": "codon_score_norm < 0",
        "negative_imm": "imm_score_norm < 0", "negative_length": "length_score_norm < 0"}


@register("negative_scores", query(f"""
SELECT label, count(*) AS n, {', '.join(f'count(*) FILTER (WHERE {v}) AS {k}' for k, v in _low.items())},
 {rsql('low_all_share=count(*) FILTER (WHERE a AND b AND c) / CAST(count(*) AS DOUBLE)')}
FROM (SELECT *, codon_score_norm < 0.2 AS a, imm_score_norm < 0.2 AS b, length_score_norm < 0.2 AS c FROM labelled) GROUP BY label""", "labelled"))
def negative_q(spark, sf_dir):
    return rounded(D.negative_scores(_labelled(context(spark, sf_dir))))


block("missed", "reference predictions contigs ref_set", f"""
SELECT m.*, CASE WHEN m.length < 100 THEN 'too_short' WHEN left(s, 3) NOT IN ('ATG','GTG','TTG') THEN 'no_start_codon'
  WHEN right(s, 3) NOT IN ('TAA','TAG','TGA') THEN 'no_stop_codon' WHEN m.length % 3 <> 0 THEN 'frameshifted'
  WHEN EXISTS (SELECT 1 FROM ref_set r WHERE r.genome_id = m.genome_id AND r.contig_id = m.contig_id AND r.genome_start <= m.genome_end
     AND m.genome_start <= r.genome_end AND (r.genome_start <> m.genome_start OR r.genome_end <> m.genome_end)) THEN 'overlapping'
  ELSE 'other' END AS reason, left(s, 3) AS first_codon,
 CASE WHEN m.length < 50 THEN '0-49' WHEN m.length < 75 THEN '50-74' WHEN m.length < 100 THEN '75-99' ELSE '100+' END AS length_bin
FROM (SELECT r.*, CASE WHEN strand = 'forward' THEN substr(c.seq, genome_start, r.length)
        ELSE reverse(translate(substr(c.seq, genome_start, r.length), 'ACGT', 'TGCA')) END AS s
      FROM reference r JOIN contigs c USING (genome_id, contig_id)
      WHERE ({_CO}) NOT IN (SELECT ({_CO}) FROM predictions)) m
""")


@register("missed_genes", query(f"SELECT {_CO}, strand, length, first_codon, reason, length_bin FROM missed", "missed"))
def missed_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return D.missed_genes(ctx.reference, ctx.predictions, ctx.contigs)


@register("missed_gene_summary", query(f"""
SELECT reason, length_bin, first_codon, count(*) AS n, {rsql('share_of_missed=count(*) / CAST((SELECT count(*) FROM missed) AS DOUBLE)',
 'share_of_genes=count(*) / CAST((SELECT count(*) FROM ref_set) AS DOUBLE)')} FROM missed GROUP BY reason, length_bin, first_codon""", "missed ref_set"))
def missed_summary_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return rounded(D.missed_gene_summary(D.missed_genes(ctx.reference, ctx.predictions, ctx.contigs), ctx.reference))


# ---- start choice ----------------------------------------------------------------------------------
_K = 'genome_id, contig_id, strand, "end"'
block("choice_groups", "labelled", f"""
SELECT *, CASE WHEN start = true_start THEN 1 ELSE 0 END AS is_true FROM (
 SELECT *, min(CASE WHEN label = 1 THEN start END) OVER (PARTITION BY {_K}) AS true_start, count(*) OVER (PARTITION BY {_K}) AS n_starts FROM labelled)
WHERE n_starts >= 2 AND true_start IS NOT NULL
""")


@register("start_calibration_rows", query(f"""
SELECT {_K}, start, true_start, is_true, {rsql(*D.NORMS)} FROM choice_groups""", "choice_groups"))
def calibration_rows_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    g = labels.start_choice_groups(ctx.scored, ctx.reference)
    return rounded(g.select("genome_id", "contig_id", "strand", "end", "start", "true_start", "is_true", *D.NORMS))


block("choice_pairs", "choice_groups", f"""
SELECT {_K}, max(CASE WHEN r = 1 THEN start END) AS chosen_start, max(true_start) AS true_start,
 max(CASE WHEN r = 1 THEN selection_score END) AS chosen_total, max(CASE WHEN is_true = 1 THEN selection_score END) AS true_total,
 {', '.join(f"max(CASE WHEN r = 1 THEN {n} END) AS chosen_{n}, max(CASE WHEN is_true = 1 THEN {n} END) AS true_{n}" for n in D.NORMS)}
FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY selection_score DESC, start) AS r FROM choice_groups) GROUP BY {_K}
""")


@register("component_wins", query(f"""
SELECT component, count(*) AS groups, count(*) FILTER (WHERE wrong) AS wrong, {rsql('correct_share=1 - count(*) FILTER (WHERE wrong) / CAST(count(*) AS DOUBLE)')},
 count(*) FILTER (WHERE wrong AND d > 0) AS true_wins, count(*) FILTER (WHERE wrong AND d < 0) AS chosen_wins, count(*) FILTER (WHERE wrong AND d = 0) AS ties,
 {rsql('mean_diff=avg(d) FILTER (WHERE wrong)', 'mean_weighted_diff=avg(d * w) FILTER (WHERE wrong)', 'mean_lead=avg(lead) FILTER (WHERE wrong)', 'median_lead=median(lead) FILTER (WHERE wrong)')}
FROM ({' UNION ALL '.join(f"SELECT '{n}' AS component, true_start <> chosen_start AS wrong, true_{n} - chosen_{n} AS d, {C.START_SELECTION_WEIGHTS[n.split('_')[0]]}::DOUBLE AS w, chosen_total - true_total AS lead FROM choice_pairs" for n in D.NORMS)})
GROUP BY component""", "choice_pairs"))
def wins_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return rounded(D.component_wins(D.chosen_and_true(ctx.scored, ctx.reference)))


_VEC = sweeps.weight_vectors(C.START_SELECTION_WEIGHTS)
block("vectors", "", "SELECT * FROM (VALUES " + ", ".join(
    f"('{v['vector']}', " + ", ".join(f"{v[c]!r}::DOUBLE" for c in C.COMPONENTS) + ")" for v in _VEC)
    + ") v(vector, " + ", ".join(f"w_{c}" for c in C.COMPONENTS) + ")")
block("vector_hits", "vectors choice_groups", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_K}, vector ORDER BY s DESC, start) AS r FROM (
 SELECT {_K}, start, is_true, vector, {' + '.join(f'{c}_score_norm * w_{c}' for c in C.COMPONENTS)} AS s FROM choice_groups, vectors)) WHERE r = 1
""")
block("vector_accuracy", "vector_hits", "SELECT vector, count(*) AS groups, avg(is_true) AS accuracy FROM vector_hits GROUP BY vector")


@register("weight_grid", query(f"SELECT vector, groups, {rsql('accuracy')} FROM vector_accuracy", "vector_accuracy"))
def weight_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return rounded(sweeps.weight_accuracy(labels.start_choice_groups(ctx.scored, ctx.reference), _VEC))


@register("weight_best_change", query(f"""
SELECT component, vector, {rsql('accuracy', 'base_accuracy', 'gain=accuracy - base_accuracy')} FROM (
 SELECT *, split_part(vector, '*', 1) AS component, (SELECT accuracy FROM vector_accuracy WHERE vector = 'base') AS base_accuracy,
  row_number() OVER (PARTITION BY split_part(vector, '*', 1) ORDER BY accuracy DESC, vector DESC) AS r FROM vector_accuracy WHERE vector <> 'base') WHERE r = 1""", "vector_accuracy"))
def weight_best_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    acc = sweeps.weight_accuracy(labels.start_choice_groups(ctx.scored, ctx.reference), _VEC)
    return rounded(sweeps.best_per_weight(acc))


@register("softmax_loss", query(f"""
SELECT count(*) AS groups, {rsql('loss=avg(-ln(t / z))', *[f'grad_{c}=avg(m_{c} / z - t_{c})' for c in C.COMPONENTS])} FROM (
 SELECT {_K}, sum(e) AS z, max(CASE WHEN is_true = 1 THEN e END) AS t,
  {', '.join(f"sum(e * {c}_score_norm) AS m_{c}, max(CASE WHEN is_true = 1 THEN {c}_score_norm END) AS t_{c}" for c in C.COMPONENTS)}
 FROM (SELECT *, exp(selection_score - max(selection_score) OVER (PARTITION BY {_K})) AS e FROM choice_groups) GROUP BY {_K})""", "choice_groups"))
def softmax_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return rounded(sweeps.softmax_loss(labels.start_choice_groups(ctx.scored, ctx.reference), C.START_SELECTION_WEIGHTS))


@register("weight_descent")
def descent_q(spark, sf_dir):
    """Weights fitted from twelve starting points at once."""
    ctx = context(spark, sf_dir)
    return rounded(descent.descend_all(labels.start_choice_groups(ctx.scored, ctx.reference), descent.starting_points(C.START_SELECTION_WEIGHTS)), 4)


def _hit(weights: dict[str, float]) -> str:
    total = " + ".join(f"{c}_score_norm * {weights[c]!r}::DOUBLE" for c in C.COMPONENTS)
    return f"first(is_true ORDER BY {total} DESC, start)"


@register("bootstrap_interval", query(f"""
SELECT {rsql('mean_delta', 'low', 'high')}, CASE WHEN low > 0 THEN 'improvement' WHEN high < 0 THEN 'regression' ELSE 'no difference' END AS verdict FROM (
 SELECT avg(delta) AS mean_delta, quantile_cont(delta, 0.025) AS low, quantile_cont(delta, 0.975) AS high FROM (
  SELECT replicate, sum(d * k) / CAST(sum(k) AS DOUBLE) AS delta FROM (
   SELECT d, block * 8 + i + 1 AS replicate, len(list_filter({sweeps.poisson_limits()}, lambda x: x <= ('0x' || substr(h, 1 + 4 * i, 4))::INT)) AS k FROM (
    SELECT d, block, md5('42:' || key || ':' || block) AS h FROM (
     SELECT concat_ws(':', {_K}) AS key, {_hit(C.START_SELECTION_WEIGHTS)} - {_hit(C.SCORE_WEIGHTS)} AS d FROM choice_groups GROUP BY {_K}), range(63) b(block)), range(8) t(i))
  WHERE replicate <= 500 GROUP BY replicate))""", "choice_groups"))
def bootstrap_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    g = labels.start_choice_groups(ctx.scored, ctx.reference)
    return rounded(sweeps.bootstrap_delta(g, C.SCORE_WEIGHTS, C.START_SELECTION_WEIGHTS, 500))


@register("stratified_split")
def split_q(spark, sf_dir):
    return labels.stratified_genome_split(context(spark, sf_dir).genomes, 2, 2, 42)


@register("weight_generalisation")
def generalisation_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    split = labels.stratified_genome_split(ctx.genomes, 2, 2, 42)
    return rounded(sweeps.generalisation_gap(labels.start_choice_groups(ctx.scored, ctx.reference), split, _VEC))


# ---- filters ---------------------------------------------------------------------------------------
_SET = [{"name": "both", "first": C.FIRST_FILTER, "second": C.SECOND_FILTER},
        {"name": "first_only", "first": C.FIRST_FILTER, "second": C.FIRST_FILTER},
        {"name": "second_twice", "first": C.SECOND_FILTER, "second": C.SECOND_FILTER},
        {"name": "open", "first": {k: -5.0 for k in C.FIRST_FILTER}, "second": {k: 0.0 for k in C.FIRST_FILTER}}]


def _setting(s: dict) -> str:
    return f"""SELECT '{s['name']}' AS setting, count(*) AS predicted, count(r.genome_id) AS tp FROM (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY selection_score DESC, start) AS rn FROM scored WHERE {keep(**s['first'])})
 WHERE rn = 1 AND {keep(**s['second'])}) p LEFT JOIN ref_set r USING ({_CO})"""


@register("filter_grid", query(f"""
SELECT setting, predicted, tp, {rsql('sensitivity=sens', 'precision=prec',
 'objective=sqrt(sens * prec) - CASE WHEN prec < 0.78 THEN (0.78 - prec) * 2 ELSE 0 END - CASE WHEN sens < 0.60 THEN 0.60 - sens ELSE 0 END')}
FROM (SELECT *, tp / CAST((SELECT count(*) FROM ref_set) AS DOUBLE) AS sens, tp / CAST(predicted AS DOUBLE) AS prec FROM ({' UNION ALL '.join(map(_setting, _SET))}))""", "scored ref_set"))
def filter_grid_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return rounded(sweeps.filter_grid(ctx.scored, ctx.reference, _SET))


_TH = [round(0.05 * i, 2) for i in range(1, 20)]
block("squashed", "labelled", "SELECT genome_id, label, 1 / (1 + exp(-combined_score)) AS prob FROM labelled")
block("sweep", "squashed", f"""
SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS recall,
 CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM (
 SELECT genome_id, threshold, count(*) FILTER (WHERE prob >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE prob >= threshold AND label = 0) AS fp,
  count(*) FILTER (WHERE prob < threshold AND label = 1) AS fn FROM squashed, (SELECT unnest({_TH}::DOUBLE[]) AS threshold) GROUP BY ALL)
""")


def _squashed(ctx):
    return _labelled(ctx).select("genome_id", "label", (1 / (1 + F.exp(-F.col("combined_score")))).alias("prob"))


@register("threshold_sweep", query(f"SELECT genome_id, threshold, tp, fp, fn, {rsql('precision', 'recall', 'f1')} FROM sweep", "sweep"))
def sweep_q(spark, sf_dir):
    return rounded(sweeps.threshold_sweep(_squashed(context(spark, sf_dir)), "prob", "label", _TH, ["genome_id"]))


@register("constrained_threshold", query(f"""
SELECT threshold, {rsql('precision', 'recall', 'f1')} FROM (SELECT threshold, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM sweep GROUP BY threshold)
WHERE precision >= 0.2 ORDER BY f1 DESC, threshold LIMIT 1""", "sweep"))
def constrained_q(spark, sf_dir):
    s = sweeps.threshold_sweep(_squashed(context(spark, sf_dir)), "prob", "label", _TH, ["genome_id"])
    return rounded(sweeps.constrained_choice(s, 0.2))


@register("best_f1_threshold", query(f"""
SELECT {rsql('threshold', 'precision', 'recall', 'f1')} FROM (
 SELECT prob AS threshold, tp / CAST(called AS DOUBLE) AS precision, tp / CAST(total AS DOUBLE) AS recall, 2.0 * tp / (called + total) AS f1 FROM (
  SELECT prob, sum(n) OVER w AS called, sum(pos) OVER w AS tp, sum(pos) OVER () AS total
  FROM (SELECT prob, count(*) AS n, sum(label) AS pos FROM squashed GROUP BY prob) WINDOW w AS (ORDER BY prob DESC ROWS UNBOUNDED PRECEDING)))
ORDER BY f1 DESC, threshold LIMIT 1""", "squashed"))
def best_f1_q(spark, sf_dir):
    return rounded(sweeps.best_f1_threshold(_squashed(context(spark, sf_dir)), "prob", "label"))


@register("temperature_loss", query(f"""
SELECT temperature, {rsql('log_loss=avg(-(label * ln(q) + (1 - label) * ln(1 - q)))')} FROM (
 SELECT label, temperature, least(greatest(1 / (1 + exp(-ln(least(greatest(prob, 1e-7), 1 - 1e-7) / (1 - least(greatest(prob, 1e-7), 1 - 1e-7))) / temperature)), 1e-15), 1 - 1e-15) AS q
 FROM squashed, (SELECT unnest([0.5, 1.0, 2.0, 4.0]::DOUBLE[]) AS temperature)) GROUP BY temperature""", "squashed"))
def temperature_q(spark, sf_dir):
    return rounded(sweeps.temperature_loss(_squashed(context(spark, sf_dir)), "prob", "label", [0.5, 1.0, 2.0, 4.0]))


_GRID = [-1.0, 0.0, 0.5, 1.0]
block("gc_tier", "contigs", """
SELECT genome_id, CASE WHEN sum(length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / CAST(sum(length) AS DOUBLE) >= 0.41 THEN 'high' ELSE 'low' END AS tier
FROM contigs GROUP BY genome_id
""")
block("gc_grid", "labelled gc_tier ref_set", f"""
SELECT tier, threshold, count(*) AS kept, sum(label) AS tp, sum(label) / CAST(any_value(n_ref) AS DOUBLE) AS sensitivity, avg(label) AS precision
FROM labelled JOIN gc_tier USING (genome_id) JOIN (SELECT tier, count(*) AS n_ref FROM ref_set JOIN gc_tier USING (genome_id) GROUP BY tier) USING (tier),
 (SELECT unnest({sorted({*_GRID, 0.2643})}::DOUBLE[]) AS threshold)
WHERE NOT ((length_score < -0.2812::DOUBLE AND codon_score < 0.2665::DOUBLE AND imm_score < 0.2308::DOUBLE) OR combined_score < threshold)
GROUP BY tier, threshold
""")


@register("gc_tier_grid", query(f"""
SELECT g.tier, g.threshold, g.kept, CAST(g.tp AS BIGINT) AS tp, {rsql('sensitivity=g.sensitivity', 'precision=g.precision',
 'delta_sensitivity=g.sensitivity - b.sensitivity', 'delta_precision=g.precision - b.precision')}
FROM gc_grid g JOIN gc_grid b ON b.tier = g.tier AND b.threshold = 0.2643::DOUBLE""", "gc_grid"))
def gc_grid_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    gc = features.genome_gc(ctx.contigs)
    return rounded(sweeps.gc_tier_grid(ctx.scored, ctx.reference, gc, _GRID, high=0.41))


# ---- purity ----------------------------------------------------------------------------------------
block("train_sets", "longest_first atg_first training0", " UNION ALL ".join(
    f"SELECT {_CO}, '{n}' AS strategy FROM {t}" for n, t in (("longest_first", "longest_first"), ("atg_first", "atg_first"), ("both", "training0"))))


@register("training_purity", query(f"""
SELECT *, row_number() OVER (ORDER BY mean_purity DESC, strategy) AS strategy_rank FROM (
SELECT strategy, CAST(sum(n) AS BIGINT) AS n, CAST(sum(t) AS BIGINT) AS true_genes, {rsql('mean_purity=avg(t / CAST(n AS DOUBLE) * 100)')} FROM (
 SELECT s.genome_id, strategy, count(*) AS n, count(r.genome_id) AS t FROM train_sets s LEFT JOIN ref_set r USING ({_CO}) GROUP BY ALL) GROUP BY strategy)""", "train_sets ref_set"))
def purity_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    cols = ["genome_id", "contig_id", "genome_start", "genome_end"]
    sets = [(n, df.select(*cols)) for n, df in (("longest_first", selection.longest_first(ctx.orfs)),
            ("atg_first", selection.atg_first(ctx.orfs)), ("both", selection.training_set(ctx.orfs)))]
    rows = sets[0][1].withColumn("strategy", F.lit(sets[0][0]))
    for n, df in sets[1:]:
        rows = rows.unionByName(df.withColumn("strategy", F.lit(n)))
    return rounded(D.training_purity(rows, ctx.reference))


block("ref_merged", "reference", """
SELECT genome_id, contig_id, min(s) AS s, max(e) AS e FROM (
 SELECT *, sum(o) OVER (PARTITION BY genome_id, contig_id ORDER BY s, e, o DESC ROWS UNBOUNDED PRECEDING) AS isl FROM (
  SELECT genome_id, contig_id, genome_start AS s, genome_end AS e, CASE WHEN genome_start <= max(genome_end) OVER (PARTITION BY genome_id, contig_id
    ORDER BY genome_start, genome_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM reference))
GROUP BY genome_id, contig_id, isl
""")


@register("region_purity", query(f"""
SELECT strategy, count(*) AS regions, count(*) FILTER (WHERE g = 0) AS pure_regions, count(*) FILTER (WHERE g > 0) AS contaminated_regions,
 CAST(sum(n) AS BIGINT) AS bp, CAST(sum(g) AS BIGINT) AS gene_bp, {rsql('pure_share=1 - sum(g) / CAST(sum(n) AS DOUBLE)',
 'genome_share=sum(n) / CAST((SELECT sum(length) FROM contigs) AS DOUBLE)')} FROM (
 SELECT p.genome_id, p.contig_id, p.strategy, p.start, any_value(p."end" - p.start + 1) AS n,
   coalesce(sum(CASE WHEN r.s IS NOT NULL THEN least(p."end", r.e) - greatest(p.start, r.s) + 1 END), 0) AS g
 FROM gaps p LEFT JOIN ref_merged r ON r.genome_id = p.genome_id AND r.contig_id = p.contig_id AND r.s <= p."end" AND r.e >= p.start
 GROUP BY p.genome_id, p.contig_id, p.strategy, p.start) GROUP BY strategy""", "gaps ref_merged contigs"))
def region_purity_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return rounded(D.region_purity(intervals.gaps_by_strategy(ctx.orfs, ctx.contigs), ctx.reference, ctx.contigs))


@register("gc_tier_choice", query(f"""
SELECT threshold, {rsql('high_gain', 'low_change')} FROM (
 SELECT threshold, max(CASE WHEN tier = 'high' THEN d_sens END) AS high_gain, max(CASE WHEN tier = 'low' THEN d_prec END) AS low_change FROM (
  SELECT g.tier, g.threshold, g.sensitivity - b.sensitivity AS d_sens, g.precision - b.precision AS d_prec
  FROM gc_grid g JOIN gc_grid b ON b.tier = g.tier AND b.threshold = 0.2643::DOUBLE) GROUP BY threshold)
WHERE coalesce(low_change, 0) >= -0.02 ORDER BY high_gain DESC NULLS LAST, threshold LIMIT 1""", "gc_grid"))
def gc_choice_q(spark, sf_dir):
    """The threshold that the grid by GC tier leads to."""
    ctx = context(spark, sf_dir)
    grid = sweeps.gc_tier_grid(ctx.scored, ctx.reference, features.genome_gc(ctx.contigs), _GRID, high=0.41)
    return rounded(sweeps.choose_gc_threshold(grid))


@register("two_model_sweep", query(f"""
SELECT model, threshold, tp, fp, fn, {rsql('precision=CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END',
 'recall=CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END', 'f1=CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END')} FROM (
 SELECT model, threshold, count(*) FILTER (WHERE prob >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE prob >= threshold AND label = 0) AS fp,
  count(*) FILTER (WHERE prob < threshold AND label = 1) AS fn
 FROM (SELECT 'old' AS model, label, 1 / (1 + exp(-combined_score)) AS prob FROM labelled UNION ALL SELECT 'new', label, 1 / (1 + exp(-length_score_norm)) FROM labelled),
  (SELECT unnest({_TH}::DOUBLE[]) AS threshold) GROUP BY model, threshold)""", "labelled"))
def two_models_q(spark, sf_dir):
    """The sum of all scores as the one model, the length alone as the other, at the same thresholds."""
    rows = _labelled(context(spark, sf_dir))
    both = rows.select("label", (1 / (1 + F.exp(-F.col("combined_score")))).alias("old"), (1 / (1 + F.exp(-F.col("length_score_norm")))).alias("new"))
    return rounded(ml.sweep_two_models(both, "old", "new", "label", _TH))


block("bench_used", "groups", "SELECT genome_id, tax_group FROM (SELECT *, row_number() OVER (PARTITION BY tax_group ORDER BY genome_id) AS r FROM groups) WHERE r <= 3")
block("bench_timed", "bench_used contigs", """
SELECT genome_id, u.tax_group, sum(length) / 1e6 AS seconds FROM bench_used u JOIN contigs USING (genome_id) GROUP BY ALL
""")
block("bench_few", "bench_used pct", "SELECT p.* FROM pct p JOIN (SELECT genome_id FROM bench_used) USING (genome_id)")


@register("benchmark_summary", query(f"""
SELECT level, key, n, {rsql(*_m)}, level = 'group' AND f1 < (SELECT avg(f1) FROM bench_few) - 5 AS flag_low_f1, level = 'group' AND n < 10 AS flag_small, {rsql('seconds')} FROM (
 SELECT 'genome' AS level, genome_id AS key, 1 AS n, sensitivity, precision, f1 FROM bench_few
 UNION ALL SELECT 'group', tax_group, count(*), avg(sensitivity), avg(precision), avg(f1) FROM bench_few GROUP BY tax_group
 UNION ALL SELECT 'overall', 'all', count(*), avg(sensitivity), avg(precision), avg(f1) FROM bench_few)
LEFT JOIN (SELECT 'genome' AS level, genome_id AS key, seconds FROM bench_timed UNION ALL SELECT 'group', tax_group, avg(seconds) FROM bench_timed GROUP BY tax_group
 UNION ALL SELECT 'overall', 'all', avg(seconds) FROM bench_timed) USING (level, key)""", "bench_few bench_timed"))
def benchmark_q(spark, sf_dir):
    """Three genomes of each group, with a microsecond a base as their runtime."""
    ctx = context(spark, sf_dir)
    runtimes = ctx.contigs.groupBy("genome_id").agg((F.sum("length") / 1e6).alias("seconds"))
    return rounded(G.benchmark_summary(G.exact_metrics(ctx.predictions, ctx.reference), ctx.genomes, runtimes, limit=3))
