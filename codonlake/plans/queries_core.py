"""Queries: detection, binding sites, intervals, training sets, models, scores, choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from codonlake import constants as C
from codonlake.operators import intervals, models, orf, rbs, scoring, selection, starts
from codonlake.plans import predict
from codonlake.plans.context import context
from codonlake.plans.oracle_base import query
from codonlake.plans import oracle_models  # noqa: F401  (registers its SQL blocks)
from codonlake.plans.suite import register, rounded, rsql
from codonlake.functions import sequence as S

ORF_COLS = ("genome_id", "contig_id", "strand", "start", "end", "genome_start", "genome_end", "length",
            "frame", "start_codon")
_O = 'genome_id, contig_id, strand, start, "end", genome_start, genome_end, length, frame, start_codon'


@register("contigs", query("""
SELECT genome_id, contig_id, tax_group, length, md5(seq) AS seq_md5,
       md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS revcomp_md5 FROM contigs""", "contigs"))
def contigs_q(spark, sf_dir):
    c = context(spark, sf_dir).contigs
    return c.select("genome_id", "contig_id", "tax_group", "length", F.md5(F.col("seq").cast("binary")).alias("seq_md5"),
                    F.md5(S.reverse_complement(F.col("seq")).cast("binary")).alias("revcomp_md5"))


@register("orf_scan", query(f"SELECT {_O} FROM orfs0", "orfs0"))
def orf_scan_q(spark, sf_dir):
    return orf.scan_orfs(context(spark, sf_dir).contigs).select(*ORF_COLS)


@register("orf_scan_short", query(f"SELECT {_O} FROM orfs_any WHERE length >= 60", "orfs_any"))
def orf_scan_short_q(spark, sf_dir):
    return orf.scan_orfs(context(spark, sf_dir).contigs, 60).select(*ORF_COLS)


@register("upstream_windows", query("SELECT genome_id, contig_id, strand, start, upstream FROM orfs0", "orfs0"))
def upstream_q(spark, sf_dir):
    return orf.scan_orfs(context(spark, sf_dir).contigs).select("genome_id", "contig_id", "strand", "start", "upstream")


@register("rbs_score", query(f"SELECT genome_id, contig_id, strand, start, {rsql('rbs_score')} FROM orfs", "orfs"))
def rbs_q(spark, sf_dir):
    scored = predict.detect(context(spark, sf_dir).contigs)
    return rounded(scored.select("genome_id", "contig_id", "strand", "start", "rbs_score"))


@register("rbs_best_site", query(f"""
SELECT genome_id, contig_id, strand, start, {rsql('rbs_score=site_score')}, motif AS rbs_motif,
       CAST(spacing AS INTEGER) AS rbs_spacing, word AS rbs_sequence, CAST(site_start AS INTEGER) AS rbs_position
FROM (SELECT *, row_number() OVER (PARTITION BY genome_id, contig_id, strand, start
                                   ORDER BY site_score DESC, site_start, site_length) AS rn FROM site_hits)
WHERE rn = 1""", "site_hits"))
def rbs_site_q(spark, sf_dir):
    orfs = context(spark, sf_dir).orfs
    return rounded(rbs.best_sites(orfs, ["genome_id", "contig_id", "strand", "start"]))


@register("rbs_words_in_use", query(
    f"SELECT word, {rsql('purine', 'motif_score')}, motif, n FROM word_scores JOIN (SELECT word, count(*) AS n FROM site_hits GROUP BY word) USING (word)",
    "word_scores site_hits"))
def site_words_q(spark, sf_dir):
    return rounded(rbs.sites_in_use(context(spark, sf_dir).orfs))


# ---- intervals -------------------------------------------------------------------------------------
@register("merge_intervals", query(
    """SELECT genome_id, contig_id, start, "end" FROM merged WHERE strategy = 'all_orfs'""", "merged"))
def merge_q(spark, sf_dir):
    o = context(spark, sf_dir).orfs.select(
        "genome_id", "contig_id", F.col("genome_start").alias("start"), F.col("genome_end").alias("end"))
    return intervals.merge_intervals(o)


@register("gaps_by_strategy", query('SELECT genome_id, contig_id, strategy, start, "end" FROM gaps', "gaps"))
def gaps_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return intervals.gaps_by_strategy(ctx.orfs, ctx.contigs)


@register("intergenic_regions", query(
    'SELECT genome_id, contig_id, start, "end", length, md5(sequence) AS seq_md5 FROM intergenic', "intergenic"))
def intergenic_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    out = intervals.with_region_sequence(intervals.intergenic_regions(ctx.orfs, ctx.contigs), ctx.contigs)
    return out.select("genome_id", "contig_id", "start", "end", "length",
                      F.md5(F.col("sequence").cast("binary")).alias("seq_md5"))


@register("training_longest_first", query(f"SELECT {_O} FROM longest_first", "longest_first"))
def longest_q(spark, sf_dir):
    return selection.longest_first(context(spark, sf_dir).orfs).select(*ORF_COLS)


@register("training_atg_first", query(f"SELECT {_O} FROM atg_first", "atg_first"))
def atg_q(spark, sf_dir):
    return selection.atg_first(context(spark, sf_dir).orfs).select(*ORF_COLS)


@register("training_set", query(f"SELECT {_O} FROM training0", "training0"))
def training_q(spark, sf_dir):
    return selection.training_set(context(spark, sf_dir).orfs).select(*ORF_COLS)


@register("training_low_entropy", query(f"SELECT {_O} FROM longest_first_calm", "longest_first_calm"))
def low_entropy_q(spark, sf_dir):
    """Longest-first choice among candidates of at most 2.9 bits (few letters of these texts give more)."""
    ctx = context(spark, sf_dir)
    return selection.longest_first(selection.low_entropy(ctx.orfs, ctx.contigs, 2.9)).select(*ORF_COLS)


# ---- models ----------------------------------------------------------------------------------------
@register("codon_model", query(
    f"SELECT genome_id, cls, codon, n, {rsql('freq', digits=9)} FROM codon_freq", "codon_freq"))
def codon_model_q(spark, sf_dir):
    return rounded(models.codon_model(context(spark, sf_dir).sequences), 9)


@register("codon_log_ratio", query(
    f"SELECT genome_id, codon, {rsql('coding', 'background', 'log_ratio')} FROM codon_ratio", "codon_ratio"))
def codon_ratio_q(spark, sf_dir):
    return rounded(models.codon_log_ratio(models.codon_model(context(spark, sf_dir).sequences)))


@register("codon_usage_extremes", query(f"""
SELECT genome_id, direction, CAST(rank AS INTEGER) AS rank, codon, {rsql('coding', 'background', 'difference')} FROM (
  SELECT *, row_number() OVER (PARTITION BY genome_id, direction ORDER BY abs(difference) DESC, codon) AS rank FROM (
    SELECT genome_id, codon, coalesce(coding, 0) AS coding, coalesce(background, 0) AS background,
           coalesce(coding, 0) - coalesce(background, 0) AS difference,
           CASE WHEN coalesce(coding, 0) > coalesce(background, 0) THEN 'enriched' ELSE 'depleted' END AS direction
    FROM codon_ratio) WHERE difference <> 0) WHERE rank <= 10""", "codon_ratio"))
def codon_extremes_q(spark, sf_dir):
    ratio = models.codon_log_ratio(models.codon_model(context(spark, sf_dir).sequences))
    return rounded(models.codon_usage_extremes(ratio))


@register("kmer_counts", query("SELECT * FROM kmer_n", "kmer_n"))
def kmer_q(spark, sf_dir):
    return models.kmer_counts(context(spark, sf_dir).sequences, 2)


@register("context_probabilities", query(f"""
SELECT genome_id, cls, pos, context, base, kmer, n, CAST(total AS BIGINT) AS total, {rsql('prob=n / CAST(total AS DOUBLE)', digits=9)} FROM (
  SELECT *, substr(kmer, 1, length(kmer) - 1) AS context, right(kmer, 1) AS base,
         sum(n) OVER (PARTITION BY genome_id, cls, pos, substr(kmer, 1, length(kmer) - 1)) AS total FROM kmer_n)
WHERE total >= 10""", "kmer_n"))
def context_q(spark, sf_dir):
    return rounded(models.context_probabilities(models.kmer_counts(context(spark, sf_dir).sequences, 2)), 9)


@register("markov_table", query(
    f"SELECT genome_id, CAST(pos AS INTEGER) AS pos, kmer, {rsql('log_ratio')} FROM backoff", "backoff"))
def markov_table_q(spark, sf_dir):
    """The words of the chosen order with their log-ratios."""
    rows = context(spark, sf_dir).models.where(F.col("pos") != models.CODON)
    each = rows.select("genome_id", "pos", "size", "context", F.posexplode("ratio").alias("base", "log_ratio"))
    code = (F.col("context") * 4 + F.col("base")).cast("string")
    kmer = F.translate(F.lpad(F.conv(code, 10, 4), F.col("size"), F.lit("0")), "0123", "ACGT")
    return rounded(each.select("genome_id", "pos", kmer.alias("kmer"), "log_ratio"))


@register("markov_order", query(
    f"SELECT genome_id, bound, markov_order, {rsql('held_out_score')} FROM chosen", "chosen"))
def markov_order_q(spark, sf_dir):
    """Order chosen per genome on held-out sequences."""
    return rounded(models.model_heads(context(spark, sf_dir).models))


@register("model_health", query(f"""
SELECT genome_id, {rsql('gc_coding', 'gc_noncoding')}, contexts_pos0, contexts_pos1, contexts_pos2,
       {rsql('max_prob_difference', 'gc_difference=gc_coding - gc_noncoding')},
       abs(gc_coding - gc_noncoding) < 0.01 AS warn_gc_close, coalesce(max_prob_difference, 0) < 0.1 AS warn_models_close
FROM (SELECT genome_id,
        sum(CASE WHEN cls = 'coding' THEN length(sequence) - length(replace(replace(sequence, 'G', ''), 'C', '')) END)
          / CAST(sum(CASE WHEN cls = 'coding' THEN length(sequence) END) AS DOUBLE) AS gc_coding,
        sum(CASE WHEN cls = 'noncoding' THEN length(sequence) - length(replace(replace(sequence, 'G', ''), 'C', '')) END)
          / CAST(sum(CASE WHEN cls = 'noncoding' THEN length(sequence) END) AS DOUBLE) AS gc_noncoding
      FROM seqs GROUP BY genome_id)
LEFT JOIN (SELECT genome_id,
    count(DISTINCT CASE WHEN pos = 0 AND pc IS NOT NULL THEN context END) AS contexts_pos0,
    count(DISTINCT CASE WHEN pos = 1 AND pc IS NOT NULL THEN context END) AS contexts_pos1,
    count(DISTINCT CASE WHEN pos = 2 AND pc IS NOT NULL THEN context END) AS contexts_pos2,
    max(abs(pc - pn)) AS max_prob_difference
  FROM (SELECT genome_id, pos, context, kmer, max(CASE WHEN cls = 'coding' THEN prob END) AS pc,
               max(CASE WHEN cls = 'noncoding' THEN prob END) AS pn
        FROM (SELECT *, n / CAST(total AS DOUBLE) AS prob FROM (
          SELECT *, substr(kmer, 1, length(kmer) - 1) AS context,
            sum(n) OVER (PARTITION BY genome_id, cls, pos, substr(kmer, 1, length(kmer) - 1)) AS total FROM kmer_n)
          WHERE total >= 10) GROUP BY ALL) GROUP BY genome_id) USING (genome_id)""", "seqs kmer_n"))
def health_q(spark, sf_dir):
    seqs = context(spark, sf_dir).sequences
    return rounded(models.model_health(seqs, models.context_probabilities(models.kmer_counts(seqs, 2))))


# ---- scores ----------------------------------------------------------------------------------------
@register("model_scores", query(
    f"SELECT genome_id, contig_id, strand, start, {rsql('codon_score', 'imm_score')} FROM raw_scores", "raw_scores"))
def model_scores_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    out = scoring.model_scores(ctx.orfs, ctx.contigs, ctx.models)
    return rounded(out.select("genome_id", "contig_id", "strand", "start", "codon_score", "imm_score"))


_N = ("codon_score", "imm_score", "rbs_score", "length_score", "start_score")


@register("scored_orfs", query(f"""SELECT genome_id, contig_id, strand, start, {rsql(*_N, *[n + '_norm' for n in _N], 'combined_score')}
FROM scored""", "scored"))
def scored_q(spark, sf_dir):
    s = context(spark, sf_dir).scored
    return rounded(s.select("genome_id", "contig_id", "strand", "start", *_N, *[n + "_norm" for n in _N],
                            "combined_score"))


@register("first_filter", query(f"SELECT {_O} FROM candidates", "candidates"))
def first_filter_q(spark, sf_dir):
    return context(spark, sf_dir).candidates.select(*ORF_COLS)


@register("best_starts", query(f"SELECT {_O}, {rsql('selection_score')} FROM best_starts", "best_starts"))
def best_starts_q(spark, sf_dir):
    return rounded(starts.best_starts(context(spark, sf_dir).candidates).select(*ORF_COLS, "selection_score"))


@register("top_two_gap", query(f"""
SELECT genome_id, contig_id, strand, "end", max(CASE WHEN start_rank = 1 THEN start END) AS start_1,
       max(CASE WHEN start_rank = 2 THEN start END) AS start_2,
       {rsql('gap=coalesce(max(CASE WHEN start_rank = 1 THEN selection_score END) - max(CASE WHEN start_rank = 2 THEN selection_score END), 999.0)')}
FROM ranked WHERE start_rank <= 2 GROUP BY ALL""", "ranked"))
def top_two_q(spark, sf_dir):
    return rounded(starts.top_two(context(spark, sf_dir).candidates).select(
        "genome_id", "contig_id", "strand", "end", "start_1", "start_2", "gap"))


@register("predict_genes", query(f"SELECT {_O}, {rsql('rbs_score', 'combined_score')} FROM predictions", "predictions"))
def predict_q(spark, sf_dir):
    return rounded(context(spark, sf_dir).predictions.select(*ORF_COLS, "rbs_score", "combined_score"))
