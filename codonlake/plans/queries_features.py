"""Queries: feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codonlake.functions import upstream as U
from codonlake import constants as C
from codonlake.operators import features, orf
from codonlake.plans.context import context
from codonlake.plans.oracle_base import block, query
from codonlake.plans.suite import register, rounded, rsql
from codonlake.session import cut_lineage

_ID = 'genome_id, contig_id, strand, start, "end"'
_IDS = ("genome_id", "contig_id", "strand", "start", "end")

block("kd", "", """
SELECT * FROM (VALUES ('A',1.8),('R',-4.5),('N',-3.5),('D',-3.5),('C',2.5),('Q',-3.5),('E',-3.5),('G',-0.4),('H',-3.2),
 ('I',4.5),('L',3.8),('K',-3.9),('M',1.9),('F',2.8),('P',-1.6),('S',-0.8),('T',-0.7),('W',-0.9),('Y',-1.3),('V',4.2)) v(letter, kd)
""")
block("cand_seq", "candidates contigs", """
SELECT * EXCLUDE (s), CASE WHEN strand = 'forward' THEN s ELSE reverse(translate(s, 'ACGT', 'TGCA')) END AS sequence
FROM (SELECT o.*, substr(c.seq, o.genome_start, o.length) AS s,
             substr(c.seq, CAST(greatest(o.genome_start - 50, 1) AS BIGINT), 26) AS box
      FROM candidates o JOIN contigs c USING (genome_id, contig_id))
""")
block("cand_codons", "cand_seq aa", f"""
SELECT c.*, coalesce(aa.letter, 'X') AS letter FROM (
  SELECT {_ID}, i, substr(sequence, CAST(i AS BIGINT) + 1, 3) AS codon
  FROM (SELECT *, unnest(range(0, length - 2, 3)) AS i FROM cand_seq)) c LEFT JOIN aa USING (codon)
""")
block("cand_usage", "cand_codons", f"""
SELECT {_ID}, sum(n) AS n_valid, count(*) AS n_distinct,
       sum(CASE WHEN right(codon, 1) IN ('G', 'C') THEN n ELSE 0 END) AS n_gc3,
       -sum(n / CAST(t AS DOUBLE) * log2(n / CAST(t AS DOUBLE) + 1e-10)) AS h
FROM (SELECT *, sum(n) OVER (PARTITION BY {_ID}) AS t FROM (
  SELECT {_ID}, codon, count(*) AS n FROM cand_codons WHERE codon NOT LIKE '%N%' GROUP BY ALL))
GROUP BY {_ID}
""")
block("cand_protein", "cand_codons kd", f"""
SELECT {_ID}, count(*) AS n_aa, avg(coalesce(kd, 0)) AS hydro_mean, stddev_pop(coalesce(kd, 0)) AS hydro_std,
  avg(CASE WHEN letter IN ('D','E','K','R') THEN 1 ELSE 0 END) AS charge,
  avg(CASE WHEN letter IN ('F','Y','W') THEN 1 ELSE 0 END) AS aromatic,
  avg(CASE WHEN letter IN ('A','G','S','T','C','V') THEN 1 ELSE 0 END) AS small,
  avg(CASE WHEN letter IN ('S','T','N','Q','Y') THEN 1 ELSE 0 END) AS polar
FROM (SELECT *, min(CASE WHEN letter = '*' THEN i END) OVER (PARTITION BY {_ID}) AS stop_at FROM cand_codons)
LEFT JOIN kd USING (letter) WHERE i < coalesce(stop_at, 1000000000) GROUP BY {_ID}
""")
block("cand_entropy", "cand_codons", f"""
SELECT {_ID}, -sum(n / CAST(t AS DOUBLE) * log2(n / CAST(t AS DOUBLE))) AS aa_h, any_value(t) AS t FROM (
  SELECT *, sum(n) OVER (PARTITION BY {_ID}) AS t FROM (
    SELECT {_ID}, letter, count(*) AS n FROM (
      SELECT *, min(CASE WHEN letter = '*' THEN i END) OVER (PARTITION BY {_ID}) AS stop_at FROM cand_codons)
    WHERE i < coalesce(stop_at, 1000000000) GROUP BY ALL)) GROUP BY {_ID}
""")
block("cand_box", "cand_seq", f"""
SELECT {_ID}, max(m) / 6.0 AS box_score FROM (
  SELECT {_ID}, list_sum([CASE WHEN substr(box, CAST(i AS BIGINT) + j, 1) = substr('TATAAT', j, 1) THEN 1 ELSE 0 END
                          for j in [1,2,3,4,5,6]]) AS m
  FROM (SELECT *, unnest(range(0, length(box) - 5)) AS i FROM cand_seq WHERE genome_start >= 51)) GROUP BY {_ID}
""")


def _n(letters: str) -> str:
    inner = "sequence"
    for c in letters:
        inner = f"replace({inner}, '{c}', '')"
    return f"CAST(length(sequence) - length({inner}) AS DOUBLE)"


_hair = ("list_sum([CASE WHEN substr(right(sequence, 30), k, 1) = substr(reverse(translate(right(sequence, 30), "
         "'ACGT', 'TGCA')), k, 1) THEN 1 ELSE 0 END for k in range(1, 31)]) / 30.0 > 0.6")
block("cand_features", "cand_seq cand_usage cand_protein cand_entropy cand_box", f"""
SELECT c.*, CAST(length AS DOUBLE) AS length_bp, length / 3.0::DOUBLE AS length_codons, ln(length) AS length_log,
 CASE start_codon WHEN 'GTG' THEN 1 WHEN 'TTG' THEN 2 ELSE 0 END AS start_codon_type,
 CASE right(sequence, 3) WHEN 'TAG' THEN 1 WHEN 'TGA' THEN 2 ELSE 0 END AS stop_codon_type,
 CASE WHEN rbs_score > 3 THEN 1 ELSE 0 END AS has_kozak_like,
 {_n('GC')} / length AS gc_content, avg({_n('GC')} / length) OVER (PARTITION BY genome_id) AS mean_gc,
 coalesce(n_gc3 / CAST(n_valid AS DOUBLE), 0) AS gc3_content,
 CASE WHEN {_n('GC')} > 0 THEN ({_n('G')} - {_n('C')}) / {_n('GC')} ELSE 0 END AS gc_skew,
 CASE WHEN {_n('AT')} > 0 THEN ({_n('A')} - {_n('T')}) / {_n('AT')} ELSE 0 END AS at_skew,
 {_n('AG')} / length AS purine_content, n_distinct / CAST(n_valid AS DOUBLE) AS effective_num_codons,
 1 - h / log2(61) AS codon_bias_index, CASE WHEN {_hair} THEN 1 ELSE 0 END AS has_hairpin_near_stop,
 coalesce(box_score, 0) AS minus10_box_score, coalesce(hydro_mean, 0) AS hydrophobicity_mean,
 CASE WHEN n_aa > 1 THEN hydro_std ELSE 0 END AS hydrophobicity_std, coalesce(charge, 0) AS charge_mean,
 coalesce(aromatic, 0) AS aromatic_fraction, coalesce(small, 0) AS small_fraction, coalesce(polar, 0) AS polar_fraction,
 CASE WHEN coalesce(t, 0) < 10 THEN 999 ELSE aa_h END AS aa_entropy
FROM cand_seq c LEFT JOIN cand_usage USING ({_ID}) LEFT JOIN cand_protein USING ({_ID})
LEFT JOIN cand_entropy USING ({_ID}) LEFT JOIN cand_box USING ({_ID})
""")
_F = [c for c in features.CANDIDATE_FEATURES if c != "gc_deviation"]


@register("candidate_features", query(
    f"SELECT {_ID}, {rsql(*_F, 'gc_deviation=gc_content - mean_gc', 'aa_entropy')} FROM cand_features", "cand_features"))
def candidate_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    f = features.candidate_features(ctx.candidates, ctx.contigs)
    return rounded(f.select(*_IDS, *features.CANDIDATE_FEATURES, "aa_entropy"))


_G = '"end", genome_id, contig_id, strand'
_rel = ("combined", "rbs", "codon", "start", "start_select")
block("group_base", "candidates", f"""
SELECT *, selection_score AS start_select_score,
 {', '.join(f"max({'selection' if c == 'start_select' else c}_score) OVER g AS top_{c}" for c in _rel)},
 sum(greatest(combined_score, 0)) OVER g AS positive, max(length) OVER g AS longest,
 row_number() OVER (PARTITION BY {_G} ORDER BY combined_score DESC) AS rk
FROM candidates WINDOW g AS (PARTITION BY {_G})
""")
block("group_features", "group_base", f"""
SELECT {_G}, count(*) AS num_orfs, max(combined_score) AS combined_max, avg(combined_score) AS combined_mean,
 CASE WHEN count(*) > 1 THEN stddev_pop(combined_score) ELSE 0 END AS combined_std,
 coalesce(-sum(CASE WHEN positive > 0 AND combined_score > 0 THEN combined_score / positive * log2(combined_score / positive) END), 0) AS combined_entropy,
 max(CASE WHEN rk = 1 THEN combined_score END) - coalesce(max(CASE WHEN rk = 2 THEN combined_score END), 0) AS combined_margin_top2,
 avg(CASE WHEN combined_score >= 0.8 * top_combined THEN 1 ELSE 0 END) AS frac_top_orfs,
 avg(CASE WHEN strand = 'forward' THEN 1 ELSE 0 END) AS strand_plus_frac, avg(CASE WHEN strand = 'reverse' THEN 1 ELSE 0 END) AS strand_minus_frac,
 CASE WHEN min(CASE WHEN combined_score = top_combined THEN start END) = min(CASE WHEN length = longest THEN start END) THEN 1 ELSE 0 END AS top_orf_is_longest,
 max(length) / CAST(greatest(min(length), 1) AS DOUBLE) AS length_ratio_max_min,
 avg(CASE WHEN combined_score >= 0.95 * top_combined THEN 1 ELSE 0 END) AS frac_top_combined,
 avg(CASE WHEN selection_score >= 0.95 * top_start_select THEN 1 ELSE 0 END) AS frac_top_start_select,
 {', '.join(f"max({c}_score) AS {c}_max, avg({c}_score) AS {c}_mean" for c in ('rbs', 'codon', 'start', 'imm', 'start_select'))},
 {', '.join(f"max(CASE WHEN top_{c} > 0 THEN {c}_score / top_{c} ELSE 0 END) AS rel_{c}_max, avg(CASE WHEN top_{c} > 0 THEN {c}_score / top_{c} ELSE 0 END) AS rel_{c}_mean" for c in _rel)}
FROM group_base GROUP BY {_G}
""")


@register("group_features", query(
    f"SELECT {_G}, {rsql(*features.GROUP_FEATURES)} FROM group_features", "group_features"))
def group_q(spark, sf_dir):
    g = features.group_features(context(spark, sf_dir).candidates)
    keys = ("genome_id", "contig_id", "strand", "end")
    return rounded(g.select(*keys, *[F.col(c).cast("double").alias(c) for c in features.GROUP_FEATURES]))


block("singles", "candidates contigs", f"""
SELECT s.*, CASE WHEN strand = 'forward'
  THEN substr(c.seq, CAST(greatest(genome_start - 20, 1) AS BIGINT), CAST(genome_start - greatest(genome_start - 20, 1) AS BIGINT))
  ELSE reverse(translate(substr(c.seq, genome_end + 1, 20), 'ACGT', 'TGCA')) END AS up
FROM (SELECT *, count(*) OVER (PARTITION BY {_G}) AS n_starts FROM candidates) s JOIN contigs c USING (genome_id, contig_id)
WHERE n_starts = 1
""")
block("pwm", "singles", """
SELECT genome_id, CAST(pos AS INTEGER) AS pos, base, n, ln(n / CAST(sum(n) OVER (PARTITION BY genome_id, pos) AS DOUBLE) / 0.25) AS logodds
FROM (SELECT e.genome_id, p.pos, b.base, 1 + count(CASE WHEN substr(s.up, CAST(p.pos AS BIGINT) + 1, 1) = b.base THEN 1 END) AS n
      FROM (SELECT genome_id FROM singles WHERE length(up) >= 20 GROUP BY genome_id HAVING count(*) >= 50) e
      JOIN singles s ON s.genome_id = e.genome_id AND length(s.up) >= 20, range(20) p(pos),
      (VALUES ('A'), ('C'), ('G'), ('T')) b(base) GROUP BY ALL)
""")


@register("site_weight_matrix", query(
    f"SELECT genome_id, pos, base, n, {rsql('logodds')} FROM pwm", "pwm"))
def pwm_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    single = orf.with_upstream(features.singletons(ctx.candidates), ctx.contigs, 20, "window")
    return rounded(features.weight_matrix(single.select("genome_id", "window"), 20))


@register("length_prior", query(f"""
SELECT genome_id, coalesce(n_single, 0) AS n_single, {rsql('len_mean=CASE WHEN n_single >= 10 THEN m ELSE 800 END',
 'len_std=CASE WHEN n_single >= 10 THEN s ELSE 400 END')}
FROM (SELECT DISTINCT genome_id FROM candidates) LEFT JOIN
 (SELECT genome_id, count(*) AS n_single, avg(length) AS m, stddev_pop(length) AS s FROM singles GROUP BY genome_id)
USING (genome_id)""", "candidates singles"))
def prior_q(spark, sf_dir):
    return rounded(features.length_prior(context(spark, sf_dir).candidates))


block("up300", "orfs contigs", """
SELECT o.genome_id, o.contig_id, o.strand, o.start, o."end", right(u, 25) AS up, u AS region FROM (
 SELECT o.*, CASE WHEN strand = 'forward'
  THEN substr(c.seq, CAST(greatest(genome_start - 300, 1) AS BIGINT), CAST(genome_start - greatest(genome_start - 300, 1) AS BIGINT))
  ELSE reverse(translate(substr(c.seq, genome_end + 1, 300), 'ACGT', 'TGCA')) END AS u
 FROM orfs o JOIN contigs c USING (genome_id, contig_id)) o
""")
_sp = ", ".join(
    f"CASE WHEN strpos(reverse(up), '{m[::-1]}') BETWEEN 5 AND 13 THEN {len(m)} / 7.0::DOUBLE ELSE 0 END"
    for m in ("AAGGAGG", "AAGGAG", "AGGAG", "GGAGG", "GAGG", "AAGG", "AGGA"))
_st = ", ".join(f"CASE WHEN strpos(reverse(region), '{s[::-1]}') > 0 THEN strpos(reverse(region), '{s[::-1]}') + 2 ELSE length(region) END"
                for s in ("TAA", "TAG", "TGA"))
_gcp = {p: f"list_avg([CASE WHEN substr(up, 3 * k + {p}, 1) IN ('G', 'C') THEN 1 ELSE 0 END for k in range(0, length(up) // 3)])"
        for p in (1, 2, 3)}
_anti = "".join(f" + CASE substr(up, CAST(i AS BIGINT) + {p}, 1) WHEN '{pair}' THEN 1.0 " +
                (f"WHEN '{wob}' THEN 0.5 " if wob else "") + "ELSE 0 END"
                for p, (pair, wob) in enumerate(
                    {"A": ("T", None), "U": ("A", "G"), "G": ("C", "T"), "C": ("G", None)}[b] for b in C.ANTI_SD[::-1]))


@register("upstream_features", query(f"""
SELECT genome_id, contig_id, strand, start, "end", {rsql(f'spacer=greatest({_sp})',
  f'gc_bias=CASE WHEN length(up) < 9 THEN 0 ELSE abs({_gcp[3]} - ({_gcp[1]} + {_gcp[2]}) / 2) END', 'anti_sd=coalesce(pairing, 0)')},
  least({_st}) AS any_stop
FROM up300 LEFT JOIN (SELECT genome_id, contig_id, strand, start, max(CAST(0{_anti} AS DOUBLE)) / 13 AS pairing
  FROM (SELECT *, unnest(range(CAST(greatest(1, length(up) - 26) AS BIGINT), length(up) - 15)) AS i FROM up300) GROUP BY ALL)
USING (genome_id, contig_id, strand, start)""", "up300"))
def upstream_features_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    rows = orf.with_upstream(ctx.orfs, ctx.contigs, 300, "region").withColumn("up", F.right("region", F.lit(25)))
    return rounded(rows.select(*_IDS, U.spacer_score(F.col("up")).alias("spacer"),
                               U.gc_position_bias(F.col("up")).alias("gc_bias"),
                               U.anti_sd_pairing(F.col("up")).alias("anti_sd"),
                               U.stop_distance(F.col("region")).cast("long").alias("any_stop")))


# ---- contested pairs in SQL: group context, then the two contestants, then their differences ----
block("ctx_pwm", "singles", """
SELECT genome_id, CAST(pos AS INTEGER) AS pos, base, ln(n / CAST(sum(n) OVER (PARTITION BY genome_id, pos) AS DOUBLE) / 0.25) AS logodds
FROM (SELECT e.genome_id, p.pos, b.base, 1 + count(CASE WHEN substr(s.w, CAST(p.pos AS BIGINT) + 1, 1) = b.base THEN 1 END) AS n
      FROM (SELECT genome_id FROM singles WHERE length(up) >= 11 GROUP BY genome_id HAVING count(*) >= 50) e
      JOIN (SELECT genome_id, right(up, 11) || left(start_codon, 2) AS w FROM singles WHERE length(up) >= 11) s USING (genome_id), range(13) p(pos),
      (VALUES ('A'), ('C'), ('G'), ('T')) b(base) GROUP BY ALL)
""")
block("len_prior", "candidates singles", """
SELECT genome_id, CASE WHEN n_single >= 10 THEN m ELSE 800 END AS len_mean, CASE WHEN n_single >= 10 THEN s ELSE 400 END AS len_std
FROM (SELECT DISTINCT genome_id FROM candidates) LEFT JOIN
 (SELECT genome_id, count(*) AS n_single, avg(length) AS m, stddev_pop(length) AS s FROM singles GROUP BY genome_id) USING (genome_id)
""")
block("gc_share", "contigs", """
SELECT genome_id, sum(length - length(replace(replace(seq, 'G', ''), 'C', ''))) / CAST(greatest(sum(length), 1) AS DOUBLE) AS gc_pct FROM contigs GROUP BY genome_id
""")
block("pair_group", "ranked", f"""
SELECT {_G}, any_value(s1) - max(CASE WHEN start_rank = 2 THEN selection_score END) AS gap, max(selection_score) - min(selection_score) AS score_range,
 count(*) FILTER (WHERE selection_score >= s1 - 0.5) - 1 AS n_near_ties, count(*) AS n_orfs,
 count(*) FILTER (WHERE length < l1) / CAST(greatest(count(*) - 1, 1) AS DOUBLE) AS top1_len_rank,
 stddev_pop(length) / greatest(avg(length), 1) AS group_len_cv, count(*) FILTER (WHERE length > l1) / CAST(count(*) AS DOUBLE) AS frac_longer,
 avg(rbs_score_norm) AS grp_rbs_mean, max(rbs_score_norm) - min(rbs_score_norm) AS grp_rbs_range, avg(CASE WHEN start_codon = 'ATG' THEN 1 ELSE 0 END) AS frac_atg,
 count(*) FILTER (WHERE rbs_score_norm < r1) / CAST(greatest(count(*) - 1, 1) AS DOUBLE) AS top1_rbs_rank,
 max(length) - min(length) AS span_length, max(codon_score_norm) - min(codon_score_norm) AS span_codon, max(imm_score_norm) - min(imm_score_norm) AS span_imm
FROM (SELECT *, max(CASE WHEN start_rank = 1 THEN selection_score END) OVER g AS s1, max(CASE WHEN start_rank = 1 THEN length END) OVER g AS l1,
       max(CASE WHEN start_rank = 1 THEN rbs_score_norm END) OVER g AS r1 FROM ranked WINDOW g AS (PARTITION BY {_G}))
GROUP BY {_G} HAVING count(*) >= 2 AND any_value(s1) - max(CASE WHEN start_rank = 2 THEN selection_score END) < {C.CONTEST_GAP}
""")
block("pair_starts", "ranked pair_group up300 contigs", f"""
SELECT r.*, u.up, u.region, CASE WHEN strand = 'forward' THEN substr(c.seq, r.genome_start, 18)
  ELSE reverse(translate(substr(c.seq, CAST(greatest(r.genome_end - 17, 1) AS BIGINT), CAST(r.genome_end - greatest(r.genome_end - 17, 1) + 1 AS BIGINT)), 'ACGT', 'TGCA')) END AS head
FROM ranked r JOIN (SELECT {_G} FROM pair_group) USING ({_G}) JOIN up300 u USING (genome_id, contig_id, strand, "end", start) JOIN contigs c USING (genome_id, contig_id)
WHERE start_rank <= 2
""")
_S = 'genome_id, contig_id, strand, "end", start'


def _pwm(table: str, text: str, size: int, least: int) -> str:
    return f"""SELECT {_S}, sum(w.logodds) AS v FROM (SELECT {_S}, p.pos, substr(right({text}, {size}), CAST(p.pos AS BIGINT) + 1, 1) AS base
  FROM pair_starts, range({size}) p(pos) WHERE length(up) >= {least}) s JOIN {table} w USING (genome_id, pos, base) GROUP BY {_S}"""


def _codon_avg(text: str, rows: str) -> str:
    return f"""SELECT {_S}, avg(coalesce(r.log_ratio, 0)) AS v FROM (SELECT {_S}, substr({text}, CAST(k AS BIGINT) * 3 + 1, 3) AS codon
  FROM (SELECT *, unnest(range(0, length({text}) // 3)) AS k FROM {rows})) LEFT JOIN codon_ratio r USING (genome_id, codon) WHERE codon NOT LIKE '%N%' GROUP BY {_S}"""


_gcs = [f"{_gcp[p]}" for p in (1, 2, 3)]
_nterm = {"nterm_charged_pos": "KRH", "nterm_charged_neg": "DE", "nterm_polar": "STNQ", "nterm_hydrophobic": "ACGILMFPWVY"}
block("pair_sides", "pair_starts pwm ctx_pwm len_prior gc_share codon_ratio backoff chosen aa", f"""
SELECT s.*, {f'greatest({_sp})'} AS f4, CASE WHEN length(up) < 9 THEN 0 ELSE abs({_gcs[2]} - ({_gcs[0]} + {_gcs[1]}) / 2) END AS f5,
 CASE WHEN length(up) < 9 THEN 0 ELSE coalesce(i.v, 0) / length(up) END AS up_imm, coalesce(w.v, 0) AS site_pwm, coalesce(a.v, 0) AS anti_sd, least({_st}) AS any_stop,
 (length - len_mean) / greatest(len_std, 1) AS len_zscore, coalesce(h.v, 0) AS post_start, coalesce(x.v, 0) AS ctx_pwm, gc_pct,
 CASE WHEN length(up) < 9 OR ({_gcs[0]} + {_gcs[1]} + {_gcs[2]}) / 3 < 0.01 THEN 0 ELSE
  list_stddev_pop([{', '.join(_gcs)}]) / (({_gcs[0]} + {_gcs[1]} + {_gcs[2]}) / 3) END AS gc3_period,
 {', '.join(f"coalesce(n.{k}, 0) AS {k}" for k in _nterm)}
FROM pair_starts s JOIN len_prior USING (genome_id) JOIN gc_share USING (genome_id)
LEFT JOIN ({_pwm('pwm', 'up', 20, 20)}) w USING ({_S})
LEFT JOIN ({_pwm('ctx_pwm', "(right(up, 11) || left(start_codon, 2))", 13, 11)}) x USING ({_S})
LEFT JOIN (SELECT {_S}, max(CAST(0{_anti} AS DOUBLE)) / 13 AS v FROM (SELECT *, unnest(range(CAST(greatest(1, length(up) - 26) AS BIGINT), length(up) - 15)) AS i FROM pair_starts) GROUP BY ALL) a USING ({_S})
LEFT JOIN ({_codon_avg('substr(head, 4, 15)', 'pair_starts')}) h USING ({_S})
LEFT JOIN (SELECT {_S}, sum(b.log_ratio) AS v FROM (SELECT {_S}, CAST(i % 3 AS INTEGER) AS pos,
    substr(up, CAST(greatest(i - markov_order, 0) + 1 AS BIGINT), CAST(least(i, markov_order) + 1 AS BIGINT)) AS kmer
   FROM (SELECT s.*, markov_order, unnest(range(0, length(up))) AS i FROM pair_starts s JOIN chosen USING (genome_id))) k JOIN backoff b USING (genome_id, pos, kmer) GROUP BY {_S}) i USING ({_S})
LEFT JOIN (SELECT {_S}, {', '.join(f"count(*) FILTER (WHERE strpos('{letters}', letter) > 0) / CAST(count(*) AS DOUBLE) AS {k}" for k, letters in _nterm.items())}
   FROM (SELECT {_S}, coalesce(aa.letter, 'X') AS letter FROM (SELECT {_S}, substr(head, CAST(k AS BIGINT) * 3 + 1, 3) AS codon
     FROM (SELECT *, unnest(range(0, least(5, length(head) // 3))) AS k FROM pair_starts)) LEFT JOIN aa USING (codon)) WHERE letter <> '*' GROUP BY {_S}) n USING ({_S})
""")
block("pair_between", "pair_sides contigs codon_ratio", f"""
SELECT t.*, b.v FROM (SELECT DISTINCT {_G} FROM pair_sides) t LEFT JOIN (
 SELECT {_G}, avg(coalesce(r.log_ratio, 0)) AS v FROM (SELECT {_G}, substr(ext, CAST(k AS BIGINT) * 3 + 1, 3) AS codon FROM (SELECT *, unnest(range(0, length(ext) // 3)) AS k FROM (
  SELECT {_G}, CASE WHEN strand = 'forward' THEN substr(c.seq, lo, hi - lo) ELSE reverse(translate(substr(c.seq, clen - hi + 2, hi - lo), 'ACGT', 'TGCA')) END AS ext
  FROM (SELECT {_G}, min(start) AS lo, max(start) AS hi, any_value(contig_length) AS clen FROM pair_sides GROUP BY {_G}) JOIN contigs c USING (genome_id, contig_id))))
 LEFT JOIN codon_ratio r USING (genome_id, codon) WHERE codon NOT LIKE '%N%' GROUP BY {_G}) b USING ({_G})
""")
_sides = ("start", "start_codon", "length", "rbs_score_norm", "start_score_norm", "codon_score_norm", "imm_score_norm", "f4", "f5", "up_imm", "site_pwm",
          "anti_sd", "any_stop", "len_zscore", "post_start", "ctx_pwm", "gc3_period", *features.NTERM)
block("pairs", "pair_sides pair_between pair_group", f"""
SELECT * FROM (SELECT {_G}, any_value(gc_pct) AS gc_pct, {', '.join(f"max(CASE WHEN start_rank = {r} THEN {c} END) AS {c}_{r}" for c in _sides for r in (1, 2))}
FROM pair_sides GROUP BY {_G}) JOIN pair_group USING ({_G}) JOIN (SELECT {_G}, coalesce(v, 0) AS ext_codon FROM pair_between) USING ({_G})
""")
_delta = {"d_baseline": "gap", **{f"d_{k}": f"{c}_1 - {c}_2" for k, c in {
    "rbs": "rbs_score_norm", "start": "start_score_norm", "codon": "codon_score_norm", "imm": "imm_score_norm", "length": "length", "f4": "f4", "f5": "f5",
    "up_imm": "up_imm", "genome_rbs": "site_pwm", "anti_sd": "anti_sd", "any_stop_dist": "any_stop", "len_zscore": "len_zscore", "post_start": "post_start",
    "ctx_pwm": "ctx_pwm", "gc3_period": "gc3_period", **{k: k for k in features.NTERM}}.items()},
    **{f"{k}_top{r}": f"{k}_{r}" for k in ("anti_sd", "any_stop", "len_zscore", "post_start", "ctx_pwm") for r in (1, 2)},
    **{f"t1_{k}": f"{k}_1" for k in features.NTERM}, "gc3_period_t1": "gc3_period_1", "gc3_period_t2": "gc3_period_2",
    "rel_gap": "gap / greatest(score_range, 1e-9)", "both_atg": "CASE WHEN start_codon_1 = 'ATG' AND start_codon_2 = 'ATG' THEN 1 ELSE 0 END",
    "d_length_norm": "(length_1 - length_2) / CAST(greatest(span_length, 1) AS DOUBLE)", "d_codon_norm": "(codon_score_norm_1 - codon_score_norm_2) / greatest(span_codon, 1e-9)",
    "d_imm_norm": "(imm_score_norm_1 - imm_score_norm_2) / greatest(span_imm, 1e-9)"}
_PAIR = features.pair_columns(tuple(features.OPTIONAL_PAIR_FEATURES))


@register("pair_features", query(f"""
SELECT {_G}, start_1, start_2, {rsql(*[f'{c}={_delta[c]}' if c in _delta else c for c in _PAIR])} FROM pairs""", "pairs"))
def pair_q(spark, sf_dir):
    """All columns of the contested pairs, the optional ones too."""
    ctx = context(spark, sf_dir)
    sc = cut_lineage(features.start_context(ctx.candidates, ctx.contigs))
    rows = features.pair_features(ctx.candidates, ctx.contigs, ctx.models, sc)
    return rounded(rows.select("genome_id", "contig_id", "strand", "end", "start_1", "start_2", *[F.col(c).cast("double").alias(c) for c in _PAIR]))
