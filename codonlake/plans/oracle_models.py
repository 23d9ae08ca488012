"""SQL blocks for models of the chosen order, scores, filters and start choice."""

from __future__ import annotations

from codonlake.plans.oracle_base import block

block("seqs", "training intergenic", """
SELECT genome_id, 'coding' AS cls, sequence FROM training
UNION ALL SELECT genome_id, 'noncoding', sequence FROM intergenic
""")
block("codon_n", "seqs", """
SELECT genome_id, cls, codon, count(*) AS n FROM (
  SELECT genome_id, cls, substr(sequence, CAST(i AS BIGINT) + 1, 3) AS codon
  FROM (SELECT *, unnest(range(0, length(sequence) - 2, 3)) AS i FROM seqs))
WHERE codon NOT LIKE '%N%' GROUP BY ALL
""")
block("codon_freq", "codon_n", """
SELECT *, n / CAST(sum(n) OVER (PARTITION BY genome_id, cls) AS DOUBLE) AS freq FROM codon_n
""")
block("codon_ratio", "codon_freq", """
SELECT genome_id, codon, max(CASE WHEN cls = 'coding' THEN freq END) AS coding,
       max(CASE WHEN cls = 'noncoding' THEN freq END) AS background,
       ln(coalesce(max(CASE WHEN cls = 'coding' THEN freq END), 0.0001))
       - ln(coalesce(max(CASE WHEN cls = 'noncoding' THEN freq END), 0.0001)) AS log_ratio
FROM codon_freq GROUP BY genome_id, codon
""")
block("kmer_n", "seqs", """
SELECT genome_id, cls, CAST(i % 3 AS INTEGER) AS pos, kmer, count(*) AS n FROM (
  SELECT genome_id, cls, i, substr(sequence, CAST(i - k + 2 AS BIGINT), k) AS kmer
  FROM (SELECT *, unnest(range(0, length(sequence))) AS i FROM seqs), (VALUES (1), (2), (3)) v(k)
  WHERE i - k + 1 >= 0)
WHERE regexp_full_match(kmer, '[ACGT]+') GROUP BY ALL
""")
# ---- chosen order: the first fifth of each class is held out, the order with the best held-out score wins ----
#: Longest words that the SQL knows; enough for the order bounds of the small data sets (5 at most).
WORDS = 6
block("marked", "training intergenic", """
SELECT genome_id, cls, sequence, seq_no <= greatest(1, floor(n_cls * 0.2::DOUBLE)) AS held FROM (
  SELECT *, row_number() OVER (PARTITION BY genome_id, cls ORDER BY contig_id, o1, o2, o3, o4) AS seq_no,
         count(*) OVER (PARTITION BY genome_id, cls) AS n_cls FROM (
    SELECT genome_id, 'coding' AS cls, contig_id, CASE WHEN strand = 'forward' THEN 0 ELSE 1 END AS o1, CAST(frame AS BIGINT) AS o2,
           "end" AS o3, start AS o4, sequence FROM training
    UNION ALL SELECT genome_id, 'noncoding', contig_id, 0, 0, start, "end", sequence FROM intergenic))
""")
block("class_sizes", "marked", """
SELECT *, CASE WHEN least(bp_coding, bp_noncoding) < 10 THEN 0 ELSE
  greatest(2, least(10, CAST(floor(ln(least(bp_coding, bp_noncoding) / 10.0::DOUBLE) / ln(4.0::DOUBLE)) AS INTEGER))) END AS bound
FROM (SELECT genome_id, count(*) FILTER (cls = 'coding') AS n_coding, count(*) FILTER (cls = 'noncoding') AS n_noncoding,
        coalesce(sum(length(sequence)) FILTER (cls = 'coding'), 0) AS bp_coding,
        coalesce(sum(length(sequence)) FILTER (cls = 'noncoding'), 0) AS bp_noncoding FROM marked GROUP BY genome_id)
""")
block("held_word_n", "marked", f"""
SELECT genome_id, cls, held, CAST(i % 3 AS INTEGER) AS pos, kmer, count(*) AS n FROM (
  SELECT genome_id, cls, held, i, substr(sequence, CAST(i - k + 2 AS BIGINT), CAST(k AS BIGINT)) AS kmer
  FROM (SELECT *, unnest(range(0, length(sequence))) AS i FROM marked), range(1, {WORDS + 1}) v(k) WHERE i - k + 1 >= 0)
WHERE regexp_full_match(kmer, '[ACGT]+') GROUP BY ALL
""")
block("word_n", "held_word_n", """
SELECT 'fit' AS part, genome_id, cls, pos, kmer, n FROM held_word_n WHERE NOT held
UNION ALL SELECT 'all', genome_id, cls, pos, kmer, CAST(sum(n) AS BIGINT) FROM held_word_n GROUP BY ALL
""")
block("slots", "marked", """
SELECT part, genome_id, cls, pos FROM (SELECT DISTINCT genome_id FROM marked), (VALUES ('fit'), ('all')) t(part),
  (VALUES ('coding'), ('noncoding')) c(cls), (VALUES (0), (1), (2)) p(pos)
""")
block("bases", "", "SELECT * FROM (VALUES ('A'), ('C'), ('G'), ('T')) v(b)")
for k in range(1, WORDS + 1):
    prev = f"lv{k - 1}" if k > 1 else ""
    source = (
        "SELECT s.*, b AS kmer, CAST(0.25 AS DOUBLE) AS back FROM slots s, bases" if k == 1 else
        f"SELECT s.part, s.genome_id, s.cls, s.pos, a.b || s.kmer AS kmer, s.p AS back FROM {prev} s, bases a"
    )
    block(f"lv{k}", f"slots bases word_n {prev}", f"""
SELECT part, genome_id, cls, pos, kmer, CASE WHEN total >= 10 AND n > 0 THEN n / CAST(total AS DOUBLE) ELSE back END AS p
FROM (SELECT f.part, f.genome_id, f.cls, f.pos, f.kmer, f.back, coalesce(n.n, 0) AS n,
        sum(coalesce(n.n, 0)) OVER (PARTITION BY f.part, f.genome_id, f.cls, f.pos, substr(f.kmer, 1, {k - 1})) AS total
      FROM ({source}) f LEFT JOIN word_n n USING (part, genome_id, cls, pos, kmer))
""")
_LEVELS = [f"lv{k}" for k in range(1, WORDS + 1)]
block("ratios", " ".join(_LEVELS), f"""
SELECT part, genome_id, pos, kmer, max(CASE WHEN cls = 'coding' THEN l END) - max(CASE WHEN cls = 'noncoding' THEN l END) AS log_ratio
FROM (SELECT *, ln(greatest(p, 1e-10)) AS l FROM ({" UNION ALL ".join("SELECT * FROM " + x for x in _LEVELS)}))
GROUP BY part, genome_id, pos, kmer
""")
block("order_scores", "marked class_sizes ratios", """
SELECT o.genome_id, o.k, sum(coalesce(r.log_ratio, 0) / o.len) AS score
FROM (SELECT m.genome_id, k, length(sequence) AS len, CAST(i % 3 AS INTEGER) AS pos,
        substr(sequence, CAST(greatest(i - k, 0) + 1 AS BIGINT), CAST(least(i, k) + 1 AS BIGINT)) AS kmer
      FROM (SELECT *, unnest(range(0, length(sequence))) AS i FROM marked WHERE cls = 'coding' AND held AND length(sequence) >= 3) m
      JOIN class_sizes s USING (genome_id), range(2, 11) v(k) WHERE k <= s.bound) o
LEFT JOIN ratios r ON r.part = 'fit' AND r.genome_id = o.genome_id AND r.pos = o.pos AND r.kmer = o.kmer
GROUP BY o.genome_id, o.k
""")
block("chosen", "class_sizes order_scores", """
SELECT s.genome_id, s.bound, CAST(CASE WHEN s.bound < 2 OR n_coding < 5 OR n_noncoding < 5 THEN s.bound ELSE coalesce(b.k, 2) END AS INTEGER) AS markov_order,
  CASE WHEN s.bound < 2 OR n_coding < 5 OR n_noncoding < 5 THEN NULL ELSE b.score / greatest(1, floor(n_coding * 0.2::DOUBLE)) END AS held_out_score
FROM class_sizes s LEFT JOIN (SELECT genome_id, first(k ORDER BY round(score, 9) DESC, k) AS k, max(score) AS score FROM order_scores GROUP BY genome_id) b USING (genome_id)
""")
block("backoff", "ratios chosen", """
SELECT r.genome_id, pos, kmer, log_ratio FROM ratios r JOIN chosen c USING (genome_id) WHERE part = 'all' AND length(kmer) <= markov_order + 1
""")
block("orf_seq", "orfs contigs", """
SELECT * EXCLUDE (s), CASE WHEN strand = 'forward' THEN s ELSE reverse(translate(s, 'ACGT', 'TGCA')) END AS sequence
FROM (SELECT o.*, substr(c.seq, o.genome_start, o.length) AS s FROM orfs o JOIN contigs c USING (genome_id, contig_id))
""")
block("imm", "orf_seq backoff chosen", """
SELECT o.genome_id, o.contig_id, o.strand, o.start, sum(b.log_ratio) / any_value(o.length) AS imm_score
FROM (SELECT genome_id, contig_id, strand, start, length, CAST(i % 3 AS INTEGER) AS pos,
        substr(sequence, CAST(greatest(i - markov_order, 0) + 1 AS BIGINT), CAST(least(i, markov_order) + 1 AS BIGINT)) AS kmer
      FROM (SELECT o.*, c.markov_order, unnest(range(0, o.length)) AS i FROM orf_seq o JOIN chosen c USING (genome_id))) o
LEFT JOIN backoff b ON b.genome_id = o.genome_id AND b.pos = o.pos AND b.kmer = o.kmer
GROUP BY ALL
""")
block("usage", "orf_seq codon_ratio", """
SELECT o.genome_id, o.contig_id, o.strand, o.start, avg(coalesce(r.log_ratio, 0)) AS codon_score
FROM (SELECT genome_id, contig_id, strand, start, substr(sequence, CAST(i AS BIGINT) + 1, 3) AS codon
      FROM (SELECT *, unnest(range(0, length - 2, 3)) AS i FROM orf_seq)) o
LEFT JOIN codon_ratio r ON r.genome_id = o.genome_id AND r.codon = o.codon
WHERE o.codon NOT LIKE '%N%' GROUP BY ALL
""")
block("raw_scores", "orfs imm usage", """
SELECT o.*, coalesce(u.codon_score, 0) AS codon_score, coalesce(i.imm_score, 0) AS imm_score,
       ln(greatest(o.length, 100) / 300.0::DOUBLE) AS length_score,
       CAST(CASE o.start_codon WHEN 'ATG' THEN 1.0 WHEN 'GTG' THEN 0.7 ELSE 0.4 END AS DOUBLE) AS start_score
FROM orfs o LEFT JOIN usage u USING (genome_id, contig_id, strand, start)
LEFT JOIN imm i USING (genome_id, contig_id, strand, start)
""")
_C = ("codon", "imm", "rbs", "length", "start")
block("score_stats", "raw_scores", "SELECT genome_id, " + ", ".join(
    f"avg({c}_score) AS {c}_mean, CASE WHEN max({c}_score) > min({c}_score) THEN stddev_pop({c}_score) ELSE 0 END AS {c}_std"
    for c in _C) + " FROM raw_scores GROUP BY genome_id")
block("scored", "raw_scores score_stats", "SELECT *, " + " + ".join(
    f"{c}_score_norm * {w}" for c, w in zip(_C, (1.0,) * 5)) + " AS combined_score, " + " + ".join(
    f"{c}_score_norm * {w}::DOUBLE" for c, w in zip(_C, (4.8562, 1.0107, 0.6383, 7.4367, 0.2755)))
    + " AS selection_score FROM (SELECT r.*, " + ", ".join(
    f"CASE WHEN {c}_std > 0 THEN ({c}_score - {c}_mean) / {c}_std ELSE 0 END AS {c}_score_norm" for c in _C)
    + " FROM raw_scores r JOIN score_stats USING (genome_id))")


def keep(codon: float, imm: float, length: float, combined: float) -> str:
    return (f"NOT ((length_score < {length}::DOUBLE AND codon_score < {codon}::DOUBLE AND imm_score < {imm}::DOUBLE)"
            f" OR combined_score < {combined}::DOUBLE)")


FIRST = keep(0.2665, 0.2308, -0.2812, 0.2643)
SECOND = keep(0.0872, 0.3157, 0.2762, 0.4669)
block("candidates", "scored", f"SELECT * FROM scored WHERE {FIRST}")
block("ranked", "candidates", """
SELECT *, row_number() OVER (PARTITION BY genome_id, contig_id, strand, "end" ORDER BY selection_score DESC, start) AS start_rank
FROM candidates
""")
block("best_starts", "ranked", "SELECT * FROM ranked WHERE start_rank = 1")
block("predictions", "best_starts", f"SELECT * FROM best_starts WHERE {SECOND}")
block("reference", "orfs_any", """
SELECT genome_id, contig_id, strand, "end", arg_min(genome_start, start) AS genome_start,
       arg_min(genome_end, start) AS genome_end, max(length) AS length
FROM orfs_any WHERE length >= 75 AND start_codon = 'ATG' GROUP BY ALL
""")
