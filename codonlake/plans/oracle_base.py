"""SQL building blocks for checking: every block is one CTE and names the blocks it needs."""

from __future__ import annotations

from codonlake.sources.adapters import BASES, LETTERS

CTE: dict[str, tuple[str, str]] = {}
PARTS: dict[str, tuple[list[str], str]] = {}  # whole query -> its blocks in order, its final SELECT


def block(name: str, needs: str, sql: str) -> None:
    CTE[name] = (needs, sql)


def query(final: str, needs: str) -> str:
    """WITH all needed blocks, in dependency order, then the final SELECT."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for n in CTE[name][0].split():
            visit(n)
        order.append(name)

    for n in needs.split():
        visit(n)
    parts = [f"{n} AS MATERIALIZED (\n{CTE[n][1].strip()}\n)" for n in order]
    text = ("WITH " + ",\n".join(parts) + "\n" if order else "") + final.strip()
    PARTS[text] = (order, final.strip())
    return text


def run_shared(con, text: str):
    """Run a query with its blocks kept as tables of the connection, so that queries share them; other SQL runs as it is."""
    if text not in PARTS:
        return con.execute(text)
    order, final = PARTS[text]
    for name in order:
        con.execute(f"CREATE TABLE IF NOT EXISTS blk_{name} AS " + _over_tables(CTE[name][1], order))
    return con.execute(_over_tables(final, order))


def _over_tables(sql: str, names: list[str]) -> str:
    aliases = ", ".join(f"{n} AS (SELECT * FROM blk_{n})" for n in names if f"{n}" in sql)
    return (f"WITH {aliases} " if aliases else "") + sql.strip()


block("contigs", "", f"""
SELECT source AS genome_id, CAST(doc_id AS VARCHAR) AS contig_id, 'group' || (('0x' || substr(md5(source), 1, 8))::BIGINT % 4) AS tax_group,
       seq, length(seq) AS length
FROM (SELECT source, doc_id,
             translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS seq
      FROM documents)
""")
block("strands", "contigs", """
SELECT genome_id, contig_id, length, 'forward' AS strand, seq FROM contigs
UNION ALL
SELECT genome_id, contig_id, length, 'reverse', reverse(translate(seq, 'ACGT', 'TGCA')) FROM contigs
""")
# tiles keep substr() cheap: it walks from the start of its string
block("tiles", "strands", """
SELECT genome_id, contig_id, strand, length, tile,
       substr(seq, CAST(greatest(tile - 19, 0) + 1 AS BIGINT), 600) AS piece, greatest(tile - 19, 0) AS piece_at
FROM (SELECT *, unnest(range(0, length - 2, 500)) AS tile FROM strands WHERE length >= 3)
""")
block("marks", "tiles", """
SELECT genome_id, contig_id, strand, length AS contig_length, pos, codon,
       CASE WHEN codon IN ('ATG','GTG','TTG') THEN
         substr(piece, greatest(pos - 19, 0) - piece_at + 1, pos + 1 - greatest(pos - 19, 0)) END AS upstream
FROM (SELECT *, substr(piece, pos - piece_at + 1, 3) AS codon
      FROM (SELECT *, unnest(range(tile, least(tile + 500, length - 2))) AS pos FROM tiles))
WHERE codon IN ('ATG','GTG','TTG','TAA','TAG','TGA')
""")
block("orfs_any", "marks", """
SELECT genome_id, contig_id, strand, stop + 3 AS "end", pos + 1 AS start,
       CASE WHEN strand = 'forward' THEN pos + 1 ELSE contig_length - stop - 2 END AS genome_start,
       CASE WHEN strand = 'forward' THEN stop + 3 ELSE contig_length - pos END AS genome_end,
       stop + 3 - pos AS length, CAST(pos % 3 AS INTEGER) AS frame, codon AS start_codon, upstream,
       contig_length
FROM (SELECT *, min(CASE WHEN codon IN ('TAA','TAG','TGA') THEN pos END) OVER (
             PARTITION BY genome_id, contig_id, strand, pos % 3 ORDER BY pos
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM marks)
WHERE codon IN ('ATG','GTG','TTG') AND stop IS NOT NULL
""")
block("orfs0", "orfs_any", "SELECT * FROM orfs_any WHERE length >= 100")
block("words", "", """
SELECT w AS word, length(replace(replace(w, 'C', ''), 'T', '')) / CAST(length(w) AS DOUBLE) AS purine FROM (
  WITH RECURSIVE g(w) AS (SELECT '' UNION ALL
    SELECT w || b FROM g, (VALUES ('A'),('C'),('G'),('T')) v(b) WHERE length(w) < 8)
  SELECT w FROM g WHERE length(w) >= 4)
WHERE length(replace(replace(w, 'C', ''), 'T', '')) / CAST(length(w) AS DOUBLE) >= 0.6
""")
block("word_scores", "words", """
SELECT word, purine, max(score) AS motif_score, arg_max(motif, score * 100 - rk) AS motif FROM (
  SELECT word, purine, rk, motif, length(motif) / 6.0::DOUBLE * list_sum([
      CASE WHEN i <= length(part) AND substr(word, i, 1) = substr(part, i, 1) THEN 1 ELSE 0 END
      for i in [1,2,3,4,5,6]]) AS score
  FROM words, (SELECT rk, motif, substr(motif, s) AS part FROM
     (VALUES (0,'AGGAGG'),(1,'GGAGG'),(2,'AGGAG'),(3,'GAGG'),(4,'AGGA'),(5,'GGAG')) m(rk, motif),
     range(1, 7) t(s) WHERE s <= length(motif)))
GROUP BY word, purine
""")
block("places", "", """
SELECT st AS site_start, sz AS site_length, 20 - st - sz AS spacing,
       CAST(CASE WHEN 20-st-sz BETWEEN 6 AND 8 THEN 3.0 WHEN 20-st-sz BETWEEN 5 AND 10 THEN 2.5 ELSE 1.5 END AS DOUBLE) AS spacing_score
FROM range(0, 17) a(st), range(4, 9) b(sz) WHERE 20 - st - sz BETWEEN 4 AND 12
""")
block("site_hits", "orfs0 places word_scores", """
SELECT o.genome_id, o.contig_id, o.strand, o.start, o."end", p.*, w.word, w.motif,
       p.spacing_score * 2.0 + w.motif_score * 1.5 + (w.purine - 0.6) * 2.0 AS site_score
FROM (SELECT genome_id, contig_id, strand, start, "end", lpad(upstream, 20, '-') AS up FROM orfs0) o, places p, word_scores w
WHERE w.word = substr(o.up, p.site_start + 1, p.site_length)
""")
block("orfs", "orfs0 site_hits", """
SELECT o.*, coalesce(s.best, CAST(-5.0 AS DOUBLE)) AS rbs_score
FROM orfs0 o LEFT JOIN (SELECT genome_id, contig_id, strand, start, max(site_score) AS best FROM site_hits
                        GROUP BY ALL) s USING (genome_id, contig_id, strand, start)
""")
# ---- intervals ----
block("occupied", "orfs", """
SELECT genome_id, contig_id, 'buffered_genes' AS strategy, greatest(1, genome_start - 50) AS start,
       least(contig_length, genome_end + 50) AS "end" FROM orfs WHERE length >= 200
UNION ALL SELECT genome_id, contig_id, 'strong_site', genome_start, genome_end FROM orfs WHERE rbs_score >= 3.0
UNION ALL SELECT genome_id, contig_id, 'all_orfs', genome_start, genome_end FROM orfs
""")
block("merged", "occupied", """
SELECT genome_id, contig_id, strategy, min(start) AS start, max("end") AS "end" FROM (
  SELECT *, sum(opens) OVER (PARTITION BY genome_id, contig_id, strategy ORDER BY start, "end", opens DESC
                             ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY genome_id, contig_id, strategy
        ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens
    FROM occupied))
GROUP BY genome_id, contig_id, strategy, island
""")
block("gaps", "merged contigs", """
SELECT genome_id, contig_id, strategy, lo AS start, start - 1 AS "end" FROM (
  SELECT *, coalesce(lag("end") OVER (PARTITION BY genome_id, contig_id, strategy ORDER BY start) + 1, 1) AS lo
  FROM (SELECT * FROM merged UNION ALL
        SELECT genome_id, contig_id, s, length + 1, length + 1
        FROM contigs, (VALUES ('buffered_genes'), ('strong_site'), ('all_orfs')) v(s)))
WHERE start - lo >= 150
""")
block("intergenic", "gaps contigs", """
SELECT m.*, m."end" - m.start + 1 AS length, substr(c.seq, m.start, m."end" - m.start + 1) AS sequence
FROM (SELECT genome_id, contig_id, min(start) AS start, max("end") AS "end" FROM (
  SELECT *, sum(opens) OVER (PARTITION BY genome_id, contig_id ORDER BY start, "end", opens DESC ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT genome_id, contig_id, start, "end", CASE WHEN start <= max("end") OVER (
          PARTITION BY genome_id, contig_id ORDER BY start, "end"
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM gaps))
  GROUP BY genome_id, contig_id, island) m JOIN contigs c USING (genome_id, contig_id)
""")
# ---- greedy choice: one fold per contig ----
def _fold(name: str, where: str, keys: str, order: str, conflict: str, source: str = "orfs") -> None:
    block(name, source, f"""
SELECT unnest(list_reduce(items, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: {conflict})) > 0
                                     THEN acc ELSE acc || x END), recursive := true)
    FROM (SELECT list([{{'genome_id': genome_id, 'contig_id': contig_id, 'strand': strand, 'end': "end",
                'start': start, 'genome_start': genome_start, 'genome_end': genome_end, 'length': length,
                'frame': frame, 'start_codon': start_codon}}] ORDER BY {order}) AS items
          FROM {source} WHERE {where} GROUP BY {keys})
""")


_tie = "CASE WHEN strand = 'forward' THEN 0 ELSE 1 END, frame, \"end\", start"
_fold("longest_first", "length >= 300", "genome_id, contig_id", f"length DESC, {_tie}",
      "y.genome_start <= x[1].genome_end AND y.genome_end >= x[1].genome_start")
_fold("atg_first", "length >= 300", "genome_id, contig_id, strand",
      f"CASE WHEN start_codon = 'ATG' THEN 0 ELSE 1 END, length DESC, {_tie}",
      "greatest(least(y.genome_end, x[1].genome_end) - greatest(y.genome_start, x[1].genome_start) + 1, 0)"
      " / CAST(x[1].length AS DOUBLE) > 0.3")
block("aa", "", """
SELECT substr('TCAG', CAST(i // 16 + 1 AS BIGINT), 1) || substr('TCAG', CAST((i // 4) % 4 + 1 AS BIGINT), 1)
       || substr('TCAG', CAST(i % 4 + 1 AS BIGINT), 1) AS codon,
       substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', CAST(i + 1 AS BIGINT), 1) AS letter
FROM range(64) t(i)
""")
block("calm_orfs", "orfs contigs aa", """
SELECT o.* FROM orfs o JOIN (
 SELECT genome_id, contig_id, strand, start, -sum(n / CAST(t AS DOUBLE) * log2(n / CAST(t AS DOUBLE))) AS h, any_value(t) AS t FROM (
  SELECT *, sum(n) OVER (PARTITION BY genome_id, contig_id, strand, start) AS t FROM (
   SELECT genome_id, contig_id, strand, start, coalesce(aa.letter, 'X') AS letter, count(*) AS n FROM (
    SELECT *, substr(s, CAST(i AS BIGINT) + 1, 3) AS codon FROM (SELECT *, unnest(range(0, length - 3, 3)) AS i FROM (
      SELECT o.*, CASE WHEN strand = 'forward' THEN substr(c.seq, genome_start, o.length)
        ELSE reverse(translate(substr(c.seq, genome_start, o.length), 'ACGT', 'TGCA')) END AS s
      FROM orfs o JOIN contigs c USING (genome_id, contig_id) WHERE o.length >= 300)))
   LEFT JOIN aa USING (codon) GROUP BY ALL)) GROUP BY ALL) e USING (genome_id, contig_id, strand, start)
WHERE e.t >= 10 AND e.h <= 2.9
""")
_fold("longest_first_calm", "length >= 300", "genome_id, contig_id", f"length DESC, {_tie}",
      "y.genome_start <= x[1].genome_end AND y.genome_end >= x[1].genome_start", "calm_orfs")
block("training0", "orfs longest_first atg_first", """
SELECT o.* FROM orfs o JOIN (
  SELECT genome_id, contig_id, genome_start, genome_end FROM longest_first INTERSECT
  SELECT genome_id, contig_id, genome_start, genome_end FROM atg_first)
USING (genome_id, contig_id, genome_start, genome_end)
""")
block("training", "training0 contigs", """
SELECT t.*, CASE WHEN strand = 'forward' THEN s ELSE reverse(translate(s, 'ACGT', 'TGCA')) END AS sequence
FROM (SELECT t.*, substr(c.seq, t.genome_start, t.length) AS s
      FROM training0 t JOIN contigs c USING (genome_id, contig_id)) t
""")
