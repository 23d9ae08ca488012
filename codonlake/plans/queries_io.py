"""Queries: sources, sinks and stores. Files are written from the given tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from codonlake.operators import features, grading as G, labels, orf
from codonlake.plans.context import context
from codonlake.plans.oracle_base import block, query
from codonlake.plans.suite import register, rounded, rsql
from codonlake.session import ensure_checkpoint_dir
from codonlake.sources import fasta, gff, store
from codonlake.streaming import incremental


def scratch(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"


@register("fasta_round_trip", query(
    "SELECT genome_id, contig_id, tax_group AS description, length, md5(seq) AS seq_md5 FROM contigs", "contigs"))
def fasta_q(spark, sf_dir):
    c = context(spark, sf_dir).contigs
    path = scratch(spark)
    fasta.write_fasta(c.withColumn("description", F.col("tax_group")), path)
    back = fasta.read_fasta(spark, f"{path}/*/*")
    return back.select("genome_id", "contig_id", "description", "length", F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


@register("alphabet_report", query("""
SELECT genome_id, contig_id, length, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(seq, '[^ACGTNRYWSKMBDHV]'))), ''), '') AS invalid_letters,
 NOT regexp_matches(seq, '[^ACGTNRYWSKMBDHV]') AS valid
FROM (SELECT source AS genome_id, CAST(doc_id AS VARCHAR) AS contig_id, length(seq) AS length, seq FROM (
 SELECT source, doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents))""", ""))
def alphabet_q(spark, sf_dir):
    """The check on the letters of the texts themselves, which hold many that are no bases."""
    from codonlake.functions.sequence import strip_to_letters

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.col("source").alias("genome_id"), F.col("doc_id").cast("string").alias("contig_id"),
                       strip_to_letters(F.col("text")).alias("seq"))
    return fasta.alphabet_report(rows.withColumn("length", F.length("seq").cast("long")))


_NO = "row_number() OVER (PARTITION BY genome_id ORDER BY contig_id, genome_start, genome_end, strand) AS gene_no"
block("numbered", "predictions", f"SELECT *, {_NO} FROM predictions")


@register("gff_lines", query("""
SELECT genome_id, gene_no, contig_id || chr(9) || 'codonlake' || chr(9) || 'CDS' || chr(9) || genome_start || chr(9) || genome_end || chr(9)
 || printf('%.3f', combined_score) || chr(9) || CASE WHEN strand = 'forward' THEN '+' ELSE '-' END || chr(9) || '0' || chr(9)
 || 'ID=gene_' || gene_no || ';rbs_score=' || printf('%.2f', rbs_score) || ';combined_score=' || printf('%.2f', combined_score) AS line
FROM numbered""", "numbered"))
def gff_lines_q(spark, sf_dir):
    return gff.gff_lines(gff.gene_numbers(context(spark, sf_dir).predictions))


@register("csv_rows", query(f"""
SELECT genome_id, 'gene_' || gene_no AS "Gene ID", genome_start AS "Start", genome_end AS "End", length AS "Length", strand AS "Strand",
 {rsql('score=combined_score', 'rbs=CASE WHEN rbs_score <> 0 THEN rbs_score END')}, CASE WHEN coalesce(rbs_score, 0) = 0 THEN 'N/A' ELSE 'number' END AS rbs_kind
FROM numbered""", "numbered"))
def csv_q(spark, sf_dir):
    t = gff.csv_table(gff.gene_numbers(context(spark, sf_dir).predictions))
    rbs = F.col("RBS Score").try_cast("double")
    return rounded(t.select("genome_id", "Gene ID", "Start", "End", "Length", "Strand", F.col("Combined Score").alias("score"), rbs.alias("rbs"),
                            F.when(rbs.isNull(), F.col("RBS Score")).otherwise("number").alias("rbs_kind")))


@register("gff_round_trip", query(
    "SELECT DISTINCT genome_id, contig_id, genome_start, genome_end FROM predictions", "predictions"))
def gff_q(spark, sf_dir):
    """Written as GFF3 and read back as a result file."""
    p = context(spark, sf_dir).predictions
    path = scratch(spark)
    gff.write_gff(p, path)
    return gff.read_predictions(spark, f"{path}/*/*").select("genome_id", "contig_id", "genome_start", "genome_end")


@register("gff_reference", query(
    "SELECT DISTINCT genome_id, contig_id, genome_start, genome_end FROM reference", "reference"))
def gff_reference_q(spark, sf_dir):
    """The annotation written as GFF3 (all rows of type gene) and read with the CDS, gene, all rule."""
    r = context(spark, sf_dir).reference
    path = scratch(spark)
    line = F.concat_ws("\t", "contig_id", F.lit("."), F.lit("gene"), F.col("genome_start").cast("string"),
                       F.col("genome_end").cast("string"), F.lit("."),
                       F.when(F.col("strand") == "forward", "+").otherwise("-"), F.lit("0"),
                       F.format_string("ID=%s;gene_biotype=%s", "contig_id", "strand"))
    r.select("genome_id", line.alias("value")).write.partitionBy("genome_id").text(path)
    return gff.reference_intervals(gff.read_gff(spark, f"{path}/*/*"))


@register("gff_biotypes", query("SELECT strand AS biotype, count(*) AS n FROM reference GROUP BY strand", "reference"))
def biotype_q(spark, sf_dir):
    r = context(spark, sf_dir).reference
    rows = r.select("genome_id", F.lit("gene").alias("type"),
                    F.concat(F.lit("ID=x;gene_biotype="), F.col("strand"), F.lit(";gbkey=Gene")).alias("attributes"))
    return gff.biotype_counts(rows).groupBy("biotype").agg(F.sum("n").alias("n"))


@register("result_page", query(f"""
SELECT genome_id, contig_id, strand, genome_start, genome_end, {rsql('combined_score')} FROM predictions WHERE strand = 'reverse'
ORDER BY length DESC, genome_id, contig_id, genome_start LIMIT 20 OFFSET 20""", "predictions"))
def page_q(spark, sf_dir):
    p = context(spark, sf_dir).predictions
    order = [F.col("length").desc(), F.col("genome_id"), F.col("contig_id"), F.col("genome_start")]
    rows = gff.page(p, order, 2, 20, "reverse")
    return rounded(rows.select("genome_id", "contig_id", "strand", "genome_start", "genome_end", "combined_score"))


@register("deep_page", query(f"""
SELECT genome_id, contig_id, strand, genome_start, genome_end, {rsql('rbs_score')} FROM orfs
ORDER BY length DESC, genome_id, contig_id, strand, genome_start LIMIT 20 OFFSET 2000""", "orfs"))
def deep_page_q(spark, sf_dir):
    """Page 101 of all ORFs, found by an index of range partitions."""
    order = [F.col("length").desc(), F.col("genome_id"), F.col("contig_id"), F.col("strand"), F.col("genome_start")]
    index = gff.page_index(context(spark, sf_dir).orfs, order)
    return rounded(index.page(101, 20).select("genome_id", "contig_id", "strand", "genome_start", "genome_end", "rbs_score"))


@register("strand_counts", query("""
SELECT genome_id, count(*) FILTER (WHERE strand = 'forward') AS forward, count(*) FILTER (WHERE strand = 'reverse') AS reverse
FROM predictions GROUP BY genome_id""", "predictions"))
def strand_q(spark, sf_dir):
    return gff.strand_counts(context(spark, sf_dir).predictions)


@register("region_query", query("""
SELECT genome_id, contig_id, strand, genome_start, genome_end FROM predictions
WHERE genome_end >= 500 AND genome_start <= 1500 AND strand = 'forward'""", "predictions"))
def region_q(spark, sf_dir):
    from codonlake.operators.intervals import region_query

    p = context(spark, sf_dir).predictions
    return region_query(p, 500, 1500, "forward").select("genome_id", "contig_id", "strand", "genome_start", "genome_end")


@register("store_statistics", query(f"""
SELECT (SELECT count(DISTINCT genome_id) FROM contigs) AS genomes, (SELECT count(*) FROM orfs0) AS orfs,
 (SELECT CAST(sum(length) AS BIGINT) FROM contigs) AS bp, {rsql('mean_orfs=(SELECT count(*) FROM orfs0) / CAST((SELECT count(DISTINCT genome_id) FROM contigs) AS DOUBLE)')}""",
 "contigs orfs0"))
def stats_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return rounded(store.store_statistics(ctx.orfs, ctx.contigs))


@register("stream_store", query("""
SELECT genome_id, CAST(count(*) AS BIGINT) AS contigs, CAST(coalesce(sum(n), 0) AS BIGINT) AS orfs FROM contigs
LEFT JOIN (SELECT genome_id, contig_id, count(*) AS n FROM orfs0 GROUP BY ALL) USING (genome_id, contig_id) GROUP BY genome_id""", "contigs orfs0"))
def stream_store_q(spark, sf_dir):
    """The contigs written as FASTA in two parts that both have contigs of every genome, streamed after each part."""
    c, path = context(spark, sf_dir).contigs.withColumn("description", F.lit("")), scratch(spark)
    expected = c.groupBy("genome_id").agg(F.count("*").alias("expected"))
    second = F.pmod(F.xxhash64("genome_id", "contig_id"), F.lit(2)) == 1
    for name, part in (("first", ~second), ("second", second)):
        fasta.write_fasta(c.where(part), f"{path}/in/{name}")
        incremental.annotate_stream(spark, f"{path}/in", f"{path}/out", f"{path}/state", expected=expected,
                                    annotate=lambda contigs: orf.scan_orfs(contigs).drop("upstream")).awaitTermination()
    return incremental.annotated(spark, f"{path}/out", "genomes").select("genome_id", "contigs", F.col("rows").alias("orfs"))


@register("incremental_store", query("SELECT genome_id, count(*) AS orfs FROM orfs0 GROUP BY genome_id", "orfs0"))
def incremental_q(spark, sf_dir):
    """Two rounds: first the genomes of one taxonomic group, then whatever is not stored yet."""
    ctx, path = context(spark, sf_dir), scratch(spark)
    first = ctx.genomes.where("tax_group = 'group1'").select("genome_id")
    store.append_by_genome(ctx.orfs.join(first, "genome_id", "left_semi"), path)
    todo = store.new_contigs(ctx.contigs, path).select("genome_id").distinct()
    store.append_by_genome(ctx.orfs.join(todo, "genome_id", "left_semi"), path)
    return store.orfs_per_genome(spark.read.parquet(path))


@register("genome_status", query("""
SELECT genome_id, CAST(c.bp AS BIGINT) AS bp, coalesce(p.genes, 0) AS genes, CASE WHEN bad OR bp = 0 THEN 'bad_input' WHEN p.genes IS NULL THEN 'no_genes' ELSE 'ok' END AS status
FROM (SELECT genome_id, sum(length) AS bp, bool_or(regexp_matches(seq, '[^ACGTNRYWSKMBDHV]')) AS bad FROM contigs GROUP BY 1) c
LEFT JOIN (SELECT genome_id, count(*) AS genes FROM predictions GROUP BY 1) p USING (genome_id)""", "contigs predictions"))
def status_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return store.genome_status(ctx.contigs, ctx.predictions)


@register("run_log_regressions", query(f"""
SELECT genome_id, {rsql('old_f1=o.f1', 'new_f1=n.f1', 'delta_pp=(n.f1 - o.f1) * 100')} FROM graded n JOIN graded_equal o USING (genome_id)
WHERE (n.f1 - o.f1) * 100 < -0.05""", "graded graded_equal"))
def run_log_q(spark, sf_dir):
    """Two runs appended to a log, equal weights first; genomes whose F1 fell."""
    from codonlake import constants as C
    from codonlake.plans.predict import predict_from_scored

    ctx, path = context(spark, sf_dir), scratch(spark)
    old = G.exact_metrics(predict_from_scored(ctx.scored, weights=C.SCORE_WEIGHTS), ctx.reference)
    G.append_run(old, "run-1", path)
    G.append_run(G.exact_metrics(ctx.predictions, ctx.reference), "run-2", path)
    return rounded(G.regressions(spark.read.parquet(path)))


@register("genome_report", query("""
SELECT genome_id, genome_id || chr(9) || 'TP=' || tp || ' FP=' || fp || ' FN=' || fn || ' sensitivity=' || printf('%.2f', sensitivity * 100 + 1e-9)
 || '% precision=' || printf('%.2f', "precision" * 100 + 1e-9) || '% F1=' || printf('%.2f', f1 * 100 + 1e-9) || '%' AS line FROM graded""", "graded"))
def report_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return G.genome_report(G.exact_metrics(ctx.predictions, ctx.reference))


_FEATURES = [c for c in features.CANDIDATE_FEATURES if c != "gc_deviation"]


@register("training_table", query(f"""
SELECT genome_id, contig_id, strand, start, label, {rsql(*_FEATURES, 'gc_deviation=gc_content - mean_gc', 'aa_entropy')}
FROM cand_features JOIN (SELECT genome_id, contig_id, strand, start, label FROM labelled) USING (genome_id, contig_id, strand, start)""", "cand_features labelled"))
def training_table_q(spark, sf_dir):
    """Candidates of all genomes with features and label, stored and read back."""
    ctx, path = context(spark, sf_dir), scratch(spark)
    f = features.candidate_features(ctx.candidates, ctx.contigs)
    labels.label_orfs(f, ctx.reference).write.partitionBy("genome_id").parquet(path)
    t = spark.read.parquet(path).withColumn("genome_id", F.col("genome_id").cast("string"))
    return rounded(t.select("genome_id", "contig_id", "strand", "start", "label", *features.CANDIDATE_FEATURES, "aa_entropy"))
