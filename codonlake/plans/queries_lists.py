"""Queries: annotation rows, batch lists, names of results, seeded splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from codonlake import constants as C
from codonlake.operators import labels
from codonlake.plans.context import context
from codonlake.plans import queries_ml  # noqa: F401  its blocks are used here
from codonlake.plans.oracle_base import query
from codonlake.plans.suite import ORACLE, register, rsql
from codonlake.sources import fasta, gff, store


@register("reference_cds", query("""
SELECT genome_id, contig_id, genome_start, genome_end, strand, genome_end - genome_start + 1 AS length FROM reference WHERE length % 2 = 0""", "reference"))
def reference_cds_q(spark, sf_dir):
    """An annotation whose genes of even length are coding, read by its CDS rows."""
    r = context(spark, sf_dir).reference
    rows = r.select("genome_id", F.col("contig_id").alias("seqid"), F.when(F.col("length") % 2 == 0, "CDS").otherwise("tRNA").alias("type"),
                    F.col("genome_start").alias("start"), F.col("genome_end").alias("end"),
                    F.when(F.col("strand") == "forward", "+").otherwise("-").alias("strand"))
    return gff.reference_cds(rows)


@register("batch_list", query("""
SELECT l.genome_id, CAST(min(list_no) AS INTEGER) AS list_no, CASE WHEN any_value(c.genome_id) IS NULL THEN 'missing' ELSE 'queued' END AS status
FROM (SELECT 0 AS list_no, trim(source) AS genome_id FROM documents UNION ALL SELECT 1, trim(lang) FROM documents UNION ALL SELECT 2, trim(source) FROM documents) l
LEFT JOIN (SELECT DISTINCT genome_id FROM contigs) c USING (genome_id) WHERE l.genome_id <> '' GROUP BY l.genome_id""", "contigs"))
def batch_list_q(spark, sf_dir):
    """Three lists of ids, one of them of names that no genome has."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lists = [docs.select(F.col(c).alias("line")) for c in ("source", "lang", "source")]
    return store.batch_list(lists, context(spark, sf_dir).genomes).select("genome_id", "list_no", "status")


@register("batch_summary", query("""
SELECT status, count(*) AS genomes, CAST(sum(genes) AS BIGINT) AS genes FROM (
 SELECT coalesce(p.genes, 0) AS genes, CASE WHEN bad OR bp = 0 THEN 'bad_input' WHEN p.genes IS NULL THEN 'no_genes' ELSE 'ok' END AS status
 FROM (SELECT genome_id, sum(length) AS bp, bool_or(regexp_matches(seq, '[^ACGTNRYWSKMBDHV]')) AS bad FROM contigs GROUP BY 1) c
 LEFT JOIN (SELECT genome_id, count(*) AS genes FROM predictions GROUP BY 1) p USING (genome_id)) GROUP BY status""", "contigs predictions"))
def batch_summary_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return store.batch_summary(store.genome_status(ctx.contigs, ctx.predictions))


@register("result_names", query(f"""
SELECT CASE WHEN doc_id % 2 = 0 THEN 'NC_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.1' ELSE source || '_' || doc_id END AS genome_id,
 CASE WHEN doc_id % 2 = 0 THEN regexp_matches('NC_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.1', '{C.ACCESSION_PATTERN}')
  ELSE regexp_matches(source || '_' || doc_id, '{C.ACCESSION_PATTERN}') END AS gradable FROM documents""", ""))
def result_names_q(spark, sf_dir):
    """Names of result files as genome ids, and which of them can be graded."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("NC_"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(".1"))).otherwise(
        F.concat_ws("_", "source", "doc_id"))
    stem = fasta.genome_of_file(F.concat(F.lit("file:/out/"), name, F.lit("_predictions.gff")))
    return docs.select(stem.alias("genome_id"), fasta.gradable(stem).alias("gradable"))


def _hash(seed: int, *keys: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 8))::BIGINT"


_KEYS = ("genome_id", "contig_id", "strand", '"end"')


@register("group_split", query(f"""
SELECT genome_id, contig_id, strand, "end", label, CASE WHEN {_hash(7, *_KEYS)} / 4294967296.0::DOUBLE < 0.2 THEN 'test' ELSE 'train' END AS split
FROM group_labels""", "group_labels"))
def group_split_q(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return labels.group_split(labels.label_groups(ctx.candidates, ctx.reference), 0.2, 7)


@register("limit_per_group", query("""
SELECT genome_id, tax_group FROM (SELECT *, row_number() OVER (PARTITION BY tax_group ORDER BY md5('11:' || genome_id), genome_id) AS r
 FROM (SELECT DISTINCT genome_id, tax_group FROM contigs)) WHERE r <= 3""", "contigs"))
def limit_per_group_q(spark, sf_dir):
    """Three genomes of each taxonomic group, by a seeded hash."""
    return labels.limit_per_group(context(spark, sf_dir).genomes, 3, 11)


ORACLE["stratified_split"] = query("SELECT genome_id, tax_group, split FROM genome_splits", "genome_splits")
ORACLE["weight_generalisation"] = query(f"""
SELECT vector, {rsql('train', 'val', 'gap=train - val')} FROM (
 SELECT vector, avg(is_true) FILTER (WHERE split = 'train') AS train, avg(is_true) FILTER (WHERE split = 'val') AS val
 FROM vector_hits JOIN genome_splits USING (genome_id) GROUP BY vector)""", "vector_hits genome_splits")
