"""Scores of ORFs against the models of their genome, z-scores and the weighted sum.

Nested ORFs share their tail, so a base is looked up once per stop codon and not once per start: each
start owns the bases up to the next start plus one context length. Looked up from the start of the ORF
those bases give its head (contexts cut at the start codon) and its own full-context part; the score of
an ORF is its head plus the full parts of itself and of all later starts of the same stop.

The bases of an ORF and the model rows of its genome meet in a cogroup: the model is there once per group and not once per
base or ORF. A genome with many ORFs is split over groups, larger ones where the model is large.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from codonlake import constants as C
from codonlake.operators.distribute import join_per_genome
from codonlake.operators.models import CODON, word_code
from codonlake.operators.orf import CONTIG, GROUP, ORF, slice_forward
from codonlake.functions.sequence import reverse_complement
from codonlake.session import cut_lineage, stored

#: ORFs of a genome that are scored in one group at least, and bases that are looked up at a time.
ORFS_PER_GROUP, SLICE = 50_000, 1_000_000
_LETTERS = np.full(256, 4, dtype=np.int64)
_LETTERS[[ord(c) for c in "ACGT"]] = range(4)


def words_up_to(size: Column) -> Column:
    """Number of words of 1..size bases, which is also where the words of size+1 bases begin."""
    return ((F.expr("1").cast("long") * F.pow(F.lit(4.0), size + 1) - 4) / 3).cast("int")


def markov_lookup(table: Column, order: Column, pos: Column, word: Column) -> Column:
    """Value of a word, 0 when it holds a letter outside ACGT."""
    size = F.length(word)
    index = pos * words_up_to(order + 1) + words_up_to(size - 1) + word_code(word)
    return F.when(word.contains("N"), F.lit(0.0)).otherwise(F.coalesce(F.get(table, index), F.lit(0.0)))


def genome_groups(orfs: DataFrame, models: DataFrame) -> DataFrame:
    """Per genome the number of groups, ``_groups``: a group has as many ORFs as half the rows of the model, ``ORFS_PER_GROUP`` at least.

    Models grow with their genome. With groups of one size the copies of a model would grow with the square of the genome.
    """
    rows = models.groupBy("genome_id").agg(F.count("*").alias("_rows"))
    counts = orfs.groupBy("genome_id").agg(F.count("*").alias("_orfs")).join(rows, "genome_id", "left")
    each = F.greatest(F.lit(ORFS_PER_GROUP), F.coalesce(F.col("_rows") / 2, F.lit(0)))
    return counts.select("genome_id", F.ceil(F.col("_orfs") / each).cast("int").alias("_groups"))


def own_parts(orfs: DataFrame, contigs: DataFrame, models: DataFrame) -> DataFrame:
    """Per ORF: sums over the bases it owns (see module text)."""
    by_start = Window.partitionBy(*GROUP).orderBy("start")
    keyed = orfs.select(*ORF, "contig_length").repartition(*CONTIG)  # serves window, join, aggregation
    keyed = keyed.select(*ORF, "contig_length", F.lead("start").over(by_start).alias("_next"))
    own = F.coalesce(F.col("_next"), F.col("end") + 1) - F.col("start")
    last = F.least(F.col("end"), F.col("start") + own - 1 + C.MAX_MARKOV_ORDER)
    keyed = keyed.select(*ORF, own.cast("int").alias("_own"), F.col("contig_length"), last.alias("_last"))
    forward = F.col("strand") == "forward"
    lo = F.when(forward, F.col("start")).otherwise(F.col("contig_length") - F.col("_last") + 1)
    hi = F.when(forward, F.col("_last")).otherwise(F.col("contig_length") - F.col("start") + 1)
    cut = slice_forward(keyed, contigs, lo, hi, "_s")
    strand_seq = F.when(forward, F.col("_s")).otherwise(reverse_complement(F.col("_s")))
    cut = cut.select(*ORF, "_own", strand_seq.alias("_bases"))
    groups = stored(genome_groups(orfs, models))
    spread = F.pmod(F.xxhash64("contig_id", "strand", "end"), F.col("_groups")).cast("int")
    parts = join_per_genome(cut, groups, 64, "inner").withColumn("_group", spread).drop("_groups")
    copies = models.join(groups, "genome_id").withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)))
    copies = copies.select("genome_id", "_group", "markov_order", "pos", "size", "context", "ratio")
    keys = ["genome_id", "_group"]
    return parts.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(
        _looked_up, "genome_id string, contig_id string, strand string, end long, start long, head double, full double, usage double, n_codons long")


def _tables(model: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """Order, codon values, and the values of all words: that of L bases with number c at position p is at p * T + (4^L - 4) / 3 + c."""
    pos, size, context = (model.column(c).to_numpy().astype(np.int64) for c in ("pos", "size", "context"))
    ratio = model.column("ratio").combine_chunks().flatten().to_numpy().reshape(-1, 4)
    orders = model.column("markov_order").drop_null()
    order = orders[0].as_py() if len(orders) else 0
    each = (4 ** (order + 2) - 4) // 3
    words, codons = np.zeros(3 * each), np.zeros(64)
    usage = pos == CODON
    codons[context[usage][:, None] * 4 + np.arange(4)] = ratio[usage]
    at = pos[~usage] * each + (4 ** size[~usage] - 4) // 3 + context[~usage] * 4
    words[at[:, None] + np.arange(4)] = ratio[~usage]
    return order, codons, words


def _looked_up(parts: pa.Table, model: pa.Table) -> pa.Table:
    """Sums over the bases each ORF owns: head, full, usage, n_codons. Words and codons with a letter outside ACGT count nothing."""
    order, codons, words = _tables(model)
    own, bases = parts.column("_own").to_numpy(), parts.column("_bases").combine_chunks().cast(pa.large_string())
    offsets = np.frombuffer(bases.buffers()[1], dtype=np.int64)[bases.offset:bases.offset + len(bases) + 1] if len(bases) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(bases.buffers()[2], dtype=np.uint8) if len(bases) and bases.buffers()[2] is not None else np.empty(0, dtype=np.uint8)
    sums, first = np.zeros((4, parts.num_rows)), 0
    while first < parts.num_rows:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1)
        letters, sizes = _LETTERS[data[offsets[first]:offsets[end]]], np.diff(offsets[first:end + 1])
        row = np.repeat(np.arange(end - first), sizes)
        start = np.repeat(offsets[first:end] - offsets[first], sizes)
        at = np.arange(letters.size)
        i, other = at - start, letters == 4
        letters = np.where(other, 0, letters)
        back = np.minimum(i, order)  # bases of the context
        code = np.zeros(letters.size, dtype=np.int64)
        for j in range(order + 1):
            code[j:] += np.where(i[j:] >= j, letters[:letters.size - j], 0) << (2 * j)
        whole = np.maximum.accumulate(np.where(other, at, -1)) < at - back
        value = words[(i % 3) * (words.size // 3) + (4 ** (back + 1) - 4) // 3 + code]
        value = np.where(whole & (i < own[first:end][row] + order), value, 0.0)
        plain = np.zeros(letters.size, dtype=bool)
        triple = np.zeros(letters.size, dtype=np.int64)
        if letters.size > 2:
            plain[:-2] = ~(other[:-2] | other[1:-1] | other[2:]) & (row[:-2] == row[2:])
            triple[:-2] = letters[:-2] * 16 + letters[1:-1] * 4 + letters[2:]
        plain &= (i % 3 == 0) & (i < own[first:end][row])
        for k, weight in enumerate((np.where(i < order, value, 0.0), np.where(i >= order, value, 0.0), np.where(plain, codons[triple], 0.0), plain)):
            sums[k, first:end] = np.bincount(row, weights=weight, minlength=end - first)
        first = end
    named = {c: parts.column(c) for c in ORF}
    return pa.table(named | {"head": sums[0], "full": sums[1], "usage": sums[2], "n_codons": pa.array(sums[3].astype(np.int64))})


def model_scores(orfs: DataFrame, contigs: DataFrame, models: DataFrame) -> DataFrame:
    """codon_score and imm_score per ORF."""
    later = (
        Window.partitionBy(*GROUP).orderBy(F.col("start").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    n = F.col("end") - F.col("start") + 1
    n_codons = F.sum("n_codons").over(later)
    return own_parts(orfs, contigs, models).select(
        *ORF,
        F.when(n_codons > 0, F.sum("usage").over(later) / n_codons).otherwise(F.lit(0.0))
        .alias("codon_score"),
        F.when(n >= 3, (F.col("head") + F.sum("full").over(later)) / n).otherwise(F.lit(0.0))
        .alias("imm_score"),
    )


def length_score(length: Column) -> Column:
    return F.log(F.greatest(length, F.lit(C.MIN_ORF_LENGTH)) / F.lit(float(C.LENGTH_REFERENCE_BP)))


def start_score(codon: Column) -> Column:
    out = F
    for name, value in C.START_CODON_SCORE.items():
        out = out.when(codon == name, F.lit(value))
    return out.otherwise(F.lit(C.START_CODON_SCORE_OTHER))


def add_scores(orfs: DataFrame, contigs: DataFrame, models: DataFrame) -> DataFrame:
    """The five raw scores. ORFs without a site column score 0 there."""
    rbs = F.coalesce("rbs_score", F.lit(0.0)) if "rbs_score" in orfs.columns else F.lit(0.0)
    return (
        orfs.join(model_scores(orfs, contigs, models), ORF)
        .withColumn("rbs_score", rbs)
        .withColumn("length_score", length_score(F.col("length")))
        .withColumn("start_score", start_score(F.col("start_codon")))
    )


def component_stats(scored: DataFrame) -> DataFrame:
    """Mean and population deviation of each component per genome; deviation 0 if it is constant."""
    aggs = []
    for c in C.COMPONENTS:
        s = f"{c}_score"
        spread = F.when(F.max(s) > F.min(s), F.stddev_pop(s)).otherwise(0.0)
        aggs += [F.avg(s).alias(f"{c}_mean"), spread.alias(f"{c}_std")]
    return scored.groupBy("genome_id").agg(*aggs)


def add_z_scores(scored: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """z-score of each component over the ORFs of the genome, 0 where the deviation is 0.

    The statistics are aggregated (map-side combine) and joined back; a window over the genome would
    gather all its ORFs in one task.
    """
    joined = join_per_genome(scored, stats if stats is not None else component_stats(scored))
    z = [
        F.when(F.col(f"{c}_std") > 0, (F.col(f"{c}_score") - F.col(f"{c}_mean")) / F.col(f"{c}_std"))
        .otherwise(F.lit(0.0)).alias(f"{c}_score_norm")
        for c in C.COMPONENTS
    ]
    return joined.select(*scored.columns, *z)


def weighted_sum(weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for i, c in enumerate(C.COMPONENTS):
        term = F.col(f"{c}_score_norm") * F.lit(float(weights[c]))
        total = term if i == 0 else total + term
    return total


def score_orfs(orfs: DataFrame, contigs: DataFrame, models: DataFrame,
               weights: dict[str, float] | None = None, normalize: bool = True,
               combined: bool = True, store=cut_lineage) -> DataFrame:
    """All scores. The raw ones are stored because statistics and result both read them."""
    out = add_scores(orfs, contigs, models)
    if normalize:
        out = store(out)
        out = add_z_scores(out, store(component_stats(out)))
        if combined:
            out = out.withColumn("combined_score", weighted_sum(weights or C.SCORE_WEIGHTS))
    return out
