"""From contigs to predicted genes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from codonlake import constants as C
from codonlake.operators import intervals, models, orf, rbs, scoring, selection, starts
from codonlake.session import cut_lineage


@dataclass
class Annotation:
    """Intermediate tables of one run over many genomes."""

    contigs: DataFrame
    orfs: DataFrame
    sequences: DataFrame
    models: DataFrame
    scored: DataFrame


def detect(contigs: DataFrame, min_length: int = C.MIN_ORF_LENGTH) -> DataFrame:
    return rbs.add_rbs_score(orf.scan_orfs(contigs, min_length))


def self_training_sequences(orfs: DataFrame, contigs: DataFrame) -> DataFrame:
    training = orf.with_sequence(selection.training_set(orfs), contigs)
    regions = intervals.with_region_sequence(intervals.intergenic_regions(orfs, contigs), contigs)
    return models.labelled_sequences(training, regions)


def annotate(contigs: DataFrame, min_length: int = C.MIN_ORF_LENGTH, fixed_order: int | None = None,
             weights: dict[str, float] | None = None, store=cut_lineage) -> Annotation:
    """Scan, self-train, score. Tables that several later steps read are stored once, by default as a
    reliable checkpoint; parsed contigs are one of them, so that the source is parsed once."""
    contigs = store(contigs)
    orfs = store(detect(contigs, min_length))
    seqs = store(self_training_sequences(orfs, contigs))
    bundle = store(models.model_bundle(seqs, fixed_order))
    scored = scoring.score_orfs(orfs, contigs, bundle, weights, store=store)
    return Annotation(contigs, orfs, seqs, bundle, scored)


def predict_from_scored(scored: DataFrame, group_filter=None, start_choice=None, final_filter=None,
                        first: dict[str, float] = C.FIRST_FILTER,
                        second: dict[str, float] = C.SECOND_FILTER,
                        weights: dict[str, float] | None = None) -> DataFrame:
    """First filter, optional group filter, start choice, second filter, optional candidate filter.

    The optional stages are functions DataFrame -> DataFrame, e.g. around a fitted Spark ML model.
    """
    rows = starts.filter_candidates(scored, first)
    if group_filter:
        rows = group_filter(rows)
    rows = start_choice(rows) if start_choice else starts.best_starts(rows, weights)
    rows = starts.filter_candidates(rows, second)
    return final_filter(rows) if final_filter else rows


def predict_genes(contigs: DataFrame, **options) -> DataFrame:
    keep = {k: options.pop(k) for k in ("min_length", "fixed_order", "store") if k in options}
    return predict_from_scored(annotate(contigs, **keep).scored, **options)


def training_matrix(contigs: DataFrame, genomes: DataFrame, reference: DataFrame, stage: str = "groups",
                    n_val: int = 2, n_test: int = 2, seed: int = 42, **options) -> DataFrame:
    """Features, label and split of all genomes in one job.

    ``stage`` is "groups" (before start choice, for the group classifier) or "candidates" (after it and
    the second filter, for the candidate classifier). Genomes without a reference are left out.
    """
    from codonlake.operators import features, labels

    known = genomes.join(reference.select("genome_id").distinct(), "genome_id", "left_semi")
    splits = labels.stratified_genome_split(known, n_val, n_test, seed)
    used = contigs.join(known.select("genome_id"), "genome_id", "left_semi")
    run = annotate(used, **options)
    if stage == "groups":
        rows = starts.filter_candidates(run.scored, C.FIRST_FILTER)
        table = features.group_features(rows).join(labels.label_groups(rows, reference), orf.GROUP)
    else:
        table = labels.label_orfs(features.candidate_features(predict_from_scored(run.scored), run.contigs), reference)
    return table.join(splits.select("genome_id", "tax_group", "split"), "genome_id")
