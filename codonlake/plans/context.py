"""Stored tables that many queries of one session share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codonlake.operators import labels, models, scoring, starts
from codonlake.plans import predict
from codonlake.session import cut_lineage
from codonlake.sources.adapters import documents_as_contigs

_CONTEXTS: dict[tuple[str, str], "Context"] = {}


def context(spark: SparkSession, sf_dir: str) -> "Context":
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _CONTEXTS:
        _CONTEXTS[key] = Context(spark, sf_dir.rstrip("/"))
    return _CONTEXTS[key]


def forget() -> None:
    """Drop all stored tables, so that the next query starts from the source."""
    _CONTEXTS.clear()


class Context:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._kept: dict[str, DataFrame] = {}

    def _keep(self, name: str, make) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = cut_lineage(make())
        return self._kept[name]

    @property
    def contigs(self) -> DataFrame:
        return self._keep("contigs", lambda: documents_as_contigs(self.spark, self.sf_dir))

    @property
    def genomes(self) -> DataFrame:
        return self.contigs.select("genome_id", "tax_group").distinct()

    @property
    def orfs(self) -> DataFrame:
        return self._keep("orfs", lambda: predict.detect(self.contigs))

    @property
    def sequences(self) -> DataFrame:
        return self._keep("seqs", lambda: predict.self_training_sequences(self.orfs, self.contigs))

    @property
    def models(self) -> DataFrame:
        return self._keep("models", lambda: models.model_bundle(self.sequences))

    @property
    def scored(self) -> DataFrame:
        if "scored" not in self._kept:
            self._kept["scored"] = scoring.score_orfs(self.orfs, self.contigs, self.models)
        return self._kept["scored"]

    @property
    def candidates(self) -> DataFrame:
        from codonlake.constants import FIRST_FILTER

        return starts.filter_candidates(self.scored, FIRST_FILTER)

    @property
    def predictions(self) -> DataFrame:
        return self._keep("predictions", lambda: predict.predict_from_scored(self.scored))

    @property
    def reference(self) -> DataFrame:
        """Stand-in annotation: per stop codon the most upstream ATG, 75 bases at least."""
        return self._keep("reference", lambda: labels.longest_atg_genes(self.contigs))
