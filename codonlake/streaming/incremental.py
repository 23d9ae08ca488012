"""Annotation of genomes as their contigs arrive, in files that may be spread over many micro-batches.

Two streams. The first copies records to an inbox, a Parquet table dealt to ``BUCKETS`` folders by genome. The second
reads only the names in the inbox and keeps, per genome, the set of contigs seen (keyed state): it lets go of the
genome once, when it is complete. Genomes let go in a micro-batch are annotated together from their folders of the inbox.
Sequences never are state, so the state of a genome is as large as its list of contigs.

What a micro-batch makes is written to folders that carry its number, and a repeated micro-batch overwrites them, so
every genome is written once. There is a row per genome in ``genomes`` whether or not it has genes, so a genome without
any is not annotated again. Contigs that come after their genome was let go, or twice, change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from codonlake.plans.predict import predict_genes
from codonlake.sources.fasta import parse_records

BUCKETS = 64
_RECORD = "genome_id string, contig_id string, description string, seq string, length long, bucket int"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fasta_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    raw = (
        spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", True).text(folder)
    )
    return parse_records(raw.select("value", F.col("_metadata.file_path").alias("path")))


class _Gatherer(StatefulProcessor):
    """Per genome the contigs seen and whether it was let go. A genome without a given number of contigs is complete at once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.contigs = handle.getMapState("contigs", "contig_id string", "seen boolean")
        self.done = handle.getValueState("done", "contigs long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            for _ in rows:
                pass
            return
        expected = None
        for part in rows:
            for contig in part["contig_id"].unique():
                self.contigs.updateValue((contig,), (True,))
            known = part["expected"].dropna()
            expected = int(known.iloc[0]) if len(known) else expected
        seen = sum(1 for _ in self.contigs.keys())
        if expected is None or seen >= expected:
            self.done.update((seen,))
            self.contigs.clear()
            yield pd.DataFrame({"genome_id": [key[0]], "contigs": [seen]})

    def close(self) -> None:
        pass


def complete_genomes(names: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """A stream of (genome_id, contig_id) to (genome_id, contigs), one row per genome, when its number of contigs has been seen.

    ``expected``: (genome_id, expected), the number of contigs of genomes that may arrive in pieces.
    """
    if expected is None:
        named = names.select("genome_id", "contig_id", F.lit(None).cast("long").alias("expected"))
    else:
        named = names.select("genome_id", "contig_id").join(expected.select("genome_id", F.col("expected").cast("long")), "genome_id", "left")
    return named.groupBy("genome_id").transformWithStateInPandas(_Gatherer(), "genome_id string, contigs long", "Append", "none")


def _run(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start with the state store that keyed state needs, and leave the setting of the session as it was."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _STORE)
    try:
        return start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def annotate_stream(spark: SparkSession, folder: str, store: str, checkpoint: str, files_per_batch: int = 1000,
                    expected: DataFrame | None = None, annotate: Callable[[DataFrame], DataFrame] | None = None,
                    **options) -> StreamingQuery:
    """Process everything that is there now and stop; call again for new files.

    ``store`` gets the folders inbox, genes and genomes. ``annotate`` makes rows of contigs, by default predicted genes.
    """
    def predicted(contigs: DataFrame) -> DataFrame:
        return predict_genes(contigs, **options).select("genome_id", "contig_id", "strand", "genome_start", "genome_end", "length",
                                                        "start_codon", "rbs_score", "combined_score")

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # the names of the genomes of this micro-batch
        try:
            if batch.isEmpty():
                return
            buckets = [r[0] for r in batch.select(_bucket()).distinct().collect()]  # BUCKETS numbers at most
            there = spark.read.schema(_RECORD).parquet(f"{store}/inbox").where(F.col("bucket").isin(buckets)).drop("bucket")
            contigs = there.join(batch.select("genome_id"), "genome_id", "left_semi").dropDuplicates(["genome_id", "contig_id"])
            rows = (annotate or predicted)(contigs)
            rows.write.mode("overwrite").parquet(f"{store}/genes/batch={batch_id}")
            made = spark.read.parquet(f"{store}/genes/batch={batch_id}").groupBy("genome_id").agg(F.count("*").alias("rows"))
            whole = batch.join(made, "genome_id", "left").select("genome_id", "contigs", F.coalesce("rows", F.lit(0)).alias("rows"))
            whole.write.mode("overwrite").parquet(f"{store}/genomes/batch={batch_id}")
        finally:
            batch.unpersist()

    records = fasta_stream(spark, folder, files_per_batch).withColumn("bucket", _bucket())
    (records.writeStream.format("parquet").partitionBy("bucket").option("path", f"{store}/inbox")
     .option("checkpointLocation", f"{checkpoint}/inbox").trigger(availableNow=True).start().awaitTermination())
    names = spark.readStream.schema(_RECORD).parquet(f"{store}/inbox").select("genome_id", "contig_id")
    return _run(spark, lambda: complete_genomes(names, expected).writeStream.foreachBatch(run)
                .option("checkpointLocation", f"{checkpoint}/genomes").trigger(availableNow=True).start())


def _bucket():
    return F.pmod(F.xxhash64("genome_id"), F.lit(BUCKETS)).cast("int").alias("bucket")


def annotated(spark: SparkSession, store: str, table: str = "genes") -> DataFrame:
    """What has been written so far: ``genes``, or ``genomes`` with the number of contigs and of rows of each."""
    return spark.read.parquet(f"{store}/{table}").drop("batch")
