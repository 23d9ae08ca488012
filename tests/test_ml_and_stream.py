import random

import pytest
from pyspark.sql import functions as F

from codonlake.operators import ml, sweeps
from codonlake.plans import predict
from codonlake.streaming.incremental import annotate_stream, annotated
from conftest import dna


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(1)
    rows = []
    for i in range(400):
        y = int(r.random() < 0.3)
        rows.append(("g", "c", "forward", i // 2, i, "abcd"[i % 4], y, y + r.gauss(0, 0.4), r.gauss(0, 1), ("ACG" if y else "TTA") * 20))
    return spark.createDataFrame(rows, "genome_id string, contig_id string, strand string, end long, start long, tax_group string, "
                                       "label int, x double, noise double, sequence string").persist()


def test_classifier_learns_and_names_missing_columns(table):
    model = ml.train_classifier(table.withColumn("held", F.col("start") % 5 == 0), ["x", "noise"], validation="held", maxIter=8, maxDepth=3)
    scored = ml.score_table(model, table)
    assert ml.auc(scored) > 0.9 and ml.model_features(model) == ["x", "noise"]
    assert ml.feature_importance(model)[0][0] == "x"
    with pytest.raises(ValueError, match="noise"):
        ml.score_table(model, table.drop("noise"))
    with pytest.raises(ValueError, match="positive"):
        ml.train_classifier(table.where("label = 0"), ["x"])
    assert ml.keep_groups(table, scored.groupBy("genome_id", "contig_id", "strand", "end").agg(F.max("prob").alias("prob")), 0.5).count() > 0
    kept = ml.keep_candidates(scored, 0.5)
    assert kept.agg(F.min("hybrid_prob")).first()[0] >= 0.5


def test_sequence_classifiers(table):
    for network in (False, True):
        model = ml.train_sequence_classifier(table, ["noise"], buckets=16, network=network, **({} if network else {"maxIter": 3, "maxDepth": 2}))
        assert ml.auc(ml.score_table(model, ml.with_kmers(table))) > 0.95


def test_studies(table):
    folds = ml.leave_one_group_out(table, ["x", "noise"], maxIter=3, maxDepth=2)
    assert folds.count() == 4 * len(ml.FLIP_THRESHOLDS) and folds.agg(F.min("auroc")).first()[0] > 0.8
    halves = table.where("start % 2 = 0"), table.where("start % 2 = 1")
    assert {n for n, a in ml.compare_models(*halves, ["x", "noise"]) if a > 0.8} == {"logistic_regression", "random_forest", "boosted_trees"}
    scored = table.withColumn("prob", 1 / (1 + F.exp(-F.col("x"))))
    curve = ml.isotonic(scored).transform(scored).orderBy("prob").select("calibrated").toPandas()["calibrated"]
    assert curve.is_monotonic_increasing
    both = ml.sweep_two_models(scored.withColumn("other", F.col("prob") - 0.1), "prob", "other", "label", [0.3, 0.5])
    assert both.count() == 4
    grid = [{"maxIter": 2, "maxDepth": 1}, {"maxIter": 4, "maxDepth": 2}, {"maxIter": 2, "maxDepth": 1}]
    best = ml.grid_search(table, ["x", "noise"], grid, flips=[0.5, 0.4])
    rows = {r.setting: r for r in best.collect()}
    assert [r.rows for r in rows.values()] == [400] * 3 and sorted(r.place for r in rows.values()) == [1, 2, 3]
    assert rows[0].accuracy == rows[2].accuracy > 0.8 and rows[0].place < rows[2].place and rows[1].parameters == "maxDepth=2, maxIter=4"
    folds = ml.leave_one_group_out(table, ["x", "noise"], flips=[0.5, 0.4], **grid[1]).groupBy("flip").agg(
        (F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")).alias("a")).collect()
    assert abs(rows[1].accuracy - max(r.a for r in folds)) < 0.05  # other samples of the rows
    assert ml.grid_search(table, ["x", "noise"], grid, flips=[0.5, 0.4]).collect() == best.collect()


def test_fits_do_not_hang_on_the_order_of_rows(table):
    other = table.orderBy(F.col("noise")).coalesce(3)
    runs = []
    for rows in (table, other):
        model = ml.train_classifier(rows, ["x", "noise"], maxIter=4, maxDepth=2)
        best = ml.grid_search(rows, ["x", "noise"], [{"maxIter": 4, "maxDepth": 2}], flips=[0.5, 0.4]).collect()
        runs.append((best, [r.prob for r in ml.score_table(model, table).orderBy("start").collect()]))
    assert runs[0] == runs[1]


def test_stream_gathers_genomes_and_handles_each_once(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    expected = spark.createDataFrame([("split", 3), ("bare", 1)], "genome_id string, expected long")
    scan = lambda contigs: predict.detect(contigs).select("genome_id", "contig_id", "strand", "start", "end")
    go = lambda ck=ck, out=out: annotate_stream(spark, str(src), out, ck, expected=expected, annotate=scan).awaitTermination()
    genomes = lambda: {r.genome_id: (r.contigs, r.rows) for r in annotated(spark, out, "genomes").collect()}

    def put(folder, name, contigs):
        (src / folder).mkdir(exist_ok=True)
        (src / folder / f"{name}.fasta").write_text("".join(f">{c} x\n{s}\n" for c, s in contigs))

    seqs = [dna(k, 2000) for k in range(3)]
    put("a", "one", [("one.1", seqs[0]), ("one.2", seqs[1])])  # without a number of contigs: complete as it comes
    put("a", "bare", [("bare.1", "C" * 500)])  # no ORF at all
    put("a", "split", [("s.1", seqs[0]), ("s.2", seqs[1])])
    go()
    first = genomes()
    assert set(first) == {"one", "bare"} and first["bare"] == (1, 0) and first["one"][0] == 2 and first["one"][1] > 0
    put("b", "split", [("s.2", seqs[1])])  # seen before
    go()
    assert genomes() == first
    put("c", "split", [("s.3", seqs[2])])
    put("c", "one", [("one.3", seqs[2])])  # too late
    go()
    last = genomes()
    assert {k: last[k] for k in first} == first and last["split"][0] == 3
    rows = annotated(spark, out)
    assert {(r.genome_id, r.contig_id) for r in rows.select("genome_id", "contig_id").distinct().collect()} == {
        ("one", "one.1"), ("one", "one.2"), ("split", "s.1"), ("split", "s.2"), ("split", "s.3")}
    assert rows.count() == rows.distinct().count() == sum(n for _, n in last.values())
    go()
    assert genomes() == last and annotated(spark, out, "genomes").count() == 3
    # another checkpoint with another store sees everything at once
    go(ck + "2", out + "2")
    again = {r.genome_id: r.rows for r in annotated(spark, out + "2", "genomes").collect()}
    assert again["split"] == last["split"][1] and again["bare"] == 0


def test_stream_predicts_genes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.fasta").write_text(f">one.1 x\n{dna(1, 15000)}\n>one.2 y\n{dna(51, 6000)}\n")
    annotate_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), fixed_order=2).awaitTermination()
    genes = annotated(spark, str(tmp_path / "out"))
    assert genes.count() > 0 and {r.genome_id for r in genes.select("genome_id").distinct().collect()} == {"one"}
