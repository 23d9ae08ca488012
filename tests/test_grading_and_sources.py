import gzip
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codonlake import constants as C
from codonlake.operators import descent, diagnostics as D, grading as G, labels, sweeps
from codonlake.sources import catalog, fasta, gff, store
from conftest import contigs_of, dna

GFF = "##gff-version 3\nNC_TEST\t.\tCDS\t100\t300\t.\t+\t0\t.\nNC_TEST\t.\tCDS\t500\t700\t.\t+\t0\t.\nNC_TEST\t.\tCDS\t900\t1100\t.\t-\t0\t.\n"
COORD = "genome_id string, contig_id string, genome_start long, genome_end long"


@pytest.fixture(scope="module")
def ref(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("gff") / "NC_000001.1.gff"
    path.write_text(GFF)
    return gff.reference_cds(gff.read_gff(spark, str(path)))


def preds(spark, *pairs):
    return spark.createDataFrame([("NC_000001.1", "NC_TEST", a, b) for a, b in pairs], COORD)


def test_exact_and_tolerance_counts(spark, ref):
    rows = ref.collect()
    assert {(r.genome_start, r.length, r.strand) for r in rows} == {(100, 201, "forward"), (500, 201, "forward"), (900, 201, "reverse")}
    m = lambda p: G.exact_metrics(p, ref).first()
    a = m(preds(spark, (100, 300), (500, 700), (900, 1100)))
    assert (a.tp, a.fp, a.fn, a.f1) == (3, 0, 0, 1.0)
    b = m(preds(spark, (100, 300), (500, 700), (9999, 10000)))
    assert (b.tp, b.fp, b.fn) == (2, 1, 1)
    n = G.exact_metrics(preds(spark).limit(0), ref).first()
    assert (n.tp, n.sensitivity, n.precision, n.f1) == (0, 0, 0, 0)
    assert m(preds(spark, (100, 300), (100, 300))).tp == 2  # duplicates count as rows
    moved = preds(spark, (103, 300), (500, 700), (900, 1100))
    assert m(moved).tp == 2
    t = G.tolerance_metrics(moved, ref, 3, 0).first()
    assert (t.tp, t.fn, t.matched_refs) == (3, 0, 3)
    assert G.tolerance_metrics(preds(spark, (100, 305), (500, 700), (900, 1100)), ref, 0, 5).first().tp == 3
    twice = G.tolerance_metrics(preds(spark, (99, 300), (101, 300), (500, 700), (900, 1100)), ref, 2, 2).first()
    assert (twice.tp, twice.fn, twice.matched_refs) == (4, -1, 3)


def test_tolerance_equals_all_pairs(spark):
    r = random.Random(1)
    p = [(r.randint(1, 3000), r.randint(3001, 3040)) for _ in range(150)]
    q = [(r.randint(1, 3000), r.randint(3001, 3040)) for _ in range(150)]
    for a, b in ((0, 0), (1, 5), (7, 3)):
        got = G.tolerance_metrics(preds(spark, *p), preds(spark, *q), a, b).first()
        assert got.tp == sum(any(abs(x[0] - y[0]) <= a and abs(x[1] - y[1]) <= b for y in q) for x in p)


def test_batch_report_flags(spark):
    rows = [("NC_A", "P", .85, .90, .874), ("NC_B", "P", .80, .88, .838), ("NC_C", "Archaea", .35, .60, .441),
            ("NC_D", "F", .75, .82, .784), ("NC_E", "F", .78, .85, .814), ("NC_F", "F", .72, .80, .758)]
    df = spark.createDataFrame(rows, "genome_id string, tax_group string, sensitivity double, precision double, f1 double")
    rep = {(r.level, r.key): r for r in G.batch_report(df.drop("tax_group"), df.select("genome_id", "tax_group")).collect()}
    assert abs(rep[("group", "P")].f1 - 85.6) < 1e-9 and abs(rep[("overall", "all")].f1 - sum(r[4] for r in rows) / 6 * 100) < 1e-9
    assert rep[("group", "Archaea")].flag_low_f1 and not rep[("group", "P")].flag_low_f1 and rep[("group", "F")].flag_small


def test_missed_gene_reasons(spark):
    orf = "ATG" + "GGG" * 40 + "TAA"
    seq = "C" * 100 + orf + "C" * 100 + orf[3:] + "C" * 200
    contigs = contigs_of(spark, [("g", "c", seq)])
    genes = [(101, 226, "ok"), (101, 180, "too_short"), (104, 226, "no_start_codon"), (101, 223, "no_stop_codon"), (327, 449, "no_start_codon")]
    ref = spark.createDataFrame([("g", "c", a, b, "forward") for a, b, _ in genes], COORD + ", strand string")
    found = ref.where("genome_start = 101 and genome_end = 226")
    got = {(r.genome_start, r.genome_end): r.reason for r in D.missed_genes(ref, found, contigs).collect()}
    assert got == {(a, b): k for a, b, k in genes if k != "ok"}
    all_missed = {(r.genome_start, r.genome_end): r.reason for r in D.missed_genes(ref, found.limit(0), contigs).collect()}
    assert all_missed[(101, 226)] == "overlapping"


def test_regressions_of_the_last_two_runs(spark, tmp_path):
    row = lambda f1: spark.createDataFrame([("a", f1), ("b", 0.5)], "genome_id string, f1 double")
    for run, f1 in (("r1", 0.1), ("r2", 0.9), ("r3", 0.8)):
        G.append_run(row(f1), run, str(tmp_path / "log"))
    got = G.regressions(spark.read.parquet(str(tmp_path / "log"))).collect()
    assert [(r.genome_id, round(r.delta_pp, 6)) for r in got] == [("a", -10.0)]


def test_best_threshold_with_ties(spark):
    r = random.Random(2)
    rows = [(round(r.random(), 1), int(r.random() < 0.4)) for _ in range(400)]
    got = sweeps.best_f1_threshold(spark.createDataFrame(rows, "prob double, label int"), "prob", "label").first()
    def f1(t):
        tp = sum(l for p, l in rows if p >= t)
        called = sum(p >= t for p, _ in rows)
        return 2 * tp / (called + sum(l for _, l in rows))
    best = max(sorted({p for p, _ in rows}), key=lambda t: (round(f1(t), 12), -t))
    assert got.threshold == best and abs(got.f1 - f1(best)) < 1e-12


def test_temperature_and_descent(spark):
    r = random.Random(3)
    logit = [r.gauss(0, 2) for _ in range(2000)]
    rows = [(1 / (1 + math.exp(-z)), int(r.random() < 1 / (1 + math.exp(-z / 2)))) for z in logit]
    assert 1.5 < sweeps.fit_temperature(spark.createDataFrame(rows, "prob double, label int"), "prob", "label") < 2.7
    norms = ", ".join(f"{c}_score_norm double" for c in C.COMPONENTS)
    groups = []
    for g in range(60):
        true = r.randint(0, 2)
        groups += [("g", "c", "forward", g, s, int(s == true), *[float(s == true) + r.gauss(0, 1) if c == "codon" else r.gauss(0, 1)
                                                              for c in C.COMPONENTS]) for s in range(3)]
    df = spark.createDataFrame(groups, "genome_id string, contig_id string, strand string, end long, start long, is_true int, " + norms).persist()
    start = {c: 1.0 for c in C.COMPONENTS}
    weights, loss = sweeps.descend(df, start, rounds=6)
    assert loss < sweeps.softmax_loss(df, start).first().loss and abs(max(weights.values()) - 1.0) < 1e-9
    eps, base = 1e-5, sweeps.softmax_loss(df, start).first()
    up = sweeps.softmax_loss(df, {**start, "codon": 1 + eps}).first()
    assert abs((up.loss - base.loss) / eps - base.grad_codon) < 1e-3
    ci = sweeps.bootstrap_delta(df, {**start, "codon": 0.0}, {**start, "codon": 10.0}, 200).first()
    assert ci.low <= ci.mean_delta <= ci.high and ci.verdict in ("improvement", "no difference")

    vectors = np.random.default_rng(1).uniform(0.01, 20.0, (200, len(C.COMPONENTS))) ** 0.5
    rows = descent.group_rows(df).persist()
    loss, grad = descent.losses(rows, vectors)
    for i in (0, 7):
        one = sweeps.softmax_loss(df, dict(zip(C.COMPONENTS, vectors[i]))).first()
        assert abs(one.loss - loss[i]) < 1e-9 and all(abs(one[f"grad_{c}"] - grad[i, k]) < 1e-9 for k, c in enumerate(C.COMPONENTS))
    found = descent.descend_all(df, descent.starting_points(start)).collect()
    assert len(found) == 12 and all(r.loss < r.start_loss for r in found)
    assert max(r.loss for r in found) - min(r.loss for r in found) < 1e-5  # one minimum, whatever the start
    assert all(r.loss <= loss.min() + 1e-9 and 0.01 <= r[c] <= 20 for r in found for c in C.COMPONENTS)
    best = np.array([found[0][c] for c in C.COMPONENTS])
    near = np.clip(np.concatenate([best + s * np.eye(len(best)) for s in (-0.05, 0.05, -0.5, 0.5)]), 0.01, 20)
    assert descent.losses(rows, near)[0].min() >= found[0].loss - 1e-7
    none = descent.descend_all(df.where("false"), {"base": start}).collect()
    assert [(r.point, r.loss) for r in none] == [("base", 0.0)]


def test_bootstrap_sums_equal_single_draws(spark):
    diff = [("g", "c", "forward", i, d) for i, d in enumerate([1, 0, -1, 0, 1, 1])]
    got = {r.replicate: (r.d, r.n) for r in sweeps.bootstrap_sums(
        spark.createDataFrame(diff, "genome_id string, contig_id string, strand string, end long, d int").repartition(3), 20, 7).collect()}
    limits = sweeps.poisson_limits()
    assert abs(sum(65536 - x for x in limits) / 65536 - 1) < 1e-3  # the mean number of draws
    for k in range(20):
        times = []
        for g, c, s, e, _ in diff:
            h = hashlib.md5(f"7:{g}:{c}:{s}:{e}:{k // 8}".encode()).hexdigest()
            times.append(sum(x <= int(h[4 * (k % 8):4 * (k % 8) + 4], 16) for x in limits))
        assert got[k + 1] == (sum(t * r[4] for t, r in zip(times, diff)), sum(times))


def test_deep_pages_read_their_partitions_only(spark):
    rows = spark.range(5000).selectExpr("id", "id * 7919 % 1000 AS v", "CAST(id AS string) AS s").repartition(5)
    order = [F.col("v").desc(), F.col("id")]
    plain = [r.id for r in rows.orderBy(*order).collect()]
    index = gff.page_index(rows, order, 16)
    assert index.total == 5000 and len(index.counts) > 8
    for number, size in ((1, 10), (37, 100), (50, 100), (51, 100), (3, 1700), (100, 7)):
        got = index.page(number, size)
        assert [r.id for r in got.collect()] == plain[(number - 1) * size:number * size] and got.columns == rows.columns
    plan = index.page(100, 7)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_part#\d+ = \d+", plan)  # one partition
    assert gff.page_index(rows.where("false"), order).page(1, 5).count() == 0


def test_splits(spark):
    g = spark.createDataFrame([(f"g{i}", "ab"[i % 2]) for i in range(20)], "genome_id string, tax_group string")
    rows = labels.stratified_genome_split(g, 2, 2, 7).collect()
    for t in "ab":
        n = {s: sum(r.split == s and r.tax_group == t for r in rows) for s in ("train", "val", "test")}
        assert n == {"train": 7, "val": 1, "test": 2}
    assert labels.limit_per_group(g, 3, 1).count() == 6
    orfs = spark.range(300).selectExpr("'g' genome_id", "'c' contig_id", "'forward' strand", "id % 50 AS end", "id AS start", "int(id % 3 = 0) label")
    parts = labels.group_split(orfs, 0.3, 1).groupBy("end").agg(F.count_distinct("split").alias("n")).where("n > 1")
    assert parts.count() == 0
    shares = labels.label_split(orfs, 0.25, 1, ["start"]).groupBy("label").agg(F.avg((F.col("split") == "test").cast("int")).alias("s"))
    assert all(abs(r.s - 0.25) < 0.02 for r in shares.collect())


def test_fasta_many_records_gzip_and_write(spark, tmp_path):
    text = ">NC_1.1 first > record\nACGT\nacgtn\n>NC_2.1\r\nTTTT\r\n"
    (tmp_path / "g1.fna").write_text(text)
    with gzip.open(tmp_path / "g2_predictions.fasta.gz", "wt") as f:
        f.write(">X only\nAC GT\n")
    rows = {r.contig_id: r for r in fasta.read_fasta(spark, [str(tmp_path / "g1.fna"), str(tmp_path / "g2_predictions.fasta.gz")]).collect()}
    assert (rows["NC_1.1"].seq, rows["NC_1.1"].description, rows["NC_1.1"].genome_id) == ("ACGTACGTN", "first > record", "g1")
    assert rows["NC_2.1"].seq == "TTTT" and rows["X"].genome_id == "g2" and rows["X"].length == 4
    c = contigs_of(spark, [("g", "a", dna(1, 333)), ("g", "b", "")])
    fasta.write_fasta(c, str(tmp_path / "out"))
    back = {r.contig_id: r.seq for r in fasta.read_fasta(spark, str(tmp_path / "out") + "/*/*").collect()}
    assert back["a"] == dna(1, 333)
    ok = spark.createDataFrame([("NC_000913.3",), ("NC_1.1",), ("x",)], "g string").where(fasta.gradable(F.col("g"))).collect()
    assert [r.g for r in ok] == ["NC_000913.3"]
    assert fasta.alphabet_report(contigs_of(spark, [("g", "a", "ACJGXJ")])).first().invalid_letters == "JX"


def test_gff_fallback_attributes_and_results(spark, tmp_path):
    (tmp_path / "a.gff").write_text("#x\nc\t.\tgene\t1\t9\t.\t+\t.\tID=1;gene_biotype=tRNA;gbkey=Gene\nc\t.\tgene\t1\t9\t.\t+\t.\tgbkey=Gene\nc\t.\texon\t2\t9\t.\t+\t.\tID=2\n")
    (tmp_path / "b.gff").write_text("c\t.\texon\t5\t9\t.\t+\t.\tID=2\nc\t.\ttRNA\t7\t9\t.\t-\t.\t.\n")
    (tmp_path / "d.gff").write_text(GFF + "NC_TEST\t.\tgene\t1\t2\t.\t+\t0\t.\n")
    g = gff.read_gff(spark, str(tmp_path / "*.gff"))
    got = {(r.genome_id, r.genome_start) for r in gff.reference_intervals(g).collect()}
    assert got == {("a", 1), ("b", 5), ("b", 7), ("d", 100), ("d", 500), ("d", 900)}
    assert {r.genome_id for r in gff.reference_intervals(g, fallback=False).collect()} == {"d"}
    assert {(r.genome_id, r.biotype): r.n for r in gff.biotype_counts(g).collect()} == {("a", "tRNA"): 1, ("a", "Gene"): 1, ("d", "unknown"): 1}
    m = spark.createDataFrame([("ID=1;Note=a=b;ID=2;bare",)], "a string").select(gff.attribute_map(F.col("a")).alias("m")).first().m
    assert m == {"ID": "1", "Note": "a"}
    (tmp_path / "r_predictions.gff").write_text("# c\n\nc\ts\tCDS\t1\t30\t.\nc\ts\tCDS\tx\t30\nc\ts\tCDS\t1\nc\ts\tCDS\t1\t30\t.\n")
    r = gff.read_predictions(spark, str(tmp_path / "r_predictions.gff")).collect()
    assert [(x.genome_id, x.genome_start, x.genome_end) for x in r] == [("r", 1, 30)]


def test_gff_and_csv_output(spark, tmp_path):
    p = spark.createDataFrame([("g", "c", 30, 60, 31, "reverse", 1.5, 2.25), ("g", "c", 1, 20, 20, "forward", 0.5, 0.0)],
                              COORD + ", length long, strand string, combined_score double, rbs_score double")
    gff.write_gff(p, str(tmp_path / "gff"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "gff")).collect()]
    assert lines == ["##gff-version 3", "c\tcodonlake\tCDS\t1\t20\t0.500\t+\t0\tID=gene_1;rbs_score=0.00;combined_score=0.50",
                     "c\tcodonlake\tCDS\t30\t60\t1.500\t-\t0\tID=gene_2;rbs_score=2.25;combined_score=1.50"]
    gff.write_csv(p, str(tmp_path / "csv"))
    rows = spark.read.csv(str(tmp_path / "csv"), header=True).collect()
    assert {r["Gene ID"]: r["RBS Score"] for r in rows} == {"gene_1": "N/A", "gene_2": "2.25"}
    assert [r.genome_start for r in gff.page(p, [F.col("length").desc()], 2, 1).collect()] == [1]


def test_catalog_and_batches(spark, tmp_path):
    c = catalog.catalog(spark)
    assert c.count() == 100 and c.select("accession").distinct().count() == 99
    assert [r.accession for r in catalog.duplicate_accessions(c).collect()] == ["NC_013235.1"]
    assert catalog.by_id(c, 1).first().accession == "NC_000913.3" and catalog.by_group(c, "Archaea").count() == 25
    assert catalog.by_accession(c, "NC_000913.3").count() == 1 and catalog.holdout(spark).count() == 20
    assert catalog.holdout_leaks(catalog.holdout(spark), c).count() == 0
    lines = [spark.createDataFrame([(x,) for x in part], "line string") for part in (["# note", "b", "a", ""], ["a", "zz", "c"])]
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "genome_id string")
    got = store.batch_list(lines, known).orderBy("list_no", "line_no").collect()
    assert [(r.genome_id, r.status) for r in got] == [("b", "queued"), ("a", "queued"), ("zz", "missing"), ("c", "queued")]
    contigs = contigs_of(spark, [("ok", "c", "ACGT"), ("bad", "c", "AC-T"), ("none", "c", "ACGT")])
    genes = spark.createDataFrame([("ok",)], "genome_id string")
    st = store.genome_status(contigs, genes)
    assert {r.genome_id: r.status for r in st.collect()} == {"ok": "ok", "bad": "bad_input", "none": "no_genes"}
    assert {r.status: r.genomes for r in store.batch_summary(st).collect()} == {"ok": 1, "bad_input": 1, "no_genes": 1}
