import math
from collections import Counter
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from codonlake import constants as C
from codonlake.operators import models, orf, rbs, scoring, starts
from conftest import contigs_of, dna

SEQ_SCHEMA = "genome_id string, cls string, contig_id string, o1 int, o2 long, o3 long, o4 long, sequence string"


def seq_rows(genome, cls, seqs):
    return [(genome, cls, "c", 0, 0, i, 0, s) for i, s in enumerate(seqs)]


class PlainModel:
    """Counts and back-off written from the definition, one context at a time."""

    def __init__(self, seqs, order):
        self.n = Counter()
        for s in seqs:
            for i in range(len(s)):
                for k in range(min(i, order) + 1):
                    w = s[i - k:i + 1]
                    if set(w) <= set("ACGT"):
                        self.n[(i % 3, w)] += 1

    def logp(self, pos, word):
        for k in range(len(word)):
            w = word[k:]
            total = sum(self.n[(pos, w[:-1] + b)] for b in "ACGT")
            if total >= 10 and self.n[(pos, w)]:
                return math.log(max(self.n[(pos, w)] / total, 1e-10))
        return math.log(0.25)

    def score(self, other, s, order):
        total = 0.0
        for i in range(len(s)):
            w = s[max(0, i - order):i + 1]
            if set(w) <= set("ACGT"):
                total += self.logp(i % 3, w) - other.logp(i % 3, w)
        return total / len(s) if len(s) >= 3 else 0.0


def table_value(row, order, pos, word):
    size = len(word)
    t = (4 ** (order + 2) - 4) // 3
    at = pos * t + (4**size - 4) // 3 + int(word.translate(str.maketrans("ACGT", "0123")), 4)
    return row.markov_table[at]


@pytest.fixture(scope="module")
def training(spark):
    coding = ["ATG" + dna(i, 300, "ACGGT") + "TAA" for i in range(12)] + ["ATGN" + dna(50, 200)]
    noncoding = [dna(100 + i, 400, "AACGTT") for i in range(9)]
    df = spark.createDataFrame(seq_rows("g", "coding", coding) + seq_rows("g", "noncoding", noncoding)
                               + seq_rows("few", "coding", coding[:2]) + seq_rows("few", "noncoding", noncoding[:2])
                               + seq_rows("none", "coding", coding[:1]), SEQ_SCHEMA)
    return coding, noncoding, df


def test_markov_table_equals_the_definition(training):
    coding, noncoding, df = training
    row = models.model_arrays(models.model_bundle(df, 3)).where("genome_id = 'g'").first()
    a, b = PlainModel(coding, 3), PlainModel(noncoding, 3)
    for word in ("A", "T", "CG", "GGT", "ACGT", "TTTT", "CCCC", "GGGG"):
        for pos in range(3):
            assert abs(table_value(row, 3, pos, word) - (a.logp(pos, word) - b.logp(pos, word))) < 1e-12


def test_order_choice_equals_the_definition(training):
    coding, noncoding, df = training
    rows = {r.genome_id: r for r in models.model_heads(models.markov_models(df)).collect()}
    bp = min(sum(map(len, coding)), sum(map(len, noncoding)))
    bound = max(2, min(math.floor(math.log(bp / 10) / math.log(4)), 10))
    n_val, m_val = max(1, int(len(coding) * 0.2)), max(1, int(len(noncoding) * 0.2))
    a, b = PlainModel(coding[n_val:], bound), PlainModel(noncoding[m_val:], bound)
    scores = {k: sum(a.score(b, s, k) for s in coding[:n_val]) / n_val for k in range(2, bound + 1)}
    best = max(scores, key=lambda k: (scores[k], -k))
    assert (rows["g"].bound, rows["g"].markov_order) == (bound, best)
    assert abs(rows["g"].held_out_score - scores[best]) < 1e-9
    assert rows["few"].markov_order == rows["few"].bound  # too few sequences for a hold-out
    assert rows["none"].markov_order == 0  # no noncoding sequence at all


def test_codon_model_skips_only_n(spark):
    df = spark.createDataFrame(seq_rows("g", "coding", ["ATGNNNATGRTG", "ATGCC"]), SEQ_SCHEMA)
    got = {r.codon: (r.n, r.freq) for r in models.codon_model(df).collect()}
    assert got == {"ATG": (3, 0.75), "RTG": (1, 0.25)}
    ratio = {r.codon: r.log_ratio for r in models.codon_log_ratio(models.codon_model(df)).collect()}
    assert abs(ratio["ATG"] - (math.log(0.75) - math.log(1e-4))) < 1e-12


@pytest.mark.parametrize("order", [0, 2, 4])
def test_scores_equal_a_direct_sum(spark, training, order):
    coding, noncoding, df = training
    seqs = [("g", "a", dna(7, 4000)), ("g", "b", dna(8, 2500, "ACGTN")), ("g", "d", "ATG" * 60 + dna(9, 90) + "TAATAATAA")]
    contigs = contigs_of(spark, seqs)
    orfs = orf.scan_orfs(contigs, 30).persist()
    bundle = models.model_bundle(df, order).persist()
    got = {(r.contig_id, r.strand, r.start): r for r in scoring.model_scores(orfs, contigs, bundle).collect()}
    a, b = PlainModel(coding, order), PlainModel(noncoding, order)
    a.logp, b.logp = lru_cache(None)(a.logp), lru_cache(None)(b.logp)
    table = models.model_arrays(bundle).where("genome_id = 'g'").first().codon_table
    rows = orf.with_sequence(orfs, contigs).collect()
    assert len(rows) == len(got) > 50
    for r in rows:
        g = got[(r.contig_id, r.strand, r.start)]
        assert abs(g.imm_score - a.score(b, r.sequence, order)) < 1e-9
        codons = [r.sequence[i:i + 3] for i in range(0, len(r.sequence) - 2, 3)]
        values = [table[int(c.translate(str.maketrans("ACGT", "0123")), 4)] for c in codons if set(c) <= set("ACGT")]
        assert abs(g.codon_score - (sum(values) / len(values) if values else 0)) < 1e-9


def test_genome_without_model_scores_zero(spark, training):
    contigs = contigs_of(spark, [("unknown", "a", dna(7, 1500))])
    got = scoring.model_scores(orf.scan_orfs(contigs, 60), contigs, models.model_bundle(training[2], 2)).collect()
    assert got and all(r.imm_score == 0 and r.codon_score == 0 for r in got)


def test_z_scores(spark):
    rows = [("g", 1.0, 2.0, 5.0), ("g", 3.0, 2.0, 1.0), ("h", 4.0, 7.0, 0.0)]
    df = spark.createDataFrame(rows, "genome_id string, codon_score double, imm_score double, rbs_score double")
    df = df.withColumn("length_score", F.lit(0.0)).withColumn("start_score", F.lit(0.4))
    got = {(r.genome_id, r.codon_score): r for r in scoring.add_z_scores(df).collect()}
    assert got[("g", 1.0)].codon_score_norm == -1 and got[("g", 3.0)].codon_score_norm == 1
    assert got[("g", 1.0)].imm_score_norm == 0 and got[("h", 4.0)].codon_score_norm == 0
    assert scoring.add_z_scores(df).withColumn("c", scoring.weighted_sum(C.SCORE_WEIGHTS)).first().c is not None


KEYS = ("genome_id", "contig_id", "strand", "end", "start")


def scored_frame(spark, rows):
    cols = ", ".join(f"{c}_score_norm double" for c in C.COMPONENTS)
    return spark.createDataFrame(
        rows, "genome_id string, contig_id string, strand string, end long, start long, length_score double, "
              "codon_score double, imm_score double, combined_score double, " + cols)


def test_filter_is_strict_and_keeps_nulls(spark):
    t = {"codon": 0.2, "imm": 0.2, "length": 0.2, "combined": 0.5}
    z = (0.0,) * 5
    rows = [("g", "c", "forward", 1, i, *v, *z) for i, v in enumerate([
        (0.1, 0.1, 0.1, 0.9), (0.2, 0.1, 0.1, 0.9), (0.9, 0.9, 0.9, 0.49), (0.9, 0.9, 0.9, 0.5), (None, 0.1, 0.1, 0.9),
        (0.9, 0.9, 0.9, None)])]
    kept = {r.start for r in starts.filter_candidates(scored_frame(spark, rows), t).collect()}
    assert kept == {1, 3, 4, 5}


def test_start_choice_and_contest(spark):
    s = (0.0, 0.0, 0.0, 0.0)
    rows = [("g", "c", "forward", 100, 1, *s, 1.0, 0.0, 0.0, 0.0, 0.0), ("g", "c", "forward", 100, 10, *s, 1.0, 0.0, 0.0, 0.0, 0.0),
            ("g", "c", "forward", 100, 19, *s, 0.0, 0.0, 0.0, 0.0, 0.0), ("g", "c", "reverse", 100, 4, *s, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = scored_frame(spark, rows)
    best = {(r.strand, r.end): r.start for r in starts.best_starts(df).collect()}
    assert best == {("forward", 100): 1, ("reverse", 100): 4}  # first start among equals; singles pass
    two = {r.strand: r for r in starts.top_two(df).collect()}
    assert (two["forward"].start_1, two["forward"].start_2, two["forward"].gap) == (1, 10, 0.0)
    assert (two["reverse"].start_2, two["reverse"].gap) == (None, 999.0)
    settled = starts.settle_contest(starts.top_two(df).withColumn("prob_keep", F.lit(0.1)))
    assert {r.strand: r.chosen_start for r in settled.collect()} == {"forward": 10, "reverse": 4}
    kept = starts.settle_contest(starts.top_two(df).withColumn("prob_keep", F.lit(0.3)))
    assert {r.strand: r.chosen_start for r in kept.collect()} == {"forward": 1, "reverse": 4}
    warm = starts.settle_contest(starts.top_two(df).withColumn("prob_keep", F.lit(0.1)), temperature=3.0)
    assert {r.strand: r.chosen_start for r in warm.collect()}["forward"] == 1


def test_shards_of_the_trie_equal_the_trie_in_one(monkeypatch):
    pa = pytest.importorskip("pyarrow")
    texts = [(True, False, dna(1, 900)), (True, True, dna(2, 700, "ACGTTN")), (False, False, dna(3, 1500, "AACGT")), (False, True, "AC"), (True, True, dna(4, 400))]
    rows = [("g", 4, "coding" if c else "noncoding", held, 0, 0, 1 / len(s) if c and held else 0.0, s.encode()) for c, held, s in sorted(texts)]
    types = pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.float64(), pa.binary()
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["genome_id", "bound", "cls", "held_out", "skip", "phase", "weight", "bases"])

    def trie(sharded_from):
        monkeypatch.setattr(models, "SHARDED_FROM", sharded_from)
        parts = [r for b in models._words_of([batch]) for r in b.to_pylist()]
        values, scores = {}, Counter()
        for pos in range(3):
            for shard in range(16 if sharded_from <= 4 else 1):
                mine = [r for r in parts if (r["pos"], r["shard"]) == (pos, shard)] + [{"bound": 4, "words": None, "counts": None, "weights": None}]
                for r in models._shard_of_trie("g", pos, shard, pa.Table.from_pylist(mine), True).to_pylist():
                    if r["order"] is not None:
                        scores[r["order"]] += r["score"]
                    else:
                        for i, ratio in enumerate(r["ratios"]):
                            cell = pos, r["size"], (i // 4 << 2 * r["tail"] | r["shard"]) * 4 + i % 4
                            assert cell not in values
                            values[cell] = ratio
        return values, scores

    whole, sharded = trie(9), trie(4)
    assert whole[0] == sharded[0] and len(whole[0]) == 3 * (4 ** 6 - 4) // 3
    assert set(whole[1]) == set(sharded[1]) == {2, 3, 4} and all(abs(whole[1][k] - sharded[1][k]) < 1e-9 for k in whole[1])
    coding, noncoding = [[s for c, _, s in texts if c == side] for side in (True, False)]
    a, b = PlainModel(coding, 4), PlainModel(noncoding, 4)
    for (pos, size, code), ratio in sharded[0].items():
        word = "".join("ACGT"[code >> 2 * j & 3] for j in reversed(range(size)))
        assert abs(ratio - (a.logp(pos, word) - b.logp(pos, word))) < 1e-12


def test_repeated_places_are_held_out_to_the_number(spark):
    rows = seq_rows("g", "coding", ["ACGT"] * 4) + [("g", "coding", "c", 0, 0, 9, 0, "ACG")] * 6 + seq_rows("g", "noncoding", ["A"] * 3)
    for copies, held in ((rows, {"coding": 2, "noncoding": 1}), ([r[:5] + (9,) + r[6:] for r in rows], {"coding": 2, "noncoding": 1})):
        marked = models.mark_held_out(spark.createDataFrame(copies, SEQ_SCHEMA))
        assert {r.cls: r.n for r in marked.where("held_out").groupBy("cls").agg(F.count("*").alias("n")).collect()} == held


def test_codons_with_other_letters_are_counted_by_name(spark):
    df = spark.createDataFrame(seq_rows("g", "coding", ["ATGRTGRTGNNAACGT", "ÄTGATG", "AC", ""]), SEQ_SCHEMA)
    assert {(r.codon, r.n) for r in models.codon_counts(df).collect()} == {("ATG", 2), ("RTG", 2), ("ACG", 1), ("ÄTG", 1)}
