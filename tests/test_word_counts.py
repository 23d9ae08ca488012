"""Word counts of the Markov models against a direct count."""

from collections import Counter, defaultdict

from conftest import dna

from codonlake.operators import models, scoring


def test_word_counts_equal_a_direct_count(spark, monkeypatch):
    monkeypatch.setattr(models, "TILE", 50)
    monkeypatch.setattr(models, "COUNTED", 70)
    bound = {"a": 3, "b": 0, "c": 10}
    seqs, want = [], defaultdict(lambda: [0, 0.0])
    for i, (g, cls, held, s) in enumerate([("a", "coding", True, dna(1, 260)), ("a", "coding", False, dna(2, 131, "ACGTN")), ("a", "noncoding", True, dna(3, 50, "ACRN")),
                                           ("b", "coding", True, "AC"), ("b", "noncoding", False, dna(4, 101)), ("c", "coding", True, dna(5, 120, "ACGTTN")),
                                           ("c", "noncoding", False, ""), ("c", "coding", True, dna(5, 120, "ACGTTN")), ("c", "noncoding", False, "NNN")]):
        seqs.append((g, cls, held, str(i), i, s))
        for at, base in enumerate(s):
            raw = "".join(x if x in "ACGT" else "N" for x in s[max(0, at - bound[g]):at + 1])
            word = raw.rpartition("N")[2]
            if word:
                code = sum("ACGT".index(x) << 2 * j for j, x in enumerate(reversed(word)))
                cell = want[g, bound[g], cls, held, at % 3, len(word), code, "N" in raw]
                cell[0] += 1
                cell[1] += 1 / len(s) if cls == "coding" and held and len(s) >= 3 else 0.0
    marked = spark.createDataFrame(seqs, "genome_id string, cls string, held_out boolean, contig_id string, o3 long, sequence string")
    bounds = spark.createDataFrame(list(bound.items()), "genome_id string, bound int")
    got = models.word_counts(marked, bounds).collect()
    assert Counter(tuple(r)[:8] for r in got) == Counter(want.keys())
    for r in got:
        n, weight = want[tuple(r)[:8]]
        assert r["n"] == n and abs(r["weight"] - weight) < 1e-9


def test_units_and_model_copies_grow_with_the_genome_alone(spark):
    sizes = spark.createDataFrame([("s", 100, 10**6, 6), ("l", 10**8, 9 * 10**8, 10)], "genome_id string, bp_coding long, bp_noncoding long, bound int")
    units = {r.genome_id: r.u for r in sizes.select("genome_id", models.counting_units(sizes).alias("u")).collect()}
    assert units == {"s": 1, "l": 10}  # eight times the 12 * 4 ** 10 words of order 10 to a unit
    n = scoring.ORFS_PER_GROUP
    orfs = spark.range(6 * n).selectExpr("if(id < 2 * %d, 'few', 'many') AS genome_id" % n)
    rows = spark.range(4 * n).selectExpr("if(id < 10, 'few', 'many') AS genome_id")
    groups = {r.genome_id: r["_groups"] for r in scoring.genome_groups(orfs, rows).collect()}
    assert groups == {"few": 2, "many": 3}  # copies of a model have at most two rows per ORF, and one model
