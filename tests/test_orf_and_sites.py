from pyspark.sql import functions as F

from codonlake import constants as C
from codonlake.operators import orf, rbs
from conftest import contigs_of, dna, plain_orfs, revcomp


def body(n):
    return "ATG" + "GGG" * n + "TAA"


GOLDEN = {
    "single": ("C" * 30 + body(48) + "C" * 120, {("forward", 31, 180)}),
    "none": ("C" * 500, set()),
    "reverse": (revcomp("C" * 60 + body(91) + "C" * 61), {("reverse", 61, 339)}),
    "multi": (body(48) + "C" * 150 + body(58) + "C" * 120 + body(48) + "C" * 150 + body(64) + "C" * 102
              + body(48) + "C" * 650,
              {("forward", 1, 150), ("forward", 301, 480), ("forward", 601, 750), ("forward", 901, 1098),
               ("forward", 1201, 1350)}),
    "large": (("C" * 300).join(body(98) for _ in range(8)) + "C" * 500,
              {("forward", 600 * k + 1, 600 * k + 300) for k in range(8)}),
}


def test_golden_coordinates(spark):
    rows = orf.scan_orfs(contigs_of(spark, [("g", k, s) for k, (s, _) in GOLDEN.items()])).collect()
    for name, (_, expected) in GOLDEN.items():
        assert {(r.strand, r.start, r.end) for r in rows if r.contig_id == name} == expected, name
    r = next(r for r in rows if r.contig_id == "reverse")
    assert (r.genome_start, r.genome_end, r.frame) == (62, 340, 0)


def test_scan_equals_direct_search(spark):
    seqs = [("g", str(i), dna(i, n, "ACGTN" if i % 2 else "ACGT")) for i, n in enumerate((0, 2, 3, 700, 900, 1500))]
    seqs.append(("g", "tiles", dna(99, 2 * orf.CHUNK + 50)))
    rows = orf.scan_orfs(contigs_of(spark, seqs), 30).collect()
    for _, name, s in seqs:
        got = {(r.strand, r.start, r.end, r.frame, r.start_codon) for r in rows if r.contig_id == name}
        assert got == plain_orfs(s, 30), name
    for r in rows:
        s = dict((n, q) for _, n, q in seqs)[r.contig_id]
        strand = s if r.strand == "forward" else revcomp(s)
        assert r.upstream == strand[max(0, r.start - 20):r.start]


def test_sequences_and_upstream(spark):
    s = dna(5, 1200)
    contigs = contigs_of(spark, [("g", "c", s)])
    orfs = orf.with_upstream(orf.with_sequence(orf.scan_orfs(contigs, 40), contigs), contigs, 25, "up")
    rows = orfs.collect()
    assert rows
    for r in rows:
        strand = s if r.strand == "forward" else revcomp(s)
        assert r.sequence == strand[r.start - 1:r.end]
        assert r.up == strand[max(0, r.start - 26):r.start - 1]


def plain_site(window):
    """Best (score, start, length, motif) of a window padded to 20."""
    w = window.rjust(20, "-")
    best = None
    for start in range(20):
        for size in range(4, 9):
            spacing = 20 - start - size
            word = w[start:start + size]
            if not 4 <= spacing <= 12 or set(word) - set("ACGT"):
                continue
            purine = sum(x in "AG" for x in word) / size
            if purine < 0.6:
                continue
            value = 3.0 if 6 <= spacing <= 8 else 2.5 if 5 <= spacing <= 10 else 1.5
            sims = [(max(sum(a == b for a, b in zip(word, m[k:])) for k in range(len(m))) * len(m) / 6, -i, m)
                    for i, m in enumerate(C.RBS_MOTIFS)]
            sim, _, motif = max(sims)
            score = 2 * value + 1.5 * sim + 2 * (purine - 0.6)
            if best is None or score > best[0] + 1e-9:
                best = (score, start, size, motif, spacing, word)
    return best


def test_sites_equal_direct_search(spark):
    windows = [dna(i, 20, "AGAGCT" if i % 3 else "ACGTN") for i in range(150)] + [dna(7, k) for k in range(1, 20)] + ["C" * 20]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(windows)], "n int, upstream string")
    scores = {r.n: r.rbs_score for r in rbs.add_rbs_score(rows).collect()}
    sites = {r.n: r for r in rbs.best_sites(rows, ["n"]).collect()}
    for i, w in enumerate(windows):
        expected = plain_site(w)
        if expected is None:
            assert scores[i] == C.RBS_NONE_SCORE and i not in sites
            continue
        assert abs(scores[i] - expected[0]) < 1e-9
        s = sites[i]
        assert (s.rbs_position, len(s.rbs_sequence), s.rbs_motif, s.rbs_spacing, s.rbs_sequence) == expected[1:]


def test_site_word_table_has_a_fixed_size(spark):
    assert rbs.site_words(spark).count() <= sum(4**k for k in range(4, 9))


def test_chunks_give_the_same_orfs(spark):
    seqs = [("g", "a", dna(5, 1500)), ("g", "b", "ATG" + "GCC" * 300 + "TAA" + dna(6, 200)), ("h", "n", dna(7, 400, "ACGTN")), ("h", "x", "AT"),
            ("h", "y", "ATG"), ("h", "z", "")]
    contigs = contigs_of(spark, seqs)
    for size in (3, 64, 700):
        rows = orf.scan_orfs(contigs, 30, size).collect()
        for g, c, s in seqs:
            mine = [r for r in rows if r.contig_id == c]
            assert {(r.strand, r.start, r.end, r.frame, r.start_codon) for r in mine} == plain_orfs(s, 30)
            for r in mine:
                strand = s if r.strand == "forward" else revcomp(s)
                assert r.upstream == strand[max(0, r.start - 20):r.start]


def test_one_contig_spans_several_tasks(spark):
    contigs = contigs_of(spark, [("g", "c", "ATG" + "GCA" * 20000 + "TGA" + dna(8, 40000))])
    marks = orf.codon_marks(contigs, 2000).select("chunk", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r.task for r in marks}) > 2 and len({r.chunk for r in marks}) > 20
    longest = orf.scan_orfs(contigs, 60000, 2000).collect()
    assert [(r.strand, r.start, r.end) for r in longest] == [("forward", 1, 60006)]


def test_scan_moves_the_bases_once(spark):
    scan = orf.scan_orfs(contigs_of(spark, [("g", "c", dna(1, 300))]))
    scan.collect()
    plan = scan._jdf.queryExecution().executedPlan().toString()
    final = plan[:plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert len([x for x in final.splitlines() if "REPARTITION_BY_COL" in x]) == 1


def test_scan_and_sites_neither_sort_codons_nor_copy_rows_per_place(spark):
    found = rbs.add_rbs_score(orf.scan_orfs(contigs_of(spark, [("g", "c", dna(3, 900, "ACGTN"))]), 30))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and not any(f"explode({x}" in plan for x in ("sequence(lo", "sequence(cast(lo"))
    top = plan[:plan.index("MapInArrow _orfs_within") if "MapInArrow _orfs_within" in plan else plan.rindex("MapInArrow")]
    assert not any(x in top for x in ("Window", "Generate", "Aggregate", "Join"))  # windows remain on carries, a row per chunk
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "AGGAGGÄTTTTTTTTTTTTT"), (4, "C" * 3 + "AGGAGGTTTTTTTTTTTTTTTTTTT")], "n int, upstream string")
    scores = {r.n: r.rbs_score for r in rbs.add_rbs_score(odd).collect()}
    best = {r.n: r.rbs_score for r in rbs.best_sites(odd, ["n"]).collect()}
    assert scores == {n: best.get(n, -5.0) for n in (1, 2, 3, 4)}
