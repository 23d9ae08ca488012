import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codonlake import constants as C
from codonlake.functions import protein as P, sequence as S, upstream as U
from codonlake.operators import features, labels, models, orf, rbs, scoring
from codonlake.plans import predict
from conftest import contigs_of, dna, revcomp

CODONS = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"]
TABLE = dict(zip(CODONS, C.AMINO_ACIDS_T11))


def plain_translate(s):
    out = ""
    for i in range(0, len(s) - 2, 3):
        aa = TABLE.get(s[i:i + 3], "X")
        if aa == "*":
            break
        out += aa
    return out


def entropy(items):
    n = len(items)
    return -sum(k / n * math.log2(k / n) for k in Counter(items).values())


SEQS = ["ATGAAACCCGGGTTTTTTGGGAAATAA", "", "AT", "ATGNNNTAG", "GTG" + dna(3, 300) + "TGA", "TTG" + dna(4, 301, "ACGTN"), "A" * 40,
        "ACGT" * 10]


def test_sequence_functions(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SEQS)], "i int, s string")
    s = F.col("s")
    cols = {
        "gc": S.gc_content(s), "gc3": S.gc3_content(s), "enc": S.codon_diversity(s), "cbi": S.codon_bias_index(s),
        "hair": S.hairpin_near_stop(s), "prot": P.translate_to_stop(s), "gskew": S.gc_skew(s), "askew": S.at_skew(s),
        "pur": S.purine_fraction(s), "rc": S.reverse_complement(s), "ent": P.amino_acid_entropy(P.translate_to_stop(s)),
        "period": U.gc_periodicity(s), "bad": F.array_join(S.invalid_letters(F.concat(s, F.lit("Jq!J"))), ""),
        **P.protein_features(P.translate_to_stop(s)), **P.n_terminal_shares(s), "kmers": S.kmer_words(s, 3),
    }
    for r in df.select("i", "s", *[c.alias(k) for k, c in cols.items()]).collect():
        q, n = r.s, len(r.s)
        near = lambda a, b: abs(a - b) < 1e-9
        share = lambda x, letters: sum(ch in letters for ch in x) / len(x) if x else 0.0
        assert near(r.gc, share(q, "GC")) and near(r.pur, share(q, "AG")) and r.rc == revcomp(q)
        g, c = q.count("G"), q.count("C")
        assert near(r.gskew, (g - c) / (g + c) if g + c else 0)
        words = [q[i:i + 3] for i in range(0, n - 2, 3) if "N" not in q[i:i + 3]]
        assert near(r.gc3, share([w[2] for w in words], "GC")) and near(r.enc, len(set(words)) / len(words) if words else 0)
        h = -sum(k / len(words) * math.log2(k / len(words) + 1e-10) for k in Counter(words).values()) if words else 0
        assert near(r.cbi, 1 - h / math.log2(61) if words else 0)
        tail = q[-30:]
        same = sum(a == b for a, b in zip(tail, revcomp(tail)))
        assert r.hair == (1.0 if n >= 30 and same / 30 > 0.6 else 0.0)
        p = plain_translate(q)
        assert r.prot == p
        kd = [C.HYDROPATHY.get(a, 0.0) for a in p]
        mean = sum(kd) / len(kd) if kd else 0
        assert near(r.hydrophobicity_mean, mean)
        assert near(r.hydrophobicity_std, math.sqrt(sum((x - mean) ** 2 for x in kd) / len(kd)) if len(kd) > 1 else 0)
        for name, letters in (("charge_mean", "DEKR"), ("aromatic_fraction", "FYW"), ("small_fraction", "AGSTCV"), ("polar_fraction", "STNQY")):
            assert near(r[name], share(p, letters))
        assert near(r.ent, entropy(p) if len(p) >= 10 else 999.0)
        head = [TABLE.get(q[i:i + 3], "X") for i in range(0, min(15, n - 2), 3)]
        head = [a for a in head if a != "*"]
        assert near(r.nterm_charged_pos, share(head, "KRH")) and near(r.nterm_hydrophobic, share(head, "ACGILMFPWVY"))
        assert r.bad == "!JQ" and r.kmers == [q[i:i + 3] for i in range(n - 2)]


def plain_anti_sd(up):
    tail, pair = C.ANTI_SD, {"A": "U", "U": "A", "G": "C", "C": "G"}
    m = up.replace("T", "U")
    best = 0.0
    for i in range(len(m) - 12):
        if 4 <= len(m) - i - 13 <= 14:
            score = 0.0
            for a, b in zip(tail, reversed(m[i:i + 13])):
                score += 1.0 if pair[a] == b else 0.5 if {a, b} == {"G", "U"} else 0.0
            best = max(best, score / 13)
    return best


def test_upstream_functions(spark):
    ups = [dna(i, 25, "AGGGACT") for i in range(40)] + [dna(i, i) for i in range(25)] + [dna(3, 300, "ACGTN")]
    df = spark.createDataFrame([(u,) for u in ups], "u string")
    u = F.col("u")
    for r in df.select("u", U.spacer_score(u).alias("sp"), U.gc_position_bias(u).alias("gb"), U.anti_sd_pairing(u).alias("an"),
                       U.stop_distance(u).alias("st")).collect():
        q = r.u
        best = 0.0
        for m in C.SD_MOTIFS:
            at = q.rfind(m)
            if at >= 0 and 4 <= len(q) - at - len(m) <= 12:
                best = max(best, len(m) / 7)
        assert abs(r.sp - best) < 1e-12 and abs(r.an - plain_anti_sd(q)) < 1e-12
        shares = [[q[i + p] in "GC" for i in range(0, len(q) - 2, 3)] for p in range(3)]
        a, b, c = [sum(x) / len(x) if x else 0 for x in shares]
        assert abs(r.gb - (abs(c - (a + b) / 2) if len(q) >= 9 else 0)) < 1e-12
        stops = [j for j in range(len(q) - 2) if q[j:j + 3] in C.STOP_CODONS]
        assert r.st == (len(q) - max(stops) if stops else len(q))


@pytest.fixture(scope="module")
def small_run(spark):
    contigs = contigs_of(spark, [("g", str(k), dna(k, 12000)) for k in range(3)]).persist()
    a = predict.annotate(contigs, 60, 2)
    return a, a.scored.persist()


def test_weight_matrix_and_minimum(spark):
    windows = [dna(i, 6) for i in range(60)]
    df = spark.createDataFrame([("g", w) for w in windows] + [("few", w) for w in windows[:49]] + [("g", "AC")], "genome_id string, window string")
    rows = features.weight_matrix(df, 5).collect()
    assert {r.genome_id for r in rows} == {"g"} and len(rows) == 20
    for r in rows:
        n = 1 + sum(w[-5:][r.pos] == r.base for w in windows)
        assert r.n == n and abs(r.logodds - math.log(n / 64 / 0.25)) < 1e-12
    table = features.matrix_array(features.weight_matrix(df, 5), "m")
    score = spark.createDataFrame([("g", "TTACGNA")], "genome_id string, w string").join(table, "genome_id").select(
        U.pwm_score(F.col("w"), F.col("m"), 5).alias("s")).first().s
    cell = {(r.pos, r.base): r.logodds for r in rows}
    assert abs(score - sum(cell[(p, b)] for p, b in enumerate("ACGNA") if b != "N")) < 1e-12


def test_pair_features(spark, small_run):
    a, scored = small_run
    ctx = features.start_context(scored, a.contigs)
    pairs = features.pair_features(scored, a.contigs, a.models, ctx).collect()
    assert pairs
    info = ctx.first()
    table = models.model_arrays(a.models).first()
    order = table.markov_order
    seqs = {r.contig_id: r.seq for r in a.contigs.collect()}
    groups = {}
    for r in scored.collect():
        groups.setdefault((r.contig_id, r.strand, r.end), []).append(r)
    weigh = lambda r: sum(r[f"{c}_score_norm"] * w for c, w in C.START_SELECTION_WEIGHTS.items())
    contested = 0
    mean = lambda s: [table.codon_table[int(s[i:i + 3].translate(str.maketrans("ACGT", "0123")), 4)] for i in range(0, len(s) - 2, 3)]
    avg = lambda v: sum(v) / len(v) if v else 0.0
    by_key = {(p.contig_id, p.strand, p.end): p for p in pairs}
    for key, members in groups.items():
        ranked = sorted(members, key=lambda r: (-weigh(r), r.start))
        if len(ranked) < 2 or weigh(ranked[0]) - weigh(ranked[1]) >= C.CONTEST_GAP:
            assert key not in by_key
            continue
        contested += 1
        p, (t1, t2) = by_key[key], ranked[:2]
        strand = seqs[key[0]] if key[1] == "forward" else revcomp(seqs[key[0]])
        up = [strand[max(0, t.start - 26):t.start - 1] for t in (t1, t2)]
        assert (p.start_1, p.start_2) == (t1.start, t2.start)
        assert abs(p.d_baseline - (weigh(t1) - weigh(t2))) < 1e-9 and p.n_orfs == len(members)
        assert abs(p.anti_sd_top1 - plain_anti_sd(up[0])) < 1e-12
        lo, hi = sorted((t1.start, t2.start))
        assert abs(p.ext_codon - avg(mean(strand[lo - 1:hi - 1]))) < 1e-9
        assert abs(p.post_start_top2 - avg(mean(strand[t2.start + 2:t2.start + 17]))) < 1e-9
        z = [(t.length - info.len_mean) / max(info.len_std, 1) for t in (t1, t2)]
        assert abs(p.d_len_zscore - (z[0] - z[1])) < 1e-9
        values = []
        for u in up:
            total = 0.0
            for i in range(len(u)):
                w = u[max(0, i - order):i + 1]
                size = len(w)
                total += table.markov_table[(i % 3) * ((4 ** (order + 2) - 4) // 3) + (4**size - 4) // 3
                                            + int(w.translate(str.maketrans("ACGT", "0123")), 4)]
            values.append(total / len(u) if len(u) >= 9 else 0.0)
        assert abs(p.d_up_imm - (values[0] - values[1])) < 1e-9
        lengths = [m.length for m in members]
        assert abs(p.frac_longer - sum(x > t1.length for x in lengths) / len(lengths)) < 1e-12
        assert abs(p.top1_len_rank - sum(x < t1.length for x in lengths) / max(len(lengths) - 1, 1)) < 1e-12
        assert p.both_atg == int(t1.start_codon == "ATG" == t2.start_codon)
    assert contested == len(pairs)


def test_pair_columns_are_switched_by_name():
    assert len(features.pair_columns()) == 40 and len(features.pair_columns(("gc3",))) == 43
    with pytest.raises(ValueError):
        features.pair_columns(("other",))


def test_single_member_group(spark, small_run):
    _, scored = small_run
    rows = {(r.contig_id, r.strand, r.end): r for r in features.group_features(scored).collect()}
    for r in features.singletons(scored).collect():
        g = rows[(r.contig_id, r.strand, r.end)]
        assert g.num_orfs == 1 and abs(g.combined_margin_top2 - r.combined_score) < 1e-12 and g.combined_std == 0


def test_markov_order_zero_when_nothing_to_train(spark):
    contigs = contigs_of(spark, [("g", "c", "C" * 400)])
    a = predict.annotate(contigs)
    assert a.scored.count() == 0 and predict.predict_from_scored(a.scored).count() == 0
