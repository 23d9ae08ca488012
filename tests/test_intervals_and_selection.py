import bisect
import random

from codonlake.operators import distribute, intervals, orf, selection
from conftest import contigs_of, dna


def iv_frame(spark, rows):
    return spark.createDataFrame(rows, "genome_id string, contig_id string, start long, end long")


def plain_merge(rows):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def random_intervals(seed, n, length):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        s = r.randint(1, length)
        out.append((s, min(length, s + r.randint(0, 60))))
    return out


def test_merge_keeps_touching_apart(spark):
    got = intervals.merge_intervals(iv_frame(spark, [("g", "c", 1, 5), ("g", "c", 6, 9), ("g", "c", 9, 12)])).collect()
    assert sorted((r.start, r.end) for r in got) == [(1, 5), (6, 12)]


def test_merge_and_complement_random(spark):
    length = 900
    contigs = contigs_of(spark, [("g", str(k), "A" * length) for k in range(6)] + [("g", "empty", "A" * length)])
    sets = {str(k): random_intervals(k, 4 * k + 1, length) for k in range(6)}
    df = iv_frame(spark, [("g", k, s, e) for k, v in sets.items() for s, e in v])
    merged = intervals.merge_intervals(df).collect()
    gaps = intervals.complement(df, contigs, 20).collect()
    for k, v in sets.items():
        m = plain_merge(v)
        assert sorted((r.start, r.end) for r in merged if r.contig_id == k) == m
        expected, last = [], 1
        for s, e in m + [(length + 1, length + 1)]:
            if s - last >= 20:
                expected.append((last, s - 1))
            last = e + 1
        assert sorted((r.start, r.end) for r in gaps if r.contig_id == k) == expected
    assert [(r.start, r.end) for r in gaps if r.contig_id == "empty"] == [(1, length)]


def test_overlap_join_random(spark):
    a, b = random_intervals(1, 60, 2000), random_intervals(2, 60, 2000) + [(1, 2000)]
    got = intervals.overlap_join(iv_frame(spark, [("g", "c", *x) for x in set(a)]),
                                 iv_frame(spark, [("g", "c", *x) for x in set(b)]), 50).collect()
    expected = sorted((*x, *y) for x in set(a) for y in set(b) if x[0] <= y[1] and y[0] <= x[1])
    assert sorted((r.start, r.end, r.r_start, r.r_end) for r in got) == expected


def order_key(o):
    return (o.strand != "forward", o.frame, o.end, o.start)


def plain_longest(orfs, limit):
    taken = []
    for o in sorted([o for o in orfs if o.length >= 120], key=lambda o: (-o.length, *order_key(o))):
        if all(o.genome_start > t.genome_end or o.genome_end < t.genome_start for t in taken):
            taken.append(o)
            if len(taken) >= limit:
                break
    return {(o.strand, o.start, o.end) for o in taken}


def plain_atg(orfs, limit):
    taken = []
    pool = [o for o in orfs if 120 <= o.length <= 20000]
    for o in sorted(pool, key=lambda o: (o.start_codon != "ATG", -o.length, *order_key(o))):
        worst = max([max(0, min(o.genome_end, t.genome_end) - max(o.genome_start, t.genome_start) + 1) / o.length
                     for t in taken if t.strand == o.strand], default=0)
        if worst <= 0.3:
            taken.append(o)
            if len(taken) >= limit:
                break
    return {(o.strand, o.start, o.end) for o in taken}


def test_greedy_choices_equal_a_sequential_pass(spark):
    contigs = contigs_of(spark, [("g", "c", dna(3, 20000))])
    df = orf.scan_orfs(contigs, 100).persist()
    orfs = df.collect()
    for limit in (2000, 15):
        got = selection.longest_first(df, 120, limit).collect()
        assert {(r.strand, r.start, r.end) for r in got} == plain_longest(orfs, limit)
        got = selection.atg_first(df, 120, 20000, limit=limit).collect()
        assert {(r.strand, r.start, r.end) for r in got} == plain_atg(orfs, limit)


def test_rounds_equal_a_sequential_pass(spark):
    contigs = contigs_of(spark, [("g", "c", dna(3, 12000)), ("g", "d", dna(4, 6000))])
    df = orf.scan_orfs(contigs, 100).persist()
    orfs = df.collect()
    for fold_most in (1, 8):
        for choose, plain in ((selection.longest_first, plain_longest), (lambda o, m, **k: selection.atg_first(o, m, 20000, **k), plain_atg)):
            got = choose(df, 120, fold_most=fold_most).collect()
            assert {(r.contig_id, r.strand, r.start, r.end) for r in got} == {
                (c, *x) for c in "cd" for x in plain([o for o in orfs if o.contig_id == c], 10**9)}


def test_one_island_of_many_candidates(spark):
    r = random.Random(9)
    rows = []
    for i in range(50_000):
        n, at = r.randint(100, 700) * 3, r.randint(1, 2_000_000)
        rows.append((at, at + n - 1, n, i % 3, at + n - 1, at, "forward" if i % 2 else "reverse", "ATG"))
    df = spark.createDataFrame([("g", "c", *x) for x in rows], "genome_id string, contig_id string, genome_start long, genome_end long, "
                               "length long, frame int, end long, start long, strand string, start_codon string")
    assert intervals.merge_intervals(df, start="genome_start", end="genome_end").count() < 5  # one island holds almost all
    got = selection.longest_first(df, 300)
    starts, taken = [], []
    for x in sorted(rows, key=lambda x: (-x[2], x[6] != "forward", x[3], x[4], x[5])):
        k = bisect.bisect_left(starts, x[0])
        if (k == 0 or taken[k - 1][1] < x[0]) and (k == len(taken) or taken[k][0] > x[1]):
            starts.insert(k, x[0])
            taken.insert(k, x)
    assert sorted((x.genome_start, x.genome_end, x.strand) for x in got.collect()) == [(x[0], x[1], x[6]) for x in taken]


def test_longest_first_never_overlaps(spark):
    contigs = contigs_of(spark, [("g", str(k), dna(k, 8000)) for k in range(3)])
    rows = selection.longest_first(orf.scan_orfs(contigs, 100), 100).collect()
    for c in {r.contig_id for r in rows}:
        iv = sorted((r.genome_start, r.genome_end) for r in rows if r.contig_id == c)
        assert all(a[1] < b[0] for a, b in zip(iv, iv[1:]))


def test_running_total_with_one_hot_key(spark):
    r = random.Random(4)
    rows = [("hot" if r.random() < 0.8 else f"k{r.randint(0, 5)}", i, r.randint(0, 9)) for i in range(3000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(7)
    got = {(x.k, x.o): x.t for x in distribute.running_total(df, ["k"], ["o"], "v", "t").collect()}
    sums = {}
    for k, o, v in sorted(rows, key=lambda x: x[1]):
        sums[k] = sums.get(k, 0) + v
        assert got[(k, o)] == sums[k]
    assert len(got) == len(rows)


def test_salted_join_equals_plain_join(spark):
    rows = spark.range(1000).selectExpr("CASE WHEN id % 10 < 7 THEN 'hot' ELSE concat('k', id % 10) END AS genome_id", "id")
    table = rows.select("genome_id").distinct().selectExpr("genome_id", "length(genome_id) AS w").where("genome_id != 'k9'")
    a = distribute.salted_join(rows, table, rows_per_salt=100).orderBy("id").collect()
    b = rows.join(table, "genome_id", "left").orderBy("id").collect()
    assert [(r.id, r.w) for r in a] == [(r.id, r.w) for r in b]
