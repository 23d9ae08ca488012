"""Searches of vectors against brute force, over odd tables and hot groups."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codonlake.llm import gnat, rotated_codes as rc, vectors

ROWS = "vec_id long, embedding array<float>, label int"


def plain_rows(n=500, dim=12, seed=1):
    """Clusters, near copies, and at the end every odd row."""
    r = np.random.default_rng(seed)
    centres = r.standard_normal((4, dim))
    x = centres[r.integers(0, 4, n)] * 0.6 + r.standard_normal((n, dim)) * 0.3
    x[100:200] = x[100] + r.standard_normal((100, dim)) * 1e-3  # a group of near copies
    x[200:220] = x[200]
    rows = [(i, [float(np.float32(v)) for v in x[i]], int(r.integers(0, 10))) for i in range(n)]
    rows += [(n, None, 1), (n + 1, rows[0][1], None), (n + 2, rows[1][1][:-1] + [None], 2), (n + 3, rows[1][1][:-1] + [math.nan], 2),
             (n + 4, rows[1][1][:-1] + [math.inf], 3), (n + 5, rows[2][1][:5], 3), (n + 6, [], 4), (n + 7, [0.0] * dim, 5), (None, rows[3][1], 1)]
    return rows + [rows[7]] * 3 + [(7, rows[9][1], 3)]


def used(rows, zero=True):
    """Distinct usable rows: (id, components, label)."""
    out = set()
    for i, x, label in rows:
        if i is None or x is None or (zero and label is None) or any(v is None or not math.isfinite(v) for v in x) or (not zero and not any(x)):
            continue
        out.add((i, tuple(x), label))
    return sorted(out, key=str)


def plain_negatives(rows, every=100):
    made = sorted({(i, tuple(math.floor(256 * v) for v in x), (label + 1) % 10 if i % 7 == 0 else label) for i, x, label in used(rows)})
    out = []
    for i, x, label in made:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), j, other) for j, y, other in made if j != i]
        for s, j, other in sorted(p for p in scored if p[2] == label)[:5]:
            window = sorted((t, k) for t, k, o in scored if o != label and 80 * -s <= 100 * -t <= 100 * -s)[:5]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows, condition="id % 10 = 0", **sizes):
    df = spark.createDataFrame(rows, ROWS).withColumn("cell", F.lit("clash")).withColumn("code", F.lit(1))
    got = gnat.mined(df, condition, **sizes).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got)


def test_hard_negatives_equal_brute_force(spark):
    rows = plain_rows()
    want = plain_negatives(rows, 10)
    assert len(want) > 200
    assert mined(spark, rows, leaf_rows=25, splits=4, sample=200, block=30) == want


def test_hard_negatives_of_huge_components_and_of_nothing(spark):
    rows = [(i, [float(np.float32(v * 1e5)) for v in x], label) for i, x, label in plain_rows()[:60]]
    assert mined(spark, rows, leaf_rows=10, splits=3) == plain_negatives(rows, 10)
    rows = [(i, [1e30, float(i)], i % 2) for i in range(8)]
    assert all(p == 2**63 - 1 for *_, p, n in mined(spark, rows))
    assert mined(spark, rows[:0]) == [] and mined(spark, rows[:1]) == []


def test_dropped_siblings_hold_nothing_of_the_window():
    r = np.random.default_rng(3)
    x = np.floor(256 * np.concatenate((r.standard_normal((300, 6)) * 0.05 + np.eye(6)[r.integers(0, 6, 300)], r.standard_normal((100, 6)))))
    norm = float((x * x).sum(axis=1).max())
    tree = gnat.fit_tree(gnat.lifted(x, norm), norm, len(x), 20, 4)
    leaf = gnat.leaves_of(tree, gnat.lifted(x, norm))
    assert tree.leaves > 8
    for splits, spans in zip(tree.splits, tree.spans):
        d = gnat._distances(gnat.lifted(x, norm), splits)
        inside = [(leaf >= a) & (leaf < b) for a, b in zip(spans[:-1], spans[1:])]
        tree.low.append(np.array([[d[m, i].min(initial=np.inf) for m in inside] for i in range(len(splits))]))
        tree.high.append(np.array([[d[m, i].max(initial=-np.inf) for m in inside] for i in range(len(splits))]))
    dropped = 0
    for q in x[:60]:
        scores = x @ q
        for most in np.sort(scores)[[-2, -10, -100]]:
            least = 0.8 * most if most > 0 else most
            live = gnat.alive(tree, q[None], np.array([least]), np.array([most]))[0]
            assert live[leaf[(scores >= least) & (scores <= most)]].all()
            dropped += (~live).sum()
    assert dropped > 300


def found(spark, rows, condition="id % 5 = 0", **sizes):
    df = spark.createDataFrame(rows, ROWS).withColumn("signs", F.lit("clash")).withColumn("floor", F.lit(1))
    out = {}
    for r in rc.searched(df, condition, **sizes).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_neighbours_against_brute_force(spark):
    rows = [r for r in plain_rows(700, 32) if r[0] != 7]
    made = used(rows, zero=False)
    got = found(spark, rows, cell_rows=80, block=60)
    hits = total = 0
    for i, x, _ in made:
        if i % 5:
            continue
        want = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y, _ in made if j != i)[:20]
        assert [r for r, _, _ in got[i]] == list(range(1, 21))
        assert [(-s, j) for _, j, s in got[i]] == sorted((-s, j) for _, j, s in got[i])
        assert all(s == pytest.approx(sum(a * b for a, b in zip(x, dict((k, y) for k, y, _ in made)[j])), rel=1e-12) for _, j, s in got[i][:3])
        hits += len({j for _, j in want} & {j for _, j, _ in got[i]})
        total += 20
    assert hits / total > 0.99


def test_neighbours_of_few_rows_and_ties(spark):
    rows = [(i, [1.0, 0.0], 0) for i in range(6)] + [(6, [0.0, 0.0], 0), (8, [2.0], 0), (10, [-1.0, 5.0], None), (10, [-1.0, 5.0], None)]
    got = found(spark, rows)
    assert set(got) == {0, 5, 10}
    assert [j for _, j, _ in got[0]] == [8, 1, 2, 3, 4, 5, 10] and [s for _, _, s in got[0]] == [2.0, 1.0, 1.0, 1.0, 1.0, 1.0, -1.0]
    assert [j for _, j, _ in got[10]] == [0, 1, 2, 3, 4, 5, 8]
    assert found(spark, rows[:0]) == {} and found(spark, rows[:1]) == {}


def test_estimates_lie_within_their_bounds():
    r = np.random.default_rng(5)
    x, q = r.standard_normal((400, 64)), r.standard_normal((40, 64))
    turn = rc.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    signs, length, fit = rc.encode(x, turn)
    columns = np.ascontiguousarray(signs.T).view(np.uint64)
    ones = np.bitwise_count(columns).sum(axis=0, dtype=np.int64)
    errors, outside = [], 0
    for one in q:
        guess, off = rc.Question(one, turn).estimate(columns, ones, length, fit, 3.0)
        errors.append(guess - x @ one)
        outside += (np.abs(errors[-1]) > off).sum()
    errors = np.concatenate(errors)
    assert outside < 0.01 * errors.size and abs(errors.mean()) < 0.1 * errors.std()


def test_top_takes_ties_by_column():
    s = np.array([[1.0, 3.0, 3.0, 3.0, -np.inf], [-np.inf] * 5])
    row, col = vectors.top(s, 2)
    assert row.tolist() == [0, 0] and col.tolist() == [1, 2]
