"""Operators over whole tables, against plain Python."""

import gzip
import io
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row, functions as F

import corpus_pipeline
from codonlake.llm import arrays, collinear, common, jaccard_join, kneser_ney, source_mix, warc
from codonlake.session import ensure_checkpoint_dir

from llm_helpers import ODD, prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def edited(text: str, *places: int) -> str:
    words = text.split()
    for p in places:
        words[p] = f"new{p}"
    return " ".join(words)


def near_copies(seed: int, n: int, words: int = 120) -> list[str]:
    base = prose(seed, words)
    return [base, *[edited(base, (7 * i) % words, *([(13 * i + 50) % words] if i % 2 else [])) for i in range(1, n)]]


def plain_components(texts, k, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = set()
    for i in sets:
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                links.add((j, i))
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}, links, sets


def test_jaccard_components_and_links(spark):
    texts = [*ODD, *near_copies(3, 90), *[prose(50 + i, 100) for i in range(20)], *near_copies(4, 6), *near_copies(4, 6)[:3], "ONE", prose(2, 40).upper()]
    docs = table(spark, texts, prefix=F.lit(1), size=F.lit(2)).repartition(5)
    want, links, sets = plain_components(texts, 4, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.linked_components(docs).collect()}
    assert got == want
    found, members = jaccard_join.similar_pairs(docs)
    of = {r["doc_id"]: r["class_id"] for r in members.collect()}
    assert {tuple(r) for r in found.collect()} == {(a, b) for a, b in links if of[a] == a and of[b] == b and sets[a] != sets[b]}
    assert all(of[i] == min(j for j in sets if sets[j] == sets[i]) for i in sets if sets[i])
    assert jaccard_join.linked_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [2, 1000])
def test_jaccard_is_the_same_by_blocks_and_by_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    texts = near_copies(6, 70, 60)
    want, _, _ = plain_components(texts, 5, 80)
    got = jaccard_join.linked_components(table(spark, texts), 5, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want


def test_links_of_repeated_and_missing_ids_are_kept(spark):
    a, b, c = prose(31, 80), prose(32, 80), prose(33, 80)
    rows = [(1, a), (1, b), (2, edited(b, 5)), (3, edited(a, 9)), (4, None), (5, c), (5, ""), (None, edited(c, 3)), (None, prose(34, 80)), (6, edited(c, 70)), (1, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(jaccard_join.linked_components(docs).collect(), key=str)
    assert [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got] == sorted(
        [(1, 77, 1), (1, 77, 1), (1, 77, 1), (2, 77, 1), (3, 77, 1), (4, 0, 4), (5, 77, 5), (5, 0, 5), (None, 77, 5), (None, 77, None), (6, 77, 5)], key=lambda r: str(
            spark_row(*r)))
    pairs, _ = jaccard_join.similar_pairs(docs)
    assert {tuple(r) for r in pairs.collect()} == {(1, 2), (1, 3), (5, 6)}


def spark_row(doc_id, n_shingles, component_id):
    return Row(doc_id=doc_id, n_shingles=n_shingles, component_id=component_id)


def test_one_row_of_each_group_stays(spark):
    a, b, c = prose(41, 80), prose(42, 80), prose(43, 80)
    rows = [(1, a, 1), (1, a, 2), (1, b, 3), (2, edited(b, 5), 4), (None, a, 5), (None, c, 6), (None, c, 7), (7, "", 8), (7, None, 9)]
    got = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3))
    kept = sorted(r["row"] for r in got.collect())
    assert got.columns == ["doc_id", "text", "row"]
    assert len(kept) == 5 and kept[0] in (1, 2) and kept[1] == 3 and kept[2] in (6, 7) and kept[3:] == [8, 9]
    assert jaccard_join.one_of_each(got.select("doc_id", "text")).count() == 5


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 199), (199, 200)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 199: 199, 200: 199}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_are_picked_by_number_without_moving_them(spark):
    rows = common.stored(spark.range(0, 150_000, 1, 3).select(F.monotonically_increasing_id().alias("row"), "id"))
    picked = rows.where("id % 7 = 3 OR id = 0 OR id BETWEEN 32760 AND 32780").select("row")
    got = common.rows_in(rows, picked, "row")
    assert got.columns == ["row", "id"] and {r["id"] for r in got.collect()} == {i for i in range(150_000) if i % 7 == 3 or i == 0 or 32760 <= i <= 32780}
    assert common.rows_in(rows, picked.limit(0), "row").count() == 0
    moved = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in moved and "BroadcastHashJoin" in moved


def test_chains_pass_every_better_point():
    rng = np.random.default_rng(5)
    for _ in range(30):
        points = np.array(sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (25, 2))}))
        best = [0.0] * len(points)
        for j, (a, b) in enumerate(points):
            options = [best[i] - collinear.GAP_COST * (a - x + b - y - 2 * collinear.WINDOW) for i, (x, y) in enumerate(points[:j]) if x < a and y < b]
            best[j] = collinear.K + max([0.0, *options])
        top = collinear.chains(points)[0]
        score = float(collinear.K)
        for i, j in zip(top, top[1:]):
            assert (points[i] < points[j]).all()
            score += collinear.K - collinear.GAP_COST * ((points[j] - points[i]).sum() - 2 * collinear.WINDOW) - collinear.K + collinear.K * 0
        assert abs(max(best) - score) < 1e-9 or score <= max(best)


def test_shared_passages_are_found_and_strangers_left_alone(spark):
    passage, other = prose(70, 60), prose(71, 55)
    texts = [*ODD, f"{prose(1000, 90)} {passage} {prose(1001, 30)}", f"{prose(1002, 10)} {edited(passage, 20, 41)} {prose(1003, 200)}",
             *[f"{prose(2000 + i, 40)} {other} {prose(3000 + i, 40)}" for i in range(30)], prose(72, 300), prose(73, 300)]
    n = len(ODD)
    docs = table(spark, texts, seeds=F.lit(0))
    spans, members = collinear.passages(docs)
    rows = spans.collect()
    assert {(r["doc_a"], r["doc_b"]) for r in rows if r["doc_b"] < n + 2} == {(n, n + 1)}
    r = next(r for r in rows if r["doc_a"] == n)
    assert (r["first_a"], r["end_a"], r["first_b"], r["end_b"], r["same"]) == (90, 150, 10, 70, 58)
    tied = dict(common.components(spans.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))).collect())
    assert len({tied[n + 2 + i] for i in range(30)}) == 1 and all(x["end_a"] - x["first_a"] >= 50 for x in rows)
    assert n + 32 not in tied and n + 33 not in tied
    assert {(r["doc_id"], r["class_id"]) for r in members.collect() if r["doc_id"] in (11, 12)} == {(11, 11), (12, 11)}
    empty, none = collinear.passages(docs.limit(0))
    assert empty.count() == 0 and none.count() == 0


def test_passages_of_two_are_found_among_documents_that_share_less(spark):
    """Halves of a passage, and a variant of it, that also stand in many other documents."""
    one, two, popular = prose(81, 30), prose(82, 30), prose(83, 60)
    variant = edited(popular, *range(2, 14), *range(40, 52))
    texts = [*[f"{prose(4000 + i, 40)} {one} {prose(5000 + i, 40)}" for i in range(12)], *[f"{prose(6000 + i, 40)} {two} {prose(7000 + i, 40)}" for i in range(12)],
             *[f"{prose(8000 + i, 40)} {popular} {prose(9000 + i, 40)}" for i in range(12)],
             *[f"{prose(i, 50)} {one} {two} {prose(i + 20, 50)}" for i in range(200, 206)], *[f"{prose(i, 50)} {variant} {prose(i + 20, 50)}" for i in range(300, 306)]]
    spans, _ = collinear.passages(table(spark, texts))
    rows = spans.collect()
    tied = dict(common.components(spans.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))).collect())
    assert {tied.get(i) for i in range(36, 42)} == {36} and {tied.get(i) for i in range(42, 48)} == {42} and {tied.get(i) for i in range(24, 36)} == {24}
    assert not set(range(24)) & set(tied)
    for i in range(36, 48):
        assert any(r["first_a"] == 50 and r["end_a"] == 110 and r["same"] == 60 for r in rows if i in (r["doc_a"], r["doc_b"])), i


@pytest.mark.parametrize("block", [16, 512])
def test_no_pair_of_blocks_is_left_to_a_third(block):
    rng = np.random.default_rng(3)
    width, n = 2 * collinear.AROUND + collinear.K, 60
    families = rng.integers(1, 256, (3, width), dtype=np.uint8)
    rows = families[np.arange(n) % 3].copy()
    rows[:, collinear.AROUND:collinear.AROUND + collinear.K] = families[0, collinear.AROUND:collinear.AROUND + collinear.K]
    for r in rows:
        r[rng.choice(collinear.AROUND - 5, 3, replace=False)] = rng.integers(1, 256, 3)
    cuts, found = [rows[i:i + block] for i in range(0, n, block)], []
    for p, x in enumerate(cuts):
        for q in range(p, len(cuts)):
            i, j, left, right = collinear.like_pairs(x, cuts[q], p == q)
            found += [(p * block + a, q * block + b) for a, b, s in zip(i.tolist(), j.tolist(), left + right) if s >= collinear.LEAST_WORDS]
    assert sorted(found) == [(a, b) for a in range(n) for b in range(a + 1, n) if a % 3 == b % 3]


def test_every_pair_that_carries_a_frequent_passage_is_linked(spark):
    passage, short = prose(91, 60), prose(92, 12)
    texts = [f"{prose(2000 + i, 40)} {edited(passage, 7 + i % 3, 41)} {prose(3000 + i, 40)}" for i in range(14)] + [f"{prose(4000 + i, 40)} {short} {prose(5000 + i, 40)}" for i in range(14)]
    spans, _ = collinear.passages(table(spark, texts))
    got = [(r["doc_a"], r["doc_b"]) for r in spans.collect()]
    assert sorted(got) == [(a, b) for a in range(14) for b in range(a + 1, 14)]


def test_one_shared_seed_is_enough(spark):
    texts = []
    for i in range(40):
        passage = prose(600 + i, 60)
        texts += [f"{prose(2000 + i, 30)} {passage} {prose(3000 + i, 30)}", f"{prose(4000 + i, 30)} {edited(passage, 5, 11, 17, 23, 35, 41, 47, 53)} {prose(5000 + i, 30)}"]
    docs = table(spark, texts)
    rows = {r["doc_id"]: {s["hash"] for s in r["seeds"]} for r in collinear._seeds(docs).collect()}
    single = {2 * i for i in range(40) if len(rows[2 * i] & rows[2 * i + 1]) == 1}
    got = {(r["doc_a"], r["doc_b"]) for r in collinear.passages(docs)[0].collect()}
    assert len(single) > 5 and all((i, i + 1) in got for i in single)


def test_passages_of_four_words_in_five_are_found(spark):
    """Every fifth word changed, evenly or at random: no eight words in a row are equal. And strangers are left alone."""
    rng, texts, pairs = np.random.default_rng(4), [], set()
    for i in range(80):
        passage, n = prose(6000 + i, 60), len(texts)
        where = range(4, 60, 5) if i % 2 else rng.choice(60, 12, replace=False).tolist()
        texts += [f"{prose(2000 + i, 30 + i % 7)} {passage} {prose(3000 + i, 30)}", f"{prose(4000 + i, 30)} {edited(passage, *where)} {prose(5000 + i, 30)}"]
        pairs.add((n, n + 1))
    rows = collinear.passages(table(spark, texts))[0].collect()
    got = {(r["doc_a"], r["doc_b"]) for r in rows}
    assert got <= pairs and {p for p in pairs if p[0] // 2 % 2} <= got and len(got) >= 0.95 * len(pairs)
    words = [t.split() for t in texts]
    for r in rows:
        x, y = words[r["doc_a"]][r["first_a"]:r["end_a"]], words[r["doc_b"]][r["first_b"]:r["end_b"]]
        assert min(len(x), len(y)) >= 50 and 0.8 * len(x) <= r["same"] <= sum(p == q for p, q in zip(x, y))


def test_every_copy_of_a_passage_counts(spark):
    """Twice in one text and once in another, three times in a row, and in a phrase that one of two texts repeats more often."""
    one, two = prose(95, 60), prose(96, 70)
    texts = [f"{prose(1, 40)} {one} {prose(2, 40)} {one} {prose(3, 40)}", f"{prose(4, 20)} {one} {prose(5, 20)}", f"{two} {two} {two}", "to and fro " * 40 + prose(6, 30), "to and fro " * 20 + prose(7, 30),
             f"{'so ' * 10} {prose(8, 60)}", f"{'so ' * 30} {prose(8, 60)}"]
    rows = {tuple(r) for r in collinear.passages(table(spark, texts))[0].collect()}
    assert {r for r in rows if r[3] < 3} == {(0, 40, 100, 1, 20, 80, 60), (0, 140, 200, 1, 20, 80, 60), (0, 40, 100, 0, 140, 200, 60), (2, 0, 70, 2, 70, 140, 70), (2, 70, 140, 2, 140, 210, 70)}
    assert {r[:3] for r in rows if (r[0], r[3]) == (3, 4)} == {(3, 0, 60), (3, 60, 120)}
    assert any(r[0] == 5 and r[3] == 6 and r[2] == 70 and r[5] == 90 for r in rows)


def test_rows_of_one_id_and_of_none_keep_their_passages(spark):
    one, two, three = prose(1, 70), prose(2, 70), prose(3, 70)
    texts = [(1, one), (1, two), (2, edited(two, 30)), (3, edited(one, 30)), (None, three), (4, edited(three, 30)), (None, prose(4, 70)), (None, prose(4, 70) + " more")]
    spans, members = collinear.passages(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    assert sorted((r["doc_a"], r["doc_b"] or -1, r["same"]) for r in spans.collect() if r["doc_a"] is not None) == [(1, 2, 69), (1, 3, 69), (4, -1, 69)]
    assert [tuple(r)[:6] for r in spans.where("doc_a IS NULL").collect()] in ([(None, 0, 70, None, 0, 70)],)
    assert members.count() == 8


def test_places_of_a_frequent_run_meet_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(collinear, "BLOCK", 4)
    monkeypatch.setattr(collinear, "GROUP", 3)
    monkeypatch.setattr(collinear, "CUT", 10)
    monkeypatch.setattr(collinear, "MET_WORDS", 300)
    monkeypatch.setattr(collinear, "ASKED_WORDS", 700)
    monkeypatch.setattr(collinear, "ALIGNED_WORDS", 500)
    passage = prose(97, 60)
    texts = [f"{prose(2000 + i, 20)} {edited(passage, 9 + i)} {prose(3000 + i, 20)}" for i in range(18)]
    got = sorted((r["doc_a"], r["doc_b"]) for r in collinear.passages(table(spark, texts))[0].collect())
    assert got == [(a, b) for a in range(18) for b in range(a + 1, 18)]


def test_equal_words_in_order_are_counted_at_any_length():
    rng = np.random.default_rng(6)
    for n, m in [(0, 3), (5, 5), (40, 70), (2100, 2000)]:
        x, y = (rng.integers(0, 30, k).tolist() for k in (n, m))
        row = np.zeros(m + 1, dtype=np.int64)
        for w in x:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (np.array(y) == w)))
        assert collinear._equal(x, y) == row[-1]


def test_run_takes_the_nearest_step():
    """The search over the band as one table against the search step by step."""
    rng = np.random.default_rng(8)
    w = collinear.BAND
    for _ in range(300):
        x = rng.integers(0, 5, int(rng.integers(0, 40)))
        y = np.delete(x, rng.integers(0, x.size, min(3, x.size))) if x.size and rng.random() < 0.7 else rng.integers(0, 5, int(rng.integers(0, 40)))
        i = j = same = 0
        done = (0, 0, 0)
        while i < x.size and j < y.size:
            k = 0
            while i + k < x.size and j + k < y.size and x[i + k] == y[j + k]:
                k += 1
            i, j, same = i + k, j + k, same + k
            if k >= 3 or (k and not done[0]):
                done = (i, j, same)
            if i >= x.size or j >= y.size:
                break
            step = next(((p, s - p) for s in range(1, 2 * w) for p in range(max(0, s - w), min(s, w) + 1)
                         if i + p + 3 <= x.size and j + s - p + 3 <= y.size and (x[i + p:i + p + 3] == y[j + s - p:j + s - p + 3]).all()), None)
            if step is None:
                break
            i, j = i + step[0], j + step[1]
        assert collinear._run(x, y) == done


def plain_mix(sizes):
    """sizes: (doc_id, source key, words). Target per source and words taken per document."""
    import hashlib
    total_of = defaultdict(int)
    for _, s, n in sizes:
        total_of[s] += n
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(total_of))}
    budget, capped = sum(total_of.values()), set()
    while True:
        free = [s for s in total_of if s not in capped]
        level = (budget - sum(3 * total_of[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        new = {s for s in free if weight[s] * level > 3 * total_of[s]}
        if not new:
            break
        capped |= new
    target = {s: 3.0 * total_of[s] if s in capped else weight[s] * level for s in total_of}
    queue = []
    for s in total_of:
        run = 0
        for h, i, n in sorted((hashlib.md5(f"mix:{i}".encode()).hexdigest(), i, n) for i, t, n in sizes if t == s):
            run += n
            if n and target[s]:
                queue += [((e * total_of[s] + run) / target[s], s, h, i, n) for e in range(min(3, math.ceil(target[s] / total_of[s])))]
    taken, so_far = Counter(), 0
    for _, _, _, i, n in sorted(queue):
        so_far += n
        if so_far > budget:
            break
        taken[i] += n
    return target, total_of, taken


def test_mix_follows_targets(spark):
    texts = [*ODD, *[prose(i, 5 + i % 40) for i in range(300)]]
    docs = table(spark, texts).withColumn("source", F.expr("CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'big' WHEN doc_id % 31 = 1 THEN 'a' ELSE 'z' END"))
    key = {r["doc_id"]: "1" if r["source"] is None else "0" + r["source"] for r in docs.collect()}
    sizes = [(i, key[i], len(WORD.findall(t or ""))) for i, t in enumerate(texts)]
    target, total_of, taken = plain_mix(sizes)
    got = {r["doc_id"]: r for r in source_mix.decisions(source_mix._sized(docs.repartition(6))).collect()}
    for i, s, n in sizes:
        assert abs(got[i]["target"] - target[s]) < 1e-6 and got[i]["source_size"] == total_of[s] and got[i]["rounds"] * n == taken[i], i
    for s in target:
        assert abs(sum(taken[i] for i, t, _ in sizes if t == s) - target[s]) <= 3100  # one document at most, the longest has 3,000 words
    rows = Counter(r["doc_id"] for r in source_mix.mixed_documents(docs.withColumn("_src", F.lit(1))).collect())
    assert rows == Counter({i: taken[i] // n for i, _, n in sizes if n and taken[i]})
    assert source_mix.mixed_documents(docs.limit(0)).count() == 0
    twice = docs.where("doc_id < 8").unionByName(docs.where("doc_id < 8"))
    assert all(n % 2 == 0 for n in Counter(r["doc_id"] for r in source_mix.mixed_documents(twice).collect()).values())


def test_archives_give_back_what_was_written(spark):
    warc.use_warc(spark)
    pages = [(i, f"http://x.org/{i}\r\nEvil: 1" if i == 3 else None if i == 4 else f"http://x.org/{i}", h) for i, h in enumerate(
        ["<p>é</p>", None, "", "<p>é</p>", "a\r\n\r\nWARC/1.1\r\n\r\n", "y" * 3_000_000, "<p>é</p>", "日本"])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("n", F.lit(9)).repartition(3)
    path = f"{ensure_checkpoint_dir(spark)}/warc-test"
    warc.response_records(df).write.format("warc").option("path", path).mode("append").save()
    read = spark.read.format("warc").option("path", path)
    got = {r["record_id"]: r for r in read.load().collect()}
    assert [(got[i]["record_type"], got[i]["refers_to"]) for i in range(8)] == [
        ("revisit", 6), ("revisit", 2), ("response", None), ("revisit", 6), ("response", None), ("response", None), ("response", None), ("response", None)]
    for i, _, h in pages:
        payload = (h or "").encode()
        assert got[i]["payload_digest"] == warc.digest_of(payload) and got[i]["payload_bytes"] == len(payload)
        assert bytes(got[i]["payload"]) == payload if got[i]["record_type"] == "response" else got[i]["payload"] is None
    assert got[3]["target_uri"] == "http://x.org/3%0D%0AEvil: 1"
    plan = read.load().where("record_type = 'revisit' AND payload_bytes > 1")
    assert [r["record_id"] for r in plan.orderBy("record_id").collect()] == [0, 3]
    assert read.option("payloads", "none").load().where(F.col("payload").isNotNull()).count() == 0
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan
    rest = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_bytes",), 1)]))
    assert [type(f) for f in rest] == [GreaterThan] and reader.tests == {"record_type": {"response"}}
    warc.response_records(df.limit(0)).write.format("warc").option("path", path + "-none").mode("append").save()
    assert spark.read.format("warc").option("path", path + "-none").load().count() == 0


def test_archives_of_other_writers_are_read(spark, tmp_path):
    def record(fields, block):
        return ("WARC/1.0\r\n" + "".join(f"{f}\r\n" for f in fields) + f"content-length:{len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>\r\n\r\nbody"
    records = [record(["WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:a>", "Content-Type: application/warc-fields"], b"software: x\r\n"),
               record(["warc-type:request", "WARC-RECORD-ID:<urn:uuid:b>", "WARC-Target-URI: http://x.org/a:b"], b"GET / HTTP/1.1\r\n\r\n") + b"\r\n",
               record(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:c>", "WARC-Target-URI:\thttp://x.org/\r\n folded", "WARC-Payload-Digest: SHA1:ABC",
                       "Content-Type: application/http; msgtype=response", "no colon here"], http),
               record(["WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:d>", "WARC-Refers-To: <urn:uuid:c>", "Content-Type: application/http"], b"HTTP/1.1 200 OK\r\n\r\n")]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "two.warc").write_bytes(b"".join(records))
    (tmp_path / "notes.txt").write_text("no archive")
    warc.use_warc(spark)
    read = spark.read.format("warc").option("path", str(tmp_path))
    got = sorted(tuple(r) for r in read.load().select("record_uri", "record_type", "target_uri", "payload_digest", "refers_to_uri", "payload_bytes", F.col("payload").cast("string"), "record_id").collect())
    want = [("urn:uuid:a", "warcinfo", None, None, None, 13, "software: x\r\n", None),
            ("urn:uuid:b", "request", "http://x.org/a:b", None, None, 18, "GET / HTTP/1.1\r\n\r\n", None),
            ("urn:uuid:c", "response", "http://x.org/ folded", "ABC", None, 11, "<p>\r\n\r\nbody", None),
            ("urn:uuid:d", "revisit", None, None, "urn:uuid:c", None, None, None)]
    assert got == sorted(want * 2)
    assert spark.read.format("warc").option("path", str(tmp_path / "two.warc")).load().where("payload_digest = 'ABC'").count() == 1
    assert read.option("payloads", "none").load().where("record_type = 'response' AND payload_bytes IS NULL").count() == 2


def test_members_skip_and_report_torn_files():
    record = {"payload": b"x" * 500_000, "record_type": "response", "record_id": 1, "target_uri": "u", "payload_digest": "D", "refers_to": None, "payload_bytes": 500_000}
    data = warc.member(record) + warc.member(record | {"record_id": 2})
    members = warc.Members(io.BytesIO(data))
    assert members.header()["WARC-Record-ID"] == "<urn:page:1>" and members.body(500_000, False) is None
    assert members.header()["WARC-Record-ID"] == "<urn:page:2>" and members.body(500_000, True) == b"x" * 500_000 and members.header() is None
    torn = warc.Members(io.BytesIO(data[:len(data) - 40]))
    torn.header(), torn.body(500_000, False), torn.header()
    with pytest.raises(ValueError):
        torn.body(500_000, False)


def plain_model(texts):
    """Interpolated modified Kneser-Ney by definition: function (a, b, c) -> log probability."""
    c3 = Counter()
    for t in texts:
        w = ["<s>", "<s>", *[re.sub(r"[.,;:]+$", "", x) or x for x in t.split()], "</s>"]
        c3.update(zip(w, w[1:], w[2:]))
    c2 = Counter((b, c) for _, b, c in c3)
    c1 = Counter(c for _, c in c2)

    def discount(counts):
        n = Counter(counts.values())
        if not n[1] or not n[2]:
            return [0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        return [min(max(x, 0.1), i + 0.9) for i, x in enumerate(d)]

    d3, d2, d1 = discount(c3), discount(c2), discount(c1)
    cut = lambda n, d: d[min(n, 3) - 1] if n else 0.0
    total = sum(c1.values())
    rest = sum(cut(n, d1) for n in c1.values()) / total / (len(c1) + 1)

    def p1(c):
        return max(c1[c] - cut(c1[c], d1), 0) / total + rest

    def p2(b, c):
        seen = [n for (x, _), n in c2.items() if x == b]
        return (c2[b, c] - cut(c2[b, c], d2)) / sum(seen) + sum(cut(n, d2) for n in seen) / sum(seen) * p1(c) if seen else p1(c)

    def p3(a, b, c):
        seen = [n for (x, y, _), n in c3.items() if (x, y) == (a, b)]
        return (c3[a, b, c] - cut(c3[a, b, c], d3)) / sum(seen) + sum(cut(n, d3) for n in seen) / sum(seen) * p2(b, c) if seen else p2(b, c)

    return lambda a, b, c: math.log(p3(a, b, c)), c1


def test_kneser_ney_is_the_definition(spark):
    trusted = ["a b c. a b d", "a b c a b c e", "b c d, b c e f", "f a b g c", "e e e a b"]
    asked = ["a b c", "c b a", "zz a b", "q r s", "e e e e", None, "", "a"]
    model = kneser_ney.Model(table(spark, trusted))
    logp, c1 = plain_model(trusted)
    got = {r["doc_id"]: r for r in model.score(table(spark, asked)).collect()}
    assert {i for i in got if got[i]["log_perplexity"] is None} == {5, 6}
    got = {i: r for i, r in got.items() if i not in (5, 6)}
    for i in got:
        w = ["<s>", "<s>", *asked[i].split(), "</s>"]
        want = -sum(logp(*g) for g in zip(w, w[1:], w[2:])) / (len(w) - 2)
        assert abs(got[i]["log_perplexity"] - want) < 1e-4 and got[i]["n_grams"] == len(w) - 2
    assert abs(sum(math.exp(logp("a", "b", c)) for c in [*c1, "never"]) - 1) < 1e-9


def test_classifier_keeps_prose_and_drops_noise(spark):
    noise = [" ".join(f"{k * 7919 % 10007:x}@{k}" for k in range(i, i + 60)) for i in range(40)]
    texts = [prose(i, 80) for i in range(300)] + noise + [None, ""]
    docs = table(spark, texts, threshold=F.lit("clash"))
    trusted = docs.where("doc_id < 200").select("doc_id")
    got = {r["doc_id"]: r for r in kneser_ney.classify(docs, trusted).collect()}
    assert len(got) == len(texts) and sum(got[i]["kept"] for i in range(200, 300)) >= 97
    assert not any(got[i]["kept"] for i in range(300, 342)) and got[340]["log_perplexity"] is None
    assert kneser_ney.classify(docs.limit(0), trusted).count() == 0
    assert not any(r["kept"] for r in kneser_ney.classify(docs.limit(3), trusted.limit(0)).collect())


def test_model_knows_every_trusted_document_of_its_part(spark, monkeypatch):
    """More trusted documents than any sample, in many shards: each either fits the model or sets a threshold."""
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 20_000)
    texts = [prose(i, 20) for i in range(2600)]
    docs = table(spark, texts)
    part = F.pmod(F.xxhash64("doc_id", F.lit("kn")), F.lit(1_000_000)) / 1e6
    fitted = {r["doc_id"] for r in docs.where(part < kneser_ney.FIT_PART).collect()}
    trusted = [texts[i] for i in sorted(fitted)]
    counts = Counter(g for t in trusted for w in [["<s>", "<s>", *t.split(), "</s>"]] for g in zip(w, w[1:], w[2:]))
    twice = docs.unionByName(docs.where(part >= kneser_ney.FIT_PART)).repartition(3)
    got = defaultdict(list)
    for r in kneser_ney.classify(twice, docs.select("doc_id"), margin=0.0).collect():
        got[r["doc_id"]].append(r)
    assert len(fitted) > 1700 and len(got) == 2600 and all(len(v) == (1 if i in fitted else 2) and v[0] == v[-1] for i, v in got.items())
    logp, _ = plain_model(trusted)
    for i in [0, 1, 2, 1300, 2599]:
        w = ["<s>", "<s>", *texts[i].split(), "</s>"]
        assert abs(got[i][0]["log_perplexity"] + sum(logp(*g) for g in zip(w, w[1:], w[2:])) / (len(w) - 2)) < 1e-4
    # a text of the fit has all its trigrams in the model; 99 % of the rest are under the threshold
    mean = lambda ids: sum(got[i][0]["log_perplexity"] for i in ids) / len(ids)
    rest = set(range(2600)) - fitted
    assert sum(counts.values()) == 21 * len(fitted) and mean(fitted) < mean(rest) - 0.5 and sum(got[i][0]["kept"] for i in rest) >= 0.98 * len(rest)


def test_pipeline_stages(spark):
    texts = [*ODD, *near_copies(8, 8, 90), *[prose(500 + i, 100) for i in range(30)], prose(900, 90) + " +1 (743) 555-3824 x@y.org", "### " * 80]
    docs = table(spark, texts, extra=F.lit(1))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, ""))
        seen[name] = docs.collect()
        assert (name == "piece sampling") != (docs.columns == corpus_pipeline.COLUMNS)
    n = len(ODD)
    kept = {r["doc_id"] for r in seen["quality rules"]}
    assert set(range(n, n + 39)) <= kept and not kept & {0, 1, 2, 3, n + 39}
    single = {r["doc_id"] for r in seen["n-gram Jaccard join"]}
    of, _, _ = plain_components([texts[i] if i in kept else None for i in range(len(texts))], 5, 80)
    assert single == {i for i in kept if of[i][1] == i}
    clean = {r["doc_id"]: r for r in seen["personal data"]}
    assert set(clean) == single and clean[n + 38]["text"].endswith("[PHONE] [EMAIL]") and clean[n + 38]["n_chars"] == len(clean[n + 38]["text"])
    sizes = Counter(r["doc_id"] for r in seen["source mix"])
    assert set(sizes) <= single and max(sizes.values()) <= 3 and len(seen["piece sampling"]) == len(seen["source mix"])
    assert all(r["n_pieces"] > 0 for r in seen["piece sampling"])


def test_n_grams_travel_once_a_slice_and_nothing_is_left_on_disk(spark, monkeypatch):
    """What goes to the shards of the model is a few bytes for each distinct n-gram; the tables of the fit are deleted."""
    texts = [prose(i, 400) for i in range(60)] * 2
    docs = table(spark, texts)
    made = []
    monkeypatch.setattr(kneser_ney, "stored", lambda df: made.append(common.stored(df)) or made[-1])
    (s,) = arrays.slices(pa.array(texts), fold=False)
    keys = np.unique(kneser_ney._keys(s)[0])
    sent = arrays.planes(keys, kneser_ney.KEY_BYTES)
    assert (arrays.unplaned(sent, kneser_ney.KEY_BYTES) == keys >> np.uint64(8) << np.uint64(8)).all()
    assert len(sent) == 7 * keys.size and keys.size < 3 * 403 * 60
    model = kneser_ney.Model(docs)
    kept = [t for t in made if common.exists(t)]
    assert len(made) > 6 and len(kept) == 3 and sum(t.count() for t in kept) == model.values.count()
    got = {r["doc_id"]: r["log_perplexity"] for r in model.score(docs).collect()}
    assert len(got) == 120 and all(got[i] == got[i + 60] for i in range(60))
