"""Operators that look at one document at a time, against plain Python over odd texts."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codonlake.llm import license_scan, pii_crf, piece_sampler, quality_ledger, winnowing

from llm_helpers import ODD, prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_ledger_measures_every_text(spark):
    got = by_id(quality_ledger.apply_policy(quality_ledger.ledger(table(spark, ODD))))
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        words = WORD.findall(t or "")
        windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
        lines = [s for s in (t or "").split("\n") if WORD.search(s)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(covered)), i
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or "")) and r["n_dup_lines"] == len(lines) - len(set(lines))
        base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        assert bool(r["fail_bits"] & 3) == base and not (base and r["kept"])
    assert got[10]["kept"]


def test_ledger_keeps_columns_and_ablates(spark):
    docs = table(spark, [prose(i, 80) for i in range(4)] + ["### " * 60, "short"], n_words=F.lit("clash"), _m=F.lit(1))
    entries = quality_ledger.ledger(docs)
    assert {"lang", "source", "_m"} <= set(entries.columns) and entries.columns.count("n_words") == 1
    report = {(r["policy"], r["rule"]): (r["fails"], r["only_this"]) for r in quality_ledger.ablation(entries).collect()}
    assert report[("v1", "too_few_words")][0] == 1 and report[("v1", "many_symbols")][0] == 1
    assert report[("base", "repeated_phrases")] == (1, 1) and report[("v1", "repeated_phrases")][1] == 0
    assert quality_ledger.ledger(docs.limit(0)).count() == 0
    assert all(r["fails"] == 0 for r in quality_ledger.ablation(quality_ledger.ledger(docs.limit(0))).collect())


def plain_spans(t):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
             ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for n, (kind, pattern) in enumerate(kinds, 1):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits[::-1]))
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".") if kind == "ip"), "card": 14 <= len(digits) <= 19 and total % 10 == 0,
                    "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), n, m.end()))
    return sorted(out)


TRICKY = ["a@b.c_x@d.e", "a@b.c@d.e", "..a+b@c-d.e.f..g @x.y z@w", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3.0255 00000001.2.3.4", "x" * 3000 + "@y.z", "+1 (2) 3-4.5 6 7890 +12 +1234567890 1",
          "4111-1111 1111-1111 41111111111111111111111", "9" * 3000, "@@@ a@@b.c", "+" * 50 + "1234567890", "1.2.3.4@a.b", "٣٤ +٣ 1٣2.3.4.5"]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans_are_those_of_the_patterns(text):
    assert pii_crf.base_spans(text) == plain_spans(text)


def test_labels_travel_to_other_mentions(spark):
    clear = ["Call +1 (743) 555-3824 or mail jane.doe@mail.example.com and 10.0.0.%d or 4111 1111 1111 1111 in 20%02d, page %d." % (i, i, i) for i in range(40)]
    again = "Reach +1 (743) 555-3824 now. " + prose(5, 200) + " again (743) 555-3824 in 1999."
    rows = by_id(pii_crf.personal_data(table(spark, clear + [again, *ODD])))
    extra = [(s["kind"], again[s["start"]:s["end"]]) for s in rows[40]["spans"] if not s["base"]]
    assert extra == [("phone", "(743) 555-3824")]
    for i, t in enumerate(ODD):
        assert [(s["start"], s["end"]) for s in rows[41 + i]["spans"] if s["base"]] == [(a, b) for a, _, b in plain_spans(t or "")]
    made = by_id(pii_crf.redacted(table(spark, clear + [again, None, ""], spans=F.lit(1))))
    assert "555" not in made[40]["text"] and "1999" in made[40]["text"] and made[41]["text"] is None and made[42]["text"] == "" and made[0]["spans"] == 1
    assert pii_crf.personal_data(table(spark, ODD).limit(0)).count() == 0


def test_labels_travel_to_all_mentions():
    unary = np.zeros((pii_crf._N_FEATURES, 5))
    unary[0, 0] = 0.5  # by itself a token is O
    text = "now +17435559999 and " + " or ".join(["17435559999"] * 40)
    graph = pii_crf.Graph()
    graph.add(0, text, pii_crf.base_spans(text))
    beliefs = pii_crf._beliefs(graph, {"unary": unary, "chain": np.zeros((5, 5)), "skip": 4 * np.eye(5)})
    assert len(beliefs) == 41 and (beliefs[:, 4] >= pii_crf.SURE).all()


@pytest.mark.parametrize("text, linked", [
    ("+33 1 23 45 67 89 or later 1 23 45 67 89 end", [("1", "1"), ("23", "23"), ("45", "45"), ("67", "67"), ("89", "89")]),
    ("+15553824000 and 5553824000", [("+15553824000", "5553824000")]),
    ("+1 (743) 555-3824 and 743 555-3824.", [("(743)", "743"), ("555-3824", "555-3824.")]),
    ("jane.doe@mail.example.com and Jane.Doe@home", [("jane.doe@mail.example.com", "Jane.Doe@home")]),
    ("1 2 3 and 1 2 3", []), ("in 1999 and 1999", []), ("x +1 555 382 4000 +33 382 4000 1", []),
])
def test_similar_mentions_are_linked(text, linked):
    graph = pii_crf.Graph()
    graph.add(0, text, pii_crf.base_spans(text))
    at = lambda n: text[graph.start[n]:graph.end[n]]
    assert sorted((at(a), at(b)) for a, b in graph.skip) == sorted(linked)


def test_beliefs_of_trees_are_exact_marginals():
    rng = np.random.default_rng(11)
    model = {"unary": rng.normal(0, 1, (pii_crf._N_FEATURES, 5)), "chain": rng.normal(0, 1, (5, 5)), "skip": rng.normal(0, 1, (5, 5))}
    model["chain"], model["skip"] = model["chain"] + model["chain"].T, model["skip"] + model["skip"].T
    for text in ("a 1234567 b 7654321 c 1234567 d", "x 12 345 y", "now 5553824000 or 1 end +15553824000 z"):
        graph = pii_crf.Graph()
        graph.add(0, text, pii_crf.base_spans(text))
        n = len(graph.doc)
        weight = np.zeros((5,) * n)
        for labels in np.ndindex(*weight.shape):
            w = sum(model["unary"][f, y] for y, shape in zip(labels, graph.shapes) for f in shape) + sum(o * model["chain"][0, y] for y, o in zip(labels, graph.open))
            w += sum(model["chain"][labels[a], labels[b]] for a, b in graph.chain) + sum(model["skip"][labels[a], labels[b]] for a, b in graph.skip)
            weight[labels] = np.exp(w) if all(f in (0, y) for f, y in zip(graph.fixed, labels)) else 0.0
        exact = np.array([weight.sum(axis=tuple(j for j in range(n) if j != i)) for i in range(n)]) / weight.sum()
        assert np.allclose(pii_crf._beliefs(graph, model), exact, atol=2e-3), text


def test_beliefs_do_not_depend_on_other_documents():
    rng = np.random.default_rng(7)
    model = {"unary": rng.normal(0, 1, (pii_crf._N_FEATURES, 5)), "chain": rng.normal(0, 1, (5, 5)), "skip": 0.2 * np.eye(5)}
    texts = [" ".join(f"{n % 7}23456{n % 3}" for n in range(i, i + 40)) for i in range(3)] + ["a 123456 b 123456 c", "+1 555 382 4000 5553824"]

    def beliefs(some):
        graph = pii_crf.Graph()
        for n, text in enumerate(some):
            graph.add(n, text, pii_crf.base_spans(text))
        return pii_crf._beliefs(graph, model)

    assert np.array_equal(np.concatenate([beliefs([t]) for t in texts]), beliefs(texts))


def test_licence_phrases_and_templates(spark):
    mit = dict((k, v) for k, v in license_scan.TEMPLATES if len(v) > 300)["mit"]
    texts = [*ODD, "Under the MIT-license, under THE mit license", prose(1, 300) + " " + mit.replace("charge", "fee") + " " + prose(2, 300), "cc by nc, Apache License Version 2",
             "this work is licensed under the GNU General Public License, version 3.", "the license of the software and the public"]
    got = by_id(license_scan.scan(table(spark, texts)))
    n = len(ODD)
    assert [(p["label"], p["start"]) for p in got[n]["phrases"]] == [("mit", 0), ("mit", 4)]
    assert [(s["label"], s["first"]) for s in got[n + 1]["spans"]] == [("mit", 300)] and 0.9 < got[n + 1]["spans"][0]["covered"] < 1
    assert sorted(p["label"] for p in got[n + 2]["phrases"]) == ["apache-2", "cc-by-nc"]
    assert [s["label"] for s in got[n + 3]["spans"]] == ["gpl-3"] and not got[n + 4]["spans"]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(ODD):
        assert got[i]["n_words"] == len(pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) and not got[i]["spans"]


def test_automaton_statistics_against_search():
    sequences = [[1, 2, 3, 1, 2, 4], [2, 3, 1, 5], [1, 2, 3, 1, 2]]
    automaton = license_scan.Automaton(sequences)
    text = [1, 2, 3, 1, 5, 2, 4, 9, 2, 3, 1, 2, 4, 4]
    inside = lambda run: [n for n, s in enumerate(sequences) if any(s[k:k + len(run)] == run for k in range(len(s)))]
    for i, (state, n) in enumerate(automaton.statistics(text)):
        longest = max(m for m in range(i + 2) if m == 0 or inside(text[i + 1 - m:i + 1]))
        assert n == longest
        if n == automaton.length[state]:
            assert sorted(automaton.ends[state]) == inside(text[i + 1 - n:i + 1])


def plain_fingerprint(t, k=winnowing.K, w=winnowing.WINDOW):
    pieces = [p for w in re.findall(r"[^\x20\x09-\x0D]+", t) for p in ([w] if len(w) <= 16 else w)]
    grams = []
    for i in range(max(1, len(pieces) - k + 1)) if pieces else []:
        seed = 42
        for p in pieces[i:i + k]:
            seed = xxhash.xxh64_intdigest(p.encode(), seed=seed)
        grams.append((seed - (1 << 64) if seed >> 63 else seed, -i))
    out = []
    for i in range(max(1, len(grams) - w + 1)) if grams else []:
        least = min(grams[i:i + w])
        if not out or out[-1] != least:
            out.append(least)
    return [(h, -b) for h, b in out]


def test_winnowing_of_odd_texts_and_neighbours(spark):
    docs = table(spark, ODD)
    got = by_id(winnowing.fingerprints(docs, "text", "f"))
    for i, t in enumerate(ODD):
        assert [(x["hash"], x["place"]) for x in got[i]["f"]] == plain_fingerprint(t or ""), i
    near = by_id(winnowing.with_next(docs.repartition(7), ["text"]))
    assert all(near[i]["next_text"] == ODD[(i + 1) % len(ODD)] for i in range(len(ODD)))
    assert winnowing.with_next(docs.limit(0), ["text"]).count() == 0
    assert by_id(winnowing.with_next(docs.limit(1), ["text"]))[0]["next_text"] is None
    nobody = winnowing.with_next(docs.where("doc_id < 2").withColumn("doc_id", F.lit(None).cast("long")), ["text"]).collect()
    assert [(r["doc_id"], r["next_text"]) for r in nobody] == [(None, None)] * 2


def test_shared_run_is_always_found():
    run = prose(9, winnowing.K + winnowing.WINDOW - 1)
    for i in range(20):
        a, b = plain_fingerprint(f"{prose(i, 50)} {run} {prose(i + 100, 30)}"), plain_fingerprint(f"{prose(i + 200, 70)} {run}")
        assert {h for h, _ in a} & {h for h, _ in b}


def test_passage_without_blanks_is_found_at_any_offset():
    run = "".join(chr(0x4E00 + (i * 7919) % 5000) for i in range(600))
    for shift in range(1, 18):
        a, b = plain_fingerprint(run), plain_fingerprint("漢" * shift + run)
        assert {h for h, _ in a} <= {h for h, _ in b} | {a[0][0]} and len({h for h, _ in a} & {h for h, _ in b}) > 50


def test_op7_against_plain_fingerprints(spark, tmp_path):
    texts = [*ODD, "漢字" * 30, prose(3, 60), prose(3, 60)]
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(None, prose(8, 40)), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = winnowing.op7_winnowing(spark, str(tmp_path)).collect()
    string = lambda t: ",".join(f"{h & (1 << 64) - 1:X}:{p}" for h, p in plain_fingerprint(t))
    hashes = lambda t: {h for h, _ in plain_fingerprint(t)}

    def like(a, b):
        a, b = hashes(a), hashes(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    assert len(got) == len(rows)
    for r in (r for r in got if r["doc_id"] is not None):
        i = r["doc_id"] // 3
        text, after = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        cut = len(text) // 2
        edited = text[:len(text) - cut] + after[:cut]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), string(text)), i
        assert (r["edited_fingerprint"], r["near_edited"], r["near_next"]) == (string(edited), like(text, edited), like(text, after)), i
    assert sorted((r["n_chars"], r["near_next"]) for r in got if r["doc_id"] is None) == [(0, None), (len(prose(8, 40)), None)]


@pytest.fixture(scope="module")
def vocabulary():
    v = piece_sampler.Vocabulary.load()
    return v, v.tables()


def test_sampling_is_lossless_seeded_and_by_weight(vocabulary):
    v, tables = vocabulary
    texts = [t for t in ODD if t is not None] + ["<0x0A>", "\x00 ￿", "a\n\n b", "   ", "\r\n"]
    keys = np.arange(len(texts))
    ids = piece_sampler.encode_texts(texts, keys, v, tables)
    assert [piece_sampler.decode_ids(i.tolist(), v) for i in ids] == texts
    alone = [piece_sampler.encode_texts([t], keys[k:k + 1], v, tables)[0] for k, t in enumerate(texts)]
    assert all((a == b).all() for a, b in zip(ids, alone))
    n = 6000
    drawn = piece_sampler.encode_texts([" then"] * n, np.arange(n), v, tables)
    weights = {}
    for m in range(16):
        cuts = [0, *[i + 1 for i in range(4) if m >> i & 1], 5]
        parts = ["▁then"[a:b] for a, b in zip(cuts, cuts[1:])]
        if all(p in v.matches for p in parts):
            weights[tuple(v.matches[p][0] for p in parts)] = np.exp(sum(v.matches[p][1] for p in parts))
    total = sum(weights.values())
    for path, w in weights.items():
        assert abs(sum(tuple(d) == path for d in drawn) / n - w / total) < 0.03
    best = piece_sampler.encode_texts([" then"], np.array([3]), v, tables, best=True)[0]
    assert tuple(best) == max(weights, key=weights.get)


def test_encode_and_decode_columns(spark):
    docs = table(spark, ODD, ids=F.lit("clash"))
    for packed in (False, True):
        rows = piece_sampler.decode(piece_sampler.encode(docs, packed=packed), packed=packed)
        assert all(r["decoded"] == r["text"] for r in rows.collect()) and set(docs.columns) <= set(rows.columns)
    assert piece_sampler.encode(docs.limit(0)).count() == 0
