"""The manifest against a plain tree, over odd tables, with few and with many levels a step."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from codonlake.llm import merkle

from llm_helpers import DOC, ODD, prose


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    i, text, lang, source, n = row
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k:k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def plain(rows):
    runs = {}
    for row in rows:
        runs.setdefault(row[2], []).append(row)
    names = sorted(runs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        runs[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[name] = levels([leaf_of(r) for r in runs[name]])
    top = levels([trees[n][-1][0] for n in names])
    out = []
    for place, name in enumerate(names):
        for pos, row in enumerate(runs[name]):
            now = changed = row
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0:
                changed = (*row[:4], row[4] + 1)
            now, siblings = leaf_of(changed), []
            for tree, at in ((trees[name], pos), (top, place)):
                for level in tree[:-1]:
                    if at ^ 1 < len(level):
                        siblings.append(level[at ^ 1])
                        now = h(siblings[-1], now) if at % 2 else h(now, siblings[-1])
                    else:
                        now = h(now)
                    at //= 2
            out.append((row[0], leaf_of(row), trees[name][-1][0], top[-1][0], h(*siblings), now, now == top[-1][0]))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, DOC).withColumn("g", F.lit("clash")).withColumn("node", F.lit(1))


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def odd_rows():
    rows = [(i, t, ["en", "de", None, "", "日本"][i % 5], f"s{i % 3}" if i % 4 else None, None if t is None else len(t)) for i, t in enumerate(ODD)]
    rows += [(100 + i, prose(i, 5), "en", "hot", 2**63 - 1 if i % 9 == 0 else i) for i in range(70)]
    return rows + [rows[3]] * 3 + [(3, "other", *rows[3][2:]), (None, "no id", "en", None, 5), (None, None, None, None, None)]


@pytest.mark.parametrize("step, broadcast", [(2, True), (3, False), (merkle.LEVELS, True)])
def test_manifest_equals_plain_trees(spark, monkeypatch, step, broadcast):
    monkeypatch.setattr(merkle, "LEVELS", step)
    rows = odd_rows()
    if broadcast:
        got = merkle.verified_documents(table(spark, rows))
    else:
        narrow = merkle.climbed
        monkeypatch.setattr(merkle, "climbed", lambda m, c: narrow(m, c, broadcast_bytes=-1, copies=4))
        got = merkle.verified_documents(table(spark, rows))
    want = plain(rows)
    assert rows_of(got) == want
    assert 0 < sum(not r[-1] for r in want) < len(want) / 2


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_manifest_of_few_rows(spark, n):
    rows = [(i + 1, f"text {i}", "en", "s", i) for i in range(n)]
    assert rows_of(merkle.verified_documents(table(spark, rows))) == plain(rows)
    many = [(i + 1, f"text {i}", f"l{i}", "s", i) for i in range(n)]
    assert rows_of(merkle.verified_documents(table(spark, many))) == plain(many)
