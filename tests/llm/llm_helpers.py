"""Small document tables for these tests."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    syllables = ["ta", "lo", "ren", "mi", "su", "kan", "or", "ite"]
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


def table(spark, texts, **more):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).withColumns(more)


ODD = [None, "", " \t\n ", "one", "A b", "tab\there\x0bvertical", "ends\n", "naïve 日本語 🙂 word", "▁ mark ▁", "x" * 5000, prose(1, 3000),
       prose(2, 40), prose(2, 40), "same words " * 200, "4111 1111 1111 1111", "a@b.co c@d.e.f"]
