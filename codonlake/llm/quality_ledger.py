"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and keeps its measurements and one long of failure bits. Policies are
versioned sets of rules, held as masks: ``apply_policy`` and ``ablation`` read the stored bits only, so trying another
policy touches no text. All of it is built-in column functions in one pass without a shuffle; the ablation is one
aggregate over the masks.

Null and empty texts have no words, so they fail ``too_few_words``. Repeated rows are judged each by itself. Extra
columns pass through, but columns with the names of measurements are replaced. An empty table gives an empty ledger,
and an ablation with zero counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codonlake.llm.common import GAP, register, table, word_array

# --- fixed values: the measured symbols
SYMBOLS = "#*$%&|<>"

#: Rules in the order of their bits: name and condition of failure over the measurements. New rules go to the end.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 50"),
    ("repeated_phrases", "100 * n_repeat_words > 50 * n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("many_symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    ("no_letters", "5 * n_letters < 3 * word_chars"),
    ("all_capitals", "2 * n_capitals > word_chars"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Policies by version: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_phrases"),
    "v1": ("too_few_words", "repeated_phrases", "word_length", "many_symbols", "repeated_lines", "no_letters"),
    "v2": ("too_few_words", "repeated_phrases", "word_length", "many_symbols", "repeated_lines", "no_letters", "all_capitals"),
}
CURRENT = "v2"


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _sorted_windows(words: Column) -> Column:
    """3-word windows with their places, sorted by hash, so that equal windows are neighbours."""
    windows = F.when(F.size(words) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))
    return F.sort_array(windows)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measurements of all rules."""
    t = F.coalesce(F.col("_t"), F.lit(""))
    letters = F.regexp_replace(t, r"\P{L}+", "")
    df = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_t")).withColumn("_w", word_array(F.col("_t"))).withColumn("_squeezed", F.regexp_replace(t, GAP, ""))
    df = df.withColumn("_lines", F.filter(F.split(t, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("_letters", letters)
    df = df.withColumn("_sorted", _sorted_windows(F.col("_w")))
    # a window is repeated if a neighbour in the sorted list has its hash
    df = df.withColumn("_places", F.sort_array(F.transform(F.filter(F.col("_sorted"), lambda x, k: (
        (F.get(F.col("_sorted"), k - 1)["h"].eqNullSafe(x["h"])) | (F.get(F.col("_sorted"), k + 1)["h"].eqNullSafe(x["h"])))), lambda x: x["i"])))
    # each repeated window covers its three words; the ascending places give the size of the union
    covered = F.aggregate(
        F.transform(F.col("_places"), lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col("_places"), k + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    measured = {
        "n_words": F.size("_w"),
        "word_chars": F.length("_squeezed"),
        "n_symbols": F.length("_squeezed") - F.length(F.translate("_squeezed", SYMBOLS, "")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_letters": F.length("_letters"),
        "n_capitals": F.length(F.regexp_replace("_letters", r"\P{Lu}+", "")),
    }
    # a generated row is where the optimiser stops to move filters, which would evaluate all this once per use
    row = F.explode(F.array(F.struct(*[m.cast("long").alias(name) for name, m in measured.items()])))
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c not in measured]
    return df.select("_row", row.alias("_m")).select(*kept, "_m.*")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measurements and ``fail_bits``: bit i is set if rule i of RULES fails."""
    bits = F.lit(0).cast("long")
    for name, failed in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs.drop("fail_bits"), text).withColumn("fail_bits", bits)


def apply_policy(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds ``kept`` and the ``policy`` that decided."""
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0).withColumn("policy", F.lit(policy))


def ablation(entries: DataFrame) -> DataFrame:
    """Per policy and rule of it: documents that fail the rule, and those that only this rule rejects."""
    bits, sums = F.col("fail_bits"), []
    for policy, names in POLICIES.items():
        m = F.lit(mask(policy)).cast("long")
        for name in names:
            b = F.lit(BIT[name]).cast("long")
            sums.append(F.struct(F.lit(policy).alias("policy"), F.lit(name).alias("rule"),
                                 F.coalesce(F.sum(F.when(bits.bitwiseAND(b) != 0, 1)), F.lit(0)).alias("fails"),
                                 F.coalesce(F.sum(F.when(bits.bitwiseAND(m) == b, 1)), F.lit(0)).alias("only_this")))
    return entries.agg(F.array(*sums).alias("r")).select(F.explode("r").alias("r")).select("r.*")


_ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l,
    regexp_replace(t, '\P{L}+', '', 'g') AS a FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM m, unnest(range(1, len(w) - 1)) AS u(i)),
p AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM p, unnest([0, 1, 2]) AS v(k) GROUP BY doc_id),
f AS (SELECT m.*, coalesce(r.n, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    len(a) AS n_letters, len(regexp_replace(a, '\P{Lu}+', '', 'g')) AS n_capitals FROM m LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > 3 * n_words
        OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines) OR 5 * n_letters < 3 * word_chars OR 2 * n_capitals > word_chars) AS kept,
    CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT
        + 8 * (10 * n_symbols > 3 * n_words)::INT + 16 * (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)::INT + 32 * (5 * n_letters < 3 * word_chars)::INT
        + 64 * (2 * n_capitals > word_chars)::INT AS BIGINT) AS fail_bits
FROM f
"""


@register("op3_quality_ledger", _ORACLE)
def op3_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the current policy."""
    base = F.lit(mask("base")).cast("long")
    return apply_policy(ledger(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(base) != 0).alias("base_failed"), "kept", "fail_bits")
