"""Document fingerprints by winnowing.

Grams are K consecutive pieces of a text: its words, and of words longer than WORD_MOST code points (text without blanks)
every code point, so that the pieces of a passage do not depend on where it stands. Of every WINDOW consecutive gram hashes the least is chosen, the rightmost where several are equal, and kept with its place. Two texts
that have ``K + WINDOW - 1`` pieces in a row in common therefore share a chosen hash, and no run below K pieces is ever
reported. Everything is built-in array functions; texts are shuffled once, to the range of ids that holds their neighbour.

Null and empty texts have no grams and an empty fingerprint; two empty fingerprints have likeness 1. A text with fewer
than K pieces has them all as its only gram. Repeated rows are fingerprinted each by itself; in the order of ids they
follow each other by text. A row with a null id has no place in that order: it has no next row, its edited text ends with
the part that is kept, and its likeness to the next document is null. Extra columns pass through ``fingerprints``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codonlake.llm.common import parts, register, table

K = 4
WINDOW = 12
WORD_MOST = 16


def _pieces(text: Column) -> Column:
    # a whole word, or one code point of a longer one
    one = r"[^\x20\x09-\x0D]"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?<!{one}){one}{{1,{WORD_MOST}}}+(?!{one})|{one}"), F.lit(0))


def fingerprints(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array<struct<hash long, place int>>, by place."""
    # names that no column has; columns stay attributes, so that a partitioning by one of them is still known after this
    p, g, least = (next(n for n in (f"_{name}{'_' * i}" for i in range(len(df.columns) + 1)) if n not in df.columns) for name in ("pieces", "grams", "least"))
    df = df.withColumn(p, _pieces(F.col(text)))
    df = df.withColumn(g, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(p) - K, F.lit(0))),
        lambda i: F.struct(F.xxhash64(*[F.get(F.col(p), i + j) for j in range(K)]).alias("hash"), (-i).alias("back"))))
    # of equal hashes the smallest negative place, that is the rightmost, is least
    df = df.withColumn(least, F.when(F.size(p) > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(g) - WINDOW + 1, F.lit(1))), lambda i: F.array_min(F.slice(F.col(g), i, WINDOW)))))
    # chosen places never go back, so a repeated choice is next to the first
    once = F.filter(F.col(least), lambda x, k: ~F.get(F.col(least), k - 1)["back"].eqNullSafe(x["back"]))
    chosen = F.transform(once, lambda x: F.struct(x["hash"].alias("hash"), (-x["back"]).alias("place")))
    return df.withColumn(out, F.coalesce(chosen, F.array().cast("array<struct<hash:bigint,place:int>>"))).drop(p, g, least)


def as_string(fingerprint: Column) -> Column:
    """hash:place in hexadecimal and decimal, comma-joined."""
    return F.concat_ws(",", F.transform(fingerprint, lambda x: F.concat(F.hex(x["hash"]), F.lit(":"), x["place"].cast("string"))))


def _hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: x["hash"]))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two columns of distinct hashes."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def _range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at most the value; two short searches, also for thousands of cuts."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    array = lambda numbers: F.array(*[F.lit(n).cast("long") for n in numbers])
    full = [g[-1] for g in groups if len(g) == step]
    group = F.size(F.filter(array(full), lambda b: b <= value)) if full else F.lit(0)
    inside = F.size(F.filter(F.coalesce(F.get(F.array(*map(array, groups)), group), F.array().cast("array<bigint>")), lambda b: b <= value))
    return group * step + inside


def with_next(docs: DataFrame, names: list[str], prepare=lambda df: df) -> DataFrame:
    """Adds ``next_<name>`` for columns of the next row by (doc_id, text), after the last row those of the first; null where
    doc_id is null.

    Rows are dealt by ranges of doc_id, each range with a copy of the first row of the range behind it, so texts are
    shuffled once. ``prepare`` may add columns after that shuffle, on rows with all columns of ``docs``. Bounds are
    quantiles: a few numbers per partition come to the driver.
    """
    spark = docs.sparkSession
    rows, lone = docs.where("doc_id IS NOT NULL"), prepare(docs.where("doc_id IS NULL"))
    without_next = lambda df: df.select("*", *[F.lit(None).cast(lone.schema[c].dataType).alias(f"next_{c}") for c in names])
    n = 4 * parts(spark)
    bounds = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    pid = _range_of(F.col("doc_id"), sorted({int(b) for b in bounds}))
    firsts = [r[0] for r in rows.groupBy(pid.alias("p")).agg(F.min("doc_id").alias("first")).orderBy("p").select(F.struct("p", "first")).collect()]
    if not firsts:
        return without_next(lone.drop(*[f"next_{c}" for c in names]))
    before = {firsts[i]["first"]: firsts[i - 1]["p"] for i in range(len(firsts))}
    goes_to = F.get(F.array(*[F.lit(p) for p in before.values()]), F.array_position(F.array(*[F.lit(k).cast("long") for k in before]), F.col("doc_id")).cast("int") - 1)
    homes = F.array_compact(F.array(F.struct(F.lit(0).alias("guest"), pid.alias("range")),
                                    F.when(F.col("doc_id").isin(list(before)), F.struct(F.lit(1).alias("guest"), goes_to.alias("range")))))
    dealt = rows.select(F.struct("*").alias("_row"), F.explode(homes).alias("_home")).select("_row", "_home.range", "_home.guest").repartition("range")
    made = prepare(dealt.select("_row.*", F.col("range").alias("_range"), F.col("guest").alias("_guest")))
    kept = [c for c in made.columns if c not in {"_range", "_guest", *(f"next_{n}" for n in names)}]
    window = Window.partitionBy("_range").orderBy("_guest", "doc_id", "text")
    placed = made.select(*kept, "_guest", F.lead(F.struct(*names)).over(window).alias("_next")).where("_guest = 0").select(
        *kept, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in names])
    return placed.unionByName(without_next(lone.select(*kept)))


@register("op7_winnowing")
def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and likeness to both neighbours."""
    docs = with_next(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["text", "hf"],
                     lambda df: fingerprints(df, "text", "f").withColumn("hf", _hashes(F.col("f"))))
    n = F.length("text")
    cut = F.floor(n / 2).cast("int")
    df = docs.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - cut), F.coalesce(F.substring("next_text", F.lit(1), cut), F.lit(""))))
    df = fingerprints(df, "edited", "e").withColumn("he", _hashes(F.col("e")))
    return df.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_string(F.col("f")).alias("fingerprint"),
                     as_string(F.col("e")).alias("edited_fingerprint"), likeness("hf", "he").alias("near_edited"),
                     F.when(F.col("next_hf").isNotNull(), likeness("hf", "next_hf")).alias("near_next"))
