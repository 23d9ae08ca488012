"""Mixing sources to target weights by weighted fair queueing.

Every source has a weight and thereby a target of words. Its documents, in a shuffled order that only their ids decide,
get virtual finish times: words of the source so far, divided by the source's target. Sources whose target exceeds
their size go round again, three times at most. Documents of all sources are then sorted by finish time over the whole
cluster and the list is cut where the words reach the budget, so each source ends close to its target at any cut.

Only (id, source, size) take part in the sorts; texts are joined back by those. Running sums go over range partitions,
so a source with most rows spans many tasks.

A null text has no words, a null source is a source of its own that sorts last. Repeated rows (same id, source, size)
are decided together. Documents without words are never taken. Extra columns are kept by ``mixed_documents``. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codonlake.llm.common import join_hot, register, stored, table, word_array
from codonlake.operators.distribute import running_total

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: A source, and so a document, is taken so many times at most.
MOST_ROUNDS = 3


def _sized(docs: DataFrame) -> DataFrame:
    """Narrow rows; ``src`` is the source as a key that is never null and sorts null last."""
    return docs.select("doc_id", F.size(word_array(F.col("text"))).cast("long").alias("size"),
                       F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")).alias("src"))


def targets(sized: DataFrame) -> DataFrame:
    """Per source: rows, source_size, target. Targets stop at MOST_ROUNDS sizes; the excess goes to the others by weight."""
    sources = sized.groupBy("src").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    numbered = running_total(sources, [], ["src"], "one", "place")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    numbered = stored(numbered.select("src", "rows", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * MOST_ROUNDS).alias("cap")))
    budget = numbered.agg(F.sum("source_size")).first()[0] or 0
    # the level up to which all uncapped sources are filled, per unit of weight; each round returns two numbers
    level, capped = 0.0, F.lit(False)
    while True:
        left, weights = numbered.agg(F.lit(budget) - F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)),
                                     F.sum(F.when(~capped, F.col("weight")))).first()
        if not weights or left / weights <= level:
            break
        level = left / weights
        capped = F.col("weight") * F.lit(level) > F.col("cap")
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level))
    return numbered.select("src", "rows", "source_size", target.alias("target"))


def decisions(sized: DataFrame) -> DataFrame:
    """Per distinct (doc_id, src, size): source_size, target and the number of times that the mix takes it."""
    sized = stored(sized)
    goals = stored(targets(sized))
    total = sized.count()
    budget = goals.agg(F.sum("source_size")).first()[0] or 0
    units = sized.groupBy("doc_id", "src", "size").agg(F.count("*").alias("times")).withColumn("words", F.col("size") * F.col("times"))
    units = units.withColumn("shuffled", F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    units = running_total(units, ["src"], ["shuffled", "doc_id", "size"], "words", "before")
    units = stored(join_hot(units, goals, "src", "rows", total))
    rounds = F.when((F.col("size") > 0) & (F.col("target") > 0), F.sequence(F.lit(0), F.least(F.ceil(F.col("target") / F.col("source_size")), F.lit(MOST_ROUNDS)).cast("int") - 1))
    finish = (F.col("turn") * F.col("source_size") + F.col("before")) / F.col("target")
    queue = units.select("doc_id", "src", "shuffled", "words", "before", "source_size", "target", F.explode(rounds).alias("turn"))
    queue = running_total(queue.select("src", "shuffled", "doc_id", "words", finish.alias("finish")), [], ["finish", "src", "shuffled", "doc_id"], "words", "so_far")
    place = F.struct("finish", "src", "shuffled")
    last = queue.where(F.col("so_far") <= budget).agg(F.max(place).alias("last"))  # one row
    chosen = units.crossJoin(F.broadcast(last))
    taken = F.size(F.filter(F.coalesce(rounds, F.array().cast("array<int>")), lambda turn: F.struct(
        ((turn * F.col("source_size") + F.col("before")) / F.col("target")).alias("finish"), F.col("src"), F.col("shuffled")) <= F.col("last")))
    return chosen.select("doc_id", "src", "size", "source_size", "target", taken.alias("rounds"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, each as many times as it is taken, with all columns of ``docs``."""
    chosen = decisions(_sized(docs)).where("rounds > 0").select(F.col("doc_id").alias("_id"), F.col("src").alias("_src"), F.col("size").alias("_size"), "rounds")
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.size(word_array(F.col("text"))).cast("long").alias("_size"),
                        F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")).alias("_src")).alias("l")
    on = F.col("l._id").eqNullSafe(F.col("r._id")) & (F.col("l._src") == F.col("r._src")) & (F.col("l._size") == F.col("r._size"))
    joined = keyed.join(chosen.alias("r"), on)
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("rounds"))).alias("_turn")).select("_row.*")


_ORACLE = r"""
WITH d AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, coalesce('0' || source, '1') AS src FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY src) - 1) % 3 AS weight FROM d GROUP BY src),
c AS (SELECT *, sum(source_size * 3) OVER q AS capped, sum(weight) OVER q AS gone, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    3.0::DOUBLE * source_size / weight AS ratio FROM s WINDOW q AS (ORDER BY 3.0::DOUBLE * source_size / weight, src ROWS UNBOUNDED PRECEDING)),
n AS (SELECT *, coalesce(lag(capped) OVER (ORDER BY ratio, src), 0) AS capped0, coalesce(lag(gone) OVER (ORDER BY ratio, src), 0) AS gone0 FROM c),
v AS (SELECT first((total - capped0)::DOUBLE / (weights - gone0)::DOUBLE ORDER BY ratio, src) AS level FROM n WHERE ratio >= (total - capped0)::DOUBLE / (weights - gone0)::DOUBLE),
g AS (SELECT src, source_size, CASE WHEN level IS NULL OR weight * level > source_size * 3 THEN CAST(source_size * 3 AS DOUBLE) ELSE weight * level END AS target FROM s, v),
u AS (SELECT d.*, source_size, target, md5('mix:' || doc_id) AS shuffled,
    sum(size) OVER (PARTITION BY d.src ORDER BY md5('mix:' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM d JOIN g USING (src)),
q AS (SELECT *, (turn * source_size + cum)::DOUBLE / target AS finish FROM u, unnest(range(0, least(3, CAST(ceil(target / source_size) AS BIGINT)))) AS t(turn) WHERE size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, src, shuffled, doc_id ROWS UNBOUNDED PRECEDING) AS so_far FROM q),
k AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM o WHERE so_far <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM u LEFT JOIN k USING (doc_id)
"""


@register("op9_source_mix", _ORACLE)
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    sized = stored(_sized(table(spark, sf_dir, "documents")))
    chosen = decisions(sized).select(F.col("doc_id").alias("_id"), F.col("src").alias("_src"), F.col("size").alias("_size"), "source_size", "target", "rounds").alias("r")
    on = F.col("l.doc_id").eqNullSafe(F.col("r._id")) & (F.col("l.src") == F.col("r._src")) & (F.col("l.size") == F.col("r._size"))
    return sized.alias("l").join(chosen, on).select("doc_id", "size", "source_size", "target", (F.col("rounds") * F.col("size")).cast("long").alias("taken"))
