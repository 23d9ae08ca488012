"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text.

Counts, continuation counts, discounts and back-off weights are aggregates and joins over n-gram keys, sharded by Spark.
The model is fitted on ``FIT_PART`` of the trusted documents (by a hash of the id) and the thresholds on all the others, so
every trusted document has its part in one of the two.

The log probability of a text is a sum of one value per trigram, pair and word: a trigram's value is what it adds to the
back-off from its context to the pair, a pair's or word's what it adds as target and as context. So a look-up needs no other,
and the values are dealt by key: the distinct n-grams of each slice of texts travel in packed arrays (seven bytes of their
hash, ascending, byte by byte, so that part of them compresses) to the shard of their key, and the values of those that the
model knows travel back to the slice, which is read again and adds them up. Memory is bounded by a shard and a slice.

Thresholds are quantiles of the mean log perplexity of the trusted documents that the model was not fitted on, per language;
languages with under ``FEW`` of those take the quantile of all.

A null or empty text has no n-grams: perplexity null, not kept. A null language is a language. Repeated rows are scored
each by itself. Extra columns are ignored. An empty table gives an empty result; without trusted text nothing is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codonlake.llm import arrays
from codonlake.llm.common import drop, join_hot, register, stored, table
from codonlake.session import ship_package

#: Part of the trusted documents that the model is fitted on; the others set the thresholds.
FIT_PART = 0.7
#: Bytes of a key that is looked up.
KEY_BYTES = 7
#: Bytes of text, and rows of the model, for each shard.
SHARD_BYTES, SHARD_ROWS = 16_000_000, 1_000_000
QUANTILE = 0.99
#: Added to a threshold, in nats per word, for documents unlike the held-out ones.
MARGIN = 0.25
FEW = 30

_LEFT_OUT = np.uint64(64 - 8 * KEY_BYTES)
_START, _END = np.uint64(1), np.uint64(2)
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[ord(c) for c in ".,;:"]] = True


def _grams(s: arrays.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, c, texts, first): every word and end mark with its two predecessors, for the texts of a slice with words.

    A word is taken without stops at its end, unless it is nothing else.
    """
    end = s.end
    while True:
        stop = _STOPS[s.data[end - 1]] & (end - 1 > s.start)
        if not stop.any():
            break
        end = end - stop
    s.end = end
    words, counts = s.hashes(), np.diff(s.first)
    texts = np.flatnonzero(counts)
    n = counts[texts]
    begin = np.concatenate(([0], np.cumsum(n + 3)))
    flat = np.full(int(begin[-1]), _START)
    flat[begin[1:] - 1] = _END
    flat[np.arange(words.size) + np.repeat(2 + 3 * np.arange(texts.size), n)] = words
    at = np.arange(flat.size) - np.repeat(begin[:-1], n + 3)
    c = np.flatnonzero(at >= 2)
    return flat[c - 2], flat[c - 1], flat[c], texts, np.concatenate(([0], np.cumsum(n + 1)))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return arrays.mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def _triples(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for s in arrays.slices(batch.column(0), fold=False):
                a, b, c, _, _ = _grams(s)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b, c)], ["a", "b", "c"])

    return docs.select("text").mapInArrow(run, "a long, b long, c long")


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts for counts of one, two, and three or more, from the counts of counts."""
    n = {r["n"]: r["k"] for r in counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.1), i + 0.9) for i, d in enumerate(found)]


def _discount(d: list[float]) -> Column:
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


def _micronats(x: Column) -> Column:
    """Whole micronats, so that sums do not depend on their order."""
    return F.round(x * 1e6).cast("long").alias("value")


def _keyed(rows: DataFrame, *names: str) -> DataFrame:
    """Rows (key, value) of n-grams given by their words."""
    def run(batches):
        for batch in batches:
            words = [batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in names]
            key = words[0] if len(words) > 1 else arrays.mix(words[0])  # start and end are small numbers
            for w in words[1:]:
                key = _pair(key, w)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("value")], ["key", "value"])

    return rows.select(*names, "value").mapInArrow(run, "key long, value long")


def _looked_up(asked: pa.Table, model: pa.Table) -> pa.Table:
    """For each slice, which of its n-grams are in this shard of the model, and their values."""
    known = model.column("key").to_numpy().astype(np.int64, copy=False).view(np.uint64) >> _LEFT_OUT
    order = np.argsort(known)
    known, value = known[order], model.column("value").to_numpy()[order].astype(np.int32)
    found, values = [], []
    for b in asked.column("keys").to_pylist():
        keys = arrays.unplaned(b, KEY_BYTES) >> _LEFT_OUT
        at = np.minimum(np.searchsorted(known, keys), max(known.size - 1, 0))
        hit = known[at] == keys if known.size else np.zeros(keys.size, bool)
        found.append(np.packbits(hit).tobytes())
        values.append(value[at[hit]].tobytes())
    return pa.table([asked.column("slice"), asked.column("shard"), pa.array(found, pa.binary()), pa.array(values, pa.binary())], ["slice", "shard", "found", "values"])


def _keys(s: arrays.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text) of all trigrams, pairs and words of a slice, contexts before the first word included; its texts with words and where their n-grams begin."""
    a, b, c, texts, first = _grams(s)
    starts, owner = first[:-1], np.repeat(texts, np.diff(first))
    pair = _pair(b, c)
    keys = np.concatenate((_pair(_pair(a, b), c), pair, arrays.mix(c), _pair(a[starts], b[starts]), arrays.mix(b[starts])))
    return keys, np.concatenate((owner, owner, owner, texts, texts)), texts, first


def _summed(slices: pa.Table, answers: pa.Table, shards: int, unknown: int) -> pa.Table:
    """Rows (doc_id, lang, n_grams, log_perplexity) of a slice of texts, from the values of its n-grams."""
    if slices.num_rows != 1:
        raise RuntimeError("the texts came in other slices when they were read again")
    ids, langs, texts = (slices.column(c).combine_chunks().flatten() for c in ("ids", "langs", "texts"))
    (s,) = arrays.slices(texts, fold=False)
    every, owner, some, first = _keys(s)
    keys, which = np.unique(every >> _LEFT_OUT << _LEFT_OUT, return_inverse=True)
    bounds, value, seen = arrays.shard_bounds(keys, shards), np.zeros(keys.size, np.int64), 0
    for shard, found, values in zip(*(answers.column(c).to_pylist() for c in ("shard", "found", "values"))):
        lo, hi = bounds[shard], bounds[shard + 1]
        value[lo + np.flatnonzero(np.unpackbits(np.frombuffer(found, np.uint8), count=hi - lo))] = np.frombuffer(values, np.int32)
        seen += hi - lo
    if seen != keys.size:
        raise RuntimeError("the texts came in other slices when they were read again")
    n = np.zeros(len(ids), np.int64)
    n[some] = np.diff(first)
    total = np.bincount(owner, weights=value[which], minlength=len(ids))  # whole micronats, so the sums are exact
    mean = -(total / np.maximum(n, 1) + unknown) / 1e6
    return pa.table({"doc_id": ids, "lang": langs, "n_grams": n, "log_perplexity": pa.array(mean, mask=n == 0)})


class Model:
    """The fitted model: ``values`` (key, value) of all its n-grams, and the value of a word that it does not know."""

    def __init__(self, trusted: DataFrame):
        ship_package(trusted.sparkSession)
        c3 = stored(_triples(trusted).groupBy("a", "b", "c").agg(F.count("*").alias("n")))
        c2 = stored(c3.groupBy("b", "c").agg(F.count("*").alias("n")))
        c1 = stored(c2.groupBy("c").agg(F.count("*").alias("n")))
        d3, d2, d1 = _discounts(c3), _discounts(c2), _discounts(c1)
        words, total, taken = c1.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(_discount(d1)), F.lit(0.0))).first()
        rest = (taken / total if total else 1.0) / (words + 1)
        self.unknown = round(1e6 * math.log(rest))
        p1 = stored(c1.select("c", ((F.col("n") - _discount(d1)) / max(total, 1) + rest).alias("p1")))
        context2 = stored(c2.groupBy("b").agg(F.sum("n").alias("m"), (F.sum(_discount(d2)) / F.sum("n")).alias("w2")))
        p2 = stored(c2.join(context2, "b").join(p1, "c").select(
            "b", "c", (F.col("w2") * F.col("p1")).alias("low"), ((F.col("n") - _discount(d2)) / F.col("m") + F.col("w2") * F.col("p1")).alias("p2")))
        context3 = stored(c3.groupBy("a", "b").agg(F.sum("n").alias("m"), (F.sum(_discount(d3)) / F.sum("n")).alias("w3")))
        low = F.col("w3") * F.col("p2")
        nothing = F.lit(0.0)
        singles = stored(_keyed(p1.join(context2.select(F.col("b").alias("c"), "w2"), "c", "full").select(
            "c", _micronats(F.coalesce(F.log(F.col("p1") / rest), nothing) + F.coalesce(F.log("w2"), nothing))), "c"))
        drop(c2, c1, p1)
        pairs = stored(_keyed(p2.join(context3.select(F.col("a").alias("b"), F.col("b").alias("c"), "w3"), ["b", "c"], "full").select(
            "b", "c", _micronats(F.coalesce(F.log(F.col("p2") / F.col("low")), nothing) + F.coalesce(F.log("w3"), nothing))), "b", "c"))
        own = stored(c3.join(context3, ["a", "b"]).select("a", "b", "c", ((F.col("n") - _discount(d3)) / F.col("m")).alias("own"), "w3"))
        drop(c3, context2, context3)
        triples = stored(_keyed(own.join(p2.select("b", "c", "p2"), ["b", "c"]).select("a", "b", "c", _micronats(F.log((F.col("own") + low) / low))), "a", "b", "c"))
        drop(own, p2)
        self.values = triples.unionByName(pairs).unionByName(singles)

    def score(self, docs: DataFrame) -> DataFrame:
        """Rows (doc_id, lang, n_grams, log_perplexity) of all documents (doc_id, text, lang)."""
        docs = stored(docs.select("doc_id", "lang", "text", F.monotonically_increasing_id().alias("row")))
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards, unknown = max(1, math.ceil(size / SHARD_BYTES), math.ceil(self.values.count() / SHARD_ROWS)), self.unknown

        def ask(batches):
            """One row per slice and shard with the distinct n-grams that go there."""
            for s, own in arrays.numbered_slices(batches, fold=False):
                keys = np.unique(_keys(s)[0] >> _LEFT_OUT << _LEFT_OUT)
                bounds = arrays.shard_bounds(keys, shards)
                some = np.flatnonzero(np.diff(bounds)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([own.column("row")[0].as_py()] * len(some), pa.int64()), pa.array(some, pa.int32()),
                                                  pa.array([arrays.planes(keys[bounds[k]:bounds[k + 1]], KEY_BYTES) for k in some], pa.binary())], ["slice", "shard", "keys"])

        def pack(batches):
            for s, own in arrays.numbered_slices(batches, fold=False):
                ends = pa.array([0, own.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([own.column("row").slice(0, 1), *(pa.ListArray.from_arrays(ends, own.column(c)) for c in ("doc_id", "lang", "text"))],
                                                 ["slice", "ids", "langs", "texts"])

        model = self.values.withColumn("shard", F.expr(f"cast(shiftright(shiftrightunsigned(key, 40) * {shards}, 24) as int)"))
        answers = stored(docs.select("row", "text").mapInArrow(ask, "slice long, shard int, keys binary").groupBy("shard").cogroup(model.groupBy("shard"))
                         .applyInArrow(_looked_up, "slice long, shard int, found binary, values binary"))
        packed = docs.mapInArrow(pack, "slice long, ids array<long>, langs array<string>, texts array<string>")
        return packed.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(
            lambda t, u: _summed(t, u, shards, unknown), "doc_id long, lang string, n_grams long, log_perplexity double")


def classify(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """Rows (doc_id, lang, n_grams, log_perplexity, threshold, kept) for documents (doc_id, text, lang).

    ``trusted_ids``: doc_id of trusted documents.
    """
    part = F.pmod(F.xxhash64("doc_id", F.lit("kn")), F.lit(1_000_000)) / 1e6
    ids = stored(trusted_ids.select("doc_id").distinct().withColumn("part", part))
    model = Model(docs.select("doc_id", "text").join(ids.where(F.col("part") < FIT_PART).select("doc_id"), "doc_id", "left_semi"))
    of = F.coalesce(F.concat(F.lit("0"), F.col("lang")), F.lit("1")).alias("of")
    scored = stored(model.score(docs).withColumn("of", of))
    held = stored(scored.join(ids.where(F.col("part") >= FIT_PART).select("doc_id"), "doc_id"))
    at = F.percentile_approx("log_perplexity", quantile, 10000)
    overall = held.agg(at).first()[0]
    limits = stored(held.groupBy("of").agg(at.alias("limit"), F.count("*").alias("n")).where(F.col("n") >= FEW))
    limit = F.coalesce("limit", F.lit(overall).cast("double")) + margin
    return join_hot(scored, limits, "of", "n", max(1, held.count()), "left").select(
        "doc_id", "lang", "n_grams", "log_perplexity", limit.alias("threshold"), F.coalesce(F.col("log_perplexity") <= limit, F.lit(False)).alias("kept"))


@register("op5_kneser_ney")
def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log perplexity of all documents under trusted text, and whether they stay."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    return classify(table(spark, sf_dir, "documents"), trusted)
