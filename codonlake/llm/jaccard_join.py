"""N-gram Jaccard join with adaptive multi-match prefixes.

Each document is a set of hashed word shingles in one global order: frequent shingles last, else by hash. A document's
l-prefix holds its first ``size - ceil(t * size) + l`` shingles; two documents whose similarity reaches t share at least
``min(l1, l2)`` shingles of their prefixes. Every document chooses its own l from the candidates that its prefix would
bring: a longer prefix costs more lookups but asks for more common shingles, so fewer pairs come to verification.

* Documents with equal sets go on as one.
* Pairs that meet in a shingle with few documents are joined, counted and verified on whole texts.
* Shingles with many documents (``HOT``) are not joined to themselves. The documents that they connect form a cluster;
  its documents are dealt into blocks, and each pair of blocks is verified within a task, which returns links only.

Rows are numbered once, and sets, classes and links know rows by that number, so ids need not be unique. In
``linked_components`` rows with one id are one document: their links, whatever their texts, count for that id. In
``one_of_each`` every row stands for itself. Rows with a null id are linked by their texts; their component is null if no
row with an id belongs to it. Nulls, empty texts and texts without words have an empty set and no links. Extra columns
are ignored by ``linked_components`` and kept by ``one_of_each``. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from codonlake.llm import arrays
from codonlake.llm.common import components, join_hot, register, rows_in, stored, table
from codonlake.session import ship_package

#: A shingle with at least so many documents among the first of their sets goes to the end of the order.
FREQUENT = 16
#: The order knows so many frequent shingles at most (8 bytes each); only the order, never the result, hangs on it.
FREQUENT_MOST = 1_000_000
#: A prefix is lengthened by so many shingles at most.
LONGEST = 4
#: Documents of one prefix shingle that are still paired by a join.
HOT = 64
#: Documents in a block of a hot cluster.
BLOCK = 256
#: Cost of a verification in lookups, for the choice of a prefix.
VERIFY = 16


def _least_shared(size, percent: int):
    """Smallest overlap with any partner: ceil(percent / 100 * size)."""
    return -((-percent * size) // 100)


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
    for s in arrays.slices(texts):
        grams, at = arrays.shingles(s.hashes(), s.first, k)
        yield s.rows, *arrays.distinct_by_row(grams, at)


def _frequent(docs: DataFrame, k: int, percent: int) -> np.ndarray:
    """Shingles that many documents have among their first ones by hash, twice as far as a prefix reaches."""
    def count(batches):
        for batch in batches:
            found = []
            for _, values, at in _sets(batch.column(0), k):
                size = np.diff(at)
                reach = np.minimum(size, 2 * (size - _least_shared(size, percent) + LONGEST))
                place = np.arange(values.size) - np.repeat(at[:-1], size)
                found.append(values[place < np.repeat(reach, size)])
            values, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int32))], ["gram", "n"])

    counts = stored(docs.select("text").mapInArrow(count, "gram long, n int").groupBy("gram").agg(F.sum("n").alias("n"))
                    .where(F.col("n") >= FREQUENT))
    by_size = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect()}  # 64 rows at most
    total, floor = 0, FREQUENT
    for b in sorted(by_size, reverse=True):
        total += by_size[b]
        if total > FREQUENT_MOST:
            floor = 2 ** (b + 1)
            break
    grams = counts.where(F.col("n") >= floor).select("gram").toArrow()["gram"].to_numpy()  # FREQUENT_MOST at most
    return np.sort(grams.astype(np.int64).view(np.uint64))


def prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Adds to the columns of ``docs``: size and digest of the set, the longest prefix in the global order."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, k, percent))

    def make(batches):
        late = shared.value
        for batch in batches:
            for (lo, hi), values, at in _sets(batch.column("text"), k):
                sizes = np.diff(at)
                digests, out, lengths = [], [], []
                if late.size:
                    held = late[np.minimum(np.searchsorted(late, values), late.size - 1)] == values
                else:
                    held = np.zeros(values.size, dtype=bool)
                for i in range(hi - lo):
                    own, last = values[at[i]:at[i + 1]], held[at[i]:at[i + 1]]
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    reach = min(own.size, int(own.size - _least_shared(own.size, percent) + LONGEST))
                    first = own[~last][:reach]
                    out += [first, own[last][:reach - first.size]]
                    lengths.append(reach)
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                grams = (np.concatenate(out) if out else np.empty(0, np.uint64)).view(np.int64)
                own_columns = [c.slice(lo, hi - lo) for c in batch.columns]
                yield pa.RecordBatch.from_arrays(
                    [*own_columns, pa.array(sizes.astype(np.int64)), pa.array(digests, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams))], [*batch.schema.names, "size", "digest", "prefix"])

    schema = StructType(docs.schema.fields + StructType.fromDDL("size long, digest binary, prefix array<long>").fields)
    return docs.mapInArrow(make, schema)


def _index(reps: DataFrame, percent: int) -> DataFrame:
    """Rows (gram, doc_id, size, need, df) of the prefixes that the documents chose; grams with one document are left out."""
    rows = reps.select("doc_id", "size", F.posexplode("prefix").alias("place", "gram"))
    df = rows.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    rows = stored(rows.join(df, "gram"))
    base = F.col("size") - F.ceil(F.lit(percent) * F.col("size") / 100)
    # lookups that a prefix of length l brings, and l as the divisor of the pairs that can come to verification
    sums = [F.sum(F.when(F.col("place") < base + l, F.col("df") - 1).otherwise(0)).alias(f"c{l}") for l in range(1, LONGEST + 1)]
    costs = rows.groupBy("doc_id").agg(*sums)
    options = F.array_min(F.array(*[F.struct((F.col(f"c{l}") * (1 + VERIFY / l)).alias("cost"), F.lit(l).alias("need")) for l in range(1, LONGEST + 1)]))
    chosen = costs.select("doc_id", options["need"].alias("need"))
    return rows.join(chosen, "doc_id").where(F.col("place") < base + F.col("need")).select("gram", "doc_id", "size", "need", "df")


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate((a, b))
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole texts reach the similarity. One text travels per pair, the other once per document."""
    texts = docs.select("doc_id", "text")
    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    rows = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def check(batches):
        for batch in batches:
            a = [v for _, values, at in _sets(batch.column("text_a"), k) for v in np.split(values, at[1:-1])]
            b = [v for _, values, at in _sets(batch.column("text_b"), k) for v in np.split(values, at[1:-1])]
            good = []
            for x, y in zip(a, b):
                n = _overlap(x, y)
                good.append(n > 0 and 100 * n >= percent * (x.size + y.size - n))
            kept = batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
            yield kept

    return rows.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def _block_links(members: DataFrame, docs: DataFrame, k: int, percent: int, forest: bool) -> DataFrame:
    """Links among the documents of each cluster (doc_id, cluster), found block by block."""
    blocks = members.groupBy("cluster").agg(F.count("*").alias("n")).select("cluster", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = (join_hot(members, blocks, "cluster", "n", members.count()).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
             .join(docs.select("doc_id", "text"), "doc_id")
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("cluster", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "doc_id", "text"))

    def link(group: pa.Table) -> pa.Table:
        ids, own = group["doc_id"].to_numpy(), group["own"].to_numpy()
        sets = [v for _, values, at in _sets(group["text"].combine_chunks(), k) for v in np.split(values, at[1:-1])]
        size = np.array([s.size for s in sets], dtype=np.int64)
        row = np.repeat(np.arange(size.size), size)
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        grams, begin, df = np.unique(flat[order], return_index=True, return_counts=True)
        holders = row[order]
        which = np.searchsorted(grams, flat)
        at = np.concatenate(([0], np.cumsum(size)))
        parent = list(range(size.size))
        two = group["lo"][0].as_py() != group["hi"][0].as_py()

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        out: list[tuple[int, int]] = []
        for i in range(size.size):
            if two and own[i] != group["lo"][0].as_py():
                continue
            g = which[at[i]:at[i + 1]]
            many = df[g]
            take = np.repeat(begin[g] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            shared = np.bincount(holders[take], minlength=size.size)
            good = np.flatnonzero((shared > 0) & (100 * shared >= percent * (size + size[i] - shared)))
            for j in good.tolist():
                if (own[j] == own[i] if two else j <= i):
                    continue
                if forest:
                    a, b = root(i), root(j)
                    if a == b:
                        continue
                    parent[a] = b
                out.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return dealt.groupBy("cluster", "lo", "hi").applyInArrow(link, "a long, b long")


def _links(docs: DataFrame, reps: DataFrame, k: int, percent: int, forest: bool) -> DataFrame:
    index = stored(_index(reps, percent))
    few, many = index.where(F.col("df") <= HOT), index.where(F.col("df") > HOT)
    a = few.select("gram", F.col("doc_id").alias("a"), F.col("size").alias("size_a"), F.col("need").alias("need_a"))
    b = few.select("gram", F.col("doc_id").alias("b"), F.col("size").alias("size_b"), F.col("need").alias("need_b"))
    fits = (F.col("a") < F.col("b")) & (F.col("size_a") * 100 >= F.col("size_b") * percent) & (F.col("size_b") * 100 >= F.col("size_a") * percent)
    pairs = stored(a.join(b, "gram").where(fits).groupBy("a", "b").agg(F.count("*").alias("shared"), F.first(F.least("need_a", "need_b")).alias("need"))
                   .where("shared >= need").select("a", "b"))
    first = stored(many.groupBy("gram").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")))
    star = join_hot(many.select("gram", F.col("doc_id").alias("a")), first, "gram", "n", many.count()).select("a", "b").distinct()
    clusters = stored(components(star).select(F.col("id").alias("doc_id"), F.col("component").alias("cluster")))
    asked = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).unionByName(clusters.select("doc_id"))
    docs = rows_in(docs.select("doc_id", "text"), asked, "doc_id")  # only the texts that are compared are moved
    return stored(_verified(pairs, docs, k, percent).unionByName(_block_links(clusters, docs, k, percent, forest)))


def _grouped(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their sets and a number each; a row per different set (digest, first, n); these sets with their prefixes.

    ``first`` is the row of a set with the least id, null last: (no_id, doc_id, row). The number of that row is the id of
    the set in all that follows. The numbers are stored with the rows, so a task that runs again cannot change them.
    """
    sets = stored(prefixes(docs, k, percent).withColumn("row", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    classes = stored(sets.where("size > 0").groupBy("digest").agg(first, F.count("*").alias("n")))
    reps = rows_in(sets.select("row", "size", "prefix"), classes.select(F.col("first.row").alias("row")), "row")
    return sets, classes, reps.withColumnRenamed("row", "doc_id")


def _by_row(sets: DataFrame) -> DataFrame:
    return sets.select(F.col("row").alias("doc_id"), "text")


def _with_least(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` with ``least``: the least ``first`` that links (a, b) between rows reach."""
    parts_of = components(links)
    grouped = stored(classes.select("digest", "n", "first", F.col("first.row").alias("row")).join(parts_of.withColumnRenamed("id", "row"), "row", "left"))
    tied = grouped.where("component IS NOT NULL")
    least = stored(tied.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("size")))
    return stored(join_hot(tied, least, "component", "size", tied.count()).select("digest", "n", "first", "least")
                  .unionByName(grouped.where("component IS NULL").select("digest", "n", "first", F.col("first").alias("least"))))


def linked_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) for every row of (doc_id long, text string).

    component_id is the least id that links reach. Links are those of Jaccard similarity percent / 100 or more.
    """
    sets, classes, reps = _grouped(docs.select("doc_id", "text"), k, percent)
    links = _links(_by_row(sets), reps, k, percent, True)
    total = sets.count()
    # ids that stand in rows with different sets tie these sets together, as links do
    held = sets.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.count("*").alias("m"))
    repeated = stored(held.where("doc_id IS NOT NULL AND lo <> hi").select("doc_id", "m", F.lit(True).alias("repeated")))
    with_sets = (join_hot(sets.where("size > 0").select("doc_id", "digest"), repeated, "doc_id", "m", total).select("doc_id", "digest").distinct()
                 .join(classes.select("digest", F.col("first.row").alias("row")), "digest"))
    of_id = stored(with_sets.select("doc_id", "row"))
    hub = stored(of_id.groupBy("doc_id").agg(F.min("row").alias("b"), F.count("*").alias("n")))
    by_id = join_hot(of_id, hub, "doc_id", "n", of_id.count()).select(F.col("row").alias("a"), "b")
    of_class = _with_least(classes, links.unionByName(by_id))
    rows = join_hot(sets.select("doc_id", "size", "digest"), of_class.select("digest", "n", F.col("least.doc_id").alias("component")), "digest", "n", total, "left")
    # a row without a set shares the component of its id
    id_component = stored(of_id.join(of_class.select(F.col("first.row").alias("row"), F.col("least.doc_id").alias("of_id")), "row")
                          .groupBy("doc_id").agg(F.min("of_id").alias("of_id")).join(repeated.select("doc_id", "m"), "doc_id"))
    empty = join_hot(rows.where("size = 0"), id_component, "doc_id", "m", total, "left")
    return (rows.where("size > 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))
            .unionByName(empty.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("of_id", "doc_id").alias("component_id"))))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, more columns) without near duplicates: of each group of linked rows the one with
    the least id, null last; rows without words all stay."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*others).alias("others")) if others else docs.select("doc_id", "text")
    sets, classes, reps = _grouped(packed, k, percent)
    of_class = _with_least(classes, _links(_by_row(sets), reps, k, percent, True))
    chosen = of_class.select(F.col("least.row").alias("row")).distinct()
    kept = rows_in(sets.where("size > 0"), chosen, "row").unionByName(sets.where("size = 0"))
    return kept.select(*[c if c in ("doc_id", "text") else F.col("others").getField(c).alias(c) for c in docs.columns])


def similar_pairs(docs: DataFrame, k: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """All links (a, b) between class representatives, and the membership (doc_id, class_id) of all rows with a set.

    A class is known by its least id; links between sets of one id are left out.
    """
    sets, classes, reps = _grouped(docs.select("doc_id", "text"), k, percent)
    found = stored(_links(_by_row(sets), reps, k, percent, False))
    name = classes.select("first.row", F.col("first.doc_id").alias("id"))
    links = (found.join(name.select(F.col("row").alias("a"), F.col("id").alias("id_a")), "a").join(name.select(F.col("row").alias("b"), F.col("id").alias("id_b")), "b")
             .where("id_a <> id_b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct())
    of = classes.select("digest", "n", F.col("first.doc_id").alias("class_id"))
    return links, join_hot(sets.where("size > 0").select("doc_id", "digest"), of, "digest", "n", sets.count()).select("doc_id", "class_id")


_ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM d),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.gram = b.gram AND a.doc_id <> b.doc_id
    AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id)
SELECT g.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(c) FROM r WHERE r.id = g.doc_id) AS component_id FROM g
"""


@register("op10_jaccard_join", _ORACLE)
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 4-word shingles and similarity 0.85."""
    return linked_components(table(spark, sf_dir, "documents"))
