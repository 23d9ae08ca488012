"""Hard negatives by a multiway tree of split points with distance ranges (GNAT), searched by annuli.

Vectors become whole numbers and are lifted by one more component to equal length, so that an inner product with an anchor
is a distance to it, and a window of inner products an annulus. A tree node has a few split points, far from each other;
a row belongs to the nearest one. For every pair of split points of a node the tree has the least and largest distance from the
one to all rows of the other. A search drops a sibling when, seen from any split point, its range and the annulus of the
window cannot meet (triangle inequality), and goes through the leaves that are left row by row in exact integers, so
the result is exact whatever the tree.

The tree is fitted on ``SAMPLE`` rows at most, and so bounded; ranges, leaves and results cover all rows. Leaves are packed into
blocks, so a leaf may hold any share of them. In the search for positives the annulus starts at the fifth best score of
a first block of the anchor's own leaf.

Defined results: rows with a null id, a null label, or a null or non-finite component or vector take no part; shorter vectors go
on with zeros; equal rows count once; rows that share an id but differ are rows of their own, and never positives or
negatives of each other; ties go to the smaller id; a positive score below zero has no negatives. Scores are exact at any size of
components; one that a long cannot hold is given as the nearest long. An empty table gives an empty result, extra columns
do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codonlake.llm.common import register, stored, table
from codonlake.llm.vectors import column, finite, matrix, numbers, packed, sampled, search, survey, top

SCALE = 256
#: Positives of an anchor, negatives of a positive, and the window of their scores in percent of the positive score.
POSITIVES, NEGATIVES, WINDOW = 5, 5, (80, 100)
#: Rows the tree is fitted on at most, rows of a leaf it aims at, split points of a node at most.
SAMPLE, LEAF_ROWS, SPLITS = 8192, 4096, 8
#: Rows of a block and anchors of a chunk.
BLOCK, CHUNK = 4096, 512
_LONG = np.iinfo(np.int64)


@dataclass
class Tree:
    """Leaves are numbered from left to right; ``spans[node]`` has the first leaf of each child and the end."""

    splits: list[np.ndarray] = field(default_factory=list)
    spans: list[np.ndarray] = field(default_factory=list)
    leaves: int = 0
    #: of each node: [split, child], least and largest distance; None until all rows have been seen
    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)
    norm: float = 0.0  # squared length of lifted rows


def lifted(codes: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm - (codes * codes).sum(axis=1), 0.0))
    return np.concatenate((codes, rest[:, None]), axis=1)


def _distances(x: np.ndarray, splits: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (splits * splits).sum(axis=1) - 2.0 * (x @ splits.T)
    return np.sqrt(np.maximum(square, 0.0))


def _far_apart(x: np.ndarray, m: int) -> np.ndarray:
    """Greedy choice of m points among the first 3 m, each the farthest from those before."""
    pool = x[:3 * m]
    chosen = [0]
    away = _distances(pool, pool[:1])[:, 0]
    while len(chosen) < m and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, _distances(pool, pool[chosen[-1:]])[:, 0])
    return pool[chosen]


def fit_tree(sample: np.ndarray, norm: float, n_rows: int, leaf_rows: int, splits: int) -> Tree:
    """A tree over lifted sample points; a node is split while it stands for more than ``leaf_rows`` rows."""
    tree = Tree(norm=norm)
    each = n_rows / max(1, len(sample))

    def grow(x: np.ndarray) -> None:
        m = int(min(splits, -(-len(x) * each // leaf_rows), len(x) // 2))
        points = _far_apart(x, m) if m >= 2 else x[:0]
        if len(points) < 2:
            tree.leaves += 1
            return
        node, spans = len(tree.splits), []
        tree.splits.append(points)
        tree.spans.append(np.empty(0))
        nearest = _distances(x, points).argmin(axis=1)
        for j in range(len(points)):
            spans.append(tree.leaves)
            grow(x[nearest == j])
        tree.spans[node] = np.array([*spans, tree.leaves])

    grow(sample)
    return tree


def leaves_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each lifted row: from the root to the nearest split point of each node."""
    at, end = np.zeros(len(x), dtype=np.int64), np.full(len(x), tree.leaves)
    for splits, spans in zip(tree.splits, tree.spans):
        here = np.flatnonzero((at == spans[0]) & (end == spans[-1]))
        nearest = _distances(x[here], splits).argmin(axis=1)
        at[here], end[here] = spans[nearest], spans[nearest + 1]
    return at


def with_ranges(tree: Tree, rows: DataFrame, dim: int) -> Tree:
    """The tree with the ranges of all rows (cell, code): as many numbers come back as its nodes have pairs of split points."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = [np.full((len(s), len(s)), np.inf) for s in tree.splits]
        high = [np.full((len(s), len(s)), -np.inf) for s in tree.splits]
        for b in batches:
            leaf, x = b.column(0).to_numpy(), lifted(matrix(b.column(1), dim), tree.norm)
            for n, (splits, spans) in enumerate(zip(tree.splits, tree.spans)):
                child = np.searchsorted(spans, leaf, side="right") - 1
                here = np.flatnonzero((leaf >= spans[0]) & (leaf < spans[-1]))
                d = _distances(x[here], splits)
                for j in np.unique(child[here]):
                    mine = d[child[here] == j]
                    low[n][:, j], high[n][:, j] = np.minimum(low[n][:, j], mine.min(axis=0)), np.maximum(high[n][:, j], mine.max(axis=0))
        for n in range(len(low)):
            i, j = np.nonzero(np.isfinite(low[n]))
            yield pa.RecordBatch.from_pydict({"node": pa.array(np.full(i.size, n), pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()),
                                              "low": low[n][i, j], "high": high[n][i, j]})

    low = [np.full((len(s), len(s)), np.inf) for s in tree.splits]
    high = [np.full((len(s), len(s)), -np.inf) for s in tree.splits]
    made = rows.select("cell", "code").mapInArrow(run, "node int, i int, j int, low double, high double")
    for r in made.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        low[r["node"]][r["i"], r["j"]], high[r["node"]][r["i"], r["j"]] = r["low"], r["high"]
    return Tree(tree.splits, tree.spans, tree.leaves, low, high, tree.norm)


def alive(tree: Tree, anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which leaves (columns) can hold a row whose inner product with the anchor is in [least, most]."""
    square = (anchors * anchors).sum(axis=1) + tree.norm
    slack = 1e-6 * (1.0 + np.sqrt(square))
    inner = np.sqrt(np.maximum(square - 2.0 * np.minimum(most, square), 0.0)) - slack
    outer = np.sqrt(np.maximum(square - 2.0 * np.maximum(least, -square), 0.0)) + slack
    x = np.concatenate((anchors, np.zeros((len(anchors), 1))), axis=1)
    out = np.repeat((least <= most)[:, None], tree.leaves, axis=1)
    for n, (splits, spans) in enumerate(zip(tree.splits, tree.spans)):
        d = _distances(x, splits)
        nearest = np.maximum(d - outer[:, None], inner[:, None] - d)  # of the annulus, as seen from a split point
        farthest = d + outer[:, None]
        for j in range(len(splits)):
            meets = ((nearest <= tree.high[n][:, j]) & (farthest >= tree.low[n][:, j])).all(axis=1)
            out[:, spans[j]:spans[j + 1]] &= meets[:, None]
    return out


@dataclass(frozen=True)
class Index:
    tree: Tree
    dim: int
    blocks: DataFrame
    n_blocks: dict[int, int]


def coded(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """id, label (one class on where 7 divides the id), code: whole numbers as an array of the vector's own type."""
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    used = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(vector))
    label = F.col("label").cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2)
            code = np.floor(SCALE * x.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            sizes = np.diff(x.offsets.to_numpy())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(code, pa.float64()).cast(pa.float32() if kind == "float" else pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["id", "label", "code"])

    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return used.select(F.col("vec_id").cast("long").alias("id"), moved.alias("label"), vector).mapInArrow(run, f"id long, label long, code array<{kind}>")


def build_index(rows: DataFrame, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, splits: int = SPLITS, block: int = BLOCK) -> Index:
    """Tree, ranges and packed leaves of rows (id, label, code)."""
    n, dim, norm = survey(rows, "code")
    picked = sampled(rows, "id", "code", dim, sample)
    tree = fit_tree(lifted(picked, norm), norm, n, leaf_rows, splits)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = leaves_of(tree, lifted(matrix(b.column("code"), dim), norm))
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), *b.columns], names=["cell", *b.schema.names])

    kind = dict(rows.dtypes)["code"]
    routed = stored(rows.mapInArrow(route, f"cell int, id long, label long, code {kind}"))
    blocks, n_blocks = packed(routed, block)
    return Index(with_ranges(tree, routed, dim), dim, blocks, n_blocks)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles while all of them, times 100, are whole numbers of a double, else Python's integers."""
    bound = 100.0 * np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0) * max(1, q.shape[1])
    if bound < 2.0**53:
        return q @ x.T
    whole = lambda a: np.array([int(v) for v in a.ravel()], dtype=object).reshape(a.shape)
    return whole(q) @ whole(x).T


def _ranked(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if scores.dtype == object:
        scores = np.unique(scores, return_inverse=True)[1].reshape(scores.shape).astype(np.float64)
    return top(np.where(allowed, scores, -np.inf), k)


def _sorted_items(items: pa.StructArray) -> pa.StructArray:
    return items.take(pa.array(np.lexsort((numbers(items, "label"), numbers(items, "id")))))


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array([min(max(int(v), int(_LONG.min)), int(_LONG.max)) for v in values.tolist()], pa.int64())


def positives_of(index: Index, anchors: DataFrame, k: int = POSITIVES, chunk: int = CHUNK) -> DataFrame:
    """Anchors (key, id, label, code) with ``positives``: their k best other rows of the label, as array of (at, id, score)."""
    tree, dim = index.tree, index.dim
    kind = dict(anchors.dtypes)["code"]

    def best(queries: pa.StructArray, items: pa.StructArray) -> pa.RecordBatch:
        items = _sorted_items(items)
        x, ids, labels = matrix(column(items, "code"), dim), numbers(items, "id"), numbers(items, "label")
        q, own, wanted, key, floor = matrix(column(queries, "code"), dim), numbers(queries, "id"), numbers(queries, "label"), numbers(queries, "key"), numbers(queries, "floor")
        scores = _scores(q, x)
        row, col = _ranked(scores, (labels == wanted[:, None]) & (ids != own[:, None]) & (scores >= floor[:, None]), k)
        return pa.RecordBatch.from_pydict({"key": pa.array(key[row], pa.int64()), "id": pa.array(ids[col], pa.int64()), "score": _longs(scores[row, col])})

    def visit(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = matrix(b.column("code"), dim)
                if first:
                    row, leaf = np.arange(len(q)), leaves_of(tree, lifted(q, tree.norm))
                else:
                    row, leaf = np.nonzero(alive(tree, q, b.column("floor").to_numpy(zero_copy_only=False), np.full(len(q), np.inf)))
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), *b.take(pa.array(row)).columns], names=["cell", *b.schema.names])
        return run

    schema = f"cell int, key long, id long, label long, code {kind}, floor double"
    start = anchors.select("key", "id", "label", "code", F.lit(float("-inf")).alias("floor"))
    found = search(index.blocks, index.n_blocks, start.mapInArrow(visit(True), schema), best, "key long, id long, score long", chunk, first_only=True)
    floors = found.groupBy("key").agg(F.when(F.count("*") >= k, F.min("score").cast("double") * F.lit(1.0)).alias("floor"))
    start = start.drop("floor").join(floors, "key", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    # a floor near the ends of a long may be rounded up by the cast; no window starts there
    start = start.withColumn("floor", F.when(F.abs("floor") < 2.0**53, F.col("floor")).otherwise(F.lit(float("-inf"))))
    found = search(index.blocks, index.n_blocks, start.mapInArrow(visit(False), schema), best, "key long, id long, score long", chunk)
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), "id")
    kept = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)
    lists = kept.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "id", "score"))).alias("positives"))
    return stored(anchors.join(lists, "key"))


def hard_negatives(index: Index, anchors: DataFrame, k: int = NEGATIVES, window: tuple[int, int] = WINDOW, chunk: int = CHUNK) -> DataFrame:
    """Per anchor, positive and rank the best rows of other labels with a score in the window of the positive score."""
    tree, dim, (least, most) = index.tree, index.dim, window
    kind = dict(anchors.dtypes)["code"]
    width = max(1, anchors.agg(F.max(F.size("positives"))).first()[0] or 0)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, lists = matrix(b.column("code"), dim), b.column("positives").to_pylist()
            low, high = np.full(len(q), np.inf), np.full(len(q), -np.inf)
            for r, each in enumerate(lists):
                for p in each:
                    if p["score"] >= 0:  # float rounding is far below the slack of the annulus
                        low[r], high[r] = min(low[r], least / 100.0 * p["score"]), max(high[r], most / 100.0 * p["score"])
            row, leaf = np.nonzero(alive(tree, q, low, high))
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), *b.take(pa.array(row)).columns], names=["cell", *b.schema.names])

    def best(queries: pa.StructArray, items: pa.StructArray) -> pa.RecordBatch:
        items = _sorted_items(items)
        x, ids, labels = matrix(column(items, "code"), dim), numbers(items, "id"), numbers(items, "label")
        q, own, wanted, key = matrix(column(queries, "code"), dim), numbers(queries, "id"), numbers(queries, "label"), numbers(queries, "key")
        lists = column(queries, "positives").to_pylist()
        scores = _scores(q, x)
        other = (labels != wanted[:, None]) & (ids != own[:, None])
        kind = object if scores.dtype == object else np.float64
        rows, cols, places = [], [], []
        for at in range(width):
            mine = np.array([each[at]["score"] if len(each) > at else -1 for each in lists], dtype=kind)[:, None]
            inside = other & (mine >= 0) & (least * mine <= 100 * scores) & (100 * scores <= most * mine)
            row, col = _ranked(scores, inside, k)
            rows.append(row), cols.append(col), places.append(np.full(row.size, at))
        row, col, at = np.concatenate(rows), np.concatenate(cols), np.concatenate(places)
        return pa.RecordBatch.from_pydict({"key": pa.array(key[row], pa.int64()), "at": pa.array(at + 1, pa.int32()), "id": pa.array(ids[col], pa.int64()), "score": _longs(scores[row, col])})

    asked = anchors.select("key", "id", "label", "code", "positives")
    schema = f"cell int, key long, id long, label long, code {kind}, positives array<struct<at:int,id:long,score:long>>"
    found = search(index.blocks, index.n_blocks, asked.mapInArrow(visit, schema), best, "key long, at int, id long, score long", chunk)
    order = Window.partitionBy("key", "at").orderBy(F.col("score").desc(), "id")
    kept = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = anchors.select("key", F.col("id").alias("anchor_id"), F.inline("positives")).select(
        "key", "anchor_id", "at", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return kept.join(named, ["key", "at"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined(vectors: DataFrame, anchor: str, **sizes: int) -> DataFrame:
    """Hard negatives of the rows for which the SQL condition ``anchor`` on ``id`` holds."""
    rows = coded(vectors)
    index = build_index(rows, **sizes)
    anchors = rows.where(anchor).dropDuplicates().withColumn("key", F.xxhash64("id", "label", "code"))
    return hard_negatives(index, positives_of(index, stored(anchors)))


_ORACLE = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS code
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: coalesce(NOT isfinite(x), true))), false)),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.code, b.code) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 100 = 0 AND b.id <> a.id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INT) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER w <= 5
"""


@register("op11_hard_negatives", _ORACLE)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 100, for each of its five best positives."""
    return mined(table(spark, sf_dir, "embeddings"), "id % 100 = 0")
