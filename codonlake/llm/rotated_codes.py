"""Nearest neighbours by inner product from randomly rotated one-bit codes.

Rows are dealt to cells around a few centres. What a row has beyond its centre is rotated at random and kept as one sign per
rotated component, packed into longs, with two correction scalars: its length and the part of it that the signs explain. From
these and from a query rotated and rounded to four bits, bit counts give an unbiased estimate of the inner product and a bound on
its error. A search first takes a threshold, the k-th best exact score in one block of the query's nearest cell; then it leaves
out cells that cannot reach the threshold (centre and radius, certain), and in the others it reranks by exact inner products
those rows whose estimate plus error bound reaches it. A true neighbour is missed only if its estimate is off by more than
``SIGMAS`` standard errors.

Centres are fitted on ``SAMPLE`` rows at most; codes, radii and results cover all rows. Vectors shorter than ``LEAST_BITS`` / 2
are extended with zeros before they are rotated, which makes the code longer and the estimate closer.

Defined results: rows with a null id, a null or all-zero vector, or a null or non-finite component take no part; shorter vectors
go on with zeros; equal rows count once; rows that share an id but differ are rows of their own, and no neighbours of each
other; equal scores go to the smaller id. Scores are sums of products in the order of the components, in double precision. An
empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codonlake.llm.common import register, stored, table
from codonlake.llm.vectors import column, finite, matrix, numbers, packed, sampled, search, survey, top

NEIGHBOURS = 20
#: Rows the centres are fitted on at most, centres at most, rows of a cell they aim at, rounds of the fit.
SAMPLE, CELLS, CELL_ROWS, ROUNDS = 8192, 64, 8192, 5
#: Bits of a code: twice the components, this many at least, in whole longs.
LEAST_BITS = 128
#: Standard errors that the bound allows for. One neighbour in a thousand or so lies beyond three.
SIGMAS = 3.0
#: Rows of a block and queries of a chunk.
BLOCK, CHUNK = 8192, 256
SEED = 20


@dataclass(frozen=True)
class Codes:
    centres: np.ndarray
    rotation: np.ndarray  # components by bits, orthonormal rows
    radius: np.ndarray  # of each cell
    blocks: DataFrame
    n_blocks: dict[int, int]

    @property
    def dim(self) -> int:
        return self.rotation.shape[0]

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]


def rotation(dim: int, seed: int = SEED, least_bits: int = LEAST_BITS) -> np.ndarray:
    """Orthonormal rows in a space of so many bits: a random rotation of vectors that were extended with zeros."""
    bits = -(-max(2 * dim, least_bits) // 64) * 64
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, max(1, dim))))[0].T


def fit_centres(sample: np.ndarray, n_rows: int, cells: int = CELLS, cell_rows: int = CELL_ROWS) -> np.ndarray:
    k = int(max(1, min(cells, n_rows // cell_rows, len(sample))))
    centres = sample[:k].copy() if len(sample) else np.zeros((1, sample.shape[1]))
    for _ in range(ROUNDS if len(sample) else 0):
        near = nearest(sample, centres)
        for c in np.unique(near):
            centres[c] = sample[near == c].mean(axis=0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2.0 * (x @ centres.T)).argmin(axis=1)


def encode(rest: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs as longs (rows by longs), length, and the inner product of the unit vector with its signs (1 for length 0)."""
    turned = rest @ turn
    length = np.sqrt((rest * rest).sum(axis=1))
    fit = np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1]) / np.where(length > 0, length, 1.0)
    signs = np.packbits(turned > 0, axis=1, bitorder="little").view(np.int64)
    return signs, length, np.where(length > 0, fit, 1.0)


class Question:
    """A query rotated and rounded to four bits: estimates and error bounds for coded rows of one cell."""

    def __init__(self, q: np.ndarray, turn: np.ndarray):
        turned = q @ turn
        self.length, self.low = float(np.sqrt((q * q).sum())), float(turned.min())
        self.step = float(turned.max() - turned.min()) / 15.0 or 1.0
        level = np.rint((turned - self.low) / self.step).astype(np.uint8)
        self.total = int(level.sum())
        self.planes = np.stack([np.packbits((level >> p) & 1, bitorder="little").view(np.uint64) for p in range(4)])

    def estimate(self, signs: np.ndarray, ones: np.ndarray, length: np.ndarray, fit: np.ndarray, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
        """signs: longs by rows. Inner products with what rows have beyond their centre, and how far off they may be."""
        bits = signs.shape[0] * 64
        inside = np.zeros(signs.shape[1], dtype=np.int64)
        for p, plane in enumerate(self.planes):
            for word, own in zip(signs, plane):
                inside += np.bitwise_count(word & own).astype(np.int64) << p
        signed = self.low * (2.0 * ones - bits) + self.step * (2.0 * inside - self.total)
        scale = length / fit
        missing = self.length * np.sqrt(np.maximum(1.0 - fit * fit, 0.0) / (bits - 1)) + self.step / np.sqrt(12.0)
        return signed / np.sqrt(bits) * scale, sigmas * scale * missing


def build_codes(vectors: DataFrame, vector: str = "embedding", sample: int = SAMPLE, cells: int = CELLS, cell_rows: int = CELL_ROWS, block: int = BLOCK) -> Codes:
    """Codes of rows (id, vector), packed by cell."""
    n, dim, _ = survey(vectors, vector)
    centres = fit_centres(sampled(vectors, "id", vector, dim, sample), n, cells, cell_rows)
    turn = rotation(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dim)
            cell = nearest(x, centres)
            signs, length, fit = encode(x - centres[cell], turn)
            longs = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * signs.shape[1], pa.int32()), pa.array(signs.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *b.columns, longs, pa.array(length), pa.array(fit)],
                                             names=["cell", "id", "vector", "signs", "length", "fit"])

    kind = dict(vectors.dtypes)[vector]
    rows = stored(vectors.select("id", vector).mapInArrow(run, f"cell int, id long, vector {kind}, signs array<long>, length double, fit double"))
    radius = np.zeros(len(centres))
    for r in rows.groupBy("cell").agg(F.max("length").alias("most")).collect():  # one row per centre
        radius[r["cell"]] = r["most"]
    blocks, n_blocks = packed(rows, block)
    return Codes(centres, turn, radius, blocks, n_blocks)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, components added in their order."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * q[:, j]
    return out


def neighbours(codes: Codes, asked: DataFrame, k: int = NEIGHBOURS, sigmas: float = SIGMAS, chunk: int = CHUNK) -> DataFrame:
    """The k best rows found for each query (key, id, vector): key, query_id, rank, vec_id, score."""
    dim, turn, centres, radius = codes.dim, codes.rotation, codes.centres, codes.radius
    kind = dict(asked.dtypes)["vector"]

    def opened(items: pa.StructArray) -> tuple[pa.StructArray, np.ndarray, np.ndarray]:
        items = items.take(pa.array(np.argsort(numbers(items, "id"), kind="stable")))
        return items, numbers(items, "id"), matrix(column(items, "vector"), dim)

    def answer(key: np.ndarray, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": pa.array(key[row], pa.int64()), "id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})

    def exact(queries: pa.StructArray, items: pa.StructArray) -> pa.RecordBatch:
        _, ids, x = opened(items)
        q, own = matrix(column(queries, "vector"), dim), numbers(queries, "id")
        row, col = top(np.where(ids != own[:, None], q @ x.T, -np.inf), k)
        return answer(numbers(queries, "key"), row, ids[col], products(x[col], q[row]))

    def rerank(queries: pa.StructArray, items: pa.StructArray) -> pa.RecordBatch:
        items, ids, x = opened(items)
        signs = np.ascontiguousarray(np.asarray(column(items, "signs").flatten()).reshape(len(ids), -1).T).view(np.uint64)
        ones = np.bitwise_count(signs).sum(axis=0, dtype=np.int64)
        length, fit = numbers(items, "length"), numbers(items, "fit")
        q, own, key, floor, at = matrix(column(queries, "vector"), dim), numbers(queries, "id"), numbers(queries, "key"), numbers(queries, "floor"), numbers(queries, "centre")
        rows, cols, scores = [], [], []
        for r in range(len(q)):
            guess, off = Question(q[r], turn).estimate(signs, ones, length, fit, sigmas)
            slack = 1e-9 * (1.0 + abs(floor[r])) if np.isfinite(floor[r]) else 0.0
            maybe = np.flatnonzero(~(guess + off + at[r] < floor[r] - slack) & (ids != own[r]))
            score = x[maybe] @ q[r]
            if maybe.size > k:  # rounding may swap the last places, so the cut is a little lower
                cut = np.partition(score, maybe.size - k)[maybe.size - k]
                maybe = maybe[score >= cut - 1e-9 * (1.0 + abs(cut))]
            score = products(x[maybe], np.broadcast_to(q[r], (maybe.size, dim)))
            best = np.lexsort((ids[maybe], -score))[:k]
            best = best[score[best] >= floor[r] - slack]
            rows.append(np.full(best.size, r)), cols.append(maybe[best]), scores.append(score[best])
        col = np.concatenate(cols)
        return answer(key, np.concatenate(rows), ids[col], np.concatenate(scores))

    def visit(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = matrix(b.column("vector"), dim)
                inner = q @ centres.T
                if first:
                    row, cell = np.arange(len(q)), nearest(q, centres)
                else:
                    floor = b.column("floor").to_numpy(zero_copy_only=False)
                    most = inner + np.sqrt((q * q).sum(axis=1))[:, None] * radius * (1.0 + 1e-9) + 1e-9
                    row, cell = np.nonzero(~(most < floor[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *b.take(pa.array(row)).columns, pa.array(inner[row, cell])], names=["cell", *b.schema.names, "centre"])
        return run

    schema = f"cell int, key long, id long, vector {kind}, floor double, centre double"
    found_schema = "key long, id long, score double"
    start = asked.select("key", "id", "vector", F.lit(float("-inf")).alias("floor"))
    first = search(codes.blocks, codes.n_blocks, start.mapInArrow(visit(True), schema), exact, found_schema, chunk, first_only=True)
    floors = first.groupBy("key").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    start = start.drop("floor").join(floors, "key", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = search(codes.blocks, codes.n_blocks, start.mapInArrow(visit(False), schema), rerank, found_schema, chunk)
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = asked.select("key", F.col("id").alias("query_id"))
    return best.join(named, "key").select("key", "query_id", "rank", F.col("id").alias("vec_id"), "score")


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """id and vector of the rows that take part."""
    some = F.exists(vector, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & finite(vector) & some).select(F.col("vec_id").cast("long").alias("id"), F.col(vector).alias("vector"))


def searched(vectors: DataFrame, query: str, k: int = NEIGHBOURS, **sizes: int) -> DataFrame:
    """Neighbours of the rows for which the SQL condition ``query`` on ``id`` holds."""
    rows = usable(vectors)
    codes = build_codes(rows, "vector", **sizes)
    asked = stored(rows.where(query).dropDuplicates().withColumn("key", F.xxhash64("id", "vector")).select("key", "id", "vector"))
    return neighbours(codes, asked, k).drop("key")


# The exact neighbours: on the small tables none is missed. On larger ones the tests hold the recall against brute force.
_ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: coalesce(NOT isfinite(x), true))), true) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)))
SELECT q.vec_id AS query_id, CAST(row_number() OVER w AS INT) AS rank, c.vec_id, list_inner_product(q.e, c.e) AS score
FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) QUALIFY row_number() OVER w <= 20
"""


@register("op13_rotated_codes", _ORACLE)
def op13_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every row whose id is divisible by 20."""
    return searched(table(spark, sf_dir, "embeddings"), "id % 20 = 0")
