"""Searches of vectors in blocks: usable rows, packed blocks of a cell, packed chunks of queries, exact top lists.

An index deals every row to a cell. The rows of a cell are packed into blocks of bounded size by a hash, the queries that
must look into a cell into chunks of bounded size, and one task at a time works on one block and one chunk. So neither a
cell that holds most rows nor one that most queries look into is ever gathered, and equal rows are packed once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from codonlake.llm.common import stored


def finite(vector: str) -> Column:
    """True for arrays without null or non-finite components; false for null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list array as doubles; shorter ones go on with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(flat.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def survey(rows: DataFrame, vector: str) -> tuple[int, int, float]:
    """Rows, longest vector and largest squared norm; three numbers come back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                dim = int(pc.max(pc.list_value_length(b.column(0))).as_py())
                x = matrix(b.column(0), dim)
                yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "dim": [dim], "most": [float((x * x).sum(axis=1).max(initial=0.0))]})

    got = rows.select(vector).mapInArrow(run, "n long, dim long, most double").agg(F.sum("n"), F.max("dim"), F.max("most")).first()
    return got[0] or 0, got[1] or 0, got[2] or 0.0


def sampled(rows: DataFrame, key: str, vector: str, dim: int, most: int) -> np.ndarray:
    """At most so many distinct vectors, picked by a hash of their keys, in the order of it."""
    got = rows.select(F.xxhash64(F.col(key), F.lit("sample")).alias("h"), vector).orderBy("h", vector).limit(most).toArrow()
    x = matrix(got.column(vector).combine_chunks(), dim) if got.num_rows else np.zeros((0, dim))
    _, first = np.unique(x, axis=0, return_index=True)
    return x[np.sort(first)]


def packed(rows: DataFrame, size: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows (cell, id, ...) as stored blocks (cell, block, items), items distinct and at most about ``size``, and the blocks of each cell.

    The number of cells is bounded by the index that deals them.
    """
    counts = rows.groupBy("cell").count().collect()
    blocks = {r["cell"]: -(-r["count"] // size) for r in counts}
    if not blocks:
        return rows.select("cell", F.lit(0).alias("block"), F.array(F.struct(*[c for c in rows.columns if c != "cell"])).alias("items")), {}
    table = rows.sparkSession.createDataFrame(list(blocks.items()), "cell int, _blocks int")
    item = F.struct(*[c for c in rows.columns if c != "cell"])
    dealt = rows.join(F.broadcast(table), "cell").withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.col("_blocks")).cast("int"))
    return stored(dealt.groupBy("cell", "block").agg(F.collect_set(item).alias("items"))), blocks


def search(blocks: DataFrame, n_blocks: dict[int, int], asked: DataFrame, look: Callable[[pa.StructArray, pa.StructArray], pa.RecordBatch],
           schema: str, chunk_size: int, first_only: bool = False) -> DataFrame:
    """``look(queries, items)`` for every chunk of the queries (cell, key, ...) that ask for a cell and every block of it.

    ``first_only``: only the first block of a cell.
    """
    spark = blocks.sparkSession
    asked = stored(asked)
    chunks = {r["cell"]: -(-r["count"] // chunk_size) for r in asked.groupBy("cell").count().collect()}
    sizes = spark.createDataFrame([(c, 1 if first_only else n, chunks[c]) for c, n in n_blocks.items() if c in chunks], "cell int, _blocks int, _chunks int")
    query = F.struct(*[c for c in asked.columns if c != "cell"])
    dealt = asked.join(F.broadcast(sizes), "cell").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("_chunks")).cast("int"))
    dealt = dealt.groupBy("cell", "_blocks", "chunk").agg(F.collect_list(query).alias("queries"))
    dealt = dealt.select("cell", "chunk", "queries", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"))
    there = blocks.where("block = 0") if first_only else blocks
    there = there.join(F.broadcast(sizes), "cell").select("cell", "block", "items", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("chunk"))

    def run(table: pa.Table) -> pa.Table:
        made = [look(q.flatten(), i.flatten()) for queries, items in zip(table.column("queries").chunks, table.column("items").chunks, strict=True)
                for q, i in ((queries.slice(k, 1), items.slice(k, 1)) for k in range(len(queries)))]
        return pa.Table.from_batches(made)

    return there.join(dealt, ["cell", "block", "chunk"]).groupBy("cell", "block", "chunk").applyInArrow(run, schema)


def column(rows: pa.StructArray, name: str) -> pa.Array:
    return rows.flatten()[rows.type.get_field_index(name)]


def numbers(rows: pa.StructArray, name: str) -> np.ndarray:
    return column(rows, name).to_numpy(zero_copy_only=False)


def top(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest entries of each row above minus infinity, in order; ties by column."""
    if not scores.size:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    m = scores.shape[1]
    keep = scores > -np.inf
    if m > k:
        keep &= scores >= np.partition(scores, m - k, axis=1)[:, m - k][:, None]
    row, col = np.nonzero(keep)
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(row.size) - np.searchsorted(row, row)
    return row[place < k], col[place < k]
