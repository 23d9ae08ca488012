"""Helpers of the operators of this folder: stored tables, hot keys, connected components."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codonlake.session import ensure_checkpoint_dir, ship_package

#: Registered queries of this folder and, where SQL can say the same, their check.
QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: A word of the contracts; the class holds blank and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def register(name: str, oracle: str | None = None):
    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The rows written as Parquet in the shared checkpoint folder and read again.

    Cuts the lineage without depending on any executor, and takes less room than a checkpoint of rows. What was shuffled for
    the rows is deleted when they are written, so the disk holds the shuffles of one table at a time.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _folders(df: DataFrame) -> list:
    """(file system, folder) of a table made by ``stored``."""
    spark = df.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})]
    return [(p.getFileSystem(spark._jsc.hadoopConfiguration()), p) for p in paths]


def exists(table: DataFrame) -> bool:
    """Whether a table made by ``stored`` has not been dropped."""
    return all(system.exists(path) for system, path in _folders(table))


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing reads any more."""
    for df in tables:
        for system, path in _folders(df):
            system.delete(path, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_array(text: Column) -> Column:
    """Words of a text as an array; empty for null and for texts without words."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), "^" + GAP + "|" + GAP + r"\z", "")
    return F.when(F.length(flat) > 0, F.split(flat, GAP)).otherwise(F.array().cast("array<string>"))


def join_hot(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows to one row per group when a group may hold a large share of all rows.

    Groups with over a thousandth of ``total`` rows number below a thousand, whatever the input, and are broadcast;
    the others are joined by shuffle, where the largest task cannot hold more than that share of one group.
    """
    floor = max(1, total // 1000)
    hot, cold = groups.where(F.col(count) > floor).drop(count), groups.where(F.col(count) <= floor).drop(count)
    marked = rows.join(F.broadcast(hot.select(key).withColumn("_hot", F.lit(True))), key, "left")
    return (marked.where("_hot").drop("_hot").join(F.broadcast(hot), key, how)
            .unionByName(marked.where("_hot IS NULL").drop("_hot").join(cold, key, how)))


def rows_in(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose number ``key`` is in ``ids``, without moving them.

    Numbers are those of ``monotonically_increasing_id``. They are sent as bitmaps of 32,768 bits: one for each partition that
    gave numbers, or for each 32,768 of its rows, so a bit per row, and 4 KB for a partition at least.
    """
    bits = ids.groupBy(F.bitmap_bucket_number(key).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("_bits"))
    place = F.bitmap_bit_position(F.col(key))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = rows.withColumn("_bucket", F.bitmap_bucket_number(key)).join(F.broadcast(bits), "_bucket")
    return joined.where((byte / F.pow(F.lit(2), F.pmod(place, F.lit(8)))).cast("int") % 2 == 1).select(*rows.columns)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b) of longs: rows (id, component), component the least id.

    Large-star and small-star rounds until nothing changes. A round is an aggregate with a partial step and a join that
    takes nodes with very many edges apart, so these are never gathered in one task, and each round is stored. Nodes
    without edges do not appear.
    """
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = stored(join_hot(both.where("b > a"), least, "a", "n", 2 * before[0])
                       .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        now = stored(join_hot(large, least, "a", "n", before[0]).select(F.col("b").alias("a"), F.col("m").alias("b"))
                     .unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        after = state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
