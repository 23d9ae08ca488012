"""Exact ways to do per-genome and global work without gathering a hot key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codonlake.session import cut_lineage

BROADCAST_BYTES = 64 * 1024 * 1024
ROWS_PER_SALT = 2_000_000


def join_per_genome(rows: DataFrame, table: DataFrame, row_bytes: Column | int = 256,
                    how: str = "left", key: str = "genome_id") -> DataFrame:
    """Join a table with at most one row per genome to many rows per genome.

    The size of ``table`` is measured first (one number comes back). Within the bound it is broadcast.
    Beyond it, a genome with many rows is split over salts and its table row copied once per salt, so
    no task gets a whole hot genome; genomes with few rows have one salt.
    """
    size = table.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0]
    if (size or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), key, how)
    return salted_join(rows, table, how, key)


def salted_join(rows: DataFrame, table: DataFrame, how: str = "left", key: str = "genome_id",
                rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    counts = rows.groupBy(key).agg(F.count("*").alias("_rows"))
    salts = counts.select(key, F.ceil(F.col("_rows") / rows_per_salt).cast("int").alias("_salts"))
    hot = salts.where("_salts > 1")
    spread = rows.join(F.broadcast(hot), key, "left")  # at most total_rows / rows_per_salt genomes
    spread = spread.withColumn(
        "_salt",
        F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_salts")).cast("int"), F.lit(0)),
    )
    copies = table.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    )
    return spread.drop("_salts").join(copies.drop("_salts"), [key, "_salt"], how).drop("_salt")


def running_total(rows: DataFrame, keys: list[str], order: list[Column | str], value: str,
                  out: str) -> DataFrame:
    """Cumulative sum of ``value`` within ``keys`` along ``order``, for keys of any size.

    Rows are range-partitioned by key and order, so a large key spans several partitions. Each partition
    sums by itself and adds the total of the partitions before it. The split is checkpointed because
    range bounds are sampled: both passes must see the same one.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"_o{i}" for i in range(len(cols))]
    split = rows
    for name, c in zip(names, cols):
        split = split.withColumn(name, c)
    split = cut_lineage(
        split.repartitionByRange(*keys, *names).withColumn("_part", F.spark_partition_id())
    )
    sums = split.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    if not keys:
        earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = (
        Window.partitionBy(*keys, "_part").orderBy(*names)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        split.join(offsets, [*keys, "_part"])
        .withColumn(out, F.col("_base") + F.sum(value).over(within))
        .drop("_part", "_base", *names)
    )


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, points: tuple[float, ...]) -> DataFrame:
    """Exact percentiles with linear interpolation, as array ``p``, for a few keys with any number of rows each.

    Equal values are counted first, the counts are summed along the values over range partitions, and the values at
    the ranks below and above each point are picked, so no task holds all values of a key.
    """
    known = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = running_total(known, keys, [value], "_n", "_upto")
    totals = upto.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    ranked = join_per_genome(upto, totals, 64, "inner", keys[0]) if len(keys) == 1 else upto.join(totals, keys)
    at = lambda rank: F.max(F.when((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto")), F.col(value)))
    picks = []
    for q in points:
        place = F.lit(float(q)) * (F.col("_total") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.first(place - F.floor(place))
        picks.append(low + (high - low) * part)
    return ranked.groupBy(*keys).agg(F.array(*picks).alias("p"))
