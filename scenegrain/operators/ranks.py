"""Exact ranks within groups of any size, worked out by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenegrain.sources.folders import stored

#: Rows of a range.
RANGE = 1_000_000


def placed(rows: DataFrame, by: list[str], order: list[str], *, rank: str = "r", total: str = "n") -> DataFrame:
    """Rows with their place in their group, from 0 on, and the group's size; order: columns of any orderable type, ascending.

    A window over the group would sort a group in one task. Here rows are dealt by ranges of group and
    order, sorted within their range, and written; a row's place is its place in the range plus the
    group's rows in the ranges before, whose counts are one row a range and group. Rows that are equal
    in the order take their places by a hash of all their columns, so order needn't tell all of them apart;
    only rows that are equal in every column stay in one range. Nulls come first.
    """
    spark = rows.sparkSession
    own = {c: c for c in ("_tie", "_range", "_at", "_before")}
    for c in own:
        while own[c] in rows.columns:
            own[c] = f"_{own[c]}"
    tie, part, at, before = own.values()
    hashed, _ = stored(rows.withColumn(tie, F.xxhash64(*rows.columns)), "unranked")  # made once: it is read for the ranges and for the rows
    parts = max(spark.sparkContext.defaultParallelism, -(-hashed.count() // RANGE))
    dealt = hashed.repartitionByRange(parts, *by, *order, tie).sortWithinPartitions(*by, *order, tie).drop(tie)
    ranged, _ = stored(dealt.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), "ranged")
    counts = ranged.groupBy(part, *by).agg(F.count("*").alias(before), F.min(at).alias("_first"))
    so_far = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(F.col(part).alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], (F.coalesce(F.sum(before).over(so_far), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum(before).over(Window.partitionBy(*by)).alias(total))
    same = (F.col(part) == F.col("_p")) if not by else (F.col(part) == F.col("_p")) & _all(F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by))
    return ranged.join(shift, same).withColumn(rank, F.col(at) + F.col("_shift")).select(*rows.columns, rank, total)


def _all(conditions):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
