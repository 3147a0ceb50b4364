"""Sharding: vector bin packing of groups of equal texts over bytes, tokens and rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD_CLASS, named, stored, table, text_of

SHARDS = 8
#: Small groups share this many units; a group above 1 / UNITS of all bytes, tokens or rows is one of its own.
UNITS = 4096
#: Cells of a shard's worth, at least, that a group larger than a shard is dealt to before it is cut.
CELLS = 64
DIMS = ("size", "tokens", "rows")


def place(units: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unit (rows: units, columns: bytes, tokens, rows).

    Largest unit first, each goes where the dot product of its vector with the shard's residual
    capacity is highest, both as shares of the total, among the shards that have room for its bytes;
    where none has, to the one with the most. The lowest shard number wins a tie.
    """
    share = units / np.maximum(units.sum(0), 1)
    residual = np.full((shards, units.shape[1]), 1 / shards)
    out = np.zeros(len(units), np.int64)
    for i in np.lexsort((-share.sum(1), -share.max(1))):
        room = residual[:, 0] >= share[i, 0]
        s = int(np.argmax(np.where(room, residual @ share[i], -np.inf) if room.any() else residual[:, 0]))
        residual[s] -= share[i]
        out[i] = s
    return out


def measured(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The few bytes per row that sharding needs, so that texts are read once and never shuffled."""
    text = text_of(text_col)
    return df.select(
        named(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit(WORD_CLASS)).cast("long").alias("tokens"),
        F.xxhash64(text).alias("g"),
    )


def assign(df: DataFrame, *, shards: int = SHARDS, units: int = UNITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row: doc_id, size, text_crc32, tokens, shard, slot.

    Equal texts form a group and stay together as long as their bytes fit into a shard, whatever their
    tokens and rows. The rows of a larger group are dealt to cells by a hash of their id, and its cells cut
    into parts of one shard's bytes and a rest, so that it fills as few shards as it needs. Groups below
    1 / units of the total, too small to matter singly, share units by their hash. So at most 7 * units
    units and cells reach the driver, whatever the input, each three sums, and the table of their
    places, at most 7 * units rows, is sent to all tasks. Slots count from 0 in each shard without gaps:
    a cell's first slot, plus a row's rank in its cell, which holds about 1 / units of all rows.

    A null text has size 1, no tokens, and is grouped with empty texts; null ids and repeated rows
    are rows like any other; an empty table gives no rows; other columns are ignored, whatever their
    names.
    """
    spark = df.sparkSession
    base, _ = stored(measured(df, id_col, text_col), "sharding")
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = base.agg(*sums).first()
    if not total["rows"]:
        return base.select("doc_id", "size", "text_crc32", "tokens", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    share = F.greatest(*(F.col(d) / F.lit(max(1, total[d] or 0)) for d in DIMS))
    # at most 3 * units groups: each has over 1 / units of one of three totals
    large = base.groupBy("g").agg(*sums).withColumn("share", share).where(F.col("share") > 1 / units).select("g", "share", "rows", "size").collect()
    table_rows, parts, first = [], [], units
    for r in sorted(large, key=lambda r: (-r["share"], r["g"])):
        worth = r["size"] / total["size"] * shards  # in shards
        cells = int(np.ceil(r["rows"] / total["rows"] * units))  # so many that ranks are counted over few rows
        if worth > 1:
            cells = max(cells, int(np.ceil(worth * CELLS)))
        table_rows.append((r["g"], first, cells))
        parts.append(np.minimum(np.arange(cells) * worth // cells, cells - 1).astype(np.int64) if worth > 1 else np.zeros(cells, np.int64))
        first += cells
    big = spark.createDataFrame(table_rows, "g long, first long, cells int")
    own = F.col("first") + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("cells"))
    celled = base.join(F.broadcast(big), "g", "left").withColumn("cell", F.coalesce(own, F.pmod(F.xxhash64("g", F.lit(2)), F.lit(units))))
    got = celled.groupBy("cell").agg(*sums).orderBy("cell").collect()
    cell = np.array([r["cell"] for r in got], np.int64)
    vector = np.array([[r[d] or 0 for d in DIMS] for r in got], float)
    unit = cell.copy()
    for (_, begin, cells), part in zip(table_rows, parts, strict=True):
        mine = (cell >= begin) & (cell < begin + cells)
        unit[mine] = begin + part[cell[mine] - begin]
    names, which = np.unique(unit, return_inverse=True)
    summed = np.zeros((len(names), len(DIMS)))
    np.add.at(summed, which, vector)
    shard = place(summed, shards)[which]
    offset = np.zeros(len(cell), np.int64)
    for s in range(shards):
        mine = np.flatnonzero(shard == s)
        counts = vector[mine, 2].astype(np.int64)
        offset[mine] = np.cumsum(counts) - counts
    places = spark.createDataFrame(list(zip(cell.tolist(), shard.tolist(), offset.tolist(), strict=True)), "cell long, shard int, offset long")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("doc_id", "text_crc32")) - 1
    return celled.withColumn("rank", rank).join(F.broadcast(places), "cell").select("doc_id", "size", "text_crc32", "tokens", "shard", (F.col("offset") + F.col("rank")).alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
