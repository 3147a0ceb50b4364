"""Objects, contact, gold relations and frames, derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenegrain.functions.geometry import Box, num, shared_width


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str, within: int | None = None) -> DataFrame:
    """One object per line item; an order is an image, nine groups of them.

    Rows are ranked under the name that they keep, so that whatever is joined or grouped by image_id
    stays where the ranking has put it, and before anything else is worked out, so that all uses of the
    objects in a query share one shuffle. With `within` they have clip, too, the images of as many ids,
    and a clip's objects are in one partition: what is grouped or joined by clip and image stays there.
    """
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    own = ["image_id"]
    if within:
        items, own = items.withColumn("clip", F.expr(f"image_id div {within}")).repartition("clip"), ["clip", "image_id"]
    rank = F.row_number().over(Window.partitionBy(*own).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"))
    c, p = F.round(F.col("l_extendedprice") * 100).cast("long"), F.col("l_partkey")
    labels = F.array(*map(F.lit, ("book", "bottle", "box", "cube", "human", "remote")))
    raw = items.withColumn("_place", rank).select(
        *own,
        (F.col("_place") - 1).cast("int").alias("idx"),
        F.element_at(labels, (p % 6 + 1).cast("int")).alias("label"),
        ((p % 80) / num(100)).alias("x1"),
        ((c % 70) / num(100)).alias("y1"),
        ((5 + p % 16) / num(100)).alias("w"),
        ((5 + (c % 7919) % 26) / num(100)).alias("h"),
        (((c % 6007) % 101) / num(100)).alias("depth"),
    )
    return raw.select(*own, (F.col("image_id") % 9).alias("grp"), "idx", "label", "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"), (F.col("x1") + F.col("w") / 2).alias("cx"), (F.col("y1") + F.col("h") / 2).alias("cy"), "depth")


def object_pairs(objs: DataFrame) -> DataFrame:
    """Every ordered pair of different objects of an image, with columns a_* and b_*.

    One equi-join on image_id; both sides have the partitioning of the objects, so rows of pairs are
    made where the objects are and never move.
    """
    own = [c for c in objs.columns if c != "image_id"]
    a = objs.select("image_id", *[F.col(c).alias(f"a_{c}") for c in own])
    b = objs.select("image_id", *[F.col(c).alias(f"b_{c}") for c in own])
    return a.join(b, "image_id").where(F.col("a_idx") != F.col("b_idx"))


def contact(objs: DataFrame, least: float = 0.05) -> DataFrame:
    """(image_id, i, j, frac): the share of i's bottom edge that rests on j, from `least` up."""
    a, b = Box.of("a_"), Box.of("b_")
    frac = shared_width(a, b) / (a.x2 - a.x1)
    pairs = object_pairs(objs.select("image_id", "idx", "x1", "y1", "x2", "y2"))
    return pairs.where((b.y1 <= a.y2 + num(0.01)) & (a.y2 < b.y2)).select("image_id", F.col("a_idx").alias("i"), F.col("b_idx").alias("j"), frac.alias("frac")).where(F.col("frac") >= num(least))


def contact_share(a: Box, b: Box, least: float = 0.05) -> Column:
    """What contact() says of one pair, 0 where it says nothing: for pairs that are rows already."""
    frac = shared_width(a, b) / (a.x2 - a.x1)
    return F.when((b.y1 <= a.y2 + num(0.01)) & (a.y2 < b.y2) & (frac >= num(least)), frac).otherwise(num(0))


def stated(a: str = "a_", b: str = "b_") -> Column:
    """What gold() says of one pair, none or one predicate: for pairs that are rows already."""
    return F.when((F.col("image_id") * 31 + F.col(f"{a}idx") * 7 + F.col(f"{b}idx") * 13) % 10 == 0, F.array(gold_name(a, b))).otherwise(F.array().cast("array<string>"))


def gold_name(a: str = "a_", b: str = "b_") -> Column:
    kind = (F.col("image_id") + F.col(f"{a}idx") + F.col(f"{b}idx")) % 3
    ahead = (F.col(f"{a}depth") < F.col(f"{b}depth")) == ~F.col(f"{a}grp").isin(6, 8)
    return (
        F.when(kind == 0, F.when(F.col(f"{a}cx") < F.col(f"{b}cx"), "to the left of").otherwise("to the right of"))
        .when(kind == 1, F.when(ahead, "in front of").otherwise("behind"))
        .otherwise(F.when((F.col(f"{a}cy") < F.col(f"{b}cy")) & (F.abs(F.col(f"{a}depth") - F.col(f"{b}depth")) < num(0.2)), "on").otherwise("near"))
    )


def gold(objs: DataFrame) -> DataFrame:
    """(image_id, subj, obj, predicate): relations that annotators gave; groups 6 and 8 turn depth around."""
    pairs = object_pairs(objs.select("image_id", "grp", "idx", "cx", "cy", "depth")).where((F.col("image_id") * 31 + F.col("a_idx") * 7 + F.col("b_idx") * 13) % 10 == 0)
    return pairs.select("image_id", F.col("a_idx").alias("subj"), F.col("b_idx").alias("obj"), gold_name().alias("predicate"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of one clip per user, in order of time."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("clip"), "event_type", "value")
    rank = F.row_number().over(Window.partitionBy("clip").orderBy("ts", "event_id"))
    return e.select("clip", (rank - 1).cast("int").alias("ord"), "ts", F.col("event_type").alias("label"), ((F.col("event_id") * 37 % 80) / num(100)).alias("x1"), "value")
