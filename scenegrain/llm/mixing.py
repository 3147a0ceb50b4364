"""Mixing sources to target weights: temperature by bisection, then budgeted block permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import WORD_CLASS, named, stored, table, text_of, unused

#: Blocks of a source, at most; a budget is met to within half a block.
BLOCKS = 4096
#: How often the most repeated source may be seen for each time that the least repeated one is.
REPETITION = 2.0
SEED = 17
#: The exponent is found in passes over the sources that each halve its range six times.
PASSES, SECTIONS = 4, 64
#: A table of at most this many sources is sent to all tasks; a larger one is joined by its key.
BROADCAST_SOURCES = 20_000


def source_key(col: str) -> Column:
    """The source as a key without nulls: rows without a source form one of their own."""
    return F.coalesce(F.concat(F.lit("s"), named(col).cast("string")), F.lit("-"))


def exponent(shares: DataFrame, *, repetition: float | None, entropy: float | None) -> float:
    """The exponent in [0, 1] to which token shares p are raised, found by bisection.

    With repetition: the smallest, most even one with max r / min r at most repetition, where
    r = p ** (exponent - 1) is how often a source is seen. With entropy (nats): the largest one, the
    closest to the corpus, whose weights still have that entropy. Either holds on one side of a single
    point, so a pass over the sources that evaluates SECTIONS points replaces six halvings.
    """
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        step = (high - low) / SECTIONS
        at = shares.select("p", F.explode(F.sequence(F.lit(0), F.lit(SECTIONS))).alias("i")).withColumn("t", F.lit(low) + F.col("i") * F.lit(step))
        sums = at.groupBy("i").agg(F.first("t").alias("t"), F.sum(F.pow("p", "t")).alias("z"), F.sum(F.pow("p", "t") * F.log("p")).alias("l"), F.min("p").alias("least"), F.max("p").alias("most"))
        if entropy is None:
            holds = F.pow(F.col("most") / F.col("least"), 1 - F.col("t")) <= F.lit(repetition)
            row = sums.agg(F.min(F.when(holds, F.col("i"))).alias("i")).first()
            k = SECTIONS if row["i"] is None else row["i"]
            low, high = low + max(0, k - 1) * step, low + k * step
        else:
            holds = F.log("z") - F.col("t") * F.col("l") / F.col("z") >= F.lit(entropy)
            row = sums.agg(F.max(F.when(holds, F.col("i"))).alias("i")).first()
            k = 0 if row["i"] is None else row["i"]
            low, high = low + k * step, low + min(SECTIONS, k + 1) * step
    return high if entropy is None else low


def order_of(epoch: Column | int) -> Column:
    """Place of a block in its source's permutation of an epoch: 0 up to 2 ** 31 - 1."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    return F.pmod(F.xxhash64(F.lit(SEED), "_source", epoch.cast("int"), "_block"), F.lit(1 << 31))


def plan(keyed: DataFrame, *, repetition: float | None, entropy: float | None, budget: int | None, blocks: int = BLOCKS) -> tuple[DataFrame, int]:
    """Per source: weight, repeats, whole epochs (full) and the cut of the last one; and the number of sources."""
    cells, _ = stored(keyed.groupBy("_source", "_block").agg(F.sum("_tokens").alias("tokens")), "mixing")
    shares, _ = stored(cells.groupBy("_source").agg(F.sum("tokens").alias("tokens")), "mixing")
    whole = shares.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    shares = shares.withColumn("p", F.col("tokens") / F.lit(whole["t"] or 1))
    tau = exponent(shares, repetition=repetition, entropy=entropy)
    z = shares.agg(F.sum(F.pow("p", F.lit(tau))).alias("z"), F.max("p").alias("most")).first()
    # without a budget, as many tokens as show every row once: the source seen least often has repeats 1
    scale = (budget / whole["t"] / z["z"]) if budget is not None and whole["t"] else (z["most"] or 1.0) ** (1 - tau)
    shares = shares.select("_source", "tokens", (F.pow("p", F.lit(tau)) / F.lit(z["z"] or 1.0)).alias("weight"), F.round(F.pow("p", F.lit(tau - 1)) * F.lit(scale), 9).alias("repeats")).withColumn("full", F.floor("repeats").cast("int"))
    # a source has at most `blocks` rows here, however large it is
    ordered = cells.join(shares.select("_source", "repeats", "full", F.col("tokens").alias("all")), "_source").withColumn("place", order_of(F.col("full")))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("_source").orderBy("place", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = ordered.withColumn("before", before).groupBy("_source").agg(F.max(F.when(F.col("before") + F.col("tokens") / 2 <= (F.col("repeats") - F.col("full")) * F.col("all"), F.col("place"))).alias("cut"))
    return shares.join(cut, "_source").select("_source", "weight", "repeats", "full", F.coalesce("cut", F.lit(-1)).alias("cut")), whole["n"]


def own_names(columns: list[str]) -> dict[str, str]:
    """Names of the columns that mix adds: each as here, with more underscores before it where docs has that name."""
    wanted = ["_source", "_block", "_epoch", "_weight", "_repeats", "_at"]
    return dict(zip(wanted, unused(columns, *wanted), strict=True))


def mix(docs: DataFrame, *, repetition: float | None = REPETITION, entropy: float | None = None, budget: int | None = None, blocks: int = BLOCKS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs in the shares that the mixture asks for, with columns before their own:

    _source (key), _block, _epoch, _weight, _repeats, _at (own_names, where docs has these already).
    A source with repeats 2.3 has each row in epochs 0 and 1 and the blocks that come first in its
    third permutation, up to 0.3 of its tokens, in epoch 2. _at, from 0 to 1, orders the mixture: in
    every stretch of it each source has its weight. A row costs its words, one at least. A budget in
    tokens below what shows every row once leaves out blocks, as asked; without one every row is kept.

    Only functions of Spark SQL. Rows are neither shuffled nor collected: the plan has a row per source
    and joins them by broadcast (up to BROADCAST_SOURCES) or by key; a source's tokens are summed per
    block first, so that a source with a third of all rows has no task of its own.

    Rows without a source are a source of their own; null ids and null texts are rows like any other;
    repeated rows are in one block; one source alone has repeats 1; an empty table gives no rows. Other
    columns are kept, whatever their names.
    """
    keyed = docs.select(
        F.struct(*map(named, docs.columns)).alias("_row"),  # so that none of their names meets one of ours
        source_key(source_col).alias("_source"),
        F.pmod(F.xxhash64(named(id_col), F.lit(SEED)), F.lit(blocks)).cast("int").alias("_block"),
        F.greatest(F.regexp_count(text_of(text_col), F.lit(WORD_CLASS)), F.lit(1)).cast("long").alias("_tokens"),
    )
    by_source, sources = plan(keyed, repetition=repetition, entropy=entropy, budget=budget, blocks=blocks)
    small = by_source.select("_source", F.col("weight").alias("_weight"), F.col("repeats").alias("_repeats"), F.col("full").alias("_full"), F.col("cut").alias("_cut"))
    joined = keyed.drop("_tokens").join(F.broadcast(small) if sources <= BROADCAST_SOURCES else small, "_source")
    copies = F.col("_full") + (order_of(F.col("_full")) <= F.col("_cut")).cast("int")
    shown = joined.withColumn("_epoch", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))))
    at = (F.col("_epoch") + order_of(F.col("_epoch")) / F.lit(float(1 << 31))) / F.greatest("_repeats", F.lit(1e-9))
    shown = shown.withColumn("_at", F.least(at, F.lit(1.0)))
    return shown.select(*(F.col(ours).alias(name) for ours, name in own_names(docs.columns).items()), *(F.col("_row")[c].alias(c) for c in docs.columns))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", F.col("_block").alias("block"), F.col("_epoch").alias("epoch"), F.col("_weight").alias("weight"), F.col("_repeats").alias("repeats"), F.col("_at").alias("at"))
