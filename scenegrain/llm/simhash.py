"""SimHash near-duplicates: fingerprints linked through one-wildcard variants of two segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import looked_up, map_rows, named, stored, table, text_of, unused
from .components import components

SHINGLE, SEED, MOST_BITS = 3, 42, 3
#: A bucket of more fingerprints than this is cut again by variants of the other segment.
BUCKET_MOST = 4096
#: Fingerprints that one task makes the keys of.
SPREAD = 100_000
#: Tables of at most this many pairs of numbers (32 MB) are sent to all tasks, larger ones joined by key.
BROADCAST_ROWS = 2_000_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; 0 for a text without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space cuts
    n = len(words) - shingle + 1
    if not words:
        return 0
    whole = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (np.concatenate([[0], ends[: n - 1]])).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, 255):
        counts += np.add.reduce(bits[lo : lo + 255], 0, np.uint8)
    return int(np.packbits(2 * counts > n).view(np.uint64)[0])


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (signed) of every row, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                fp = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])
    return df.select(named(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def variants(distinct: DataFrame) -> DataFrame:
    """fp and its 64 keys: either half with one bit taken out, and which.

    Two fingerprints that differ in three bits at most differ in one bit at most in one of the
    halves, so they share at least one key.
    """
    i = F.col("i")
    half = F.when(i < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    without = half.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, i % 32)")))
    return distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select("fp", (F.expr("shiftleft(cast(i as bigint), 32)") + without).alias("key"))


def linked(members: np.ndarray, bits: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges, at most one fewer than members, that connect what is connected by steps of at most `bits` bits.

    Breadth first: a member is compared with those not reached yet, so a group of close copies costs
    one comparison each, and no pair beyond a spanning forest comes out.
    """
    left, a, b = np.unique(members), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= bits
            if near.any():
                found = left[near]
                left = left[~near]
                queue += list(found)
                a.append(np.full(len(found), at, np.uint64))
                b.append(found)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _link_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        a, b = linked(group["fp"].to_numpy().view(np.uint64))
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return df.groupBy(*keys).applyInArrow(run, "a long, b long")


def _link_rows(df: DataFrame) -> DataFrame:
    """Edges of buckets that are rows: key and its fingerprints, few enough to be gathered by the aggregate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [linked(x.values.to_numpy().view(np.uint64)) for x in batch.column(0)]
            a, b = (np.concatenate([f[i] for f in found] or [np.empty(0, np.uint64)]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return df.groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(run, "a long, b long")


def edges(distinct: DataFrame, *, bucket_most: int = BUCKET_MOST) -> DataFrame:
    """Edges between distinct fingerprints that connect all pairs of at most three differing bits.

    Keys are counted with their smallest and largest fingerprint, aggregated before the shuffle. A
    bucket of two is verified at once. Larger ones are gathered, up to bucket_most fingerprints (8
    bytes each), and linked in one task; beyond it they are cut by one-wildcard variants of the two
    halves of the other segment, of which one again differs by one bit at most: such a part holds at
    most 2 ** 18 different fingerprints, whatever the input. Nothing is dropped.
    """
    spread = max(distinct.sparkSession.sparkContext.defaultParallelism, 1 + distinct.count() // SPREAD)  # a task makes 64 rows of each
    keyed = variants(distinct.repartition(spread, "fp"))
    counted = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    buckets, _ = stored(counted, "buckets")
    sizes = buckets.agg(F.count_if(F.col("n") > 2).alias("more"), F.count_if(F.col("n") > bucket_most).alias("huge")).first()
    out = buckets.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS)).select("a", "b")
    if sizes["more"]:
        wanted = buckets.where("n > 2").select("key", "n")
        members = keyed.join(F.broadcast(wanted) if sizes["more"] <= BROADCAST_ROWS else wanted, "key")
        out = out.union(_link_rows(members.where(F.col("n") <= bucket_most).select("key", "fp")))
        if sizes["huge"]:
            # of a key below 2 ** 37 the low half is free, of the others the high one
            free = F.when(F.col("key") < F.lit(1 << 37), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
            parts = members.where(F.col("n") > bucket_most).select("key", "fp", free.alias("free")).select("*", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
            half = F.when(F.col("i") < 16, F.shiftright("free", 16)).otherwise(F.col("free").bitwiseAND(F.lit(0xFFFF)))
            sub = F.expr("cast(i as bigint) * 65536") + half.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, i % 16)")))
            out = out.union(_link_groups(parts.select("key", sub.alias("sub"), "fp"), ["key", "sub"]))
    return out


def groups(fps: DataFrame) -> DataFrame:
    """Of each distinct fp of fps: n (rows), first (smallest doc_id), component_id (smallest doc_id reachable), keeper (the fp whose first that is)."""
    distinct, _ = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    roots = components(edges(distinct.select("fp"))).withColumnRenamed("node", "fp")
    rooted, _ = stored(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    ids = rooted.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "fp")).alias("k"), F.count("*").alias("size"))
    ids = ids.select("root", "size", F.col("k.first").alias("component_id"), F.col("k.fp").alias("keeper"))
    found, _ = stored(looked_up(rooted, ids, "root", "size", rooted.count()).select("fp", "n", "first", "component_id", "keeper"), "found")
    return found


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Texts are read once; what is shuffled are 64 keys per distinct fingerprint. Copies share a
    fingerprint and are one node, so a group with a third of all rows is aggregated before anything
    is linked. Null and empty texts, and texts of white space, have fingerprint 0 and are linked as
    any other. Null ids are never the smallest; a component of null ids only has a null component_id.
    Repeated rows are rows of their own; an empty table gives no rows; other columns are ignored.
    """
    fps, _ = stored(fingerprints(df, id_col=id_col, text_col=text_col), "fingerprints")
    found = looked_up(fps, groups(fps).select("fp", "n", "component_id"), "fp", "n", fps.count())
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each component: that of the smallest id, or of the smallest fingerprint if ids tie or are null.

    Null and empty texts are copies of each other (fingerprint 0). Of repeated rows one is left;
    rows of one id and fingerprint but different texts count as repeated, and any of them stays. An
    empty table gives no rows; other columns are kept, whatever their names.
    """
    names = docs.columns
    where = names.index(text_col)
    own_fp, gone_id, gone_fp = unused(names, "_fp", "_gone", "_gone_fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                fp = np.array([fingerprint(t or "") for t in part.column(where).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fp)], names=[*part.schema.names, f"c{len(names)}"])

    with_fp, _ = stored(map_rows(docs, run, T.StructField(own_fp, T.LongType())), "with-fp")
    fps = with_fp.select(named(id_col).cast("long").alias("doc_id"), F.col(own_fp).alias("fp"))
    found = groups(fps)
    each = fps.groupBy("doc_id", "fp").agg(F.count("*").alias("c"))
    rows = looked_up(each, found, "fp", "n", fps.count()).select("doc_id", "fp", "c", ((F.col("fp") == F.col("keeper")) & F.col("doc_id").eqNullSafe(F.col("first"))).alias("keep"))
    out, _ = stored(rows.where("not keep or c > 1"), "dropped")
    sizes = out.agg(F.count_if(~F.col("keep")).alias("drop"), F.count_if("keep").alias("repeated")).first()
    gone = out.where("not keep").select(F.col("doc_id").alias(gone_id), F.col("fp").alias(gone_fp))
    gone = F.broadcast(gone) if sizes["drop"] <= BROADCAST_ROWS else gone  # beyond it dealt by id and fingerprint, so that copies part
    kept = with_fp.join(gone, (F.col(own_fp) == F.col(gone_fp)) & named(id_col).cast("long").eqNullSafe(F.col(gone_id)), "left_anti")
    if sizes["repeated"]:
        kept = kept.dropDuplicates([id_col, own_fp])
    return kept.select(*map(named, names))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
