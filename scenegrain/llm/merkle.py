"""Merkle manifest: a tree per group of rows and one over the groups, with every row's authentication path."""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import named, stored, table

#: An aligned block has 2 ** BLOCK nodes, and a subtree of the traversal 2 ** SUBTREE.
BLOCK, SUBTREE = 10, 5
#: Rows of a range partition; tables sent to all tasks have at most so many rows (32 MB: a path has some 30 digests).
RANGE, BROADCAST_ROWS = 200_000, 1 << 14
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values, each as its UTF-8 byte count, a colon and itself, or a hyphen for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


def joined(left: str, right: str | None) -> str:
    return sha256((left + right if right else left).encode()).hexdigest()


Subtree = list[list[str | None]]


def grown(leaves: list[str], first: int, base: int, top: int) -> Generator[None, None, Subtree]:
    """Builds the subtree over 2 ** top leaves from `first` on and gives its nodes of levels base to top.

    Stops after each leaf and each digest, holding one node a level besides those it keeps. Beyond the
    last leaf there are no nodes; a node without a right-hand sibling is hashed alone.
    """
    kept: Subtree = [[] for _ in range(base, top + 1)]
    stack: list[tuple[int, str | None]] = []
    for i in range(first, first + (1 << top)):
        node, level = leaves[i] if i < len(leaves) else None, 0
        if not base:
            kept[0].append(node)
        yield
        while stack and stack[-1][0] == level:
            left, level = stack.pop()[1], level + 1
            node = joined(left, node) if left else None
            if level >= base:
                kept[level - base].append(node)
            yield
        stack.append((level, node))
    return kept


def finished(subtree: Generator[None, None, Subtree]) -> Subtree:
    while True:
        try:
            next(subtree)
        except StopIteration as end:
            return end.value


def root_of(leaves: list[str], height: int) -> str:
    return finished(grown(leaves, 0, height, height))[0][0]


def paths(leaves: list[str], height: int, subtree: int = SUBTREE) -> Iterator[list[str]]:
    """The authentication path of each leaf in turn, by fractal traversal of a tree of the given height.

    A path has one step a level: the sibling's digest behind L or R, the side that it is on, or an empty
    string where there is none. The tree's levels are cut into bands of `subtree` levels. Each band
    keeps the existing subtree, which the current leaf's path runs through, and grows the desired one,
    which is next, by two units a leaf, so that it is ready when the path leaves the existing one.
    """
    bands = [(base, min(base + subtree, height)) for base in range(0, height, subtree)]
    existing = [finished(grown(leaves, 0, base, top)) for base, top in bands]
    desired = [grown(leaves, 1 << top, base, top) for base, top in bands]
    ready: list[Subtree | None] = [None] * len(bands)
    for at in range(len(leaves)):
        path = []
        for (base, top), nodes in zip(bands, existing, strict=True):
            inside = at & ((1 << top) - 1)
            for level in range(base, top):
                node = inside >> level
                digest = nodes[level - base][node ^ 1]
                path.append(("L" if node & 1 else "R") + digest if digest else "")
        yield path
        for i, (base, top) in enumerate(bands):
            if (at + 1) >> top << top == at + 1 < len(leaves):
                existing[i] = ready[i] or finished(desired[i])
                desired[i], ready[i] = grown(leaves, at + 1 + (1 << top), base, top), None
            if ready[i] is None and at + (1 << top) < len(leaves):
                try:
                    next(desired[i])
                    next(desired[i])
                except StopIteration as end:
                    ready[i] = end.value


def folded(digest: str, path: list[str]) -> str:
    """The root that a leaf and its path lead to."""
    for step in path:
        digest = joined(step[1:], digest) if step[:1] == "L" else joined(digest, step[1:])
    return digest


def height_of(n: int, whole: int, block: int) -> int:
    """Levels of a block of n nodes in a tree of `whole` nodes: those of a full block, unless it is the tree's only one."""
    return block if whole > 1 << block else (n - 1).bit_length()


def fewer(n: str, block: int) -> Column:
    """Blocks that n nodes fill."""
    return F.expr(f"({n} + {(1 << block) - 1}) div {1 << block}")


def positions(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with pos, the place in their group g from 0 on, and n, the group's size. rows are stored and have a salt.

    Dealt by ranges of group, order and salt, so that neither a large group nor equal rows fall to one
    task; a partition's first place in a group is the sum of the counts of those before it.
    """
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // RANGE))
    by = ["g", *order, "salt"]
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("salt")
    ranged, _ = stored(dealt.withColumn("p", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "merkle-ranged")
    counts = ranged.groupBy("p", "g").agg(F.count("*").alias("c"), F.min("seq").alias("least"))
    so_far, whole = Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("g")
    begins, _ = stored(counts.select("p", "g", (F.coalesce(F.sum("c").over(so_far), F.lit(0)) - F.col("least")).alias("shift"), F.sum("c").over(whole).alias("n")), "merkle-counts")
    few = begins.count() <= BROADCAST_ROWS
    return ranged.join(F.broadcast(begins) if few else begins, ["p", "g"]).withColumn("pos", F.col("seq") + F.col("shift")).drop("p", "seq", "shift")


def packed(nodes: DataFrame, block: int, *more: str) -> DataFrame:
    """One row of each aligned block of nodes (g, pos, n, digest): g, block, n, digests, what `more` names as arrays, and its root."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        digests = group["digest"].to_pylist()
        whole = group["n"][0].as_py()
        lists = [pa.array([group[c].to_pylist()], pa.list_(group.schema.field(c).type)) for c in ("digest", *more)]
        root = root_of(digests, height_of(len(digests), whole, block))
        return pa.Table.from_arrays([pa.array([group["g"][0].as_py()], pa.string()), pa.array([group["block"][0].as_py()], pa.int64()), pa.array([whole], pa.int64()), *lists, pa.array([root], pa.string())], names=names)

    names = ["g", "block", "n", "digests", *(f"{c}s" for c in more), "root"]
    kinds = [T.StringType(), T.LongType(), T.LongType(), T.ArrayType(T.StringType()), *(T.ArrayType(nodes.schema[c].dataType) for c in more), T.StringType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
    rows = nodes.select("g", F.shiftright("pos", block).alias("block"), "n", "pos", "digest", *more)
    return stored(rows.groupBy("g", "block").applyInArrow(run, schema), "merkle-blocks")[0]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row, which is a block, at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def with_upper(blocks: DataFrame, upper: DataFrame) -> DataFrame:
    """Blocks with the columns of upper, which has one row a block; few are sent to all tasks, more are joined by block."""
    return blocks.join(F.broadcast(upper) if blocks.count() <= BROADCAST_ROWS else upper, ["g", "block"])


def above(nodes: DataFrame, n: int, block: int) -> DataFrame:
    """g, block (the node's pos), path to the root of its group, and that root as top, of nodes (g, pos, n, digest) in groups of at most n.

    A tree of blocks of blocks: as many rounds as n has digits of base 2 ** block.
    """
    if n <= 1:
        return nodes.select("g", F.col("pos").alias("block"), F.array().cast("array<string>").alias("path"), F.col("digest").alias("top"))
    blocks = packed(nodes, block)
    up = with_upper(blocks, above(blocks.select("g", F.col("block").alias("pos"), fewer("n", block).alias("n"), F.col("root").alias("digest")), -(-n >> block), block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            digests = r["digests"]
            own = [p + r["path"] for p in paths(digests, height_of(len(digests), r["n"], block))]
            at = [(r["block"] << block) + i for i in range(len(digests))]
            yield pa.RecordBatch.from_arrays([pa.array([r["g"]] * len(own), pa.string()), pa.array(at, pa.int64()), pa.array(own, pa.list_(pa.string())), pa.array([r["top"]] * len(own), pa.string())], names=["g", "block", "path", "top"])

    return stored(up.select("g", "block", "n", "digests", "path", "top").mapInArrow(run, "g string, block long, path array<string>, top string"), "merkle-above")[0]


def _walked(df: DataFrame, of: Callable[[str, str | None, list[str], str, str], tuple], fields: list[T.StructField], columns: tuple[str, ...], id_col: str, group_col: str, claimed: Column | None, block: int) -> DataFrame:
    """doc_id and what of(leaf, claimed leaf, path, subroot, root) gives, of every row."""
    key = F.coalesce(F.concat(F.lit("v"), named(group_col).cast("string")), F.lit("n"))  # null first, then the groups bytewise
    base = df.select(named(id_col).cast("long").alias("doc_id"), key.alias("g"), leaf_of(*map(named, columns)).alias("digest"), (F.lit(None) if claimed is None else claimed).cast("string").alias("claim"), F.monotonically_increasing_id().alias("salt"))
    ranked = positions(stored(base, "merkle-leaves")[0], "doc_id", "digest")
    blocks = packed(ranked, block, "doc_id", "claim")
    most = blocks.agg(F.max("n")).first()[0] or 0
    roots = blocks.select("g", F.col("block").alias("pos"), fewer("n", block).alias("n"), F.col("root").alias("digest"))
    upper = above(roots, -(-most >> block), block)
    subroots, _ = stored(upper.where("block = 0").select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("top").alias("digest"), F.lit(0).alias("salt")), "merkle-subroots")
    groups = positions(subroots, "name")
    tops = above(groups.select("g", "pos", "n", "digest"), subroots.count(), block).select(F.col("block").alias("pos"), F.col("path").alias("last"), F.col("top").alias("whole"))
    named_tops = groups.select(F.col("name").alias("g"), "pos").join(tops, "pos").drop("pos")
    whole = with_upper(blocks, upper.join(named_tops, "g").select("g", "block", F.concat("path", "last").alias("path"), "top", "whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            leaves = r["digests"]
            walk = paths(leaves, height_of(len(leaves), r["n"], block))
            found = [of(leaf, claim, path + r["path"], r["top"], r["whole"]) for leaf, claim, path in zip(leaves, r["claims"], walk, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), arrow, strict=True))], names=["doc_id", *(f.name for f in fields)])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), *fields])
    arrow = [pa.list_(pa.string()) if isinstance(f.dataType, T.ArrayType) else pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.string() for f in fields]
    return whole.select("digests", "doc_ids", "claims", "n", "path", "top", "whole").mapInArrow(run, schema)


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def proofs(df: DataFrame, *, columns: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", block: int = BLOCK) -> DataFrame:
    """doc_id, leaf, path, subroot and root of every row; path as in paths(), from the leaf via the group's root to the root.

    A group's leaves ascend by id, null first, equal ids by leaf; equal rows have equal leaves and take
    any of their places. Groups ascend bytewise, null first. Null fields, ids and groups are values of
    their own; empty and long texts are hashed where they are read, and nothing longer than a digest is
    shuffled. A tree of one leaf is that leaf, with an empty path. An empty table gives no rows; other
    columns are ignored, whatever their names. Blocks of 2 ** block leaves are walked one by one and get
    the path of their root from rounds over the roots of blocks.
    """
    return _walked(df, lambda leaf, _, path, subroot, root: (leaf, path, subroot, root), [*_strings("leaf"), T.StructField("path", T.ArrayType(T.StringType())), *_strings("subroot", "root")], columns, id_col, group_col, None, block)


def checked(df: DataFrame, claimed: Column, *, columns: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", block: int = BLOCK) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row, the claimed leaf (null: its own) folded along its path; odd rows as in proofs()."""

    def of(leaf: str, claim: str | None, path: list[str], subroot: str, root: str) -> tuple:
        found = folded(claim or leaf, path)
        return leaf, subroot, root, sha256("".join(s[1:] for s in path).encode()).hexdigest(), found, found == root

    return _walked(df, of, [*_strings("leaf", "subroot", "root", "proof_sha256", "folded_root"), T.StructField("verified", T.BooleanType())], columns, id_col, group_col, claimed, block)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = leaf_of(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS))
    return checked(table(spark, sf_dir, "documents"), F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, tampered))


_FIELD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f"({c})") for c in FIELDS) + ")"
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten([[(ascii(x) >> b) & 1 for b in range(8)] for x in string_split(doc_id::varchar, '')])),
    lambda c, b: xor(c >> 1, xor(c & 1, b) * 3988292384)))"""

#: Trees by recursion, level by level; a level's row has the sibling, if any, beside it.
ORACLE_SQL = f"""
with recursive leaves as (
    select doc_id, lang, {_LEAF} leaf, case when ({_CRC}) % 7 = 0 then {_LEAF.replace("(n_chars)", "(n_chars + 1)")} end claim,
        row_number() over (partition by lang order by doc_id nulls first) - 1 pos, count(*) over (partition by lang) n
    from documents),
low as (
    select 0 lvl, lang, pos, n, leaf digest from leaves
    union all
    select lvl + 1, lang, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' order by pos)) from low where n > 1 group by lvl, lang, pos // 2),
subroots as (select lang, digest subroot, lvl height, row_number() over (order by encode(lang) nulls first) - 1 pos, count(*) over () n from low where n = 1),
high as (
    select 0 lvl, pos, n, subroot digest from subroots
    union all
    select lvl + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' order by pos)) from high where n > 1 group by lvl, pos // 2),
steps as (
    select l.doc_id, t.lvl, s.digest sibling, (l.pos >> t.lvl) & 1 side
    from leaves l join (select distinct lang, lvl from low where n > 1) t on t.lang is not distinct from l.lang
    left join low s on s.lang is not distinct from l.lang and s.lvl = t.lvl and s.pos = xor(l.pos >> t.lvl, 1)
    union all
    select l.doc_id, r.height + t.lvl, s.digest, (r.pos >> t.lvl) & 1
    from leaves l join subroots r on r.lang is not distinct from l.lang cross join (select distinct lvl from high where n > 1) t
    left join high s on s.lvl = t.lvl and s.pos = xor(r.pos >> t.lvl, 1)),
proofs as (
    select doc_id, string_agg(coalesce(sibling, ''), '' order by lvl) siblings, list([case when side = 1 then coalesce(sibling, '') else '' end, case when side = 0 then coalesce(sibling, '') else '' end] order by lvl) path
    from steps group by doc_id),
folds as (
    select l.doc_id, l.leaf, r.subroot, coalesce(l.claim, l.leaf) digest, coalesce(p.siblings, '') siblings, p.path, 1 i
    from leaves l join subroots r on r.lang is not distinct from l.lang left join proofs p on p.doc_id = l.doc_id
    union all
    select doc_id, leaf, subroot, sha256(path[i][1] || digest || path[i][2]), siblings, path, i + 1 from folds where i <= len(path))
select doc_id, leaf, subroot, root, sha256(siblings) proof_sha256, digest folded_root, digest = root verified
from folds cross join (select digest root from high where n = 1) where i > coalesce(len(path), 0)
"""
