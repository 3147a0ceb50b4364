"""Ranked lexical search over a tiered index: postings of high impact first, lower tiers for what they leave unproven."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import named, stored, table, text_of

TOP = 10
#: Bytes of item text that are searched together; with more, the items are dealt to several blocks, each with an index of its terms.
ITEM_BYTES = 1 << 20
#: Share of a term's postings, in order of impact, that the tiers down to each one hold, and postings of which the first tier has no fewer.
SHARES, LEAST = (1 / 4, 1 / 2, 7 / 8, 1.0), 2048
#: Impacts are below 10 ** 6; tiers are cut between this many levels of it.
LEVELS = 64
LEVEL = 10**6 // LEVELS
#: Numbers in a task's matrix of documents x items, and bytes of a text that are split at once.
MATRIX, TOGETHER = 1 << 21, 1 << 22
#: Ranges of row keys that the scan of single documents is narrowed to.
RANGES = 128

#: Of the term rule: ASCII letters and digits and all bytes of other characters; only A-Z are lower-cased.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text (UTF-8), in lists of some TOGETHER bytes."""
    text, lo = text.translate(TERM_BYTES), 0
    while lo < len(text):
        hi = text.find(b" ", lo + TOGETHER)
        hi = len(text) if hi < 0 else hi
        yield text[lo:hi].split()
        lo = hi


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists, and how many each row has."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy().astype(np.int64), np.diff(offsets)


def counted(docs: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """key, doc_id, n (all terms) and, of the numbered terms, terms and tfs of every row: texts are read this once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.get
        for batch in batches:
            n, terms, tfs = [], [], []
            for i in range(batch.num_rows):
                total, some = 0, []
                for words in terms_of(batch.column(2)[i].as_buffer().to_pybytes()):
                    total += len(words)
                    some += [t for t in map(get, words) if t is not None]
                unique, tf = np.unique(np.array(some, np.int64), return_counts=True)
                n.append(total)
                terms.append(unique)
                tfs.append(tf)
            counts = np.array([len(t) for t in terms], np.int64)
            join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), lists(join(terms), counts), lists(join(tfs), counts)], names=["key", "doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.monotonically_increasing_id().alias("key"), named(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    return stored(rows.mapInArrow(run, "key long, doc_id long, n long, terms array<int>, tfs array<int>"), "tiered-counted")[0]


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """Impact of postings in documents of n terms, before the term's weight."""
    m = 25 + 75 * n * docs // max(1, length)
    return 10**9 * tf // (1000 * tf + 8 * m)


def levels(rows: DataFrame, docs: int, length: int) -> DataFrame:
    """term, level of impact, c postings of it and most, the largest impact among them: counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (term, counts), (tf, _) = flat(batch.column(1)), flat(batch.column(2))
            f = impacts(tf, np.repeat(batch.column(0).to_numpy(), counts), docs, length)
            order = np.lexsort((f, term))
            at, f = (term * LEVELS + f // LEVEL)[order], f[order]
            last = np.flatnonzero(np.append(at[1:] != at[:-1], True)) if len(at) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at[last] // LEVELS, at[last] % LEVELS, np.diff(last, prepend=-1), f[last])], names=["term", "level", "c", "most"])

    return rows.select("n", "terms", "tfs").mapInArrow(run, "term long, level long, c long, most long").groupBy("term", "level").agg(F.sum("c").alias("c"), F.max("most").alias("most"))


def cuts(rows: DataFrame, terms: int, docs: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each term: df; the level that each tier begins at; and its residual bound, the largest impact below each tier.

    A tier takes whole levels until it has its share of the postings. At most one row a term comes to the driver.
    """
    by = Window.partitionBy("term").orderBy(F.desc("level"))
    before = F.sum("c").over(by.rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("c").over(Window.partitionBy("term"))
    found = levels(rows, docs, length).select("term", "level", "most", "c", F.coalesce(before, F.lit(0)).alias("before"), whole.alias("df"))
    wanted = [F.greatest(F.lit(LEAST), F.ceil(F.col("df") * share)) if share < 1 else F.col("df") for share in SHARES]
    begins = [F.min(F.when(F.col("before") < w, F.col("level"))).alias(f"begin{k}") for k, w in enumerate(wanted)]
    below = [F.max(F.when(F.col("before") >= w, F.col("most"))).alias(f"below{k}") for k, w in enumerate(wanted)]
    df, begin, bound = np.zeros(terms, np.int64), np.zeros((len(SHARES), terms), np.int64), np.zeros((len(SHARES), terms), np.int64)
    for r in found.groupBy("term").agg(F.first("df").alias("df"), *begins, *below).collect():
        df[r["term"]] = r["df"]
        for k in range(len(SHARES)):
            begin[k, r["term"]], bound[k, r["term"]] = r[f"begin{k}"], r[f"below{k}"] or 0
    return df, begin, bound


def indexed(rows: DataFrame, begin: np.ndarray, docs: int, length: int) -> DataFrame:
    """The index: a row per document with postings, and for each tier columns of its own, so that a search reads no column of lower tiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (term, counts), (tf, _) = flat(batch.column(3)), flat(batch.column(4))
            row = np.repeat(np.arange(batch.num_rows), counts)
            f = impacts(tf, batch.column(2).to_numpy()[row], docs, length)
            tier = (f // LEVEL < begin[:, term]).sum(0)
            columns = [batch.column(0), batch.column(1)]
            for k in range(len(SHARES)):
                mine = tier == k
                per = np.bincount(row[mine], minlength=batch.num_rows)
                columns += [lists(term[mine], per), lists(f[mine], per)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["key", "doc_id", *(f"{c}{k}" for k in range(len(SHARES)) for c in ("terms", "impacts"))]
    schema = "key long, doc_id long, " + ", ".join(f"{c} array<int>" for c in names[2:])
    return stored(rows.where(F.size("terms") > 0).select("key", "doc_id", "n", "terms", "tfs").mapInArrow(run, schema), "tiered-index")[0]


class Items:
    """The terms of items, turned around: which items ask for a term, and with what weight (repeats x the term's)."""

    def __init__(self, asked: list[dict[int, int]], weight: np.ndarray):
        item = np.repeat(np.arange(len(asked)), [len(a) for a in asked])
        term = np.array([t for a in asked for t in a], np.int64)
        by = np.argsort(term, kind="stable")
        self.n, self.item = len(asked), item[by]
        self.weight = (np.array([c for a in asked for c in a.values()], np.int64) * weight[term])[by]
        self.term = term[by]
        self.count = np.bincount(term, minlength=len(weight))
        self.first = np.cumsum(self.count) - self.count

    def totals(self, bound: np.ndarray) -> np.ndarray:
        """Of each item, the most that a document without any of its postings so far can score."""
        out = np.zeros(self.n, np.int64)
        np.add.at(out, self.item, self.weight * bound[self.term])
        return out

    def scores(self, row: np.ndarray, term: np.ndarray, f: np.ndarray, rows: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matrices of documents x items: what the postings add up to, and the bounds of their terms."""
        count = self.count[term]
        ends = np.cumsum(count)
        at = np.repeat(self.first[term] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)
        cell = np.repeat(row, count) * self.n + self.item[at]
        lower, had = np.zeros(rows * self.n, np.int64), np.zeros(rows * self.n, np.int64)
        np.add.at(lower, cell, self.weight[at] * np.repeat(f, count))
        np.add.at(had, cell, self.weight[at] * np.repeat(bound[term], count))
        return lower.reshape(rows, self.n), had.reshape(rows, self.n)


def _slices(batch: pa.RecordBatch, tiers: int, n_items: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch of the index: rows, and of their postings in the first tiers the row, term and impact."""
    step = max(1, MATRIX // max(1, n_items))
    for lo in range(0, batch.num_rows, step):
        part = batch.slice(lo, step)
        found = [(np.repeat(np.arange(part.num_rows), flat(part.column(c))[1]), flat(part.column(c))[0], flat(part.column(c + 1))[0]) for c in range(2, 2 + 2 * tiers, 2)]
        yield part, *(np.concatenate(x) for x in zip(*found, strict=True))


def _tier_columns(tiers: int) -> list[str]:
    return ["key", "doc_id", *(f"{c}{k}" for k in range(tiers) for c in ("terms", "impacts"))]


def candidates(index: DataFrame, items: Items, bound: np.ndarray, tiers: int, top: int) -> DataFrame:
    """By task: of each item the `top` documents of the highest sums in the first tiers, with lower and upper bound; and, where key is null, the largest upper bound of the others that isn't exact."""
    missing = items.totals(bound)

    def pruned(rows: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """rows: item, lower, upper, no id, doc_id, key; the first `top` of each item."""
        rows = rows[:, np.lexsort((rows[5], rows[4], rows[3], -rows[1], rows[0]))]
        begins = np.append(True, rows[0][1:] != rows[0][:-1]) if rows.shape[1] else np.empty(0, bool)
        at = np.arange(rows.shape[1])
        keep = at - np.maximum.accumulate(np.where(begins, at, 0)) < top if len(at) else np.empty(0, bool)
        open_ = ~keep & (rows[2] > rows[1])
        np.maximum.at(rest, rows[0][open_], rows[2][open_])
        return rows[:, keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, rest, least = np.empty((6, 0), np.int64), np.full(items.n, -1), np.ones(items.n, np.int64)
        for batch in batches:
            for part, row, term, f in _slices(batch, tiers, items.n):
                lower, had = items.scores(row, term, f, part.num_rows, bound)
                upper = lower + missing - had
                if part.num_rows >= top:
                    least = np.maximum(least, np.partition(lower, part.num_rows - top, axis=0)[part.num_rows - top])
                chosen = lower >= least
                rest = np.maximum(rest, np.where(chosen | (upper == lower), -1, upper).max(axis=0, initial=-1))
                at, item = np.nonzero(chosen)
                ids = part.column(1)
                none = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                values = [item, lower[at, item], upper[at, item], none[at], ids.fill_null(0).to_numpy()[at], part.column(0).to_numpy()[at]]
                best = pruned(np.concatenate([best, np.array(values, np.int64).reshape(6, -1)], axis=1), rest)
        doc = pa.array(best[4], mask=best[3].astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[1]), pa.array(best[2]), doc, pa.array(best[5])], names=names)
        nothing = pa.nulls(items.n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(items.n)), nothing, pa.array(rest), nothing, nothing], names=names)

    names = ["item", "lower", "upper", "doc_id", "key"]
    return index.select(*_tier_columns(tiers)).mapInArrow(run, ", ".join(f"{c} long" for c in names))


ORDER = (F.desc, "lower"), (F.asc_nulls_last, "doc_id"), (F.asc, "key")


def judged(found: DataFrame, top: int) -> DataFrame:
    """Of each item: its `top` candidates of all tasks, and others, the largest upper bound of any other document seen that isn't exact."""
    found, _ = stored(found, "tiered-candidates")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*(way(c) for way, c in ORDER)))
    ranked = found.where("key is not null").withColumn("rank", rank)
    beyond = ranked.where(F.col("rank") > top).where("upper > lower").select("item", "upper")
    others = beyond.unionByName(found.where("key is null").select("item", "upper")).groupBy("item").agg(F.max("upper").alias("others"))
    return ranked.where(F.col("rank") <= top).join(others, "item", "right").select("item", "lower", "upper", "doc_id", "key", "others")


def completed(index: DataFrame, items: Items, wanted: dict[int, list[int]]) -> DataFrame:
    """item, doc_id, key and full score of given pairs; wanted: items by the key of a document.

    The scan is narrowed to ranges of keys, which the index is in order of, so that files and pages
    between them aren't read.
    """
    keys = np.array(sorted(wanted), np.int64)
    gaps = np.sort(np.argsort(np.diff(keys), kind="stable")[::-1][: RANGES - 1]) + 1
    near = [F.col("key").between(int(part[0]), int(part[-1])) for part in np.split(keys, gaps)]
    while len(near) > 1:
        near = [reduce(lambda a, b: a | b, near[i : i + 2]) for i in range(0, len(near), 2)]
    tiers = len(SHARES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(np.isin(batch.column(0).to_numpy(), keys)))
            for part, row, term, f in _slices(batch, tiers, items.n):
                lower, _ = items.scores(row, term, f, part.num_rows, np.zeros(len(items.count), np.int64))
                mine = [wanted[k] for k in part.column(0).to_pylist()]
                at, item = np.repeat(np.arange(part.num_rows), list(map(len, mine))), np.array([i for m in mine for i in m], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(item), part.column(1).take(pa.array(at)), part.column(0).take(pa.array(at)), pa.array(lower[at, item])], names=["item", "doc_id", "key", "score"])

    return index.where(near[0]).select(*_tier_columns(tiers)).mapInArrow(run, "item long, doc_id long, key long, score long")


def _search_block(docs: DataFrame, block: list[tuple[int | None, str]], top: int, id_col: str, text_col: str) -> tuple[list[tuple], list[int]]:
    """Rows (item_id, rank, doc_id, score) of the items of a block, and how many items each tier proved."""
    number: dict[bytes, int] = {}
    asked = []
    for _, text in block:
        asked.append({})
        for words in terms_of(text.encode()):
            for w in words:
                t = number.setdefault(w, len(number))
                asked[-1][t] = asked[-1].get(t, 0) + 1
    rows = counted(docs, number, id_col, text_col)
    total = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("length")).first()
    n_docs, length = total["docs"], total["length"] or 0
    df, begin, bound = cuts(rows, len(number), n_docs, length)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    index = indexed(rows, begin, n_docs, length)
    pending, out, proved = [i for i, a in enumerate(asked) if a], [], []
    for k in range(len(SHARES)):
        if not pending:
            break
        items = Items([asked[i] for i in pending], weight)
        unseen = items.totals(bound[k])
        found: dict[int, list] = {}
        for r in judged(candidates(index, items, bound[k], k + 1, top), top).collect():
            found.setdefault(r["item"], []).append(r)
        exact, open_, wanted = [], [], {}
        for i in range(items.n):
            mine = [r for r in found.get(i, []) if r["key"] is not None]
            least = min(r["lower"] for r in mine) if len(mine) == top else 1
            others = max([int(unseen[i]), *(r["others"] for r in found.get(i, []) if r["others"] is not None)])
            if others >= least and k + 1 < len(SHARES):
                open_.append(i)
                continue
            for r in mine:
                if r["upper"] > r["lower"]:
                    wanted.setdefault(r["key"], []).append(i)
                else:
                    exact.append((i, r["doc_id"], r["key"], r["lower"]))
        if wanted:
            exact += [(r["item"], r["doc_id"], r["key"], r["score"]) for r in completed(index, items, wanted).collect()]
        best: dict[int, list] = {}
        for i, doc_id, key, score in exact:
            best.setdefault(i, []).append((-score, doc_id is None, doc_id or 0, key, doc_id))
        for i, some in best.items():
            out += [(block[pending[i]][0], rank, x[4], -x[0]) for rank, x in enumerate(sorted(some), 1)]
        proved.append(items.n - len(open_))
        pending = [pending[i] for i in open_]
    return out, proved


def search(docs: DataFrame, items: DataFrame, *, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of each item's `top` documents with a score above 0.

    Documents are indexed for the terms that a block of items asks for, in tiers by impact. The items
    are evaluated on the first tier; one is proven if no document can reach its last place by the
    residual bounds of the terms that it wasn't met with, and its documents' scores are then completed.
    The others fall through to the next tier, the last of which has all postings. So results are exact
    at any depth, and what reaches the driver is one row a term and `top` rows an item of a block.

    A null text has no terms and isn't counted; null ids rank behind others of the same score, repeated
    rows are documents of their own; equal (id, text) items are one, and items that share an id only
    are ranked each for itself; an item without terms, or that no document has terms of, has no rows;
    empty tables give none. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    wanted, _ = stored(items.select(named(item_id).cast("long").alias("item_id"), text_of(item_text).alias("text")).distinct(), "tiered-items")
    blocks = -(-(wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES)
    parts = [spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")]
    for b in range(blocks):
        block = [(r["item_id"], r["text"]) for r in wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        rows, _ = _search_block(docs, block, top, id_col, text_col)
        parts.append(stored(spark.createDataFrame(rows, parts[0].schema), "tiered-found")[0])
    return reduce(DataFrame.union, parts)


def op12_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
with d as (select row_number() over () k, doc_id, {_TERMS.format("text")} terms from documents),
s as (select count(*) filter (len(terms) > 0) docs, sum(len(terms))::bigint length from d),
p as (select k, doc_id, n, term, count(*) tf from (select k, doc_id, len(terms) n, unnest(terms) term from d) group by all),
t as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint w from p, s group by term, docs),
q as (select item_id, term, count(*) c from (select item_id, unnest({_TERMS.format("text")}) term from benchmark) group by all),
r as (select item_id, k, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))))::bigint score
    from q join t using (term) join p using (term), s group by item_id, k, doc_id)
select item_id, rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id)::int rank from r where score > 0) where rank <= {TOP}
"""
