"""Substring dedup: fixed reference blocks, rolling probes, extension to maximal exact repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import discard, named, stored, table, text_of

#: Words of a repeat that counts, and of a reference block: any 35 words hold a whole block of 18.
LEAST = 35
BLOCK = (LEAST + 1) // 2
#: A block is indexed, and a window of its length probes, under the smallest hash of its runs of CORE words.
CORE = BLOCK // 2
#: Bytes of text that are hashed together; words longer than WORD_MOST are hashed one by one.
TOGETHER, WORD_MOST = 1 << 19, 4096

BYTE, WORD, WORD_2 = (np.uint64(m) for m in (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


CODES = mixed(np.arange(1, 257, dtype=np.uint64) * WORD)


def powers(multiplier: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number, from 0 on, and of its inverse; those of short texts are kept."""
    top = 1 << max(20, (n + 1).bit_length())
    if (found := _powers.get(multiplier)) is None or len(found[0]) < n:
        inverse = np.uint64(pow(int(multiplier), -1, 1 << 64))
        found = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(top - 1, x)])) for x in (multiplier, inverse))
        if top == 1 << 20:
            _powers[multiplier] = found
    return found


def sums_of(values: np.ndarray, multiplier: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of value times power of the multiplier, and the inverse powers that make runs comparable."""
    up, down = powers(multiplier, len(values) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])]), down


def windows(h: np.ndarray, size: int, multiplier: np.uint64 = WORD) -> np.ndarray:
    """Hash of every run of `size` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums, down = sums_of(h, multiplier)
    return mixed((sums[size:] - sums[:-size]) * down[:n])


def word_hashes(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie one after another in data, and the text of each; firsts: where each text begins."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    space = SPACE[data]
    begins, stops = ~space, ~space
    begins[1:] &= space[:-1]
    stops[:-1] &= space[1:]
    cut = firsts[(firsts > 0) & (firsts < len(data))]
    begins[cut] |= ~space[cut]
    stops[cut - 1] |= ~space[cut - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts > WORD_MOST)
    if len(long):
        import xxhash

        out[long] = [xxhash.xxh64_intdigest(data[a:b].tobytes()) for a, b in zip(starts[long], ends[long], strict=True)]
    lo = 0
    short = np.flatnonzero(ends - starts <= WORD_MOST) if len(long) else np.arange(len(starts))
    while lo < len(short):
        base = starts[short[lo]]
        hi = int(np.searchsorted(starts[short], base + TOGETHER, "right"))
        some = short[lo:hi]
        sums, down = sums_of(CODES[data[base : ends[some[-1]]]], BYTE)
        begin, end = starts[some] - base, ends[some] - base
        out[some] = mixed((sums[end] - sums[begin]) * down[begin])
        lo = hi
    return out, np.searchsorted(firsts, starts, "right") - 1


def parts_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about TOGETHER bytes of text: the slice, its words' hashes, and which of its rows has each word."""
    texts = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + TOGETHER, "right")) - 1)
        h, row = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo:hi] - offsets[lo])
        yield batch.slice(lo, hi - lo), h, row
        lo = hi


def sliding(values: np.ndarray, size: int, of) -> np.ndarray:
    """Smallest (np.minimum) or largest of every run of `size` values, in a number of passes that is its logarithm."""
    width, out = 1, values
    while width < size:
        step = min(width, size - width)
        out = of(out[:-step], out[step:]) if len(out) > step else out[:0]
        width += step
    return out


def anchors_of(h: np.ndarray, row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words at which a core starts that stands for a window of BLOCK words, the cores' hashes, and whether one of a reference block.

    row: of each word; first: the first word of each row, and the end. Every rolling window of BLOCK
    words within a text of LEAST words or more probes under the smallest of its cores' hashes; windows
    side by side mostly share theirs, so about one word in five is a row.
    """
    n, reach = len(h) - BLOCK + 1, BLOCK - CORE
    if len(h) < LEAST:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
    cores = windows(h, CORE)
    least = sliding(cores, reach + 1, np.minimum)
    whole = (row[:n] == row[BLOCK - 1 :]) & (np.diff(first) >= LEAST)[row[:n]]
    none = np.zeros(reach, np.uint64)
    most = sliding(np.concatenate([none, np.where(whole, least, 0), none]), reach + 1, np.maximum)  # of the windows that hold a core
    at = np.flatnonzero((cores == most) & (most > 0))
    behind = (at - first[row[at]]) % BLOCK
    start = np.minimum(at - behind, n - 1)
    return at, cores[at], (behind <= reach) & whole[start] & (least[start] == cores[at])


KEY = ["doc_id", "t1"]
#: Hits gathered by a task before it merges them; tables sent to all tasks hold this many numbers at most.
CHUNK, BROADCAST_NUMBERS = 1 << 18, 4_000_000


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows by id and hash of the text: rows that agree in both are interchangeable, and named once."""
    text = text_of(text_col)
    return df.select(named(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), text.alias("text"))


def _with(keyed: DataFrame, other: DataFrame, how: str, small: bool) -> DataFrame:
    """Rows of keyed with those of other that have their key; other is sent to all tasks where it is small."""
    other = other.withColumnsRenamed({"doc_id": "_d", "t1": "_1"})
    return keyed.join(F.broadcast(other) if small else other, (F.col("t1") == F.col("_1")) & F.col("doc_id").eqNullSafe(F.col("_d")), how).drop("_d", "_1")


class Merger:
    """Hits (hashes, places) of a chunk, merged where they meet.

    A hash that a chunk has twice is known to repeat: all its places come out as FOUND, and one row
    without a place announces it to the others (KNOWN). Other hits are PROBEs or of the INDEX. So,
    whatever a hash's share of the corpus, a chunk sends one row of it.
    """

    PROBE, KNOWN, FOUND, INDEX = 0, 1, 2, 3

    def __init__(self):
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, keys: pa.RecordBatch, row: np.ndarray, h: np.ndarray, h2: np.ndarray, at: np.ndarray, index: np.ndarray, known: np.ndarray) -> None:
        """Hits of rows of keys (doc_id, t1); known ones repeat whatever else is met."""
        if len(h):
            doc, t1 = keys.column(0), keys.column(1).to_numpy()
            self.parts.append((h, h2, at.astype(np.int32), doc.fill_null(0).to_numpy()[row], doc.is_valid().to_numpy(False)[row], t1[row], index, known))
            self.size += len(h)

    def take(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        h, h2, at, doc, has, t1, index, known = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order = np.lexsort((h2, h))
        new = np.ones(len(h), bool)
        new[1:] = np.diff(h[order]) != 0
        new[1:] |= np.diff(h2[order]) != 0
        run = np.cumsum(new) - 1
        twice = ((np.bincount(run) > 1) | (np.bincount(run, known[order]) > 0))[run]
        told = order[new & twice]  # one announcement for each
        keep = order[~known[order]]  # what is known of old needs no place
        kind = np.where(twice[~known[order]], self.FOUND, np.where(index[keep], self.INDEX, self.PROBE)).astype(np.int8)
        rows = np.concatenate([keep, told])
        kinds = np.concatenate([kind, np.full(len(told), self.KNOWN, np.int8)])
        yield pa.RecordBatch.from_arrays([pa.array(doc[rows], pa.int64(), mask=~has[rows]), pa.array(t1[rows]), pa.array(h[rows].view(np.int64)), pa.array(h2[rows]), pa.array(at[rows]), pa.array(kinds)], names=[*KEY, "h", "h2", "at", "kind"])


MERGED = "doc_id long, t1 long, h long, h2 int, at int, kind tinyint"


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, the places whose hash the index and another row have; a run that a batch cuts waits for the next."""
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        h, h2 = now["h"].to_numpy(), now["h2"].to_numpy()
        last = int(np.flatnonzero((h != h[-1]) | (h2 != h2[-1]))[-1]) + 1 if len(h) and ((h != h[-1]) | (h2 != h2[-1])).any() else 0
        rest = now.slice(last)
        if last:
            yield from _repeated(now.slice(0, last))
    if rest is not None and rest.num_rows:
        yield from _repeated(rest)


def _repeated(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    h, h2, kind = rows["h"].to_numpy(), rows["h2"].to_numpy(), rows["kind"].to_numpy()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
    run = np.cumsum(new) - 1
    twice = (np.bincount(run) > 1) & (np.bincount(run, kind == Merger.INDEX) > 0) | (np.bincount(run, kind == Merger.KNOWN) > 0)
    yield from rows.select([*KEY, "at"]).take(pa.array(np.flatnonzero(twice[run] & (kind != Merger.KNOWN)))).combine_chunks().to_batches()


def _places(merged: DataFrame) -> DataFrame:
    """Places whose hash occurs elsewhere: those found within a chunk, and those settled after one shuffle by hash."""
    asked = merged.where(F.col("kind") != Merger.FOUND).repartition("h").sortWithinPartitions("h", "h2").mapInArrow(_settled, "doc_id long, t1 long, at int")
    return merged.where(F.col("kind") == Merger.FOUND).select(*KEY, "at").union(asked)


def _ranges(places: DataFrame, before: int, after: int) -> tuple[DataFrame, bool]:
    """Per key the ranges, as [begin, end, ...], from `before` places ahead of a place to `after` behind it, merged; and whether they are small."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ats in batch.column(2):
                at = ats.values.to_numpy().astype(np.int64)  # sorted
                cut = np.flatnonzero(np.diff(at) > before + after)
                begin, end = np.concatenate([at[:1], at[cut + 1]]) - before, np.concatenate([at[cut], at[-1:]]) + after
                out.append(np.stack([np.maximum(begin, 0), end], 1).ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=[*KEY, "ranges"])

    # of one text at a time: no more places than it has words
    gathered = places.groupBy(*KEY).agg(F.sort_array(F.collect_set("at")).alias("ats"))
    out, _ = stored(gathered.mapInArrow(merge, "doc_id long, t1 long, ranges array<int>"), "ranges")
    numbers = out.agg(F.sum(F.size("ranges") + 4)).first()[0] or 0
    return out, numbers <= BROADCAST_NUMBERS


def inside(ranges: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in ranges [begin, end, ...], ends exclusive."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.minimum(ranges[0::2], n), 1)
    np.add.at(change, np.minimum(ranges[1::2], n), -1)
    return np.cumsum(change[:-1]) > 0


def repeats(keyed: DataFrame) -> tuple[DataFrame, bool, DataFrame, bool]:
    """Per key the ranges of words that repeated windows cover, and the texts that occur more than once; each with whether it is small.

    1. Copies: a text that occurs again is repeated as a whole. One of its rows stands for all, and its
       windows are known to repeat.
    2. Index: every text's non-overlapping reference blocks of BLOCK words, each under the smallest
       hash of its cores.
    3. Probes: all rolling windows of BLOCK words, each under the smallest hash of its cores. Index and
       probes meet in one shuffle by that hash; what the index and another place have is an anchor.
    4. Extension: windows around an anchor that occur twice, by 96-bit hashes; together they are the
       maximal exact repeats of LEAST words or more.

    A window that occurs at two places holds a whole reference block of either, and equal blocks have
    equal cores, so both are anchors and none is lost. Places are never paired: a passage that many
    texts share costs a row for each of its places, and each task sends one row of a hash that it has
    met twice. The plan is the same at every size: some 0.2 rows of 33 bytes a word before compression,
    no filter and nothing else that grows with the corpus in a task or on the driver.

    Words are not compared again: two windows count as equal if their 96-bit hashes over the words'
    64-bit hashes are. Of N extended windows, some pair of different ones is mistaken for equal with a
    probability of about N * N / 2 ** 97, that is 6e-6 for 10 ** 12 windows.
    """
    copies, _ = stored(keyed.groupBy("t1").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1").select("t1", "first"), "copies")
    few = copies.count() * 2 <= BROADCAST_NUMBERS
    rows = keyed.withColumn("again", F.lit(False))
    if few:  # where they are many, copies are met as any other repeats
        again = copies.select(F.col("t1").alias("_t"), "first")
        rows = keyed.join(F.broadcast(again), F.col("t1") == F.col("_t"), "left").where(F.col("_t").isNull() | F.col("doc_id").eqNullSafe(F.col("first"))).select(*KEY, "text", F.col("_t").isNotNull().alias("again"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger()
        for batch in batches:
            for part, h, row in parts_of(batch, 2):
                first = np.searchsorted(row, np.arange(part.num_rows + 1))
                at, core, block = anchors_of(h, row, first)
                merger.add(part, row[at], core, np.zeros(len(at), np.int32), at - first[row[at]], block, np.zeros(len(at), bool))
                if merger.size >= CHUNK:
                    yield from merger.take()
        yield from merger.take()

    # a copied text's places all count as anchors: it is probed, and extended, as one row
    probes, path = stored(rows.select(*KEY, "text").mapInArrow(probe, MERGED), "probes")
    anchors, small = _ranges(_places(probes), LEAST - CORE, 1)
    discard(keyed.sparkSession, path)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger()
        for batch in batches:
            for part, h, row in parts_of(batch, 2):
                first = np.searchsorted(row, np.arange(part.num_rows + 1))
                inside_one = np.zeros(len(h) + 1, np.int64)
                for i, ranges in enumerate(part.column(4)):
                    begin, end = (first[i] + np.minimum(ranges.values.to_numpy()[k::2], max(0, first[i + 1] - first[i] - LEAST + 1)) for k in (0, 1))
                    np.add.at(inside_one, begin, 1)
                    np.add.at(inside_one, end, -1)
                s = np.flatnonzero(np.cumsum(inside_one) > 0)
                if len(s):
                    h2 = windows(mixed(h ^ WORD_2), LEAST, WORD_2)[s]
                    again = part.column(3).to_numpy(False)
                    merger.add(part, row[s], windows(h, LEAST)[s], (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32), s - first[row[s]], np.ones(len(s), bool), again[row[s]])
                if merger.size >= CHUNK:
                    yield from merger.take()
        yield from merger.take()

    extended, path = stored(_with(rows, anchors, "inner", small).select(*KEY, "text", "again", "ranges").mapInArrow(extend, MERGED), "extended")
    found, found_small = _ranges(_places(extended), 0, LEAST)
    discard(keyed.sparkSession, path)
    return found, found_small, copies, few


OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


def removed(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's text without the words that a repeated window of 35 words covers: doc_id, n_words, n_removed, kept.

    Words are cut at ASCII white space and kept unchanged, joined by one space. Windows are judged on
    the input; every occurrence goes, the first included, also within one text. Null and empty texts,
    and texts under 35 words, lose nothing. A repeated row makes its windows occur elsewhere. Null ids
    are rows like any other; an empty table gives no rows; other columns are ignored.

    What is found is a few numbers per text: they are sent to all tasks while they are at most
    BROADCAST_NUMBERS, and joined by key beyond, so that texts are shuffled only where they must be.
    """
    keyed = _keyed(df, id_col, text_col)
    found, small, copies, few = repeats(keyed)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, gone, kept = [], [], []
                for t, again, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3), strict=True):
                    words = t.encode("utf-8", "surrogatepass").split()
                    n.append(len(words))
                    if again and len(words) >= LEAST:
                        gone.append(len(words))
                        words = []
                    elif ranges.is_valid:
                        out = inside(ranges.values.to_numpy(), len(words))
                        gone.append(int(out.sum()))
                        words = [words[i] for i in np.flatnonzero(~out)]
                    else:
                        gone.append(0)
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[f.name for f in OUT])

    rows = _with(keyed, found, "left", small)
    if few:
        again = copies.select(F.col("t1").alias("_t"))
        rows = rows.join(F.broadcast(again), F.col("t1") == F.col("_t"), "left").withColumn("again", F.col("_t").isNotNull())
    else:
        rows = rows.withColumn("again", F.lit(False))
    return rows.select("doc_id", "text", "again", "ranges").mapInArrow(cut, OUT)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), p AS (
  SELECT r, unnest(range(1, len(ws) - 33)) AS s FROM w WHERE len(ws) >= 35
), h AS (
  SELECT p.r, p.s, md5(array_to_string(list_slice(w.ws, p.s, p.s + 34), ' ')) AS g FROM p JOIN w USING (r)
), d AS (
  SELECT DISTINCT r, s FROM h WHERE g IN (SELECT g FROM h GROUP BY g HAVING count(*) > 1)
), c AS (
  SELECT DISTINCT r, s + k AS i FROM d, range(0, 35) t(k)
), k AS (
  SELECT r, list(i) AS gone FROM c GROUP BY r
), u AS (
  SELECT w.r, unnest(w.ws) AS x, unnest(range(1, len(w.ws) + 1)) AS i FROM w
), j AS (
  SELECT u.r, string_agg(u.x, ' ' ORDER BY u.i) AS kept FROM u LEFT JOIN c ON c.r = u.r AND c.i = u.i WHERE c.i IS NULL GROUP BY u.r
)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(len(k.gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(j.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.r = w.r LEFT JOIN j ON j.r = w.r
"""
