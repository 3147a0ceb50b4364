"""Nearest neighbours: balanced posting lists with replicated boundary vectors, found through a graph of centroids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import named, stored, table

#: Vectors a list is meant to hold, and rows that each list's centroid is fitted on; numbers that a fit takes on the driver (32 MB as doubles).
LIST_SIZE, FIT_EACH, FIT_NUMBERS = 128, 64, 1 << 22
#: Vectors of a list, and queries of one, that meet in one task; more are dealt out in parts by a hash of the id.
PART_MOST, TURN_MOST = 1 << 16, 4096
#: A part of more lists' worth of vectors than this has lists of its own.
WHOLE = 8
#: Rows that a matrix product takes at once.
BLOCK = 4096
#: A vector is put into up to COPIES of its NEAR nearest lists, whose centroids are at most (1 + BOUNDARY) times as far as the nearest.
COPIES, BOUNDARY, NEAR = 4, 0.12, 16
#: A query probes all lists up to (1 + PRUNE) times as far as the nearest, and PROBES_LEAST at least.
PRUNE, PROBES_LEAST = 0.24, 8
#: Neighbours of a centroid in the graph; a walk keeps BEAM centroids in view at first and opens OPEN of them at a time.
DEGREE, BEAM, OPEN = 24, 48, 4


@dataclass
class Centroids:
    """Unit centroids and, for each, its nearest ones: the graph that searches walk."""

    vectors: np.ndarray
    near: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray) -> Centroids:
        k = len(vectors)
        degree = min(DEGREE, max(1, k - 1))
        near = np.zeros((k, degree), np.int64)
        for lo in range(0, k, 512):
            sims = vectors[lo : lo + 512] @ vectors.T
            sims[np.arange(len(sims)), np.arange(lo, lo + len(sims))] = -2
            near[lo : lo + 512] = np.argsort(-sims, axis=1, kind="stable")[:, :degree]
        # a ring over all centroids keeps the graph connected
        ring = np.stack([(np.arange(k) + 1) % k, (np.arange(k) - 1) % k], 1)
        return cls(vectors, np.concatenate([near, ring], 1).astype(np.int64))

    def walk(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the numbers of the `width` nearest centroids that a walk over the graph finds, nearest first, and their similarities.

        Each step opens a row's OPEN nearest centroids that aren't opened yet, looks at those of their
        neighbours that it hasn't seen, and keeps the best `width`. A row is done when all in its view
        are opened, so it looks at some width * DEGREE centroids, however many there are.
        """
        n, k = len(x), len(self.vectors)
        start = np.linspace(0, k - 1, min(width, k, 16)).astype(np.int64)
        view = np.zeros((n, width), np.int64)
        sims = np.full((n, width), -3.0, np.float32)
        opened = np.ones((n, width), bool)
        view[:, : len(start)], sims[:, : len(start)], opened[:, : len(start)] = start, x @ self.vectors[start].T, False
        seen = np.zeros((n, k), bool)
        seen[:, start] = True
        claim = np.zeros((n, k), np.int32)
        go, step = np.arange(n), max(OPEN, width // 16)
        while len(go):
            best = np.argsort(np.where(opened[go], -4.0, sims[go]), axis=1)[:, : -step - 1 : -1]
            fresh = ~np.take_along_axis(opened[go], best, 1)
            ring = np.where(fresh[:, :, None], self.near[np.take_along_axis(view[go], best, 1)], -1).reshape(len(go), -1)
            opened[go[:, None], best] = True
            order = np.broadcast_to(np.arange(ring.shape[1], dtype=np.int32), ring.shape)
            row = np.broadcast_to(go[:, None], ring.shape)
            new = (ring >= 0) & ~seen[row, ring]
            claim[row[new], ring[new]] = order[new]  # of a centroid that two opened ones lead to, one
            new &= claim[row, ring] == order
            seen[row[new], ring[new]] = True
            value = np.full(ring.shape, -3.0, np.float32)
            at = np.nonzero(new)
            value[at] = np.einsum("nd,nd->n", x[row[at]], self.vectors[ring[at]])
            every = np.concatenate([sims[go], value], 1)
            keep = np.argpartition(-every, width - 1, axis=1)[:, :width]
            sims[go] = np.take_along_axis(every, keep, 1)
            view[go] = np.take_along_axis(np.concatenate([view[go], ring], 1), keep, 1)
            opened[go] = np.take_along_axis(np.concatenate([opened[go], ~new], 1), keep, 1)
            go = go[~opened[go].all(1)]
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(view, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of centroids, nearest first, and their distances (inf: none): all that a walk finds within `ratio` times the nearest one's.

        The view is doubled for the rows whose farthest centroid in view is still within the ratio.
        """
        n, k = len(x), len(self.vectors)
        width = min(k, BEAM)
        order, distance = np.zeros((n, 0), np.int64), np.zeros((n, 0), np.float32)
        left = np.arange(n)
        while True:
            view, sims = self.walk(x[left], width)
            far = np.where(sims > -2, np.sqrt(np.maximum(2 - 2 * sims, 0)), np.inf)
            wider = width - order.shape[1]
            order = np.concatenate([order, np.zeros((n, wider), np.int64)], 1)
            distance = np.concatenate([distance, np.full((n, wider), np.inf, np.float32)], 1)
            order[left], distance[left] = view, far
            left = left[far[:, -1] <= far[:, 0] * ratio] if width < k else left[:0]
            if not len(left):
                return order, distance
            width = min(k, 2 * width)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means whose assignment is charged for a list's excess over the mean size; no more than BLOCK rows meet all centroids at once."""
    rng = np.random.default_rng(7)
    c = x[rng.permutation(len(x))[:k]].copy()
    charge = np.zeros(k)
    mean = len(x) / k
    for _ in range(rounds):
        own = np.concatenate([(x[lo : lo + BLOCK] @ c.T - charge.astype(np.float32)).argmax(1) for lo in range(0, len(x), BLOCK)])
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = counts == 0
        sums[empty] = x[rng.integers(0, len(x), int(empty.sum()))]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        charge = 0.5 * charge + 0.02 * np.clip(counts / mean - 1, -1, 3)
    return c.astype(np.float32)


def lists_of(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Row and list pairs: the nearest list of each vector and, near a boundary, more of the NEAR nearest that lie in other directions.

    Lists are filled by a product with all centroids: for a block of vectors, and some thousands of
    centroids, that takes a small part of the time of walks, which queries take.
    """
    sims = x @ centroids.vectors.T
    near = min(NEAR, sims.shape[1])
    order = np.argpartition(-sims, near - 1, axis=1)[:, :near]
    order = np.take_along_axis(order, np.argsort(-np.take_along_axis(sims, order, 1), axis=1, kind="stable"), 1)
    distance = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(sims, order, 1), 0))
    own = centroids.vectors[order]
    gaps = np.sqrt(np.maximum(2 - 2 * own @ own.transpose(0, 2, 1), 0))
    # a centroid nearer to one already taken than to the vector adds little
    beside = gaps <= distance[:, :, None] * 0.8
    taken = np.zeros(order.shape, bool)
    taken[:, 0] = True
    for m in range(1, near):
        apart = ~(beside[:, m, :m] & taken[:, :m]).any(1) & (taken[:, :m].sum(1) < COPIES)
        taken[:, m] = apart & (distance[:, m] <= distance[:, 0] * (1 + BOUNDARY))
    row, m = np.nonzero(taken)
    return row, order[row, m]


def probes_of(x: np.ndarray, centroids: Centroids, ratio: float = 1 + PRUNE) -> tuple[np.ndarray, np.ndarray]:
    """Row and list pairs that each query reads: all within the distance ratio, and the PROBES_LEAST nearest."""
    order, distance = centroids.search(x, ratio)
    keep = distance <= distance[:, :1] * ratio
    keep[:, :PROBES_LEAST] = True
    row, m = np.nonzero(keep & np.isfinite(distance))
    return row, order[row, m]


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors, each times the power of two that brings its largest number below 1: cosines stay the same, and squares don't overflow."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def nearest(ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k best candidates of each query in one part, by cosine and then by id.

    A matrix product finds what may be among them; those are scored again one by one, in an order of
    additions that depends on the two vectors alone, so equal vectors have equal scores.
    """
    nv, nq = np.sqrt((v * v).sum(1)), np.sqrt((q * q).sum(1))
    rough = (q / nq[:, None]) @ (v / nv[:, None]).T
    rough[query_ids[:, None] == ids[None, :]] = -9
    out = ([], [], [])
    for i in range(len(q)):
        row = rough[i]
        least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -8
        at = np.flatnonzero((row >= least - 1e-9) & (row > -8))
        score = (v[at] * q[i]).sum(1) / (nv[at] * nq[i])
        best = np.lexsort((ids[at], -score))[:k]
        out[0].extend([int(query_ids[i])] * len(best))
        out[1].extend(ids[at][best].tolist())
        out[2].extend(score[best].tolist())
    return out


def within(ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, ratio: float, list_size: int) -> tuple[list, list, list]:
    """The k best candidates of each query in one part; a part of many lists' worth of vectors gets lists of its own.

    These are fitted on FIT_EACH of the part's vectors each, filled and found like those of the first level, so that
    the rows that a query is compared with don't grow with a list of the first level. An infinite ratio
    compares all, block by block.
    """
    lists = len(ids) // list_size if ratio < float("inf") and len(ids) > WHOLE * list_size else 0
    if lists:
        some = np.random.default_rng(7).permutation(len(ids))[: FIT_EACH * lists]
        centroids = Centroids.of(balanced_centroids(unit(v[some]), lists))
        rows = _by_blocks(lambda x: lists_of(x, centroids), v, 512)
        asks = _by_blocks(lambda x: probes_of(x, centroids, ratio), q, 64)
        by_rows, by_asks = np.argsort(rows[1], kind="stable"), np.argsort(asks[1], kind="stable")
        row_ends, ask_ends = np.searchsorted(rows[1][by_rows], np.arange(lists + 1)), np.searchsorted(asks[1][by_asks], np.arange(lists + 1))
        meetings = [(rows[0][by_rows[row_ends[i] : row_ends[i + 1]]], asks[0][by_asks[ask_ends[i] : ask_ends[i + 1]]]) for i in range(lists)]
    else:
        meetings = [(np.arange(len(ids)), np.arange(len(query_ids)))]
    best = ([], [], [])
    for mine, asking in meetings:
        for lo in range(0, len(mine), BLOCK):
            for at in range(0, len(asking), 512):
                m, a = mine[lo : lo + BLOCK], asking[at : at + 512]
                for into, new in zip(best, nearest(ids[m], v[m], query_ids[a], q[a], k), strict=True):
                    into.extend(new)
    if len(meetings) == 1 and len(ids) <= BLOCK:
        return best
    query, vec, score = np.array(best[0], np.int64), np.array(best[1], np.int64), np.array(best[2], np.float64)
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    if len(query):  # a vector of several lists has one score
        new = np.append(True, (query[1:] != query[:-1]) | (vec[1:] != vec[:-1]))
        query, vec, score = query[new], vec[new], score[new]
        starts = np.append(True, query[1:] != query[:-1])
        first = np.arange(len(query)) - np.maximum.accumulate(np.where(starts, np.arange(len(query)), 0)) < k
        query, vec, score = query[first], vec[first], score[first]
    return query.tolist(), vec.tolist(), score.tolist()


def _by_blocks(of, x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    found = [(row + lo, which) for lo in range(0, len(x), size) for row, which in [of(unit(x[lo : lo + size]))]]
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (doubles) of the rows that take part."""
    rows = df.select(named(id_col).cast("long").alias("id"), named(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", list_size: int = LIST_SIZE, fit_numbers: int = FIT_NUMBERS, ratio: float = 1 + PRUNE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of each row of queries, never itself.

    Fit: a list for each list_size vectors, its centroid fitted on FIT_EACH vectors or more of a sample
    (smallest hashes of ids) of at most fit_numbers numbers; so many that a vector of the sample isn't
    much nearer to its centroid than others are. Where fit_numbers is too small for that, lists are
    fewer and longer, and those longer than WHOLE lists are cut into lists of list_size once more, by the
    tasks that hold them: so lists in all grow with the rows, while the driver holds the first level
    only. Index: every vector, in one list or more of either level. Search: all lists within the
    distance ratio of the nearest, found by a walk over the centroids' graph, at both levels; a query
    that these give fewer than k others reads every list, and an infinite ratio makes all do so, which is
    exact. PART_MOST vectors and TURN_MOST queries of a list meet in one task, however many are alike;
    each part gives its k best for a query, and these are merged. Scores are cosines of the original
    vectors in double precision.

    Vectors that are null, empty, zero or hold null or non-finite numbers take no part, nor do null
    ids or vectors of another length than most. A repeated id counts once, with its best score. Ties
    go to the smaller id; with fewer than k candidates all are given; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], empty)
    dim, total = sizes[0]["d"], sizes[0]["count"]
    rows = rows.where(F.size("v") == dim)
    asked = valid(queries, id_col, vector_col).where(F.size("v") == dim)
    fitted = max(FIT_EACH, fit_numbers // dim)
    lists = int(max(1, min(total // list_size, fitted // FIT_EACH)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(min(fitted, max(20_000, FIT_EACH * lists))).toArrow()
    centroids = Centroids.of(balanced_centroids(unit(matrix(sample["v"].combine_chunks(), dim)), lists))

    def listed(of, rows_together: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, rows_together):
                    part = batch.slice(lo, rows_together)
                    row, which = of(unit(matrix(part.column(1), dim)))
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), part.column(0).take(at), part.column(1).take(at)], names=["list", "id", "v"])

        return run

    schema = "list int, id long, v array<double>"
    postings, _ = stored(rows.mapInArrow(listed(lambda x: lists_of(x, centroids), 512), schema), "postings")
    held = postings.groupBy("list").agg(F.count("*").alias("n"))

    def compare(near: float):
        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            out = ([], [], [])
            if a.num_rows and b.num_rows:
                out = within(a["id"].to_numpy(), matrix(a["v"].combine_chunks(), dim), b["id"].to_numpy(), matrix(b["v"].combine_chunks(), dim), k, near, list_size)
            return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

        return run

    def best(of: DataFrame, probing, near: float) -> DataFrame:
        """Up to k ranked rows for each of the queries, from the lists that probing says, within which lists of lists are read up to the ratio `near`."""
        probes, _ = stored(of.mapInArrow(listed(probing, 64), schema), "probes")
        asking = probes.groupBy("list").agg(F.count("*").alias("m"))
        # a row for each list, of which the fit bounds the number
        split = held.join(asking, "list").select("list", F.ceil(F.col("n") / PART_MOST).cast("int").alias("parts"), F.ceil(F.col("m") / TURN_MOST).cast("int").alias("turns")).collect()
        split = F.broadcast(spark.createDataFrame([tuple(r) for r in split], "list int, parts int, turns int"))

        def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
            """Each row in one part of its own kind, and before all parts of the other."""
            mine, theirs = F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
            return df.join(split, "list").select("list", "id", "v", mine, theirs)

        keys = ["list", "parts", "turns"]
        found = dealt(postings, "parts", "turns").groupBy(*keys).cogroup(dealt(probes, "turns", "parts").groupBy(*keys)).applyInArrow(compare(near), "query_id long, vec_id long, score double")
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return once.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def everything(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(x)), lists), np.tile(np.arange(lists), len(x))

    exact = float("inf")
    if ratio == exact or total <= WHOLE * list_size:
        return best(asked, everything, exact)
    found, _ = stored(best(asked, everything if lists <= PROBES_LEAST else lambda x: probes_of(x, centroids, ratio), ratio), "found")
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("full"))
    short = asked.join(full, F.col("id") == F.col("full"), "left_anti")
    if short.isEmpty():
        return found
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(best(short, everything, exact))


def op6_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 50 = 0"))
