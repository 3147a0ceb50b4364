"""Quality classifier: an additive model with pairwise interactions, boosted as lookup tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import id_text_crc_mod, map_rows, named, table, text_of

#: Labelled rows that a fit takes at most: those with the smallest hash of their id.
MAX_LABELLED = 20_000
HELD_OUT_MOD = 5
THRESHOLD = 0.3

FEATURES = ("words_log", "word_len", "upper", "digit", "symbol", "bang", "pipe", "stop_end", "distinct", "top_word", "adjacent", "dup_lines", "line_words_log", "short_words", "space", "non_ascii")
COUNTED = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "symbol": "#*$%&<>@^~_=+{}[]\\", "bang": "!?", "pipe": "|", "stop_end": ".,;:"}
#: One row per counted class, one column per byte.
CLASSES = np.array([[chr(b) in chars for b in range(256)] for chars in COUNTED.values()], float)


def features(text: str) -> list[float]:
    """What the model sees of a text: FEATURES in order, all 0 for a text without words."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    histogram = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    inside = int(lengths.sum())
    return [
        np.log1p(n),
        inside / n,
        *(CLASSES @ histogram / chars),
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        int((lengths < 4).sum()) / n,
        1 - inside / chars,
        int(histogram[128:].sum()) / chars,
    ]


@dataclass
class Gam:
    """Edges of each feature's bins, a table per feature, and a table per chosen pair of features."""

    base: float = 0.0
    edges: list = field(default_factory=list)
    single: list = field(default_factory=list)
    pairs: list = field(default_factory=list)  # (feature, feature, 2-d table)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for j, t in enumerate(self.single):
            z += t[b[:, j]]
        for i, j, t in self.pairs:
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-z))


def _split(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, int]:
    """Best cut of a histogram of gradients: gain and number of bins left of it (0: none)."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    total = g.sum() ** 2 / (h.sum() + l2)
    gain = gl**2 / (hl + l2) + (g.sum() - gl) ** 2 / (h.sum() - hl + l2) - total
    k = int(np.argmax(gain))
    return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)


def tree(g: np.ndarray, h: np.ndarray, l2: float, depth: int = 2) -> np.ndarray:
    """Leaf values, bin by bin, of a shallow tree over one feature's histogram."""
    out = np.full(len(g), g.sum() / (h.sum() + l2))
    if depth:
        gain, k = _split(g, h, l2)
        if k:
            out[:k], out[k:] = tree(g[:k], h[:k], l2, depth - 1), tree(g[k:], h[k:], l2, depth - 1)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """A tree over two features: a first cut of either, then a cut of the other in each half.

    The first cut is the one whose halves, after their own cuts, gain most: where only the two
    together say anything, no first cut gains by itself.
    """
    best, out = -1.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        gl, hl = np.cumsum(gg, 0), np.cumsum(hh, 0)
        for k in range(1, len(gg) + (len(gg) == 1)):
            halves = [(gl[k - 1], hl[k - 1]), (gl[-1] - gl[k - 1], hl[-1] - hl[k - 1])]
            value = sum(_split(a, b, l2)[0] + a.sum() ** 2 / (b.sum() + l2) for a, b in halves)
            if value > best:
                top, bottom = (tree(a, b, l2, 1) for a, b in halves)
                grid = np.vstack([np.tile(top, (k, 1)), np.tile(bottom, (len(gg) - k, 1))])
                best, out = value, grid.T if flip else grid
    return out


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 32, rounds: int = 120, rate: float = 0.15, pairs: int = 6, l2: float = 5.0) -> Gam:
    """Cyclic boosting: each round passes over all features in turn, and later over the chosen pairs.

    Without rows, or with one class only, the model is a constant: the class share, smoothed.
    """
    prior = (y.sum() + 1) / (len(y) + 2)
    model = Gam(base=float(np.log(prior / (1 - prior))))
    if len(y) == 0 or y.min() == y.max():
        return model
    quantiles = np.linspace(0, 1, bins + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, j], quantiles)) for j in range(x.shape[1])]
    b, sizes = model.bins(x), [len(e) + 1 for e in model.edges]
    model.single = [np.zeros(s) for s in sizes]
    z = np.full(len(y), model.base)

    def gradient():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, s in enumerate(sizes):
            g, h = gradient()
            step = rate * tree(np.bincount(b[:, j], g, s), np.bincount(b[:, j], h, s), l2)
            model.single[j] += step
            z += step[b[:, j]]

    def grid(i, j, v):
        return np.bincount(b[:, i] * sizes[j] + b[:, j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    g, h = gradient()
    gains = []
    for i in range(len(sizes)):
        for j in range(i + 1, len(sizes)):
            gg, hh = grid(i, j, g), grid(i, j, h)
            gains.append((float((pair_tree(gg, hh, l2) * gg).sum()), i, j))
    chosen = [(i, j) for gain, i, j in sorted(gains, reverse=True)[:pairs] if gain > 0]
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for i, j in chosen]
    for _ in range(rounds // 2):
        for i, j, t in model.pairs:
            g, h = gradient()
            step = rate * pair_tree(grid(i, j, g), grid(i, j, h), l2)
            t += step
            z += step[b[:, i], b[:, j]]
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str, *, id_col: str, text_col: str, held_out_mod: int, max_rows: int) -> DataFrame:
    """Texts with their label, learning rows only, at most max_rows of them (smallest hash of the id).

    A document labelled twice counts once, with the larger label. The taken labels are max_rows at
    most, two integers each, and are therefore sent to every task.
    """
    taken = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_y").isNotNull() & (id_text_crc_mod("_id", held_out_mod) != 0))
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    rows = docs.select(named(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    return rows.join(F.broadcast(taken), "_id")


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", held_out_mod: int = HELD_OUT_MOD, max_rows: int = MAX_LABELLED) -> Gam:
    """Fits the model on at most max_rows labelled texts; only their features reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64())), batch.column(2)], names=["id", "x", "y"])

    rows = labelled(docs, labels, label, id_col=id_col, text_col=text_col, held_out_mod=held_out_mod, max_rows=max_rows)
    got = rows.select("_id", "_text", "_y").mapInArrow(run, "id long, x array<double>, y int").toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, got["id"].to_numpy()))  # the same order, whatever task came first
    return fit(x[order], got["y"].to_numpy().astype(float)[order])


SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def scored(docs: DataFrame, model: Gam, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row, in one pass without a shuffle; the model is a few kilobytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                x = np.array([features(t) for t in part.column(1).to_pylist()], float)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return docs.select(named(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, SCORES)


def accepted(docs: DataFrame, model: Gam, *, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold.

    Null and empty texts have the score of a text without words; repeated rows share their verdict;
    null ids are rows like any other; an empty table gives no rows; other columns are kept, whatever
    their names.
    """
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                x = np.array([features(t or "") for t in part.column(where).to_pylist()], float)
                yield part.filter(pa.array(model.score(x) >= threshold))

    return map_rows(docs, run)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, held_out_mod: int = HELD_OUT_MOD) -> DataFrame:
    """Quality of every whole text: doc_id, held_out, score, predicted.

    Null and empty texts have all features 0 and the score that the tables give for that. Repeated
    rows get equal scores; a null id is held out from nothing (held_out false); an empty table gives
    no rows; without usable labels every score is the smoothed class share. Other columns of either
    table are ignored, whatever their names.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, held_out_mod=held_out_mod)
    return scored(docs, model, id_col=id_col, text_col=text_col).select(
        "doc_id",
        F.coalesce(id_text_crc_mod("doc_id", held_out_mod) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
