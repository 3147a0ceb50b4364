"""Intervals, tests and agreement measures, as column expressions or grouped frames."""

from __future__ import annotations

from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .geometry import num


def _wilson(k: Column, n: Column, z: float) -> tuple[Column, Column]:
    p, d = k / n, 1 + num(z * z) / n
    centre = (p + num(z * z) / (2 * n)) / d
    half = num(z) * F.sqrt(p * (1 - p) / n + num(z * z) / (4 * n * n)) / d
    return centre - half, centre + half


def wilson_open(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a share; without cases (0, 1), and not clamped."""
    lo, hi = _wilson(k, n, z)
    return F.when(n == 0, num(0)).otherwise(lo), F.when(n == 0, num(1)).otherwise(hi)


def wilson_clamped(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a share; without cases (0, 0), and within 0 and 1."""
    lo, hi = _wilson(k, n, z)
    return F.when(n == 0, num(0)).otherwise(F.greatest(num(0), lo)), F.when(n == 0, num(0)).otherwise(F.least(num(1), hi))


def kappa(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Agreement and Cohen's kappa of two judges with two verdicts (0, 1): kappa 1 where chance agrees always, 0 without rows."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    n, aa, bb, same = F.count("*"), F.count_if(F.col(a) == 1), F.count_if(F.col(b) == 1), F.count_if(F.col(a) == F.col(b))
    s = both.groupBy(*(by or [])).agg(n.alias("n"), aa.alias("_a"), bb.alias("_b"), same.alias("_s"))
    p, q, po = F.col("_a") / F.col("n"), F.col("_b") / F.col("n"), F.col("_s") / F.col("n")
    pe = p * q + (1 - p) * (1 - q)
    k = F.when(F.col("n") == 0, num(0)).when(pe >= 1, num(1)).otherwise((po - pe) / (1 - pe))
    return s.select(*(by or []), "n", F.round(F.when(F.col("n") == 0, num(0)).otherwise(po), 6).alias("agreement"), (F.round(k, 6) + num(0)).alias("kappa"))


def mcnemar(x: Column, y: Column) -> Column:
    """Exact two-sided sign test over discordant cases; 1 without any.

    Each binomial term follows from the one before it. Up to 1000 cases terms are numbers, exact for
    few; beyond, where these would overflow, they are logarithms less n log 2.
    """
    n, one = (x + y).cast("long"), F.lit(1).cast("long")
    steps = F.when(F.least(x, y) > 0, F.sequence(one, F.least(x, y).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def tail(first: Column, following, value) -> Column:
        start = F.struct(first.alias("t"), value(first).alias("s"))

        def step(acc: Column, i: Column) -> Column:
            t = following(acc["t"], n - i + 1, i)
            return F.struct(t.alias("t"), (acc["s"] + value(t)).alias("s"))

        return F.aggregate(steps, start, step, lambda acc: acc["s"])

    few = tail(num(1), lambda t, a, b: t * a / b, lambda t: t) / F.pow(num(2), n)
    many = tail(-n * F.ln(num(2)), lambda t, a, b: t + F.ln(a / b), F.exp)
    return F.when(n == 0, num(1)).otherwise(F.least(num(1), 2 * F.when(n <= 1000, few).otherwise(many)))


INTERVAL = T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])


def _beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function: of a + b - 1 draws with chance x, at least a succeed. By Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    value, m = d, 0
    while True:
        m += 1
        for u in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + u * d or tiny), 1 + u / c or tiny
            value *= d * c
        if abs(d * c - 1) < 1e-15 or m > 1_000_000:
            return exp(lgamma(a + b) - lgamma(a + 1) - lgamma(b) + a * log(x) + b * log1p(-x)) * value


@F.pandas_udf(INTERVAL)
def clopper_pearson(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Exact binomial interval at 95 %, by bisection on the tails; a tail of n draws takes some root of n steps."""

    def root(share, a, b):
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if _beta(mid, a, b) < share else (lo, mid)
        return (lo + hi) / 2

    out = []
    for a, m in zip(k.astype(int), n.astype(int), strict=True):
        out.append((root(0.025, a, m - a + 1) if a > 0 else 0.0, root(0.975, a + 1, m - a) if a < m else 1.0))
    return pd.DataFrame(out, columns=["lo", "hi"])


def frechet(p: Column, q: Column) -> tuple[Column, Column]:
    """Bounds of the agreement of two judges who each agree with a third in shares p and q."""
    return F.greatest(num(0), p + q - 1), 1 - F.abs(p - q)


def total_variation(df: DataFrame, key: str, p: str, q: str) -> DataFrame:
    return df.agg(F.round(F.sum(F.abs(F.col(p) - F.col(q))) / 2, 6).alias("tv"))


def average_precision(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Sum of recall steps times precision, over distinct scores from high to low.

    Rows are counted per score first; running sums then go over distinct scores, not rows.
    """
    per = df.groupBy(*by, score).agg(F.sum(label).alias("_t"), F.count("*").alias("_n"))
    run = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumns({"_tp": F.sum("_t").over(run), "_all": F.sum("_n").over(run), "_pos": F.sum("_t").over(Window.partitionBy(*by))})
    return per.groupBy(*by).agg(F.round(F.sum(F.when(F.col("_pos") > 0, F.col("_t") / F.col("_pos") * F.col("_tp") / F.col("_all")).otherwise(num(0))), 6).alias("ap"))


def standardised(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Columns less their training mean over their training population deviation (1 where that is 0); one pass for all statistics."""
    stats = df.where(train).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = df.join(F.broadcast(stats), F.lit(True))
    return joined.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, num(1)).otherwise(F.col(f"_s_{c}")) for c in columns}).drop(*stats.columns)


def oversampled(df: DataFrame, label: str, share: float = 0.1) -> DataFrame:
    """Positives repeated until they are `share` of the negatives; no change if they are already, or if there are none.

    Repetition follows each positive's place in an order by hash, so that it is the same every time.
    """
    n = df.agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    want = F.greatest(F.col("_pos"), F.ceil(F.col("_neg") * num(share)))
    times = F.when((F.col(label) == 1) & (F.col("_pos") > 0), F.ceil(want / F.col("_pos"))).otherwise(1).cast("int")
    return df.join(F.broadcast(n), F.lit(True)).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("_pos", "_neg")


def oversampled_rows(x: np.ndarray, y: np.ndarray, share: float = 0.1, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Drawn positives are added until they are `share` of the negatives; for training in workers."""
    rng = np.random.default_rng(seed)
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(pos) or len(pos) >= share * len(neg):
        return x, y
    at = np.concatenate([np.arange(len(y)), rng.choice(pos, int(np.ceil(share * len(neg))) - len(pos))])
    rng.shuffle(at)
    return x[at], y[at]


class Mlp:
    """Two hidden layers (64, 32) of rectified units, logistic output, Adam; for grouped training in workers."""

    def __init__(self, seed: int = 0, hidden=(64, 32), epochs: int = 60, rate: float = 1e-3, batch: int = 200):
        self.seed, self.hidden, self.epochs, self.rate, self.batch = seed, hidden, epochs, rate, batch

    def fit(self, x: np.ndarray, y: np.ndarray, after=None) -> Mlp:
        """Trains on all epochs; `after` is called with the network after each."""
        rng = np.random.default_rng(self.seed)
        sizes = [x.shape[1], *self.hidden, 1]
        self.w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [np.zeros(b) for b in sizes[1:]]
        m = [np.zeros_like(p) for p in (*self.w, *self.b)]
        v, t = [np.zeros_like(p) for p in (*self.w, *self.b)], 0
        for _ in range(self.epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // self.batch)):
                grads, t = self._gradient(x[rows], y[rows]), t + 1
                for i, (p, g) in enumerate(zip((*self.w, *self.b), grads, strict=True)):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p -= self.rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
            if after:
                after(self)
        return self

    def _forward(self, x):
        layers = [x]
        for w, b in zip(self.w[:-1], self.b[:-1], strict=True):
            layers.append(np.maximum(layers[-1] @ w + b, 0))
        return layers, 1 / (1 + np.exp(-np.clip(layers[-1] @ self.w[-1] + self.b[-1], -30, 30)))

    def _gradient(self, x, y):
        layers, p = self._forward(x)
        d = (p - y[:, None]) / len(x)
        gw, gb = [], []
        for i in range(len(self.w) - 1, -1, -1):
            gw.insert(0, layers[i].T @ d + 1e-4 * self.w[i] / len(x))
            gb.insert(0, d.sum(0))
            d = (d @ self.w[i].T) * (layers[i] > 0)
        return [*gw, *gb]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[1][:, 0]

    def says(self, x: np.ndarray, margin: float = 1e-2) -> np.ndarray:
        """predict(x) > 0.5, worked out in single precision; rows whose sum is near 0, or can't be trusted, are worked out again in double."""
        z, loss = self._roughly(x)
        said, doubt = z > 0, ~(np.abs(z) > margin + loss)
        if doubt.any():
            said[doubt] = self.predict(x[doubt]) > 0.5
        return said

    def sure(self, x: np.ndarray, level: float, margin: float = 1e-2) -> tuple[np.ndarray, np.ndarray]:
        """predict(x) >= level and predict(x) <= 1 - level (level above 0.5), as says() works them out."""
        z, loss = self._roughly(x)
        at = np.float32(np.log(level / (1 - level)))
        yes, no, doubt = z > at, z < -at, ~(np.abs(np.abs(z) - at) > margin + loss)
        if doubt.any():
            p = self.predict(x[doubt])
            yes[doubt], no[doubt] = p >= level, p <= 1 - level
        return yes, no

    def _roughly(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last layer's sum in single precision, and a bound on what that loses."""
        h = x.astype(np.float32)
        for w, b in zip(self.w[:-1], self.b[:-1], strict=True):
            h = h @ w.astype(np.float32)
            h += b.astype(np.float32)
            np.maximum(h, 0, out=h)
        last = self.w[-1].astype(np.float32)
        z = (h @ last)[:, 0] + np.float32(self.b[-1][0])
        return z, 1e-3 * (h @ np.abs(last))[:, 0]  # what is added up bounds what single precision loses
