"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACE_CLASS, id_text_crc_mod, named, table, text_of
from .quality_gam import SCORES, labelled

#: Labelled rows that a fit takes at most, landmark words, and where a score counts as toxic.
MAX_LABELLED = 20_000
LANDMARKS = 96
HELD_OUT_MOD = 5
THRESHOLD = 0.5
#: Subsequences of three characters that span SPAN characters at most; a character of span costs DECAY.
SPAN, DECAY = 5, 0.6
#: The kernel is this power of the subsequence kernel (products of kernels are kernels); where that is below LEAST, it counts as 0.
LEAST, POWER = 0.4, 2
#: A text's mean word is taken so many times: one insult in so many words weighs as much as the largest value.
MEAN_WEIGHT = 50.0
#: Longer words are scored by windows, MARGIN characters longer than a landmark and MARGIN apart; landmarks are no longer.
WORD_MOST, MARGIN = 40, 2
#: Words and windows that a worker looks at together.
TOGETHER = 1 << 16
#: Words are first screened together, up to this length; longer ones go to the kernel at once.
SCREEN_MOST = 24
#: Words known not to resemble a landmark, kept by a worker at most.
SEEN_MOST = 300_000
#: Two landmarks are less alike than this; the log-likelihood ratio that a landmark needs.
ALIKE, EVIDENCE = 0.85, 24.0
#: Characters written for letters.
LEET = str.maketrans("013457@$", "oieastas")

EDGES = "\"'`.,;:!?()[]{}<>|#*$%&_-~…«»“”„¿¡"
SPELLED = re.compile(r"(?<!\S)\S(?:[ \t]\S){3,}(?!\S)")


def subsequences(word: str) -> dict[str, float]:
    """Weights, with Euclidean norm 1, of a word's subsequences; ^ and $ stand for its ends."""
    s, out = f"^{word}$", {}
    n = len(s)
    for i in range(n - 2):
        for k in range(i + 2, min(i + SPAN, n)):
            weight = DECAY ** (k - i)
            for j in range(i + 1, k):
                u = s[i] + s[j] + s[k]
                out[u] = out.get(u, 0.0) + weight
    norm = sum(v * v for v in out.values()) ** 0.5
    return {u: v / norm for u, v in out.items()} if norm else out


def forms(word: str) -> list[str]:
    """The word without its edges, and, if it isn't all letters, also its letters with digits read as letters."""
    plain = word.lower().strip(EDGES)
    if plain.isalpha():
        return [plain]
    bare = "".join(filter(str.isalpha, plain.translate(LEET)))
    return [plain, bare] if bare else [plain] if plain else []


class Kernel:
    """Kernel values of words with the landmarks; remembers what it has met, up to SEEN_MOST words.

    A word is first screened by a bound: the sum of its subsequence weights times the largest weight
    that any landmark gives that subsequence, over the least norm that a word of that length has.
    Words below LEAST by this bound are below it for every landmark, so the screen loses nothing.
    """

    def __init__(self, landmarks: list[str]):
        self.size, self.index = len(landmarks), {}
        self.lengths = sorted({len(w) for w in landmarks})
        self.known: dict[str, tuple] = {}
        self.seen: set[str] = set()
        for j, word in enumerate(landmarks):
            for u, v in subsequences(word).items():
                self.index.setdefault(u, []).append((j, v))
        self.letters = {c for u in self.index for c in u}
        letters = sorted(self.letters)[:63]
        self.code = np.zeros(0x110000, np.uint8)
        for i, c in enumerate(letters):
            self.code[ord(c)] = i + 1
        self.most = np.zeros(64**3, np.float32)
        for u, found in self.index.items():
            a, b, c = (int(self.code[ord(x)]) for x in u)
            if a and b and c:
                self.most[a * 4096 + b * 64 + c] = max(v for _, v in found)
        codes = sorted(self.index)
        self.row = np.zeros(64**3, np.int16)
        self.weights = np.zeros((len(codes) + 1, max(1, self.size)), np.float32)
        for r, u in enumerate(codes[:32_000], 1):
            a, b, c = (int(self.code[ord(x)]) for x in u)
            self.row[a * 4096 + b * 64 + c] = r
            for j, v in self.index[u]:
                self.weights[r, j] = v
        self.complete = len(codes) <= 32_000 and len(self.letters) <= 63
        spans = [(j, k) for k in range(2, SPAN) for j in range(1, k)]
        self.spans = spans
        self.norm = np.array([max(1e-9, sum(max(0, n - k) * DECAY ** (2 * k) for _, k in spans)) ** 0.5 for n in range(SCREEN_MOST + 3)])

    def passing(self, words: list[str]) -> np.ndarray:
        """Which words the bounds can't exclude: first over all landmarks at once, then for each."""
        out = np.ones(len(words), bool)
        if not self.complete:
            return out
        short = np.array([i for i, w in enumerate(words) if len(w) <= SCREEN_MOST], np.int64)
        width = SCREEN_MOST + 2
        for lo in range(0, len(short), 4096):
            at = short[lo : lo + 4096]
            raw = np.array([f"^{words[i]}$" for i in at], f"<U{width}")
            c = self.code[raw.view(np.uint32).reshape(len(at), width)].astype(np.int32)
            c[c == 0] = 1 << 20  # of no landmark: beyond the tables
            least = LEAST * self.norm[[len(words[i]) + 2 for i in at]] * 0.9999
            codes, bound = {}, np.zeros(len(at), np.float32)
            for j, k in self.spans:
                u = c[:, : width - k] * 64 + c[:, j : width - k + j]
                u = np.minimum(u, 1 << 20) * 64 + c[:, k:]
                u[u >= 64**3] = 0
                codes[j, k] = u
                bound += DECAY**k * self.most[u].sum(1)
            left = np.flatnonzero(bound >= least)
            value = np.zeros((len(left), self.weights.shape[1]), np.float32)
            for (_, k), u in codes.items():
                rows = self.row[u[left]]
                own = np.zeros_like(value)
                for p in np.flatnonzero(rows.any(0)):
                    own += self.weights[rows[:, p]]
                value += DECAY**k * own
            out[at] = False
            out[at[left[value.max(1) >= least[left]]]] = True
        return out

    def of(self, word: str) -> dict[int, float]:
        values: dict[int, float] = {}
        for u, v in subsequences(word).items():
            for j, w in self.index.get(u, ()):
                values[j] = values.get(j, 0.0) + v * w
        return {j: v**POWER for j, v in values.items() if v >= LEAST}

    def windows(self, form: str) -> Iterator[str]:
        """Windows of which one holds any landmark that the form has, without those that have next to no letter of one."""
        known = np.cumsum([0, *(c in self.letters for c in form)])
        for n in self.lengths:
            starts = np.arange(0, max(1, len(form) - n), MARGIN)
            ends = np.minimum(starts + n + MARGIN, len(form))
            for i in np.flatnonzero(known[ends] - known[starts] >= 2):
                yield form[starts[i] : ends[i]]

    def pieces(self, words: set[str]) -> Iterator[tuple[str, str]]:
        """Each word with what is scored of it: its forms, and windows of long forms and of spelled-out runs (which start with a space)."""
        for w in words:
            for f in forms(w.lstrip(" ")):
                if len(f) <= WORD_MOST:
                    yield w, f
                if len(f) > WORD_MOST or w[0] == " ":
                    for x in self.windows(f):
                        yield w, x

    def learn(self, words: set[str]) -> dict[str, tuple]:
        """Numbers and kernel values of those of the words that resemble a landmark."""
        left = self.pieces(words)
        out: dict[str, dict] = {}
        while pairs := [*islice(left, TOGETHER)]:
            for keep, (w, f) in zip(self.passing([f for _, f in pairs]).tolist(), pairs, strict=True):
                if keep:
                    for j, v in self.of(f).items():
                        mine = out.setdefault(w, {})
                        mine[j] = max(v, mine.get(j, 0.0))
        return {w: (np.array(list(m), np.int64), np.array(list(m.values()))) for w, m in out.items()}

    def pooled(self, texts: list[str]) -> np.ndarray:
        """For each text and landmark the largest value over its words, the second largest, and their mean."""
        each = [t.split() for t in texts]
        for words, t in zip(each, texts, strict=True):
            if SPELLED.search(t):
                words += [" " + m[0].replace(" ", "").replace("\t", "") for m in SPELLED.finditer(t)]
        if len(self.known) > SEEN_MOST:
            self.known.clear()
        new = set().union(*each) - self.seen - self.known.keys()
        found = self.learn(new)
        self.known.update(found)
        if len(self.seen) < SEEN_MOST:
            self.seen |= {w for w in new - found.keys() if len(w) <= WORD_MOST}
        top, second, mean = np.zeros((3, len(texts), self.size))
        for i, words in enumerate(each):
            if hits := [x for x in map(self.known.get, words) if x is not None]:
                at, values = np.concatenate([x[0] for x in hits]), np.concatenate([x[1] for x in hits])
                mean[i] = np.bincount(at, values, self.size) / len(words)
                order = np.lexsort((values, at))
                at, values = at[order], values[order]
                last = np.flatnonzero(np.append(at[1:] != at[:-1], True))
                top[i, at[last]] = values[last]
                last = last[1:] if last[0] == 0 else last
                last = last[at[last - 1] == at[last]]
                second[i, at[last]] = values[last - 1]
        for w in found:
            if len(w) > WORD_MOST:
                del self.known[w]
        return np.hstack([top, second, mean])


@dataclass
class Svm:
    """Landmark words, the Nyström map, weights and the line that turns margins into scores."""

    landmarks: list = field(default_factory=list)
    mapping: np.ndarray | None = None
    weights: np.ndarray | None = None
    slope: float = 0.0
    shift: float = -2.0

    def margins(self, pooled: np.ndarray) -> np.ndarray:
        if self.mapping is None:
            return np.zeros(len(pooled))
        return design(pooled, self.mapping) @ self.weights

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margins(pooled) + self.shift)))


def design(pooled: np.ndarray, mapping: np.ndarray) -> np.ndarray:
    """What the machine weighs: the two largest kernel values by landmark, the Nyström features of the mean word, and 1.

    The map is linear, so the features of a mean of kernel rows are the mean of the words' features.
    """
    m = len(mapping)
    return np.hstack([pooled[:, : 2 * m], MEAN_WEIGHT * (pooled[:, 2 * m :] @ mapping), np.ones((len(pooled), 1))])


def nystrom(landmarks: list[str]) -> np.ndarray:
    """The inverse square root of the landmarks' kernel matrix, of the kernel that words are valued by."""
    maps = [subsequences(w) for w in landmarks]
    k = np.array([[sum(v * b.get(u, 0.0) for u, v in a.items()) for b in maps] for a in maps])
    k = np.where(k >= LEAST, k**POWER, 0)
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    return vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T


def hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, rounds: int = 40) -> np.ndarray:
    """Linear SVM with squared hinge loss, by Newton steps over the rows inside the margin."""
    w, d = np.zeros(x.shape[1]), x.shape[1]
    ridge = np.eye(d)
    ridge[-1, -1] = 1e-4
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        a = x[inside] * (c * weight[inside])[:, None]
        new = np.linalg.solve(ridge + a.T @ x[inside], a.T @ y[inside])
        if np.abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


def logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the scores over margins, by Newton's method with a little shrinkage."""
    x, w = np.stack([m, np.ones_like(m)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + 1e-3 * np.eye(2), x.T @ (y - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(pooled: np.ndarray, toxic: np.ndarray, landmarks: list[str], *, c: float = 0.5) -> Svm:
    """Fits weights on all rows, and the scores' line on margins from a two-fold split."""
    prior = (toxic.sum() + 1) / (len(toxic) + 2)
    model = Svm(shift=float(np.log(prior / (1 - prior))))
    if not landmarks or len(toxic) < 4 or toxic.min() == toxic.max():
        return model
    model.landmarks, model.mapping = landmarks, nystrom(landmarks)
    x = design(pooled, model.mapping)
    y, weight = np.where(toxic > 0, 1.0, -1.0), np.where(toxic > 0, 2.0, 1.0)
    margins, fold = np.zeros(len(y)), np.arange(len(y)) % 2
    for f in (0, 1):
        if len(set(y[fold != f])) == 2:
            margins[fold == f] = x[fold == f] @ hinge(x[fold != f], y[fold != f], weight[fold != f], c)
    model.weights = hinge(x, y, weight, c)
    model.slope, model.shift = logistic(margins, toxic.astype(float))
    return model


def choose(counts: list[tuple[str, int, int]], toxic: int, other: int, most: int = LANDMARKS) -> list[str]:
    """Landmarks: words with the largest log-likelihood ratio among those more frequent in toxic texts."""
    def g2(a, b):
        e1, e2 = (a + b) * toxic / (toxic + other), (a + b) * other / (toxic + other)
        return 2 * (a * np.log(a / e1) + (b * np.log(b / e2) if b else 0))

    found = [(g2(a, b), w) for w, a, b in counts if a >= 3 and a * other > 2 * b * toxic and w.strip(EDGES)]
    chosen: list[str] = []
    maps: list[dict] = []
    for value, word in sorted(found, key=lambda x: (-x[0], x[1])):
        own = subsequences(word)
        if value >= EVIDENCE and all(sum(v * m.get(u, 0.0) for u, v in own.items()) < ALIKE for m in maps):
            chosen.append(word)
            maps.append(own)
            if len(chosen) == most:
                break
    return chosen


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", held_out_mod: int = HELD_OUT_MOD, max_rows: int = MAX_LABELLED, landmarks: int = LANDMARKS) -> Svm:
    """Fits the model on at most max_rows labelled texts.

    Word counts are aggregated by Spark and only words of at least three toxic texts that are twice
    as frequent there are fetched, at most 20 * landmarks of them; then each labelled text's pooled
    kernel values (3 * landmarks numbers).
    """
    rows = labelled(docs, labels, label, id_col=id_col, text_col=text_col, held_out_mod=held_out_mod, max_rows=max_rows)
    words = rows.select("_y", F.explode(F.array_distinct(F.split(F.lower("_text"), f"{SPACE_CLASS}+"))).alias("w")).select("_y", F.btrim("w", F.lit(EDGES)).alias("w")).where("w <> ''").where(F.length("w") <= WORD_MOST)
    size = rows.groupBy("_y").count().collect()
    toxic, other = (sum(r["count"] for r in size if bool(r["_y"]) == k) for k in (True, False))
    if not toxic or not other:
        return fit(np.zeros((toxic + other, 0)), np.repeat([1, 0], [toxic, other]), [])
    tops = words.groupBy("w").agg(F.count_if(F.col("_y") > 0).alias("a"), F.count_if(F.col("_y") == 0).alias("b")).where((F.col("a") >= 3) & (F.col("a") * other > 2 * F.col("b") * toxic))
    tops = tops.orderBy(F.desc(F.col("a") / (F.col("b") + 1) * F.log("a")), "w").limit(20 * landmarks)
    chosen = choose([tuple(r) for r in tops.collect()], toxic, other, landmarks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(chosen)
        for batch in batches:
            x = kernel.pooled(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(2)], names=["id", "x", "y"])

    got = rows.select("_id", "_text", "_y").mapInArrow(run, "id long, x array<double>, y int").toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(len(got), -1)
    order = np.lexsort((x.sum(1), got["id"].to_numpy()))
    return fit(x[order], got["y"].to_numpy()[order], chosen)


def scored(docs: DataFrame, model: Svm, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row, in one pass without a shuffle; each distinct word meets the landmarks once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(model.landmarks)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                x = kernel.pooled(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return docs.select(named(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, SCORES)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, held_out_mod: int = HELD_OUT_MOD) -> DataFrame:
    """Toxicity of every whole text: doc_id, held_out, score, predicted.

    Null and empty texts meet no landmark and get the score of a text without insults. Repeated rows
    get equal scores; a null id has held_out false; an empty table gives no rows; without usable
    labels every score is the smoothed class share. Other columns are ignored, whatever their names.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, held_out_mod=held_out_mod)
    return scored(docs, model, id_col=id_col, text_col=text_col).select(
        "doc_id",
        F.coalesce(id_text_crc_mod("doc_id", held_out_mod) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op10_toxicity_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
