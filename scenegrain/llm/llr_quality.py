"""Quality rules: counts of each text, and a hashed n-gram log-likelihood ratio of trusted text to the corpus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACE_CLASS, named, table, text_of

#: Buckets of hashed word n-grams (1 and 2 words); the model is one array of that length.
BUCKETS = 1 << 14
#: Trusted n-grams that each bucket has besides its own, as many as expected, and the scale at which log ratios are kept as integers.
SMOOTHING, SCALE = 8.0, 10_000
#: Mean log-likelihood ratio per n-gram, in nats, that a text needs; set with SMOOTHING on labels that the model hadn't seen.
THRESHOLD = -0.06
#: Trusted ids that are sent to all tasks, at most; more of them are joined by id. Either way all of them count.
MOST_SENT = 1_000_000
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: inside a lambda a plain expression is computed for each element."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")


def grams(words: Column) -> Column:
    """Bucket, from 1, of each hashed unigram and bigram."""

    def of(h: Column) -> Column:
        n = F.size(h)
        one = F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int") + 1)
        pairs = F.zip_with(F.slice(h, 1, F.greatest(n - 1, F.lit(0))), F.slice(h, 2, n), lambda x, y: F.pmod(F.xxhash64(x, y), F.lit(BUCKETS)).cast("int") + 1)
        return F.concat(one, pairs)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more in the text.

    Windows are hashed and sorted with their places; equal neighbours mark repeats, and the places of
    these, sorted, give the number of words that they cover together. n log n, inside the row, and
    only where hashes repeat at all.
    """

    def cover(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, 2, F.size(p)), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(WINDOW), lambda acc, g: acc + g)

    def places(keyed: Column) -> Column:
        n = F.size(keyed)
        same = F.zip_with(F.slice(keyed, 2, n), F.slice(keyed, 1, n - 1), lambda b, a: b["h"] == a["h"])
        return let(
            same,
            lambda eq: F.array_sort(
                F.array_compact(F.zip_with(keyed, F.zip_with(F.concat(F.array(F.lit(False)), eq), F.concat(eq, F.array(F.lit(False))), lambda x, y: x | y), lambda s, m: F.when(m, s["i"])))
            ),
        )

    def counted(w: Column) -> Column:
        keyed = F.sort_array(F.zip_with(w, F.sequence(F.lit(1), F.size(w)), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(let(keyed, places), cover))

    def hashed(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(WINDOW)]))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(hashed(h), counted))).cast("long")


def model(docs: DataFrame, trusted: DataFrame, *, id_col: str, text_col: str, most_sent: int = MOST_SENT) -> list[int]:
    """Per bucket the log ratio of its share in trusted text to its share in the corpus, times SCALE.

    The corpus's counts cover every text, the target's every trusted one; both are summed per bucket
    before the shuffle, and what reaches the driver are BUCKETS pairs of numbers. Up to most_sent
    trusted ids, one integer each, are sent to all tasks, and one pass counts both. Beyond that, texts
    become arrays of buckets, two bytes an n-gram, before these meet the ids in a join; texts
    themselves are never shuffled.
    """
    ids = trusted.select(F.col("doc_id").cast("long").alias("_trusted")).where("_trusted is not null").distinct()
    rows = docs.select(named(id_col).cast("long").alias("_id"), grams(words_of(text_of(text_col))).cast("array<smallint>").alias("_grams"))
    if ids.count() <= most_sent:
        marked = rows.join(F.broadcast(ids), F.col("_id") == F.col("_trusted"), "left")
        hashed = marked.select(F.col("_trusted").isNotNull().cast("long").alias("t"), F.explode("_grams").alias("b"))
        counts = {r["b"]: (r["t"], r["n"]) for r in hashed.groupBy("b").agg(F.sum("t").alias("t"), F.count("*").alias("n")).collect()}
    else:
        found = rows.where("_id is not null").join(ids.hint("shuffle_hash"), F.col("_id") == F.col("_trusted"))
        target, every = ({r["b"]: r["count"] for r in x.select(F.explode("_grams").alias("b")).groupBy("b").count().collect()} for x in (found, rows))
        counts = {b: (target.get(b, 0), n) for b, n in every.items()}
    of_trusted, of_all = (sum(c[k] for c in counts.values()) for k in (0, 1))
    out = []
    for b in range(1, BUCKETS + 1):
        t, n = counts.get(b, (0, 0))
        # counted against expected trusted n-grams; both are raised alike, so that words of a few texts say little
        expected = of_trusted * n / max(of_all, 1)
        out.append(round(SCALE * math.log((t + SMOOTHING) / (expected + SMOOTHING))))
    return out


def judged(docs: DataFrame, trusted: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept of every row.

    llr is the sum of the log ratios of a text's n-grams over their number; sums are of integers, so
    that no order of addition shows. A text that fails the base rules, or whose llr is below the
    threshold, isn't kept. Without trusted rows every ratio is 0 and the base rules decide.

    Null and empty texts have no words and fail; null ids and repeated rows are rows like any other
    (each counts in the corpus); an empty table gives no rows; other columns are ignored.
    """
    ratios = model(docs, trusted, id_col=id_col, text_col=text_col)
    # a literal of BUCKETS integers: parsed once, when the plan is optimised
    ratio = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", f"{SPACE_CLASS}+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        let(grams(F.col("words")), lambda g: F.aggregate(g, F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(ratio, b)) / F.greatest(F.size(g), F.lit(1))).alias("total"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("llr", F.col("total") / F.lit(float(SCALE)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"))


def op5_llr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return judged(table(spark, sf_dir, "documents"), trusted)
