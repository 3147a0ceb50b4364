"""Agreement of emitted predicates with gold ones: recall, precision, confusion, splits, sweeps, intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenegrain.functions.geometry import num
from scenegrain.types import PREDICATES


def ratio(a: Column, b: Column, places: int = 6) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, num(0)).otherwise(F.round(a / b, places))


def opposite(k: Column) -> Column:
    return F.when(k == "in front of", "behind").when(k == "behind", "in front of")


def hits(fact: DataFrame) -> DataFrame:
    """A row per gold predicate of a pair: k and whether the pair's predicates have it."""
    return fact.withColumn("k", F.explode("gold")).withColumn("hit", F.expr("array_contains(pred, k)"))


def recall_table(fact: DataFrame) -> DataFrame:
    """Recall per predicate over all and over held-out groups, and the MEAN row, which skips predicates without gold."""
    held = F.col("grp") >= 6
    per = hits(fact).groupBy("k").agg(F.count("*").alias("gold"), F.avg(F.col("hit").cast("double")).alias("r"), F.count_if(held).alias("gold_held"), F.avg(F.when(held, F.col("hit").cast("double"))).alias("h"))
    mean = per.agg(F.lit("MEAN").alias("k"), F.sum("gold").alias("gold"), F.avg("r").alias("r"), F.sum("gold_held").alias("gold_held"), F.avg("h").alias("h"))
    return per.unionByName(mean).select("k", "gold", F.round("r", 6).alias("recall"), "gold_held", F.round("h", 6).alias("recall_held"))


def counts_per_predicate(fact: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn per predicate over pairs with any gold, in one pass: a pair is exploded into what it has, gold or emitted."""
    by = by or []
    rows = fact.where("size(gold) > 0").withColumn("k", F.explode(F.array_union("gold", "pred")))
    g, p = F.expr("array_contains(gold, k)"), F.expr("array_contains(pred, k)")
    return rows.groupBy(*by, "k").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))


def prf(counts: DataFrame, places: int = 4) -> DataFrame:
    """precision, recall, f1 and support from tp, fp, fn."""
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    counts = counts.withColumns({"_p": F.when(F.col("tp") + F.col("fp") == 0, num(0)).otherwise(p), "_r": F.when(F.col("tp") + F.col("fn") == 0, num(0)).otherwise(r)})
    f1 = F.when(F.col("_p") + F.col("_r") == 0, num(0)).otherwise(2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r")))
    return counts.withColumns({"precision": F.round("_p", places), "recall": F.round("_r", places), "f1": F.round(f1, places), "support": F.col("tp") + F.col("fn")}).drop("_p", "_r")


def confusion(fact: DataFrame) -> DataFrame:
    """What came out where a predicate was gold: correct, nothing, or each other predicate."""
    said = F.when(F.col("hit"), F.array(F.lit("correct"))).when(F.size("pred") == 0, F.array(F.lit("(nothing)"))).otherwise(F.col("pred"))
    return hits(fact).withColumn("response", F.explode(said)).groupBy(F.col("k").alias("gold"), "response").agg(F.count("*").alias("n"))


def group_recall(fact: DataFrame) -> DataFrame:
    return hits(fact).groupBy("grp").agg(F.count("*").alias("gold"), F.round(F.avg(F.col("hit").cast("double")), 4).alias("recall"))


def depth_decomposition(fact: DataFrame) -> DataFrame:
    """Front and behind per group: how often a direction is emitted, agrees, and what recall is under the group's convention.

    A group that agrees in under half of what is emitted has the inverted convention; OVERALL sums the
    groups' own choices.
    """
    h = hits(fact).where(F.col("k").isin("in front of", "behind")).withColumn("o", opposite(F.col("k"))).withColumn("flip", F.expr("array_contains(pred, o)"))
    emitted = F.col("hit") | F.col("flip")
    per = h.groupBy("grp").agg(F.count("*").alias("gold"), F.count_if("hit").alias("raw"), F.count_if("flip").alias("flip"), F.count_if(emitted).alias("emitted"))
    inverted = (F.col("emitted") > 0) & (F.col("raw") * 2 < F.col("emitted"))
    per = per.withColumn("convention", F.when(inverted, "inverted").otherwise("same")).withColumn("aligned", F.when(inverted, F.col("flip")).otherwise(F.col("raw")))
    rows = per.select(F.col("grp").cast("string").alias("grp"), "gold", "raw", "emitted", "aligned", "convention")
    total = per.agg(F.lit("OVERALL").alias("grp"), F.sum("gold").alias("gold"), F.sum("raw").alias("raw"), F.sum("emitted").alias("emitted"), F.sum("aligned").alias("aligned"), F.lit("").alias("convention"))
    rows = rows.unionByName(total)
    return rows.select("grp", "gold", "convention", ratio(F.col("emitted"), F.col("gold"), 4).alias("emit_rate"), ratio(F.col("raw"), F.col("emitted"), 4).alias("agreement"), ratio(F.col("raw"), F.col("gold"), 4).alias("raw_recall"), ratio(F.col("aligned"), F.col("gold"), 4).alias("aligned_recall"))


def flag_rates(fact: DataFrame) -> DataFrame:
    """Pairs by flag, and FLAGGED for any, with shares of all pairs: one pass, no second count of the table."""
    marks = F.concat(F.array(F.lit("ALL")), F.when(F.size("flags") > 0, F.array(F.lit("FLAGGED"))).otherwise(F.array().cast("array<string>")), F.col("flags"))
    n = fact.select(F.explode(marks).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
    total = F.max(F.when(F.col("flag") == "ALL", F.col("n"))).over(Window.partitionBy(F.lit(1)))
    return n.withColumn("t", total).where("flag <> 'ALL'").select("flag", "n", F.round(F.col("n") / F.col("t"), 4).alias("rate"))


def majority(fact: DataFrame) -> DataFrame:
    """Recall of always naming the predicate most frequent in the training groups (ties: the first by name)."""
    counts = fact.where("grp < 6").select(F.explode("gold").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "k").limit(1).select(F.col("k").alias("top"))
    per = hits(fact).groupBy("k").agg(F.count("*").alias("gold"))
    return per.join(F.broadcast(top), F.lit(True)).select("k", "gold", F.when(F.col("k") == F.col("top"), num(1)).otherwise(num(0)).alias("recall"))


def fit_near(unordered: DataFrame, points: int = 100) -> DataFrame:
    """The threshold on `metric` with the best F1 against `near`, to six places, over evenly spaced candidates; the first of equals.

    Candidates aren't crossed with pairs: a pair counts from the first candidate that reaches its
    metric on, so pairs are counted per that candidate and running sums over `points` rows do the rest.
    """
    unordered = unordered.select("metric", "near")
    span = unordered.agg(F.min("metric").alias("lo"), F.max("metric").alias("hi"), F.sum("near").alias("positives"))
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(points - 1), F.ceil((F.col("metric") - F.col("lo")) / step - num(1e-9)))).cast("int")
    first = unordered.join(F.broadcast(span), F.lit(True)).groupBy(at.alias("i")).agg(F.sum("near").alias("tp"), F.sum(1 - F.col("near")).alias("fp"))
    grid = span.select("lo", step.alias("step"), "positives", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).join(F.broadcast(first), "i", "left")
    run = Window.partitionBy("lo").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # `points` rows
    grid = grid.withColumns({"tp": F.coalesce(F.sum("tp").over(run), F.lit(0)), "fp": F.coalesce(F.sum("fp").over(run), F.lit(0))})
    f1 = F.when(F.col("tp") == 0, num(0)).otherwise(num(2) * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("positives")))
    scored = grid.withColumn("f1", F.round(F.round(f1, 9), 6))  # as it is returned: candidates that look alike there are equals
    best = scored.agg(F.max_by(F.struct("i", "lo", "step", "f1"), F.struct("f1", -F.col("i"))).alias("b"))
    return best.select(F.col("b.i").cast("int").alias("i"), F.round(F.col("b.lo") + F.col("b.i") * F.col("b.step"), 6).alias("T"), F.col("b.f1").alias("f1"))


def bootstrap(per_image: DataFrame, iters: int = 2000) -> DataFrame:
    """Percentile intervals of recall when whole images are drawn with replacement: k, draws, lo, hi."""
    return intervals(drawn(per_image, iters)).select("k", "draws", "lo", "hi")


def drawn(per_image: DataFrame, iters: int = 2000, held: Column | None = None) -> DataFrame:
    """scope, k, draw, h, t: weighted hits and totals of all images (pooled) and, with `held`, of those of its rows (held out).

    per_image: image_id, k, hits, total; an image may have several rows of a predicate. Each draw gives
    an image a Poisson(1) weight, from a hash of draw and image: the large-sample form of drawing with
    replacement, which needs no list of images in one place. Draw 0 takes every image once. Images
    become rows first; a task multiplies their weights for all draws with their counts, block by block,
    and gives one row a scope, predicate and draw, so nothing is exploded, and both scopes share weights.
    """
    names = PREDICATES
    counts = [F.coalesce(F.sum(F.when(F.col("k") == p, F.col(c))), F.lit(0)).cast("double").alias(f"{c}{i}") for c in ("hits", "total") for i, p in enumerate(names)]
    whole = dict(per_image.dtypes)["image_id"] in ("tinyint", "smallint", "int", "bigint")
    image = F.pmod(F.col("image_id").cast("long") if whole else F.xxhash64("image_id"), F.lit(DRAW_PRIME).cast("long"))
    side = F.lit(False) if held is None else F.coalesce(held, F.lit(False))
    wide = per_image.groupBy("image_id", side.alias("held")).agg(*counts).select(image.alias("image"), "held", F.array(*[f"{c}{i}" for c in ("hits", "total") for i in range(len(names))]).alias("v"))
    scopes = ["pooled"] if held is None else ["pooled", "held out"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.arange(iters + 1)
        sums = np.zeros((2, 2 * len(names), iters + 1))  # of images not held out, and of those that are
        for batch in batches:
            images, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            v = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * len(names))
            for i in (0, 1):
                mine, own = images[sides == i], v[sides == i]
                for lo in range(0, len(mine), DRAWN_TOGETHER):
                    some = own[lo : lo + DRAWN_TOGETHER]
                    sums[i, :, 1:] += some.T @ draw_weights(draw[None, 1:], mine[lo : lo + DRAWN_TOGETHER, None]).astype(float)
                sums[i, :, 0] += own.sum(0)
        of = np.stack([sums.sum(0), sums[1]][: len(scopes)])
        hits, total = (of[:, i * len(names) : (i + 1) * len(names)].ravel() for i in (0, 1))
        keep = np.flatnonzero(total > 0)
        at, (scope, k, n) = keep, np.unravel_index(keep, (len(scopes), len(names), iters + 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(scopes)[scope]), pa.array(np.array(names)[k]), pa.array(draw[n]), pa.array(hits[at]), pa.array(total[at])], names=["scope", "k", "draw", "h", "t"])

    return wide.mapInArrow(run, "scope string, k string, draw long, h double, t double").groupBy("scope", "k", "draw").agg(F.sum("h").alias("h"), F.sum("t").alias("t"))


def intervals(draws: DataFrame) -> DataFrame:
    """scope, k, draws, gold, recall, lo, hi from drawn(): recall and gold of the images as they are, the interval of their draws."""
    real = F.col("draw") > 0
    share = F.when(real, F.col("h") / F.col("t"))
    ends = [F.round(F.percentile(share, num(p)), 6).alias(c) for p, c in ((0.025, "lo"), (0.975, "hi"))]
    once = [F.max(F.when(~real, v)).alias(c) for v, c in ((F.col("t").cast("long"), "gold"), (F.col("h") / F.col("t"), "recall"))]
    return draws.groupBy("scope", "k").agg(F.count_if(real).alias("draws"), *once, *ends).where("draws > 0")


#: The hash of draw and image works modulo this prime, so that all products fit into 64 bits.
DRAW_PRIME, DRAW_A, DRAW_B = 2_147_483_647, 1_103_515_245, 69_621


#: Cumulative probabilities of a Poisson variable of mean 1 being 0, at most 1, ... at most 7.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]
#: Images whose weights are worked out together: few enough that what is worked out stays in a core's cache.
DRAWN_TOGETHER = 32


def first_passed(p: float) -> int:
    """The smallest number whose share of the prime reaches p."""
    x = max(0, int(p * DRAW_PRIME) - 2)
    while x / DRAW_PRIME < p:
        x += 1
    return x


PASSED = [np.uint32(first_passed(p)) for p in POISSON]


def draw_weights(draw: np.ndarray, image: np.ndarray) -> np.ndarray:
    """Poisson(1) weights of images (below the prime) in draws: the steps that a hash of both, as a share of the prime, has passed.

    The prime is 2**31 - 1, so that a remainder is what is left of adding the digits above 31 to those
    below, twice; it may be the prime and a little more, which is 0 and a little more.
    """
    prime, high = np.uint64(DRAW_PRIME), np.uint64(31)
    draw, image = draw.astype(np.uint64), image.astype(np.uint64)
    x = image * np.uint64(DRAW_A) % prime + (draw * np.uint64(DRAW_B) + np.uint64(12_345)) % prime
    above = np.empty_like(x)
    for more in (image, draw):
        x *= x  # below 2**64, since a sum of two remainders is below 2**32
        x += more
        for _ in range(2):
            np.right_shift(x, high, out=above)
            x &= prime
            x += above
    x = x.astype(np.uint32)
    w = np.zeros(x.shape, np.int8)
    for least in PASSED:
        w += (x >= least).view(np.int8)
    w[x >= np.uint32(DRAW_PRIME)] = 0
    return w


def failure_cause(t, inverted=(6, 8)) -> Column:
    """Why a gold predicate k was missed, by evidence from masks: the first test that holds."""
    dz = F.abs(F.col("a_depth") - F.col("b_depth"))
    up = F.when(F.col("k") == "on", F.col("a_cy") < F.col("b_cy")).otherwise(F.col("b_cy") < F.col("a_cy"))
    c = F.when(F.col("k") == "on", F.col("c_ab")).otherwise(F.col("c_ba"))
    depth = F.when(dz <= num(t.depth_eps), "depth band").when(F.col("grp").isin(*inverted), "inverted convention").otherwise("depth order")
    support = F.when((c >= num(t.on_contact_min)) & (dz > num(t.on_depth_eps)), "depth gate").when((c >= num(t.on_contact_min)) & ~up, "centre order").when((c > 0) & (c < num(t.on_contact_min)), "little contact").otherwise("no contact")
    near = F.when(F.arrays_overlap("pred", F.array(F.lit("on"), F.lit("under"))), "called support").when(F.col("gap_rel") > num(t.near_T), "gap too large").otherwise("other")
    lateral = F.when(F.abs(F.col("a_cx") - F.col("b_cx")) <= num(t.lateral_center_eps), "centre band").otherwise("centre flip")
    return F.when(F.col("k").isin("in front of", "behind"), depth).when(F.col("k").isin("on", "under"), support).when(F.col("k") == "near", near).otherwise(lateral)


def ablation(pairs: DataFrame, points: list[tuple[str, float]], held: Column) -> DataFrame:
    """Of every point of threshold sweeps and predicate the whole record: gold, recalled, held-out ones, tp, fp (on annotated pairs), emitted, and their rates.

    pairs: a pair judged at base thresholds, with predicates, gold, gap_rel and both depths. A point is
    near_T or depth_eps and a value: all are judged in the pair's row, and a pair is a row for each
    predicate that is stated or gold at a point.
    """
    base = F.col("predicates")
    dz, back = F.col("b_depth") - F.col("a_depth"), F.col("a_depth") - F.col("b_depth")
    free = ~(F.array_contains(base, "on") | F.array_contains(base, "under"))

    def said(param: str, value: float) -> Column:
        if param == "near_T":
            return F.concat(F.array_remove(base, "near"), F.when(free & (F.col("gap_rel") <= num(value)), F.array(F.lit("near"))).otherwise(F.array().cast("array<string>")))
        depth = F.when(dz > num(value), "in front of").when(back > num(value), "behind")
        return F.array_compact(F.concat(F.array_remove(F.array_remove(base, "in front of"), "behind"), F.array(depth)))

    at = F.explode(F.array(*[F.struct(F.lit(p).alias("param"), num(v).alias("value"), said(p, v).alias("said")) for p, v in points]))
    each = pairs.select("gold", held.alias("held"), at.alias("t")).select("gold", "held", "t.*")
    rows = each.select("*", F.explode(F.array_union("said", "gold")).alias("k"))
    gold, stated = F.array_contains("gold", F.col("k")), F.array_contains("said", F.col("k"))
    n = rows.groupBy("param", "value", "k").agg(F.count_if(gold).alias("gold"), F.count_if(gold & stated).alias("tp"), F.count_if(gold & F.col("held")).alias("gold_held"), F.count_if(gold & stated & F.col("held")).alias("tp_held"), F.count_if(stated & ~gold & (F.size("gold") > 0)).alias("fp"), F.count_if(stated).alias("emitted"))
    share = lambda a, b, none: F.when(b > 0, a / b).otherwise(none)
    tp, zero = F.col("tp"), num(0)
    p, r = share(tp, tp + F.col("fp"), zero), share(tp, F.col("gold"), zero)
    rates = {"recall": r, "recall_held": share(F.col("tp_held"), F.col("gold_held"), F.lit(None)), "precision": p, "f1": share(2 * p * r, p + r, zero)}
    return n.withColumns({c: F.round(v, 6) for c, v in rates.items()})


def residual_motion(shifts: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """keys, idx and residual: how far an object's shift (dx, dy) is from the median shift of its image, for images of `least` objects or more.

    Turning the camera moves all objects alike, so the median carries no depth; what is left grows with nearness.
    """
    middle = shifts.groupBy(*keys).agg(F.median("dx").alias("_mx"), F.median("dy").alias("_my"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    return shifts.join(middle, keys).select(*keys, "idx", residual(F.col("dx"), F.col("dy"), F.col("_mx"), F.col("_my")).alias("residual"))


def residual(dx: Column, dy: Column, mx: Column, my: Column) -> Column:
    """How far a shift is from the median one."""
    x, y = dx - mx, dy - my
    return F.round(F.sqrt(x * x + y * y), 9)


def parallax(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Gold depth pairs ordered by residual motion: by, image_id, subj, obj, right (parallax), mono (null: not committed), mono_right, agree, separation.

    pairs: by, image_id, subj, obj, gold, pred, ra and rb. The larger residual is nearer, that is in front.
    """
    front, behind = (lambda c: F.array_contains(c, "in front of")), (lambda c: F.array_contains(c, "behind"))
    truth, nearer = front("gold"), F.col("ra") > F.col("rb")
    mono = F.when(front("pred"), True).when(behind("pred"), False)
    apart = F.abs(F.col("ra") - F.col("rb")) / F.greatest(F.abs("ra"), F.abs("rb"), num(1e-9))
    known = pairs.where((front("gold") | behind("gold")) & F.col("ra").isNotNull() & F.col("rb").isNotNull())
    return known.select(*by, "image_id", "subj", "obj", (nearer == truth).alias("right"), mono.alias("mono"), F.coalesce(mono == truth, F.lit(False)).alias("mono_right"), (mono == nearer).alias("agree"), F.round(apart, 9).alias("separation"))
