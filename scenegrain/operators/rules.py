"""The seven predicates of an ordered pair, with corrections and flags, as one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenegrain.functions.geometry import Box, box_gap_rel, num, vertical_gap, x_extent_overlap
from scenegrain.sources.fixtures import object_pairs
from scenegrain.types import Thresholds


def on_box(a: Box, b: Box, cy_a: Column, cy_b: Column, z_a: Column, z_b: Column, t: Thresholds) -> Column:
    """a rests on b by its boxes: above, touching, overlapping, at one depth."""
    gap = vertical_gap(a, b)
    return (cy_a < cy_b) & (gap >= num(-t.on_vertical_gap)) & (gap <= num(t.on_vertical_gap)) & (x_extent_overlap(a, b) >= num(t.on_horizontal_overlap)) & (F.abs(z_a - z_b) <= num(t.on_depth_eps))


def on_mask(contact: Column, cy_a: Column, cy_b: Column, z_a: Column, z_b: Column, t: Thresholds) -> Column:
    """a rests on b by mask contact: above, at one depth, enough of its bottom on b."""
    return (cy_a < cy_b) & (F.abs(z_a - z_b) <= num(t.on_depth_eps)) & (contact >= num(t.on_contact_min))


def looked_up(objs: DataFrame, per: DataFrame, columns: list[str]) -> DataFrame:
    """objs with columns of `per` (image_id, idx, columns; a row per object at most), null where it has none.

    A join by image_id and idx would move both sides; here an image's rows are gathered into a map, no
    larger than its scene, which meets the objects by image_id, where they are.
    """
    said = per.where("idx is not null").groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", F.struct(*columns).alias("v")))).alias("_said"))
    own = F.col("_said")[F.col("idx")]
    return objs.join(said, "image_id", "left").withColumns({c: own[c] for c in columns}).drop("_said")


def with_evidence(objs: DataFrame, contact: DataFrame | None, t: Thresholds, extra_elevated: DataFrame | None = None) -> DataFrame:
    """Objects with what masks say of them: touches (object below: share) and elevated.

    Contact is aggregated to objects before pairs are made, so the join has a row per object, and
    pairs look up both directions in maps no larger than their scene. An object is elevated if its
    contact with anything reaches on_contact_min, or if extra_elevated (image_id, idx) names it.
    Without contact the map is null, which means: no masks, use boxes.
    """
    if contact is None:
        return objs.withColumn("touches", F.lit(None).cast("map<int,double>")).withColumn("elevated", F.lit(None).cast("boolean"))
    per = contact.groupBy("image_id", F.col("i").alias("idx")).agg(F.map_from_entries(F.collect_list(F.struct("j", "frac"))).alias("touches"), (F.max("frac") >= num(t.on_contact_min)).alias("elevated"))
    out = looked_up(objs, per, ["touches", "elevated"])
    none = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<double>"))
    if extra_elevated is not None:
        out = looked_up(out, extra_elevated.select("image_id", "idx").distinct().withColumn("extra", F.lit(True)), ["extra"])
    extra = F.coalesce("extra", F.lit(False)) if extra_elevated is not None else F.lit(False)
    return out.withColumn("touches", F.coalesce("touches", none)).withColumn("elevated", F.coalesce("elevated", F.lit(False)) | extra).drop("extra")


Share = Callable[[Box, Box], Column]


def gathered(objs: DataFrame, share: Share | None = None, t: Thresholds | None = None, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """A row per image: `by`, and scene, an array of its objects; with `share`, each with elevated."""
    rows = objs.groupBy(*by).agg(F.collect_list(F.struct(*[c for c in objs.columns if c not in by])).alias("scene"))
    return rows if share is None else rows.withColumn("scene", elevated_in("scene", share, t or Thresholds()))


def elevated_in(scene: Column | str, share: Share, t: Thresholds) -> Column:
    """An array of objects, each with elevated: whether its contact with any of them reaches on_contact_min."""
    box = lambda o: Box(o["x1"], o["y1"], o["x2"], o["y2"])
    return F.transform(scene, lambda o: o.withField("elevated", F.exists(scene, lambda u: share(box(o), box(u)) >= num(t.on_contact_min))))


def contact_key(i: Column, j: Column) -> Column:
    """The key of an ordered pair of objects in a scene's map of contacts."""
    return i.cast("long") * (1 << 32) + j


def elevated_by(scene: str, contacts: str, raised: str, t: Thresholds) -> Column:
    """An array of objects, each with elevated, whether its contact with any object reaches on_contact_min, and raised, whether it is named there."""
    up = F.transform(F.filter(contacts, lambda c: c["frac"] >= num(t.on_contact_min)), lambda c: c["i"])
    return F.transform(scene, lambda o: o.withField("elevated", F.array_contains(up, o["idx"])).withField("raised", F.array_contains(raised, o["idx"])))


def gathered_pairs(rows: DataFrame, share: Share | None = None) -> DataFrame:
    """Every ordered pair (a_*, b_*) of different objects of gathered() rows, which keep their other columns; with `share`, c_ab and c_ba.

    An image's row is unfolded twice: no rows are sorted or joined to make pairs.
    """
    own = [f.name for f in rows.schema["scene"].dataType.elementType.fields]
    kept = [c for c in rows.columns if c != "scene"]
    a = rows.select(*kept, "scene", F.explode("scene").alias("_a")).select(*kept, "scene", *[F.col("_a")[c].alias(f"a_{c}") for c in own])
    pairs = a.select(*[c for c in a.columns if c != "scene"], F.explode("scene").alias("_b")).where(F.col("_b.idx") != F.col("a_idx"))
    pairs = pairs.select("*", *[F.col("_b")[c].alias(f"b_{c}") for c in own]).drop("_b")
    a, b = Box.of("a_"), Box.of("b_")
    return pairs if share is None else pairs.withColumns({"c_ab": share(a, b), "c_ba": share(b, a)})


def evaluate_gathered(objs: DataFrame, t: Thresholds | None = None, *, correct: bool = True, share: Share | None = None) -> DataFrame:
    """The rows of evaluate_scene() where contact is an expression of two boxes (`share`) rather than a table."""
    t = t or Thresholds()
    return judged(gathered_pairs(gathered(objs, share, t), share), t, correct)


def evaluate_some(objs: DataFrame, wanted: Column, share: Share, t: Thresholds | None = None) -> DataFrame:
    """The rows of evaluate_gathered() that `wanted` (of image_id, a_* and b_*) names: other pairs aren't judged.

    Whether an object is elevated is looked up only where the order in depth hangs on it, and is false elsewhere.
    """
    t = t or Thresholds()
    pairs = gathered_pairs(gathered(objs).withColumn("_around", F.col("scene")), share).where(wanted)
    settled = (F.col("b_depth") - F.col("a_depth") > num(t.depth_eps)) | (F.col("a_depth") - F.col("b_depth") > num(t.depth_eps))

    def elevated(side: str) -> Column:
        touches = F.exists("_around", lambda u: share(Box.of(side), Box(u["x1"], u["y1"], u["x2"], u["y2"])) >= num(t.on_contact_min))
        return F.when(settled, F.lit(False)).otherwise(touches)

    return judged(pairs.withColumns({"a_elevated": elevated("a_"), "b_elevated": elevated("b_")}).drop("_around"), t)


def named(*names: Column) -> Column:
    """An array of the names that aren't null, in order; compiled, which array_compact() and its lambda aren't."""
    return F.concat(*[F.when(name.isNotNull(), F.array(name)).otherwise(F.array().cast("array<string>")) for name in names])


def judged(pairs: DataFrame, t: Thresholds, correct: bool = True) -> DataFrame:
    """Pairs (a_*, b_*, with evidence) with c_ab, c_ba, gap_rel, predicates and flags.

    Evidence is a_touches and b_touches (with_evidence()), or c_ab and c_ba themselves (gathered_pairs()); null, or neither: no masks.

    Predicates come in the order on, under, lateral, depth, near. `correct` governs the class guard,
    the demotion of on-and-under, and the exclusion of near by support, all three.
    """
    a, b = Box.of("a_"), Box.of("b_")
    if "a_touches" in pairs.columns:
        masks = F.col("a_touches").isNotNull()
        pairs = pairs.withColumns({"c_ab": F.when(masks, F.coalesce(F.col("a_touches")[F.col("b_idx")], num(0))), "c_ba": F.when(masks, F.coalesce(F.col("b_touches")[F.col("a_idx")], num(0)))})
    elif "c_ab" not in pairs.columns:
        pairs = pairs.withColumns({c: F.lit(None).cast("double") for c in ("c_ab", "c_ba")} | {c: F.lit(None).cast("boolean") for c in ("a_elevated", "b_elevated")})
    masks = F.col("a_touches").isNotNull() if "a_touches" in pairs.columns else F.col("c_ab").isNotNull()
    pairs = pairs.withColumn("gap_rel", box_gap_rel(a, b))
    args = (F.col("a_cy"), F.col("b_cy"), F.col("a_depth"), F.col("b_depth"))
    back = (F.col("b_cy"), F.col("a_cy"), F.col("b_depth"), F.col("a_depth"))
    blocked = F.col("a_label").isin(*t.no_support_classes) | F.col("b_label").isin(*t.no_support_classes) if correct else F.lit(False)
    pairs = pairs.withColumns(
        {
            "_on": ~blocked & F.when(masks, on_mask(F.col("c_ab"), *args, t)).otherwise(on_box(a, b, *args, t)),
            "_under": ~blocked & F.when(masks, on_mask(F.col("c_ba"), *back, t)).otherwise(on_box(b, a, *back, t)),
        }
    )
    conflict = F.col("_on") & F.col("_under") & F.lit(correct)
    pairs = pairs.withColumns({"_conflict": conflict, "_on": F.col("_on") & ~conflict, "_under": F.col("_under") & ~conflict})
    dx, dz = F.col("b_cx") - F.col("a_cx"), F.col("b_depth") - F.col("a_depth")
    back_dx, back_dz = F.col("a_cx") - F.col("b_cx"), F.col("a_depth") - F.col("b_depth")
    drop = a.y2 - b.y2
    grounded = masks & ~F.col("a_elevated") & ~F.col("b_elevated")
    lateral = F.when(dx > num(t.lateral_center_eps), "to the left of").when(back_dx > num(t.lateral_center_eps), "to the right of")
    depth = F.when(dz > num(t.depth_eps), "in front of").when(back_dz > num(t.depth_eps), "behind").when(grounded & (drop > num(t.plane_band)), "in front of").when(grounded & (drop < num(-t.plane_band)), "behind")
    free = ~(F.col("_on") | F.col("_under")) if correct else F.lit(True)
    pairs = pairs.withColumns({"_lateral": lateral, "_depth": depth, "_near": free & (F.col("gap_rel") <= num(t.near_T)), "_edge": free & (F.abs(F.col("gap_rel") - num(t.near_T)) <= num(t.flag_near_band))})
    predicates = named(F.when(F.col("_on"), "on"), F.when(F.col("_under"), "under"), F.col("_lateral"), F.col("_depth"), F.when(F.col("_near"), "near"))
    flags = named(F.when(F.col("_conflict"), "on_under_conflict"), F.when(F.col("_lateral").isNull(), "lateral_ambiguous"), F.when(F.col("_depth").isNull(), "depth_ambiguous"), F.when(F.col("_edge"), "near_threshold_edge"))
    return pairs.withColumns({"predicates": predicates, "flags": flags}).drop("_on", "_under", "_conflict", "_lateral", "_depth", "_near", "_edge")


def evaluate_scene(objs: DataFrame, t: Thresholds | None = None, *, correct: bool = True, contact: DataFrame | None = None, extra_elevated: DataFrame | None = None) -> DataFrame:
    """Predicates and flags of every ordered pair of every image.

    objs: image_id, idx, label, x1, y1, x2, y2, cx, cy, depth and any others. Pair rows are made on
    the partitioning of the objects and projected at once; nothing after the join shuffles.
    """
    t = t or Thresholds()
    return judged(object_pairs(with_evidence(objs, contact, t, extra_elevated)), t, correct)


def claims(pairs: DataFrame, *columns: Column | str, name: str = "predicate") -> DataFrame:
    """A row per predicate of a pair. Of a plain explode() the optimizer infers a filter on the number of predicates, and judges each pair twice to apply it."""
    return pairs.select(*columns, F.explode_outer("predicates").alias(name)).where(F.col(name).isNotNull())


def both_ways(objs: DataFrame, t: Thresholds | None = None, *, share: Share | None = None) -> DataFrame:
    """image_id, a_idx, b_idx (a before b), forth and back: the predicates of (a, b) and of (b, a), judged apart, in one row."""
    t = t or Thresholds()
    half = gathered_pairs(gathered(objs, share, t), share).where("a_idx < b_idx")
    forth = judged(half, t).withColumn("forth", F.col("predicates")).drop("predicates", "flags", "gap_rel")
    other = {"a": "b", "b": "a"}
    swap = {c: f"{other[c[0]]}_{c[2:]}" for c in forth.columns if c[:2] in ("a_", "b_")} | {"c_ab": "c_ba", "c_ba": "c_ab"}
    back = judged(forth.select(*[F.col(c).alias(swap.get(c, c)) for c in forth.columns]), t)
    return back.select("image_id", F.col("b_idx").alias("a_idx"), F.col("a_idx").alias("b_idx"), "forth", F.col("predicates").alias("back"))


def evaluate_pairs_once(objs: DataFrame, t: Thresholds | None = None, *, correct: bool = True, contact: DataFrame | None = None) -> DataFrame:
    """The same rows from half the comparisons: pairs with a_idx < b_idx are judged and then mirrored.

    Every rule has a mirror image: on and under, left and right, front and behind swap, near, flags
    and gap stay. (image_id, subj, obj, predicates, flags, gap_rel.)
    """
    t = t or Thresholds()
    half = judged(object_pairs(with_evidence(objs, contact, t)).where("a_idx < b_idx"), t, correct)
    p = F.col("predicates")
    has = lambda name: F.array_contains(p, name)
    mirrored = named(
        F.when(has("under"), "on"), F.when(has("on"), "under"),
        F.when(has("to the right of"), "to the left of").when(has("to the left of"), "to the right of"),
        F.when(has("behind"), "in front of").when(has("in front of"), "behind"),
        F.when(has("near"), "near"),
    )
    both = F.array(F.struct(F.col("a_idx").alias("subj"), F.col("b_idx").alias("obj"), p.alias("predicates")), F.struct(F.col("b_idx").alias("subj"), F.col("a_idx").alias("obj"), mirrored.alias("predicates")))
    return half.select("image_id", "flags", "gap_rel", F.explode(both).alias("r")).select("image_id", "r.subj", "r.obj", "r.predicates", "flags", "gap_rel")


def with_gold(objs: DataFrame, gold: DataFrame) -> DataFrame:
    """Objects with gold_of: a map from each partner to what is stated of the two."""
    pairs_gold = gold.groupBy("image_id", "subj", "obj").agg(F.sort_array(F.collect_set("predicate")).alias("p"))
    per = pairs_gold.groupBy("image_id", F.col("subj").alias("idx")).agg(F.map_from_entries(F.collect_list(F.struct("obj", "p"))).alias("gold_of"))
    return looked_up(objs, per, ["gold_of"])


def corrected_and_raw(objs: DataFrame, t: Thresholds | None = None, *, contact: DataFrame | None = None) -> DataFrame:
    """Every ordered pair judged both ways in one projection: predicates and flags without the corrections, kept and kept_flags with them."""
    t = t or Thresholds()
    pairs = object_pairs(with_evidence(objs, contact, t))
    return judged(judged(pairs, t, True).withColumnsRenamed({"predicates": "kept", "flags": "kept_flags"}), t, False)


def with_and_without_masks(objs: DataFrame, contact: DataFrame, t: Thresholds | None = None) -> DataFrame:
    """Every ordered pair judged by masks (masked) and by boxes alone (boxed) in one projection."""
    t = t or Thresholds()
    by_masks = judged(object_pairs(with_evidence(objs, contact, t)), t).select("*", F.col("predicates").alias("masked"))
    no_masks = {c: F.lit(None).cast("map<int,double>") for c in ("a_touches", "b_touches")}
    return judged(by_masks.withColumns(no_masks), t).withColumnRenamed("predicates", "boxed")


def fact(objs: DataFrame, gold: DataFrame, t: Thresholds | None = None, *, contact: DataFrame | None = None, correct: bool = True) -> DataFrame:
    """The pair table on which evaluation works: image_id, grp, subj, obj, gap_rel, dist3d, pred, flags, gold, gold_rev.

    Gold, too, is brought to objects (a map from partner to predicates) before pairs are made.
    """
    none = F.array().cast("array<string>")
    scene = evaluate_scene(with_gold(objs, gold), t or Thresholds(), correct=correct, contact=contact)
    return fact_rows(scene, F.coalesce(F.col("a_gold_of")[F.col("b_idx")], none), F.coalesce(F.col("b_gold_of")[F.col("a_idx")], none))


def fact_rows(scene: DataFrame, gold: Column, gold_rev: Column) -> DataFrame:
    """The columns of fact() from judged pairs and what is stated of them either way."""
    dist = (F.col("a_cx") - F.col("b_cx"), F.col("a_cy") - F.col("b_cy"), F.col("a_depth") - F.col("b_depth"))
    return scene.select(
        "image_id",
        F.col("a_grp").alias("grp"),
        F.col("a_idx").alias("subj"),
        F.col("b_idx").alias("obj"),
        "gap_rel",
        F.sqrt(dist[0] * dist[0] + dist[1] * dist[1] + dist[2] * dist[2]).alias("dist3d"),
        F.col("predicates").alias("pred"),
        "flags",
        gold.alias("gold"),
        gold_rev.alias("gold_rev"),
    )
