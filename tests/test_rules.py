"""Worked examples of the rules, as one- to three-object scenes, and invariants over random ones."""

import random

import pytest

from scenegrain.operators.rules import evaluate_pairs_once, evaluate_scene
from scenegrain.types import INVERSE, Thresholds

T = Thresholds.profile("test")
SCHEMA = "image_id long, idx int, label string, x1 double, y1 double, x2 double, y2 double, cx double, cy double, depth double"


def obj(idx, box, depth=0.5, label="box", image=0):
    return (image, idx, label, *box, (box[0] + box[2]) / 2, (box[1] + box[3]) / 2, depth)


def scene(spark, objs, contact=None, t=T, **kw):
    df = spark.createDataFrame(objs, SCHEMA)
    c = None if contact is None else spark.createDataFrame([(0, i, j, f) for (i, j), f in contact.items()], "image_id long, i int, j int, frac double")
    return {(r.image_id, r.a_idx, r.b_idx): (r.predicates, r.flags) for r in evaluate_scene(df, t, contact=c, **kw).collect()}


#: Less and more than a threshold by so much.
E = 1e-6


def pile(gap, share, dz=0.0, t=T):
    """A lid whose bottom is `gap` above (negative: below) the top of a crate, of which `share` of the lid's width is over it."""
    crate = (0.25, 0.55, 0.65, 0.95)
    left = 0.65 - 0.125 * share
    return [obj(0, (left, 0.35, left + 0.125, 0.55 - gap), 0.5 - dz), obj(1, crate, 0.5)]


@pytest.mark.parametrize("side", [-1, 1])
def test_support_by_boxes_is_within_the_vertical_gap(spark, side):
    for gap, rests in ((T.on_vertical_gap - E, True), (T.on_vertical_gap + E, False)):
        got = scene(spark, pile(side * gap, 1.0))
        assert ("on" in got[0, 0, 1][0], "under" in got[0, 1, 0][0]) == (rests, rests)
        assert "under" not in got[0, 0, 1][0] and "on" not in got[0, 1, 0][0] and not (rests and "near" in got[0, 0, 1][0])


@pytest.mark.parametrize(("more", "rests"), [(E, True), (-E, False)])
def test_support_by_boxes_needs_the_horizontal_overlap(spark, more, rests):
    assert ("on" in scene(spark, pile(0.0, T.on_horizontal_overlap + more))[0, 0, 1][0]) == rests


@pytest.mark.parametrize("dz", [T.on_depth_eps - E, T.on_depth_eps + E, -T.on_depth_eps + E, -T.on_depth_eps - E])
def test_support_needs_one_depth(spark, dz):
    assert ("on" in scene(spark, pile(0.0, 1.0, dz))[0, 0, 1][0]) == (abs(dz) < T.on_depth_eps)


@pytest.mark.parametrize("shift", [0.0, T.lateral_center_eps - E, T.lateral_center_eps + E])
def test_lateral_band(spark, shift):
    got = scene(spark, [obj(0, (0.2, 0.1, 0.3, 0.2)), obj(1, (0.2 + shift, 0.7, 0.3 + shift, 0.8))])
    beyond = shift > T.lateral_center_eps
    assert ("to the left of" in got[0, 0, 1][0], "to the right of" in got[0, 1, 0][0]) == (beyond, beyond)
    assert ("lateral_ambiguous" in got[0, 0, 1][1]) == (not beyond)


@pytest.mark.parametrize(("size", "close"), [(0.12, True), (0.01, False)])
def test_near_is_relative_to_size(spark, size, close):
    """Two squares with corners at the same places: large ones are near each other, small ones aren't."""
    got = scene(spark, [obj(i, (x, 0.4, x + size, 0.4 + size)) for i, x in enumerate((0.05, 0.30))])
    assert ("near" in got[0, 0, 1][0], "near" in got[0, 1, 0][0]) == (close, close)


def floor(bottoms, z=0.42, shelf=0.93):
    """Things that stand on the floor with these bottoms, at one depth, and last one on a shelf far behind."""
    standing = [obj(i, (0.15 + 0.3 * i, b - 0.15, 0.25 + 0.3 * i, b), z) for i, b in enumerate(bottoms)]
    return [*standing, obj(len(bottoms), (0.85, 0.05, 0.95, 0.15), shelf)]


WEAK = {(2, 1): T.on_contact_min / 10}


@pytest.mark.parametrize("drop", [T.plane_band + E, T.plane_band - E, -T.plane_band - E])
def test_plane_fallback_beyond_its_band(spark, drop):
    got = scene(spark, floor([0.5 + drop, 0.5]), WEAK)
    want = ("in front of", "behind") if drop > T.plane_band else ("behind", "in front of") if drop < -T.plane_band else (None, None)
    for pair, p in zip(((0, 0, 1), (0, 1, 0)), want, strict=True):
        assert (p in got[pair][0]) if p else "depth_ambiguous" in got[pair][1]


def test_no_fallback_without_masks_or_when_elevated(spark):
    objs = floor([0.5 + 2 * T.plane_band, 0.5])
    extra = spark.createDataFrame([(0, 0)], "image_id long, idx int")
    for got in (scene(spark, objs), scene(spark, objs, {(1, 2): T.on_contact_min}), scene(spark, objs, WEAK, extra_elevated=extra)):
        assert "depth_ambiguous" in got[0, 0, 1][1] and not {"in front of", "behind"} & set(got[0, 0, 1][0])
    assert "in front of" in scene(spark, objs, {(1, 2): T.on_contact_min - E})[0, 0, 1][0]


def test_people_hold_but_do_not_support(spark):
    objs = [obj(0, (0.52, 0.22, 0.58, 0.41), label="remote"), obj(1, (0.35, 0.37, 0.71, 0.88), label="human")]
    assert not {"on", "under"} & set(scene(spark, objs, {(0, 1): 0.9})[0, 0, 1][0])
    assert "on" in scene(spark, objs, {(0, 1): 0.9}, correct=False)[0, 0, 1][0]


@pytest.mark.parametrize(("frac", "on"), [(0.85, True), (0.8499, False)])
def test_contact_threshold_is_inclusive(spark, frac, on):
    objs = [obj(0, (0.52, 0.22, 0.58, 0.41)), obj(1, (0.35, 0.37, 0.71, 0.88))]
    assert ("on" in scene(spark, objs, {(0, 1): frac}, t=Thresholds())[0, 0, 1][0]) == on


def test_single_object_has_no_pairs(spark):
    assert scene(spark, [obj(0, (0.1, 0.1, 0.2, 0.2))]) == {}


def test_invariants_of_random_scenes(spark):
    rng = random.Random(42)
    objs = []
    for image in range(500):
        for idx in range(rng.randint(1, 4)):
            x, y, w, h = rng.random() * 0.8, rng.random() * 0.8, 0.02 + rng.random() * 0.2, 0.02 + rng.random() * 0.2
            objs.append(obj(idx, (x, y, x + w, y + h), rng.random(), rng.choice(["box", "human", "cube"]), image))
    got = scene(spark, objs)
    for (image, a, b), (p, _) in got.items():
        assert len({"on", "under"} & set(p)) < 2 and len({"to the left of", "to the right of"} & set(p)) < 2 and len({"in front of", "behind"} & set(p)) < 2
        assert not ({"on", "under"} & set(p) and "near" in p)
        assert sorted(INVERSE[k] for k in p) == sorted(got[image, b, a][0])
    once = evaluate_pairs_once(spark.createDataFrame(objs, SCHEMA), T).collect()
    assert {(r.image_id, r.subj, r.obj): (r.predicates, r.flags) for r in once} == got


def test_profiles():
    assert Thresholds.profile().on_contact_min == 0.85 and T.on_contact_min == 0.60
    assert Thresholds.from_config({"predicates": {"near_T": 1.0}}).near_T == 1.0 and Thresholds.from_config({}).on_contact_min == 0.60
