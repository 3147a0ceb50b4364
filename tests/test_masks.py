"""Masks as runs against the same measures on arrays of pixels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenegrain.functions.geometry import Box, num
from scenegrain.operators import masks as M
from scenegrain.operators import perception as P
from scenegrain.operators import rules

H, W = 24, 30


def runs_of(mask):
    out = []
    for row in range(mask.shape[0]):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask[row].astype(int), [0]])))
        out += [(row, int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return out


def drawn(rng):
    """An empty mask, a block, blocks with holes, or noise."""
    mask, kind = np.zeros((H, W), bool), rng.randrange(6)
    if kind == 0:
        return mask
    y, x = rng.randrange(H), rng.randrange(W)
    mask[y : y + rng.randint(1, 9), x : x + rng.randint(1, 12)] = True
    if kind == 1:
        mask[H - 1, : rng.randint(1, W)] = True  # on the last row, where contact is with the row itself
    if kind > 2:
        mask &= np.array([[rng.random() < (0.7 if kind == 3 else 0.95) for _ in range(W)] for _ in range(H)])
    return mask


@pytest.fixture(scope="module")
def scenes():
    rng = random.Random(11)
    return [[drawn(rng) for _ in range(rng.randint(1, 6))] for _ in range(60)]


@pytest.fixture(scope="module")
def table(spark, scenes):
    rows = [(s, i, runs_of(m)) for s, some in enumerate(scenes) for i, m in enumerate(some)]
    return spark.createDataFrame(rows, f"image_id int, idx int, runs {M.RUNS}").cache()


def test_centre_and_depth(table, scenes):
    surface = np.add.outer(np.arange(H) * 3, np.arange(W) * 7) % 11 / 10
    at = lambda row, col: (col * 7 + row * 3) % 11 / num(10)
    overall = float(np.median(surface))
    c = M.centroid(F.col("runs"), H, W)
    got = table.select("image_id", "idx", M.area(F.col("runs")).alias("area"), c["cx"].alias("cx"), c["cy"].alias("cy"), M.depth(F.col("runs"), at, F.lit(overall)).alias("z"))
    for r in got.collect():
        mask = scenes[r.image_id][r.idx]
        ys, xs = np.nonzero(mask)
        assert r.area == mask.sum()
        if len(xs):
            assert (r.cx, r.cy, r.z) == pytest.approx((xs.mean() / W, ys.mean() / H, np.median(surface[mask])))
        else:
            assert (r.cx, r.cy, r.z) == (0.5, 0.5, overall)


def test_contact_of_every_pair(table, scenes):
    want = {(s, *k): v for s, some in enumerate(scenes) for k, v in P.pair_contacts(some).items()}
    assert {(r.image_id, r.i, r.j): r.frac for r in M.pair_contacts(table, H).collect()} == want


def test_surfaces_raise_what_rests_on_them(spark, table, scenes):
    rng = random.Random(2)
    surfaces = {s: [drawn(rng) for _ in range(2)] + [some[0]] for s, some in enumerate(scenes)}  # the last is an object's own region
    rows = spark.createDataFrame([(s, runs_of(m)) for s, some in surfaces.items() for m in some], f"image_id int, runs {M.RUNS}")
    want = set()
    for s, some in enumerate(scenes):
        for i, m in enumerate(some):
            if any(P.bottom_contact(m, b) >= 0.6 and (m & b).sum() <= 0.8 * max(m.sum(), 1) for b in surfaces[s]):
                want.add((s, i))
    assert want and {(r.image_id, r.idx) for r in M.elevated(table, rows, H).collect()} == want


def test_boxes_are_rounded_half_to_even(spark):
    boxes = [(0.05, 0.1, 0.45, 0.5), (0.25, 0.15, 0.35, 0.95), (0.3, 0.3, 0.3, 0.6), (-0.2, -0.2, 1.4, 1.4)]
    rows = spark.createDataFrame(boxes, "x1 double, y1 double, x2 double, y2 double").select(M.rect(Box.of(), 10, 10).alias("runs")).collect()
    for box, r in zip(boxes, rows, strict=True):
        clipped = [min(1.0, max(0.0, v)) for v in box]
        assert [tuple(q) for q in r.runs] == runs_of(P.rect_mask(clipped, 10, 10))


def test_raised_objects_are_not_ordered_by_their_bottoms(spark):
    """Two boxes at one depth, one lower in the picture: in front, unless a surface raises it."""
    objs = spark.createDataFrame([(1, 0, "box", 0.1, 0.1, 0.3, 0.5, 0.2, 0.3, 0.5), (1, 1, "cube", 0.6, 0.1, 0.8, 0.7, 0.7, 0.4, 0.5)], "image_id int, idx int, label string, x1 double, y1 double, x2 double, y2 double, cx double, cy double, depth double")
    masks = objs.withColumn("runs", M.rect(Box.of(), 50, 50)).select("image_id", "idx", "runs")
    slab = spark.createDataFrame([(1, [(r, 28, 42) for r in range(36, 45)])], f"image_id int, runs {M.RUNS}")
    contact = M.pair_contacts(masks, 50)
    said = lambda extra: {p for r in rules.evaluate_scene(objs, contact=contact, extra_elevated=extra).where("a_idx = 1").collect() for p in r.predicates}
    assert "in front of" in said(None) and "in front of" not in said(M.elevated(masks, slab, 50))


def test_boxes_are_drawn_at_once_as_one_by_one(spark):
    boxes = [(i, 0.013 * i, 0.5 - 0.02 * i, 0.013 * i + 0.05 * (i % 4), 0.7, 0.3) for i in range(20)] + [(20, None, 0.1, 0.4, 0.4, 0.5), (21, 0.9, 0.9, 1.2, 1.3, 0.7)]
    objs = spark.createDataFrame(boxes, "idx int, x1 double, y1 double, x2 double, y2 double, depth double").withColumn("image_id", F.lit(1))
    drawn = M.drawn(objs, ["x1", "y1", "x2", "y2"], 50, 50)
    assert drawn.withColumn("other", M.rect(Box.of(), 50, 50)).where("runs <> other").count() == 0
    at = lambda row, col: F.col("depth") + (col * 7 + row * 3) % 11 / 100
    one = {r["idx"]: r["z"] for r in drawn.select("idx", M.depth(F.col("runs"), at, F.col("depth")).alias("z")).collect()}
    many = M.with_depth(drawn, lambda batch, of, row, col: batch.column("depth").to_numpy()[of] + (col * 7 + row * 3) % 11 / 100, "depth", "z")
    assert {r["idx"]: r["z"] for r in many.collect()} == one


def test_whole_scenes_say_what_their_masks_say(spark):
    from scenegrain.queries import masks as Q

    small = "/root/testdata/sf0.001"
    both = Q.scenes(spark, small)
    said = M.with_evidence(both, 50)
    masks = both.select("image_id", F.inline("masks"))
    found = {(r[0], r[1], r[2], r[3]) for r in M.pair_contacts(masks, 50).collect()}
    assert {(r[0], *r[1]) for r in said.select("image_id", F.explode("contacts")).collect()} == found and found
    up = {tuple(r) for r in M.elevated(masks, both.select("image_id", F.inline("surfaces")), 50).collect()}
    assert {tuple(r) for r in said.select("image_id", F.explode("raised")).collect()} == up and up
    assert said.columns == ["image_id", "scene", "contacts", "raised"]


def test_masks_are_not_shuffled_and_scenes_are_made_once(spark):
    from scenegrain.queries import masks as Q

    for query in (Q.guarded_scene, Q.surface_guard, Q.mask_contact):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().treeString()
        assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1
