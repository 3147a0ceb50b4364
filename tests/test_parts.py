"""Sequences, text, perception, readers, writers and streams."""

import json
import math
import time

import numpy as np
import pytest

from scenegrain.functions import stats, text
from scenegrain.operators import perception as P
from scenegrain.operators import sequence as S
from scenegrain.plans import sinks
from scenegrain.sources import fixtures, readers
from scenegrain.streaming import stateful

# sequences


def drift(values):
    return [(1, i, [float(v)] * 3) for i, v in enumerate(values)]


def segs(spark, values, tau, **kw):
    df = spark.createDataFrame(drift(values), "clip long, ord int, sig array<double>")
    return [r.seg for r in S.segments(df, tau, **kw).orderBy("ord").collect()]


def test_drift_accumulates_against_the_anchor(spark):
    assert segs(spark, [0, 1, 2, 3, 4, 5, 6], 2.0) == [0, 0, 0, 1, 1, 1, 2]


def test_short_segments_are_folded(spark):
    values = [0] * 8 + [50] + [0] * 8
    assert segs(spark, values, 5.0) == [0] * 8 + [1] + [2] * 8
    assert segs(spark, values, 5.0, min_len=2) == [0] * 9 + [1] * 8
    assert segs(spark, [9, 0, 0, 0], 5.0, min_len=2) == [0, 1, 1, 1]


def test_keyframe_is_the_most_typical(spark):
    df = spark.createDataFrame(drift([0, 1, 1, 1, 2.9]), "clip long, ord int, sig array<double>")
    got = S.keyframes(df, S.segments(df, 5.0)).collect()
    assert [(r.start, r.end, r.keyframe) for r in got] == [(0, 4, 1)]


@pytest.mark.parametrize(("tol", "recall"), [(2, 0.5), (6, 1.0)])
def test_boundary_tolerance(spark, tol, recall):
    at = lambda v: spark.createDataFrame([(1, x) for x in v], "clip long, at int")
    assert S.boundary_scores(at([0, 10]), at([0, 15]), tol).first().recall == recall


def brute_greedy(rows):
    used_i, used_j, out = set(), set(), []
    for v, i, j in sorted(((r[2], r[0], r[1]) for r in rows), reverse=True):
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            out.append((i, j))
    return sorted(out)


def test_greedy_match(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), int(j), float(rng.integers(0, 6)) / 5) for i in range(7) for j in range(7) if rng.random() < 0.6]
    df = spark.createDataFrame([(1, *r) for r in rows], "g int, i int, j int, v double")
    assert sorted((r.i, r.j) for r in S.greedy_match(df, ["g"]).collect()) == brute_greedy(rows)


DETS = [(1, 0, 0, "cup", 0.9, 0.0, 0.0, 1.0, 1.0), (1, 1, 0, "cup", 0.9, 0.1, 0.0, 1.1, 1.0), (1, 1, 1, "box", 0.8, 0.1, 0.0, 1.1, 1.0), (1, 3, 0, "cup", 0.9, 0.1, 0.0, 1.1, 1.0), (1, 4, 0, "cup", 0.5, 0.1, 0.0, 1.1, 1.0), (1, 4, 1, "cup", 0.9, 0.12, 0.0, 1.12, 1.0)]
DET_SCHEMA = "clip long, ord int, det int, label string, score double, x1 double, y1 double, x2 double, y2 double"


def test_tracks_end_with_a_missing_frame(spark):
    got = {(r.ord, r.det): r.track for r in S.tracked(spark.createDataFrame(DETS, DET_SCHEMA)).collect()}
    assert got == {(0, 0): 0, (1, 0): 0, (1, 1): 1, (3, 0): 2, (4, 1): 2, (4, 0): 3}


def test_majority_vote(spark):
    said = spark.createDataFrame([(1, o, 0, "near", 1) for o in (0, 1, 3, 4)], "clip long, ord int, s int, p string, o int")
    visible = spark.createDataFrame([(1, o, t) for o in range(8) for t in (0, 1)], "clip long, ord int, track int")
    assert sorted(r.ord for r in S.majority_vote(said, visible).collect()) == [0, 1, 2, 3]  # at 4, two of five frames


# statistics and text


def test_intervals(spark):
    df = spark.createDataFrame([(0, 0), (5, 10), (10, 10)], "k long, n long")
    lo, hi = stats.wilson_open(df.k, df.n)
    clo, chi = stats.wilson_clamped(df.k, df.n)
    rows = df.select("k", lo.alias("lo"), hi.alias("hi"), clo.alias("clo"), chi.alias("chi"), stats.clopper_pearson("k", "n").alias("cp")).orderBy("n", "k").collect()
    assert (rows[0].lo, rows[0].hi, rows[0].clo, rows[0].chi) == (0, 1, 0, 0)
    assert math.isclose(rows[1].lo, 0.2366, abs_tol=1e-4) and rows[2].chi <= 1 and rows[2].cp.hi == 1.0
    assert math.isclose(rows[1].cp.lo, 0.1871, abs_tol=1e-4) and math.isclose(rows[1].cp.hi, 0.8129, abs_tol=1e-4)


def test_exact_intervals_of_the_counts_themselves(spark):
    from math import comb

    cases = [(1, 7), (39, 60), (200, 900), (900, 900)]
    df = spark.createDataFrame([*cases, (300_000, 1_000_000), (0, 5_000_000)], "k long, n long")
    got = {(r.k, r.n): r.c for r in df.select("k", "n", stats.clopper_pearson("k", "n").alias("c")).collect()}
    for k, n in cases:
        tail = lambda p, i: math.fsum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(i, n + 1))  # noqa: B023, E731
        assert math.isclose(tail(got[k, n].lo, k), 0.025, abs_tol=1e-9)
        assert got[k, n].hi == 1 if k == n else math.isclose(1 - tail(got[k, n].hi, k + 1), 0.025, abs_tol=1e-9)
    c = got[300_000, 1_000_000]
    assert math.isclose(c.lo, 0.299102, abs_tol=2e-6) and math.isclose(c.hi, 0.300899, abs_tol=2e-6)
    assert got[0, 5_000_000].lo == 0 and math.isclose(got[0, 5_000_000].hi, 1 - 0.025 ** (1 / 5_000_000), rel_tol=1e-6)


def test_exact_intervals_query(spark, small_dir):
    from scenegrain.queries import text

    counts = {r.source: (r.q, r.n) for r in text.by_source(spark, small_dir).collect()}
    df = spark.createDataFrame([(s, q, n) for s, (q, n) in counts.items()], "source string, k long, n long")
    want = df.select("source", stats.clopper_pearson("k", "n").alias("c")).collect()
    assert {(r.source, r.lo, r.hi) for r in text.clopper_pearson(spark, small_dir).collect()} == {(r.source, round(r.c.lo, 6), round(r.c.hi, 6)) for r in want}


def test_sign_test(spark):
    df = spark.createDataFrame([(0, 0), (1, 5), (3, 3)], "x int, y int")
    got = [r.p for r in df.select(stats.mcnemar(df.x, df.y).alias("p")).collect()]
    assert got[0] == 1 and math.isclose(got[1], 2 * 7 / 64) and got[2] == 1


def test_sign_test_of_large_counts(spark):
    from fractions import Fraction
    from math import comb

    cases = [(99, 0), (0, 99), (470, 530), (480, 521), (700, 620), (5000, 5200), (1000, 6000)]
    df = spark.createDataFrame(cases, "x long, y long")
    for (x, y), r in zip(cases, df.select(stats.mcnemar(df.x, df.y).alias("p")).collect(), strict=True):
        want = float(min(Fraction(1), Fraction(2 * sum(comb(x + y, i) for i in range(min(x, y) + 1)), 2 ** (x + y))))
        assert math.isclose(r.p, want, rel_tol=1e-8, abs_tol=1e-300), (x, y)


def said(*relations, before="", after=""):
    """A reply that states these relations, (subject, predicate, object) each, None for a missing key."""
    records = [{k: v for k, v in zip("spo", r, strict=True) if v is not None} for r in relations]
    return before + json.dumps({"relations": records}) + after


REPLIES = [
    (said((2, "behind", 1), (1, "under", 2)), [(2, "behind", 1), (1, "under", 2)], []),
    (said((1, "near", 0), before="```\n", after="\n```"), [(1, "near", 0)], []),
    (said(("2", "In_Front_Of", "0"), before="My answer follows.\n", after="\nThat is all."), [(2, "in front of", 0)], []),
    (said((1, "inside", 2), (2, "touching", 1), (2, "on", 1)), [(2, "on", 1)], ["unknown predicate"] * 2),
    (said((3, "near", 2), (0, "behind", 0), (-1, "on", 1)), [], ["index out of range or self-pair"] * 3),
    (said((2, None, 0), (2, "under", None), (2, "under", 0)), [(2, "under", 0)], ["malformed record", "malformed record"]),
    (said(), [], []),
    ("The picture shows three things on a table.", [], ["no JSON object"]),
    ('{"relations": [{"s": 1, "p": }]}', [], ["unreadable JSON"]),
    ('{"relations":[{"s":0,"p":"on","o":1},"junk",{"s":1,"p":"near","o":2}]}', [(0, "on", 1), (1, "near", 2)], ["malformed record"]),
    ('{"relations":[{"s":0,"p":"on","o":1},null,[1,2],7]}', [(0, "on", 1)], ["malformed record"] * 3),
    ('{"relations":[{"s":1.9,"p":"on","o":0},{"s":true,"p":"on","o":2},{"s":" 2 ","p":"on","o":0},{"s":"1.9","p":"on","o":0},{"s":null,"p":"on","o":0},{"s":[1],"p":"on","o":0}]}', [(1, "on", 0), (1, "on", 2), (2, "on", 0)], ["malformed record"] * 3),
    ('{"relations":[{"s":0,"p":null,"o":1},{"s":0,"p":5,"o":1},{"s":0,"p":"ON","o":1,"q":{}},{"s":99999999999,"p":"on","o":1}]}', [(0, "on", 1)], ["unknown predicate"] * 2 + ["index out of range or self-pair"]),
    ('{"relations": "on"}', [], ["relations is no list"]),
    ('{"relations": null}', [], ["relations is no list"]),
    ('{"others": [1]}', [], []),
    ("", [], ["no JSON object"]),
    (None, [], ["no JSON object"]),
]


def test_replies(spark):
    df = spark.createDataFrame([(i, r[0], 3) for i, r in enumerate(REPLIES)], "i int, reply string, n int")
    rows = text.parsed_relations(df, "reply", "n").collect()
    for i, (_, good, bad) in enumerate(REPLIES):
        assert [(r.s, r.p, r.o) for r in rows if r.i == i and r.problem is None] == good
        assert [r.problem for r in rows if r.i == i and r.problem is not None] == bad


def test_markdown_tables(spark):
    doc = ["| a | **b** |", "|---|:-:|", "| x | `1` |", "|  y  |  |", "text | with pipe", "  | a | b | c |", "| x | 2 | 3 |", "", "| lone |", None, "| | |", "| p | q |"]
    lines = spark.createDataFrame([("d", i, v) for i, v in enumerate(doc)] + [("e", 0, "no table")], "doc string, at int, value string")
    rows = text.markdown_tables(lines)
    assert sorted((r.tab, r.row, r.cells) for r in rows.collect()) == [(1, 0, ["a", "b"]), (1, 1, ["x", "1"]), (1, 2, ["y", ""]), (2, 0, ["a", "b", "c"]), (2, 1, ["x", "2", "3"]), (3, 0, ["lone"]), (4, 0, ["p", "q"])]
    cells = text.table_cells(rows)
    assert sorted((r["head"], r.label, r.col, r.cell) for r in cells.where("tab = 1").collect()) == [("a | b", "x", 0, "x"), ("a | b", "x", 1, "1"), ("a | b", "y", 0, "y"), ("a | b", "y", 1, "")]
    other = text.table_cells(text.markdown_tables(spark.createDataFrame([("g", i, v) for i, v in enumerate(["|a|b|", "|x|1.0|", "|z|9|"])], "doc string, at int, value string")))
    assert [tuple(r) for r in text.table_drift(cells, other).collect()] == [("d", "a | b", "x", 1, "1", "1.0")]


def test_plans(spark):
    plan = "To pick up box0 do this:\n1. Remove cube1 near lamp2\n2. Pick up box0"
    df = spark.createDataFrame([(plan, "box0", "cube1", ["box0", "cube1"])], "reply string, target string, must_clear string, allowed array<string>")
    r = text.scored_plan(df).first()
    assert (r.n_steps, r.clear_step, r.grasp_step, r.clears_first, r.invented) == (2, 0, 1, True, ["lamp2"])


# perception


def test_contact_of_block_masks():
    block = lambda y1, y2, x1, x2: np.pad(np.ones((y2 - y1, x2 - x1), bool), ((y1, 100 - y2), (x1, 100 - x2)))
    top, base, aside = block(20, 50, 30, 60), block(50, 90, 20, 80), block(20, 50, 0, 10)
    assert P.bottom_contact(top, base) == 1.0 and P.bottom_contact(base, top) == 0.0 and P.bottom_contact(top, aside) == 0.0
    assert P.bottom_contact(block(30, 40, 40, 50), block(20, 90, 20, 80)) == 1.0
    assert P.pair_contacts([top, base, aside]) == {(0, 1): 1.0}
    assert P.bottom_contact(np.zeros((100, 100), bool), base) == 0.0


def test_masks_depth_and_lift():
    assert P.rect_mask((0.1, 0.2, 0.3, 0.4), 100, 100).sum() == 400
    assert P.nearness_to_depth(np.array([1.0, 3.0])).tolist() == [1.0, 0.0] and P.nearness_to_depth(np.array([2.0, 2.0])).tolist() == [0.0, 0.0]
    depth = np.tile(np.where(np.arange(100) < 50, 0.1, 0.8), (100, 1))
    cx, cy, z, _ = P.lift(np.zeros((100, 100), bool), depth, (0.1, 0.4, 0.3, 0.6))
    assert abs(cx - 0.2) < 0.01 and abs(cy - 0.5) < 0.01 and z == 0.1
    thumb = P.thumbnail(np.arange(480 * 640 * 3).reshape(480, 640, 3) % 251)
    assert thumb.shape == (48, 64) and abs(float(thumb.mean())) < 1e-3


def test_detectors(spark):
    class Fake:
        def detect(self, rgb):
            return [{"box_px": [-5, 0, 50, 10], "label": "mug", "score": 0.12345}, {"box_px": [0, 0, 1, 1], "label": "sky"}]

    assert isinstance(Fake(), P.Detector)
    P.register("fake", lambda config: Fake())
    assert isinstance(P.detector_from({"type": "fake"}), Fake)
    with pytest.raises(ValueError, match="unknown detector"):
        P.detector_from({"kind": "none"})
    seen = []
    for kind in ("yolo", "grounding_dino"):
        P.register(kind, lambda config, kind=kind: seen.append((kind, config)) or Fake())
    P.detector_from({"detector": {"backend": "yolov10m", "conf_threshold": 0.4, "iou_nms": 0.5, "weights": "w"}})
    P.detector_from({"detector": {"kind": "yolo", "threshold": 0.3}})
    P.detector_from({})
    assert seen == [("yolo", {"threshold": 0.4, "weights": "w"}), ("yolo", {"threshold": 0.3}), ("grounding_dino", {})]
    df = spark.createDataFrame([("a.png", bytearray(b"x"))], "path string, content binary")
    got = P.detect(df, Fake, lambda b: np.zeros((20, 30, 3)), {"mug": "cup"}).collect()
    assert [(r.label, r.score, r.x1, r.x2, r.y2) for r in got] == [("cup", 0.1234, 0.0, 30.0, 10.0)] or got[0].score == 0.1235


# files


def test_annotation_files(spark, tmp_path):
    folder = tmp_path / "group_1"
    folder.mkdir()
    doc = {"width": 1024, "height": 512, "boxes_1024": [[512, 256, 100, 100], [100, 100, 50, 50], [1, 1, 1, 1]], "labels": [3, 99], "relationships": [[0, 1], [1, 0], [0, 1]], "predicates": [10, 1, 9]}
    (folder / "000001.json").write_text(json.dumps(doc))
    (folder / "000002.json").write_text(json.dumps(doc | {"boxes_1024": [], "labels": []}))
    (folder / "labels.json").write_text(json.dumps({"box": 3}))
    objects, relations, total = readers.annotations(spark, str(tmp_path))
    assert total == 2
    assert [(r.image_id, r.idx, r.label) for r in objects.orderBy("idx").collect()] == [("group_1/000001", 0, "box"), ("group_1/000001", 1, "label_99")]
    assert [(r.subj, r.obj, r.predicate) for r in relations.orderBy("predicate").collect()] == [(0, 1, "near"), (0, 1, "on")]
    assert [tuple(r) for r in readers.vocabulary(spark, str(tmp_path)).collect()] == [("box", 3)]


def test_side_files(spark, tmp_path):
    for kind, name, value in (("c", "000001", {"0-1": 0.5}), ("c", "000002", {}), ("d", "000001", {"detections": [{"box_px": [-1, 0, 99, 10], "label": "cup"}]}), ("d", "000002", [{"box_px": [0, 0, 1, 1], "label": "box", "score": 0.5}])):
        (tmp_path / kind / "g").mkdir(parents=True, exist_ok=True)
        (tmp_path / kind / "g" / f"{name}.json").write_text(json.dumps(value))
    assert [tuple(r) for r in readers.contact(spark, f"{tmp_path}/c").collect()] == [("g/000001", 0, 1, 0.5)]
    assert readers.has_masks(spark, f"{tmp_path}/c").count() == 2
    got = readers.detections(spark, f"{tmp_path}/d", 30, 20).orderBy("image_id").collect()
    assert [(r.label, r.score, r.x1, r.x2) for r in got] == [("cup", 1.0, 0.0, 30.0), ("box", 0.5, 0.0, 1.0)]


def test_writers_round_trip(spark, small_dir, tmp_path):
    from scenegrain.operators import rules
    from scenegrain.queries.scene import as_csv_rows

    objs = fixtures.objects(spark, small_dir).where("image_id < 60").cache()
    contact, gold = fixtures.contact(objs), fixtures.gold(objs)
    rows = as_csv_rows(rules.fact(objs, gold, contact=contact))
    sinks.write_pairs_csv(rows, f"{tmp_path}/pairs")
    back = readers.pairs_csv(spark, f"{tmp_path}/pairs")
    key = lambda df: sorted((str(r.image_id), r.subj, r.obj, ";".join(r.pred) if isinstance(r.pred, list) else r.pred, ";".join(r.gold) if isinstance(r.gold, list) else r.gold) for r in df.collect())
    assert key(back) == key(rows) and back.where("size(gold) = 0").count() > 0
    docs = {r.image_id: json.loads(r.value) for r in sinks.annotations(objs, rules.evaluate_scene(objs, contact=contact)).collect()}
    assert sum(len(d["labels"]) for d in docs.values()) == objs.count()
    assert all(len(d["relationships"]) == len(d["predicates"]) and len(d["attribute"]) == len(d["labels"]) for d in docs.values())
    sinks.write_yolo(objs, f"{tmp_path}/yolo")
    assert spark.read.text(f"{tmp_path}/yolo").count() == objs.count()
    triplets = gold.select("image_id", "subj", "obj", "predicate")
    export = sinks.relation_export(objs, triplets)
    assert export["rel_annotations"].count() == triplets.count()
    ids = export["images"].toPandas()
    assert all(sorted(g["id"]) == list(range(len(g))) for _, g in ids.groupby("split"))
    claims = triplets.selectExpr("image_id", "subj", "predicate", "obj", "'tool' as kind")
    sheet, key_ = sinks.audit_pack(claims)
    assert "kind" not in sheet.columns and sheet.join(key_, "id").count() == claims.count()


# streams


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run_stream(spark, make, batches, schema, tmp_path, name):
    source = f"{tmp_path}/{name}-in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}-c").trigger(availableNow=True).start()
    end = time.time() + 60  # a stream with timers goes on without data: it is stopped a batch after the last rows
    total = sum(map(len, batches))
    while query.isActive and time.time() < end:
        seen = [p["numInputRows"] for p in query.recentProgress]
        if sum(seen) >= total and (not seen[-1] or len(seen) > 2 * len(batches)):
            break
        time.sleep(0.1)
    query.stop()
    return spark.table(name)


def test_streams_equal_batch(spark, tmp_path, rocks):
    batches = [[d for d in DETS if d[1] <= 1], [d for d in DETS if d[1] > 1]]
    got = run_stream(spark, stateful.tracked_stream, batches, DET_SCHEMA, tmp_path, "tracks")
    want = S.tracked(spark.createDataFrame(DETS, DET_SCHEMA))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    frames = drift([0, 1, 2, 3, 4, 5, 6])
    schema = "clip long, ord int, sig array<double>"
    got = run_stream(spark, lambda s: stateful.segmented_stream(s, 2.0), [frames[:3], frames[3:]], schema, tmp_path, "segs")
    assert [r.seg for r in got.orderBy("ord").collect()] == [0, 0, 0, 1, 1, 1, 2]


FRAME_SCHEMA = "clip long, ord int, tracks array<int>, said array<struct<s:int,p:string,o:int>>, last boolean"


def voting_frames(spark, small_dir):
    """What seen_tracks() shows and states, a row a frame."""
    from pyspark.sql import functions as F

    from scenegrain.queries import sequence

    said, visible = sequence.seen_tracks(spark, small_dir)
    clips = [r.clip for r in visible.groupBy("clip").count().orderBy(F.desc("count"), "clip").limit(6).collect()]
    said, visible = (x.where(F.col("clip").isin(clips)) for x in (said, visible))
    shown = visible.groupBy("clip", "ord").agg(F.collect_list("track").alias("tracks"))
    stated = said.groupBy("clip", "ord").agg(F.collect_list(F.struct("s", "p", "o")).alias("said"))
    ends = visible.groupBy("clip").agg(F.max("ord").alias("end"))
    rows = shown.join(stated, ["clip", "ord"], "left").join(ends, "clip").collect()
    return [(r.clip, r.ord, r.tracks, [tuple(t) for t in r.said or []], r.ord == r.end) for r in sorted(rows, key=lambda r: (r.ord, r.clip))], said, visible


def test_votes_as_frames_come_are_those_of_the_whole_clip(spark, small_dir, tmp_path, rocks):
    rows, said, visible = voting_frames(spark, small_dir)
    third = len(rows) // 3
    batches = [rows[:third], rows[max(0, third - 5) : 2 * third], rows[2 * third :]]  # some frames come twice
    got = run_stream(spark, stateful.voted_stream, batches, FRAME_SCHEMA, tmp_path, "votes")
    want = S.majority_vote(said, visible)
    assert want.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("clip", "ord", "s", "p", "o").collect()))


def test_votes_of_a_silent_clip_go_out_by_the_timer(spark, tmp_path, rocks):
    near = [(1, "near", 2)]
    batches = [[(1, i, [1, 2], near if i != 2 else [], False) for i in range(5)], [(2, 0, [1], [], False)], [(2, 1, [1], [], False)]]
    got = run_stream(spark, lambda s: stateful.voted_stream(s, patience=0), batches, FRAME_SCHEMA, tmp_path, "silent")
    assert sorted((r.clip, r.ord) for r in got.collect()) == [(1, i) for i in range(5)]


def test_scenes_go_out_whole_and_once(spark, tmp_path, rocks):
    schema = "scene long, condition string, model string, reply string, parsed boolean"
    row = lambda scene, c, model="m", reply="y", parsed=True: (scene, c, model, reply, parsed)
    batches = [
        [row(1, "A"), row(1, "B", reply="??", parsed=False), row(2, "A"), row(2, "B"), row(2, "C"), row(3, "A"), row(4, "A"), row(4, "B", "other"), row(4, "C")],
        [row(1, "B", reply="n"), row(1, "C"), row(2, "A", reply="changed"), row(2, "B"), row(2, "C"), row(1, "D")],
        [row(4, "B", reply="late"), row(2, "A")],
    ]
    got = run_stream(spark, lambda s: stateful.whole_scenes(s, ["A", "B", "C"]), batches, schema, tmp_path, "scenes")
    assert sorted((r.scene, r.condition, r.reply) for r in got.collect()) == [(1, "A", "y"), (1, "B", "n"), (1, "C", "y"), (2, "A", "y"), (2, "B", "y"), (2, "C", "y"), (4, "A", "y"), (4, "B", "late"), (4, "C", "y")]
    patient = run_stream(spark, lambda s: stateful.whole_scenes(s, ["A", "B"], patience=0), [[row(1, "A")], [row(2, "A")], [row(1, "B")], [row(1, "A")]], schema, tmp_path, "dropped")
    assert sorted((r.scene, r.condition) for r in patient.collect()) in ([], [(1, "A"), (1, "B")])  # the first answer was dropped; the last two are whole if they come in time


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    log = f"{tmp_path}/log"
    schema = spark.createDataFrame([], "id long, verdict string, parsed boolean").schema
    write = stateful.commit_batch(log)
    assert stateful.committed(spark, log, schema).count() == 0
    first = spark.createDataFrame([(1, "y", True), (2, "?", False)], schema)
    write(first, 0)
    write(first, 0)
    second = spark.createDataFrame([(3, "n", True), (4, None, None)], schema)
    second.write.parquet(f"{log}/rows/batch=1")  # a crash before the manifest has it
    assert sorted(r.id for r in stateful.committed(spark, log, schema).collect()) == [1, 2]
    write(second, 1)
    done = stateful.committed(spark, log, schema)
    assert sorted(r.id for r in done.collect()) == [1, 2, 3, 4]
    prompts = spark.range(1, 7).toDF("id")
    assert sorted(r.id for r in stateful.to_ask(prompts, done, ["id"]).collect()) == [2, 4, 5, 6]
    parts = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A")], "scene int, c string")
    assert {r.scene for r in stateful.complete_scenes(parts, "scene", "c", 2).collect()} == {1}


def test_segments_of_long_clips_by_batches(spark):
    """Arrow batches far shorter than a clip, clips that begin within them, and signatures that are null or of another length."""
    rng = np.random.default_rng(6)
    rows = [(c, i, None if (c, i) in {(1, 5), (2, 0)} else rng.normal(size=4 if (c, i) != (2, 7) else 3).tolist()) for c in range(4) for i in range(0 if c == 3 else 40 + c)]
    df = spark.createDataFrame(rows, "clip long, ord int, sig array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.clip, r.ord): r.segs for r in S.segment_sweep(df, [0.5, 1.2]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, tau in enumerate((0.5, 1.2)):
        for clip in range(3):
            seg, anchor = -1, None
            for _, order, sig in sorted((r for r in rows if r[0] == clip), key=lambda r: r[1]):
                if anchor is None or sig is None or len(sig) != len(anchor) or sum(abs(a - b) for a, b in zip(sig, anchor, strict=True)) / len(sig) > tau:
                    seg, anchor = seg + 1, sig
                assert got[clip, order][k] == seg, (clip, order)


def test_places_within_large_groups(spark):
    from scenegrain.operators.ranks import placed

    rng = np.random.default_rng(8)
    rows = [(None if i % 7 == 0 else f"g{min(i % 5, 2)}", f"{rng.integers(0, 40):03d}" if i % 11 else None, i % 400) for i in range(1200)]
    got = placed(spark.createDataFrame(rows, "g string, name string, i long").repartition(5), ["g"], ["name"]).collect()
    assert len(got) == len(rows)
    for g in {r.g for r in got}:
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.r)
        assert [r.r for r in mine] == list(range(len(mine))) and {r.n for r in mine} == {len(mine)}
        names = [(r["name"] is not None, r["name"] or "") for r in mine]
        assert names == sorted(names)


def test_images_of_any_id_are_numbered(spark):
    objs = spark.createDataFrame([(f"group_{g}/{i:06d}", g, j) for g in range(9) for i in range(20) for j in range(2)], "image_id string, grp int, idx int")
    got = sinks.image_ids(objs).collect()
    assert len(got) == 180
    for split in ("train", "val", "test"):
        mine = sorted((r for r in got if r.split == split), key=lambda r: r.id)
        assert [r.id for r in mine] == list(range(len(mine))) and [r.image_id for r in mine] == sorted(r.image_id for r in mine)


def test_network_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = stats.Mlp(epochs=80, batch=50).fit(x, y)
    assert ((model.predict(x) > 0.5) == y).mean() > 0.9


def toy_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 4))
    y = np.stack([(x[:, 0] > 0.3), (x[:, 1] * x[:, 2] > 0.2), np.zeros(900, bool)], 1).astype(int)
    known = rng.random(900) < 0.4
    told = y * known[:, None]
    rows = [(i, *v, *a, *b, bool(k)) for i, (v, a, b, k) in enumerate(zip(x.tolist(), y.tolist(), told.tolist(), known, strict=True))]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, d double, y0 int, y1 int, y2 int, h0 int, h1 int, h2 int, known boolean")
    return df, x, y, told, known


def plain_net(x, y, epochs):
    """One network after each epoch, and what it says of rows."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    if not 0 < y.sum() < len(y):
        return lambda rows: [np.zeros(len(rows))] * epochs
    return lambda rows: [stats.Mlp(epochs=e).fit(*stats.oversampled_rows((x - mean) / scale, y.astype(float))).predict((rows - mean) / scale) for e in range(1, epochs + 1)]


def test_learning_curve_against_separate_trainings(spark):
    from scenegrain.operators import learning

    df, x, y, *_ = toy_pairs(spark)
    got = {(r.arm, r.epoch): r for r in learning.learning_curve(df.where("i < 600"), df.where("i >= 600"), list("abcd"), ["y0", "y1", "y2"], ["i"], most=600, epochs=4).collect()}
    assert set(got) == {(a, e) for a in (0, 1) for e in range(1, 5)} | {(2, 1)}
    for arm in (0, 1):
        order = sorted(range(600))  # rows are sorted by key before training
        for e, p in enumerate(plain_net(x[order], y[order, arm], 4)(x[600:]), 1):
            said, true = p > 0.5, y[600:, arm] > 0
            assert (got[arm, e].tp, got[arm, e].fn) == (int((said & true).sum()), int((~said & true).sum()))
    assert got[0, 4].recall > 0.5


def test_self_training_against_a_plain_version(spark):
    from scenegrain.operators import learning

    df, x, y, told, known = toy_pairs(spark)
    got = {r.arm: r for r in learning.self_trained(df.where("i < 600"), df.where("i >= 600"), list("abcd"), ["h0", "h1", "h2"], "known", ["i"], most=600, epochs=8).collect()}
    tx, tk = x[:600], known[:600]
    for arm in range(3):
        label = told[:600, arm]
        p = plain_net(tx, label, 8)(tx)[-1] if label.any() else np.full(600, 0.5)
        mine = np.where(tk, label, np.where(p >= 0.9, 1, np.where(p <= 0.1, 0, -1)))
        keep = mine >= 0
        said = plain_net(tx[keep], mine[keep], 8)(x[600:])[-1] > 0.5
        true = told[600:, arm] > 0
        r = got[arm]
        assert (r.annotated, r.pseudo_pos, r.pseudo_neg) == (tk.sum(), (~tk & (mine == 1)).sum(), (~tk & (mine == 0)).sum())
        assert (r.tp, r.fp, r.fn) == ((said & true).sum(), (said & ~true).sum(), (~said & true).sum())


def test_self_training_on_samples_against_a_plain_version(spark):
    """Fewer rows are sampled than are annotated: teacher and student learn from those with the smallest digests."""
    import hashlib

    from scenegrain.operators import learning

    df, x, y, told, known = toy_pairs(spark)
    got = {r.arm: r for r in learning.self_trained(df.where("i < 600"), df.where("i >= 600"), list("abcd"), ["h0", "h1", "h2"], "known", ["i"], most=100, epochs=8).collect()}
    order = sorted(range(600), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert known[:600].sum() > 100
    for arm in range(3):
        first, label = sorted(order[:100]), told[:600, arm]
        p = plain_net(x[first], label[first], 8)(x[:600])[-1] if label[first].any() else np.full(600, 0.5)
        mine = np.where(known[:600], label, np.where(p >= 0.9, 1, np.where(p <= 0.1, 0, -1)))
        pool = sorted([i for i in order if mine[i] >= 0][:100])
        said = plain_net(x[pool], mine[pool], 8)(x[600:])[-1] > 0.5
        true, r, free = told[600:, arm] > 0, got[arm], ~known[:600]
        assert (r.annotated, r.pseudo_pos, r.pseudo_neg) == (known[:600].sum(), (free & (mine == 1)).sum(), (free & (mine == 0)).sum())
        assert (r.tp, r.fp, r.fn) == ((said & true).sum(), (said & ~true).sum(), (~said & true).sum())


def test_confident_answers_are_those_of_double_precision():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 5))
    net = stats.Mlp(epochs=20).fit(x, (x[:, 0] > x[:, 1]).astype(float))
    for level in (0.6, 0.9, 0.99):
        p, (yes, no) = net.predict(x), net.sure(x, level)
        assert 0 < yes.sum() < len(x) and np.array_equal(yes, p >= level) and np.array_equal(no, p <= 1 - level)
    assert [v.tolist() for v in net.sure(np.array([[np.nan] * 5]), 0.9)] == [[False], [False]]


def plain_weights(draw: int, image: int) -> int:
    from scenegrain.operators import evaluate as V

    x = (image * V.DRAW_A + draw * V.DRAW_B + 12345) % V.DRAW_PRIME
    x = (x * x + image) % V.DRAW_PRIME
    return sum((x * x + draw) % V.DRAW_PRIME / V.DRAW_PRIME >= p for p in V.POISSON)


def test_weights_without_division_are_those_of_remainders():
    from scenegrain.operators import evaluate as V

    image = np.array([0, 1, 2, 12345, V.DRAW_PRIME - 2, V.DRAW_PRIME - 1, *np.random.default_rng(1).integers(0, V.DRAW_PRIME, 200)])
    draw = np.arange(1, 2001, 7)
    got = V.draw_weights(draw[None, :], image[:, None])
    assert got.tolist() == [[plain_weights(int(d), int(i)) for d in draw] for i in image]


def test_both_scopes_share_their_draws(spark):
    """An image may be held out in part; draw 0 takes each image once."""
    from pyspark.sql import functions as F
    from scenegrain.operators import evaluate as V

    rows = [(1, 6, "on", 1, 1), (1, 6, "on", 0, 2), (1, 2, "on", 3, 4), (2, 3, "near", 1, 5), (-7, 8, "on", 2, 2), (2**40, None, "on", 0, 1)]
    df = spark.createDataFrame(rows, "image_id long, grp int, k string, hits long, total long")
    got = {(r.scope, r.k, r.draw): (r.h, r.t) for r in V.drawn(df, 40, F.col("grp") >= 6).collect()}
    want = {}
    for image, grp, k, hits, total in rows:
        for scope in ["pooled"] + ["held out"] * ((grp or 0) >= 6):
            for draw in range(41):
                w = plain_weights(draw, image % V.DRAW_PRIME) if draw else 1
                h, t = want.get((scope, k, draw), (0, 0))
                want[scope, k, draw] = h + w * hits, t + w * total
    assert got == {key: v for key, v in want.items() if v[1]}
    each = {(r.scope, r.k): (r.gold, r.recall) for r in V.intervals(V.drawn(df, 40, F.col("grp") >= 6)).collect()}
    assert each == {("pooled", "on"): (10, 0.6), ("pooled", "near"): (5, 0.2), ("held out", "on"): (5, 0.6)}
    assert {r.k for r in V.bootstrap(df, 40).collect()} == {"on", "near"}


def test_some_pairs_are_judged_like_all(spark, small_dir):
    """Where elevation decides the order in depth, too."""
    from pyspark.sql import functions as F
    from scenegrain.operators import rules
    from scenegrain.queries import _inputs
    from scenegrain.sources import fixtures

    objs, columns = _inputs.objects(spark, small_dir), ["image_id", "a_idx", "b_idx", "predicates", "flags", "gap_rel", "c_ab", "c_ba"]
    every = rules.evaluate_gathered(objs, share=fixtures.contact_share)
    for wanted in (F.lit(True), F.size(fixtures.stated()) > 0):
        some, plain = rules.evaluate_some(objs, wanted, fixtures.contact_share).select(columns), every.where(wanted).select(columns)
        assert some.count() == plain.count() and not some.exceptAll(plain).head(1)
    tied = every.where("abs(a_depth - b_depth) < 0.03 and abs(a_y2 - b_y2) > 0.005")
    assert tied.where("a_elevated or b_elevated").head(1) and tied.where("not (a_elevated or b_elevated)").head(1)


def test_networks_meet_every_held_out_pair(spark, small_dir):
    from scenegrain.queries import _inputs, text
    from scenegrain.types import PREDICATES

    rows = text.mlp(spark, small_dir).collect()
    assert {r.arm for r in rows} == set(PREDICATES) and len(rows) == len(PREDICATES)
    assert {r.held_out for r in rows} == {_inputs.scene(spark, small_dir).where("a_grp >= 6").count()}
    assert all(r.accuracy > 0.9 for r in rows)
    x, y = stats.oversampled_rows(np.arange(105.0)[:, None], np.r_[np.ones(5), np.zeros(100)])
    assert y.sum() == 10 and len(x) == 110 and set(x[y == 1, 0]) == {0, 1, 2, 3, 4}


def test_spaced_sample_is_that_of_one_after_another(spark):
    import hashlib

    rng = np.random.default_rng(5)
    rows = list(dict.fromkeys((int(g), int(f), int(n)) for g, f, n in zip(rng.integers(0, 3, 500), rng.integers(-80, 900, 500), rng.integers(0, 3, 500), strict=True)))
    got = {tuple(r) for r in S.spaced_sample(spark.createDataFrame(rows + rows[:9], "g int, frame int, n int"), ["g"], "frame", 25).collect()}
    taken = []
    for r in sorted(rows, key=lambda r: (hashlib.md5("|".join(["audit", *map(str, r)]).encode()).hexdigest(), r)):
        if all(t[0] != r[0] or abs(t[1] - r[1]) >= 25 for t in taken):
            taken.append(r)
    assert got == set(taken)


def test_tracks_of_whole_tables_against_a_plain_tracker(spark, small_dir):
    """Every clip of the table: best detection first, the first of the unused boxes of its label that overlap most."""
    from scenegrain.queries import _inputs, sequence

    got = {(r.clip, r.ord, r.det): r.track for r in sequence.tracks(spark, small_dir).collect()}
    boxes = [(r.clip, r.ord // 3, r.ord % 3, r.label, r.value, (r.x1, 0.2, r.x1 + 0.3, 0.6)) for r in _inputs.frames(spark, small_dir).collect()]

    def share(a, b):
        both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)

    want = {}
    for clip in {b[0] for b in boxes}:
        before, number, frames = [], 0, {}
        for b in boxes:
            if b[0] == clip:
                frames.setdefault(b[1], []).append(b)
        for order in sorted(frames):
            if order - 1 not in frames:
                before = []
            here, free = sorted(frames[order], key=lambda b: b[2]), list(before)
            for b in sorted(here, key=lambda b: -b[4]):
                best = None
                for old in free:
                    if old[1] == b[3] and share(b[5], old[2]) > (share(b[5], best[2]) if best else 0.30):
                        best = old
                if best:
                    free.remove(best)
                    want[clip, order, b[2]] = best[0]
                else:
                    want[clip, order, b[2]], number = number, number + 1
            before = [(want[clip, order, b[2]], b[3], b[5]) for b in here]
    assert got == want


def test_spaced_sample(spark):
    claims = spark.createDataFrame([(1, f, i) for i, f in enumerate([0, 5, 10, 30, 31, 60])], "g int, frame int, n int")
    got = S.spaced_sample(claims, ["g"], "frame", 20).collect()
    frames = sorted(r.frame for r in got)
    assert all(b - a >= 20 for a, b in zip(frames, frames[1:], strict=False))
    assert all(any(abs(f - g) < 20 for g in frames) for f in (0, 5, 10, 30, 31, 60))  # nothing more would fit


def test_recall_asks_networks_only_about_rows_with_the_label(spark):
    from scenegrain.operators import learning

    class Asked:
        def says(self, x):
            assert (x[:, 0] > 0).all(), "a row without the label"
            return x[:, 0] > 1

    df = spark.createDataFrame([(float(v), int(v > 0), 0) for v in (-2, -1, 1, 2, 3)], "a double, y0 int, y1 int")
    nets = {0: [(Asked(), np.zeros(1), np.ones(1))] * 2}
    got = {tuple(r) for r in learning.recalled(df, ["a"], ["y0", "y1"], nets).collect()}
    assert got == {(0, 0, 2, 1), (0, 1, 2, 1), (1, 0, 0, 0)}
