"""Masks as columns: runs of pixels (row, first, end), with centre, depth, contact and overlap as expressions.

A mask is array<struct<row:int, first:int, end:int>>: of a row the pixels from first on, before end. Runs of a
mask don't overlap; a row may have several. An empty mask is an empty array. Rows grow downwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenegrain.functions.geometry import Box, num

RUNS = "array<struct<row:int,first:int,end:int>>"
RUNS_TYPE = T.ArrayType(T.StructType([T.StructField(name, T.IntegerType()) for name in ("row", "first", "end")]))
#: Rows below an object's lowest pixels in which what it rests on begins.
BAND = 5
#: Contact that raises an object on a surface, and overlap beyond which the surface is the object itself.
SURFACE_CONTACT, SAME_REGION = 0.60, 0.80
#: Pixels, pairs or columns that are worked on at once, unless one mask or object has more.
TOGETHER = 1 << 20


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def run(row: Column, first: Column, end: Column) -> Column:
    return F.struct(row.cast("int").alias("row"), first.cast("int").alias("first"), end.cast("int").alias("end"))


def rect(box: Box, height: int, width: int) -> Column:
    """A box (shares of the image) filled in, its sides rounded half to even."""
    x1, y1, x2, y2 = (F.bround(v * n, 0).cast("int") for v, n in ((box.x1, width), (box.y1, height), (box.x2, width), (box.y2, height)))
    sides = F.struct(F.greatest(x1, F.lit(0)).alias("x1"), F.least(x2, F.lit(width)).alias("x2"), F.greatest(y1, F.lit(0)).alias("y1"), F.least(y2, F.lit(height)).alias("y2"))

    def filled(q: Column) -> Column:
        rows = F.transform(F.sequence(q["y1"], F.greatest(q["y2"] - 1, q["y1"])), lambda r: run(r, q["x1"], q["x2"]))
        return F.when((q["y2"] > q["y1"]) & (q["x2"] > q["x1"]), rows).otherwise(F.array().cast(RUNS))

    return let(sides, filled)


#: From a batch of objects and flat runs (which object, row, first, end), the runs that are left of them, in order.
Carve = Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _fill(objs: pa.RecordBatch, sides: list[str], height: int, width: int, carve: Carve | None) -> pa.Array:
    """The masks of a batch of objects, whose boxes are in the columns `sides`, worked out at once on flat arrays."""
    v = [objs.column(s).to_numpy(zero_copy_only=False) for s in sides]
    # a side that isn't known is the image's, as in rect()
    v = [np.where(np.isnan(s), edge, s) for s, edge in zip(v, (0, 0, 1, 1), strict=True)]
    x1, y1, x2, y2 = (np.rint(s * n).astype(np.int64) for s, n in zip(v, (width, height, width, height), strict=True))
    x1, y1, x2, y2 = np.maximum(x1, 0), np.maximum(y1, 0), np.minimum(x2, width), np.minimum(y2, height)
    rows = np.where((y2 > y1) & (x2 > x1), y2 - y1, 0)
    of = np.repeat(np.arange(len(rows)), rows)
    runs = of, _spread(y1, rows), x1[of], x2[of]
    if carve:
        runs = carve(objs, *runs)
    ends = np.append(0, np.cumsum(np.bincount(runs[0], minlength=len(rows)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(r.astype(np.int32)) for r in runs[1:]], names=["row", "first", "end"]))


def drawn(objs: DataFrame, sides: list[str], height: int, width: int, carve: Carve | None = None) -> DataFrame:
    """objs with runs: boxes (columns x1, y1, x2, y2, or as `sides` has them) filled in as rect() does and then carved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _fill(batch, sides, height, width, carve)], names=[*batch.schema.names, "runs"])

    return objs.mapInArrow(run, T.StructType([*objs.schema.fields, T.StructField("runs", RUNS_TYPE)]))


def drawn_scenes(scenes: DataFrame, height: int, width: int, **drawings: tuple[list[str], Carve | None]) -> DataFrame:
    """Rows of scenes (scene: an array of objects, gathered where they are) with arrays of idx and runs, as drawn() has them: for each name a box's sides and what carves it.

    Objects are gathered before they are drawn, so that no mask is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scene = batch.column("scene")
            objs = pa.RecordBatch.from_struct_array(scene.flatten())
            ends = pa.array(np.append(0, np.cumsum(pc.list_value_length(scene).to_numpy(zero_copy_only=False))).astype(np.int32))
            masks = [pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([objs.column("idx"), _fill(objs, sides, height, width, carve)], names=["idx", "runs"])) for sides, carve in drawings.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *masks], names=[*batch.schema.names, *drawings])

    mask = T.ArrayType(T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("runs", RUNS_TYPE)]))
    return scenes.mapInArrow(run, T.StructType([*scenes.schema.fields, *[T.StructField(name, mask) for name in drawings]]))


def _total(runs: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda acc, q: acc + of(q).cast("long"))


def area(runs: Column) -> Column:
    return _total(runs, lambda q: q["end"] - q["first"])


def centroid(runs: Column, height: int, width: int) -> Column:
    """cx and cy of the mask's pixels as shares of the image; the middle for an empty one."""
    n = area(runs)
    # the columns of a run add up to half of (first + last) times their number
    x = _total(runs, lambda q: (q["end"] - q["first"]) * (q["first"] + q["end"] - 1)) / (n * 2) / width
    y = _total(runs, lambda q: (q["end"] - q["first"]) * q["row"]) / n / height
    return F.struct(F.when(n > 0, x).otherwise(num(0.5)).alias("cx"), F.when(n > 0, y).otherwise(num(0.5)).alias("cy"))


def median(values: Column) -> Column:
    """Of an array without nulls: the middle value, or the mean of the two; null for an empty one."""
    middle = lambda v: F.when(F.size(v) > 0, (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2)
    return let(F.sort_array(values), middle)


def depth(runs: Column, at: Callable[[Column, Column], Column], overall: Column) -> Column:
    """Median over the mask's pixels of the depth at(row, column); `overall` for an empty mask."""
    pixels = F.flatten(F.transform(runs, lambda q: F.transform(F.sequence(q["first"], q["end"] - 1), lambda c: at(q["row"], c))))
    return F.coalesce(median(pixels), overall)


def with_depth(masks: DataFrame, at: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], np.ndarray], overall: str, name: str) -> DataFrame:
    """masks without their runs and with depth() of each, `overall` (a column) for an empty one; at(batch, which mask, rows, columns) gives the depths of many pixels at once.

    Masks of as many pixels form a matrix, whose middle is found without sorting it.
    """
    kept = [f for f in masks.schema.fields if f.name != "runs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _Masks(pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), pa.StructArray.from_arrays([batch.column("runs")], names=["runs"])))
            z = batch.column(overall).to_numpy(zero_copy_only=False).astype(float).copy()
            order = np.argsort(m.area, kind="stable")
            order = order[m.area[order] > 0]
            for block in _blocks(m.area[order]):
                some = order[block]
                run_at = _spread(m.first_run[some], m.runs[some])
                wide = (m.end - m.first)[run_at]
                pixels = at(batch, np.repeat(m.of[run_at], wide), np.repeat(m.row[run_at], wide), _spread(m.first[run_at], wide))
                sizes, firsts, counts = np.unique(m.area[some], return_index=True, return_counts=True)
                begin = np.cumsum(sizes * counts) - sizes * counts
                for n, first, count, lo in zip(sizes, firsts, counts, begin, strict=True):
                    block_of = np.partition(pixels[lo : lo + n * count].reshape(count, n), ((n - 1) // 2, n // 2), axis=1)
                    z[some[first : first + count]] = (block_of[:, (n - 1) // 2] + block_of[:, n // 2]) / 2
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(z, from_pandas=True)], names=[f.name for f in kept] + [name])

    return masks.mapInArrow(run, T.StructType([*kept, T.StructField(name, T.DoubleType())]))


def extent(runs: Column) -> Column:
    """top and low rows, left column and right end of a mask; nulls for an empty one."""
    of = lambda name: F.transform(runs, lambda q: q[name])
    return F.struct(F.array_min(of("row")).alias("top"), F.array_max(of("row")).alias("low"), F.array_min(of("first")).alias("left"), F.array_max(of("end")).alias("right"))


def _scenes(masks: DataFrame, name: str, *keep: str) -> DataFrame:
    """image_id and its masks in a row, which is no larger than a scene. What is grouped by image already doesn't move."""
    return masks.where("image_id is not null").groupBy("image_id").agg(F.collect_list(F.struct(*keep, F.coalesce("runs", F.array().cast(RUNS)).alias("runs"))).alias(name))


def _blocks(weights: np.ndarray, most: int = TOGETHER) -> Iterator[slice]:
    """Slices, in order, of what weighs no more than `most` together, or of one that weighs more."""
    ends, at = np.cumsum(weights), 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield slice(at, end)
        at = end


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .. (sizes[0] of them), starts[1], .."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


class _Masks:
    """A column of lists of masks as flat arrays: of each list its masks, of each mask its runs."""

    def __init__(self, column: pa.Array):
        self.sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        *keep, runs = column.flatten().flatten()
        self.idx = keep[0].to_numpy() if keep else np.zeros(len(runs), np.int32)
        n = pc.list_value_length(runs).to_numpy(zero_copy_only=False).astype(np.int64)
        row, first, end = (f.to_numpy().astype(np.int64) for f in runs.flatten().flatten())
        of, full = np.repeat(np.arange(len(n)), n), end > first
        self.of, self.row, self.first, self.end = of[full], row[full], first[full], end[full]
        n = np.bincount(self.of, minlength=len(n))
        self.first_run, self.runs = np.cumsum(n) - n, n
        self.area = np.bincount(self.of, weights=self.end - self.first, minlength=len(n)).astype(np.int64)
        self.box = [self._of_runs(f, v) for f, v in ((np.minimum, self.row), (np.maximum, self.row), (np.minimum, self.first), (np.maximum, self.end))]

    def _of_runs(self, f: np.ufunc, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.runs), np.int64)
        if len(values):
            out[self.runs > 0] = f.reduceat(values, self.first_run[self.runs > 0])
        return out

    def pixels(self, some: np.ndarray, height: int, width: int) -> np.ndarray:
        """Of the masks `some` their pixels as ((place in some) * width + column) * height + row, in order."""
        at = _spread(self.first_run[some], self.runs[some])
        of, wide = np.repeat(np.arange(len(some)), self.runs[some]), (self.end - self.first)[at]
        columns = _spread(self.first[at], wide)
        return np.sort((np.repeat(of, wide) * width + columns) * height + np.repeat(self.row[at], wide))


def _rests(a: _Masks, b: _Masks, image: slice, height: int, least: float, other: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Of the scenes of a slice, pairs of masks that touch: their places in a and b, the share of a's bottom that rests on b, from `least` up, and, if b are others (not a), the pixels they share.

    Extents leave most pairs out. A bottom is the lowest pixel of each column; it rests on what has a pixel
    in its column within BAND rows below, or on the last row.
    """
    last = height - 1
    ours = _spread(a.starts[image], a.sizes[image])
    theirs, partners = np.repeat(b.starts[image], a.sizes[image]), np.repeat(b.sizes[image], a.sizes[image])
    for some in _blocks(partners):
        i, j = np.repeat(ours[some], partners[some]), _spread(theirs[some], partners[some])
        (a_top, a_low, a_left, a_right), (b_top, b_low, b_left, b_right) = ([v[at] for v in m.box] for m, at in ((a, i), (b, j)))
        may = (a.area[i] > 0) & (b.area[j] > 0) & (a_left < b_right) & (b_left < a_right) & (b_low >= np.minimum(a_top + 1, last)) & (b_top <= np.minimum(a_low + BAND, last))
        if not other:
            may &= i != j
        i, j = i[may], j[may]
        for part in _blocks(a.area[i] + b.area[j]):
            yield _judged(a, b, i[part], j[part], height, least, other)


def _judged(a: _Masks, b: _Masks, i: np.ndarray, j: np.ndarray, height: int, least: float, other: bool) -> tuple[np.ndarray, ...]:
    """Of pairs of masks those whose share of the one's bottom that rests on the other is `least` or more, with that share, and, if asked, the pixels that both have, which of most pairs nobody counts."""
    last = height - 1
    of, on = i, j
    (mine, i), (yours, j) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
    left = min(a.box[2][mine].min(), b.box[2][yours].min(), 0)
    top = min(a.box[0][mine].min(), b.box[0][yours].min(), 0)
    width = max(a.box[3][mine].max(), b.box[3][yours].max()) - left
    tall = max(a.box[1][mine].max(), b.box[1][yours].max(), last) - top + 1
    shift = -left * tall - top
    own, put = a.pixels(mine, tall, width) + shift, b.pixels(yours, tall, width) + shift
    column = own // tall
    low = np.append(column[1:] != column[:-1], True)  # in order of rows: the last of a column is its lowest
    wide = np.bincount(column[low] // width, minlength=len(mine))

    def met(i: np.ndarray, j: np.ndarray, pixels: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of each pair how many of the one's pixels have one of the other's in their column, from lo to hi."""
        at = _spread((np.cumsum(n) - n)[i], n[i])
        pair = np.repeat(np.arange(len(i)), n[i])
        base = (j[pair] * width + (pixels // tall % width)[at]) * tall
        found = np.searchsorted(put, base + lo[at])
        hit = (found < len(put)) & (put[np.minimum(found, len(put) - 1)] <= base + hi[at])
        return np.bincount(pair[hit], minlength=len(i))

    below = own[low] % tall + top
    lo, hi = np.minimum(below + 1, last) - top, np.minimum(below + BAND, last) - top
    frac = met(i, j, own[low], wide, lo, hi) / wide[i]
    keep = frac >= least
    if not other:
        return of[keep], on[keep], frac[keep]
    row = own % tall
    return of[keep], on[keep], frac[keep], met(i[keep], j[keep], own, np.bincount(own // (tall * width), minlength=len(mine)), row, row)


def pair_contacts(masks: DataFrame, height: int, least: float = 0.05) -> DataFrame:
    """(image_id, i, j, frac): contact of every ordered pair of masks (image_id, idx, runs) of an image, from `least` up, judged before it is rounded to four places."""
    kind = masks.schema["image_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _Masks(batch.column(1))
            owner = np.repeat(np.arange(len(m.sizes)), m.sizes)
            for some in _blocks(np.bincount(owner, weights=m.area, minlength=len(m.sizes))):
                for i, j, frac in _rests(m, m, some, height, least, False):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[i])), pa.array(m.idx[i]), pa.array(m.idx[j]), pa.array(frac)], names=["image_id", "i", "j", "frac"])

    found = _scenes(masks.select("image_id", F.col("idx").cast("int").alias("idx"), "runs"), "masks", "idx").mapInArrow(run, _schema(kind, i=T.IntegerType(), j=T.IntegerType(), frac=T.DoubleType()))
    return found.select("image_id", "i", "j", F.round("frac", 4).alias("frac"))


def elevated(masks: DataFrame, surfaces: DataFrame, height: int, least: float = SURFACE_CONTACT) -> DataFrame:
    """(image_id, idx) of objects that rest on a surface (image_id, runs), leaving out surfaces that cover more than SAME_REGION of the object.

    What evaluate_scene takes as extra_elevated. A null or empty mask rests on nothing.
    """
    kind = masks.schema["image_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _Masks(batch.column(1)), _Masks(batch.column(2))
            owner = np.repeat(np.arange(len(a.sizes)), a.sizes)
            for some in _blocks(np.bincount(owner, weights=a.area, minlength=len(a.sizes))):
                up = [i[~(both > SAME_REGION * a.area[i])] for i, _, _, both in _rests(a, b, some, height, least, True)]
                raised = np.unique(np.concatenate(up)) if up else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[raised])), pa.array(a.idx[raised])], names=["image_id", "idx"])

    both = _scenes(masks.select("image_id", F.col("idx").cast("int").alias("idx"), "runs"), "masks", "idx").join(_scenes(surfaces, "surfaces"), "image_id")
    return both.select("image_id", "masks", "surfaces").mapInArrow(run, _schema(kind, idx=T.IntegerType())).distinct()


def with_evidence(scenes: DataFrame, height: int, least: float | None = 0.05, surface: float = SURFACE_CONTACT) -> DataFrame:
    """Rows of whole scenes with what their masks say: contacts (i, j, frac), as pair_contacts() has them, none without `least`, and, if there are surfaces, raised (idx), as elevated() has them.

    scenes: masks and maybe surfaces (arrays of idx and runs) and any others, which are kept; masks and surfaces are not.
    """
    kept = [f for f in scenes.schema.fields if f.name not in ("masks", "surfaces")]
    flat = "surfaces" in scenes.columns
    touch = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("frac", T.DoubleType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = _Masks(batch.column("masks"))
            b = _Masks(batch.column("surfaces")) if flat else None
            owner = np.repeat(np.arange(len(a.sizes)), a.sizes)
            found, up = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], [np.zeros(0, np.int64)]
            for some in _blocks(np.bincount(owner, weights=a.area, minlength=len(a.sizes))):
                if least is not None:
                    found += _rests(a, a, some, height, least, False)
                if flat:
                    up += [i[~(both > SAME_REGION * a.area[i])] for i, _, _, both in _rests(a, b, some, height, surface, True)]
            i, j, frac = (np.concatenate(v) for v in zip(*found, strict=True))
            raised = np.unique(np.concatenate(up))
            listed = lambda of, values: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(owner[of], minlength=len(a.sizes)))).astype(np.int32)), values)
            out = {f.name: batch.column(f.name) for f in kept}
            out["contacts"] = listed(i, pa.StructArray.from_arrays([pa.array(a.idx[i]), pa.array(a.idx[j]), pa.array(frac)], names=["i", "j", "frac"]))
            if flat:
                out["raised"] = listed(raised, pa.array(a.idx[raised]))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    raised = [T.StructField("raised", T.ArrayType(T.IntegerType()))] if flat else []
    judged = scenes.mapInArrow(run, T.StructType([*kept, T.StructField("contacts", touch), *raised]))
    return judged.withColumn("contacts", F.transform("contacts", lambda c: c.withField("frac", F.round(c["frac"], 4))))


def _schema(image_id: T.DataType, **rest: T.DataType) -> T.StructType:
    out = T.StructType([T.StructField("image_id", image_id)])
    for name, kind in rest.items():
        out = out.add(name, kind)
    return out
