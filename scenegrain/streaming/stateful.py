"""Streams of frames: tracking, drift segmentation and votes with state per clip, windowed counts, logs that are atomic and can be resumed."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scenegrain.operators.sequence import assign_tracks

TRACKS = T.StructType([T.StructField("clip", T.LongType()), T.StructField("ord", T.IntegerType()), T.StructField("det", T.IntegerType()), T.StructField("track", T.IntegerType())])
SEGMENTS = T.StructType([T.StructField("clip", T.LongType()), T.StructField("ord", T.IntegerType()), T.StructField("seg", T.IntegerType())])


class TrackState(StatefulProcessor):
    """Tracks of a clip: the boxes of its last frame and the next number. Frames of a batch are taken in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "next int, last int, track array<int>, label array<string>, box array<array<double>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values(["ord", "det"])
        prev, next_id, last = [], 0, None
        if self.now.exists():
            next_id, last, track, label, box = self.now.get()
            prev = [(t, n, tuple(b)) for t, n, b in zip(track, label, box, strict=True)]
        out = []
        for order, frame in frames.groupby("ord", sort=True):
            if last is not None and order != last + 1:
                prev = []
            ids, prev, next_id = assign_tracks(frame, prev, next_id)
            out.append(pd.DataFrame({"clip": frame["clip"], "ord": frame["ord"], "det": frame["det"], "track": ids}))
            last = int(order)
        self.now.update((next_id, last, [t for t, _, _ in prev], [n for _, n, _ in prev], [[float(v) for v in b] for _, _, b in prev]))
        yield pd.concat(out).astype({"ord": "int32", "det": "int32", "track": "int32"})

    def close(self) -> None:
        pass


class SegmentState(StatefulProcessor):
    """Drift segments of a clip: the signature that opened the running segment, and its number."""

    def __init__(self, tau: float):
        self.tau = tau

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "seg int, anchor array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values("ord")
        seg, anchor = self.now.get() if self.now.exists() else (-1, None)
        out = []
        for clip, order, sig in frames[["clip", "ord", "sig"]].itertuples(index=False, name=None):
            if anchor is None or sum(abs(a - b) for a, b in zip(sig, anchor, strict=True)) / len(sig) > self.tau:
                seg, anchor = seg + 1, [float(v) for v in sig]
            out.append((clip, order, seg))
        self.now.update((seg, anchor))
        yield pd.DataFrame(out, columns=["clip", "ord", "seg"]).astype({"ord": "int32", "seg": "int32"})

    def close(self) -> None:
        pass


def tracked_stream(dets: DataFrame) -> DataFrame:
    """Tracks of a stream of detections whose clips arrive in order. Needs the RocksDB state store."""
    return dets.groupBy("clip").transformWithStateInPandas(statefulProcessor=TrackState(), outputStructType=TRACKS, outputMode="Append", timeMode="None")


def segmented_stream(frames: DataFrame, tau: float) -> DataFrame:
    """Segments of a stream of signatures whose clips arrive in order. Needs the RocksDB state store."""
    return frames.groupBy("clip").transformWithStateInPandas(statefulProcessor=SegmentState(tau), outputStructType=SEGMENTS, outputMode="Append", timeMode="None")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per event-time window and type; events later than the watermark are left out by Spark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


# votes as frames come


def voted(frames: list[dict], order: int, window: int) -> list[tuple]:
    """Triplets of the frame `order` that more than half of the frames within `window`, of those that show both tracks, state."""
    near = [f for f in frames if abs(f["ord"] - order) <= window]
    here = next(f for f in near if f["ord"] == order)
    out = []
    for s, p, o in sorted({tuple(t) for f in near for t in f["said"]}):
        shown = [f for f in near if s in f["tracks"] and o in f["tracks"]]
        if s in here["tracks"] and o in here["tracks"] and 2 * sum([s, p, o] in f["said"] for f in shown) > len(shown):
            out.append((order, s, p, o))
    return out


VOTES = T.StructType([T.StructField("clip", T.LongType()), T.StructField("ord", T.IntegerType()), T.StructField("s", T.IntegerType()), T.StructField("p", T.StringType()), T.StructField("o", T.IntegerType())])


class VoteState(StatefulProcessor):
    """A clip's frames that a vote still needs: those that aren't out yet, and `window` before them.

    Frame n goes out when a frame from n + window on has come, with `last` set on the clip's last
    frame, or when the clip has been silent for `patience` milliseconds. Frames come in order; one
    that is already out, or was held already, changes nothing.
    """

    def __init__(self, window: int, patience: int):
        self.window, self.patience = window, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "frames string, out int")

    def emitted(self, clip: int, frames: list[dict], out: int, upto: int | None) -> tuple[pd.DataFrame, list[dict], int]:
        ready = [f["ord"] for f in frames if f["ord"] > out and (upto is None or f["ord"] <= upto)]
        rows = [(clip, *t) for order in ready for t in voted(frames, order, self.window)]
        out = max([out, *ready])
        return pd.DataFrame(rows, columns=VOTES.names).astype({"clip": "int64", "ord": "int32", "s": "int32", "o": "int32"}), [f for f in frames if f["ord"] > out - self.window], out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out = self.now.get() if self.now.exists() else ("[]", -1)
        frames = json.loads(held)
        known, ended = {f["ord"] for f in frames}, False
        for part in rows:
            for r in part.itertuples(index=False):
                ended |= bool(r.last)
                if r.ord > out and r.ord not in known:
                    known.add(int(r.ord))
                    frames.append({"ord": int(r.ord), "tracks": [int(t) for t in r.tracks], "said": [[int(t["s"]), t["p"], int(t["o"])] for t in r.said]})
        frames.sort(key=lambda f: f["ord"])
        newest = frames[-1]["ord"] if frames else out
        found, frames, out = self.emitted(int(key[0]), frames, int(out), None if ended else newest - self.window)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if any(f["ord"] > out for f in frames):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        self.now.update((json.dumps(frames), out))
        yield found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, out = self.now.get() if self.now.exists() else ("[]", -1)
        found, frames, out = self.emitted(int(key[0]), json.loads(held), int(out), None)
        self.now.update((json.dumps(frames), out))
        yield found

    def close(self) -> None:
        pass


def voted_stream(frames: DataFrame, window: int = 2, patience: int = 60_000) -> DataFrame:
    """Voted triplets (clip, ord, s, p, o) of a stream of frames: clip, ord, tracks (array<int>), said (array<struct<s,p,o>>) and last.

    Row for row what majority_vote() gives for the whole clip, `window` frames later. Needs the RocksDB state store.
    """
    return frames.groupBy("clip").transformWithStateInPandas(statefulProcessor=VoteState(window, patience), outputStructType=VOTES, outputMode="Append", timeMode="ProcessingTime")


# answers of scenes, all of a scene's or none

ANSWERS = T.StructType([T.StructField("scene", T.LongType()), T.StructField("condition", T.StringType()), T.StructField("model", T.StringType()), T.StructField("reply", T.StringType())])


class SceneState(StatefulProcessor):
    """A scene's parsed answers by model, until one model has answered all conditions: then they go out together, once."""

    def __init__(self, expected: tuple[str, ...], patience: int):
        self.expected, self.patience = expected, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "answers string, whole boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, whole = self.now.get() if self.now.exists() else ("{}", False)
        answers, out = json.loads(held), []
        for part in rows:
            for r in part.itertuples(index=False):
                if whole or not r.parsed or r.condition not in self.expected:
                    continue
                mine = answers.setdefault(r.model or "", {})
                mine.setdefault(r.condition, r.reply)
                if len(mine) == len(self.expected):
                    out, whole, answers = [(int(key[0]), c, r.model, mine[c]) for c in self.expected], True, {}
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if answers:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        self.now.update((json.dumps(answers), whole))
        yield pd.DataFrame(out, columns=ANSWERS.names).astype({"scene": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.now.exists() and not self.now.get()[1]:
            self.now.clear()  # a scene left half answered is asked anew, all of it
        yield pd.DataFrame([], columns=ANSWERS.names).astype({"scene": "int64"})

    def close(self) -> None:
        pass


def whole_scenes(answers: DataFrame, expected: list[str], patience: int = 3_600_000) -> DataFrame:
    """Of a stream of answers (scene, condition, model, reply, parsed) those of scenes of which one model has answered all `expected` conditions.

    An answer that isn't parsed counts as not given; the first parsed one of a condition stays; a scene
    goes out once, whatever comes again; one that stays partial for `patience` milliseconds is dropped.
    Needs the RocksDB state store.
    """
    return answers.groupBy("scene").transformWithStateInPandas(statefulProcessor=SceneState(tuple(expected), patience), outputStructType=ANSWERS, outputMode="Append", timeMode="ProcessingTime")


def commit_batch(log: str):
    """For foreachBatch: a function that writes a batch below the log and then names it in the log's manifest.

    A batch has a folder of its own, so one that is repeated, after a crash at whatever point, writes the
    same folder again and adds nothing; until the manifest names it no reader sees it. No batch reads
    what is in the log.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/rows/batch={batch_id}")
        batch.sparkSession.range(1).selectExpr(f"{int(batch_id)}L as batch").coalesce(1).write.mode("overwrite").parquet(f"{log}/manifest/of={batch_id}")

    return write


def committed(spark: SparkSession, log: str, schema: T.StructType) -> DataFrame:
    """The rows of the log's batches that its manifest names; of a log that doesn't exist yet, none."""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{log}/manifest")
    if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        return spark.createDataFrame([], schema)
    named = spark.read.schema("batch long").parquet(f"{log}/manifest").select("batch")
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option("basePath", f"{log}/rows").parquet(f"{log}/rows")
    return rows.join(F.broadcast(named), "batch", "left_semi").select(*schema.names)


def to_ask(prompts: DataFrame, log: DataFrame, keys: list[str], parsed: str = "parsed") -> DataFrame:
    """Prompts without a parsed answer in the log: one that failed or can't be read is asked again."""
    return prompts.join(log.where(F.coalesce(F.col(parsed), F.lit(False))).select(*keys).distinct(), keys, "left_anti")


def complete_scenes(rows: DataFrame, key: str, part: str, expected: int) -> DataFrame:
    """Rows of scenes that have all their parts: what is committed together."""
    whole = rows.groupBy(key).agg(F.count_distinct(part).alias("n")).where(F.col("n") == expected).select(key)
    return rows.join(whole, key, "left_semi")
