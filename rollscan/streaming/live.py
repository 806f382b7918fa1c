"""Live inspection: ordered frames in, positions, events and counters out, with carried state."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import StructType

from rollscan.functions import grading
from rollscan.operators import positions
from rollscan.operators.track import BOX, ROLL, Tracks


def read_frames(spark: SparkSession, path: str, schema: StructType, max_files: int = 8) -> DataFrame:
    """ST1: frame rows in the order they were written, at most max_files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def newest(batch: DataFrame, source: str = "source_id", ts: str = "ts_s") -> DataFrame:
    """ST2: of a micro-batch each source's newest row, and how many it stands for (dropped)."""
    row = F.max_by(F.struct(*batch.columns), F.col(ts)).alias("row")
    return batch.groupBy(source).agg(row, (F.count("*") - 1).alias("dropped")).select("row.*", "dropped")


#: Processors with typed state need this store.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stateful(rows: DataFrame, keys: list[Column | str], processor: StatefulProcessor, schema: str, timed: bool) -> DataFrame:
    """rows of each key, through a processor whose state is kept by key from batch to batch. timed: it has timers or its state
    expires; Spark then runs batches without data too, so that a trigger of all there is (availableNow) does not end."""
    rows.sparkSession.conf.set(*PROVIDER)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if timed else "None")


def ends(rows: DataFrame) -> DataFrame:
    """rows with end_of_roll, false where they have no such column."""
    return rows if "end_of_roll" in rows.columns else rows.withColumn("end_of_roll", F.lit(False))


def in_order(batches: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(list(order), kind="stable").reset_index(drop=True)


class Stalls(StatefulProcessor):
    """State of a source: its last frame, and a timer that the next frame puts off."""

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "frame long")

    def forget(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        batch = pd.concat(list(rows))
        last = max(held[0] if held else -1, int(batch["frame_index"].max()))
        self.forget()
        if batch["end_of_roll"].any():
            yield pd.DataFrame({"source_id": [key[0]], "last_frame": [last], "state": ["ended"]})
        else:
            self.last.update((last,))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"source_id": [key[0]], "last_frame": [last[0] if last else -1], "state": ["stalled"]})

    def close(self) -> None:
        pass


def stalls(frames: DataFrame, timeout_ms: int, source: str = "source_id") -> DataFrame:
    """ST3: a row for each source that sends nothing for timeout_ms, which is not the same as its end (a row with end_of_roll).
    Nothing is kept of a source that ended or stalled."""
    rows = frames.withColumn("source_id", F.col(source).cast("string"))
    return stateful(rows, ["source_id"], Stalls(timeout_ms), "source_id string, last_frame long, state string", True)


def phases(frames: DataFrame, learn: int, calibrate: int) -> DataFrame:
    """ST4 in batch: the phase of each frame by its number in the roll."""
    return frames.withColumn("phase", F.when(F.col("frame_index") < learn, "learn").when(F.col("frame_index") < learn + calibrate, "calibrate").otherwise("inspect"))


class Phases(StatefulProcessor):
    """State of a roll: how many of its frames came before."""

    def __init__(self, learn: int, calibrate: int, ttl_ms: int | None) -> None:
        self.learn, self.calibrate, self.ttl_ms = learn, calibrate, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "frames long", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        seen = self.seen.get()[0] if self.seen.exists() else 0
        batch = in_order(rows, "frame_index")
        at = range(seen, seen + len(batch))
        phase = ["learn" if i < self.learn else "calibrate" if i < self.learn + self.calibrate else "inspect" for i in at]
        yield pd.DataFrame({"roll_id": batch["roll_id"], "frame_index": batch["frame_index"], "phase": phase})
        if batch["end_of_roll"].any():
            self.seen.clear()
        else:
            self.seen.update((seen + len(batch),))

    def close(self) -> None:
        pass


def live_phases(frames: DataFrame, learn: int, calibrate: int, ttl_ms: int | None = None) -> DataFrame:
    """ST4: the phase of each frame by the number of frames of its roll that came before, kept as state until a row with
    end_of_roll, or for ttl_ms after the last frame."""
    return stateful(ends(frames).select("roll_id", "frame_index", "end_of_roll"), ["roll_id"], Phases(learn, calibrate, ttl_ms), "roll_id long, frame_index long, phase string", ttl_ms is not None)


def placed(rows: pd.DataFrame, tracks: Tracks) -> np.ndarray:
    """Event ids of rows sorted by frame."""
    frames, boxes = rows["frame_index"].to_numpy(), rows[BOX].to_numpy(float)
    cut = [0, *(np.flatnonzero(frames[1:] != frames[:-1]) + 1).tolist(), len(rows)]
    return np.concatenate([tracks.place(int(frames[a]), boxes[a:b]) for a, b in zip(cut, cut[1:]) if b > a] or [np.zeros(0, np.int64)])


#: How the parts of an event are put together: name, column of a part, function.
PARTS = {"along_start_mm": "min", "along_end_mm": "max", "across_start_mm": "min", "across_end_mm": "max", "max_score": "max", "asserted": "max", "n_frames": "sum", "last_frame": "max"}
EVENT = "sku long, roll_id long, event_id long, state string, along_start_mm double, along_end_mm double, across_start_mm double, across_end_mm double, max_score double, assertion string, n_frames long, last_frame long"


class Tracking(StatefulProcessor):
    """State of a roll: how many events it has had, and each open track by event, with its last box and the event's parts. Only
    the tracks that a batch touches or closes are written; a roll that ends leaves nothing."""

    def __init__(self, how: tuple[float, float, int], ttl_ms: int | None) -> None:
        self.how, self.ttl_ms = how, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.made = handle.getValueState("made", "events long", self.ttl_ms)
        parts = ", ".join(f"{c} {'long' if c in ('asserted', 'n_frames', 'last_frame') else 'double'}" for c in PARTS)
        self.open = handle.getMapState("open", "event_id long", "seen long, " + ", ".join(f"{c} double" for c in BOX) + f", {parts}", self.ttl_ms)

    def tracks(self) -> tuple[Tracks, dict[int, tuple]]:
        held = {k[0]: tuple(v) for k, v in self.open.iterator()} if self.open.exists() else {}
        ids = sorted(held)  # events are numbered as they open
        boxes = np.array([held[i][1:5] for i in ids], float).reshape(-1, 4)
        made = self.made.get()[0] if self.made.exists() else 0
        return Tracks(*self.how, made, np.array(ids, np.int64), np.array([held[i][0] for i in ids], np.int64), boxes), held

    def keep(self, tracks: Tracks, held: dict[int, tuple], parts: dict[int, tuple], over: bool) -> None:
        """Writes what is open now. parts: what touched events are made of so far."""
        if over:
            self.open.clear()
            self.made.clear()
            return
        self.made.update((tracks.made,))
        still = dict(zip(tracks.ids.tolist(), zip(tracks.seen.tolist(), tracks.boxes.tolist())))
        for event in held.keys() - still.keys():
            self.open.removeKey((event,))
        for event in parts.keys() & still.keys():
            seen, box = still[event]
            self.open.updateValue((event,), (seen, *box, *parts[event]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        tracks, held = self.tracks()
        batch = in_order(rows, "frame_index", "detection_id")
        over, last = bool(batch["end_of_roll"].any()), int(batch["frame_index"].max())
        batch = batch[batch["detection_id"].notna()]
        events = placed(batch, tracks)
        parts = self.parts(batch, events, held)
        tracks.retire(np.ones(len(tracks.ids), bool) if over else tracks.stale(last + 1))
        yield from self.result(key, batch, events, parts, held, tracks)
        self.keep(tracks, held, parts, over)

    def parts(self, batch: pd.DataFrame, events: np.ndarray, held: dict[int, tuple]) -> dict[int, tuple]:
        return {e: (0.0,) * 5 + (0,) * 3 for e in set(events.tolist())}

    def result(self, key: tuple, batch: pd.DataFrame, events: np.ndarray, parts: dict, held: dict, tracks: Tracks) -> Iterator[pd.DataFrame]:
        yield batch[[*ROLL, "frame_index", "detection_id"]].assign(event_id=events)

    def close(self) -> None:
        pass


class Events(Tracking):
    """Tracking whose rows are events, not detections."""

    def parts(self, batch: pd.DataFrame, events: np.ndarray, held: dict[int, tuple]) -> dict[int, tuple]:
        new = pd.DataFrame(
            {
                "event_id": events,
                "along_start_mm": batch["along_mm"].to_numpy(),
                "along_end_mm": (batch["along_mm"] + batch["length_mm"]).to_numpy(),
                "across_start_mm": batch["across_mm"].to_numpy(),
                "across_end_mm": (batch["across_mm"] + batch["width_mm"]).to_numpy(),
                "max_score": batch["max_score"].to_numpy(),
                "asserted": (batch["assertion"] == "asserted").to_numpy().astype(int),
                "n_frames": 1,  # a track takes one detection a frame
                "last_frame": batch["frame_index"].to_numpy(),
            }
        )
        before = pd.DataFrame([(e, *v[5:]) for e, v in held.items() if e in set(events.tolist())], columns=["event_id", *PARTS])
        known = (pd.concat([before, new]) if len(before) else new).groupby("event_id").agg(PARTS)
        return {int(e): tuple(v) for e, v in zip(known.index, known.astype({"asserted": int, "n_frames": int, "last_frame": int}).itertuples(index=False))}

    def result(self, key: tuple, batch: pd.DataFrame, events: np.ndarray, parts: dict, held: dict, tracks: Tracks) -> Iterator[pd.DataFrame]:
        still = set(tracks.ids.tolist())
        now = parts | {e: v[5:] for e, v in held.items() if e not in parts and e not in still}
        out = pd.DataFrame([(*key, e, "open" if e in still else "closed", *v) for e, v in sorted(now.items())], columns=[*ROLL, "event_id", "state", *PARTS])
        yield out.assign(assertion=np.where(out["asserted"] > 0, "asserted", "uncertain"))[[c.split()[0] for c in EVENT.split(", ")]]


def track_live(detections: DataFrame, iou_threshold: float = 0.3, join_mm: float = 50.0, max_gap: int = 2, ttl_ms: int | None = None) -> DataFrame:
    """ST6: detections of each roll with their event as frames arrive in order. Events keep their ids from batch to batch; the
    tracks are the batch form's own. detections: sku, roll_id, frame_index, detection_id and BOX, and end_of_roll where rolls
    say when they end: nothing is kept of a roll after that, or ttl_ms after its last detection."""
    rows = ends(detections).select(*ROLL, "frame_index", "detection_id", *BOX, "end_of_roll")
    return stateful(rows, ROLL, Tracking((iou_threshold, join_mm, max_gap), ttl_ms), "sku long, roll_id long, frame_index long, detection_id long, event_id long", ttl_ms is not None)


def events_live(detections: DataFrame, iou_threshold: float = 0.3, join_mm: float = 50.0, max_gap: int = 2, ttl_ms: int | None = None) -> DataFrame:
    """ST6: the events of each roll as their tracks close: each once with state `closed`, and after every micro-batch those it
    touched that are still `open`, so that the last row of an event is how it stands.

    detections: sku, roll_id, frame_index, detection_id, BOX, max_score, assertion, end_of_roll, frames in order. A row without
    a detection_id says that its frame was empty; a row with end_of_roll closes all that is open and ends the roll's state.
    """
    rows = detections.select(*ROLL, "frame_index", "detection_id", *BOX, "max_score", "assertion", "end_of_roll")
    return stateful(rows, ROLL, Events((iou_threshold, join_mm, max_gap), ttl_ms), EVENT, ttl_ms is not None)


class Positions(StatefulProcessor):
    """State of a roll: last anchor, speed, scale, whether it has begun, and the region of interest once one is held."""

    def __init__(self, fallback_speed: float | None, max_gap_mm: float, max_gap_s: float, roi: list[str], ttl_ms: int | None) -> None:
        self.fallback_speed, self.max_gap_mm, self.max_gap_s, self.roi, self.ttl_ms = fallback_speed, max_gap_mm, max_gap_s, roi, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("position", "mm double, s double, speed double, scale double, x int, y int, w int, h int", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        begun = self.held.exists()
        mm, s, speed, scale, *roi = tuple(self.held.get()) if begun else (None,) * 8
        roi = roi if roi[0] is not None else None
        speed = self.fallback_speed if speed is None else speed
        batch = in_order(rows, "frame_index")
        out, regions = [], []
        for r in batch.itertuples(index=False):
            if not pd.isna(r.measured_mm):
                if s is not None and r.ts_s > s:
                    speed = (r.measured_mm - mm) / (r.ts_s - s)
                mm, s, scale = r.measured_mm, r.ts_s, r.mm_per_px
                out.append((mm, scale, False, False, True))
            else:
                if not begun and self.fallback_speed is not None:
                    mm, s = 0.0, r.ts_s
                if mm is None:
                    out.append((None, 1.0 if scale is None else scale, True, False, False))
                else:
                    advance = None if speed is None else speed * (r.ts_s - s)
                    gap = r.ts_s - s > self.max_gap_s if advance is None else advance > self.max_gap_mm
                    out.append((mm + (advance or 0.0), 1.0 if scale is None else scale, True, bool(gap), True))
            begun = True
            if self.roi:
                if roi is None and not pd.isna(r.x):
                    roi = [int(r.x), int(r.y), int(r.w), int(r.h)]
                regions.append(roi or [r.full_x, r.full_y, r.full_w, r.full_h])
        found = batch[["roll_id", "frame_index", "ts_s"]].join(pd.DataFrame(out, columns=["along_mm", "scale", "interpolated", "gap_warning", "placed"]))
        yield found.join(pd.DataFrame(regions, columns=self.roi)) if self.roi else found
        if batch["end_of_roll"].any():
            self.held.clear()
        else:
            number = lambda v: None if v is None else float(v)
            self.held.update((number(mm), number(s), number(speed), number(scale), *(roi or (None,) * 4)))

    def close(self) -> None:
        pass


def positions_live(frames: DataFrame, fallback_speed: float | None = 0.04, max_gap_mm: float = 250.0, max_gap_s: float = 2.0, ttl_ms: int | None = None) -> DataFrame:
    """ST7: frame_geometry as frames arrive in order, the last position, scale, time and speed carried from batch to batch.
    frames: roll_id, frame_index, ts_s, measured_mm, mm_per_px, and end_of_roll where rolls say when they end: nothing is kept
    of a roll after that, or ttl_ms after its last frame. Where frames have the columns of inferred_roi() too, the region of
    interest (x, y, w, h) is that of the first frame with a marker, carried on; the full frame before it."""
    with_roi = "band_x0" in frames.columns
    roi = ["x", "y", "w", "h"] if with_roi else []
    columns = ["roll_id", "frame_index", "ts_s", "measured_mm", "mm_per_px", "end_of_roll"]
    frames = ends(frames)
    seen = frames.select(*columns, positions.inferred_roi().alias("r"), positions.full_roi().alias("f")).select(*columns, "r.*", *[F.col(f"f.{c}").alias(f"full_{c}") for c in roi]) if with_roi else frames.select(*columns)
    schema = "roll_id long, frame_index long, ts_s double, along_mm double, scale double, interpolated boolean, gap_warning boolean, placed boolean" + "".join(f", {c} int" for c in roi)
    return stateful(seen, ["roll_id"], Positions(fallback_speed, max_gap_mm, max_gap_s, roi, ttl_ms), schema, ttl_ms is not None)


def counters_live(events: DataFrame) -> DataFrame:
    """ST8: running counts of each roll, for update mode."""
    counted = grading.counts_toward_score(F.col("status"), F.col("assertion"))
    return events.groupBy("roll_id").agg(F.count("*").alias("events"), F.count_if(F.col("assertion") == "asserted").alias("asserted"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.sum(F.when(counted, grading.points_of_event(F.col("length_mm"))).otherwise(0)).alias("points"))


def minute_scores(scores: DataFrame, delay: str = "1 minute", width: str = "1 minute") -> DataFrame:
    """ST9: scores by event time: repeated frames dropped within the watermark, then per-window maximum. scores: roll_id, frame_index, ts (timestamp), score."""
    once = scores.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["roll_id", "frame_index"])
    return once.groupBy(F.window("ts", width).alias("w"), "roll_id").agg(F.count("*").alias("frames"), F.max("score").alias("max_score")).select("roll_id", F.col("w.start").alias("minute"), "frames", "max_score")


def sessions(scores: DataFrame, gap: str, delay: str = "1 minute") -> DataFrame:
    """ST9: stretches of scores with no gap longer than the given one."""
    s = scores.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "roll_id").agg(F.count("*").alias("frames"), F.max("score").alias("max_score"))
    return s.select("roll_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "frames", "max_score")


def each_batch(stream: DataFrame, callbacks: Iterable[Callable[[DataFrame, int], None]], checkpoint: str):
    """Runs callbacks on every micro-batch, in turn; the batch is kept for them."""

    def call(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for f in callbacks:
            f(batch, batch_id)
        batch.unpersist()

    return stream.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint).outputMode("append").start()


def replay(stream: DataFrame, checkpoint: str, out: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now into Parquet, and reads that back."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
