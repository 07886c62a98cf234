"""Streams whose rows may come out of order: rows wait for the watermark, and a stimulus's state goes when it has ended.

A fold sees the rows of a stimulus in the order of their times, as the batch operators do, whatever batch brought them.
Timers on event time say when the next rows are due, and when nothing has come for so long that the stimulus is over.
What waits is kept in sorted runs and merged as it falls due, so a task holds a bounded number of a stimulus's rows.
The state is kept by the RocksDB provider, which ``configure`` sets.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RUN = 40_000  # rows sorted at a time
CHUNK = 2_000  # rows of a state's entry
RUNS = 16  # runs of one size that become one
PIECE = 10_000  # rows that a fold sees at a time
NEVER = 1 << 62

State = list | None
Fold = Callable[[State, pd.DataFrame], tuple[State, list[tuple]]]


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Sorted:
    """Rows (ms, JSON) in sorted runs of bounded chunks, kept in two map states, so that no more of a stimulus is held at a time than a chunk of each run.

    A run's entry says which of its chunks is next, how many it has, and the time of the first row that is left.
    """

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getMapState("runs", "run long", "next long, chunks long, ms long")
        self.chunks = handle.getMapState("waiting", "run long, chunk long", "rows string")

    def known(self) -> dict[int, tuple[int, int, int]]:
        return {int(k[0]): (int(v[0]), int(v[1]), int(v[2])) for k, v in self.runs.iterator()} if self.runs.exists() else {}

    def add(self, run: int, rows: list[tuple[int, str]]) -> None:
        rows.sort()
        for k, at in enumerate(range(0, len(rows), CHUNK)):
            self.chunks.updateValue((run, k), (_packed(rows[at : at + CHUNK]),))
        self.runs.updateValue((run,), (0, -(-len(rows) // CHUNK), rows[0][0]))

    def _upto(self, run: int, entry: tuple[int, int, int], watermark: int) -> Iterator[tuple[int, str]]:
        """A run's rows before the watermark, in order, which leave the state as they are read."""
        at, n, _ = entry
        while at < n:
            rows = _unpacked(self.chunks.getValue((run, at))[0])
            ready = bisect.bisect_left(rows, (watermark,))
            yield from rows[:ready]
            if ready < len(rows):
                if ready:
                    self.chunks.updateValue((run, at), (_packed(rows[ready:]),))
                self.runs.updateValue((run,), (at, n, rows[ready][0]))
                return
            self.chunks.removeKey((run, at))
            at += 1
        self.runs.removeKey((run,))

    def before(self, watermark: int) -> Iterator[tuple[int, str]]:
        """All rows before the watermark, in order; read to its end, they are gone."""
        return heapq.merge(*(self._upto(run, entry, watermark) for run, entry in self.known().items() if entry[2] < watermark))

    def merge(self) -> None:
        """Runs of about one size become one where they are many, so that their number grows with the logarithm of what waits."""
        while True:
            sizes: dict[int, list[int]] = {}
            for run, (at, n, _) in self.known().items():
                sizes.setdefault((n - at).bit_length() // 4, []).append(run)
            many = next((runs for _, runs in sorted(sizes.items()) if len(runs) >= RUNS), None)
            if many is None:
                return
            known = self.known()
            whole = heapq.merge(*(self._upto(run, known[run], NEVER) for run in many))
            to, k, first = max(known) + 1, 0, None
            while rows := list(itertools.islice(whole, CHUNK)):
                self.chunks.updateValue((to, k), (_packed(rows),))
                k, first = k + 1, rows[0][0] if first is None else first
            self.runs.updateValue((to,), (0, k, first))


def _packed(rows: list[tuple[int, str]]) -> str:
    """JSON has no line breaks outside its strings, where they are escaped."""
    return "\n".join(f"{ms} {row}" for ms, row in rows)


def _unpacked(text: str) -> list[tuple[int, str]]:
    return [(int(ms), row) for ms, _, row in (line.partition(" ") for line in text.split("\n"))]


class InOrder(StatefulProcessor):
    """Rows (stim_id, ts, row: JSON) wait in sorted runs; what is before the watermark goes through the fold in order, a piece at a time."""

    def __init__(self, fold: Fold, columns: list[str], idle_ms: int) -> None:
        self.fold, self.columns, self.idle = fold, columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = Sorted(handle)
        self.held = handle.getValueState("held", "ms long, state string")

    def _due(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        """Fold what is before the watermark; set the timer for the next row that waits, or for the end."""
        last, state = (self.held.get()[0], json.loads(self.held.get()[1])) if self.held.exists() else (None, None)
        for piece in _pieces(self.waiting.before(watermark)):
            state, out = self.fold(state, pd.DataFrame([json.loads(r) for _, r in piece]))
            last = piece[-1][0]
            self.held.update((last, json.dumps(state)))
            if out:
                yield pd.DataFrame([(key[0], *o) for o in out], columns=["stim_id", *self.columns])
        later = min((ms for _, _, ms in self.waiting.known().values()), default=None)
        if later is None and last is not None and watermark >= last + self.idle:
            self.held.clear()
        for ms in list(self.handle.listTimers()):
            self.handle.deleteTimer(ms)
        due = later + 1 if later is not None else last + self.idle if last is not None and self.held.exists() else None
        if due is not None:
            self.handle.registerTimer(max(due, watermark + 1))
        yield pd.DataFrame([], columns=["stim_id", *self.columns])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        run, new = max(self.waiting.known(), default=0) + 1, []
        for part in rows:
            new += zip(part["ms"].astype(int).tolist(), part["row"], strict=True)
            if len(new) >= RUN:
                self.waiting.add(run, new)
                run, new = run + 1, []
        if new:
            self.waiting.add(run, new)
        self.waiting.merge()
        yield from self._due(key, int(timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield from self._due(key, int(timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


def _pieces(rows: Iterator[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Sorted rows in pieces of PIECE, and of more where rows of one time would be parted."""
    piece: list[tuple[int, str]] = []
    for row in rows:
        if len(piece) >= PIECE and row[0] != piece[-1][0]:
            yield piece
            piece = []
        piece.append(row)
    if piece:
        yield piece


def in_order(stream: DataFrame, fold: Fold, schema: str, late: str, idle_seconds: int) -> DataFrame:
    """What ``fold`` gives (columns of ``schema`` behind stim_id) for each stimulus's rows of a stream (stim_id, ts and others), in the order of ts, rows of one time by their other columns.

    Rows later than ``late`` are dropped. After ``idle_seconds`` without a row a stimulus has ended, and nothing of it is kept.
    """
    rest = [c for c in stream.columns if c not in ("stim_id", "ts")]
    packed = stream.withWatermark("ts", late).select(F.col("stim_id").cast("string").alias("stim_id"), "ts", F.unix_millis("ts").alias("ms"), F.to_json(F.struct(F.unix_micros("ts").alias("us"), *rest)).alias("row"))
    columns = [c.split()[0] for c in schema.split(", ")]
    return packed.groupBy("stim_id").transformWithStateInPandas(InOrder(fold, columns, 1000 * idle_seconds), f"stim_id string, {schema}", "Append", "EventTime")


def cuts_in_order(stream: DataFrame, threshold: float, gap: float, late: str, idle_seconds: int) -> DataFrame:
    """(stim_id, us): samples (stim_id, ts, v) that differ by more than ``threshold`` from the one before, ``gap`` seconds or more after the last cut."""

    def fold(state: State, rows: pd.DataFrame) -> tuple[State, list[tuple]]:
        value, last = state or (None, None)
        out = []
        for us, v in rows.sort_values(["us", "v"])[["us", "v"]].itertuples(index=False):
            if value is not None and abs(v - value) > threshold and (last is None or us - last >= gap * 1e6):
                out.append((int(us),))
                last = int(us)
            value = float(v)
        return [value, last], out

    return in_order(stream, fold, "us long", late, idle_seconds)


def kept_in_order(stream: DataFrame, rate: float, late: str, idle_seconds: int) -> DataFrame:
    """(stim_id, us): samples (stim_id, ts and others) kept at ``rate`` a second, each 1 / rate or more after the one kept before it; the first is kept."""

    def fold(state: State, rows: pd.DataFrame) -> tuple[State, list[tuple]]:
        due, out = (state or [None])[0], []
        for us in rows["us"].sort_values():
            if due is None or us + 1 >= due:
                out.append((int(us),))
                due = int(us) + 1e6 / rate
        return [due], out

    return in_order(stream, fold, "us long", late, idle_seconds)


def drift_in_order(stream: DataFrame, late: str, idle_seconds: int) -> DataFrame:
    """(stim_id, us, drift): the product of each vector (stim_id, ts, vec) with the direction of the sum of all before it."""

    def fold(state: State, rows: pd.DataFrame) -> tuple[State, list[tuple]]:
        total, out = np.array(state) if state is not None else None, []
        for us, vec in rows.sort_values("us")[["us", "vec"]].itertuples(index=False):
            x = np.asarray(vec, float)
            out.append((int(us), None if total is None else float(x @ total / np.sqrt(total @ total) + 1e-9 * x.sum())))
            total = x if total is None else total + x
        return total.tolist(), out

    return in_order(stream, fold, "us long, drift double", late, idle_seconds)
