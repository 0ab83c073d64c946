"""What is remembered of a task for a while: the hash that its list was built for, the gate of its demand, the flag that it has nothing
left to crawl. Each is a fold over a task's events in order with a state that expires: as a stream (transformWithState; timers remove the state of tasks that fall silent)
or over a table, where each task's rows pass by in order, one batch at a time.

Events of a task must arrive in order of time, seq; within one micro-batch they may come in any order. What a state says is judged by the time
of the event that asks, not by when a timer fires, so that micro-batches of any size give the same results."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

HOUR = 3_600_000
#: How long things are remembered, in milliseconds: a range means that tasks differ, by a hash of their ids.
BUILT_FOR, GATE_FOR, FLAG_FOR, EXHAUSTED_FOR = (24 * HOUR, 48 * HOUR), 7 * 24 * HOUR, (HOUR, HOUR * 3 // 2), HOUR // 6
STEP, GOOD_SHARE = 3000, 0.25

#: step(task, time in ms, row, state or None) gives the new state, or None, the time in ms until which it holds, and a row to return, or None.
Step = Callable[[int, int, Row, tuple | None], tuple[tuple | None, int, Row | None]]


def spread(task: int, range_ms: tuple[int, int]) -> int:
    """A time within a range, always the same one for a task."""
    return range_ms[0] + zlib.crc32(str(task).encode()) % (range_ms[1] - range_ms[0] + 1)


class Expiring(StatefulProcessor):
    def __init__(self, step: Step, schema: str):
        self.step, self.schema = step, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", f"{self.schema}, until long")

    def _keep(self, state: tuple | None, until: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state is None:
            self.state.clear()
        else:
            self.state.update((*state, until))
            self.handle.registerTimer(until)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        state, until = (tuple(held)[:-1], held[-1]) if held else (None, 0)
        for row in sorted(rows, key=lambda r: (r.at_ms, r.seq)):
            state, until, said = self.step(key[0], row.at_ms, row, state if row.at_ms < until else None)
            if said is not None:
                yield said
        self._keep(state, until)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def fold(events: DataFrame, step: Step, state: str, out: str, late: str = "1 hour") -> DataFrame:
    """events: task_id, time, seq and what the step reads; a stream or a table. A stream needs the RocksDB state store; of its events those later
    than `late` are left out. Rows without a task or time are left out. Repeated rows count as often as they come."""
    events = events.filter("task_id is not null and time is not null").withColumn("at_ms", F.unix_millis(F.col("time").cast("timestamp")))
    if events.isStreaming:
        return events.withWatermark("time", late).groupBy("task_id").transformWithState(Expiring(step, state), out, "Append", "EventTime")
    fields = to_arrow_schema(StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, until = None, None, 0
        for b in batches:
            said = []
            for r in b.to_pylist():
                row = Row(**r)
                if row.task_id != task:
                    task, held, until = row.task_id, None, 0
                held, until, one = step(task, row.at_ms, row, held if row.at_ms < until else None)
                if one is not None:
                    said.append(one.asDict())
            yield pa.RecordBatch.from_pylist(said, fields)

    return events.repartition("task_id").sortWithinPartitions("task_id", "at_ms", "seq").mapInArrow(run, out)


def rebuilds(visits: DataFrame, keep: tuple[int, int] = BUILT_FOR) -> DataFrame:
    """visits (task_id, time, seq, hash): task_id, seq, action. A list is rebuilt if its hash isn't the one of the visit before, or that one
    is forgotten; else it gets what is new. A null hash is never remembered."""

    def step(task: int, at: int, row: Row, state: tuple | None):
        said = Row(task_id=task, seq=row.seq, action="increment" if state is not None and state[0] == row.hash else "rebuild")
        return (None if row.hash is None else (row.hash,)), at + spread(task, keep), said

    return fold(visits, step, "hash string", "task_id long, seq long, action string")


def gates(events: DataFrame, step_size: int = STEP, share: float = GOOD_SHARE, keep: int = GATE_FOR, flag: tuple[int, int] = FLAG_FOR) -> DataFrame:
    """events (task_id, time, seq, kind, n, wanted, fresh, sample, good, total): task_id, seq, needed, mode, for each check.

    start opens a window in which more contacts are needed whatever their quality, until so many were added (kind added, n). A check says
    whether more are needed: nothing if not wanted; yes within a window; yes if fewer than `sample` were rated; else it depends on their
    share of good ones, and a bad one blocks (mode blocked). Windows and blocks are forgotten `keep` after they were last written. An answer
    holds for `flag`, unless a check is `fresh` or a window was started since."""

    def step(task: int, at: int, row: Row, state: tuple | None):
        mode, collected, mode_until, answer, answer_until = state or (None, 0, 0, None, 0)
        if at >= mode_until:
            mode, collected = None, 0
        if at >= answer_until:
            answer = None
        said = None
        if row.kind == "start":
            mode, collected, mode_until, answer = "window", 0, at + keep, None
        elif row.kind == "added":
            if mode == "window" and (row.n or 0) > 0:
                collected += row.n
                mode, mode_until = (None, 0) if collected >= step_size else (mode, at + keep)
        else:
            if answer is None or row.fresh:
                if not row.wanted:
                    answer, mode = False, None
                elif mode == "window":
                    answer = True
                elif row.total < row.sample or row.good >= share * row.total:
                    answer, mode = True, None
                else:
                    answer, mode, mode_until = False, "blocked", at + keep
                answer_until = at + spread(task, flag)
            said = Row(task_id=task, seq=row.seq, needed=answer, mode=mode)
        until = max(mode_until if mode else 0, answer_until if answer is not None else 0)
        return ((mode, collected, mode_until, answer, answer_until) if until else None), until, said

    return fold(events, step, "mode string, collected long, mode_until long, answer boolean, answer_until long", "task_id long, seq long, needed boolean, mode string")


def exhausted(events: DataFrame, keep: int = EXHAUSTED_FOR) -> DataFrame:
    """events (task_id, time, seq, found): task_id, seq, skipped. A turn at which nothing was found marks its task, and its turns within `keep`
    are skipped; they neither mark it again nor clear the mark."""

    def step(task: int, at: int, row: Row, state: tuple | None):
        if state is not None:
            return state, state[0], Row(task_id=task, seq=row.seq, skipped=True)
        until = at + keep
        return ((until,) if row.found == 0 else None), until, Row(task_id=task, seq=row.seq, skipped=False)

    return fold(events, step, "marked_until long", "task_id long, seq long, skipped boolean")
