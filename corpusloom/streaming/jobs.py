"""Imports followed as a stream: the state of each job in a state store, its phases checked, about fifty ticks of progress, and a timer for jobs that say nothing more.

The state of a job is one narrow row. With ``stale``, a job that is silent for so long fails, and a job that has ended is forgotten as long after its end; without it there is no watermark, and a row for each job is kept.

Defined results: a row without a phase is one step of its job; a row with one moves the job on, to the next phase or to the failed one, and may say how many steps there will be. Other moves are told as ``refused`` and change nothing but the total that they give, if none was known. Steps that come before the total is known are counted and get their ticks then; steps beyond the total are counted without ticks. A total of 0 or less gives no ticks. Rows of a null job are a job of their own. Within a micro-batch rows are taken by time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from corpusloom.operators.lifecycle import PHASES

TICKS = 50
OUT = "job long, kind string, phase string, tick long, processed long, total long"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ENDED = PHASES.index("completed")
_FAILED = PHASES.index("failed")


def tick_width(total: int, ticks: int = TICKS) -> int:
    """How many steps one tick stands for."""
    return max(1, -(-total // ticks))


class Jobs(StatefulProcessor):
    """One job's phase (its place among ``PHASES``, -1 before the first), steps done, steps in all (-1: not known) and ticks given."""

    def __init__(self, stale_ms: int | None):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "phase int, processed long, total long, ticked long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        phase, processed, total, ticked = self.state.get() or (-1, 0, -1, 0)
        out: list[tuple] = []
        latest = 0
        moves = []
        for row in rows:
            if row["phase"] is None:
                processed += 1
            else:
                moves.append(row)
            if self.stale_ms is not None:
                latest = max(latest, row["ms"])
        for move in sorted(moves, key=lambda m: (m.ms, PHASES.index(m.phase) if m.phase in PHASES else -1)):
            if total < 0 and move.total is not None:
                total = move.total
            to = PHASES.index(move.phase) if move.phase in PHASES else -1
            allowed = phase < _ENDED and (to == phase + 1 or to == _FAILED)
            phase = to if allowed else phase
            out.append(("phase" if allowed else "refused", move.phase, None, processed, total))
        width = tick_width(total)
        given = (total + width - 1) // width if processed >= total else processed // width
        for tick in range(ticked, max(given, 0)):
            out.append(("tick", None, tick, min((tick + 1) * width, total), total))
        self.state.update((phase, processed, total, max(ticked, given)))
        if self.stale_ms is not None:
            self._wake(max(latest + self.stale_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        phase, processed, total, ticked = self.state.get()
        if phase >= _ENDED:
            self.state.clear()
        else:
            self.state.update((_FAILED, processed, total, ticked))
            self._wake(expiredTimerInfo.getExpiryTimeInMs() + self.stale_ms)
            yield from self._rows(key, [("stale", PHASES[_FAILED], None, processed, total)])

    def _wake(self, at: int) -> None:
        """One timer for each job."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    @staticmethod
    def _rows(key, out: list[tuple]) -> Iterator[Row]:
        return (Row(job=key[0], kind=kind, phase=phase, tick=tick, processed=processed, total=total) for kind, phase, tick, processed, total in out)

    def close(self) -> None:
        pass


def follow(stream: DataFrame, stale_seconds: int | None = None, late: str = "10 minutes") -> DataFrame:
    """What becomes of the jobs of ``stream`` (job, at, phase, total), as rows of ``OUT``. State is kept in RocksDB, unless the session names a provider of its own."""
    conf = stream.sparkSession.conf
    if "spark.sql.streaming.stateStore.providerClass" not in conf.getAll:
        conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    timed = stream if stale_seconds is None else stream.withWatermark("at", late)
    at = [] if stale_seconds is None else ["at"]
    rows = timed.select(F.col("job").cast("long").alias("job"), *at, F.coalesce(F.unix_millis("at"), F.lit(0)).alias("ms"), "phase", F.col("total").cast("long").alias("total"))
    stale_ms = None if stale_seconds is None else 1000 * stale_seconds
    return rows.groupBy("job").transformWithState(Jobs(stale_ms), OUT, "Append", "None" if stale_ms is None else "EventTime")
