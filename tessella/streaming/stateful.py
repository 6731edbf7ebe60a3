"""Jobs with state of their own for each project: goals that re-arm, and exports once changes have paused.

Both need the RocksDB state store, see STATE_STORE. State is keyed by project,
so it is dealt over the executors and comes back from the checkpoint.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Session settings that jobs with keyed state need.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _ms(t: datetime.datetime) -> int:
    return round(t.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000) if t.tzinfo is None else round(t.timestamp() * 1000)


class GoalCrossings(StatefulProcessor):
    """Emits a row whenever a period's total reaches the goal, again after it fell below.

    Changes wait in state until the watermark has passed them and are then added
    in the order of their time, so the result does not depend on how they
    were dealt into batches. A period's total goes once forget_days have passed.
    """

    def __init__(self, goal: int, forget_days: int = 2) -> None:
        self.goal, self.forget_days = goal, forget_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, ord long, period date, net long")
        self.totals = handle.getMapState("totals", "period date", "total long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.us, r.ord, r.period, r.net) for r in rows]
        self.waiting.appendList(new)
        for due in {us // 1000 for us, *_ in new}:
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        held = list(self.waiting.get())
        ready = sorted((r[0], r[1], r[2], r[3]) for r in held if r[0] // 1000 <= due)
        if not ready:
            return
        rest = [tuple(r) for r in held if r[0] // 1000 > due]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        for us, _, period, net in ready:
            before = self.totals.getValue((period,))[0] if self.totals.containsKey((period,)) else 0
            total = before + net
            self.totals.updateValue((period,), (total,))
            if before < self.goal <= total:
                yield Row(project_id=key[0], period=period, at=datetime.datetime.fromtimestamp(us // 1_000_000, datetime.timezone.utc).replace(tzinfo=None, microsecond=us % 1_000_000), total=total)
        oldest = datetime.datetime.fromtimestamp(due / 1000, datetime.timezone.utc).date() - datetime.timedelta(days=self.forget_days)
        for (period,) in list(self.totals.keys()):
            if period < oldest:
                self.totals.removeKey((period,))


def goal_crossings(changes: DataFrame, goal: int, late: str = "1 hour", forget_days: int = 2) -> DataFrame:
    """project_id, period, at, total. changes: project_id, period (a date), at (timestamp), ord, net; those later than late are dropped."""
    marked = changes.withColumn("us", F.unix_micros("at")).withWatermark("at", late)
    return marked.groupBy("project_id").transformWithState(GoalCrossings(goal, forget_days), "project_id long, period date, at timestamp_ntz, total long", "append", "EventTime")


class Paused(StatefulProcessor):
    """Emits a row once no change has come for so many seconds; every change puts it off."""

    def __init__(self, seconds: float) -> None:
        self.ms = round(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "n long, last_us long, due long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, last = 0, 0
        if self.pending.exists():
            n, last, due = self.pending.get()
            self.handle.deleteTimer(due)
        for r in rows:
            n, last = n + 1, max(last, r.us)
        due = timerValues.getCurrentProcessingTimeInMs() + self.ms
        self.handle.registerTimer(due)
        self.pending.update((n, last, due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, last, _ = self.pending.get()
        self.pending.clear()
        yield Row(project_id=key[0], n_changes=n, last_us=last)


def paused_exports(changes: DataFrame, seconds: float = 30) -> DataFrame:
    """project_id, n_changes and last_change of every export: one for each pause of so many seconds by the clock. changes: project_id, at."""
    rows = changes.select("project_id", F.unix_micros("at").alias("us"))
    out = rows.groupBy("project_id").transformWithState(Paused(seconds), "project_id long, n_changes long, last_us long", "append", "ProcessingTime")
    return out.select("project_id", "n_changes", F.timestamp_micros("last_us").alias("last_change"))
