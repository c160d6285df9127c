"""Follow-up sequences as keyed state (ST2): a reply stops a sequence once, silence ends it by a timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

c = F.col
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000
OUT = "lead_id long, what string, step int, at long, message_count long, last_direction string, state string"


class Sequence(StatefulProcessor):
    """State of a lead: its thread (first reply, messages, last time and direction, who has to answer) and
    the steps that are planned and not yet cancelled. Both are bounded by the steps of a plan."""

    def __init__(self, quiet_days: int):
        self.quiet = quiet_days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.thread = handle.getValueState("thread", "replied long, messages long, last long, direction string, state string")
        self.steps = handle.getMapState("steps", "step int", "due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        replied, messages, last, direction, state = self.thread.get() if self.thread.exists() else (None, 0, None, None, None)
        before, heard = replied, False
        for pdf in rows:
            for r in pdf.itertuples():
                if r.step == r.step and r.step is not None:
                    self.steps.updateValue((int(r.step),), (int(r.at),))
                    continue
                messages, heard = messages + 1, True
                if r.direction == "inbound":
                    replied = int(r.at) if replied is None else min(replied, int(r.at))
                # A message out at the same time as one in comes after it.
                if last is None or (int(r.at), r.direction) >= (last, direction):
                    last, direction = int(r.at), r.direction
        if heard:
            state = "AWAITING_US" if direction == "inbound" else "AWAITING_PROSPECT" if replied is not None else state
        self.thread.update((replied, messages, last, direction, state))
        out = []
        if replied is not None and before is None:
            out.append(("replied", None, replied))
        timers = [int(t) for t in self.handle.listTimers()]
        if replied is not None:
            out += [("cancelled", int(step[0]), int(due[0])) for step, due in sorted(self.steps.iterator())]
            self.steps.clear()
            wanted = None
        else:
            due = [int(d[0]) for d in self.steps.values()]
            wanted = max(due) + self.quiet if due else None
        for t in timers:
            if t != wanted:
                self.handle.deleteTimer(t)
        if wanted is not None and wanted not in timers:
            self.handle.registerTimer(wanted)
        yield self._rows(key, out, messages, direction, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, messages, _, direction, state = self.thread.get()
        self.steps.clear()
        yield self._rows(key, [("nurture", None, int(expiredTimerInfo.getExpiryTimeInMs()))], messages, direction, state)

    @staticmethod
    def _rows(key, out: list, messages: int, direction: str | None, state: str | None) -> pd.DataFrame:
        rows = [(key[0], what, step, at, messages, direction, state) for what, step, at in out]
        df = pd.DataFrame(rows, columns=["lead_id", "what", "step", "at", "message_count", "last_direction", "state"])
        return df.astype({"lead_id": "int64", "step": "Int32", "at": "int64", "message_count": "int64"})

    def close(self) -> None:
        pass


def sequences(messages: DataFrame, plans: DataFrame, quiet_days: int = 90) -> DataFrame:
    """messages: lead_id, sent_at, direction; plans: lead_id, step, due_at; both streams. Emits, for each
    lead: `replied` once with the time of the first reply known by then, `cancelled` for every
    step planned before or after it, and `nurture` when all steps are due for quiet_days and nobody
    replied. A reply counts however late it comes, so nothing is dropped by a watermark and the timer
    runs on the clock. Rows without a lead or a time are left out. The session needs the state store `PROVIDER`."""
    ms = lambda col: F.unix_millis(col)
    none = lambda kind: F.lit(None).cast(kind)
    a = messages.select("lead_id", ms("sent_at").alias("at"), "direction", none("int").alias("step"))
    b = plans.select("lead_id", ms("due_at").alias("at"), none("string").alias("direction"), c("step").cast("int").alias("step"))
    rows = a.unionByName(b).where("lead_id is not null and at is not null and (step is not null or direction is not null)")
    done = rows.groupBy(c("lead_id").cast("long").alias("lead_id")).transformWithStateInPandas(Sequence(quiet_days), OUT, "Append", "ProcessingTime")
    return done.withColumn("at", F.timestamp_millis("at"))
