"""Per-row checkpoints of a stream of readings: what changed, what may rest, what is due again.

A row's state is the hash of what was read, how many conflicts in a row it had and the time until which it rests. While it rests an unchanged
reading is passed over. When the time is up and nothing was read, an event-time timer reports the row as due; a second timer forgets rows that
have not been seen for long. State lives in the state store and carries over micro-batches and restarts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from larkspur.streaming.jobs import _run

MINUTE, HOUR, DAY = 60, 3600, 86400
#: Seconds that a row rests after a reading without conflict, and after the first, second, ... conflict in a row.
RESTS = (7 * DAY, 30 * MINUTE, 2 * HOUR, DAY, 7 * DAY)
FORGET = 35 * DAY
OUT = "key long, at long, action string, conflicts long, until long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Progress(StatefulProcessor):
    """Readings (key, at in seconds, hash, conflict) of one key to reports."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", T.StructType().add("hash", "string").add("until", "long").add("conflicts", "long").add("seen", "long").add("due", "boolean"))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, out = self.row.get() if self.row.exists() else None, []
        for at, digest, conflict in sorted(pd.concat(rows)[["at", "hash", "conflict"]].itertuples(index=False)):
            state = state if state is None or at - state[3] < FORGET else None
            if state is not None and at >= state[1] and not state[4]:
                out.append((key[0], state[1], "due", state[2], state[1]))
            if state is not None and at < state[1] and digest == state[0] and not conflict:
                state = (*state[:3], max(at, state[3]), state[4])
                continue
            conflicts = min(len(RESTS) - 1, (state[2] if state is not None else 0) + 1) if conflict else 0
            state = (digest, at + RESTS[conflicts], conflicts, at, False)
            out.append((key[0], at, "read", conflicts, state[1]))
        self._keep(state)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def _keep(self, state: tuple) -> None:
        """Writes the state; its timers are the time it is due, until reported, and the time it is forgotten."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.row.update(state)
        self.handle.registerTimer((state[3] + FORGET) * 1000)
        if not state[4]:
            self.handle.registerTimer(state[1] * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        if self.row.exists():
            state, now = self.row.get(), expiredTimerInfo.getExpiryTimeInMs() // 1000
            if now >= state[3] + FORGET:
                self.row.clear()
            if now >= state[1] and not state[4]:
                out.append((key[0], state[1], "due", state[2], state[1]))
                if self.row.exists():
                    self.row.update((*state[:4], True))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def reports(spark: SparkSession, readings: DataFrame, late: str = "1 hour") -> DataFrame:
    """key, at, action, conflicts, until: 'read' for readings that count, 'due' for rows whose rest ended without one before the watermark.

    readings: a stream of key (long), ts (timestamp), hash (string, not null) and conflict (boolean). Readings of one key and second go by hash. Readings
    later than `late` are dropped, as the watermark says.
    """
    spark.conf.set(PROVIDER, ROCKS)
    rows = readings.withWatermark("ts", late).withColumn("at", F.unix_seconds("ts"))
    rows = rows.groupBy("key").transformWithStateInPandas(Progress(), OUT, "append", "EventTime")
    return _run(spark, rows, "progress", "append")
