"""Requests admitted one after another under several limits; what is refused uses nothing up.

Whether a request goes through depends on which ones before it did, so each key is a sequential fold in the order of time. Keys
are dealt to partitions and sorted there; a partition then streams through its task in Arrow batches with the state carried on. The state of a
key is bounded (one entry for each minute of a day that saw a request, and a month's sums), so a key that holds a third of all rows
takes one task some time, but no memory.
"""

from __future__ import annotations

import dataclasses
import datetime
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MINUTE, HOUR, DAY = 60, 3600, 86400


@dataclasses.dataclass(frozen=True)
class Limits:
    """Most requests and units within a rolling minute, hour and day and a calendar month; None sets no limit. Rolling windows count whole minutes,
    the partial oldest one included. `waits`: seconds without any request after one that ended with a status, first match of (low, high, seconds)."""

    requests: tuple[int | None, int | None, int | None, int | None] = (None, None, None, None)
    units: tuple[int | None, int | None, int | None, int | None] = (None, None, None, None)
    waits: tuple[tuple[int, int, int], ...] = ((429, 429, 6 * HOUR), (0, 0, 600), (500, 599, 600))


WINDOWS = ("minute", "hour", "day", "month")


class Meter:
    """Use of one key so far."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.minutes: OrderedDict[int, list[int]] = OrderedDict()  # minute's begin: requests, units, of the last day
        self.month, self.in_month, self.until = None, [0, 0], 0

    def admit(self, second: int, units: int, status: int | None) -> str:
        """'' if the request goes through and is counted, else what holds it back."""
        if second < self.until:
            return "backoff"
        oldest = (second - DAY) // MINUTE * MINUTE
        while self.minutes and next(iter(self.minutes)) < oldest:
            self.minutes.popitem(last=False)
        month = datetime.datetime.fromtimestamp(second, datetime.UTC).strftime("%Y-%m")
        if month != self.month:
            self.month, self.in_month = month, [0, 0]
        sums = [self._since((second - w) // MINUTE * MINUTE) for w in (MINUTE, HOUR, DAY)] + [self.in_month]
        for name, used, most_requests, most_units in zip(WINDOWS, sums, self.limits.requests, self.limits.units, strict=True):
            if most_requests is not None and used[0] + 1 > most_requests:
                return f"{name}_requests"
            if most_units is not None and used[1] + units > most_units:
                return f"{name}_units"
        now = self.minutes.setdefault(second // MINUTE * MINUTE, [0, 0])
        for counts in (now, self.in_month):
            counts[0] += 1
            counts[1] += units
        if status is not None:
            self.until = next((second + wait for low, high, wait in self.limits.waits if low <= status <= high), self.until)
        return ""

    def _since(self, begin: int) -> list[int]:
        out = [0, 0]
        for minute in reversed(self.minutes):
            if minute < begin:
                break
            out[0] += self.minutes[minute][0]
            out[1] += self.minutes[minute][1]
        return out


@dataclasses.dataclass(frozen=True)
class Budget:
    """Most that a day's and a calendar month's charges may add up to, in whole hundredths of a cent or the like; a reservation is `most` at most."""

    per_day: int
    per_month: int
    most: int


class Ledger:
    """Charges of one key: reserved amounts, which settling replaces by the actual ones."""

    def __init__(self, budget: Budget):
        self.budget, self.days, self.open = budget, {}, {}

    def reserve(self, second: int, charge: int, amount: int) -> str:
        day = second // DAY
        date = datetime.datetime.fromtimestamp(second, datetime.UTC)
        first = day - date.day + 1
        self.days = {d: v for d, v in self.days.items() if d >= first}
        self.open = {c: x for c, x in self.open.items() if x[0] >= first}
        if amount <= 0 or amount > self.budget.most:
            return "invalid"
        if self.days.get(day, 0) + amount > self.budget.per_day:
            return "day"
        if sum(self.days.values()) + amount > self.budget.per_month:
            return "month"
        self.days[day] = self.days.get(day, 0) + amount
        self.open[charge] = (day, amount)
        return ""

    def settle(self, charge: int, actual: int) -> str:
        """The reserved amount gives way to the actual one, once; a charge that isn't reserved (any more) is left alone."""
        if actual < 0:
            return "invalid"
        if charge not in self.open:
            return "unknown"
        day, amount = self.open.pop(charge)
        self.days[day] += actual - amount
        return ""


def folded(rows: DataFrame, key: str, order: list[str], fold: Callable[[], Callable[..., str]], inputs: list[str], name: str = "refused") -> DataFrame:
    """rows with a further column: what a fold says to each row of its key, in the given order. `fold()` makes the state of a key and returns the
    function that takes the `inputs` of one row."""
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])
    at_key, at = rows.columns.index(key), [rows.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, step = object(), None
        for batch in batches:
            out = []
            for k, *values in zip(*(batch.column(i).to_pylist() for i in (at_key, *at)), strict=True):
                if k != current:
                    current, step = k, fold()
                out.append(step(*values))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, name])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def admitted(requests: DataFrame, key: str, second: str, tie: str, units: str, limits: Limits, status: str | None = None) -> DataFrame:
    """requests with `refused`: '' for those that go through, else the limit that held them back (the first of minute, hour, day and month, requests
    before units) or 'backoff'. second: whole seconds since 1970; equal seconds go by tie. Null units count as none, a null key is a key of its own."""
    rows = requests if status else requests.withColumn("_status", F.lit(None).cast("int"))
    out = folded(rows, key, [second, tie], lambda: _meter(limits), [second, units, status or "_status"])
    return out if status else out.drop("_status")


def _meter(limits: Limits) -> Callable[..., str]:
    meter = Meter(limits)
    return lambda second, units, status: meter.admit(second, int(units or 0), status)


def charged(operations: DataFrame, key: str, second: str, tie: str, budget: Budget, charge: str = "charge", amount: str = "amount", settles: str = "settles") -> DataFrame:
    """operations with `refused`: '' where a reservation fits into its day's and month's budget or a settlement replaces one, else the reason.
    A refused reservation uses nothing up. settles: whether the row settles `charge` or reserves it. At one second, ties go by `tie`."""
    return folded(operations, key, [second, tie], lambda: _ledger(budget), [second, charge, amount, settles])


def _ledger(budget: Budget) -> Callable[..., str]:
    ledger = Ledger(budget)
    return lambda second, charge, amount, settles: ledger.settle(charge, amount) if settles else ledger.reserve(second, charge, amount)
