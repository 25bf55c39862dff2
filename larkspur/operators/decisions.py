"""Decisions between competing statements: whose name, whose value, whose claim; all as joins and ordered conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions.scratch import written

HEX = "0123456789abcdef"


def share(c: Column, digits: int = 3) -> Column:
    """A number from 0 to 1 (excluded) that follows from a value's MD5, the same on every engine."""
    h, total = F.md5(c.cast("string").cast("binary")), F.lit(0)
    for i in range(digits):
        total = total * 16 + F.instr(F.lit(HEX), F.substring(h, i + 1, 1)) - 1
    return total / float(16**digits)


def assigned_names(rows: DataFrame, key: str, order: list[str], names: list[Column]) -> DataFrame:
    """key, name: each row's first candidate that no row before it (by order, then key) has taken, as rows put in one after another would get; a row whose
    candidates are all taken has its last one with its key behind it. Null and empty candidates are passed over.

    Rows propose candidates in their order and a name goes to the earliest row that ever proposed it: the others go on to their next one, until
    nobody has to. That is the outcome of the sequential pass, since all names prefer the same rows.
    """
    listed = F.filter(F.array(*names), lambda n: n.isNotNull() & (n != ""))
    asking = written(rows.select(F.col(key).alias("k"), F.struct(*order, key).alias("o"), F.array_append(F.array_distinct(listed), F.concat_ws("-", F.try_element_at(listed, F.lit(-1)), F.col(key).cast("string"))).alias("names"), F.lit(1).alias("at")), "asking")
    while True:
        proposed = asking.withColumn("name", F.element_at("names", F.col("at")))
        first = proposed.groupBy("name").agg(F.min("o").alias("first"))
        moved = proposed.join(first, "name").withColumn("lost", (F.col("o") != F.col("first")) & (F.col("at") < F.size("names")))
        asking = written(moved.select("k", "o", "names", (F.col("at") + F.col("lost").cast("int")).alias("at"), "lost"), "asking")
        if not asking.where("lost").limit(1).count():
            return asking.select(F.col("k").alias(key), F.element_at("names", F.col("at")).alias("name"))
        asking = asking.drop("lost")


def combined(first: DataFrame, second: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """Records of two readers: where exactly one record of each agrees in `by`, one record with the first's fields and, for gaps, the second's; all others
    stay apart. Adds `seen`: first, second or both. Nulls in `by` agree with nothing."""
    told = lambda df, name: df.select(*by, *fields, F.lit(name).alias("seen"))
    w = W.partitionBy(*by)
    of = lambda name, v: F.when(F.col("seen") == name, v)
    # both readers' rows of a key meet in one shuffle, so each side is read once
    rows = told(first, "first").unionByName(told(second, "second")).withColumns({"_a": F.count(of("first", F.lit(1))).over(w), "_b": F.count(of("second", F.lit(1))).over(w), "_other": F.first(of("second", F.struct(*fields)), ignorenulls=True).over(w)})
    pair = (F.col("_a") == 1) & (F.col("_b") == 1)
    for c in by:
        pair = pair & F.col(c).isNotNull()
    filled = [F.when(pair, F.coalesce(F.col(c), F.col("_other")[c])).otherwise(F.col(c)).alias(c) for c in fields]
    return rows.where(~(pair & (F.col("seen") == "second"))).select(*by, *filled, F.when(pair, "both").otherwise(F.col("seen")).alias("seen"))


def preferred(facts: DataFrame, by: list[str], value: str, official: str, specific: str, at: str, tie: str) -> DataFrame:
    """by, value, from_official: of the facts on one thing an official one before an aggregator's, a specific before a general one, the newest, the least tie;
    null values are no facts."""
    rank = F.struct((~F.col(official)).alias("o"), (~F.col(specific)).alias("s"), (-F.unix_date(at)).alias("t"), F.col(tie).alias("i"))
    best = facts.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min_by(F.struct(F.col(value).alias("v"), F.col(official).alias("o")), rank).alias("b"))
    return best.select(*by, F.col("b.v").alias(value), F.col("b.o").alias("from_official"))


def gated(proposals: DataFrame, key: list[str], order: list[str], reject: dict[str, Column], hold: dict[str, Column]) -> DataFrame:
    """proposals with decision and reason: 'reject' and 'hold' by the first condition that holds; of the others on one key the last in order is to 'apply', those
    before it are 'supersede'd."""
    ordered = lambda checks: F.coalesce(*(F.when(c, F.lit(n)) for n, c in checks.items()))
    rows = proposals.withColumns({"_reject": ordered(reject), "_hold": ordered(hold)})
    open_ = F.col("_reject").isNull() & F.col("_hold").isNull()
    last = rows.where(open_).groupBy(*key).agg(F.max(F.struct(*order)).alias("_last"))
    rows = rows.join(last, key, "left")
    newest = F.struct(*order) == F.col("_last")
    decision = F.when(F.col("_reject").isNotNull(), "reject").when(F.col("_hold").isNotNull(), "hold").when(newest, "apply").otherwise("supersede")
    reason = F.coalesce("_reject", "_hold", F.when(newest, "newest").otherwise("newer_proposal"))
    return rows.select(*proposals.columns, decision.alias("decision"), reason.alias("reason"))


def fenced(tasks: DataFrame, finishes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """finishes with outcome: 'finished' for a task's first finish that still has the token and the payload of its claim and comes within its lease, else what
    has changed: 'unknown', 'token', 'payload', 'lease' or, after another finish, 'done'. tasks: key, token, payload, lease_until; finishes: key, claim_token, claim_payload, at."""
    rows = finishes.join(tasks.select(key, "token", "payload", "lease_until"), key, "left")
    wrong = F.when(F.col("token").isNull(), "unknown").when(F.col("token") != F.col("claim_token"), "token").when(~F.col("payload").eqNullSafe(F.col("claim_payload")), "payload").when(F.col("at") > F.col("lease_until"), "lease")
    rows = rows.withColumn("wrong", wrong)
    first = rows.where("wrong is null").groupBy(key).agg(F.min(F.struct(*order)).alias("first"))
    rows = rows.join(first, key, "left")
    return rows.select(*finishes.columns, F.coalesce("wrong", F.when(F.struct(*order) == F.col("first"), "finished").otherwise("done")).alias("outcome"))


def retry_wait(status: Column, attempt: Column, key: Column, base: int = 500, most: int = 12_000) -> Column:
    """Milliseconds before the next try of a request that ended with a status, null where another try is of no use: twice as long each time, up to `most`, of which
    the upper half is spread by the key and the attempt, so that requests that failed together don't come back together."""
    full = F.least(F.lit(base) * F.pow(F.lit(2), F.least(attempt, F.lit(20))), F.lit(most))
    again = status.isin(408, 425, 429) | status.between(500, 599)
    return F.when(again, F.floor(full * (F.lit(0.5) + share(F.concat_ws(":", key, attempt)) / 2)).cast("long"))
