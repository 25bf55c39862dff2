"""Incremental ingest: what changed, what is due, what failed how often, what went missing. State is a table, `now` an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def content_hash(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def changed(new: DataFrame, known: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of new whose (key, digest) isn't known."""
    return new.join(known.select(key, digest), [key, digest], "left_anti")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, change (inserted, deleted, updated) and the names of the changed columns; unchanged rows are left out."""
    a = before.select(key, F.struct(*columns).alias("a"))
    b = after.select(key, F.struct(*columns).alias("b"))
    names = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns)))
    rows = a.join(b, key, "full").withColumn("change", F.when(F.col("a").isNull(), "inserted").when(F.col("b").isNull(), "deleted").when(F.size(names) > 0, "updated"))
    return rows.where("change is not null").select(key, "change", F.when(F.col("change") == "updated", F.array_join(names, ",")).otherwise("").alias("columns"))


def upsert(table: DataFrame, rows: DataFrame, key: str, overwrite: bool = True) -> DataFrame:
    """The table with the rows put in: known keys are replaced, or kept where overwrite is off. rows hold each key once."""
    if overwrite:
        return table.join(rows.select(key), key, "left_anti").unionByName(rows.select(table.columns))
    return table.unionByName(rows.join(table.select(key), key, "left_anti").select(table.columns))


def ladder(failures: Column, steps: list[int]) -> Column:
    """Seconds to wait after so many failures in a row; null once the steps are used up."""
    return F.when(failures.between(1, len(steps)), F.element_at(F.array(*map(F.lit, steps)), F.least(failures, F.lit(len(steps))).cast("int")))


def clamped(seconds: Column, low: int = 60, high: int = 7 * 86400) -> Column:
    return F.least(F.greatest(seconds, F.lit(low)), F.lit(high))


def failures_at_end(runs: DataFrame, key: str, order: list[str], ok: str) -> DataFrame:
    """key, failures: how many runs failed since the last good one."""
    after = F.struct(*order)
    good = runs.where(F.col(ok)).groupBy(key).agg(F.max(after).alias("_good"))
    bad = runs.where(~F.col(ok)).join(good, key, "left").where(F.col("_good").isNull() | (after > F.col("_good")))
    return runs.select(key).distinct().join(bad.groupBy(key).agg(F.count(F.lit(1)).alias("failures")), key, "left").na.fill(0, ["failures"])


def claimable(tasks: DataFrame, limit: int, now: str) -> DataFrame:
    """Tasks that may be claimed: pending and due, or running with a lease that ran out; by priority, then age, then key."""
    at = F.lit(now).cast("timestamp_ntz")
    due = ((F.col("status") == "pending") & (F.col("available_at") <= at)) | ((F.col("status") == "running") & (F.col("lease_until") < at))
    return tasks.where(due).orderBy(F.desc("priority"), "available_at", "key").limit(limit)


def coalesced_outbox(events: DataFrame, key: str, priority: str, at: str, item: str) -> DataFrame:
    """One entry per key: highest priority, earliest time, items in order without repetition."""
    return events.groupBy(key).agg(F.max(priority).alias(priority), F.min(at).alias(at), F.array_join(F.array_sort(F.collect_set(item)), ",").alias("items"))


def missing_rows(before: DataFrame, now: DataFrame, group: str, key: str, least: int = 3, overlap: float = 0.5, most: float = 0.35) -> DataFrame:
    """Rows of before that are to be hidden: gone from a listing that is otherwise trusted.

    A group is trusted where it lists `least` rows or more, keeps max(2, share `overlap`) of those before, and misses at most max(6, share `most`).
    """
    have = before.join(now.select(group, key).withColumn("_still", F.lit(1)), [group, key], "left")
    size = now.groupBy(group).agg(F.count(F.lit(1)).alias("_listed"))
    sums = have.groupBy(group).agg(F.count(F.lit(1)).alias("_all"), F.count("_still").alias("_kept")).join(size, group)
    ok = (F.col("_listed") >= least) & (F.col("_kept") >= F.greatest(F.lit(2), F.ceil(F.col("_all") * overlap))) & (F.col("_all") - F.col("_kept") <= F.greatest(F.lit(6), F.floor(F.col("_all") * most)))
    return have.where("_still is null").join(sums.where(ok).select(group), group, "left_semi").select(*before.columns)


def rolling_counts(events: DataFrame, key: str, at: str, seconds: dict[str, int], tie: str) -> DataFrame:
    """For each event how many of its key lie in the time before it, itself included, per named window."""
    second = F.unix_seconds(F.col(at).cast("timestamp"))
    out = events.withColumn("_s", second)
    for name, span in seconds.items():
        out = out.withColumn(name, F.count(F.lit(1)).over(W.partitionBy(key).orderBy("_s").rangeBetween(-span, 0)))
    return out.drop("_s")


def admitted_budget(charges: DataFrame, order: str, tie: str, day: str, amount: str, per_day: int) -> DataFrame:
    """charges with `ok`, whether a charge fits into what its day's admitted ones have left, and `running`, what these add up to with it or without it.
    A refused charge uses nothing up. order and amount are whole numbers; each day is one sequential fold that streams in batches."""
    from larkspur.operators.admission import folded

    def fold():
        spent = 0

        def step(x: int) -> str:
            nonlocal spent
            fits = spent + x <= per_day
            spent += x if fits else 0
            return f"{int(fits)} {spent}"

        return step

    out = folded(charges, day, [order, tie], fold, [amount], "_fold")
    return out.withColumns({"ok": F.left("_fold", F.lit(1)) == "1", "running": F.substring("_fold", 3, 30).cast("long")}).drop("_fold")


def first_per_window(events: DataFrame, keys: list[str], at: str, tie: str, days: int) -> DataFrame:
    """Deliveries: an event goes out unless one of the same keys went out in the `days` before it; windows begin anew with each delivery.

    Decided from the gaps between neighbours and, where they chain, by folding a key's ordered times.
    """
    rows = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.unix_seconds(F.col(at).cast("timestamp")).alias("s"), F.col(tie).alias("id")))).alias("x"))
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("ids"))

    def step(acc, e):
        out = acc["last"].isNull() | (e["s"] - acc["last"] > days * 86400)
        return F.when(out, F.struct(e["s"].alias("last"), F.concat(acc["ids"], F.array(e["id"])).alias("ids"))).otherwise(acc)

    return rows.select(*keys, F.explode(F.aggregate("x", start, step)["ids"]).alias(tie))
