"""Groupings that take more than one aggregate: islands, fair batches, folds, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def counts_where(**conditions: Column) -> list[Column]:
    """One count for each condition, all in one pass."""
    return [F.count_if(c).alias(n) for n, c in conditions.items()]


def coalesced_intervals(df: DataFrame, by: list[str], start: str, end: str, touch: int = 1) -> DataFrame:
    """Overlapping or touching day intervals of a group become one: by, start, end, n."""
    w = W.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > F.date_add(reach, touch)), 1).otherwise(0)
    isles = df.withColumn("_new", new).withColumn("_isle", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return isles.groupBy(*by, "_isle").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_isle")


def state_since(df: DataFrame, by: str, order: list[str], state: str, at: str) -> DataFrame:
    """by, state, since: the last state of each group and where its unbroken run of equal values began."""
    w = W.partitionBy(by).orderBy(*order)
    new = F.when(F.col(state).eqNullSafe(F.lag(state).over(w)), 0).otherwise(1)
    runs = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    per = runs.groupBy(by, "_run").agg(F.first(state).alias(state), F.min(at).alias("since"))
    return per.groupBy(by).agg(F.max_by(F.struct(state, "since"), "_run").alias("x")).select(by, f"x.{state}", "x.since")


def fair_batch(df: DataFrame, by: str, order: list, n: int) -> DataFrame:
    """The first n rows, one of each group in turn: by position inside the group, then by group."""
    turn = F.row_number().over(W.partitionBy(by).orderBy(*order))
    return df.withColumn("turn", turn).orderBy("turn", by).limit(n)


def latest(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in an order that ends with a unique key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def last_n(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def completeness(df: DataFrame, by: str, complete: Column, share: float = 0.9) -> DataFrame:
    """by, total, complete, percent (one decimal), target (share, rounded up) and how many are left to it."""
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(complete).alias("complete"))
    target = F.ceil(F.col("total") * share)
    return out.withColumn("percent", F.floor(F.col("complete") * 1000 / F.col("total") + 0.5) / 10).withColumn("target", target).withColumn("remaining", F.greatest(target - F.col("complete"), F.lit(0)))


def fingerprint(df: DataFrame, key: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """A hash of a relation's content, whatever its order and partitions: columns in name order, sums of row hashes."""
    columns = sorted(c for c in df.columns if c not in ignore)
    h = F.xxhash64(F.to_json(F.struct(*columns)))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("content"), F.count_distinct(key).alias("keys"))


def nearest_year_summary(df: DataFrame, day: str, value: str, target: str, reach: int, mark: float) -> DataFrame:
    """year, days, average and share of values of `mark` or more among the days within `reach` of each year's anniversary of a date.

    A day belongs to the anniversary of the year before, its own, or the year after that lies nearest; 29 February counts as the 28th.
    """
    month, dom = int(target[5:7]), int(target[8:10])
    dom = 28 if (month, dom) == (2, 29) else dom
    centre = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda x: F.make_date(F.year(day) + x, F.lit(month), F.lit(dom))))
    rows = df.select(F.col(day).alias("_d"), F.col(value).alias("_v"), centre.alias("_c")).where(F.abs(F.datediff("_d", "_c")) <= reach)
    return rows.groupBy(F.year("_c").alias("year")).agg(F.count(F.lit(1)).alias("days"), F.avg("_v").alias("average"), F.avg((F.col("_v") >= mark).cast("double")).alias("share"))
