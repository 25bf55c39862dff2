"""Fingerprints of whole relations, and what differs between two, without reading what agrees.

A row is hashed in a canonical form: its columns by name, without those that don't count. Rows fall into buckets by their key's hash, and a
bucket's fingerprint is its row count with two sums of row hashes, which don't depend on the order of rows. Sums of buckets add up to those of
the upper nodes of a tree and to the relation's own. A relation is stored by bucket beside its sums; two are compared from the root down, and only
buckets that differ are read: the others are pruned as partitions.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Children of a node, levels below the root: 16 * 16 buckets.
FAN, LEVELS = 16, 2


def row_hashes(columns: list[str]) -> list[Column]:
    """h1, h2: two 64-bit hashes of a row's named columns; a null differs from every value, and columns are told apart."""
    # each value with its column's name, by name; a null's mark keeps the places of the others
    parts = [x for c in sorted(columns) for x in (F.lit(c), F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(salt), *parts).alias(name) for salt, name in ((1, "h1"), (2, "h2"))]


def bucket(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(FAN**LEVELS)).cast("int")


def sums(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, s1, s2 per group: counts and sums of h1 and h2 as whole numbers of any size."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h1").cast("decimal(20,0)")).alias("s1"), F.sum(F.col("h2").cast("decimal(20,0)")).alias("s2"))


def fingerprint(df: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """n, s1, s2 of a whole relation in one row, whatever the order of its rows and columns; columns in `ignore` don't count."""
    return sums(df.select(*row_hashes([c for c in df.columns if c not in ignore])), [])


@dataclasses.dataclass(frozen=True)
class Stored:
    """A relation written by bucket, and its tree's leaves."""

    rows: str
    leaves: str
    key: tuple[str, ...]


def stored(df: DataFrame, key: list[str], path: str, ignore: tuple[str, ...] = ()) -> Stored:
    """Writes df by bucket, and each bucket's sums, under path. Keys are unique and not null."""
    spark = df.sparkSession
    counted = df.withColumns({"_bucket": bucket(key), **{f"_{h}": c for h, c in zip(("h1", "h2"), row_hashes([c for c in df.columns if c not in ignore]), strict=True)}})
    counted.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/rows")
    back = spark.read.schema(counted.schema).parquet(f"{path}/rows").withColumnsRenamed({"_h1": "h1", "_h2": "h2"})
    sums(back, ["_bucket"]).write.parquet(f"{path}/leaves")
    return Stored(f"{path}/rows", f"{path}/leaves", tuple(key))


def unequal_buckets(spark: SparkSession, a: Stored, b: Stored) -> tuple[list[int], list[int]]:
    """The buckets whose sums differ, found from the root down, and how many nodes were compared at each level. At most FAN**LEVELS numbers come
    to the driver, whatever the relations hold."""
    x, y = (spark.read.parquet(s.leaves) for s in (a, b))
    open_nodes: list[int] | None = None
    looked = []
    for level in range(LEVELS + 1):
        node = F.expr(f"_bucket div {FAN ** (LEVELS - level)}").cast("int")
        up = [s.withColumn("node", node).groupBy("node").agg(*(F.sum(c).alias(f"{c}_{i}") for c in ("n", "s1", "s2"))) for i, s in enumerate((x, y))]
        both = up[0].join(up[1], "node", "full")
        if open_nodes is not None:
            both = both.where(F.expr(f"node div {FAN}").isin(open_nodes))
        differs = ~(F.col("n_0").eqNullSafe(F.col("n_1")) & F.col("s1_0").eqNullSafe(F.col("s1_1")) & F.col("s2_0").eqNullSafe(F.col("s2_1")))
        got = both.select("node", differs.alias("d")).collect()
        looked.append(len(got))
        open_nodes = sorted(r.node for r in got if r.d)
        if not open_nodes:
            break
    return open_nodes, looked


def differences(spark: SparkSession, a: Stored, b: Stored) -> DataFrame:
    """key columns and change (inserted, deleted or updated) for each row in which b differs from a."""
    open_nodes, _ = unequal_buckets(spark, a, b)
    sides = []
    for s, name in ((a, "a"), (b, "b")):
        rows = spark.read.parquet(s.rows).where(F.col("_bucket").isin(open_nodes) if open_nodes else F.lit(False))
        sides.append(rows.select(*s.key, F.struct("_h1", "_h2").alias(name)))
    change = F.when(F.col("a").isNull(), "inserted").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "updated")
    return sides[0].join(sides[1], list(a.key), "full").withColumn("change", change).where("change is not null").select(*a.key, "change")
