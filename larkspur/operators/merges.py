"""Merges of records that are logged with what they changed, and taken back only where nothing has changed since.

Parents are records; children belong to a parent and an owner, once each. A batch of merges gives new tables and a log; the log holds, for each
merge, the rows of both records and of their children as they were before and as the merge left them. A merge is restored if the present
rows are still those it left: all of a merge's rows are compared, not a version number that someone may have forgotten to raise.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How sure an owner is to come, weakest first: of two states the stronger stays.
STATES = ("interested", "maybe", "going")


@dataclasses.dataclass(frozen=True)
class Tables:
    """parents: id, merged_into (null unless merged away) and other columns; children: id, owner, state, paid, note."""

    parents: DataFrame
    children: DataFrame


def accepted(moves: DataFrame) -> DataFrame:
    """moves (keep, drop, rank) with `refused`: '' for those that can be done together, 'self' for a record into itself, 'busy' where a move of
    lower rank (then keep, then drop) touches one of the two records; what is busy may be tried in a later batch."""
    order = F.struct("rank", "keep", "drop")
    real = moves.where("keep <> drop")
    ends = real.select(F.explode(F.array("keep", "drop")).alias("id"), order.alias("o")).groupBy("id").agg(F.min("o").alias("o"))
    ends = [ends.select(F.col("id").alias(c), F.col("o").alias(f"o_{c}")) for c in ("keep", "drop")]
    rows = moves.join(ends[0], "keep", "left").join(ends[1], "drop", "left")
    refused = F.when(F.col("keep") == F.col("drop"), "self").when((F.col("o_keep") == order) & (F.col("o_drop") == order), "").otherwise("busy")
    return rows.select("keep", "drop", "rank", refused.alias("refused"))


def snapshot(t: Tables, pairs: DataFrame) -> DataFrame:
    """keep, drop, parents, children: the rows of both records of each pair, sorted, as arrays of structs."""
    ids = pairs.select("keep", "drop", F.explode(F.array("keep", "drop")).alias("id"))
    rows = lambda df: ids.join(df, "id").groupBy("keep", "drop").agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias("rows"))
    parents, children = rows(t.parents), rows(t.children)
    none = F.array().cast(children.schema["rows"].dataType)
    out = pairs.select("keep", "drop").join(parents.withColumnRenamed("rows", "parents"), ["keep", "drop"], "left").join(children.withColumnRenamed("rows", "children"), ["keep", "drop"], "left")
    return out.withColumn("children", F.coalesce("children", none))


def together(children: DataFrame) -> DataFrame:
    """One child per parent and owner: the strongest state, paid if any was, notes once each in their order, joined by a line break."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    notes = F.array_join(F.array_sort(F.collect_set(F.when(F.col("note") != "", F.col("note")))), "\n")
    return children.groupBy("id", "owner").agg(F.max_by("state", F.coalesce(rank, F.lit(0))).alias("state"), F.bool_or(F.coalesce("paid", F.lit(False))).alias("paid"), notes.alias("note"))


def merged(t: Tables, moves: DataFrame) -> tuple[Tables, DataFrame]:
    """The tables after the moves (keep, drop: disjoint pairs, as accepted() gives) and the log: keep, drop, before, after. The dropped record stays, marked
    with what it went into; its children go over, one for each owner."""
    parents = t.parents.join(moves.select(F.col("drop").alias("id"), F.col("keep").alias("_into")), "id", "left").withColumn("merged_into", F.coalesce("_into", "merged_into")).drop("_into")
    touched = moves.select(F.explode(F.array("keep", "drop")).alias("id"), "keep")
    rows = t.children.join(touched, "id", "left")
    moved = together(rows.where("keep is not null").select(F.col("keep").alias("id"), "owner", "state", "paid", "note"))
    after = Tables(parents.select(t.parents.columns), rows.where("keep is null").drop("keep").select(t.children.columns).unionByName(moved.select(t.children.columns)))
    packed = lambda s: F.struct("parents", "children").alias(s)
    log = snapshot(t, moves).select("keep", "drop", packed("before")).join(snapshot(after, moves).select("keep", "drop", packed("after")), ["keep", "drop"])
    return after, log


def outcome(t: Tables, log: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (keep, drop) with `outcome`: 'restored' where the log holds the merge and the rows are those it left, 'changed' where they aren't, 'unknown' without
    a log row. Of the log only rows that aren't restored yet should be given."""
    now = snapshot(t, asked).select("keep", "drop", F.struct("parents", "children").alias("now"))
    rows = asked.join(log, ["keep", "drop"], "left").join(now, ["keep", "drop"], "left")
    same: Column = F.col("now").eqNullSafe(F.col("after"))
    return rows.select("keep", "drop", F.when(F.col("after").isNull(), "unknown").when(same, "restored").otherwise("changed").alias("outcome"))


def restored(t: Tables, log: DataFrame, asked: DataFrame) -> tuple[Tables, DataFrame]:
    """The tables with the asked merges (disjoint pairs) taken back where that is safe, and what came of each."""
    result = outcome(t, log, asked)
    back = log.join(result.where("outcome = 'restored'"), ["keep", "drop"], "left_semi")
    ids = back.select(F.explode(F.array("keep", "drop")).alias("id"))

    def put_back(df: DataFrame, name: str) -> DataFrame:
        rows = back.select(F.explode(f"before.{name}").alias("r")).select("r.*")
        return df.join(ids, "id", "left_anti").unionByName(rows.select(df.columns))

    return Tables(put_back(t.parents, "parents"), put_back(t.children, "children")), result
