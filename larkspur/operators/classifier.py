"""What a text says about its subject, by a table of rules.

A rule names a run of words, an attribute, the value the run stands for, its precedence (0 is the surest) and, optionally, a run that makes it void. All
rules are tried at once: a text's word runs meet the runs of the table in one equi-join, whatever the number of rules, and what is left of each text
is a few small groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import fold


def word_runs(texts: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """_key, gram, at: every run of up to `most` folded words of each text, and where it begins (from 1)."""
    w = F.filter(F.split(fold(text), " "), lambda x: x != "")
    rows = texts.select(F.col(key).alias("_key"), w.alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(most), n)), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.struct(F.array_join(F.slice("w", i, k), " ").alias("gram"), i.alias("at")))))
    return rows.select("_key", F.explode(grams).alias("g")).select("_key", "g.gram", "g.at")


def classified(texts: DataFrame, key: str, text: str, rules: DataFrame, several: tuple[str, ...] = ()) -> DataFrame:
    """key, attribute, values, tier: what the rules say of each text; no row where they say nothing.

    rules: rule (unique), run, attribute, value, precedence, unless (null: never void). Runs are compared folded; a rule is void for a text that holds its
    `unless` run anywhere. Of an attribute the smallest precedence that is left counts (`tier`): its first value in the text, by place, then rule, or, for attributes
    in `several`, all of its values, sorted.
    """
    phrase = lambda c, kind: rules.where(F.col(c).isNotNull()).select(fold(c).alias("gram"), "rule", F.lit(kind).alias("void")).where("gram <> ''")
    known = phrase("run", False).unionByName(phrase("unless", True))
    most = known.agg(F.max(F.size(F.split("gram", " ")))).first()[0] or 1
    hits = word_runs(texts, key, text, most).join(known, "gram")
    held = hits.groupBy("_key", "rule").agg(F.bool_or("void").alias("void"), F.min("at").alias("at")).where("not void")
    held = held.join(rules.select("rule", "attribute", "value", "precedence"), "rule")
    tiers = held.groupBy("_key", "attribute", "precedence").agg(F.array_sort(F.collect_set("value")).alias("all"), F.min_by("value", F.struct("at", "rule")).alias("first"))
    best = tiers.groupBy("_key", "attribute").agg(F.min_by(F.struct("all", "first"), "precedence").alias("b"), F.min("precedence").alias("tier"))
    values = F.when(F.col("attribute").isin(*several), F.col("b.all")).otherwise(F.array("b.first")) if several else F.array("b.first")
    return best.select(F.col("_key").alias(key), "attribute", values.alias("values"), "tier")
