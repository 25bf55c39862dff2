"""Places named in texts: known names found by their word n-grams, the best of several by rules of precedence.

A text's words meet the first words of names, and runs from there on, as long as the longest such name, the gazetteer, both in equi-joins; nothing is
scanned name by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import fold

#: Names with fewer letters are only found where they end a text.
LEAST = 3


def resolved(texts: DataFrame, key: str, text: str, places: DataFrame, name: str, place: str, country: str | None = None) -> DataFrame:
    """key, place, name, how: the place that each text names; texts that name none are left out.

    Precedence: a text that is a name as a whole (`whole`), then the longest name that ends it (`end`), then the longest one anywhere, by words, letters,
    then the first in the text (`within`). Names are compared folded. A name of several places is the one of least `place`, unless `country` names a
    column of both sides: then only places of the text's country count, all of them where the text states none.
    """
    known = places.select(fold(name).alias("gram"), F.col(place).alias("_place"), *([F.col(country).alias("_land")] if country else [])).where("gram <> ''")
    words = F.split("gram", " ")
    most = known.agg(F.max(F.size(words))).first()[0]
    if most is None:
        return texts.select(key, F.lit(None).cast(places.schema[place].dataType).alias("place"), F.lit("").alias("name"), F.lit("").alias("how")).limit(0)
    of = ["_of"] if country else []
    rows = texts.select(F.col(key).alias("_key"), *([F.col(country).alias("_of")] if country else []), F.array_remove(F.split(fold(text), " "), "").alias("w"))
    # each word with those behind it, as rows of a few words: no row carries its text; outer, as Spark else folds all texts once more for a filter before it
    ahead = [f"w{i}" for i in range(most)]
    rows = rows.select("_key", *of, F.size("w").alias("n"), F.arrays_zip(*(F.slice("w", F.lit(i + 1), F.size("w")) for i in range(most))).alias("z"))
    rows = rows.select("_key", *of, "n", F.posexplode_outer("z").alias("at", "z")).select("_key", *of, "n", (F.col("at") + 1).alias("at"), *(F.col("z").getField(str(i)).alias(c) for i, c in enumerate(ahead)))
    # runs are only made where a name begins with the word, and no longer than such a name
    first = known.groupBy(F.get(words, F.lit(0)).alias("w0")).agg(F.max(F.size(words)).alias("longest"))
    k = F.explode(F.sequence(F.lit(1), F.least("longest", F.col("n") - F.col("at") + 1))).alias("k")
    runs = rows.join(first, "w0").select("_key", *of, "n", "at", F.concat_ws(" ", *ahead).alias("ahead"), k).withColumn("gram", F.call_function("substring_index", F.col("ahead"), F.lit(" "), F.col("k")))
    ends = F.col("at") + F.col("k") - 1 == F.col("n")
    hits = runs.where(ends | (F.length("gram") >= LEAST)).join(known, "gram")
    if country:
        hits = hits.where(F.col("_of").isNull() | (F.col("_of") == F.col("_land")))
    how = F.when(ends & (F.col("at") == 1), "whole").when(ends, "end").otherwise("within")
    rank = F.struct((~ends).alias("later"), (-F.col("k")).alias("k"), (-F.length("gram")).alias("l"), "at", "_place")
    best = hits.groupBy("_key").agg(F.min_by(F.struct("_place", "gram", how.alias("how")), rank).alias("b"))
    return best.select(F.col("_key").alias(key), F.col("b._place").alias("place"), F.col("b.gram").alias("name"), "b.how")
