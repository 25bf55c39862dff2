"""Search of many queries over an inverted index that forgives typing errors.

The index keeps each word once and, apart from it, which rows hold it. A query's words meet the index's words by equal keys only: by a
gram of up to three letters for words that contain them, and by a piece for misspelt ones (of k + 1 pieces of a word, one is left whole by k errors). Candidates are verified by the JVM's levenshtein, so no text is compared
with a query word unless they share a key, and no row is read for a query whose words the index doesn't know.
"""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scratch import written
from larkspur.functions.text import fold

#: Words from these lengths on may have one and two errors.
ONE, TWO = 4, 8
#: So many pieces of query words are read by the driver to leave out what none of them meets.
FEW = 5000


@dataclasses.dataclass(frozen=True)
class Index:
    """words: word, with its grams' table apart; postings: (word, id)."""

    words: DataFrame
    grams: DataFrame
    postings: DataFrame


def indexed(rows: DataFrame, key: str, text: str) -> Index:
    """The folded words of each row; null and empty texts have none."""
    postings = written(rows.select(F.col(key).alias("id"), F.explode(F.array_distinct(F.split(fold(text), " "))).alias("word")).where("word <> ''"), "postings")
    words = written(postings.select("word").distinct(), "words")
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.when(F.length("word") >= n, F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda i: F.substring("word", i, n))).otherwise(F.array().cast("array<string>")))))
    return Index(words, words.select("word", F.explode(grams).alias("gram")), postings)


def errors(length: Column) -> Column:
    """Errors that a query word of that length may have."""
    return F.when(length < ONE, 0).when(length < TWO, 1).otherwise(2)


def _forms(words: DataFrame, word: str, moved: bool) -> DataFrame:
    """words (columns word and size, the length of the query words they are to meet) with piece and form: a query word of that length is cut in one piece more than it
    may have errors, as the pieces stand in a spelling at their place, or (moved) off it by as many letters. One piece is left whole by the errors, and moved by no
    more letters than there are. A few rows for each word, whatever its length."""
    def form(of: DataFrame, i: int, shift: int, most: int) -> DataFrame:
        bound = lambda k: F.floor(F.col("size") * k / (most + 1)).cast("int")
        at, end = bound(i) + shift, bound(i + 1) + shift
        return of.where((at >= 0) & (end <= F.length(word))).select(*of.columns, F.lit(i).alias("piece"), F.substring(F.col(word), at + 1, end - at).alias("form"))

    both = ((words.where(F.col("size") < TWO), 1), (words.where(F.col("size") >= TWO), 2))
    return reduce(DataFrame.unionByName, (form(of, i, shift, most) for of, most in both for i in range(most + 1) for shift in (range(-most, most + 1) if moved else (0,))))


def misspelt(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """token, word, d: index words within a token's allowed edit distance, either whole or cut to the token's length; d is the smaller of the two distances.

    The tokens' lengths (at most a few dozen) are read first: an index word is struck for lengths that are asked for only.
    """
    asked = tokens.select("token", F.length("token").alias("size")).where(F.col("size") >= ONE)
    sizes = sorted(r[0] for r in asked.select("size").distinct().collect())
    own = _forms(asked, "token", False)
    long = F.length("word")
    spellings = F.explode(F.array_distinct(F.concat(*(
        F.filter(F.array(
            F.when(F.abs(long - n) <= (1 if n < TWO else 2), F.struct(F.lit(n).alias("size"), F.col("word").alias("spelt"))),
            F.when(long > n, F.struct(F.lit(n).alias("size"), F.left("word", F.lit(n)).alias("spelt"))),
        ), lambda x: x.isNotNull()) for n in sizes
    )))) if sizes else None
    if spellings is None:
        return tokens.select("token", F.lit("").alias("word"), F.lit(0).alias("d")).limit(0)
    spelt = words.select("word", spellings.alias("s")).select("word", "s.size", "s.spelt")
    # forms are made of distinct spellings: most words share their beginnings with others
    kinds = _forms(written(spelt.select("size", "spelt").distinct(), "spelt"), "spelt", True)
    # where few pieces are asked for, the others are not dealt out
    at = ["size", "piece", "form"]
    wanted = [tuple(r) for r in own.select(*at).distinct().limit(FEW + 1).collect()]
    if len(wanted) <= FEW:
        kinds = kinds.where(F.concat_ws(" ", *at).isin([" ".join(map(str, w)) for w in wanted]))
    # both sides were multiplied, which the planner's size estimate leaves out: never broadcast them; distances are told where they meet
    met = own.join(kinds.hint("merge"), at).select("token", "size", "spelt").withColumn("d", F.levenshtein("token", "spelt", 2))
    near = met.where((F.col("d") >= 0) & (F.col("d") <= errors(F.col("size")))).distinct()
    return near.join(spelt.hint("merge"), ["size", "spelt"]).groupBy("token", "word").agg(F.min("d").alias("d"))


def containing(tokens: DataFrame, grams: DataFrame) -> DataFrame:
    """token, word: index words that hold a token as a substring."""
    asked = tokens.withColumn("gram", F.left("token", F.lit(3)))
    return asked.join(grams.hint("merge"), "gram").where(F.contains("word", F.col("token"))).select("token", "word")


def search(index: Index, queries: DataFrame, query_key: str, query: str, cut: float = 0.1) -> DataFrame:
    """query_key, id, score, fuzzy: rows in which every distinct folded word of a query occurs, within a word, with score 1.

    For a query without such rows that has a word of four letters or more: rows in which each word occurs or a word within its allowed errors does,
    scored by the mean of 1 - errors/length, down to `cut` below the query's best. Queries without words find nothing.
    """
    asked = queries.select(F.col(query_key).alias("q"), F.array_distinct(F.filter(F.split(fold(query), " "), lambda w: w != "")).alias("tokens"))
    asked = written(asked.where(F.size("tokens") > 0), "queries")
    single = asked.select("q", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    tokens = single.select("token").distinct()
    exact = written(containing(tokens, index.grams), "containing")

    def rows_for(of: DataFrame, known: DataFrame) -> DataFrame:
        """q, id, score: rows that hold a known word for each token of their query."""
        # only what holds a known word is dealt out
        known = written(known, "known")
        held = index.postings.join(known.select("word"), "word", "left_semi")
        best = of.join(known.hint("merge"), "token").join(held.hint("merge"), "word").groupBy("q", "n", "token", "id").agg(F.min("d").alias("d"))
        share = F.lit(1.0) - F.least(F.col("d"), F.length("token")) / F.length("token")
        return best.groupBy("q", "n", "id").agg(F.count(F.lit(1)).alias("found"), F.avg(share).alias("score")).where("found = n").select("q", "id", "score")

    found = written(rows_for(single, exact.withColumn("d", F.lit(0))), "found")
    open_ = asked.join(found.select("q").distinct(), "q", "left_anti").where(F.exists("tokens", lambda w: F.length(w) >= ONE))
    rest = written(open_.select("q", F.size("tokens").alias("n"), F.explode("tokens").alias("token")), "open")
    near = misspelt(rest.select("token").distinct(), index.words).unionByName(exact.withColumn("d", F.lit(0)))
    guesses = written(rows_for(rest, near), "guesses")
    top = guesses.groupBy("q").agg(F.max("score").alias("top"))
    guesses = guesses.join(top, "q").where(F.col("score") >= F.col("top") - cut).select("q", "id", "score", F.lit(True).alias("fuzzy"))
    return found.withColumn("fuzzy", F.lit(False)).unionByName(guesses).withColumnRenamed("q", query_key)
