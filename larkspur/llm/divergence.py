"""Where the sources of a language differ: term probabilities of each (language, source), in whole numbers, compared term by term.

A text is tokenized by one pass of bytes.translate, which lowers A-Z and turns every ASCII byte that is no letter into a blank, and by
bytes.split; a Counter for each document gives its terms and their frequencies. Batches add these up sparsely, one entry for each
(language, source, term) they hold, before anything is shuffled; all later steps are DataFrame operations on such entries.

Pairs of sources are summed without a dense table. With p0 the probability of a term that a source doesn't hold, the sum over all
kept terms of f(p, q) is V f(p0, q0), corrected for the terms that one side holds (of which only a histogram by p is needed) and for
those that both hold (met by their term).
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm import spread as S

#: Lower-cases A-Z and blanks the other ASCII bytes that aren't letters; bytes from 0x80 on are parts of letters.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split at once; entries held as Python objects; unit of the probabilities; entries of a salted part.
PIECE, FLUSH, SCALE, PART_ROWS = 1 << 20, 1 << 16, 1_000_000_000, 1 << 17


def terms_of(raw: bytes) -> Counter:
    """Frequency of each term of a text."""
    raw = raw.translate(TABLE)
    if len(raw) <= PIECE:
        return Counter(raw.split())
    out, at = Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        out.update(raw[at:end].split())
        at = end
    return out


def _entries(batches):
    """lang, source, term, count, docs: sums over each batch. Terms leave Python's lists every FLUSH entries."""
    for batch in batches:
        parts, words, counts, owner = [], [], [], []
        for i, text in enumerate(batch.column(2)):
            got = terms_of(text.as_buffer().to_pybytes())
            words += got.keys()
            counts += got.values()
            owner += [i] * len(got)
            if len(words) >= FLUSH or i == batch.num_rows - 1:
                rows = pa.array(owner, pa.int64())
                parts.append(pa.table({"lang": batch.column(0).take(rows), "source": batch.column(1).take(rows), "term": pa.array(words, pa.binary()), "count": pa.array(counts, pa.int64())}))
                words, counts, owner = [], [], []
        if parts:
            sums = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("count", "sum"), ("count", "count")])
            sums = sums.select(["lang", "source", "term", "count_sum", "count_count"]).rename_columns(["lang", "source", "term", "count", "docs"])
            yield from sums.set_column(2, "term", sums["term"].cast(pa.string())).to_batches(max_chunksize=1 << 16)


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exactly, whatever the counts."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(count + F.lit(1)), whole(total + terms))


def gain(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def divergences(docs: DataFrame, least_docs: int = 3, top: int = 200, columns: tuple[str, str, str] = ("lang", "source", "text")) -> DataFrame:
    """lang, source, part, item, value, rank: for every (lang, source) of docs how far its terms lie from each other source of its language
    (part `pair`), and the terms that it holds more than its language does (part `term`, to rank `top`).

    Null text, lang or source count as ''. A language keeps the terms that at least_docs of its documents hold; where none is kept, pairs have
    the value 0. A source without other sources has no pairs, texts without letters add a group and no terms. Repeated rows count as further
    documents; an empty table gives an empty one; other columns don't matter, whatever their names. Ties are ranked by the item's UTF-8 bytes.
    """
    lang, source, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)
    rows = docs.select(lang.alias("lang"), source.alias("source"), text.alias("text"))
    groups = S.kept(rows.select("lang", "source").distinct(), "groups")
    entries = rows.mapInArrow(_entries, "lang string, source string, term string, count long, docs long")
    entries = entries.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    # a term's holders are as many as its language's sources at most
    terms = entries.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("all"), F.collect_list(F.struct("source", "count")).alias("held")).where(F.col("docs") >= least_docs)
    terms = S.kept(terms.select("lang", "term", "all", "held"), "terms")
    of_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_total"))
    single = terms.select("lang", "term", "all", F.explode("held").alias("h")).select("lang", "term", "all", "h.source", "h.count")
    of_group = single.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    known = groups.join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").na.fill(0, ["terms", "lang_total", "total"])
    base = F.when(F.col("terms") > 0, probability(F.lit(0), F.col("total"), F.col("terms")))
    known = S.kept(known.withColumn("p0", base), "sources")
    # a source may hold a third of all entries: its figures are repeated for parts of the terms
    parts = S.parts(terms.count(), PART_ROWS)
    part = F.pmod(F.xxhash64("term"), F.lit(parts))
    dealt = known.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    placed = single.withColumn("part", part).join(dealt, ["lang", "source", "part"]).withColumn("p", probability(F.col("count"), F.col("total"), F.col("terms")))
    placed = S.kept(placed.select("lang", "source", "term", "p", "p0", probability(F.col("all"), F.col("lang_total"), F.col("terms")).alias("q")), "placed")

    above = placed.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gain(F.col("p"), F.col("q")).alias("value"))
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = above.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    # per pair of sources: V f(p0, q0), then what the terms of one side change, then what those of both do
    one = known.select("lang", "source", "p0", "terms")
    pairs = one.join(one.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")), "lang").where("source <> item")
    flat = pairs.select("lang", "source", "item", F.coalesce(F.col("terms") * gain(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    seen = placed.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"), F.first("p0").alias("p0"))
    others = one.select("lang", F.col("source").alias("other"), F.col("p0").alias("o0"))
    sided = seen.join(others, "lang").where("source <> other")
    p, p0, o0 = F.col("p"), F.col("p0"), F.col("o0")
    mine = sided.groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum(F.col("n") * (gain(p, o0) - gain(p0, o0))).alias("value"))
    theirs = sided.groupBy("lang", F.col("other").alias("source"), F.col("source").alias("item")).agg(F.sum(F.col("n") * (gain(o0, p) - gain(o0, p0))).alias("value"))
    held = placed.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("h")).where(F.size("h") > 1)
    met = held.select("lang", "h", F.explode("h").alias("a")).select("lang", "a", F.explode("h").alias("b")).where("a.source <> b.source")
    pa_, pa0, pb, pb0 = (F.col(c) for c in ("a.p", "a.p0", "b.p", "b.p0"))
    both = met.groupBy("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item")).agg(F.sum(gain(pa_, pb) - gain(pa_, pb0) - gain(pa0, pb) + gain(pa0, pb0)).alias("value"))
    sums = flat.unionByName(mine).unionByName(theirs).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sums = sums.withColumn("rank", F.row_number().over(ranked)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return sums.unionByName(best.select(sums.columns))
