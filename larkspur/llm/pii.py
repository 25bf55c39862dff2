"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the matches of four fixed patterns (e-mail, IP address, card, phone) and long hexadecimal keys (kind `secret`). Tokens of
identifier shape that no seed covers are instances without a kind. What stands around a place makes its lexical patterns: the
two words before it; the word before it with its own shape; the word after it with its own shape. Patterns and
instances form a graph, one edge for each pair that occurs. In rounds, a pattern's confidence in a kind is the sum of the scores of
its accepted instances of that kind over the number of all its instances; a pattern of high confidence that enough
different accepted instances support gives its other instances its kind, with its confidence as their score. These count from the
next round on, so that they can lift further patterns, until a round accepts nothing new. Every occurrence of an accepted instance,
in whatever context, is a span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm import spread as S

KINDS = ("email", "ip", "card", "phone")
#: Kinds of seeds; those beyond KINDS are no part of the base.
SEEDS = (*KINDS, "secret")
# The seed patterns. Quantifiers are possessive only where the next character can't be in the class; a group so
# repeated is matched in a loop, without a stack. A run of characters is entered at its start or where the last match ended, else
# a very long run would be read again from each of its characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])",
}
#: What a text must hold for a pattern to match; cheap to see.
HINTS = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]", "secret": r"[0-9a-f]{32}"}
#: A token of identifier shape: it holds a digit or an at-sign (see _instance).
TOKEN, TOKEN_HINT = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+", r"[0-9@]"
#: Characters of a context from which on its hash stands for it.
LONG = 256
BYTE = r"0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _matches(docs: DataFrame, pattern: str, hint: str) -> DataFrame:
    """doc_id, start, end, m, left, right: the leftmost matches of a pattern, by code points, up to two words before each, and the word after it or null.

    What stands between two matches, with the earlier one before it, is a piece, of which the last words are kept with single spaces.
    A place's words are looked for in the pieces from the last word's start but one on; c counts such starts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    hit = docs.where(text.rlike(hint)).select("doc_id", F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.split(text, pattern, -1).alias("g"))
    words = "split(concat(if(i = 0, '', m[i - 1]), g[i]), '\\\\s++')"
    one = F.expr(f"transform(m, (x, i) -> struct(x as m, char_length(g[i]) as n, {words} as w, nullif(regexp_extract(g[i + 1], '^\\\\S*+\\\\s++(\\\\S++)\\\\s', 1), '') as r))")
    rows = hit.select("doc_id", F.posexplode(one).alias("i", "x")).select("doc_id", "i", "x.m", "x.n", F.col("x.r").alias("right"), F.expr("if(size(x.w) > 3, concat(' ', array_join(slice(x.w, -3, 3), ' ')), array_join(x.w, ' '))").alias("piece"))
    order = W.partitionBy("doc_id").orderBy("i")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("n") + F.char_length("m")).over(so_far)
    begun = F.regexp_count(F.concat(F.coalesce(F.right(F.lag("piece").over(order), F.lit(1)), F.lit("")), "piece"), F.lit(r" \S"))
    rows = rows.withColumn("end", end.cast("int")).withColumn("c", begun).withColumn("c", F.sum("c").over(so_far))
    near = F.collect_list(F.struct("i", "piece")).over(W.partitionBy("doc_id").orderBy("c").rangeBetween(-1, 0))
    rows = rows.withColumn("near", near).withColumn("near", F.expr("array_join(transform(array_sort(filter(near, x -> x.i <= i)), x -> x.piece), '')"))
    left = F.expr("reverse(slice(reverse(filter(split(near, ' '), x -> x <> '')), 1, 2))")
    return rows.select("doc_id", (F.col("end") - F.char_length("m")).alias("start"), "end", "m", left.alias("left"), "right")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda s, i: s + F.when(i % 2 == 1, F.substring(turned, i, F.lit(1)).cast("int")).otherwise(F.substring(turned, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(turned, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)),
    )
    return total % 10 == 0


def _holds(kind: str) -> Column:
    digits = F.regexp_replace("m", "[^0-9]", "")
    if kind == "ip":
        return F.col("m").rlike(rf"^{BYTE}(\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "secret":
        return F.col("m").rlike("[0-9]") & F.col("m").rlike("[a-f]")
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _contexts() -> Column:
    """The lexical patterns of a place, lower-case, a very long one by its hash: an array without nulls."""
    got = F.when(F.col("m").rlike("[A-Za-z]"), F.regexp_replace("m", "[A-Za-z0-9]", "x")).otherwise(F.regexp_replace("m", "[0-9]", "9"))
    before = F.element_at("left", -1)
    two = F.when(F.size("left") == 2, F.concat(F.lit("b2 "), F.array_join("left", " ")))
    near = F.when(F.size("left") > 0, F.concat(F.lit("b1 "), before, F.lit(" "), got))
    after = F.concat(F.lit("a1 "), "right", F.lit(" "), got)
    short = lambda c: F.when(F.length(c) > LONG, F.sha2(c.cast("binary"), 256)).otherwise(F.lower(c))
    return F.array_compact(F.array(short(two), short(near), short(after)))


def seed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, kind, rank, start, end, m, left, right of all seeds: per kind leftmost and non-overlapping; failing matches are dropped."""
    out = None
    for rank, kind in enumerate(SEEDS):
        got = _matches(docs, PATTERNS[kind], HINTS[kind]).where(_holds(kind)).select("doc_id", F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), "start", "end", "m", "left", "right")
        out = got if out is None else out.unionByName(got)
    return out


def _instances(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Tokens with an at-sign or five digits or more that overlap no seed: doc_id, start, end, m, left, right."""
    token = _matches(docs, TOKEN, TOKEN_HINT)
    first = F.char_length(F.regexp_extract("m", r"^[^A-Za-z0-9+(]*+", 0))  # marks at the start and at the end are no part of it
    bare = F.regexp_replace(F.regexp_replace("m", r"^[^A-Za-z0-9+(]++", ""), r"[^A-Za-z0-9)]++$", "")
    token = token.withColumn("start", F.col("start") + first).withColumn("m", bare).withColumn("end", F.col("start") + F.char_length("m"))
    token = token.where((F.length(F.regexp_replace("m", "[^0-9]", "")) >= 5) | F.col("m").rlike(".@."))
    # a running maximum over the places of a document tells where a seed still covers
    both = seeds.select("doc_id", "start", "end", F.lit(None).cast("string").alias("m"), "left", "right", F.lit(0).alias("own"))
    both = both.unionByName(token.withColumn("own", F.lit(1)))
    before = W.partitionBy("doc_id").orderBy("start", "own", "end").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy("doc_id").orderBy("start", "own", "end").rowsBetween(1, W.unboundedFollowing)
    reach = F.max(F.when(F.col("own") == 0, F.col("end"))).over(before)
    ahead = F.min(F.when(F.col("own") == 0, F.col("start"))).over(after)
    free = (F.coalesce(reach, F.lit(-1)) <= F.col("start")) & (F.coalesce(ahead, F.lit(2**31 - 1)) >= F.col("end"))
    return both.withColumn("free", free).where("own = 1 and free").select("doc_id", "start", "end", "m", "left", "right")


def discovered_spans(docs: DataFrame, seeds: DataFrame, confidence: float = 0.8, support: int = 5) -> DataFrame:
    """doc_id, kind, rank, start, end: the instances that patterns of `confidence` or more, backed by `support` different
    accepted ones, discover, and those whose value is a seed elsewhere.

    seeds: the rows of seed_spans. Edges are distinct (pattern, instance) pairs, so a context or a value that a third of all rows
    hold is one edge; each round is a few aggregations over the edges of patterns that hold `support` instances or more.
    An instance keeps the kind that it gets first; of several at once, that of the highest score, then of the lowest rank.
    """
    free = S.kept(_instances(docs, seeds).withColumn("patterns", _contexts()).drop("left", "right"), "instances")
    found = seeds.select("m", _contexts().alias("patterns")).unionByName(free.select("m", "patterns"))
    edges = found.select("m", F.explode("patterns").alias("pattern")).distinct()
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= support)
    edges = S.kept(edges.join(sizes, "pattern"), "edges")
    labels = S.kept(seeds.groupBy("m").agg(F.min(F.struct("rank", "kind")).alias("x")).select("m", "x.kind", "x.rank", F.lit(1.0).alias("score")), "labels")
    while True:
        backed = edges.join(labels, "m").groupBy("pattern", "kind", "rank").agg((F.sum("score") / F.first("size")).alias("trust"), F.count(F.lit(1)).alias("n"))
        good = backed.where((F.col("trust") >= confidence) & (F.col("n") >= support))
        best = F.max(F.struct("trust", (-F.col("rank")).alias("r"), "kind", "rank")).alias("x")
        new = edges.join(good, "pattern").groupBy("m").agg(best).select("m", "x.kind", "x.rank", F.col("x.trust").alias("score")).join(labels.select("m"), "m", "left_anti")
        new = S.kept(new, "labels")
        if new.isEmpty():
            break
        labels = labels.unionByName(new)
    return free.join(labels, "m").select("doc_id", "kind", "rank", "start", "end")


def find(docs: DataFrame, confidence: float = 0.8, support: int = 5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans: one row per document.

    The counts and base_sha256 are of the base, the four fixed patterns, which always stays; spans lists all: base, keys and discovered
    ones, n_spans is their number and n_added that of those beyond the base. docs: doc_id (unique, not null) and text;
    other columns are ignored. Null texts are empty; texts without any span get zeros, the hash of nothing and an empty
    string. An empty table gives an empty result.
    """
    seeds = S.kept(seed_spans(docs), "seeds")
    added = discovered_spans(docs, seeds, confidence, support)
    new = F.when(F.col("rank") < len(KINDS), 0).otherwise(1).alias("new")
    rows = seeds.select("doc_id", "kind", "rank", "start", "end", new).unionByName(added.withColumn("new", F.lit(1)))
    place = F.struct("rank", "start", "end", "new", "kind")
    per = rows.groupBy("doc_id").agg(*(F.count(F.when((F.col("kind") == k) & (F.col("new") == 0), 1)).alias(f"n_{k}") for k in KINDS), F.sum("new").alias("n_added"), F.count(F.lit(1)).alias("n_spans"), F.array_sort(F.collect_list(place)).alias("all"))
    written = lambda a: f"array_join(transform({a}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    per = per.withColumn("spans", F.expr(written("`all`"))).withColumn("base", F.expr(written("filter(`all`, x -> x.new = 0)"))).drop("all")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = docs.select("doc_id").join(per, "doc_id", "left")
    return out.select("doc_id", *(zero(f"n_{k}") for k in KINDS), F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_added"), zero("n_spans"))


def mask(docs: DataFrame, **limits) -> DataFrame:
    """docs with each span replaced by its kind in angle brackets, and n_chars to match where there is such a column; all columns stay, all rows stay."""
    seeds = S.kept(seed_spans(docs), "seeds")
    rows = S.kept(seeds.select("doc_id", "kind", "rank", "start", "end").unionByName(discovered_spans(docs, seeds, **limits)), "spans")
    order = W.partitionBy("doc_id").orderBy("start", F.desc("end"), "rank")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("isle", F.sum(F.when(F.col("start") < F.coalesce(reach, F.lit(-1)), 0).otherwise(1)).over(order))
    isles = rows.groupBy("doc_id", "isle").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.min_by("kind", F.struct("start", -F.col("end"), "rank")).alias("kind"))
    per = isles.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("s", "e", "kind"))).alias("_larkspur_spans"))
    piece = "transform(_larkspur_spans, (x, i) -> concat(substring(text, if(i = 0, 0, _larkspur_spans[i - 1].e) + 1, x.s - if(i = 0, 0, _larkspur_spans[i - 1].e)), '<', upper(x.kind), '>'))"
    masked = F.expr(f"if(_larkspur_spans is null, text, concat(array_join({piece}, ''), substring(text, element_at(_larkspur_spans, -1).e + 1)))")
    out = docs.join(per, "doc_id", "left").withColumn("text", masked)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_larkspur_spans").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)
