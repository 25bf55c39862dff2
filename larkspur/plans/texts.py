"""Text kernel over documents, parts and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.operators import entities as E
from larkspur.plans.registry import Tables, query


def sql_fold(c: str) -> str:
    out = f"translate(lower({c}), '{X.ACCENTS}', '{X.PLAIN}')"
    for a, b in X.DOUBLE.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT doc_id, {sql_fold('text')} AS folded FROM documents")
def c1_search_fold(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.fold("text").alias("folded"))


@query(f"SELECT doc_id, contains(' ' || {sql_fold('text')} || ' ', ' the ') AS the, contains(' ' || {sql_fold('text')} || ' ', ' fur ') AS fur FROM documents")
def c3_whole_words(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.padded("text").alias("p")).select("doc_id", X.has_word("p", "the").alias("the"), X.has_word("p", "fur").alias("fur"))


@query(f"SELECT p_partkey, CASE WHEN length(x) < 3 THEN {sql_fold('p_name')} ELSE x END AS name FROM (SELECT p_partkey, p_name, array_to_string(list_filter(string_split({sql_fold('p_name')}, ' '), lambda w: w NOT IN ('blue', 'red', 'small')), ' ') AS x FROM part)")
def c4_normalized_name(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.normalized_name("p_name", ["blue", "red", "small"]).alias("name"))


@query(f"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace({sql_fold('p_name')}, '^(red|small) ', 'series:plain ', 'g'), ' [0-9]+$', '', 'g'), ' +', ' ', 'g')) AS name FROM part")
def c5_alias_rules(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.ruled("p_name", [("^(red|small) ", "series:plain "), (" [0-9]+$", "")]).alias("name"))


BI = "list_transform(range(1, length({0})), lambda i: substr({0}, CAST(i AS BIGINT), 2))"


def sql_dice(a: str, b: str) -> str:
    x, y = BI.format(a), BI.format(b)
    common = f"coalesce(list_sum(list_transform(list_distinct({x}), lambda g: least(len(list_filter({x}, lambda z: z = g)), len(list_filter({y}, lambda z: z = g))))), 0)"
    return f"CASE WHEN len({x}) + len({y}) > 0 THEN 2.0 * {common} / (len({x}) + len({y})) ELSE 0 END"


@query(f"SELECT a.p_partkey AS a, b.p_partkey AS b, round({sql_dice('a.p_name', 'b.p_name')}, 6) AS dice FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def c6_bigram_dice(t: Tables) -> DataFrame:
    """Names of one brand and size, compared by bigram multisets; two names are compared once, however many parts have them."""
    return named_pairs(t, "dice", F.round(X.dice_of(X.numbered_bigrams("x_p_name"), X.numbered_bigrams("y_p_name")), 6))


def named_pairs(t: Tables, name: str, value: Column) -> DataFrame:
    """a, b and a value told by their names (x_p_name, y_p_name): all pairs of parts of one brand and size."""
    rows = E.classed(t.part, "p_partkey", ["p_brand", "p_size", "p_name"])
    pairs = E.once_for(E.class_pairs(rows, "p_partkey", ["p_brand", "p_size"], ["p_name"]), ["x_p_name", "y_p_name"], name, value)
    return E.members_of(pairs.select("c", "d", name), rows, "p_partkey")


def sql_words(c: str) -> str:
    return f"list_distinct(list_filter(string_split({sql_fold(c)}, ' '), lambda w: length(w) >= 3))"


@query(f"SELECT a, b, round(CASE WHEN greatest(len(x), len(y)) > 0 THEN len(list_intersect(x, y)) / greatest(len(x), len(y)) ELSE 0 END, 6) AS share FROM (SELECT a.p_partkey AS a, b.p_partkey AS b, {sql_words('a.p_name')} AS x, {sql_words('b.p_name')} AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey)")
def c7_word_set_similarity(t: Tables) -> DataFrame:
    return named_pairs(t, "share", F.round(X.word_overlap("x_p_name", "y_p_name"), 6))


@query(f"SELECT p_partkey, list_min(list_transform(string_split({sql_fold('p_name')}, ' '), lambda w: levenshtein(substr(w, 1, 5), 'blush'))) AS d FROM part")
def c8_prefix_levenshtein(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.prefix_distance(X.fold("p_name"), "blush").alias("d"))


@query(f"""WITH e AS (SELECT p_partkey, {sql_fold('p_name')} AS n FROM part), s AS (SELECT p_partkey, 1.0 AS score FROM e WHERE contains(n, 'bluw')), f AS (SELECT p_partkey, 1.0 - list_min(list_transform(string_split(n, ' '), lambda w: levenshtein(substr(w, 1, 4), 'bluw'))) / 4.0 AS score FROM e WHERE NOT EXISTS (SELECT 1 FROM s)),
g AS (SELECT * FROM s UNION ALL SELECT * FROM f WHERE score >= 0.5) SELECT p_partkey, round(score, 6) AS score FROM g WHERE score >= (SELECT max(score) FROM g) - 0.1 ORDER BY score DESC, p_partkey LIMIT 100""")
def x6_two_phase_search(t: Tables) -> DataFrame:
    """Typo-tolerant search: exact substrings; where there are none, edit distance of word prefixes; then a cut near the best."""
    word = "bluw"
    rows = t.part.select("p_partkey", X.fold("p_name").alias("n"))
    exact = rows.where(F.contains("n", F.lit(word))).select("p_partkey", F.lit(1.0).cast("double").alias("score"))
    if exact.isEmpty():
        exact = rows.select("p_partkey", (1.0 - X.prefix_distance("n", word) / 4.0).cast("double").alias("score")).where("score >= 0.5")
    best = exact.agg(F.max("score")).first()[0]
    return exact.where(F.col("score") >= (best or 0) - 0.1).orderBy(F.desc("score"), "p_partkey").limit(100).select("p_partkey", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, CASE WHEN strpos(s, '-~') > 0 THEN substr(s, 1, strpos(s, '-~') - 1) ELSE s END AS slug FROM (SELECT doc_id, list_reduce(list_prepend('', string_split({sql_fold('text')}, ' ')), lambda s, w: CASE WHEN s LIKE '%-~' THEN s WHEN s = '' THEN substr(w, 1, 30) WHEN length(s) + length(w) + 1 <= 30 THEN s || '-' || w ELSE s || '-~' END) AS s FROM documents)")
def c10_slugs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.slug("text", 30).alias("slug"))


@query("SELECT p_partkey, len(list_intersect(list_distinct(string_split(lower(p_name), ' ')), ['blue', 'almond', 'green'])) AS score FROM part")
def c11_slug_match(t: Tables) -> DataFrame:
    wanted = F.split(F.lit("blue-almond-green"), "-")
    return t.part.select("p_partkey", F.size(F.array_intersect(F.split(F.lower("p_name"), " "), wanted)).alias("score"))


@query("SELECT doc_id, regexp_matches(text, '^[a-z]') OR regexp_matches(text, '[|]\\s*$') OR length(text) < 30 AS fragment FROM documents")
def c13_fragment_detector(t: Tables) -> DataFrame:
    head = F.col("text")
    return t.documents.select("doc_id", (head.rlike("^[a-z]") | head.rlike(r"[|]\s*$") | (F.char_length(head) < 30)).alias("fragment"))


@query("SELECT p_partkey, (length(p_name) BETWEEN 8 AND 40)::INT * 3 + (p_name <> upper(p_name))::INT * 2 - regexp_matches(p_name, '[0-9]')::INT AS score FROM part")
def c14_name_score(t: Tables) -> DataFrame:
    n = F.col("p_name")
    return t.part.select("p_partkey", (F.length(n).between(8, 40).cast("int") * 3 + (n != F.upper(n)).cast("int") * 2 - n.rlike("[0-9]").cast("int")).alias("score"))


@query("SELECT n_nationkey, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS place FROM nation")
def c15_title_case(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.initcap(F.lower("n_name")).alias("place"))


@query("SELECT p_partkey, nullif(regexp_extract(p_brand, '#([0-9])', 1), '') AS round, CAST(nullif(regexp_extract(p_brand, '([0-9])$', 1), '') AS INTEGER) AS last FROM part")
def c16_round_extraction(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.nullif(F.regexp_extract("p_brand", "#([0-9])", 1), F.lit("")).alias("round"), F.regexp_extract("p_brand", "([0-9])$", 1).cast("int").alias("last"))


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace({sql_fold('text')}, '(^| )[0-9]+( |$)', ' ', 'g'), ' +', ' ', 'g')) AS key FROM documents")
def c17_edition_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.trim(F.regexp_replace(F.regexp_replace(X.fold("text"), "(^| )[0-9]+( |$)", " "), " +", " ")).alias("key"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)), '^www\\.', '') AS host, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS key FROM pages")
def c19_url_key(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.host("url").alias("host"), X.url_key("url").alias("key"))


@query(f"SELECT doc_id, contains({sql_fold('text')}, 'all rights reserved') AS quoted FROM documents")
def c20_quote_on_page(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.quote_is_on("text", "All rights -- réserved.").alias("quoted"))


@query("SELECT doc_id, md5(text) AS m, sha1(text) AS s1, sha256(text) AS s2 FROM documents")
def c21_hashes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("m"), F.sha1(F.col("text").cast("binary")).alias("s1"), F.sha2(F.col("text").cast("binary"), 256).alias("s2"))
