"""Kinds, ages, identities, gates and states of records, on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.operators import profiles as P
from larkspur.plans.pages import SQL_DAY, VISIBLE, sql_title
from larkspur.plans.registry import Tables, query
from larkspur.plans.texts import sql_fold
from larkspur.sources import readers

KINDS = P.Kinds(
    family={"ring": "turning", "gear": "turning", "bolt": "fixing", "rod": "fixing", "plate": "flat", "gadget": "device", "anvil": "tool"},
    same={"widget": "gadget", "gizmo": "gadget"},
    doubtful={"anvil": (("flat", "fixing"), ("gear",)), "rod": (("device",), ("bolt", "plate"))},
    strong=(("turning", ("gear",)), ("device", ())),
)


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


def sql_map(pairs: dict[str, str], v: str, otherwise: str) -> str:
    return f"CASE {v} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + f" ELSE {otherwise} END"


FAMILY = lambda v: sql_map(KINDS.family, v, "NULL")
SQL_KINDS = f"""WITH s AS (SELECT l_orderkey, {sql_map(KINDS.same, "split_part(p_name, ' ', 2)", "split_part(p_name, ' ', 2)")} AS v, (l_linenumber, l_partkey, l_suppkey) AS o FROM lineitem JOIN part ON p_partkey = l_partkey),
f AS (SELECT l_orderkey, v, {FAMILY('v')} AS f, min(o) AS o FROM s GROUP BY 1, 2), g AS (SELECT *, list(v) OVER (PARTITION BY l_orderkey) AS vs, list(f) OVER (PARTITION BY l_orderkey) AS fs FROM f WHERE f IS NOT NULL),
k AS (SELECT l_orderkey, v, f, o FROM g WHERE NOT (v = 'anvil' AND list_has_any(fs, ['flat', 'fixing']) AND NOT list_contains(vs, 'gear')) AND NOT (v = 'rod' AND list_contains(fs, 'device') AND NOT list_has_any(vs, ['bolt', 'plate']))),
l AS (SELECT l_orderkey, CASE WHEN count(DISTINCT f) = 1 THEN min(f) WHEN bool_or(v = 'gear') THEN 'turning' WHEN bool_or(f = 'device') THEN 'device' ELSE arg_min(f, o) END AS led_by FROM k GROUP BY 1),
m AS (SELECT l_orderkey, led_by, string_agg(v, ',' ORDER BY f <> led_by, o) AS kinds FROM k JOIN l USING (l_orderkey) GROUP BY 1, 2)
SELECT l_orderkey, led_by, coalesce(kinds, '') AS kinds FROM (SELECT DISTINCT l_orderkey FROM s) LEFT JOIN m USING (l_orderkey)"""


@query(SQL_KINDS)
def c39_canonical_families(t: Tables) -> DataFrame:
    """What kinds of part an order is about: one spelling each, doubtful ones out, those of the leading family first."""
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("v")))).alias("l"))
    rows = P.canonical_kinds(lines.select("l_orderkey", F.transform("l", lambda x: x["v"]).alias("v")), "v", KINDS)
    return rows.select("l_orderkey", F.col("leading").alias("led_by"), F.array_join("kinds", ",").alias("kinds"))


@query("""WITH c AS (SELECT p_partkey, 2026 AS season, p_size + 1960 AS y, p_size AS a, p_partkey % 12 AS form FROM part),
b AS (SELECT p_partkey, CASE form WHEN 0 THEN y WHEN 2 THEN y WHEN 3 THEN y WHEN 5 THEN season - a - 4 WHEN 6 THEN season - a WHEN 8 THEN season - a WHEN 9 THEN CASE WHEN a > 2 THEN season - a + 1 END END AS a,
CASE form WHEN 0 THEN y + 3 WHEN 1 THEN y WHEN 3 THEN y WHEN 5 THEN season - a WHEN 7 THEN season - a WHEN 8 THEN season - a WHEN 9 THEN CASE WHEN a > 2 THEN season - a + 2 END END AS b FROM c),
r AS (SELECT 1950 + c_custkey * 7919 % 75 AS born, count(*) AS n FROM customer GROUP BY 1) SELECT p_partkey, a AS born_from, b AS born_to, coalesce(CAST(sum(n) AS BIGINT), 0) AS riders FROM b LEFT JOIN r ON (a IS NOT NULL OR b IS NOT NULL) AND born BETWEEN coalesce(a, 1900) AND coalesce(b, 2099) GROUP BY 1, 2, 3""")
def c42_riders_by_category(t: Tables) -> DataFrame:
    """Categories written in twelve ways, the birth years that each admits, and how many riders were born in them."""
    y, a, later = F.col("p_size") + 1960, F.col("p_size"), F.col("p_size") + 4
    texts = [
        F.concat(F.lit("Ročníky "), y + 3, F.lit("–"), y), F.concat(F.lit("<= "), y), F.concat(y, F.lit(" a mladší")), F.concat(F.lit("Jahrgang "), y), F.concat(F.lit("Cup "), y),
        F.concat(a, F.lit("-"), later, F.lit(" Jahre")), F.concat(F.lit("do "), a, F.lit(" let")), F.concat(a, F.lit("+")), F.concat(a, F.lit(" years")), F.concat(F.lit("WU"), a), F.concat(y, F.lit(", "), a, F.lit(" let")), F.concat(later, F.lit("-"), a, F.lit(" lat")),
    ]
    form = F.col("p_partkey") % len(texts)
    said = F.element_at(F.array(*texts), (form + 1).cast("int"))
    rows = P.with_birth_years(t.part.select("p_partkey", said.alias("said"), F.lit(2026).alias("season"), (form == 4).alias("label")), "said", "season", F.col("label"))
    riders = t.customer.groupBy((F.lit(1950) + F.col("c_custkey") * 7919 % 75).cast("int").alias("born")).agg(F.count(F.lit(1)).alias("n"))
    # categories of one span have the same riders: only the distinct spans are listed by their years
    years = rows.select("born_from", "born_to").distinct().select(F.col("born_from").alias("f"), F.col("born_to").alias("t"), F.explode(P.admitted_years(F.col("born_from"), F.col("born_to"))).alias("born"))
    met = years.hint("merge").join(riders, "born").groupBy("f", "t").agg(F.sum("n").alias("riders"))
    same = F.col("born_from").eqNullSafe(F.col("f")) & F.col("born_to").eqNullSafe(F.col("t"))
    return rows.join(met, same, "left").select("p_partkey", "born_from", "born_to", F.coalesce("riders", F.lit(0)).alias("riders"))


#: Failing states and outcomes of what reading a page gave.
RULES = [("deferred", "(needs_rendering|year_conflict)"), ("unreadable", "^(no_title|junk_title)"), ("review", "unreadable_script")]


@query(rf"""WITH q AS (SELECT page_id, url, regexp_matches(html, '(?i)<script') AS scripted, {VISIBLE} AS text, {sql_title('html')} AS title FROM pages), r AS (SELECT *, {SQL_DAY} AS day FROM q),
s AS (SELECT *, CASE WHEN title IS NULL THEN 'no_title' WHEN regexp_matches(lower(title), '^(home|index|untitled)\b') THEN 'junk_title' WHEN day IS NOT NULL AND len(years) > 0 AND NOT list_contains(years, CAST(year(day) AS VARCHAR)) THEN 'year_conflict' WHEN day IS NULL THEN 'no_day' END AS issue
  FROM (SELECT *, list_filter(regexp_extract_all(title || ' ' || regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '[0-9]+'), lambda y: regexp_matches(y, '^20[0-9]{{2}}$')) AS years FROM r)),
u AS (SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)), '^www\.', '') AS host, CASE WHEN issue IS NULL THEN 'ok' WHEN issue = 'year_conflict' OR (length(text) < 250 AND scripted) THEN 'deferred' WHEN issue IN ('no_title', 'junk_title') THEN 'unreadable' ELSE 'broken' END AS state FROM s)
SELECT host, state, count(*) AS pages FROM u GROUP BY 1, 2""")
def c43_states_of_hosts(t: Tables) -> DataFrame:
    """How a host's pages stand after a reading: fine, to be tried again, unreadable, for review, or broken."""
    read = readers.read_pages(t.pages)
    state = P.source_state(F.when(F.size("records") == 0, "error").otherwise("read"), F.nullif(F.array_join("issues", ","), F.lit("")), ("error", "needs_review"), RULES, "needs_review")
    return read.select("page_id", state.alias("state")).join(t.pages.select("page_id", X.host("url").alias("host")), "page_id").groupBy("host", "state").agg(F.count(F.lit(1)).alias("pages"))


@query("""WITH s AS (SELECT o_orderkey, o_orderstatus, list(DISTINCT 'b' || CAST(p_size // 10 AS INT)) FILTER (WHERE o_orderpriority <> '4-NOT SPECIFIED' AND p_size IS NOT NULL) AS c FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, o_orderpriority)
SELECT o_orderkey, CASE WHEN c IS NULL THEN 3 WHEN list_has_any(c, ['b1', 'b5']) AND o_orderstatus = 'F' THEN 0 WHEN list_has_any(c, ['b1', 'b5']) AND o_orderstatus = 'O' THEN 1 WHEN list_has_any(c, ['b1', 'b5', 'b0', 'b4']) THEN 2 ELSE 4 END AS rank FROM s""")
def f14_ranked_orders(t: Tables) -> DataFrame:
    """Orders by how well the size classes of their parts meet the two that are wanted: stated, as in the edition before, guessed, unknown, others."""
    sizes = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("b"), F.floor(F.col("p_size") / 10).cast("string"))).alias("c"))
    rows = t.orders.join(sizes, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    stated = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("c"))
    confidence = F.when(F.col("o_orderstatus") == "F", "explicit").when(F.col("o_orderstatus") == "O", "previous").otherwise("guessed")
    return rows.select("o_orderkey", P.match_rank(stated, confidence, ["b1", "b5"], {"b1": ["b0"], "b5": ["b4"]}).alias("rank"))


#: Signs in order: what bars a text for good, what keeps it, what bars it else.
SIGNS = [
    ("barred", P.Sign(runs=("all rights reserved",), words=("license",))), ("mixed", P.Sign(stems=("erth", "ciona"), runs=("of the", "de la"))), ("kept", P.Sign(words=("nicht", "pour", "and"), stems=("schr",))),
    ("other", P.Sign(words=("los", "el"))), ("elsewhere", P.Sign(stems=("re", "ei"))),
]


def _sql_sign(s: P.Sign) -> str:
    whole = [f"contains(p, ' {w} ')" for w in (*s.words, *s.runs)]
    return " OR ".join([*whole, *(f"contains(p, ' {w}')" for w in s.stems)])


@query(f"SELECT doc_id, CASE {' '.join(f'WHEN {_sql_sign(s)} THEN {chr(39)}{a}{chr(39)}' for a, s in SIGNS)} ELSE 'open' END AS gate FROM (SELECT doc_id, ' ' || {sql_fold('coalesce(text, {})'.format(chr(39) * 2))} || ' ' AS p FROM documents)")
def f17_gated_documents(t: Tables) -> DataFrame:
    """Whole documents through an ordered gate of words, beginnings of words and runs of words."""
    return P.gated_texts(t.documents, "text", SIGNS, "open").select("doc_id", "gate")


@query(f"""WITH d AS (SELECT doc_id, lang, quality, toxic, count(*) OVER (PARTITION BY h) AS same, {sql_fold("coalesce(text, '')")} AS f FROM (SELECT *, md5(coalesce(text, '')) AS h FROM documents) LEFT JOIN labels USING (doc_id)),
i AS (SELECT doc_id, list_filter([CASE WHEN lang <> 'en' THEN 'outside_target' END, CASE WHEN toxic = 1 THEN 'unfit' END, CASE WHEN same > 1 THEN 'generic' END, CASE WHEN len(string_split(f, ' ')) < 30 THEN 'missing_evidence' END, CASE WHEN lang IS NULL OR quality IS NULL THEN 'needs_verification' END, CASE WHEN contains(' ' || f || ' ', ' license ') OR quality = 0 THEN 'tentative' END], lambda x: x IS NOT NULL) AS issues FROM d)
SELECT doc_id, CASE WHEN list_has_any(issues, ['outside_target', 'unfit', 'generic']) THEN 'out_of_scope' WHEN len(issues) > 0 THEN 'needs_review' ELSE 'ready' END AS state, CASE WHEN list_contains(issues, 'tentative') THEN 'tentative' ELSE 'requires_verification' END AS date_status, array_to_string(issues, ',') AS issues FROM i""")
def f38_assessed_documents(t: Tables) -> DataFrame:
    """Documents as candidates: what speaks against each, in order, whether that puts it out of scope, and whether it is tentative."""
    docs = t.documents.select("doc_id", "lang", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"), X.padded(F.coalesce("text", F.lit(""))).alias("f"))
    docs = docs.select("doc_id", "lang", "h", (F.size(F.split(F.trim("f"), " ")) < 30).alias("short"), X.has_word("f", "license").alias("licence"))
    again = docs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", F.lit(True).alias("again"))
    rows = docs.join(again, "h", "left").join(t.labels, "doc_id", "left")
    checks = {
        "outside_target": F.col("lang") != "en", "unfit": F.col("toxic") == 1, "generic": F.col("again"), "missing_evidence": F.col("short"),
        "needs_verification": F.col("lang").isNull() | F.col("quality").isNull(), "tentative": F.col("licence") | (F.col("quality") == 0),
    }
    return P.assessed(rows, checks, ("outside_target", "unfit", "generic"), "tentative").select("doc_id", "state", "date_status", F.array_join("issues", ",").alias("issues"))


#: Names that stand for one series each, and what says nothing about which one it is.
ALIASES = [(r"\b(?:the|that) thnd\b", "series:thnd"), (r"\bin\b.*\bof\b", "series:inof"), (r"\b(?:que|de) (?:os|la)\b", "series:romance"), (r"\b(?:der|die|das)\b", "series:german")]
DROPPED = [r"\b[0-9]{1,2}\. *", r"\b20[0-9]{2}\b", r"\b[0-9]{1,2} */ *[0-9]{1,2}\b", r"\b(?:and|the|le|un)\b", "&amp;"]


def _sql_identity(c: str) -> str:
    text = sql_fold(c).removeprefix("trim(regexp_replace(").removesuffix(", '[^a-z0-9]+', ' ', 'g'))")
    tokens, left = [], text
    for pattern, token in ALIASES:
        tokens.append(f"CASE WHEN regexp_matches({left}, '{pattern}') THEN '{token}' END")
        left = f"regexp_replace({left}, '{pattern}', ' ', 'g')"
    for pattern in DROPPED:
        left = f"regexp_replace({left}, '{pattern}', ' ', 'g')"
    return f"trim(concat_ws(' ', {', '.join(tokens)}, trim(regexp_replace({left}, '[^a-z0-9]+', ' ', 'g'))))"


@query(f"SELECT identity, count(*) AS pages, min(page_id) AS first_page FROM (SELECT page_id, {_sql_identity('title')} AS identity FROM (SELECT page_id, coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages)) GROUP BY 1")
def c5_pages_by_identity(t: Tables) -> DataFrame:
    """Pages of one identity: series by their aliases, the rest of the title without editions and empty words."""
    titles = t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return P.identity(titles, "title", ALIASES, DROPPED).groupBy("identity").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))


@query(r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)), '^www\.', '') AS host FROM pages), p AS (SELECT regexp_extract(host, '[^.]+\.[^.]+\.[^.]+$', 0) AS site FROM h GROUP BY 1 HAVING count(DISTINCT host) > 2),
k AS (SELECT host FROM h WHERE host <> '' AND regexp_extract(host, '[^.]+\.[^.]+\.[^.]+$', 0) NOT IN (SELECT site FROM p) GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20)
SELECT a.page_id, a.host, string_agg(CAST(b.page_id AS VARCHAR), ',' ORDER BY b.page_id) AS others FROM h a JOIN k USING (host) JOIN h b ON b.host = a.host AND b.page_id <> a.page_id GROUP BY 1, 2""")
def a26_pages_of_host(t: Tables) -> DataFrame:
    """For each page the others of its host, unless the host belongs to a platform (a site with three hosts or more) or has more than twenty pages."""
    h = X.host("url")
    rows = t.pages.select("page_id", h.alias("host"), F.regexp_extract(h, r"[^.]+\.[^.]+\.[^.]+$", 0).alias("site")).where("host <> ''")
    platforms = rows.groupBy("site").agg(F.count_distinct("host").alias("n")).where("n > 2")
    return P.siblings(rows.join(platforms, "site", "left_anti"), "host", "page_id").select("page_id", "host", F.array_join(F.col("others").cast("array<string>"), ",").alias("others"))
