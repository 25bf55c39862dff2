"""Classification, money, JSON and the smaller composite operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.operators import filters as P
from larkspur.plans.entities import BLOCK, SCORED, TOLD, known, met, scored, two_scores
from larkspur.plans.joins import KM, POINT, points
from larkspur.plans.registry import Tables, query
from larkspur.plans.texts import sql_fold

PTS = f"(SELECT s_suppkey, {POINT} FROM supplier)"


@query(f"SELECT p_partkey, ' ' || {sql_fold('p_name')} || ' ' AS padded FROM part")
def c2_padded_fold(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.padded("p_name").alias("padded"))


@query("SELECT doc_id, replace(replace(replace(replace('&amp;lt;' || lang || '&amp;gt; &quot;x&quot;', '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') AS repaired FROM documents")
def c12_repaired_text(t: Tables) -> DataFrame:
    """Entities that were escaped twice."""
    return t.documents.select("doc_id", X.decoded(F.concat(F.lit("&amp;lt;"), F.col("lang"), F.lit("&amp;gt; &quot;x&quot;"))).alias("repaired"))


@query("SELECT s_suppkey, trim(regexp_replace(regexp_replace(s_name, '[#(].*$', '', 'g'), '\\s+', ' ', 'g')) AS place FROM supplier")
def c18_simplified_place(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.trim(F.regexp_replace(F.regexp_replace("s_name", r"[#(].*$", ""), r"\s+", " ")).alias("place"))


def day_length(lat, day):
    """Hours between sunrise and sunset, from the declination on that day of the year."""
    tilt = F.radians(F.lit(-23.44)) * F.cos(F.radians(F.lit(360.0) / 365 * (F.dayofyear(day) + 10)))
    x = -F.tan(F.radians(lat)) * F.tan(tilt)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))) / 7.5


@query(f"SELECT s_suppkey, round(degrees(acos(greatest(-1.0, least(1.0, -tan(radians(lat)) * tan(radians(-23.44) * cos(radians(360.0::DOUBLE / 365 * (dayofyear(DATE '2024-06-01' + CAST(s_suppkey % 200 AS INTEGER)) + 10)))))))) / 7.5, 4) AS hours FROM {PTS}")
def c30_day_length(t: Tables) -> DataFrame:
    day = F.date_add(F.lit("2024-06-01").cast("date"), (F.col("s_suppkey") % 200).cast("int"))
    return points(t).select("s_suppkey", F.round(day_length(F.col("lat"), day), 4).alias("hours"))


@query("SELECT o_orderkey, h.name FROM orders JOIN (VALUES (DATE '1997-12-24', DATE '1998-01-02', 'winter'), (DATE '1998-07-01', DATE '1998-08-31', 'summer')) h(a, b, name) ON CAST(o_orderdate AS DATE) BETWEEN a AND b")
def c31_holidays(t: Tables) -> DataFrame:
    """A day's holidays: the few spans go into the row as a list."""
    spans = [("1997-12-24", "1998-01-02", "winter"), ("1998-07-01", "1998-08-31", "summer")]
    day = F.to_date("o_orderdate")
    names = F.array_compact(F.array(*(F.when(day.between(a, b), F.lit(n)) for a, b, n in spans)))
    return t.orders.select("o_orderkey", F.explode(names).alias("name"))


@query("SELECT event_id, CASE WHEN c <= 1 THEN 'clear' WHEN c <= 3 THEN 'cloud' WHEN c IN (45, 48) THEN 'fog' WHEN c BETWEEN 51 AND 67 THEN 'rain' WHEN c BETWEEN 71 AND 77 THEN 'snow' WHEN c >= 95 THEN 'storm' ELSE 'unknown' END AS sky FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS c FROM events)")
def c35_sky_of_code(t: Tables) -> DataFrame:
    c = F.floor("value")
    sky = F.when(c <= 1, "clear").when(c <= 3, "cloud").when(c.isin(45, 48), "fog").when(c.between(51, 67), "rain").when(c.between(71, 77), "snow").when(c >= 95, "storm").otherwise("unknown")
    return t.events.select("event_id", sky.alias("sky"))


@query(f"SELECT CAST(floor(lat * 10 / 48) AS BIGINT) AS y, CAST(floor(lng * 10 / 48) AS BIGINT) AS x, count(*) AS n, min(s_suppkey) AS shown FROM {PTS} GROUP BY 1, 2")
def c37_marker_groups(t: Tables) -> DataFrame:
    """Markers by grid bucket of 48 pixels: the same whatever the order of rows."""
    cell = lambda c: F.floor(F.col(c) * 10 / 48)
    return points(t).groupBy(cell("lat").alias("y"), cell("lng").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.min("s_suppkey").alias("shown"))


SYNONYM = {"MACHINERY": "works", "BUILDING": "works", "AUTOMOBILE": "road", "HOUSEHOLD": "home", "FURNITURE": "home"}


@query("SELECT c_nationkey, string_agg(DISTINCT CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'works' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'road' ELSE 'home' END, ',' ORDER BY CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'works' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'road' ELSE 'home' END) AS families FROM customer GROUP BY 1")
def c39_canonical_lists(t: Tables) -> DataFrame:
    names = F.create_map(*(F.lit(x) for kv in SYNONYM.items() for x in kv))
    stated = t.customer.groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("s"))
    return stated.select("c_nationkey", F.array_join(F.array_sort(F.array_distinct(F.transform("s", lambda x: F.element_at(names, x)))), ",").alias("families"))


@query("SELECT p_partkey, CASE WHEN p_type LIKE 'PROMO%' THEN 'explicit' WHEN p_size <= 10 THEN 'default' ELSE 'none' END AS ages, CASE WHEN p_name LIKE '%bolt' THEN 'national' WHEN p_name LIKE '%gear' THEN 'regional' ELSE 'local' END AS level FROM part")
def c40_classifier(t: Tables) -> DataFrame:
    kind = F.col("p_type")
    ages = F.when(kind.startswith("PROMO"), "explicit").when(F.col("p_size") <= 10, "default").otherwise("none")
    return t.part.select("p_partkey", ages.alias("ages"), F.when(F.col("p_name").endswith("bolt"), "national").when(F.col("p_name").endswith("gear"), "regional").otherwise("local").alias("level"))


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') AND bool_or(event_type = 'signup') THEN 'both' WHEN bool_or(event_type = 'purchase') THEN 'buyers' ELSE 'others' END AS audience FROM events GROUP BY user_id")
def c41_audience_of_list(t: Tables) -> DataFrame:
    lists = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    has = lambda v: F.exists("k", lambda x: x == v)
    return lists.select("user_id", F.when(has("purchase") & has("signup"), "both").when(has("purchase"), "buyers").otherwise("others").alias("audience"))


@query("SELECT p_partkey, a, b FROM (SELECT p_partkey, 2026 - p_size AS a, 2026 - p_size + 5 AS b FROM part) WHERE 1999 BETWEEN a AND b OR 1985 BETWEEN a AND b")
def c42_birth_years(t: Tables) -> DataFrame:
    """Categories whose birth years, read from their text, hold a rider's."""
    stated = F.concat(F.lit("born "), (2026 - F.col("p_size")).cast("string"), F.lit("-"), (2031 - F.col("p_size")).cast("string"))
    years = F.regexp_extract_all("s", F.lit(r"\d{4}"), 0).cast("array<int>")
    rows = t.part.withColumn("s", stated).select("p_partkey", years.alias("y")).select("p_partkey", F.array_min("y").alias("a"), F.array_max("y").alias("b"))
    return rows.where("1999 between a and b or 1985 between a and b")


@query("SELECT page_id, CASE WHEN length(html) = 0 THEN 'empty' WHEN regexp_matches(html, '(?i)error|not found') THEN 'failing' WHEN strpos(html, '<li') > 0 THEN 'list' ELSE 'page' END AS state FROM pages")
def c43_source_state(t: Tables) -> DataFrame:
    h = F.col("html")
    return t.pages.select("page_id", F.when(F.length(h) == 0, "empty").when(h.rlike("(?i)error|not found"), "failing").when(F.contains(h, F.lit("<li")), "list").otherwise("page").alias("state"))


@query("SELECT event_id, '{\"kind\":\"' || event_type || '\",\"k\":' || json_extract_string(props, '$.k') || '}' AS j FROM events")
def c44_json_build(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select("event_id", F.to_json(F.struct(F.col("event_type").alias("kind"), k.alias("k"))).alias("j"))


@query("SELECT c_custkey, i.a, i.b FROM customer, (VALUES (1, 'x'), (2, 'y')) i(a, b)")
def c45_json_records(t: Tables) -> DataFrame:
    listed = F.from_json(F.lit('[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]'), "array<struct<a: int, b: string>>")
    return t.customer.select("c_custkey", F.inline(listed))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def c46_json_from_replies(t: Tables) -> DataFrame:
    """The first object in a reply that has words and fences around it."""
    reply = F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```"))
    return t.events.select("event_id", F.get_json_object(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "$.k").cast("int").alias("k"))


@query("SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda w: w <> '')) AS n, w FROM part, unnest(list_distinct(list_filter(string_split(p_name, ' '), lambda w: w <> ''))) u(w)")
def c47_unnest_words(t: Tables) -> DataFrame:
    words = F.filter(F.split("p_name", " "), lambda w: w != "")
    return t.part.select("p_partkey", F.size(words).alias("n"), F.explode(F.array_distinct(words)).alias("w"))


def money(c, unit: str = "EUR|Kč|USD"):
    """Amount of the first sum of money in a text: thousands by blanks, decimals by comma or point."""
    got = F.regexp_extract(c, rf"(\d{{1,3}}(?: \d{{3}})+|\d+)(?:[,.](\d{{1,2}}))? ?(?:{unit})", 1)
    cents = F.regexp_extract(c, rf"(\d{{1,3}}(?: \d{{3}})+|\d+)(?:[,.](\d{{1,2}}))? ?(?:{unit})", 2)
    return F.when(got != "", F.concat(F.replace(got, F.lit(" "), F.lit("")), F.lit("."), F.rpad(cents, 2, "0")).cast("decimal(12,2)"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(trunc(o_totalprice * 100) AS BIGINT) END AS cents FROM orders")
def c48_money_in_text(t: Tables) -> DataFrame:
    whole = F.floor("o_totalprice")
    cents = F.floor(F.col("o_totalprice") * 100) - whole * 100
    grouped = F.regexp_replace(F.format_number(whole.cast("double"), 0), ",", " ")
    stated = F.when(F.col("o_orderkey") % 3 == 0, "free of charge").otherwise(F.concat(F.lit("fee "), grouped, F.lit(","), F.lpad(cents.cast("string"), 2, "0"), F.lit(" Kč on site")))
    return t.orders.select("o_orderkey", (money(stated) * 100).cast("long").alias("cents"))


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality = 1 OR (quality IS NULL AND lang = 'en')")
def f15_strict_filter(t: Tables) -> DataFrame:
    """The fallback counts only where nothing is stated."""
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").where((F.col("quality") == 1) | (F.col("quality").isNull() & (F.col("lang") == "en"))).select("doc_id")


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%a%b%' THEN 'indoor' WHEN p_type LIKE '%MED%' THEN 'multi' WHEN p_name LIKE '%e%' THEN 'kept' WHEN p_type LIKE '%LAR%' THEN 'other' ELSE 'kept' END AS gate FROM part")
def f17_gate_precedence(t: Tables) -> DataFrame:
    n, k = F.col("p_name"), F.col("p_type")
    return t.part.select("p_partkey", F.when(n.like("%a%b%"), "indoor").when(k.like("%MED%"), "multi").when(n.like("%e%"), "kept").when(k.like("%LAR%"), "other").otherwise("kept").alias("gate"))


@query("SELECT o_orderkey, count(l_orderkey) AS kept FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND CAST(l_shipdate AS DATE) BETWEEN CAST(o_orderdate AS DATE) AND CAST(o_orderdate AS DATE) + 30 GROUP BY 1")
def f35_nested_span_filter(t: Tables) -> DataFrame:
    """Of an order's nested lines those whose day lies inside the order's span."""
    nested = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.to_date("l_shipdate")).alias("days"))
    rows = t.orders.join(nested, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("a", F.to_date("o_orderdate"))
    inside = F.size(F.filter(F.coalesce("days", F.array().cast("array<date>")), lambda d: d.between(F.col("a"), F.date_add("a", 30))))
    return rows.select("o_orderkey", inside.cast("long").alias("kept"))


@query("SELECT doc_id, CASE WHEN n_chars < 100 OR lang = 'es' THEN 'blocked' WHEN quality IS NULL THEN 'review' ELSE 'ready' END AS state, CAST(n_chars < 100 AS INT) + CAST(lang = 'es' AS INT) AS issues FROM documents LEFT JOIN labels USING (doc_id)")
def f38_candidate_eligibility(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars", "lang").join(t.labels, "doc_id", "left")
    issues = P.missing_fields({"short": F.col("n_chars") < 100, "language": F.col("lang") == "es"})
    return rows.withColumn("i", issues).select("doc_id", F.when(F.size("i") > 0, "blocked").when(F.col("quality").isNull(), "review").otherwise("ready").alias("state"), F.size("i").alias("issues"))


@query("SELECT user_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-25') AS week, bool_or(event_type = 'error' AND ts >= TIMESTAMP '2024-01-25') AS trouble FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-25') > 0")
def a24_weekly_digest(t: Tables) -> DataFrame:
    late = t.events.where(F.col("ts") >= F.lit("2024-01-25").cast("timestamp_ntz"))
    return late.groupBy("user_id").agg(F.count(F.lit(1)).alias("week"), F.bool_or(F.col("event_type") == "error").alias("trouble"))


@query(f"SELECT CAST(floor(lat / 4) AS BIGINT) AS y, CAST(floor(lng / 4) AS BIGINT) AS x, s_nationkey % 4 AS land, count(*) AS n, min(p.s_suppkey) AS keeper FROM {PTS} p JOIN supplier s ON p.s_suppkey = s.s_suppkey GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def a25_location_groups(t: Tables) -> DataFrame:
    rows = points(t).join(t.supplier.select("s_suppkey", "s_nationkey"), "s_suppkey")
    return rows.groupBy(F.floor(F.col("lat") / 4).alias("y"), F.floor(F.col("lng") / 4).alias("x"), (F.col("s_nationkey") % 4).alias("land")).agg(F.count(F.lit(1)).alias("n"), F.min("s_suppkey").alias("keeper")).where("n >= 2")


@query(f"SELECT a, b, CASE WHEN reason <> 'scored' OR score = 0 THEN 'distinct' WHEN score >= 50 THEN 'match' ELSE 'review' END AS decision FROM ({SCORED})")
def e2_decision(t: Tables) -> DataFrame:
    return scored(t).select("a", "b", F.when((F.col("reason") != "scored") | (F.col("score") == 0), "distinct").when(F.col("score") >= 50, "match").otherwise("review").alias("decision"))


@query(f"WITH s AS (SELECT a, b, score FROM ({SCORED}) WHERE score >= 20), m AS (SELECT a, max(score) AS m FROM s GROUP BY a) SELECT s.a, min(b) AS best FROM s JOIN m ON s.a = m.a AND score = m GROUP BY s.a HAVING count(*) = 1")
def e3_unique_best_match(t: Tables) -> DataFrame:
    """The best later part of each part's block, where there is one best. Later parts are counted by score where they meet a part, so that a part leaves one row for
    each score, and no pair is dealt out."""
    pairs = met(known(t.part.select("p_partkey", *BLOCK, *TOLD))).where("a < b").select(*BLOCK, "piece", "a", "b", two_scores()[0]).where("score >= 20")
    ends = pairs.groupBy(*BLOCK, "piece", "a", "score").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b"))
    top = ends.groupBy("a").agg(F.max_by(F.struct("n", "b"), "score").alias("top"))
    return top.where("top.n = 1").select("a", F.col("top.b").alias("best"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS value, p_partkey % 3 = 0 AS first FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 0")
def e11_combined_readers(t: Tables) -> DataFrame:
    """Two readers of one page: the first's fields, gaps from the second's; what only the second saw is appended."""
    a = t.part.where("p_partkey % 3 = 0").select("p_partkey", F.col("p_brand").alias("va"))
    b = t.part.where("p_partkey % 2 = 0").select("p_partkey", F.col("p_type").alias("vb"))
    return a.join(b, "p_partkey", "full").select("p_partkey", F.coalesce("va", "vb").alias("value"), F.col("va").isNotNull().alias("first"))


@query("SELECT p_partkey, arg_min(place, (n, i)) AS place FROM (SELECT p_partkey, i, CASE WHEN w IN ('ring', 'gear') THEN 'round' WHEN w IN ('bolt') THEN 'long' END AS place, 0 AS n FROM (SELECT p_partkey, generate_subscripts(string_split(lower(p_name), ' '), 1) AS i, unnest(string_split(lower(p_name), ' ')) AS w FROM part)) WHERE place IS NOT NULL GROUP BY 1")
def e17_gazetteer(t: Tables) -> DataFrame:
    """Known names among a text's words, the first of them: a small map, looked up in the row."""
    known = F.create_map(*(F.lit(x) for kv in {"ring": "round", "gear": "round", "bolt": "long"}.items() for x in kv))
    hits = F.array_compact(F.transform(F.split(F.lower("p_name"), " "), lambda w: F.try_element_at(known, w)))
    return t.part.select("p_partkey", F.try_element_at(hits, F.lit(1)).alias("place")).where("place is not null")


@query("SELECT n_nationkey, CASE WHEN n_name IN ('CHINA') THEN NULL WHEN n_regionkey = 2 THEN 'market:' || n_name WHEN n_regionkey = 3 THEN 'place:' || n_name END AS alias FROM nation")
def e18_alias_resolver(t: Tables) -> DataFrame:
    n = F.col("n_name")
    return t.nation.select("n_nationkey", F.when(n.isin("CHINA"), None).when(F.col("n_regionkey") == 2, F.concat(F.lit("market:"), n)).when(F.col("n_regionkey") == 3, F.concat(F.lit("place:"), n)).alias("alias"))


@query("SELECT a.s_suppkey, b.s_suppkey AS other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) <= 500")
def j13_sorted_pairs(t: Tables) -> DataFrame:
    """Pairs of like value inside a key, by buckets of the value and the one before."""
    rows = t.supplier.select("s_nationkey", "s_suppkey", "s_acctbal", F.floor(F.col("s_acctbal") / 500).alias("k"))
    other = rows.select("s_nationkey", F.col("s_suppkey").alias("other"), F.col("s_acctbal").alias("v"), F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)).alias("k"))
    return rows.join(other, ["s_nationkey", "k"]).where((F.col("s_suppkey") < F.col("other")) & (F.abs(F.col("s_acctbal") - F.col("v")) <= 500)).select("s_suppkey", "other")


@query(f"WITH p AS {PTS} SELECT a.s_suppkey AS l, b.s_suppkey AS r FROM p a JOIN p b ON a.s_suppkey < b.s_suppkey AND abs(a.lat - b.lat) <= 3.5 AND abs(a.lng - b.lng) <= 4.5 AND {KM} >= 0")
def j26_same_place_tolerance(t: Tables) -> DataFrame:
    """Pairs of suppliers in one tolerance of latitude and longitude."""
    from larkspur.operators.joins import within_box

    return within_box(points(t), "s_suppkey", 3.5, 4.5)


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_name LIMIT 10")
def o14_locale_order(t: Tables) -> DataFrame:
    """Names in the order of a locale; these are ASCII, so the binary order is the same."""
    return t.nation.orderBy(F.collate("n_name", "cs"), "n_nationkey").limit(10).select("n_nationkey", "n_name")


@query("SELECT 25 AS n")
def o16_seeded_sample(t: Tables) -> DataFrame:
    """A random sample, the same for a seed: as many rows as asked for."""
    return t.orders.orderBy(F.xxhash64("o_orderkey", F.lit(7)), "o_orderkey").limit(25).agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("SELECT lang, source, count(*) AS n FROM documents WHERE n_chars > 300 GROUP BY 1, 2")
def s19_materialised_feed(t: Tables) -> DataFrame:
    """A feed is written once and read from there."""
    from larkspur.functions.scratch import written

    feed = written(t.documents.where("n_chars > 300").select("lang", "source", "doc_id"), "feed")
    return feed.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT a.k AS k, list_has_any(a.s, b.s) AS shares FROM (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a JOIN (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS s FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k")
def u5_shared_family(t: Tables) -> DataFrame:
    part = lambda s, name: t.orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias(name))
    return part("F", "x").join(part("O", "y"), "k").select("k", ((F.size("x") > 0) & (F.size("y") > 0) & P.overlaps("x", F.col("y"))).alias("shares"))


@query("SELECT p_partkey, p_retailprice, round(p_retailprice * 1.21, 4) AS gross FROM part")
def x4_generated_column(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_retailprice").withColumn("gross", F.round(F.col("p_retailprice") * 1.21, 4))


@query("SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_size + 1 ELSE p_size END AS p_size, p_size % 4 <> 0 AS written FROM part")
def x3_revision_check(t: Tables) -> DataFrame:
    """A write takes effect only where the row's revision is the one it was read at."""
    patch = t.part.select("p_partkey", F.when(F.col("p_size") % 4 != 0, F.col("p_size")).otherwise(-1).alias("read_at"))
    rows = t.part.select("p_partkey", "p_size").join(patch, "p_partkey")
    same = F.col("p_size") == F.col("read_at")
    return rows.select("p_partkey", F.when(same, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"), same.alias("written"))
