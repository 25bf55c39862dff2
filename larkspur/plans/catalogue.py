"""Filters, projections, ordering and sets over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.operators import filters as P
from larkspur.plans.registry import Tables, query

DAY = "CAST(o_orderdate AS DATE)"


def facts(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("priority"))


def customers(t: Tables) -> DataFrame:
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    dim = t.customer.join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    return dim.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"))


FLAG_SQL = f"""SELECT o_orderkey, {DAY} AS day, o_totalprice AS amount, c_name AS name, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name IN (SELECT r_name FROM region WHERE r_regionkey < 3) AND c_mktsegment = 'BUILDING' AND o_orderstatus IN ('O', 'P') AND {DAY} >= DATE '1997-06-01' AND o_totalprice BETWEEN 1000 AND 200000"""


@query(FLAG_SQL)
def f1_catalogue_query(t: Tables) -> DataFrame:
    """The flagship: one plan of date floor, enumerations, range and dimensions, in date order."""
    regions = [r.r_name for r in t.region.where("r_regionkey < 3").collect()]
    spec = P.Spec(regions=regions, segments=["BUILDING"], statuses=["O", "P"], date_from="1997-06-01", low=1000, high=200000)
    return P.catalogue(facts(t), customers(t), "o_custkey", spec, "1995-01-01").select("o_orderkey", "day", "amount", "name", "nation").orderBy("day", "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority <> '1-URGENT'")
def f2_enum_predicates(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderstatus").isin("F", "P") & (F.col("o_orderpriority") != "1-URGENT")).select("o_orderkey", "o_orderstatus")


@query(f"SELECT o_orderkey, 'bad' AS floor FROM orders UNION ALL SELECT o_orderkey, 'given' FROM orders WHERE {DAY} >= DATE '1999-03-01' UNION ALL SELECT o_orderkey, 'default' FROM orders WHERE {DAY} >= DATE '2000-01-01'")
def f3_date_floor(t: Tables) -> DataFrame:
    out = None
    for name, stated in (("bad", "1999-31-31"), ("given", "1999-03-01"), ("default", None)):
        got = facts(t).where(P.date_floor("day", stated, "2000-01-01")).select("o_orderkey", F.lit(name).alias("floor"))
        out = got if out is None else out.unionByName(got)
    return out


TAGS = "[CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END, o_orderstatus]"


def tagged(t: Tables) -> DataFrame:
    return t.orders.withColumn("tags", F.array(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")), F.col("o_orderstatus")))


@query(f"SELECT o_orderkey FROM orders WHERE coalesce(list_has_any(list_filter({TAGS}, lambda x: x IS NOT NULL), ['1-URGENT', 'P']), false)")
def f4_array_overlap(t: Tables) -> DataFrame:
    return tagged(t).where(P.overlaps("tags", ["1-URGENT", "P"])).select("o_orderkey")


@query(f"SELECT o_orderkey FROM orders WHERE list_has_all({TAGS}, ['1-URGENT', 'O'])")
def f5_array_containment(t: Tables) -> DataFrame:
    return tagged(t).where(P.contains_all("tags", ["1-URGENT", "O"])).select("o_orderkey")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang IN ('de', 'fr') OR l.quality IS NULL OR l.toxic = 1")
def f6_disjunction(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").where(F.col("lang").isin("de", "fr") | F.col("quality").isNull() | (F.col("toxic") == 1)).select("doc_id")


LEVEL = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query("SELECT o_orderkey, CASE WHEN d.quality IS NULL THEN 'possible' WHEN d.toxic = 1 THEN 'possible' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'match' WHEN o_orderpriority = '3-MEDIUM' THEN 'possible' ELSE 'no' END AS answer FROM orders LEFT JOIN labels d ON o_orderkey = d.doc_id")
def f13_three_valued_match(t: Tables) -> DataFrame:
    rows = t.orders.join(t.labels, F.col("o_orderkey") == F.col("doc_id"), "left")
    stated = F.when(F.col("quality").isNotNull(), F.array("o_orderpriority"))
    return rows.withColumn("stated", stated).select("o_orderkey", P.three_valued("stated", ["1-URGENT", "2-HIGH"], ["3-MEDIUM"], F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("answer"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 4 END AS rank FROM orders")
def f14_match_rank(t: Tables) -> DataFrame:
    c = F.col("o_orderpriority")
    return t.orders.select("o_orderkey", F.when(c == "1-URGENT", 0).when(c == "2-HIGH", 1).when(c == "3-MEDIUM", 2).when(c == "4-NOT SPECIFIED", 3).otherwise(4).alias("rank"))


@query("SELECT user_id, event_id FROM events WHERE event_type <> 'error' AND NOT regexp_matches(props, '\"k\": [0-9]{2,}') AND value >= 0")
def f16_visibility(t: Tables) -> DataFrame:
    return t.events.where((F.col("event_type") != "error") & ~F.col("props").rlike('"k": [0-9]{2,}') & (F.col("value") >= 0)).select("user_id", "event_id")


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%blue%'")
def f18_ilike_stripped(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_name").ilike("%" + "b%lu_e".replace("%", "").replace("_", "") + "%")).select("p_partkey")


@query("SELECT p_partkey, regexp_matches(p_name, '^[a-m]') AS early, NOT regexp_matches(lower(p_type), 'economy|promo') AS other FROM part")
def f19_regex_predicates(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.col("p_name").rlike("^[a-m]").alias("early"), (~F.col("p_type").rlike("(?i)economy|promo")).alias("other"))


@query("SELECT doc_id FROM documents WHERE strpos(text, 'License') > 0")
def f20_substring_predicate(t: Tables) -> DataFrame:
    return t.documents.where(F.instr("text", "License") > 0).select("doc_id")


@query("SELECT count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS DISTINCT FROM l.toxic")
def f21_null_safe_compare(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").where(~F.col("quality").eqNullSafe(F.col("toxic"))).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL AND CAST(json_extract(props, '$.k') AS BIGINT) < 20")
def f22_json_predicates(t: Tables) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return t.events.select("event_id", k.alias("k")).where(F.col("k").isNotNull() & (F.col("k") < 20))


@query("SELECT d.doc_id, array_to_string(list_filter([CASE WHEN n_chars < 200 THEN 'length' END, CASE WHEN l.quality IS NULL THEN 'quality' END, CASE WHEN d.lang = 'en' THEN NULL ELSE 'translation' END], lambda x: x IS NOT NULL), ',') AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def f23_completeness_flags(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars", "lang").join(t.labels, "doc_id", "left")
    flags = P.missing_fields({"length": F.col("n_chars") < 200, "quality": F.col("quality").isNull(), "translation": F.col("lang") != "en"})
    return rows.select("doc_id", F.array_join(flags, ",").alias("missing"))


@query(f"""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus = 'F' AND {DAY} > DATE '2000-06-01' THEN 'closed_in_future' END, CASE WHEN o_totalprice <= 2000 THEN 'low' END, CASE WHEN year({DAY}) NOT IN (1995 + o_orderkey % 7, 1996) THEN 'year' END], lambda x: x IS NOT NULL), ',') AS issues FROM orders""")
def f24_validity_issues(t: Tables) -> DataFrame:
    year = F.year("day")
    flags = P.missing_fields({"closed_in_future": (F.col("status") == "F") & (F.col("day") > "2000-06-01"), "low": F.col("amount") <= 2000, "year": ~((year == 1995 + F.col("o_orderkey") % 7) | (year == 1996))})
    return facts(t).select("o_orderkey", F.array_join(flags, ",").alias("issues"))


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey IN (1, 3, 5, 7, 9)")
def f25_country_gate(t: Tables) -> DataFrame:
    return t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).where(F.col("n_nationkey").isin(1, 3, 5, 7, 9)).select("s_suppkey", "n_name")


@query("SELECT doc_id, x, (regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(x AS DATE) IS NOT NULL AND abs(year(TRY_CAST(x AS DATE)) - 2025) <= 1) IS TRUE AS ok FROM (SELECT doc_id, (2022 + doc_id % 6) || '-' || lpad(CAST(doc_id % 14 AS VARCHAR), 2, '0') || '-' || CASE WHEN doc_id % 5 = 0 THEN '7' ELSE '15' END AS x FROM documents)")
def f26_ingestible_date(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    x = F.concat_ws("-", (2022 + i % 6).cast("string"), F.lpad((i % 14).cast("string"), 2, "0"), F.when(i % 5 == 0, "7").otherwise("15"))
    day = F.when(F.col("x").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr("try_cast(x as date)"))
    return t.documents.select("doc_id", x.alias("x")).select("doc_id", "x", F.coalesce(F.abs(F.year(day) - 2025) <= 1, F.lit(False)).alias("ok"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('3-MEDIUM', '2-HIGH', '1-URGENT')")
def f27_level_at_least(t: Tables) -> DataFrame:
    return t.orders.where(P.at_least("o_orderpriority", LEVEL, "3-MEDIUM")).select("o_orderkey")


@query(f"SELECT o_orderkey, {DAY} + CAST((6 - isodow({DAY}) + 7) % 7 AS INTEGER) AS saturday, CAST(date_trunc('month', {DAY}) AS DATE) AS month FROM orders")
def f28_date_presets(t: Tables) -> DataFrame:
    """The weekend on or after a day (its own on Saturday; of a Sunday the next) and the month."""
    ahead = F.pmod(5 - F.weekday("day"), F.lit(7))
    return facts(t).select("o_orderkey", F.date_add("day", ahead.cast("int")).alias("saturday"), F.trunc("day", "month").alias("month"))


@query(f"SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE {DAY} BETWEEN DATE '1996-05-01' AND DATE '1997-04-30' AND c_nationkey < 12 AND (c_mktsegment = 'MACHINERY' OR o_orderpriority = '1-URGENT')")
def f29_collection_membership(t: Tables) -> DataFrame:
    rows = facts(t).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.where(F.col("day").between("1996-05-01", "1997-04-30") & (F.col("c_nationkey") < 12) & ((F.col("c_mktsegment") == "MACHINERY") | (F.col("priority") == "1-URGENT"))).select("o_orderkey")


@query("SELECT d.doc_id, coalesce(nullif(d.lang, 'en'), CASE WHEN l.quality = 1 THEN 'good' END, 'unknown') AS label, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def f30_projection_fallbacks(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.nullif("lang", F.lit("en")), F.when(F.col("quality") == 1, "good"), F.lit("unknown")).alias("label"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS content FROM nation")
def f31_drop_columns_to_json(t: Tables) -> DataFrame:
    rest = t.nation.drop("n_nationkey").columns
    return t.nation.select("n_nationkey", F.to_json(F.struct(*rest)).alias("content"))


@query("SELECT doc_id, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 3 WHEN l.quality = 1 THEN 2 WHEN l.quality = 0 THEN 1 ELSE 0 END AS trust FROM documents LEFT JOIN labels l USING (doc_id)")
def f33_trust_level(t: Tables) -> DataFrame:
    q, x = F.col("quality"), F.col("toxic")
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.when((q == 1) & (x == 0), 3).when(q == 1, 2).when(q == 0, 1).otherwise(0).alias("trust"))


@query("SELECT event_id, TRY_CAST(json_extract_string(j, '$.k') AS INTEGER) AS k, TRY_CAST(json_extract_string(j, '$.v') AS DOUBLE) AS v FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{\"k\": \"x\", \"v\": 1.5}' ELSE props END AS j FROM events)")
def f34_lenient_fields(t: Tables) -> DataFrame:
    """Each field of a document is read on its own: a bad one is null, the others stay."""
    j = F.when(F.col("event_id") % 3 == 0, '{"k": "x", "v": 1.5}').otherwise(F.col("props"))
    field = lambda name, kind: F.expr(f"try_cast(get_json_object(j, '$.{name}') as {kind})")
    return t.events.withColumn("j", j).select("event_id", field("k", "int").alias("k"), field("v", "double").alias("v"))


@query("SELECT doc_id, CASE WHEN strpos(text, 'License') = 0 THEN 'no_quote' WHEN n_chars > 6000 THEN 'too_long' WHEN lang <> 'en' THEN 'language' ELSE 'ok' END AS reason FROM documents")
def f36_ordered_reasons(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.when(~F.contains("text", F.lit("License")), "no_quote").when(F.col("n_chars") > 6000, "too_long").when(F.col("lang") != "en", "language").otherwise("ok").alias("reason"))


@query("SELECT conv_id, bool_and(role IN ('user', 'assistant') AND length(text) BETWEEN 1 AND 5000) AS ok FROM conversations GROUP BY conv_id")
def f37_strict_validation(t: Tables) -> DataFrame:
    """One bad item refuses all of its group."""
    return t.conversations.groupBy("conv_id").agg(F.bool_and(F.col("role").isin("user", "assistant") & F.char_length("text").between(1, 5000)).alias("ok"))


@query("SELECT page_id, score FROM (SELECT page_id, 6 * CAST(strpos(html, 'License') > 0 AS INT) + 3 * CAST(strpos(url, 'a') > 0 AS INT) + 2 * CAST(strpos(html, '<li') > 0 AS INT) - 5 * CAST(length(html) < 1500 AS INT) AS score FROM pages) WHERE score >= 2")
def f39_link_score(t: Tables) -> DataFrame:
    has = lambda c, s: F.contains(c, F.lit(s)).cast("int")
    score = 6 * has("html", "License") + 3 * has("url", "a") + 2 * has("html", "<li") - 5 * (F.char_length("html") < 1500).cast("int")
    return t.pages.select("page_id", score.alias("score")).where("score >= 2")


# Ordering and limits


@query(f"SELECT o_orderkey, {DAY} AS day FROM orders ORDER BY day, o_orderkey LIMIT 500")
def o1_stable_sort(t: Tables) -> DataFrame:
    return facts(t).select("o_orderkey", "day").orderBy("day", "o_orderkey").limit(500)


@query("SELECT s_suppkey, bal FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_acctbal END AS bal FROM supplier) ORDER BY bal ASC NULLS LAST, s_suppkey LIMIT 90")
def o2_nulls_last(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("bal")).orderBy(F.asc_nulls_last("bal"), "s_suppkey").limit(90)


@query("SELECT p_partkey FROM part ORDER BY p_brand <> 'Brand#11', p_size DESC, p_retailprice, p_partkey LIMIT 40")
def o4_multi_key_top_k(t: Tables) -> DataFrame:
    return t.part.orderBy(F.col("p_brand") != "Brand#11", F.desc("p_size"), "p_retailprice", "p_partkey").limit(40).select("p_partkey")


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size * 2 + p_retailprice / 1000 DESC, p_partkey) AS r FROM part) WHERE r = 1")
def o7_survivor_choice(t: Tables) -> DataFrame:
    order = W.partitionBy("p_brand").orderBy(F.desc(F.col("p_size") * 2 + F.col("p_retailprice") / 1000), "p_partkey")
    return t.part.withColumn("r", F.row_number().over(order)).where("r = 1").select("p_brand", "p_partkey")


@query(f"SELECT o_orderkey FROM orders ORDER BY o_orderpriority, {DAY}, o_orderkey LIMIT 200")
def o8_queue_order(t: Tables) -> DataFrame:
    return facts(t).orderBy("priority", "day", "o_orderkey").limit(200).select("o_orderkey")


@query(f"SELECT o_orderkey FROM orders ORDER BY {DAY} < DATE '1998-01-01', CASE WHEN {DAY} < DATE '1998-01-01' THEN DATE '1998-01-01' - {DAY} ELSE {DAY} - DATE '1998-01-01' END, o_orderkey LIMIT 300")
def o10_forward_first(t: Tables) -> DataFrame:
    """Upcoming days first, nearest ahead; then past ones, latest first."""
    today = F.lit("1998-01-01").cast("date")
    return facts(t).orderBy(F.col("day") < today, F.abs(F.datediff("day", today)), "o_orderkey").limit(300).select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END AS w FROM orders) ORDER BY w NULLS FIRST, o_orderkey LIMIT 250")
def o11_stalest_first(t: Tables) -> DataFrame:
    return t.orders.withColumn("w", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate"))).orderBy(F.asc_nulls_first("w"), "o_orderkey").limit(250).select("o_orderkey")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 2")
def o12_quota_per_host(t: Tables) -> DataFrame:
    return t.events.withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))).where("r <= 2").select("user_id", "event_id")


@query("SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 500")
def o13_clamped_limit(t: Tables) -> DataFrame:
    return t.part.select("p_partkey").orderBy("p_partkey").limit(max(1, min(9000, 500)))


@query("SELECT (SELECT count(*) FROM orders) AS n, true AS near_tenth")
def o15_hash_sample(t: Tables) -> DataFrame:
    """A tenth of all keys, the same ones at every run; the members follow the hash, so only the share is compared."""
    inside = F.pmod(F.xxhash64("o_orderkey"), F.lit(10)) == 0
    got = t.orders.agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("s"))
    return got.select("n", (F.abs(F.col("s") / F.col("n") - 0.1) < 0.05).alias("near_tenth"))


# Sets


@query("SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)")
def u1_union_distinct(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT n, count(*) AS c FROM (SELECT c_nationkey AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY n")
def u2_union_all(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("n")).unionByName(t.supplier.select(F.col("s_nationkey").alias("n"))).groupBy("n").agg(F.count(F.lit(1)).alias("c"))


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(flatten([list(DISTINCT o_orderpriority), list(DISTINCT o_orderstatus)]))), ',') AS tags FROM orders GROUP BY o_custkey")
def u3_array_union(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.array_union(F.collect_set("o_orderpriority"), F.collect_set("o_orderstatus"))), ",").alias("tags"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def u4_key_difference(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
