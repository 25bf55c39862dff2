"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.operators.joins import held_items
from larkspur.operators import rollups as R
from larkspur.plans.registry import Tables, query


@query("SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY user_id")
def a1_counts_with_filters(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), *R.counts_where(errors=F.col("event_type") == "error", high=F.col("value") > 50))


@query("SELECT user_id, max(value) FILTER (WHERE event_type = 'purchase') AS best FROM events GROUP BY user_id")
def a2_max_with_filter(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("best"))


@query("SELECT l_orderkey, bool_and(l_quantity > 5) AS every, bool_or(l_returnflag = 'R') AS some FROM lineitem GROUP BY 1")
def a3_bool_aggregates(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") > 5).alias("every"), F.bool_or(F.col("l_returnflag") == "R").alias("some"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_tax) AS low, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ALL")
def a4_sums_and_averages(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"), F.min("l_tax").alias("low"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    )


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1")
def a5_count_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))).alias("returned"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def a6_ordered_strings(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15 AND max(o_totalprice) > 200000")
def a7_having(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("m")).where("n >= 15 and m > 200000").drop("m")


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, p_brand")
def a8_series_tally(t: Tables) -> DataFrame:
    return t.part.where("p_size > 10").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").orderBy(F.desc("n"), "p_brand")


@query("SELECT c_nationkey, seg, count(*) AS n FROM (SELECT c_nationkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'heavy' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'home' ELSE 'other' END AS seg FROM customer) GROUP BY GROUPING SETS ((c_nationkey, seg), (c_nationkey), ())")
def a9_tally_by_levels(t: Tables) -> DataFrame:
    s = F.col("c_mktsegment")
    rows = t.customer.withColumn("seg", F.when(s.isin("BUILDING", "MACHINERY"), "heavy").when(s == "HOUSEHOLD", "home").otherwise("other"))
    return rows.rollup("c_nationkey", "seg").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, total, complete, floor(complete * 1000 / total + 0.5) / 10 AS percent, ceil(total * 0.9) AS target, greatest(ceil(total * 0.9) - complete, 0) AS remaining FROM (SELECT lang, count(*) AS total, count(*) FILTER (WHERE n_chars >= 500) AS complete FROM documents GROUP BY lang)")
def a10_completeness_percent(t: Tables) -> DataFrame:
    return R.completeness(t.documents.select("lang", "n_chars"), "lang", F.col("n_chars") >= 500)


@query("""WITH p AS (SELECT a.o_orderkey AS key, max(CASE b.o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END) AS s FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND CAST(a.o_orderdate AS DATE) - CAST(b.o_orderdate AS DATE) BETWEEN 300 AND 430 GROUP BY 1)
SELECT state, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 1) AS percent FROM (SELECT CASE coalesce(s, 0) WHEN 3 THEN 'public' WHEN 2 THEN 'hidden' WHEN 1 THEN 'mentioned' ELSE 'nothing' END AS state FROM orders LEFT JOIN p ON o_orderkey = key) GROUP BY state""")
def a11_edition_coverage(t: Tables) -> DataFrame:
    """How well each order's customer is covered about a year before: the best state found, and shares."""
    rows = t.orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1).alias("s"))
    bucket = lambda day: F.floor(F.unix_date(day) / 131)  # noqa: E731  131 days, the width of the range: a row looks into two buckets at most
    a = rows.select("o_orderkey", "o_custkey", F.col("day").alias("d"), F.explode(F.sequence(bucket(F.date_sub("day", 430)), bucket(F.date_sub("day", 300)))).alias("bucket"))
    b = rows.select("o_custkey", "day", "s", bucket("day").alias("bucket"))
    best = a.join(b, ["o_custkey", "bucket"]).where(F.datediff("d", "day").between(300, 430)).groupBy("o_orderkey").agg(F.max("s").alias("s"))
    names = F.when(F.col("s") == 3, "public").when(F.col("s") == 2, "hidden").when(F.col("s") == 1, "mentioned").otherwise("nothing")
    out = rows.select("o_orderkey").join(best, "o_orderkey", "left").groupBy(names.alias("state")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))  # of at most four rows
    return out.select("state", "n", F.round(100.0 * F.col("n") / total, 1).alias("percent"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE n_chars < 200) AS short, count(*) FILTER (WHERE l.quality IS NULL) AS unlabelled, count(*) FILTER (WHERE n_chars < 200 AND l.quality IS NULL) AS both_missing FROM documents LEFT JOIN labels l USING (doc_id)")
def a12_quality_summary(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    short, bare = F.col("n_chars") < 200, F.col("quality").isNull()
    return rows.agg(F.count(F.lit(1)).alias("n"), *R.counts_where(short=short, unlabelled=bare, both_missing=short & bare))


@query("SELECT coalesce(lang, 'ALL') AS lang, count(*) AS n, min(n_chars) AS low, max(n_chars) AS high FROM documents GROUP BY ROLLUP (lang)")
def a13_stats_with_total(t: Tables) -> DataFrame:
    return t.documents.rollup("lang").agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high")).withColumn("lang", F.coalesce("lang", F.lit("ALL")))


@query("""WITH r AS (SELECT CAST(o_orderdate AS DATE) AS d, o_totalprice AS v, make_date(CAST(year(o_orderdate) + x AS INTEGER), 1, 2) AS c FROM orders, (VALUES (-1), (0), (1)) t(x))
SELECT year(c) AS year, count(*) AS days, round(avg(v), 4) AS average, round(avg(CASE WHEN v >= 100000 THEN 1.0 ELSE 0 END), 6) AS share FROM r WHERE abs(d - c) <= 3 GROUP BY 1""")
def a14_climate_summary(t: Tables) -> DataFrame:
    out = R.nearest_year_summary(t.orders.withColumn("day", F.to_date("o_orderdate")), "day", "o_totalprice", "2000-01-02", 3, 100000.0)
    return out.select("year", "days", F.round("average", 4).alias("average"), F.round("share", 6).alias("share"))


@query("""WITH s AS (SELECT o_custkey AS who, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) AS b FROM orders),
m AS (SELECT *, CASE WHEN max(b) OVER (PARTITION BY who ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= a - 1 THEN 0 ELSE 1 END AS n FROM s),
g AS (SELECT *, sum(n) OVER (PARTITION BY who ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM m) SELECT who, min(a) AS start, max(b) AS "end", count(*) AS n FROM g GROUP BY who, i""")
def a15_interval_coalescing(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    rows = t.orders.select(F.col("o_custkey").alias("who"), day.alias("start"), F.date_add(day, (F.col("o_orderkey") % 60).cast("int")).alias("end"))
    return R.coalesced_intervals(rows, ["who"], "start", "end")


@query("SELECT CAST(floor(s_acctbal / 100 + 0.5) AS BIGINT) AS cell, count(DISTINCT s_nationkey) AS n FROM supplier GROUP BY 1")
def a16_rounded_cells(t: Tables) -> DataFrame:
    return t.supplier.groupBy(F.floor(F.col("s_acctbal") / 100 + 0.5).alias("cell")).agg(F.count_distinct("s_nationkey").alias("n"))


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_key, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS kinds FROM orders GROUP BY 1")
def a17_first_row_fold(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_key"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("kinds"))


@query("SELECT p_partkey, turn FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part) ORDER BY turn, p_brand LIMIT 60")
def a18_fair_batch(t: Tables) -> DataFrame:
    return R.fair_batch(t.part, "p_brand", ["p_partkey"], 60).select("p_partkey", "turn")


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 90) THEN 'failed' WHEN bool_or(event_type = 'error') THEN 'partial' ELSE 'done' END AS state, count(*) AS n FROM events GROUP BY user_id")
def a19_batch_outcome(t: Tables) -> DataFrame:
    bad = F.col("event_type") == "error"
    return t.events.groupBy("user_id").agg(F.when(F.bool_or(bad & (F.col("value") > 90)), "failed").when(F.bool_or(bad), "partial").otherwise("done").alias("state"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, arg_max(event_id, (ts, event_id)) AS last_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-29') AS recent, max(ts) FILTER (WHERE value > 50) AS last_high FROM events GROUP BY 1")
def a20_step_status(t: Tables) -> DataFrame:
    cut = F.lit("2024-01-29").cast("timestamp_ntz")
    return t.events.groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"), F.count_if(F.col("ts") >= cut).alias("recent"), F.max(F.when(F.col("value") > 50, F.col("ts"))).alias("last_high"))


@query("WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(value) FILTER (WHERE event_type = 'purchase' AND value > 99) AS v FROM events GROUP BY 1) SELECT day, round(last_value(v IGNORE NULLS) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 4) AS v FROM d ORDER BY day DESC LIMIT 400")
def a21_daily_history(t: Tables) -> DataFrame:
    """A day without a value keeps the one before; the last 400 days stay. One row per day: the window is over calendar days."""
    day = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.when((F.col("event_type") == "purchase") & (F.col("value") > 99), F.col("value"))).alias("v"))
    carried = F.last("v", ignorenulls=True).over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0))
    return day.withColumn("v", F.round(carried, 4)).orderBy(F.desc("day")).limit(400)


@query("SELECT p_brand, count(*) AS parts, count(o) AS ordered, round(100.0 * count(o) / count(*), 1) AS percent FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS o FROM lineitem WHERE l_quantity > 45) ON p_partkey = o GROUP BY 1")
def a22_series_progress(t: Tables) -> DataFrame:
    done = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("o")).distinct()
    out = t.part.join(done, F.col("p_partkey") == F.col("o"), "left").groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"), F.count("o").alias("ordered"))
    return out.withColumn("percent", F.round(100.0 * F.col("ordered") / F.col("parts"), 1))


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS buys, coalesce(b.n, 0) AS views FROM (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 95 GROUP BY 1) a FULL JOIN (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'view' AND value > 95 GROUP BY 1) b ON a.k = b.k")
def a23_plan_assembly(t: Tables) -> DataFrame:
    def part(kind: str, name: str) -> DataFrame:
        return t.events.where((F.col("event_type") == kind) & (F.col("value") > 95)).groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias(name))

    return part("purchase", "buys").join(part("view", "views"), "k", "full").na.fill(0)


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS ks FROM customer GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 20")
def a26_capped_groups(t: Tables) -> DataFrame:
    """Groups of two to twenty rows; larger ones are left out whole. Sizes come first, so no large group is gathered."""
    by = ["c_nationkey", "c_mktsegment"]
    size = t.customer.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n between 2 and 20")
    return t.customer.join(size, by).groupBy(*by, "n").agg(F.array_join(F.array_sort(F.collect_list("c_custkey")).cast("array<string>"), ",").alias("ks"))


@query("SELECT split_part(p_name, ' ', 1) AS prefix, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY 1 HAVING count(*) >= 2")
def a27_prefix_groups(t: Tables) -> DataFrame:
    return t.part.groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_key")).where("n >= 2")


@query("SELECT w, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(p_name || ' ' || p_type, ' '))) AS w FROM part) GROUP BY w")
def a28_multi_label_counts(t: Tables) -> DataFrame:
    return t.part.select(F.explode(F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type"), " "))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


WORDS = "trim(regexp_replace({0}, '[ \\t\\n\\f\\r]+', ' ', 'g'))"


@query(f"WITH d AS MATERIALIZED (SELECT ' ' || {WORDS.format('text')} || ' ' AS s FROM documents), b AS MATERIALIZED (SELECT item_id, ' ' || {WORDS.format('text')} || ' ' AS s FROM benchmark) SELECT count(*) AS items, count(*) FILTER (WHERE hit) AS found, round(100.0 * count(*) FILTER (WHERE hit) / count(*), 1) AS recall FROM (SELECT item_id, EXISTS (SELECT 1 FROM d WHERE strpos(d.s, b.s) > 0 AND b.s <> '  ') AS hit FROM b)")
def a29_benchmark_recall(t: Tables) -> DataFrame:
    """How many benchmark items stand whole, word for word, in some document."""
    found = held_items(t.documents, t.benchmark, "doc_id", "item_id").select("item_id").distinct().withColumn("hit", F.lit(1))
    out = t.benchmark.select("item_id").join(found, "item_id", "left").agg(F.count(F.lit(1)).alias("items"), F.count("hit").alias("found"))
    return out.withColumn("recall", F.round(100.0 * F.col("found") / F.col("items"), 1))


@query(f"WITH d AS MATERIALIZED (SELECT doc_id, ' ' || {WORDS.format('text')} || ' ' AS s FROM documents), b AS MATERIALIZED (SELECT item_id, ' ' || {WORDS.format('text')} || ' ' AS s FROM benchmark) SELECT item_id, doc_id FROM b JOIN d ON strpos(d.s, b.s) > 0 WHERE b.s <> '  '")
def a29_items_in_documents(t: Tables) -> DataFrame:
    """Which documents hold which benchmark items whole."""
    return held_items(t.documents, t.benchmark, "doc_id", "item_id")


@query("SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys, true AS same FROM orders")
def a30_relation_fingerprint(t: Tables) -> DataFrame:
    """The same whatever the order and number of partitions; a hash has no SQL twin, so two layouts are compared."""
    a, b = R.fingerprint(t.orders, "o_orderkey"), R.fingerprint(t.orders.repartition(7, "o_custkey").select(*reversed(t.orders.columns)), "o_orderkey")
    return a.join(b.select("rows", F.col("content").alias("other")), "rows").select("rows", "keys", (F.col("content") == F.col("other")).alias("same"))


@query("SELECT user_id, count(*) AS row_at_end FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type NOT IN ('error', 'view') AND (x.ts, x.event_id) > (e.ts, e.event_id)) GROUP BY user_id")
def a31_failures_in_a_row(t: Tables) -> DataFrame:
    """Failures after the last real success; views in between count as neither."""
    w = F.struct("ts", "event_id")
    last = t.events.where("event_type not in ('error', 'view')").groupBy("user_id").agg(F.max(w).alias("m"))
    bad = t.events.where("event_type = 'error'").join(last, "user_id", "left").where(F.col("m").isNull() | (w > F.col("m")))
    return bad.groupBy("user_id").agg(F.count(F.lit(1)).alias("row_at_end"))


@query("SELECT o_custkey, arg_max(o_orderpriority, (-CAST(left(o_orderpriority, 1) AS INTEGER), o_orderkey)) AS best FROM orders GROUP BY 1")
def a32_best_level(t: Tables) -> DataFrame:
    rank = -F.substring("o_orderpriority", 1, 1).cast("int")
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct(rank, "o_orderkey")).alias("best"))


@query("SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS first_day, max(CAST(l_shipdate AS DATE)) AS last_day FROM lineitem GROUP BY 1")
def a33_date_span_union(t: Tables) -> DataFrame:
    day = F.to_date("l_shipdate")
    return t.lineitem.groupBy("l_orderkey").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY n DESC, 1, 2")
def a34_two_column_report(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_orderstatus", "o_orderpriority")


@query("SELECT p_size, count(DISTINCT lower(p_name)) AS names FROM part GROUP BY 1 HAVING count(DISTINCT lower(p_name)) > 1")
def a35_points_with_many_names(t: Tables) -> DataFrame:
    return t.part.groupBy("p_size").agg(F.count_distinct(F.lower("p_name")).alias("names")).where("names > 1")
