"""Joins: dimensions, existence, intervals, anniversaries, nearness, tiers, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import joins as J
from larkspur.plans.registry import Tables, query


def spans(t: Tables) -> DataFrame:
    """Orders as day spans of their customers."""
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("who"), F.to_date("o_orderdate").alias("start"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 20).cast("int")).alias("end"))


SPANS = "SELECT o_orderkey AS id, o_custkey AS who, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 20 AS INTEGER) AS e FROM orders"


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1")
def j1_left_dimension(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation.where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def j2_inner_dimension(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.where("c_acctbal > 5000"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("SELECT c_custkey, coalesce(ks, '') AS ks FROM customer LEFT JOIN (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ks FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def j3_nested_children(t: Tables) -> DataFrame:
    kids = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ks"))
    return t.customer.join(kids, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce(F.array_join(F.col("ks").cast("array<string>"), ","), F.lit("")).alias("ks"))


@query("SELECT DISTINCT p_partkey, s FROM (SELECT l_partkey AS p_partkey, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R' UNION SELECT p_partkey, p_size FROM part) WHERE s <= 20")
def j4_bridge_and_legacy(t: Tables) -> DataFrame:
    bridge = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s"))
    return bridge.union(t.part.select("p_partkey", F.col("p_size").cast("long"))).where("s <= 20").distinct()


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def j5_semi_join(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem.where("l_quantity > 49"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal < -900)")
def j6_stacked_anti_joins(t: Tables) -> DataFrame:
    key = F.col("c_custkey") == F.col("o_custkey")
    out = t.customer.join(t.orders.where("o_orderstatus = 'P'"), key, "left_anti").join(t.orders.where("o_totalprice > 400000"), key, "left_anti")
    return out.join(t.supplier.where("s_acctbal < -900"), F.col("c_nationkey") == F.col("s_nationkey"), "left_anti").select("c_custkey")


@query("SELECT p_partkey, tok, levenshtein(w, tok) AS d FROM (SELECT p_partkey, split_part(lower(p_name), ' ', 1) AS w FROM part), (VALUES ('blue'), ('gren')) v(tok) WHERE levenshtein(w, tok) <= 1")
def j7_rows_by_tokens(t: Tables) -> DataFrame:
    """Each row meets the few words of a query: they are exploded in the row, so nothing is joined."""
    word = F.lower(F.split_part("p_name", F.lit(" "), F.lit(1)))
    rows = t.part.select("p_partkey", word.alias("w"), F.explode(F.array(F.lit("blue"), F.lit("gren"))).alias("tok"))
    return rows.withColumn("d", F.levenshtein("w", "tok")).where("d <= 1").select("p_partkey", "tok", "d")


@query("SELECT p_partkey, min(levenshtein(w, 'almond')) AS best FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part) GROUP BY 1")
def j8_lateral_aggregate(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_min(F.transform(F.split(F.lower("p_name"), " "), lambda w: F.levenshtein(w, F.lit("almond")))).alias("best"))


@query(f"WITH s AS ({SPANS}) SELECT a.id AS l_id, b.id AS r_id FROM s a JOIN s b ON a.s <= b.e AND b.s <= a.e AND a.id < b.id AND a.who = b.who")
def j10_interval_overlap(t: Tables) -> DataFrame:
    s = spans(t)
    return J.interval_overlap(s, s, days=14, on=["who"]).where("l_id < r_id").select("l_id", "r_id")


@query(f"WITH s AS ({SPANS}) SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.who = b.who AND a.id < b.id AND b.s - a.e <= 3 AND a.s - b.e <= 3")
def j11_dates_compatible(t: Tables) -> DataFrame:
    """Spans of one customer that overlap or lie at most three days apart, in buckets of days: no customer's spans all meet each other."""
    s = spans(t)
    return J.spans_near(s, s, 3, days=14, on=["who"]).where("l_id < r_id").select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))


@query(f"WITH s AS (SELECT id, who, s, least(e, s + 11) AS e FROM ({SPANS})) SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.who = b.who AND a.id < b.id AND b.s - a.e <= 1 AND a.s - b.e <= 1")
def j12_day_blocks(t: Tables) -> DataFrame:
    return J.day_blocks(spans(t), "id", "start", "end", ["who"])


POINT = "((s_suppkey * 37 % 900) / 30.0 + 35) AS lat, ((s_suppkey * 53 % 1200) / 30.0 - 10) AS lng"


def points(t: Tables) -> DataFrame:
    """Places for suppliers: lat = (key * 37 mod 900) / 30 + 35, lng = (key * 53 mod 1200) / 30 - 10."""
    k = F.col("s_suppkey")
    return t.supplier.select("s_suppkey", ((k * 37 % 900) / 30.0 + 35).alias("lat"), ((k * 53 % 1200) / 30.0 - 10).alias("lng"))


KM = "2 * 6371 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"


@query(f"WITH p AS (SELECT s_suppkey, {POINT} FROM supplier) SELECT a.s_suppkey AS l, b.s_suppkey AS r, round({KM}, 3) AS km FROM p a JOIN p b ON a.s_suppkey < b.s_suppkey WHERE {KM} <= 150")
def j14_spatial_proximity(t: Tables) -> DataFrame:
    p = points(t)
    return J.within_km(p, p, 150, step=1.5).where("l_s_suppkey < r_s_suppkey").select(F.col("l_s_suppkey").alias("l"), F.col("r_s_suppkey").alias("r"), F.round("km", 3).alias("km"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 0 WHEN p_size = 7 THEN 1 WHEN p_brand = 'Brand#11' THEN 2 END AS tier, CASE WHEN p_partkey % 10 = 0 THEN p_partkey WHEN p_size = 7 THEN 7 WHEN p_brand = 'Brand#11' THEN 11 END AS found FROM part")
def j15_first_probe_wins(t: Tables) -> DataFrame:
    key = "p_partkey"
    probes = [t.part.where("p_partkey % 10 = 0").select(key, F.col(key).alias("found")), t.part.where("p_size = 7").select(key, F.lit(7).cast("long").alias("found")), t.part.where("p_brand = 'Brand#11'").select(key, F.lit(11).cast("long").alias("found"))]
    return J.first_tier(t.part.select(key), key, probes)


@query("WITH p AS (SELECT a.o_orderkey AS key, b.o_orderkey AS previous FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND CAST(a.o_orderdate AS DATE) - CAST(b.o_orderdate AS DATE) BETWEEN 300 AND 430) SELECT key, min(previous) AS previous FROM p GROUP BY key HAVING count(*) = 1")
def j16_anniversary_join(t: Tables) -> DataFrame:
    return J.unique_previous(t.orders.withColumn("day", F.to_date("o_orderdate")), "o_orderkey", ["o_custkey"], "day")


@query("SELECT c_custkey, p_partkey FROM customer JOIN part ON c_nationkey = p_size AND p_retailprice <= c_acctbal / 4 AND c_custkey % 5 = p_partkey % 5")
def j17_subscription_match(t: Tables) -> DataFrame:
    """Subscriptions meet events on all the keys they share, the rest of a division among them; the price limit is a filter on that join."""
    subscriptions = t.customer.select("c_custkey", (F.col("c_acctbal") / 4).alias("most"), F.col("c_nationkey").alias("k"), (F.col("c_custkey") % 5).alias("m"))
    # nobody meets a part dearer than their limit: parts and limits are dealt by price, and a limit looks into the steps up to its own
    step = lambda c: F.greatest(F.floor(F.col(c) / PRICE_STEP), F.lit(0))
    offers = t.part.select("p_partkey", "p_retailprice", F.col("p_size").alias("k"), (F.col("p_partkey") % 5).alias("m"), step("p_retailprice").alias("step"))
    dearest = offers.agg(F.max("step").alias("top")).first()["top"]
    if dearest is None:
        return subscriptions.join(offers, ["k", "m"]).select("c_custkey", "p_partkey").limit(0)
    wanted = subscriptions.where("most is not null").withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.least(step("most"), F.lit(dearest)))))
    return wanted.join(offers.hint("merge"), ["k", "m", "step"]).where("p_retailprice <= most").select("c_custkey", "p_partkey")


#: Width of a step of prices.
PRICE_STEP = 100


@query("SELECT DISTINCT user_id, CAST(floor(value) AS BIGINT) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-20' EXCEPT SELECT user_id, CAST(floor(value) AS BIGINT) FROM events WHERE ts < TIMESTAMP '2024-01-20'")
def j18_not_yet_delivered(t: Tables) -> DataFrame:
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    keyed = t.events.select("user_id", F.floor("value").alias("k"), "ts")
    return keyed.where(F.col("ts") >= cut).select("user_id", "k").distinct().join(keyed.where(F.col("ts") < cut), ["user_id", "k"], "left_anti")


@query("WITH e AS (SELECT DISTINCT least(l_suppkey, l_partkey % 100) AS a, greatest(l_suppkey, l_partkey % 100) AS b FROM lineitem) SELECT a, b FROM e WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE least(s_suppkey, s_nationkey) = a AND greatest(s_suppkey, s_nationkey) = b)")
def j19_pair_exclusion(t: Tables) -> DataFrame:
    pairs = t.lineitem.select("l_suppkey", (F.col("l_partkey") % 100).alias("x")).select(*J.unordered("l_suppkey", "x")).distinct()
    return pairs.join(t.supplier.select(*J.unordered("s_suppkey", "s_nationkey")), ["a", "b"], "left_anti")


@query("SELECT a.p_partkey, coalesce(b.p_partkey, a.p_partkey) AS target FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey - 7 AND a.p_partkey % 3 = 0 AND b.p_partkey % 3 <> 0")
def j20_alias_follow(t: Tables) -> DataFrame:
    """One hop to the row another was merged into; a target that is itself merged is refused."""
    merged = F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") - 7).alias("into")
    target = t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("into"), F.col("p_partkey").alias("target"))
    return t.part.select("p_partkey", merged).join(target, "into", "left").select("p_partkey", F.coalesce("target", "p_partkey").alias("target"))


@query("""WITH b AS (SELECT p_partkey AS k, p_size AS x FROM part), th AS (SELECT k, CASE WHEN k % 5 = 0 THEN x + 1 ELSE x END AS x FROM b), o AS (SELECT k, CASE WHEN k % 7 = 0 THEN x + 2 ELSE x END AS x FROM b)
SELECT k, CASE WHEN b.x = th.x THEN o.x ELSE th.x END AS x, (b.x <> th.x AND b.x <> o.x AND th.x <> o.x) AS conflict FROM b JOIN th USING (k) JOIN o USING (k)""")
def j21_three_way_merge(t: Tables) -> DataFrame:
    base = t.part.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("x"))
    theirs = base.withColumn("x", F.when(F.col("k") % 5 == 0, F.col("x") + 1).otherwise(F.col("x")))
    ours = base.withColumn("x", F.when(F.col("k") % 7 == 0, F.col("x") + 2).otherwise(F.col("x")))
    return J.three_way(base, theirs, ours, "k", ["x"])


@query("WITH p AS (SELECT l_partkey, min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(DISTINCT l_linestatus) AS kinds FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '2000-01-01' GROUP BY 1) SELECT p_partkey, CASE WHEN kinds = 1 THEN low END AS low, CASE WHEN kinds = 1 THEN high END AS high FROM part LEFT JOIN p ON p_partkey = l_partkey")
def j23_as_of_price(t: Tables) -> DataFrame:
    """Prices not expired at a day: their span, or none where the kinds are mixed."""
    open_ = t.lineitem.where(F.to_date("l_shipdate") >= "2000-01-01").groupBy("l_partkey").agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.count_distinct("l_linestatus").alias("kinds"))
    one = F.col("kinds") == 1
    return t.part.join(open_, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.when(one, F.col("low")).alias("low"), F.when(one, F.col("high")).alias("high"))


@query("SELECT e.event_id, (SELECT arg_max(value, (ts, event_id)) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts) AS last_value FROM events e WHERE event_type = 'error'")
def j23_as_of_value(t: Tables) -> DataFrame:
    """For each error the value of the user's last purchase at or before it."""
    buys = t.events.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_value"))
    return J.as_of(t.events.where("event_type = 'error'").select("event_id", "user_id", "ts"), buys, "user_id", "ts", "last_value").select("event_id", "last_value")


@query("""WITH o AS (SELECT o_custkey, o_orderpriority AS p, min(CAST(o_orderdate AS DATE)) AS d0, max(CAST(o_orderdate AS DATE)) AS d1, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, p, d0, d1 FROM o WHERE n = 2 AND d0 <> d1 AND NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND CAST(x.o_orderdate AS DATE) = o.d1 AND x.o_orderpriority <> o.p)""")
def j24_date_moves(t: Tables) -> DataFrame:
    """The same source key listed on two days only moves, unless the new day lists another key as well."""
    rows = t.orders.select("o_custkey", F.col("o_orderpriority").alias("p"), F.to_date("o_orderdate").alias("day"))
    moved = rows.groupBy("o_custkey", "p").agg(F.min("day").alias("d0"), F.max("day").alias("d1"), F.count(F.lit(1)).alias("n")).where("n = 2 and d0 <> d1").drop("n")
    other = rows.select("o_custkey", F.col("day").alias("d1"), F.col("p").alias("q"))
    return moved.join(other, (moved.o_custkey == other.o_custkey) & (moved.d1 == other.d1) & (F.col("p") != F.col("q")), "left_anti")


@query("WITH u AS (SELECT DISTINCT user_id, event_type AS k FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-17') SELECT user_id, k FROM u WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = 'signup' AND ts >= TIMESTAMP '2024-01-29')")
def j27_owners_of_change(t: Tables) -> DataFrame:
    late = t.events.where(F.col("ts") >= F.lit("2024-01-17").cast("timestamp_ntz"))
    owners = late.where("event_type = 'click'").select("user_id", F.col("event_type").alias("k")).union(late.where("event_type = 'view'").select("user_id", "event_type")).distinct()
    return owners.join(late.where((F.col("event_type") == "signup") & (F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz"))), "user_id", "left_anti")
