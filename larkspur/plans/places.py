"""Dates and places: calendars, distances, nearness, taxonomies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import geo as G
from larkspur.operators import filters as P
from larkspur.plans.joins import POINT, points
from larkspur.plans.registry import Tables, query

DAY = "CAST(o_orderdate AS DATE)"
CENTRE = (48.0, 11.0)
KM = "2 * 6371 * asin(sqrt(least(1, pow(sin(radians({0} - {2}) / 2), 2) + cos(radians({2})) * cos(radians({0})) * pow(sin(radians({1} - {3}) / 2), 2))))"
FAR = KM.format("lat", "lng", *CENTRE)
PTS = f"(SELECT s_suppkey, {POINT} FROM supplier)"


@query(f"SELECT s_suppkey FROM {PTS} WHERE lat BETWEEN 40 AND 55 AND lng BETWEEN -5 AND 20")
def f7_bounding_box(t: Tables) -> DataFrame:
    return points(t).where(P.in_box("lat", "lng", 40, -5, 55, 20)).select("s_suppkey")


RING = [(-4.03, 36.07), (25.51, 41.13), (18.22, 60.31), (2.27, 47.19)]


def sql_ring() -> str:
    corners, terms = [*RING, RING[0]], []
    for (x1, y1), (x2, y2) in zip(corners[:-1], corners[1:], strict=True):
        terms.append(f"CASE WHEN (lat < {y1}) <> (lat < {y2}) AND lng < {x1} + (lat - {y1}) * {(x2 - x1) / (y2 - y1)!r}::DOUBLE THEN 1 ELSE 0 END")
    return " + ".join(terms)


@query(f"SELECT s_suppkey FROM {PTS} WHERE ({sql_ring()}) % 2 = 1")
def f8_polygon(t: Tables) -> DataFrame:
    return points(t).where(P.in_polygon("lat", "lng", RING)).select("s_suppkey")


@query(f"SELECT s_suppkey, round({FAR}, 3) AS km FROM {PTS} WHERE {FAR} <= 600")
def f9_radius(t: Tables) -> DataFrame:
    """A box first, which is cheap and can be pushed down; then the exact distance."""
    south, west, north, east = G.km_box(*CENTRE, 600)
    km = G.haversine(F.lit(CENTRE[0]), F.lit(CENTRE[1]), F.col("lat"), F.col("lng"))
    return points(t).where(P.in_box("lat", "lng", south, west, north, east)).withColumn("km", km).where("km <= 600").select("s_suppkey", F.round("km", 3).alias("km"))


@query(f"SELECT s_suppkey, lat - (0.65 * 2) AS south, lng + (0.65 * 3) AS east, abs(lat - {CENTRE[0]}) > 0.9 * 5 AS refetch FROM {PTS}")
def f10_viewport_growth(t: Tables) -> DataFrame:
    return points(t).select("s_suppkey", (F.col("lat") - 0.65 * 2).alias("south"), (F.col("lng") + 0.65 * 3).alias("east"), (F.abs(F.col("lat") - CENTRE[0]) > 0.9 * 5).alias("refetch"))


FAMILY = {"BUILDING": "works", "MACHINERY": "works", "HOUSEHOLD": "home", "FURNITURE": "home", "AUTOMOBILE": "road"}


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'works' WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'home' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'road' ELSE 'other' END AS family FROM customer")
def f11_dominant_family(t: Tables) -> DataFrame:
    names = F.create_map(*(F.lit(x) for kv in FAMILY.items() for x in kv))
    return t.customer.select("c_custkey", F.coalesce(F.try_element_at(names, F.col("c_mktsegment")), F.lit("other")).alias("family"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')")
def f12_hierarchy_expansion(t: Tables) -> DataFrame:
    wanted = [leaf for leaf, parent in FAMILY.items() if parent in ("works", "road")]
    return t.customer.where(F.col("c_mktsegment").isin(wanted)).select("c_custkey")


@query(f"SELECT o_orderkey, {DAY} - DATE '1998-03-01' AS diff, CAST({DAY} + 45 AS DATE) AS later, CAST(date_trunc('month', {DAY}) + INTERVAL 2 MONTH AS DATE) AS month2, day(last_day({DAY})) AS days FROM orders")
def c22_day_arithmetic(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", F.datediff(day, F.lit("1998-03-01").cast("date")).alias("diff"), F.date_add(day, 45).alias("later"), F.add_months(F.trunc(day, "month"), 2).alias("month2"), F.dayofmonth(F.last_day(day)).alias("days"))


@query(f"SELECT o_orderkey, isodow({DAY}) AS weekday, isodow({DAY}) >= 6 OR isodow({DAY}) = 3 AS busy FROM orders")
def c23_weekdays(t: Tables) -> DataFrame:
    d = F.weekday(F.to_date("o_orderdate")) + 1
    return t.orders.select("o_orderkey", d.alias("weekday"), ((d >= 6) | (d == 3)).alias("busy"))


@query(f"SELECT o_orderkey, CASE WHEN month({DAY}) >= 10 THEN year({DAY}) || '/' || (year({DAY}) + 1) WHEN month({DAY}) <= 2 THEN (year({DAY}) - 1) || '/' || year({DAY}) ELSE CAST(year({DAY}) AS VARCHAR) END AS season, CASE WHEN month({DAY}) >= 9 THEN year({DAY}) + 1 ELSE year({DAY}) END AS reference FROM orders")
def c24_seasons(t: Tables) -> DataFrame:
    """A winter season begins in October; the reference year turns in September: two cut-offs on purpose."""
    day = F.to_date("o_orderdate")
    y, m = F.year(day), F.month(day)
    season = F.when(m >= 10, F.concat_ws("/", y, y + 1)).when(m <= 2, F.concat_ws("/", y - 1, y)).otherwise(y.cast("string"))
    return t.orders.select("o_orderkey", season.alias("season"), F.when(m >= 9, y + 1).otherwise(y).alias("reference"))


@query(f"SELECT o_orderkey, TRY_CAST(regexp_extract(s, '([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}})', 0) AS DATE) AS day FROM (SELECT o_orderkey, 'from ' || CASE WHEN o_orderkey % 4 = 0 THEN '1999-02-31' ELSE CAST({DAY} AS VARCHAR) END || ' on' AS s FROM orders)")
def c25_date_in_text(t: Tables) -> DataFrame:
    s = F.concat(F.lit("from "), F.when(F.col("o_orderkey") % 4 == 0, "1999-02-31").otherwise(F.to_date("o_orderdate").cast("string")), F.lit(" on"))
    return t.orders.select("o_orderkey", F.try_to_date(F.regexp_extract(s, r"\d{4}-\d{2}-\d{2}", 0), "yyyy-MM-dd").alias("day"))


@query("SELECT l_orderkey, l_linenumber, abs(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE)) >= 30 AS moved FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def c26_reschedule_test(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", (F.abs(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))) >= 30).alias("moved"))


@query("SELECT l_orderkey, bool_and(greatest(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)) < DATE '1998-01-01') AS run FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def c27_past_completion(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("l_orderkey").agg(F.bool_and(F.greatest(F.to_date("l_shipdate"), F.to_date("o_orderdate")) < "1998-01-01").alias("run"))


@query(f"SELECT o_orderkey, CASE WHEN d < -7 THEN 30 WHEN d <= 7 THEN 1 WHEN d <= 30 THEN 3 ELSE 7 END AS wait FROM (SELECT o_orderkey, {DAY} - DATE '1998-03-01' AS d FROM orders)")
def c28_poll_schedule(t: Tables) -> DataFrame:
    d = F.datediff(F.to_date("o_orderdate"), F.lit("1998-03-01").cast("date"))
    return t.orders.select("o_orderkey", F.when(d < -7, 30).when(d <= 7, 1).when(d <= 30, 3).otherwise(7).alias("wait"))


@query("SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Prague' AS DATE) AS day FROM events")
def c29_zone_day(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("Europe/Prague"), F.col("ts"))).alias("day"))


@query(f"SELECT s_suppkey, round({FAR}, 4) AS km FROM {PTS}")
def c32_haversine(t: Tables) -> DataFrame:
    return points(t).select("s_suppkey", F.round(G.haversine(F.lit(CENTRE[0]), F.lit(CENTRE[1]), F.col("lat"), F.col("lng")), 4).alias("km"))


@query(f"SELECT CAST(floor(lat / 2.5) AS BIGINT) AS y, CAST(floor(lng / 2.5) AS BIGINT) AS x, count(*) AS n FROM {PTS} GROUP BY 1, 2")
def c33_grid_cells(t: Tables) -> DataFrame:
    return points(t).groupBy(G.cell(F.col("lat"), 2.5).alias("y"), G.cell(F.col("lng"), 2.5).alias("x")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, CAST(floor(c_acctbal / 10 + 0.5) AS BIGINT) AS tens FROM customer")
def c34_round_half_up(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", G.round_half_up(F.col("c_acctbal") / 10).alias("tens"))


@query("SELECT event_id, least(greatest(value, 5), 75) AS radius FROM events")
def c36_clamped_radius(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.least(F.greatest("value", F.lit(5.0)), F.lit(75.0)).alias("radius"))


@query("SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_quantity AS DECIMAL(18, 4)) * 0.003 + CAST(l_tax AS DECIMAL(18, 4)) * 0.015, 9) AS DOUBLE) AS cost FROM lineitem")
def c38_token_cost(t: Tables) -> DataFrame:
    money = lambda c, price: F.col(c).cast("decimal(18,4)") * F.lit(price).cast("decimal(9,3)")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(money("l_quantity", "0.003") + money("l_tax", "0.015"), 9).cast("double").alias("cost"))


@query(f"SELECT s_suppkey, tier FROM (SELECT s_suppkey, CASE WHEN {FAR} < 300 THEN 0 ELSE 1 END AS tier, row_number() OVER (ORDER BY CASE WHEN {FAR} < 300 THEN 0 ELSE 1 END, {FAR}, s_suppkey) AS r FROM {PTS} WHERE {FAR} <= 900) WHERE r <= 6")
def o5_nearby_with_fallback(t: Tables) -> DataFrame:
    """The six nearest, those within the inner radius first."""
    km = G.haversine(F.lit(CENTRE[0]), F.lit(CENTRE[1]), F.col("lat"), F.col("lng"))
    rows = points(t).withColumn("km", km).where("km <= 900").withColumn("tier", F.when(F.col("km") < 300, 0).otherwise(1))
    return rows.orderBy("tier", "km", "s_suppkey").limit(6).select("s_suppkey", "tier")


@query(f"WITH p AS (SELECT s.s_suppkey, s_nationkey, {FAR} AS km FROM {PTS} q JOIN supplier s ON q.s_suppkey = s.s_suppkey) SELECT s_nationkey, arg_min(s_suppkey, (km, s_suppkey)) AS nearest FROM p WHERE s_suppkey % 3 <> 0 GROUP BY 1")
def o6_single_nearest(t: Tables) -> DataFrame:
    km = G.haversine(F.lit(CENTRE[0]), F.lit(CENTRE[1]), F.col("lat"), F.col("lng"))
    rows = points(t).withColumn("km", km).join(t.supplier.select("s_suppkey", "s_nationkey"), "s_suppkey")
    planned = t.supplier.where("s_suppkey % 3 = 0").select("s_suppkey")
    return rows.join(planned, "s_suppkey", "left_anti").groupBy("s_nationkey").agg(F.min_by("s_suppkey", F.struct("km", "s_suppkey")).alias("nearest"))


@query("SELECT o_orderkey, band FROM (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND c_nationkey < 5 THEN 0 WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN c_nationkey < 5 THEN 2 ELSE 3 END AS band FROM orders JOIN customer ON o_custkey = c_custkey) ORDER BY band, o_orderkey LIMIT 400")
def o9_work_bands(t: Tables) -> DataFrame:
    soon, first = F.col("o_orderpriority") == "1-URGENT", F.col("c_nationkey") < 5
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", F.when(soon & first, 0).when(soon, 1).when(first, 2).otherwise(3).alias("band")).orderBy("band", "o_orderkey").limit(400)


@query("SELECT p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part) WHERE r <= 4")
def o3_rank_inside_tier(t: Tables) -> DataFrame:
    return t.part.withColumn("r", F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey"))).where("r <= 4").select("p_partkey")
