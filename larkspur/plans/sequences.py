"""Windows over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.operators import ingest as I
from larkspur.operators import rollups as R
from larkspur.plans.registry import Tables, query


@query("SELECT r_regionkey, row_number() OVER (ORDER BY r_name) AS n FROM region")
def w1_row_numbers(t: Tables) -> DataFrame:
    """Numbers over one small relation, in a stated order; larger ones are numbered within a key."""
    return t.region.select("r_regionkey", F.row_number().over(W.orderBy("r_name")).alias("n"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def w2_latest_per_key(t: Tables) -> DataFrame:
    return R.latest(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(value), 6) AS average FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5 GROUP BY 1")
def w3_last_n_aggregate(t: Tables) -> DataFrame:
    last = R.last_n(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)
    return last.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.avg("value"), 6).alias("average"))


@query("""WITH m AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS n FROM events), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT user_id, event_type, min(ts) AS since FROM g WHERE i = (SELECT max(i) FROM g x WHERE x.user_id = g.user_id) GROUP BY user_id, event_type""")
def w4_state_since(t: Tables) -> DataFrame:
    return R.state_since(t.events, "user_id", ["ts", "event_id"], "event_type", "ts")


@query("SELECT o_custkey, o_orderkey, p FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'O', o_totalprice, o_orderkey) AS p FROM orders) WHERE p <= 3")
def w5_rank_in_tier(t: Tables) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy(F.col("o_orderstatus") != "O", "o_totalprice", "o_orderkey")
    return t.orders.withColumn("p", F.row_number().over(w)).where("p <= 3").select("o_custkey", "o_orderkey", "p")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_totalprice >= m * 0.9")
def w6_group_relative_cut(t: Tables) -> DataFrame:
    return t.orders.withColumn("m", F.max("o_totalprice").over(W.partitionBy("o_custkey"))).where("o_totalprice >= m * 0.9D").select("o_custkey", "o_orderkey")


@query("SELECT p_brand, min(p_partkey) AS p_partkey FROM part JOIN (SELECT p_brand AS b, max(p_size) AS m FROM part GROUP BY 1) ON p_brand = b AND p_size = m GROUP BY p_brand HAVING count(*) = 1")
def w7_unique_best(t: Tables) -> DataFrame:
    """A tie at the top gives no answer."""
    top = t.part.withColumn("r", F.rank().over(W.partitionBy("p_brand").orderBy(F.desc("p_size")))).where("r = 1")
    return top.groupBy("p_brand").agg(F.min("p_partkey").alias("p_partkey"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


@query("""SELECT o_orderkey, r, CASE WHEN m = c THEN c END AS total FROM (SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS INTEGER) AS r, max(CAST(left(o_orderpriority, 1) AS INTEGER)) OVER w AS m, (SELECT count(DISTINCT left(x.o_orderpriority, 1)) FROM orders x WHERE x.o_custkey = o.o_custkey AND year(x.o_orderdate) = year(o.o_orderdate)) AS c FROM orders o WINDOW w AS (PARTITION BY o_custkey, year(o_orderdate)))""")
def w8_round_positions(t: Tables) -> DataFrame:
    """The round within a season, and of how many, where the numbers make a whole run from one."""
    w = W.partitionBy("o_custkey", F.year("o_orderdate"))
    r = F.substring("o_orderpriority", 1, 1).cast("int")
    rows = t.orders.withColumn("r", r).withColumn("m", F.max("r").over(w)).withColumn("c", F.size(F.collect_set("r").over(w)))
    return rows.select("o_orderkey", "r", F.when(F.col("m") == F.col("c"), F.col("c")).alias("total"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS hour, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS day FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)")
def w9_trailing_windows(t: Tables) -> DataFrame:
    return I.rolling_counts(t.events, "user_id", "ts", {"hour": 3600, "day": 86400}, "event_id").select("event_id", "hour", "day")


@query("SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS new FROM conversations")
def w10_row_before(t: Tables) -> DataFrame:
    before = F.lag("role").over(W.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", before.alias("before"), (~F.col("role").eqNullSafe(before)).alias("new"))
