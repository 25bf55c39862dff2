"""Incremental state: due work, retries, changes, absences, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.operators import ingest as I
from larkspur.operators import rollups as R
from larkspur.plans.registry import Tables, query

MID = "TIMESTAMP '2024-01-16'"


def cut():
    return F.lit("2024-01-16").cast("timestamp_ntz")


def halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of (user, hour) with the last value of each: before and after the middle of the month."""
    rows = t.events.withColumn("hour", F.hour("ts"))
    both = []
    for part in (rows.where(F.col("ts") < cut()), rows.where(F.col("ts") >= cut())):
        both.append(part.groupBy("user_id", "hour").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"), F.count(F.lit(1)).alias("n")))
    return both[0], both[1]


HALF = "SELECT user_id, hour(ts) AS hour, arg_max(event_type, (ts, event_id)) AS kind, count(*) AS n FROM events WHERE ts {} {} GROUP BY 1, 2"
A, B = HALF.format("<", MID), HALF.format(">=", MID)


@query("SELECT user_id FROM (SELECT user_id, max(ts) AS last, max(value) AS v FROM events GROUP BY 1) WHERE last + CASE WHEN v > 99 THEN INTERVAL 1 DAY ELSE INTERVAL 3 DAY END <= TIMESTAMP '2024-02-01'")
def t1_due_work(t: Tables) -> DataFrame:
    per = t.events.groupBy("user_id").agg(F.max("ts").alias("last"), F.max("value").alias("v"))
    return per.where(F.expr("last + case when v > 99 then interval 1 day else interval 3 day end <= timestamp_ntz'2024-02-01'")).select("user_id")


@query(f"WITH a AS ({A}), b AS ({B}) SELECT b.user_id, b.hour FROM b LEFT JOIN a USING (user_id, hour) WHERE a.kind IS NULL OR a.kind <> b.kind")
def t2_content_change(t: Tables) -> DataFrame:
    a, b = halves(t)
    key = F.concat_ws("/", "user_id", "hour").alias("key")
    a, b = (x.select(key, "user_id", "hour", I.content_hash("kind").alias("digest")) for x in (a, b))
    return I.changed(b, a, "key", "digest").select("user_id", "hour")


@query("SELECT user_id, n, CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN 1800 WHEN n = 2 THEN 7200 WHEN n = 3 THEN 86400 WHEN n = 4 THEN 604800 END AS wait FROM (SELECT u.user_id, count(e.event_id) AS n FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type IN ('purchase', 'signup') AND (x.ts, x.event_id) > (e.ts, e.event_id)) GROUP BY 1)")
def t3_checkpoint_retry(t: Tables) -> DataFrame:
    runs = t.events.where("event_type in ('error', 'purchase', 'signup')").withColumn("ok", F.col("event_type") != "error")
    got = I.failures_at_end(runs, "user_id", ["ts", "event_id"], "ok")
    got = t.events.select("user_id").distinct().join(got, "user_id", "left").na.fill(0, ["failures"])
    return got.select("user_id", F.col("failures").alias("n"), I.ladder(F.col("failures"), [1800, 7200, 86400, 604800]).alias("wait"))


@query(f"SELECT o_orderkey AS key FROM orders WHERE (o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1998-06-01') OR (o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01') ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 60")
def t4_claimable_tasks(t: Tables) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    lease = F.expr("o_orderdate + interval 882 day")  # a running task's lease
    tasks = t.orders.select(F.col("o_orderkey").alias("key"), state.alias("status"), F.col("o_orderdate").alias("available_at"), lease.alias("lease_until"), F.col("o_totalprice").alias("priority"))
    return I.claimable(tasks, 60, "1998-06-01").select("key")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 THEN 'finished' ELSE 'superseded' END AS outcome FROM part WHERE p_size % 3 = 0 OR p_partkey % 2 = 0")
def t5_fenced_finish(t: Tables) -> DataFrame:
    """An outcome counts only where token and payload are still those of the claim."""
    tasks = t.part.where("p_size % 3 = 0").select("p_partkey", F.lit(1).alias("token"))
    done = t.part.where("p_partkey % 2 = 0").select("p_partkey", F.lit(1).alias("claimed"))
    return tasks.join(done, "p_partkey", "full").select("p_partkey", F.when(F.col("token") == F.col("claimed"), "finished").otherwise("superseded").alias("outcome"))


@query("SELECT event_id, least(greatest(CAST(floor(value * 37) AS BIGINT), 60), 3000) AS wait FROM events WHERE event_type = 'error'")
def t6_retry_clamp(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'error'").select("event_id", I.clamped(F.floor(F.col("value") * 37), 60, 3000).alias("wait"))


@query("SELECT user_id, max(value) AS priority, min(ts) AS at, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS items FROM events GROUP BY 1")
def t7_outbox_coalescing(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.col("value").alias("priority"), F.col("ts").alias("at"), "event_type")
    return I.coalesced_outbox(rows, "user_id", "priority", "at", "event_type")


@query("SELECT event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before")
def t8_revision_stamp(t: Tables) -> DataFrame:
    """A revision is stamped where the content, without its heartbeat columns, differs from the row before."""
    digest = I.content_hash("event_type")
    before = F.lag("h").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.withColumn("h", digest).withColumn("b", before).where(~F.col("h").eqNullSafe(F.col("b"))).select("event_id")


@query("SELECT n_nationkey, lower(n_name || ' ' || string_agg(c_mktsegment, ' ' ORDER BY c_mktsegment)) AS search_text FROM nation JOIN (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) ON n_nationkey = c_nationkey GROUP BY n_nationkey, n_name")
def t9_search_text(t: Tables) -> DataFrame:
    parts = t.customer.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), " ").alias("s"))
    return t.nation.join(parts, F.col("n_nationkey") == F.col("c_nationkey")).select("n_nationkey", F.lower(F.concat_ws(" ", "n_name", "s")).alias("search_text"))


@query(f"""WITH a AS ({A}), b AS ({B}), h AS (SELECT a.user_id, a.hour, b.hour IS NOT NULL AS still FROM a LEFT JOIN b USING (user_id, hour)), s AS (SELECT user_id, count(*) AS al, count(*) FILTER (WHERE still) AS kept FROM h GROUP BY 1), l AS (SELECT user_id, count(*) AS listed FROM b GROUP BY 1)
SELECT h.user_id, h.hour FROM h JOIN s USING (user_id) JOIN l USING (user_id) WHERE NOT still AND listed >= 3 AND kept >= greatest(2, ceil(al * 0.5)) AND al - kept <= greatest(6, floor(al * 0.35))""")
def t10_absence_detection(t: Tables) -> DataFrame:
    a, b = halves(t)
    return I.missing_rows(a, b, "user_id", "hour").select("user_id", "hour")


@query("SELECT user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3 GROUP BY 1 HAVING count(*) = 3 AND bool_and(event_type IN ('view', 'error'))")
def t11_auto_pause(t: Tables) -> DataFrame:
    last = R.last_n(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 3)
    per = last.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("event_type").isin("view", "error")).alias("empty"))
    return per.where("n = 3 and empty").select("user_id")


@query("SELECT event_type, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 2")
def t12_rate_buckets(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", F.date_trunc("minute", F.col("ts")).cast("timestamp_ntz").alias("minute")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, CAST(ts AS DATE) AS day, CAST(round(value * 100) AS BIGINT) AS v, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase'),
run AS (SELECT day, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS spent, true AS ok FROM (SELECT DISTINCT day FROM e) UNION ALL SELECT e.day, e.n, e.event_id, CASE WHEN spent + v <= 100000 THEN spent + v ELSE spent END, spent + v <= 100000 FROM run r JOIN e ON e.day = r.day AND e.n = r.n + 1)
SELECT event_id, spent AS running, ok FROM run WHERE n > 0""")
def t13_budget_ledger(t: Tables) -> DataFrame:
    """Purchases admitted against a day's budget, in cents: one that doesn't fit uses nothing up, so a smaller later one may still go through."""
    rows = t.events.where("event_type = 'purchase'").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.to_date("ts").alias("day"), F.round(F.col("value") * 100).cast("long").alias("value"))
    return I.admitted_budget(rows, "at", "event_id", "day", "value", 100_000).select("event_id", "running", "ok")


@query("SELECT event_id FROM (SELECT *, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR ts - b >= INTERVAL 15 MINUTE")
def t14_overlap_guard(t: Tables) -> DataFrame:
    """A job begins only where the one before of its name began 15 minutes ago or more."""
    b = F.lag("ts").over(W.partitionBy("event_type").orderBy("ts", "event_id"))
    return t.events.withColumn("b", b).where("b is null or ts - b >= interval 15 minute").select("event_id")


@query("SELECT event_id, ts + INTERVAL 30 MINUTE AS closed_at FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n IS NULL OR n - ts > INTERVAL 30 MINUTE")
def t15_abandoned_runs(t: Tables) -> DataFrame:
    n = F.lead("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.withColumn("n", n).where("n is null or n - ts > interval 30 minute").select("event_id", F.expr("ts + interval 30 minute").alias("closed_at"))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_type, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS r FROM events),
d AS (SELECT user_id, event_type, event_id, s, r, s AS last, true AS sent FROM o WHERE r = 1 UNION ALL SELECT o.user_id, o.event_type, o.event_id, o.s, o.r, CASE WHEN o.s - d.last > 1209600 THEN o.s ELSE d.last END, o.s - d.last > 1209600 FROM d JOIN o ON o.user_id = d.user_id AND o.event_type = d.event_type AND o.r = d.r + 1)
SELECT user_id, event_type, event_id FROM d WHERE sent""")
def t16_exactly_once_delivery(t: Tables) -> DataFrame:
    return I.first_per_window(t.events, ["user_id", "event_type"], "ts", "event_id", 14)


@query("SELECT event_id, array_to_string(list_filter([CASE WHEN abs(value - pv) >= 60 THEN 'value' END, CASE WHEN event_type = 'error' AND pt <> 'error' THEN 'failed' END, CASE WHEN CAST(ts AS DATE) - CAST(pts AS DATE) >= 3 THEN 'moved' END], lambda x: x IS NOT NULL), ',') AS notices FROM (SELECT *, lag(value) OVER w AS pv, lag(event_type) OVER w AS pt, lag(ts) OVER w AS pts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE pv IS NOT NULL")
def t17_change_notices(t: Tables) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.withColumn("p", F.lag(F.struct("value", "event_type", "ts")).over(w)).where("p is not null")
    found = F.array(
        F.when(F.abs(F.col("value") - F.col("p.value")) >= 60, "value"), F.when((F.col("event_type") == "error") & (F.col("p.event_type") != "error"), "failed"), F.when(F.datediff(F.to_date("ts"), F.to_date("p.ts")) >= 3, "moved"),
    )
    return rows.select("event_id", F.array_join(F.array_compact(found), ",").alias("notices"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size - 1 ELSE p_size END AS p_size FROM part")
def t18_fact_rollback(t: Tables) -> DataFrame:
    """A written value goes back to the one before only where it still stands."""
    log = t.part.where("p_size % 2 = 0").select("p_partkey", F.col("p_size").alias("written"), (F.col("p_size") - 1).alias("previous"))
    rows = t.part.select("p_partkey", "p_size").join(log, "p_partkey", "left")
    return rows.select("p_partkey", F.when(F.col("p_size") == F.col("written"), F.col("previous")).otherwise(F.col("p_size")).alias("p_size"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) + 30 < DATE '1998-01-01' THEN 'completed' ELSE o_orderstatus END AS status FROM orders")
def t19_past_completion(t: Tables) -> DataFrame:
    past = (F.col("o_orderstatus") == "O") & (F.date_add(F.to_date("o_orderdate"), 30) < "1998-01-01")
    return t.orders.select("o_orderkey", F.when(past, "completed").otherwise(F.col("o_orderstatus")).alias("status"))


@query("SELECT count(*) AS hosts, true AS each_in_one FROM (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]+)', 1) FROM pages)")
def t20_host_shards(t: Tables) -> DataFrame:
    """Every host's pages meet in one shard."""
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    rows = t.pages.select(host.alias("host"), F.pmod(F.xxhash64(host), F.lit(8)).alias("shard")).groupBy("host").agg(F.count_distinct("shard").alias("n"))
    return rows.agg(F.count(F.lit(1)).alias("hosts"), F.bool_and(F.col("n") == 1).alias("each_in_one"))


@query(f"WITH a AS ({A}), b AS ({B}) SELECT user_id, hour, change, CASE WHEN change = 'updated' THEN array_to_string(list_filter([CASE WHEN ak <> bk THEN 'kind' END, CASE WHEN an <> bn THEN 'n' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS columns FROM (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.hour, b.hour) AS hour, a.kind AS ak, b.kind AS bk, a.n AS an, b.n AS bn, CASE WHEN a.user_id IS NULL THEN 'inserted' WHEN b.user_id IS NULL THEN 'deleted' WHEN a.kind <> b.kind OR a.n <> b.n THEN 'updated' END AS change FROM a FULL JOIN b ON a.user_id = b.user_id AND a.hour = b.hour) WHERE change IS NOT NULL")
def s18_snapshot_diff(t: Tables) -> DataFrame:
    a, b = (x.withColumn("key", F.struct("user_id", "hour")) for x in halves(t))
    return I.snapshot_diff(a, b, "key", ["kind", "n"]).select("key.user_id", "key.hour", "change", "columns")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size + 100 ELSE p_size END AS p_size FROM part UNION ALL SELECT p_partkey + 1000000, p_size FROM part WHERE p_partkey % 10 = 0")
def s13_idempotent_upsert(t: Tables) -> DataFrame:
    table = t.part.select("p_partkey", "p_size")
    rows = table.where("p_partkey % 2 = 0").withColumn("p_size", F.col("p_size") + 100).unionByName(table.where("p_partkey % 10 = 0").withColumn("p_partkey", F.col("p_partkey") + 1000000))
    once = I.upsert(table, rows, "p_partkey")
    return I.upsert(once, rows, "p_partkey")  # a second run changes nothing
