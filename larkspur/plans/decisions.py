"""Names, values and claims that compete, on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scratch import written
from larkspur.functions.text import slug
from larkspur.operators import decisions as O
from larkspur.operators import scoring as P
from larkspur.plans.identity import CHOSEN, TASKS, chosen, tasks
from larkspur.plans.matching import RECORDS, RULES, records
from larkspur.plans.registry import Tables, query
from larkspur.plans.texts import sql_fold


def sql_share(c: str, digits: int = 3) -> str:
    h = f"md5(CAST({c} AS VARCHAR))"
    total = "0"
    for i in range(digits):
        total = f"({total}) * 16 + instr('{O.HEX}', substr({h}, {i + 1}, 1)) - 1"
    return f"(({total}) / {float(16**digits)})"


@query(f"SELECT o_orderkey FROM orders WHERE {sql_share('o_orderkey')} < 0.1")
def o15_sampled_keys(t: Tables) -> DataFrame:
    """The tenth of all keys that stays open: it follows from the key alone, so every run and every engine keeps the same ones."""
    return t.orders.where(O.share(F.col("o_orderkey")) < 0.1).select("o_orderkey")


@query(f"SELECT o_orderkey, rank FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {sql_share(chr(39) + '7:' + chr(39) + ' || o_orderkey', 7)}, o_orderkey) AS rank FROM orders) WHERE rank <= 25")
def o16_drawn_rows(t: Tables) -> DataFrame:
    """25 rows drawn for a seed, in the order drawn; another seed draws others."""
    drawn = t.orders.select("o_orderkey", O.share(F.concat(F.lit("7:"), F.col("o_orderkey").cast("string")), 7).alias("s")).orderBy("s", "o_orderkey").limit(25)
    return drawn.groupBy().agg(F.array_sort(F.collect_list(F.struct("s", "o_orderkey"))).alias("l")).select(F.posexplode("l").alias("i", "x")).select("x.o_orderkey", (F.col("i") + 1).alias("rank"))


@query(f"SELECT page_id, CAST(floor({sql_share('h')} * 8) AS BIGINT) AS shard FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS h FROM pages)")
def t20_shard_of_host(t: Tables) -> DataFrame:
    """Which of eight workers reads a page: all pages of a host by one, whoever asks."""
    return t.pages.select("page_id", F.floor(O.share(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)) * 8).alias("shard"))


@query(f"""SELECT event_id, CASE WHEN status IN (408, 425, 429) OR status BETWEEN 500 AND 599 THEN CAST(floor(least(500 * pow(2, n), 12000) * (0.5 + {sql_share("user_id || ':' || n")} / 2)) AS BIGINT) END AS wait
FROM (SELECT event_id, user_id, [200, 404, 408, 425, 429, 500, 503][CAST(floor(value) AS BIGINT) % 7 + 1] AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) % 9 AS n FROM events)""")
def s22_retry_waits(t: Tables) -> DataFrame:
    """Waits before another try, longer each time and spread by a fixed jitter; statuses that another try can't mend have none."""
    from pyspark.sql import Window as W

    status = F.element_at(F.array(*map(F.lit, (200, 404, 408, 425, 429, 500, 503))), (F.floor("value") % 7 + 1).cast("int"))
    rows = t.events.withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) % 9)
    return rows.select("event_id", O.retry_wait(status, F.col("n"), F.col("user_id").cast("string")).alias("wait"))


def _sql_slug(c: str) -> str:
    return f"replace({sql_fold(c)}, ' ', '-')"


@query(f"""WITH RECURSIVE c AS MATERIALIZED (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS n, {_sql_slug('p_name')} AS a, {_sql_slug("p_name || ' ' || p_size")} AS b, {_sql_slug("p_name || ' ' || p_size || ' ' || p_type")} AS c, {_sql_slug("p_name || ' ' || p_size || ' ' || p_type")} || '-' || p_partkey AS d FROM part),
run AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS taken, CAST(-1 AS BIGINT) AS k, '' AS name UNION ALL SELECT n, list_append(taken, name), k, name FROM (SELECT c.n, r.taken, c.k, CASE WHEN NOT list_contains(r.taken, a) THEN a WHEN NOT list_contains(r.taken, b) THEN b WHEN NOT list_contains(r.taken, c) THEN c ELSE d END AS name FROM run r JOIN c ON c.n = r.n + 1))
SELECT k AS p_partkey, name FROM run WHERE n > 0""")
def c10_assigned_slugs(t: Tables) -> DataFrame:
    """Slugs for parts, dearest first: the name, else with its size, else with its type too, else with its key."""
    words = lambda *c: slug(F.concat_ws(" ", *c), 60)
    return O.assigned_names(t.part.withColumn("rank", -F.col("p_retailprice")), "p_partkey", ["rank"], [words("p_name"), words("p_name", "p_size"), words("p_name", "p_size", "p_type")])


@query(f"""WITH r AS (SELECT id, "start", url, array_to_string(list_filter(string_split({sql_fold('name')}, ' '), lambda w: w NOT IN ('', 'round', 'steel')), ' ') AS core FROM ({RECORDS}))
SELECT a.id AS a, b.id AS b, abs(a.start - b.start) AS days FROM r a JOIN r b ON a.url = b.url AND a.id < b.id WHERE abs(a.start - b.start) <= 2 AND (a.start = b.start OR a.core = b.core)""")
def e6_same_page_pairs(t: Tables) -> DataFrame:
    """Listings of one page at most two days apart; on different days only with the same title."""
    rows = P.described(records(t), RULES)
    return P.same_page(rows).select("a", "b", "days")


@query("""WITH a AS (SELECT o_custkey AS who, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS name, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS state FROM orders), b AS (SELECT o_custkey AS who, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_linenumber > 2 THEN l_returnflag END AS name, l_linestatus AS state FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
x AS (SELECT *, count(*) OVER (PARTITION BY who, day) AS n FROM a), y AS (SELECT *, count(*) OVER (PARTITION BY who, day) AS n FROM b), m AS (SELECT x.who, x.day, coalesce(x.name, y.name) AS name, coalesce(x.state, y.state) AS state FROM x JOIN y ON x.who = y.who AND x.day = y.day WHERE x.n = 1 AND y.n = 1)
SELECT *, 'both' AS seen FROM m UNION ALL SELECT who, day, name, state, 'first' FROM x ANTI JOIN m USING (who, day) UNION ALL SELECT who, day, name, state, 'second' FROM y ANTI JOIN m USING (who, day)""")
def e11_two_readers(t: Tables) -> DataFrame:
    """What two readers saw of a customer's days, orders and shipments: one of each on a day is one record, its gaps filled; all else stays apart."""
    a = t.orders.select(F.col("o_custkey").alias("who"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("state"))
    b = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("who"), F.to_date("l_shipdate").alias("day"), F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")).alias("name"), F.col("l_linestatus").alias("state"))
    return O.combined(a, b, ["who", "day"], ["name", "state"])


@query("""SELECT l_partkey, field, arg_min(v, (l_returnflag <> 'A', l_linenumber < 4, -(CAST(l_shipdate AS DATE) - DATE '1970-01-01'), i)) AS v, arg_min(l_returnflag = 'A', (l_returnflag <> 'A', l_linenumber < 4, -(CAST(l_shipdate AS DATE) - DATE '1970-01-01'), i)) AS from_official
FROM (SELECT *, l_linestatus AS field, CASE WHEN l_quantity < 45 THEN l_suppkey END AS v, l_orderkey * 8 + l_linenumber AS i FROM lineitem) WHERE v IS NOT NULL GROUP BY 1, 2""")
def e12_preferred_facts(t: Tables) -> DataFrame:
    """What is stated of a part, field by field: an official source before others, the specific before the general, the newest."""
    rows = t.lineitem.select("l_partkey", F.col("l_linestatus").alias("field"), F.when(F.col("l_quantity") < 45, F.col("l_suppkey")).alias("v"), (F.col("l_returnflag") == "A").alias("official"), (F.col("l_linenumber") >= 4).alias("specific"), F.to_date("l_shipdate").alias("day"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("i"), "l_suppkey")
    return O.preferred(rows, ["l_partkey", "field"], "v", "official", "specific", "day", "i")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(l_shipdate AS DATE) AS day, CAST(o_orderdate AS DATE) AS now, o_orderstatus, l_returnflag, l_discount, CASE WHEN o_orderstatus = 'F' THEN 'locked' WHEN CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) THEN 'in_the_past' WHEN CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) > 90 THEN 'too_far' END AS no,
CASE WHEN l_returnflag = 'N' AND l_discount < 0.02 THEN 'weak_evidence' WHEN l_quantity > 48 THEN 'needs_review' END AS wait FROM lineitem JOIN orders ON l_orderkey = o_orderkey), o AS (SELECT l_orderkey, max((l_linenumber, l_partkey, l_suppkey, day)) AS last FROM p WHERE no IS NULL AND wait IS NULL GROUP BY 1)
SELECT p.l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN no IS NOT NULL THEN 'reject' WHEN wait IS NOT NULL THEN 'hold' WHEN (l_linenumber, l_partkey, l_suppkey, day) = last THEN 'apply' ELSE 'supersede' END AS decision, coalesce(no, wait, CASE WHEN (l_linenumber, l_partkey, l_suppkey, day) = last THEN 'newest' ELSE 'newer_proposal' END) AS reason FROM p LEFT JOIN o USING (l_orderkey)""")
def e14_gated_proposals(t: Tables) -> DataFrame:
    """Days proposed for orders: refused, held back, overtaken by a later proposal, or to be applied, with the reason."""
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("day"), F.to_date("o_orderdate").alias("now"), "o_orderstatus", "l_returnflag", "l_discount", "l_quantity")
    gap = F.datediff("day", "now")
    reject = {"locked": F.col("o_orderstatus") == "F", "in_the_past": gap < 0, "too_far": gap > 90}
    hold = {"weak_evidence": (F.col("l_returnflag") == "N") & (F.col("l_discount") < 0.02), "needs_review": F.col("l_quantity") > 48}
    return O.gated(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "day"], reject, hold).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "decision", "reason")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS day, CASE WHEN o_orderkey IS NULL THEN 'unknown' WHEN o_custkey % 4 + 1 <> l_linenumber THEN 'token' WHEN o_orderstatus <> l_linestatus THEN 'payload' WHEN CAST(l_shipdate AS DATE) > CAST(o_orderdate AS DATE) + 60 THEN 'lease' END AS wrong
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 20000) ON l_orderkey = o_orderkey), o AS (SELECT l_orderkey, min((day, l_partkey, l_suppkey)) AS first FROM f WHERE wrong IS NULL GROUP BY 1)
SELECT f.l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(wrong, CASE WHEN (day, l_partkey, l_suppkey) = first THEN 'finished' ELSE 'done' END) AS outcome FROM f LEFT JOIN o USING (l_orderkey)""")
def t5_fenced_claims(t: Tables) -> DataFrame:
    """Finishes of claimed orders: only the first that still has the claim's token and payload within the lease counts."""
    claims = t.orders.where("o_totalprice > 20000").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 4 + 1).alias("token"), F.col("o_orderstatus").alias("payload"), F.date_add(F.to_date("o_orderdate"), 60).alias("lease_until"))
    done = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_linenumber").alias("claim_token"), F.col("l_linestatus").alias("claim_payload"), F.to_date("l_shipdate").alias("at"))
    return O.fenced(claims, done, "l_orderkey", ["at", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "outcome")


@query(f"SELECT key, 'running' AS status, priority, l_linenumber AS step, l_returnflag AS said FROM {TASKS} JOIN lineitem ON l_orderkey = key WHERE key IN {CHOSEN} AND CAST(l_shipdate AS DATE) <= DATE '1997-06-01'")
def j22_claims_with_log(t: Tables) -> DataFrame:
    """Claimed tasks with the lines that the log has of them, by their key; a claim without a line is left out, one with several comes with each."""
    log = t.lineitem.where(F.to_date("l_shipdate") <= F.lit("1997-06-01").cast("date")).select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("step"), F.col("l_returnflag").alias("said"))
    claimed = tasks(t).join(chosen(t), "key").select("key", F.lit("running").alias("status"), "priority")
    return claimed.join(log, "key").select("key", "status", "priority", "step", "said")


@query("SELECT o_custkey, o_orderkey AS key, o_orderstatus AS state, CAST(o_totalprice AS DOUBLE) AS price FROM orders")
def c45_records_of_json(t: Tables) -> DataFrame:
    """A customer's orders as one JSON text, and the text's elements as rows again."""
    item = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").cast("double").alias("price"))
    texts = written(t.orders.groupBy("o_custkey").agg(F.to_json(F.collect_list(item)).alias("j")), "json")
    return texts.select("o_custkey", F.inline(F.from_json("j", "array<struct<key: bigint, state: string, price: double>>")))


@query("""WITH e AS (SELECT user_id % 10 AS home, CAST(json_extract(props, '$.k') AS BIGINT) AS item, user_id, max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'view' THEN 1 END) AS s, bool_or(event_type IN ('purchase', 'signup')) AS attends FROM events WHERE event_type IN ('purchase', 'signup', 'view') GROUP BY 1, 2, 3)
SELECT home, item, string_agg(user_id || '=' || CASE s WHEN 3 THEN 'going' WHEN 2 THEN 'maybe' ELSE 'favourite' END, ',' ORDER BY CAST(user_id AS VARCHAR)) AS members, count(*) FILTER (WHERE attends) AS attending FROM e GROUP BY 1, 2""")
def a23_household_plans(t: Tables) -> DataFrame:
    """A household's plan for each item: who marked it or attends it, one status for each member; attending outweighs a mark."""
    status = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "view", 1)
    rows = t.events.select((F.col("user_id") % 10).alias("home"), F.get_json_object("props", "$.k").cast("long").alias("item"), "user_id", status.alias("s")).where("s is not null")
    per = rows.groupBy("home", "item", "user_id").agg(F.max("s").alias("s"))
    held = F.map_from_entries(F.collect_list(F.struct(F.col("user_id").cast("string"), F.element_at(F.array(*map(F.lit, ("favourite", "maybe", "going"))), F.col("s")))))
    plans = per.groupBy("home", "item").agg(held.alias("m"), F.count_if(F.col("s") > 1).alias("attending"))
    members = F.array_join(F.transform(F.array_sort(F.map_keys("m")), lambda u: F.concat(u, F.lit("="), F.element_at("m", u))), ",")
    return plans.select("home", "item", members.alias("members"), "attending")
