"""Which rows are the same thing: dated ids, source keys, places, chains of claims, dates after a phrase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.dates import date_after
from larkspur.functions.text import fold
from larkspur.operators import entities as E
from larkspur.plans.entities import SCORED, linked_classes, one_of_each, parts, two_scores
from larkspur.plans.joins import POINT, points
from larkspur.plans.registry import Tables, query
from larkspur.plans.texts import sql_fold


@query("SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey IS NULL THEN 'new' WHEN CAST(l_shipdate AS DATE) BETWEEN d AND d + 30 THEN 'known' ELSE 'date_differs' END AS decision, CASE WHEN o_orderkey IS NOT NULL AND NOT CAST(l_shipdate AS DATE) BETWEEN d AND d + 30 THEN 'catalogue_has_' || d END AS reason FROM lineitem LEFT JOIN (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderkey % 7 <> 0) ON l_orderkey = o_orderkey")
def j9_source_key_lookup(t: Tables) -> DataFrame:
    """Rows read against the catalogue by their source's key."""
    stored = t.orders.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("d"))
    inside = F.to_date("l_shipdate").between(F.col("d"), F.date_add("d", 30))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate").join(stored, "l_orderkey", "left")
    decision = F.when(F.col("d").isNull(), "new").when(inside, "known").otherwise("date_differs")
    return rows.select("l_orderkey", "l_linenumber", decision.alias("decision"), F.when(~inside, F.concat(F.lit("catalogue_has_"), F.col("d").cast("string"))).alias("reason"))


def dated(c: str) -> Column:
    """An id that ends in a day: its number, its calendar (what stands before the first hyphen) and the day; nulls for other ids."""
    part = lambda i: F.nullif(F.regexp_extract(c, r"^(.+)-(\d{4}-\d{2}-\d{2})$", i), F.lit(""))
    return F.struct(part(1).alias("number"), F.split_part(F.col(c), F.lit("-"), F.lit(1)).alias("calendar"), F.try_to_date(part(2), "yyyy-MM-dd").alias("day"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, split_part(o_orderpriority, '-', 1) AS calendar, o_orderstatus AS k, CAST(o_orderdate AS DATE) AS day FROM orders), f AS (SELECT o_custkey, min(day) AS stored FROM s GROUP BY 1),
o AS (SELECT s.o_custkey, calendar, k FROM s JOIN f ON s.o_custkey = f.o_custkey AND day = stored)
SELECT s.o_orderkey, s.day <> stored AND bool_or(s.calendar <> o.calendar OR s.k <> o.k) AS different, s.day <> stored AND bool_or(s.calendar = o.calendar AND s.k <> o.k) AS same_calendar FROM s JOIN f USING (o_custkey) JOIN o USING (o_custkey) GROUP BY s.o_orderkey, s.day, stored""")
def j25_same_calendar_other_row(t: Tables) -> DataFrame:
    """A row with a dated id against the record it is joined to: where the record holds another number for the day that is stored, it is another thing;
    where that number is of the same calendar, for certain."""
    external = F.concat_ws("-", F.split_part("o_orderpriority", F.lit("-"), F.lit(1)), "o_orderstatus", F.to_date("o_orderdate").cast("string"))
    rows = t.orders.select("o_custkey", "o_orderkey", external.alias("external")).select("o_custkey", "o_orderkey", dated("external").alias("own"))
    # of a record's sources only the numbers on its stored day count: the least day and its numbers in one pass, no list of all sources
    days = rows.groupBy("o_custkey", "own.day").agg(F.collect_set("own").alias("held"))
    stored = days.groupBy("o_custkey").agg(F.min_by("held", "day").alias("held"), F.min("day").alias("stored"))
    other = lambda x: x["number"] != F.col("own.number")
    moved = F.col("own.day") != F.col("stored")
    rows = rows.join(stored, "o_custkey")
    return rows.select("o_orderkey", (moved & F.exists("held", other)).alias("different"), (moved & F.exists("held", lambda x: other(x) & (x["calendar"] == F.col("own.calendar")))).alias("same_calendar"))


TASKS = "(SELECT o_orderkey AS key, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'running' ELSE 'done' END AS status, CAST(split_part(o_orderpriority, '-', 1) AS INT) AS priority, CAST(o_orderdate AS DATE) AS available FROM orders)"
CHOSEN = f"(SELECT key FROM {TASKS} WHERE (status = 'pending' AND available <= DATE '1997-01-01') OR (status = 'running' AND available + 30 <= DATE '1997-01-01') ORDER BY priority DESC, available, key LIMIT 40)"


def tasks(t: Tables) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "running").otherwise("done")
    return t.orders.select(F.col("o_orderkey").alias("key"), state.alias("status"), F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).cast("int").alias("priority"), F.to_date("o_orderdate").alias("available"))


def chosen(t: Tables, limit: int = 40) -> DataFrame:
    """Tasks that one claim takes: at most 100 by its clamp, so their keys may be broadcast."""
    now = F.lit("1997-01-01").cast("date")
    due = ((F.col("status") == "pending") & (F.col("available") <= now)) | ((F.col("status") == "running") & (F.date_add("available", 30) <= now))
    return F.broadcast(tasks(t).where(due).orderBy(F.desc("priority"), "available", "key").limit(max(0, min(limit, 100))).select("key"))


@query(f"SELECT key AS token, key, CASE WHEN key IN {CHOSEN} THEN 'lease_expired' ELSE 'open' END AS outcome FROM {TASKS} WHERE status = 'running' UNION ALL SELECT -key - 1, key, 'open' FROM {CHOSEN}")
def x2_claim_chain(t: Tables) -> DataFrame:
    """The attempts after a claim: open ones of the claimed tasks are closed as expired, and each claim is a new one. Three tables, each made from the one before."""
    taken = chosen(t)
    attempts = tasks(t).where("status = 'running'").select(F.col("key").alias("token"), "key")
    closed = attempts.join(taken.withColumn("hit", F.lit(True)), "key", "left").select("token", "key", F.when(F.col("hit"), "lease_expired").otherwise("open").alias("outcome"))
    return closed.unionByName(taken.select((-F.col("key") - 1).alias("token"), "key", F.lit("open").alias("outcome")))


@query(f"SELECT key, 'running' AS status, priority FROM {TASKS} WHERE key IN {CHOSEN}")
def j22_claimed_and_logged(t: Tables) -> DataFrame:
    """What was claimed, with what was logged for it, by their token."""
    claimed = tasks(t).join(chosen(t), "key").select("key", F.lit("running").alias("status"), "priority", (-F.col("key") - 1).alias("token"))
    logged = chosen(t).select((-F.col("key") - 1).alias("token"))
    return claimed.join(logged, "token").select("key", "status", "priority")


PLACES = f"(SELECT p.s_suppkey AS id, CAST(floor(lat / 4) AS BIGINT) AS y, CAST(floor(lng / 4) AS BIGINT) AS x, s_nationkey % 4 AS land, s_acctbal, CASE WHEN p.s_suppkey % 10 = 0 THEN n_name WHEN p.s_suppkey % 4 = 1 THEN 'SÍDLO ' || (p.s_suppkey % 2) ELSE 'Sídlo ' || (p.s_suppkey % 2) END AS place FROM (SELECT s_suppkey, {POINT} FROM supplier) p JOIN supplier s ON p.s_suppkey = s.s_suppkey JOIN nation ON s_nationkey = n_nationkey)"
# The weights by which the best written of equal places is told.
SCORE = f"CASE WHEN s_acctbal > 0 THEN 8 ELSE 0 END + CASE WHEN regexp_matches(place, '[a-z]') THEN 4 ELSE 0 END + CASE WHEN place <> {sql_fold('place')} THEN 2 ELSE 0 END + CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END"


@query(f"""WITH p AS (SELECT *, {sql_fold('place')} AS name, {SCORE} AS score FROM {PLACES}), pinned AS (SELECT * FROM p WHERE name NOT IN (SELECT {sql_fold('n_name')} FROM nation)),
g AS (SELECT y, x, land, name, arg_min(id, (-score, id)) AS keeper, count(*) AS n FROM pinned GROUP BY ALL), c AS (SELECT l_suppkey, count(*) AS children FROM lineitem GROUP BY 1)
SELECT p.id, CASE WHEN g.keeper IS NULL THEN 'unpinned' WHEN n = 1 THEN 'alone' WHEN keeper = p.id THEN 'keeper' ELSE 'merged' END AS state, keeper, CASE WHEN n > 1 AND keeper <> p.id THEN coalesce(children, 0) ELSE 0 END AS moved
FROM p LEFT JOIN pinned q ON p.id = q.id LEFT JOIN g ON q.y = g.y AND q.x = g.x AND q.land = g.land AND q.name = g.name LEFT JOIN c ON p.id = l_suppkey""")
def e16_location_merge(t: Tables) -> DataFrame:
    """A country's name is no place and loses its pin; of rows of one point, country and folded name the best written stays, and the others'
    children move to it."""
    rows = points(t).join(t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal"), "s_suppkey").join(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    number = (F.col("s_suppkey") % 2).cast("string")
    place = F.when(F.col("s_suppkey") % 10 == 0, F.col("n_name")).when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("SÍDLO "), number)).otherwise(F.concat(F.lit("Sídlo "), number))
    rows = rows.select(F.col("s_suppkey").alias("id"), F.floor(F.col("lat") / 4).alias("y"), F.floor(F.col("lng") / 4).alias("x"), (F.col("s_nationkey") % 4).alias("land"), "s_acctbal", place.alias("place")).withColumn("name", fold("place"))
    points_for = lambda c, n: F.when(c, n).otherwise(0)
    score = points_for(F.col("s_acctbal") > 0, 8) + points_for(F.rlike("place", F.lit("[a-z]")), 4) + points_for(F.col("place") != F.col("name"), 2) + points_for(F.col("s_acctbal") > 5000, 1)
    countries = t.nation.select(fold("n_name").alias("name")).distinct().withColumn("country", F.lit(True))
    rows = rows.join(countries, "name", "left").withColumn("pinned", F.col("country").isNull())
    key = ["y", "x", "land", "name", "pinned"]
    groups = rows.where("pinned").groupBy(key).agg(F.min(F.struct((-score).alias("s"), "id")).getField("id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    children = t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    state = F.when(F.col("keeper").isNull(), "unpinned").when(F.col("n") == 1, "alone").when(F.col("keeper") == F.col("id"), "keeper").otherwise("merged")
    out = rows.join(groups, key, "left").join(children, "id", "left").select("id", state.alias("state"), "keeper", F.coalesce("children", F.lit(0)).alias("children"))
    return out.select("id", "state", "keeper", F.when(F.col("state") == "merged", F.col("children")).otherwise(0).alias("moved"))


@query(f"""WITH RECURSIVE l AS (SELECT a, b FROM ({SCORED}) WHERE score >= 60), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT DISTINCT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a), c AS (SELECT node, min(reach) AS component FROM r GROUP BY node)
SELECT node, CASE WHEN node = component OR e.a IS NOT NULL THEN component ELSE node END AS component FROM c LEFT JOIN e ON e.a = component AND e.b = node""")
def e5_rechecked_members(t: Tables) -> DataFrame:
    """Components whose members must match the keeper itself; those that only a chain ties to it are let go."""
    rows = parts(t)
    ones = one_of_each(rows)
    keeper = F.col("p_partkey") == F.col("component")  # the least part of a component is the first of its class, so a score with its class is one with it
    side = lambda of, s, more: of.select(*more, *(F.col(c).alias(f"{s}_{c}") for c in ("p_type", "head", "p_retailprice", "to", "place")))
    members = side(linked_classes(ones, rows).join(ones, "cls"), "x", ("cls", "component"))
    found = members.join(side(ones, "y", (F.col("cls").alias("component"),)), "component").select("cls", "component", (two_scores()[0] >= 60).alias("ok"))
    return rows.join(found, "cls").select(F.col("p_partkey").alias("node"), F.when(F.col("ok") | keeper, F.col("component")).otherwise(F.col("p_partkey")).alias("component"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 16 IN (5, 6, 15) THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + INTERVAL 28 YEAR AS DATE) END AS day FROM orders")
def c25_date_after_phrase(t: Tables) -> DataFrame:
    """Deadlines in texts of several languages and forms: only a date close behind a phrase counts, and only one of the calendar."""
    day = F.add_months(F.to_date("o_orderdate"), 336)
    form = lambda f: F.date_format("day", f)
    month = lambda names: F.element_at(F.array(*map(F.lit, names.split())), F.month("day"))
    czech = month("ledna února března dubna května června července srpna září října listopadu prosince")
    french = month("janvier février mars avril mai juin juillet août septembre octobre novembre décembre")
    ordinal = F.when(F.dayofmonth("day").isin(1, 21, 31), "st").when(F.dayofmonth("day").isin(2, 22), "nd").when(F.dayofmonth("day").isin(3, 23), "rd").otherwise("th")
    later = F.date_add("day", 1)
    texts = [
        F.concat(F.lit("Race 12. Entries close "), form("dd.MM.yyyy"), F.lit(" at noon")),
        F.concat(F.lit("Registration UNTIL  "), form("d MMMM yyyy"), F.lit(" for all who wish to take part in it; race 1.1.2031")),
        F.concat(F.lit("Anmeldung bis "), form("d/M/yy")),
        F.concat(F.lit("Uzávěrka přihlášek: "), form("d. "), czech, form(" yyyy")),
        F.concat(F.lit("entries close "), form("yyyy-MM-dd"), F.lit(".")),
        F.lit("Entries close 31.2.2026"),
        F.concat(F.lit("Race on "), form("d.M.yyyy")),
        F.concat(F.lit("Entries close soon, that is long before the race starts; entries close on "), form("d. M.")),
        F.concat(F.lit("entries close "), form("MMMM d"), F.lit(", "), form("yyyy"), F.lit(" (midnight)")),
        F.concat(F.lit("Open until the "), form("d"), ordinal, F.lit(" of "), form("MMMM"), F.lit(" and not a day more")),
        F.concat(F.lit("Anmeldung bis "), form("dd-MM-yyyy"), F.lit(", 18 Uhr")),
        F.concat(F.lit("Entries close between "), form("d MMMM"), F.lit(" - "), F.date_format(later, "d MMMM"), form(" yyyy")),
        F.concat(F.lit("Entries close "), form("d.M."), F.lit("–"), F.date_format(later, "d.M."), form("yyyy")),
        F.concat(F.lit("Inscriptions: until le "), form("d "), french, form(" yyyy")),
        F.concat(F.lit("entries close "), form("yyyy/M/d")),
        F.concat(F.lit("Entries closed "), form("d.M.yyyy"), F.lit("; bisher 12.")),
    ]
    k = F.coalesce(*(F.when(F.col("o_orderkey") % 16 == i, text) for i, text in enumerate(texts)))  # only a row's own text is made
    rows = t.orders.select("o_orderkey", day.alias("day")).select("o_orderkey", k.alias("s"), F.year("day").alias("y"))
    return rows.select("o_orderkey", date_after("s", ["entries close", "until", "bis", "uzaverka"], F.col("y")).alias("day"))
