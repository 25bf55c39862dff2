"""Search over an index, places in texts, logged merges and their return, differences of stored relations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scratch import ensure_checkpoints, written
from larkspur.functions.text import fold
from larkspur.operators import fingerprint as D
from larkspur.operators import classifier, gazetteer, merges, search
from larkspur.plans.registry import Tables, query
from larkspur.plans.texts import sql_fold

#: Two words of each benchmark item, every third one with a letter struck from the middle of its second word.
ASKED = f"""SELECT item_id, w[1] || ' ' || CASE WHEN item_id % 3 = 0 THEN left(w[2], length(w[2]) // 2) || substr(w[2], length(w[2]) // 2 + 2) ELSE w[2] END AS q FROM (SELECT item_id, list_filter(string_split({sql_fold('text')}, ' '), lambda x: length(x) >= 6) AS w FROM benchmark) WHERE len(w) >= 2"""


@query(f"""WITH q AS ({ASKED}), t AS MATERIALIZED (SELECT DISTINCT item_id, unnest(string_split(q, ' ')) AS t FROM q), size AS (SELECT item_id, count(*) AS n FROM t GROUP BY 1),
post AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(string_split({sql_fold('text')}, ' '))) AS w FROM documents), word AS MATERIALIZED (SELECT DISTINCT w FROM post WHERE w <> ''),
tok AS MATERIALIZED (SELECT DISTINCT t FROM t), exact AS MATERIALIZED (SELECT t, w, 0 AS d FROM tok JOIN word ON contains(w, t)),
found AS MATERIALIZED (SELECT item_id, doc_id FROM t JOIN exact USING (t) JOIN post USING (w) JOIN size USING (item_id) GROUP BY item_id, doc_id, n HAVING count(DISTINCT t) = n),
near AS MATERIALIZED (SELECT t, w, least(levenshtein(t, w), levenshtein(t, left(w, length(t)))) AS d FROM tok, word WHERE length(t) >= 4 AND abs(length(w) - length(t)) <= 40 AND least(levenshtein(t, w), levenshtein(t, left(w, length(t)))) <= CASE WHEN length(t) < 8 THEN 1 ELSE 2 END UNION ALL SELECT * FROM exact),
best AS (SELECT item_id, doc_id, t, n, min(d) AS d FROM t ANTI JOIN found USING (item_id) JOIN near USING (t) JOIN post USING (w) JOIN size USING (item_id) GROUP BY ALL),
guess AS (SELECT item_id, doc_id, avg(1.0 - least(d, length(t)) / length(t)) AS score FROM best GROUP BY item_id, doc_id, n HAVING count(*) = n)
SELECT item_id, doc_id AS id, 1.0 AS score, false AS fuzzy FROM found UNION ALL SELECT item_id, doc_id, round(score, 6), true FROM guess g WHERE score >= (SELECT max(score) FROM guess h WHERE h.item_id = g.item_id) - 0.1""")
def x6_indexed_search(t: Tables) -> DataFrame:
    """Many two-word queries, some misspelt, over the words of all documents: exact hits, and where there are none the nearest spellings."""
    words = F.filter(F.split(fold("text"), " "), lambda x: F.length(x) >= 6)
    rows = t.benchmark.select("item_id", words.alias("w")).where(F.size("w") >= 2).select("item_id", F.get("w", F.lit(0)).alias("a"), F.get("w", F.lit(1)).alias("b"))
    half = F.floor(F.length("b") / 2).cast("int")
    wrong = F.concat(F.left("b", half), F.substring("b", half + 2, F.length("b")))
    asked = rows.select("item_id", F.concat_ws(" ", "a", F.when(F.col("item_id") % 3 == 0, wrong).otherwise(F.col("b"))).alias("q"))
    return search.search(search.indexed(t.documents, "doc_id", "text"), asked, "item_id", "q").withColumn("score", F.round("score", 6))


TOWNS = f"""SELECT item_id AS town, array_to_string(list_slice(list_filter(string_split({sql_fold('text')}, ' '), lambda x: length(x) >= 2), 1, CAST(item_id % 3 + 1 AS INT)), ' ') AS name, CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS lang FROM benchmark
UNION ALL SELECT 1000000 + n_nationkey, {sql_fold('n_name')}, 'en' FROM nation"""


@query(f"""WITH place AS MATERIALIZED (SELECT town, {sql_fold('name')} AS name, lang FROM ({TOWNS})), most AS (SELECT max(len(string_split(name, ' '))) AS k FROM place WHERE name <> ''),
d AS MATERIALIZED (SELECT doc_id, lang, list_filter(string_split({sql_fold('text')}, ' '), lambda x: x <> '') AS w FROM documents),
run AS (SELECT doc_id, lang, len(w) AS n, i AS pos, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram FROM (SELECT d.*, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT unnest(range(1, (SELECT k FROM most) + 1)) AS k) WHERE i + k - 1 <= len(w)),
hit AS (SELECT doc_id, town, gram, n, pos, k, pos + k - 1 = n AS ends FROM run JOIN place ON gram = name AND (run.lang IS NULL OR run.lang = place.lang) WHERE name <> '' AND (pos + k - 1 = n OR length(gram) >= 3))
SELECT doc_id, town AS place, gram AS name, CASE WHEN ends AND pos = 1 THEN 'whole' WHEN ends THEN 'end' ELSE 'within' END AS how FROM hit QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY NOT ends, -k, -length(gram), pos, town) = 1""")
def e17_gazetteer_runs(t: Tables) -> DataFrame:
    """Places that documents name, of a gazetteer with names of one to three words, nested and shared ones among them, within the document's language."""
    words = F.filter(F.split(fold("text"), " "), lambda x: F.length(x) >= 2)
    k = F.col("item_id")
    lang = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (k % 4 + 1).cast("int"))
    towns = t.benchmark.select(k.cast("long").alias("town"), F.array_join(F.slice(words, F.lit(1), (k % 3 + 1).cast("int")), " ").alias("name"), lang.alias("lang"))
    towns = towns.unionByName(t.nation.select((F.col("n_nationkey") + 1_000_000).cast("long").alias("town"), F.col("n_name").alias("name"), F.lit("en").alias("lang")))
    return gazetteer.resolved(t.documents, "doc_id", "text", towns, "name", "town", "lang")


ATTENDING = "SELECT o_custkey AS id, o_orderpriority AS owner, CASE max(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END) WHEN 3 THEN 'going' WHEN 2 THEN 'maybe' ELSE 'interested' END AS state, bool_or(o_totalprice > 400000) AS paid, CAST(year(min(CAST(o_orderdate AS DATE))) AS VARCHAR) AS note FROM orders GROUP BY 1, 2"
WISHED = "SELECT min(c_custkey) AS keep, max(c_custkey) AS drop, CAST(count(*) AS BIGINT) AS rank FROM customer GROUP BY c_nationkey, c_mktsegment UNION ALL SELECT min(c_custkey), max(c_custkey), 1000 FROM customer GROUP BY c_nationkey"
DONE = f"SELECT keep, drop FROM (SELECT *, min((rank, keep, drop)) OVER (PARTITION BY keep) AS one FROM ({WISHED}) WHERE keep <> drop) w WHERE NOT EXISTS (SELECT 1 FROM ({WISHED}) o WHERE o.keep <> o.drop AND (o.keep IN (w.keep, w.drop) OR o.drop IN (w.keep, w.drop)) AND (o.rank, o.keep, o.drop) < (w.rank, w.keep, w.drop))"


def before_merge(t: Tables) -> tuple[merges.Tables, DataFrame]:
    """Customers, what their orders say of them per priority, and the wished merges: within a nation and segment, and within a nation."""
    parents = t.customer.select(F.col("c_custkey").alias("id"), F.lit(None).cast("long").alias("merged_into"), "c_mktsegment", "c_acctbal")
    strength = F.max(F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 2).otherwise(1))
    children = t.orders.groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("owner")).agg(strength.alias("s"), F.bool_or(F.col("o_totalprice") > 400_000).alias("paid"), F.year(F.min(F.to_date("o_orderdate"))).cast("string").alias("note"))
    children = children.select("id", "owner", F.element_at(F.array(*map(F.lit, merges.STATES)), F.col("s")).alias("state"), "paid", "note")
    wished = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("keep"), F.max("c_custkey").alias("drop"), F.count(F.lit(1)).alias("rank")).select("keep", "drop", "rank")
    wished = wished.unionByName(t.customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("keep"), F.max("c_custkey").alias("drop")).select("keep", "drop", F.lit(1000).cast("long").alias("rank")))
    return merges.Tables(written(parents, "parents"), written(children, "children")), wished


def done(wished: DataFrame) -> DataFrame:
    return written(merges.accepted(wished.distinct()).where("refused = ''").select("keep", "drop"), "moves")


@query(f"""WITH c AS MATERIALIZED ({ATTENDING}), m AS MATERIALIZED ({DONE}), g AS (SELECT c.*, coalesce(a.keep, b.keep) AS keep FROM c LEFT JOIN m a ON c.id = a.keep LEFT JOIN m b ON c.id = b.drop)
SELECT keep AS id, owner, CASE max(CASE state WHEN 'going' THEN 3 WHEN 'maybe' THEN 2 ELSE 1 END) WHEN 3 THEN 'going' WHEN 2 THEN 'maybe' ELSE 'interested' END AS state, bool_or(paid) AS paid, string_agg(DISTINCT note, chr(10) ORDER BY note) AS note FROM g WHERE keep IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT id, owner, state, paid, note FROM g WHERE keep IS NULL""")
def e9_merged_children(t: Tables) -> DataFrame:
    """Children after a batch of merges: of one owner's two the stronger state, paid if either is, both notes."""
    before, wished = before_merge(t)
    return merges.merged(before, done(wished))[0].children


EDITED = "(c_acctbal < 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 495000))"


@query(f"""WITH m AS MATERIALIZED ({DONE}), e AS (SELECT c_custkey AS id FROM customer WHERE {EDITED}), r AS (SELECT keep, drop, keep IN (SELECT id FROM e) OR drop IN (SELECT id FROM e) AS changed FROM m), a AS ({ATTENDING})
SELECT c_custkey AS id, CASE WHEN r.changed THEN r.keep END AS merged_into, CASE WHEN {EDITED} THEN 'EDITED' ELSE c_mktsegment END AS segment, CASE WHEN x.keep IS NULL THEN 'alone' WHEN x.changed THEN 'changed' ELSE 'restored' END AS outcome,
(SELECT count(DISTINCT owner) FROM a WHERE CASE WHEN x.changed THEN a.id IN (x.keep, x.drop) AND c_custkey = x.keep ELSE a.id = c_custkey END) AS children
FROM customer LEFT JOIN r ON r.drop = c_custkey LEFT JOIN r x ON c_custkey IN (x.keep, x.drop)""")
def e10_restored_merges(t: Tables) -> DataFrame:
    """Merges, then edits of some records, then every merge is to be taken back: those whose rows were edited since stay as they are."""
    before, wished = before_merge(t)
    moves = done(wished)
    after, log = merges.merged(before, moves)
    log = written(log, "merge-log")
    big = t.orders.where("o_totalprice > 495000").select(F.col("o_custkey").alias("id")).distinct().withColumn("big", F.lit(True))
    parents = after.parents.join(big, "id", "left").withColumn("c_mktsegment", F.when((F.col("c_acctbal") < 0) | F.col("big"), "EDITED").otherwise(F.col("c_mktsegment"))).select(after.parents.columns)
    now = merges.Tables(written(parents, "parents"), written(after.children, "children"))
    back, result = merges.restored(now, log, moves)
    result = result.select(F.explode(F.array("keep", "drop")).alias("id"), "outcome")
    held = back.children.groupBy("id").agg(F.count(F.lit(1)).alias("children"))
    out = back.parents.join(result, "id", "left").join(held, "id", "left")
    return out.select("id", "merged_into", F.col("c_mktsegment").alias("segment"), F.coalesce("outcome", F.lit("alone")).alias("outcome"), F.coalesce("children", F.lit(0)).alias("children"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 300000 THEN 'deleted' WHEN o_orderstatus = 'F' AND o_totalprice > 495000 THEN 'inserted' ELSE 'updated' END AS change FROM orders WHERE (o_orderstatus = 'P' AND o_totalprice > 300000) OR (o_orderstatus = 'F' AND o_totalprice > 495000) OR (o_orderstatus = 'O' AND o_totalprice > 499000)")
def a30_relation_differences(t: Tables) -> DataFrame:
    """Two stored versions of a relation: what was put in, taken out and changed, found by descending into unequal buckets only; a changed heartbeat column doesn't count."""
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    before = t.orders.where(~((status == "F") & (price > 495_000))).withColumn("seen", F.lit(1))
    after = t.orders.where(~((status == "P") & (price > 300_000))).withColumn("o_orderpriority", F.when((status == "O") & (price > 499_000), "moved").otherwise(F.col("o_orderpriority"))).withColumn("seen", F.lit(2))
    ensure_checkpoints(t.spark)
    at = f"{t.spark.sparkContext.getCheckpointDir()}/relations-{uuid.uuid4().hex}"
    a, b = (D.stored(df.select(*sorted(df.columns, reverse=turn)), ["o_orderkey"], f"{at}/{turn}", ("seen",)) for df, turn in ((before, False), (after, True)))
    return D.differences(t.spark, a, b)


RULES = f"""SELECT item_id AS rule, array_to_string(list_slice(w, 3, 3 + CAST(item_id % 2 AS INT)), ' ') AS run, ['age', 'level', 'class', 'type', 'season'][CAST(item_id % 5 + 1 AS INT)] AS attribute, 'v' || (item_id % 7) AS value, item_id % 3 AS precedence, CASE WHEN item_id % 4 = 0 THEN w[1] || ' ' || w[2] END AS unless
FROM (SELECT item_id, list_filter(string_split({sql_fold('text')}, ' '), lambda x: length(x) >= 2) AS w FROM benchmark) WHERE len(w) >= 4"""


@query(f"""WITH rule AS MATERIALIZED ({RULES}), d AS MATERIALIZED (SELECT doc_id, list_filter(string_split({sql_fold('text')}, ' '), lambda x: x <> '') AS w FROM documents),
run AS (SELECT doc_id, i AS pos, w[i] AS gram FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d) UNION ALL SELECT doc_id, i, w[i] || ' ' || w[i + 1] FROM (SELECT *, unnest(range(1, len(w))) AS i FROM d)),
hit AS (SELECT doc_id, rule, min(pos) AS pos FROM run JOIN rule ON run.gram = rule.run GROUP BY ALL), void AS (SELECT DISTINCT doc_id, rule FROM run JOIN rule ON run.gram = unless),
held AS (SELECT * FROM hit ANTI JOIN void USING (doc_id, rule) JOIN rule USING (rule)), tier AS (SELECT doc_id, attribute, min(precedence) AS tier FROM held GROUP BY 1, 2)
SELECT doc_id, attribute, CASE WHEN attribute IN ('age', 'type') THEN string_agg(DISTINCT value, ',' ORDER BY value) ELSE arg_min(value, (pos, rule)) END AS found, tier FROM held JOIN tier USING (doc_id, attribute) WHERE precedence = tier GROUP BY doc_id, attribute, tier""")
def c40_rule_classifier(t: Tables) -> DataFrame:
    """Ages, level, class, type and season of whole documents by a table of word runs with precedences and exclusions."""
    words = F.filter(F.split(fold("text"), " "), lambda x: F.length(x) >= 2)
    k = F.col("item_id")
    rules = t.benchmark.select("item_id", words.alias("w")).where(F.size("w") >= 4).select(
        k.alias("rule"), F.array_join(F.slice("w", F.lit(3), (k % 2 + 1).cast("int")), " ").alias("run"), F.element_at(F.array(*map(F.lit, ("age", "level", "class", "type", "season"))), (k % 5 + 1).cast("int")).alias("attribute"),
        F.concat(F.lit("v"), (k % 7).cast("string")).alias("value"), (k % 3).alias("precedence"), F.when(k % 4 == 0, F.array_join(F.slice("w", 1, 2), " ")).alias("unless"),
    )
    out = classifier.classified(t.documents, "doc_id", "text", written(rules, "rules"), several=("age", "type"))
    return out.select("doc_id", "attribute", F.array_join("values", ",").alias("found"), "tier")
