"""Pages, calendars and paging over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scratch import ensure_checkpoints
from larkspur.functions.ship import ship
from larkspur.functions.text import visible_text
from larkspur.plans.registry import Tables, query
from larkspur.sources import documents as D
from larkspur.sources import exchange, readers
from larkspur.streaming import jobs, progress

#: DuckDB's visible text of a page, and its title.
VISIBLE = r"""left(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script>', ' ', 'gis'), '<style\b.*?</style>', ' ', 'gis'), '<nav\b.*?</nav>', ' ', 'gis'), '<footer\b.*?</footer>', ' ', 'gis'), '<noscript\b.*?</noscript>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[\s\x{A0}]+', ' ', 'g')), 20000)"""
DECODED = """replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"""


def sql_title(html: str) -> str:
    grab = lambda p: "nullif(trim(" + DECODED.format(DECODED.format(f"regexp_extract({html}, '{p}', 1, 'is')")) + "), '')"
    return "coalesce(" + ", ".join(map(grab, ('<meta[^>]*property="og:title"[^>]*content="([^"]*)"', "<h1[^>]*>([^<]*)</h1>", "<title[^>]*>([^<]*)</title>"))) + ")"


SQL_DAY = r"coalesce(TRY_CAST(nullif(regexp_extract(text, '\b(\d{4}-\d{2}-\d{2})\b', 1), '') AS DATE), CAST(TRY_STRPTIME(replace(regexp_extract(text, '\b(\d{1,2}\. ?\d{1,2}\. ?\d{4})\b', 1), ' ', ''), '%d.%m.%Y') AS DATE))"
MADE = """'<script type="application/ld+json">{"@type": "SportsEvent", "name": "Race ' || page_id || '", "startDate": "2025-05-04T10:00", "location": {"name": "Lund"}}</script>'"""


@query("SELECT o_orderkey, o_custkey FROM orders")
def s1_full_scan(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 12345 ORDER BY o_orderkey LIMIT 1000")
def s2_keyset_page(t: Tables) -> DataFrame:
    return t.orders.where("o_orderkey > 12345").orderBy("o_orderkey").limit(1000).select("o_orderkey")


@query("SELECT page_id, 'Race ' || page_id AS name, DATE '2025-05-04' AS start, CAST(NULL AS DATE) AS \"end\", 'Lund' AS place, CAST(NULL AS VARCHAR) AS url, 0.85 AS confidence FROM pages")
def s4_json_ld(t: Tables) -> DataFrame:
    """Structured items of pages; the test pages hold none, so each page gets a script made from its id."""
    made = F.concat(F.lit('<script type="application/ld+json">{"@type": "SportsEvent", "name": "Race '), F.col("page_id").cast("string"), F.lit('", "startDate": "2025-05-04T10:00", "location": {"name": "Lund"}}</script>'))
    return D.json_ld(t.pages.withColumn("html", F.concat("html", made)))


@query(rf"SELECT page_id, CASE WHEN title IS NULL OR regexp_matches(lower(title), '^(home|index|untitled)\b') THEN 'none' ELSE 'generic' END AS strategy FROM (SELECT page_id, {sql_title('html')} AS title FROM pages)")
def s5_layered_readers(t: Tables) -> DataFrame:
    pages = t.pages
    return D.layered(pages, [("json_ld", D.json_ld(pages)), ("generic", D.generic(pages))])


@query(f"SELECT page_id, {VISIBLE} AS text FROM pages")
def s7_visible_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", visible_text("html").alias("text"))


@query("SELECT o_orderkey, concat_ws(chr(13) || chr(10), 'BEGIN:VEVENT', 'UID:' || o_orderkey, 'SUMMARY:' || o_orderpriority || '\\, ' || o_orderstatus, 'DTSTART;VALUE=DATE:' || strftime(o_orderdate, '%Y%m%d'), 'DTEND;VALUE=DATE:' || strftime(CAST(o_orderdate AS DATE) + 1, '%Y%m%d'), 'END:VEVENT', '') AS ics FROM orders")
def s14_calendar_text(t: Tables) -> DataFrame:
    ship(t.spark)
    day = F.to_date("o_orderdate")
    return D.calendar(t.orders.select("o_orderkey", F.concat_ws(", ", "o_orderpriority", "o_orderstatus").alias("name"), day.alias("start"), day.alias("end")), "o_orderkey", "name", "start", "end")


@query(rf"SELECT page_id, title, {SQL_DAY} AS day FROM (SELECT page_id, {VISIBLE} AS text, {sql_title('html')} AS title FROM pages) WHERE title IS NOT NULL AND NOT regexp_matches(lower(title), '^(home|index|untitled)\b')")
def s20_generic_reader(t: Tables) -> DataFrame:
    return D.generic(t.pages)


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?', 'g') END AS text FROM documents")
def s21_charset(t: Tables) -> DataFrame:
    ship(t.spark)
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode(F.regexp_replace("text", r"[^\x00-\xFF]", "?"), "ISO-8859-1"))
    return t.documents.select("doc_id", D.charset_text(raw, F.lit("windows-1252")).alias("text"))


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def t12_streaming_hour_counts(t: Tables) -> DataFrame:
    """The hourly counts as a stream: one pass over the table's files with watermarks, all windows closed at the end."""
    return jobs.hourly(t.spark, f"{t.folder}/events.parquet").select("event_type", "hour", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(*) > 0 AS seen FROM events GROUP BY ALL")
def t16_streaming_deduplication(t: Tables) -> DataFrame:
    """The first delivery of each (user, kind, day), kept apart from repeats by state under a watermark."""
    return jobs.delivered_once(t.spark, f"{t.folder}/events.parquet")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) AS seen FROM events GROUP BY 1")
def t3_streaming_state(t: Tables) -> DataFrame:
    """Per-user state over a stream: how many events and failures so far."""
    ship(t.spark)
    return jobs.user_state(t.spark, f"{t.folder}/events.parquet")


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS key, CAST(floor(epoch(ts)) AS BIGINT) AS s, event_type AS h, event_type = 'error' AS c, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_type) AS n FROM events),
run AS (SELECT key, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS s, '' AS h, CAST(NULL AS BIGINT) AS until, CAST(0 AS BIGINT) AS conflicts, false AS read, CAST(NULL AS BIGINT) AS due, CAST(0 AS BIGINT) AS before FROM (SELECT DISTINCT key FROM e) UNION ALL
  SELECT key, n, s, h, CASE WHEN rests THEN until ELSE s + CASE k WHEN 0 THEN 604800 WHEN 1 THEN 1800 WHEN 2 THEN 7200 WHEN 3 THEN 86400 ELSE 604800 END END, k, NOT rests, CASE WHEN s >= until THEN until END, conflicts FROM (
    SELECT *, CASE WHEN rests THEN conflicts WHEN c THEN least(4, conflicts + 1) ELSE 0 END AS k FROM (SELECT e.*, r.until, r.conflicts, coalesce(e.s < r.until AND e.h = r.h AND NOT e.c, false) AS rests FROM run r JOIN e ON e.key = r.key AND e.n = r.n + 1)))
SELECT key, s AS at, 'read' AS action, conflicts, until FROM run WHERE read UNION ALL SELECT key, due, 'due', before, due FROM run WHERE due IS NOT NULL
UNION ALL SELECT key, until, 'due', conflicts, until FROM run r WHERE n = (SELECT max(n) FROM e WHERE e.key = r.key) AND until * 1000 <= (SELECT floor(epoch_us(max(ts)) / 1000) - 3600000 FROM events)""")
def t3_streaming_progress(t: Tables) -> DataFrame:
    """Users as rows that are read again and again: readings that count, and rows that fall due when their rest has ended, by event-time timers."""
    ship(t.spark)
    rows = jobs._source(t.spark, f"{t.folder}/events.parquet")
    return progress.reports(t.spark, rows.select(F.col("user_id").alias("key"), "ts", F.col("event_type").alias("hash"), (F.col("event_type") == "error").alias("conflict")))


@query(rf"""WITH p AS (SELECT page_id, url, CASE WHEN page_id % 5 = 4 THEN '<html><head><title>App ' || page_id || '</title></head><body><script>boot()</script></body></html>'
  ELSE regexp_replace(html, '<article>', '<article><p>' || CASE page_id % 4 WHEN 0 THEN '2025-03-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') WHEN 1 THEN (page_id % 28 + 1) || '. 4. 2026' WHEN 2 THEN '31.2.2026' ELSE '' END || '</p>')
    || CASE WHEN page_id % 3 = 0 THEN {MADE} ELSE '' END || CASE WHEN page_id % 7 = 1 THEN '<script type="application/ld+json">{{"@type": "Event", </script>' ELSE '' END END AS html FROM pages),
q AS (SELECT page_id, url, page_id % 5 <> 4 AND page_id % 3 = 0 AS made, page_id % 5 <> 4 AND page_id % 7 = 1 AS broken, regexp_matches(html, '(?i)<script') AS scripted, {VISIBLE} AS text, {sql_title('html')} AS title FROM p), r AS (SELECT *, {SQL_DAY} AS day FROM q),
s AS (SELECT *, CASE WHEN made THEN NULL WHEN title IS NULL THEN 'no_title' WHEN regexp_matches(lower(title), '^(home|index|untitled)\b') THEN 'junk_title' WHEN day IS NOT NULL AND len(years) > 0 AND NOT list_contains(years, CAST(year(day) AS VARCHAR)) THEN 'year_conflict' WHEN day IS NULL THEN 'no_day' END AS issue
  FROM (SELECT *, list_filter(regexp_extract_all(title || ' ' || regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '[0-9]+'), lambda y: regexp_matches(y, '^20[0-9]{{2}}$')) AS years FROM r)),
u AS (SELECT *, NOT made AND issue IS NOT NULL AND length(text) < 250 AND scripted AS thin FROM s)
SELECT page_id, CASE WHEN made THEN 'json_ld' WHEN issue IS NULL THEN 'generic' WHEN thin THEN 'dynamic_unread' ELSE 'none' END AS strategy, CASE WHEN made THEN 'Race ' || page_id WHEN issue IS NULL THEN title END AS name, CASE WHEN made THEN DATE '2025-05-04' WHEN issue IS NULL THEN day END AS day,
CASE WHEN made THEN 0.85 WHEN issue IS NULL THEN 0.4 ELSE 0 END AS confidence, made AND NOT broken AS complete, concat_ws(',', CASE WHEN broken THEN 'unreadable_script' END, issue, CASE WHEN thin THEN 'needs_rendering' END) AS issues FROM u""")
def s5_read_pages(t: Tables) -> DataFrame:
    """Pages in layers, with how far each was read: some with a structured item, some with a script that is no JSON, some with days in their text, some only shells of scripts."""
    k = F.col("page_id")
    day = F.when(k % 4 == 0, F.concat(F.lit("2025-03-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).when(k % 4 == 1, F.concat((k % 28 + 1).cast("string"), F.lit(". 4. 2026"))).when(k % 4 == 2, "31.2.2026").otherwise("")
    made = F.concat(F.lit('<script type="application/ld+json">{"@type": "SportsEvent", "name": "Race '), k.cast("string"), F.lit('", "startDate": "2025-05-04T10:00", "location": {"name": "Lund"}}</script>'))
    broken = F.lit('<script type="application/ld+json">{"@type": "Event", </script>')
    with_day = F.regexp_replace(F.col("html"), F.lit("<article>"), F.concat(F.lit("<article><p>"), day, F.lit("</p>")))
    full = F.concat(with_day, F.when(k % 3 == 0, made).otherwise(""), F.when(k % 7 == 1, broken).otherwise(""))
    shell = F.concat(F.lit("<html><head><title>App "), k.cast("string"), F.lit("</title></head><body><script>boot()</script></body></html>"))
    rows = readers.read_pages(t.pages.withColumn("html", F.when(k % 5 == 4, shell).otherwise(full)))
    first = F.get("records", F.lit(0))
    return rows.select("page_id", "strategy", first["name"].alias("name"), first["day"].alias("day"), "confidence", "complete", F.array_join("issues", ",").alias("issues"))


@query("SELECT doc_id, text, lang, n_chars > 1000 AS long, o.day, n_chars FROM documents JOIN (SELECT DISTINCT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders) o ON o_orderkey = doc_id WHERE lang <> 'fr' AND n_chars >= 200")
def s8_csv_there_and_back(t: Tables) -> DataFrame:
    """Documents, with all their quotes and line ends, written as semicolon CSV and read again with filters pushed down to the reader."""
    return _exchanged(t, "larkspur_csv").where("lang <> 'fr' and n_chars >= 200")


@query("SELECT doc_id, text, lang, n_chars > 1000 AS long, o.day, n_chars FROM documents JOIN (SELECT DISTINCT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders) o ON o_orderkey = doc_id WHERE lang IN ('en', 'de')")
def s15_json_there_and_back(t: Tables) -> DataFrame:
    """The same as arrays of objects with headers for caches."""
    return _exchanged(t, "larkspur_json").where("lang in ('en', 'de')")


def _exchanged(t: Tables, form: str) -> DataFrame:
    ship(t.spark)
    exchange.register(t.spark)
    rows = t.documents.join(t.orders.select(F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("day")).distinct(), "doc_id").select("doc_id", "text", "lang", (F.col("n_chars") > 1000).alias("long"), "day", "n_chars")
    ensure_checkpoints(t.spark)
    at = f"{t.spark.sparkContext.getCheckpointDir()}/{form}-{uuid.uuid4().hex}"
    rows.write.format(form).mode("append").save(at)
    return t.spark.read.format(form).option("pushdown", True).schema(rows.schema).load(at)
