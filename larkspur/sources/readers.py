"""Pages read in layers: each reader is asked only about pages on which the one before found nothing, and every page comes out with what was found, how,
whether that is all there is, and what was wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.text import decoded, visible_text
from larkspur.sources.documents import EVENT, GRAPH

SCRIPT = r'(?is)<script[^>]*type\s*=\s*["\']application/ld\+json["\'][^>]*>(.*?)</script>'
RECORD = "array<struct<name:string,day:date,place:string,url:string,confidence:double>>"
#: A page with less visible text than this, with scripts and without a record, has to be rendered before it can be read.
THIN = 250


def structured(html: Column) -> Column:
    """Records of a page's JSON-LD scripts: items, lists or graphs of them whose type holds Event, with a name and a day."""

    def items(j: Column) -> Column:
        graph = F.from_json(j, GRAPH)["@graph"]
        return F.when(F.ltrim(j).startswith("["), F.from_json(j, T.ArrayType(EVENT))).when(graph.isNotNull(), graph).otherwise(F.array(F.from_json(j, EVENT)))

    def record(e: Column) -> Column:
        day, place = F.try_to_date(F.left(e["startDate"], F.lit(10)), "yyyy-MM-dd"), e["location"]["name"]
        return F.struct(e["name"].alias("name"), day.alias("day"), place.alias("place"), e["url"].alias("url"), F.when(place.isNotNull(), 0.85).otherwise(0.7).alias("confidence"))

    found = F.flatten(F.transform(F.regexp_extract_all(html, F.lit(SCRIPT), 1), lambda j: F.coalesce(items(j), F.array().cast(T.ArrayType(EVENT)))))
    events = F.filter(found, lambda e: e["@type"].contains("Event") & (e["name"] != ""))
    return F.filter(F.transform(events, record), lambda r: r["day"].isNotNull())


def unreadable_scripts(html: Column) -> Column:
    """How many JSON-LD scripts of a page are no JSON."""
    return F.size(F.filter(F.regexp_extract_all(html, F.lit(SCRIPT), 1), lambda j: F.try_parse_json(j).isNull()))


def plain(html: Column, url: Column, text: Column, junk: str = r"^(home|index|untitled)\b") -> tuple[Column, Column]:
    """At most one record of any page, and what kept it from being one: its title (og:title, else h1, else title) and the first day in its text, ISO or
    dotted. A title that says nothing, no title, and a year in the title or path other than the day's are issues; a page without a day gives none."""
    grab = lambda p: F.nullif(F.trim(decoded(F.regexp_extract(html, p, 1))), F.lit(""))
    title = F.coalesce(grab(r'(?is)<meta[^>]*property="og:title"[^>]*content="([^"]*)"'), grab(r"(?is)<h1[^>]*>([^<]*)</h1>"), grab(r"(?is)<title[^>]*>([^<]*)</title>"))
    dotted = F.replace(F.regexp_extract(text, r"\b(\d{1,2}\. ?\d{1,2}\. ?\d{4})\b", 1), F.lit(" "), F.lit(""))
    day = F.coalesce(F.try_to_date(F.regexp_extract(text, r"\b(\d{4}-\d{2}-\d{2})\b", 1), "yyyy-MM-dd"), F.try_to_date(dotted, "d.M.yyyy"))
    said = F.regexp_extract_all(F.concat_ws(" ", title, F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)), F.lit(r"(?<![0-9])(20[0-9]{2})(?![0-9])"), 1)
    issue = F.when(title.isNull(), "no_title").when(F.rlike(F.lower(title), F.lit(junk)), "junk_title").when(day.isNotNull() & (F.size(said) > 0) & ~F.array_contains(said, F.year(day).cast("string")), "year_conflict").when(day.isNull(), "no_day")
    record = F.struct(title.alias("name"), day.alias("day"), F.lit(None).cast("string").alias("place"), url.alias("url"), F.lit(0.4).alias("confidence"))
    return F.when(issue.isNull(), F.array(record)).otherwise(F.array()).cast(RECORD), issue


def read_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, strategy, records, confidence, complete, issues: one row per page.

    strategy: json_ld, generic, dynamic_unread (a shell of scripts) or none. Only structured records are taken for complete, and only if all scripts could be
    read; the generic reader sees one record where a page may list many. confidence is the least of the records', 0 without any. A null page is none.
    """
    source = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), source.alias("h")).withColumn("first", structured(F.col("h")).cast(RECORD))
    open_ = F.size("first") == 0
    # a branch is evaluated for the pages that reach it only
    rows = rows.withColumn("text", F.when(open_, visible_text("h")))
    second, issue = plain(F.col("h"), F.col("u"), F.col("text"))
    rows = rows.withColumns({"second": F.when(open_, second), "issue": F.when(open_, issue)})
    found = F.when(~open_, F.col("first")).otherwise(F.col("second"))
    thin = open_ & (F.size("second") == 0) & (F.length("text") < THIN) & F.rlike("h", F.lit("(?i)<script"))
    strategy = F.when(~open_, "json_ld").when(F.size("second") > 0, "generic").when(thin, "dynamic_unread").otherwise("none")
    broken = unreadable_scripts(F.col("h"))
    issues = F.array_compact(F.array(F.when(broken > 0, "unreadable_script"), F.col("issue"), F.when(thin, "needs_rendering")))
    out = rows.select("k", strategy.alias("strategy"), found.alias("records"), issues.alias("issues"), (~open_ & (broken == 0)).alias("complete"))
    least = F.coalesce(F.array_min(F.transform("records", lambda r: r["confidence"])), F.lit(0.0))
    return out.select(F.col("k").alias(key), "strategy", "records", least.alias("confidence"), "complete", "issues")
