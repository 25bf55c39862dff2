"""Pages to records: JSON-LD, layered readers, CSV, and text sinks. Column expressions; only the byte-level fold is a pandas UDF."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.text import decoded, visible_text

EVENT = T.StructType().add("@type", "string").add("name", "string").add("startDate", "string").add("endDate", "string").add("url", "string").add("location", T.StructType().add("name", "string"))
GRAPH = T.StructType().add("@graph", T.ArrayType(EVENT))


def json_ld(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, name, start, end, place, url, confidence of every JSON-LD item whose type holds Event and that has a name and a start.

    Scripts may hold one item, a list, or an @graph; unreadable JSON gives nothing. Confidence is 0.85 with a place, else 0.7.
    """
    script = r'(?is)<script[^>]*type\s*=\s*["\']application/ld\+json["\'][^>]*>(.*?)</script>'
    rows = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(script), 1)).alias("j"))
    one, many, graph = F.from_json("j", EVENT), F.from_json("j", T.ArrayType(EVENT)), F.from_json("j", GRAPH)["@graph"]
    items = F.when(F.ltrim("j").startswith("["), many).when(graph.isNotNull(), graph).otherwise(F.array(one))
    got = rows.select(key, F.explode(items).alias("e")).select(key, "e.*")
    place = F.col("location.name")
    return got.where(F.col("@type").contains("Event") & F.col("name").isNotNull() & F.col("startDate").isNotNull()).select(
        key, "name", F.try_to_date(F.left("startDate", F.lit(10)), "yyyy-MM-dd").alias("start"), F.try_to_date(F.left("endDate", F.lit(10)), "yyyy-MM-dd").alias("end"), place.alias("place"), "url", F.when(place.isNotNull(), 0.85).otherwise(0.7).alias("confidence")
    )


def generic(pages: DataFrame, key: str = "page_id", html: str = "html", junk: str = r"^(home|index|untitled)\b") -> DataFrame:
    """key, title, day of pages: og:title, else h1, else title; first ISO date, else a dotted one, of the visible text; junk titles go."""
    grab = lambda p: F.nullif(F.trim(decoded(F.regexp_extract(html, p, 1))), F.lit(""))
    title = F.coalesce(grab(r'(?is)<meta[^>]*property="og:title"[^>]*content="([^"]*)"'), grab(r"(?is)<h1[^>]*>([^<]*)</h1>"), grab(r"(?is)<title[^>]*>([^<]*)</title>"))
    text = visible_text(html)
    dotted = F.regexp_extract(text, r"\b(\d{1,2}\. ?\d{1,2}\. ?\d{4})\b", 1)
    day = F.coalesce(F.try_to_date(F.regexp_extract(text, r"\b(\d{4}-\d{2}-\d{2})\b", 1), "yyyy-MM-dd"), F.try_to_date(F.replace(dotted, F.lit(" "), F.lit("")), "d.M.yyyy"))
    return pages.select(key, title.alias("title"), day.alias("day")).where(F.col("title").isNotNull() & ~F.lower("title").rlike(junk))


def layered(pages: DataFrame, readers: list[tuple[str, DataFrame]], key: str = "page_id") -> DataFrame:
    """key, strategy: the first reader that found something on the page; none where no reader did."""
    found = None
    for rank, (name, rows) in enumerate(readers):
        one = rows.select(key).distinct().select(key, F.struct(F.lit(rank).alias("r"), F.lit(name).alias("name")).alias("x"))
        found = one if found is None else found.unionByName(one)
    best = found.groupBy(key).agg(F.min("x").alias("x"))
    return pages.select(key).join(best, key, "left").select(key, F.coalesce("x.name", F.lit("none")).alias("strategy"))


def semicolon_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A quoted, multi-line CSV with semicolons; the header must name exactly these columns."""
    df = spark.read.csv(path, sep=";", header=True, quote='"', escape='"', multiLine=True)
    if df.columns != columns:
        raise ValueError(f"columns are {df.columns}, not {columns}")
    return df


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


@F.pandas_udf(T.StringType())
def folded_line(line: pd.Series) -> pd.Series:
    """Content lines of at most 75 bytes, continued after CRLF and a blank; no character is split."""

    def fold(s: str) -> str:
        out, size = [], 0
        for ch in s:
            n = len(ch.encode())
            if size + n > 75:
                out.append("\r\n ")
                size = 1
            out.append(ch)
            size += n
        return "".join(out)

    return line.map(lambda s: None if s is None else fold(s))


def escaped(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"([\;,])", r"\\$1"), "\r?\n", r"\\n")


def calendar(events: DataFrame, key: str, name: str, start: str, end: str) -> DataFrame:
    """key, ics: one calendar entry per row as text, lines ended by CRLF; the end day is exclusive."""
    day = lambda c: F.date_format(c, "yyyyMMdd")
    lines = F.array(
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col(key).cast("string")), F.concat(F.lit("DTSTART;VALUE=DATE:"), day(start)), F.concat(F.lit("DTEND;VALUE=DATE:"), day(F.date_add(end, 1))), F.lit("END:VEVENT"),
    )
    summary = folded_line(F.concat(F.lit("SUMMARY:"), escaped(F.col(name))))
    return events.select(key, lines.alias("l"), summary.alias("s")).select(key, F.concat(F.array_join(F.concat(F.slice("l", 1, 2), F.array("s"), F.slice("l", 3, 3)), "\r\n"), F.lit("\r\n")).alias("ics"))


#: Texts that are decoded as Python objects at a time.
SLICE = 64


@F.arrow_udf(T.StringType())
def charset_text(raw: pa.Array, declared: pa.Array) -> pa.Array:
    """Bytes to text: valid UTF-8 wins over any label; then the label, if it is known; then Latin-1."""

    def one(b: bytes | None, label: str | None) -> str | None:
        if b is None:
            return None
        for name in ("utf-8", label, "latin-1"):
            try:
                return b.decode(name)
            except (UnicodeDecodeError, LookupError, TypeError):
                continue
        return None

    # a few texts at a time are Python objects, never a whole batch of them
    parts = [pa.array([one(b, x) for b, x in zip(raw.slice(i, SLICE).to_pylist(), declared.slice(i, SLICE).to_pylist(), strict=True)], pa.string()) for i in range(0, len(raw), SLICE)]
    return pa.concat_arrays(parts or [pa.array([], pa.string())])
