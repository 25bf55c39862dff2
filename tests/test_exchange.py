"""Exchange formats there and back, pages in layers, and the rule classifier, on fixed rows."""

import datetime
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from larkspur.functions.ship import ship
from larkspur.operators import classifier
from larkspur.sources import exchange, readers

SCHEMA = "id long, name string, price double, day date, ok boolean, at timestamp_ntz"
ROWS = [
    (1, 'semi;colon "quoted"', 1.5, datetime.date(2026, 5, 1), True, datetime.datetime(2026, 5, 1, 12, 30)),
    (2, "two\nlines\r\nthree", None, None, False, None),
    (3, None, -0.25, datetime.date(1999, 12, 31), None, datetime.datetime(1999, 1, 1)),
    (4, "ünï 日本 [x],\\", 1e300, None, True, None),
]


@pytest.fixture
def formats(spark):
    ship(spark)
    exchange.register(spark)


def held(path):
    return sorted(p.name for p in path.iterdir() if not p.name.startswith("."))


@pytest.mark.parametrize("form", ["larkspur_csv", "larkspur_json"])
def test_there_and_back(spark, formats, tmp_path, form):
    at = tmp_path / "x"
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    df.write.format(form).mode("append").save(str(at))
    load = lambda **o: spark.read.format(form).options(**o).schema(SCHEMA).load(str(at))
    assert sorted(tuple(r) for r in load().collect()) == ROWS
    for filters, ids in (("price > 0 and name is not null and id in (1, 3, 4)", [1, 4]), ("day >= date'2026-01-01'", [1]), ("name is null", [3]), ("name like 'two%'", [2])):
        for pushed in (False, True):
            assert sorted(r.id for r in load(pushdown=pushed).where(filters).collect()) == ids
    df.where("id < 3").write.format(form).mode("append").save(str(at))
    assert load().count() == 6
    df.where("id = 4").write.format(form).mode("overwrite").save(str(at))
    assert [r.id for r in load().collect()] == [4]
    manifest = json.loads((at / exchange.MANIFEST).read_text())
    assert held(at) == sorted([exchange.MANIFEST, *manifest["parts"]]) and manifest["rows"] == 1
    df.where("id > 9").write.format(form).mode("overwrite").save(str(at))
    assert load().collect() == []


def test_filters_are_pushed_down(spark):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains
    from pyspark.sql.types import _parse_datatype_string

    reader = exchange.PushedCsvReader(_parse_datatype_string("id long, name string"), {"path": "x"})
    left = list(reader.pushFilters([GreaterThan(("id",), 2), In(("name",), ("a", "b")), StringContains(("name",), "z"), EqualTo(("s", "t"), 1)]))
    assert [type(f).__name__ for f in left] == ["StringContains", "EqualTo"]
    assert [reader.passes(r) for r in [(3, "a"), (2, "a"), (3, "c"), (None, "a"), (3, None)]] == [True, False, False, False, False]


def test_headers_of_json(spark, formats, tmp_path):
    df = spark.createDataFrame(ROWS[:2], SCHEMA).coalesce(1)
    tags = []
    for i, rows in enumerate((df, df, df.where("id = 1"))):
        rows.write.format("larkspur_json").option("maxAge", 300).option("staleWhileRevalidate", 60).mode("overwrite").save(str(tmp_path / f"{i}"))
        headers = json.loads((tmp_path / f"{i}" / exchange.MANIFEST).read_text())["headers"]
        assert headers["cache-control"] == "public, max-age=300, stale-while-revalidate=60"
        tags.append(headers["etag"])
    assert tags[0] == tags[1] != tags[2]
    part = next((tmp_path / "0").glob("part-*.json"))
    assert [x["name"] for x in json.loads(part.read_text())] == [r[1] for r in ROWS[:2]]


def test_an_aborted_write_leaves_nothing(spark, formats, tmp_path):
    at = tmp_path / "x"
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    df.write.format("larkspur_csv").mode("append").save(str(at))
    before = held(at)
    broken = df.withColumn("name", F.when(F.col("id") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("name")))
    with pytest.raises(PySparkException):
        broken.write.format("larkspur_csv").mode("overwrite").save(str(at))
    assert held(at) == before
    assert spark.read.format("larkspur_csv").schema(SCHEMA).load(str(at)).count() == len(ROWS)


@pytest.mark.parametrize("text", ["id;nam\r\n1;x\r\n", "id;name;more\r\n1;x;y\r\n", "id;name\r\n1;x;y\r\n", 'id;name\r\n1;"x\r\n', ""])
def test_bad_csv_is_refused(spark, formats, tmp_path, text):
    (tmp_path / "x.csv").write_text(text)
    with pytest.raises(PySparkException):
        spark.read.format("larkspur_csv").schema("id long, name string").load(str(tmp_path / "x.csv")).collect()


LD = '<script type="application/ld+json">%s</script>'
ONE = '{"@type": "SportsEvent", "name": "Night Run", "startDate": "2026-06-01T20:00", "location": {"name": "Lund"}, "url": "https://x.example/n"}'
PAGES = [  # html, strategy, names and days, confidence, complete, issues
    (LD % ONE, "json_ld", [("Night Run", "2026-06-01")], 0.85, True, []),
    (LD % '[%s, {"@type": "Event", "name": "B", "startDate": "2026-07-02"}, {"@type": "Place", "name": "C"}]' % ONE, "json_ld", [("Night Run", "2026-06-01"), ("B", "2026-07-02")], 0.7, True, []),
    (LD % '{"@graph": [{"@type": "Event", "name": "G", "startDate": "2026-07-02"}]}', "json_ld", [("G", "2026-07-02")], 0.7, True, []),
    (LD % ONE + LD % '{"@type": ', "json_ld", [("Night Run", "2026-06-01")], 0.85, False, ["unreadable_script"]),
    (LD % '{"@type": "Event", "name": "No day"}' + "<h1>Spring &amp; Run</h1><p>on 2026-05-09, not 1. 1. 2027", "generic", [("Spring & Run", "2026-05-09")], 0.4, False, []),
    ('<meta property="og:title" content="Og"><title>T</title><h1>H</h1><p>on 9. 5. 2026', "generic", [("Og", "2026-05-09")], 0.4, False, []),
    ("<title>T</title><p>on 9.5.2026", "generic", [("T", "2026-05-09")], 0.4, False, []),
    ("<h1>Run 2025</h1><p>on 9.5.2026", "none", [], 0.0, False, ["year_conflict"]),
    ("<h1>Index of races</h1><p>on 9.5.2026", "none", [], 0.0, False, ["junk_title"]),
    ("<h1>Run</h1><p>on 31.2.2026", "none", [], 0.0, False, ["no_day"]),
    ("<h1>Run</h1><nav>9.5.2026</nav>", "none", [], 0.0, False, ["no_day"]),
    ("<p>9.5.2026</p>", "none", [], 0.0, False, ["no_title"]),
    ("<title>App</title><div id=root></div><script>go()</script>", "dynamic_unread", [], 0.0, False, ["no_day", "needs_rendering"]),
    ("", "none", [], 0.0, False, ["no_title"]), (None, "none", [], 0.0, False, ["no_title"]),
]


def test_pages_in_layers(spark):
    df = spark.createDataFrame([(i, f"https://a.example/p/{i}", p[0]) for i, p in enumerate(PAGES)], "page_id long, url string, html string")
    got = {r.page_id: (r.strategy, [(x.name, str(x.day)) for x in r.records], r.confidence, r.complete, r.issues) for r in readers.read_pages(df).collect()}
    assert [got[i] for i in range(len(PAGES))] == [p[1:] for p in PAGES]


RULES = [
    ("a1", "under 23", "age", "u23", 0, None), ("a2", "juniors", "age", "junior", 0, None), ("a3", "young", "age", "youth", 1, None), ("a4", "kids", "age", "kids", 0, "kids menu"),
    ("l1", "national championship", "level", "national", 0, "qualifier for the national championship"), ("l2", "cup", "level", "regional", 1, None), ("l3", "World Cup", "level", "world", 0, None),
    ("t1", "race", "type", "race", 0, None), ("t2", "ride", "type", "ride", 0, None),
]
TEXTS = [
    ("Juniors and UNDER-23, young riders: race, then a ride", {"age": (["junior", "u23"], 0), "type": (["race"], 0)}), ("A young ride", {"age": (["youth"], 1), "type": (["ride"], 0)}),
    ("Kids race with a menu for kids", {"type": (["race"], 0), "age": (["kids"], 0)}), ("Kids race with a kids menu", {"type": (["race"], 0)}), ("World cup", {"level": (["world"], 0)}), ("National Championship and cup", {"level": (["national"], 0)}),
    ("Cup: qualifier for the national championship", {"level": (["regional"], 1)}), ("nothing of it", {}), ("", {}), (None, {}), ("braces and rides", {}),
]


def test_rules(spark):
    rules = spark.createDataFrame(RULES, "rule string, run string, attribute string, value string, precedence int, unless string")
    texts = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TEXTS)], "id long, t string")
    got = {}
    for r in classifier.classified(texts, "id", "t", rules, several=("age",)).collect():
        got.setdefault(r.id, {})[r.attribute] = (r["values"], r.tier)
    assert [got.get(i, {}) for i in range(len(TEXTS))] == [t[1] for t in TEXTS]
    assert classifier.classified(texts, "id", "t", rules.limit(0)).collect() == []


@pytest.mark.parametrize("form", ["larkspur_csv", "larkspur_json"])
def test_batches_are_bounded_by_their_text(spark, formats, tmp_path, form):
    """A batch was 10,000 records, however long their texts; and a CSV field of over 131,072 characters could not be read."""
    from pyspark.sql.types import _parse_datatype_string

    schema = "id long, s string, at timestamp"
    df = spark.range(40).select("id", F.repeat(F.lit("ü"), F.when(F.col("id") == 7, 3_000_000).otherwise(200_000)).alias("s"), F.timestamp_seconds("id").alias("at"))
    df.coalesce(1).write.format(form).mode("append").save(str(tmp_path / "x"))
    back = spark.read.format(form).schema(schema).load(str(tmp_path / "x"))
    assert sorted((r.id, r.n, r.t) for r in back.select("id", F.length("s").alias("n"), F.unix_seconds("at").alias("t")).collect()) == [(i, 3_000_000 if i == 7 else 200_000, i) for i in range(40)]
    reader = {"larkspur_csv": exchange.CsvReader, "larkspur_json": exchange.JsonReader}[form](_parse_datatype_string(schema), {"path": str(tmp_path / "x")})
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert sum(b.num_rows for b in batches) == 40 and max(b.num_rows for b in batches) <= 11


def test_json_keeps_odd_texts(spark, tmp_path):
    """An empty text came back as null."""
    import duckdb

    from larkspur.plans import registry

    registry.load()
    texts = ["", None, " ", "null", "\x00", "a\x85b\u2028c\x1cd\x0ce\r\nf\rg", "\ufeffx", "],", "}", "\\n\"", "e\u0301 \U0001f600", "0", "NaN"]
    docs = [(i, x, lang, 0 if x is None else len(x)) for lang in ("en", "", None, "fr") for i, x in enumerate(texts, {"en": 0, "": 20, None: 40, "fr": 60}[lang])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(80).select(F.col("id").alias("o_orderkey"), F.lit("2026-05-01").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for name in ("documents", "orders"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    df = registry.QUERIES["s15_json_there_and_back"](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(df.columns)} from ({registry.ORACLES['s15_json_there_and_back']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want, key=lambda r: r[0]) and len(want) == len(texts)
