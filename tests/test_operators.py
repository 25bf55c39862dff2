"""Operators on small made-up rows: edges that the tables don't hold."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from larkspur.functions import geo, text
from larkspur.operators import entities, filters, ingest, joins, rollups
from larkspur.sources import documents

D = datetime.date


def days(spark, rows):
    return spark.createDataFrame(rows, "id long, start date, end date")


def test_interval_overlap_is_the_theta_join(spark):
    rows = [(i, D(2024, 1, 1) + datetime.timedelta(days=i * 3 % 50), D(2024, 1, 1) + datetime.timedelta(days=i * 3 % 50 + i % 23)) for i in range(60)]
    rows.append((99, D(2024, 2, 9), D(2024, 1, 30)))  # turned round
    df = days(spark, rows)
    got = {(r.l_id, r.r_id) for r in joins.interval_overlap(df, df, days=5).select("l_id", "r_id").collect()}
    spans = {i: (min(a, b), max(a, b)) for i, a, b in rows}
    assert got == {(x, y) for x in spans for y in spans if spans[x][0] <= spans[y][1] and spans[y][0] <= spans[x][1]}


def test_interval_overlap_has_each_pair_once_and_no_theta_plan(spark):
    df = days(spark, [(1, D(2024, 1, 1), D(2024, 3, 1)), (2, D(2024, 1, 2), D(2024, 2, 28))])
    out = joins.interval_overlap(df, df, days=3)
    assert out.count() == 4
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("gap", [0, 3, 9])
def test_spans_near_is_the_theta_join(spark, gap):
    rows = [(i, D(2024, 1, 1) + datetime.timedelta(days=i * 7 % 90), D(2024, 1, 1) + datetime.timedelta(days=i * 7 % 90 + i % 11)) for i in range(50)]
    rows += [(99, D(2024, 2, 9), D(2024, 1, 30)), (100, None, D(2024, 1, 5)), (101, D(1969, 12, 30), D(1970, 1, 2))]
    df = days(spark, rows)
    near = joins.dates_compatible(F.col("x.start"), F.col("x.end"), F.col("y.start"), F.col("y.end"), gap)
    want = {(r[0], r[1]) for r in df.alias("x").join(df.alias("y"), near).select("x.id", "y.id").collect()}
    out = joins.spans_near(df, df, gap, days=6)
    got = [(r.l_id, r.r_id) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    held = {r.l_id: (r.l_start, r.l_end) for r in out.collect()}
    assert held[99] == (D(2024, 2, 9), D(2024, 1, 30))
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("km", "step"), [(150, 1.5), (40, 7.0), (900, 2.0)])
def test_within_km_is_the_theta_join_at_any_latitude(spark, km, step):
    rows = [(i, 64.9 + i % 7 * 0.02, i * 0.29 - 5) for i in range(80)]
    rows += [(100 + i, (-1) ** i * (89.9 - i * 0.7), i * 47.0 % 360 - 180) for i in range(20)] + [(200, 64.0, 179.9), (201, 64.0, -179.9), (202, 0.0, -180.0), (203, 0.0, 180.0), (204, None, 1.0), (205, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, lat double, lng double")
    out = joins.within_km(df, df, km, step=step)
    got = [(r.l_id, r.r_id) for r in out.select("l_id", "r_id").collect()]

    def far(a, b):
        p, x, q, y = map(math.radians, (*a[1:], *b[1:]))
        return 2 * 6371 * math.asin(min(1, math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((y - x) / 2) ** 2)))

    known = [r for r in rows if None not in r]
    assert sorted(got) == sorted((a[0], b[0]) for a in known for b in known if far(a, b) <= km)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_polygon_and_box(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5), (3, None, 0.5)], "id long, lat double, lng double")
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    assert [r.id for r in df.where(filters.in_polygon("lat", "lng", ring)).collect()] == [1]
    assert [r.id for r in df.where(filters.in_box("lat", "lng", 0, 0, 2, 2)).orderBy("id").collect()] == [1, 2]
    with pytest.raises(ValueError):
        filters.in_polygon("lat", "lng", ring[:2])


def test_overlap_with_nulls_is_false(spark):
    df = spark.createDataFrame([(1, ["a", None]), (2, [None]), (3, None), (4, [])], "id long, tags array<string>")
    got = {r.id: r.o for r in df.select("id", filters.overlaps("tags", ["a", "b"]).alias("o")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_three_valued(spark):
    df = spark.createDataFrame([(1, ["x"], False), (2, ["u"], False), (3, ["z"], False), (4, [], False), (5, None, False), (6, ["x"], True)], "id long, s array<string>, g boolean")
    got = [r.a for r in df.orderBy("id").select(filters.three_valued("s", ["x"], ["u"], F.col("g")).alias("a")).collect()]
    assert got == ["match", "possible", "no", "possible", "possible", "possible"]


def test_dice_counts_repeated_bigrams(spark):
    df = spark.createDataFrame([("aaaa", "aaa"), ("night", "nacht"), ("a", "a"), ("", "")], "x string, y string")
    assert [round(r.d, 4) for r in df.select(text.dice_of(text.numbered_bigrams("x"), text.numbered_bigrams("y")).alias("d")).collect()] == [0.8, 0.25, 0.0, 0.0]


def test_fold_and_slug(spark):
    df = spark.createDataFrame([("Čeští  Straße – Łódź!",)], "s string")
    r = df.select(text.fold("s").alias("f"), text.slug(F.col("s"), 12).alias("g"), text.has_word(text.padded("s"), "lodz").alias("h")).first()
    assert (r.f, r.g, r.h) == ("cesti strasse lodz", "cesti", True)


def test_url_key(spark):
    df = spark.createDataFrame([("https://WWW.Example.org/a/b/?utm=1#x",), ("nonsense",)], "u string")
    assert [r.k for r in df.select(text.url_key("u").alias("k")).collect()] == ["example.org/a/b", ""]


def test_haversine(spark):
    r = spark.range(1).select(geo.haversine(F.lit(50.0), F.lit(14.0), F.lit(48.0), F.lit(16.0)).alias("k"), geo.round_half_up(F.lit(-2.5)).alias("r")).first()
    assert abs(r.k - 266.0) < 2 and r.r == -2


def test_three_way_merge_conflicts(spark):
    make = lambda v: spark.createDataFrame(v, "k long, x long")
    out = joins.three_way(make([(1, 1), (2, 1), (3, 1)]), make([(1, 2), (2, 1), (3, 5)]), make([(1, 1), (2, 4), (3, 6)]), "k", ["x"])
    assert {r.k: (r.x, r.conflict) for r in out.collect()} == {1: (2, False), 2: (4, False), 3: (5, True)}


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t long")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y")], "k string, t long, v string")
    assert {(r.k, r.t): r.v for r in joins.as_of(left, right, "k", "t", "v").collect()} == {("a", 5): "y", ("a", 1): None, ("b", 9): None}


def test_snapshot_diff_and_upsert(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", None), (3, "z", 1)], "k long, s string, n long")
    b = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (4, "w", 1)], "k long, s string, n long")
    assert {(r.k, r.change, r.columns) for r in ingest.snapshot_diff(a, b, "k", ["s", "n"]).collect()} == {(2, "updated", "n"), (3, "deleted", ""), (4, "inserted", "")}
    assert ingest.upsert(a, b, "k").count() == 4
    assert {r.k: r.n for r in ingest.upsert(a, b, "k", overwrite=False).collect()} == {1: 1, 2: None, 3: 1, 4: 1}


def test_ladder(spark):
    df = spark.range(0, 5).select(ingest.ladder(F.col("id"), [10, 20, 30]).alias("w"))
    assert [r.w for r in df.collect()] == [None, 10, 20, 30, None]


def test_components_with_a_cycle_and_a_chain(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 101), (101, 102), (102, 100)], "a long, b long")
    got = {r.node: r.component for r in entities.components(pairs).collect()}
    assert got == {**dict.fromkeys(range(1, 31), 1), **dict.fromkeys((100, 101, 102), 100)}


def test_recheck_lets_go_of_indirect_members(spark):
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "node long, component long")
    links = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {r.node: r.component for r in entities.recheck(members, links).collect()} == {1: 1, 2: 1, 3: 3}


def test_coalesced_intervals_touching(spark):
    df = spark.createDataFrame([(1, D(2024, 1, 1), D(2024, 1, 3)), (1, D(2024, 1, 4), D(2024, 1, 5)), (1, D(2024, 1, 9), D(2024, 1, 9))], "k long, start date, end date")
    got = {(r.start, r.end, r.n) for r in rollups.coalesced_intervals(df, ["k"], "start", "end").collect()}
    assert got == {(D(2024, 1, 1), D(2024, 1, 5), 2), (D(2024, 1, 9), D(2024, 1, 9), 1)}


def test_json_ld_shapes(spark):
    s = '<script type="application/ld+json">{}</script>'
    one = '{"@type": "Event", "name": "A", "startDate": "2025-05-01", "location": {"name": "Lund"}}'
    pages = [(1, s.format(one)), (2, s.format(f"[{one}, {one}]")), (3, s.format('{"@graph": [' + one + ', {"@type": "Person", "name": "x"}]}')), (4, s.format("{broken")), (5, "<p>none</p>"), (6, s.format('{"@type": "Event", "name": "B", "startDate": "2025-06-01"}'))]
    got = documents.json_ld(spark.createDataFrame(pages, "page_id long, html string")).collect()
    assert sorted((r.page_id, r.name, r.confidence) for r in got) == [(1, "A", 0.85), (2, "A", 0.85), (2, "A", 0.85), (3, "A", 0.85), (6, "B", 0.7)]


def test_calendar_lines_fold_at_75_bytes(spark):
    df = spark.createDataFrame([(1, "é" * 100, D(2025, 1, 31))], "id long, name string, day date")
    ics = documents.calendar(df, "id", "name", "day", "day").first().ics
    lines = ics.split("\r\n")
    assert all(len(x.encode()) <= 75 for x in lines) and "DTEND;VALUE=DATE:20250201" in lines
    assert "".join(x[1:] if x.startswith(" ") else "\n" + x for x in lines).count("é") == 100


def test_semicolon_csv_checks_its_header(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('date;name\n2025-01-01;"a; ""b""\nc"\n')
    assert documents.semicolon_csv(spark, str(p), ["date", "name"]).first().name == 'a; "b"\nc'
    with pytest.raises(ValueError):
        documents.semicolon_csv(spark, str(p), ["name", "date"])


def test_charset_prefers_utf8(spark):
    df = spark.createDataFrame([("é".encode(), "windows-1250"), ("š".encode("windows-1250"), "windows-1250"), (b"\xe9", "no-such"), (None, None)], "b binary, l string")
    assert [r.t for r in df.select(documents.charset_text("b", "l").alias("t")).collect()] == ["é", "š", "é", None]


def test_held_items(spark):
    import random

    rnd = random.Random(11)
    docs = [(i, " ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 60)))) for i in range(40)] + [(90, None), (91, " \t\n"), (92, "a\tb\n c")]
    items = [(i, " ".join(rnd.choice("abcd") for _ in range(n))) for i, n in enumerate([1, 1, 2, 2, 3, 3, 4, 5, 5, 6, 7, 8, 9, 12])]
    items += [(50 + i, " ".join((docs[i][1] or "").split()[3 : 3 + n])) for i, n in enumerate([8, 9, 20, 40])] + [(70, None), (71, ""), (72, "a  b\nc"), (73, items[0][1]), (74, "ab")]
    pad = lambda x: f" {' '.join((x or '').split())} "
    want = {(i, d) for i, x in items for d, y in docs if pad(x).strip() and pad(x) in pad(y)}
    got = [tuple(r) for r in joins.held_items(spark.createDataFrame(docs, "d long, text string"), spark.createDataFrame(items, "i long, text string"), "d", "i").collect()]
    assert set(got) == want and len(got) == len(want) and {50, 51, 52, 72, 73} & {i for i, _ in want}
    assert joins.held_items(spark.createDataFrame(docs, "d long, text string"), spark.createDataFrame([(1, None)], "i long, text string"), "d", "i").collect() == []
