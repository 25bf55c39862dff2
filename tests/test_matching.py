"""The pair scorer's gates and points, greedy folds and admission against plain Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions.scratch import written
from larkspur.operators import admission as A
from larkspur.operators import greedy as G
from larkspur.operators import scoring as P

RULES = P.Rules(
    generic=("race", "event"), aliases=(("hills", " hills cup "), ("coast", " coast cup ")), formats=(("sprint", " sprint "), ("marathon", " marathon ")), families=(("trail", "off road"), ("forest", "off road")),
    regions=("utopia", "north coast"), aside=" spectator trip ", weak=" class [0-9] ",
)
D = datetime.date
BASE = {"name": "Lakeside Loop", "start": D(2026, 5, 9), "end": None, "country": "UT", "lat": 50.0, "lng": 14.0, "place": "Lakeside", "series": None, "fingerprint": None, "urls": [], "disciplines": ["trail"]}
SCHEMA = "id long, name string, start date, end date, country string, lat double, lng double, place string, series string, fingerprint string, urls array<string>, disciplines array<string>"
PAGE = {"urls": ["https://www.lake.example/loop/?from=x"]}
AWAY = {"lat": 51.0, "lng": 14.0, "place": "Hilltop"}
CASES = [  # what the two records change, score, reasons
    ({}, {}, 68, "same_day same_place same_canonical_name same_discipline"),
    ({"name": "Spectator trip Lakeside Loop"}, {}, 0, "format_conflict"),
    (PAGE, PAGE | {"start": D(2025, 5, 9)}, 0, "edition_conflict"),
    ({"country": "XX"}, {}, 0, "country_conflict"),
    ({"name": "Lakeside Sprint"}, {"name": "Lakeside Marathon"}, 0, "format_conflict"),
    ({"disciplines": ["road"]}, {}, 0, "discipline_conflict"),
    ({"disciplines": ["forest"]}, {}, 68, "same_day same_place same_canonical_name same_discipline"),
    ({"name": "Lakeside Loop round 2"}, {"name": "Lakeside Loop stage 3"}, 0, "round_conflict"),
    ({"name": "Lakeside Loop women"}, {"name": "Lakeside Loop men"}, 0, "gender_conflict"),
    ({"series": "Hills Cup"}, {"name": "Coast Cup Lakeside"}, 0, "series_conflict"),
    ({"fingerprint": "f"}, {"fingerprint": "f", "name": "Something else"}, 100, "fingerprint"),
    ({"fingerprint": "f", **PAGE}, {"fingerprint": "f", **PAGE, "start": D(2026, 6, 20)}, 95, "same_url same_place same_canonical_name"),
    (PAGE, PAGE | AWAY | {"start": D(2026, 5, 30)}, 0, "same_url_other_race"),
    (PAGE, PAGE | {"start": D(2026, 5, 12)}, 100, "same_url dates_near same_place same_canonical_name"),
    (PAGE, {"urls": ["http://lake.example/loop"], "name": "Another thing"}, 87, "same_url dates_ok same_place same_discipline"),
    ({}, {"start": D(2026, 5, 10)}, 62, "weekend same_place same_canonical_name"),
    ({"end": D(2026, 5, 11)}, {"start": D(2026, 5, 12)}, 62, "weekend same_place same_canonical_name"),
    ({"name": "Lakeside Lopp"}, {}, 66, "same_day same_place name_sim_high same_discipline"),
    ({"name": "Hills Cup Lakeside"}, {"name": "Grand final", "series": "Hills Cup"}, 64, "same_day same_place series_alias same_discipline"),
    ({"name": "Class 1"}, {"name": "Class 1 Lakeside Loop"}, 74, "same_day same_place name_sim_low weak_name_absorbed same_discipline name_substring"),
    ({"name": "Lakeside"}, {"name": "Lakeside sprint"}, 78, "same_day same_place name_sim_mid venue_format_mirror same_discipline name_substring"),
    ({"name": "National championship of Utopia"}, {"name": "Mistrovství: national championships"}, 76, "same_day same_place name_sim_mid national_championship_mirror same_discipline"),
    ({"name": "Round 4 of a thing"}, {"name": "Other words leg 4"}, 54, "same_day same_place same_round same_discipline"),
    ({"place": "Utopia", "lat": None, "lng": None}, AWAY, 68, "place_unknown_same_weekend same_day same_place same_canonical_name same_discipline"),
    ({"lat": None, "lng": None}, {"lat": None, "lng": None, "place": "By the Lakeside, Utopia"}, 68, "same_day same_place same_canonical_name same_discipline"),
    ({}, AWAY, 46, "same_day same_canonical_name needs_place_or_url"),
]


def record(i, change):
    r = BASE | change
    return (i, *(r[c] for c in ("name", "start", "end", "country", "lat", "lng", "place", "series", "fingerprint", "urls", "disciplines")))


def test_gates_and_points(spark):
    rows = [record(2 * i + k, change) for i, case in enumerate(CASES) for k, change in enumerate(case[:2])]
    known = written(P.described(spark.createDataFrame(rows, SCHEMA), RULES), "described")
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(len(CASES))], "a long, b long")
    got = {r.a // 2: (r.score, " ".join(r.reasons)) for r in P.scored(pairs, known).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[2:] for c in CASES]
    turned = P.scored(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), known).collect()
    assert {(r.a // 2, r.score, " ".join(r.reasons)) for r in turned} == {(i, *v) for i, v in got.items()}
    assert {r for _, _, _, said in CASES for r in said.split()} >= set(P.GATES) - {"dates_too_far"}


def test_candidates_are_all_and_once(spark):
    """Random records, near the date line and a pole too: the pairs of the definition, each once."""
    rnd = random.Random(9)
    spots = [(50.0, 14.0), (50.2, 14.1), (10.0, 179.95), (10.0, -179.9), (89.95, 0.0), (89.9, 180.0), (-0.1, 0.0), (70.0, 25.0), (70.01, 25.6), (None, None)]
    rows = []
    for i in range(260):
        lat, lng = rnd.choice(spots)
        if lat is not None:
            lat, lng = min(90.0, lat + rnd.uniform(-0.2, 0.2)), lng + rnd.uniform(-0.3, 0.3)
            lng = (lng + 180) % 360 - 180
        day = D(2026, 3, 1) + datetime.timedelta(rnd.randrange(40))
        urls = [f"https://x.example/{rnd.randrange(60)}"] if rnd.random() < 0.3 else None
        rows.append((i, f"common word{rnd.randrange(90)}", day, day + datetime.timedelta(rnd.choice([0, 0, 3])), None, lat, lng, None, None, None, urls, None))
    known = written(P.described(spark.createDataFrame(rows, SCHEMA), P.Rules()), "described")
    got = sorted(tuple(r) for r in P.candidates(known, rare=5).collect())
    count = {}
    for r in rows:
        for w in set(r[1].split()):
            count[w] = count.get(w, 0) + 1

    def km(a, b):
        import math

        p, q = (tuple(map(math.radians, (x[5], x[6]))) for x in (a, b))
        return 2 * 6371 * math.asin(math.sqrt(min(1, math.sin((q[0] - p[0]) / 2) ** 2 + math.cos(p[0]) * math.cos(q[0]) * math.sin((q[1] - p[1]) / 2) ** 2)))

    def meet(a, b):
        if a[10] and a[10] == b[10]:
            return True
        if (b[2] - a[3]).days > 1 or (a[2] - b[3]).days > 1:
            return False
        return (a[5] is not None and b[5] is not None and km(a, b) <= 25) or any(count[w] <= 5 for w in set(a[1].split()) & set(b[1].split()))

    assert got == [(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if meet(a, b)]


def greedy(order, near):
    leaders, out = [], {}
    for n in order:
        out[n] = next((x for x in leaders if (x, n) in near or (n, x) in near), n)
        if out[n] == n:
            leaders.append(n)
    return out


@pytest.mark.parametrize("shape", ["chain", "star", "random", "ties"])
def test_followers_are_those_of_the_greedy_fold(spark, shape):
    rnd = random.Random(shape)
    n = 30 if shape != "random" else 120
    near = {(i, i + 1) for i in range(n - 1)} if shape == "chain" else {(0, i) for i in range(1, n)} if shape == "star" else {(rnd.randrange(n), rnd.randrange(n)) for _ in range(2 * n)}
    rank = [rnd.randrange(4 if shape == "ties" else 10**6) for _ in range(n)]
    nodes = spark.createDataFrame([(i, r) for i, r in enumerate(rank)], "node long, r long")
    got = {r.node: r.leader for r in G.followers(nodes, spark.createDataFrame(list(near), "a long, b long"), F.col("r")).collect()}
    assert got == greedy(sorted(range(n), key=lambda i: (rank[i], i)), near)


def test_followers_without_links(spark):
    nodes = spark.createDataFrame([(1, 5), (2, 4)], "node long, r long")
    assert {tuple(r) for r in G.followers(nodes, spark.createDataFrame([(1, 1)], "a long, b long"), F.col("r")).collect()} == {(1, 1), (2, 2)}
    assert G.followers(nodes.limit(0), spark.createDataFrame([], "a long, b long"), F.col("r")).collect() == []


@pytest.mark.parametrize("wide", [100.0, 600.0, 4000.0])
def test_near_in_plane(spark, wide):
    rnd = random.Random(int(wide))
    rows = [(i, rnd.uniform(-wide, wide), rnd.uniform(-wide, wide)) for i in range(150)] + [(150, None, 1.0), (151, float("nan"), 0.0), (152, 48.0, 0.0), (153, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    want = {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if None not in (a[1], b[1]) and abs(a[1] - b[1]) < 48 and abs(a[2] - b[2]) < 48}
    assert {tuple(r) for r in G.near_in_plane(df, "k", "x", "y", 48.0).collect()} == want and (152, 153) not in want


def brute_admission(rows, limits):
    out, held, until = {}, {}, {}
    month = lambda s: datetime.datetime.fromtimestamp(s, datetime.UTC).strftime("%Y%m")
    for i, key, s, u, status in sorted(rows, key=lambda r: (r[2], r[0])):
        mine = held.setdefault(key, [])
        why = "backoff" if s < until.get(key, 0) else ""
        if not why:
            for k, (name, back) in enumerate((("minute", 60), ("hour", 3600), ("day", 86400), ("month", None))):
                used = [x for x in mine if (x[0] >= (s - back) // 60 * 60 if back else month(x[0]) == month(s))]
                if limits.requests[k] is not None and len(used) + 1 > limits.requests[k]:
                    why = f"{name}_requests"
                elif limits.units[k] is not None and sum(x[1] for x in used) + (u or 0) > limits.units[k]:
                    why = f"{name}_units"
                if why:
                    break
        if not why:
            mine.append((s, u or 0))
            wait = {429: 21600, 0: 600}.get(status, 600 if status is not None and 500 <= status < 600 else None)
            until[key] = s + wait if wait else until.get(key, 0)
        out[i] = why
    return out


def test_admission(spark):
    """A hot key, months that begin anew, waits after failures, ties, null units and a null key; small batches carry the state on."""
    rnd = random.Random(6)
    begin = int(datetime.datetime(2026, 1, 28, tzinfo=datetime.UTC).timestamp())
    rows = [(i, rnd.choice(["hot"] * 5 + ["b", None]), begin + int(rnd.random() ** 2 * 9 * 86400) // 7 * 7, rnd.choice([1, 2, 30, None]), rnd.choice([200] * 60 + [429, 0, 503, None])) for i in range(1500)]
    limits = A.Limits(requests=(3, 20, 150, 400), units=(50, 200, None, 3000))
    df = spark.createDataFrame(rows, "id long, key string, s long, u long, status int").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r.id: r.refused for r in A.admitted(df, "key", "s", "id", "u", limits, "status").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_admission(rows, limits)
    assert len(set(got.values())) >= 6
    free = A.admitted(df.limit(0), "key", "s", "id", "u", limits)
    assert free.columns == ["id", "key", "s", "u", "status", "refused"] and free.collect() == []


def test_budget(spark):
    """Refused reservations use nothing up, settling frees or uses more, once; days and months begin anew."""
    day = lambda m, d: int(datetime.datetime(2026, m, d, 12, tzinfo=datetime.UTC).timestamp())
    ops = [  # second, charge, amount, settles, what comes of it
        (day(1, 30), 1, 60, False, ""), (day(1, 30) + 1, 2, 50, False, "day"), (day(1, 30) + 2, 3, 40, False, ""), (day(1, 30) + 3, 4, 1, False, "day"),
        (day(1, 30) + 4, 1, 10, True, ""), (day(1, 30) + 5, 1, 0, True, "unknown"), (day(1, 30) + 6, 4, 50, False, ""), (day(1, 30) + 7, 2, 5, True, "unknown"),
        (day(1, 31), 5, 95, False, "invalid"), (day(1, 31), 6, 90, False, ""), (day(1, 31) + 1, 7, 0, False, "invalid"), (day(1, 31) + 2, 8, 10, False, ""), (day(1, 31) + 3, 6, -1, True, "invalid"), (day(1, 31) + 4, 6, 120, True, ""),
        (day(2, 1), 9, 90, False, ""), (day(2, 1) + 1, 6, 1, True, "unknown"), (day(2, 2), 10, 90, False, ""), (day(2, 3), 11, 90, False, "month"), (day(2, 3) + 1, 12, 60, False, ""),
    ]
    df = spark.createDataFrame([(i, k, *op[:4]) for k in ("x", "y") for i, op in enumerate(ops)], "i long, key string, s long, charge long, amount long, settles boolean")
    got = A.charged(df, "key", "s", "i", A.Budget(per_day=100, per_month=240, most=90)).collect()
    assert sorted((r.key, r.i, r.refused) for r in got) == sorted((k, i, op[4]) for k in ("x", "y") for i, op in enumerate(ops))
