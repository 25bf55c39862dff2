"""Competing names, values and claims against plain Python, and pairs of one page."""

import datetime
import random

from pyspark.sql import functions as F

from larkspur.functions.scratch import written
from larkspur.operators import decisions as O
from larkspur.operators import scoring as P

D = datetime.date


def test_names_are_those_of_the_sequential_pass(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.randrange(5), *(rnd.choice([*"abcdefgh", None, ""]) if rnd.random() < 0.8 else f"n{i}" for _ in range(3))) for i in range(60)] + [(60, 9, None, "", None), (61, 9, None, None, None)]
    want, taken = {}, set()
    for k, _, *names in sorted(rows, key=lambda r: (r[1], r[0])):
        listed = list(dict.fromkeys(n for n in names if n))
        kept = [n for n in names if n]
        listed.append(f"{kept[-1]}-{k}" if kept else str(k))
        want[k] = next((n for n in listed if n not in taken), listed[-1])
        taken.add(want[k])
    df = spark.createDataFrame(rows, "k long, r long, a string, b string, c string")
    got = {r.k: r["name"] for r in O.assigned_names(df, "k", ["r"], [F.col("a"), F.col("b"), F.col("c")]).collect()}
    assert got == want and len(set(got.values())) == len(rows)


def test_fenced_finishes(spark):
    tasks = spark.createDataFrame([(1, 7, "p", 10), (2, 7, None, 10)], "key long, token long, payload string, lease_until long")
    rows = [(1, 7, "p", 11, "lease"), (1, 8, "p", 3, "token"), (1, 7, "q", 3, "payload"), (1, 7, "p", 5, "finished"), (1, 7, "p", 6, "done"), (2, 7, None, 10, "finished"), (2, 7, "p", 1, "payload"), (3, 7, "p", 1, "unknown")]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i long, key long, claim_token long, claim_payload string, at long")
    assert [r.outcome for r in O.fenced(tasks, df, "key", ["at", "i"]).orderBy("i").collect()] == [r[4] for r in rows]


def test_preferred_and_combined(spark):
    facts = [(1, "x", False, True, D(2026, 1, 9), 1), (1, "y", True, False, D(2025, 1, 1), 2), (1, None, True, True, D(2026, 1, 9), 3), (2, "g", True, False, D(2026, 1, 9), 4), (2, "s", True, True, D(2025, 1, 9), 5), (3, "new", False, False, D(2026, 1, 9), 6), (3, "old", False, False, D(2026, 1, 8), 7), (4, None, True, True, D(2026, 1, 1), 8)]
    df = spark.createDataFrame(facts, "k long, v string, o boolean, s boolean, at date, i long")
    assert {tuple(r) for r in O.preferred(df, ["k"], "v", "o", "s", "at", "i").collect()} == {(1, "y", True), (2, "s", True), (3, "new", False)}
    a = spark.createDataFrame([(1, "a", None), (2, "b", "m"), (2, "c", "n"), (None, "d", None)], "k long, x string, y string")
    b = spark.createDataFrame([(1, "z", "q"), (2, "e", "r"), (3, "f", None), (None, "g", "t")], "k long, x string, y string")
    want = {(1, "a", "q", "both"), (2, "b", "m", "first"), (2, "c", "n", "first"), (None, "d", None, "first"), (2, "e", "r", "second"), (3, "f", None, "second"), (None, "g", "t", "second")}
    assert {tuple(r) for r in O.combined(a, b, ["k"], ["x", "y"]).collect()} == want


def test_gated_proposals(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, -1), (1, 4, 99), (2, 1, 99)], "k long, n long, v long")
    got = {(r.k, r.n): (r.decision, r.reason) for r in O.gated(df, ["k"], ["n"], {"negative": F.col("v") < 0}, {"large": F.col("v") > 50}).collect()}
    assert got == {(1, 1): ("supersede", "newer_proposal"), (1, 2): ("apply", "newest"), (1, 3): ("reject", "negative"), (1, 4): ("hold", "large"), (2, 1): ("hold", "large")}


def test_retry_waits(spark):
    df = spark.range(0, 40).select("id", F.explode(F.array(*map(F.lit, range(8)))).alias("n"), F.explode(F.array(*map(F.lit, (200, 404, 408, 425, 429, 500, 599, 600)))).alias("status"))
    rows = df.withColumn("w", O.retry_wait(F.col("status"), F.col("n"), F.col("id"))).collect()
    assert {r.status for r in rows if r.w is not None} == {408, 425, 429, 500, 599}
    assert all(min(500 * 2**r.n, 12000) // 2 <= r.w < min(500 * 2**r.n, 12000) for r in rows if r.w is not None)
    assert len({r.w for r in rows if r.n == 3 and r.status == 429}) > 20


def test_pairs_of_one_page(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["Loop", "Loop run", "Night"]), D(2026, 1, 1) + datetime.timedelta(rnd.randrange(20)), [f"https://x.example/{p}" for p in rnd.sample("abc", rnd.choice([0, 1, 2]))]) for i in range(60)]
    df = spark.createDataFrame([(i, n, d, None, None, None, None, None, None, None, u, None) for i, n, d, u in rows], "id long, name string, start date, end date, country string, lat double, lng double, place string, series string, fingerprint string, urls array<string>, disciplines array<string>")
    got = sorted(tuple(r) for r in P.same_page(written(P.described(df, P.Rules()), "described")).collect())
    want = [(a[0], b[0], abs((a[2] - b[2]).days)) for i, a in enumerate(rows) for b in rows[i + 1 :] if set(a[3]) & set(b[3]) and abs((a[2] - b[2]).days) <= 2 and (a[2] == b[2] or a[1] == b[1])]
    assert got == sorted(want) and len(got) > 20
