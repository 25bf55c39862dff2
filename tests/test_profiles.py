"""Kinds, birth years, ranks, gates, states, identities and siblings on fixed cases and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import profiles as P

KINDS = P.Kinds(
    family={"xc": "off", "marathon": "off", "line": "on", "hill": "on", "stone": "mixed"}, same={"cross country": "xc", "crit": "line"},
    doubtful={"marathon": (("on", "mixed"), ("xc",))}, strong=(("off", ("xc",)), ("mixed", ())),
)


@pytest.mark.parametrize(
    ("values", "kinds", "leading"),
    [
        (["Cross Country", "xc", " XC "], ["xc"], "off"),
        (["marathon", "line"], ["line"], "on"),
        (["marathon", "line", "xc"], ["marathon", "xc", "line"], "off"),
        (["marathon"], ["marathon"], "off"),
        (["line", "stone", "marathon"], ["stone", "line"], "mixed"),
        (["hill", None, "unheard", "crit"], ["hill", "line"], "on"),
        (["unheard"], [], None),
        ([], [], None),
        (None, [], None),
    ],
)
def test_canonical_kinds(spark, values, kinds, leading):
    got = P.canonical_kinds(spark.createDataFrame([(1, values)], "k long, v array<string>"), "v", KINDS).first()
    assert (got.kinds, got.leading) == (kinds, leading)


BORN = [
    ("2019-2020", 2019, 2020), ("2014/2013", 2013, 2014), ("<= 2008", None, 2008), ("2008 a starší", None, 2008), ("1998 and younger", 1998, None), (">=2001", 2001, None), ("2011", 2011, 2011),
    ("2011 older or younger", None, None), ("40-49 Jahre", 1977, 1986), ("do 15 lat", 2011, None), ("60 a více let", None, 1966), ("60+", None, 1966), ("over 18", None, 2008), ("12 years", 2014, 2014),
    ("U13", 2014, 2015), ("WU-15", 2012, 2013), ("U2", None, None), ("49-40", None, None), ("over 20 under 30", 1996, 2006), ("men", None, None), ("2011 12 let", None, None), ("7", None, None),
    ("120 years", None, None), ("0-5", None, None), ("2001 2002 2003", None, None), ("99999999999999", None, None), ("max 12 min", None, None), ("", None, None), (None, None, None),
]


def test_birth_years(spark):
    rows = P.with_birth_years(spark.createDataFrame([(i, b[0]) for i, b in enumerate(BORN)], "i long, said string").withColumn("season", F.lit(2026)), "said", "season")
    got = {r.said: (r.born_from, r.born_to) for r in rows.collect()}
    assert got == {s: (a, b) for s, a, b in BORN} and rows.columns == ["i", "said", "season", "born_from", "born_to"]
    label = P.with_birth_years(spark.createDataFrame([("Cup 2027",), ("2010-2011",), ("2009 younger",)], "said string").withColumn("season", F.lit(2026)), "said", "season", F.lit(True))
    assert [(r.born_from, r.born_to) for r in label.collect()] == [(None, None), (2010, 2011), (2009, None)]


def test_admitted_years(spark):
    rows = spark.createDataFrame([(2000, 2002), (None, 1901), (2098, None), (None, None), (2005, 2001), (1800, 1850)], "a int, b int")
    assert [r.y for r in rows.select(P.admitted_years(F.col("a"), F.col("b")).alias("y")).collect()] == [[2000, 2001, 2002], [1900, 1901], [2098, 2099], [], [], []]


def test_match_rank(spark):
    rows = [(["a"], "explicit", 0), (["a"], "previous", 1), (["a"], "guessed", 2), (["a"], None, 2), (["all"], "explicit", 2), (["z"], "explicit", 4), ([], "explicit", 3), (None, None, 3), ([None], "explicit", 4)]
    df = spark.createDataFrame(rows, "c array<string>, s string, want int").withColumn("rank", F.coalesce(P.match_rank(F.col("c"), F.col("s"), ["a", "b"], {"a": ["all"]}), F.lit(4)))
    assert [r["rank"] for r in df.collect()] == [r[2] for r in rows]


def test_gate(spark):
    signs = [("hall", P.Sign(runs=("ball game",))), ("multi", P.Sign(stems=("triath",))), ("kept", P.Sign(words=("bike", "rad"))), ("other", P.Sign(words=("run",))), ("none", P.Sign())]
    texts = {"Ball-Game on a bike": "hall", "Triathlon with bike": "multi", "RÁD und run": "kept", "a run": "other", "runs, bikes": "open", "tri athlon": "open", "": "open", "ball  game": "hall", "football game": "open"}
    got = {r.t: r.gate for r in P.gated_texts(spark.createDataFrame([*((t,) for t in texts), (None,)], "t string"), "t", signs, "open").collect()}
    assert got == {**texts, None: "open"}


def test_assessed(spark):
    df = spark.createDataFrame([(True, False, None), (False, True, True), (False, None, False)], "a boolean, b boolean, c boolean")
    got = P.assessed(df, {"far": F.col("a"), "thin": F.col("b"), "tbc": F.col("c")}, ("far",), "tbc").collect()
    assert [(r.state, r.date_status, r.issues) for r in got] == [("out_of_scope", "requires_verification", ["far"]), ("needs_review", "tentative", ["thin", "tbc"]), ("ready", "requires_verification", [])]


def test_source_state(spark):
    rules = [("deferred", "(budget|chunk_limit)"), ("unreadable", "^(too_large|no_text)"), ("review", "identity_review")]
    rows = [("fine", "budget", "ok"), (None, None, "ok"), ("error", "LLM budget of", "deferred"), ("error", "no_text x", "unreadable"), ("error", "x no_text", "broken"), ("error", "identity_review", "review"), ("needs_review", None, "review"), ("error", None, "broken"), ("needs_review", "", "broken")]
    df = spark.createDataFrame(rows, "s string, e string, want string")
    got = df.select("want", P.source_state(F.col("s"), F.col("e"), ("error", "needs_review"), rules, "needs_review").alias("got")).collect()
    assert [r.got for r in got] == [r[2] for r in rows]


def test_identity(spark):
    aliases = [(r"\b(?:world cup|wc)\b", "series:wc"), (r"\bcup\b", "series:cup")]
    names = {"World Cup Åre 2026": "series:wc are", "12. WC": "series:wc", "Cup of Lund (World Cup)": "series:wc series:cup lund", "wc cup wc": "series:wc series:cup", "2026": "", "Lund": "lund"}
    got = {r.n: r.identity for r in P.identity(spark.createDataFrame([*((n,) for n in names), (None,)], "n string"), "n", aliases, [r"\b[0-9]{1,2}\. *", r"\b20[0-9]{2}\b", r"\bof\b"]).collect()}
    assert got == {**names, None: ""}


def test_siblings(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["hot"] * 30 + [None, *(f"h{j}" for j in range(40))])) for i in range(150)]
    by = {}
    for k, h in rows:
        by.setdefault(h, []).append(k)
    want = {(k, h): [x for x in by[h] if x != k] for k, h in rows if h is not None and 2 <= len(by[h]) <= 20}
    got = {(r.k, r.h): r.others for r in P.siblings(spark.createDataFrame(rows, "k long, h string"), "h", "k").collect()}
    assert got == want and len(by["hot"]) > 20
