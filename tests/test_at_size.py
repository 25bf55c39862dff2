"""What keeps joins small on large tables: no side that was multiplied is broadcast, no list of all near pairs is made."""

import random

from pyspark.sql import functions as F

from larkspur.operators import greedy as G
from larkspur.operators import joins as J
from larkspur.plans import registry

registry.load()
FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString()


def test_day_blocks_broadcast_nothing(spark):
    rows = spark.createDataFrame([(1, 1, "2026-01-01", "2026-01-20"), (2, 1, "2026-01-13", "2026-01-13"), (3, 1, "2026-01-14", "2026-01-15"), (4, 2, "2026-01-01", "2026-01-02")], "id long, who long, start string, end string")
    out = J.day_blocks(rows.withColumns({c: F.to_date(c) for c in ("start", "end")}), "id", "start", "end", ["who"])
    assert "Broadcast" not in plan(out)[1]
    assert sorted(map(tuple, out.collect())) == [(1, 2), (2, 3)]


def test_categories_list_years_of_distinct_spans(spark):
    text = plan(registry.QUERIES["c42_riders_by_category"](spark, FOLDER))[0]
    assert "Aggregate [born_from" in text.split("Generate", 1)[1]


def test_subscriptions_join_on_all_keys(spark):
    text = plan(registry.QUERIES["j17_subscription_match"](spark, FOLDER))[1]
    assert "SortMergeJoin [k#" in text and " m#" in text.split("SortMergeJoin", 1)[1].split("]")[0]


def test_crowded_markers_need_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(G, "near_in_plane", lambda *a: 1 / 0)
    r = random.Random(5)
    points = [(i, r.random() * 30, r.random() * 300) for i in range(600)] + [(600, None, 1.0)]
    got = {x["id"]: x["leader"] for x in G.followers_in_plane(spark.createDataFrame(points, "id long, x double, y double"), -F.col("id") % 7, 48.0, "id", "x", "y").collect()}
    G.grouped_markers(spark.createDataFrame([(1, 1.0, 1.0)], "id long, lat double, lng double"), "id", F.lit(0)).collect()
    leaders, want = [], {600: 600}
    for i, x, y in sorted(points[:600], key=lambda p: (-(p[0] % 7), p[0])):
        lead = next((k for k, a, b in leaders if abs(a - x) < 48 and abs(b - y) < 48), i)
        leaders += [(i, x, y)] if lead == i else []
        want[i] = lead
    assert got == want


def test_boxes_meet_by_places(spark):
    r = random.Random(6)
    rows = [(i, r.randint(0, 8) * 1.5, r.randint(-4, 4) * 2.25) for i in range(120)] + [(120, None, 0.0)]
    got = sorted(map(tuple, J.within_box(spark.createDataFrame(rows, "k long, lat double, lng double"), "k", 3.5, 4.5).collect()))
    assert got == sorted((a, b) for a, p, q in rows[:120] for b, s, t in rows[:120] if a < b and abs(p - s) <= 3.5 and abs(q - t) <= 4.5)


def test_search_broadcasts_no_forms(spark):
    from larkspur.operators import search as S

    tokens, words = spark.createDataFrame([("lakeside",), ("lop",)], "token string"), spark.createDataFrame([("lakeside",), ("lakesid",), ("loop",)], "word string")
    for out in (S.misspelt(tokens, words), S.containing(tokens, words.selectExpr("word", "left(word, 3) AS gram"))):
        assert "Broadcast" not in plan(out)[1]
    assert sorted(map(tuple, S.misspelt(tokens, words).collect())) == [("lakeside", "lakesid", 1), ("lakeside", "lakeside", 0)]


def test_candidates_carry_no_lists_of_keys(spark):
    from larkspur.operators import scoring as P

    rows = spark.createDataFrame([(i, "2026-05-09", 50.0, 14.0) for i in range(3)], "id long, d string, lat double, lng double")
    rows = rows.select("id", F.to_date("d").alias("low"), F.to_date("d").alias("high"), "lat", "lng", F.lit(True).alias("placed"), F.array(F.lit("p/q")).alias("pages"), F.array(F.lit("loop")).alias("words"), F.array(F.lit("lake")).alias("spots"))
    pairs = P.candidates(rows)
    assert " ka#" not in plan(pairs)[0]
    assert sorted(map(tuple, pairs.collect())) == [(0, 1), (0, 2), (1, 2)]


def test_runs_of_words_carry_no_texts(spark):
    """Each run was a row with its whole text, and Spark folds a text again for each mention in a filter that it puts before an explode."""
    text = plan(registry.QUERIES["e17_gazetteer_runs"](spark, FOLDER))[0]
    documents = text.split("Join Inner")[2]
    assert "posexplode" in documents and "slice" not in documents.split("posexplode")[0] and documents.split("Join")[0].split("Aggregate")[0].count("regexp_replace") == 1


def test_two_readers_are_read_once(spark):
    from larkspur.operators import decisions as O

    text = plan(registry.QUERIES["e11_two_readers"](spark, FOLDER))[0]
    assert text.count("Relation [") == 3 and text.count("Join") == 1
    a = [(1, "x", None), (2, "x", 5), (2, "y", 6), (None, "n", None), (4, "q", 1)]
    b = [(1, "z", 9), (2, "z", None), (None, "m", 3), (5, None, None), (5, None, 2)]
    got = O.combined(*(spark.createDataFrame(r, "k int, s string, v int") for r in (a, b)), ["k"], ["s", "v"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "x", 9, "both"), *((*r, "first") for r in a[1:]), *((*r, "second") for r in b[1:])], key=str)


def test_bytes_become_texts_slice_by_slice():
    """A whole batch was held as Python objects, bytes and texts both."""
    import pyarrow as pa

    from larkspur.sources import documents as D

    raw = [("ü" * i).encode("latin-1" if i % 2 else "utf-8") for i in range(150)] + [None]
    got = D.charset_text.func(pa.array(raw, pa.binary()), pa.array(["windows-1252"] * 100 + [None, "nonsense"] + ["latin-1"] * 49))
    assert isinstance(got, pa.Array) and got.to_pylist() == ["ü" * i for i in range(150)] + [None]


def test_misspelt_words_make_few_forms(spark):
    """A word was a row for each way to strike one or two letters from it, which grows with the square of its length."""
    from larkspur.operators import search as S

    r = random.Random(8)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    tokens = sorted({word(r.randint(3, 12)) for _ in range(60)})
    words = {word(r.randint(1, 16)) for _ in range(300)} | {t[:i] + x + t[j:] + y for t in tokens for i, j, x, y in ((2, 3, "", ""), (4, 4, "ab", "c"), (1, 3, "", "bb"), (len(t), len(t), "c", ""))}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = []
    for t in tokens:
        k = 0 if len(t) < 4 else 1 if len(t) < 8 else 2
        for w in words if k else ():
            d = min(distance(t, w), distance(t, w[: len(t)]))
            want += [(t, w, d)] if d <= k else []
    frame = lambda c, values: spark.createDataFrame([(v,) for v in values], f"{c} string")
    assert sorted(map(tuple, S.misspelt(frame("token", tokens), frame("word", sorted(words))).collect())) == sorted(want)
    long = frame("spelt", ["abcdefghijklmnopqrstuvwxyz"]).withColumn("size", F.length("spelt"))
    assert S._forms(long, "spelt", True).count() == 11
