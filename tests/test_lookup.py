"""Search, places, logged merges and relation fingerprints on small made-up rows, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import fingerprint as D
from larkspur.operators import gazetteer, merges, search


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute_search(rows, q):
    tokens = sorted(set(q.split()))
    if not tokens:
        return {}
    hit = {i: 1.0 for i, t in rows if t and all(any(k in w for w in t.split()) for k in tokens)}
    if hit:
        return {i: (s, False) for i, s in hit.items()}
    if not any(len(k) >= 4 for k in tokens):
        return {}
    out = {}
    for i, t in rows:
        words, ds = set((t or "").split()), []
        for k in tokens:
            allowed = 0 if len(k) < 4 else 1 if len(k) < 8 else 2
            d = 0 if any(k in w for w in words) else min((min(distance(k, w), distance(k, w[: len(k)])) for w in words), default=99) if allowed else 99
            ds.append((d, len(k), d <= allowed))
        if words and all(ok for *_, ok in ds):
            out[i] = sum(1 - min(d, n) / n for d, n, _ in ds) / len(ds)
    top = max(out.values(), default=0)
    return {i: (s, True) for i, s in out.items() if s >= top - 0.1}


def test_search(spark):
    """Every query's rows are those of a full scan: exact, one and two errors, prefixes, short words, unknown words, no words."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 12))) for _ in range(120)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 9)))) for i in range(80)] + [(80, None), (81, "")]

    def spoilt(w):
        for _ in range(rnd.choice([0, 1, 1, 2, 3])):
            at = rnd.randrange(len(w) + 1)
            w = rnd.choice([w[:at] + "x" + w[at:], w[:at] + w[at + 1 :], w[:at] + "y" + w[at + 1 :]]) or "z"
        return w

    queries = [(j, " ".join(spoilt(w) for w in rnd.choices(words, k=rnd.choice([1, 1, 2])))) for j in range(150)] + [(150, ""), (151, "qq"), (152, "zzzzzzzzzz"), (153, words[5] + " " + words[5])]
    index = search.indexed(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    got = {}
    for r in search.search(index, spark.createDataFrame(queries, "q long, s string"), "q", "s").collect():
        got.setdefault(r.q, {})[r.id] = (round(r.score, 9), r.fuzzy)
    want = {j: {i: (round(s, 9), f) for i, (s, f) in x.items()} for j, q in queries if (x := brute_search(rows, q))}
    assert got == want
    assert {f for x in want.values() for _, f in x.values()} == {True, False}


PLACES = [(1, "Elmford", "a"), (2, "Upper Elmford", "a"), (3, "Elmford on the Water", "b"), (4, "Ríver-Bend", "a"), (5, "Twin", "a"), (6, "Twin", "b"), (7, "Io", "b")]
NAMED = [  # text, its country, place, name, how
    ("Elmford", None, 1, "elmford", "whole"), ("Race at Upper Elmford", None, 2, "upper elmford", "end"), ("Elmford on the Water", None, 3, "elmford on the water", "whole"), ("The Elmford on the Water Tour", None, 3, "elmford on the water", "within"),
    ("Elmford on the Water Tour of Twin", None, 5, "twin", "end"), ("River Bend classic, Elmford road", None, 4, "river bend", "within"), ("twin", "b", 6, "twin", "whole"), ("Upper Elmford", "b", None, None, None), ("visit Io", None, 7, "io", "end"), ("Io tour", None, None, None, None),
    ("nowhere", None, None, None, None), ("", None, None, None, None), (None, None, None, None, None), ("Elmford Twin cup", None, 1, "elmford", "within"), ("Elmfordshire", None, None, None, None),
]


def test_places_in_texts(spark):
    places = spark.createDataFrame(PLACES, "place long, name string, land string")
    texts = spark.createDataFrame([(i, n[0], n[1]) for i, n in enumerate(NAMED)], "id long, t string, land string")
    got = {r.id: (r.place, r.name, r.how) for r in gazetteer.resolved(texts, "id", "t", places, "name", "place", "land").collect()}
    assert got == {i: n[2:] for i, n in enumerate(NAMED) if n[2]}
    assert gazetteer.resolved(texts, "id", "t", places.limit(0), "name", "place").collect() == []
    free = {r.id: r.place for r in gazetteer.resolved(texts, "id", "t", places, "name", "place").collect()}
    assert free[6] == 5 and free[7] == 2


@pytest.fixture
def catalogue(spark):
    parents = spark.createDataFrame([(i, None, f"n{i}") for i in range(1, 9)], "id long, merged_into long, name string")
    children = [(1, "ann", "maybe", False, "x"), (2, "ann", "going", True, "y"), (2, "bob", "interested", None, None), (3, "ann", "going", False, ""), (4, "ann", "maybe", True, "x"), (4, "cyd", "going", True, "z"), (7, "ann", "going", False, "q")]
    return merges.Tables(parents, spark.createDataFrame(children, "id long, owner string, state string, paid boolean, note string"))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_moves_that_can_be_done_together(spark):
    moves = spark.createDataFrame([(1, 2, 5), (2, 3, 1), (4, 4, 0), (4, 5, 2), (5, 6, 2), (7, 8, 9)], "keep long, drop long, rank long")
    got = {(r.keep, r.drop): r.refused for r in merges.accepted(moves).collect()}
    assert got == {(1, 2): "busy", (2, 3): "", (4, 4): "self", (4, 5): "", (5, 6): "busy", (7, 8): ""}


def test_merge_edit_and_restore(spark, catalogue):
    moves = spark.createDataFrame([(1, 2), (3, 4), (5, 6), (7, 8)], "keep long, drop long")
    after, log = merges.merged(catalogue, moves)
    assert {(r.id, r.merged_into) for r in after.parents.collect()} == {(1, None), (2, 1), (3, None), (4, 3), (5, None), (6, 5), (7, None), (8, 7)}
    assert rows_of(after.children) == sorted([(1, "ann", "going", True, "x\ny"), (1, "bob", "interested", False, ""), (3, "ann", "going", True, "x"), (3, "cyd", "going", True, "z"), (7, "ann", "going", False, "q")], key=str)
    log = spark.createDataFrame(log.collect(), log.schema)
    # nothing changed: all comes back as it was
    back, result = merges.restored(after, log, moves)
    assert {r.outcome for r in result.collect()} == {"restored"}
    assert rows_of(back.parents) == rows_of(catalogue.parents) and rows_of(back.children) == rows_of(catalogue.children)
    # a record edited, a child edited, a child added: these stay merged, the other comes back; a merge that was never logged is unknown
    parents = after.parents.withColumn("name", F.when(F.col("id") == 2, "edited").otherwise(F.col("name")))
    children = after.children.withColumn("state", F.when((F.col("id") == 3) & (F.col("owner") == "cyd"), "maybe").otherwise(F.col("state"))).unionByName(spark.createDataFrame([(6, "eve", "going", False, "")], after.children.schema))
    asked = moves.unionByName(spark.createDataFrame([(9, 10)], moves.schema))
    back, result = merges.restored(merges.Tables(parents, children), log, asked)
    assert {(r.keep, r.outcome) for r in result.collect()} == {(1, "changed"), (3, "changed"), (5, "changed"), (7, "restored"), (9, "unknown")}
    assert {(r.id, r.merged_into) for r in back.parents.collect()} == {(1, None), (2, 1), (3, None), (4, 3), (5, None), (6, 5), (7, None), (8, None)}
    assert rows_of(back.children) == rows_of(children)


def test_fingerprints(spark, tmp_path):
    rows = [(i, f"v{i % 7}", float(i), None if i % 5 else i, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, v string, x double, y long, seen long")
    base = D.fingerprint(df, ("seen",)).first()
    same = df.repartition(7).select("seen", "y", "x", "v", "k").withColumn("seen", F.lit(0).cast("long"))
    assert D.fingerprint(same, ("seen",)).first() == base
    swapped = df.withColumns({"x": F.col("y").cast("double"), "y": F.col("x").cast("long")})
    assert D.fingerprint(swapped, ("seen",)).first() != base
    a = D.stored(df, ["k"], str(tmp_path / "a"), ("seen",))
    b = D.stored(same, ["k"], str(tmp_path / "b"), ("seen",))
    assert D.unequal_buckets(spark, a, b) == ([], [1]) and D.differences(spark, a, b).collect() == []
    other = df.where("k <> 17").withColumn("v", F.when(F.col("k") == 5, "w").otherwise(F.col("v"))).unionByName(spark.createDataFrame([(900, "n", 1.0, None, 0)], df.schema))
    c = D.stored(other, ["k"], str(tmp_path / "c"), ("seen",))
    buckets, looked = D.unequal_buckets(spark, a, c)
    assert 1 <= len(buckets) <= 3 and looked[0] == 1 and looked[1] == D.FAN and looked[2] <= 3 * D.FAN
    assert {tuple(r) for r in D.differences(spark, a, c).collect()} == {(17, "deleted"), (5, "updated"), (900, "inserted")}
    plan = D.differences(spark, a, c)._jdf.queryExecution().toString()
    assert "PartitionFilters: [_bucket" in plan and "ReadSchema: struct<k:bigint,_h1:bigint,_h2:bigint>" in plan
