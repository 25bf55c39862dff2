"""Part pairs by classes of equal parts: a block of many copies against the SQL twins, and what is compared."""

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur.operators import entities as E
from larkspur.plans import registry

registry.load()
NAMES = ["blue ring", "blue rings", "bluering", "red bolt", None]
#: 60 parts of one block, 20 classes of three parts, nulls among the names, kinds and prices.
PARTS = [(i, NAMES[i % 5], "Brand#1", (None, "SMALL TIN", "SMALL ZINC", "LARGE TIN")[i % 4], 7, (900.0, 930.0, 1900.0, None, 960.0)[i * 7 % 20 % 5]) for i in range(60)]
SCHEMA = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("parts"))
    rows = spark.createDataFrame(PARTS, SCHEMA)
    rows.write.parquet(f"{at}/part.parquet")
    rows.where("p_name is not null").write.parquet(f"{at}/named/part.parquet")
    return at


def agrees(spark, folder, name):
    df = registry.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{folder}/part.parquet/*.parquet'")
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({registry.ORACLES[name]})").fetchall()
    plain = lambda rows: sorted(tuple(str(float(v)) if isinstance(v, (int, float)) else str(v) for v in r) for r in rows)
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(want)


def test_comparisons_do_not_grow_with_copies(spark):
    rows = spark.createDataFrame(PARTS, SCHEMA)
    more = rows.unionByName(rows.withColumn("p_partkey", F.col("p_partkey") + 1000)).unionByName(rows.withColumn("p_partkey", F.col("p_partkey") + 2000))
    counts = [E.class_pairs(E.classed(r, "p_partkey", ["p_brand", "p_size", "p_name"]), "p_partkey", ["p_brand", "p_size"], ["p_name"]).count() for r in (rows, more)]
    assert counts == [15, 15]


@pytest.mark.parametrize("name", "e4_gates_after_score e5_components e5_rechecked_members e7_review_list e3_unique_best_match c6_bigram_dice c7_word_set_similarity e1_pair_score e2_decision".split())
def test_copies_and_nulls(spark, folder, name):
    # DuckDB's share of words tells a null first name from a null second one, which ours does not
    agrees(spark, f"{folder}/named" if name.startswith("c7_") else folder, name)


@pytest.mark.parametrize("name", "e1_pair_score e2_decision e4_gates_after_score e7_review_list".split())
def test_no_pair_of_parts_is_dealt_out(spark, folder, name):
    """Pairs of classes were dealt out with their names to find how alike these are, and again for each side's rows."""
    text = registry.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    after = text.split("== Initial Plan ==")[-1].split("SortMergeJoin")
    assert len(after) == (4 if name.startswith("e4_") else 2) and "Exchange" not in after[0]


def test_names_are_compared_in_lists(spark):
    value = lambda x, y: F.length(x["s"]) * 100 + F.length(y["s"])
    few = [(i, i % 6, "a" * (1 + i % 4)) for i in range(30)] + [(30, 0, None)]
    many = [(i, i % 6, "a" * (1 + i)) for i in range(30)] + [(30, 0, None)]
    for rows, sizes in ((few, {4}), (many, {5})):
        got = E.known_names(spark.createDataFrame(rows, "k long, b int, s string"), ["b"], "s", {"n": F.length("s")}, value).collect()
        assert sorted((r["k"], r["b"], r["s"]) for r in got) == rows and {len(r["to"]) for r in got if r["s"]} == sizes
        assert [(r["place"], r["to"]) for r in got if r["s"] is None] == [(None, None)]
        assert all(x["to"][y["place"]] == len(x["s"]) * 100 + len(y["s"]) for x in got for y in got if x["s"] and y["s"] and x["b"] == y["b"])
