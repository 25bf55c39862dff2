"""The pipeline's stages, each against brute force on what the stage before kept."""

import re

import pytest

import corpus_pipeline
from larkspur.llm import spread

pytest.importorskip("public_tokenizers")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, texts, tmp_path_factory):
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate([*texts, "call +1 (415) 555-2671 or a.b@c-d.org now and then some more words of it here"])]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        new = spread.kept(stage(spark, docs, str(folder)), name)
        out.append((name, {r.doc_id: r for r in docs.collect()}, new))
        docs = new
    return str(folder), out


def test_columns(stages):
    assert [n for n, _, _ in stages[1]] == ["language", "near_copies", "repeated_passages", "personal_data", "packing"]
    assert all(df.columns == COLUMNS for _, _, df in stages[1][:-1])


def test_language_lets_only_letterless_and_far_texts_go(stages):
    _, before, df = stages[1][0]
    kept = {r.doc_id for r in df.collect()}
    gone = [before[i].text for i in before if i not in kept]
    assert None in gone and "" in gone and " \t\n" in gone and len(gone) < 12


def test_near_copies_keep_the_least_of_each_group(stages):
    _, before, df = stages[1][1]
    sets = {}
    for i, r in before.items():
        w = r.text.lower().split() if r.text.isascii() else re.sub("[A-Z]", lambda m: m.group().lower(), r.text).encode().split()
        w = [x if isinstance(x, bytes) else x.encode() for x in w]
        sets[i] = frozenset([tuple(w[k : k + 5]) for k in range(len(w) - 4)] or [tuple(w)])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * (both := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    rows = {r.doc_id: r.text for r in df.collect()}
    assert rows == {i: before[i].text for i in sets if find(i) == i}


def test_repeated_passages(stages):
    _, before, df = stages[1][2]
    first, words = {}, {i: r.text.encode().split() for i, r in sorted(before.items())}
    for i, w in words.items():
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for r in df.collect():
        w = words[r.doc_id]
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < r.doc_id for j in range(k, k + 13)}
        want = b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else before[r.doc_id].text
        assert r.text == want and r.n_chars == len(want)


def test_personal_data_is_masked(stages):
    _, before, df = stages[1][3]
    rows = {r.doc_id: r for r in df.collect()}
    assert rows.keys() == before.keys()
    changed = {i: r for i, r in rows.items() if r.text != before[i].text}
    assert [r.text for r in changed.values()] == ["call <PHONE> or <EMAIL> now and then some more words of it here"]
    assert all(r.n_chars == len(r.text) for r in rows.values())


def test_packing_places_every_document(stages, spark):
    folder, out = stages
    _, before, df = out[4]
    rows = df.collect()
    assert {r.doc_id for r in rows} == before.keys() and all(r.offset + r.length <= 4096 for r in rows)
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, folder).collect())) == sorted(map(key, rows))


CLASHING = "row string, kept_text string, n_removed long, rejected boolean, component_id long, chunk int, piece int, label string, span string, grp int"


@pytest.fixture(scope="module")
def clashing(spark, texts):
    rows = [(i, t, "en", "src", len(t or ""), f"r{i}", "k", -i, True, -1, 7, 8, "l", None, i) for i, t in enumerate(texts[:60])]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").repartition(3).cache()


def test_stages_of_no_rows(spark, clashing):
    """An empty table comes out of every stage empty, with the columns it came with."""
    none = clashing.select(COLUMNS).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, "")
        assert out.collect() == [] and (stage is corpus_pipeline.STAGES[-1][1] or out.columns == COLUMNS)


def test_run_of_no_rows(spark, clashing, tmp_path):
    clashing.select(COLUMNS).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_clashing_columns_go_through(spark, clashing):
    """Further columns, named as what the stages use inside, neither change a stage's decisions nor are changed, and stay with their rows."""
    extra = [c for c in clashing.columns if c not in COLUMNS]
    held = {r.doc_id: [r[c] for c in extra] for r in clashing.collect()}
    plain = clashing.select(COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        with_extra, without = (spread.kept(stage(spark, df, ""), name) for df in (clashing, plain))
        got = with_extra.collect()
        assert with_extra.columns == clashing.columns and all([r[c] for c in extra] == held[r.doc_id] for r in got)
        assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == sorted(map(tuple, without.collect())), name
    last = corpus_pipeline.STAGES[-1][1]
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, last(spark, clashing, "").select(key).collect())) == sorted(map(tuple, last(spark, plain, "").select(key).collect()))
