"""Exact duplicates and the audit of sources against plain Python, whole results."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from larkspur.llm import copies, divergence


def brute_copies(rows):
    plain = lambda t: re.sub(r"[ \t-\r]", "", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append((-len(t or ""), i))
    out = []
    for i, t in rows:
        g = groups[plain(t)]
        out.append((i, min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(plain(t).encode()).hexdigest()))
    return sorted(out)


def copies_of(df, **more):
    return sorted(tuple(r) for r in copies.exact_copies(df, **more).collect())


@pytest.mark.parametrize(("radix", "run"), [(16, 1 << 16), (2, 16), (4, 8)])
def test_exact_copies(docs, by_id, radix, run):
    """One round, and several with small runs: equal texts, texts equal without white space, nulls, empty and very long texts."""
    assert copies.rounds_for(len(by_id), radix, run) == (1 if run > 1000 else 4 if radix == 2 else 3)
    assert copies_of(docs, radix=radix, run=run, chunk_rows=20) == brute_copies(list(by_id.items()))


def test_exact_copies_hot_group_and_ties(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["same text", "same  text", "sametext\x0b", None, "", "\n", "other text", "other text", f"own {i}"])) for i in range(700)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert copies_of(df) == brute_copies(rows)


def test_exact_copies_of_repeated_rows_null_keys_and_none(spark, none):
    assert copies_of(none) == []
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "ab"), (None, "a  b"), (None, "z")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in copies.exact_copies(df).collect()), key=str)
    assert got == sorted([(1, None, 4, False)] * 2 + [(2, None, 4, False), (None, None, 4, True), (None, None, 1, True)], key=str)
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "ab"), (None, "ab")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.kept) for r in copies.exact_copies(df).collect()), key=str)
    assert got == sorted([(1, 1, True)] * 2 + [(2, 1, False), (None, 1, False)], key=str)


def test_merge_verifies_whole_digests():
    """Digests with one head are told apart by the rest."""
    d = np.array([[5, 0, 0, 1], [5, 0, 0, 2], [9, 0, 0, 0], [5, 0, 0, 1], [5, 0, 0, 2]], np.uint64)
    got = copies.merged(d, np.array([3, 1, 1, 4, 1]), np.array([10, 8, 7, 12, 6]), np.ones(5, np.int64))
    assert got[0].tolist() == [[5, 0, 0, 1], [5, 0, 0, 2], [9, 0, 0, 0]]
    assert [x.tolist() for x in got[1:]] == [[4, 1, 1], [12, 6, 7], [2, 2, 1]]


def brute_divergence(rows, least=3, top=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    df, cells, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        c = Counter(term.findall((text or "").translate(lower)))
        groups[lang or ""].add(source or "")
        cells[lang or "", source or ""].update(c)
        df[lang or ""].update(c.keys())
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        v = len(kept)

        def p_of(counts, kept=kept, v=v):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + v) for t in kept}

        p = {s: p_of(cells[lang, s]) for s in sources}
        q = p_of(sum((cells[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            rank = lambda items: sorted(items, key=lambda x: (-x[1], x[0].encode()))
            pair = rank((o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s)
            best = rank((t, f(p[s][t], q[t])) for t in kept if cells[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item, value, i) for part, items in (("pair", pair), ("term", best)) for i, (item, value) in enumerate(items, 1)]
    return sorted(out)


def divergences_of(df, **more):
    return sorted(tuple(r) for r in divergence.divergences(df, **more).collect())


COLUMNS = "lang string, source string, text string, term string, count long, p double, part int, held string"


def audit_rows(n, seed):
    rnd = random.Random(seed)
    words = ["the", "The", "THE", "Éa", "éa", "naïve", "日本", "x-y", "don't", "a1b", " ", "zz", "ß", "q", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = []
    for _ in range(n):
        lang, source = rnd.choice(["en", "fr", None, ""]), rnd.choice(["hot"] * 4 + ["a", "b", None, "B", "é"])
        text = rnd.choice([None, "", " 12 ;", " ".join(rnd.choices(words, k=rnd.randint(1, 60)))]) if rnd.random() < 0.3 else " ".join(rnd.choices(words, k=rnd.randint(1, 60)))
        rows.append((lang, source, text, "x", 1, 2.0, 3, "y"))
    return rows + [("de", "only", "nothing kept here", "x", 1, 2.0, 3, "y"), ("de", "two", "1 2 3", "x", 1, 2.0, 3, "y"), ("it", "alone", "sì sì", "x", 1, 2.0, 3, "y")]


@pytest.mark.parametrize("part_rows", [1 << 17, 9])
def test_divergences(spark, monkeypatch, part_rows):
    """Several sources and languages, a hot source, nulls, empty texts, columns with clashing names; with one part of terms and with many."""
    monkeypatch.setattr(divergence, "PART_ROWS", part_rows)
    rows = audit_rows(300, 2)
    assert divergences_of(spark.createDataFrame(rows, COLUMNS).repartition(5)) == brute_divergence([r[:3] for r in rows])


def test_divergences_ranks_and_documents(spark):
    rows = audit_rows(120, 8)
    df = spark.createDataFrame(rows, COLUMNS)
    assert divergences_of(df, top=3, least_docs=2) == brute_divergence([r[:3] for r in rows], 2, 3)
    assert divergences_of(df.unionByName(df)) == brute_divergence([r[:3] for r in rows] * 2)


def test_divergences_of_no_rows(spark, docs):
    assert divergences_of(docs.limit(0).selectExpr("source as lang", "source", "text")) == []


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = "Ab cdefghijkl é-é ab\tAB" * 9
    assert divergence.terms_of(text.encode()) == Counter(re.sub("[^a-zé]", " ", text.lower()).encode().split())
