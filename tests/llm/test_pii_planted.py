"""Contexts planted in real texts: identifiers that no seed pattern matches, behind words that also stand before seeds."""

import os
import random
import re

import pytest

from larkspur.llm import pii

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def planted(rows, seed=1, contexts=8, each=60, of=6):
    """Texts with, behind each of some two-word contexts that occur in them anyway, `each` identifiers: e-mail addresses or phone numbers, but
    every `of`-th has a form that no pattern matches; and where the latter stand, as (doc_id, identifier)."""
    rnd = random.Random(seed)
    texts, pairs = dict(rows), {}
    for t in texts.values():
        for a, b in zip(w := re.findall(r"[^\W\d_]{4,12}", t), w[1:], strict=False):
            pairs[a.lower(), b.lower()] = pairs.get((a.lower(), b.lower()), 0) + 1
    chosen = [p for p, _ in sorted(pairs.items(), key=lambda x: (-x[1], x[0]))[:contexts]]
    ids, out = sorted(texts), []
    for c, (a, b) in enumerate(chosen):
        for i in range(each):
            known = i % of > 0
            n = rnd.randrange(10**6)
            value = (f"name{n}@host{n % 97}.example" if c % 2 == 0 else f"+49 {n:06d} {n % 9000 + 1000}") if known else (f"name{n}@localhost" if c % 2 == 0 else f"ext-{n:06d}/{n % 89 + 10}")
            doc = rnd.choice(ids)
            words = texts[doc].split(" ")
            words.insert(rnd.randrange(len(words) + 1), f"{a} {b} {value} ,")
            texts[doc] = " ".join(words)
            if not known:
                out.append((doc, value))
    return sorted(texts.items()), out


def measured(spark, rows, before):
    """Precision and recall of what the contexts add, apart from the kind `secret`, which has a seed pattern of its own."""
    texts, plants = planted(rows)
    found = set()
    for r in pii.find(spark.createDataFrame(texts, "doc_id long, text string").repartition(8)).collect():
        text = dict(texts)[r.doc_id] if r.n_added else ""
        for s in filter(None, r.spans.split(",")) if r.n_added else ():
            kind, start, end = s.split(":")
            value = text[int(start) : int(end)]
            if kind != "secret" and not any(re.fullmatch(p, value) for p in before):
                found.add((r.doc_id, value))
    hit = {p for p in plants if any(d == p[0] and (p[1] in v or v in p[1]) for d, v in found)}
    right = {f for f in found if any(f[0] == d and (v in f[1] or f[1] in v) for d, v in plants)}
    return len(right) / max(1, len(found)), len(hit) / len(plants), len(found)


#: What the base finds: addresses, IP addresses, card numbers and phone numbers.
BASE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+){3}", r"[0-9]([ -]?[0-9])+", r"\+[0-9][ ().0-9-]+[0-9]")


def test_planted_contexts_are_learned(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    precision, recall, _ = measured(spark, rows, BASE)
    assert precision >= 0.95 and recall >= 0.9
