import random

import pytest

LOW = "the of and to in a is that for it".split()


def make_texts(n=160, seed=3):
    """Texts with copies, near copies, shared passages, nulls, empty and long ones, other scripts, and repeated lines."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(LOW) if rnd.random() < 0.4 else "".join(rnd.choice("abcdefghijklmnoprstuv") for _ in range(rnd.randint(2, 9)))
    passage = " ".join(word() for _ in range(60))
    line = "All rights reserved. This line stands in very many documents of this small corpus, again and again, as it does in real ones."
    out = [None, "", " \t\n", "word", "one two three", "Über Straße ñandú 日本語 テスト 😀", "a " * 400, "ab" * 300, "x" * 250]
    while len(out) < n:
        kind = rnd.random()
        if kind < 0.12 and len(out) > 20:
            out.append(rnd.choice(out[9:]))
        elif kind < 0.3 and len(out) > 20:
            w = (rnd.choice(out[9:]) or "").split(" ")
            for _ in range(rnd.randint(1, 3)):
                w[rnd.randrange(len(w))] = word()
            out.append(" ".join(w))
        else:
            w = [word() for _ in range(rnd.randint(1, 150))]
            if rnd.random() < 0.3:
                w.insert(rnd.randrange(len(w)), passage)
            if rnd.random() < 0.4:
                w.append("\n" + line)
            out.append(" ".join(w))
    out.append(" ".join(word() for _ in range(20_000)) + " " + passage)
    return out


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """doc_id not in the order of rows, and further columns whose names the operators use inside."""
    rows = [((i * 37) % 1009, t, "src", i, 1.0, i % 3, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, chunk int, score double, n long, row string").repartition(5).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def by_id(texts):
    return {(i * 37) % 1009: (t or "") for i, t in enumerate(texts)}
