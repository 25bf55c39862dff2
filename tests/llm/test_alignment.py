"""Cross-tokenizer alignment against the two libraries and plain loops over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from larkspur.llm import align

paths = pytest.importorskip("public_tokenizers")
A, B = paths.path("byte_bpe_50k.json"), paths.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tok():
    return align.pair_of(A, B)


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(rows, tok):
    """As the docstring of alignments has it, from whole texts by the tokenizers' own libraries."""
    found, count = [], Counter()
    for key, text in rows:
        a = b = ()
        if text:
            a = [(i, tok.a_bytes[i]) for i in tok.a.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, tok.b_bytes[i]) for i in tok.b.encode(text)]
            whole = (" " + text).encode()
            if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
                a = b = ()
        a, b = spans(a), spans(b)
        links, j = [], 0
        for i, s, e in a:
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        ia = ib = 0
        for end in ends:
            ga, gb = [], []
            while ia < len(a) and a[ia][2] <= end:
                ga.append(str(a[ia][0]))
                ia += 1
            while ib < len(b) and b[ib][2] <= end:
                gb.append(str(b[ib][0]))
                ib += 1
            groups.append(f"{','.join(ga)}|{','.join(gb)}")
            low = end
        assert not a or low == a[-1][2]
        count.update(set(links))
        found.append((key, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return sorted((k, na, nb, g, len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), digest) for k, na, nb, g, links, digest in found)


ODD = ["<|endoftext|> and <s> </s> <unk> <0x41>", " starts and ends with blanks  ", "   ", " ", "a▁b", "▁", "tabs\tand\nlines\n\n  mixed \n x", "it's we'll 'tis 5's I'm", "Ünïcödé nbsp　wide em é à", "日本語のテキスト 空白 なし", "😀👍🏽 emoji‍join", "x1y2z3 4567 -- ,,.!", "\x00nul \x1f\x7f", "İstanbul ǅ ſ", "a" * 700, "0123456789" * 50, "https://example.org/a?b=c&d=%20"]


def aligned(df, **more):
    return sorted(tuple(r) for r in align.alignments(df, A, B, **more).collect())


@pytest.mark.parametrize("piece", [1 << 16, 300])
def test_alignment(docs, by_id, tok, piece):
    """Short texts whole, and long ones in ranges; null and empty ones, columns with clashing names."""
    assert aligned(docs, piece=piece, fan=3) == brute(list(by_id.items()), tok)


@pytest.mark.parametrize("piece", [1 << 16, 16, 1])
def test_odd_texts(spark, tok, piece):
    rows = [(i, t) for i, t in enumerate([*ODD, *ODD[:4], None, "", *("\n".join(ODD[i:]) for i in range(0, len(ODD), 5))])]
    got = aligned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), piece=piece, fan=2)
    assert got == brute(rows, tok)


def test_repeated_rows_null_keys_and_none(spark, tok, none):
    assert aligned(none) == []
    rows = [(1, "some words here"), (1, "some words here"), (2, "x" * 40 + " some words"), (2, "x" * 40 + " some words")]
    assert aligned(spark.createDataFrame(rows, "doc_id long, text string"), piece=20) == brute(rows, tok)
    got = align.alignments(spark.createDataFrame([(None, "two words")], "doc_id long, text string"), A, B).collect()
    assert got[0].doc_id is None and got[0].n_links > 0


def test_fragments_compose_in_any_order(tok):
    """Associative: whatever neighbours are composed first, the same groups close and nothing stays open."""
    rnd = random.Random(4)
    text = "Internationalization of 12345 tokens isn't unbelievable; straightforwardness, über-überaus \n wide " * 6
    a, b = tok.encode_a([(" " + text).encode()])[0], tok.encode_b([(" " + text).encode()])[0]
    ea, eb = np.cumsum(tok.la[a]), np.cumsum(tok.lb[b])
    for _ in range(30):
        cuts = sorted(rnd.sample(range(len(ea)), 12))
        runs, i, k = [], 0, 0
        for c in [*cuts, len(ea)]:
            m = len(eb) if c == len(ea) else max(k, int(np.searchsorted(eb, ea[c])) + rnd.randint(-3, 3))
            m = min(m, len(eb))
            runs.append(align.Run(int(ea[i - 1]) if i else 0, a[i:c], int(eb[k - 1]) if k else 0, b[k:m]))
            i, k = c, m
        parts = [align.Fragment.lift(tok, True, r) for r in runs]
        closed = [c for _, cs in parts for c in cs]
        parts = [f for f, _ in parts]
        while len(parts) > 1:
            at = rnd.randrange(len(parts) - 1)
            whole, done = parts[at].then(tok, parts[at + 1])
            closed += done
            parts[at : at + 2] = [whole]
        closed.append(parts[0].prefix)
        assert parts[0].suffix is None or not len(parts[0].suffix.a) + len(parts[0].suffix.b)
        closed.sort(key=lambda r: r.a_at)
        assert np.concatenate([r.a for r in closed]).tolist() == a.tolist()
        assert np.concatenate([r.b for r in closed]).tolist() == b.tolist()
        for r in closed:
            assert r.a_at == r.b_at and int(tok.la[r.a].sum()) == int(tok.lb[r.b].sum())
