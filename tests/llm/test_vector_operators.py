"""Vector operators against brute force."""

import numpy as np
import pytest

from larkspur.llm import caps, pivots, spread


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id long, v string").repartition(3)


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(9)
    base = rng.standard_normal((260, 24))
    near = base[:40] + 0.2 * rng.standard_normal((40, 24))
    crowd = base[50] + 0.05 * rng.standard_normal((70, 24))
    x = np.concatenate([base, near, crowd, base[:6]]).astype(np.float32)
    return x, np.arange(len(x)) * 3 + 1


def odd(n):
    return [(90_001, None), (90_002, []), (90_003, [float("nan")] * n), (90_004, [0.0] * n), (90_005, [float("inf")] + [0.0] * (n - 1)), (90_006, [None] * n)]


def as_rows(x, ids):
    return [(int(i), [float(c) for c in v], 0, 1, "x") for i, v in zip(ids, x, strict=True)]


@pytest.mark.parametrize("block", [64, 8192])
def test_top_k(spark, made, block):
    x, ids = made
    rows = [*as_rows(x, ids), *((i, v, 0, 1, "x") for i, v in odd(24))]
    got = pivots.top_k(frame(spark, rows), every=5, k=7, block=block).collect()
    keep = np.append(ids, 90_004)
    f = np.floor(64.0 * np.concatenate([x, np.zeros((1, 24))]).astype(float))
    for q in np.flatnonzero(keep % 5 == 0):
        s = f @ f[q]
        s[q] = -np.inf
        want = [(r + 1, int(keep[j]), int(s[j])) for r, j in enumerate(np.lexsort((keep, -s))[:7])]
        assert sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == keep[q]) == want
    assert len(got) == 7 * int((keep % 5 == 0).sum())


def test_top_k_with_fewer_than_k(spark):
    rows = [(0, [1.0, 2.0], 0, 1, "x"), (1, [1.0, 2.0], 0, 1, "x"), (2, [1.0], 0, 1, "x")]
    assert [(r.query_id, r["rank"], r.vec_id) for r in pivots.top_k(frame(spark, rows), every=20).collect()] == [(0, 1, 1)]


def test_blocks_are_left_out_but_never_one_that_holds_a_hit():
    rng = np.random.default_rng(5)
    centre = rng.integers(-400, 400, (12, 16))
    x = np.concatenate([c + rng.integers(-5, 6, (100, 16)) for c in centre]).astype(float)
    piv = pivots.farthest_first(x[::7], 32)
    far = pivots.distances(x, piv).T
    low, high, norm = (np.stack([f(part) for part in np.split(v, 12)]) for f, v in ((lambda p: p.min(axis=0), far), (lambda p: p.max(axis=0), far), (lambda p: p.max(), (x**2).sum(axis=1))))
    q = x[::50]
    s = q @ x.T
    limit = np.sort(s, axis=1)[:, -20]
    there = pivots.may_hold(q, far[::50], limit, norm, low, high)
    best_of = s.reshape(len(q), 12, 100).max(axis=2)
    assert there[best_of >= limit[:, None]].all() and there.mean() < 0.5


def test_pivot_bounds_leave_work_out():
    rng = np.random.default_rng(1)
    centre = rng.integers(-400, 400, (10, 16))
    x = (centre[rng.integers(0, 10, 4000)] + rng.integers(-5, 6, (4000, 16))).astype(float)
    piv = pivots.farthest_first(x[:500], 32)
    far = pivots.distances(x, piv)
    ids = np.arange(len(x))
    got, score, done = pivots.best(x[7], 7, far[:, 7], -np.inf, x, ids, (x**2).sum(axis=1), far, 20)
    s = x @ x[7]
    s[7] = -np.inf
    assert list(ids[got]) == list(np.lexsort((ids, -s))[:20]) and done < len(x) / 2


def test_near_duplicates(spark, made, monkeypatch):
    x, ids = made
    rows = [*as_rows(x, ids), *((i, v, 0, 1, "x") for i, v in odd(24))]
    monkeypatch.setattr(caps, "SIDE", 30)  # the crowd's filters are split
    got = {r.vec_id: r for r in caps.near_duplicates(frame(spark, rows), cos=0.9).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert len(got) == len(rows)
    found = sum(got[int(i)].n_links for i in ids)
    assert 0.95 * near.sum() <= found <= near.sum()
    assert all(got[int(i)].n_links <= n for i, n in zip(ids, near.sum(axis=1), strict=True))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in odd(24))
    crowd = [int(i) for i, m in zip(ids, near.sum(axis=1), strict=True) if m > 60]
    assert len({got[i].component_id for i in crowd}) == 1
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_filters_are_those_above_the_cut():
    code = caps.Code(24, 2000, 0.9)
    rng = np.random.default_rng(0)
    u = rng.standard_normal((50, 24))
    u /= np.linalg.norm(u, axis=1)[:, None]
    row, filt = code.decode(u)
    x = u @ code.rotation.T * np.sqrt(24)
    whole = np.zeros((50, 1))
    for (a, b), d in zip(zip(code.edges[:-1], code.edges[1:], strict=True), code.directions, strict=True):
        whole = (whole[:, :, None] + (x[:, a:b] @ d.T)[:, None, :]).reshape(50, -1)
    want = {(int(r), int(c)) for r, c in zip(*np.nonzero(whole >= code.cut), strict=True)}
    have = {(int(r), int(c)) for r, c in zip(row, filt, strict=True)}
    assert want <= have and {r for r, _ in have} == set(range(50))


@pytest.mark.parametrize("n", [200, 20_000, 200_000, 2_000_000])
def test_pairs_at_the_threshold_share_a_filter_at_every_size(n):
    chosen = caps.codes(64, n, 0.9)
    for cos in (0.9, 0.95, 0.98):
        a, b = caps.pairs_at(64, cos, 3000, seed=77)  # other pairs than those the codes were sized on
        assert caps.shares(chosen, a, b).mean() >= 0.985


def test_near_duplicates_of_many_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b = caps.pairs_at(64, 0.905, 400, seed=5)
    x = np.concatenate([x, a, b, caps.pairs_at(64, 0.96, 200, seed=6)[0], caps.pairs_at(64, 0.96, 200, seed=6)[1]]).astype(np.float32)
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = sum(int((u[at : at + 2048] @ u.T >= 0.9).sum()) for at in range(0, len(u), 2048)) - len(u)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    found = sum(r.n_links for r in caps.near_duplicates(df, cos=0.9).collect())
    assert want >= 1200 and 0.98 * want <= found <= want


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_codes_of_few_dimensions(dim):
    a, b = caps.pairs_at(dim, 0.9, 1000, seed=7)
    assert caps.shares(caps.codes(dim, 5000, 0.9), a, b).mean() >= 0.98


def test_empty_and_useless_tables(spark):
    none = frame(spark, as_rows(np.zeros((1, 2)), [1])).limit(0)
    assert pivots.top_k(none).collect() == [] and caps.near_duplicates(none).collect() == []
    zero = frame(spark, as_rows(np.zeros((2, 3)), [1, 2]))
    assert [(r.vec_id, r.n_links) for r in caps.near_duplicates(zero).orderBy("vec_id").collect()] == [(1, 0), (2, 0)]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (102, 101), (100, 101), (7, 7)]
    got = {r.node: r.component for r in spread.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys((100, 101, 102), 100)}
    assert spread.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_clashing_columns_and_names(spark, made):
    """Columns named as what the operators use inside change nothing, whatever the key and the vector are called."""
    x, ids = made
    rows = [(int(i), [float(c) for c in v], 1, [1], 2, 3.0, 4, 5, 6) for i, v in zip(ids[-90:], x[-90:], strict=True)]
    df = spark.createDataFrame(rows, "f long, filters array<float>, dim int, v array<int>, own int, s double, lo int, hi int, component long").repartition(3)
    plain = df.selectExpr("f as vec_id", "filters as embedding")
    got, want = caps.near_duplicates(df, "f", "filters"), caps.near_duplicates(plain)
    assert got.columns == ["f", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    found, wanted = pivots.top_k(df, "f", "filters", every=5, k=4), pivots.top_k(plain, every=5, k=4)
    as_set = lambda rows: {(r.query_id, r["rank"], r[2], r.score) for r in rows}
    assert as_set(found.collect()) == as_set(wanted.collect())
