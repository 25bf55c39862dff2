"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

A filter is a direction; a vector belongs to every filter whose direction it exceeds a threshold with. The directions form a product
code: the (randomly rotated) space is cut into blocks, each block has its own random directions, and a filter takes one
of each. A vector's filters are list-decoded: block scores are combined only as far as their sum can still pass. The filters of
one code depend on each other, so several codes with rotations of their own are united; their number comes from the share of
random pairs at the threshold that have no filter in common, measured before the table is read. Vectors of one filter are compared exactly, in double precision; a pair that shares several filters is counted in the least one.
Filters with very many vectors are split into pairs of sub-blocks of bounded size, so no task holds a whole one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import spread as S
from larkspur.llm.pivots import usable

#: Vectors that a filter should hold, about; most rows of one side of a task; chance of missing a pair at the threshold, at most.
LOAD, SIDE, MISS = 512, 1024, 0.01
#: Miss of one code were its filters independent (small codes, of which more are united, need fewer filters); pairs measured.
ONE, PAIRS = 0.6, 4000


def rows_of(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column of vectors of length dim as rows of numbers."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def tail(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


class Code:
    """A product code of `blocks` parts with `size` directions each, for vectors of length dim; `cut` is the threshold."""

    def __init__(self, dim: int, n: int, cos: float, seed: int = 11):
        self.dim = dim
        p = min(0.05, max(LOAD / max(n, 1), 1e-12))
        low, high = 0.0, 12.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if tail(mid) > p else (low, mid)
        self.cut = low
        over = self.cut + 1 / (self.cut + 1)  # a typical score beyond the cut
        both = tail((self.cut - cos * over) / math.sqrt(1 - cos * cos))
        each = math.log(1 / ONE) / both
        self.blocks = min(dim, 2 if each / p < 1e6 else 3)
        self.size = max(2, math.ceil((each / p) ** (1 / self.blocks)))
        rng = np.random.Generator(np.random.PCG64(seed))
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.edges = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.directions = []
        for a, b in zip(self.edges[:-1], self.edges[1:], strict=True):
            d = rng.standard_normal((self.size, b - a))
            self.directions.append(d / np.linalg.norm(d, axis=1, keepdims=True) * math.sqrt((b - a) / dim))

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that each row exceeds; a row that exceeds none gets its best one."""
        x = unit @ self.rotation.T * math.sqrt(self.dim)
        scores = [x[:, a:b] @ d.T for a, b, d in zip(self.edges[:-1], self.edges[1:], self.directions, strict=True)]
        best = [s.max(axis=1) for s in scores]
        rest = np.cumsum([np.zeros(len(x)), *best[::-1]], axis=0)[::-1]  # the most that blocks from i on can add
        row, code, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for i, s in enumerate(scores):
            parts = []
            for at in range(0, len(row), 4096):
                sl = slice(at, at + 4096)
                sums = total[sl, None] + s[row[sl]]
                r, c = np.nonzero(sums + rest[i + 1][row[sl], None] >= self.cut)
                parts.append((row[sl][r], code[sl][r] * self.size + c, sums[r, c]))
            row, code, total = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (row, code, total)
        none = np.setdiff1d(np.arange(len(x)), row)
        top = np.zeros(len(none), np.int64)
        for s in scores:
            top = top * self.size + s[none].argmax(axis=1)
        return np.append(row, none), np.append(code, top)


def pairs_at(dim: int, cos: float, n: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """n random pairs of unit vectors with that cosine (equal ones where dim is 1)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    a, b = rng.standard_normal((2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    if dim == 1:
        return a, a
    b -= (a * b).sum(axis=1, keepdims=True) * a
    return a, cos * a + math.sqrt(1 - cos * cos) * b / np.linalg.norm(b, axis=1, keepdims=True)


def codes(dim: int, n: int, cos: float) -> list[Code]:
    """As many codes as leave a share of MISS of the measured pairs without a common filter, by two standard errors."""
    a, b = pairs_at(dim, cos, PAIRS)
    left, out = np.arange(PAIRS), []
    while len(left) + 2 * math.sqrt(len(left)) > MISS * PAIRS:
        out.append(Code(dim, n, cos, seed=11 + len(out)))
        left = left[~shares([out[-1]], a[left], b[left])]
    return out


def decode(codes: list[Code], unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all codes, by row and filter; each code's filters have numbers of their own."""
    got = [(row, filt + k * c.size**c.blocks) for k, c in enumerate(codes) for row, filt in [c.decode(unit)]]
    row, filt = (np.concatenate(p) for p in zip(*got, strict=True))
    order = np.lexsort((filt, row))
    return row[order], filt[order]


def shares(codes: list[Code], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether row i of a and row i of b have a filter in common."""
    (row, filt), (row2, filt2) = decode(codes, a), decode(codes, b)
    most = np.int64(max(filt.max(initial=0), filt2.max(initial=0))) + 1
    out = np.zeros(len(a), bool)
    out[np.intersect1d(row * most + filt, row2 * most + filt2) // most] = True
    return out


def _decode(codes: list[Code], dim: int):
    def run(batches):
        for batch in batches:
            x = rows_of(batch.column(1), dim)
            norm = np.sqrt((x * x).sum(axis=1))
            ok = norm > 0
            row, filt = decode(codes, x[ok] / norm[ok, None])
            off = np.searchsorted(row, np.arange(int(ok.sum()) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok)), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(filt))], ["id", "v", "filters"])

    return run


def _earlier(lists: list[np.ndarray], filt: int, a: np.ndarray, b: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Which of the near pairs share a filter below filt. Only rows with a near pair and filters of several rows are looked at."""
    out = np.zeros(near.shape, bool)
    ra, rb = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    rows = np.union1d(a[ra], b[rb])
    earlier = [lists[i][lists[i] < filt] for i in rows]
    if not sum(map(len, earlier)):
        return out
    owner = np.repeat(np.arange(len(rows)), [len(f) for f in earlier])
    _, place, count = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True)
    place, owner = (np.cumsum(count > 1) - 1)[place[count[place] > 1]], owner[count[place] > 1]
    ia, ib = np.searchsorted(rows, a[ra]), np.searchsorted(rows, b[rb])
    shared = np.zeros((len(ra), len(rb)), bool)
    for at in range(0, int((count > 1).sum()), 4096):
        here = (place >= at) & (place < at + 4096)
        held = np.zeros((len(rows), min(4096, int((count > 1).sum()) - at)), np.float32)
        held[owner[here], place[here] - at] = 1
        shared |= held[ia] @ held[ib].T > 0
    out[np.ix_(ra, rb)] = shared
    return out


def _links(x: np.ndarray, ids: np.ndarray, lists: list[np.ndarray], filt: int, side: np.ndarray, same: bool, cos: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row that count here, and the least id each row's linked group here has."""
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    a, b = (np.arange(len(x)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    near = unit[a] @ unit[b].T >= cos
    if same:
        np.fill_diagonal(near, False)
    new = near & ~_earlier(lists, filt, a, b, near)
    links = np.zeros(len(x), np.int64)
    links[a] += new.sum(axis=1)
    if not same:
        links[b] += new.sum(axis=0)
    label = ids.copy()
    big = np.iinfo(np.int64).max
    while near.any():
        was = label.copy()
        label[a] = np.minimum(label[a], np.where(near, label[b][None, :], big).min(axis=1))
        label[b] = np.minimum(label[b], np.where(near, label[a][:, None], big).min(axis=0))
        if (label == was).all():
            break
    return links, label


def _compare(dim: int, cos: float):
    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["id"].to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        ids = rows["id"].to_numpy()
        lists = [np.asarray(f) for f in rows["filters"].to_pylist()]
        same = rows["lo"][0].as_py() == rows["hi"][0].as_py()
        links, label = _links(rows_of(rows["v"], dim), ids, lists, rows["f"][0].as_py(), (rows["own"].to_numpy() != rows["lo"][0].as_py()).astype(int), same, cos)
        keep = (links > 0) | (label != ids)
        return pa.table({"id": pa.array(ids[keep]), "links": pa.array(links[keep]), "label": pa.array(label[keep])})

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", cos: float = 0.9) -> DataFrame:
    """key, n_links, component_id, kept: rows link where a pair found has cosine >= cos in double precision.

    Null, empty and zero vectors and those with null or non-finite components link with nothing: no links, a component of their own.
    Vectors of different lengths don't link. Each pair at the threshold is found with a chance of 1 - MISS or more at every size
    of the table (measured on random pairs, see codes), closer ones with more; none below it is linked. Keys are unique.
    """
    rows = usable(vectors, key, column)
    sizes = rows.groupBy("dim").count().collect()
    found = None
    for r in sorted(sizes, key=lambda r: r["dim"]):
        chosen = codes(r["dim"], r["count"], cos)
        held = S.kept(rows.where(F.col("dim") == r["dim"]).select("id", "v").mapInArrow(_decode(chosen, r["dim"]), "id long, v array<double>, filters array<long>"), "filters")
        big = held.select(F.explode("filters").alias("f")).groupBy("f").count().where("count > 1").select("f", F.ceil(F.col("count") / SIDE).cast("int").alias("s"))
        dealt = held.select("id", "filters", F.explode("filters").alias("f")).join(big, "f")
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id", "f"), F.col("s")).cast("int"))
        pair = F.expr("transform(sequence(0, s - 1), o -> struct(least(own, o) as lo, greatest(own, o) as hi))")
        dealt = dealt.withColumn("p", F.explode(pair)).select("f", "p.lo", "p.hi", "own", "id", "filters")
        dealt = dealt.join(held.select("id", "v"), "id")
        got = dealt.groupBy("f", "lo", "hi").applyInArrow(_compare(r["dim"], cos), "id long, links long, label long")
        found = got if found is None else found.unionByName(got)
    ids = vectors.select(F.col(key).alias("id"))
    if found is None:
        return ids.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    found = S.kept(found, "links")
    group = S.components(found.where("label <> id").select("id", "label"), "id", "label").select(F.col("node").alias("id"), "component")
    links = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    out = ids.join(links, "id", "left").join(group, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
