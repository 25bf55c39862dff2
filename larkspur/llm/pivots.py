"""Exact top-k search by inner product with a pivot table.

Every vector's distances to the pivots are computed once and kept beside it. For a query q and a vector v the triangle
inequality gives d(q, v) >= max over pivots p of |d(q, p) - d(v, p)|, and so an upper bound of their inner product,
(|q|^2 + |v|^2 - d^2) / 2. Candidates are evaluated in the order of that bound until the k-th best score found is above
every bound left, which makes the result exact.

Vectors whose nearest pivots are the same lie in one block. A query is answered in its own block first; its k-th score there, or
in a bounded sample of vectors, is the limit for the rest. A block's least and largest distance to each pivot bound what it can
hold for a query, and a query goes only to those blocks whose bound reaches its limit; blocks are sent only to queries that come.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm import spread as S

#: Vectors of the sample (pivots come from it), pivots, vectors and queries of a block, candidates evaluated at once.
SAMPLE, PIVOTS, BLOCK, QUERY_BLOCK, STEP = 1024, 32, 8192, 2048, 512


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """key, v (array<double>), dim: vectors that are neither null nor empty and hold finite numbers only."""
    ok = F.expr(f"{column} is not null and size({column}) > 0 and forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return vectors.where(ok).select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v"), F.size(column).alias("dim"))


def packed_rows(col, dim: int, kind: str = "<i4") -> np.ndarray:
    """Packed vectors as rows of numbers."""
    return S.joined(col, kind)[0].reshape(-1, dim)


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """k rows, each farthest from those before."""
    if not len(x):
        return x
    chosen = [0]
    d = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmax(d)))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """pivots x rows."""
    return np.sqrt(np.maximum((pivots**2).sum(axis=1)[:, None] + (x**2).sum(axis=1) - 2 * pivots @ x.T, 0)).astype(np.float32)


def best(q: np.ndarray, q_id: int, q_far: np.ndarray, limit: float, x: np.ndarray, ids: np.ndarray, norms: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and scores of the k best rows for q with a score of `limit` or more, and how many rows were evaluated."""
    bound = (float(q @ q) + norms) / 2
    if len(far):
        gap = np.abs(far - q_far[:, None]).max(axis=0).astype(np.float64)
        bound = bound - gap * gap / 2 + 1 + gap * 1e-3  # scores are whole numbers: the slack covers rounding
    order = np.flatnonzero((bound >= limit) & (ids != q_id))
    order = order[np.argsort(-bound[order], kind="stable")]
    got, score, done = np.zeros(0, np.int64), np.zeros(0), 0
    while done < len(order) and bound[order[done]] >= limit:
        part = order[done : done + STEP]
        done += len(part)
        s = x[part] @ q
        keep = s >= limit
        got, score = np.append(got, part[keep]), np.append(score, s[keep])
        if len(got) > k:
            top = np.lexsort((ids[got], -score))[:k]
            got, score = got[top], score[top]
            limit = max(limit, float(score[-1]))
    return got, score, done


def may_hold(q: np.ndarray, far: np.ndarray, limit: np.ndarray, norm: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """[query, block]: whether a block of vectors of squared length `norm` at most, whose distances to the pivots lie from low to high,
    may hold an inner product of `limit` or more. far: the queries' distances to the pivots."""
    gap = np.zeros((len(q), len(norm)))
    for p in range(far.shape[1]):
        np.maximum(gap, np.maximum(low[None, :, p] - far[:, None, p], far[:, None, p] - high[None, :, p]), out=gap)
    bound = ((q**2).sum(axis=1)[:, None] + norm) / 2 - gap * gap / 2 + 1 + gap * 1e-3
    return bound >= limit[:, None]


BLOCK_OF = ("dim", "cell", "sub")
OWN = "query_id long, vec_id long, score long, dim int, cell long, sub int, norm double, low binary, high binary"


def top_k(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: float = 64.0, every: int = 20, k: int = 20, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose key is divisible by `every`, the k other rows of largest integer inner product.

    Components become floor(scale * x), whole numbers below 2**20 in size here; scores are sums of their products. Ties go to the smaller key. Vectors
    that are null, empty or hold null or non-finite components take no part; a vector meets vectors of its own length only.
    A query with fewer than k others gets all of them. Keys are unique. An empty table gives an empty result.
    """
    rows = usable(vectors, key, column)
    whole = rows.select("id", "dim", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("v"))
    sample = whole.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()  # SAMPLE vectors
    dims: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {r.dim for r in sample}:
        own = [r for r in sample if r.dim == d]
        dims[d] = (np.array([r.id for r in own]), np.array([r.v for r in own], float))
    pivots = {d: farthest_first(x, PIVOTS) for d, (_, x) in dims.items()}
    n = rows.count()
    query_blocks, wanted_blocks, near = S.parts(n // every + 1, QUERY_BLOCK), S.parts(n, block), 1
    wide = min(PIVOTS, wanted_blocks)  # a block's vectors have the same nearest ones of so many pivots, so that blocks are of about the wanted size
    while wide**near < wanted_blocks:
        near += 1

    def placed(batches):
        for batch in batches:
            ids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            flat = batch.column(2).flatten().to_numpy().astype("<i4")
            off = np.append(0, np.cumsum(sizes))
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                x = flat[(off[at][:, None] + np.arange(d)).ravel()].reshape(-1, d)
                far = np.ascontiguousarray(distances(x.astype(float), pivots.get(d, np.zeros((0, d)))).T)
                cell = np.zeros(len(at), np.int64)
                for c in np.argsort(far[:, :wide], axis=1, kind="stable")[:, :near].T if far.shape[1] else ():
                    cell = cell * PIVOTS + c
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(sizes[at]), S.blobs(x), S.blobs(far), pa.array(cell)], ["id", "dim", "v", "far", "cell"])

    table = whole.mapInArrow(placed, "id long, dim int, v binary, far binary, cell long")
    sizes = table.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("size"))
    sub = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / block)).cast("int")
    table = S.kept(table.join(sizes, ["dim", "cell"]).select("id", "dim", "v", "far", "cell", sub.alias("sub")), "vectors")

    def numbers(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dim = t["dim"][0].as_py()
        x = packed_rows(t["v"], dim).astype(float)
        return t["id"].to_numpy(), x, packed_rows(t["far"], len(pivots.get(dim, ())), "<f4") if len(pivots.get(dim, ())) else np.zeros((len(x), 0), np.float32)

    def found(q_ids, q, q_far, limits, ids, x, far) -> list[pa.Array]:
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
        norms, far = (x**2).sum(axis=1), np.ascontiguousarray(far.T)
        for i in range(len(q)):
            got, score, _ = best(q[i], int(q_ids[i]), q_far[i], float(limits[i]), x, ids, norms, far, k)
            out.append((np.full(len(got), q_ids[i]), ids[got], score.astype(np.int64)))
        return [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]

    def own_block(t: pa.Table) -> pa.Table:
        """Each query of a block against the block, and the block's bounds as a row without a query."""
        ids, x, far = numbers(t)
        dim, cell, part = (t[c][0].as_py() for c in BLOCK_OF)
        mine = np.flatnonzero(ids % every == 0)
        s_ids, s_x = dims.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
        limits = np.full(len(mine), -np.inf)
        for i, m in enumerate(mine.tolist()):
            seen = np.sort((s_x @ x[m])[s_ids != ids[m]])
            if len(seen) >= k:
                limits[i] = seen[-k]
        got = found(ids[mine], x[mine], far[mine], limits, ids, x, far)
        row = {"dim": dim, "cell": cell, "sub": part, "norm": float((x**2).sum(axis=1).max()), "low": far.min(axis=0).tobytes(), "high": far.max(axis=0).tobytes()}
        m = len(got[0])
        # a query's limit stands beside its id, for those of the sample too
        told = pa.table({"query_id": pa.array(ids[mine]), "vec_id": pa.nulls(len(mine), pa.int64()), "score": pa.nulls(len(mine), pa.int64()), "norm": pa.array(limits)})
        hits = pa.table({"query_id": got[0], "vec_id": got[1], "score": got[2], "norm": pa.nulls(m, pa.float64())})
        edge = pa.table({"query_id": pa.nulls(1, pa.int64()), "vec_id": pa.nulls(1, pa.int64()), "score": pa.nulls(1, pa.int64()), "norm": pa.array([row["norm"]])})
        out = pa.concat_tables([edge, told, hits])
        only = lambda name, kind: pa.concat_arrays([pa.array([row[name]], kind), pa.nulls(out.num_rows - 1, kind)])
        cols = [out["query_id"], out["vec_id"], out["score"], only("dim", pa.int32()), only("cell", pa.int64()), only("sub", pa.int32()), out["norm"], only("low", pa.binary()), only("high", pa.binary())]
        return pa.table(cols, names=["query_id", "vec_id", "score", *BLOCK_OF, "norm", "low", "high"])

    own = S.kept(table.groupBy(*BLOCK_OF).applyInArrow(own_block, OWN), "own")
    hits = own.where("vec_id is not null").select("query_id", "vec_id", "score")
    limit = F.greatest(F.max(F.when(F.col("vec_id").isNull(), F.col("norm"))), F.when(F.count("vec_id") >= k, F.min("score").cast("double")))
    limits = own.where("query_id is not null").groupBy("query_id").agg(limit.alias("limit"))
    edges = own.where("query_id is null").select(*BLOCK_OF, "norm", "low", "high")
    edge_parts = S.parts(edges.count(), 4096)
    queries = table.where(F.col("id") % every == 0).join(limits, F.col("id") == F.col("query_id")).drop("query_id").withColumn("q", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)).cast("int"))
    asked = queries.withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(edge_parts - 1))))
    edges = edges.withColumn("e", F.pmod(F.xxhash64("cell", "sub"), F.lit(edge_parts)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def reached(q_rows: pa.Table, e_rows: pa.Table) -> pa.Table:
        """The queries, once for each block other than their own that may hold a score of their limit or more."""
        if not q_rows.num_rows or not e_rows.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "dim": pa.array([], pa.int32()), "v": pa.array([], pa.binary()), "far": pa.array([], pa.binary()), "limit": pa.array([], pa.float64()), "q": pa.array([], pa.int32()), "cell": pa.array([], pa.int64()), "sub": pa.array([], pa.int32())})
        _, q, far = numbers(q_rows)
        wide = far.shape[1]
        low, high = (packed_rows(e_rows[c], wide, "<f4") if wide else np.zeros((e_rows.num_rows, 0)) for c in ("low", "high"))
        there = may_hold(q, far, q_rows["limit"].to_numpy(), e_rows["norm"].to_numpy(), low, high)
        cell, part = e_rows["cell"].to_numpy(), e_rows["sub"].to_numpy()
        there &= (q_rows["cell"].to_numpy()[:, None] != cell) | (q_rows["sub"].to_numpy()[:, None] != part)
        i, j = np.nonzero(there)
        sent = q_rows.select(["id", "dim", "v", "far", "limit", "q"]).take(pa.array(i))
        return sent.append_column("cell", pa.array(cell[j])).append_column("sub", pa.array(part[j]))

    sent = asked.groupBy("q", "e", "dim").cogroup(edges.groupBy("q", "e", "dim")).applyInArrow(reached, "id long, dim int, v binary, far binary, limit double, q int, cell long, sub int")
    sent = S.kept(sent, "sent")
    wanted = sent.select(*BLOCK_OF, F.col("q").alias("to")).distinct().withColumnRenamed("to", "q")

    def search(x_rows: pa.Table, q_rows: pa.Table) -> pa.Table:
        cols = [pa.array([], pa.int64())] * 3
        if x_rows.num_rows and q_rows.num_rows:
            q_ids, q, q_far = numbers(q_rows)
            cols = found(q_ids, q, q_far, q_rows["limit"].to_numpy(), *numbers(x_rows))
        return pa.table(cols, names=["query_id", "vec_id", "score"])

    by = (*BLOCK_OF, "q")
    more = table.join(wanted, list(BLOCK_OF)).groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.unionByName(more).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
