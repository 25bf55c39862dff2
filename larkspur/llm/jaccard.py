"""N-gram Jaccard join as a blocked sparse product of the document by n-gram matrix with itself.

Rows are documents, columns the n-grams. Only pairs that can reach the threshold are multiplied out:

* equal sets are one row from the start (`classes`);
* a row enters the columns of its prefix only: of its n n-grams in one global order, the first n - ceil(t n) + 1. Two
  sets with Jaccard t or more share one of them. The order puts n-grams of rare words first and those that very many
  documents hold last, so that neither common words nor a common passage bring together all who hold them;
* overlap counts accumulate over the columns a pair shares there, and pairs whose count and remaining sizes can't reach
  the overlap that their sizes ask for are dropped;
* each row has a parity map: about one bit per n-gram, turned over by each n-gram that falls on it. The bits in which two
  maps differ are no more than the n-grams in which the rows differ, so their number bounds the overlap from above;
* the remaining pairs' products are accumulated over blocks of columns, dropping pairs on the way by the same bound. Rows
  stream past the rows of one chunk in the order of their ids, so a task holds one chunk and one batch.

Components, not pairs, are the result, so inside one column all rows are multiplied with a few of the column's rows of like
size first (its least one and two by hashes); only rows that are then still in different components are paired in a second
pass. So a group of many near copies costs a few products per copy, and yet no link between different components is lost.
A column that very many rows hold is dealt out in parts, whose chosen rows then meet in a column of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import kernels as K
from larkspur.llm import spread as S

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Common n-grams and common words that the order knows: at most so many of each, the most frequent ones (16 bytes each, in the closure).
LAST = 1 << 16
#: Column blocks over which a pair's product accumulates.
BLOCKS = 4
#: Rows of a column beyond which it is dealt out in parts, and bytes of entries after which a worker sends them.
SPLIT, FLUSH = 20_000, 4 << 20
#: Seeds of the hashes by which a column's further chosen rows are found.
CHOSEN = (11, 12)


def shingles(data: np.ndarray, off: np.ndarray, n: int, common: tuple[np.ndarray, np.ndarray] | None = None):
    """Distinct n-word shingles (64-bit hashes, ascending in each row), offsets (rows + 1), and with a table of common words and their
    weights the summed weight of each shingle's words."""
    data = LOWER[data]
    s, e, first = K.words(data, off)
    h = K.span_hashes(data, s, e) if len(s) else np.zeros(0, U)
    counts = np.diff(first)
    start = K.ragged(first[:-1], np.maximum(counts - n + 1, 0))
    value = K.gram_hashes(h, n)[start] if len(start) else np.zeros(0, U)
    row = np.repeat(np.arange(len(counts)), np.maximum(counts - n + 1, 0))
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        value = np.concatenate([value, np.concatenate([K.gram_hashes(h[first[r] : first[r + 1]], int(counts[r])) for r in short])])
        row = np.concatenate([row, short])
    order = np.lexsort((value, row))
    keep = np.append(True, (value[order][1:] != value[order][:-1]) | (row[order][1:] != row[order][:-1])) if len(value) else np.zeros(0, bool)
    order = order[keep]
    value, row = value[order], row[order]
    out = value, np.searchsorted(row, np.arange(len(counts) + 1))
    if common is None:
        return out
    known, heavy = common
    w = np.zeros(len(h) + 1, np.int64)
    if len(known) and len(h):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        np.cumsum(np.where(known[at] == h, heavy[at], 0), out=w[1:])
    begin = np.concatenate([start, first[short]])
    return (*out, (w[begin + np.minimum(counts, n)[np.concatenate([np.repeat(np.arange(len(counts)), np.maximum(counts - n + 1, 0)), short])]] - w[begin])[order])


def _sets(batch: pa.RecordBatch, n: int, common=None):
    """Per slice of (doc_id, text): ids, shingles, offsets, and weights where a table of common words is given."""
    ids = batch.column(0).to_numpy()
    data, off = K.column(batch.column(1))
    for i, j in K.slices(off):
        yield (ids[i:j], *shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], n, common))


def _set_hashes(v: np.ndarray, off: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each row's set."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(K.mix(v, seed), dtype=U)])
    return K.mix(sums[off[1:]] - sums[off[:-1]])


def _parity_maps(v: np.ndarray, off: np.ndarray) -> pa.Array:
    """For each row a map of a power of two bits, at least 64 and at least one per n-gram: bit mix(x) turned over by each n-gram x."""
    size = np.diff(off)
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    at = np.append(0, np.cumsum(bits))
    row = K.row_of(off, len(v))
    place = at[row] + (K.mix(v, 9) & (bits[row] - 1).astype(U)).astype(np.int64)
    flat = np.packbits((np.bincount(place, minlength=at[-1]) & 1).astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at // 8), pa.py_buffer(flat)]).cast(pa.binary())


def _folded(maps: np.ndarray, bits: int) -> np.ndarray:
    """Parity maps (rows of uint64 words) of a larger power of two, folded to so many bits."""
    while maps.shape[1] * 64 > bits:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


SIGNED = ["doc_id", "n", "a", "b", "map"]


def _told(key: np.ndarray, count: np.ndarray, kind: int) -> pa.RecordBatch:
    """Counts of shingles (kind 0) or words (kind 1), as rows without a document."""
    return pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.int64()), pa.array(count.astype(np.int64)), pa.array(key.view(np.int64)), pa.array(np.full(len(key), kind)), pa.nulls(len(key), pa.binary())], SIGNED)


def _sign(n: int):
    def sign(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, off = K.column(batch.column(1))
            seen, times, total = [], [], 0
            for i, j in K.slices(off):
                d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                v, at = shingles(d, o, n)
                a, b = _set_hashes(v, at, 3).view(np.int64), _set_hashes(v, at, 4).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), pa.array(np.diff(at)), pa.array(a), pa.array(b), _parity_maps(v, at)], SIGNED)
                u, c = np.unique(v, return_counts=True)
                often = c >= max(4, (j - i) // 200)
                yield _told(u[often], c[often], 0)
                low = LOWER[d]
                s, e, _ = K.words(low, o)
                u, c = np.unique(K.span_hashes(low, s, e), return_counts=True) if len(s) else (np.zeros(0, U), np.zeros(0, np.int64))
                seen.append(u[c > 1])
                times.append(c[c > 1])
                total += len(s)
            if seen:
                u, inverse = np.unique(np.concatenate(seen), return_inverse=True)
                c = np.bincount(inverse, weights=np.concatenate(times), minlength=len(u)).astype(np.int64)
                often = c >= max(4, total // 100_000)
                yield _told(u[often], c[often], 1)

    return sign


def _most_counted(signed: DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The LAST most counted keys of a kind, ascending, and their counts."""
    rows = signed.where(f"doc_id is null and b = {kind}").groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(LAST).collect()
    key, n = np.array([r.a for r in rows], np.int64).view(U), np.array([r.n for r in rows], np.int64)
    order = np.argsort(key)
    return key[order], n[order]


def least_overlap(na, nb, num: int, den: int):
    """The overlap that Jaccard >= num/den asks of sets of these sizes."""
    return -(-num * (na + nb) // (num + den))


PRE = np.dtype([("k", "<u8"), ("set", "<u8"), ("doc", "<i8"), ("n", "<i4"), ("pos", "<i4")])


def _place(p: np.ndarray, split: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A key by which entries go to buckets: the column's, or for a column dealt out in parts, its part's; equal sets go to one part."""
    keys, parts = split
    place = p["k"].copy()
    if len(keys):
        at = np.minimum(np.searchsorted(keys, place), len(keys) - 1)
        hot = np.flatnonzero(keys[at] == place)
        place[hot] = K.mix(place[hot] + p["set"][hot] % parts[at[hot]].astype(U), 5)
    return place


def _prefixes(n: int, num: int, den: int, buckets: int, last: np.ndarray, common: tuple[np.ndarray, np.ndarray], split: tuple[np.ndarray, np.ndarray]):
    def sent(out: list) -> pa.RecordBatch:
        p = np.concatenate(out)
        # equal sets of a batch are one row, that of their least document
        order = np.lexsort((p["doc"], p["n"], p["set"]))
        q = p[order]
        new = np.append(True, (q["set"][1:] != q["set"][:-1]) | (q["n"][1:] != q["n"][:-1]))
        p = q[q["doc"] == q["doc"][new][np.cumsum(new) - 1]]
        order, got, at = S.by_bucket(_place(p, split), buckets)
        p = p[order]
        return pa.RecordBatch.from_arrays([pa.array(got, pa.int32()), S.blobs([p[x:y] for x, y in zip(at[:-1], at[1:], strict=True)])], ["bucket", "entries"])

    def send(batches):
        for batch in batches:
            out, size_out = [], 0
            for ids, v, off, weight in _sets(batch, n, common):
                row, size = K.row_of(off, len(v)), np.diff(off)
                late = last[np.minimum(np.searchsorted(last, v), len(last) - 1)] == v if len(last) else np.zeros(len(v), bool)
                order = np.lexsort((v, weight, late, row))
                pos = np.arange(len(v)) - off[row]
                keep = pos < (size - -(-num * size // den) + 1)[row]
                p = np.empty(int(keep.sum()), PRE)
                p["k"], p["doc"], p["n"], p["pos"] = v[order][keep], ids[row[keep]], size[row[keep]], pos[keep]
                p["set"] = _set_hashes(v, off, 3)[row[keep]]
                out.append(p)
                size_out += p.nbytes
                if size_out >= FLUSH:
                    yield sent(out)
                    out, size_out = [], 0
            if size_out:
                yield sent(out)

    return send


def _chosen(p: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in the order of their columns and of bands of like size, the first of each column and band, and by [way, band] the chosen rows."""
    band = np.floor(np.log(np.maximum(p["n"], 1)) / np.log(den / num) + 1e-9).astype(np.int64)
    order = np.lexsort((p["doc"], band, p["k"]))
    p, band = p[order], band[order]
    head = np.append(True, (p["k"][1:] != p["k"][:-1]) | (band[1:] != band[:-1])) if len(p) else np.zeros(0, bool)
    at, own = np.flatnonzero(head), np.cumsum(head) - 1
    chosen = [at]
    for seed in CHOSEN:
        by = np.lexsort((K.mix(p["doc"].view(U), seed), own))
        chosen.append(by[at])
    return p, band, np.stack(chosen) if len(p) else np.zeros((1, 0), np.int64)


def _paired(p: np.ndarray, num: int, den: int) -> tuple[pa.Table, np.ndarray]:
    """Products of the rows of each column with the column's chosen rows of like size, counted by pair; and the chosen entries."""
    p, band, chosen = _chosen(p, num, den)
    at = chosen[0]
    own = np.searchsorted(at, np.arange(len(p)), "right") - 1
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for back in (0, 1):  # the chosen rows of the own band, and of the band before in the same column
        g = own - back
        for lead in chosen[:, np.maximum(g, 0)] if len(p) else ():
            ok = (g >= 0) & (p["k"][lead] == p["k"]) & (p["doc"][lead] != p["doc"]) & (band - band[lead] <= 1)
            i = np.flatnonzero(ok & (den * np.minimum(p["n"], p["n"][lead]) >= num * np.maximum(p["n"], p["n"][lead])))
            left.append(i)
            right.append(lead[i])
    i, j = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((p["k"][i], p["doc"][j], p["doc"][i]))
    i, j = i[order], j[order]
    once = np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])) if len(i) else np.zeros(0, bool)  # a row may be chosen twice
    i, j = i[once], j[once]
    u, v = p["doc"][i], p["doc"][j]
    one = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))) if len(u) else np.zeros(0, np.int64)
    most = lambda x: np.maximum.reduceat(x, one) if len(one) else np.zeros(0, np.int32)
    pairs = S.table(u=pa.array(u[one]), v=pa.array(v[one]), nu=pa.array(p["n"][i][one]), nv=pa.array(p["n"][j][one]), c=pa.array(np.diff(np.append(one, len(u)))), iu=pa.array(most(p["pos"][i])), iv=pa.array(most(p["pos"][j])))
    return pairs, p[np.unique(chosen)] if len(p) else p


PAIR = "u long, v long, nu int, nv int, c long, iu int, iv int"


def _entries(p: np.ndarray, chosen: bool) -> pa.Table:
    """Entries as rows without v: column k, document u, size nu, place iu; c is 1 for the chosen ones of a column in parts, else 0."""
    m = len(p)
    return S.table(u=pa.array(p["doc"]), v=pa.nulls(m, pa.int64()), nu=pa.array(p["n"]), nv=pa.nulls(m, pa.int32()), c=pa.array(np.full(m, int(chosen))), iu=pa.array(p["pos"]), iv=pa.nulls(m, pa.int32()), k=pa.array(p["k"].view(np.int64)))


def _columns(num: int, den: int, split: tuple[np.ndarray, np.ndarray]):
    """Of a bucket of columns: products with chosen rows, the entries of shared columns, and the chosen entries of columns in parts."""

    def in_parts(k: np.ndarray) -> np.ndarray:
        keys = split[0]
        return keys[np.minimum(np.searchsorted(keys, k), len(keys) - 1)] == k if len(keys) else np.zeros(len(k), bool)

    def multiply(sent: pa.Table) -> pa.Table:
        p, _ = S.joined(sent["entries"], PRE)
        p = p[np.lexsort((p["doc"], p["n"], p["set"], p["k"]))]
        if len(p):  # equal sets are one row, that of their least document
            p = p[np.append(True, (p["k"][1:] != p["k"][:-1]) | (p["set"][1:] != p["set"][:-1]) | (p["n"][1:] != p["n"][:-1]))]
        new = np.append(True, p["k"][1:] != p["k"][:-1]) if len(p) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        p = p[(np.bincount(group) > 1)[group] | in_parts(p["k"])] if len(p) else p
        pairs, chosen = _paired(p, num, den)
        pairs = pairs.append_column("k", pa.nulls(pairs.num_rows, pa.int64()))
        return pa.concat_tables([pairs, _entries(p, False), _entries(chosen[in_parts(chosen["k"])], True)])

    return multiply


def _chosen_columns(num: int, den: int):
    """As _columns, of the chosen entries of one column in parts."""

    def multiply(rows: pa.Table) -> pa.Table:
        p = np.zeros(rows.num_rows, PRE)
        p["k"], p["doc"], p["n"], p["pos"] = rows["k"].to_numpy().view(U), rows["u"].to_numpy(), rows["nu"].to_numpy(), rows["iu"].to_numpy()
        return _paired(p, num, den)[0]

    return multiply


def _possible(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs without those whose sizes and overlap so far rule them out."""
    acc = pairs.groupBy("u", "v").agg(F.first("nu").alias("nu"), F.first("nv").alias("nv"), F.sum("c").alias("c"), F.max("iu").alias("iu"), F.max("iv").alias("iv"))
    most = F.col("c") + F.least(F.col("nu") - F.col("iu") - 1, F.col("nv") - F.col("iv") - 1)
    return acc.where(most * (num + den) >= (F.col("nu") + F.col("nv")) * num).select("u", "v", "nu", "nv")


def _near_maps(num: int, den: int):
    """Pairs u, v, nu, nv whose parity maps mu, mv leave the overlap that their sizes ask for possible."""

    def near(batches):
        for batch in batches:
            nu, nv = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
            most = (nu + nv - 2 * least_overlap(nu, nv, num, den)).astype(np.int64)  # n-grams that only one of the two may hold
            (mu, ou), (mv, ov) = K.column(batch.column(4)), K.column(batch.column(5))
            wu, wv = np.diff(ou), np.diff(ov)
            keep = np.zeros(batch.num_rows, bool)
            for a, b in sorted({*zip(wu.tolist(), wv.tolist(), strict=True)}):
                rows = np.flatnonzero((wu == a) & (wv == b))
                for at in range(0, len(rows), max(1, (4 << 20) // (a + b))):
                    r = rows[at : at + max(1, (4 << 20) // (a + b))]
                    x = mu[K.ragged(ou[r], wu[r])].view(U).reshape(len(r), -1)
                    y = mv[K.ragged(ov[r], wv[r])].view(U).reshape(len(r), -1)
                    bits = 8 * min(a, b)
                    keep[r] = np.bitwise_count(_folded(x, bits) ^ _folded(y, bits)).sum(axis=1, dtype=np.int64) <= most[r]
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep))

    return near


def _close(pairs: DataFrame, maps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that their parity maps leave."""
    with_maps = pairs.join(maps.select(F.col("doc_id").alias("u"), F.col("map").alias("mu")), "u").join(maps.select(F.col("doc_id").alias("v"), F.col("map").alias("mv")), "v")
    return with_maps.select("u", "v", "nu", "nv", "mu", "mv").mapInArrow(_near_maps(num, den), "u long, v long, nu int, nv int")


def _rows(n: int):
    """Rows of the matrix: doc_id and its n-grams, ascending, packed."""

    def rows(batches):
        for batch in batches:
            for ids, v, off in _sets(batch, n):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(off.astype(np.int64) * 8), pa.py_buffer(v)]).cast(pa.binary())], ["doc_id", "row"])

    return rows


EDGES = np.array([(1 << 64) // BLOCKS * i for i in range(1, BLOCKS)], U)


def _products(num: int, den: int):
    """Pairs that link. Rows arrive by chunk: first the chunk's own, then by v the row of v and its pairs. A pair's product is
    accumulated block of columns by block, and given up where what is left can't reach the overlap it needs."""

    def cuts(row: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.searchsorted(row, EDGES), [len(row)]])

    def multiply(right: np.ndarray, rows: list, need: np.ndarray) -> np.ndarray:
        acc, live = np.zeros(len(rows), np.int64), np.arange(len(rows))
        at, ats = cuts(right), [cuts(r) for r in rows]
        left, left_v = np.array([len(r) for r in rows], np.int64), len(right)
        for b in range(BLOCKS):
            block = right[at[b] : at[b + 1]]
            part = [rows[i][ats[i][b] : ats[i][b + 1]] for i in live.tolist()]
            sizes = np.array([len(r) for r in part], np.int64)
            if len(block) and sizes.sum():
                cat = np.concatenate(part)
                total = np.append(0, np.cumsum(block[np.minimum(np.searchsorted(block, cat), len(block) - 1)] == cat))
                ends = np.cumsum(sizes)
                acc[live] += total[ends] - total[ends - sizes]
            left[live] -= sizes
            left_v -= len(block)
            live = live[acc[live] + np.minimum(left[live], left_v) >= need[live]]
            if not len(live):
                break
        return live

    def products(batches):
        chunk, own, right = None, {}, np.zeros(0, U)
        for batch in batches:
            chunks, kinds, us, vs = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2, 3, 1))
            head = np.flatnonzero(np.append(True, (chunks[1:] != chunks[:-1]) | (kinds[1:] != kinds[:-1]) | (vs[1:] != vs[:-1])))
            made_u, made_v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x, y in zip(head.tolist(), [*head[1:].tolist(), batch.num_rows], strict=True):
                if chunks[x] != chunk:
                    chunk, own = chunks[x], {}
                if kinds[x] == 0:
                    own.update((u, np.frombuffer(r, U)) for u, r in zip(us[x:y].tolist(), batch.column(6).slice(x, y - x).to_pylist(), strict=True))
                elif kinds[x] == 1:
                    right = np.frombuffer(batch.column(6)[x].as_py(), U)
                else:
                    for i in range(x, y, 512):
                        j = min(i + 512, y)
                        nu, nv = (batch.column(c).slice(i, j - i).to_numpy().astype(np.int64) for c in (4, 5))
                        live = multiply(right, [own[u] for u in us[i:j].tolist()], least_overlap(nu, nv, num, den))
                        made_u.append(us[i:j][live])
                        made_v.append(vs[i:j][live])
            u, v = np.concatenate(made_u).astype(np.int64), np.concatenate(made_v).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return products


def _verified(docs: DataFrame, pairs: DataFrame, n: int, num: int, den: int, chunk_bytes: int) -> DataFrame:
    """Those pairs u, v that link. Only rows in a pair are made; the row of v goes once to each chunk that holds a partner u."""
    ends = pairs.select(F.col("u").alias("doc_id"), F.col("nu").alias("n")).union(pairs.select("v", "nv")).distinct()
    needed = S.kept(ends, "needed")
    size = needed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * 8
    chunks = S.parts(size, chunk_bytes)
    rows = docs.select("doc_id", "text").join(needed.select("doc_id").hint("merge"), "doc_id", "left_semi").mapInArrow(_rows(n), "doc_id long, row binary")
    rows = S.kept(rows, "rows")
    chunk = F.pmod(F.xxhash64("u"), F.lit(chunks)).cast("int").alias("chunk")
    no = lambda kind: F.lit(None).cast(kind)
    pairs = pairs.select(chunk, "v", F.lit(2).alias("kind"), "u", "nu", "nv", no("binary").alias("row"))
    own = rows.join(pairs.select("u").distinct(), rows.doc_id == F.col("u"), "left_semi").withColumnRenamed("doc_id", "u").select(chunk, F.lit(-(2**63)).cast("long").alias("v"), F.lit(0).alias("kind"), "u", F.lit(0).alias("nu"), F.lit(0).alias("nv"), "row")
    sent = rows.join(pairs.select("chunk", "v").distinct(), rows.doc_id == F.col("v")).select("chunk", "v", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("u"), F.lit(0).alias("nu"), F.lit(0).alias("nv"), "row")
    work = own.unionByName(sent).unionByName(pairs).repartition(chunks, "chunk").sortWithinPartitions("chunk", "v", "kind")
    return S.kept(work.mapInArrow(_products(num, den), "u long, v long"), "links")


def jaccard_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, chunk_bytes: int = S.CHUNK_BYTES, split: int = SPLIT) -> DataFrame:
    """doc_id, n_shingles, component_id: documents link where Jaccard of their n-word shingle sets is num/den or more.

    docs: doc_id (unique, not null) and text; other columns are ignored. Words are lower-cased in A-Z. Fewer than n words make one
    shingle; null texts and texts without words have none, and stand alone. Equal sets link. An empty table gives an
    empty result. `split`: counted rows of a column beyond which it is dealt out in parts; results don't depend on it.
    """
    buckets = S.parts(S.text_bytes(docs)[1] // 2, S.BUCKET_BYTES)
    signed = S.kept(docs.select("doc_id", "text").mapInArrow(_sign(n), "doc_id long, n long, a long, b long, map binary"), "signed")
    (last, times), (words, often) = _most_counted(signed, 0), _most_counted(signed, 1)
    hot = times > split
    parted = last[hot], -(-times[hot] // split)
    sets = signed.where("doc_id is not null")
    maps = sets.select("doc_id", "map")
    classes = S.kept(sets.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep")), "classes")
    entries = docs.select("doc_id", "text").mapInArrow(_prefixes(n, num, den, buckets, last, (words, np.log2(np.maximum(often, 1)).astype(np.int64)), parted), "bucket int, entries binary")
    cols = S.kept(entries.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_columns(num, den, parted), PAIR + ", k long"), "columns")
    first = cols.where("k is null").drop("k").unionByName(cols.where("k is not null and c = 1").groupBy("k").applyInArrow(_chosen_columns(num, den), PAIR))
    first = S.kept(_close(_possible(first, num, den), maps, num, den), "pairs")
    edges = _verified(docs, first, n, num, den, chunk_bytes)
    label = S.components(edges, "u", "v")
    entries = cols.where("k is not null and c = 0").select("k", F.col("u").alias("doc"), F.col("nu").alias("n"), F.col("iu").alias("pos"))
    entries = entries.join(label.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    # columns that hold the same rows, such as those of a passage, are one block: as many columns, each row at its first place there
    held = lambda seed: F.bit_xor(F.xxhash64("doc", F.lit(seed)))
    apart = entries.groupBy("k").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("rows"), held(1).alias("s"), held(2).alias("t")).where("x < y")
    blocks = entries.join(apart.select("k", "rows", "s", "t"), "k").groupBy("rows", "s", "t", "doc", "n", "component").agg(F.count(F.lit(1)).alias("m"), F.min("pos").alias("pos"))
    blocks = S.kept(blocks, "blocks")
    e, f = blocks.alias("e"), blocks.alias("f")
    same = (F.col("e.s") == F.col("f.s")) & (F.col("e.t") == F.col("f.t")) & (F.col("e.rows") == F.col("f.rows"))
    fits = F.expr(f"e.component < f.component and {den} * least(e.n, f.n) >= {num} * greatest(e.n, f.n)")
    # at the first n-gram that a linked pair shares, what is left of the shorter rest holds the whole overlap; later blocks only add to its count
    bound = F.expr(f"least(e.n - e.pos, f.n - f.pos) * {num + den} >= {num} * (e.n + f.n)")
    pairs = e.join(f, same & fits & bound).select(F.col("e.doc").alias("u"), F.col("f.doc").alias("v"), F.col("e.n").alias("nu"), F.col("f.n").alias("nv"), F.col("e.m").alias("c"), F.col("e.pos").alias("iu"), F.col("f.pos").alias("iv"))
    second = S.kept(_close(_possible(pairs, num, den), maps, num, den), "pairs")
    edges = edges.unionByName(_verified(docs, second, n, num, den, chunk_bytes))
    label = S.components(edges, "u", "v")
    named = classes.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").select("n", "a", "b", F.coalesce("component", "rep").alias("component"))
    return sets.join(named, ["n", "a", "b"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
