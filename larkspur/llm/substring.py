"""Substring removal by recompression: word windows that also start in an earlier document go.

Recompression (Jez, 2013) replaces runs and pairs of neighbouring symbols by new symbols, round after round. The names
are global: a new symbol is a hash of what it replaces, so every executor names the same pair alike. Which neighbours
form a pair follows from the symbols alone (a left and a right class by one bit of each symbol), so two equal substrings
get the same symbols inside, whatever stands around them; only at the two edges may symbols differ.

For each window of `window` words we follow the part of the parse that the window alone determines. The last round in
which something is left gives the window's high-level symbol. Equal windows have equal symbols there, so

1. each chunk of documents sends its distinct high-level symbols, a few bytes of each, to buckets by symbol; a symbol found
   twice goes back to the chunks that hold it (`shared symbols`),
2. chunks send 128-bit hashes of only those windows whose symbol is shared; buckets find the smallest document of each
   (`verification`),
3. chunks remove the covered words.

Copies of an earlier word sequence lose all their words and take no part in this. One exchange of the texts serves the three steps. A passage that a third of all documents hold costs one entry per chunk.
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
#: Rounds of naming after which the windows left keep the symbol they have: each shortens a window by a quarter or more, on average.
ROUNDS = 12


def name_round(sym: np.ndarray, row: np.ndarray, seed: int):
    """One round of run and pair naming over symbols `sym` of documents `row`.

    Returns the new symbols and documents, and for each old symbol the new one from which on a window that begins there
    is determined (`low`), and up to which one that ends there is (`high`).
    """
    n = len(sym)
    low, high = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
    same = np.zeros(n + 1, bool)  # same[i]: symbol i continues the run of i - 1
    same[1:-1] = (sym[1:] == sym[:-1]) & (row[1:] == row[:-1])
    if same.any():
        # a run a..a keeps its first and last symbol and names what is between: of a run at a window's edge, the symbol on the inside is determined
        bounds = np.flatnonzero(~same)
        lengths = np.diff(bounds)
        head, tail = np.repeat(bounds[:-1], lengths), np.repeat(bounds[1:] - 1, lengths)
        inner = same[:-1] & same[1:]
        first = np.flatnonzero(inner & ~np.append(False, inner[:-1]))
        keep = ~inner
        keep[first] = True
        sym = sym.copy()
        sym[first] = K.mix(sym[first] + (tail[first] - head[first] - 1).astype(U) * K.Q2, 7000 + seed)
        index = (np.cumsum(keep) - 1).astype(np.int32)
        low, high = index[tail], index[head]
        sym, row = sym[keep], row[keep]
        n = len(sym)
    right = (K.mix(sym, seed) & U(1)).astype(bool)
    second = np.zeros(n, bool)
    second[1:] = ~right[:-1] & right[1:] & (row[1:] == row[:-1])
    index = np.empty(n + 2, np.int32)
    np.cumsum(~second, out=index[1:-1])
    index[1:-1] -= 1
    index[0], index[-1] = -1, index[-2] + 1
    low = index[low + right[low] + 1]
    high = index[high + right[high]]
    at = np.flatnonzero(second)
    sym = sym.copy()
    sym[at - 1] = K.mix(sym[at - 1] * K.Q1 + sym[at], 9000 + seed)
    return sym[~second], row[~second], low, high


def window_symbols(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: its first word, its document, and its high-level symbol.

    h: word hashes of consecutive documents; first: index of each document's first word (documents + 1).
    """
    row = K.row_of(first, len(h)).astype(np.int32)
    start = K.ragged(first[:-1], np.maximum(np.diff(first) - window + 1, 0)).astype(np.int32)
    symbol = np.zeros(len(start), U)
    live, sym, r, lo, hi = np.arange(len(start), dtype=np.int32), h, row, start, start + np.int32(window - 1)
    for level in range(ROUNDS + 1):
        if not len(live):
            break
        if level < ROUNDS:
            named, r, low, high = name_round(sym, r, level)
            lo2, hi2 = low[lo], high[hi]
            on = lo2 <= hi2
            done = ~on
        else:
            on, done = np.zeros(len(live), bool), np.ones(len(live), bool)
        if done.any():
            other = K.mix(sym, 31)
            symbol[live[done]] = K.mix(np.minimum(other[lo[done]], other[hi[done]]), 100 + level)
        if level < ROUNDS:
            live, sym, lo, hi = live[on], named, lo2[on], hi2[on]
    return start, row[start] if len(start) else start, symbol


def _parsed(docs: pa.Table, window: int):
    """Of each slice of a chunk: document ids, bytes, offsets, word starts and ends, index of first words, word hashes, windows."""
    ids = docs["doc_id"].to_numpy()
    data, off = K.column(docs["text"])
    for i, j in K.slices(off):
        d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        s, e, first = K.words(d, o)
        h = K.span_hashes(d, s, e) if len(s) else np.zeros(0, U)
        yield ids[i:j], d, o, s, e, first, h


def _window_hashes(h: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return K.gram_hashes(h, window, K.Q1)[start], K.gram_hashes(K.mix(h, 77), window, K.Q2)[start]


def _least(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the least value of each, and whether it has two values."""
    order = np.lexsort((value, key))
    k, v = key[order], value[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    last = np.append(at[1:], len(k)) - 1
    return k[at], v[at], v[at] != v[last]


WIN = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("many", "u1")])


def _sequences(batches):
    """doc_id, words, and a 128-bit hash of the word sequence of each document."""
    for batch in batches:
        ids, n_words, a_, b_ = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U)], [np.zeros(0, U)]
        for own, _, _, s, _, first, h in _parsed(pa.Table.from_batches([batch]), 0):
            ids.append(own)
            n_words.append(np.diff(first))
            place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
            for out, seed in ((a_, 5), (b_, 6)):
                sums = np.concatenate([np.zeros(1, U), np.cumsum(K.mix(h, seed) * K.powers(K.Q1, int(place.max(initial=0)) + 1)[place], dtype=U)])
                out.append(K.mix(sums[first[1:]] - sums[first[:-1]]))
        cols = [np.concatenate(x) for x in (ids, n_words, a_, b_)]
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in cols], ["doc_id", "n", "a", "b"])


def _without(docs: pa.Table, copies: pa.Table) -> pa.Table:
    """The documents that are no copies of an earlier one."""
    gone = copies["copy"].drop_null()
    return docs.filter(pc.invert(pc.is_in(docs["doc_id"], gone))) if docs.num_rows and len(gone) else docs


def _send_symbols(window: int, buckets: int, width: int):
    def send(docs: pa.Table, copies: pa.Table) -> pa.Table:
        chunk, keys, owner = docs["chunk"][0].as_py() if docs.num_rows else 0, [], []
        for ids, _, _, _, _, first, h in _parsed(_without(docs, copies), window):
            start, row, symbol = window_symbols(h, first, window)
            u, inverse = np.unique(symbol, return_inverse=True)
            pair = np.unique(inverse.astype(np.int64) * len(ids) + row)  # distinct (symbol, document)
            keys.append(u[pair // max(len(ids), 1)])
            owner.append(ids[pair % max(len(ids), 1)])
        k, _, many = _least(np.concatenate(keys), np.concatenate(owner)) if keys else (np.zeros(0, U), None, np.zeros(0, bool))
        order, got, at = S.by_bucket(k, buckets)
        out = S.narrow_blob(S.narrow(k[order], width) | many[order].astype(U), width)
        return S.table(bucket=pa.array(got, pa.int32()), chunk=pa.array([chunk] * len(got), pa.int32()), keys=S.blobs([out[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]))

    return send


def _shared_symbols(width: int):
    def match(sent: pa.Table) -> pa.Table:
        """Symbols of two documents or more, for each chunk that holds them."""
        got, counts = S.joined_narrow(sent["keys"], width)
        chunk = np.repeat(sent["chunk"].to_numpy(), counts)
        order = np.argsort(got, kind="stable")
        k, many, chunk = got[order] & ~U(1), got[order] & U(1), chunk[order]
        group = np.cumsum(np.append(True, k[1:] != k[:-1])) - 1 if len(k) else np.zeros(0, np.int64)
        keep = ((np.bincount(group) > 1) | (np.bincount(group, weights=many) > 0))[group] if len(k) else np.zeros(0, bool)
        k, chunk = k[keep], chunk[keep]
        order = np.argsort(chunk, kind="stable")
        own, at = np.unique(chunk[order], return_index=True)
        return S.table(chunk=pa.array(own, pa.int32()), shared=S.blobs([S.narrow_blob(x, width) for x in np.split(k[order], at[1:])] if len(own) else []))

    return match


def _send_windows(window: int, buckets: int, width: int):
    def send(docs: pa.Table, answer: pa.Table) -> pa.Table:
        out = []
        shared = np.sort(S.joined_narrow(answer["shared"], width)[0])
        if docs.num_rows and len(shared):
            for ids, _, _, _, _, first, h in _parsed(_without(docs, answer), window):
                start, row, symbol = window_symbols(h, first, window)
                symbol = S.narrow(symbol, width)
                keep = shared[np.minimum(np.searchsorted(shared, symbol), len(shared) - 1)] == symbol
                w = np.empty(int(keep.sum()), WIN)
                w["a"], w["b"] = _window_hashes(h, start[keep], window)
                w["doc"], w["many"] = ids[row[keep]], 0
                out.append(w)
        w = _folded(np.concatenate(out)) if out else np.zeros(0, WIN)
        order, got, at = S.by_bucket(w["a"], buckets)
        w = w[order]
        chunk = docs["chunk"][0].as_py() if docs.num_rows else 0
        return S.table(bucket=pa.array(got, pa.int32()), chunk=pa.array([chunk] * len(got), pa.int32()), windows=S.blobs([w[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]))

    return send


def _folded(w: np.ndarray) -> np.ndarray:
    """One entry per window: its smallest document, and whether it has others."""
    w = w[np.lexsort((w["doc"], w["b"], w["a"]))]
    new = np.flatnonzero(np.append(True, (w["a"][1:] != w["a"][:-1]) | (w["b"][1:] != w["b"][:-1]))) if len(w) else np.zeros(0, np.int64)
    out = w[new]
    last = np.append(new[1:], len(w)) - 1
    out["many"] = (w["doc"][last] != out["doc"]) | (np.add.reduceat(w["many"], new) > 0 if len(new) else False)
    return out


def _first_documents(sent: pa.Table) -> pa.Table:
    """For each chunk, its windows that two documents hold, with the smallest of those."""
    w, counts = S.joined(sent["windows"], WIN)
    chunk = np.repeat(sent["chunk"].to_numpy(), counts)
    order = np.lexsort((w["doc"], w["b"], w["a"]))
    w, chunk = w[order], chunk[order]
    new = np.append(True, (w["a"][1:] != w["a"][:-1]) | (w["b"][1:] != w["b"][:-1])) if len(w) else np.zeros(0, bool)
    group, at = np.cumsum(new) - 1, np.flatnonzero(new)
    keep = (np.bincount(group, minlength=len(at)) + np.bincount(group, weights=w["many"], minlength=len(at)) > 1)[group] if len(w) else new
    out = w[keep].copy()
    out["doc"] = w["doc"][at][group[keep]] if len(w) else out["doc"]
    chunk = chunk[keep]
    order = np.argsort(chunk, kind="stable")
    own, at = np.unique(chunk[order], return_index=True)
    return S.table(chunk=pa.array(own, pa.int32()), earlier=S.blobs(np.split(out[order], at[1:]) if len(own) else []))


def _remove(window: int, texts: bool, carry: tuple[str, ...]):
    def remove(docs: pa.Table, answer: pa.Table) -> pa.Table:
        earlier, _ = S.joined(answer["earlier"], WIN)
        earlier = earlier[np.argsort(earlier["a"], kind="stable")]
        ea, eb, ed = (np.ascontiguousarray(earlier[c]) for c in ("a", "b", "doc"))
        copies = answer["copy"].drop_null().to_numpy()
        n_words, n_removed, sha, kept = [], [], [], []
        for ids, d, o, s, e, first, h in _parsed(docs, window) if docs.num_rows else ():
            gone = np.zeros(len(h), bool)
            if len(ea) and len(h) >= window:
                start = K.ragged(first[:-1], np.maximum(np.diff(first) - window + 1, 0))
                a = K.gram_hashes(h, window, K.Q1)[start]
                at = np.minimum(np.searchsorted(ea, a), len(ea) - 1)
                hit = np.flatnonzero(ea[at] == a)
                b = K.gram_hashes(K.mix(h, 77), window, K.Q2)[start[hit]]
                row = np.searchsorted(first, start[hit], "right") - 1
                bad = start[hit[(eb[at[hit]] == b) & (ed[at[hit]] < ids[row])]]
                cover = np.zeros(len(h) + 1, np.int32)
                np.add.at(cover, bad, 1)
                np.add.at(cover, bad + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
            if len(copies):
                gone |= np.repeat(np.isin(ids, copies) & (np.diff(first) >= window), np.diff(first))
            raw = d.tobytes()
            for r in range(len(ids)):
                x, y = int(first[r]), int(first[r + 1])
                stay = np.flatnonzero(~gone[x:y]) + x
                out = b" ".join([raw[p:q] for p, q in zip(s[stay].tolist(), e[stay].tolist(), strict=True)])
                n_words.append(y - x)
                n_removed.append(y - x - len(stay))
                sha.append(K.sha256_hex(out))
                if texts:
                    kept.append(out if len(stay) < y - x else raw[o[r] : o[r + 1]])
        cols = [docs["doc_id"], *(docs[c] for c in carry), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
        if texts:
            cols.append(pa.array(kept, pa.binary()).cast(pa.string()))
        return pa.table(cols, [str(i) for i in range(len(cols))])

    return remove


def remove_repeats(docs: DataFrame, window: int = 13, texts: bool = False, carry: tuple[str, ...] = (), chunk_bytes: int = S.CHUNK_BYTES) -> DataFrame:
    """doc_id, the columns of `carry`, n_words, n_removed, kept_sha256 (and kept_text): words outside every window that starts in a smaller document too.

    kept_text is the text itself where no word goes (empty for null), else the kept words joined by one space.
    docs: doc_id (unique, not null) and text; other columns are ignored. A null or empty text has no words. Copies: the
    smallest doc_id keeps all its words, the others lose all of them if they have `window` words or more. An empty table
    gives an empty result.
    """
    rows, size = S.text_bytes(docs)
    chunks = S.parts(size, chunk_bytes)
    buckets, width = S.parts(size, S.BUCKET_BYTES), S.key_bytes(size)
    same = docs.select("doc_id", "text").mapInArrow(_sequences, "doc_id long, n long, a long, b long")
    same = S.kept(same.where(f"n >= {window}"), "sequences")
    copies = S.later_copies(same, ["n", "a", "b"]).select(F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk"), F.col("doc_id").alias("copy"))
    copies = S.kept(copies, "copies")
    none = F.lit(None)
    dealt = S.chunked(docs, chunks, "doc_id", "text", *carry)
    by_chunk = dealt.groupBy("chunk")

    def with_copies(answer: DataFrame, column: str):
        told = answer.withColumn("copy", none.cast("long"))
        return told.unionByName(copies.withColumn(column, none.cast("binary"))).groupBy("chunk")

    sent = by_chunk.cogroup(copies.groupBy("chunk")).applyInArrow(_send_symbols(window, buckets, width), "bucket int, chunk int, keys binary")
    shared = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_shared_symbols(width), "chunk int, shared binary")
    wins = by_chunk.cogroup(with_copies(shared, "shared")).applyInArrow(_send_windows(window, buckets, width), "bucket int, chunk int, windows binary")
    first = wins.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_first_documents, "chunk int, earlier binary")
    schema = docs.select("doc_id", *carry).schema
    for name, kind in (("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string"), ("kept_text", "string"))[: 3 + texts]:
        schema = schema.add(name, kind)
    return by_chunk.cogroup(with_copies(first, "earlier")).applyInArrow(_named(_remove(window, texts, carry), schema.names), schema)


def _named(f, names: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return f(left, right).rename_columns(names)

    return run
