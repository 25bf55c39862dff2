"""Removal of long byte matches with a run-length index.

Which pairs of places can match is settled first. Each 100-byte window has an anchor: the k-gram in it with the least
hash. Equal windows have equal anchors, so a match of 100 bytes lies between two places with the same anchor, and the windows of one
anchor make a snippet of at most 160 bytes. Anchors go, as packed hashes, to buckets; those found once are done with.
Then, for anchors found again:

* places with the same snippet: the first keeps it, all others lose it (copies add no runs to an index);
* a few different snippets (`DISTINCT` at most): their bucket builds a run-length Burrows-Wheeler index of the earlier
  ones, with the suffix array sampled at the ends of runs, streams the later ones through it for their matching
  statistics, and marks statistics of 100 or more;
* more different snippets, as around a line that very many documents hold: the windows go out one by one, as 128-bit
  hashes, each to the bucket of its hash. That is exact too, and no bucket gets a whole group.

One exchange of the texts serves the three passes over them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import kernels as K
from larkspur.llm import spread as S

U = np.uint64
#: Bytes of an anchor; different snippets of an anchor that an index takes; bits for a place in a slice.
GRAM, DISTINCT, PLACE = 40, 8, 28
#: Snippet bytes of one index, about.
INDEX_BYTES = 1 << 19
ONCE, INDEX, HOT = 0, 1, 2


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """min(v[i:i+w]) for each i that has w values."""
    n = len(v)
    if n < w:
        return v[:0]
    pad = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = v
    block = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


class Anchors:
    """The anchors of a slice: row, place of the anchor, first and last window start (p0, p1), key, snippet hash."""

    def __init__(self, data: np.ndarray, off: np.ndarray, window: int):
        gram = min(GRAM, window)
        n = len(data)
        if n >= 1 << PLACE:
            raise ValueError(f"a text of {n} bytes: places are kept in {PLACE} bits; cut it first")
        z = np.zeros(0, np.int64)
        self.row = self.at = self.p0 = self.p1 = z
        self.key = self.snip = np.zeros(0, U)
        starts = K.ragged(off[:-1], np.maximum(np.diff(off) - window + 1, 0))
        if not len(starts):
            return
        sums = K.prefix_sums(data, K.P1)
        h = K.mix((sums[gram:] - sums[:-gram]) * K.powers(K.P1I, n + 1)[: n + 1 - gram])
        low = U((1 << PLACE) - 1)
        m = sliding_min((h & ~low) | np.arange(len(h), dtype=U), window - gram + 1)[starts]
        at = (m & low).astype(np.int64)
        row = np.repeat(np.arange(len(off) - 1), np.maximum(np.diff(off) - window + 1, 0))
        new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])))
        self.row, self.at, self.p0 = row[new], at[new], starts[new]
        self.p1 = starts[np.append(new[1:], len(starts)) - 1]
        self.key = h[self.at]
        s2 = K.prefix_sums(data, K.P2)
        e = self.p1 + window
        left = (self.at - self.p0).astype(U)
        self.snip = K.mix((s2[e] - s2[self.p0]) * K.powers(K.P2I, n + 1)[self.p0] + (e - self.p0).astype(U) * K.Q1 + left)


class RunIndex:
    """Run-length BWT of a text, suffix array samples at both ends of each run, and comparison of its places by hashes."""

    def __init__(self, text: np.ndarray):
        """text: symbols 1..256 for bytes, 0 between snippets; an end symbol below all is added."""
        t = np.append(text.astype(np.int64) + 1, 0)
        n = len(t)
        key, span = np.zeros(n, np.int64), 6
        for i in range(span):
            key = (key << 9) | np.append(t[i:], np.zeros(min(i, n), np.int64))[:n]
        rank = np.unique(key, return_inverse=True)[1]
        while rank.max() < n - 1:
            key = rank * np.int64(n + 1) + np.append(rank[span:] + 1, np.zeros(min(span, n), np.int64))[:n]
            rank = np.unique(key, return_inverse=True)[1]
            span *= 2
        sa = np.empty(n, np.int64)
        sa[rank] = np.arange(n)
        bwt = t[sa - 1]
        head = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
        self.n, self.start, self.char = n, head, bwt[head]
        self.size = np.diff(np.append(head, n))
        self.first_sample, self.last_sample = sa[head], sa[head + self.size - 1]
        counts = np.bincount(bwt, minlength=259)
        less = np.cumsum(counts) - counts
        order = np.argsort(self.char, kind="stable")
        run = np.cumsum(self.size[order]) - self.size[order]
        self.image = np.empty(len(head), np.int64)  # where the LF mapping takes the first row of each run
        c = self.char[order]
        began = np.searchsorted(c, c)
        self.image[order] = less[c] + run - run[began]
        self.by_char = self.char[order] * np.int64(len(head) + 1) + order  # runs of each character, ascending
        self.sums = K.prefix_sums(np.minimum(np.maximum(t - 2, 0), 255).astype(np.uint8), K.P1)
        zero = np.where(t <= 1, 1, 0)
        self.stop = _next_stop(zero)

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, at most `most`."""
        inv = K.powers(K.P1I, self.n + 1)
        most = np.minimum(most, np.minimum(self.stop[a] - a, self.stop[b] - b))
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = (self.sums[a + mid] - self.sums[a]) * inv[a] == (self.sums[b + mid] - self.sums[b]) * inv[b]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def stream(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Matching statistics of patterns data[start:start+length], all from their last byte on: yields, for each step
        from the end, the indices of the patterns that have a byte there and the length of the longest match that begins with it."""
        order = np.argsort(-lengths, kind="stable")
        row, pos, length = np.zeros(len(starts), np.int64), np.full(len(starts), self.n - 1), np.zeros(len(starts), np.int64)
        runs = len(self.start)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            live = order[: np.searchsorted(-lengths[order], -step, "right")]
            c = data[starts[live] + lengths[live] - step].astype(np.int64) + 2
            r = np.searchsorted(self.start, row[live], "right") - 1
            hit = self.char[r] == c
            a = live[hit]
            row[a] = self.image[r[hit]] + row[a] - self.start[r[hit]]
            pos[a] -= 1
            length[a] += 1
            b, cb = live[~hit], c[~hit]
            if len(b):
                at = np.searchsorted(self.by_char, cb * np.int64(runs + 1) + r[~hit])
                up, down = np.maximum(at - 1, 0), np.minimum(at, runs - 1)
                ok_up = (at > 0) & (self.by_char[up] // (runs + 1) == cb)
                ok_down = (at < runs) & (self.by_char[down] // (runs + 1) == cb)
                run_up, run_down = self.by_char[up] % (runs + 1), self.by_char[down] % (runs + 1)
                p_up, p_down = self.last_sample[run_up], self.first_sample[run_down]
                l_up = np.where(ok_up, self.common(pos[b], p_up, length[b]), -1)
                l_down = np.where(ok_down, self.common(pos[b], p_down, length[b]), -1)
                use_up = l_up >= l_down
                found = ok_up | ok_down
                row[b] = np.where(found, np.where(use_up, self.image[run_up] + self.size[run_up] - 1, self.image[run_down]), 0)
                pos[b] = np.where(found, np.where(use_up, p_up, p_down) - 1, self.n - 1)
                length[b] = np.where(found, np.maximum(l_up, l_down) + 1, 0)
            yield live, length[live]


def _next_stop(zero: np.ndarray) -> np.ndarray:
    """For each place the first place from it on where a snippet ends."""
    n = len(zero)
    at = np.where(zero == 1, np.arange(n), n)
    return np.minimum.accumulate(at[::-1])[::-1]


def mark_earlier(snippets: np.ndarray, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray, rank: np.ndarray, window: int) -> np.ndarray:
    """For each snippet (row), which of its windows also stand in a snippet of the same group with a smaller rank."""
    n = lengths - window + 1
    left = n.copy()
    flat = np.zeros((len(starts), int(n.max(initial=1))), bool)
    sizes = np.bincount(group) if len(group) else np.zeros(0, np.int64)
    for t in range(int(rank.max(initial=0))):
        refs = np.flatnonzero((rank == t) & (sizes[group] > t + 1))
        asks = np.flatnonzero((rank > t) & (left > 0))
        if not len(refs) or not len(asks):
            continue
        total = lengths[refs] + 1
        text = np.zeros(int(total.sum()), np.int64)
        at = np.cumsum(total) - total
        text[K.ragged(at, lengths[refs])] = snippets[K.ragged(starts[refs], lengths[refs])].astype(np.int64) + 1
        for step, (live, length) in enumerate(RunIndex(text).stream(snippets, starts[asks], lengths[asks]), 1):
            if step >= window:
                who = asks[live]
                flat[who, lengths[who] - step] |= length >= window
        left[asks] = n[asks] - flat[asks].sum(axis=1)
    return flat


KEY = np.dtype([("k", "<u8"), ("s", "<u8"), ("f", "u1")])
CLASS = np.dtype([("k", "<u8"), ("f", "u1")])
SNIP = np.dtype([("k", "<u8"), ("s", "<u8"), ("doc", "<i8"), ("at", "<i8"), ("size", "<i4")])
WIN = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("at", "<i8"), ("many", "u1")])
ANSWER = np.dtype([("k", "<u8"), ("s", "<u8"), ("doc", "<i8"), ("at", "<i8"), ("mask", "<u8")])


def _slices(docs: pa.Table, copies: np.ndarray, window: int):
    ids = docs["doc_id"].to_numpy() if docs.num_rows else np.zeros(0, np.int64)
    if len(copies) and len(ids):
        keep = np.flatnonzero(~np.isin(ids, copies))
        docs, ids = docs.take(pa.array(keep)), ids[keep]
    if not len(ids):
        return
    data, off = K.column(docs["text"])
    for i, j in K.slices(off, 1 << 19):
        d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        yield ids[i:j], d, o, Anchors(d, o, window)


def _copies(answer: pa.Table) -> np.ndarray:
    return answer["copy"].drop_null().to_numpy()


def _starts(*cols: np.ndarray) -> np.ndarray:
    """Where a new tuple begins in sorted columns."""
    if not len(cols[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(cols[0]) - 1, bool)
    for c in cols:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.append(True, new))


def _send_keys(window: int, buckets: int, most: int):
    def send(docs: pa.Table, copies: pa.Table) -> pa.Table:
        parts = [(a.key, a.snip) for _, _, _, a in _slices(docs, _copies(copies), window)]
        k, s = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, U), np.zeros(0, U))
        order = np.lexsort((s, k))
        k, s = k[order], s[order]
        at = _starts(k, s)
        out = np.empty(len(at), KEY)
        out["k"], out["s"], out["f"] = k[at], s[at], np.diff(np.append(at, len(k))) > 1
        first = _starts(out["k"])
        many = np.diff(np.append(first, len(out)))
        hot = many > most
        out["f"][first[hot]] = HOT
        drop = np.repeat(hot, many)
        drop[first] = False
        out = out[~drop]
        order, got, at = S.by_bucket(out["k"], buckets)
        out = out[order]
        chunk = docs["chunk"][0].as_py() if docs.num_rows else 0
        return S.table(bucket=pa.array(got, pa.int32()), chunk=pa.array([chunk] * len(got), pa.int32()), keys=S.blobs([out[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]))

    return send


def _per_chunk(chunk: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list]:
    order = np.argsort(chunk, kind="stable")
    own, at = np.unique(chunk[order], return_index=True)
    return own, np.split(rows[order], at[1:]) if len(own) else []


def _classes(sent: pa.Table, most: int) -> pa.Table:
    """For each chunk, its keys that stand in two places or more, and how their windows are compared."""
    e, counts = S.joined(sent["keys"], KEY)
    chunk = np.repeat(sent["chunk"].to_numpy(), counts)
    order = np.lexsort((e["s"], e["k"]))
    e, chunk = e[order], chunk[order]
    first = _starts(e["k"])
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(e))))
    n = np.bincount(group, minlength=len(first))
    distinct = np.bincount(group[_starts(e["k"], e["s"])], minlength=len(first))
    top = np.maximum.reduceat(e["f"], first) if len(first) else np.zeros(0, np.uint8)
    kind = np.where((top == HOT) | (distinct > most), HOT, np.where(distinct > 1, INDEX, ONCE))
    keep = ((n > 1) | (top > 0))[group]
    one = np.flatnonzero(keep)
    pick = one[np.unique(chunk[one].astype(np.int64) * (len(first) + 1) + group[one], return_index=True)[1]]
    out = np.empty(len(pick), CLASS)
    out["k"], out["f"] = e["k"][pick], kind[group[pick]]
    own, rows = _per_chunk(chunk[pick], out)
    return S.table(chunk=pa.array(own, pa.int32()), classes=S.blobs(rows))


def _kind(key: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The class of each key, 255 where it has none. classes: ascending by key."""
    if not len(classes):
        return np.full(len(key), 255, np.uint8)
    at = np.minimum(np.searchsorted(classes["k"], key), len(classes) - 1)
    return np.where(classes["k"][at] == key, classes["f"][at], 255)


def _window_pairs(d: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return K.span_hashes(d, start, start + window, K.P1), K.mix(K.span_hashes(d, start, start + window, K.P2), 9)


def _send_places(window: int, buckets: int):
    def send(docs: pa.Table, answer: pa.Table) -> pa.Table:
        classes = np.sort(S.joined(answer["classes"], CLASS)[0], order="k")
        snips, texts, wins = [], [], []
        for ids, d, o, a in _slices(docs, _copies(answer), window) if len(classes) else ():
            kind = _kind(a.key, classes)
            i = np.flatnonzero(kind <= INDEX)
            p = np.empty(len(i), SNIP)
            p["k"], p["s"], p["doc"], p["at"] = a.key[i], a.snip[i], ids[a.row[i]], a.at[i] - o[a.row[i]]
            p["size"] = np.where(kind[i] == INDEX, a.p1[i] + window - a.p0[i], 0)
            order = np.lexsort((p["at"], p["doc"], p["s"], p["k"]))
            i, p = i[order], p[order]
            first = _starts(p["k"], p["s"])
            i, p = i[first], p[first]
            snips.append(p)
            texts.append(d[K.ragged(a.p0[i], p["size"])])
            i = np.flatnonzero(kind == HOT)
            n = a.p1[i] - a.p0[i] + 1
            start, row = K.ragged(a.p0[i], n), np.repeat(a.row[i], n)
            w = np.zeros(len(start), WIN)
            if len(start):
                w["a"], w["b"] = _window_pairs(d, start, window)
            w["doc"], w["at"] = ids[row], start - o[row]
            wins.append(_fold(w))
        p = np.concatenate(snips) if snips else np.zeros(0, SNIP)
        text = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
        begins = np.cumsum(p["size"], dtype=np.int64) - p["size"]
        order, got, at = S.by_bucket(p["k"], buckets)
        w = _fold(np.concatenate(wins)) if wins else np.zeros(0, WIN)
        w_order, w_got, w_at = S.by_bucket(w["a"], buckets)
        chunk = docs["chunk"][0].as_py() if docs.num_rows else 0
        rows = {int(b): [b"", b"", b""] for b in np.union1d(got, w_got)}
        for b, x, y in zip(got, at[:-1], at[1:], strict=True):
            j = order[x:y]
            rows[int(b)][:2] = p[j].tobytes(), text[K.ragged(begins[j], p["size"][j])].tobytes()
        for b, x, y in zip(w_got, w_at[:-1], w_at[1:], strict=True):
            rows[int(b)][2] = w[w_order[x:y]].tobytes()
        hot = np.ascontiguousarray(classes["k"][classes["f"] == HOT]).tobytes()
        out = [(b, chunk, *v, b"") for b, v in rows.items()] + ([(chunk % buckets, chunk, b"", b"", b"", hot)] if hot else [])
        cols = list(zip(*out, strict=True)) or [[]] * 6
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["bucket", "chunk", "snips", "texts", "wins", "hot"])

    return send


def _fold(w: np.ndarray) -> np.ndarray:
    """One entry per window: its first place, and whether it has others."""
    w = w[np.lexsort((w["at"], w["doc"], w["b"], w["a"]))]
    first = _starts(w["a"], w["b"])
    out = w[first]
    n = np.diff(np.append(first, len(w)))
    out["many"] = (n > 1) | (np.add.reduceat(w["many"].astype(np.int64), first) > 0 if len(first) else False)
    return out


def _match(window: int):
    def match(sent: pa.Table) -> pa.Table:
        chunks = sent["chunk"].to_numpy()
        p, counts = S.joined(sent["snips"], SNIP)
        text, _ = S.joined(sent["texts"], np.uint8)
        chunk = np.repeat(chunks, counts)
        begins = np.cumsum(p["size"], dtype=np.int64) - p["size"]
        order = np.lexsort((p["at"], p["doc"], p["s"], p["k"]))
        p, chunk, begins = p[order], chunk[order], begins[order]
        first = _starts(p["k"], p["s"])  # the first place of each snippet
        n = np.diff(np.append(first, len(p)))
        one = p[first]
        mask = np.zeros(len(one), U)
        long = np.flatnonzero(one["size"] > 0)
        if len(long):
            by = long[np.lexsort((one["at"][long], one["doc"][long], one["k"][long]))]
            heads = _starts(one["k"][by])
            sizes = np.diff(np.append(heads, len(by)))
            group = np.repeat(np.arange(len(heads)), sizes)
            rank = np.arange(len(by)) - np.repeat(heads, sizes)
            size = one["size"][by].astype(np.int64)
            batch = np.cumsum(np.add.reduceat(size, heads))[group] // INDEX_BYTES  # whole groups, a bounded index each
            for b in np.unique(batch):
                own = np.flatnonzero(batch == b)
                flags = mark_earlier(text, begins[first[by[own]]], size[own], group[own] - group[own[0]], rank[own], window)
                mask[by[own]] = (flags[:, :64].astype(U) << np.arange(min(64, flags.shape[1]), dtype=U)).sum(axis=1, dtype=U)
        out = np.zeros(len(p), ANSWER)
        own = np.repeat(np.arange(len(first)), n)
        for c in ("k", "s", "doc", "at"):
            out[c] = one[c][own]
        out["mask"] = mask[own]
        a_own, a_rows = _per_chunk(chunk, out)
        w, counts = S.joined(sent["wins"], WIN)
        chunk = np.repeat(chunks, counts)
        order = np.lexsort((w["at"], w["doc"], w["b"], w["a"]))
        w, chunk = w[order], chunk[order]
        first = _starts(w["a"], w["b"])
        n = np.diff(np.append(first, len(w)))
        own = np.repeat(np.arange(len(first)), n)
        keep = ((n > 1) | (w["many"][first] > 0))[own] if len(w) else np.zeros(0, bool)
        lead = w[first][own] if len(w) else w
        w_own, w_rows = _per_chunk(chunk[keep], lead[keep])
        hot = [(c, h) for c, h in zip(chunks.tolist(), sent["hot"].to_pylist(), strict=True) if h]
        kind = pa.binary()
        none = lambda k: pa.nulls(k, kind)
        return pa.concat_tables([
            S.table(chunk=pa.array(a_own, pa.int32()), answers=S.blobs(a_rows), wins=none(len(a_own)), hot=none(len(a_own))),
            S.table(chunk=pa.array(w_own, pa.int32()), answers=none(len(w_own)), wins=S.blobs(w_rows), hot=none(len(w_own))),
            S.table(chunk=pa.array([c for c, _ in hot], pa.int32()), answers=none(len(hot)), wins=none(len(hot)), hot=pa.array([h for _, h in hot], kind)),
        ])

    return match


def _find(answers: np.ndarray, k: np.ndarray, s: np.ndarray, names: tuple[str, str]) -> np.ndarray:
    """The position of each (k, s) in the answers, ascending by both; -1 where there is none."""
    a, b = (np.ascontiguousarray(answers[c]) for c in names)
    if not len(a):
        return np.full(len(k), -1)
    low, high = np.searchsorted(a, k), np.searchsorted(a, k, "right")
    out = np.full(len(k), -1)
    left = np.flatnonzero(low < high)
    while len(left):  # as often as the most snippets of one key: DISTINCT, or once for windows
        hit = b[low[left]] == s[left]
        out[left[hit]] = low[left[hit]]
        left = left[~hit]
        low[left] += 1
        left = left[low[left] < high[left]]
    return out


def _remove(window: int, texts: bool):
    def remove(docs: pa.Table, answer: pa.Table) -> pa.Table:
        answers = np.sort(S.joined(answer["answers"], ANSWER)[0], order=["k", "s"])
        wins = np.sort(S.joined(answer["wins"], WIN)[0], order=["a", "b"])
        hot = np.sort(S.joined(answer["hot"], "<u8")[0])
        copies = np.sort(_copies(answer))
        rows: list[tuple] = []
        for ids, d, o, a in _slices(docs, copies[:0], window):
            bad = [np.zeros(0, np.int64)]
            copy = np.isin(ids, copies)
            i = _find(answers, a.key, a.snip, ("k", "s"))
            have = np.flatnonzero(i >= 0)
            lead = answers[i[have]]
            first = (lead["doc"] == ids[a.row[have]]) & (lead["at"] == a.at[have] - o[a.row[have]])
            n = a.p1[have] - a.p0[have] + 1
            start = K.ragged(a.p0[have], n)
            bit = start - np.repeat(a.p0[have], n)
            marked = (np.repeat(lead["mask"], n) >> bit.astype(U)) & U(1)
            bad.append(start[~np.repeat(first, n) | (marked == 1)])
            if len(hot):
                j = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, a.key), len(hot) - 1)] == a.key)
                n = a.p1[j] - a.p0[j] + 1
                start, row = K.ragged(a.p0[j], n), np.repeat(a.row[j], n)
                if len(start):
                    i = _find(wins, *_window_pairs(d, start, window), ("a", "b"))
                    lead = wins[np.maximum(i, 0)] if len(wins) else np.zeros(len(i), WIN)
                    bad.append(start[(i >= 0) & ((lead["doc"] != ids[row]) | (lead["at"] != start - o[row]))])
            bad = np.concatenate(bad)
            cover = np.zeros(len(d) + 1, np.int32)
            np.add.at(cover, bad, 1)
            np.add.at(cover, bad + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
            gone[K.ragged(o[:-1][copy], np.where(np.diff(o)[copy] >= window, np.diff(o)[copy], 0))] = True
            gone_at = np.diff(gone.astype(np.int8), prepend=0) == 1
            for r in range(len(ids)):
                x, y = int(o[r]), int(o[r + 1])
                g = gone[x:y]
                spans = int(gone_at[x:y].sum()) + (bool(y > x and g[0]) and not bool(gone_at[x]))
                out = d[x:y][~g].tobytes()
                rows.append((int(ids[r]), y - x, int(g.sum()), spans, K.sha256_hex(out)) + ((out,) if texts else ()))
        cols = list(zip(*rows, strict=True)) or [[]] * (5 + texts)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"][: 5 + texts])

    return remove


def remove_matches(docs: DataFrame, window: int = 100, texts: bool = False, distinct: int = DISTINCT, chunk_bytes: int = S.CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes): bytes outside every `window`-byte string that also starts earlier.

    Earlier is in a smaller doc_id, or before in the same document; overlaps count. docs: doc_id (unique, not null) and
    text; other columns are ignored. Null texts are empty. Copies: the first keeps what it has, the others lose all if they have
    `window` bytes or more. window: 40 to 100; distinct: the different snippets of an anchor up to which an index compares them, results do not
    depend on it. An empty table gives an empty result.
    """
    rows, size = S.text_bytes(docs)
    chunks, buckets = S.parts(size, chunk_bytes), S.parts(size, S.BUCKET_BYTES)
    same = docs.where(F.octet_length("text") >= window).select("doc_id", F.sha2("text", 256).alias("sha"))
    copies = S.later_copies(same, ["sha"]).select(F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk"), F.col("doc_id").alias("copy"))
    copies = S.kept(copies, "copies")
    by_chunk = S.chunked(docs, chunks, "doc_id", "text").groupBy("chunk")

    def with_copies(answer: DataFrame):
        return answer.unionByName(copies, allowMissingColumns=True).groupBy("chunk")

    sent = by_chunk.cogroup(copies.groupBy("chunk")).applyInArrow(_send_keys(window, buckets, distinct), "bucket int, chunk int, keys binary")
    classes = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: _classes(t, distinct), "chunk int, classes binary")
    places = by_chunk.cogroup(with_copies(classes)).applyInArrow(_send_places(window, buckets), "bucket int, chunk int, snips binary, texts binary, wins binary, hot binary")
    answers = places.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_match(window), "chunk int, answers binary, wins binary, hot binary")
    return by_chunk.cogroup(with_copies(answers)).applyInArrow(_remove(window, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * texts)
