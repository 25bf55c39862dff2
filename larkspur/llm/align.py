"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text, and how usual each such pair is.

Both tokenizers cut the same bytes, a blank and the text. Byte offsets where tokens of both end cut a text into groups; tokens whose
byte ranges overlap are linked. Between two neighbouring token ends, of whichever tokenizer, lies the overlap of exactly one pair, so links
and groups of many texts come from marks on their bytes, by array operations.

Very long texts are cut into byte ranges that are tokenized in different tasks. The two tokenizers can't be cut at the same places: each range
takes A's tokens from one place near its border and B's from another. A range is a *fragment*: an open prefix (tokens up to the first common
end), closed groups, and an open suffix (tokens behind the last). Composing two neighbours closes what lies between them; this is
associative, so fragments are composed in a tree over Spark tasks, only open parts travel upward, and closed groups stay as they are.

Counts of id pairs go from chunks of documents to buckets of A ids and back as packed arrays, so a pair that every document holds is one
entry per chunk.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import kernels as K
from larkspur.llm import spread as S
from larkspur.llm.tokens import WordStore, byte_letters

#: Bytes of a range of a long text; fragments composed by a task; chunks whose pairs meet in one group; most buckets; ids that a worker keeps.
PIECE, FAN, PART_CHUNKS, BUCKETS, POOL = 1 << 16, 8, 1024, 1024, 1 << 24
#: Fixed value: how byte-level vocabularies of this family split a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units that the fast encoder takes; all others go to the tokenizer's own library.
PLAIN = re.compile(r"[\n -~À-ÖØ-öø-ÿ]*")
BAD = np.uint32(0xFFFFFFFF)


class Pair:
    """Tokenizers A (byte-level BPE) and B (SentencePiece) of a worker, and how many bytes each of their tokens covers."""

    def __init__(self, a_path: str, b_path: str):
        import json

        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = byte_letters(), model["vocab"]
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in token)
        ranks, ids = {}, []
        for token in [*letters, *("".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"])]:
            if ranks.setdefault(bytes(letters[c] for c in token), len(ids)) == len(ids):
                ids.append(vocab[token])
        self.a_ids = np.array(ids, np.uint32)
        self.fast = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.b = SentencePieceProcessor(model_file=b_path)
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.get_piece_size())]
        self.mark = self.b.piece_to_id("▁")
        self.la, self.lb = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        text = lambda t, end: [b"%d%s" % (i, end) for i in range(len(t))]
        self.written = np.array(text(self.a_bytes, b",") + text(self.a_bytes, b"|") + text(self.b_bytes, b",") + text(self.b_bytes, b";"), object)
        self.kept_a, self.kept_b = WordStore(), WordStore()

    def encode_a(self, runs: list[bytes]) -> list[np.ndarray]:
        """A's ids of runs of text that each begin where A cuts; BAD where the tokens' bytes aren't the run's."""
        texts = [u.decode("utf-8", "replace") for u in runs]
        plain = [bool(PLAIN.fullmatch(t)) for t in texts]
        slow = iter(self.a.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        ids = [self.a_ids[self.fast.encode_ordinary(t)] if p else np.array(next(slow).ids, np.uint32) for t, p in zip(texts, plain, strict=True)]
        return [x if b"".join([self.a_bytes[i] for i in x.tolist()]) == u else np.array([BAD]) for u, x in zip(runs, ids, strict=True)]

    def encode_b(self, runs: list[bytes]) -> list[np.ndarray]:
        """B's ids likewise, of runs that begin with a blank, which B adds by itself."""
        ids = self.b.encode([u[1:].decode("utf-8", "replace") for u in runs], num_threads=1)
        ids = [np.array([self.mark] if u == b" " else x, np.uint32) for u, x in zip(runs, ids, strict=True)]
        return [x if b"".join([self.b_bytes[i] for i in x.tolist()]) == u else np.array([BAD]) for u, x in zip(runs, ids, strict=True)]

    def rows(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's ids of all rows and their offsets, and B's; rows hold a blank and a text, or nothing. Rows whose bytes differ have no tokens.
        Each distinct unit (a run of blanks and what follows) is encoded once."""
        starts, first = units(data, off)
        if not len(starts):
            none = np.zeros(len(off), np.int64)
            return np.zeros(0, np.uint32), none, np.zeros(0, np.uint32), none
        ends = np.append(starts[1:], off[-1])
        u, one, inverse = np.unique(K.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if max(self.kept_a.used, self.kept_b.used) > POOL:
            self.kept_a.forget()
        new = self.kept_a.missing(u)
        if not len(self.kept_a.key):
            self.kept_b.forget()
        if len(new):
            raw, pick = data.tobytes(), one[new]
            runs = [raw[s:e] for s, e in zip(starts[pick].tolist(), ends[pick].tolist(), strict=True)]
            for store, ids in ((self.kept_a, self.encode_a(runs)), (self.kept_b, self.encode_b(runs))):
                store.add(u[new], np.concatenate(ids), np.array([len(x) for x in ids], np.int64))
        out, bad = [], np.zeros(len(off) - 1, bool)
        for store in (self.kept_a, self.kept_b):
            ids, at = store.ids(u, inverse, first)
            bad[np.searchsorted(at, np.flatnonzero(ids == BAD), "right") - 1] = True
            out.append((ids, at))
        if bad.any():
            out = [(ids[np.repeat(~bad, np.diff(at))], np.concatenate([[0], np.cumsum(np.where(bad, 0, np.diff(at)))])) for ids, at in out]
        return *out[0], *out[1]


_open: dict[tuple[str, str], Pair] = {}


def pair_of(a_path: str, b_path: str) -> Pair:
    """The worker's own copy, read once."""
    if (a_path, b_path) not in _open:
        _open[a_path, b_path] = Pair(a_path, b_path)
    return _open[a_path, b_path]


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the units of all rows start, and the index of each row's first (rows + 1): at a blank behind a character that is no white space,
    where both tokenizers cut. Characters that may be white space beyond ASCII don't count, nor control characters."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n:
        p = np.flatnonzero(data[1:] == 32) + 1
        one, two, three = data[p - 1], data[np.maximum(p - 2, 0)], data[np.maximum(p - 3, 0)]
        wide = (one >= 128) & ~((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) & ~np.isin(three, (0xE1, 0xE2, 0xE3))
        cut[p[((one > 32) & (one < 127)) | wide]] = True
        cut[off[:-1][np.diff(off) > 0]] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, off)


def with_blanks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a blank before each that isn't empty."""
    size = np.diff(off)
    more = np.concatenate([[0], np.cumsum(np.where(size > 0, size + 1, 0))])
    out = np.full(int(more[-1]), 32, np.uint8)
    out[K.ragged(more[:-1] + (size > 0), size)] = data
    return out, more


class Aligned:
    """Links and groups of rows of tokens: A's ids with row offsets, and B's, both over the same bytes."""

    def __init__(self, tok: Pair, a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray):
        self.tok, self.a, self.b, self.a_off, self.b_off = tok, a, b, a_off, b_off
        self.a_end, self.b_end = np.cumsum(tok.la[a]), np.cumsum(tok.lb[b])
        n = int(self.a_end[-1]) if len(a) else 0
        in_a, in_b = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        in_a[self.a_end], in_b[self.b_end] = True, True
        at = np.flatnonzero(in_a | in_b)
        self.link_a, self.link_b = np.cumsum(in_a)[at] - in_a[at], np.cumsum(in_b)[at] - in_b[at]
        self.common = np.flatnonzero(in_a & in_b)
        ends = np.append(0, self.a_end)[a_off[1:]]
        self.row = np.searchsorted(ends, at, "left")
        self.link_off = np.concatenate([[0], np.searchsorted(at, ends, "right")])
        self.n_groups = np.diff(np.concatenate([[0], np.searchsorted(self.common, ends, "right")]))

    def pairs(self) -> np.ndarray:
        """Each link's ids as one number."""
        return self.a[self.link_a].astype(np.int64) * len(self.tok.b_bytes) + self.b[self.link_b]

    def digests(self) -> list[str]:
        """Of each row's groups as text: ids of A, a bar, ids of B, a semicolon; '' where a row has no tokens."""
        a_of, b_of = np.searchsorted(self.common, self.a_end), np.searchsorted(self.common, self.b_end)
        a_thru, b_thru = (np.cumsum(np.bincount(x, minlength=len(self.common))) for x in (a_of, b_of))
        b_before = np.append(0, b_thru)[:-1]
        na, nb = len(self.tok.a_bytes), len(self.tok.b_bytes)
        code = np.zeros(len(self.a) + len(self.b), np.int64)
        last = lambda of: np.append(of[1:] != of[:-1], True)[: len(of)]
        code[np.arange(len(self.a)) + b_before[a_of]] = self.a + na * last(a_of)
        code[np.arange(len(self.b)) + a_thru[b_of]] = 2 * na + self.b + nb * last(b_of)
        out = []
        at = (self.a_off + self.b_off).tolist()
        for s, e in zip(at[:-1], at[1:], strict=True):
            out.append(hashlib.sha256(b"".join(self.tok.written[code[s:e]].tolist())[:-1]).hexdigest() if e > s else "")
        return out


# --- very long texts: fragments ---------------------------------------------------------------------------------------------------------


class Run:
    """Tokens of A from byte a_at on and of B from byte b_at on, one after another."""

    def __init__(self, a_at: int, a: np.ndarray, b_at: int, b: np.ndarray):
        self.a_at, self.a, self.b_at, self.b = a_at, a, b_at, b

    def __add__(self, other: Run) -> Run:
        return Run(self.a_at, np.concatenate([self.a, other.a]), self.b_at, np.concatenate([self.b, other.b]))

    def parted(self, tok: Pair) -> tuple[Run, Run | None, Run | None]:
        """Up to the first common end, up to the last one, and behind it; only the first where there is none."""
        ea, eb = self.a_at + np.cumsum(tok.la[self.a]), self.b_at + np.cumsum(tok.lb[self.b])
        both = np.intersect1d(ea, eb, assume_unique=True)
        if not len(both):
            return self, None, None
        low, high = int(both[0]), int(both[-1])
        (i, j), (k, m) = np.searchsorted(ea, (low, high), "right"), np.searchsorted(eb, (low, high), "right")
        return Run(self.a_at, self.a[:i], self.b_at, self.b[:k]), Run(low, self.a[i:j], low, self.b[k:m]), Run(high, self.a[j:], high, self.b[m:])


class Fragment:
    """An open prefix and an open suffix; a fragment without a common end is a prefix only. ok: all tokens' bytes are the text's."""

    def __init__(self, ok: bool, prefix: Run, suffix: Run | None):
        self.ok, self.prefix, self.suffix = ok, prefix, suffix

    @classmethod
    def lift(cls, tok: Pair, ok: bool, run: Run) -> tuple[Fragment, list[Run]]:
        prefix, closed, suffix = run.parted(tok)
        return cls(ok, prefix, suffix), [closed] if closed is not None and len(closed.a) else []

    def then(self, tok: Pair, right: Fragment) -> tuple[Fragment, list[Run]]:
        """The two as one, and the groups that this closes."""
        ok = self.ok and right.ok
        if not ok:
            return Fragment(False, _NOTHING, None), []
        prefix, closed, suffix = ((self.prefix if self.suffix is None else self.suffix) + right.prefix).parted(tok)
        if self.suffix is None and closed is None:
            return Fragment(True, prefix, None), []
        if self.suffix is not None:  # what was open between the two is closed up to its last common end
            done = [] if closed is None else [prefix + closed]
            rest = prefix if closed is None else suffix
            return Fragment(True, self.prefix, rest if right.suffix is None else right.suffix), done
        return Fragment(True, prefix, suffix if right.suffix is None else right.suffix), [closed] if len(closed.a) else []


_NOTHING = Run(0, np.zeros(0, np.uint32), 0, np.zeros(0, np.uint32))
FRAGMENT = "row long, id long, i long, open boolean, ok boolean, has boolean, pa_at long, pa binary, pb_at long, pb binary, sa_at long, sa binary, sb_at long, sb binary"
NAMES = [c.split()[0] for c in FRAGMENT.split(", ")]


def _cut(piece: int):
    """Byte ranges of long texts, each once for A and once for B, from the first place behind the border where that tokenizer cuts."""

    def run(batches):
        for batch in batches:
            for row, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = b" " + text.encode()
                data = np.frombuffer(raw, np.uint8)
                kind = np.zeros(256, np.uint8)  # letters 1, figures 2, visible marks 3, white space 4
                kind[33:127], kind[48:58] = 3, 2
                kind[65:91], kind[97:123] = 1, 1
                kind[[32, 9, 10, 11, 12, 13]] = 4
                k = kind[data]
                before, now = k[:-1], k[1:]
                a_cut = np.flatnonzero((before > 0) & (before < 4) & ((now == 4) | (before + now == 3) & (before > 0) & (now > 0))) + 1
                b_cut = np.flatnonzero((data[1:] == 32) & (data[:-1] != 32)) + 1
                borders = np.arange(0, len(raw), piece)[1:]
                a_at, b_at = ([0, *np.append(c, len(raw))[np.searchsorted(c, borders)].tolist(), len(raw)] for c in (a_cut, b_cut))
                for i in range(len(borders) + 1):
                    yield pa.RecordBatch.from_pylist([{"row": row, "id": key, "i": i, "a_at": a_at[i], "a": raw[a_at[i] : a_at[i + 1]], "b_at": b_at[i], "b": raw[b_at[i] : b_at[i + 1]]}], schema=_PIECES)

    return run


_PIECES = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("i", pa.int64()), ("a_at", pa.int64()), ("a", pa.binary()), ("b_at", pa.int64()), ("b", pa.binary())])


def _open_row(row: int, key: int | None, i: int, f: Fragment) -> tuple:
    s = f.suffix or _NOTHING
    return (row, key, i, True, f.ok, f.suffix is not None, f.prefix.a_at, K.pack(f.prefix.a), f.prefix.b_at, K.pack(f.prefix.b), s.a_at, K.pack(s.a), s.b_at, K.pack(s.b))


def _closed_row(row: int, key: int | None, r: Run) -> tuple:
    return (row, key, None, False, True, True, r.a_at, K.pack(r.a), r.b_at, K.pack(r.b), None, None, None, None)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.bool_()] * 3 + [pa.int64(), pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)


def _lift(paths: tuple[str, str]):
    def run(batches):
        tok = pair_of(*paths)
        for batch in batches:
            for r in batch.to_pylist():
                a, b = (encode([x])[0] if x else _NOTHING.a for encode, x in ((tok.encode_a, r["a"]), (tok.encode_b, r["b"])))
                ok = BAD not in a and BAD not in b
                f, closed = Fragment.lift(tok, ok, Run(r["a_at"], a, r["b_at"], b)) if ok else (Fragment(False, _NOTHING, None), [])
                yield _as_batch([_open_row(r["row"], r["id"], r["i"], f), *(_closed_row(r["row"], r["id"], c) for c in closed)])

    return run


def _compose(paths: tuple[str, str], fan: int):
    """Neighbouring fragments as one."""

    def run(t: pa.Table) -> pa.Table:
        tok = pair_of(*paths)
        ids = lambda x: np.frombuffer(x, np.uint32)
        rows = sorted(t.to_pylist(), key=lambda r: r["i"])
        whole, closed = None, []
        for r in rows:
            f = Fragment(r["ok"], Run(r["pa_at"], ids(r["pa"]), r["pb_at"], ids(r["pb"])), Run(r["sa_at"], ids(r["sa"]), r["sb_at"], ids(r["sb"])) if r["has"] else None)
            if whole is None:
                whole = f
            else:
                whole, done = whole.then(tok, f)
                closed += done
        return pa.Table.from_batches([_as_batch([_open_row(rows[0]["row"], rows[0]["id"], rows[0]["i"] // fan, whole), *(_closed_row(rows[0]["row"], rows[0]["id"], c) for c in closed)])])

    return run


def closed_runs(long: DataFrame, paths: tuple[str, str], piece: int = PIECE, fan: int = FAN) -> DataFrame:
    """row, id, start, a, b: the closed groups of long texts (row, id, text), runs of them, one after another; for a text that has no tokens one row of nulls."""
    # the number that tells rows apart is written with the ranges, so it doesn't change when a task runs again
    pieces = S.kept(long.mapInArrow(_cut(piece), "row long, id long, i long, a_at long, a binary, b_at long, b binary"), "ranges")
    most = pieces.agg(F.max("i")).first()[0]
    parts = S.parts(pieces.count(), 64)
    at = S.kept(pieces.repartition(parts, "row", "i").mapInArrow(_lift(paths), FRAGMENT), "fragments")
    closed = at.where("not open")
    while most:
        most //= fan
        at = S.kept(at.where("open").groupBy("row", F.expr(f"i div {fan}").alias("up")).applyInArrow(_compose(paths, fan), FRAGMENT), "fragments")
        closed = closed.unionByName(at.where("not open"))
    root = at.where("open")
    # at the root nothing is open: a text begins and ends with both tokenizers
    runs = closed.join(root.where("ok").select("row"), "row", "left_semi").unionByName(root.where("ok"))
    rows = runs.select("row", "id", F.col("pa_at").alias("start"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    none = root.where("not ok").select("row", "id", *(F.lit(None).cast(t).alias(c) for c, t in (("start", "long"), ("a", "binary"), ("b", "binary"))))
    return rows.unionByName(none)


# --- chunks of documents ----------------------------------------------------------------------------------------------------------------


def _aligned(t: pa.Table, tok: Pair):
    """(ids, Aligned) of slices of a chunk's rows: texts, and the runs of long texts put together."""
    is_long = t["row"].is_valid().to_numpy()
    short = t.filter(pa.array(~is_long))
    ids = short["id"].to_pylist()
    data, off = with_blanks(*K.column(short["text"])) if short.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    for i, j in K.slices(off):
        a, a_off, b, b_off = tok.rows(data[off[i] : off[j]], off[i : j + 1] - off[i])
        yield ids[i:j], Aligned(tok, a, a_off, b, b_off)
    if is_long.any():
        whole = t.filter(pa.array(is_long)).sort_by([("row", "ascending"), ("start", "ascending")])
        rows = whole["row"].to_numpy()
        at = np.append(np.unique(rows, return_index=True)[1], len(rows))
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            a, b = (S.joined(whole[c].slice(i, j - i), np.uint32)[0] for c in ("a", "b"))
            yield [whole["id"][i].as_py()], Aligned(tok, a, np.array([0, len(a)]), b, np.array([0, len(b)]))


def _bucket(pairs: np.ndarray, n_b: int, buckets: int) -> np.ndarray:
    """Pairs of one A id meet in one bucket."""
    return pairs // n_b % buckets


def _counts(paths: tuple[str, str], buckets: int):
    """How many documents of a chunk hold each pair, packed by bucket."""

    def run(t: pa.Table) -> pa.Table:
        tok = pair_of(*paths)
        pairs, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, x in _aligned(t, tok):
            wide = np.int64(len(tok.a_bytes)) * len(tok.b_bytes)
            got, n = np.unique(np.unique(x.row * wide + x.pairs()) % wide, return_counts=True)
            pairs, back = np.unique(np.concatenate([pairs, got]), return_inverse=True)
            docs = _added(back, np.concatenate([docs, n]), len(pairs))
        of = _bucket(pairs, len(tok.b_bytes), buckets)
        order = np.argsort(of, kind="stable")
        got, at = np.unique(of[order], return_index=True)
        at = np.append(at, len(of))
        chunk = t["chunk"][0].as_py()
        cut = lambda x: S.blobs([x[order[i:j]] for i, j in zip(at[:-1], at[1:], strict=True)])
        return pa.table({"chunk": pa.array([chunk] * len(got), pa.int32()), "bucket": pa.array(got), "part": pa.array([chunk // PART_CHUNKS] * len(got), pa.int32()), "pairs": cut(pairs), "docs": cut(docs)})

    return run


def _added(place: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by place."""
    out = np.zeros(n, np.int64)
    np.add.at(out, place, value)
    return out


def _sums(t: pa.Table) -> pa.Table:
    """Document counts of the pairs of one bucket and part."""
    pairs, docs = (S.joined(t[c], "<i8")[0] for c in ("pairs", "docs"))
    got, back = np.unique(pairs, return_inverse=True)
    return pa.table({"pair": got, "docs": _added(back, docs, len(got))})


def _replies(asked: pa.Table, known: pa.Table) -> pa.Table:
    """For each chunk that asked, its pairs with their counts, negative where the pair isn't its A id's most usual one."""
    order = np.argsort(known["pair"].to_numpy())
    pair, count = known["pair"].to_numpy()[order], np.where(known["best"].to_numpy(zero_copy_only=False), known["docs"].to_numpy(), -known["docs"].to_numpy())[order]
    flat, sizes = S.joined(asked["pairs"], "<i8")
    found, at = count[np.searchsorted(pair, flat)], np.cumsum(sizes)[:-1]
    return pa.table({"chunk": asked["chunk"], "pairs": asked["pairs"], "counts": S.blobs(np.split(found, at))})


def _results(paths: tuple[str, str]):
    def run(t: pa.Table, known: pa.Table) -> pa.Table:
        tok = pair_of(*paths)
        pairs, counts = (S.joined(known[c], "<i8")[0] for c in ("pairs", "counts"))
        order = np.argsort(pairs)
        pairs, counts = pairs[order], counts[order]
        out = []
        for ids, x in _aligned(t, tok):
            count = counts[np.searchsorted(pairs, x.pairs())] if len(pairs) else np.zeros(0, np.int64)
            per_row = lambda v, x=x: np.diff(np.append(0, np.cumsum(v))[x.link_off])
            sums = [np.diff(x.a_off), np.diff(x.b_off), x.n_groups, np.diff(x.link_off), per_row((count > 0).astype(np.int64)), per_row(np.abs(count))]
            out.append(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(s, pa.int64()) for s in sums), pa.array(x.digests(), pa.string())], RESULT_NAMES))
        return pa.Table.from_batches(out, schema=pa.schema([(c, pa.string() if c == "groups_sha256" else pa.int64()) for c in RESULT_NAMES]))

    return run


RESULT_NAMES = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def alignments(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", piece: int = PIECE, fan: int = FAN) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of docs, for tokenizers A (byte-level BPE, its file's
    path) and B (a SentencePiece model that adds a blank and changes nothing).

    Null and empty texts, and texts whose tokens' bytes aren't a blank and the text, have no tokens: zeros and ''. A pair of ids counts once for
    each document, long or short, that holds it linked; repeated rows are documents of their own. count_sum adds the counts of all
    links, n_best counts those whose count is the largest that their A id has anywhere, ties included. Texts of more than `piece` bytes are
    tokenized in ranges by different tasks, `fan` of which are composed at once. Keys are whole numbers and may be null; an empty table gives an empty one; other columns don't matter,
    whatever their names.
    """
    paths = (a_path, b_path)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    is_long = F.octet_length("text") > piece
    n, total, longest = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.max(F.octet_length("text")), F.lit(0))).first()
    chunks = S.parts(total + 64 * n, S.CHUNK_BYTES)
    long = rows.where(is_long)
    mixed = F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(chunks)).cast("int")
    dealt = rows.where(~is_long).select(mixed.alias("chunk"), "id", F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("start"), "text", F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b"))
    if longest > piece:
        runs = closed_runs(long.select(F.monotonically_increasing_id().alias("row"), "id", "text"), paths, piece, fan)
        dealt = dealt.unionByName(runs.select(F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk"), "id", "row", "start", F.lit(None).cast("string").alias("text"), "a", "b"))
    dealt = dealt.repartition(chunks, "chunk")
    buckets, parts = min(chunks, BUCKETS), -(-chunks // PART_CHUNKS)
    asked = dealt.groupBy("chunk").applyInArrow(_counts(paths, buckets), "chunk int, bucket long, part int, pairs binary, docs binary")
    sums = asked.groupBy("bucket", "part").applyInArrow(_sums, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    of = F.expr(f"pair div {len(pair_of(*paths).b_bytes)}")
    top = sums.groupBy(of.alias("a")).agg(F.max("docs").alias("most"))
    known = sums.withColumn("a", of).join(top, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"), F.expr(f"a % {buckets}").alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    replies = asked.groupBy("bucket", "part").cogroup(known.groupBy("bucket", "part")).applyInArrow(_replies, "chunk int, pairs binary, counts binary")
    out = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_results(paths), "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("id", key)
