"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces with log scores.

Encoding a text: a blank goes before it, each blank becomes the whitespace marker U+2581, and the pieces are chosen whose sum of scores is
largest; a character that no piece covers costs the least score minus 10 and becomes its UTF-8 bytes' pieces (byte
fallback). Decoding puts pieces together, byte pieces as bytes, markers as blanks, and drops the first blank. Where no
piece holds a marker after another character, a text falls into units, each a run of markers and what follows, that are encoded apart;
each distinct unit of a slice is encoded once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkspur.llm import kernels as K
from larkspur.llm.tokens import WordStore

MARK = "▁"
MARK_BYTES = np.frombuffer(MARK.encode(), np.uint8)
#: Fixed value: what an uncovered character costs beyond the least score.
UNKNOWN_PENALTY = 10.0
NORMAL, USER_DEFINED, BYTE = 1, 4, 6


class Trie:
    """A double array: the child of node s by byte b is base[s] + b, if its check is s; value is a piece or -1."""

    def __init__(self, pieces: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for piece, value in pieces.items():
            node = 0
            for b in piece:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    values.append(-1)
                node = children[node][b]
            values[node] = value
        size = len(children) * 4 + 4096
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = np.zeros(size, bool)
        taken[0] = True
        todo, wide, step = [(0, 0)], 1, 512
        for node, at in todo:
            self.value[at] = values[node]
            if not children[node]:
                continue
            kids = np.array(sorted(children[node]))
            base = wide
            while True:  # the first base from `wide` on where all children find free cells, a stretch at a time
                if base + step + 256 > len(taken):
                    more = len(taken)
                    taken = np.append(taken, np.zeros(more, bool))
                    self.base, self.check, self.value = (np.append(a, np.full(more, v, np.int32)) for a, v in ((self.base, 0), (self.check, -1), (self.value, -1)))
                fits = np.flatnonzero(~taken[base + kids[:, None] + np.arange(step)].any(axis=0))
                if len(fits):
                    base += int(fits[0])
                    break
                base += step
            if base > wide + 4 * step:
                wide = base - step
            self.base[at] = base
            taken[base + kids] = True
            self.check[base + kids] = at
            todo += [(children[node][b], base + b) for b in kids.tolist()]

    def matches(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, value) of every piece that begins at a start and ends by its stop; all places step through the trie together."""
        begin, pos, node = start, start.copy(), np.zeros(len(start), np.int32)
        out = []
        while len(pos):
            on = pos < stop
            begin, pos, node, stop = begin[on], pos[on], node[on], stop[on]
            nxt = self.base[node] + data[pos]
            on = (self.check[np.minimum(nxt, len(self.check) - 1)] == node) & (nxt < len(self.check)) & (self.base[node] > 0)
            begin, pos, node, stop = begin[on], pos[on] + 1, nxt[on], stop[on]
            value = self.value[node]
            hit = value >= 0
            out.append((begin[hit], pos[hit], value[hit]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (start, start, start)


class Model:
    """Pieces, scores and types of a SentencePiece model file, as a Unigram model whatever its type.

    In a file of type Unigram the scores are log probabilities. In one of type BPE, as among the public files, they are negated merge
    ranks: the segmentation is still the one of largest sum, but that sum is no likelihood."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            proto = pb.ModelProto.FromString(f.read())
        kinds = np.array([p.type for p in proto.pieces])
        self.score = np.array([p.score for p in proto.pieces], np.float64)
        plain = {p.piece.encode(): i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER_DEFINED)}
        self.trie = Trie(plain)
        self.byte = np.zeros(256, np.int64)
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.byte[int(p.piece[1:-1], 16)] = i
        self.unknown = float(self.score[[i for i in plain.values()]].min()) - UNKNOWN_PENALTY
        self.apart = not any(MARK in p.lstrip(MARK) for p in (x.decode() for x in plain))
        text = [bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else p.piece.encode() if p.type in (NORMAL, USER_DEFINED) else b"" for p in proto.pieces]
        self.is_byte = kinds == BYTE
        self.size = np.array([len(t) for t in text], np.int64)
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self.begin = np.cumsum(self.size) - self.size

    def marked(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts with markers for blanks and one before each text that isn't empty."""
        n = np.diff(off)
        width = np.where(data == 32, 3, 1)
        total = np.concatenate([[0], np.cumsum(width)])
        lead = np.where(n > 0, 3, 0)
        new = np.concatenate([[0], np.cumsum(total[off[1:]] - total[off[:-1]] + lead)])
        row = np.repeat(np.arange(len(n)), n)
        at = total[:-1] - total[off[:-1]][row] + new[:-1][row] + 3
        out = np.empty(int(new[-1]), np.uint8)
        out[at] = data
        for places in (at[data == 32], new[:-1][n > 0]):
            for i, b in enumerate(MARK_BYTES):
                out[places + i] = b
        return out, new

    def units(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the units, and the index of each row's first unit (rows + 1)."""
        start = np.zeros(len(data) + 1, bool)
        if self.apart and len(data) > 2:
            mark = np.zeros(len(data), bool)
            mark[:-2] = (data[:-2] == MARK_BYTES[0]) & (data[1:-1] == MARK_BYTES[1]) & (data[2:] == MARK_BYTES[2])
            start[:-1] = mark
            start[3:-1] &= ~mark[:-3]
        start[off[:-1]] = True
        start = np.flatnonzero(start[:-1])
        return start, np.searchsorted(start, off)

    def viterbi(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best pieces of each unit data[off[i]:off[i+1]], one after another, and the count of each. All units advance together."""
        unit = np.repeat(np.arange(len(off) - 1), np.diff(off))
        first = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.union1d(first, off[:-1][np.diff(off) > 0])
        stop = off[1:][unit[first]]
        b, e, v = self.trie.matches(data, first, stop)
        after = np.minimum(np.append(first[1:], len(data)), stop)
        one = np.zeros(len(data) + 1, bool)
        nxt = np.zeros(len(data) + 1, np.int64)
        nxt[first] = after
        one[b[e == nxt[b]]] = True
        lone = first[~one[first]]  # characters that no piece covers alone
        b, e, v = np.append(b, lone), np.append(e, nxt[lone]), np.append(v, np.full(len(lone), -1))
        gain = np.where(v >= 0, self.score[v], self.unknown)
        away = b - off[:-1][unit[b]]
        order = np.argsort(away, kind="stable")
        b, e, v, gain, away = b[order], e[order], v[order], gain[order], away[order]
        # position p of unit u has a cell p + u, so that a unit's end is not the next one's start
        best, back, piece = np.full(len(data) + len(off), -np.inf), np.zeros(len(data) + len(off), np.int64), np.zeros(len(data) + len(off), np.int64)
        best[off[:-1] + np.arange(len(off) - 1)] = 0
        cut = np.flatnonzero(np.append(True, away[1:] != away[:-1])) if len(away) else np.zeros(0, np.int64)
        shift = unit[b]
        for x, y in zip(cut.tolist(), np.append(cut[1:], len(away)).tolist(), strict=True):
            to = e[x:y] + shift[x:y]
            score = best[b[x:y] + shift[x:y]] + gain[x:y]
            better = score > best[to]
            to = to[better]
            best[to], back[to], piece[to] = score[better], b[x:y][better], v[x:y][better]
        u = np.flatnonzero(np.diff(off) > 0)
        cur = off[1:][u]
        got = []
        while len(u):
            cell = cur + u
            got.append((back[cell], cur, piece[cell], u))
            cur = back[cell]
            on = cur > off[:-1][u]
            cur, u = cur[on], u[on]
        if not got:
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        b, e, v, u = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(b, kind="stable")
        b, e, v, u = b[order], e[order], v[order], u[order]
        n = np.where(v >= 0, 1, e - b)
        ids = np.repeat(v, n)
        at = np.cumsum(n) - n
        loose = v < 0
        ids[K.ragged(at[loose], n[loose])] = self.byte[data[K.ragged(b[loose], n[loose])]]
        return ids.astype(np.uint32), np.bincount(u, weights=n, minlength=len(off) - 1).astype(np.int64)

    def encode(self, data: np.ndarray, off: np.ndarray, store: WordStore) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and offsets (rows + 1)."""
        data, off = self.marked(data, off)
        start, first = self.units(data, off)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        end = np.append(start[1:], len(data))
        u, one, inverse = np.unique(K.span_hashes(data, start, end), return_index=True, return_inverse=True)
        new = store.missing(u)
        if len(new):
            s, n = start[one[new]], (end - start)[one[new]]
            store.add(u[new], *self.viterbi(data[K.ragged(s, n)], np.concatenate([[0], np.cumsum(n)])))
        return store.ids(u, inverse, first)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """The texts of rows of ids; bytes that are no UTF-8 become U+FFFD."""
        size = self.size[ids]
        raw = self.bytes[K.ragged(self.begin[ids], size)].tobytes()
        total = np.concatenate([[0], np.cumsum(size)])[off]
        mark = MARK.encode()
        out = []
        for a, b in zip(total[:-1].tolist(), total[1:].tolist(), strict=True):
            text = raw[a:b].replace(mark, b" ")
            out.append((text[1:] if text[:1] == b" " else text).decode("utf-8", "replace"))
        return out


_store: dict[int, WordStore] = {}


def _own_store(model: Model) -> WordStore:
    """The worker's store for this model (its scores tell it from another)."""
    return _store.setdefault(zlib.crc32(model.score.tobytes()), WordStore())


def encode_documents(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """key, ids (array<int>): the pieces of each text; empty for null and empty texts."""

    def run(batches):
        store = _own_store(model)
        for batch in batches:
            data, off = K.column(batch.column(1))
            for i, j in K.slices(off):
                ids, at = model.encode(data[off[i] : off[j]], off[i : j + 1] - off[i], store)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))], [key, "ids"])

    return docs.select(key, "text").mapInArrow(run, docs.select(key).schema.add("ids", T.ArrayType(T.IntegerType())))


def decode_documents(encoded: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """key, text of rows of ids; a null row of ids is an empty text."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1).fill_null([])
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            off = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.decode(ids, off), pa.string())], [key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, encoded.select(key).schema.add("text", "string"))


def round_trips(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, n_fallback (byte pieces), ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256, same: whether decoding
    gives the text again (null counts as empty; a text that holds the marker itself comes back with a blank there). One row
    per document, whatever its text; other columns are ignored; an empty table gives an empty result."""
    schema = docs.select(key).schema.add("n_tokens", "long").add("n_fallback", "long").add("ids_crc32", "long").add("decoded_sha256", "string").add("same", "boolean")

    def run(batches):
        store = _own_store(model)
        for batch in batches:
            data, off = K.column(batch.column(1))
            for i, j in K.slices(off):
                d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                ids, at = model.encode(d, o, store)
                loose = np.concatenate([[0], np.cumsum(model.is_byte[ids])])[at]
                raw, packed = d.tobytes(), ids.astype("<u4").tobytes()
                back = [t.encode() for t in model.decode(ids, at)]
                cols = [
                    batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(np.diff(loose)), pa.array([zlib.crc32(packed[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64()),
                    pa.array([K.sha256_hex(t) for t in back], pa.string()), pa.array([t == raw[a:b] for t, a, b in zip(back, o[:-1].tolist(), o[1:].tolist(), strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return docs.select(key, "text").mapInArrow(run, schema)
