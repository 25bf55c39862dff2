"""Packing documents into sequences of at most `max_tokens` tokens: best fit, then a swap-based local search.

Documents are cut into pieces only where they are longer than a sequence. Pieces are dealt to groups of bounded size by
a hash; each group is packed by best fit decreasing, and then improved: documents move, or are exchanged one for one or
two for one, between underfull bins, always so that the sum of squared fills grows, until bins are empty. Each group
can lose part of one sequence, a share that goes to zero with the group's size.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import kernels as K
from larkspur.llm import spread as S
from larkspur.llm.tokens import word_bpe

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, max_tokens: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids, end_id last; a null text is empty: one piece of one id."""

    def cut(batches):
        encoder = word_bpe(tokenizer)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, off = K.column(batch.column(1))
            out: list[tuple] = []
            for i, j in K.slices(off):
                tokens, at = encoder.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for r in range(j - i):
                    own = np.append(tokens[at[r] : at[r + 1]], np.uint32(end_id)).astype("<u4")
                    for p, x in enumerate(range(0, len(own), max_tokens)):
                        piece = own[x : x + max_tokens]
                        out.append((int(ids[i + r]), p, x, len(piece), zlib.crc32(piece.tobytes())))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, room: int) -> np.ndarray:
    """The bin of each item: longest first, each into the fullest bin that holds it."""
    bins = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(room + 1)]
    open_ = n = 0  # bit r: a bin with room r is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        x = int(lengths[i])
        fits = open_ >> x
        if fits:
            r = x + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_ &= ~(1 << r)
            r -= x
        else:
            b, n, r = n, n + 1, room - x
        bins[i] = b
        if r:
            by_room[r].append(b)
            open_ |= 1 << r
    return bins


def _exchange(lengths: np.ndarray, bins: np.ndarray, items: np.ndarray, fill: np.ndarray, room: int) -> bool:
    """Exchange two items of different bins, one for one, so that the sum of squared fills grows most; whether there was such a pair."""
    own = items[np.argsort(lengths[items], kind="stable")]
    if len(own) < 2:
        return False
    y, b = lengths[own], bins[own]
    k = np.searchsorted(y, y + room - fill[b], "right") - 1  # the longest that can stand in the item's place
    more = y[k] - y
    gain = np.where((more > 0) & (b[k] != b), more * (fill[b] - fill[b[k]] + more), 0)
    i = int(np.argmax(gain))
    if gain[i] <= 0:
        return False
    bins[own[i]], bins[own[k[i]]] = b[k[i]], b[i]
    return True


def _two_for_one(x: int, own: np.ndarray, lengths: np.ndarray, bins: np.ndarray, slack: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two items of one bin, shorter together than x, that make room for x there, or None. slack: each item's bin's room."""
    order = np.lexsort((lengths[own], bins[own]))
    own, slack = own[order], slack[order]
    b, y = np.unique(bins[own], return_inverse=True)[1], lengths[own]
    line = b * (room + 1) + y  # ascending: bins one after another, in each by length
    least = np.maximum(x - slack - y, 1)
    k = np.searchsorted(line, b * (room + 1) + least)
    k = np.where(k == np.arange(len(own)), k + 1, k)  # not the item itself
    ok = k < len(own)
    k = np.minimum(k, len(own) - 1)
    two = y + y[k]
    ok &= (b[k] == b) & (two < x) & (two + slack >= x)
    if not ok.any():
        return None
    i = int(np.argmin(np.where(ok, two, room + 1)))
    return int(own[i]), int(own[k[i]])


def _emptied(lengths: np.ndarray, bins: np.ndarray, target: int, room: int) -> np.ndarray | None:
    """bins with the target bin emptied by moves and exchanges with the other underfull bins, or None. Each change makes the sum of
    squared fills grow, so it ends."""
    trial = bins.copy()
    fill = np.bincount(trial, weights=lengths).astype(np.int64)
    others = np.flatnonzero((fill > 0) & (fill < room) & (np.arange(len(fill)) != target))
    if int((room - fill[others]).sum()) < fill[target]:
        return None
    pool = np.flatnonzero(np.isin(trial, others))
    while True:
        mine = np.flatnonzero(trial == target)
        if not len(mine):
            return trial
        fill = np.bincount(trial, weights=lengths, minlength=len(fill)).astype(np.int64)
        own = pool[trial[pool] != target]
        y, slack = lengths[own], (room - fill)[trial[own]]
        change = None
        for i in mine[np.argsort(-lengths[mine], kind="stable")].tolist():
            x = int(lengths[i])
            fits = others[room - fill[others] >= x]
            if len(fits):  # a move
                change = i, int(fits[np.argmin(room - fill[fits])]), []
                break
            ok = np.flatnonzero((y < x) & (slack + y >= x))
            if len(ok):  # one for one: the smallest that makes room
                k = int(own[ok[np.argmin(y[ok])]])
                change = i, int(trial[k]), [k]
                break
            two = _two_for_one(x, own, lengths, trial, slack, room) if len(own) > 1 else None
            if two:
                change = i, int(trial[two[0]]), list(two)
                break
        if change is not None:
            i, to, back = change
            trial[i] = to
            trial[back] = target
            pool = np.append(pool[~np.isin(pool, back)] if back else pool, i)
        elif not _exchange(lengths, trial, own, fill, room):
            return None


def local_search(lengths: np.ndarray, bins: np.ndarray, room: int) -> np.ndarray:
    """Improve a packing: empty the least full bin, again and again, by moves, one-for-one and two-for-one exchanges with all other underfull
    bins; where that is stuck, items of the others are exchanged for each other, which gathers their room in fewer bins. It ends
    when there are as few bins as can be, or no change that gains is left for the least full bin."""
    least = -(-int(lengths.sum()) // room)
    while True:
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        used = np.flatnonzero(fill)
        if len(used) <= least:
            return bins
        better = _emptied(lengths, bins, int(used[np.argmin(fill[used])]), room)
        if better is None:
            return bins
        bins = better


def pack_pieces(pieces: DataFrame, max_tokens: int = 4096, group_pieces: int = 20_000) -> DataFrame:
    """pieces with sequence_id and offset: groups of about `group_pieces` pieces, packed apart from each other."""
    groups = S.parts(pieces.count(), group_pieces)

    def pack(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        order = np.lexsort((table["piece"].to_numpy(), table["doc_id"].to_numpy()))
        bins = np.empty(len(lengths), np.int64)
        bins[order] = local_search(lengths[order], best_fit(lengths[order], max_tokens), max_tokens)
        by = np.lexsort((table["piece"].to_numpy(), table["doc_id"].to_numpy(), bins))
        before = np.cumsum(lengths[by]) - lengths[by]
        new = np.append(True, np.diff(bins[by]) != 0)
        offset = np.empty(len(by), np.int64)
        offset[by] = before - np.repeat(before[new], np.diff(np.append(np.flatnonzero(new), len(by))))
        sequence = (np.int64(table["grp"][0].as_py()) << np.int64(32)) + bins
        return table.drop_columns(["grp"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    return dealt.groupBy("grp").applyInArrow(pack, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = 4096, end_id: int = 1, group_pieces: int = 20_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs: doc_id (unique) and text; other columns are ignored. A null or empty text gives one piece with the end id only.
    Each piece stands in one sequence; offsets in a sequence leave no gap. An empty table gives an empty result.
    """
    return pack_pieces(S.kept(token_pieces(docs, tokenizer, end_id, max_tokens), "pieces"), max_tokens, group_pieces)
