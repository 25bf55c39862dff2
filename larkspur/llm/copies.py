"""Exact duplicates by a tree-merge of sorted digest runs.

Every partition turns its rows into runs: digests in ascending order, each once, with the row that stays and how many rows it stands
for. Runs are exchanged in binomial rounds: nodes are numbered in base `radix`, and in round r the nodes that differ in digit r only
deal each other the part of their run whose digest has the receiver's digit there. A node merges the `radix` sorted parts it gets,
keeps of equal digests the row that stays and adds up the counts, so a digest held by a third of all rows is one entry per run at
every level, and after the last round each node holds one range of digests, whole. No node ever holds more than its share of them.

Entries are merged by the first eight bytes of a SHA-256 and are one only where all 32 bytes agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import spread as S

#: Runs merged at once; entries of a run, about; rows of a chunk on the way back.
RADIX, RUN, CHUNK_ROWS = 16, 1 << 16, 1 << 15
#: Characters that make no difference (space, tab, line feed, vertical tab, form feed, carriage return).
BLANKS = r"[\x20\x09-\x0D]+"
ENTRY = "node long, digests binary, sizes binary, ids binary, counts binary"


def merged(digests: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One sorted run of several, one after another: per digest the largest size, the least id of that size, and the sum of counts.

    digests: rows of four 64-bit numbers, most significant first. A stable sort of sorted runs is their multiway merge.
    """
    if not len(digests):
        return digests, sizes, ids, counts
    order = np.argsort(digests[:, 0], kind="stable")
    d = digests[order]
    same_head = d[1:, 0] == d[:-1, 0]
    if (same_head & (d[1:] != d[:-1]).any(axis=1)).any():  # unlike digests with one head: by all their bytes
        order = np.lexsort(digests.T[::-1])
        d = digests[order]
    first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]).any(axis=1)))
    sizes, ids, counts = sizes[order], ids[order], counts[order]
    most = np.maximum.reduceat(sizes, first)
    width = np.diff(np.append(first, len(d)))
    least = np.minimum.reduceat(np.where(sizes == np.repeat(most, width), ids, np.iinfo(np.int64).max), first)
    return d[first], most, least, np.add.reduceat(counts, first)


def rounds_for(rows: int, radix: int = RADIX, run: int = RUN) -> int:
    """Rounds after which a node's share of so many digests is a run."""
    r = 1
    while radix**r * run < rows:
        r += 1
    return r


def digit(digests: np.ndarray, r: int, radix: int) -> np.ndarray:
    """Digit r of each digest in base radix (a power of two), from its most significant bits."""
    bits = radix.bit_length() - 1
    return ((digests[:, 0] >> np.uint64(64 - bits * (r + 1))) & np.uint64(radix - 1)).astype(np.int64)


def _segments(node: int, r: int, radix: int, run: tuple) -> pa.RecordBatch:
    """The parts of a run for the nodes that differ from `node` in digit r. What a node holds agrees in the digits before, so parts follow each other."""
    got, at = np.unique(digit(run[0], r, radix), return_index=True)
    at = np.append(at, len(run[0]))
    home = node - (node // radix**r % radix) * radix**r
    parts = [pa.array([np.ascontiguousarray(x[i:j]).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()) for x in run]
    return pa.RecordBatch.from_arrays([pa.array(home + got * radix**r, pa.int64()), *parts], ["node", "digests", "sizes", "ids", "counts"])


def _first_runs(rounds: int, radix: int, most: int):
    """Rows of a partition as runs of about `most` entries (or one batch), parted for round 0."""

    def run(batches):
        held, n = [], 0

        def flush():
            out = merged(*(np.concatenate(x) for x in zip(*held, strict=True)))
            # the other digits of the sender's number only share out the work
            home = int(out[0][0, 3] % np.uint64(radix**rounds)) if len(out[0]) else 0
            return _segments(home, 0, radix, out)

        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u8").astype(np.uint64).reshape(-1, 4)
            ids = batch.column(1).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            held.append(merged(raw, batch.column(2).to_numpy().astype(np.int64), ids, np.ones(len(raw), np.int64)))
            n += len(held[-1][0])
            if n >= most:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    return run


def _unpacked(t: pa.Table) -> tuple:
    digests = S.joined(t["digests"], "<u8")[0].reshape(-1, 4)
    return digests, *(S.joined(t[c], "<i8")[0] for c in ("sizes", "ids", "counts"))


def _merge_and_send(r: int, radix: int):
    def run(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_segments(t["node"][0].as_py(), r, radix, merged(*_unpacked(t)))])

    return run


def _last(t: pa.Table) -> pa.Table:
    digests, sizes, ids, counts = merged(*_unpacked(t))
    several = counts > 1
    raw = np.ascontiguousarray(digests[several].astype(">u8")).tobytes()
    return pa.table({"digest": pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()), "keep_size": pa.array(sizes[several]), "keep_id": pa.array(ids[several]), "held": pa.array(counts[several])})


def merged_groups(rows: DataFrame, n: int, radix: int = RADIX, run: int = RUN) -> DataFrame:
    """digest, keep_size, keep_id, held: every digest that several of the n rows (digest binary, id long, size long) hold, by the merge tree."""
    rounds = rounds_for(n, radix, run)
    runs = rows.select("digest", "id", "size").mapInArrow(_first_runs(rounds, radix, run), ENTRY)
    for r in range(1, rounds):
        runs = runs.groupBy("node").applyInArrow(_merge_and_send(r, radix), ENTRY)
    return runs.groupBy("node").applyInArrow(_last, "digest binary, keep_size long, keep_id long, held long")


def exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", radix: int = RADIX, run: int = RUN, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """key, keep_id, group_size, kept, text_sha256: one row for each row of docs, dropped ones too.

    Texts are equal where they are identical without their white space (BLANKS); null counts as empty, so null, empty and blank texts
    are one group. Of equal texts the row with the most code points before anything is deleted stays, then that of the smallest key;
    keys are whole numbers, null ones come last. Rows that repeat a kept row's key and length stay with it. An empty table gives an empty one.
    Other columns of docs don't matter, whatever their names. radix (a power of two), run and chunk_rows bound what a task holds.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.regexp_replace(body, BLANKS, "").cast("binary"), 256))
    rows = S.kept(docs.select(F.col(key).cast("long").alias("id"), digest.alias("digest"), F.char_length(body).cast("long").alias("size")), "digests")
    n = rows.count()
    last = F.lit(np.iinfo(np.int64).max)
    groups = merged_groups(rows, n, radix, run).select("digest", "keep_size", F.nullif("keep_id", last).alias("keep_id"), "held")
    # back to the rows: a group's answer goes once to every chunk of rows that holds its digest, so no key of either join has more rows than a chunk
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "size"), F.lit(S.parts(n, chunk_rows))))
    answers = rows.select("digest", "chunk").distinct().join(groups, "digest")
    out = rows.join(answers, ["digest", "chunk"], "left")
    alone = F.col("held").isNull()
    kept = alone | (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("size") == F.col("keep_size")))
    return out.select(
        F.col("id").alias(key), F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("held", F.lit(1)).cast("long").alias("group_size"),
        kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
