"""Language identification by nearest centroid over normalised TF-IDF vectors of byte n-grams.

A text, in lower case and with every run of other ASCII characters than letters as one blank, is a vector of its 1-, 2-
and 3-grams of UTF-8 bytes, hashed to `DIMS` places: square root of the count, times the n-gram's inverse document frequency,
scaled to length 1. Document frequencies are counted over all rows to learn from. Each language has several centroids,
found by spherical k-means on a bounded sample of its rows, inside one task per language. A text gets the language of
the centroid with the largest cosine. How far a text of a language may be from its centroids depends on the text's length:
for 16, 32, 64 ... bytes of letters, pieces of that length of the sampled rows give a low quantile of their cosines, and a text of at least
that length whose cosine is below `MARGIN` times the quantile is rejected, as is one below `reject_below` at any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import kernels as K

U32 = np.uint32
DIMS = 1 << 12
#: Rows of each language, at most about, that centroids are fitted on; and centroids of each language.
FIT_ROWS, CENTROIDS = 600, 4
#: Lengths, in bytes of letters, that rejection is learned for: 2 ** LEAST and doublings of it.
LEAST, LENGTHS = 4, 9
#: A length's limit is MARGIN times the QUANTILE of at least PIECES pieces; with fewer it is the next smaller length's.
MARGIN, QUANTILE, PIECES = 0.4, 0.05, 50
#: Blank for every ASCII byte that is no letter; bytes of other characters stay.
FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """n-gram counts, one row of DIMS per text. data: lower-case UTF-8."""
    out = np.zeros((len(off) - 1, DIMS), np.float32)
    d = FOLD[data]
    if not len(d):
        return out
    blank = d == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first blank of a run
    keep[off[:-1][off[:-1] < len(d)]] = True
    d, off = d[keep].astype(U32), np.concatenate([[0], np.cumsum(keep)])[off]
    n = len(d)
    one = d * U32(0x9E3779B1)
    two = np.zeros(n, U32)
    two[: n - 1] = (d[:-1] * U32(257) + d[1:]) * U32(0x85EBCA6B)
    three = np.zeros(n, U32)
    three[: n - 2] = ((d[:-2] * U32(257) + d[1:-1]) * U32(257) + d[2:]) * U32(0xC2B2AE35)
    shift = U32(32 - (DIMS.bit_length() - 1))
    one, two, three = ((x ^ (x >> U32(15))) * U32(0x2C1B3C6D) >> shift for x in (one, two, three))
    for r in range(len(off) - 1):
        a, b = int(off[r]), int(off[r + 1])
        if b > a:
            out[r] = np.bincount(one[a:b], minlength=DIMS) + np.bincount(two[a : b - 1], minlength=DIMS) + np.bincount(three[a : max(b - 2, a)], minlength=DIMS)
    return out


def vectors(data: np.ndarray, off: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts(data, off)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes of letters before each place, and in all."""
    return np.concatenate([[0], np.cumsum(FOLD[data] != 32)])


def limits(texts: list[bytes], centre: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """For each length the least cosine of a text of the language, 0 where the rows are too few: from the first and the last piece of that
    length of each text. A text is judged by the greatest length it reaches, so by pieces that are no longer than itself."""
    out, seen = np.zeros(LENGTHS), [(np.frombuffer(t, np.uint8), letters(np.frombuffer(t, np.uint8))) for t in texts]
    for c in range(LENGTHS):
        n, pieces = 1 << LEAST + c, []
        for data, before in seen:
            if before[-1] >= n:
                pieces += [data[: np.searchsorted(before, n)], data[np.searchsorted(before, before[-1] - n, "right") - 1 :]]
        out[c] = out[c - 1] if c else 0.0
        if len(pieces) >= 2 * PIECES:
            v = vectors(np.concatenate(pieces), np.cumsum([0, *map(len, pieces)]), idf)
            out[c] = max(out[c], MARGIN * np.quantile((v @ centre.T).max(axis=1), QUANTILE))
    return out


def _slices(text: pa.Array, limit: int = 1 << 20):
    """Lower-case texts, few at a time: first row, row after the last, bytes, offsets."""
    data, off = K.column(pc.utf8_lower(text))
    for i, j in K.slices(off, limit):
        for k in range(i, j, 512):
            m = min(k + 512, j)
            yield k, m, data[off[k] : off[m]], off[k : m + 1] - off[k]


def _frequencies(batches):
    df, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for i, j, data, off in _slices(batch.column(0)):
            df += (counts(data, off) > 0).sum(axis=0)
            n += j - i
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.append(n, df))], ["place", "n"])


def centroids(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, begun from the mean and then the rows farthest from all centres so far."""
    centre = v.mean(axis=0, keepdims=True)
    centre /= max(float(np.linalg.norm(centre)), 1e-12)
    while len(centre) < min(k, len(v)):
        far = np.argmin((v @ centre.T).max(axis=1))
        centre = np.concatenate([centre, v[far : far + 1]])
    for _ in range(rounds):
        near = np.argmax(v @ centre.T, axis=1)
        new = np.stack([v[near == c].sum(axis=0) if (near == c).any() else centre[c] for c in range(len(centre))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, centre, atol=1e-5):
            break
        centre = new
    return centre.astype(np.float32)


class Model:
    """Languages, inverse document frequencies and centroids: DIMS floats for each of at most CENTROIDS per language; LENGTHS limits for each."""

    def __init__(self, langs: list[str], idf: np.ndarray, centres: np.ndarray, limits: np.ndarray | None = None):
        self.langs, self.idf, self.centres = langs, idf, centres
        self.limits = np.zeros((len(langs), LENGTHS)) if limits is None else limits


def fit(rows: DataFrame, lang: str = "lang", key: str = "doc_id", fit_rows: int = FIT_ROWS, k: int = CENTROIDS) -> Model:
    """Learn from rows (key, text, lang not null). Document frequencies come from all of them, centroids from about
    `fit_rows` rows of each language, chosen by a hash of the key. Without rows the model knows no language."""
    rows = rows.where(F.col(lang).isNotNull() & F.col("text").isNotNull()).select(key, "text", F.col(lang).alias("lang"))
    got = rows.select("text").mapInArrow(_frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()  # DIMS + 1 rows
    df = np.zeros(DIMS + 1)
    for r in got:
        df[r.place + 1] = r.n
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = F.lit(None).cast("double")
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, fit_rows / n))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64(key), F.lit(1_000_003)) < share * 1_000_003)

    def fit_one(group: pa.Table) -> pa.Table:
        order = np.argsort(group[key].to_numpy(), kind="stable")
        group = group.take(pa.array(order)).combine_chunks()
        v = np.concatenate([vectors(data, off, idf) for b in group.to_batches() for _, _, data, off in _slices(b.column(1))])
        c = centroids(v, k)
        least = limits([data[x:y].tobytes() for b in group.to_batches() for _, _, data, off in _slices(b.column(1)) for x, y in zip(off[:-1], off[1:], strict=True)], c, idf)
        same = [pa.array([x] * len(c)) for x in (group["lang"][0].as_py(), least.tobytes())]
        return pa.table({"lang": same[0], "centre": pa.array([x.tobytes() for x in c], pa.binary()), "least": same[1]})

    found = sample.groupBy("lang").applyInArrow(fit_one, "lang string, centre binary, least binary").orderBy("lang").collect() if sizes else []
    found = sorted(found, key=lambda r: (r.lang, bytes(r.centre)))
    if not found:
        return Model([], idf, np.zeros((0, DIMS), np.float32))
    return Model([r.lang for r in found], idf, np.stack([np.frombuffer(bytes(r.centre), np.float32) for r in found]), np.stack([np.frombuffer(bytes(r.least)) for r in found]))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", reject_below: float = 0.12, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, lang_pred, score, rejected, and the columns of `keep`. A null text or one without a letter is `und`, score 0, rejected; a text
    whose largest cosine is below `reject_below`, or below the limit of the nearest language for its length, keeps that language's name and
    is rejected. Languages learned from fewer than PIECES rows of a length have no limit of their own there."""
    schema = docs.select(key, *keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    names, idf, centres, least = np.array(model.langs, object), model.idf, model.centres, np.maximum(model.limits, reject_below)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    place = keep.index("text") + 1 if "text" in keep else 1 + len(keep)  # a text that is kept is sent once
    sent = [key, *keep] if "text" in keep else [key, *keep, "text"]
    kept = 1 + len(keep)

    def run(batches):
        for batch in batches:
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            limit = np.full(batch.num_rows, reject_below)
            if len(names):
                for i, j, data, off in _slices(batch.column(place)):
                    near = vectors(data, off, idf) @ centres.T
                    best[i:j], score[i:j] = near.argmax(axis=1), near.max(axis=1)
                    size = np.diff(letters(data)[off])
                    length = np.minimum(np.log2(np.maximum(size, 1)).astype(np.int64) - LEAST, LENGTHS - 1)
                    limit[i:j] = np.where(length >= 0, least[best[i:j], np.maximum(length, 0)], reject_below)
            ok = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False) & bool(len(names))
            lang = [names[b] if x else "und" for b, x in zip(best, ok, strict=True)]
            score = np.where(ok, np.clip(score, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(lang, pa.string()), pa.array(score), pa.array(~ok | (score < limit))], schema.names)

    flag = "_letters" + "_" * max(map(len, docs.columns))  # longer than any column's name
    return docs.select(*sent, lettered.alias(flag)).mapInArrow(run, schema)


def held_out(key: str = "doc_id", folds: int = 5):
    """The fold that is never learned from: crc32 of the key as text, modulo folds, is 0."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0
