"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of features of its text. Of a pair (better, worse) the better wins with
probability sigmoid(strength difference); the weights maximise that likelihood over preference pairs, which is a logistic
regression without intercept on feature differences. The score is the strength through a sigmoid placed so that the
share of documents below the decision mark `accept` equals the share of worse labels (a quantile of the strengths).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import kernels as K

#: Labelled rows, at most about, that the weights and the quantile are learned from; preference pairs drawn from them.
FIT_ROWS, PAIRS = 20_000, 60_000
_ascii = np.arange(256)
LETTER = ((_ascii | 32) >= 97) & ((_ascii | 32) <= 122) & (_ascii < 128) | (_ascii >= 128)
UPPER = (_ascii >= 65) & (_ascii <= 90)
DIGIT = (_ascii >= 48) & (_ascii <= 57)
MARK = (_ascii > 32) & (_ascii < 127) & ~LETTER & ~DIGIT
PLAIN_MARK = np.isin(_ascii, [ord(c) for c in ".,;:'-?"])
BASE = ("words", "word_length", "long_words", "upper", "digits", "marks", "odd_marks", "odd_words", "bare_words", "distinct", "repeats", "near_repeats", "top_word", "line_words", "distinct_lines", "ended_lines", "capital_words", "capital_all", "distinct_bytes", "word_length_spread")


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of len(BASE) numbers per text; texts without words have zeros."""
    n = len(off) - 1
    out = np.zeros((n, len(BASE)))
    s, e, first = K.words(data, off)
    if not len(s):
        return out
    row, count = K.row_of(first, len(s)), np.diff(first)
    has = np.maximum(count, 1)

    def within(table):  # how many bytes of the class each word has
        total = np.concatenate([[0], np.cumsum(table[data])])
        return total[e] - total[s]

    def mean(x):
        return np.bincount(row, weights=x, minlength=n) / has

    size = (e - s).astype(float)
    letters, upper, digits, marks, plain = (within(t) for t in (LETTER, UPPER, DIGIT, MARK, PLAIN_MARK))
    odd = marks - plain
    total = np.maximum(np.bincount(row, weights=size, minlength=n), 1)
    sums = lambda x: np.bincount(row, weights=x, minlength=n) / total
    h = K.span_hashes(data, s, e)
    order = np.lexsort((h, row))
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1]))
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(h)))
    distinct = np.bincount(row[order][at], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, row[order][at], runs)
    same = np.append(False, (h[1:] == h[:-1]) & (row[1:] == row[:-1]))
    near = same.copy()
    near[2:] |= (h[2:] == h[:-2]) & (row[2:] == row[:-2])
    cut = np.ones(256, bool)
    cut[10] = False
    ls, le, lf = K.words(data, off, cut)  # lines
    lrow, lines = K.row_of(lf, len(ls)), np.maximum(np.diff(lf), 1)
    lh = K.span_hashes(data, ls, le)
    lo = np.lexsort((lh, lrow))
    lnew = np.append(True, (lh[lo][1:] != lh[lo][:-1]) | (lrow[lo][1:] != lrow[lo][:-1]))
    ended = np.isin(data[le - 1], [ord("."), ord("?"), ord("!"), ord('"')])
    length = mean(size)
    cols = (
        np.log1p(count), length, mean(size > 12), sums(upper), sums(digits), sums(marks), sums(odd), mean(odd > 0), mean(letters == 0), distinct / has, mean(same), mean(near), top / has, np.log1p(count / lines),
        np.bincount(lrow[lo][lnew], minlength=n) / lines, np.bincount(lrow, weights=ended, minlength=n) / lines, mean(UPPER[data[s]] & (upper < letters)), mean((upper >= letters) & (letters > 1)),
        np.log1p(distinct) - np.log1p(count) * 0.8, np.sqrt(np.maximum(mean(size**2) - length**2, 0)),
    )
    return np.where((count > 0)[:, None], np.stack(cols, axis=1), 0.0)


class Ranker:
    """Quantile knots of the features (each feature becomes steps between its knots), weights, and the score's place and scale."""

    def __init__(self, knots: np.ndarray, weights: np.ndarray, place: float, scale: float, accept: float):
        self.knots, self.weights, self.place, self.scale, self.accept = knots, weights, place, scale, accept

    @staticmethod
    def steps(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
        """How far each feature is through each interval between its knots, 0 to 1."""
        low, high = knots[:, :-1], knots[:, 1:]
        return np.clip((x[:, :, None] - low) / np.maximum(high - low, 1e-9), 0, 1).reshape(len(x), low.size)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.steps(x, self.knots) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.strength(x) - self.place) / self.scale + np.log(self.accept / (1 - self.accept))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def bradley_terry(diff: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights w that maximise the mean of log sigmoid(diff @ w) - ridge/2 |w|^2, by Newton steps."""
    w = np.zeros(diff.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))
        grad = diff.T @ p / len(diff) - ridge * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit_ranker(x: np.ndarray, better: np.ndarray, pairs: int = PAIRS, accept: float = 0.3, knots: int = 9, seed: int = 7) -> Ranker:
    """x: features; better: the rows labelled so. With one label only, all weights are zero."""
    marks = np.quantile(x, np.linspace(0, 1, knots), axis=0).T if len(x) else np.zeros((len(BASE), knots))
    z = Ranker.steps(x, marks)
    good, bad = np.flatnonzero(better), np.flatnonzero(~better)
    if not len(good) or not len(bad):
        return Ranker(marks, np.zeros(z.shape[1]), 0.0, 1.0, accept)
    rng = np.random.default_rng(seed)
    w = bradley_terry(z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)])
    strength = z @ w
    place = float(np.quantile(strength, len(bad) / len(x)))
    return Ranker(marks, w, place, max(float(strength.std()), 1e-9), accept)


def _feature_rows(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    schema = docs.select(*keep).schema.add("features", T.ArrayType(T.DoubleType()))

    def run(batches):
        for batch in batches:
            data, off = K.column(batch.column(batch.num_columns - 1))
            x = np.concatenate([features(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in K.slices(off)] or [np.zeros((0, len(BASE)))])
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(BASE), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], schema.names)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame | None = None, label: str = "quality", key: str = "doc_id", fit_rows: int = FIT_ROWS, accept: float = 0.3) -> Ranker:
    """Learn from docs (key, text) and labels (key, label 0/1), which may be columns of docs: about `fit_rows` labelled keys, chosen by a hash.

    Labels are counted and chosen before texts are read, so only the chosen ones (key and label, about `fit_rows` rows) are broadcast.
    Null labels are left out; of several labels of one key the largest counts.
    """
    labels = (docs if labels is None else labels).where(F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("larkspur_label"))
    share = min(1.0, fit_rows / max(labels.count(), 1))
    chosen = labels.where(F.pmod(F.xxhash64(key), F.lit(1_000_003)) < F.lit(share * 1_000_003))
    rows = docs.select(key, "text").join(F.broadcast(chosen), key)
    got = sorted((r[0], r[1], r[2]) for r in _feature_rows(rows, (key, "larkspur_label")).collect())
    x = np.array([r[2] for r in got]) if got else np.zeros((0, len(BASE)))
    return fit_ranker(x, np.array([r[1] == 1 for r in got], bool), accept=accept)


def score(docs: DataFrame, model: Ranker, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of `keep`, score (0 to 1) and predicted (1 where score >= model.accept). Null and empty texts are scored like any other."""
    schema = docs.select(key, *keep).schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        for batch in batches:
            data, off = K.column(batch.column(batch.num_columns - 1))
            got = np.concatenate([model.score(features(data[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in K.slices(off)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got), pa.array((got >= model.accept).astype(np.int32))], schema.names)

    return docs.select(key, *keep, "text").mapInArrow(run, schema)
