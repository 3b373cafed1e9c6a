"""Quality by positive-unlabelled learning.

Texts become a row of shape figures (case, punctuation, repetition of words and lines,
word lengths), cut into bins. A logistic model minimises the non-negative unbiased risk
of trusted positives and unlabelled web text: prior * R_pos(+) + max(0, R_unl(-) -
prior * R_pos(-)). The class prior is estimated from how rare the unlabelled are where
positives are common; labels of 0 teach nothing. Both samples are bounded (SAMPLE_ROWS of each, by a hash of the key).

Defined results: null and empty text are scored as a text without words; an empty table
gives an empty result; without positives every score is the prior, 0.5; rows of null
labels teach nothing; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, chunks, mix, prefix_hash, span_hash, text_buffer, words

#: The bound of each of the two training samples.
SAMPLE_ROWS = 6000
#: Scores from here on are accepted.
ACCEPT = 0.3
BINS, STEPS, RATE, L2, KNOTS = 12, 600, 0.05, 1e-3, 60
FOLDS, PRIOR_STEPS = 5, 300

_NOT_LINE = np.ones(256, bool)
_NOT_LINE[[0x0A, 0x0D]] = False
_CLASSES = {
    "upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "space": b" \t", "line": b"\n\r",
    "stop": b".,;:?'\"-", "cry": b"!", "mark": b"*#$%&@^~=+_|<>{}[]\\/`", "wide": range(0x80, 0x100),
}
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _c in enumerate(_CLASSES.values()):
    _CLASS[list(_c)] = _i


def _distinct(of: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text: how many different values, and the sum of squared counts."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(of[order], kind="stable")]
    a, b = of[order], h[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(a)))
    return np.bincount(a[at], minlength=n).astype(float), np.bincount(a[at], weights=count.astype(float) ** 2, minlength=n)


def figures(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of figures for each text."""
    n, size = len(off) - 1, np.diff(off)
    one = np.maximum(size, 1).astype(float)
    of_byte = np.repeat(np.arange(n), size)
    k = len(_CLASSES) + 1
    share = np.bincount(of_byte * k + _CLASS[buf], minlength=n * k).reshape(n, k) / one[:, None]
    s, e, of = words(buf, off, NOT_SPACE)
    h = span_hash(prefix_hash(buf), s, e) if len(s) else np.zeros(0, np.uint64)
    count = np.bincount(of, minlength=n).astype(float)
    w = np.maximum(count, 1)
    length = (e - s).astype(float)
    mean = np.bincount(of, weights=length, minlength=n) / w
    spread = np.sqrt(np.maximum(np.bincount(of, weights=length**2, minlength=n) / w - mean**2, 0))
    different, squares = _distinct(of, h, n)
    same = (of[1:] == of[:-1]) if len(of) else np.zeros(0, bool)
    again = np.bincount(of[1:][same & (h[1:] == h[:-1])], minlength=n) / w
    pair_of = of[1:][same]
    pairs, _ = _distinct(pair_of, mix(h[:-1][same] * np.uint64(3) + h[1:][same]), n)
    odd_end = np.zeros(n)
    capital = np.zeros(n)
    if len(s):
        last, first = buf[e - 1], buf[s]
        odd_end = np.bincount(of[np.isin(last, list(b"*#$%&!|@"))], minlength=n) / w
        capital = np.bincount(of[(first >= 0x41) & (first < 0x5B)], minlength=n) / w
    ls, le, lof = words(buf, off, _NOT_LINE)
    lines = np.bincount(lof, minlength=n).astype(float)
    lh = span_hash(prefix_hash(buf), ls, le) if len(ls) else np.zeros(0, np.uint64)
    line_kinds, _ = _distinct(lof, lh, n)
    return np.column_stack([
        share, np.log1p(count), mean, spread, different / w, squares / w**2, again, pairs / np.maximum(w - 1, 1), odd_end, capital,
        np.log1p(lines), line_kinds / np.maximum(lines, 1), count / np.maximum(lines, 1), different / np.sqrt(w),
    ])


@dataclass
class Model:
    edges: np.ndarray  # figures x (BINS - 1)
    weights: np.ndarray  # figures x BINS
    bias: float
    prior: float
    knots: np.ndarray | None = None
    posterior: np.ndarray | None = None

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.edges)], axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        return self.weights[np.arange(b.shape[1])[None, :], b].sum(1) + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        """The posterior, with a thousandth of the plain logistic value so that ties keep their order."""
        z = self.logit(x)
        p = sigmoid(z)
        return p if self.knots is None else 0.999 * np.interp(z, self.knots, self.posterior) + 0.001 * p


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """From scores alone: the least ratio, over thresholds that enough positives pass, of the
    unlabelled and positive shares above. No threshold is free of negatives, so each ratio
    lies above the prior; it is taken one standard error of both shares lower."""
    cuts = np.quantile(positive, np.append([0.01, 0.02], np.arange(0.05, 0.66, 0.05)))
    p, u = (positive[:, None] >= cuts).mean(0), (unlabelled[:, None] >= cuts).mean(0)
    p, u = p + np.sqrt(p * (1 - p) / len(positive)), u - np.sqrt(u * (1 - u) / len(unlabelled))
    return float(np.clip((u / p).min(), 0.02, 0.98))


def cross_fitted_prior(pos: np.ndarray, unl: np.ndarray, edges: np.ndarray) -> float:
    """The prior by scores that each row gets from a model that has not learnt it, or the model
    would know its positives. A model learnt at the first estimate separates better, so the
    estimate is made again at it; both bound the prior from above, and the lower one holds."""
    if min(len(pos), len(unl)) < FOLDS:
        return 0.5
    of_p, of_u = np.arange(len(pos)) % FOLDS, np.arange(len(unl)) % FOLDS

    def at(prior: float) -> float:
        zp, zu = np.empty(len(pos)), np.empty(len(unl))
        for k in range(FOLDS):
            part = _minimise(pos[of_p != k], unl[of_u != k], prior, edges, PRIOR_STEPS)
            zp[of_p == k], zu[of_u == k] = part.logit(pos[of_p == k]), part.logit(unl[of_u == k])
        return estimate_prior(zp, zu)

    first = at(0.5)
    return min(first, at(first))


def _minimise(pos: np.ndarray, unl: np.ndarray, prior: float, edges: np.ndarray, steps: int = STEPS) -> Model:
    """Adam on the non-negative risk with the logistic loss; where the negative part falls below 0 its gradient is undone."""
    f = edges.shape[0]
    model = Model(edges, np.zeros((f, BINS)), float(np.log(prior / (1 - prior))), prior)
    bp, bu = model.bins(pos), model.bins(unl)
    cols = np.arange(f)[None, :]
    flat_p, flat_u = (bp + cols * BINS), (bu + cols * BINS)
    theta, m, v = np.zeros(f * BINS + 1), np.zeros(f * BINS + 1), np.zeros(f * BINS + 1)
    theta[-1] = model.bias

    def grad(flat: np.ndarray, g: np.ndarray) -> np.ndarray:
        out = np.bincount(flat.ravel(), weights=np.repeat(g, f), minlength=f * BINS)
        return np.append(out, g.sum())

    for t in range(1, steps + 1):
        zp, zu = theta[:-1][flat_p].sum(1) + theta[-1], theta[:-1][flat_u].sum(1) + theta[-1]
        pp, pu = sigmoid(zp), sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_neg = grad(flat_u, pu / len(zu)) - grad(flat_p, prior * pp / len(zp))
        g = grad(flat_p, -prior * (1 - pp) / len(zp)) + g_neg if negative >= 0 else -g_neg
        g[:-1] += L2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= RATE * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.weights, model.bias = theta[:-1].reshape(f, BINS), float(theta[-1])
    return model


def fit(pos: np.ndarray, unl: np.ndarray, prior: float | None) -> Model:
    both = np.concatenate([pos, unl])
    edges = np.stack([np.quantile(both[:, k], np.arange(1, BINS) / BINS) for k in range(both.shape[1])])
    if prior is None:
        prior = cross_fitted_prior(pos, unl, edges)
    model = _minimise(pos, unl, float(np.clip(prior, 0.02, 0.98)), edges)
    _calibrate(model, pos, unl)
    return model


def _calibrate(model: Model, pos: np.ndarray, unl: np.ndarray) -> None:
    """The posterior is prior * p(z | positive) / p(z): a ratio of shares by bin of z, made monotone by pooling neighbours that fall."""
    zp, zu = model.logit(pos), model.logit(unl)
    cuts = np.unique(np.quantile(np.concatenate([zp, zu]), np.arange(1, KNOTS) / KNOTS))
    k = len(cuts) + 1
    of_p, of_u = np.searchsorted(cuts, zp, "right"), np.searchsorted(cuts, zu, "right")
    fp, fu = (np.bincount(of_p, minlength=k) / len(zp)), (np.bincount(of_u, minlength=k) / len(zu))
    centre = (np.bincount(of_p, weights=zp, minlength=k) + np.bincount(of_u, weights=zu, minlength=k)) / np.maximum(1, np.bincount(of_p, minlength=k) + np.bincount(of_u, minlength=k))
    blocks: list[list[float]] = []  # numerator, denominator, bins
    for a, b in zip(model.prior * fp, np.maximum(fu, 0.5 / len(zu)), strict=True):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a2, b2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a2, blocks[-1][1] + b2, blocks[-1][2] + n2]
    model.knots, model.posterior = centre, np.repeat([min(1.0, x[0] / x[1]) for x in blocks], [int(x[2]) for x in blocks])


def _texts_figures(texts: list[str]) -> np.ndarray:
    buf, off, _ = text_buffer(pa.array(texts, pa.string()))
    return np.concatenate([figures(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in chunks(off)])


def train(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> Model | None:
    """Positives are labelled rows of 1 where `learn` (of the documents' key) holds; the unlabelled are any rows where it holds."""
    y = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    mine = docs.where(learn).select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    u = F.shiftrightunsigned(F.xxhash64(F.col("k").cast("string"), F.lit("quality")), 11) * F.lit(2.0**-53)
    n_pos, n_all = y.where("y = 1").join(mine.select("k").distinct(), "k").count(), mine.count()
    if not n_pos or not n_all:
        return None
    some = lambda df, of: df.withColumn("u", u).where(F.col("u") < min(1.0, rows / of)).orderBy("u", "k").limit(rows * 5 // 4)
    chosen = some(y.where("y = 1"), max(1, n_pos)) if n_pos else None
    pos = [r.x for r in mine.join(F.broadcast(chosen.select("k")), "k").orderBy("k", "x").limit(rows * 3 // 2).collect()]  # the keys are at most 5/4 of the bound
    unl = [r.x for r in some(mine, n_all).collect()]
    if not pos or not unl:
        return None
    return fit(_texts_figures(pos), _texts_figures(unl), None)


def _scored(col: pa.Array, model: Model | None) -> np.ndarray:
    buf, off, _ = text_buffer(col)
    if model is None:
        return np.full(len(off) - 1, 0.5)
    parts = [model.score(figures(buf[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in chunks(off)]
    return np.concatenate(parts) if parts else np.zeros(0)


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """(key, score, predicted) for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _scored(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= accept).astype(np.int32))], names=["k", "score", "predicted"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, score double, predicted int").withColumnRenamed("k", key)


def accept(docs: DataFrame, model: Model | None, text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """The documents that the model accepts, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scored(batch.column(place), shared.value) >= accept))

    return docs.mapInArrow(run, docs.schema)
