"""Language identification: averaged hashed subword embeddings and a linear softmax,
trained in numpy by stochastic gradient descent, with calibrated rejection.

A text's subwords are the 2- to 4-grams of its lower-cased bytes, with every run of
other than letters as one space. Their embeddings are averaged and go through a linear
softmax. As that is linear, a trained model is a table of class scores by bucket and a
prediction one gather and one sum by document: no document moves. Training takes a
bounded sample (ROWS_PER_LANGUAGE rows of each language, fewer if there are more than
FULL_LANGUAGES, chosen by a hash of the key; no language is left out);
a fifth of it sets the temperature and the rejection threshold.

Defined results: null text, and text without a letter, is `und` with score 0; an empty
table, or one without labelled rows, gives `und` throughout; rows of null lang teach
nothing; repeated rows each get a row; ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_buffer

#: The bound of the training sample.
ROWS_PER_LANGUAGE = 700
#: Up to so many languages have all those rows; with more of them each has fewer, but no less than LEAST_ROWS.
FULL_LANGUAGES, LEAST_ROWS = 400, 50
BUCKET_BITS, DIM, EPOCHS, RATE, SEED = 15, 16, 8, 0.5, 7
GRAMS = (2, 3, 4)
#: The share of wrong answers among those not rejected that calibration allows.
REJECT_ERROR = 0.01
UNDETERMINED = "und"

_MAP = np.full(256, 0x20, np.uint8)
_MAP[0x41:0x5B] = np.arange(0x61, 0x7B)
_MAP[0x61:0x7B] = np.arange(0x61, 0x7B)
_MAP[0x80:] = np.arange(0x80, 0x100)
_ODD = (0, 0, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def subwords(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram length: (buckets, offsets of n+1 texts). Texts stand between spaces."""
    n = len(off) - 1
    lens = np.diff(off)
    padded = np.full(len(buf) + 2 * n, 0x20, np.uint8)
    doc = np.repeat(np.arange(n), lens)
    padded[np.arange(len(buf)) + 2 * doc + 1] = _MAP[buf]
    at = off + 2 * np.arange(n + 1)
    space = padded == 0x20
    keep = np.ones(len(padded), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    if n:
        keep[at[:-1]] = True
    b = padded[keep].astype(np.uint32)
    at = np.concatenate([[0], np.cumsum(keep)])[at]
    for k, length in enumerate(GRAMS):
        # texts of fewer bytes than the gram have none; grams that reach into the next text are left out
        m = np.maximum(np.diff(at) - length + 1, 0)
        to = np.concatenate([[0], np.cumsum(m)])
        first = np.repeat(at[:-1] - to[:-1], m) + np.arange(to[-1])
        code = b[first]
        for j in range(1, length):
            code = (code << np.uint32(8)) | b[first + j]
        code ^= code >> np.uint32(15)
        code = code * np.uint32(_ODD[length])
        yield (code >> np.uint32(32 - BUCKET_BITS)).astype(np.int64) + (k << BUCKET_BITS), to


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        total, count = np.zeros((n, len(self.languages))), np.zeros(n)
        for bucket, to in subwords(buf, off):
            has = np.flatnonzero(np.diff(to))
            if len(has):
                total[has] += np.add.reduceat(self.scores[bucket], to[has], axis=0)
            count += np.diff(to)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        return softmax(self.logits(buf, off) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def _bags(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for t in texts:
        all_ = [b for b, _ in subwords(np.frombuffer(t, np.uint8), np.array([0, len(t)]))]
        bucket, count = np.unique(np.concatenate(all_), return_counts=True)
        out.append((bucket, (count / max(1, count.sum())).astype(np.float32)))
    return out


def fit(texts: list[str], labels: list[str]) -> Model | None:
    """A model of texts and their languages; whole texts and, for short ones' sake, short cuts of them."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(SEED)
    no = {x: i for i, x in enumerate(languages)}
    data: list[bytes] = []
    y: list[int] = []
    fold: list[bool] = []
    for i, (t, label) in enumerate(zip(texts, labels, strict=True)):
        words = t.split()
        cuts = [t]
        for n in (1, 2, 5, 20):
            if len(words) > n:
                k = int(rng.integers(0, len(words) - n + 1))
                cuts.append(" ".join(words[k : k + n]))
        data += [c.encode() for c in cuts]
        y += [no[label]] * len(cuts)
        fold += [i % 5 == 4] * len(cuts)
    bags, target, test = _bags(data), np.array(y), np.array(fold)
    if test.all() or not test.any():
        test[:] = False
    e = (rng.standard_normal((len(GRAMS) << BUCKET_BITS, DIM)) * 0.1).astype(np.float32)
    w, b = np.zeros((len(languages), DIM), np.float32), np.zeros(len(languages), np.float32)
    learn = np.flatnonzero(~test)
    steps, step = EPOCHS * len(learn), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(learn).tolist():
            bucket, weight = bags[i]
            rate = RATE * (1 - step / steps)
            step += 1
            if not len(bucket):
                continue
            rows = e[bucket]
            h = weight @ rows
            p = softmax(w @ h + b)
            p[target[i]] -= 1
            back = p @ w
            w -= rate * np.outer(p, h)
            b -= rate * 0.1 * p
            # a text's embedding is the mean of many: each of its rows moves by its own share of the count
            e[bucket] = rows - (rate * len(bucket) ** 0.5) * weight[:, None] * back
    model = Model(languages, e @ w.T, b.astype(np.float64))
    _calibrate(model, [data[i] for i in np.flatnonzero(test)], target[test])
    return model


def _calibrate(model: Model, texts: list[bytes], target: np.ndarray) -> None:
    """Temperature by likelihood, and the least threshold that keeps accepted errors rare."""
    if not texts:
        return
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    logits = model.logits(np.frombuffer(b"".join(texts), np.uint8), off)
    rows = np.arange(len(target))
    model.temperature = float(min((2.0 ** np.arange(-4, 4.25, 0.25)), key=lambda t: -np.log(softmax(logits / t)[rows, target] + 1e-12).mean()))
    p = softmax(logits / model.temperature)
    top, right = p.max(1), p.argmax(1) == target
    order = np.argsort(-top, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(wrong <= REJECT_ERROR)
    model.threshold = float(top[order[fine[-1]]]) if len(fine) else 1.0


def sample(rows: DataFrame, by: Column, most: int, counts: dict, label: str = "y") -> DataFrame:
    """About `most` rows of each label, chosen by the hash `by`; rows above the bound fall to a limit."""
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, most / max(1, n)))).otherwise(share)
    u = F.shiftrightunsigned(by, 11) * F.lit(2.0**-53)
    return rows.withColumn("u", u).where(F.col("u") < share).orderBy("u").limit(most * max(1, len(counts)) * 5 // 4).drop("u")


def train(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """Fits on a bounded sample of the rows where `learn` holds and the label is known."""
    rows = docs.where(learn & F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(text).alias("x"), F.col(label).alias("y"))
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    most = rows_per_language if len(counts) <= FULL_LANGUAGES else max(LEAST_ROWS, rows_per_language * FULL_LANGUAGES // len(counts))
    by = F.xxhash64("k", F.lit("langid"))
    if len(counts) <= FULL_LANGUAGES:
        got = sample(rows, by, most, counts).collect()
    else:  # too many for one expression
        share = rows.sparkSession.createDataFrame([(y, min(1.0, most / n)) for y, n in counts.items()], "y string, share double")
        u = F.shiftrightunsigned(by, 11) * F.lit(2.0**-53)
        got = rows.join(F.broadcast(share), "y").where(u < F.col("share")).select("k", "x", "y").collect()
    got.sort(key=lambda r: (r.y, r.k, r.x))
    return fit([r.x for r in got], [r.y for r in got])


def _has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    ascii_ = np.zeros(256, bool)
    ascii_[0x41:0x5B] = ascii_[0x61:0x7B] = True
    seen = np.concatenate([[0], np.cumsum(ascii_[buf])])
    has = seen[off[1:]] > seen[off[:-1]]
    for i in np.flatnonzero(~has & (np.diff(off) > 0)).tolist():
        has[i] = any(c.isalpha() for c in buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return has


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, rejected) for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by parameters and the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            buf, off, _ = text_buffer(batch.column(1))
            names, score, rejected = [], [], []
            for i, j in chunks(off):
                b, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                if model is None:
                    best, p, has = np.zeros(j - i, int), np.zeros(j - i), np.zeros(j - i, bool)
                else:
                    prob, has = model.probabilities(b, o), _has_letter(b, o)
                    best = prob.argmax(1)
                    p = np.where(has, prob.max(1), 0.0)
                names += [model.languages[x] if h else UNDETERMINED for x, h in zip(best.tolist(), has.tolist(), strict=True)]
                score += p.tolist()
                rejected += (~has | (p < (model.threshold if model else 1))).tolist()
            cols = [batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["k", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, lang_pred string, score double, rejected boolean").withColumnRenamed("k", key)
