"""Toxicity by a classifier chain.

One linear model per category, in a fixed order. Each later model sees the words and the probabilities of the earlier
categories; it is trained with out-of-fold predictions of those, so that it learns from probabilities as uncertain as
the ones it will get. The models are logistic regressions over hashed words, fitted by conjugate gradients on a bounded
sample of labelled rows (``SAMPLE`` rows, least hash of the id); scoring covers whole texts of all rows.

The categories are label columns of 0 and 1 in the order of the chain; the query op6 takes low quality first, then the
verdict (``toxic``), which low quality supports. Labels that are null leave their row out of that category's training.

Defined cases: a null or blank text has no words and gets the models' intercepts; labels without a document and
documents without a label are fine; rows of the labels that repeat an id count each; if the sample holds one class
only, its smoothed share is the probability for all; an empty table gives an empty result; other columns pass through
inside ``row``, whatever their names; very long texts count like others, one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast, packed, quoted, received, slices, small_batches, utf8, with_row

#: Labelled rows that the models are fitted on, at most; a documented bound, the only one here.
SAMPLE = 5_000
#: Hashed words; folds of the out-of-fold predictions; penalty on squared weights; steps of the fit.
SPACE, FOLDS, PENALTY, STEPS = 1 << 18, 5, 0.01, 7
#: Value of a feature that is there. A feature gets a weight if it is in LEAST rows of the sample and in no more than the
#: share MOST of them (what nearly every text has tells nothing).
SCALE, LEAST, MOST = 0.1, 3, 0.2
#: Lengths in bytes of the word beginnings that count as features beside whole words; compounds share them.
PREFIXES = (4, 5, 6)
#: Words that a worker remembers the places of before it forgets them all.
MEMORY = 200_000

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class Hasher:
    """The distinct lower-cased words of a text, and their first bytes, as places in [0, SPACE)."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words, known = set(_WORD.findall(text.lower())), self.known
        if len(known) > MEMORY:
            known.clear()
        found: list[int] = []
        for w in words:
            places = known.get(w)
            if places is None:
                parts = [w + b"$", *(w[:n] for n in PREFIXES if len(w) >= n)]
                places = known[w] = tuple(xxhash.xxh64_intdigest(p) % SPACE for p in parts)
            found += places
        return np.array(sorted(set(found)), np.int32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places = Hasher()
    for batch in slices(batches, 1):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([places(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["row", "places"])


@dataclass
class Rows:
    """Sparse rows: places[start[i]:start[i + 1]] belong to row i, each with the value SCALE."""

    places: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Rows:
        return cls(np.concatenate([np.empty(0, np.int32), *rows]), np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64))

    def __post_init__(self):
        length = np.diff(self.start)
        self.owner = np.repeat(np.arange(len(length)), length)
        self.scale = np.full(len(length), SCALE)

    def compact(self) -> tuple[Rows, np.ndarray]:
        """Only places that get a weight, numbered anew; and the places behind the numbers."""
        places, flat, count = np.unique(self.places, return_inverse=True, return_counts=True)
        fit = (count >= LEAST) & (count <= max(LEAST, MOST * len(self.scale)))
        number, kept = np.cumsum(fit) - 1, fit[flat]
        start = np.r_[0, np.cumsum(kept)][self.start]
        return Rows(number[flat][kept].astype(np.int32), start), places[fit]

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.scale))
        full = np.flatnonzero(np.diff(self.start))
        if len(full):
            out[full] = np.add.reduceat(w[self.places], self.start[full])
        return out * self.scale

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.places, (r * self.scale)[self.owner], size)

    def take(self, at: np.ndarray) -> Rows:
        return Rows.of([self.places[self.start[i] : self.start[i + 1]] for i in at])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Linear:
    words: np.ndarray  # SPACE weights
    earlier: np.ndarray  # a weight for the logit of each earlier category
    intercept: float

    def predict(self, x: Rows, earlier: np.ndarray) -> np.ndarray:
        return _sigmoid(x.dot(self.words) + earlier @ self.earlier + self.intercept)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 4


def fit(x: Rows, earlier: np.ndarray, y: np.ndarray, size: int) -> Linear:
    """Penalised logistic regression with balanced class weights: Newton steps, each solved by conjugate gradients."""
    k, n = earlier.shape[1], len(y)
    if not n or y.min() == y.max():
        share = (y.sum() + 0.5) / (n + 1)
        return Linear(np.zeros(size), np.zeros(k), float(np.log(share / (1 - share))))
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    theta = np.zeros(size + k + 1)
    penalty = np.r_[np.full(size + k, PENALTY), 1e-6]

    def forward(t):
        return x.dot(t[:size]) + earlier @ t[size:-1] + t[-1]

    def backward(r):
        return np.r_[x.back(r, size), earlier.T @ r, r.sum()]

    def loss(t):
        z = forward(t)
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + (penalty * t * t).sum() / 2

    now = loss(theta)
    for _ in range(STEPS):
        p = _sigmoid(forward(theta))
        grad = backward(weight * (p - y)) + penalty * theta
        curve = weight * p * (1 - p) + 1e-9
        step, rest = np.zeros_like(theta), -grad
        way, energy = rest.copy(), rest @ rest
        goal = energy * 1e-2
        for _ in range(15):
            bent = backward(curve * forward(way)) + penalty * way
            length = energy / (way @ bent)
            step += length * way
            rest -= length * bent
            energy, before = rest @ rest, energy
            if energy < goal:
                break
            way = rest + energy / before * way
        scale = 1.0
        while (then := loss(theta + scale * step)) > now and scale > 1e-4:
            scale /= 2
        theta = theta + scale * step
        if now - then < 1e-5 * abs(now):
            break
        now = then
    return Linear(theta[:size], theta[size:-1], float(theta[-1]))


@dataclass
class Chain:
    models: list[Linear]
    thresholds: list[float]  # a category's probability from which it holds


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 over out-of-fold probabilities, halfway to the next lower one."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    last = np.flatnonzero(np.r_[p[1:] < p[:-1], True])  # equal probabilities stand together
    best = last[np.argmax(f1[last])]
    return float((p[best] + (p[best + 1] if best + 1 < len(p) else 0)) / 2)


def fit_chain(x: Rows, labels: np.ndarray, fold: np.ndarray) -> Chain:
    """labels: a column a category, nan where unknown. Out-of-fold probabilities of each category feed the next ones."""
    chain, earlier = Chain([], []), np.empty((len(labels), 0))
    x, places = x.compact()
    for c in range(labels.shape[1]):
        known, out = ~np.isnan(labels[:, c]), np.empty(len(labels))
        for k in range(FOLDS):
            at, rest = np.flatnonzero(known & (fold != k)), np.flatnonzero(fold == k)
            out[rest] = fit(x.take(at), earlier[at], labels[at, c], len(places)).predict(x.take(rest), earlier[rest])
        at = np.flatnonzero(known)
        model = fit(x.take(at), earlier[at], labels[at, c], len(places))
        words = np.zeros(SPACE)
        words[places] = model.words
        chain.models.append(Linear(words, model.earlier, model.intercept))
        chain.thresholds.append(_threshold(out[at], labels[at, c]))
        earlier = np.c_[earlier, logit(out)]
    return chain


def apply_chain(chain: Chain, x: Rows) -> np.ndarray:
    earlier, found = np.empty((len(x.scale), 0)), []
    for model in chain.models:
        found.append(model.predict(x, earlier))
        earlier = np.c_[earlier, logit(found[-1])]
    return np.stack(found, 1)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Chain:
    """Fits the chain on the driver, on at most ``sample`` labelled rows; what is collected is bounded by that."""
    own, names = quoted(doc_id), [quoted(c) for c in categories]
    chosen = labels.select(own, *names).where(F.col(own).isNotNull()).orderBy(F.xxhash64(F.lit("sample"), own), own, *names).limit(sample)
    # Of documents that repeat an id the one whose text has the least hash; so the sample bounds the rows, too.
    texts = docs.select(own, utf8(text).alias("data")).join(F.broadcast(chosen.select(own).distinct()), doc_id)
    texts = texts.groupBy(own).agg(F.min(F.struct(F.xxhash64("data"), "data"))["data"].alias("data"))
    rows = texts.join(F.broadcast(chosen), doc_id)
    data = rows.select(F.struct(F.pmod(F.xxhash64(F.lit("fold"), own), F.lit(FOLDS)).alias("fold"), F.xxhash64(F.lit("sample"), own).alias("rank"), *names).alias("row"), "data")
    found = data.mapInArrow(_features, with_row(data, "places array<int>")).orderBy("row.rank").toArrow()
    row, places = found.column("row").combine_chunks(), found.column("places").combine_chunks()
    known = np.stack([np.array(row.field(c).to_pylist(), float) for c in categories], 1) if len(row) else np.empty((0, len(categories)))
    x = Rows.of([np.asarray(p, np.int32) for p in places.to_pylist()])
    return fit_chain(x, known, np.array(row.field("fold").to_pylist(), int))


def _score(chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, models = Hasher(), received(chain)
        for batch in slices(batches, 1):
            x = Rows.of([places(t) for t in batch.column(1).to_pylist()])
            found = apply_chain(models, x).reshape(batch.num_rows, len(models.models))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(found), pa.list_(pa.float64()))], names=["row", "probabilities"])

    return run


def score(docs: DataFrame, chain: Chain, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Returns row (the columns ``keep``, by default all but the text) and probabilities, one a category in chain order.

    The broadcast models have a fixed size: SPACE weights a category.
    """
    small_batches(docs.sparkSession)
    data = docs.select(packed(keep or [c for c in docs.columns if c != text]), utf8(text).alias("data"))
    models = broadcast(docs.sparkSession, chain)
    return data.mapInArrow(_score(models), with_row(data, "probabilities array<double>"))
