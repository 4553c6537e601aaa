"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts are taken as labels; all else is unlabelled, toxic texts among it. The risk of a classifier is
estimated without negatives: of the loss of unlabelled texts as negatives, the part that the class prior ascribes to
positives is taken off, and where the difference would fall below zero (which overfitting does) the step goes up that term
instead of down. The classifier is linear, in numpy, over the words and the beginnings of words that a text has. Unless
``signed``, its weights are not negative, so what else a text says, however long, does not outweigh what is toxic in it.

No negative label is used, for the class prior neither: of all regions {score of at least c}, one holds the share q of positive
texts and r of unlabelled ones, and the prior is at most r / q. It is read where that bound, with room for what chance does
to both shares, is smallest, on halves of the sample that the scoring classifier was not fitted to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, durable, hash_spans, release, slices, text_bytes

#: Letters and digits, and all bytes of other characters, make words.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


#: The class prior where too few texts are known to estimate it, and how many are needed.
PRIOR, KNOWN = 0.1, 30


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample that is fitted, and how it is fitted."""

    positives: int = 4000
    unlabelled: int = 12_000
    buckets: int = 1 << 22
    beginnings: tuple[int, ...] = (4, 5, 6)
    least: int = 4  # positives that have a feature
    ratio: float = 2.5  # how much more often positives have it than unlabelled texts do
    kept: int = 1 << 16  # features that may have a weight: those that most positives have
    signed: bool = False
    steps: int = 300
    rate: float = 0.1
    shrink: float = 1e-4
    folds: int = 5
    left_out: tuple[int, ...] = (0,)  # folds whose labels and texts are not learnt from


def features(data: np.ndarray, off: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row): hashes of a text's words and of their first bytes, as often as they occur; A-Z are lower-cased."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _INSIDE[data]
    cut = np.zeros(n, bool)
    cut[off[:-1][off[:-1] < n]] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(off, starts, "right") - 1
    out, rows = [hash_spans(data, starts, ends, lower=True)], [row]
    for k in s.beginnings:
        long = ends - starts > k
        out.append(hash_spans(data, starts[long], starts[long] + k, lower=True) ^ U64(k))
        rows.append(row[long])
    return (np.concatenate(out) & U64(s.buckets - 1)).astype(np.int64), np.concatenate(rows)


def fold_of(key: Column, folds: int) -> Column:
    """CRC-32 of the key as text, modulo the number of folds; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


@dataclass(frozen=True)
class Model:
    """Weights of the features that have one, in order of their numbers."""

    numbers: np.ndarray
    weights: np.ndarray
    bias: float
    settings: Settings

    def table(self) -> np.ndarray:
        out = np.zeros(self.settings.buckets, np.float32)
        out[self.numbers] = self.weights
        return out


def chosen_features(count: np.ndarray, other: np.ndarray, positives: int, unlabelled: int, s: Settings) -> np.ndarray:
    """Where features are, of those with ``count`` positives and ``other`` unlabelled texts that have them."""
    some = np.flatnonzero((count >= s.least) & (count / max(positives, 1) >= s.ratio * other / max(unlabelled, 1)))
    if len(some) > s.kept:
        some = np.sort(some[np.argsort(-count[some], kind="stable")[: s.kept]])
    return some


def fit_rows(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, s: Settings) -> Model:
    """The classifier of texts given as their distinct features."""
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.int64), np.zeros(0), -4.0, s)
    every, inverse = np.unique(np.concatenate([*positive, *unlabelled]), return_inverse=True)
    sizes = np.array([len(x) for x in [*positive, *unlabelled]])
    m, p = len(sizes), len(positive)
    rows = np.repeat(np.arange(m), sizes)
    count, other = np.bincount(inverse[rows < p], minlength=len(every)), np.bincount(inverse[rows >= p], minlength=len(every))
    some = chosen_features(count, other, p, m - p, s)
    numbers = every[some]
    place = np.full(len(every), -1, np.int64)
    place[some] = np.arange(len(some))
    at = place[inverse]
    at, rows = at[at >= 0], rows[at >= 0]
    w, b = np.zeros(len(numbers)), float(np.log(prior / (1 - prior)))
    moments = [np.zeros(len(w) + 1), np.zeros(len(w) + 1)]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, s.steps + 1):
        z = np.bincount(rows, w[at], m) + b
        g = sigmoid(z)
        # Logistic loss: as positive its slope is g - 1, as negative g.
        as_negative_u, as_negative_p = np.logaddexp(0, z[p:]).mean(), np.logaddexp(0, z[:p]).mean()
        slope = np.zeros(m)
        if as_negative_u - prior * as_negative_p >= 0:
            slope[:p] = (prior * (g[:p] - 1) - prior * g[:p]) / p
            slope[p:] = g[p:] / (m - p)
        else:
            slope[:p] = prior * g[:p] / p
            slope[p:] = -g[p:] / (m - p)
        grad = np.append(np.bincount(at, slope[rows], len(w)) + s.shrink * (np.sign(w) if s.signed else 1.0), slope.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad**2
        move = s.rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        w = w - move[:-1]
        if not s.signed:
            w = np.maximum(0.0, w)
        b -= float(move[-1])
    return Model(numbers, w, b, s)


def logits(rows: list[np.ndarray], model: Model) -> np.ndarray:
    weight = model.table()
    return np.array([model.bias + float(weight[x].sum(dtype=np.float64)) for x in rows])


def prior_of(positive: np.ndarray, unlabelled: np.ndarray, risk: float = 0.1) -> float:
    """The part of positives among unlabelled texts, from the scores of both (of texts that the scorer was not fitted to); ``PRIOR``
    where there are fewer than ``KNOWN`` of either."""
    if min(len(positive), len(unlabelled)) < KNOWN:
        return PRIOR
    p, u = np.sort(positive), np.sort(unlabelled)
    cut = np.unique(p)
    q = 1 - np.searchsorted(p, cut, "left") / len(p)
    r = 1 - np.searchsorted(u, cut, "left") / len(u)
    room = np.sqrt(np.log(4 / risk) / 2) * (1 / np.sqrt(len(u)) + 1 / np.sqrt(len(p)))
    best = int(np.argmin((r + room) / q))
    return float(np.clip(r[best] / q[best], 0.005, 0.4))


def estimate_prior(positive: list[np.ndarray], unlabelled: list[np.ndarray], s: Settings) -> float:
    """``prior_of`` of each half, scored by a classifier of the other half; their mean."""
    if min(len(positive), len(unlabelled)) < 2 * KNOWN:
        return PRIOR
    out = []
    for k in (0, 1):
        model = fit_rows(positive[1 - k :: 2], unlabelled[1 - k :: 2], PRIOR, s)
        out.append(prior_of(logits(positive[k::2], model), logits(unlabelled[k::2], model)))
    return float(np.mean(out))


def _row_features(b: pa.RecordBatch, s: Settings) -> Iterator[np.ndarray]:
    f, row = features(*text_bytes(b.column("text")), s)
    both = np.unique((row << 32) | f)
    bounds = np.searchsorted(both >> 32, np.arange(b.num_rows + 1))
    for k in range(b.num_rows):
        yield both[bounds[k] : bounds[k + 1]] & 0xFFFFFFFF


def sample_features(rows: DataFrame, s: Settings) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The features of the positive and of the unlabelled texts of a bounded sample (``h``, ``y``, ``text``), in order of ``h``.

    Features are counted where the texts are; only those that may have a weight, ``kept`` at most, are told for each text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            y = b.column("y").to_numpy()
            f = list(_row_features(b, s))
            n = [np.unique(np.concatenate([np.zeros(0, np.int64), *(f[k] for k in np.flatnonzero(y == v))]), return_counts=True) for v in (1, 0)]
            for v, (x, c) in zip((1, 0), n, strict=True):
                zero = np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(c if v else zero), pa.array(zero if v else c)], ["f", "p", "u"])

    sizes = rows.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("p"), F.count(F.lit(1)).alias("n")).first()
    p, u = int(sizes["p"]), int(sizes["n"]) - int(sizes["p"])
    counted = rows.mapInArrow(count, "f bigint, p bigint, u bigint").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    # Halves of the sample are fitted too, so what half the positives have is told as well.
    may = counted.where((F.col("p") >= s.least) & (F.col("p") / max(p, 1) >= 0.5 * s.ratio * F.col("u") / max(u, 1)))
    known = np.sort(np.array([r["f"] for r in may.orderBy(F.desc("p"), "f").limit(s.kept).select("f").collect()], np.int64))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            own = [np.intersect1d(x, known, assume_unique=True).astype("<u4").tobytes() for x in _row_features(b, s)]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("y"), pa.array(own, pa.binary())], ["h", "y", "f"])

    got = sorted(rows.mapInArrow(told, "h bigint, y int, f binary").collect(), key=lambda r: (r["h"], bytes(r["f"])))
    of = lambda y: [np.frombuffer(r["f"], "<u4").astype(np.int64) for r in got if r["y"] == y]
    return of(1), of(0)


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """Fit the classifier to a bounded sample: at most ``positives`` confirmed toxic texts and ``unlabelled`` others, both
    taken by a hash of the key and the text. Rows of the folds ``left_out`` are neither learnt from nor in the sample. What has
    no label, a null label or a null key counts as unlabelled, as does a text that is labelled not toxic; a key with
    several labels is toxic if one of them says so. Rows of one key and text count once. Without a positive, everything
    scores low."""
    s = settings or Settings()
    learnt = ~fold_of(F.col("k"), s.folds).isin(*s.left_out)
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y = 1").where(learnt).select("k").distinct()
    # Which rows: by key and hash of the text alone. No row of the sample stands for another, so its number is bounded.
    named = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("k is not null").where(learnt)
    named = named.withColumn("t", F.xxhash64("text"))
    order = F.xxhash64(F.col("k").cast("string"), F.col("t"))
    pick = lambda rows, n: rows.select("k", "t").withColumn("h", order).dropDuplicates(["h"]).orderBy("h").limit(n)
    positive = pick(named.join(known, "k", "left_semi"), s.positives).withColumn("y", F.lit(1))
    others = pick(named, s.unlabelled).withColumn("y", F.lit(0))
    chosen = positive.unionByName(others)
    # Bounded by the settings, so it may be broadcast; rows of one key and text are one.
    rows = durable(named.join(F.broadcast(chosen), ["k", "t"]).dropDuplicates(["h", "y"]).select("h", "y", "text"), "sample")
    told = sample_features(rows, s)
    release(rows)
    return fit_rows(*told, estimate_prior(*told, s), s)


def validate(docs: DataFrame, labels: DataFrame, settings: list[Settings], text: str = "text", key: str = "doc_id", label: str = "toxic") -> list[tuple[Settings, int, int, int, int, int]]:
    """How settings do inside the folds that may be learnt from: for each of ``settings`` and of those folds, a classifier that
    leaves the fold out too is held against the fold's labels. (settings, fold, positives, of them found, negatives, of them
    called toxic). Labels of fold 0 take no part."""
    marks = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null").groupBy("k").agg(F.max("y").alias("y"))
    out = []
    for s in settings:
        for fold in range(1, s.folds):
            model = train(docs, labels, replace(s, left_out=(0, fold)), text, key, label)
            own = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).where(fold_of(F.col("k"), s.folds) == fold).join(marks, "k")
            hit = score_texts(own, model).select("y", (F.col("score") >= 0.5).cast("int").alias("hit"))
            n = hit.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("y"), F.col("y") * F.col("hit"), 1 - F.col("y"), (1 - F.col("y")) * F.col("hit"))]).first()
            out.append((s, fold, *map(int, n)))
    return out


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` double: from 0 to 1, of each whole text; a null text counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that was fitted
    names = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        weight = m.table()
        for b in slices(batches, text):
            data, off = text_bytes(b.column(text))
            total = np.full(b.num_rows, m.bias)
            step = 1 << 20
            if len(data) > 8 * step and b.num_rows == 1:
                total[0] += _long(data, weight, m.settings)
            else:
                f, row = distinct(*features(data, off, m.settings), weight)
                total += np.bincount(row, weight[f].astype(np.float64), b.num_rows)
            out = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*names, "score"])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def distinct(f: np.ndarray, row: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature that has a weight once for a row."""
    some = weight[f] != 0
    both = np.unique((row[some] << 32) | f[some])
    return both & 0xFFFFFFFF, both >> 32


def _long(data: np.ndarray, weight: np.ndarray, s: Settings) -> float:
    """Sum of the weights of a very long text's distinct features, a stretch at a time."""
    seen, at, step = np.zeros(len(weight), bool), 0, 1 << 20
    while at < len(data):
        end = min(len(data), at + step)
        while end < len(data) and _INSIDE[data[end]]:
            end += 1
        f, _ = features(data[at:end], np.array([0, end - at]), s)
        seen[f] = True
        at = end
    return float(weight[seen].sum(dtype=np.float64))


def score_documents(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Score every document by what its text alone says.

    Returns ``key``, ``held_out`` boolean (the key's fold is 0, so no label of it was learnt from), ``score`` double and
    ``predicted`` int (1 if the score is at least 0.5). Null texts are empty ones, and get the score of a text without
    known words; every row is kept, repeated ones too. An empty table gives no rows; with no labels at all everything
    scores low. Other columns are left out.
    """
    s = settings or Settings()
    model = train(docs, labels, s, text, key, label)
    scored = score_texts(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")), model, "__text")
    return scored.select(F.col("__key").alias(key), (fold_of(F.col("__key"), s.folds) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """The documents that the classifier does not call toxic, with their columns."""
    names = list(docs.columns)
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])  # a column may be called "score"
    scored = score_texts(plain, train(docs, labels, settings, text, key, label), f"c{names.index(text)}")
    return scored.where("score < 0.5").drop("score").toDF(*names)
