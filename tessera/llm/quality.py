"""Quality classifier by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, unused

#: Trusted positives and unlabelled texts that the fit sees at most, those of smallest id hash.
SAMPLE = 12_000
#: Lengths of the descent to choose from.
STEPS = (1500, 3000, 6000)
THRESHOLD = 0.3

#: Byte classes: other, lower, upper, digit, blank, line end, sentence mark, bracket or quote, symbol, beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
for _i, _set in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".,;:", b"()[]{}'\"", b"!?#$%&*+-/<=>@\\^_`|~"], 1):
    _CLASS[list(_set)] = _i
_CLASS[128:] = 9
_CLASSES = 10
WIDTH = _CLASSES * _CLASSES + _CLASSES + 9


def features(text: str) -> np.ndarray:
    """Shape of a whole text: frequencies of byte classes and their bigrams, repetition of words and lines, lengths."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = _CLASS[data]
    n = max(1, len(kinds))
    single = np.bincount(kinds, minlength=_CLASSES) / n
    pairs = np.bincount(kinds[:-1].astype(np.int64) * _CLASSES + kinds[1:], minlength=_CLASSES * _CLASSES) / n if len(kinds) > 1 else np.zeros(_CLASSES * _CLASSES)
    words = text.split()
    m = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    rest = [
        math.log1p(len(words)),
        len(seen) / m**0.8,
        max(seen.values(), default=0) / m,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
        sum(c for c in seen.values() if c > 1) / m,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(map(len, words)) / m / 10,
        sum(w.isupper() for w in seen) / max(1, len(seen)),
        sum(not w[-1].isalnum() for w in seen) / max(1, len(seen)),
    ]
    return np.sqrt(np.concatenate([pairs, single, np.maximum(rest, 0)])).astype(np.float32)


@dataclass
class Model:
    """Linear model of standardised features. ``prior`` is the estimated share of positives among unlabelled texts."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(p: np.ndarray, u: np.ndarray, prior: float | None, seed: int, steps: int = 6000, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Minimise the non-negative unbiased risk (logistic loss) by Adam on batches; prior None: tell p from u instead."""
    rng = np.random.default_rng(seed)
    w, m, v = (np.zeros(p.shape[1] + 1) for _ in range(3))
    add = lambda x: np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    p, u = add(p), add(u)
    for t in range(1, steps + 1):
        a, b = p[rng.integers(len(p), size=256)], u[rng.integers(len(u), size=512)]
        sa, sb = _sigmoid(a @ w), _sigmoid(b @ w)
        if prior is None:
            grad = -((1 - sa) @ a) / len(a) + sb @ b / len(b)
        else:
            positive = -prior * ((1 - sa) @ a) / len(a)  # of prior * E_p[loss(f)]
            negative = sb @ b / len(b) - prior * (sa @ a) / len(a)  # of E_u[loss(-f)] - prior * E_p[loss(-f)]
            risk = np.logaddexp(0, b @ w).mean() - prior * np.logaddexp(0, a @ w).mean()
            grad = positive + negative if risk >= 0 else -negative  # below zero the estimate overfits: step back
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among the unlabelled, from held-out scores of a classifier of p against u.

    The unlabelled hold at least prior times the positives' share above any threshold, so the smallest ratio of the
    shares, each with its sampling error, bounds the prior from above; it is tight where no negatives score.
    """
    best, delta = 1.0, 0.1
    slack = lambda n: math.sqrt(math.log(4 / delta) / 2 / max(n, 1))
    key = None
    for c in np.quantile(p, np.linspace(0.0, 0.9, 91)):
        qp, qu = (p >= c).mean(), (u >= c).mean()
        if qp > 0:
            bound = (qu + slack(len(u)) + slack(len(p))) / qp
            if key is None or bound < key:
                key, best = bound, qu / qp
    return float(min(0.98, max(0.02, best)))


def _risk(p: np.ndarray, u: np.ndarray, w: np.ndarray, b: float, prior: float) -> float:
    """The non-negative risk with the loss of the sign, which tells models apart that all separate well."""
    wrong = lambda z: 1 / (1 + np.exp(np.clip(z, -30, 30)))
    zp, zu = p @ w + b, u @ w + b
    return float(prior * wrong(zp).mean() + max(0.0, wrong(-zu).mean() - prior * wrong(-zp).mean()))


def fit(positives: np.ndarray, unlabelled: np.ndarray, seed: int = 7) -> Model:
    """Fit on feature rows. Without positives or without unlabelled texts every score is 0.5.

    The prior is estimated, and the number of steps chosen among STEPS, on a half of the rows that the model compared there
    has not seen; then the model is fitted on all rows.
    """
    if not len(positives) or not len(unlabelled):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, 0.5)
    both = np.concatenate([positives, unlabelled]).astype(np.float64)
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x.astype(np.float64) - mean) / scale, -8, 8) for x in (positives, unlabelled))
    rng = np.random.default_rng(seed)
    p, u = p[rng.permutation(len(p))], u[rng.permutation(len(u))]
    hp, hu = max(1, len(p) // 2), max(1, len(u) // 2)
    prior, steps = 0.5, STEPS[0]
    if len(p) > hp and len(u) > hu:
        w, b = _descend(p[:hp], u[:hu], None, seed)
        prior = class_prior(p[hp:] @ w + b, u[hu:] @ w + b)
        steps = min(STEPS, key=lambda n: _risk(p[hp:], u[hu:], *_descend(p[:hp], u[:hu], prior, seed, n), prior))
    w, b = _descend(p, u, prior, seed, steps)
    return Model(mean, scale, w, b, prior)


def _matrix(rows: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                yield pa.RecordBatch.from_arrays([pa.array([features(t or "").tobytes() for t in b.slice(at, 500).column(0).to_pylist()], pa.binary())], names=["x"])

    found = [r["x"] for r in map_arrow(rows.select("text"), run, "x binary").collect()]
    return np.frombuffer(b"".join(sorted(found)), np.float32).reshape(-1, WIDTH) if found else np.zeros((0, WIDTH), np.float32)


def train(docs: DataFrame, positives: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` trusted positives (ids) and as many unlabelled documents.

    Unlabelled are the documents of all other ids, whatever labels those have, for labels other than the trusted
    positives are not used; where there are none, the positives themselves. Both are taken by the smallest hash of their id, so the same
    tables give the same model. Only the sample's features reach the driver, ``sample`` * 2 * WIDTH floats.
    """
    ids = docs.select(F.col("doc_id")).filter("doc_id is not null")
    first = lambda rows: rows.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    p, u = first(positives.join(ids, "doc_id", "left_semi")), first(ids.join(positives, "doc_id", "left_anti"))
    pick = lambda chosen: _matrix(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    x, y = pick(p), pick(u)
    return fit(x, y if len(y) else x)


def score(docs: DataFrame, model: Model, keep_from: float | None = None) -> DataFrame:
    """All columns of ``docs`` with ``quality_score``, that of their whole text; with ``keep_from``, only rows that reach it, without the score.

    Null texts are empty ones, which have a score too. Repeated rows get equal scores. An empty table gives no rows. If docs has a
    column ``quality_score``, the score's name gets underscores in front. One pass over the rows, no shuffle.
    """
    names = docs.columns
    name = unused(names, "quality_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = model.scores(np.array([features(t.as_py() or "") for t in b.column(names.index("text"))]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*names, name]) if keep_from is None else b.filter(pa.array(s >= keep_from))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return map_arrow(docs, run, ", ".join([*fields, *([f"`{name}` double"] if keep_from is None else [])]))


def fold(modulus: int):
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % modulus


def trusted(labels: DataFrame, name: str, where) -> DataFrame:
    """Ids that only ever carry label 1 among the rows ``where`` holds. Null labels and ids count as no label."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(name).isNotNull())
    return rows.filter(where).groupBy("doc_id").agg(F.min(name).alias("least")).filter("least = 1").select("doc_id")


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; nulls, empty texts, repeats and empty tables as in ``score``.

    Neither labels nor texts of the held-out fold are used in the fit.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    good = trusted(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", fold(5) != 0)
    scored = score(docs, train(docs.filter(fold(5) != 0), good)).withColumnRenamed("quality_score", "score")
    held_out = F.coalesce(fold(5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
