"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic documents, the rest of the corpus is unlabelled. Linear classifiers over hashed
words and word beginnings are trained with numpy on the non-negative, class-prior-corrected risk
``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))`` with the sigmoid loss. Fitting takes a bounded sample (``max_positive``,
``max_unlabelled``); every whole document is scored where it lies, without a shuffle.

Defined results: a null or empty text has no features and gets the score of the biases; without any positive
label every score is 0; repeated rows get equal scores; of the texts of one id one is sampled; columns named like the
results, in any case, are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, filled, fold, signed, text_slices, tune, with_columns

MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 4000, 8000, 2048
LEAST_Z, LEAST_DF = 4.0, 3
PREFIX_BYTES = 5
_NOT_LETTERS = np.ones(256, dtype=bool)
_NOT_LETTERS[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = False
FIELDS = [T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)]


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray  # classifiers x features
    biases: np.ndarray
    prior: float


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the lower-cased words and of their first bytes."""
    words = Words(data, offs, lower=True, sep=_NOT_LETTERS)
    long = words.ends - words.starts > PREFIX_BYTES
    at = words.starts[long]
    h = np.concatenate([words.hash(), words.hash(at, at + PREFIX_BYTES) ^ np.uint64(0xA5A5A5A5A5A5A5A5)])
    return h, np.concatenate([words.doc, words.doc[long]])


def _sampled(docs: DataFrame, labels: DataFrame, max_p: int, max_u: int) -> DataFrame:
    """(text, positive): a bounded sample of at most max_p + max_u rows, one text of an id. Ids come first, so that no text is
    shuffled to find them; rows of one id are reduced before a shuffle."""
    order = F.xxhash64(F.col("doc_id"))
    known = labels.where(~fold(5, 0)).where(F.col("doc_id").isNotNull())
    p_ids = known.where("toxic = 1").select("doc_id").distinct().orderBy(order, "doc_id").limit(max_p)
    u_ids = docs.where(~fold(5, 0)).where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(order, "doc_id").limit(max_u)
    ids = p_ids.withColumn("positive", F.lit(1)).unionByName(u_ids.withColumn("positive", F.lit(0)))
    # at most max_p + max_u ids
    of_ids = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return of_ids.groupBy("doc_id", "positive").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "positive")


def fit(
    docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, classifiers: int = 3
) -> Model:
    """Learns from rows outside the held-out fold (crc32(doc_id as text) mod 5 = 0) only."""
    tune(docs.sparkSession)
    share = labels.where(~fold(5, 0)).agg(F.avg(F.when(F.col("toxic") == 1, 1.0).when(F.col("toxic").isNotNull(), 0.0)).alias("p")).first()
    empty = Model(np.zeros(0, np.uint64), np.zeros((1, 0)), np.full(1, -40.0), 0.0)
    if not share["p"]:
        return empty
    prior = float(min(max(share["p"], 1e-3), 0.9))
    sample = _sampled(docs, labels, max_positive, max_unlabelled)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], np.zeros(2, np.int64)
        for batch in batches:
            positive = np.asarray(batch.column(1))
            n += np.bincount(positive, minlength=2)[:2]
            for lo, _, data, offs in text_slices(filled(batch.column(0))):
                h, doc = features(data, offs)
                pair = _distinct(h, doc)
                parts.append((pair[0], positive[lo + pair[1]]))
        h = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.uint64)
        p = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, np.int64)
        keys, inverse = np.unique(h, return_inverse=True)
        dp = np.bincount(inverse, weights=p, minlength=len(keys)).astype(np.int64)
        du = np.bincount(inverse, minlength=len(keys)).astype(np.int64) - dp
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([signed(keys), [0]])), pa.array(np.concatenate([dp, n[1:]])), pa.array(np.concatenate([du, n[:1]])), pa.array(np.arange(len(keys) + 1) == len(keys))],
            names=["h", "dp", "du", "total"],
        )

    counted = sample.mapInArrow(count, "h long, dp long, du long, total boolean").groupBy("total", "h").agg(F.sum("dp").alias("dp"), F.sum("du").alias("du"))
    counted = counted.where(F.col("total") | (F.col("dp") >= LEAST_DF)).persist()
    totals = counted.where("total").first()
    n_p, n_u = (totals["dp"], totals["du"]) if totals else (0, 0)
    if not n_p or not n_u:
        counted.unpersist()
        return empty
    rate = (F.col("du") + 0.5) / F.lit(n_u + 1.0)
    z = (F.col("dp") / F.lit(float(n_p)) - rate) / F.sqrt(rate / F.lit(float(n_p)))
    chosen = counted.where(~F.col("total")).select("h", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "h").limit(MAX_FEATURES).collect()
    counted.unpersist()
    if not chosen:
        return empty
    keys = np.sort(np.array([r["h"] for r in chosen], dtype=np.int64).view(np.uint64))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[] for _ in range(batch.num_rows)]
            for lo, _, data, offs in text_slices(filled(batch.column(0))):
                for d, f in zip(*_hits(keys, data, offs)):
                    found[lo + d].append(f)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["positive", "found"])

    rows = sample.mapInArrow(sparse, "positive int, found array<int>").collect()  # bounded by the sample
    rows.sort(key=lambda r: (r["positive"], r["found"]))
    y = np.array([r["positive"] for r in rows])
    x = np.zeros((len(rows), len(keys)), dtype=np.uint8)
    for i, r in enumerate(rows):
        x[i, r["found"]] = 1
    fitted = [nnpu(x[y == 1], x[y == 0], prior, seed) for seed in range(classifiers)]
    fitted = [(w, b - decision(x[y == 1] @ w + b, x[y == 0] @ w + b, prior)) for w, b in fitted]
    return Model(keys, np.stack([w for w, _ in fitted]), np.array([b for _, b in fitted]), prior)


def nnpu(p: np.ndarray, u: np.ndarray, prior: float, seed: int, epochs: int = 60, batch: int = 512, rate: float = 0.05, decay: float = 1e-4):
    """One linear classifier on a bootstrap of the sample, by Adam on the non-negative risk."""
    rng = np.random.default_rng(seed)
    p, u = p[rng.integers(0, len(p), len(p))], u[rng.integers(0, len(u), len(u))]
    w, b = np.zeros(p.shape[1]), -1.0
    m, v, t = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    steps = max(1, min(20, len(u) // batch))
    for _ in range(epochs):
        for _ in range(steps):
            xp = p[rng.integers(0, len(p), min(batch, len(p)))].astype(np.float64)
            xu = u[rng.integers(0, len(u), min(batch, len(u)))].astype(np.float64)
            sp, su = _sigmoid(xp @ w + b), _sigmoid(xu @ w + b)
            # sigmoid loss: as positive 1 - s, as negative s; the slope of s is s * (1 - s)
            dp, du = sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
            negative = su.mean() - prior * sp.mean()
            g_neg = np.concatenate([du @ xu - prior * (dp @ xp), [du.sum() - prior * dp.sum()]])
            g_pos = -prior * np.concatenate([dp @ xp, [dp.sum()]])
            g = g_pos + g_neg if negative >= 0 else -g_neg
            g[:-1] += decay * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
    return w, b


def decision(p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """Where a classifier's logit is cut, 0 or less: low enough for 98 % of the positives, but at most three tenths of the way from 0 down to
    the upper edge of the unlabelled bulk, which the class prior places."""
    bulk = float(np.quantile(u, max(0.0, 1 - 1.5 * prior)))
    return min(0.0, max(float(np.quantile(p, 0.02)), 0.3 * bulk))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


_BITS = 20


def _gate(keys: np.ndarray) -> np.ndarray:
    gate = np.zeros(1 << _BITS, dtype=bool)
    gate[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return gate


def _hits(keys: np.ndarray, data: np.ndarray, offs: np.ndarray, gate: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature index) pairs."""
    h, doc = features(data, offs)
    maybe = (_gate(keys) if gate is None else gate)[(h >> np.uint64(64 - _BITS)).astype(np.int64)]
    h, doc = h[maybe], doc[maybe]
    at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
    same = keys[at] == h if len(keys) else np.zeros(len(h), bool)
    pair = np.unique(doc[same].astype(np.int64) * len(keys) + at[same]) if same.any() else np.zeros(0, np.int64)
    return (pair // max(1, len(keys)), pair % max(1, len(keys)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with score (0 to 1) and predicted (1 from 0.5 on)."""
    keys, weights, biases = model.keys, model.weights, model.biases  # at most MAX_FEATURES columns

    def make(col: pa.Array) -> list[pa.Array]:
        z, gate = np.repeat(biases[:, None], len(col), axis=1), _gate(keys)
        for lo, hi, data, offs in text_slices(col):
            doc, f = _hits(keys, data, offs, gate)
            for i in range(len(biases)):
                z[i, lo:hi] += np.bincount(doc, weights=weights[i, f], minlength=hi - lo)
        s = _sigmoid(z).mean(axis=0)
        return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

    return with_columns(docs, FIELDS, make)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
