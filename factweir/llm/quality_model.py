"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and web text without labels train a linear model that minimises the non-negative
unbiased risk: prior * risk of positives + max(0, risk of unlabelled as negatives - prior * risk of positives
as negatives). The class prior is the share of label 1 among the labelled training rows, where both labels
occur; with trusted positives alone it is estimated from them and the unlabelled text. Features describe
the form of the whole text: hashed word shapes, and shares of symbols, capitals, repeated words and lines.

Defined results: a text without a word (null, empty, blank) scores 0; repeated rows and null ids get a row
each; of several labels of a document the smallest counts; without any positive everything scores 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweir.llm import bytehash
from factweir.llm.common import pick, prepare

SHAPES = 256
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>^~=_+{}[]\\@"]] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = ord("0"), ord("A"), ord("a"), ord("a")
N_FEATURES = SHAPES + 12
#: Against the hashed shapes, the few shares of the whole text weigh more.
DENSE_SCALE = 6.0


def features(text: str | None) -> np.ndarray | None:
    """The feature vector of a whole text; None without a word."""
    data = (text or "").encode("utf-8", "replace")
    shapes, words, starts, runs = np.zeros(SHAPES), [], [], np.zeros(256, dtype=np.int64)
    for at, b in bytehash.blocks(data):
        start, end, h = bytehash._block_words(b, True)
        words.append(h)
        starts.append(start + at)
        runs += np.bincount(b, minlength=256)
        s = _SHAPE[b]
        s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        shapes += np.bincount((bytehash._block_words(s, False)[2] >> np.uint64(40)).astype(np.int64) % SHAPES, minlength=SHAPES)
    h = np.concatenate(words) if words else np.zeros(0, dtype=np.uint64)
    if not len(h):
        return None
    n, size = len(h), len(data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    grams = bytehash.mix(bytehash.mix(h[:-2]) + h[1:-1]) + h[2:]
    letters = max(1, int(runs[65:91].sum() + runs[97:123].sum() + runs[128:].sum()))
    dense = [
        np.log1p(n) / 10,
        size / n / 20,
        runs[_SYMBOLS].sum() / size * 5,
        runs[ord("!")] / n,
        runs[ord("|")] / n,
        runs[65:91].sum() / letters,
        runs[48:58].sum() / size,
        1 - len(set(lines)) / len(lines),
        float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0,
        1 - len(np.unique(grams)) / len(grams) if len(grams) else 0.0,
        np.log1p(n / len(lines)) / 5,
        (runs[ord(".")] + runs[ord("?")]) / n,
    ]
    return np.concatenate([np.sqrt(shapes / n), DENSE_SCALE * np.array(dense)]).astype(np.float32)


def _bytes(texts: list[str | None]) -> pa.Array:
    return pa.array([None if (f := features(t)) is None else f.tobytes() for t in texts], pa.binary())


def _sample(docs: DataFrame, rows: int) -> np.ndarray:
    """Feature rows of about `rows` random rows of docs(text), never more than twice as many; of all if fewer.

    Every row has a chance of its own, so copies of a text or of an id are no case apart.
    """
    n = docs.select(F.count(F.lit(1))).first()[0]
    some = docs.where(F.rand(17) < rows / n).limit(2 * rows) if n > rows else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([_bytes(b.column("text").to_pylist())], names=["f"])

    got = sorted(bytes(x) for x in some.select("text").mapInArrow(run, "f binary").where("f IS NOT NULL").toPandas()["f"])  # 1 kB a row
    return np.stack([np.frombuffer(x, dtype=np.float32) for x in got]) if got else np.zeros((0, N_FEATURES), dtype=np.float32)


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights (bias last) that minimise the non-negative risk with the logistic loss, by Adam.

    Where the negative part of the risk falls below zero, the step undoes it instead, which keeps the
    unbiased estimate from overfitting.
    """
    w = np.zeros(positive.shape[1] + 1)
    if not len(positive) or not len(unlabelled):
        return w
    p, u = (np.hstack([x.astype(np.float64), np.ones((len(x), 1))]) for x in (positive, unlabelled))
    m = v = np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_neg = sigmoid(zu) @ u / len(u) - prior * (sigmoid(zp) @ p) / len(p)
        g = -prior * (sigmoid(-zp) @ p) / len(p) + g_neg if negative >= 0 else -g_neg
        g = g + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.2) -> float:
    """Share of positives in the unlabelled rows, from above.

    A model tells positives from unlabelled rows. At each of its thresholds the share of unlabelled rows that
    pass is at least the prior times the share of positives that pass; the prior is the smallest ratio among
    thresholds that the share `least` of the positives pass, which leaves enough of them to count.
    """
    if not len(positive) or not len(unlabelled):
        return 1.0
    w = fit_pu(positive, unlabelled, 0.5)
    p, u = (np.sort(x @ w[:-1] + w[-1]) for x in (positive, unlabelled))
    cuts = np.quantile(p, np.linspace(0, 1 - least, 50))
    ratio = (1 - np.searchsorted(u, cuts) / len(u)) / np.maximum(1 - np.searchsorted(p, cuts) / len(p), 1e-9)
    return float(np.clip(ratio.min(), 0.01, 1.0))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000) -> np.ndarray:
    """Weights from docs(doc_id, text) and labels(doc_id, quality).

    The fit holds at most 6 * sample_rows rows of features (1 kB each) on the driver: positives, and unlabelled
    text, which is a sample of all documents, whether labelled or not, without their labels: the mixture that the
    class prior speaks of.
    """
    prepare(docs.sparkSession)
    docs = pick(docs, "doc_id", "text")
    marks = pick(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    by = {r["quality"]: r["n"] for r in marks.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy(F.least("quality", F.lit(1)).alias("quality")).agg(F.count(F.lit(1)).alias("n")).collect()}
    good, all_ = by.get(1, 0), sum(by.values())
    # label ids of the sample alone meet the texts: about 2 * sample_rows of them
    share = min(1.0, 2 * sample_rows / max(good, 1))
    ids = marks.where(f"quality >= 1 AND pmod(xxhash64(doc_id), 1000000) < {int(share * 1_000_000)}").select("doc_id")
    positive = _sample(docs.join(ids, "doc_id", "left_semi"), 2 * sample_rows)
    unlabelled = _sample(docs, sample_rows)
    return fit_pu(positive, unlabelled, good / all_ if 0 < good < all_ else estimate_prior(positive, unlabelled))


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, score, predicted."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t) for t in b.column("text").to_pylist()]
            s = [0.0 if f is None else float(1 / (1 + np.exp(-np.clip(f @ weights[:-1] + weights[-1], -30, 30)))) for f in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
