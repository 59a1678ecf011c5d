"""Language identification by multilingual mixture inference.

Each language has a distribution of byte trigrams over letters, learned from labelled texts. A document is
cut into units of consecutive trigrams; each unit is written in one language, and the document mixes
languages in unknown proportions. Expectation-maximisation estimates the proportions; the set of languages
grows from the best one while the likelihood gains more than a penalty for each added proportion. The
prediction is the language with the largest proportion, which is also the score.

Whole texts are read, in blocks. Defined results: null texts and texts without a letter are `und` with
score 0, as is everything if no labelled text exists; rows are independent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweir.llm.common import pick, prepare

BUCKETS = 1 << 16
#: Trigrams of a unit, about six words.
UNIT = 32
_BLOCK = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters lower-cased, other ASCII one blank; bytes of other characters stay.
_TABLE = np.full(256, 32, dtype=np.uint8)
_TABLE[97:123] = np.arange(97, 123)
_TABLE[65:91] = np.arange(97, 123)
_TABLE[128:] = np.arange(128, 256)


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod, F.lit(-1))


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the trigrams of a text in blocks; runs of blanks count as one."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    for at in range(0, len(raw), _BLOCK):
        b = _TABLE[raw[at : at + _BLOCK + 2]]
        blank = b == 32
        b = b[~(blank & np.concatenate(([True], blank[:-1])))].astype(np.uint32)
        if len(b) > 2:
            x = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
            yield ((x * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def learn(docs: DataFrame, sample_rows: int = 20_000, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (buckets by languages) from docs(text, lang) with non-null lang.

    Fits on a random sample of about `sample_rows` labelled rows, whole texts each; all of them if fewer. Every row
    has a chance of its own, whatever copies it has; trigrams are counted in the tasks.
    """
    prepare(docs.sparkSession)
    labelled = pick(docs, "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    n = labelled.select(F.count(F.lit(1))).first()[0]
    part = min(1.0, sample_rows / max(n, 1))
    labelled = labelled.where(F.rand(23) < part) if part < 1 else labelled

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                for grams in trigrams(text):
                    sums[lang] = sums.get(lang, 0) + np.bincount(grams, minlength=BUCKETS)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(c[at])], names=["lang", "bucket", "n"])

    rows = labelled.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((BUCKETS, len(langs)))
    for i, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        counts[own["bucket"].to_numpy(dtype=np.int64), i] = own["n"]
    counts += smoothing
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def _units(text: str, logp: np.ndarray) -> np.ndarray:
    """Log-likelihoods of the units of a text (units by languages); a third each, as trigrams overlap."""
    out = [np.add.reduceat(logp[g], np.arange(0, len(g), UNIT), axis=0) for g in trigrams(text)]
    return np.concatenate(out) / 3 if out else np.zeros((0, logp.shape[1]), dtype=np.float32)


def _mixture(units: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Proportions of the columns by expectation-maximisation, and the log-likelihood reached."""
    top = units.max(axis=1, keepdims=True)
    like = np.exp((units - top).astype(np.float64))
    share = np.full(units.shape[1], 1 / units.shape[1])
    for _ in range(rounds):
        each = like * share
        new = (each / each.sum(axis=1, keepdims=True)).mean(axis=0)
        if np.abs(new - share).max() < 1e-4:
            share = new
            break
        share = new
    return share, float(np.log((like * share).sum(axis=1)).sum() + top.sum())


def infer(text: str | None, langs: list[str], logp: np.ndarray, penalty: float = 3.0) -> tuple[str, float, dict[str, float]]:
    """Prediction, score and proportions of one text."""
    if not text or not langs or not _LETTER.search(text):
        return "und", 0.0, {}
    units = _units(text, logp)
    if not len(units):  # letters, but fewer than three bytes
        units = np.zeros((1, len(langs)), dtype=np.float32)
    total = units.sum(axis=0, dtype=np.float64)
    chosen = [int(total.argmax())]
    share, best = np.ones(1), float(total[chosen[0]])
    limit, cost = float(units.max(axis=1).sum(dtype=np.float64)), penalty + 0.5 * np.log(len(units))
    while limit - best > cost and len(chosen) < len(langs):
        tried = [(*_mixture(units[:, [*chosen, i]]), i) for i in range(len(langs)) if i not in chosen]
        new, gained, i = max(tried, key=lambda x: x[1])
        if gained - best <= cost:
            break
        chosen, share, best = [*chosen, i], new, gained
    main = int(share.argmax())
    return langs[chosen[main]], float(share[main]), {langs[c]: float(s) for c, s in zip(chosen, share, strict=True)}


def identify(docs: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, lang_pred, score, proportions."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [infer(t, langs, logp) for t in b.column("text").to_pylist()]
            mixed = pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), mixed], names=["doc_id", "lang_pred", "score", "proportions"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, proportions map<string,double>")
