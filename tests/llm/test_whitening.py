import math

import numpy as np
import pytest
from factweir.llm import entries, whitening

SCHEMA = "vec_id long, embedding array<float>, N int, deviation string, Vec_Id int"


def brute(rows, k=16):
    """{vec_id: (deviation, whitened up to sign)}, n and shares, by the whole covariance of the distinct vectors."""
    ok = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in ok})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit], dtype=np.float64) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    c = int((values[:k] > 1e-12 * values[0]).sum())
    out = []
    for i, x in ok:
        off = [n * a - s for a, s in zip(x, sums, strict=True)]
        out.append((i, sum(o * o for o in off), np.array(off, dtype=np.float64) / n @ vectors[:, :c] / np.sqrt(values[:c])))
    return n, values[:c] / values.sum(), out


def compare(got, rows, k=16):
    n, shares, want = brute(rows, k)
    assert len(got) == len(want)
    key = lambda i, d: (i is None, i or 0, d)
    got, want = sorted(got, key=lambda r: key(r.vec_id, r.deviation)), sorted(want, key=lambda r: key(r[0], r[1]))
    white, plain = np.array([r.whitened for r in got]), np.array([r[2] for r in want])
    assert [(r.vec_id, r.deviation, r.n) for r in got] == [(i, d, n) for i, d, _ in want]
    assert white.shape == plain.shape
    signs = np.sign((white * plain).sum(axis=0))
    np.testing.assert_allclose(white, plain * signs, atol=1e-7)
    for r in got[:3]:
        np.testing.assert_allclose(r.explained, shares, rtol=1e-9)
        assert r.identity_error < 1e-9


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("steep", [True, False])
def test_against_the_whole_covariance(spark, steep):
    rng = np.random.default_rng(3)
    scales = 0.7 ** np.arange(48) * 40 if steep else np.ones(48)
    x = rng.standard_normal((700, 48)) * scales @ np.linalg.qr(rng.standard_normal((48, 48)))[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [rows[5], rows[5], (None, rows[6][1]), (7000, None), (7001, [None] + [0.0] * 47), (7002, [float("nan")] * 48), (7003, [float("inf")] * 48)]
    compare(whitening.whiten(frame(spark, rows)).collect(), rows)


def test_passes_end_early_where_the_span_holds_all(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 5)) @ rng.standard_normal((5, 40)) * 30
    fit = whitening.coded(frame(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)]), "vec_id", "embedding", 64, 1_000_000).select("x").distinct()
    low = np.zeros((300, 40), dtype=np.int64)
    low[:, :5] = np.array([r.x for r in fit.collect()])[:, :5]
    got = whitening.fit_whitening(spark.createDataFrame([(v.tolist(),) for v in low], "x array<long>"), 40)
    assert got.passes < whitening.PASSES and len(got.eigenvalues) == 5 and got.identity_error < 1e-9
    full = whitening.fit_whitening(fit, 40)
    assert full.passes == whitening.PASSES + 1 and len(full.eigenvalues) == 16


def test_few_dimensions_single_vectors_and_none(spark):
    rows = [(i, [float(i % 7), float(i % 3), 2.0]) for i in range(50)]
    got = whitening.whiten(frame(spark, rows)).collect()
    compare(got, rows)
    assert {len(r.whitened) for r in got} == {2}  # the constant entry has no component
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in one] == [(1, 0, [], 0.0)] * 2
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0


def test_dimensions_apart_and_values_beyond_64_bits(spark):
    rows = [(i, [float(i), float(-i * i)]) for i in range(9)]
    more = [(100 + i, [float(i), float(i * i % 5), 1.0 / (i + 1)]) for i in range(9)]
    got = whitening.whiten(frame(spark, rows + more)).collect()
    compare([r for r in got if r.vec_id < 100], rows)
    compare([r for r in got if r.vec_id >= 100], more)
    huge = whitening.whiten(frame(spark, [(1, [1e30]), (2, [-1e30]), (3, [0.0])])).collect()
    assert {r.deviation for r in huge} == {2**63 - 1} or all(r.deviation >= 0 for r in huge)
    assert huge[0].identity_error < 1e-9


def test_query(spark, data):
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    got = entries.op12_whitening(spark, data).toPandas()
    n, shares, want = brute(rows)
    assert len(got) == 16 * len(want) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    table = got.pivot(index="vec_id", columns="component", values="whitened")
    plain = np.array([w for _, _, w in sorted(want, key=lambda r: r[0])])
    signs = np.sign((table.to_numpy() * plain).sum(axis=0))
    np.testing.assert_allclose(table.to_numpy(), plain * signs, atol=1e-6)
    np.testing.assert_allclose(got.groupby("component")["explained"].first().to_numpy(), shares, rtol=1e-9)
    assert got.groupby("vec_id")["deviation"].first().to_dict() == {i: d for i, d, _ in want}
