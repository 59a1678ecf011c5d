import math

import numpy as np
from factweir.llm import topk
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int"


def brute(rows, asked, k):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if asked(i):
            s = sorted(((sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in ok if j != i and len(w) == len(v)), key=lambda x: (-x[0], x[1]))
            out += [(i, n + 1, j, x) for n, (x, j) in enumerate(s[:k])]
    return sorted(out)


def run(spark, rows, k=10):
    df = spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], SCHEMA)
    got = topk.search(df.where(F.col("vec_id") % 100 == 0), df, k)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect())


def test_matches_brute_force_with_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE_BYTES", 8 * 6 * 37)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 8]) for i in range(650)]
    rows += [(1000, None), (1001, [None] * 6), (1002, [float("nan")] * 6), (1100, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (1200, [0.5] * 3), (1201, [0.25] * 3)]
    assert run(spark, rows) == brute(rows, lambda i: i % 100 == 0, 10)


def test_few_candidates_and_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (5, [3.0, -1.0])]
    assert run(spark, rows) == brute(rows, lambda i: i % 100 == 0, 10)
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []


def test_repeated_candidates_count_once(spark):
    rows = [(0, [1.0]), (1, [1.0]), (1, [1.0]), (2, [0.5])]
    assert run(spark, rows) == [(0, 1, 1, 1024 * 1024), (0, 2, 2, 512 * 1024)]


def test_large_values_stay_exact(spark):
    rows = [(0, [2.0**20, 1.0]), (1, [2.0**20, 3.0]), (2, [2.0**20, 2.0])]
    assert run(spark, rows) == brute(rows, lambda i: i % 100 == 0, 10)


def test_what_64_bits_do_not_hold_becomes_the_nearest(spark):
    top = 2**63 - 1
    assert run(spark, [(0, [2.0**40]), (1, [2.0**40]), (2, [-(2.0**40)])]) == [(0, 1, 1, top), (0, 2, 2, -top - 1)]
    rows = [(i, [x]) for i, x in ((0, 1e300), (1, -1e300), (2, 1.0))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df.where("vec_id = 0"), df).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(2, top), (1, -top - 1)]
