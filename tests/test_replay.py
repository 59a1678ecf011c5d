"""The replay of runs against a plain fold, with one company that has half of all runs."""

import random
from datetime import datetime, timedelta

import pytest
from factweir.operators import runs
from pyspark.sql import functions as F

SCHEMA = "run_id long, company_id long, status string, finished_at timestamp, ranked boolean, is_ranked boolean, coverage double, published boolean, version string, degraded boolean, basis string, retracted boolean"


def made_up(seed, published, ranked, n=1500):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        company = 0 if rnd.random() < 0.5 else rnd.randrange(1, 60)
        rk = rnd.random() < ranked
        when = None if rnd.random() < 0.01 else datetime(2024, 1, 1) + timedelta(hours=rnd.randrange(600))
        rows.append((
            i, company, "succeeded" if rnd.random() < 0.9 else "failed", when, rk, rk and rnd.random() < 0.7, rnd.choice([None, 0.1, 0.4, 0.4, 0.8]), rnd.choice([None, False]) if rnd.random() > published else True,
            rnd.choice([None, "pipeline-v2.9", "pipeline-v2.10", "v1", "odd"]), rnd.choice([None, False, False, True]), rnd.choice([None, "standard", "energy_unreadable"]), rnd.choice([None, False]) if rnd.random() > 0.02 else True,
        ))
    return rows


def numbers(version):
    digits = (version or "").partition("v")[2]
    return [int(x) for x in digits.split(".")] if digits else []


def brute(rows, legacy):
    """{company: (current, public)}, by the rules in words: one run after another."""
    out = {}
    for company in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == company and r[2] == "succeeded"), key=lambda r: (r[3] is not None, r[3] or datetime.min, r[0]))
        cur, seen, last, public = None, False, None, []
        for i, _, _, _, ranked, now, coverage, published, version, degraded, basis, retracted in mine:
            if retracted:
                seen = True
                continue
            last = i
            show = bool(published)
            if seen:
                show = bool(ranked) or ((not cur[0] and not (cur[1] or 0) > (coverage or 0)) if cur else not legacy[company])
            if cur and not degraded and basis != "energy_unreadable" and numbers(version) > cur[2]:
                show = True
            if show:
                cur = (bool(now), coverage, numbers(version), i)
                public.append(i)
        if not cur and seen and last is not None:
            out[company] = (last, [last])
        elif cur:
            out[company] = (cur[3], public)
    return out


@pytest.mark.parametrize(("seed", "published", "ranked"), [(1, 0.3, 0.3), (2, 0.0, 0.02), (3, 0.02, 0.0)])
def test_replay_matches_a_plain_fold(spark, seed, published, ranked):
    rows = made_up(seed, published, ranked)
    legacy = {c: c % 2 == 0 for c in range(60)}
    got = runs.replay(spark.createDataFrame(rows, SCHEMA).orderBy(F.rand(1)), spark.createDataFrame(list(legacy.items()), "company_id long, has_legacy boolean")).collect()
    found = {}
    for r in got:
        found.setdefault(r.company_id, (r.current_run, []))[1].append(r.run_id)
    when = {r[0]: (r[3] is not None, r[3] or datetime.min, r[0]) for r in rows}
    assert {c: (cur, sorted(p, key=when.get)) for c, (cur, p) in found.items()} == brute(rows, legacy)


def test_replay_of_nothing(spark):
    got = runs.replay(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "company_id long, has_legacy boolean"))
    assert got.collect() == [] and runs.current(got).collect() == []


def test_decision(spark):
    d = lambda *xs: spark.range(1).select(runs.decide(*[F.lit(x) for x in xs]).alias("v")).first().v
    assert d(True, 0.1, True, True, 0.9, True) and not d(False, 0.1, True, True, 0.0, False)
    assert d(False, 0.5, True, False, 0.5, False) and not d(False, 0.4, True, False, 0.5, False)
    assert d(False, 0.4, False, False, 0.0, False) and not d(False, 0.4, False, False, 0.0, True)
