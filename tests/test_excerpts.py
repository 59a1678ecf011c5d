"""Choices of chunks, shares of a budget and passages for claims, against plain versions."""

import math
import random

import pytest
from factweir.operators import evidence, excerpts
from factweir.plans import figure_queries, registry
from pyspark.sql import functions as F

CHUNKS = "source_id long, i int, start int, end int, quant double, qual double"


def plain_choice(chunks, budget, past=()):
    """chunks: (start, end, quant, qual) in order. The taken numbers, by walking through all offers."""
    past, got, used = set(past), [], 0
    size = [b - a for a, b, _, _ in chunks]

    def offers():
        if budget >= 4400 and not past and chunks:
            yield 0, budget, False
        for score, most, brings in ((lambda c: c[2], math.floor(0.6 * budget), 10), (lambda c: c[3], budget, math.inf), (lambda c: c[2] + c[3], budget, math.inf)):
            worth = [(-score(c), i) for i, c in enumerate(chunks) if i not in past and score(c) > 0]
            for s, i in sorted(worth):
                yield i, most, False
                if -s >= brings and i + 1 < len(chunks):
                    yield i + 1, most, True

    fresh = False
    for i, most, follows in offers():
        fits = i not in got and used + size[i] <= most and (fresh or not follows)
        if fits:
            got.append(i)
            used += size[i]
        fresh = fits and not follows
    if used < budget // 2:
        for i in range(len(chunks)):
            if i not in past and i not in got and used + size[i] <= budget:
                got.append(i)
                used += size[i]
    return sorted(got)


def plain_windows(chunks, chosen):
    out = []
    for i in chosen:
        if out and i - 1 in chosen:
            out[-1][1] = chunks[i][1]
        else:
            out.append([chunks[i][0], chunks[i][1]])
    return [tuple(w) for w in out]


def made(rng, n):
    out, at = [], 0
    for _ in range(n):
        end = at + rng.randint(1, 1100)
        out.append((at, end, float(rng.choice([0, 0, -4, 3, 4.75, 10, 12, 12])), float(rng.choice([0, 0, 0, -1, 2, 5]))))
        at = end + rng.randint(0, 2)
    return out


def test_choices_against_plain_ones(spark):
    rng = random.Random(11)
    sources = {k: made(rng, rng.randint(0, 25)) for k in range(150)}
    budgets = {k: rng.choice([0, 300, 1000, 2500, 4400, 6000, 9000, 30_000]) for k in sources}
    past = {k: rng.sample(range(len(c)), rng.randint(0, min(6, len(c)))) for k, c in sources.items() if k % 2}
    rows = spark.createDataFrame([(k, i, *c) for k, cs in sources.items() for i, c in enumerate(cs)], CHUNKS).repartition(5)
    length = {k: c[-1][1] if c else 0 for k, c in sources.items()}
    wanted = spark.createDataFrame([(k, length[k], budgets[k]) for k in sources] + [(999, None, 10)], "source_id long, length int, budget int")
    avoid = spark.createDataFrame(list(past.items()), "source_id long, chosen array<int>")
    for used in (None, avoid):
        got = {r.source_id: r for r in excerpts.choose(rows, wanted, used).collect()}
        assert len(got) == len(sources) + 1
        for k, c in sources.items():
            if length[k] <= budgets[k]:
                want, windows = [], [(0, length[k])]
            else:
                want = plain_choice(c, budgets[k], past.get(k, ()) if used is not None else ())
                windows = plain_windows(c, want)
            assert (list(got[k].chosen), [tuple(w) for w in got[k].windows]) == (want, windows), (k, budgets[k], c)


def _cut(spark, data, size):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    frame = spark.createDataFrame(docs, "source_id long, text string")
    chunks = {}
    for r in sorted(evidence.ranked_chunks(frame, size, figure_queries._worth).collect(), key=lambda r: (r.source_id, r.i)):
        chunks.setdefault(r.source_id, []).append((r.start, r.end, float(r.quant), float(r.qual)))
    return docs, chunks


@pytest.mark.parametrize(("name", "budget", "size"), [("source_excerpts", 6000, 1100), ("excerpt_retry", 1000, 500)])
def test_queries_against_plain_choices(spark, data, name, budget, size):
    assert excerpts.chunk_size(budget) == size and excerpts.chunk_size(100) == 300
    docs, chunks = _cut(spark, data, size)
    got = {r.source_id: r for r in registry.queries()[name](spark, data).collect()}
    assert len(got) == len(docs)
    for k, text in docs:
        if len(text) <= budget:
            want, windows = [], [(0, len(text))]
        else:
            want = plain_choice(chunks[k], budget)
            want = plain_choice(chunks[k], budget, want) if name == "excerpt_retry" else want
            windows = plain_windows(chunks[k], want)
        assert (list(got[k].chosen), [tuple(w) for w in got[k].windows]) == (want, windows)


def test_shares_against_a_search_for_the_level(spark):
    rng = random.Random(4)
    rows = []
    for run in range(60):
        for s in range(rng.randint(1, 12)):
            rows.append((run, run * 100 + s, rng.choice([0, 100, 3000, 9000, 50_000]), rng.choice([None, -3.0, 0.0, 0.0, 5.0, 90.0, 900.0]), rng.random() < 0.3, rng.random() < 0.3))
    frame = spark.createDataFrame(rows, "run_id long, source_id long, length int, relevance double, filing boolean, qualitative boolean")
    for total in (5000, 30_000, 64_000):
        got = {r.source_id: r.budget for r in excerpts.allocate(frame, total, 20_000, 8000, 6000).collect()}
        for run in range(60):
            mine = [r for r in rows if r[0] == run]
            most = {r[1]: min(r[2], 8000 if r[4] else 20_000) for r in mine}
            base = {r[1]: min(most[r[1]], 6000 if r[5] else 2500) for r in mine}
            pot = max(0, total - sum(base.values()))
            want = dict(base)
            for group in ([r for r in mine if (r[3] or 0) > 0], [r for r in mine if (r[3] or 0) <= 0]):
                width = {r[1]: math.sqrt(min(r[3], 300)) if (r[3] or 0) > 0 else 1.0 for r in group}
                poured = lambda level: {k: min(most[k] - base[k], level * w) for k, w in width.items()}  # noqa: B023, E731
                low, high = 0.0, 1e6
                for _ in range(200):
                    mid = (low + high) / 2
                    low, high = (mid, high) if sum(poured(mid).values()) <= pot else (low, mid)
                now = poured(low)
                for k, v in now.items():
                    want[k] += math.floor(v + 1e-5)
                pot = max(0, pot - sum(now.values()))
                if pot < 1e-3:
                    pot = 0
            for k, v in want.items():
                assert abs(got[k] - v) <= 0, (run, total, k, got[k], v)


def plain_passages(chunks, budget):
    """chunks: (source, i, start, end, qual) of one run."""
    used, taken = 0, {}
    for _, name, i, s, a, b in sorted((-q, str(s), i, s, a, b) for s, i, a, b, q in chunks if q > 0):
        if used + b - a <= budget:
            used += b - a
            taken.setdefault(s, []).append((i, a, b))
    return {s: sorted(x) for s, x in taken.items()}


def test_claim_passages_against_a_plain_choice(spark, monkeypatch):
    monkeypatch.setattr(excerpts, "_SALTS", 3)
    rng = random.Random(9)
    sources = [(run, run * 10 + s, rng.random() < 0.2) for run in range(20) for s in range(rng.randint(1, 6))]
    chunks = {s: made(rng, rng.randint(0, 40)) for _, s, _ in sources}
    rows = spark.createDataFrame([(s, i, *c) for s, cs in chunks.items() for i, c in enumerate(cs)], CHUNKS)
    kinds = spark.createDataFrame(sources, "run_id long, source_id long, filing boolean")
    runs = spark.createDataFrame([(r,) for r in range(0, 20, 2)] + [(0,)], "run_id long")
    got = {(r.run_id, r.source_id): r for r in excerpts.claim_passages(rows, kinds, runs, 5000).collect()}
    want = {}
    for run in range(0, 20, 2):
        mine = [(s, i, a, b, q) for r, s, f in sources if r == run and not f for i, (a, b, _, q) in enumerate(chunks[s])]
        want |= {(run, s): x for s, x in plain_passages(mine, 5000).items()}
    assert set(got) == set(want) and len(want) > 10
    for k, x in want.items():
        assert list(got[k].chosen) == [i for i, _, _ in x]
        assert [tuple(w) for w in got[k].windows] == plain_windows(dict((i, (a, b)) for i, a, b in x), [i for i, _, _ in x])


def test_who_is_asked_for_claims(spark):
    runs = spark.createDataFrame([(1, 0, 0.1), (2, 2, 0.3), (3, 3, 0.0), (4, None, None), (5, 1, 0.32), (6, 1, 0.35)], "run_id long, claims_verified int, cost double")
    assert sorted(r.run_id for r in excerpts.needs_claims(runs).collect()) == [1, 2, 4]


def test_kinds_of_sources(spark):
    rows = [
        (1, 1, "https://www.sec.gov/x", None, None, "research", 50.0), (1, 2, "https://a.org/", "https://data.sec.gov/y", None, "research", 50.0), (1, 3, "https://a.org/", None, None, "filing", 50.0),
        (1, 4, "https://x.com/000000000124000001/acme-20231231.htm", None, None, "x", 50.0), (1, 5, "https://a.org/", None, None, None, 1.0), (1, 6, "https://a.org/", None, None, "x", 3.0),
        (1, 7, None, None, None, "x", 3.0), (1, 8, "https://a.org/", None, None, "x", 2.0), (1, 9, "https://a.org/", None, None, "x", 0.0),
    ]
    got = excerpts.source_kinds(spark.createDataFrame(rows, "run_id long, source_id long, url string, final_url string, title string, origin string, qual double")).collect()
    assert sorted(r.source_id for r in got if r.filing) == [1, 2, 3, 4]
    assert sorted(r.source_id for r in got if r.qualitative) == [6, 7, 8]


def test_claims_query_against_a_plain_choice(spark, data):
    docs, chunks = _cut(spark, data, 1100)
    got = {(r.run_id, r.source_id): r for r in registry.queries()["claims_followup"](spark, data).collect()}
    runs = {}
    for k, _ in docs:
        runs.setdefault(k // 25, []).append(k)
    want = {}
    for run, members in runs.items():
        first = min(members)
        if first % 5 < 3 and first % 40 / 100 + 0.05 + 0.04 < 0.40:
            mine = [(k, i, a, b, q) for k in members if k % 7 > 1 and k % 11 for i, (a, b, _, q) in enumerate(chunks.get(k, []))]
            want |= {(run, s): x for s, x in plain_passages(mine, 24_000).items()}
    assert {k: list(r.chosen) for k, r in got.items()} == {k: [i for i, _, _ in x] for k, x in want.items()} and want
