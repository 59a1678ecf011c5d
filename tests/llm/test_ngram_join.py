import random

import numpy as np
import pandas as pd
import pytest
from factweir.llm import components as cc
from factweir.llm import entries
from factweir.llm import ngram_join as nj
from factweir.llm.components import components as spark_components
from factweir.llm.common import work_dir

from tests.llm.brute import HOSTILE, components, docs


def _near(rng, base, edits):
    w = list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def _planted(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    for size in (1, 2, 3, 5, 8, 11, 12, 21, 40, 75, 160, 400):
        base = [word() for _ in range(size)]
        texts += [" ".join(base), " ".join(base).upper()] + [_near(rng, base, 1 + k % 4) for k in range(8)]
        texts += [" ".join([*base, word()]), " ".join(base[: max(1, size - 1)])]
    hub = [word() for _ in range(90)]
    texts += [" ".join(hub)] + [_near(rng, hub, 1 + k % 3) for k in range(60)]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 90, 1), (5, 80, 2)])
def test_planted_groups_match_brute_force(spark, n, percent, seed):
    rows = _planted(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.jaccard_components(docs(spark, rows), n, percent).collect()}
    assert got == components(rows, n, percent)


def test_hostile_rows(spark):
    rows = [(i, t) for i, t in enumerate(HOSTILE)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.jaccard_components(docs(spark, rows), 5, 80).collect()}
    assert got == components(rows, 5, 80)


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, "alone here"), (9, "other text of five words")]
    got = sorted(nj.jaccard_components(docs(spark, rows), 5, 80).collect(), key=repr)
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(7, 7), (7, 7), (9, 9)]
    assert sorted((r.component_id for r in got if r.doc_id is None), key=repr) == [7, None]
    assert nj.jaccard_components(docs(spark, []), 5, 80).count() == 0


def test_blocks_check_all_pairs_that_the_pivot_leaves_open(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_ROWS", 4)
    monkeypatch.setattr(nj, "STAR_ROWS", 3)
    rows = _planted(5)[-61:]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.jaccard_components(docs(spark, rows), 3, 90).collect()}
    assert got == components(rows, 3, 90)


@pytest.mark.parametrize("double", [0, 1, 3])
def test_every_linking_pair_shares_a_signature(double):
    rng = np.random.default_rng(double)
    rule = nj.Rule(3, 90)
    cuts = nj.bands(90, 500)
    for _ in range(300):
        size = int(rng.integers(9, 300))
        a = rng.integers(0, 2**63, size, dtype=np.uint64)
        b = a.copy()
        for _ in range(int(rng.integers(0, 1 + size // 10))):
            b = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 else np.append(b, rng.integers(0, 2**63, dtype=np.uint64))
        a, b = np.unique(a), np.unique(b)
        if 10 * len(np.intersect1d(a, b)) < 9 * len(np.union1d(a, b)):
            continue
        found = False
        for k, (lo, hi) in enumerate(cuts):
            if not lo <= min(len(a), len(b)) <= hi:
                continue
            need = rule.distance(hi, hi * 100 // 90) + 1
            d = min(double, need // 2)
            scheme = nj.Scheme(need - d, d)
            found |= bool(len(np.intersect1d(nj.signatures(a, k, scheme), nj.signatures(b, k, scheme))))
        assert found


def test_overlaps():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, int(rng.integers(1, 200))).astype(np.uint64)) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = nj.overlaps(sets, columns=64)
    off = ~np.eye(len(sets), dtype=bool)
    assert (got[off] == np.array(want)[off]).all()


def test_components_of_chains(spark):
    n = 40
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in spark_components(links, work_dir(spark, "test")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}


def test_components_of_v_shaped_chains_take_few_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cc, "TASK_LINKS", 20)
    n = 300  # labels fall towards both ends of the chain
    order = [*range(n - 1, 0, -2), *range(0, n, 2)]
    links = spark.createDataFrame([*zip(order, order[1:], strict=False), (1000, 1001), (1002, 1001)], "a long, b long")
    got = {r.id: r.component for r in spark_components(links, f"{tmp_path}/rounds").collect()}
    assert got == dict.fromkeys(range(n), 0) | dict.fromkeys((1000, 1001, 1002), 1000)
    rounds = [int(f.name) for f in (tmp_path / "rounds").iterdir() if f.name.isdigit()]
    assert max(rounds) <= 24


def test_contraction_in_bounded_memory_keeps_what_is_connected(monkeypatch):
    monkeypatch.setattr(cc, "HELD_IDS", 10)
    rng = random.Random(4)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    got = [x for pdf in cc._contracted(pd.DataFrame(pairs[i : i + 5], columns=["a", "b"]) for i in range(0, 150, 5)) for x in pdf.itertuples(index=False)]
    assert all(hi > lo for hi, lo in got)
    whole, stars = cc.Forest(), cc.Forest()
    for a, b in pairs:
        whole.join(a, b)
    for a, b in got:
        stars.join(a, b)
    assert [whole.top(x) for x in range(200)] == [stars.top(x) for x in range(200)]


def test_components_extended_by_more_links(spark, tmp_path):
    of = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    first, more = [(5, 6), (7, 8), (20, 21)], [(6, 8), (9, 7), (2, 9), (30, 31), (20, 21), (4, 4)]
    known = spark_components(of(first), f"{tmp_path}/first")
    got = sorted((r.id, r.component) for r in cc.extended(known, of(more), f"{tmp_path}/more").collect())
    assert got == [(2, 2), (5, 2), (6, 2), (7, 2), (8, 2), (9, 2), (20, 20), (21, 20), (30, 30), (31, 30)]
    same = sorted((r.id, r.component) for r in cc.extended(known, of([(1, 1)]), f"{tmp_path}/none").collect())
    assert same == [(5, 5), (6, 5), (7, 7), (8, 7), (20, 20), (21, 20)]


def test_rows_without_an_id_link_their_neighbours(spark):
    words = [f"w{i}" for i in range(400)]
    ends = [" ".join([*words[:392], *(f"{side}{i}" for i in range(8))]) for side in "ab"]
    rows = [(1, ends[0]), (None, " ".join(words)), (2, ends[1]), (None, "alone here " * 5)]
    got = nj.jaccard_components(docs(spark, rows), 3, 96).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 1), (1, 1), (2, 1)]


def test_sketches_never_part_a_link():
    rng = np.random.default_rng(4)
    rule = nj.Rule(5, 80)
    passed = 0
    for size in (1, 5, 63, 64, 65, 300, 1000, 5000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            b = np.unique(np.concatenate([a[int(rng.integers(0, 1 + len(a) // 4)) :], rng.integers(0, 2**63, int(rng.integers(0, 1 + size // 4)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            fits = nj.may_link(nj.sketch(a), nj.sketch(b), len(a), len(b), rule)
            if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
                assert fits
            c = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            passed += size > 60 and nj.may_link(nj.sketch(a), nj.sketch(c), len(a), len(c), rule)
    assert passed == 0


def test_query_matches_brute_force(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in entries.op5_ngram_jaccard_join(spark, data).collect()}
    assert got == components(rows, 3, 90)


def test_linking_sets_meet_although_empty_segments_have_no_signature():
    """Small sets with empty segments, by planned schemes: links share a signature, unrelated sets share few."""
    rng = np.random.default_rng(5)
    rule = nj.Rule(5, 80)
    cuts = nj.bands(80, 100)
    schemes = [nj.plan(rule, lo, hi, 50_000, 0.35) for lo, hi in cuts]

    def meet(a, b):
        return any(lo <= min(len(a), len(b)) <= hi and len(np.intersect1d(nj.signatures(a, k, s), nj.signatures(b, k, s))) for k, ((lo, hi), s) in enumerate(zip(cuts, schemes, strict=True)))

    linked = 0
    for _ in range(4000):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(2, 70)), dtype=np.uint64))
        gone = rng.permutation(len(a))[: int(rng.integers(0, 1 + len(a) // 5))]
        b = np.unique(np.append(np.delete(a, gone), rng.integers(0, 2**63, int(rng.integers(0, 1 + len(a) // 9)), dtype=np.uint64)))
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            linked += 1
            assert meet(a, b)
    assert linked > 1500
    strangers = [np.unique(rng.integers(0, 2**63, 40, dtype=np.uint64)) for _ in range(120)]
    assert sum(meet(a, b) for i, a in enumerate(strangers) for b in strangers[:i]) < 20
