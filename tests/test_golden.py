"""Values worked out by hand."""

import pytest
from factweir.functions import figures, kernels, text
from factweir.operators import evidence, measures, runs, scoring
from factweir.shipping import ship
from pyspark.sql import functions as F


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def si(spark, metric, number, unit):
    f = spark.createDataFrame([(metric, number, unit, "FY2024")], "metric_key string, value double, unit string, period string")
    return measures.with_si(f).first().si


@pytest.mark.parametrize(("metric", "number", "unit", "want"), [
    ("energy_consumption", 1.0, "TWh", 3.6e15), ("energy_consumption", 1000.0, "GWh", 3.6e15), ("energy_consumption", 1e6, "MWh/yr", 3.6e15),
    ("energy_consumption", 3.6, "petajoules", 3.6e15), ("energy_consumption", 1000.0, "thousand MWh", 3.6e15), ("energy_consumption", 5.0, "MW", None),
    ("capex", 5.0, "EUR", None), ("capex", 4.2, "$ billion", 4.2e9), ("revenue", 3.0, "in millions of US dollars", 3e6), ("datacenter_capacity_operating", 2.0, "Giga-watts", 2e9),
])
def test_units(spark, metric, number, unit, want):
    got = si(spark, metric, number, unit)
    assert got is None if want is None else got == pytest.approx(want)


def test_scores(spark):
    for watts, want in ((1e7, 0), (1e8, 2.5), (1e9, 5), (1e10, 7.5), (1e11, 10), (0.0, 0)):
        assert value(spark, measures.energy_score(F.lit(float(watts)))) == pytest.approx(want)
    for rate, want in ((-0.3, 0), (0.0, 3), (0.05, 4), (0.1, 5), (0.25, 7), (0.375, 8), (0.5, 9), (1.0, 10), (7.0, 10), (-1.0, 0)):
        assert value(spark, measures.growth_score(F.lit(rate))) == pytest.approx(want)
    assert value(spark, measures.power_scale(F.lit(1e16))) == pytest.approx(1.0)
    assert value(spark, measures.period_year(F.lit("FY '24"))) == 2024
    assert value(spark, scoring.score_band(F.lit(6.0))) == "strong"
    assert value(spark, scoring.judge_confidence(F.lit(0.9), F.array(F.lit(1), F.lit(1)))) == pytest.approx(0.85 * (0.6 + 0.4 / 3))
    assert value(spark, scoring.token_cost(F.lit("big-mini-2"), F.lit(1e6), F.lit(0.0), {"big": (9.0, 9.0), "big-mini": (1.0, 2.0)})) == 1.0


def test_growth_over_three_years(spark):
    rows = [(1, "revenue", y, v, "edgar", True, i) for i, (y, v) in enumerate(((2018, 1.0), (2021, 1.0), (2024, 1.331)))]
    got = measures.growth_rates(spark.createDataFrame(rows, "entity_id int, metric_key string, year int, si double, origin string, is_primary boolean, figure_id int")).first()
    assert (got.years, got.cagr) == (3, pytest.approx(0.1))


def _index(spark, scores, **gates):
    df = spark.createDataFrame([(1, k, s, c) for k, (s, c) in scores.items()], "run_id int, category string, score double, confidence double")
    return scoring.aggregate_index(df, **gates).first()


def test_index(spark):
    full = {k: (6.0, 0.9) for k in scoring.WEIGHTS}
    assert _index(spark, full | {"energy_throughput": (10.0, 0.9)}).index_score == 7.2
    r = _index(spark, {k: (8.0, 0.9) for k in full} | {"compute_capacity": (None, 0.9)})
    assert (r.index_score, r.coverage, r.confidence, r.ranked) == (8.0, 0.8, 0.72, True)
    r = _index(spark, {k: (5.0, 0.9) for k in full if k != "energy_throughput"})
    assert (r.basis, r.coverage, r.ranked) == ("standard", 0.7, True)
    r = _index(spark, {k: (5.0, 0.9) for k in ("compute_capacity", "frontier_acceleration", "builder_velocity")}, min_share=0.4)
    assert (r.basis, r.adjusted_coverage, r.confidence, r.ranked) == ("energy_undisclosed", 0.6714, 0.338, True)
    r = _index(spark, {"policy_stance": (5.0, 2.0), "unlisted": (9.0, 1.0)})
    assert (r.index_score, r.coverage, r.confidence, r.ranked) == (5.0, 0.08, 0.08, False)


RUN = "run_id int, company_id int, status string, finished_at int, ranked boolean, is_ranked boolean, coverage double, published boolean, version string, degraded boolean, basis string, retracted boolean"


def _replay(spark, rows, legacy=False):
    full = [(i, 1, "succeeded", i, rk, rk, cov, pub, ver, deg, "standard", ret) for i, rk, cov, pub, ver, deg, ret in rows]
    df = spark.createDataFrame(full, RUN)
    companies = spark.createDataFrame([(1, legacy)], "company_id int, has_legacy boolean")
    got = sorted(runs.replay(df.orderBy(F.rand(1)), companies).collect(), key=lambda r: r.run_id)
    return (got[0].current_run if got else None), [r.run_id for r in got]


def test_replay_rules(spark):
    a = (1, True, 0.9, True, "pipeline-v2.9", False, False)
    assert _replay(spark, [a, (2, False, 0.9, False, "pipeline-v2.9", False, False)]) == (1, [1])
    assert _replay(spark, [a, (2, False, 0.1, False, "pipeline-v2.10", False, False)]) == (2, [1, 2])
    assert _replay(spark, [a, (2, False, 0.1, False, "pipeline-v2.10", True, False)]) == (1, [1])
    assert _replay(spark, [(1, True, 0.9, True, None, False, True), (2, False, 0.1, False, None, False, False)]) == (2, [2])
    assert _replay(spark, [(1, True, 0.9, True, None, False, True), (2, False, 0.1, False, None, False, False)], legacy=True) == (2, [2])
    assert _replay(spark, [(1, True, 0.9, True, None, False, True)]) == (None, [])


def test_labels(spark):
    assert [value(spark, runs.label(F.lit(i))) for i in (0, -2, 3)] == ["N", "N-2", "N+3"]


def test_names_and_numbers(spark):
    ship(spark)
    assert value(spark, text.core_name(F.lit("The Big & Small Holdings, Inc."))) == "big and small"
    assert kernels.indel("abcd", "abxd") == 75.0 and kernels.indel("", "") == 100.0
    assert kernels.token_set("alpha beta", "beta gamma alpha") == 100.0
    assert kernels.numbers("1,053,479 815,864") == [1053479.0, 815864.0]
    assert kernels.numbers("about 4.2 billion and 1 053 479") == [1053479.0, 4.2, 4.2e9, 1.0, 53.0, 479.0]  # grouped readings first, and each plain cell
    assert value(spark, text.number_matches(text.plain_numbers(F.lit("1,004 of 7")), F.lit(1000.0)))
    words = "word " * 1000
    spans = kernels.chunk_spans(words)
    assert all(b - a <= 1100 for a, b in spans) and "".join(words[a:b] for a, b in spans).replace(" ", "") == words.replace(" ", "")


def test_figure_rules(spark):
    f = lambda metric, quote, year=2024, primary=True: value(spark, figures.check_figure(F.lit(metric), F.lit(quote), F.lit(year), F.lit(primary), 2025)).asDict()
    assert f("energy_consumption", "we deployed Megapacks")["metric_key"] == "energy_storage_deployed"
    assert f("energy_consumption", "energy sold to the grid")["metric_key"] == "energy_sold"
    assert f("datacenter_capacity_operating", "3 GW under construction")["metric_key"] == "datacenter_capacity_planned"
    assert not f("capex", "raised senior notes for capital expenditures")["ok"]
    assert f("capex", "capital expenditures were $5")["ok"]
    assert not f("capex", "capital expenditures were $5", primary=False)["ok"]
    assert not f("revenue", "annualized revenue")["ok"]


def test_similar_names_against_all_pairs(spark):
    ship(spark)
    names = ["Alpha Power Inc", "Alpha Powers", "Beta Energy", "Beta Energi Ltd", "Gamma", "Alpha Power Group"]
    registry = ["Alpha Power Corp", "Beta Energy plc", "Delta Gamma"]
    a = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    b = spark.createDataFrame([(i, n) for i, n in enumerate(registry)], "id int, name string")
    got = {r.id: r.entry for r in evidence.similar_names(a, b, 85.0).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 5: 0}


def test_budget_skips_what_does_not_fit(spark):
    rows = [(1, 0, 0, 90, 5.0), (1, 1, 90, 150, 9.0), (1, 2, 150, 190, 7.0), (1, 3, 190, 200, 1.0), (1, 4, 200, 201, 0.0)]
    c = spark.createDataFrame(rows, "source_id int, i int, start int, end int, s double")
    got = evidence.take_within(c, "s", 115).first()
    assert (got.used, got.taken) == (110, [1, 2, 3])


def test_best_figure_of_a_year_without_sorting_all(spark):
    rows = [(e, "capex", y, float(v), o, p, i) for i, (e, y, v, o, p) in enumerate((e, y, v, o, p) for e in (1, 2) for v in (3, 4) for y in (2020, 2021) for o in ("quote", "edgar", "archive", None) for p in (True, False, None))]
    order = lambda r: (r[4] is not None, r[4] == "edgar", r[5] is not None, bool(r[5]), -r[6])
    want = {(e, y): max((r for r in rows if (r[0], r[2]) == (e, y) and (e, r[4]) != (2, "edgar")), key=order) for e in (1, 2) for y in (2020, 2021)}
    figs = spark.createDataFrame([r for r in rows if (r[0], r[4]) != (2, "edgar")], "entity_id long, metric_key string, year int, si double, origin string, is_primary boolean, figure_id long")
    got = measures.yearly(figs)
    assert {(r.entity_id, r.year): (r.si, r.origin, r.is_primary, r.figure_id) for r in got.collect()} == {k: (r[3], r[4], r[5], r[6]) for k, r in want.items()}
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_listed_spellings_are_their_own_keys(spark):
    rows = [(k, f"{k[:i]} {k[i:]}".upper()) for _, k, _, _ in measures.unit_rows() for i in range(len(k))]
    assert [r for r in spark.createDataFrame(rows, "k string, u string").select("k", "u", measures.spelling_key(F.col("u")).alias("s")).collect() if r.s != r.k] == []
