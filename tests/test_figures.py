"""Figure rules, quote location, excerpts and names against plain versions and worked cases."""

import random
import re

import pytest
from factweir.functions import figures as fg
from factweir.functions import kernels
from factweir.operators import evidence, filings, quotes, records
from pyspark.sql import functions as F


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_chunks_match_a_plain_scan():
    def plain(text, size):
        out, at = [], 0
        while at < len(text):
            end = min(at + size, len(text))
            if end < len(text):
                cut = [k for k in range(at + size // 2, end) if text[k] == " "]
                end = cut[-1] if cut else end
            out.append((at, end))
            at = end
            while at < len(text) and text[at] == " ":
                at += 1
        return out

    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab  é😀\n" if rng.random() < 0.5 else "abcdefgh ") for _ in range(rng.randint(0, 90)))
        assert kernels.chunk_spans(text, 20) == plain(text, 20), text


def test_sentence_around_a_quote(spark):
    f = lambda quote, context: value(spark, fg.same_sentence(F.lit(quote), F.lit(context)))
    assert f("90 MW runs", "It grew. Site A: 90 MW runs well. An additional 120 MW is planned.") == "Site A: 90 MW runs well."
    assert f("90 MW", "no such words") == "no such words"
    assert f("", "all of it. Yes") == "all of it. Yes"
    assert f("x", "really? x! more") == "x! more"


def test_footnotes(spark):
    around = "Capacity 3 GW* in all.\n* Under development as of March 2026 † Site area* Excluding leases"
    got = value(spark, fg.footnote_texts(F.lit("3 GW* in all"), F.lit(around)))
    assert got[0].startswith("Under development as of March 2026") and len(got) == 1
    assert value(spark, fg.footnotes_used(F.lit("3 GW† and 4 sqft¹ of 5%**"))) == ["†", "¹", "**"]
    assert value(spark, fg.footnote_texts(F.lit("3 GW"), F.lit(around))) == []


@pytest.mark.parametrize(
    ("quote", "row", "want"),
    [
        ("Energy Consumption (kWh) 1,673 681 1,477", "", ["1,673", "681", "1,477"]),
        ("Energy use (MWh) 2022 2023 120 140", "", []),
        ("Energy use (MWh) 120", "", []),
        ("681", "Energy (GJ) FY 2023 681 702 14", ["681", "702", "14"]),
        ("5", "Energy (GJ) 681 702", []),
    ],
)
def test_runs_of_values(spark, quote, row, want):
    assert value(spark, fg.unlabelled_values(F.lit(quote), F.lit(row))) == want


def test_future_capacity_sentences(spark):
    f = lambda t, *mw: value(spark, fg.without_future(F.lit(t), F.array(*[F.lit(float(x)) for x in mw])))
    text = "It operates 3 GW today. A further 3 GW is planned by 2027. It has 3,000 MW live. Other 30 GW online."
    assert f(text, 3000) == "A further 3 GW is planned by 2027. Other 30 GW online."
    assert f(text, 50) == text
    assert f("Operating 120 MW.", 120) is None
    assert f("It is running 1.5 gigawatts.", 1500) is None


CHAIN = [
    # quote, text, metric, value, unit, factor, year, primary, reason
    ("total energy consumption was 1,200 MWh in 2023", "{}", "energy_consumption", 1200.0, "MWh", 3.6e9, 2023, True, None),
    ("total energy consumption was 1,200 MWh in 2023", "gone", "energy_consumption", 1200.0, "MWh", 3.6e9, 2023, True, "quote not found"),
    ("total energy consumption was 1,200 MWh in 2023", "{}", "energy_consumption", 1200.0, "cups", None, 2023, True, "unit not supported"),
    ("total energy consumption was 1,200 MWh in 2023", "{}", "energy_consumption", 1300.0, "MWh", 3.6e9, 2023, True, "value not in the quote"),
    ("total energy consumption was 1,200 MWh in 2023", "{}", "energy_consumption", 1200.0, "GJ", 1e9, 2023, True, "unit not near"),
    ("total energy consumption was 1,200 TWh in 2023", "{}", "energy_consumption", 1200.0, "TWh", 3.6e18, 2023, True, "implausibly large"),
    ("capital expenditures were 12,339 for the year", "(in millions) {}", "capex", 12339.0, "USD", 1.0, 2023, True, None),
    ("capital expenditures were 12,339 for the year", "(in millions) {}", "capex", 12339e6, "USD", 1.0, 2023, True, None),
    ("capital expenditures were 12,339 dollars then", "{}", "capex", 12339.0, "USD", 1.0, 2023, True, "implausibly small"),
    ("capital expenditures were $ 12,339 million", "{}", "capex", 12339e6, "USD", 1.0, None, True, "no period"),
    ("revenue is expected to be $ 12,339 million", "{}", "revenue", 12339e6, "USD", 1.0, 2023, True, "forecast"),
]


def test_figure_chain(spark):
    rows = [(i, i, m, v, u, f, y, p, q) for i, (q, _, m, v, u, f, y, p, _) in enumerate(CHAIN)]
    figs = spark.createDataFrame(rows, "figure_id long, source_id long, metric_key string, value double, unit string, factor double, period_year int, is_primary boolean, quote string")
    texts = spark.createDataFrame([(i, t.replace("{}", q)) for i, (q, t, *_) in enumerate(CHAIN)], "source_id long, text string")
    got = {r.figure_id: r for r in quotes.verify_figures(figs, texts, 2025).collect()}
    assert [got[i].reason for i in range(len(CHAIN))] == [c[-1] for c in CHAIN]
    assert got[0].si == pytest.approx(1200 * 3.6e9) and got[6].si == pytest.approx(12339e6) and got[7].si == pytest.approx(12339e6)


def test_similar_names_against_all_pairs(spark):
    rng = random.Random(7)
    words = ["photovoltaic", "widgets", "international", "energy", "grid", "nord", "solar", "x", "ab"]

    def typo(s):
        i = rng.randrange(max(1, len(s)))
        return s[:i] + rng.choice(["", "z", s[i : i + 1] * 2]) + s[i + 1 :]

    registry = [(i, " ".join(rng.sample(words, rng.randint(1, 3)))) for i in range(60)]
    names = [(i, typo(typo(n)) if i % 2 else typo(n)) for i, n in registry] + [(900, "photovoltaics"), (901, ""), (902, "International Widgetz Inc.")]
    core = {r.name: r.core for r in spark.createDataFrame([(n,) for _, n in registry + names], "name string").select("name", F.expr("name").alias("core")).collect()}
    frame = lambda rows: spark.createDataFrame(rows, "id long, name string")
    cores = {r.name: r.core for r in frame([*registry, *names]).select("name", evidence.text.core_name(F.col("name")).alias("core")).collect()}
    assert set(core) == set(cores)
    want = {}
    for i, n in names:
        scored = sorted((-kernels.indel(cores[n], cores[m]), j) for j, m in registry if cores[n] and cores[m])
        scored = [(-s, j) for s, j in scored if -s >= 92]
        if scored:
            want[i] = (scored[0][1], len(scored) > 1 and scored[1][0] >= scored[0][0] - 2)
    got = {r.id: (r.entry, r.ambiguous) for r in evidence.similar_names(frame(names), frame(registry)).collect()}
    assert got == want and len(want) > 20


def test_duplicate_companies_against_all_pairs(spark):
    rng = random.Random(8)
    names = ["Acme Energy Holdings of the North", "Acme", "AB", "Nord Stream", "Nordic Streams", "Zeta"]
    companies = [(i, rng.choice(names) + rng.choice(["", " Two", "s"]), f"d{i}" if i % 4 == 0 else None) for i in range(40)]
    asked = [(i, n[: rng.randint(1, len(n))] if i % 3 else n, "d8" if i == 5 else None) for i, (_, n, _) in enumerate(companies)]
    a = spark.createDataFrame(asked, "id long, name string, domain string")
    c = spark.createDataFrame(companies, "company_id long, name string, domain string")
    key = lambda n: re.sub(r"[ \t]+", " ", re.sub(r"[^a-z0-9_ \t]", "", n.strip().lower())).strip()
    want = {}
    for i, n, d in asked:
        same = [j for j, _, e in companies if d and e == d]
        near = [j for j, m, _ in companies if key(n)[:20] in key(m) and kernels.indel(key(n), key(m)) >= 85 and key(n) and (len(key(n)) >= 3 or len(key(m)) < 3)]
        if same or near:
            want[i] = (min(same), "domain") if same else (min(near), "name")
    got = {r.id: (r.company_id, r.how) for r in filings.duplicate_company(a, c).collect()}
    assert got == want


def test_duplicate_companies_compare_each_name_once(spark):
    names = ["Acme Works", "Acme Workshop", "Energy Holdings of the Northern Sea", "Energy Holdings of the Northern Seas"]
    rows = spark.range(4000).selectExpr("id AS company_id", f"element_at(array({', '.join(map(repr, names))}), cast(id % 4 + 1 AS int)) AS name", "'' AS domain")
    asked = rows.select(F.col("company_id").alias("id"), "name", "domain")
    got = {r.company_id: r.n for r in filings.duplicate_company(asked, rows).groupBy("company_id").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 1000, 1: 1000, 2: 2000}
    cores = rows.select(F.lower("name").alias("core")).distinct()
    assert filings.name_pairs(cores, cores.select(F.col("core").alias("other"))).count() == 7


@pytest.mark.parametrize(("x", "want"), [(1053479.0, "1,053,479"), (12345.6, "12,346"), (123.45, "123.5"), (1.5, "1.5"), (0.25, "0.25"), (2.0, "2"), (None, "—")])
def test_shown_numbers(spark, x, want):
    assert value(spark, records.shown_number(F.lit(x).cast("double"))) == want


def test_shown_units_and_stored_text(spark):
    assert [value(spark, records.shown_power(F.lit(w))) for w in (5.0, 1500.0, 2.5e9, 3e14)] == ["5 W", "1.5 kW", "2.5 GW", "300 TW"]
    assert value(spark, records.shown_energy(F.lit(7.2e15))) == "2.00 TWh/yr"
    assert [value(spark, records.shown_duration(F.lit(ms))) for ms in (1500, 42_000, 61_000, 3_660_000)] == ["1.5 s", "42 s", "1m 01s", "1h 01m"]
    text = "It used 1.05348e+06 MWh and 2e3 more."
    assert value(spark, records.without_exponents(F.lit(text), F.array(F.lit(1053479.0)))) == "It used 1,053,479 MWh and 2,000 more."


def test_sentence_ends_and_capacities_are_fixed_expressions(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", ".", "!", "?", " ", "\n", "\t", "b3 ", "GW"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.split("t", fg.SENTENCE_END).alias("a"), F.split("t", r"(?<=[.!?])\s+").alias("b"), (F.regexp_count("t", F.lit(r"[.!?]\s")) + 1).alias("n")).collect()
    assert all(r.a == r.b and len(r.a) == r.n for r in got)
    for mw, said in ((3000.0, ("3 GW", "3,000MW", "3000 megawatts", "3 gigawatt")), (1.5, ("1.5 MW",)), (120.0, ("120 MW", "0.12 GW"))):
        assert all(value(spark, F.regexp_like(F.lit(s), fg.amount_pattern(F.lit(mw)))) and value(spark, fg.says(F.lit(s), fg.CAPACITY)) for s in said if s != "3 gigawatt")
