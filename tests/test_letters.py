"""Quotes found on the index of letters, against a plain scan."""

import random
import unicodedata

import pytest
from factweir.functions import kernels, letters
from factweir.operators import quotes

CASES = [
    ("We used 1,234 MWh of energy in 2023", "Intro. We used 1,234 MWh of energy in 2023. End", "exact", "We used 1,234 MWh of energy in 2023"),
    ("we used 1,234 mwh of energy in 2023", "Intro. We  used\n1,234 MWh — of energy in 2023. End", "loose", "We  used\n1,234 MWh — of energy in 2023"),
    ("Total capacity of 3 gigawatts in operation", "x Total capacity¹ of 3 gigawatts² in operation", "footnote", "Total capacity¹ of 3 gigawatts² in operation"),
    ("Total capacity of 3 GW in all operation", "x Total capacity of 3 GW² in all operation", None, None),  # behind a capital: part of the unit
    ("It grew, the report says. (A further note.)", "It grew,12 the report says.3 (A further note.)4, yes", "footnote", "It grew,12 the report says.3 (A further note.)"),
    ("It grew by 1 and the report says more", "It grew by 123 and the report says more", None, None),
    ("Purchases of property ..... (12,734) in all", "Purchases of property (12,734) in all", "loose", "Purchases of property (12,734) in all"),
    ("Capital expenditures ___________ 2,800", "Capital expenditures 2,800", "loose", "Capital expenditures 2,800"),
    ("The company used energy … and bought more power", "The company used energy for years, it says, and bought more power then", "ellipsis", "The company used energy for years, it says, and bought more power"),
    ("The company used energy [...] and bought more power", "The company used energy " + "x " * 300 + "and bought more power", "ellipsis", "The company used energy " + "x " * 300 + "and bought more power"),
    ("The company used energy … and bought more power", "The company used energy " + "x " * 401 + "and bought more power", None, None),
    ("The company used energy … and bought more power", "The company used energy " + "x-----" * 250 + "and bought more power", None, None),  # beyond the longest span
    ("The company used energy … tiny", "The company used energy tiny", "loose", "The company used energy tiny"),
    ("used energy … bought power … in the end", "used energy a used energy b bought power c in the end", "ellipsis", "used energy a used energy b bought power c in the end"),
    ("$4.2 billion for the new power plants.", "paid ($4.2 billion for the new power plants.)", "exact", "$4.2 billion for the new power plants."),
    ('"Quoted words of some length here"', "he said “Quoted words of some length here” then", "exact", "“Quoted words of some length here”"),
    ("eﬃcient ½ of the Ｗｏｒｄｓ that count", "more efficient 1⁄2 of the words that count", "exact", "efficient 1⁄2 of the words that count"),
    ("short quote", "short quote", None, None),
    ("!!! ??? ... --- *** ((( ))) !!! ???", "!!! ??? ... --- *** ((( ))) !!! ???", None, None),
    ("w" * 601, "w" * 601, None, None),
    ("words that are nowhere in the text", "other words", None, None),
    ("words that are nowhere in the text", "", None, None),
]


@pytest.mark.parametrize(("quote", "source", "method", "span"), CASES)
def test_worked_cases(quote, source, method, span):
    got = letters.Source(source).find(quote)
    assert (got and (got[0], source[got[1] : got[2]])) == (method and (method, span))


def plain_index(text):
    out = []
    for i, c in enumerate(text):
        if unicodedata.category(c)[0] in "LN" and c.isalnum():
            out += [(x, i) for x in unicodedata.normalize("NFKC", c).lower() if x.isalnum()]
    return "".join(c for c, _ in out), [i for _, i in out]


def test_index_against_a_plain_scan():
    rng = random.Random(3)
    for k in range(400):
        text = "".join(rng.choice("abC 1²½.-é😀ﬁßİ" if k % 2 else "abC 12.-(\n") for _ in range(rng.randint(0, 60)))
        got, places = letters.indexed(text)
        assert (got, places.tolist()) == plain_index(text), text
    long = "Größe 12 ﬁx. " * 5000
    got, places = letters.indexed(long)
    assert (got, places.tolist()) == plain_index(long)


def test_contiguous_quotes_against_a_plain_scan():
    rng = random.Random(5)
    words = ["energy", "(MWh)", "1,200", "größer", "a+b", "\\d", "[x]", "$5.2", "été", "—", "end!", "e", "n"]
    found = 0
    for _ in range(400):
        text = " ".join(rng.choices(words, k=40))
        quote = " ".join(rng.choices(words, k=3)) if rng.random() < 0.3 else text[(at := rng.randrange(0, 80)) : at + rng.randint(20, 150)]
        got = letters.Source(text).find(quote)
        wanted, (index, places) = plain_index(quote)[0], plain_index(text)
        fits = 20 <= len(letters.normal(quote).strip(" \"'")) <= 600 and len(wanted) >= 14
        at = index.find(wanted) if fits else -1
        assert (got is not None) == (at >= 0), quote
        if got:
            found += 1
            core = text[places[at] : places[at + len(wanted) - 1] + 1]
            assert core in text[got[1] : got[2]] and plain_index(text[got[1] : got[2]])[0] == wanted
    assert found > 250


@pytest.mark.parametrize("together", [1, 3, 1000])
def test_rows_of_a_hot_source_are_split_and_none_is_lost(spark, together):
    texts = {i: f"Source {i} tells that it used 1,2{i}4 MWh of energy in all, and more." for i in range(5)} | {7: "", 8: None}
    rows = [(n, s, f"used 1,2{s}4 MWh of energy in all", "x") for n, s in enumerate([0] * 40 + [1, 2, 3, None, 9, 7, 8])] + [(0, 0, "used 1,204 MWh of energy in all", "x")] * 2 + [(77, 1, None, None), (78, 2, "", "y")]
    asked = spark.createDataFrame(rows, "figure_id long, source_id long, quote string, `TEXT` string")
    got = quotes.locate_quotes(asked, spark.createDataFrame(list(texts.items()), "source_id long, text string"), contexts=True, together=together).collect()
    assert sorted(map(repr, (tuple(r)[:4] for r in got))) == sorted(map(repr, rows))
    for r in got:
        if r.source_id in (0, 1, 2, 3) and r.quote:
            body = texts[r.source_id]
            assert body[r.start - 1 : r.end] == r.span == r.quote and r.method == "exact" and r.row in body and r.before.startswith("Source")
        else:
            assert r.method is None and r.start is None
    assert quotes.locate_quotes(asked.limit(0), spark.createDataFrame([], "source_id long, text string")).count() == 0


def test_every_source_of_a_quote_is_found(spark):
    quote = "the company reported that it used 1,234 MWh of energy in the year"
    texts = [(i, f"Words {i}. " + (quote.upper() if i % 3 == 0 else "nothing here") + " end") for i in range(30)] + [(50, None), (51, "")]
    asked = spark.createDataFrame([(1, quote), (1, quote), (2, None), (3, "too short")], "quote_id long, quote string")
    got = quotes.quote_places(asked, spark.createDataFrame(texts, "source_id long, text string")).collect()
    assert sorted((r.quote_id, r.source_id) for r in got) == sorted([(1, i) for i in range(0, 30, 3)] * 2)


def test_numbers_come_with_the_span(spark):
    text = "Introduction. It used 1,234 million MWh or 2.345.678,5 in 12 345 plants of 90 MW. More 77 follows."
    asked = spark.createDataFrame([(1, 1, "used 1,234 million MWh or 2.345.678,5 in 12 345 plants of 90 MW"), (2, 1, "nothing of the kind is said here")], "figure_id long, source_id long, quote string")
    got = {r.figure_id: r for r in quotes.locate_quotes(asked, spark.createDataFrame([(1, text)], "source_id long, text string"), contexts=True).collect()}
    assert got[1].numbers == kernels.numbers(got[1].span) and {1234.0, 1.234e9, 2345678.5, 12345.0, 90.0} <= set(got[1].numbers) and 77.0 not in got[1].numbers
    assert got[2].numbers is None
