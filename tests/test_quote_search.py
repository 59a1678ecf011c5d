"""Quotes are sought in all documents, whatever ids they have."""

import re

from factweir.operators import evidence
from factweir.plans import registry

from tests.oracle import connection, same

LONG = "The plant on the river delivered more energy than all the others in that year."
SHORT = "Übung macht den Meister"


def test_every_document_is_searched(spark):
    rows = [(i, "Nothing to be seen in this one, whatever the number.") for i in range(1, 8)]
    rows += [(10, "before " * 500 + LONG.upper() + " after" * 500), (11, f"x{LONG.replace(' ', '-')}y"), (12, "so: übung MACHT den  meister!"), (None, f"a {LONG}"), (None, None), (13, "")]
    quotes = [(1, 1, LONG), (2, 11, LONG), (3, 3, SHORT), (4, 4, "Übung macht den Meisterkoch"), (5, 5, "too short"), (6, 6, None), (7, 7, "a " + LONG)]
    q = spark.createDataFrame(quotes, "quote_id long, source_id long, quote string")
    got = {r.quote_id: r.found_in for r in evidence.find_quotes(q, spark.createDataFrame(rows, "source_id long, text string")).collect()}
    flat = lambda t: re.sub(r"[\W_]+", "", (t or "").lower())
    want = {}
    for i, cited, t in quotes:
        found = [d for d, x in rows if len(t or "") >= 20 and flat(t) in flat(x)]
        if found:
            want[i] = min(found, key=lambda d: (d != cited, d is None, d or 0))
    assert got == want == {1: 10, 2: 11, 3: 12, 7: None}


def test_more_is_found_than_in_one_quarter(spark):
    data = "/root/testdata/sf0.01"
    got = registry.queries()["quote_search"](spark, data)
    same(got, connection(data), registry.oracle_sql()["quote_search"])
    assert got.count() == 20
