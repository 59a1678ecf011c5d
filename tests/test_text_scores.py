"""Scores count what stands anywhere in a text, and nothing that doesn't stand there."""

import pytest
from factweir.plans import registry

from tests.oracle import connection, same

MARKED = "Energy use 1,234 MWh in 12,000 GW; launch and cookie policy."


@pytest.fixture(scope="module")
def got(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("scores"))
    rows = [(1, MARKED), (2, "nothing here. " * 100 + MARKED), (3, "nothing here."), (4, ""), (5, MARKED + " nothing here." * 2000 + MARKED)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return {r.doc_id: (r.quant, r.qual) for r in registry.queries()["text_scores"](spark, folder).collect()}


def test_figures_beyond_the_first_characters_count(got):
    assert got[1] == got[2] and got[1][0] > 0
    assert got[5][0] > got[1][0]


def test_texts_without_matches_score_nothing(got):
    assert got[3] == got[4] == (0, 0)


def test_matches_sql(spark):
    data = "/root/testdata/sf0.01"
    same(registry.queries()["text_scores"](spark, data), connection(data), registry.oracle_sql()["text_scores"])
