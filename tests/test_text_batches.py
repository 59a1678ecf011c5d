"""Queries with Python functions over whole texts bound their Arrow batches, whatever a partition holds."""

import pytest
from factweir import shipping
from factweir.plans import registry

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("name", ["chunk_plan", "claims_followup", "excerpt_retry", "letter_places", "decoded_bodies", "source_excerpts", "budget_shares", "page_text"])
def test_batches_are_bounded(spark, data, name):
    before = {k: spark.conf.get(k) for k in (ROWS, BYTES)}
    try:
        spark.conf.set(ROWS, "10000")
        spark.conf.set(BYTES, "64m")
        registry.queries()[name](spark, data)
        assert int(spark.conf.get(ROWS)) <= shipping.TEXT_ROWS and int(spark.conf.get(BYTES).rstrip("b")) <= shipping.TEXT_BYTES
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
