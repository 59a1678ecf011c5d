"""Rows of the pipeline are judged one by one, whatever their ids."""

import corpus_pipeline

from tests.llm.brute import docs

A, B, C = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "gamma"))


def texts(frame):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in frame.collect())


def test_null_and_repeated_ids_keep_distinct_texts(spark, data):
    rows = [(None, A), (None, B), (None, B + " more"), (None, B), (7, A), (7, C), (7, C), (9, C + " end")]
    got = texts(corpus_pipeline.near_duplicates(spark, docs(spark, rows), data))
    assert [(null, i) for null, i, _ in got] == [(False, 7), (False, 7), (True, 0)]
    assert [t for *_, t in got][:2] == [A, C] and got[2][2] in (B, B + " more")


def test_near_copies_without_an_id_are_linked(spark, data):
    got = texts(corpus_pipeline.near_duplicates(spark, docs(spark, [(None, A), (None, A + " x"), (None, C)]), data))
    assert len(got) == 2


def test_a_good_row_readmits_no_rejected_row_of_its_id(spark):
    frame = docs(spark, [(None, A), (None, B), (4, A), (4, C)])
    good = frame.where(frame["text"] == A)
    assert texts(corpus_pipeline._kept(frame, corpus_pipeline._as_id(good))) == [(False, 4, A), (True, 0, A)]
