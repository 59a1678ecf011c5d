from collections import defaultdict

import corpus_pipeline
import pytest
from factweir.llm import entries

from tests.llm.brute import HOSTILE, components, docs

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    """Every stage's rows, each from what the one before wrote."""
    frame, out = spark.read.parquet(f"{data}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "rows")
        stage(spark, frame, data).write.parquet(path)
        frame = spark.read.parquet(path)
        out[name] = frame.toPandas()
    return out


def test_stages_and_columns(stages):
    names = list(stages)
    assert names == ["language ID", "quality classifier", "n-gram Jaccard join", "mixing sources", "best-fit packing"]
    assert all(sorted(stages[n].columns) == sorted(COLUMNS) for n in names[:-1])
    sizes = [len(stages[n]) for n in names[:-1]]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0


def test_one_document_of_each_group_stays(stages):
    before, after = stages["quality classifier"], stages["n-gram Jaccard join"]
    want = {c for _, c in components(list(zip(before.doc_id, before.text, strict=True)), 5, 80).values()}
    assert set(after.doc_id) == want


def test_clean_documents_stay(spark, data, stages):
    labels = spark.read.parquet(f"{data}/labels.parquet").toPandas().set_index("doc_id")
    first = stages["language ID"]
    kept = set(stages["quality classifier"].doc_id)
    marked = first[first.doc_id.isin(labels.index)].doc_id
    good = [i for i in marked if labels.quality[i] == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    before, after = set(stages["n-gram Jaccard join"].doc_id), set(stages["mixing sources"].doc_id)
    clean = [i for i in before if i in labels.index and labels.quality[i] == 1 and labels.toxic[i] == 0]
    assert sum(i in after for i in clean) >= 0.97 * len(clean)


def test_bad_documents_go(spark):
    data = "/root/testdata/sf0.01"
    kept = corpus_pipeline.quality(spark, spark.read.parquet(f"{data}/documents.parquet"), data)
    got = kept.join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").groupBy("quality").count().toPandas().set_index("quality")["count"]
    assert got.get(1, 0) >= 335 and got.get(0, 0) <= 6  # of 341 and 58


def test_packing_holds_every_document(stages):
    packed = stages["best-fit packing"]
    assert set(packed.doc_id) == set(stages["mixing sources"].doc_id)
    by = defaultdict(list)
    for r in packed.itertuples():
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096


def test_run_is_the_chain_of_stages(spark, data, stages):
    got = corpus_pipeline.run(spark, data).toPandas()
    want = stages["best-fit packing"]
    key = ["doc_id", "piece", "start", "length"]
    assert sorted(got[key].itertuples(index=False)) == sorted(want[key].itertuples(index=False))


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_awkward_rows(spark, data, stage):
    rows = [*enumerate(HOSTILE), (None, None), (None, "some more words here"), (3, "word"), (3, "word")]
    f = corpus_pipeline.STAGES[stage][1]
    got = f(spark, docs(spark, rows), data).collect()
    assert len(got) >= (1 if stage in (2, 3, 4) else 0)
    assert f(spark, docs(spark, []), data).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_clashing_columns(spark, data, stage):
    """Columns that differ in case only, or look like work columns, pass through untouched."""
    plain = spark.read.parquet(f"{data}/documents.parquet")
    odd = plain.withColumnsRenamed({"n_chars": "TEXT", "source": "Doc_ID"}).selectExpr("*", "'k' as _key", "'c' as _c0", "1 as ROW")
    f = corpus_pipeline.STAGES[stage][1]
    want, got = f(spark, plain, data), f(spark, odd, data)
    if stage < 4:
        assert got.columns == odd.columns
    shown = ["doc_id"] if stage < 4 else ["doc_id", "piece", "start", "length"]
    rows = lambda df: sorted(tuple(r[df.columns.index(c)] for c in shown) for r in df.collect())
    assert rows(got) == rows(want)


def test_rates_reach_the_bound_by_the_fit(spark, data, stages):
    from factweir.llm import mixing

    docs_ = spark.createDataFrame(stages["n-gram Jaccard join"])
    model = mixing.learn(docs_, spark.read.parquet(f"{data}/labels.parquet"))
    rates = mixing.mix(docs_, model, corpus_pipeline.TARGETS, max_rate=1.0, reach=corpus_pipeline.REACH).toPandas()
    assert (rates.rate[rates.p_clean > 0.9] > 0.999).all() and rates.rate.max() <= 1.0


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in entries.queries()) == list(range(1, 14))
