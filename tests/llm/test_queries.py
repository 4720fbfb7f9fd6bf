"""The registered queries against their SQL, and the pipeline stage by stage."""

import pytest

from oracle import duck, key, norm
from postmeter.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_query_against_sql(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=key)
    cursor = duck(SF).execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=key)
    assert sorted(names) == columns and got == want


def test_pipeline(spark):
    import corpus_pipeline as pipeline
    from postmeter.llm import decontaminate, packing, shared, simhash, substrings, toxicity

    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs, left = source, [source.count()]
    for name, stage in pipeline.STAGES:
        out, _ = shared.stored(stage(spark, docs, SF))
        left.append(out.count())
        if name != "packing":
            assert out.columns == source.columns
        if name == "simhash":
            classes = simhash.simhash_classes(docs)
            assert left[-1] == classes.select("component_id").distinct().count()
        if name == "substrings":
            gone = substrings.dedup_substrings(docs).filter("n_bytes > 0 AND n_removed = n_bytes").count()
            assert left[-1] == left[-2] - gone and out.filter("n_chars <> length(text)").count() == 0
        if name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert decontaminate.contamination(out, bench).filter("contaminated").count() == 0
        if name == "packing":
            want = packing.pack(docs)
            assert left[-1] == want.count() and out.columns == want.columns
        docs = out
    assert left[1] < left[0] and left[2] < left[1] and left[4] < left[3]
    empty = source.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    assert toxicity.SAMPLE_ROWS > 0 and pipeline.ORACLE_SQL is None
