import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables")
def test_stages_follow_each_other(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in c.STAGES[:-1]:
        docs = c.store(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        if name != "mixture":
            assert docs.count() <= rows
            rows = docs.count()
    assert docs.count() == c.STAGES[-1][1](spark, docs, SF).count()
    assert c.run(spark, SF).count() == docs.count()
