"""Queries against their SQL on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
SOME = ["FN-01_name", "FN-12_classify_tax_id", "RL-02_dates", "RL-08_po_math", "RL-13_tax_ids", "RL-15_report", "RL-21_quality_report", "RL-25_summary", "TR-01_repair", "TR-03_changed_fields", "JN-04_strongest", "WN-02_damper", "SO-01_order", "AG-02_match_summary", "AG-04_net_impact", "AG-10_run", "AG-14_vote", "SC-05_override", "WN-05_split", "RP-03_chat", "PIPE-01_duplicate_decision"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


def rows(values):
    return sorted(tuple("" if v is None else f"{float(v):.6f}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v) for v in r) for r in values)


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    import __spark_entry__ as e

    df, rel = e.queries()[name](spark, SF), duck.sql(e.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.collect()) == rows(rel.select(*[f'"{c}"' for c in df.columns]).fetchall())


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
