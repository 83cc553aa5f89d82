"""Every registered query on the smallest test tables: columns, and rows that must be there."""

import os

import pytest

from basalt.llm import queries

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": {"id_a": "string", "id_b": "string"},
    "p2_found": {"chunk_id": "string", "line_no": "bigint"},
    "p3_found": {"path": "string"},
    "p4_found": {"src": "string", "id_a": "string", "id_b": "string"},
    "p5_found": {"path": "string"},
    "p7_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p8_found": {"doc_id": "bigint"},
}

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, DIR)
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name] and df.columns == list(COLUMNS[name])
    rows = df.collect()
    assert len(rows) == len(set(map(str, rows)))
    if name == "p6_packing":
        assert {r.doc_id for r in rows} == {r.doc_id for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id").collect()}


def cell(v):
    return "" if v is None or str(v) in ("<NA>", "nan") else str(int(v)) if hasattr(v, "dtype") and v.dtype.kind in "iub" or isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    where = DIR.replace("0.001", "0.01")
    con = duckdb.connect()
    for t in os.listdir(where):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{where}/{t}'")
    got, want = queries.queries()[name](spark, where).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(want)
    rows = lambda df: sorted(tuple(map(cell, r)) for r in df[cols].itertuples(index=False))
    assert rows(got) == rows(want)
