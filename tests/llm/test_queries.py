import os

import pytest

from compare import rows, views
from stratacel.llm import queries

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "p2_found": {"cel_id_lo": "bigint", "cel_id_hi": "bigint"},
    "p3_found": {"doc_id": "string", "source_layer_id": "bigint", "first_frame": "int", "last_frame": "int"},
    "p4_found": {"layer_key_lo": "bigint", "layer_key_hi": "bigint"},
    "p7_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p8_found": {"doc_id": "bigint", "start_char": "bigint", "end_char": "bigint"},
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_runs_over_its_whole_tables(spark, name):
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    out = queries.QUERIES[name](spark, SMALL)
    if name in COLUMNS:
        assert dict(out.dtypes) == COLUMNS[name]
        found = [tuple(r) for r in out.collect()]
        assert len(found) == len(set(found)) > 0
    else:
        assert out.count() > 0


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), views(SMALL).execute(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
