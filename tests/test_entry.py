import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from compare import rows, views
from stratacel.queries import documents, files, general, layers, reference

SMALL = "/root/testdata/sf0.001"
MODULES = (general, reference, documents, layers, files)
CHECKED = {name: (m.QUERIES[name], sql) for m in MODULES for name, sql in m.ORACLE.items()}
OTHERS = {name: q for m in MODULES for name, q in m.QUERIES.items() if name not in m.ORACLE}


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_subpackage():
    code = "import sys; sys.modules['stratacel.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('p2') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(entry.__file__), check=True)
    assert out.stdout.split() == [str(len(CHECKED) + len(OTHERS)), "False"]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    return views(SMALL)


@pytest.mark.parametrize("name", list(CHECKED))
def test_query_equals_its_sql(spark, duck, name):
    query, sql = CHECKED[name]
    got, want = query(spark, SMALL).toPandas(), duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", list(OTHERS))
def test_query_runs(spark, duck, name):
    frame = OTHERS[name](spark, SMALL)
    assert frame.count() > 0 and len(set(frame.columns)) == len(frame.columns)


def test_flagship(spark, duck):
    assert entry.entry(spark).count() > 0
