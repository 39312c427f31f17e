"""The registered queries of this package over whole tables."""

import pytest

from compare import difference, oracle
from skein.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["root", "file", "name", "line_start"], "p3_found": ["root", "file"], "p4_found": ["id"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "subject"],
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    run, sql = QUERIES[name]
    got = run(spark, DIR).toPandas()
    if sql:
        assert difference(got, oracle(DIR).sql(sql).df()) == ""
    if name in COLUMNS:
        assert list(got.columns) == COLUMNS[name] and (name == "p7_ids" or not got.duplicated().any()) and len(got)
