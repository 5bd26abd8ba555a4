"""Every llm query: equal to its SQL, or at least runnable with its defined columns."""

import os

import pytest

from granthika.llm.registry import oracle_sql, queries
from tests.oracle import SMALL, agree

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
COLUMNS = {
    "p1_found": ["src", "row_id", "kind", "value"], "p2_found": ["src", "row_id", "lang"], "p3_found": ["request_id", "kind", "line_no", "item"],
    "p4_found": ["session_id", "reason"], "p5_found": ["src", "a_id", "b_id"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, name):
    agree(spark, queries()[name], oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    df = queries()[name](spark, SMALL)
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables(spark, name, tmp_path):
    for p in os.listdir(SMALL):
        spark.read.parquet(f"{SMALL}/{p}").limit(0).write.parquet(str(tmp_path / p))
    assert queries()[name](spark, str(tmp_path)).count() == 0
