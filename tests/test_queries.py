"""Every core query: equal to its SQL, or at least runnable on the small tables."""

import os

import duckdb
import pytest

from granthika.plans import core
from tests.oracle import SMALL, agree
from tests.test_operators import written

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
SQL = core.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    agree(spark, core.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(SQL)))
def test_runs(spark, name):
    assert core.queries()[name](spark, SMALL).count() > 0


#: Queries that rank documents for every hundredth document's title.
RANKED = (
    "multi_hop_fusion",
    "rrf_fusion",
    "source_authority",
    "verified_sources",
    "evidence_graph",
    "multi_query_union",
    "section_dedup",
    "source_cards",
    "minmax_hybrid",
    "rerank_threshold",
    "section_expansion",
    "source_list",
)


@pytest.fixture(scope="module")
def many_questions(tmp_path_factory):
    """1,000 documents that all have words of the 200 questions, of which few differ."""
    d = tmp_path_factory.mktemp("tables")
    titles = "['Seed loan, Hill Roads Act', 'Shared well, Village Ponds Act', 'Broken pump, Fair Bargain Act']"
    docs = f"SELECT 20 * row_number() OVER (ORDER BY i, doc_id) AS doc_id, {titles}[1 + (doc_id + i) % 3] AS title, concat('act ', text) AS text, * EXCLUDE (doc_id, title, text) FROM (SELECT * FROM '{SMALL}/documents.parquet' LIMIT 100), range(10) t(i)"
    duckdb.sql(f"COPY ({docs}) TO '{d}/documents.parquet' (FORMAT parquet)")
    for name in ("acts", "embeddings"):
        os.symlink(f"{SMALL}/{name}.parquet", f"{d}/{name}.parquet")
    return str(d)


@pytest.mark.parametrize("name", RANKED)
def test_no_score_is_shuffled(spark, name, many_questions):
    n_docs, n_asked = duckdb.sql(f"SELECT count(*), count(*) FILTER (doc_id % 100 = 0) FROM '{many_questions}/documents.parquet'").fetchall()[0]
    n = written(spark, lambda: agree(spark, core.queries()[name], SQL[name], many_questions))
    assert n < n_docs * n_asked / 2
