"""The registered training-data queries that SQL can express, against DuckDB."""

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck, spark_pdf
from tabsieve.llm import queries


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_names():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries()) and set(queries.ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, con, sf, name):
    ok, said = compare(spark_pdf(E.queries()[name](spark, sf)), con.execute(queries.ORACLE[name]).df())
    assert ok, said


def test_score_and_leak_queries(spark, sf, sf_rows):
    scores = E.queries()["op1_stupid_backoff"](spark, sf).collect()
    assert sorted(r.doc_id for r in scores) == sorted(r[0] for r in sf_rows)
    text = {r[0]: r[1] for r in sf_rows}
    assert all(r.log_score <= 0 and r.n_words == len(text[r.doc_id].split()) for r in scores)
    leaks = E.queries()["op6_bm25_wand_decontamination"](spark, sf)
    assert leaks.columns[:2] == ["doc_id", "item_id"] and leaks.count() > 0
