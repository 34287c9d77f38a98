"""The corpus queries with SQL on the fixture tables, and the columns of the others."""

import pytest

from heddle.llm import queries, sql
from tests import oracle

pytestmark = pytest.mark.skipif(not oracle.there(), reason="no fixture tables")


@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_equals_sql(spark, name):
    oracle.compare(spark, queries.QUERIES[name], sql.ORACLE_SQL[name])


COLUMNS = {
    "op1_ctw": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op2_quality": "doc_id held_out score predicted",
    "op5_jaccard_join": "doc_id n_shingles component_id",
    "op6_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op8_suffix_array": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op9_toxicity": "doc_id held_out score predicted",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = queries.QUERIES[name](spark, oracle.SF)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    assert df.count() == spark.read.parquet(f"{oracle.SF}/documents.parquet").count()


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 1 + len(queries.QUERIES)))
