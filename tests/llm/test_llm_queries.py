"""Registered corpus queries against their SQL, or their columns where SQL can't say it."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from tenderflow.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
#: Fixed columns of the queries that have no SQL; the operators' own tests compare the values.
COLUMNS = {
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op4_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op5_quality": ["doc_id", "quality", "kept"],
    "op6_simhash": ["doc_id", "fingerprint", "component_id"],
    "op11_token_alignment": [
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
    ],
    "op9_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
}


def test_each_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) == set(ORACLE_SQL) | set(COLUMNS)
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(name, spark):
    assert compare(QUERIES[name], ORACLE_SQL[name], spark, SMALL, connect(SMALL))["problem"] is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_rows_and_columns(name, spark):
    frame = QUERIES[name](spark, SMALL)
    assert set(COLUMNS[name]) <= set(frame.columns)
    docs = {r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = [r.doc_id for r in frame.collect()]
    assert set(found) == docs and (name == "op4_packing" or len(found) == len(docs))
