"""The contract's queries: their columns, and their rows against DuckDB where SQL can express them."""

import duckdb
import pytest

from expodex.llm import queries

COLUMNS = {
    "op1": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op2": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op3": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op4": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op5": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op6": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op7": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op8": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op11": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op12": {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"},
    "op13": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"},
    "op10": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_columns(spark, data, name):
    have = dict(queries.queries()[name](spark, data).dtypes)
    assert COLUMNS[name.partition("_")[0]].items() <= have.items()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = queries.queries()[name](spark, data)
    cur = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r)) for r in got.select(names).collect())
