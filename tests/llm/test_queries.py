"""Registered queries against their DuckDB SQL, and the contract's columns."""

import duckdb
import pytest

from attrition.llm.queries import QUERIES
from attrition.sources.tables import TABLES

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
            "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op2": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op3": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op4": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op5": {"doc_id": "bigint"},
    "op6": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op7": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint",
            "base_score": "double", "score": "double"},
    "op8": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op9": {"page_id": "bigint", "text": "string"},
    "op10": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op11": {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint",
             "cost": "bigint", "audit": "string", "repaired_sha256": "string"},
    "op12": {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint",
             "runs_sha256": "string", "collapsed_sha256": "string"},
    "op13": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
}


@pytest.mark.parametrize("q", QUERIES, ids=lambda q: q.name)
def test_columns_and_oracle(spark, q):
    df = q.build(spark, SF)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[q.name.split("_")[0]]} == COLUMNS[q.name.split("_")[0]]
    rows = df.collect()
    assert rows
    if q.sql:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        res = con.execute(q.sql)
        names = [c[0] for c in res.description]
        assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(res.fetchall(), key=repr)
        assert sorted(names) == sorted(df.columns)
