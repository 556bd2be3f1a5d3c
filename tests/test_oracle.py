"""A sample of registered queries against their DuckDB oracle at sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from pliego.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
NAMES = [
    "fn18_sanitize_template_path", "fn25_sanitize_error_message", "fn10_sortable_id", "v9_message_status",
    "rs1_flatten_outputs", "rn8_render_text", "rn6_render_html", "rs10_collate_results", "so3_decode_record",
    "j5_fresh_cache_lookup", "rn11_generate_documents", "rn6_many_templates", "rs6_flatten_deep", "rn4_text_kinds", "v3_data_kinds",
    "v8_check_result_counts", "so4_decode_binary", "sk2_write_local_copy", "st1_run_stream",
]


def norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cols = df.columns
    got = sorted(tuple(norm(r[c]) for c in sorted(cols)) for r in df.collect())
    res = con.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == sorted(cols)
    idx = [ocols.index(c) for c in sorted(cols)]
    exp = sorted(tuple(norm(r[i]) for i in idx) for r in res.fetchall())
    assert got == exp


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["msg_id", "ok", "error_code", "error_message", "documents", "response"]
    assert df.count() > 0
