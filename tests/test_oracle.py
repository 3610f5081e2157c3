"""Registered queries against their DuckDB statements, and the contract of the entry file."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, duck

CHECKED = [
    "settled_spans", "redacted_documents", "redacted_json", "scanned_sends", "redacted_files",
    "analyzed_prompts", "injected_guidance", "command_verdicts", "merged_findings", "routed_requests",
    "translated_requests", "traffic_log", "conv_turns", "unchecked_turns", "turn_dedupe", "picked_replies",
    "per_surface", "config_upserts", "event_csv_lines", "stream_redact_sorted", "stream_redact",
    "pending_findings_stream", "series_stream",
]


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    own = {name for name in queries if not name.startswith("op") and name != "pipeline"}
    assert own <= set(sql)
    assert entry.entry(spark).columns == ["doc_id", "source", "lang", "redacted", "matched", "pii_detected"]


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, sf, name):
    con = duck(sf)
    outcome = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], sf)
    assert outcome.startswith("ok"), outcome
