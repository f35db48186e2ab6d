"""Light registered queries against their SQL on the smallest tables; ``oracle.py`` runs all."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
LIGHT = (
    "valid_urls rejected_urls first_seen_urls duplicate_urls batch_gate invalid_lists request_bodies header_lookup "
    "body_kept error_kinds interference final_response verdicts fallback progress file_names extensions "
    "allocated_names titles tokens blocks resolved_links citation_numbers markdown_full fit_notes page_text languages "
    "origins proxy_check live_artifacts stream_intake stream_intake_once stream_counts stream_closed_counts stream_progress stream_retention stream_rejects documents markdown_images fit_scored text_helpers format_outcomes prechecks custom_rules unpaired"
).split()


@pytest.mark.parametrize("name", LIGHT)
def test_query(spark, name):
    key = f"q_{name}"
    assert compare(spark, connect(FOLDER), key, entry.queries()[key], entry.oracle_sql()[key], FOLDER) is None


def test_every_query_of_the_library_has_an_oracle():
    own = {name for name in entry.queries() if name.startswith("q_")}
    assert own == {name for name in entry.oracle_sql() if name.startswith("q_")}
    assert set(entry.oracle_sql()) <= set(entry.queries())
