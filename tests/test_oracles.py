"""Every registered query against its SQL, and its plan against a few rules."""

import io
import re
from contextlib import redirect_stdout

import oracle
import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()
SQL = entry.oracle_sql()
CORPUS = re.compile(r"op\d+_|pipeline$")  # tested on their own, if they are there
STREAMS = {"micro_batch", "fan_out", "bounded_table", "dedupe_overlap", "rolling_view", "event_time_windows",
           "file_replay_source", "mask_outages_stream_batches", "mask_outages_sink", "live_view", "live_view_kept", "incremental_append",
           "windows_and_late_rows", "poll_new", "frame_stream"}


@pytest.fixture(scope="module")
def duck(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL and not CORPUS.match(n)])
def test_same_rows_as_sql(spark, data, duck, name):
    assert oracle.difference(QUERIES[name](spark, data), duck, SQL[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in STREAMS and not CORPUS.match(n)])
def test_plan(spark, data, name):
    text = io.StringIO()
    with redirect_stdout(text):
        QUERIES[name](spark, data).explain()
    plan = text.getvalue()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan
    for line in plan.splitlines():
        if "Window [" in line and "windowspecdefinition" in line:
            assert "SinglePartition" not in line


def test_every_library_query_has_sql():
    assert {n for n in QUERIES if not CORPUS.match(n)} <= set(SQL)


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns[:2] == ["__level", "ticker"]
    assert result.count() == 6
