"""Queries and their SQL agree where contributions tie and where a score lies on its threshold."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture
def agree(spark, tmp_path):
    def run(name: str, rows: list[tuple]) -> list[tuple]:
        """The rows of a query over events ``(kind, hour, value, k)``, which its SQL has to give as well."""
        con = duckdb.connect()
        con.execute("""CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE,
            props VARCHAR)""")
        for i, (kind, hour, value, k) in enumerate(rows, 1):
            con.execute("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", [i, f"2024-01-01 {hour:02}:30:00", i, kind, value, f'{{"k": {k}}}'])
        con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
        got = entry.queries()[name](spark, str(tmp_path))
        found = sorted(map(tuple, got.collect()))
        assert found == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall())
        return found

    return run


def test_contributions_of_equal_size_rank_by_name(agree):
    # 0.03 * 100 = 0.05 * 60; 0.03 * 10 = 0.05 * 6 and less than 3.7
    rows = [("click", 1, 100.0, 60), ("click", 1, 101.0, 60), ("click", 1, 99.0, 60), ("click", 1, 10.0, 6)]
    assert [r[-1] for r in agree("alert_stream", rows)] == ["k", "value", "k"]


def test_scores_on_the_threshold_are_alerts(agree):
    # log-odds of -3.5 + 0.025 * value + 0.055 * k + 0.005 * hour: -2e-16, whose score is 0.5, then below and above
    rows = [("signup", 0, 82.8, 26), ("signup", 0, 82.7, 26), ("signup", 0, 82.9, 26)]
    assert agree("routed_score_not_finite", rows) == [("mqtt", 3, 0, 2)]
