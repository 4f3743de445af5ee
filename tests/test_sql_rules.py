"""Registered queries next to their SQL on small tables with the cases that the shared ones lack."""

from datetime import datetime, timedelta

import duckdb
import pytest

from strandline.queries import ORACLES, QUERIES
from tests.compare import compare

START = datetime(2024, 1, 1)


def _events(spark, folder, rows):
    """Rows (event_id, seconds, event_type, value) as the events table."""
    made = [(i, START + timedelta(seconds=s), i % 3, kind, v, "{}") for i, s, kind, v in rows]
    df = spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["transform_log", "series_arithmetic"])
def test_zeros_infinities_and_equal_times(spark, tmp_path, name):
    rows = [(1, 10, "click", 152.38), (2, 20, "click", 0.0), (3, 30, "click", 1e200), (4, 40, "click", -3.5), (5, 2000, "click", 8.0)]
    # no quotient, one too large, several rows of one time on either side of a click and at its own time
    rows += [(6, 10, "purchase", 0.0), (7, 21, "purchase", 1e-200), (8, 31, "purchase", 1e200), (9, 39, "purchase", 2.0), (10, 39, "purchase", 7.0)]
    rows += [(i, 2001, "purchase", float(i)) for i in range(20, 40)] + [(i, 1999, "purchase", float(i)) for i in range(60, 40, -1)]
    con = _events(spark, str(tmp_path), rows)
    assert compare(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name]) == ""
