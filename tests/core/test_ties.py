"""Queries against their SQL where the last bit of a sum decides."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
import pytest

from recurva import registry

#: The third (fifth) value is the mean: by sums in order it does not lie above it, by sums from the end it does.
EQUAL_TO_MEAN = [[71.74, 7.89, 62.09, 11.8, 123.91, 95.11], [2.31, 94.73, 125.8, 51.44, 105.33, 252.37]]
ABOVE_MEAN = [
    "islands", "similar_length", "drop_singletons", "occurrence_masks", "interval_births", "sample_prf", "contingency", "united_occurrences",
    "label_scores_weighted", "event_prf_thresholds", "adjusted_information", "barycenter",
]


def checked(spark, folder, values, name):
    """Rows of a query and of its SQL as text, over events that stand in their file from the last to the first."""
    rows = [(k, datetime(2024, 1, 1) + timedelta(minutes=k), user, v) for user, xs in enumerate(values) for k, v in enumerate(xs)]
    events = spark.createDataFrame(rows[::-1], "event_id long, ts timestamp, user_id long, value double")
    events.coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    columns = list(want.columns)
    got = registry.QUERIES[name](spark, str(folder)).select(*columns).collect()
    return sorted(map(repr, map(tuple, got))), sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", ABOVE_MEAN)
def test_values_equal_to_the_mean(spark, tmp_path, name):
    got, want = checked(spark, tmp_path, EQUAL_TO_MEAN, name)
    assert got == want


def test_negative_zero(spark, tmp_path):
    # The last value is the mean but for the last bit of the sum, which leaves it below.
    got, want = checked(spark, tmp_path, [[45.3, 38.34, 51.44, 60.07, 51.37, 8.81, 38.53, 41.98]], "window_znorm")
    assert got == want and "-0.0]" in want[0]
