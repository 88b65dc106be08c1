"""Stored intermediate tables."""

from __future__ import annotations

import os

from tabloom.functions.storage import remove, staged


def test_remove_deletes_the_table_and_no_other(spark):
    one, other = staged(spark.range(5), "one"), staged(spark.range(6), "other")
    assert os.path.isdir(one._staged_path)
    remove(one)
    assert not os.path.exists(one._staged_path) and other.count() == 6


def test_spread_bounds_the_rows_of_a_task(spark, monkeypatch):
    """A large table read in few tasks is cut so that no task holds more than its share of rows."""
    from tabloom.functions import storage

    monkeypatch.setattr(storage, "MOST_ROWS_PER_TASK", 10)
    rows = spark.range(1000).coalesce(1)
    spread = storage.spread(rows, 1000, per_task=10_000)
    assert spread.rdd.getNumPartitions() == 100
    assert max(spread.rdd.glom().map(len).collect()) <= 10 * 2 and spread.count() == 1000
