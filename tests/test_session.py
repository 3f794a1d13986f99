"""Stored tables: which are deleted, and when."""

import os

import pytest

from gradewell.session import discard, materialize, temporary


def there(table):
    return os.path.exists(table.scratch)


def test_blocks_delete_what_they_do_not_keep(spark):
    df = spark.range(3)
    with temporary(spark) as keep:
        gone, kept = materialize(df), keep(materialize(df))
        with temporary(spark) as keep_inside:
            inner, passed = materialize(df), keep_inside(materialize(df))
        assert not there(inner) and there(passed) and there(gone)
    assert not there(gone) and not there(passed) and there(kept) and kept.count() == 3
    discard(kept, df)
    assert not there(kept)


def test_blocks_that_fail_leave_nothing(spark):
    with pytest.raises(ValueError), temporary(spark) as keep:
        table = materialize(spark.range(3))
        keep(spark.range(2))
        raise ValueError
    assert not there(table)


def test_tables_with_a_path_stay(spark, tmp_path):
    with temporary(spark):
        table = materialize(spark.range(3), str(tmp_path / "own"))
        discard(table)
    assert table.count() == 3
