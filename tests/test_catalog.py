import pytest

from brinelog.plans import catalog


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_same_rows_as_sql(matches, name):
    matches(catalog.queries()[name], catalog.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["sensor_id", "ts", "event_id", "consecutive_count"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
