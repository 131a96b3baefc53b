from datetime import datetime, timedelta

import pytest

from histolode.plans import registry
from tests.compare import SF, assert_same

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, registry.queries()[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    assert registry.flagship(spark, SF).limit(1).count() == 1


def test_support_rounds_fractions_of_values_as_its_sql(spark, tmp_path):
    # one user's old events are all of one bucket if fractions are cut, of two if they are rounded
    values = [2.0] * 20 + [1.5, 1.4, 0.5, 2.5, -1.5, -0.5]
    rows = [(i, datetime(2024, 1, 1) - timedelta(minutes=i), 1, "new" if i < 20 else "old", v) for i, v in enumerate(values)]
    rows += [(100 + i, datetime(2024, 1, 1) - timedelta(minutes=i), 2, "new" if i < 20 else "old", 0.6 if i < 20 else 1.0) for i in range(21)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "sf").mkdir()
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "sf" / "events.parquet")
    assert_same(spark, registry.queries()["l3_support"], ORACLES["l3_support"], str(tmp_path / "sf"))
