"""Every query against its SQL, on the smallest tables."""

import pytest
from helpers import SF, same_rows

from tidewatch.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(name, spark, duck):
    same_rows(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name])


def test_every_query_is_checked():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"detect_scene_e2e"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1500
    assert set(entry.oracle_sql()) <= set(entry.queries())
