"""Queries on tables repeated with shifted keys: the same points and boxes many times over, against their SQL."""

import os

import pytest
from helpers import SF, joined_rows, same_rows

from tidewatch.plans import registry

KEYS = {"events": "event_id", "orders": "o_orderkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    import duckdb

    place, con = tmp_path_factory.mktemp("crowded"), duckdb.connect()
    for name in os.listdir(SF):
        table, path = name.removesuffix(".parquet"), f"{place}/{name}"
        more = f"replace ({KEYS[table]} + 30000 * copy as {KEYS[table]})" if table in KEYS else ""
        source = f"'{SF}/{name}', range({15 if more else 1}) c(copy)"
        con.execute(f"copy (select * exclude (copy) {more} from {source}) to '{path}' (format parquet)")
        con.execute(f"create view {table} as select * from '{path}'")
    return str(place), con


@pytest.mark.parametrize("name", ["ais_nearest_10km", "ais_nearest_windowed", "dark_summary"])
def test_matches_grow_in_proportion(name, crowded, spark):
    """Detections and ships 15 times over: their pairs within the radius are 225 times as many, what joins give is not."""
    d, con = crowded
    df = registry.QUERIES[name](spark, d)
    same_rows(df, con, registry.ORACLES[name])
    assert joined_rows(df) <= 1500 * 15


@pytest.mark.parametrize("name", ["haversine_pairs", "iou_pairs"])
def test_pairs_are_joined_by_groups(name, crowded, spark):
    """The result has a row a pair; what is joined and computed is a row a pair of points or of different boxes."""
    d, con = crowded
    df = registry.QUERIES[name](spark, d)
    same_rows(df, con, registry.ORACLES[name])
    assert 5 * joined_rows(df) < df.count()
