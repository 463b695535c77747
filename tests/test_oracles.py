"""Queries next to their SQL on DuckDB. STAYLENS_ALL=1 runs every query, the default a spread over all areas."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entrypoint

SPREAD = """ag02_daily_series ag06_district_snapshot ag14_district_breakdown ag15_segment_benchmark ag20_seasonality_summary ag22_recommendations ag39_rollup
jn03_map_rows jn05_events_by_district jn07_event_days jn12_calendar_lag_join jn13_nearby_events wn03_gaps wn04_pickup_pace wn11_rolling_features wn16_event_episodes
wn18_short_gap_interpolation ml01_feature_matrix ml07_weighted_average ml10_error_metrics ml13_backtest_report ml16_cross_products ml25_vector_search so01_union_of_sources
so04_exact_dedup sc13_event_type sc17_russian_date sc38_jsonld_event sc41_listing_lines snk04_upsert_events_coalesce src08_hotel_payload src12_import_rows sm07_sessions""".split()
QUERIES, ORACLES = entrypoint.queries(), entrypoint.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("STAYLENS_ALL") else SPREAD


def norm(v):
    return repr(0.0 if v == 0 else v) if isinstance(v, float) else (v if v is None else str(v))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(ORACLES[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(at) == cols
    want = sorted((tuple(norm(r[at[c]]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    assert entrypoint.entry(spark).count() == 5
