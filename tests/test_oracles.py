"""Every query against its oracle SQL in DuckDB on the smallest tables."""

import datetime
import decimal
import math
import os

import pytest

from tidemark.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(cols, found):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(list(want.columns), want.fetchall())


#: Queries without SQL, and where their values are held against direct computations.
VALUE_TESTS = {
    "test_simulation": "pilot_fit dgp_reduced dgp_coherent sim_forecasts sim_measure sim_summarize critical_calibration effect_calibration ordering_audit conditional_power lrv_upper_boot",
    "test_behaviour": "mc_iid_block",
    "test_values": "t_p_ci_r2 forecast_models freeze_manifest bundle_manifest",
}


def test_every_other_query_has_a_value_test():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {n for names in VALUE_TESTS.values() for n in names.split()}
    here = os.path.dirname(__file__)
    for module, names in VALUE_TESTS.items():
        text = open(os.path.join(here, f"{module}.py")).read()
        assert all(f'"{n}"' in text for n in names.split()), module


@pytest.mark.parametrize("name", ["entry_session_rv", "session_valid", "agg_session", "resample_m5", "trade_R", "london_first_breach", "grid_densify"])
def test_the_session_s_zone_changes_nothing_and_stays(spark, name):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = registry.QUERIES[name](spark, SF)
        assert spark.conf.get("spark.sql.session.timeZone") == "America/New_York"
        away = rows(df.columns, df.collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = registry.QUERIES[name](spark, SF)
    assert away == rows(df.columns, df.collect())
