"""Queries without SQL on the test tables, against direct computations."""

import datetime
import hashlib
import math
import os
from statistics import NormalDist

import numpy as np
import pytest

from tidemark.operators import forecast as FC
from tidemark.plans import registry
from tidemark.plans.statistics import logs
from tidemark.sources import files as FS
from tidemark.sources.market import daily, table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_regression_table_with_robust_errors(spark):
    x = logs(spark, SF).orderBy("date").toPandas()
    z, y = np.column_stack([np.ones(len(x)), x["lag_ll"], x["la"]]), x["ll"].to_numpy()
    inv = np.linalg.inv(z.T @ z)
    beta = inv @ z.T @ y
    e = y - z @ beta
    u = z * e[:, None]
    meat = u.T @ u
    for lag in range(1, 6):
        g = u[lag:].T @ u[:-lag]
        meat += (1 - lag / 6) * (g + g.T)
    se = np.sqrt(np.diag(inv @ meat @ inv))
    r2 = 1 - (e @ e) / ((y - y.mean()) @ (y - y.mean()))
    got = {r["term"]: r for r in registry.QUERIES["t_p_ci_r2"](spark, SF).collect()}
    for k, term in enumerate(("const", "lag_ll", "la")):
        r, t = got[term], beta[k] / se[k]
        assert (r["beta"], r["se"], r["t"]) == (pytest.approx(beta[k]), pytest.approx(se[k]), pytest.approx(t))
        assert r["p"] == pytest.approx(math.erfc(abs(t) / math.sqrt(2)), abs=1e-9) and r["r2"] == pytest.approx(r2) and r["n"] == len(y)
        q = NormalDist().inv_cdf(0.975)
        assert (r["ci_low"], r["ci_high"]) == (pytest.approx(beta[k] - q * se[k]), pytest.approx(beta[k] + q * se[k]))


def direct_forecasts(x, until, least):
    """Refits by least squares, one day after the other."""
    x = x[x.eligible].sort_values("date").reset_index(drop=True)
    out = {}
    for name, cols in FC.MODELS.items():
        z, y = np.column_stack([np.ones(len(x)), *[x[c] for c in cols]]), x["log_l"].to_numpy(float)
        for t in range(len(x)):
            early = x.date[t] <= until
            rows = [k for k in range(t if early else len(x)) if not math.isnan(y[k]) and (early or x.date[k] <= until)]
            if len(rows) >= least:
                b = np.linalg.lstsq(z[rows], y[rows], rcond=None)[0]
                out[x.date[t], name] = ("expanding" if early else "frozen", max(1e-12, np.exp(z[t] @ b) * np.exp(y[rows] - z[rows] @ b).mean()))
    return out


def test_forecast_models(spark):
    ledger = FC.ledger(daily(spark, SF))
    until = datetime.date(1999, 12, 31)
    want = direct_forecasts(ledger.toPandas(), until, 300)
    got = {(r["date"], r["model"]): (r["mode"], r["forecast"]) for r in registry.QUERIES["forecast_models"](spark, SF).collect()}
    assert got.keys() == want.keys() and len(got) > 400
    assert all(got[k][0] == mode and got[k][1] == pytest.approx(v, rel=1e-6) for k, (mode, v) in want.items())


def test_series_are_forecast_apart(spark):
    from pyspark.sql import functions as F

    ledger = FC.ledger(daily(spark, SF))
    until = datetime.date(1999, 12, 31)
    two = ledger.withColumn("feed", F.lit("a")).unionByName(ledger.withColumn("feed", F.lit("b")).withColumn("log_l", F.col("log_l") + 1))
    got = {}
    for r in FC.forecasts(two, until, 300, series="feed").collect():
        got.setdefault(r["series"], {})[r["date"], r["model"]] = r["forecast"]
    one = {(r["date"], r["model"]): r["forecast"] for r in FC.forecasts(ledger, until, 300).collect()}
    assert got["a"].keys() == got["b"].keys() == one.keys()
    assert all(got["a"][k] == pytest.approx(v) and got["b"][k] == pytest.approx(math.e * v) for k, v in one.items())


def digests(path):
    folder = path.removeprefix("file://").removeprefix("file:")
    out = []
    for name in sorted(os.listdir(folder)):
        if name.startswith("part-"):
            raw = open(os.path.join(folder, name), "rb").read()
            out.append((len(raw), hashlib.sha256(raw).hexdigest()))
    return out


def test_manifests_hold_the_files_bytes_and_digests(spark, monkeypatch):
    staged, real = [], FS.staged
    monkeypatch.setattr(FS, "staged", lambda *a, **k: staged.append(real(*a, **k)) or staged[-1])
    frozen = registry.QUERIES["freeze_manifest"](spark, SF).collect()
    assert [(r["bytes"], r["sha256"]) for r in frozen] == digests(staged[-1]) and {r["changes"] for r in frozen} == {0}
    lines = table(spark, SF, "nation").count() + 1
    folder = staged[-1].removeprefix("file://")
    assert sum(sum(1 for _ in open(os.path.join(folder, f))) for f in os.listdir(folder) if f.startswith("part-")) == lines
    bundle = registry.QUERIES["bundle_manifest"](spark, SF).head()
    files = digests(staged[-1])
    assert (bundle["files"], bundle["bytes"], bundle["digests"]) == (len(files), sum(n for n, _ in files), len({h for _, h in files}))


@pytest.fixture
def unsteady(spark, monkeypatch):
    """A function that makes prices whose last bits are others each time they are computed, as sums' are that add blocks in the order they come in."""
    import random

    from pyspark.sql import functions as F

    from tidemark.sources import market

    spark.conf.set("spark.sql.exchange.reuse", "false")
    shaken = F.udf(lambda x: x * (1 + random.random() * 1e-13), "double").asNondeterministic()
    real = market.table

    def table_of(spark, sf, name):
        return real(spark, sf, name).withColumn("o_totalprice", shaken("o_totalprice")) if name == "orders" else real(spark, sf, name)

    yield lambda: monkeypatch.setattr(market, "table", table_of)
    spark.conf.unset("spark.sql.exchange.reuse")


def test_changes_are_no_last_bits_of_sums(spark, unsteady):
    want = {r["date"] for r in registry.QUERIES["dict_value_change"](spark, SF).collect()}
    unsteady()
    assert {r["date"] for r in registry.QUERIES["dict_value_change"](spark, SF).collect()} == want


def test_ranks_survive_last_bits_of_sums(spark, unsteady):
    from tidemark.functions.moments import average_rank

    want = registry.QUERIES["circ_shift_perm"](spark, SF).collect()
    unsteady()
    assert registry.QUERIES["circ_shift_perm"](spark, SF).collect() == want
    from tidemark.sources import market

    rows = market.table(spark, SF, "orders").limit(50)
    assert average_rank(rows, "o_totalprice", "rank").where("rank IS NULL").count() == 0
