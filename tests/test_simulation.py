"""The simulation's queries, executed on a small design and held against direct computations."""

import itertools
import math
import os

import numpy as np
import pytest

from tidemark.operators import simulate as SIM
from tidemark.plans import registry
from tidemark.plans import simulation as PS
from tidemark.sources.market import daily

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
LINE = np.array([-0.5, 0.1, 0.1, 0.1, 0.1])
PILOT = {"ca": LINE, "cl": LINE, "cr": LINE, "theta": 0.5, "residuals": np.random.default_rng(1).normal(size=(100, 4)) * 0.2, "start": (-1.0, 0.0)}
SMALL = SIM.Design(burn=20, train=60, scored=60, sizes=(30, 60), batch=10)
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def simulated(paths=5, effect=1.0, coherent=True, design=SMALL, p=PILOT, block=5):
    return SIM.generate(p, design, np.arange(paths), block, effect, (7, 1), coherent)


def test_states_are_the_path_s_own_past():
    g = simulated()
    assert np.array_equal(g["s1"][:, 1:], g["l"][:, :-1]) and np.array_equal(g["s2"][:, 1:], g["d"][:, :-1])
    v = np.exp(g["l"])
    for t in range(25, 120):
        assert np.allclose(g["s3"][:, t], np.log(v[:, t - 5 : t].mean(1))) and np.allclose(g["s4"][:, t], np.log(v[:, t - 20 : t].mean(1)))


def test_days_contain_their_sessions_in_the_coherent_generator_alone():
    g = simulated()
    assert (g["d"] > g["l"]).all() and (g["d"] > g["a"]).all() and np.allclose(np.exp(g["d"]), np.exp(g["a"]) + np.exp(g["l"]) + np.exp(g["r"]))
    g = simulated(coherent=False, p=PILOT | {"residuals": np.concatenate([PILOT["residuals"][:, :3], np.ones((100, 1))], 1)})
    assert np.allclose(g["d"], g["l"] + 1)


def test_forecasts_ignore_what_comes_after_training():
    g = simulated()
    state = [g[f"s{k}"] for k in range(1, 5)]
    later = g["l"].copy()
    later[:, 60:] += 5
    for x in (state, [*state, g["a"]]):
        (one, b), (two, c) = SIM.forecasts(g["l"], x, 60), SIM.forecasts(later, x, 60)
        assert np.array_equal(one, two) and np.array_equal(b, c)


def test_standard_error_equals_enumeration():
    x = np.array([[1.0, 2, 4, 8, 3], [4, 2, 1, 3, 7]])
    for block in (1, 2, 3, 4, 5):
        k, r = divmod(5, block)
        for row in range(2):
            twice = np.concatenate([x[row], x[row]])
            whole = [twice[s : s + block].sum() for s in range(5)]
            rest = [twice[s : s + r].sum() for s in range(5)] if r else [0.0]
            means = [(sum(c) + q) / 5 for c in itertools.product(whole, repeat=k) for q in rest]
            assert SIM.se_circular(x, block)[row] == pytest.approx(np.std(means), abs=1e-7)


def test_positions_are_blocks_around_the_end_and_spread_evenly():
    at = SIM.circular_positions((3, 4), np.arange(400), 42, 5, 50)
    assert at.shape == (400, 42) and ((np.diff(at, axis=1) % 50 == 1) | (np.arange(1, 42) % 5 == 0)).all()
    n = np.bincount(at[:, ::5].ravel(), minlength=50)
    assert n.min() > 0.5 * n.mean() and n.max() < 1.5 * n.mean()
    # A path's draws don't depend on the batch it is in.
    assert np.array_equal(at[100:200], SIM.circular_positions((3, 4), np.arange(100, 200), 42, 5, 50))


def direct(paths, effect, block, key, design=SMALL, p=PILOT):
    """Figures of each path and size, one path and day at a time."""
    g = SIM.generate(p, design, np.arange(paths), block, effect, key)
    out = {}
    for i in range(paths):
        y, k = g["l"][i], design.train
        preds = []
        for names in (("s1", "s2", "s3", "s4"), ("s1", "s2", "s3", "s4", "a")):
            x = np.column_stack([np.ones(len(y)), *[g[c][i] for c in names]])
            beta = np.linalg.lstsq(x[:k], y[:k], rcond=None)[0]
            preds.append(np.exp(x[k:] @ beta) * np.exp(y[:k] - x[:k] @ beta).mean())
        actual = np.exp(y[k:])
        loss = [actual / f - np.log(actual / f) - 1 for f in preds]
        for n in design.sizes:
            diff = (loss[0] - loss[1])[:n]
            se = 0.0
            for b in design.blocks:
                whole, rest = divmod(n, b)
                twice = np.concatenate([diff, diff])
                sums = lambda w: np.array([twice[s : s + w].sum() for s in range(n)])  # noqa: B023, E731
                se = max(se, math.sqrt(whole * sums(b).var() + (sums(rest).var() if rest else 0)) / n)
            e0, e1 = actual[:n] - preds[0][:n], actual[:n] - preds[1][:n]
            out[i, n] = (diff.mean() / se, diff.mean(), diff.mean() / loss[0][:n].mean(), (e1**2).mean() / (e0**2).mean(), np.abs(e1).mean() / np.abs(e0).mean(), beta[-1])
    return out


def test_measures_match_a_direct_computation(spark):
    rows = SIM.simulate(spark, PILOT, SMALL, [("null", 5, 0.0, 12), ("effect", 5, 2.0, 12)]).collect()
    assert len(rows) == 2 * 12 * 2
    for phase, effect in (("null", 0.0), ("effect", 2.0)):
        want = direct(12, effect, 5, (SMALL.seed, int.from_bytes(phase.encode()[:7], "big"), 5, int(effect * 1e6)))
        for r in rows:
            if r["phase"] == phase:
                got = [r[c] for c in ("statistic", "mean_gain", "gain", "mse_ratio", "mae_ratio", "coefficient")]
                assert got == [pytest.approx(v, rel=1e-6, abs=1e-9) for v in want[r["path"], r["n"]]]
    mean = lambda phase: np.mean([r["gain"] for r in rows if r["phase"] == phase])
    assert mean("effect") > mean("null") + 0.05


def test_summary_and_criticals_match_direct_counts(spark):
    rows = SIM.simulate(spark, PILOT, SMALL, [("null_calibration", b, 0.0, 30) for b in (5, 10)] + [("alternative", 5, 1.0, 30)])
    data = [r.asDict() for r in rows.collect()]
    crit = {r["n"]: r["critical"] for r in SIM.calibrated(rows).collect()}
    for n in SMALL.sizes:
        tops = [np.quantile([r["statistic"] for r in data if r["n"] == n and r["block"] == b and r["phase"] == "null_calibration"], 0.975, method="higher") for b in (5, 10)]
        assert crit[n] == max(SIM.LEAST_CRITICAL, *tops)
    for g in SIM.summarise(rows, spark.createDataFrame(list(crit.items()), "n int, critical double")).collect():
        part = [r for r in data if (r["phase"], r["block"], r["n"]) == (g["phase"], g["block"], g["n"])]
        passed = [r["statistic"] > crit[g["n"]] and r["mean_gain"] > 0 for r in part]
        joint = [ok and r["coefficient"] > 0 and r["mse_ratio"] <= 1.05 and r["mae_ratio"] <= 1.05 for ok, r in zip(passed, part)]
        assert (g["paths"], g["hits"], g["rate"], g["joint_rate"]) == (30, sum(passed), pytest.approx(np.mean(passed)), pytest.approx(np.mean(joint)))
        assert g["nominal_rate"] == pytest.approx(np.mean([r["statistic"] > SIM.LEAST_CRITICAL for r in part]))
        gains = [r["gain"] for r in part]
        assert (g["gain_mean"], g["gain_p05"], g["gain_p95"]) == (pytest.approx(np.mean(gains)), pytest.approx(np.quantile(gains, 0.05)), pytest.approx(np.quantile(gains, 0.95)))
        p, m = np.mean(passed), 30
        for name, z, sign in (("low", 1.959963984540054, -1), ("high", 1.959963984540054, 1), ("upper_one_sided", 1.6448536269514722, 1)):
            want = (p + z * z / (2 * m) + sign * z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
            assert g[name] == pytest.approx(want)


def test_targets_are_met_on_the_first_rising_stretch(spark):
    grid = spark.createDataFrame([(0.0, 0.0), (0.5, 0.02), (1.0, 0.01), (2.0, 0.06)], "multiplier double, achieved_gain double")
    got = {r["target"]: r["multiplier"] for r in SIM.interpolated(grid).collect()}
    assert got == {0.01: pytest.approx(0.25), 0.03: pytest.approx(1.4), 0.05: pytest.approx(1.8)}


def test_shrunk_lines_keep_the_means():
    beta, means = np.array([2.0, 0.6, -0.5, 0.2, 0.1]), np.array([-1.0, 0.5, -0.8, -0.9])
    out = SIM.shrunk(beta, means, -0.7)
    assert np.abs(out[1:]).sum() == pytest.approx(0.97) and out[0] + out[1:] @ means == pytest.approx(-0.7)
    assert np.allclose(out[1:] / beta[1:], out[1] / beta[1])
    kept = SIM.shrunk(np.array([1.0, 0.2, 0.1, 0.0, 0.0]), means, 0.3)
    assert np.allclose(kept[1:], [0.2, 0.1, 0, 0]) and kept[0] == pytest.approx(0.3 - kept[1:] @ means)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(PS, "FULL", SMALL)
    monkeypatch.setattr(PS, "CALIBRATION", SIM.Design(burn=20, train=80, scored=60, sizes=SMALL.sizes, batch=16))
    monkeypatch.setattr(PS, "NULL_PATHS", 20)
    monkeypatch.setattr(PS, "EFFECT_PATHS", 10)
    monkeypatch.setattr(PS, "LRV_DRAWS", 60)
    monkeypatch.setattr(PS, "POWER_DRAWS", 600)


@needs_tables
def test_pilot_matches_least_squares(spark):
    x = SIM.state_rows(daily(spark, SF)).orderBy("date").toPandas()
    s = np.column_stack([np.ones(len(x)), x[["s1", "s2", "s3", "s4"]]])
    got = {(r["part"], r["k"]): (r["value"], r["fitted"]) for r in registry.QUERIES["pilot_fit"](spark, SF).collect()}
    errors = {}
    for part, y in (("ca", "la"), ("cl", "ll"), ("cr", "lr")):
        beta = np.linalg.lstsq(s, x[y], rcond=None)[0]
        errors[y] = x[y] - s @ beta
        want = SIM.shrunk(beta, s[:, 1:].mean(0), x[y].mean())
        assert [got[part, k][1] for k in range(5)] == pytest.approx(beta.tolist(), rel=1e-6)
        assert [got[part, k][0] for k in range(5)] == pytest.approx(want.tolist(), rel=1e-6)
    assert got["theta", 0][0] == pytest.approx(np.polyfit(errors["la"], errors["ll"], 1)[0]) and got["residuals", 0][0] == len(x)


@needs_tables
def test_queries_run_and_agree_with_their_paths(spark, small):
    q = {name: registry.QUERIES[name](spark, SF) for name in ("dgp_reduced", "dgp_coherent", "sim_forecasts", "sim_measure", "sim_summarize", "critical_calibration", "effect_calibration", "ordering_audit")}
    got = {name: [r.asDict() for r in df.collect()] for name, df in q.items()}
    assert {name: len(got[name]) for name in ("dgp_reduced", "dgp_coherent", "sim_measure")} == {"dgp_reduced": 60, "dgp_coherent": 60, "sim_measure": 180}
    p = SIM.pilot(daily(spark, SF))
    want = direct(10, 1.0, 10, (SMALL.seed, int.from_bytes(b"effect", "big"), 10, 1_000_000), p=p)
    for r in got["dgp_coherent"]:
        if r["phase"] == "effect":
            assert (r["statistic"], r["gain"]) == (pytest.approx(want[r["path"], r["n"]][0], rel=1e-5), pytest.approx(want[r["path"], r["n"]][2], rel=1e-5))
    five = [r for r in got["sim_measure"] if r["phase"] == "effect" and r["block"] == 5 and r["n"] == 60]
    one = got["sim_forecasts"][0]
    assert (one["paths"], one["mean_gain"], one["mse_ratio"]) == (10, pytest.approx(np.mean([r["gain"] for r in five])), pytest.approx(np.mean([r["mse_ratio"] for r in five])))
    crit = {r["n"]: r["critical"] for r in got["critical_calibration"]}
    assert {r["n"]: r["critical"] for r in got["sim_summarize"]} == crit and min(crit.values()) >= SIM.LEAST_CRITICAL
    grid = sorted((r["multiplier"], r["achieved_gain"]) for r in got["effect_calibration"] if r["target"] is None)
    assert [m for m, _ in grid] == list(PS.MULTIPLIERS)
    met = {r["target"]: r["multiplier"] for r in got["effect_calibration"] if r["target"] is not None}
    for t, m in met.items():
        a, b = next((a, b) for a, b in zip(grid, grid[1:]) if a[1] <= t <= b[1] and b[1] > a[1])
        assert m == pytest.approx(np.interp(t, [a[1], b[1]], [a[0], b[0]]))
    assert {r["effect"] for r in got["sim_summarize"]} == {0.0, *met.values()} and {r["target_effect"] for r in got["sim_summarize"]} == {0.0, *met}
    share = {r["generator"]: r["share"] for r in got["ordering_audit"]}
    assert share["coherent"] == 0 and 0 <= share["reduced"] <= 1


@needs_tables
def test_planning_queries_match_direct_draws(spark, small):
    x = PS._losses(spark, SF)

    def lrv(z, lags):
        z, n = z - z.mean(), len(z)
        return max(0.0, sum((1 if k == 0 else 2 * (1 - k / (lags + 1))) * (z[k:] * z[: n - k]).sum() / n for k in range(lags + 1)))

    most = {}
    for b in SMALL.blocks:
        at = SIM.circular_positions((17, b), np.arange(60), len(x), b, len(x))
        most[b] = np.quantile([max(lrv(x[row], k) for k in (5, 10, 20)) for row in at], 0.95)
    got = {r["block"]: r for r in registry.QUERIES["lrv_upper_boot"](spark, SF).collect()}
    point = max(lrv(x, k) for k in (5, 10, 20))
    assert {b: (r["draws"], r["upper"], r["point"]) for b, r in got.items()} == {b: (60, pytest.approx(v), pytest.approx(point)) for b, v in most.items()}

    z = x / x.mean() - 1
    omega = 1.5 * max(*most.values(), point) / x.mean() ** 2
    rows = registry.QUERIES["conditional_power"](spark, SF).collect()
    assert {(r["target"], r["block"]) for r in rows} == {(t, b) for t in (0.8, 0.9) for b in SMALL.blocks}
    for r in rows:
        n = math.ceil((1.959963984540054 + SIM.NORMAL.inv_cdf(r["target"])) ** 2 * omega / 0.05**2)
        whole, rest = divmod(n, r["block"])
        starts = SIM.hashed((13, int(r["target"] * 100), r["block"]), np.arange(600), whole + 1, len(z))
        means = [(sum(z[(s + np.arange(r["block"])) % len(z)].sum() for s in row[:-1]) + z[(row[-1] + np.arange(rest)) % len(z)].sum()) / n for row in starts[:40]]
        assert r["n"] == n and r["draws"] == 600 and r["omega"] == pytest.approx(omega)
        assert abs(np.mean(np.array(means) + 0.05 > 1.959963984540054 * math.sqrt(omega / n)) - r["power"]) < 0.3


def test_registered_queries_have_the_whole_design(spark, monkeypatch):
    asked = []

    def simulate(spark, p, design, cells, coherent=True):
        asked.append((design, cells))
        return spark.createDataFrame([], SIM._OUT)

    monkeypatch.setattr(PS.SIM, "simulate", simulate)
    monkeypatch.setattr(PS, "_pilot", lambda spark, sf: PILOT)
    for name in ("dgp_reduced", "dgp_coherent", "sim_forecasts", "sim_measure", "sim_summarize", "critical_calibration", "effect_calibration", "ordering_audit"):
        asked.clear()
        registry.QUERIES[name](spark, "")
        assert asked
        for design, cells in asked:
            grid = cells[0][0] == "grid"
            assert (design.burn, design.train, design.scored, design.sizes) == (500, 4000 if grid else 400, 8000, (250, 500, 1000, 2000, 4000, 8000))
            assert {(c[0].split("_")[0], c[3]) for c in cells} <= {("null", 2000), ("effect", 1000), ("alternative", 1000), ("grid", 16)}
            assert not grid or [c[2] for c in cells] == [0, 0.125, 0.25, 0.5, 0.75, 1, 1.5, 2, 3]
    assert (PS.LRV_DRAWS, PS.POWER_DRAWS, PS.TARGETS if hasattr(PS, "TARGETS") else SIM.TARGETS) == (2000, 20_000, (0.01, 0.03, 0.05, 0.10))
