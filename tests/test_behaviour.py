"""Behaviours pinned on small literal inputs: time zones, gaps, causality, fills, sizing, bootstrap, power."""

import datetime
import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import losses as L
from tidemark.functions import moments as M
from tidemark.functions import stats as ST
from tidemark.operators import forecast as FC
from tidemark.operators import joins as J
from tidemark.operators import quality as Q
from tidemark.operators import replay as RP
from tidemark.operators import risk as K
from tidemark.operators import rolling as R
from tidemark.operators import sessions as S
from tidemark.operators import simulate as SIM
from tidemark.plans import events_and_risk, registry
from tidemark.sources import market
from tidemark.sources import files as FS

T0 = datetime.datetime(2016, 1, 4, 4, 0)
SCHEMA = "bar timestamp_ntz, open_bid double, high_bid double, low_bid double, close_bid double, open_ask double, high_ask double, low_ask double, close_ask double, quote_count long"


def bars(spark, quads, start=T0, minutes=1, spread=0.2, skip=()):
    rows = [(start + datetime.timedelta(minutes=minutes * k), *map(float, q), *[v + spread for v in q], 1) for k, q in enumerate(quads) if q is not None and k not in skip]
    return spark.createDataFrame(rows, SCHEMA)


def ramp(n):
    return [(1000 + 0.001 * k, 1000 + 0.001 * k + 0.002, 1000 + 0.001 * k - 0.002, 1000 + 0.001 * k + 0.001) for k in range(n)]


# Time zones


@pytest.mark.parametrize("day, hour", [("2016-01-15", 8), ("2016-07-15", 7)])
def test_london_opens_by_local_clock(spark, day, hour):
    row = S.bounds(spark.sql(f"SELECT DATE'{day}' AS date"), S.LONDON).head()
    assert row["starts"].hour == hour


def test_us_and_uk_change_clocks_on_different_days(spark):
    days = spark.sql("SELECT explode(array(DATE'2016-03-10', DATE'2016-03-15', DATE'2016-03-29')) AS date")
    gap = [(r["starts"] - q["starts"]).total_seconds() / 3600 for r, q in zip(S.bounds(days, S.Session("n", "America/New_York", 8, 12)).orderBy("date").collect(), S.bounds(days, S.LONDON).orderBy("date").collect())]
    assert gap == [5, 4, 5]


def test_windows_may_cross_midnight(spark):
    row = S.bounds(spark.sql("SELECT DATE'2016-01-04' AS date"), S.Session("x", "UTC", 22, 3)).head()
    assert (row["starts"], row["ends"]) == (datetime.datetime(2016, 1, 4, 22), datetime.datetime(2016, 1, 5, 3))
    b = bars(spark, ramp(24), datetime.datetime(2016, 1, 4, 12), 60)
    got = S.in_session(b, S.Session("x", "UTC", 22, 3)).select("session_date", "bar").collect()
    assert len(got) == 5 and {r["session_date"] for r in got} == {datetime.date(2016, 1, 4)}


# Quality


def test_flat_bars_are_kept_and_flagged(spark):
    f = Q.flagged(bars(spark, [(1000, 1000, 1000, 1000), (1000, 1001, 999, 1000)]), Q.Limits(bar_minutes=1))
    assert [r["flat"] for r in f.orderBy("bar").collect()] == [True, False] and f.where("suspect").count() == 0


def test_jump_needs_adjacent_bars(spark):
    quads = [(1000, 1000, 1000, 1000), (1100, 1100, 1100, 1100), (1100, 1100, 1100, 1100)]
    flags = lambda skip: [r["jump"] for r in Q.jump_flag(bars(spark, quads, skip=skip), 0.02, minutes=1).orderBy("bar").collect()]
    assert flags(()) == [False, True, False] and flags((1,)) == [False, False]
    monthly = Q.jump_flag(bars(spark, quads, skip=(1,)), 0.02, "monthly").orderBy("bar").collect()
    assert [r["jump"] for r in monthly] == [False, True]


def test_previous_row_crosses_days_without_a_global_window(spark):
    b = bars(spark, ramp(6), datetime.datetime(2016, 1, 4, 23, 57))
    got = Q.with_previous(b, "close_bid").orderBy("bar").collect()
    assert [r["prev_close_bid"] for r in got] == [None, *[r["close_bid"] for r in got[:-1]]]


def test_invalid_quotes(spark):
    good, bad = (1000, 1001, 999, 1000), [(1000, 999, 998, 1000), (1000, 1001, 1002, 1000), (0, 1, 0, 1), (float("nan"), 1001, 999, 1000)]
    got = bars(spark, [good, *bad]).select("bar", Q.ohlc_invalid().alias("x")).orderBy("bar").collect()
    assert [r["x"] for r in got] == [False, True, True, True, True]


def test_first_failing_rule_names_the_reason(spark):
    c = Q.first_failure((F.col("a") < 2, "few"), (F.col("b"), "flag"))
    got = spark.createDataFrame([(1, True), (3, True), (3, False), (None, None)], "a int, b boolean").select(c.alias("r")).collect()
    assert [r["r"] for r in got] == ["few", "flag", "ok", "ok"]


# Realised variance


def rv(spark, bridge, skip=range(100, 105)):
    f = Q.flagged(bars(spark, ramp(60 * 4), datetime.datetime(2016, 1, 4, 8), skip=set(skip)), Q.Limits(bar_minutes=1))
    return S.realised_variance(S.in_session(f, S.LONDON), 5, 5, "session_date", bridge=bridge).head()


def test_a_gap_invents_no_return(spark):
    safe, bridged = rv(spark, False), rv(spark, True)
    assert safe["n_blocks"] == bridged["n_blocks"] == 47 and safe["n_returns"] == 46 and bridged["n_returns"] == 47
    assert bridged["rv"] > safe["rv"] > 0


def test_gap_of_two_blocks_by_hand(spark):
    rows = [(1, datetime.datetime(2016, 1, 4, 0, m), o, c, 5) for m, o, c in ((0, 100.0, 101.0), (5, 101.0, 102.0), (15, 200.0, 201.0))]
    w = spark.createDataFrame(rows, "k int, block timestamp_ntz, o double, c double, n_bars int")
    got = [r["ret"] for r in S.block_returns(w, 5, "k").orderBy("block").collect()]
    assert got == [pytest.approx(math.log(101 / 100)), pytest.approx(math.log(102 / 101)), None]


@pytest.mark.parametrize("skip, valid", [((), True), ((100, 101, 102, 103, 104), False), ((0,), False), ((239,), False), ((100,), True)])
def test_session_validity(spark, skip, valid):
    f = Q.flagged(bars(spark, ramp(240), datetime.datetime(2016, 1, 4, 8), skip=set(skip)), Q.Limits(bar_minutes=1))
    assert S.session_summary(f, S.LONDON, 1, 0.98, 5).head()["valid"] is valid


# Causality


def ledger(spark, values, start=datetime.date(2023, 1, 2)):
    return spark.createDataFrame([(d, v) for d, v in values], "date date, v double")


def test_lag_is_causal_and_ages(spark):
    d = datetime.date
    rows = [(d(2023, 1, 2), 1.0), (d(2023, 1, 3), None), (d(2023, 1, 4), 3.0), (d(2023, 1, 9), 9.0), (d(2023, 1, 10), 4.0)]
    got = R.causal_lag(ledger(spark, rows), "v").orderBy("date").collect()
    assert [r["lag_value"] for r in got] == [None, 1.0, 1.0, None, 9.0]


def test_the_future_cannot_reach_the_past(spark):
    d0 = datetime.date(2020, 1, 1)
    rng = np.random.default_rng(3)
    v = rng.gamma(2, 1, (120, 3))

    def features(x):
        rows = [(d0 + datetime.timedelta(days=k), *map(float, r), float(sum(r))) for k, r in enumerate(x)]
        return FC.ledger(spark.createDataFrame(rows, "date date, a double, l double, r double, d double")).orderBy("date").collect()

    poisoned = v.copy()
    poisoned[80:] = 1e6
    keep = ("lag_l", "lag_d", "log_mean5", "log_mean20", "eligible")
    a, b = ([[r[c] for c in keep] for r in features(x)[:80]] for x in (v, poisoned))
    assert a == b and a[79][4] is True


@pytest.mark.parametrize("strict", [True, False])
def test_as_of_looks_back_over_months_within_its_group(spark, strict):
    rng = np.random.default_rng(4)
    day = lambda: datetime.date(2023, 1, 1) + datetime.timedelta(days=int(rng.integers(0, 400)))
    left = [(int(rng.integers(0, 3)) or None, day()) for _ in range(60)]
    right = list({(int(rng.integers(0, 3)) or None, day()): None for _ in range(12)})
    a = spark.createDataFrame(left, "g int, date date")
    b = spark.createDataFrame([(g, d, float(k)) for k, (g, d) in enumerate(right)], "g int, date date, v double")
    got = list((str(r["g"]), r["date"], r["as_of"], r["v"]) for r in J.as_of(a, b, "date", "v", by=("g",), strict=strict).collect())
    want = []
    for g, d in left:
        before = [(e, float(k)) for k, (h, e) in enumerate(right) if h == g and (e < d or e == d and not strict)]
        want.append((str(g), d, *(max(before) if before else (None, None))))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_as_of_is_strict_or_not(spark):
    d = datetime.date
    left = spark.createDataFrame([(d(2023, 1, k),) for k in (1, 2, 3, 5)], "date date")
    right = spark.createDataFrame([(d(2023, 1, 2), 2.0), (d(2023, 1, 4), 4.0)], "date date, v double")
    run = lambda strict: [r["v"] for r in J.as_of(left, right, "date", "v", strict=strict).orderBy("date").collect()]
    assert run(True) == [None, None, 2.0, 4.0] and run(False) == [None, 2.0, 2.0, 4.0]


def test_one_to_one_refuses_duplicates(spark):
    a, b = spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(ValueError, match="duplicate"):
        J.one_to_one(a, b, "k")


def test_frozen_coefficients_ignore_later_labels(spark):
    d0 = datetime.date(2020, 1, 1)
    rng = np.random.default_rng(5)
    x = rng.normal(size=60)

    def run(shift):
        y = -0.8 + 0.3 * x + 0.1 * rng.normal(size=60) * 0
        y[40:] += shift
        rows = [(d0 + datetime.timedelta(days=k), float(np.exp(y[k])), float(y[k]), float(x[k]), True) for k in range(60)]
        out = FC.forecasts(spark.createDataFrame(rows, "date date, actual double, log_l double, z double, eligible boolean"), d0 + datetime.timedelta(days=39), 20, {"m": ("z",)})
        return [r["forecast"] for r in out.orderBy("date", "mode").collect() if r["mode"] == "frozen"]

    a, b = run(0.0), run(5.0)
    assert len(a) == 20 and a == pytest.approx(b)


def test_missing_labels_keep_their_forecasts(spark):
    d0 = datetime.date(2020, 1, 1)
    rows = [(d0 + datetime.timedelta(days=k), None if k % 7 == 3 else 1.0 + k % 5, None if k % 7 == 3 else math.log(1.0 + k % 5), float(k % 11), True) for k in range(60)]
    out = FC.forecasts(spark.createDataFrame(rows, "date date, actual double, log_l double, z double, eligible boolean"), d0 + datetime.timedelta(days=59), 20, {"m": ("z",)}).collect()
    # A refit needs 20 labelled rows; from then on every eligible day has a forecast.
    assert len(out) == 60 - 23 and any(math.isnan(r["actual"]) if r["actual"] is not None else True for r in out)


def test_qlike_is_zero_only_at_the_truth(spark):
    got = spark.createDataFrame([(2.0, 2.0), (2.0, 1.0), (1.0, 2.0)], "y double, f double").select(L.qlike(F.col("y"), F.col("f")).alias("q")).collect()
    assert [r["q"] for r in got] == [pytest.approx(0), pytest.approx(2 - math.log(2) - 1), pytest.approx(0.5 - math.log(0.5) - 1)]


# Sources


def test_delta_decoding_rounds_half_up(spark):
    rows = spark.createDataFrame([("k", T0, 1.25), ("k", T0 + datetime.timedelta(minutes=3), 1.2)], "key string, ts timestamp_ntz, v double")
    got = FS.decode_delta(FS.encode_delta(rows, "key", "ts", "v", 0.5), "key").orderBy("minute").collect()
    assert [r["value"] for r in got] == [1.5, 1.0] and got[1]["minute"] - got[0]["minute"] == 3


def test_delta_arrays_must_have_equal_length(spark):
    bad = spark.createDataFrame([("k", 0, 1.0, [0, 1], [5])], "key string, start long, multiplier double, times array<long>, values array<long>")
    with pytest.raises(Exception, match="unequal"):
        FS.decode_delta(bad, "key").collect()


def test_incomplete_candles_are_dropped(spark):
    doc = '{"candles":[{"time":"2016-01-04T04:00:00","complete":false,"volume":1,"bid":{"o":"1","h":"1","l":"1","c":"1"},"ask":{"o":"2","h":"2","l":"2","c":"2"}},{"time":"2016-01-04T04:01:00","complete":true,"volume":3,"bid":{"o":"1.5","h":"2","l":"1","c":"1"},"ask":{"o":"2","h":"2","l":"2","c":"2"}}]}'
    got = FS.candles_json(spark.createDataFrame([(doc,)], "doc string")).collect()
    assert [(r["open_bid"], r["volume"], r["bar"].minute) for r in got] == [(1.5, 3, 1)]


def test_dates_outside_are_refused(spark):
    d = datetime.date
    for a, b in ((d(2019, 12, 31), d(2020, 1, 2)), (d(2020, 1, 1), d(2021, 1, 2)), (d(2020, 2, 1), d(2020, 1, 1))):
        with pytest.raises(ValueError):
            FS.guard_dates(a, b, (d(2020, 1, 1), d(2020, 12, 31)))
    with pytest.raises(ValueError, match="no provider"):
        FS.load("other", spark, "", d(2020, 1, 1), d(2020, 1, 2), (d(2020, 1, 1), d(2020, 12, 31)))


def test_manifest_sees_changes(spark, tmp_path):
    (tmp_path / "a").write_text("1")
    (tmp_path / "b").write_text("2")
    spark.createDataFrame(FS.manifest(spark, str(tmp_path)).collect()).createOrReplaceTempView("frozen")
    (tmp_path / "b").write_text("3")
    (tmp_path / "c").write_text("4")
    got = {tuple(r) for r in FS.manifest_changes(spark.table("frozen"), FS.manifest(spark, str(tmp_path))).collect()}
    assert got == {("b", "changed"), ("c", "added")}


def test_holdout_opens_once(spark, tmp_path):
    lock = FS.HoldoutLock(spark, f"file://{tmp_path}/marker")
    lock.open("first")
    with pytest.raises(PermissionError):
        lock.open("second")


# Replay

RULES = RP.Rules(zone="UTC", box_start=0, box_hours=3, entry_hours=4, exit_hours=9, base_minutes=60, weekdays=(0,))


def replayed(spark, quads, gate=False, suspect_hour=None, **changes):
    from dataclasses import replace

    r = replace(RULES, **changes)
    b = bars(spark, quads, datetime.datetime(2016, 1, 4), 60)
    f = Q.flagged(b, Q.Limits(bar_minutes=60, jump=9.0))
    f = f.withColumn("suspect", F.col("suspect") | (F.hour("bar") == F.lit(suspect_hour if suspect_hour is not None else -1)))
    box = RP.boxes(f, replace(r, least_blocks=0)).withColumns({"valid": F.lit(True), "rel_width": F.lit(0.0)})
    return RP.replay(f, box, r, gate).head()


BOX = [(100, 101, 99, 100)] * 3


def test_both_sides_in_one_bar_is_ambiguous(spark):
    assert replayed(spark, BOX + [(100, 102, 98, 100)] + [(100, 100, 100, 100)] * 9)["status"] == "ambiguous_entry"


def test_long_entry_and_time_exit(spark):
    got = replayed(spark, BOX + [(100.5, 101.5, 100.2, 101.2)] + [(102, 102.5, 101.5, 102)] * 9)
    entry, stop = 101 + 0.2 + 0.05, 99
    assert got["entry"] == pytest.approx(entry) and got["risk"] == pytest.approx(entry - stop)
    assert got["status"] == "time" and got["exit"] == pytest.approx(102 - 0.05) and got["r"] == pytest.approx((102 - 0.05 - entry - 0.07) / (entry - stop))


def test_adverse_gap_fills_at_the_open(spark):
    got = replayed(spark, BOX + [(100.5, 101.5, 100.2, 101.2), (98, 98.5, 97, 98)] + [(98, 98, 98, 98)] * 8)
    assert got["status"] == "stop" and got["exit"] == pytest.approx(98 - 0.05)


def test_excursions_include_the_stop_bar_and_exclude_the_time_exit(spark):
    stop = replayed(spark, BOX + [(100.5, 101.5, 100.2, 101.2), (100, 104, 98, 98)] + [(98, 98, 98, 98)] * 8)
    assert stop["mfe"] == pytest.approx((104 - stop["entry"]) / stop["risk"])
    time = replayed(spark, BOX + [(100.5, 101.5, 100.2, 101.2)] + [(102, 102, 102, 102)] * 8 + [(102, 109, 102, 102)])
    assert time["status"] == "time" and time["mfe"] == pytest.approx((102 - time["entry"]) / time["risk"])


def test_no_breakout_and_missing_exit(spark):
    assert replayed(spark, BOX + [(100, 100.5, 99.5, 100)] * 10)["status"] == "no_breakout"
    assert replayed(spark, BOX + [(100.5, 101.5, 100.2, 101.2)] + [(102, 102, 102, 102)] * 3)["status"] == "missing_exit_quote"


def test_broken_paths_are_refused(spark):
    """A box is priced only if its path has its first and last bar, nearly all between, no long gap and no suspect bar."""
    whole = BOX + [(100.5, 101.5, 100.2, 101.2)] + [(102, 102.5, 101.5, 102)] * 9
    assert replayed(spark, whole, gate=True)["status"] == "time"
    for broken in (whole[:12], whole[:3] + [None] + whole[4:], whole[:5] + [None] + whole[6:]):
        got = replayed(spark, broken, gate=True)
        assert got["status"] == "incomplete_execution_path" and got["r"] is None
        assert replayed(spark, broken, gate=False)["status"] != "incomplete_execution_path"
    gap = whole[:6] + [None] * 3 + whole[9:]
    assert replayed(spark, gap, gate=True, path_share=0.5)["status"] == "time"
    assert replayed(spark, gap, gate=True, path_share=0.5, path_gap_bars=3)["status"] == "incomplete_execution_path"
    assert replayed(spark, whole, gate=True, suspect_hour=6)["status"] == "incomplete_execution_path"


# Sizing and moments


def test_brake_after_twenty_losses(spark):
    t = spark.createDataFrame([(k, datetime.date(2020, 1, 1) + datetime.timedelta(days=k), -1.0, 1.0, "long") for k in range(1, 22)], "n long, exit_date date, r double, risk double, direction string")
    got = [r["fraction"] for r in K.sized(t).orderBy("n").collect()]
    assert got == [0.01] * 20 + [0.005]


def test_drawdown_counts_from_the_initial_equity(spark):
    t = spark.createDataFrame([(1, -1.0), (2, 0.5), (3, 2.0), (4, -1.0)], "n long, r double")
    got = [round(r["drawdown"], 6) for r in R.equity(t, F.lit(0.01)).orderBy("n").collect()]
    assert got == [0.01, round(1 - 0.99 * 1.005, 6), 0.0, 0.01]


def year_by_day(x, base):
    """A resampled year, one day after the other."""
    level = peak = 1.0
    done, levels, depth, ret = [], [], [], []
    for v in x:
        risk = base / 2 if len(done) >= 20 and sum(done[-20:]) < -4 - 1e-9 else base
        ret.append(risk * v)
        level *= 1 + risk * v
        peak = max(peak, level)
        levels.append(level)
        depth.append(1 - level / peak)
        if v:
            done.append(v)

    def longest(flags):
        return max((len(list(g)) for k, g in itertools.groupby(flags) if k), default=0)

    months = [levels[21 * k + 20] / (levels[21 * k - 1] if k else 1) - 1 for k in range(12)]
    return {"max_drawdown": max(depth), "terminal": level, "lowest": min(1, *levels), "sharpe": np.mean(ret) / np.std(ret, ddof=1) * math.sqrt(252), "drawdown_days": longest(d > 1e-9 for d in depth), "losing_streak": longest(v < 0 for v in done), "losing_months": sum(m < -1e-12 for m in months)}


def test_resampled_years_match_a_day_by_day_run():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(-0.15, 1, (40, 252)), 1) * (rng.random((40, 252)) < 0.6)
    for base in (0.0025, 0.01):
        got = K.resampled_years(x, base)
        for k in range(40):
            for name, v in year_by_day(x[k], base).items():
                assert got[name][k] == pytest.approx(v), (name, k)


def test_monte_carlo_draws_are_trades_and_days_of_books(spark, monkeypatch):
    day = datetime.date(2024, 1, 1)
    rows = [(b, k + 1, day + datetime.timedelta(days=3 * k), float(b * 100 + k), 1.0, "long", 5.0) for b in (1, 2) for k in range(10 * b)]
    t = spark.createDataFrame(rows, "book long, n long, exit_date date, r double, risk double, direction string, minutes double")
    days = K.daily_returns(t.withColumn("fraction", F.lit(1.0)), ("book",))
    by_book = {}
    for r in days.orderBy("book", "date").collect():
        by_book.setdefault(r["book"], []).append(r["ret"])
    got = {}
    for r in K.draws(t, days, 50).collect():
        got.setdefault((r["method"], r["path"]), {})[r["t"]] = r["x"]
    known = {r[3] for r in rows}
    pace = round(30 / sum(map(len, by_book.values())) * 252)
    assert len(got) == 100
    for (method, _), x in got.items():
        if method == "iid":
            assert sorted(x) == sorted({int(v) for v in np.linspace(0, 251, pace)}) and set(x.values()) <= known
        else:
            assert sorted(x) == list(range(252))
            for k in range(0, 252, 10):
                part = [x[j] for j in range(k, min(k + 10, 252))]
                assert any(part == [d[(s + j) % len(d)] for j in range(len(part))] for d in by_book.values() for s in range(len(d)))
    rows = K.monte_carlo(t, days, 60, batch=25).collect()
    assert {(r["method"], r["risk"], r["paths"]) for r in rows} == {(m, f, 60) for m in ("iid", "block") for f in (0.0025, 0.005, 0.0075, 0.01)}
    paths = {}
    for r in K.draws(t, days, 60).collect():
        paths.setdefault((r["method"], r["path"]), np.zeros(252))[r["t"]] = r["x"]
    for r in rows:
        each = [year_by_day(v, r["risk"]) for (m, _), v in paths.items() if m == r["method"]]
        assert r["p_dd10"] == np.mean([e["max_drawdown"] > 0.1 for e in each]) and r["p_ruin"] == np.mean([e["lowest"] <= 0.5 for e in each])
        assert r["terminal_p05"] == pytest.approx(np.quantile([e["terminal"] for e in each], 0.05)) and r["drawdown_days_p95"] == pytest.approx(np.quantile([e["drawdown_days"] for e in each], 0.95))


def test_corrected_moments(spark):
    row = spark.createDataFrame([(float(k),) for k in range(1, 11)], "x double").agg(M.kurtosis_corrected(F.col("x")), M.skew_corrected(F.col("x"))).head()
    assert row[0] == pytest.approx(-1.2) and row[1] == pytest.approx(0)


def test_quantile_buckets_are_right_closed_and_may_be_empty(spark):
    x = spark.createDataFrame([(float(v),) for v in [0] * 8 + [1, 2]], "x double")
    got = x.groupBy(M.bucket(F.col("x"), M.quantile_edges(x, "x", 5)).alias("b")).count().orderBy("b").collect()
    assert [tuple(r) for r in got] == [(1, 8), (5, 2)]


@pytest.mark.parametrize("bound", [1000, 0])
def test_average_ranks(spark, bound):
    got = M.average_rank(spark.createDataFrame([(3.0,), (1.0,), (3.0,), (None,)], "x double"), "x", "k", bound).orderBy("x").collect()
    assert [r["k"] for r in got] == [None, 1.0, 2.5, 2.5]


@pytest.mark.parametrize("bound", [10**6, 0])
def test_quantiles_are_exact_in_one_task_and_in_many(spark, bound):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=3001), np.full(1500, 0.25)])
    at = [0.0, 0.2, 0.5, 0.95, 0.99, 1.0]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    assert M.exact_quantiles(df, "x", at, bound) == pytest.approx(np.quantile(x, at).tolist())
    assert M.exact_quantiles(df.where("x IS NULL"), "x", [0.5], bound) == [None]


# Inference


def test_hac_standard_error_by_hand(spark):
    rng = np.random.default_rng(8)
    x, e = rng.normal(size=80), rng.normal(size=80)
    y = 1 + 0.5 * x + e
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "t long, x double, y double")
    fit = ST.ols(df, "y", ["x"], "t", 5)
    z = np.column_stack([np.ones(80), x])
    b = np.linalg.solve(z.T @ z, z.T @ y)
    u = z * (y - z @ b)[:, None]
    meat = u.T @ u
    for lag in range(1, 6):
        g = u[lag:].T @ u[:-lag]
        meat += (1 - lag / 6) * (g + g.T)
    inv = np.linalg.inv(z.T @ z)
    assert fit.beta == pytest.approx(b) and fit.se() == pytest.approx(np.sqrt(np.diag(inv @ meat @ inv)))


def test_normal_p_value_of_a_known_t():
    fit = ST.Fit(("const",), np.array([0.32218708]), np.array([[0.05204566**2]]), 495, 0.1)
    _, b, s, t, p, low, _ = fit.rows()[0]
    assert t == pytest.approx(6.19047, abs=1e-5) and p == pytest.approx(5.9985e-10, rel=1e-3) and low == pytest.approx(0.2201795, abs=1e-6)


def test_circular_standard_error_equals_enumeration():
    x = np.array([[1.0, 2, 4, 8, 3], [4, 2, 1, 3, 7]])
    for block in (1, 2, 3, 4):
        k, r = divmod(5, block)
        for row in range(2):
            doubled = np.concatenate([x[row], x[row]])
            whole = [doubled[s : s + block].sum() for s in range(5)]
            rest = [doubled[s : s + r].sum() for s in range(5)] if r else [0.0]
            means = [(sum(c) + q) / 5 for c in itertools.product(whole, repeat=k) for q in rest]
            assert SIM.se_circular(x, block)[row] == pytest.approx(np.std(means))


def test_block_sums_wrap_around(spark):
    got = R.circular_block_sums(spark.createDataFrame([(k, float(v)) for k, v in enumerate((1, 2, 4, 8, 3))], "t long, v double"), "v", 3).orderBy("t").collect()
    assert [r["s"] for r in got] == [7, 14, 15, 12, 6]


def test_bootstrap_draws_are_deterministic_and_centred(spark):
    df = spark.createDataFrame([(k, float(k % 7)) for k in range(53)], "t long, v double")
    run = lambda seed: [r["v"] / 53 for r in ST.drawn_sums(df, ["v"], "t", 5, 300, seed).orderBy("draw").collect()]
    a, true = run(1), np.mean([k % 7 for k in range(53)])
    assert a == run(1) != run(2) and abs(np.mean(a) - true) < 0.05
    assert np.std(a) == pytest.approx(SIM.se_circular(np.array([[k % 7 for k in range(53)]], float), 5)[0], rel=0.2)


def test_lrv_of_an_autoregression(spark):
    rng, x = np.random.default_rng(9), [0.0]
    for e in rng.normal(size=6000):
        x.append(0.5 * x[-1] + e)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "t long, v double")
    assert ST.bartlett_lrv(df, "v", "t", 40).head()[0] == pytest.approx(4.0, rel=0.2)


def test_required_sample_scales_with_effect():
    n = lambda d: math.ceil((ST.NORMAL.inv_cdf(0.975) + ST.NORMAL.inv_cdf(0.9)) ** 2 * 7.6139 / d**2)
    assert n(0.05) == pytest.approx(32001, abs=1) and n(0.025) == pytest.approx(4 * n(0.05), rel=1e-3)


def test_benjamini_hochberg_is_monotone(spark):
    q = [r["q"] for r in ST.benjamini_hochberg(spark.createDataFrame([(p,) for p in (0.04, 0.01, 0.03, 0.5)], "p double")).orderBy("p").collect()]
    assert q == [pytest.approx(v) for v in (0.04, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.5)]


def test_random_draws_are_as_many_as_the_reference_has(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    assert {(r["block"], r["draws"]) for r in registry.QUERIES["lrv_upper_boot"](spark, sf).collect()} == {(5, 2000), (10, 2000), (20, 2000)}
    assert registry.QUERIES["block_boot_beta"](spark, sf).head()["draws"] == 2000 and registry.QUERIES["paired_block_ci"](spark, sf).head()["draws"] == 10_000
    assert registry.QUERIES["circ_shift_perm"](spark, sf).head()["shifts"] == 2000 and registry.QUERIES["block_boot_mean"](spark, sf).count() == 2000
    assert events_and_risk.MC_PATHS == 10_000


def test_monte_carlo_query_resamples_all_books(spark, monkeypatch):
    """The registered query, on few paths, from the draws of its own trades."""
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    monkeypatch.setattr(events_and_risk, "MC_PATHS", 40)
    t = market.trades(spark, sf)
    days = K.daily_returns(t.withColumn("fraction", F.lit(1.0)), ("book",))
    paths = {}
    for r in K.draws(t, days, 40).collect():
        paths.setdefault((r["method"], r["path"]), np.zeros(252))[r["t"]] = r["x"]
    rows = registry.QUERIES["mc_iid_block"](spark, sf).collect()
    assert len(rows) == 8
    for r in rows:
        each = [year_by_day(v, r["risk"]) for (m, _), v in paths.items() if m == r["method"]]
        assert r["paths"] == 40 and r["mean_equity"] == pytest.approx(np.mean([e["terminal"] for e in each])) and r["max_drawdown_p95"] == pytest.approx(np.quantile([e["max_drawdown"] for e in each], 0.95))


# Streaming


def test_stream_gives_the_batch_bars(spark, tmp_path):
    from tidemark.streaming.bars import bars_stream, quotes_stream, run_available

    rows = [(k, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=7 * k), 1, "view", float(k % 5), '{"k": 3}') for k in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    import glob
    import os
    import shutil

    part = glob.glob(f"{tmp_path}/events.parquet/part-*")[0]
    os.makedirs(f"{tmp_path}/in")
    shutil.copy(part, f"{tmp_path}/in/events.parquet")
    got = run_available(bars_stream(quotes_stream(spark, f"{tmp_path}/in"), 15), "bar").collect()
    assert sum(r["quote_count"] for r in got) == 60 and len(got) == 28
