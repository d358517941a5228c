"""Boxes, breakout replay, sizing and performance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import replay as RP
from ..operators import risk as K
from ..operators import rolling as R
from ..sources.market import daily, trades
from .bars_and_sessions import flagged
from .registry import query
from .rolling import _V, BOOK, valid
from .views import FLAGGED, TRADES, q6, q6n, r6, r6n, sql

_BOX = FLAGGED + """, placed0 AS (SELECT *, timezone('America/New_York', timezone('UTC', bar)) - INTERVAL '20 hours' AS sh FROM flagged),
placed AS (SELECT *, sh::DATE AS box_date, hour(sh) * 60 + minute(sh) AS since FROM placed0 WHERE hour(sh) * 60 + minute(sh) <= 720 AND isodow(sh) - 1 IN (6, 0, 1, 2, 3)),
box0 AS (SELECT box_date, since // 60 AS h, count(*) AS n, max(high_bid) AS hi, min(low_bid) AS lo, bool_or(extreme OR jump OR spread_bad) AS suspect FROM placed WHERE since < 180 GROUP BY 1, 2),
box1 AS (SELECT box_date, max(hi) AS hi, min(lo) AS lo, count(*) FILTER (n >= 3) AS n_blocks, bool_or(suspect) AS suspect FROM box0 GROUP BY 1),
box2 AS (SELECT *, hi - lo AS width, n_blocks >= 2 AND hi - lo >= 0.2 AND NOT suspect AS valid FROM box1),
boxes AS (SELECT *, CASE WHEN count(CASE WHEN valid THEN width END) OVER w >= 10 THEN CASE WHEN valid THEN width END / quantile_cont(CASE WHEN valid THEN width END, 0.5) OVER w END AS rel_width FROM box2 WINDOW w AS (ORDER BY box_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""

_ENTRY = _BOX + """, hit AS (SELECT p.*, b.hi, b.lo, p.high_bid >= b.hi AS up, p.low_bid <= b.lo AS down FROM placed p JOIN boxes b USING (box_date) WHERE p.since >= 180 AND p.since < 420 AND (p.high_bid >= b.hi OR p.low_bid <= b.lo)),
first_hit AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY box_date ORDER BY bar) = 1),
trade AS (SELECT box_date, bar AS entry_bar, up AS long, hi, lo, CASE WHEN up THEN greatest(hi, open_bid) + (open_ask - open_bid) + 0.05 ELSE least(lo, open_bid) - 0.05 END AS entry,
  CASE WHEN up THEN lo ELSE hi + (open_ask - open_bid) END AS stop FROM first_hit WHERE NOT (up AND down))"""


def _replay_sql(variants: str, chosen: str, placed: str) -> str:
    """CTEs up to done, one row a variant and box that is chosen; variants: VALUES (variant, threshold, cost, slip, finish)."""
    return placed + f""", variants(variant, threshold, cost, slip, finish) AS ({variants}),
pick AS (SELECT b.*, v.* FROM boxes b, variants v WHERE {chosen}),
pth AS (SELECT p.*, b.variant, b.hi, b.lo, b.cost, b.slip, b.finish, p.extreme OR p.jump OR p.spread_bad AS bad, p.since - lag(p.since) OVER (PARTITION BY b.variant, p.box_date ORDER BY p.bar) AS gap
  FROM placed p JOIN pick b ON p.box_date = b.box_date WHERE p.since >= 180 AND p.since <= b.finish),
whole AS (SELECT variant, box_date, count(*) >= 0.75 * ((max(finish) - 180) / 15.0 + 1) AND count(*) >= 2 AND bool_or(since = 180) AND bool_or(since = finish) AND coalesce(max(gap), 0) <= 75 AND NOT bool_or(bad) AS complete FROM pth GROUP BY 1, 2),
first_hit AS (SELECT *, high_bid >= hi AS up, low_bid <= lo AS down FROM pth WHERE since < 420 AND (high_bid >= hi OR low_bid <= lo) QUALIFY row_number() OVER (PARTITION BY variant, box_date ORDER BY bar) = 1),
trade AS (SELECT variant, box_date, bar AS entry_bar, up AS long, cost, CASE WHEN up THEN greatest(hi, open_bid) + (open_ask - open_bid) * cost + slip ELSE least(lo, open_bid) - slip END AS entry,
  CASE WHEN up THEN lo ELSE hi + (open_ask - open_bid) END AS stop FROM first_hit WHERE NOT (up AND down)),
path AS (SELECT p.*, (p.cost - 1) * (p.open_ask - p.open_bid) / 2 AS extra, t.long, t.entry, t.stop, abs(t.entry - t.stop) AS risk FROM pth p JOIN trade t ON p.variant = t.variant AND p.box_date = t.box_date WHERE p.bar >= t.entry_bar AND abs(t.entry - t.stop) > 0),
stops AS (SELECT variant, box_date, bar, CASE WHEN long THEN least(stop, open_bid - extra) - slip ELSE greatest(stop, open_ask + extra) + slip END AS fill FROM path
  WHERE since < finish AND (CASE WHEN long THEN low_bid - extra <= stop ELSE high_ask + extra >= stop END) QUALIFY row_number() OVER (PARTITION BY variant, box_date ORDER BY bar) = 1),
times AS (SELECT variant, box_date, bar, CASE WHEN long THEN open_bid - extra - slip ELSE open_ask + extra + slip END AS fill FROM path WHERE since = finish),
moves AS (SELECT p.variant, p.box_date, greatest(0, max(CASE WHEN long THEN high_bid - entry ELSE entry - low_ask END / risk)) AS mfe, greatest(0, max(CASE WHEN long THEN entry - low_bid ELSE high_ask - entry END / risk)) AS mae
  FROM path p LEFT JOIN stops s ON s.variant = p.variant AND s.box_date = p.box_date WHERE CASE WHEN s.bar IS NOT NULL THEN p.bar <= s.bar ELSE p.since < p.finish END GROUP BY 1, 2),
done AS (SELECT k.variant, k.box_date, coalesce(w.complete, false) AS complete, f.bar IS NOT NULL AS broke, f.up AND f.down AS both_sides, t.entry_bar, t.long, t.entry, t.stop, abs(t.entry - t.stop) AS risk,
  s.bar IS NOT NULL AS stopped, coalesce(s.bar, x.bar) AS exit_bar, coalesce(s.fill, x.fill) AS exit, m.mfe, m.mae, ((CASE WHEN t.long THEN 1 ELSE -1 END) * (coalesce(s.fill, x.fill) - t.entry) - 0.07 * k.cost) / abs(t.entry - t.stop) AS r
  FROM pick k LEFT JOIN whole w USING (variant, box_date) LEFT JOIN first_hit f USING (variant, box_date) LEFT JOIN trade t USING (variant, box_date) LEFT JOIN stops s USING (variant, box_date) LEFT JOIN times x USING (variant, box_date) LEFT JOIN moves m USING (variant, box_date)),
stated AS (SELECT *, CASE WHEN NOT complete THEN 'incomplete_execution_path' WHEN NOT broke THEN 'no_breakout' WHEN both_sides THEN 'ambiguous_entry' WHEN risk <= 0 THEN 'invalid_risk' WHEN exit IS NULL THEN 'missing_exit_quote' WHEN stopped THEN 'stop' ELSE 'time' END AS status FROM done)"""


_REPLAY = _replay_sql("VALUES ('base', 1.2::DOUBLE, 1.0::DOUBLE, 0.05::DOUBLE, 720)", "true", _BOX)
#: The tables' quotes are thinner than the feed for which the rules' own share of path bars is meant.
THIN = RP.Rules(path_share=0.75)


def _boxed(spark, sf):
    f = flagged(spark, sf)
    return f, RP.boxes(f)


@query("box_build", sql(_BOX, f"SELECT box_date, {q6('hi', 'hi')}, {q6('lo', 'lo')}, {q6('width', 'width')}, n_blocks, valid FROM boxes"))
def box_build(spark, sf):
    _, b = _boxed(spark, sf)
    return b.select("box_date", r6("hi", "hi"), r6("lo", "lo"), r6("width", "width"), "n_blocks", "valid")


@query("box_rel_width_bars", sql(_BOX, f"SELECT box_date, {q6('rel_width', 'rel_width')} FROM boxes"))
def box_rel_width_bars(spark, sf):
    _, b = _boxed(spark, sf)
    return b.select("box_date", r6("rel_width", "rel_width"))


_PATHS = _BOX + ", pth AS (SELECT *, extreme OR jump OR spread_bad AS bad, since - lag(since) OVER (PARTITION BY box_date ORDER BY bar) AS gap FROM placed WHERE since >= 180)"


@query("path_complete", sql(_PATHS, "SELECT box_date, count(*) AS n_path, max(gap) AS largest_gap, bool_or(bad) AS suspect, count(*) >= 0.75 * 37 AND bool_or(since = 180) AND bool_or(since = 720) AND coalesce(max(gap), 0) <= 75 AND NOT bool_or(bad) AS complete FROM pth GROUP BY 1"))
def path_complete(spark, sf):
    return RP.path_quality(flagged(spark, sf), THIN).select("box_date", "n_path", F.col("largest_gap").cast("long").alias("largest_gap"), "suspect", "complete")


@query("first_touch_entry", sql(_ENTRY, "SELECT b.box_date, f.bar AS entry_bar, CASE WHEN f.bar IS NULL THEN 'none' WHEN f.up AND f.down THEN 'ambiguous' WHEN f.up THEN 'long' ELSE 'short' END AS side FROM boxes b LEFT JOIN first_hit f USING (box_date)"))
def first_touch_entry(spark, sf):
    f, b = _boxed(spark, sf)
    e = RP.entries(f, b)
    side = F.when(F.col("entry_bar").isNull(), "none").when(F.col("up") & F.col("down"), "ambiguous").when(F.col("up"), "long").otherwise("short")
    return e.select("box_date", "entry_bar", side.alias("side"))


@query("fill_price", sql(_ENTRY, f"SELECT box_date, long, {q6('entry', 'entry')}, {q6('stop', 'stop')}, {q6('abs(entry - stop)', 'risk')} FROM trade"))
def fill_price(spark, sf):
    f, b = _boxed(spark, sf)
    return RP.priced(RP.entries(f, b)).select("box_date", "long", r6("entry", "entry"), r6("stop", "stop"), r6("risk", "risk"))


def _replayed(spark, sf):
    """Every box, valid or not, wide or narrow: the queries compare the replay itself."""
    f, b = _boxed(spark, sf)
    return RP.replay(f, b.withColumns({"valid": F.lit(True), "rel_width": F.lit(0.0)}), THIN)


@query("stop_or_time_exit", sql(_REPLAY, f"SELECT box_date, stopped, exit IS NULL AS no_exit, {q6('exit', 'exit')} FROM stated WHERE complete AND risk > 0"))
def stop_or_time_exit(spark, sf):
    return _replayed(spark, sf).where("risk IS NOT NULL").select("box_date", "stopped", F.col("exit").isNull().alias("no_exit"), r6("exit", "exit"))


@query("mfe_mae", sql(_REPLAY, f"SELECT box_date, {q6('mfe', 'mfe')}, {q6('mae', 'mae')} FROM stated WHERE complete AND risk > 0"))
def mfe_mae(spark, sf):
    return _replayed(spark, sf).where("risk IS NOT NULL").select("box_date", r6("mfe", "mfe"), r6("mae", "mae"))


@query("trade_R", sql(_REPLAY, f"SELECT box_date, {q6('r', 'r')}, {q6('(epoch(exit_bar) - epoch(entry_bar)) / 60', 'minutes')} FROM stated WHERE complete AND risk > 0"))
def trade_R(spark, sf):
    return _replayed(spark, sf).where("risk IS NOT NULL").select("box_date", r6("r", "r"), r6("minutes", "minutes"))


@query("status_counts", sql(_REPLAY, "SELECT status, count(*) AS n FROM stated GROUP BY 1"))
def status_counts(spark, sf):
    return _replayed(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


_LDN = FLAGGED + """, cl AS (SELECT *, timezone('Europe/London', timezone('UTC', bar)) AS lt FROM flagged WHERE isodow(bar) < 6),
asia AS (SELECT lt::DATE AS date, max(high_bid) AS hi, min(low_bid) AS lo, last(mid_close ORDER BY bar) AS c FROM cl WHERE hour(lt) < 6 GROUP BY 1),
ldn AS (SELECT lt::DATE AS date, bar, high_bid, low_bid, mid_close FROM cl WHERE hour(lt) >= 8 AND hour(lt) < 12)"""


def _london_asia(spark, sf):
    from ..operators.sessions import local

    f = flagged(spark, sf).where(F.weekday("bar") < 5).withColumn("lt", local("bar", "Europe/London"))
    f = f.withColumn("date", F.to_date("lt"))
    asia = f.where(F.hour("lt") < 6).groupBy("date").agg(F.max("high_bid").alias("hi"), F.min("low_bid").alias("lo"), F.max_by("mid_close", "bar").alias("c"))
    return asia, f.where((F.hour("lt") >= 8) & (F.hour("lt") < 12)).select("date", "bar", "high_bid", "low_bid", "mid_close")


_BREACH = _LDN + """, ranges AS (SELECT *, CASE WHEN count(*) OVER w >= 20 THEN quantile_cont(hi - lo, 0.5) OVER w END AS base FROM asia WINDOW w AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
marked AS (SELECT l.*, hi, lo, base, high_bid > hi AS up, low_bid < lo AS down, min(CASE WHEN high_bid > hi OR low_bid < lo THEN bar END) OVER (PARTITION BY date) AS first FROM ldn l JOIN ranges USING (date)),
days AS (SELECT date, min(hi) AS hi, min(lo) AS lo, min(base) AS base, min(first) AS first, bool_or(up AND bar = first) AS up, bool_or(down AND bar = first) AS down,
  max(high_bid) FILTER (bar >= first) AS top, min(low_bid) FILTER (bar >= first) AS bottom, last(mid_close ORDER BY bar) AS c, timezone('UTC', timezone('Europe/London', date::TIMESTAMP + INTERVAL '8 hours')) AS starts FROM marked GROUP BY date),
sided AS (SELECT *, CASE WHEN first IS NULL THEN 'none' WHEN up AND down THEN 'ambiguous' WHEN up THEN 'up' ELSE 'down' END AS side FROM days)"""


@query("london_first_breach", sql(_BREACH, f"""SELECT date, side, date_diff('minute', starts, first)::BIGINT AS minutes,
  {q6("CASE side WHEN 'up' THEN (top - hi) / base WHEN 'down' THEN (lo - bottom) / base END", 'mfe')}, {q6("CASE side WHEN 'up' THEN (hi - bottom) / base WHEN 'down' THEN (top - lo) / base END", 'mae')},
  {q6("CASE side WHEN 'up' THEN (c - hi) / base WHEN 'down' THEN (lo - c) / base END", 'endpoint')} FROM sided"""))
def london_first_breach(spark, sf):
    """Every day with both sessions: the side of the Asian range that London breaks first (none, or both in one bar:
    ambiguous), minutes into the session, and from the breached level on the greatest excursions and the session's end, in
    units of the median range of the twenty days before."""
    from ..operators.sessions import LONDON, bounds

    asia, ldn = _london_asia(spark, sf)
    asia = asia.withColumn("base", R.prior(F.col("hi") - F.col("lo"), 20, "median", R.ordered("date")))
    x = ldn.join(asia, "date").withColumns({"up": F.col("high_bid") > F.col("hi"), "down": F.col("low_bid") < F.col("lo")})
    x = x.withColumn("first", F.min(F.when(F.col("up") | F.col("down"), F.col("bar"))).over(Window.partitionBy("date")))
    at, after = F.col("bar") == F.col("first"), F.col("bar") >= F.col("first")
    days = x.groupBy("date").agg(
        *[F.min(c).alias(c) for c in ("hi", "lo", "base", "first")], F.bool_or(F.col("up") & at).alias("up"), F.bool_or(F.col("down") & at).alias("down"),
        F.max(F.when(after, F.col("high_bid"))).alias("top"), F.min(F.when(after, F.col("low_bid"))).alias("bottom"), F.max_by("mid_close", "bar").alias("c"),
    )
    days = bounds(days, LONDON)
    up, hi, lo = F.col("side") == "up", F.col("hi"), F.col("lo")
    side = F.when(F.col("first").isNull(), "none").when(F.col("up") & F.col("down"), "ambiguous").when(F.col("up"), "up").otherwise("down")
    sec = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    told = days.withColumns({"side": side, "minutes": ((sec("first") - sec("starts")) / 60).cast("long")})
    sided = lambda a, b: F.try_divide(F.when(up, a).when(F.col("side") == "down", b), F.col("base"))
    top, bottom, c = F.col("top"), F.col("bottom"), F.col("c")
    return told.select("date", "side", "minutes", r6(sided(top - hi, lo - bottom), "mfe"), r6(sided(hi - bottom, top - lo), "mae"), r6(sided(c - hi, lo - c), "endpoint"))


@query("breach_distance", sql(_LDN, f"SELECT date, {q6('greatest(max(high_bid) - min(hi), min(lo) - min(low_bid), 0) / nullif(min(hi) - min(lo), 0)', 'distance')} FROM ldn JOIN asia USING (date) GROUP BY 1"))
def breach_distance(spark, sf):
    asia, ldn = _london_asia(spark, sf)
    x = ldn.groupBy("date").agg(F.max("high_bid").alias("h"), F.min("low_bid").alias("w")).join(asia, "date")
    return x.select("date", r6(RP.breach_distance(F.col("h"), F.col("w"), F.col("hi"), F.col("lo"), F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))), "distance"))


@query("close_location", sql(_LDN, f"SELECT date, {q6('(c - lo) / nullif(hi - lo, 0)', 'location')} FROM asia"))
def close_location(spark, sf):
    asia, _ = _london_asia(spark, sf)
    return asia.select("date", r6(F.try_divide(F.col("c") - F.col("lo"), F.col("hi") - F.col("lo")), "location"))


_W20, _W60 = "(ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)", "(ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
_FEATURES = _V + f""", m AS (SELECT *, count(*) OVER w >= 20 AS full20, quantile_cont(a, 0.5) OVER w AS ma, stddev_samp(a - l) OVER w AS sd, quantile_cont(l, 0.5) OVER w AS ml, quantile_cont(r, 0.5) OVER w AS mr, stddev_samp(l - r) OVER w AS sl,
  sum(a - l) OVER w AS s1, sum((a - l) * (a - l)) OVER w AS s2 FROM v WINDOW w AS {_W20}),
k AS (SELECT date, a, l, r, CASE WHEN full20 THEN ma END AS ma, CASE WHEN full20 THEN sd END AS sd, CASE WHEN full20 THEN ml END AS ml, CASE WHEN full20 THEN mr END AS mr, CASE WHEN full20 THEN sl END AS sl, CASE WHEN full20 THEN abs(s1) / sqrt(s2) END AS strength FROM m),
h AS (SELECT *, CASE WHEN count(ma) OVER w >= 60 THEN (ma > quantile_cont(ma, 0.5) OVER w)::INTEGER END AS highvol, (strength >= 1)::INTEGER AS trend FROM k WINDOW w AS {_W60})"""


@query("feature_ratios", sql(_FEATURES, f"""SELECT date, {q6('a / ma', 'c')}, {q6('ln(a / ma)', 'log_c')}, {q6('(a - l) / sd', 'd')}, {q6('ln(l / ml)', 'y_range')}, {q6('ln(r / mr)', 'y_rv')}, {q6('(l - r) / sl', 'y_return')}, (l > a)::INTEGER AS y_break,
  {q6('abs(l - a) / ma', 'gap')}, {q6('ln(ma)', 'base_log')}, {q6('(a - l) / sd * ln(a / ma)', 'd_x_c')}, highvol, trend, {q6('ln(a / ma) * highvol', 'c_x_vol')}, {q6('ln(a / ma) * trend', 'c_x_trend')} FROM h"""))
def feature_ratios(spark, sf):
    """The study's features of a day from causal baselines: compression, direction, outcomes in units of their own lagged
    medians and deviations, the gap, regimes, and their products."""
    o, a, l, r = R.ordered("date"), F.col("a"), F.col("l"), F.col("r")
    held = {"ma": (a, "median"), "sd": (a - l, "std"), "ml": (l, "median"), "mr": (r, "median"), "sl": (l - r, "std"), "s1": (a - l, "sum"), "s2": ((a - l) * (a - l), "sum")}
    x = valid(spark, sf).withColumns({name: R.prior(c, 20, how, o) for name, (c, how) in held.items()})
    x = x.withColumns({"highvol": (F.col("ma") > R.prior(F.col("ma"), 60, "median", o)).cast("int"), "trend": (F.try_divide(F.abs("s1"), F.sqrt("s2")) >= 1).cast("int")})
    ratio = lambda top, base: F.try_divide(top, F.col(base))
    log_c, d = F.log(ratio(a, "ma")), ratio(a - l, "sd")
    found = {"c": ratio(a, "ma"), "log_c": log_c, "d": d, "y_range": F.log(ratio(l, "ml")), "y_rv": F.log(ratio(r, "mr")), "y_return": ratio(l - r, "sl"), "gap": ratio(F.abs(l - a), "ma"), "base_log": F.log("ma"), "d_x_c": d * log_c, "c_x_vol": log_c * F.col("highvol"), "c_x_trend": log_c * F.col("trend")}
    return x.select("date", *[r6(c, name) for name, c in found.items()], (l > a).cast("int").alias("y_break"), "highvol", "trend")


_SIZED = TRADES + """, fr AS (SELECT *, CASE WHEN count(r) OVER w >= 20 AND round(sum(r) OVER w, 9) < -4 THEN 0.005::DOUBLE ELSE 0.01::DOUBLE END AS fraction FROM trades WINDOW w AS (PARTITION BY book ORDER BY n ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
eq AS (SELECT *, exp(sum(ln(1 + fraction * r)) OVER (PARTITION BY book ORDER BY n ROWS UNBOUNDED PRECEDING)) AS equity FROM fr),
sized AS (SELECT *, greatest(1.0, max(equity) OVER (PARTITION BY book ORDER BY n ROWS UNBOUNDED PRECEDING)) AS peak, 100000 * coalesce(lag(equity) OVER (PARTITION BY book ORDER BY n), 1) AS before FROM eq)"""


@query("sizing", sql(_SIZED, f"SELECT book, n, {q6n('before', 'before', 3)}, {q6n('before * fraction * r', 'profit', 3)}, {q6n('before * fraction / risk', 'ounces', 3)} FROM sized"))
def sizing(spark, sf):
    return K.sized(trades(spark, sf), by=BOOK).select("book", "n", *[r6n(c, c, 3) for c in ("before", "profit", "ounces")])


_DAYS = _SIZED + """, days AS (SELECT book, d::DATE AS date FROM (SELECT book, unnest(generate_series(min(exit_date)::TIMESTAMP, max(exit_date)::TIMESTAMP, INTERVAL '1 day')) AS d FROM trades GROUP BY book) WHERE isodow(d) < 6),
dr AS (SELECT book, date, coalesce(x, 0) AS ret FROM days LEFT JOIN (SELECT book, exit_date AS date, sum(fraction * r) AS x FROM sized GROUP BY 1, 2) USING (book, date))"""


@query("daily_densify", sql(_DAYS, f"SELECT book, date, {q6('ret', 'ret')} FROM dr"))
def daily_densify(spark, sf):
    return K.daily_returns(K.sized(trades(spark, sf), by=BOOK), BOOK).select("book", "date", r6("ret", "ret"))


_PERF = _DAYS + """, de AS (SELECT book, date, exp(sum(ln(1 + ret)) OVER (PARTITION BY book ORDER BY date ROWS UNBOUNDED PRECEDING)) AS e FROM dr),
dd AS (SELECT book, date, 1 - e / greatest(1.0, max(e) OVER (PARTITION BY book ORDER BY date ROWS UNBOUNDED PRECEDING)) > 1e-9 AS below FROM de),
dur AS (SELECT book, max(c) AS drawdown_days FROM (SELECT book, count(*) AS c FROM (SELECT book, below, row_number() OVER (PARTITION BY book ORDER BY date) - row_number() OVER (PARTITION BY book, below ORDER BY date) AS g FROM dd) WHERE below GROUP BY book, g) GROUP BY book),
streaks AS (SELECT book, max(c) AS losing_streak FROM (SELECT book, count(*) AS c FROM (SELECT book, r, row_number() OVER (PARTITION BY book ORDER BY n) - row_number() OVER (PARTITION BY book, r < 0 ORDER BY n) AS g FROM trades) WHERE r < 0 GROUP BY book, g) GROUP BY book),
months AS (SELECT book, avg((x > 1e-12)::INTEGER) AS monthly FROM (SELECT book, date_trunc('month', date) AS p, sum(ln(1 + ret)) AS x FROM dr GROUP BY 1, 2) GROUP BY book),
years AS (SELECT book, avg((x > 1e-12)::INTEGER) AS yearly FROM (SELECT book, year(date) AS p, sum(ln(1 + ret)) AS x FROM dr GROUP BY 1, 2) GROUP BY book),
perday AS (SELECT book, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS sharpe, avg(ret) / nullif(sqrt(avg(power(least(ret, 0), 2))), 0) * sqrt(252) AS sortino, stddev_samp(ret) * sqrt(252) AS volatility, count(*) AS business_days FROM dr GROUP BY book),
pertrade AS (SELECT book, count(*) AS n, avg(r) AS mean_r, quantile_cont(r, 0.5) AS median_r, sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0) AS profit_factor, avg((r > 0)::INTEGER) AS hit_rate,
  avg(r) FILTER (r > 0) / -(avg(r) FILTER (r < 0)) AS payoff, (avg(r * r * r) - 3 * avg(r) * avg(r * r) + 2 * power(avg(r), 3)) / power(var_pop(r), 1.5) AS skew_r, kurtosis_pop(r) AS kurtosis_r,
  max(1 - equity / peak) AS max_drawdown, arg_max(equity, n) AS final, power(arg_max(equity, n), 365.25 / greatest(date_diff('day', min(exit_date), max(exit_date)), 1)) - 1 AS cagr,
  2 * sum(before * fraction / risk) AS turnover, sum(minutes) / 60 AS exposure_hours FROM sized GROUP BY book)"""
_FIGURES = ("mean_r", "median_r", "profit_factor", "hit_rate", "payoff", "skew_r", "kurtosis_r", "max_drawdown", "final", "cagr", "turnover", "exposure_hours", "sharpe", "sortino", "volatility")


@query("perf_metrics", sql(_PERF, f"""SELECT book, n, {', '.join(q6(c, c) for c in _FIGURES)}, {q6('exposure_hours / (24 * business_days)', 'exposure_share')}, {q6('monthly', 'monthly_hit_rate')}, {q6('yearly', 'yearly_hit_rate')},
coalesce(drawdown_days, 0) AS drawdown_days, coalesce(losing_streak, 0) AS losing_streak FROM pertrade JOIN perday USING (book) JOIN months USING (book) JOIN years USING (book) LEFT JOIN dur USING (book) LEFT JOIN streaks USING (book)"""))
def perf_metrics(spark, sf):
    m = K.metrics(trades(spark, sf), by=BOOK)
    return m.select("book", "n", *[r6(c, c) for c in (*_FIGURES, "exposure_share")], r6("monthly_hit_rate", "monthly_hit_rate"), r6("yearly_hit_rate", "yearly_hit_rate"), "drawdown_days", "losing_streak")


VARIANTS = {f"{t}_{x}": {"threshold": t, "exit_hours": h} for t in (0.9, 1.0, 1.2) for x, h in (("0800", 9), ("1200", 13))} | {"cost_2": {"cost": 2.0}, "slip_25": {"slip": 0.25}}
_SWEEP = _replay_sql(
    "VALUES " + ", ".join(f"('{k}', {v.get('threshold', 1.2)}::DOUBLE, {v.get('cost', 1.0)}::DOUBLE, {v.get('slip', 0.05)}::DOUBLE, {(3 + v.get('exit_hours', 9)) * 60})" for k, v in VARIANTS.items()),
    "b.valid AND b.rel_width < v.threshold", _BOX.replace("<= 720", "<= 960"))


@query("param_sweep", sql(_SWEEP, f"SELECT variant, count(*) AS boxes, count(CASE WHEN complete AND risk > 0 THEN r END) AS trades, {q6('sum(CASE WHEN complete AND risk > 0 THEN r END)', 'total_r')}, count(*) FILTER (status = 'stop') AS stops FROM stated GROUP BY 1"))
def param_sweep(spark, sf):
    f, b = _boxed(spark, sf)
    all_trades = RP.swept(f, b, THIN, VARIANTS)
    return all_trades.groupBy("variant").agg(F.count("*").alias("boxes"), F.count("r").alias("trades"), r6(F.sum("r"), "total_r"), F.count_if(F.col("status") == "stop").alias("stops"))


@query("state_candidate", sql(_V, f"SELECT date, d > quantile_cont(d, 0.8) OVER w AS high_state FROM v QUALIFY count(*) OVER w >= 60 WINDOW w AS (ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)".replace("QUALIFY count(*) OVER w >= 60 WINDOW w AS (ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)", "WINDOW w AS (ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) QUALIFY count(*) OVER w >= 60")))
def state_candidate(spark, sf):
    w = R.ordered("date").rowsBetween(-60, -1)
    return valid(spark, sf).select("date", (F.col("d") > F.percentile("d", 0.8).over(w)).alias("high_state"), F.count("*").over(w).alias("n")).where("n >= 60").drop("n")


#: Paths of the reference.
MC_PATHS = 10_000


@query("mc_iid_block", None)
def mc_iid_block(spark, sf):
    t = trades(spark, sf)
    return K.monte_carlo(t, K.daily_returns(t.withColumn("fraction", F.lit(1.0)), BOOK), MC_PATHS)
