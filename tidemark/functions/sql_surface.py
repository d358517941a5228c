"""The library in SQL text: losses and intervals as SQL functions, the breakout replay as a table function.

register(spark) makes them known to a session. The functions are SQL expressions, which the optimiser inlines like any
other. The table function takes a table of bars PARTITION BY the box and ORDER BY the bar, so Spark deals boxes to tasks
and sorts each; it keeps a few numbers a box and reads every bar once.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.replay import Rules

#: name -> (parameters, expression)
FUNCTIONS = {
    "squared_loss": ("actual DOUBLE, forecast DOUBLE", "(actual - forecast) * (actual - forecast)"),
    "absolute_loss": ("actual DOUBLE, forecast DOUBLE", "abs(actual - forecast)"),
    "qlike_loss": ("actual DOUBLE, forecast DOUBLE", "try_divide(actual, forecast) - ln(try_divide(actual, forecast)) - 1"),
    "saved_share": ("base DOUBLE, better DOUBLE", "try_divide(base - better, base)"),
    "clark_west_gain": ("actual DOUBLE, base DOUBLE, enhanced DOUBLE", "pow(ln(actual) - ln(base), 2) - pow(ln(actual) - ln(enhanced), 2) + pow(ln(base) - ln(enhanced), 2)"),
    "wilson_low": ("k DOUBLE, n DOUBLE, z DOUBLE", "(k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)"),
    "wilson_high": ("k DOUBLE, n DOUBLE, z DOUBLE", "(k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)"),
}


def replayed(rules: Rules):
    """A table function over bars of (box_date, bar, since, suspect, open and high and low quotes, hi, lo): one row a box."""
    start, end = rules.box_hours * 60, (rules.box_hours + rules.exit_hours) * 60
    until, most_gap = start + rules.entry_hours * 60, rules.path_gap_bars * rules.base_minutes
    enough = max(2, rules.path_share * ((end - start) / rules.base_minutes + 1))
    cost, slip, commission = rules.cost, rules.slip, rules.commission

    class Replay:
        def __init__(self):
            self.n, self.gap, self.first, self.last, self.suspect, self.box = 0, 0, None, None, False, None
            self.up = self.down = False
            self.entry = self.stop = self.exit = None
            self.stopped = False

        def eval(self, row):
            since = row["since"]
            self.box, self.n, self.suspect = row["box_date"], self.n + 1, self.suspect or bool(row["suspect"])
            if self.last is None:
                self.first = since
            else:
                self.gap = max(self.gap, since - self.last)
            self.last = since
            if not (self.up or self.down) and since < until:
                self._enter(row)
            if self.entry is not None and abs(self.entry - self.stop) > 0 and not self.stopped and self.exit is None:
                self._leave(row, since)

        def _enter(self, row):
            self.up, self.down = row["high_bid"] >= row["hi"], row["low_bid"] <= row["lo"]
            if self.up != self.down:
                spread = row["open_ask"] - row["open_bid"]
                if self.up:
                    self.entry, self.stop = max(row["hi"], row["open_bid"]) + spread * cost + slip, row["lo"]
                else:
                    self.entry, self.stop = min(row["lo"], row["open_bid"]) - slip, row["hi"] + spread

        def _leave(self, row, since):
            extra = (cost - 1) * (row["open_ask"] - row["open_bid"]) / 2
            bid, ask = row["open_bid"] - extra, row["open_ask"] + extra
            if since == end:
                self.exit = bid - slip if self.up else ask + slip
            elif self.up and row["low_bid"] - extra <= self.stop:
                self.stopped, self.exit = True, min(self.stop, bid) - slip
            elif self.down and row["high_ask"] + extra >= self.stop:
                self.stopped, self.exit = True, max(self.stop, ask) + slip

        def terminate(self):
            if self.box is None:
                return
            whole = self.n >= enough and self.first == start and self.last == end and self.gap <= most_gap and not self.suspect
            risk = None if self.entry is None else abs(self.entry - self.stop)
            status = "time"
            for odd, name in ((not whole, "incomplete_execution_path"), (not (self.up or self.down), "no_breakout"), (self.up and self.down, "ambiguous_entry"), (risk == 0, "invalid_risk"), (self.exit is None, "missing_exit_quote"), (self.stopped, "stop")):
                if odd:
                    status = name
                    break
            if not whole or not risk:
                yield self.box, status, None, None, None, None
            else:
                r = None if self.exit is None else ((1 if self.up else -1) * (self.exit - self.entry) - commission * cost) / risk
                yield self.box, status, self.entry, self.stop, self.exit, r

    return udtf(Replay, returnType="box_date date, status string, entry double, stop double, exit double, r double")


def register(spark: SparkSession, rules: Rules = Rules()) -> None:
    """FUNCTIONS and breakout_replay, for this session."""
    for name, (parameters, expression) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS DOUBLE RETURN {expression}")
    spark.udtf.register("breakout_replay", replayed(rules))
