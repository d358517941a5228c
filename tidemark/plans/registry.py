"""Query registry: name -> (spark, sf_dir) -> DataFrame, with the matching oracle SQL where one exists."""

from __future__ import annotations

import functools

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    """Register a query under its name, with its oracle SQL if there is one."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @functools.wraps(f)
        def run(spark, sf_dir):
            # Timestamps carry no zone and mean UTC; epoch arithmetic on them goes through the session's zone, which a
            # plan takes over when it is analysed: here. The user's zone stands again afterwards.
            zone = spark.conf.get("spark.sql.session.timeZone")
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            try:
                return f(spark, sf_dir)
            finally:
                spark.conf.set("spark.sql.session.timeZone", zone)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return add


from . import aggregation, bars_and_sessions, connectors, events_and_risk, joins, nested, ordering, quality, rolling, scans, simulation, sketches, sources, sql_text, statistics, streams  # noqa: E402, F401
