"""Nested documents built from whole tables, and what a walk finds in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nested as N
from ..sources.market import table
from .registry import query


def documents(spark, sf):
    """(o_orderkey, doc): an order with its customer (and that one's nation) and its lines, as JSON."""
    line = F.struct(F.col("l_linenumber").alias("number"), F.struct(F.col("l_partkey").alias("key"), F.struct(F.col("l_suppkey").alias("key"), F.array(F.col("l_returnflag"), F.col("l_linestatus")).alias("flags")).alias("supplier")).alias("part"))
    # Few lines share an order, so they are shuffled as they are, and not gathered before.
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").repartition("l_orderkey")
    lines = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    rows = o.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    who = F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("key"), (F.col("c_nationkey") < 5).alias("near")).alias("nation"))
    doc = F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"), who.alias("customer"), F.coalesce("lines", F.array()).alias("lines")))
    return rows.select("o_orderkey", doc.alias("doc"))


_DOCS = """lines AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) - 1 AS i, * EXCLUDE (l_orderkey) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)),
orders_of AS (SELECT o_orderkey AS k, o_orderpriority, c_custkey, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey),
line_values AS (SELECT l_orderkey AS k, '$.lines[' || i || ']' AS p, * FROM lines)"""
_FLAT = [
    ("orders_of", "'$'", "NULL", 0, "object", "NULL"),
    ("orders_of", "'$.key'", "'key'", 1, "number", "k"),
    ("orders_of", "'$.priority'", "'priority'", 1, "string", "o_orderpriority"),
    ("orders_of", "'$.customer'", "'customer'", 1, "object", "NULL"),
    ("orders_of", "'$.customer.key'", "'key'", 2, "number", "c_custkey"),
    ("orders_of", "'$.customer.name'", "'name'", 2, "string", "c_name"),
    ("orders_of", "'$.customer.nation'", "'nation'", 2, "object", "NULL"),
    ("orders_of", "'$.customer.nation.key'", "'key'", 3, "number", "c_nationkey"),
    ("orders_of", "'$.customer.nation.near'", "'near'", 3, "boolean", "c_nationkey < 5"),
    ("orders_of", "'$.lines'", "'lines'", 1, "array", "NULL"),
    ("line_values", "p", "NULL", 2, "object", "NULL"),
    ("line_values", "p || '.number'", "'number'", 3, "number", "l_linenumber"),
    ("line_values", "p || '.part'", "'part'", 3, "object", "NULL"),
    ("line_values", "p || '.part.key'", "'key'", 4, "number", "l_partkey"),
    ("line_values", "p || '.part.supplier'", "'supplier'", 4, "object", "NULL"),
    ("line_values", "p || '.part.supplier.key'", "'key'", 5, "number", "l_suppkey"),
    ("line_values", "p || '.part.supplier.flags'", "'flags'", 5, "array", "NULL"),
    ("line_values", "p || '.part.supplier.flags[0]'", "NULL", 6, "string", "l_returnflag"),
    ("line_values", "p || '.part.supplier.flags[1]'", "NULL", 6, "string", "l_linestatus"),
]
_WALK = f"WITH {_DOCS}, walked AS (" + " UNION ALL ".join(f"SELECT k AS o_orderkey, {p} AS path, {name}::VARCHAR AS name, {d} AS depth, '{kind}' AS kind, ({v})::VARCHAR AS value FROM {t}" for t, p, name, d, kind, v in _FLAT) + ")"


@query("json_walk", f"{_WALK} SELECT * FROM walked")
def json_walk(spark, sf):
    """Every value of every order's document, at any depth."""
    return N.walk(documents(spark, sf), "o_orderkey", "doc")


@query("json_find_any_depth", f"{_WALK} SELECT o_orderkey, path, value FROM walked WHERE name = 'key' AND regexp_matches(value, '7$')")
def json_find_any_depth(spark, sf):
    """Keys at any depth of the documents that end in 7."""
    return N.found(documents(spark, sf), "o_orderkey", "doc", "key", "7$").select("o_orderkey", "path", "value")


@query("json_shape", f"{_WALK} SELECT regexp_replace(path, '\\[[0-9]+\\]', '[*]', 'g') AS shape, kind, count(*) AS n, count(DISTINCT value) AS n_values, max(depth) AS depth FROM walked GROUP BY ALL")
def json_shape(spark, sf):
    """The paths that occur, with array positions left out: a schema found in the data."""
    return N.shapes(documents(spark, sf), "o_orderkey", "doc")
