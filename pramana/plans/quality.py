"""Profiles of nested data and checks of tables against each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from pramana.operators import filechecks as K
from pramana.operators.profiles import nested_profile
from pramana.plans import derive as D
from pramana.plans.catalogue import query, r6


def order_documents(spark, sf):
    """(j): each order as JSON, its lines as objects in an array, with arrays in them; keys that some lack, values of two kinds."""
    li = D.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("long").alias("q"), F.col("l_discount").cast("double").alias("d"), "l_partkey", "l_suppkey")
    seen = F.when(F.col("l_partkey") % 3 == 0, F.array(F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long"))).otherwise(F.array().cast("array<bigint>"))
    line = F.struct("n", "q", "d", seen.alias("seen"), F.when(F.col("q") > 25, F.struct(F.concat(F.lit("n"), F.col("q").cast("string")).alias("t"))).alias("note"))
    lines = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(line).alias("lines"))
    o = D.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("c"), F.col("o_orderpriority").alias("p")).join(lines, "o_orderkey", "left")
    who = F.struct(F.col("c").alias("id"), F.when(F.col("c") % 4 == 0, F.to_json(F.struct("p"))).otherwise(F.col("p")).alias("level"))
    return o.select(F.to_json(F.struct("o_orderkey", who.alias("who"), "lines"), {"ignoreNullFields": "false"}).alias("j"))


_LINES = "lines AS (SELECT l_orderkey AS o_orderkey, list({'n': l_linenumber, 'q': CAST(l_quantity AS BIGINT), 'd': CAST(l_discount AS DOUBLE), 'seen': CASE WHEN l_partkey % 3 = 0 THEN [CAST(l_partkey AS BIGINT), CAST(l_suppkey AS BIGINT)] ELSE [] END, 'note': CASE WHEN CAST(l_quantity AS BIGINT) > 25 THEN {'t': 'n' || CAST(l_quantity AS BIGINT)} END}) AS lines FROM lineitem GROUP BY 1)"
_DOCS = "docs AS (SELECT to_json({'o_orderkey': o_orderkey, 'who': {'id': CAST(o_custkey AS BIGINT), 'level': CASE WHEN o_custkey % 4 = 0 THEN CAST(to_json({'p': o_orderpriority}) AS VARCHAR) ELSE o_orderpriority END}, 'lines': lines}) AS j FROM orders LEFT JOIN lines USING (o_orderkey))"


@query(
    """SELECT path, kind, count(*) AS n, round(min(x), 6) AS low, round(max(x), 6) AS high, CAST(min(size) AS INTEGER) AS shortest, CAST(max(size) AS INTEGER) AS longest FROM (
  SELECT regexp_replace(fullkey, '\\[[0-9]+\\]', '[*]', 'g') AS path, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
         CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(atom AS DOUBLE) END AS x, CASE WHEN type = 'VARCHAR' THEN length(atom ->> '$') WHEN type = 'ARRAY' THEN json_array_length(value) END AS size
  FROM docs, json_tree(docs.j)) GROUP BY 1, 2""",
    (_LINES, _DOCS),
)
def nested_json_profile(spark, sf):
    p = nested_profile(order_documents(spark, sf), "j")
    return p.select("path", "kind", "n", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"), "shortest", "longest")


def _sql(name, level, n, bad):
    return f"SELECT '{name}' AS \"check\", ({n}) AS n, (SELECT count(*) FROM ({bad})) AS bad, CASE WHEN (SELECT count(*) FROM ({bad})) = 0 THEN 'PASS' ELSE '{level}' END AS status, coalesce((SELECT string_agg(what, '|' ORDER BY what) FROM (SELECT CAST(what AS VARCHAR) AS what FROM ({bad}) ORDER BY 1 LIMIT 5)), '') AS samples"


@query(
    " UNION ALL ".join(
        [
            _sql("lines have an order", "FAIL", "SELECT count(DISTINCT l_orderkey) FROM lineitem", "SELECT DISTINCT l_orderkey AS what FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)"),
            _sql("orders have lines", "WARN", "SELECT count(DISTINCT o_orderkey) FROM orders", "SELECT DISTINCT o_orderkey AS what FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
            _sql("customers have orders", "WARN", "SELECT count(DISTINCT c_custkey) FROM customer", "SELECT DISTINCT c_custkey AS what FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
            _sql("a line is there once", "FAIL", "SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)", "SELECT l_orderkey || '/' || l_linenumber AS what FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"),
            _sql("prices are above 1000", "WARN", "SELECT count(*) FROM orders", "SELECT o_orderkey AS what FROM orders WHERE NOT coalesce(o_totalprice > 1000, false)"),
            _sql("priorities occur", "WARN", "SELECT 3", "SELECT * FROM (VALUES ('1-URGENT'), ('5-LOW'), ('9-NEVER')) v(what) WHERE what NOT IN (SELECT o_orderpriority FROM orders)"),
        ]
    )
)
def table_checks(spark, sf):
    li, o, c = (D.table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    found = K.report(
        [
            K.has_partner("lines have an order", li.select(F.col("l_orderkey").alias("k")), o.select(F.col("o_orderkey").alias("k")), ["k"]),
            K.has_partner("orders have lines", o.select(F.col("o_orderkey").alias("k")), li.select(F.col("l_orderkey").alias("k")), ["k"], "WARN"),
            K.has_partner("customers have orders", c.select(F.col("c_custkey").alias("k")), o.select(F.col("o_custkey").alias("k")), ["k"], "WARN"),
            K.is_unique("a line is there once", li, ["l_orderkey", "l_linenumber"]),
            K.holds("prices are above 1000", o, F.col("o_totalprice") > 1000, F.col("o_orderkey"), "WARN"),
            K.takes_all("priorities occur", o, "o_orderpriority", ["1-URGENT", "5-LOW", "9-NEVER"]),
        ]
    )
    return found.withColumn("samples", F.array_join("samples", "|"))
