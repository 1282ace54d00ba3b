"""Structured requests over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import pairing
from tallyloom.operators.request import Filter, Join, Measure, Request, run_request
from tallyloom.plans import bindings as b
from tallyloom.plans.book import BOOK


def _run(request, *names):
    def query(spark, folder):
        return run_request(request, {n: b.table(spark, folder, n) for n in names or (request.table,)})
    return query


def _add(name, sql, request, *names):
    BOOK.add(name, sql)(_run(request, *names))


_add("project_columns", "SELECT o_orderkey, o_totalprice FROM orders",
     Request("orders", columns=("o_orderkey", "o_totalprice"), limit=0))

_add("custom_expressions", """
SELECT l_orderkey, l_linenumber, l_quantity * 2 AS double_quantity, upper(l_linestatus) || '/' || l_returnflag AS flags
FROM lineitem""",
     Request("lineitem", columns=("l_orderkey", "l_linenumber"), limit=0, expressions=(
         ("double_quantity", "l_quantity * 2"),
         ("flags", "concat(upper(lineitem.l_linestatus), '/', l_returnflag)"))))

for _name, _op, _sql in (("eq", "=", "="), ("ne", "!=", "<>"), ("lt", "<", "<"), ("le", "<=", "<="),
                         ("gt", ">", ">"), ("ge", ">=", ">=")):
    _add(f"filter_compare_{_name}", f"SELECT p_partkey, p_size FROM part WHERE p_size {_sql} 25",
         Request("part", columns=("p_partkey", "p_size"), filters=(Filter("p_size", _op, "25"),), limit=0))

_add("filter_compare", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01 00:00:00'",
     Request("orders", columns=("o_orderkey", "o_orderdate"), filters=(Filter("o_orderdate", ">", "1998-01-01"),), limit=0))

_add("filter_columns", "SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem WHERE l_tax < l_discount",
     Request("lineitem", columns=("l_orderkey", "l_linenumber", "l_tax", "l_discount"), limit=0,
             filters=(Filter("l_tax", "<", other="l_discount"),)))

_add("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%'",
     Request("part", columns=("p_partkey", "p_name"), filters=(Filter("p_name", "LIKE", "%ring%"),), limit=0))

_add("filter_in", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
     Request("customer", columns=("c_custkey", "c_mktsegment"), limit=0,
             filters=(Filter("c_mktsegment", "IN", "BUILDING, MACHINERY,,"),)))

_add("filter_conjunction", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE o_orderstatus IN ('O', 'F') AND o_totalprice >= 100000 AND o_orderpriority LIKE '1%'""",
     Request("orders", columns=("o_orderkey", "o_orderstatus", "o_totalprice"), limit=0, filters=(
         Filter("o_orderstatus", "IN", "O,F"), Filter("o_totalprice", ">=", "100000"),
         Filter("o_orderpriority", "LIKE", "1%"))))

@BOOK.add("param_binding", """
SELECT p_partkey, named FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'O''Hare ' || p_brand ELSE p_brand END AS named FROM part)
WHERE named <> 'O''Hare Brand#11' AND named LIKE 'O''H%'""")
def param_binding(spark, folder):
    quoted = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("O'Hare "), F.col("p_brand"))).otherwise(F.col("p_brand"))
    parts = b.table(spark, folder, "part").select("p_partkey", quoted.alias("named"))
    request = Request("parts", columns=("p_partkey", "named"), limit=0,
                      filters=(Filter("named", "!=", "O'Hare Brand#11"), Filter("named", "LIKE", "O'H%")))
    return run_request(request, {"parts": parts})



# Joins

_add("join_inner", "SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
     Request("orders", columns=("o_orderkey", "o_custkey"), expressions=(("c_name", "customer.c_name"),), limit=0,
             joins=(Join("customer", "INNER JOIN", "o_custkey", "=", "c_custkey"),)), "orders", "customer")

_add("join_left", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey",
     Request("orders", columns=("o_orderkey",), limit=0,
             expressions=(("l_linenumber", "lineitem.l_linenumber"), ("l_quantity", "lineitem.l_quantity")),
             joins=(Join("lineitem", "LEFT JOIN", "o_orderkey", "=", "l_orderkey"),)), "orders", "lineitem")

_add("join_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey",
     Request("orders", columns=("o_orderkey",), expressions=(("c_custkey", "customer.c_custkey"),), limit=0,
             joins=(Join("customer", "RIGHT JOIN", "o_custkey", "=", "c_custkey"),)), "orders", "customer")

_add("join_full", "SELECT s_suppkey, c_custkey FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey",
     Request("supplier", columns=("s_suppkey",), expressions=(("c_custkey", "customer.c_custkey"),), limit=0,
             joins=(Join("customer", "FULL OUTER JOIN", "s_suppkey", "=", "c_custkey"),)), "supplier", "customer")

for _name, _op in (("", "<"), ("_le", "<="), ("_gt", ">"), ("_ge", ">="), ("_ne", "!=")):
    _add(f"join_theta{_name}",
         f"SELECT c_custkey, r_regionkey FROM customer JOIN region ON c_nationkey {_op} r_regionkey",
         Request("customer", columns=("c_custkey",), expressions=(("r_regionkey", "region.r_regionkey"),), limit=0,
                 joins=(Join("region", "INNER JOIN", "c_nationkey", _op, "r_regionkey"),)), "customer", "region")


@BOOK.add("join_like", """
SELECT c_custkey, c_mktsegment, pattern FROM customer
JOIN (SELECT DISTINCT substr(p_type, 1, 1) || '%' AS pattern FROM part) ON c_mktsegment LIKE pattern""")
def join_like(spark, folder):
    patterns = b.table(spark, folder, "part").select(F.concat(F.substring("p_type", 1, 1), F.lit("%")).alias("pattern"))
    request = Request("customer", columns=("c_custkey", "c_mktsegment"), limit=0,
                      expressions=(("pattern", "patterns.pattern"),),
                      joins=(Join("patterns", "INNER JOIN", "c_mktsegment", "LIKE", "pattern"),))
    return run_request(request, {"customer": b.table(spark, folder, "customer"), "patterns": patterns.distinct()})


@BOOK.add("like_index", """
SELECT t.c_name AS "text", p.pattern FROM (SELECT DISTINCT c_name FROM customer) t
JOIN (SELECT DISTINCT '%' || right(c_name, 3) AS pattern FROM customer UNION SELECT DISTINCT '%' || left(right(s_name, 4), 3) || '_' FROM supplier) p
ON t.c_name LIKE p.pattern""")
def like_index(spark, folder):
    """Names and patterns matched the way two large sides are, by the rarest piece of each pattern."""
    names = b.table(spark, folder, "customer").select(F.col("c_name").alias("_text"))
    ends = names.select(F.concat(F.lit("%"), F.right("_text", F.lit(3))).alias("_pattern"))
    inner = b.table(spark, folder, "supplier").select(F.concat(F.lit("%"), F.left(F.right("s_name", F.lit(4)), F.lit(3)), F.lit("_")).alias("_pattern"))
    found = pairing.like_matches(names, ends.unionByName(inner))
    return found.select(F.col("_text").alias("text"), F.col("_pattern").alias("pattern"))


_add("join_literal", """
SELECT c_custkey, r_name FROM customer LEFT JOIN region ON c_mktsegment = 'BUILDING'""",
     Request("customer", columns=("c_custkey",), expressions=(("r_name", "region.r_name"),), limit=0,
             joins=(Join("region", "LEFT JOIN", "c_mktsegment", "=", literal="BUILDING"),)), "customer", "region")


@BOOK.add("join_membership", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def join_membership(spark, folder):
    indebted = b.customers(spark, folder).filter(F.col("c_acctbal") < 0).select("c_custkey")
    request = Request("orders", columns=("o_orderkey", "o_custkey"), limit=0,
                      joins=(Join("indebted", "INNER JOIN", "o_custkey", "IN", "c_custkey"),))
    return run_request(request, {"orders": b.table(spark, folder, "orders"), "indebted": indebted})


@BOOK.add("join_chain", """
SELECT l_orderkey, l_linenumber, l_suppkey, s_name, p_name, o_orderstatus
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
JOIN orders ON l_orderkey = o_orderkey""")
def join_chain(spark, folder):
    names = ("lineitem", "supplier", "part", "orders")
    request = Request(
        "lineitem", columns=("l_orderkey", "l_linenumber", "l_suppkey"), limit=0,
        expressions=(("s_name", "sales.s_name"), ("p_name", "part.p_name"), ("o_orderstatus", "orders.o_orderstatus")),
        joins=(Join("supplier", "LEFT JOIN", "l_suppkey", "=", "s_suppkey", alias="sales"),
               Join("part", "INNER JOIN", "l_partkey", "=", "p_partkey"),
               Join("orders", "INNER JOIN", "l_orderkey", "=", "o_orderkey")))
    return run_request(request, {n: b.table(spark, folder, n) for n in names})


# Aggregates, sort, limit

_add("spec_aggregate", """
SELECT l_returnflag, l_linestatus, count(*) AS count_all, count(l_tax) AS count_l_tax, min(l_discount) AS min_l_discount,
       max(l_extendedprice) AS max_l_extendedprice, CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber,
       avg(l_linenumber) AS avg_l_linenumber
FROM lineitem GROUP BY l_returnflag, l_linestatus""",
     Request("lineitem", group_by=("l_returnflag", "l_linestatus"), limit=0, measures=(
         Measure("COUNT"), Measure("COUNT", "l_tax"), Measure("MIN", "l_discount"), Measure("MAX", "l_extendedprice"),
         Measure("SUM", "l_linenumber"), Measure("AVG", "l_linenumber"))))

_add("spec_first_last", """
SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS first_o_orderstatus,
       arg_max(o_orderpriority, o_orderkey) AS last_o_orderpriority FROM orders GROUP BY o_custkey""",
     Request("orders", group_by=("o_custkey",), limit=0, measures=(
         Measure("FIRST", "o_orderstatus", order_by="o_orderkey"),
         Measure("LAST", "o_orderpriority", order_by="o_orderkey"))))

_add("spec_concat_ws", """
SELECT p_brand, string_agg(p_name, '|' ORDER BY p_name) AS concat_ws_p_name, string_agg(p_type, ', ' ORDER BY p_type) AS concat_ws_p_type,
       count(*) AS count_all FROM part GROUP BY p_brand""",
     Request("part", group_by=("p_brand",), limit=0, measures=(
         Measure("CONCAT_WS", "p_name", separator="|"), Measure("CONCAT_WS", "p_type", separator=", "), Measure("COUNT"))))

_add("spec_expression", """
SELECT l_returnflag, lower(l_returnflag) || '!' AS flag, count(*) AS count_all, max(l_linenumber) - min(l_linenumber) AS span
FROM lineitem GROUP BY l_returnflag""",
     Request("lineitem", group_by=("l_returnflag",), limit=0, measures=(Measure("COUNT"),), expressions=(
         ("flag", "concat(lower(l_returnflag), '!')"), ("span", "max(l_linenumber) - min(l_linenumber)"))))

_add("filter_fraction", "SELECT p_partkey, p_size FROM part WHERE p_size > 24.5 AND p_size <= 30.25",
     Request("part", columns=("p_partkey", "p_size"), limit=0,
             filters=(Filter("p_size", ">", "24.5"), Filter("p_size", "<=", "30.25"))))

_add("sort_hidden", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
     Request("orders", columns=("o_orderkey",), order_by=("o_totalprice DESC", "o_orderkey"), limit=50))

_add("sort_multi", "SELECT o_orderstatus, o_totalprice, o_orderkey FROM orders",
     Request("orders", columns=("o_orderstatus", "o_totalprice", "o_orderkey"), limit=0,
             order_by=("o_orderstatus", "o_totalprice DESC", "o_orderkey ASC")))

_add("limit_rows", "SELECT l_extendedprice, l_orderkey, l_linenumber, l_partkey FROM lineitem "
     "ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100",
     Request("lineitem", columns=("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"),
             order_by=("l_extendedprice DESC", "l_orderkey", "l_linenumber", "l_partkey")))
