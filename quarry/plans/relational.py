"""The relational surface benchmark questions ask for.

Each query is written with the DataFrame API (Catalyst sees one plan, pushes
filters into the parquet scan and picks broadcast or sort-merge joins from
file statistics).  The oracle is the SQL a benchmark gold query would be.
SQLite semantics that differ from Spark are handled explicitly:

* ``LIKE`` is ASCII case-insensitive in SQLite -> ``ilike``;
* bare columns next to ``max()`` -> ``max_by``; other bare columns ->
  ``any_value`` (Spark rejects them with ``MISSING_GROUP_BY``);
* ``LIMIT`` after ``ORDER BY`` always gets a unique tie-break key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .reg import Registry

R = Registry()
c = F.col


# ------------------------------------------------------------------ projection
@R.query("proj_columns", "SELECT c_custkey, c_name FROM customer")
def proj_columns(t):
    return t.customer.select("c_custkey", "c_name")


@R.query("proj_star", "SELECT * FROM supplier")
def proj_star(t):
    return t.supplier.select("*")


@R.query("proj_alias", """
SELECT n.n_name AS nation, r.r_name AS region
FROM nation AS n JOIN region AS r ON n.n_regionkey = r.r_regionkey""")
def proj_alias(t):
    n, r = t.nation.alias("n"), t.region.alias("r")
    return n.join(r, c("n.n_regionkey") == c("r.r_regionkey")).select(
        c("n.n_name").alias("nation"), c("r.r_name").alias("region"))


# ------------------------------------------------------------------ filters
@R.query("filter_eq", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_eq(t):
    return t.customer.filter(c("c_mktsegment") == "BUILDING").select("c_custkey", "c_name")


@R.query("filter_range", """
SELECT p_partkey, p_size, p_retailprice FROM part
WHERE p_size > 40 AND p_retailprice < 1500 AND p_partkey >= 10""")
def filter_range(t):
    return (t.part.filter((c("p_size") > 40) & (c("p_retailprice") < 1500) & (c("p_partkey") >= 10))
            .select("p_partkey", "p_size", "p_retailprice"))


@R.query("filter_ne_cols", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey <> o_orderkey % 1500""")
def filter_ne_cols(t):
    return t.orders.filter(c("o_custkey") != c("o_orderkey") % 1500).select("o_orderkey", "o_custkey")


@R.query("filter_and", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice > 300000 AND o_orderpriority = '1-URGENT'""")
def filter_and(t):
    return (t.orders.filter((c("o_orderstatus") == "F") & (c("o_totalprice") > 300000)
                            & (c("o_orderpriority") == "1-URGENT"))
            .select("o_orderkey", "o_totalprice"))


@R.query("filter_or", """
SELECT o_orderkey, o_orderpriority FROM orders
WHERE o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' OR o_totalprice > 450000""")
def filter_or(t):
    return (t.orders.filter(c("o_orderpriority").isin("1-URGENT", "2-HIGH") | (c("o_totalprice") > 450000))
            .select("o_orderkey", "o_orderpriority"))


@R.query("filter_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def filter_between(t):
    return t.part.filter(c("p_size").between(10, 20)).select("p_partkey", "p_size")


@R.query("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%'")
def filter_like(t):
    # SQLite LIKE ignores ASCII case; Spark LIKE does not -> ilike.
    return t.part.filter(c("p_name").ilike("%RED%")).select("p_partkey", "p_name")


@R.query("filter_flag", "SELECT doc_id, quality FROM labels WHERE toxic = 1")
def filter_flag(t):
    return t.labels.filter(c("toxic") == 1).select("doc_id", "quality")


# ------------------------------------------------------------------ aggregates
@R.query("agg_count_star", "SELECT count(*) AS n FROM orders")
def agg_count_star(t):
    return t.orders.agg(F.count(F.lit(1)).alias("n"))


@R.query("agg_count_where", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def agg_count_where(t):
    return t.orders.filter(c("o_orderstatus") == "O").agg(F.count(F.lit(1)).alias("n"))


@R.query("agg_count_col", """
SELECT count(CASE WHEN l_discount > 0.05 THEN l_discount END) AS n_col, count(*) AS n_rows FROM lineitem""")
def agg_count_col(t):
    # COUNT(col) skips NULLs: the CASE without ELSE yields NULL for small discounts.
    return t.lineitem.agg(F.count(F.when(c("l_discount") > 0.05, c("l_discount"))).alias("n_col"),
                          F.count(F.lit(1)).alias("n_rows"))


@R.query("agg_count_distinct", """
SELECT count(DISTINCT o_custkey) AS n_cust,
       (SELECT count(DISTINCT n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey
        WHERE c_acctbal < 0) AS n_nation_neg
FROM orders""")
def agg_count_distinct(t):
    a = t.orders.agg(F.countDistinct("o_custkey").alias("n_cust"))
    b = (t.customer.filter(c("c_acctbal") < 0)
         .join(t.nation, c("c_nationkey") == c("n_nationkey"))
         .agg(F.countDistinct("n_name").alias("n_nation_neg")))
    return a.crossJoin(b)


@R.query("agg_sum", "SELECT round(sum(l_quantity), 2) AS sum_qty FROM lineitem WHERE l_returnflag = 'R'")
def agg_sum(t):
    return t.lineitem.filter(c("l_returnflag") == "R").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"))


@R.query("agg_avg", "SELECT round(avg(c_acctbal), 6) AS avg_bal FROM customer WHERE c_mktsegment = 'AUTOMOBILE'")
def agg_avg(t):
    return (t.customer.filter(c("c_mktsegment") == "AUTOMOBILE")
            .agg(F.round(F.avg("c_acctbal"), 6).alias("avg_bal")))


@R.query("agg_min_max", "SELECT min(p_retailprice) AS min_price, max(p_retailprice) AS max_price FROM part")
def agg_min_max(t):
    return t.part.agg(F.min("p_retailprice").alias("min_price"), F.max("p_retailprice").alias("max_price"))


@R.query("agg_multi", """
SELECT count(*) AS n, round(avg(s_acctbal), 6) AS avg_bal, min(s_acctbal) AS min_bal,
       max(s_acctbal) AS max_bal, round(sum(s_acctbal), 2) AS sum_bal FROM supplier""")
def agg_multi(t):
    return t.supplier.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s_acctbal"), 6).alias("avg_bal"),
                          F.min("s_acctbal").alias("min_bal"), F.max("s_acctbal").alias("max_bal"),
                          F.round(F.sum("s_acctbal"), 2).alias("sum_bal"))


@R.query("group_count", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def group_count(t):
    return t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@R.query("group_avg_max", """
SELECT p_brand, round(avg(p_retailprice), 6) AS avg_price, max(p_size) AS max_size
FROM part GROUP BY p_brand""")
def group_avg_max(t):
    return t.part.groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 6).alias("avg_price"),
                                         F.max("p_size").alias("max_size"))


@R.query("group_no_agg", """
SELECT c_nationkey, any_value(n_name) AS n_name
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey""")
def group_no_agg(t):
    # GROUP BY with a bare column that depends on the key: any_value is exact.
    return (t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey"))
            .groupBy("c_nationkey").agg(F.any_value("n_name").alias("n_name")))


@R.query("agg_bare_column", """
SELECT c_mktsegment, arg_max(c_name, c_acctbal) AS c_name, max(c_acctbal) AS max_bal
FROM customer GROUP BY c_mktsegment""")
def agg_bare_column(t):
    # SQLite: SELECT c_name, max(c_acctbal) ... returns the row holding the max.
    return t.customer.groupBy("c_mktsegment").agg(F.max_by("c_name", "c_acctbal").alias("c_name"),
                                                  F.max("c_acctbal").alias("max_bal"))


# ------------------------------------------------------------------ joins
@R.query("join_inner_2", """
SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def join_inner_2(t):
    return (t.orders.join(t.customer, c("o_custkey") == c("c_custkey"))
            .select("o_orderkey", "c_name"))


@R.query("join_inner_3", """
SELECT DISTINCT c.c_name
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
JOIN lineitem l ON l.l_orderkey = o.o_orderkey
WHERE l.l_returnflag = 'R' AND o.o_orderpriority = '1-URGENT'""")
def join_inner_3(t):
    li = t.lineitem.filter(c("l_returnflag") == "R").select("l_orderkey").distinct()
    o = t.orders.filter(c("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_custkey")
    return (t.customer.join(o.join(li, c("l_orderkey") == c("o_orderkey"), "left_semi"),
                            c("c_custkey") == c("o_custkey"))
            .select("c_name").distinct())


@R.query("join_filter", """
SELECT s.s_suppkey, s.s_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
WHERE n.n_name = 'NATION_7' AND s.s_acctbal > 0""")
def join_filter(t):
    return (t.supplier.filter(c("s_acctbal") > 0)
            .join(t.nation.filter(c("n_name") == "NATION_7"), c("s_nationkey") == c("n_nationkey"))
            .select("s_suppkey", "s_name"))


@R.query("join_nonkey", """
SELECT DISTINCT c.c_mktsegment, s.s_suppkey
FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey""")
def join_nonkey(t):
    # Many-to-many on a non-key column: de-duplicate each side on the join
    # key first, so no (customer, supplier) pair is ever materialised.
    segs = t.customer.select("c_nationkey", "c_mktsegment").distinct()
    return (segs.join(t.supplier.select("s_suppkey", "s_nationkey"), c("c_nationkey") == c("s_nationkey"))
            .select("c_mktsegment", "s_suppkey").distinct())


@R.query("join_group", """
SELECT p.p_brand, round(sum(l.l_quantity), 2) AS qty, count(*) AS n
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p.p_brand""")
def join_group(t):
    return (t.lineitem.join(t.part, c("l_partkey") == c("p_partkey"))
            .groupBy("p_brand").agg(F.round(F.sum("l_quantity"), 2).alias("qty"),
                                    F.count(F.lit(1)).alias("n")))


@R.query("join_agg_filter", """
SELECT round(avg(o.o_totalprice), 6) AS avg_price, count(*) AS n
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE c.c_mktsegment = 'AUTOMOBILE' AND o.o_orderstatus = 'F'""")
def join_agg_filter(t):
    return (t.orders.filter(c("o_orderstatus") == "F")
            .join(t.customer.filter(c("c_mktsegment") == "AUTOMOBILE"), c("o_custkey") == c("c_custkey"))
            .agg(F.round(F.avg("o_totalprice"), 6).alias("avg_price"), F.count(F.lit(1)).alias("n")))


# ------------------------------------------------------------------ sort / limit
@R.query("sort_asc", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal ASC NULLS FIRST, c_custkey")
def sort_asc(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(c("c_acctbal").asc_nulls_first(), "c_custkey")


@R.query("sort_desc", """
SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey""")
def sort_desc(t):
    return t.part.select("p_partkey", "p_retailprice").orderBy(c("p_retailprice").desc_nulls_last(), "p_partkey")


@R.query("topk", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def topk(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(c("o_totalprice").desc(), "o_orderkey").limit(10)


@R.query("top1_row", """
SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1""")
def top1_row(t):
    return (t.part.select("p_partkey", "p_name", "p_retailprice")
            .orderBy(c("p_retailprice").desc(), "p_partkey").limit(1))


@R.query("top1_group", """
SELECT c.c_mktsegment, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY c.c_mktsegment ORDER BY n DESC, c.c_mktsegment LIMIT 1""")
def top1_group(t):
    # Pre-aggregate orders per customer before the join: the join then
    # carries one row per customer, not one per order.
    per_cust = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
    return (per_cust.join(t.customer, c("o_custkey") == c("c_custkey"))
            .groupBy("c_mktsegment").agg(F.sum("k").alias("n"))
            .orderBy(c("n").desc(), "c_mktsegment").limit(1))


@R.query("bottom1_group_sum", """
SELECT s_nationkey, round(sum(s_acctbal), 2) AS total FROM supplier
GROUP BY s_nationkey ORDER BY sum(s_acctbal) ASC, s_nationkey LIMIT 1""")
def bottom1_group_sum(t):
    return (t.supplier.groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("raw"))
            .orderBy(c("raw").asc(), "s_nationkey").limit(1)
            .select("s_nationkey", F.round("raw", 2).alias("total")))


@R.query("join_top1", """
SELECT l.l_orderkey, l.l_linenumber, p.p_name, l.l_extendedprice
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
WHERE p.p_size > 10 ORDER BY l.l_extendedprice DESC, l.l_orderkey, l.l_linenumber LIMIT 1""")
def join_top1(t):
    return (t.lineitem.join(t.part.filter(c("p_size") > 10), c("l_partkey") == c("p_partkey"))
            .select("l_orderkey", "l_linenumber", "p_name", "l_extendedprice")
            .orderBy(c("l_extendedprice").desc(), "l_orderkey", "l_linenumber").limit(1))


@R.query("limit_only", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5")
def limit_only(t):
    return t.nation.select("n_nationkey", "n_name").orderBy("n_nationkey").limit(5)


# ------------------------------------------------------------------ distinct
@R.query("distinct_one", "SELECT DISTINCT p_brand FROM part WHERE p_size > 25")
def distinct_one(t):
    return t.part.filter(c("p_size") > 25).select("p_brand").distinct()


@R.query("distinct_multi", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_multi(t):
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@R.query("distinct_join", """
SELECT DISTINCT n.n_name FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey
WHERE c.c_acctbal < -900""")
def distinct_join(t):
    # Only nation columns are returned: a semi join replaces join + distinct.
    return (t.nation.join(t.customer.filter(c("c_acctbal") < -900), c("c_nationkey") == c("n_nationkey"),
                          "left_semi")
            .select("n_name").distinct())


# ------------------------------------------------------------------ subqueries
@R.query("subq_in", """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)""")
def subq_in(t):
    big = t.orders.filter(c("o_totalprice") > 450000)
    return t.customer.join(big, c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey", "c_name")


@R.query("subq_scalar", """
SELECT p_partkey, p_name FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part)""")
def subq_scalar(t):
    mx = F.broadcast(t.part.agg(F.max("p_retailprice").alias("mx")))  # one row
    return t.part.join(mx, c("p_retailprice") == c("mx")).select("p_partkey", "p_name")


@R.query("subq_not_in", """
SELECT c_custkey FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')""")
def subq_not_in(t):
    return (t.customer.join(t.orders.filter(c("o_orderstatus") == "F"), c("c_custkey") == c("o_custkey"),
                            "left_anti").select("c_custkey"))


@R.query("case_when", """
SELECT o_orderpriority,
       CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_finished,
       max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS max_open
FROM orders GROUP BY o_orderpriority""")
def case_when(t):
    return t.orders.groupBy("o_orderpriority").agg(
        F.sum(F.when(c("o_orderstatus") == "F", 1).otherwise(0)).cast("long").alias("n_finished"),
        F.max(F.when(c("o_orderstatus") == "O", c("o_totalprice")).otherwise(0.0)).alias("max_open"))


@R.query("having", """
SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15""")
def having(t):
    return (t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
            .filter(c("n") > 15))


# ------------------------------------------------------------------ set operations
@R.query("set_union", """
SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 9900
UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000""")
def set_union(t):
    a = t.customer.filter(c("c_acctbal") > 9900).select(c("c_nationkey").alias("nationkey"))
    b = t.supplier.filter(c("s_acctbal") > 9000).select(c("s_nationkey").alias("nationkey"))
    return a.union(b).distinct()


@R.query("set_intersect", """
SELECT o_custkey AS custkey FROM orders WHERE o_orderpriority = '1-URGENT'
INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def set_intersect(t):
    a = t.orders.filter(c("o_orderpriority") == "1-URGENT").select(c("o_custkey").alias("custkey"))
    b = t.orders.filter(c("o_orderstatus") == "P").select(c("o_custkey").alias("custkey"))
    return a.intersect(b)


@R.query("set_except", """
SELECT c_custkey AS custkey FROM customer
EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""")
def set_except(t):
    a = t.customer.select(c("c_custkey").alias("custkey"))
    b = t.orders.filter(c("o_orderpriority") == "1-URGENT").select(c("o_custkey").alias("custkey"))
    return a.subtract(b)


@R.query("multi_join_hard", """
SELECT r.r_name, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS revenue
FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey
JOIN customer c ON c.c_nationkey = n.n_nationkey
JOIN orders o ON o.o_custkey = c.c_custkey
GROUP BY r.r_name""")
def multi_join_hard(t):
    geo = (t.nation.join(t.region, c("n_regionkey") == c("r_regionkey"))
           .join(t.customer, c("c_nationkey") == c("n_nationkey")).select("c_custkey", "r_name"))
    per_cust = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"),
                                                 F.sum("o_totalprice").alias("s"))
    return (per_cust.join(geo, c("o_custkey") == c("c_custkey"))
            .groupBy("r_name").agg(F.sum("k").alias("n_orders"), F.round(F.sum("s"), 2).alias("revenue")))


QUERIES = R.queries
ORACLES = R.oracles
