"""Queries over the test tables, one for each operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakescan import sinks
from lakescan.frame import Batch
from lakescan.functions import Expr, call, case, cast, col, lit
from lakescan.operators import relational
from lakescan.plans import Empty, Plan, QueryPlan, Scan, Union
from lakescan.scan import scan_csv, scan_ipc, scan_json, scan_parquet
from lakescan.session import scratch
from lakescan.streaming import ranged, run_available, session, stream_of, watermarked

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def scanned(spark: SparkSession, sf_dir: str, name: str):
    return scan_parquet(f"{sf_dir}/{name}.parquet", spark)


def batch(spark: SparkSession, sf_dir: str, name: str) -> Batch:
    return scanned(spark, sf_dir, name).read_all()


def node(spark: SparkSession, sf_dir: str, name: str) -> Plan:
    return Scan(scanned(spark, sf_dir, name).df)


# --- scans and projection

query("scan_count", "SELECT count(l_orderkey) AS n FROM lineitem")(lambda s, d: batch(s, d, "lineitem").aggregate([("count", "l_orderkey", "n")]).df)
query("project", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")(lambda s, d: scanned(s, d, "orders").read_columns(["o_orderkey", "o_totalprice", "o_orderstatus"]).df)
query("project_at", "SELECT c_custkey, c_nationkey FROM customer")(lambda s, d: scanned(s, d, "customer").read_columns_at([0, 2]).df)
query("batch_select", "SELECT p_brand, p_partkey FROM part")(lambda s, d: batch(s, d, "part").select(["p_brand", "p_partkey"]).df)
query("null_counts", "SELECT count(*) FILTER (o_custkey IS NULL) AS o_custkey, count(*) FILTER (o_totalprice IS NULL) AS o_totalprice FROM orders")(lambda s, d: s.createDataFrame([batch(s, d, "orders").select(["o_custkey", "o_totalprice"]).null_counts()], "o_custkey long, o_totalprice long"))
query("slice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")(lambda s, d: batch(s, d, "orders").select(["o_orderkey", "o_totalprice"]).slice(100, 50, by=["o_orderkey"]).df)
query("take", "WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) SELECT o_orderkey, o_custkey FROM (SELECT unnest([5, 0, 17, 5, 900]) AS k) JOIN r USING (k)")(lambda s, d: batch(s, d, "orders").select(["o_orderkey", "o_custkey"]).take([5, 0, 17, 5, 900], by=["o_orderkey"]).df)
query("row_index", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS at FROM customer")(lambda s, d: relational.numbered(scanned(s, d, "customer").read_columns(["c_custkey"]).df, ["c_custkey"], "at"))

# --- filters


def filtered(name: str, table: str, e: Expr, columns: list[str], where: str) -> None:
    query(name, f"SELECT {', '.join(columns)} FROM {table} WHERE {where}")(lambda s, d: scanned(s, d, table).filter(e).select(columns).df)


for _name, _op, _sql in (("eq", "=", "="), ("ne", "!=", "<>"), ("lt", "<", "<"), ("le", "le", "<="), ("gt", ">", ">"), ("ge", "ge", ">=")):
    query(f"filter_{_name}", f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey {_sql} 370")(lambda s, d, op=_op: scanned(s, d, "orders").filter_column("o_custkey", op, 370).select(["o_orderkey", "o_custkey"]).df)
query("filter_batch", "SELECT c_custkey FROM customer WHERE c_acctbal < 100.5")(lambda s, d: batch(s, d, "customer").filter("c_acctbal", "<", 100.5).select(["c_custkey"]).df)
query("filter_int_float", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 48")(lambda s, d: scanned(s, d, "lineitem").filter_parallel("l_quantity", ">", 48).select(["l_orderkey", "l_linenumber"]).df)
query("filter_string_eq", "SELECT event_id FROM events WHERE event_type = 'click'")(lambda s, d: scanned(s, d, "events").filter_column("event_type", "==", "click").select(["event_id"]).df)
filtered("filter_col_col", "lineitem", col("l_tax") < col("l_discount"), ["l_orderkey", "l_linenumber"], "l_tax < l_discount")
filtered("filter_flipped", "orders", Expr("compare", ("<", Expr("literal", (200,)), col("o_custkey"))), ["o_orderkey"], "200 < o_custkey")
filtered("filter_and", "orders", (col("o_custkey") > 100) & (col("o_orderstatus") == "F"), ["o_orderkey"], "o_custkey > 100 AND o_orderstatus = 'F'")
filtered("filter_or", "orders", (col("o_custkey") < 20) | (col("o_totalprice") > 400000.0), ["o_orderkey"], "o_custkey < 20 OR o_totalprice > 400000")
filtered("filter_not", "events", ~((col("event_type") == "view") | (col("value") > 50.0)), ["event_id"], "NOT (event_type = 'view' OR value > 50)")
filtered("filter_in", "orders", col("o_orderpriority").isin(["1-URGENT", "2-HIGH"]), ["o_orderkey"], "o_orderpriority IN ('1-URGENT', '2-HIGH')")
filtered("filter_in_numbers", "orders", col("o_custkey").isin([3, 700, 1100]), ["o_orderkey"], "o_custkey IN (3, 700, 1100)")
filtered("filter_like", "part", col("p_name").like("%a_e%"), ["p_partkey"], "p_name LIKE '%a_e%'")
filtered("filter_matches", "customer", col("c_name").matches("[13579]$"), ["c_custkey"], "regexp_matches(c_name, '[13579]$')")
filtered("filter_between", "lineitem", col("l_quantity").between(10, 12), ["l_orderkey", "l_linenumber"], "l_quantity BETWEEN 10 AND 12")


@query("filter_null_3vl", "WITH t AS (SELECT event_id, nullif(event_type, 'view') AS kind, value FROM events) SELECT event_id FROM t WHERE NOT (kind = 'click') OR value > 90")
def filter_null_3vl(s, d):
    df = scanned(s, d, "events").df.withColumn("kind", F.nullif("event_type", F.lit("view")))
    return Batch(df).filter(~(col("kind") == "click") | (col("value") > 90.0)).select(["event_id"]).df


@query("filter_is_null", "SELECT event_id FROM (SELECT event_id, nullif(event_type, 'view') AS kind FROM events) WHERE kind IS NULL")
def filter_is_null(s, d):
    df = scanned(s, d, "events").df.withColumn("kind", F.nullif("event_type", F.lit("view")))
    return Batch(df).filter(col("kind").is_null()).select(["event_id"]).df


@query("filter_mask", "SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 3")
def filter_mask(s, d):
    b = batch(s, d, "orders").with_column("mask", (col("o_custkey") % 7) == 3)
    return b.filter(col("mask")).select(["o_orderkey"]).df


# --- aggregates

_AGGS = {
    "sum_int": ("lineitem", "sum", "l_orderkey", "CAST(sum(l_orderkey) AS BIGINT)", None),
    "sum_float": ("lineitem", "sum", "l_extendedprice", "round(sum(l_extendedprice), 2)", 2),
    "mean": ("lineitem", "mean", "l_quantity", "round(avg(l_quantity), 6)", 6),
    "min": ("orders", "min", "o_totalprice", "min(o_totalprice)", None),
    "max": ("orders", "MAX", "o_totalprice", "max(o_totalprice)", None),
    "min_string": ("customer", "min", "c_name", "min(c_name)", None),
    "count": ("events", "count", "event_type", "count(event_type)", None),
}
for _name, (_table, _op, _col, _sql, _digits) in _AGGS.items():

    def _agg(s, d, table=_table, op=_op, column=_col, digits=_digits):
        df = Batch(scanned(s, d, table)._frame([column])).aggregate([(op, column, "v")]).df
        return df.select(F.round("v", digits).alias("v")) if digits else df

    query(f"agg_{_name}", f"SELECT {_sql} AS v FROM {_table}")(_agg)

for _op, _sql in (("sum", "round(sum(l_extendedprice), 2)"), ("mean", "round(avg(l_extendedprice), 4)"), ("min", "min(l_extendedprice)"), ("max", "max(l_extendedprice)"), ("count", "count(l_extendedprice)")):

    @query(f"filter_agg_{_op}", f"SELECT {_sql} AS v FROM lineitem WHERE l_quantity > 25")
    def _filter_agg(s, d, op=_op):
        plan = QueryPlan().filter(col("l_quantity") > 25).project(["l_extendedprice"]).aggregate(op, "l_extendedprice", "v")
        df = plan.lower(batch(s, d, "lineitem")).df
        return df.select(F.round("v", {"sum": 2, "mean": 4}[op]).alias("v")) if op in ("sum", "mean") else df


query("fused_scalar", "SELECT CAST(sum(o_custkey) AS BIGINT) AS total FROM orders WHERE o_totalprice > 100000")(lambda s, d: s.createDataFrame([(scanned(s, d, "orders").filter_agg("o_totalprice", ">", 100000, "o_custkey", "sum"),)], "total long"))
query("agg_scalars", "SELECT CAST(sum(o_custkey) AS BIGINT) AS total, min(o_orderkey) AS least, count(o_orderstatus) AS n FROM orders")(lambda s, d: s.createDataFrame([(batch(s, d, "orders").agg("sum", "o_custkey"), scanned(s, d, "orders").agg_column("min", "o_orderkey"), scanned(s, d, "orders").agg_column("count", "o_orderstatus"))], "total long, least long, n long"))
query("agg_empty", "SELECT CAST(sum(l_quantity) AS DOUBLE) AS s, avg(l_quantity) AS m, min(l_quantity) AS lo, max(l_quantity) AS hi, count(l_quantity) AS n FROM lineitem WHERE false")(lambda s, d: batch(s, d, "lineitem").filter(col("l_quantity") < -1).aggregate([("sum", "l_quantity", "s"), ("mean", "l_quantity", "m"), ("min", "l_quantity", "lo"), ("max", "l_quantity", "hi"), ("count", "l_quantity", "n")]).df)
query("multi_agg_default_alias", 'SELECT count(o_custkey) AS "COUNT_o_custkey", max(o_custkey) AS "MAX_o_custkey" FROM orders')(lambda s, d: QueryPlan().aggregate("count", "o_custkey").aggregate("max", "o_custkey").lower(batch(s, d, "orders")).df)
query("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS sellers, round(stddev(l_quantity), 6) AS spread FROM lineitem GROUP BY l_returnflag")(lambda s, d: batch(s, d, "lineitem").group_by("l_returnflag").agg([("count_distinct", "l_suppkey", "sellers"), ("stddev", "l_quantity", "spread")]).df.withColumn("spread", F.round("spread", 6)))
query("rollup", "SELECT l_returnflag, l_linestatus, count(l_orderkey) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")(lambda s, d: batch(s, d, "lineitem").rollup(["l_returnflag", "l_linestatus"], [("count", "l_orderkey", "n")]).df)
query("cube", "SELECT o_orderstatus, o_orderpriority, max(o_totalprice) AS most FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")(lambda s, d: batch(s, d, "orders").rollup(["o_orderstatus", "o_orderpriority"], [("max", "o_totalprice", "most")], cube=True).df)
query("group_by_one", "SELECT o_orderstatus, count(o_orderkey) AS n, min(o_totalprice) AS lo FROM orders GROUP BY o_orderstatus")(lambda s, d: batch(s, d, "orders").group_by("o_orderstatus").agg([("count", "o_orderkey", "n"), ("min", "o_totalprice", "lo")]).df)
query("group_by_two", "SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS lines, count(l_orderkey) AS n FROM lineitem GROUP BY ALL")(lambda s, d: node(s, d, "lineitem").aggregate([("sum", "l_linenumber", "lines"), ("count", "l_orderkey", "n")], ["l_returnflag", "l_linestatus"]).lower(s))
query("distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")(lambda s, d: batch(s, d, "lineitem").select(["l_returnflag", "l_linestatus"]).distinct().df)


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(s, d):
    df = scanned(s, d, "lineitem").df.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return df.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count(F.lit(1)).alias("n"),
    )


@query("nation_year_revenue", """SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS o_year, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue
    FROM part, supplier, lineitem, orders, nation
    WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey GROUP BY ALL""")
def nation_year_revenue(s, d):
    lines = scanned(s, d, "lineitem").df
    parts = scanned(s, d, "part").df.select("p_partkey")
    sellers = scanned(s, d, "supplier").df.join(scanned(s, d, "nation").df, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    df = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).join(sellers, lines["l_suppkey"] == sellers["s_suppkey"])
    df = df.join(scanned(s, d, "orders").df, F.col("o_orderkey") == F.col("l_orderkey"))
    return df.groupBy("n_name", F.year("o_orderdate").alias("o_year")).agg(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double").alias("revenue"))


# --- order, sets


query("sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")(lambda s, d: node(s, d, "orders").project(["o_orderkey", "o_totalprice"]).sort([("o_totalprice", False), "o_orderkey"]).limit(25).lower(s))
query("limit_offset", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 30")(lambda s, d: batch(s, d, "customer").select(["c_custkey", "c_name"]).sort(["c_custkey"]).limit(10, 30).df)
query("top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 5")(lambda s, d: relational.top(batch(s, d, "part").select(["p_partkey", "p_retailprice"]).df, [("p_retailprice", False), "p_partkey"], 5))
query("union_all", "SELECT o_orderkey FROM orders UNION ALL SELECT l_orderkey FROM lineitem")(lambda s, d: Union([node(s, d, "orders").project(["o_orderkey"]), node(s, d, "lineitem").project(["l_orderkey"])]).lower(s))
query("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")(lambda s, d: Batch(batch(s, d, "customer").df.selectExpr("c_nationkey as k")).intersect(Batch(batch(s, d, "supplier").df.selectExpr("s_nationkey as k"))).df)
query("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")(lambda s, d: Batch(batch(s, d, "customer").df.selectExpr("c_custkey as k")).subtract(Batch(batch(s, d, "orders").df.selectExpr("o_custkey as k"))).df)
query("empty_relation", "SELECT o_orderkey, o_orderstatus FROM orders WHERE false")(lambda s, d: Empty("o_orderkey long, o_orderstatus string").lower(s))
query("filter_false", "SELECT o_orderkey FROM orders WHERE o_custkey < 0 AND o_custkey > 0")(lambda s, d: node(s, d, "orders").filter((col("o_custkey") < 0) & (col("o_custkey") > 0)).project(["o_orderkey"]).lower(s))

# --- joins


def customers_orders(s, d):
    return batch(s, d, "customer").select(["c_custkey", "c_nationkey"]), batch(s, d, "orders").select(["o_orderkey", "o_custkey"])


_ON = "customer c {} JOIN orders o ON c.c_custkey = o.o_custkey"
for _how in ("inner", "left", "right", "full"):

    @query(f"join_{_how}", f"SELECT c.c_custkey, c.c_nationkey, o.o_orderkey, o.o_custkey FROM {_ON.format(_how.upper())}")
    def _join(s, d, how=_how):
        a, b = customers_orders(s, d)
        return a.join(b, [("c_custkey", "o_custkey")], how).df


for _how in ("semi", "anti"):

    @query(f"join_{_how}", f"SELECT c_custkey, c_nationkey FROM {_ON.format(_how.upper())}")
    def _join(s, d, how=_how):
        a, b = customers_orders(s, d)
        return a.join(b, [("c_custkey", "o_custkey")], how).df


query("join_cross", "SELECT r_regionkey, n_nationkey FROM region, nation")(lambda s, d: batch(s, d, "region").select(["r_regionkey"]).join(batch(s, d, "nation").select(["n_nationkey"]), how="cross").df)
query("join_anti_lineitem", "SELECT o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")(lambda s, d: node(s, d, "orders").project(["o_orderkey"]).join(node(s, d, "lineitem").project(["l_orderkey"]), [("o_orderkey", "l_orderkey")], "anti").lower(s))


@query("join_same_name", "SELECT a.k, a.v, b.v AS v_right FROM (SELECT o_orderkey AS k, o_custkey AS v FROM orders) a JOIN (SELECT l_orderkey AS k, l_linenumber AS v FROM lineitem) b ON a.k = b.k")
def join_same_name(s, d):
    a = batch(s, d, "orders").df.selectExpr("o_orderkey as k", "o_custkey as v")
    return relational.join(a, batch(s, d, "lineitem").df.selectExpr("l_orderkey as k", "l_linenumber as v"), "k")


@query("join_null_keys", "WITH t AS (SELECT nullif(c_nationkey, 3) AS k, c_custkey FROM customer), n AS (SELECT nullif(n_nationkey, 3) AS k, n_name FROM nation) SELECT t.c_custkey, n.n_name FROM t LEFT JOIN n ON t.k = n.k")
def join_null_keys(s, d):
    t = batch(s, d, "customer").df.select(F.nullif("c_nationkey", F.lit(3)).alias("k"), "c_custkey")
    n = batch(s, d, "nation").df.select(F.nullif("n_nationkey", F.lit(3)).alias("k"), "n_name")
    return relational.join(t, n, "k", "left").drop("k")


@query("join_null_safe", "WITH t AS (SELECT nullif(c_nationkey, 3) AS k, c_custkey FROM customer), n AS (SELECT nullif(n_nationkey, 3) AS k, n_name FROM nation) SELECT t.c_custkey, n.n_name FROM t JOIN n ON t.k IS NOT DISTINCT FROM n.k")
def join_null_safe(s, d):
    t = batch(s, d, "customer").df.select(F.nullif("c_nationkey", F.lit(3)).alias("k"), "c_custkey")
    n = batch(s, d, "nation").df.select(F.nullif("n_nationkey", F.lit(3)).alias("k"), "n_name")
    return relational.join(t, n, "k", null_safe=True).drop("k")


@query("join_asof", """WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, ts AS clicked, max(event_id) AS click FROM events WHERE event_type = 'click' GROUP BY ALL)
    SELECT a.event_id, a.user_id, b.click, b.clicked FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.clicked""")
def join_asof(s, d):
    """Each purchase with the user's last click before it."""
    events = batch(s, d, "events")
    clicks = Batch(events.filter("event_type", "=", "click").df.selectExpr("user_id", "ts as clicked", "event_id as click"))
    return events.filter("event_type", "=", "purchase").join_asof(clicks, ("ts", "clicked"), ["user_id"], ["click", "clicked"]).select(["event_id", "user_id", "click", "clicked"]).df


@query("join_three", """SELECT n_name, count(*) AS "COUNT_o_orderkey" FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def join_three(s, d):
    plan = node(s, d, "orders").join(node(s, d, "customer"), [("o_custkey", "c_custkey")]).join(node(s, d, "nation"), [("c_nationkey", "n_nationkey")])
    return plan.aggregate([("count", "o_orderkey")], ["n_name"]).lower(s)


# --- expressions, windows, functions of the user

query("with_column", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")(lambda s, d: Batch(batch(s, d, "lineitem").with_column("net", col("l_extendedprice") * (-(col("l_discount") - 1))).df.withColumn("net", F.round("net", 4))).select(["l_orderkey", "l_linenumber", "net"]).df)
query("cast", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")(lambda s, d: batch(s, d, "orders").select(["o_orderkey", "o_custkey"]).cast("o_custkey", "string").df)
query("try_cast", "SELECT o_orderkey, try_cast(o_orderpriority AS INTEGER) AS p FROM orders")(lambda s, d: batch(s, d, "orders").with_column("p", cast(col("o_orderpriority"), "int")).select(["o_orderkey", "p"]).df)
query("case", "SELECT event_id, CASE WHEN value > 80 THEN 'high' WHEN value > 20 THEN 'mid' ELSE 'low' END AS band FROM events")(lambda s, d: batch(s, d, "events").with_column("band", case([(col("value") > 80.0, "high"), (col("value") > 20.0, "mid")], "low")).select(["event_id", "band"]).df)
query("functions", "SELECT o_orderkey, upper(substring(o_orderpriority, 3, 4)) AS p, CAST(length(o_orderpriority) AS INTEGER) AS len, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(floor(o_totalprice) AS BIGINT) AS f, greatest(o_custkey, 500) AS g FROM orders")(lambda s, d: batch(s, d, "orders").with_column("p", call("upper", call("substring", col("o_orderpriority"), 3, 4))).with_column("len", call("length", col("o_orderpriority"))).with_column("y", call("year", col("o_orderdate"))).with_column("f", call("floor", col("o_totalprice"))).with_column("g", call("greatest", col("o_custkey"), cast(lit(500), "bigint"))).select(["o_orderkey", "p", "len", "y", "f", "g"]).df)
query("window_rank", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS INTEGER) AS rank FROM orders")(lambda s, d: relational.ranked(batch(s, d, "orders").df, ["o_custkey"], [("o_totalprice", False), "o_orderkey"]).select("o_orderkey", "rank"))
query("window_sum", "SELECT l_orderkey, l_linenumber, CAST(sum(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS parts FROM lineitem")(lambda s, d: relational.running(batch(s, d, "lineitem").df, ["l_orderkey"], ["l_linenumber", "l_partkey"], "sum", "l_partkey", "parts").select("l_orderkey", "l_linenumber", "parts"))
query("window_lag", "SELECT event_id, lag(event_id, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")(lambda s, d: relational.shifted(batch(s, d, "events").df, ["user_id"], ["ts", "event_id"], "event_id", 1, "previous").select("event_id", "previous"))


def _double_batches(batches):
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pc.multiply(b.column(1), 2)], names=["o_orderkey", "twice"])


query("udf_batches", "SELECT o_orderkey, o_custkey * 2 AS twice FROM orders")(lambda s, d: batch(s, d, "orders").select(["o_orderkey", "o_custkey"]).map_batches(_double_batches, "o_orderkey long, twice long").df)

def _twice(x):
    import pyarrow.compute as pc

    return pc.multiply(x, 2)


def _longest(t):
    """A group's row of largest value, ties by the least id."""
    return t.sort_by([("value", "descending"), ("event_id", "ascending")]).slice(0, 1).select(["user_id", "event_id"])


query("udf_column", "SELECT o_orderkey, o_custkey * 2 AS twice FROM orders")(lambda s, d: batch(s, d, "orders").map_column("twice", _twice, ["o_custkey"], "long").select(["o_orderkey", "twice"]).df)
query("udf_groups", "SELECT user_id, arg_max(event_id, (value, -event_id)) AS event_id FROM events GROUP BY user_id")(lambda s, d: batch(s, d, "events").select(["user_id", "event_id", "value"]).group_by("user_id").map_groups(_longest, "user_id long, event_id long").df)

query("tumbling", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")(lambda s, d: ranged(batch(s, d, "events").df, "ts", "1 day", [("count", "event_id", "n")], ["event_type"]).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n"))
query("sliding", "SELECT date_trunc('hour', ts) - to_hours(h) AS window_start, count(*) AS n FROM events, (SELECT unnest([0, 1, 2]) AS h) GROUP BY ALL")(lambda s, d: ranged(batch(s, d, "events").df, "ts", "3 hours", [("count", "event_id", "n")], slide="1 hour").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n"))
query("session", """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS window_start, count(*) AS n FROM s GROUP BY user_id, k""")(lambda s, d: session(batch(s, d, "events").df, "ts", "6 hours", [("count", "event_id", "n")], ["user_id"]).select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n"))

# --- round trips

_KINDS = "SELECT l_returnflag, count(l_orderkey) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts, min(l_extendedprice) AS least, max(l_shipdate) AS last FROM lineitem GROUP BY l_returnflag"
_TEXTS = "SELECT doc_id, lang, md5(nullif(text, '')) AS digest FROM documents"


def _by_flag(b: Batch) -> DataFrame:
    df = b.group_by("l_returnflag").agg([("count", "l_orderkey", "n"), ("sum", "l_partkey", "parts"), ("min", "l_extendedprice", "least"), ("max", "l_shipdate", "last")]).df
    return df.withColumn("last", F.col("last").cast("timestamp_ntz"))


def _digests(b: Batch) -> DataFrame:
    return b.df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", F.md5(F.nullif("text", F.lit(""))).alias("digest"))


@query("roundtrip_csv", _KINDS)
def roundtrip_csv(s, d):
    sinks.write(batch(s, d, "lineitem"), path := scratch(s), "csv", header=True)
    return _by_flag(scan_csv(path, spark=s).read_all())


@query("roundtrip_csv_texts", _TEXTS)
def roundtrip_csv_texts(s, d):
    """Texts with quotes and line ends."""
    sinks.write(batch(s, d, "documents"), path := scratch(s), "csv", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return _digests(scan_csv(path, spark=s, trim=False).read_columns(["doc_id", "lang", "text"]))


@query("roundtrip_json", _KINDS)
def roundtrip_json(s, d):
    sinks.write(batch(s, d, "lineitem"), path := scratch(s), "json")
    return _by_flag(scan_json(path, spark=s).read_columns(["l_returnflag", "l_orderkey", "l_partkey", "l_extendedprice", "l_shipdate"]))


@query("roundtrip_json_texts", _TEXTS)
def roundtrip_json_texts(s, d):
    sinks.write(batch(s, d, "documents"), path := scratch(s), "json")
    return _digests(scan_json(path, spark=s).read_columns(["text", "lang", "doc_id"]))


def _ipc(s: SparkSession, d: str, name: str, compression: str | None = None):
    sinks.write_ipc_folder(path := scratch(s).removeprefix("file://"), batch(s, d, name), compression=compression)
    return scan_ipc(path, s)


query("roundtrip_ipc", _KINDS)(lambda s, d: _by_flag(_ipc(s, d, "lineitem", "zstd").read_columns(["l_returnflag", "l_orderkey", "l_partkey", "l_extendedprice", "l_shipdate"])))
query("roundtrip_ipc_texts", _TEXTS)(lambda s, d: _digests(_ipc(s, d, "documents", "lz4").read_all()))
query("ipc_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45")(lambda s, d: _ipc(s, d, "lineitem").filter_parallel("l_quantity", ">", 45).select(["l_orderkey", "l_linenumber"]).df)
query("ipc_project_at", "SELECT c_custkey, c_nationkey FROM customer")(lambda s, d: _ipc(s, d, "customer").read_columns_at([0, 2]).df)
query("ipc_empty", "SELECT o_orderkey, o_totalprice FROM orders WHERE false")(lambda s, d: _ipc_empty(s, d))


def _ipc_empty(s, d):
    sinks.write_ipc_folder(path := scratch(s).removeprefix("file://"), batch(s, d, "orders").select(["o_orderkey", "o_totalprice"]).filter("o_orderkey", "<", -1))
    return scan_ipc(path, s).read_all().df


@query("ipc_aggregates", "SELECT CAST(sum(l_partkey) AS BIGINT) AS total, max(l_extendedprice) AS most, count(l_orderkey) AS n, CAST((SELECT sum(l_partkey) FROM lineitem WHERE l_quantity <= 10) AS BIGINT) AS some FROM lineitem")
def ipc_aggregates(s, d):
    r = _ipc(s, d, "lineitem", "lz4")
    row = r.agg_column("sum", "l_partkey"), r.agg_column("max", "l_extendedprice"), r.agg_column("count", "l_orderkey"), r.filter_agg("l_quantity", "le", 10, "l_partkey", "sum")
    return s.createDataFrame([row], "total long, most double, n long, some long")


@query("ipc_batches", "SELECT count(*) AS n, 11 AS columns, count(*) AS counted, count(*) AS read FROM lineitem")
def ipc_batches(s, d):
    """Rows by footers and by reading batch after batch."""
    r = _ipc(s, d, "lineitem")
    read = sum(r.read_batch(k, ["l_orderkey"]).num_rows for k in range(r.num_batches))
    return s.createDataFrame([(r.num_rows, r.num_columns, sum(r.batch_row_counts()), read)], "n long, columns int, counted long, read long")


@query("parquet_row_groups", "SELECT o_orderkey, o_totalprice FROM orders")
def parquet_row_groups(s, d):
    """Each row by the group that holds it, all groups in one scan."""
    sinks.write(batch(s, d, "orders"), path := scratch(s), **{"parquet.block.size": 1 << 17, "parquet.page.size": 1 << 14})
    return scan_parquet(path, s).read_row_groups(columns=["o_orderkey", "o_totalprice"]).df


query("scan_metadata", "SELECT count(*) AS n, 6 AS columns, 'o_orderkey' AS first FROM orders")(lambda s, d: s.createDataFrame([((r := scanned(s, d, "orders")).num_rows, r.num_columns, r.column_names[0])], "n long, columns int, first string"))
query("iter_batches", "SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer")(lambda s, d: s.createDataFrame([_iterated(batch(s, d, "customer").select(["c_custkey"]))], "n long, keys long"))


def _iterated(b: Batch) -> tuple[int, int]:
    found = [(t.num_rows, sum(t.column(0).to_pylist())) for t in b.iter_batches(700)]
    return sum(n for n, _ in found), sum(k for _, k in found)


@query("roundtrip_parquet_append", "SELECT o_orderkey, count(*) AS n FROM (FROM orders UNION ALL FROM orders) GROUP BY o_orderkey")
def roundtrip_parquet_append(s, d):
    path = scratch(s)
    for append in (False, True):
        sinks.write(batch(s, d, "orders"), path, append=append)
    return scan_parquet(path, s).read_all().group_by("o_orderkey").agg([("count", "o_custkey", "n")]).df


@query("stream_filter", "SELECT event_id, value FROM events WHERE value > 50 AND event_type <> 'view'")
def stream_filter(s, d):
    events = scanned(s, d, "events").df
    sinks.write(Batch(events), path := scratch(s))
    kept = stream_of(s, path, events.schema).filter(((col("value") > 50) & (col("event_type") != "view")).column(events.schema))
    run_available(kept.select("event_id", "value"), out := scratch(s), scratch(s))
    return s.read.parquet(out)


@query("stream_tumbling", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts < (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY ALL")
def stream_tumbling(s, d):
    """Windows that the watermark has passed: all but those of the last day."""
    events = scanned(s, d, "events").df
    sinks.write(Batch(events), path := scratch(s))
    counted = ranged(watermarked(stream_of(s, path, events.schema), "ts", "0 seconds"), "ts", "1 day", [("count", "event_id", "n")], ["event_type"])
    run_available(counted, out := scratch(s), scratch(s))
    return s.read.parquet(out).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


FLAGSHIP = "pricing_summary"
