"""Queries of the relational surface: scans, joins, aggregates, windows, sets, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesense.functions.cells import id_text, is_true, join_key
from tablesense.operators import relational as R
from tablesense.plans.spec import Filter, Join, Measure, Melt, Pivot, QuerySpec, Windowed, compile_spec

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str):
    """Registers a query under its function's name, with the SQL of the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def cents(c):
    return F.round(F.col(c) * 100).cast("bigint") if isinstance(c, str) else F.round(c * 100).cast("bigint")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_shipdate AS DATE) AS ship_date FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity > 45""")
def scan_project_filter(spark, d):
    return table(spark, d, "lineitem").where("l_shipdate < timestamp_ntz'1996-01-01' and l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_shipdate").cast("date").alias("ship_date"))


@query("""
SELECT c_custkey, c_name, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS revenue_cents
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE year(o_orderdate) = 1998 GROUP BY c_custkey, c_name ORDER BY revenue_cents DESC, c_custkey LIMIT 3""")
def flagship_join_top3(spark, d):
    spec = QuerySpec(
        source="lineitem",
        joins=(Join("orders", ("l_orderkey",), ("o_orderkey",)), Join("customer", ("o_custkey",), ("c_custkey",))),
        derived={"cents": "cast(round(l_extendedprice * (1 - l_discount) * 100) as bigint)"},
        filters=(Filter("o_orderdate", "year", 1998),),
        groups=("c_custkey", "c_name"),
        measures=(Measure("revenue_cents", "sum", "cents"),),
        order=(("revenue_cents", True), ("c_custkey", False)),
        limit=3,
    )
    return compile_spec(spec, {t: table(spark, d, t) for t in ("lineitem", "orders", "customer")})


@query("""SELECT a.nationkey, a.name AS name_x, a.acctbal AS acctbal_x, b.name AS name_y, b.acctbal AS acctbal_y
FROM (SELECT s_nationkey AS nationkey, s_name AS name, s_acctbal AS acctbal FROM supplier) a JOIN (SELECT c_nationkey AS nationkey, c_name AS name, c_acctbal AS acctbal FROM customer) b ON a.nationkey = b.nationkey""")
def merge_suffixes(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    b = table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"))
    return R.merge(a, b, on=["nationkey"], many=True)


@query("""SELECT s_suppkey, s_name, s_nationkey, s_acctbal, n_nationkey, n_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def merge_left_right_on(spark, d):
    return R.merge(table(spark, d, "supplier"), table(spark, d, "nation"), left_on=["s_nationkey"], right_on=["n_nationkey"])


@query("""
WITH a AS (SELECT s_suppkey, CASE WHEN s_nationkey >= 5 THEN s_nationkey END AS k FROM supplier), b AS (SELECT n_name, CASE WHEN n_nationkey >= 5 THEN n_nationkey END AS k FROM nation)
SELECT s_suppkey, a.k, n_name FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def merge_null_safe(spark, d):
    a = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") >= 5, F.col("s_nationkey")).alias("k"))
    b = table(spark, d, "nation").select("n_name", F.when(F.col("n_nationkey") >= 5, F.col("n_nationkey")).alias("k"))
    return R.merge(a, b, on=["k"])


@query("""SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey""")
def join_outer(spark, d):
    c, o = table(spark, d, "customer").where("c_acctbal > 0"), table(spark, d, "orders").where("o_totalprice > 400000")
    return c.join(o, c.c_custkey == o.o_custkey, "full").select("c_custkey", "o_orderkey")


@query("""SELECT r_name, n_name FROM region CROSS JOIN nation""")
def join_cross(spark, d):
    return table(spark, d, "region").crossJoin(F.broadcast(table(spark, d, "nation"))).select("r_name", "n_name")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def semi_members(spark, d):
    return R.members(table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 300000"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("""SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def anti_unmatched(spark, d):
    return R.unmatched(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey").select("o_orderkey")


@query("""SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey""")
def id_key_normalized_join(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.format_string(" %d.0", "o_custkey").alias("cust"))
    return R.merge(orders, table(spark, d, "customer"), left_on=["cust"], right_on=["c_custkey"], normalise_keys=True).select("o_orderkey", "c_name")


@query("""SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS key_of_int, CAST(o_custkey AS VARCHAR) AS key_of_float, lower(o_orderpriority) AS key_of_text FROM orders""")
def join_key_forms(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", join_key(F.col("o_custkey")).alias("key_of_int"), join_key(F.format_string("%d.0", "o_custkey")).alias("key_of_float"), join_key(F.concat(F.lit("  "), "o_orderpriority")).alias("key_of_text"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS BIGINT) AS qty_cents, round(avg(l_quantity), 4) AS avg_qty, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY 1, 2""")
def agg_basic(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(cents("l_quantity")).alias("qty_cents"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"))


@query("""SELECT l_shipmonth AS ship_month, round(median(l_quantity), 4) AS median_qty FROM (SELECT l_quantity, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS l_shipmonth FROM lineitem) GROUP BY 1""")
def agg_median(spark, d):
    return table(spark, d, "lineitem").groupBy((F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("bigint").alias("ship_month")).agg(F.round(F.median("l_quantity"), 4).alias("median_qty"))


@query("""SELECT o_orderpriority, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS pct_f, count(*) FILTER (o_orderstatus = 'F') - count(*) FILTER (o_orderstatus = 'O') AS diff FROM orders GROUP BY 1""")
def agg_ratio(spark, d):
    f, o = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") == "O")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.try_divide(100.0 * f, F.count("*")), 4).alias("pct_f"), (f - o).alias("diff"))


@query("""SELECT o_custkey, avg(CAST(round(o_totalprice * 100) AS BIGINT)) / 12 AS monthly_cents FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1""")
def agg_monthly_avg(spark, d):
    spec = QuerySpec("orders", filters=(Filter("o_orderdate", "year", 1997),), derived={"cents": "cast(round(o_totalprice * 100) as bigint)"}, groups=("o_custkey",), measures=(Measure("monthly_cents", "monthly_avg", "cents"),))
    return compile_spec(spec, {"orders": table(spark, d, "orders")})


@query("""SELECT l_suppkey, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1""")
def agg_count_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"))


@query("""SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1""")
def drop_duplicates_first(spark, d):
    return R.first_per_key(table(spark, d, "events"), ["user_id", "event_type"], ["event_id"]).select("event_id", "user_id", "event_type", "value")


@query("""SELECT event_type, count(*) AS "count" FROM events WHERE event_type IS NOT NULL GROUP BY 1""")
def value_counts(spark, d):
    return R.value_counts(table(spark, d, "events"), "event_type")


@query("""SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer""")
def set_union(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).union(table(spark, d, "customer").select("c_custkey")).distinct()


@query("""SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0""")
def set_intersect(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("""SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000""")
def set_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_totalprice > 100000").select("o_custkey"))


@query("""SELECT o_orderkey, o_custkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk,
 CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS last3, lag(o_orderkey) OVER w AS before
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_rank_frame(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.row_number().over(w).cast("bigint").alias("rn"), F.rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).cast("bigint").alias("rk"), F.sum(cents("o_totalprice")).over(w.rowsBetween(-2, 0)).alias("last3"), F.lag("o_orderkey").over(w).alias("before"))


@query("""SELECT count(*) > 200 AS truncated, least(count(*), 200) AS row_count FROM (SELECT * FROM orders LIMIT 201)""")
def limit_truncated_flag(spark, d):
    return R.limited(table(spark, d, "orders"), 200, ["o_orderkey"])[1].withColumn("row_count", F.col("row_count").cast("bigint"))


@query("""
WITH n AS (SELECT count(*) AS n FROM orders), k AS (SELECT DISTINCT CAST(round_even(i * (n - 1) / 9.0, 0) AS BIGINT) AS p FROM n, range(0, 10) t(i))
SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) WHERE pos IN (SELECT p FROM k)""")
def diverse_sample(spark, d):
    return R.diverse_sample(table(spark, d, "orders"), 10, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("""SELECT doc_id, toxic FROM labels WHERE toxic = 1""")
def bool_safe_filter(spark, d):
    spelt = F.when(F.col("toxic") == 1, F.element_at(F.array(F.lit("true"), F.lit("True"), F.lit("TRUE")), (F.col("doc_id") % 3 + 1).cast("int"))).otherwise("False")
    return table(spark, d, "labels").withColumn("flag", spelt).where(is_true(F.col("flag"))).select("doc_id", "toxic")


@query("""SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y%m') = '199705'""")
def yyyymm_filter(spark, d):
    return compile_spec(QuerySpec("orders", filters=(Filter("o_orderdate", "yyyymm", 199705),), columns=("o_orderkey",)), {"orders": table(spark, d, "orders")})


@query("""SELECT conv_id, turn AS last_turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1""")
def latest_record_per_id(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    return R.last_record(c, "conv_id", "turn").withColumnRenamed("turn", "last_turn")


@query("""SELECT conv_id, arg_max(u, turn) FILTER (u IS NOT NULL) AS last_user, arg_max(a, turn) FILTER (a IS NOT NULL) AS last_assistant
FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text END AS u, CASE WHEN role = 'assistant' THEN text END AS a FROM conversations) GROUP BY conv_id""")
def fieldwise_last_nonnull(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("last_user"), F.when(F.col("role") == "assistant", F.col("text")).alias("last_assistant"))
    return R.last_values(c, "conv_id", "turn")


@query("""SELECT conv_id, max(turn) AS turn, arg_max(coalesce(u, '(none)'), turn) AS said, min(turn) AS first_seen
FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text END AS u FROM conversations) GROUP BY conv_id""")
def merge_later_wins(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("said"))
    return R.merged_records(c, "conv_id", "turn").withColumn("said", F.coalesce("said", F.lit("(none)")))


@query("""SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal > 1.2 * 5000""")
def threshold_from_rule(spark, d):
    rules = table(spark, d, "region").limit(1).select(F.lit("Balances: c_acctbal is high when it is above 6000.0, says the rule.").alias("text"))
    return R.above_threshold(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_acctbal", rules, "text")


@query("""SELECT o_orderkey, regexp_replace(CAST(o_custkey AS VARCHAR), '\\.0$', '') AS cust FROM orders""")
def id_suffix_stripped(spark, d):
    return table(spark, d, "orders").select("o_orderkey", id_text(F.format_string("%d.0", "o_custkey")).alias("cust"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '' END AS a, CASE WHEN p_partkey % 3 <> 2 THEN p_brand ELSE '' END AS b FROM part""")
def rectangular_rows(spark, d):
    p = table(spark, d, "part")
    ragged = F.when(F.col("p_partkey") % 3 == 0, F.array("p_name", "p_brand", "p_type")).when(F.col("p_partkey") % 3 == 1, F.array(F.lit(""), "p_brand")).otherwise(F.array().cast("array<string>"))
    cells = R.rectangular(ragged, 2)
    return p.select("p_partkey", cells[0].alias("a"), cells[1].alias("b"))


@query("""SELECT c_custkey, c_name FROM customer""")
def drop_empty_columns(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_name", F.lit(" n/a ").alias("x"), F.lit(None).cast("string").alias("y"))
    return R.drop_empty_columns(df)


_OWN = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


@query(f"""
WITH c AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
SELECT o_orderkey, CASE WHEN count(cents) {_OWN} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 THEN round(avg(cents) {_OWN} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) END AS rolling,
 CAST(sum(cents) {_OWN} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, lag(cents, 2) {_OWN}) AS two_before, lead(cents) {_OWN}) AS next_one,
 CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority DESC) AS INTEGER) AS place FROM c""")
def spec_windows(spark, d):
    own = {"partition": ("o_custkey",), "order": (("o_orderdate", False), ("o_orderkey", False))}
    spec = QuerySpec(
        "orders",
        derived={"cents": "cast(round(o_totalprice * 100) as bigint)"},
        windows=(
            Windowed("rolling", "avg", "cents", rows=3, least=3, **own),
            Windowed("running", "sum", "cents", **own),
            Windowed("two_before", "shift", "cents", rows=2, **own),
            Windowed("next_one", "shift", "cents", rows=-1, **own),
            Windowed("place", "dense_rank", partition=("o_orderstatus",), order=(("o_orderpriority", True),)),
        ),
        columns=("o_orderkey", "rolling", "running", "two_before", "next_one", "place"),
    )
    return compile_spec(spec, {"orders": table(spark, d, "orders")}).withColumn("rolling", F.round("rolling", 2))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 2""")
def spec_largest_of_each(spark, d):
    largest = Windowed("n", "row_number", partition=("o_custkey",), order=(("o_totalprice", True), ("o_orderkey", False)))
    return compile_spec(QuerySpec("orders", windows=(largest,), where_windows=(Filter("n", "<=", 2),), columns=("o_custkey", "o_orderkey", "o_totalprice")), {"orders": table(spark, d, "orders")})


@query("""SELECT c_nationkey, coalesce(CAST(sum(CASE WHEN o_orderstatus = 'F' THEN cents END) AS BIGINT), 0) AS "F", coalesce(CAST(sum(CASE WHEN o_orderstatus = 'O' THEN cents END) AS BIGINT), 0) AS "O"
FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def spec_pivot(spark, d):
    spec = QuerySpec("orders", joins=(Join("customer", ("o_custkey",), ("c_custkey",)),), derived={"cents": "cast(round(o_totalprice * 100) as bigint)"}, pivot=Pivot(("c_nationkey",), "o_orderstatus", "cents", "sum", ("F", "O"), fill=0))
    return compile_spec(spec, {t: table(spark, d, t) for t in ("orders", "customer")})


@query("""SELECT x.m AS measure, count(*) AS n, min(x.v) AS least, max(x.v) AS most FROM (SELECT unnest([{'m': 'l_quantity', 'v': l_quantity}, {'m': 'l_discount', 'v': l_discount}, {'m': 'l_tax', 'v': l_tax}]) AS x FROM lineitem) GROUP BY 1""")
def spec_melt(spark, d):
    spec = QuerySpec("lineitem", melt=Melt((), ("l_quantity", "l_discount", "l_tax"), "measure", "amount"), groups=("measure",), measures=(Measure("n", "count"), Measure("least", "min", "amount"), Measure("most", "max", "amount")))
    return compile_spec(spec, {"lineitem": table(spark, d, "lineitem")})
