"""Fixture queries for table questions: I1-I6 and the statement families T1-T18.

Each T query is a Spark SQL statement run through ``ask`` over the registered
views; its DuckDB twin is the same question in DuckDB's dialect.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import ask as A
from tessera.operators import scans as S
from tessera.session import read_if_there, register_tables, scratch_path
from tessera.suite.common import T

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def _ask(stmt, tables):
    def run(spark, sf):
        register_tables(spark, sf, tables)
        df, msg = A.ask(spark, stmt)
        if df is None:
            raise ValueError(msg)
        return df
    return run


_PIV = ", ".join(f"'{t}'" for t in EVENT_TYPES)
_PIV_COLS = ", ".join(f"round(`{t}`, 2) AS `{t}`" for t in EVENT_TYPES)
_PIV_COLS_D = ", ".join(f'round("{t}", 2) AS "{t}"' for t in EVENT_TYPES)

FAMILIES = {
    # T1 distinct counts (nunique) -- see T1_nunique below, it goes through I4
    "T2_filter": (
        ["lineitem"],
        "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem "
        "WHERE (l_quantity > 45) AND (l_discount < 0.02) AND (l_returnflag <> 'N')",
        None,
    ),
    "T3_computed_column": (
        ["lineitem"],
        "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge "
        "FROM lineitem",
        None,
    ),
    "T5_group_aggregate": (
        ["lineitem"],
        "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, "
        "round(sum(l_extendedprice), 2) AS sum_base_price, "
        "round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, "
        "round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, "
        "min(l_shipdate) AS min_ship, max(l_shipdate) AS max_ship, count(*) AS count_order "
        "FROM lineitem GROUP BY l_returnflag, l_linestatus",
        None,
    ),
    "T6_top_k_per_group": (
        ["orders"],
        "SELECT o_orderpriority, o_orderkey, o_totalprice FROM ("
        "SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER "
        "(PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3",
        None,
    ),
    "T7_value_counts": (
        ["events"],
        "SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type "
        "ORDER BY n DESC",
        None,
    ),
    "T8_pivot": (
        ["events"],
        f"SELECT user_id, {_PIV_COLS} FROM (SELECT user_id, event_type, value FROM events) "
        f"PIVOT (sum(value) FOR event_type IN ({_PIV}))",
        f"SELECT user_id, {_PIV_COLS_D} FROM (SELECT user_id, event_type, value FROM events) "
        f"PIVOT (sum(value) FOR event_type IN ({_PIV}))",
    ),
    "T9_unpivot": (
        ["customer"],
        "SELECT c_custkey, metric, round(val, 2) AS val FROM (SELECT c_custkey, c_acctbal, "
        "CAST(c_nationkey AS DOUBLE) AS c_nationkey FROM customer) "
        "UNPIVOT (val FOR metric IN (c_acctbal, c_nationkey))",
        "SELECT c_custkey, metric, round(val, 2) AS val FROM (SELECT c_custkey, c_acctbal, "
        "CAST(c_nationkey AS DOUBLE) AS c_nationkey FROM customer) "
        "UNPIVOT (val FOR metric IN (c_acctbal, c_nationkey))",
    ),
    "T10_rank_shift_cumsum": (
        ["events"],
        "SELECT event_id, user_id, CAST(row_number() OVER w AS BIGINT) AS rn, lag(value) OVER w AS prev_value, "
        "round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cum_value "
        "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
        "SELECT event_id, user_id, CAST(row_number() OVER w AS BIGINT) AS rn, lag(value) OVER w AS prev_value, "
        "round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cum_value "
        "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    ),
    "T11_rolling_mean": (
        ["events"],
        "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id "
        "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rolling_value FROM events",
        None,
    ),
    "T12_merge_inner": (
        ["orders", "customer"],
        "SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue "
        "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
        None,
    ),
    "T12_merge_left": (
        ["orders", "customer"],
        "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey "
        "GROUP BY c_custkey",
        None,
    ),
    "T12_merge_semi": (
        ["orders", "customer"],
        "SELECT c_custkey, c_nationkey FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey",
        "SELECT c_custkey, c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    ),
    "T12_merge_anti": (
        ["orders", "customer"],
        "SELECT c_custkey, c_nationkey FROM customer LEFT ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) "
        "ON o_custkey = c_custkey",
        "SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS "
        "(SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    ),
    "T13_merge_asof": (
        ["events"],
        "SELECT event_id, prev_view_id FROM ("
        "SELECT event_id, event_type, last(CASE WHEN event_type = 'view' THEN event_id END, true) OVER ("
        "PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_view_id "
        "FROM events) WHERE event_type = 'click'",
        "SELECT c.event_id, v.event_id AS prev_view_id FROM (SELECT * FROM events WHERE event_type = 'click') c "
        "ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v "
        "ON c.user_id = v.user_id AND c.ts > v.ts",
    ),
    "T14_set_ops": (
        ["customer", "supplier"],
        "SELECT 'union' AS op, n FROM (SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier) "
        "UNION ALL SELECT 'intersect', n FROM (SELECT c_nationkey AS n FROM customer INTERSECT "
        "SELECT s_nationkey FROM supplier) "
        "UNION ALL SELECT 'except', n FROM (SELECT c_nationkey AS n FROM customer EXCEPT SELECT s_nationkey FROM supplier) "
        "UNION ALL SELECT 'concat', count(*) FROM (SELECT c_nationkey FROM customer UNION ALL "
        "SELECT s_nationkey FROM supplier)",
        None,
    ),
    "T15_time_buckets": (
        ["events"],
        "SELECT date_trunc('DAY', ts) AS day, count(*) AS n, round(sum(value), 2) AS total FROM events "
        "GROUP BY date_trunc('DAY', ts)",
        "SELECT date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 2) AS total FROM events "
        "GROUP BY date_trunc('day', ts)",
    ),
    "T16_summary": (
        ["lineitem"],
        "SELECT count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, "
        "min(l_quantity) AS min, round(percentile(l_quantity, 0.25), 6) AS p25, "
        "round(percentile(l_quantity, 0.5), 6) AS p50, round(percentile(l_quantity, 0.75), 6) AS p75, "
        "max(l_quantity) AS max FROM lineitem",
        "SELECT count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, "
        "min(l_quantity) AS min, round(quantile_cont(l_quantity, 0.25), 6) AS p25, "
        "round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.75), 6) AS p75, "
        "max(l_quantity) AS max FROM lineitem",
    ),
    "T17_string_null": (
        ["part"],
        "SELECT p_partkey, upper(p_name) AS name_upper, substr(p_type, 1, 3) AS type3, "
        "regexp_replace(p_brand, '[^0-9]', '') AS brand_no, coalesce(nullif(p_size, 1), 0) AS size_or_zero, "
        "length(p_name) AS name_len FROM part",
        "SELECT p_partkey, upper(p_name) AS name_upper, substr(p_type, 1, 3) AS type3, "
        "regexp_replace(p_brand, '[^0-9]', '', 'g') AS brand_no, coalesce(nullif(p_size, 1), 0) AS size_or_zero, "
        "CAST(length(p_name) AS INTEGER) AS name_len FROM part",
    ),
    "T18_rollup": (
        ["lineitem"],
        "SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS gid, "
        "round(sum(l_quantity), 2) AS sum_qty, count(*) AS n FROM lineitem "
        "GROUP BY ROLLUP (l_returnflag, l_linestatus)",
        "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS gid, "
        "round(sum(l_quantity), 2) AS sum_qty, count(*) AS n FROM lineitem "
        "GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    ),
}


def t1_nunique(spark, sf):
    return A.nunique(T(spark, sf, "customer"), written=True)


T1_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM customer"
    for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


def i1_peek(spark, sf):
    return A.peek(T(spark, sf, "orders"), ["o_orderdate", "o_orderkey"]).select(
        "o_orderkey", "o_custkey", "o_orderdate", "n_records")


I1_SQL = ("SELECT o_orderkey, o_custkey, o_orderdate, (SELECT count(*) FROM orders) AS n_records FROM orders "
          "ORDER BY o_orderdate, o_orderkey LIMIT 5")

T4_STMT = ("SELECT l_orderkey, l_linenumber, (SELECT count(*) FROM lineitem) AS n_records FROM lineitem "
           "ORDER BY l_shipdate, l_orderkey, l_linenumber LIMIT 5")


def i2_ask_with_repair(spark, sf):
    """A wrapped statement with a wrong column; the repair step fixes it on the second try."""
    register_tables(spark, sf, ["lineitem"])
    wrapped = '{"df": "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflagg"}'
    df, msg = A.ask(spark, wrapped, repair=lambda stmt, err: stmt.replace("l_returnflagg", "l_returnflag"))
    if df is None:
        raise ValueError(msg)
    return df


I2_SQL = "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag"


def i3_report(spark, sf):
    register_tables(spark, sf, ["lineitem"])
    stmt = FAMILIES["T5_group_aggregate"][1]
    df, _ = A.ask(spark, stmt)
    rep = A.report(df, stmt, "t5_result")
    nun = A.nunique(df)
    return nun.withColumn("n_records", F.lit(rep["n_records"]).cast("bigint"))


_T5_COLS = ("l_returnflag", "l_linestatus", "sum_qty", "sum_base_price", "sum_disc_price", "avg_qty", "avg_disc",
            "min_ship", "max_ship", "count_order")
I3_SQL = (f"WITH r AS ({FAMILIES['T5_group_aggregate'][1]}) "
          + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, "
                               f"(SELECT count(*) FROM r) AS n_records FROM r" for c in _T5_COLS))


def i5_recipe_replay(spark, sf):
    """Save a two-step recipe, then replay it: per-order line counts, then their distribution."""
    register_tables(spark, sf, ["lineitem"])
    log = scratch_path(spark, "recipes")
    A.save_recipe(spark, log, "lines", "lines per order",
                  "SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey")
    A.save_recipe(spark, log, "lines", "orders per line count",
                  "SELECT n_lines, count(*) AS n_orders FROM last_result GROUP BY n_lines")
    return A.replay(spark, log, "lines")


I5_SQL = """SELECT n_lines, count(*) AS n_orders FROM
  (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) GROUP BY n_lines"""


def i6_register_dataset(spark, sf):
    """Register three tables into a catalog table, then the same three again: nothing new is added."""
    from tessera.sources.tables import append

    store = scratch_path(spark, "catalog")
    path = f"{store}/datasets"
    for _ in range(2):
        for n in ["customer", "orders", "lineitem"]:
            catalog = read_if_there(spark, path)
            append(A.register_dataset(T(spark, sf, n), catalog, n), store, "datasets")
    return spark.read.parquet(path).select("table_name", "n_rows")


I6_SQL = ("SELECT 'customer' AS table_name, count(*) AS n_rows FROM customer UNION ALL "
          "SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")



def _event_parts(spark, sf):
    return S.in_parts(T(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value"), ["user_id"], ["ts", "event_id"])


def t10_scan_in_parts(spark, sf):
    """T10 for users of any size: running values and the row before, over parts of a user."""
    parts = S.with_running(_event_parts(spark, sf), {"rn": ("count", F.lit(1)), "cum_value": ("sum", "value")})
    out = S.framed(parts, 1, lambda w: {"prev_value": F.lag("value").over(w)})
    return out.select("event_id", "user_id", F.col("rn").cast("bigint").alias("rn"), "prev_value", F.round("cum_value", 6).alias("cum_value"))


def t11_frame_in_parts(spark, sf):
    """A frame of three rows that may begin in the part before."""
    out = S.framed(_event_parts(spark, sf), 2, lambda w: {"mean": F.avg("value").over(w.rowsBetween(-2, 0))})
    return out.select("event_id", F.round("mean", 6).alias("rolling_value"))


def t13_asof_in_parts(spark, sf):
    """Each click with the user's latest earlier view."""
    events = T(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    views = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("prev_view_id"))
    return S.asof(events.where("event_type = 'click'"), views, ["user_id"], "ts", "view_ts", ["prev_view_id"], ties=["prev_view_id"]).select(
        "event_id", "prev_view_id")


def t16_exact_quantiles(spark, sf):
    """T16 with percentiles by selection, for columns whose different values are too many for one task."""
    lines = T(spark, sf, "lineitem").select("l_quantity")
    p25, p50, p75 = S.exact_quantiles(lines, "l_quantity", [0.25, 0.5, 0.75])
    q = F.col("l_quantity")
    return lines.agg(F.count(q).alias("n"), F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_samp(q), 6).alias("std"), F.min(q).alias("min"),
                     *[F.round(F.lit(v), 6).alias(name) for name, v in (("p25", p25), ("p50", p50), ("p75", p75))], F.max(q).alias("max"))


QUERIES = {
    "T10_scan_in_parts": (t10_scan_in_parts, FAMILIES["T10_rank_shift_cumsum"][2]),
    "T11_frame_in_parts": (t11_frame_in_parts, FAMILIES["T11_rolling_mean"][1]),
    "T13_asof_in_parts": (t13_asof_in_parts, FAMILIES["T13_merge_asof"][2]),
    "T16_exact_quantiles": (t16_exact_quantiles, FAMILIES["T16_summary"][2]),
    "I1_peek": (i1_peek, I1_SQL),
    "I2_ask_with_repair": (i2_ask_with_repair, I2_SQL),
    "I3_report": (i3_report, I3_SQL),
    "I4_nunique": (t1_nunique, T1_SQL),
    "I5_recipe_replay": (i5_recipe_replay, I5_SQL),
    "I6_register_dataset": (i6_register_dataset, I6_SQL),
    "T1_nunique": (_ask("SELECT 'c_custkey' AS column_name, count(DISTINCT c_custkey) AS n_distinct FROM customer "
                        "UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer "
                        "UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey) FROM customer",
                        ["customer"]),
                   "SELECT 'c_custkey' AS column_name, count(DISTINCT c_custkey) AS n_distinct FROM customer "
                   "UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer "
                   "UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey) FROM customer"),
    "T4_head_len": (_ask(T4_STMT, ["lineitem"]), T4_STMT),
}
for _name, (_tables, _stmt, _dsql) in FAMILIES.items():
    QUERIES[_name] = (_ask(_stmt, _tables), _dsql or _stmt)
