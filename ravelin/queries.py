"""Queries over the given tables, one or more for each operator, with the SQL that must give the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ravelin.functions import stats
from ravelin.functions.periods import bucket
from ravelin.functions.predicates import code_key
from ravelin.operators import aggregates as agg, charts, documents, forecast, history, kpi, modeling, quality, recommend, relations, report, segments, target, why
from ravelin.plans.compile import compile_plan
from ravelin.plans.ir import Filter, Operation, QueryPlan
from ravelin.sources import catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None, *tables: str):
    """Registers a function of the named tables."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[table(spark, sf_dir, t) for t in tables])
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def plan(name: str, sql: str, source: str, p: QueryPlan, shape=lambda d: d):
    query(name, sql, source)(lambda d: shape(compile_plan(p, d)))


def r(*columns: str, n: int = 4, up: float = 0.0):
    """Rounds columns, so that the order of additions doesn't show; ``up`` moves exact halves off the edge."""
    return lambda d: d.withColumns({c: F.round(F.col(c).cast("double") + up, n) for c in columns})


def longs(*columns: str):
    return lambda d: d.withColumns({c: F.col(c).cast("long") for c in columns})


O = Operation  # noqa: E741
ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"

# --- filters ---
for _name, _f, _sql in (
    ("eq", Filter("o_orderstatus", "=", "F"), "o_orderstatus = 'F'"),
    ("ne", Filter("o_orderstatus", "!=", "F"), "o_orderstatus is distinct from 'F'"),
    ("gt", Filter("o_totalprice", ">", 200000.0), "o_totalprice > 200000"),
    ("ge", Filter("o_totalprice", ">=", 200000.0), "o_totalprice >= 200000"),
    ("lt", Filter("o_totalprice", "<", 5000.0), "o_totalprice < 5000"),
    ("le", Filter("o_totalprice", "<=", 5000.0), "o_totalprice <= 5000"),
    ("in", Filter("o_orderpriority", "in", ("1-URGENT", "2-HIGH")), "o_orderpriority in ('1-URGENT', '2-HIGH')"),
    ("not_in", Filter("o_orderpriority", "not_in", ("1-URGENT", "2-HIGH")), "coalesce(o_orderpriority not in ('1-URGENT', '2-HIGH'), true)"),
    ("contains", Filter("o_orderpriority", "contains", "urg"), "contains(lower(o_orderpriority), 'urg')"),
    ("month", Filter("o_orderdate", "month", 3), "month(o_orderdate) = 3"),
    ("quarter", Filter("o_orderdate", "quarter", 2), "quarter(o_orderdate) = 2"),
    ("year", Filter("o_orderdate", "year", 1996), "year(o_orderdate) = 1996"),
):
    plan(f"filter_{_name}", f"select {ORDERS} from orders where {_sql}", "orders", QueryPlan(O.FILTER, filters=(_f,)))
plan("filter_conjunctive", f"select {ORDERS} from orders where o_orderstatus = 'O' and o_totalprice > 100000 and year(o_orderdate) = 1997", "orders",
     QueryPlan(O.FILTER, filters=(Filter("o_orderstatus", "=", "O"), Filter("o_totalprice", ">", 100000.0), Filter("o_orderdate", "year", 1997))))
query("filter_null_rules", "select count(*) filter (where nullif(o_orderstatus, 'P') = 'F') eq, count(*) filter (where nullif(o_orderstatus, 'P') is distinct from 'F') ne, count(*) filter (where coalesce(nullif(o_orderstatus, 'P') not in ('F'), true)) not_in from orders", "orders")(
    lambda d: (lambda c: d.agg(F.count_if(c == "F").alias("eq"), F.count_if(~c.eqNullSafe("F")).alias("ne"), F.count_if(~F.coalesce(c.isin("F"), F.lit(False))).alias("not_in")))(F.expr("nullif(o_orderstatus, 'P')")))
query("filter_code_key", "select c_custkey, lower(regexp_extract(c_name, '^([A-Za-z]+)[-_ #]?(\\d+)$', 1)) prefix, cast(regexp_extract(c_name, '^([A-Za-z]+)[-_ #]?(\\d+)$', 2) as bigint) number from customer where regexp_matches(c_name, '^([A-Za-z]+)[-_ #]?(\\d+)$')", "customer")(
    lambda d: d.select("c_custkey", code_key(F.col("c_name")).alias("k")).where("k is not null").select("c_custkey", "k.prefix", "k.number"))

# --- aggregates ---
plan("count_rows", "select count(*) as \"value\" from orders", "orders", QueryPlan(O.COUNT))
plan("count_distinct_entity", "select count(distinct o_custkey) as \"value\" from orders", "orders", QueryPlan(O.COUNT, "o_custkey"))
plan("count_grouped", "select o_orderpriority, count(distinct o_custkey) as \"value\" from orders group by 1", "orders", QueryPlan(O.COUNT, "o_custkey", group_by="o_orderpriority"))
plan("sum_measure", "select round(sum(o_totalprice), 2) as \"value\" from orders", "orders", QueryPlan(O.SUM, "o_totalprice"), r("value", n=2))
plan("sum_of_nothing", "select cast(0 as double) as \"value\"", "orders", QueryPlan(O.SUM, "o_totalprice", (Filter("o_totalprice", "<", -1.0),)))
plan("average_measure", "select round(avg(o_totalprice), 4) as \"value\" from orders", "orders", QueryPlan(O.AVERAGE, "o_totalprice"), r("value"))
plan("min_measure", "select min(o_totalprice) as \"value\" from orders", "orders", QueryPlan(O.MIN, "o_totalprice"))
plan("max_measure", "select max(o_totalprice) as \"value\" from orders", "orders", QueryPlan(O.MAX, "o_totalprice"))
for _op, _fn in (("sum", O.SUM), ("avg", O.AVERAGE), ("min", O.MIN), ("max", O.MAX)):
    plan(f"grouped_{_op}", f"select l_returnflag, round({_op}(l_extendedprice), 2) as \"value\" from lineitem group by 1", "lineitem", QueryPlan(_fn, "l_extendedprice", group_by="l_returnflag"), r("value", n=2))
query("grouped_null_group", "select nullif(o_orderstatus, 'P') g, round(sum(o_totalprice), 2) as \"value\" from orders group by 1", "orders")(
    lambda d: r("value", n=2)(agg.grouped(d.withColumn("g", F.expr("nullif(o_orderstatus, 'P')")), "g", "sum", "o_totalprice")))
query("pricing_summary", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice), 2) sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) sum_disc, round(avg(l_quantity), 4) avg_qty, round(avg(l_discount), 4) avg_disc, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2", "lineitem")(
    lambda d: d.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count(F.lit(1)).alias("n")))
plan("argmax_rows", "select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from part where p_retailprice = (select max(p_retailprice) from part)", "part", QueryPlan(O.ARGMAX, "p_retailprice"))
plan("argmin_subject", "select distinct p_brand, p_retailprice from part where p_retailprice = (select min(p_retailprice) from part)", "part", QueryPlan(O.ARGMIN, "p_retailprice", subject="p_brand"))
plan("max_of_subject", "select distinct c_name, c_acctbal from customer where c_acctbal = (select max(c_acctbal) from customer)", "customer", QueryPlan(O.MAX, "c_acctbal", subject="c_name"))
plan("top_n", "select o_custkey, round(sum(o_totalprice), 2) o_totalprice from orders group by 1 order by sum(o_totalprice) desc, 1 limit 7", "orders", QueryPlan(O.TOP_N, "o_totalprice", subject="o_custkey", limit=7), r("o_totalprice", n=2))
plan("bottom_n", "select o_custkey, round(sum(o_totalprice), 2) o_totalprice from orders group by 1 order by sum(o_totalprice), 1 limit 5", "orders", QueryPlan(O.BOTTOM_N, "o_totalprice", subject="o_custkey", limit=5), r("o_totalprice", n=2))
plan("top_priorities_1996", "select o_orderpriority, round(sum(o_totalprice), 2) o_totalprice from orders where year(o_orderdate) = 1996 group by 1 order by 2 desc, 1 limit 5", "orders", QueryPlan(O.TOP_N, "o_totalprice", (Filter("o_orderdate", "year", 1996),), "o_orderpriority", limit=5), r("o_totalprice", n=2))
plan("measure_column", "select o_totalprice from orders where o_orderstatus = 'P'", "orders", QueryPlan(O.FILTER, "o_totalprice", (Filter("o_orderstatus", "=", "P"),)))
query("distinct_entities", "select c_custkey, min(c_name) c_name, min(c_mktsegment) c_mktsegment from customer group by 1", "customer")(lambda d: agg.entities(d, "c_custkey"))
plan("describe_measure", "select count(o_totalprice) \"count\", round(avg(o_totalprice), 4) mean, round(stddev(o_totalprice), 4) std, min(o_totalprice) \"min\", round(quantile_cont(o_totalprice, 0.25), 4) q25, round(quantile_cont(o_totalprice, 0.5), 4) q50, round(quantile_cont(o_totalprice, 0.75), 4) q75, max(o_totalprice) \"max\" from orders", "orders", QueryPlan(O.DESCRIBE, "o_totalprice"), r("mean", "std", "q25", "q50", "q75"))
query("distinct_aggregates", "select l_returnflag, sum(distinct l_quantity) s, round(avg(distinct l_quantity), 4) a, min(l_quantity) lo, max(l_quantity) hi from lineitem group by 1", "lineitem")(
    lambda d: r("a")(d.groupBy("l_returnflag").agg(agg.aggregate("sum_distinct", "l_quantity").alias("s"), agg.aggregate("average_distinct", "l_quantity").alias("a"), agg.aggregate("min_distinct", "l_quantity").alias("lo"), agg.aggregate("max_distinct", "l_quantity").alias("hi"))))
query("mode_value", "select l_returnflag, (select min(q) from (select l_quantity q, count(*) n from lineitem b where b.l_returnflag = a.l_returnflag group by 1 qualify n = max(n) over ())) m from (select distinct l_returnflag from lineitem) a", "lineitem")(
    lambda d: d.groupBy("l_returnflag").agg(agg.aggregate("mode", "l_quantity").alias("m")))
query("crosstab", "select o_orderstatus, o_orderpriority, count(*) \"rows\" from orders group by 1, 2", "orders")(lambda d: agg.crosstab(d, "o_orderstatus", "o_orderpriority"))
query("value_shares", "select c_mktsegment, count(*) \"rows\", round(count(*) / sum(count(*)) over (), 6) \"share\" from customer group by 1", "customer")(lambda d: r("share", n=6)(agg.shares(d, "c_mktsegment")))
query("duplicate_rows", "select cast(sum(n) as bigint) \"rows\", cast(sum(n - 1) as bigint) duplicates from (select count(*) n from lineitem group by l_returnflag, l_linestatus, l_quantity, l_discount)", "lineitem")(
    lambda d: agg.duplicate_rows(d.select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")))
query("fold_rare", "select case when n >= 40 then p_brand else 'Other' end p_brand, cast(sum(n) as bigint) n from (select p_brand, count(*) n from part group by 1) group by 1", "part")(
    lambda d: agg.fold_rare(d, "p_brand", 40).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")))
query("keep_top", "with t as (select event_type from events group by 1 order by count(*) desc, 1 limit 2) select case when event_type in (from t) then event_type else 'Other' end event_type, count(*) n from events group by 1", "events")(
    lambda d: agg.keep_top(d, "event_type", 2).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))
query("dimension_measure_stats", "select c_mktsegment, count(c_acctbal) \"count\", round(sum(c_acctbal), 2) \"sum\", round(avg(c_acctbal), 4) mean, round(median(c_acctbal), 4) median, min(c_acctbal) \"min\", max(c_acctbal) \"max\", round(stddev(c_acctbal), 4) std from customer group by 1", "customer")(
    lambda d: r("mean", "median", "std")(r("sum", n=2)(agg.by_dimension(d, "c_mktsegment", "c_acctbal"))))

# --- time ---
for _g, _u in (("D", "day"), ("W", "week"), ("M", "month"), ("Q", "quarter"), ("Y", "year")):
    query(f"orders_by_{_u}", f"select cast(date_trunc('{_u}', o_orderdate) as timestamp) period, count(o_totalprice) \"count\", round(sum(o_totalprice), 2) \"sum\", round(avg(o_totalprice) + 3e-6, 4) mean from orders group by 1", "orders")(
        lambda d, g=_g: r("mean", up=3e-6)(r("sum", n=2)(agg.by_period(d, "o_orderdate", g, "o_totalprice"))))
query("calendar_gaps", "select period, count(e.event_id) n from (select unnest(generate_series((select min(date_trunc('day', ts)) from events), (select max(date_trunc('day', ts)) from events), interval 1 day)) period) c left join events e on date_trunc('day', e.ts) = c.period group by 1", "events")(
    lambda d: _calendar(d))


def _calendar(d: DataFrame) -> DataFrame:
    from ravelin.functions.periods import calendar

    n = d.groupBy(bucket("ts", "D").alias("period")).agg(F.count("event_id").alias("n"))
    return calendar(d, "ts", "D").join(n, "period", "left").withColumn("n", F.coalesce("n", F.lit(0)))


query("incomplete_month_dropped", "select cast(date_trunc('month', o_orderdate) as timestamp) period, count(*) n from orders where o_orderdate < (select case when (extract(day from max(o_orderdate))) >= 0.8 * extract(day from last_day(max(o_orderdate))) then timestamp '9999-01-01' else date_trunc('month', max(o_orderdate)) end from orders) group by 1", "orders")(
    lambda d: __import__("ravelin.functions.periods", fromlist=["x"]).complete_periods(d, "o_orderdate", "M").groupBy(bucket("o_orderdate", "M").alias("period")).agg(F.count(F.lit(1)).alias("n")))
query("native_grain", "with g as (select d, date_diff('day', lag(d) over (order by d), d) g from (select distinct cast(ts as date) d from events)) select count(*) moments, median(g) median_gap_days, case when median(g) = 1 then 'D' when median(g) = 7 then 'W' when median(g) between 28 and 31 then 'M' when median(g) between 89 and 92 then 'Q' when median(g) between 365 and 366 then 'Y' end grain from g", "events")(
    lambda d: target.native_grain(d, "ts"))
plan("chart_by_month", "select cast(date_trunc('month', o_orderdate) as timestamp) o_orderdate, round(sum(o_totalprice), 2) as \"value\" from orders group by 1", "orders", QueryPlan(O.CHART, "o_totalprice", group_by="o_orderdate", time_grain="M"), r("value", n=2))

# --- windows ---
HISTORY = """with e as (select event_id, user_id, ts, coalesce(event_type = 'purchase', false) s from events)
select event_id, cast(floor(date_diff('microsecond', lag(ts) over w, ts) / 86400e6) as bigint) days_since_last,
row_number() over w - 1 prior_contacts, cast(coalesce(sum(cast(s as int)) over (w rows between unbounded preceding and 1 preceding), 0) as bigint) prior_successes,
cast(floor(date_diff('microsecond', last_value(case when s then ts end ignore nulls) over (w rows between unbounded preceding and 1 preceding), ts) / 86400e6) as bigint) days_since_success,
(select count(*) from e b where b.user_id = e.user_id and b.ts >= e.ts - interval 7 day and (b.ts < e.ts or b.ts = e.ts and b.event_id < e.event_id)) contacts_7d
from e window w as (partition by user_id order by ts, event_id)"""
query("history_features", HISTORY, "events")(
    lambda d: history.history_features(d, "user_id", "ts", "event_id", F.col("event_type") == "purchase", 7).select("event_id", "days_since_last", "prior_contacts", "prior_successes", "days_since_success", "contacts_7d"))
query("history_success_rate", "select event_id, lag(s) over w last_succeeded, round((sum(s) over (w rows between unbounded preceding and 1 preceding)) / nullif(row_number() over w - 1, 0), 6) prior_success_rate from (select *, cast(event_type = 'purchase' as int) s from events) window w as (partition by user_id order by ts, event_id)", "events")(
    lambda d: r("prior_success_rate", n=6)(history.history_features(d, "user_id", "ts", "event_id", F.col("event_type") == "purchase").select("event_id", "last_succeeded", "prior_success_rate")))
query("contacts_90d_orders", "select o_orderkey, (select count(*) from orders b where b.o_custkey = a.o_custkey and b.o_orderdate >= a.o_orderdate - interval 90 day and (b.o_orderdate < a.o_orderdate or b.o_orderdate = a.o_orderdate and b.o_orderkey < a.o_orderkey)) contacts_90d from orders a", "orders")(
    lambda d: history.history_features(d, "o_custkey", "o_orderdate", "o_orderkey", F.lit(False)).select("o_orderkey", "contacts_90d"))
query("snapshot_as_of", "with e as (select * from events where ts < timestamp '2024-01-15') select u.user_id, count(e.event_id) contacts, count(e.event_id) filter (where event_type = 'purchase') successes, round(count(e.event_id) filter (where event_type = 'purchase') / nullif(count(e.event_id), 0), 6) success_rate, cast(floor(date_diff('microsecond', max(ts), timestamp '2024-01-15') / 86400e6) as bigint) days_since_last, cast(floor(date_diff('microsecond', max(ts) filter (where event_type = 'purchase'), timestamp '2024-01-15') / 86400e6) as bigint) days_since_success from (select distinct user_id from events) u left join e using (user_id) group by 1", "events")(
    lambda d: r("success_rate", n=6)(history.snapshot(d, "user_id", "ts", "event_id", F.col("event_type") == "purchase", "2024-01-15", d).drop("last_succeeded")))
query("rank_thirds", "select band, count(*) n, max(o_totalprice) hi from (select o_totalprice, case when r <= 1 + (n - 1) / 3 then 0 when r <= 1 + 2 * (n - 1) / 3 then 1 else 2 end band from (select o_totalprice, row_number() over (order by o_totalprice, o_orderkey) r, count(*) over () n from orders)) group by 1", "orders")(
    lambda d: history.thirds(d, "o_totalprice", "o_orderkey").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("hi")))
query("quartile_bins", "with q as (select quantile_cont(p_retailprice, 0.25) a, quantile_cont(p_retailprice, 0.5) b, quantile_cont(p_retailprice, 0.75) c from part) select case when p_retailprice <= a then 1 when p_retailprice <= b then 2 when p_retailprice <= c then 3 else 4 end bin, count(*) \"rows\", round(avg(p_size), 4) mean from part, q group by 1", "part")(
    lambda d: r("mean")(history.quartile_bins(d, "p_retailprice", "p_size").select("bin", "rows", "mean")))
query("decile_lift", "with d as (select cast(floor((row_number() over (order by o_totalprice desc, o_orderkey) - 1) * 10 / count(*) over ()) + 1 as bigint) decile, cast(o_orderstatus = 'F' as int) y from orders), g as (select decile, count(*) \"rows\", cast(sum(y) as bigint) positives from d group by 1) select decile, \"rows\", positives, round(positives / \"rows\", 6) rate, round(positives / \"rows\" / ((sum(positives) over ()) / (sum(\"rows\") over ())), 6) lift, round((sum(positives) over (order by decile)) / (sum(positives) over ()), 6) capture from g", "orders")(
    lambda d: r("rate", "lift", "capture", n=6)(history.lift_table(d.withColumn("y", (F.col("o_orderstatus") == "F").cast("int")), "o_totalprice", "y", "o_orderkey")))
query("ranked_positions", "select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) \"position\" from orders", "orders")(
    lambda d: history.ranked(d.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "position"))
query("mid_percentile", "select l_orderkey, l_linenumber, round((rank() over (order by l_quantity) - 1 + (count(*) over (partition by l_quantity)) / 2) / count(*) over (), 6) percentile from lineitem", "lineitem")(
    lambda d: r("percentile", n=6)(history.mid_percentile(d, "l_quantity").select("l_orderkey", "l_linenumber", "percentile")))
query("top_share_per_week", "select event_id from (select event_id, row_number() over (partition by date_trunc('week', ts) order by \"value\" desc, event_id) r, count(*) over (partition by date_trunc('week', ts)) n from events) where r <= ceil(n * 0.2)", "events")(
    lambda d: history.top_share(d, bucket("ts", "W"), "value", "event_id", 0.2).select("event_id"))

# --- joins and sets ---
def _tables(spark, sf_dir):
    return {t: table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region")}


QUERIES["lookup_depth_2"] = lambda s, d: catalog.enrich(catalog.Catalog(_tables(s, d)), "orders", [catalog.Link("orders", "o_custkey", "customer", "c_custkey"), catalog.Link("customer", "c_nationkey", "nation", "n_nationkey")])[0].select("o_orderkey", "c_name", "c_mktsegment", "n_name")
ORACLE["lookup_depth_2"] = "select o_orderkey, c_name, c_mktsegment, n_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey"
QUERIES["link_discovery"] = lambda s, d: s.createDataFrame([(x.table, x.column, x.lookup, x.lookup_column) for x in catalog.discover_links(catalog.Catalog(_tables(s, d)))], "base string, key string, lookup string, lookup_key string")
ORACLE["link_discovery"] = "select * from (values ('customer', 'c_nationkey', 'nation', 'n_nationkey'), ('nation', 'n_regionkey', 'region', 'r_regionkey'), ('orders', 'o_custkey', 'customer', 'c_custkey')) t(base, key, lookup, lookup_key)"
query("key_overlap", "select count(*) \"keys\", count(c_custkey) found, round(count(c_custkey) / count(*), 6) overlap from (select distinct o_custkey from orders) left join customer on o_custkey = c_custkey", "orders", "customer")(lambda o, c: r("overlap", n=6)(catalog.key_overlap(o, "o_custkey", c, "c_custkey")))
query("semi_join", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 250000)", "customer", "orders")(lambda c, o: c.join(o.where("o_totalprice > 250000"), c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey"))
query("anti_join", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)", "customer", "orders")(lambda c, o: c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey"))
query("revenue_by_nation", "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where year(o_orderdate) = 1996 group by 1", "lineitem", "orders", "customer", "nation")(
    lambda l, o, c, n: l.join(o.where(F.year("o_orderdate") == 1996), l["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")))
query("union_dedupe", "select k, min(src) src from (select s_nationkey k, 0 src from supplier union all select c_nationkey, 1 from customer) group by 1", "supplier", "customer")(lambda s, c: s.select(F.col("s_nationkey").alias("k"), F.lit(0).alias("src")).unionByName(c.select(F.col("c_nationkey").alias("k"), F.lit(1).alias("src"))).groupBy("k").agg(F.min("src").alias("src")))
query("key_intersection", "select count(*) n from (select o_custkey from orders intersect select c_custkey from customer)", "orders", "customer")(lambda o, c: o.select("o_custkey").intersect(c.select("c_custkey")).agg(F.count(F.lit(1)).alias("n")))
query("distinct_periods", "select distinct cast(date_trunc('quarter', o_orderdate) as timestamp) period from orders", "orders")(lambda d: d.select(bucket("o_orderdate", "Q").alias("period")).distinct())

# --- profile and quality ---
query("profile_orders", "select 'o_totalprice' \"column\", count(*) \"rows\", count(o_totalprice) non_null, count(distinct o_totalprice) \"unique\", round(min(o_totalprice), 4) \"min\", round(max(o_totalprice), 4) \"max\", round(avg(o_totalprice), 4) mean, round(median(o_totalprice), 4) median, round(stddev(o_totalprice), 4) std, round(skewness(o_totalprice), 4) skew from orders", "orders")(
    lambda d: r("min", "max", "mean", "median", "std", "skew")(quality.profile(d.select("o_totalprice")).select("column", "rows", "non_null", "unique", "min", "max", "mean", "median", "std", "skew")))
query("null_ratios", "select 'o_orderstatus' \"column\", round(count(*) filter (where o_orderstatus = 'P') / count(*), 6) missing_ratio from orders", "orders")(
    lambda d: r("missing_ratio", n=6)(quality.profile(d.select(F.expr("nullif(o_orderstatus, 'P')").alias("o_orderstatus"))).select("column", "missing_ratio")))
query("adjusted_skew", "select round(skewness(c_acctbal), 4) skew from customer", "customer")(lambda d: d.agg(F.round(stats.adjusted_skewness("c_acctbal"), 4).alias("skew")))
query("outlier_fences", "with q as (select quantile_cont(l_extendedprice, 0.25) a, quantile_cont(l_extendedprice, 0.75) b from lineitem), f as (select a - 1.5 * (b - a) low, b + 1.5 * (b - a) high from q) select round(low, 4) low, round(high, 4) high, count(*) \"rows\", count(*) filter (where l_extendedprice < low or l_extendedprice > high) outliers from lineitem, f group by low, high", "lineitem")(
    lambda d: r("low", "high")(quality.outlier_ratio(d, "l_extendedprice", 1.5)))
query("negative_ratio", "select round(avg(cast(c_acctbal < 0 as int)), 6) negative_ratio from customer", "customer")(lambda d: r("negative_ratio", n=6)(quality.profile(d.select("c_acctbal")).select("negative_ratio")))
query("label_collisions", "select lower(trim(v)) \"label\", count(*) variants from (select distinct case when c_custkey % 2 = 0 then upper(c_mktsegment) else c_mktsegment || ' ' end v from customer) group by 1 having count(*) > 1", "customer")(
    lambda d: quality.label_collisions(d.select(F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit(" "))).alias("v")), "v"))
QUERIES["quality_findings"] = lambda s, d: quality.findings(table(s, d, "orders"), "2002-01-01")
QUERIES["column_roles"] = lambda s, d: s.createDataFrame([(c.name, c.role) for t in ("orders", "customer", "events", "part") for c in quality.infer_schema(table(s, d, t)).columns], "column string, role string")

# --- statistics ---
query("pearson", "select 'l_quantity' x, 'l_extendedprice' y, count(*) n, round(corr(l_quantity, l_extendedprice), 4) pearson from lineitem", "lineitem")(lambda d: r("pearson")(relations.pearson_matrix(d, ["l_quantity", "l_extendedprice"])))
query("spearman", "with d as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2 a, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2 b from lineitem) select count(*) n, round(corr(a, b), 4) spearman from d", "lineitem")(lambda d: r("spearman")(stats.spearman(d, "l_quantity", "l_extendedprice")))
query("eta_squared", "with d as (select c_mktsegment g, c_acctbal x, avg(c_acctbal) over (partition by c_mktsegment) m, avg(c_acctbal) over () t from customer) select count(distinct g) groups, count(*) n, round(sum((m - t) ** 2) / sum((x - t) ** 2), 6) eta_squared from d", "customer")(lambda d: r("eta_squared", n=6)(relations.eta_squared(d, "c_mktsegment", "c_acctbal").select("groups", "n", "eta_squared")))
query("chi_square", "with o as (select o_orderstatus a, o_orderpriority b, count(*) n from orders group by 1, 2), g as (select x.a, y.b, coalesce(o.n, 0) n, x.s * y.s / t e, t from (select o_orderstatus a, count(*) s from orders group by 1) x cross join (select o_orderpriority b, count(*) s from orders group by 1) y cross join (select count(*) t from orders) left join o on o.a = x.a and o.b = y.b) select max(t) n, round(sum((n - e) ** 2 / e), 4) chi_square, round(sqrt(sum((n - e) ** 2 / e) / (max(t) * (least(count(distinct a), count(distinct b)) - 1))), 4) cramers_v from g", "orders")(lambda d: r("chi_square", "cramers_v")(relations.chi_square_table(d, "o_orderstatus", "o_orderpriority")))
query("group_difference", "with g as (select o_orderpriority g, avg(o_totalprice) m from orders group by 1) select (select g from g order by m desc, g desc limit 1) highest, round(max(m), 4) high, (select g from g order by m, g limit 1) lowest, round(min(m), 4) low, round((max(m) - min(m)) / greatest(abs(max(m)), abs(min(m))), 6) spread from g", "orders")(lambda d: r("spread", n=6)(r("high", "low")(relations.group_difference(d, "o_orderpriority", "o_totalprice"))))
query("time_trend", "with g as (select row_number() over (order by p) - 1 i, y from (select date_trunc('month', o_orderdate) p, avg(o_totalprice) y from orders group by 1)) select count(*) periods, round(regr_slope(y, i), 3) slope, round(regr_r2(y, i), 4) r2, round(avg(y), 4) mean, round(regr_slope(y, i) * (count(*) - 1) / avg(abs(y)), 4) change from g", "orders")(lambda d: r("slope", n=3)(r("r2", "mean", "change")(relations.trend(d, "o_orderdate", "o_totalprice"))))
query("auc_mid_ranks", "with d as (select l_quantity x, cast(l_returnflag = 'R' as int) y from lineitem), k as (select y, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2 r from d) select cast(sum(y) as bigint) positives, cast(sum(1 - y) as bigint) negatives, round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) auc from k", "lineitem")(lambda d: r("auc", n=6)(target.auc(d.withColumn("y", (F.col("l_returnflag") == "R").cast("int")), "l_quantity", "y").select("positives", "negatives", "auc")))
query("robust_z", "with m as (select median(c_acctbal) med from customer), k as (select 1.4826 * median(abs(c_acctbal - med)) mad from customer, m) select c_custkey, round((c_acctbal - med) / mad, 6) z from customer, m, k", "customer")(lambda d: r("z", n=6)(segments.robust_z(d.select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "z")))
QUERIES["insights"] = lambda s, d: relations.insights(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag", "l_linestatus"], "l_shipdate")
query("variance_inflation", None, "lineitem")(lambda d: relations.partners(d, ["l_quantity", "l_extendedprice", "l_discount"]))

# --- key figures ---
ROLES = {"orders": kpi.Roles("o_orderdate", {"segment": "o_orderpriority"}), "lineitem": kpi.Roles("l_shipdate", {"segment": "l_returnflag"})}
KPIS = [
    kpi.Kpi("revenue", kpi.Aggregate("orders", "sum", "o_totalprice")),
    kpi.Kpi("orders", kpi.Aggregate("orders", "count")),
    kpi.Kpi("large orders", kpi.Aggregate("orders", "count", None, {"o_totalprice": {"gt": 200000}})),
    kpi.Kpi("buyers", kpi.Aggregate("orders", "distinct", "o_custkey")),
    kpi.Kpi("open share", kpi.Aggregate("orders", "count", None, {"o_orderstatus": "O"}), kpi.Aggregate("orders", "count")),
    kpi.Kpi("coverage", kpi.Aggregate("orders", "distinct", "o_custkey"), kpi.Aggregate("customer", "distinct", "c_custkey")),
    kpi.Kpi("lines per order", kpi.Aggregate("lineitem", "count"), kpi.Aggregate("orders", "count")),
]
KPI_SQL = """with o as (select cast(date_trunc('{u}', o_orderdate) as timestamp) p, sum(o_totalprice) revenue, count(*) orders, count(*) filter (where o_totalprice > 200000) large, count(distinct o_custkey) buyers, count(*) filter (where o_orderstatus = 'O') open from orders group by 1),
l as (select cast(date_trunc('{u}', l_shipdate) as timestamp) p, count(*) lines from lineitem group by 1), c as (select count(distinct c_custkey) n from customer), a as (select coalesce(o.p, l.p) p, * exclude (p) from o full join l on o.p = l.p)
select kpi, p period, cast(null as varchar) "group", round(v, 4) as "value" from a, c, lateral (values ('revenue', cast(revenue as double)), ('orders', orders), ('large orders', large), ('buyers', buyers), ('open share', open / orders), ('coverage', buyers / n), ('lines per order', lines / orders)) t(kpi, v)"""
QUERIES["kpi_by_year"] = lambda s, d: r("value")(kpi.evaluate({t: table(s, d, t) for t in ("orders", "customer", "lineitem")}, ROLES, KPIS, "Y"))
ORACLE["kpi_by_year"] = KPI_SQL.replace("{u}", "year").replace("from a, c, lateral", "from a cross join c cross join lateral") + " where not (kpi in ('revenue', 'orders', 'large orders', 'buyers', 'open share') and orders is null)"
QUERIES["kpi_by_segment"] = lambda s, d: r("value")(kpi.evaluate({"orders": table(s, d, "orders")}, ROLES, KPIS[:5], None, "segment").select("kpi", "group", "value"))
ORACLE["kpi_by_segment"] = "select kpi, g \"group\", round(v, 4) as \"value\" from (select o_orderpriority g, sum(o_totalprice) revenue, count(*) orders, count(*) filter (where o_totalprice > 200000) large, count(distinct o_custkey) buyers, count(*) filter (where o_orderstatus = 'O') open from orders group by 1) cross join lateral (values ('revenue', cast(revenue as double)), ('orders', orders), ('large orders', large), ('buyers', buyers), ('open share', open / orders)) t(kpi, v)"
QUERIES["kpi_trend"] = lambda s, d: (lambda o: r("value", "previous", "change")(kpi.trend(kpi.evaluate({"orders": o}, ROLES, KPIS[:1], "Q"), KPIS, o.agg(F.max("o_orderdate")).first()[0], "Q")))(table(s, d, "orders"))

# --- change ---
P0, P1 = "1996-01-01", "1997-01-01"
query("why_compare", "select round(a, 2) previous, round(b, 2) \"current\", round(b - a, 2) change, round((b - a) / abs(a), 6) change_pct from (select sum(o_totalprice) filter (where year(o_orderdate) = 1996) a, sum(o_totalprice) filter (where year(o_orderdate) = 1997) b from orders)", "orders")(lambda d: r("change_pct", n=6)(r("previous", "current", "change", n=2)(why.compare(d, "o_orderdate", "Y", P0, P1, "sum", "o_totalprice"))))
BREAKDOWN = "with e as (select 'o_orderpriority' dimension, o_orderpriority g, * from orders union all select 'o_orderstatus', o_orderstatus, * from orders), k as (select dimension, g, coalesce(sum(o_totalprice) filter (where year(o_orderdate) = 1996), 0) a, coalesce(sum(o_totalprice) filter (where year(o_orderdate) = 1997), 0) b from e where year(o_orderdate) in (1996, 1997) group by 1, 2)"
query("why_breakdown", BREAKDOWN + " select dimension, g \"group\", round(a, 2) previous, round(b, 2) \"current\", round(b - a, 2) change, round((b - a) / nullif(sum(b - a) over (partition by dimension), 0), 4) \"share\" from k", "orders")(lambda d: r("share")(r("previous", "current", "change", n=2)(why.breakdown(d, "o_orderdate", "Y", P0, P1, "sum", "o_totalprice", ["o_orderpriority", "o_orderstatus"]))))
query("why_concentration", BREAKDOWN + ", s as (select dimension, g, b - a c, sum(b - a) over (partition by dimension) t, sum(abs(b - a)) over (partition by dimension) m from k), w as (select dimension, g, case when sign(c) = sign(t) then abs(c) else 0 end x, m from s) select dimension, max_by(g, x) top, round(max(x) / max(m), 6) concentration from w group by 1", "orders")(lambda d: r("concentration", n=6)(why.concentration(why.breakdown(d, "o_orderdate", "Y", P0, P1, "sum", "o_totalprice", ["o_orderpriority", "o_orderstatus"]))))
query("why_mix_rate", "with g as (select o_orderpriority g, count(*) filter (where year(o_orderdate) = 1996) n0, count(*) filter (where year(o_orderdate) = 1997) n1, avg(o_totalprice) filter (where year(o_orderdate) = 1996) r0, avg(o_totalprice) filter (where year(o_orderdate) = 1997) r1 from orders where year(o_orderdate) in (1996, 1997) group by 1), w as (select *, n0 / (sum(n0) over ()) w0, n1 / (sum(n1) over ()) w1 from g) select g \"group\", round((w1 - w0) * coalesce(r0, r1, 0), 3) mix, round(coalesce(w1 * (r1 - r0), 0), 3) rate from w", "orders")(lambda d: r("mix", "rate", n=3)(why.mix_and_rate(d, "o_orderdate", "Y", P0, P1, "o_totalprice", "o_orderpriority")))
QUERIES["why_drill_down"] = lambda s, d: s.createDataFrame(why.drill_down(table(s, d, "orders"), "o_orderdate", "Y", P0, P1, "sum", "o_totalprice", ["o_orderpriority", "o_orderstatus"], least=0.1), "dimension string, `group` string, share double")
query("group_history", "select g \"group\", p period, round(coalesce(sum(o_totalprice), 0), 2) as \"value\" from (select distinct o_orderpriority g from orders) cross join (select distinct cast(date_trunc('quarter', o_orderdate) as timestamp) p from orders) left join orders on o_orderpriority = g and date_trunc('quarter', o_orderdate) = p group by 1, 2", "orders")(lambda d: r("value", n=2)(why.group_history(d, "o_orderdate", "Q", "o_orderpriority", "sum", "o_totalprice")))
query("attention", None, "orders")(lambda d: why.attention(why.group_history(d, "o_orderdate", "Q", "o_orderpriority", "sum", "o_totalprice")))
query("one_to_one", "select count(distinct (n_nationkey, n_name)) = count(distinct n_nationkey) and count(distinct (n_nationkey, n_name)) = count(distinct n_name) same from nation", "nation")(lambda d: why.one_to_one(d, "n_nationkey", "n_name"))

# --- charts ---
query("chart_bar", "select c_mktsegment x, count(*) as \"value\" from customer group by 1", "customer")(lambda d: charts.execute(charts.ChartSpec("bar", "c_mktsegment"), d))
query("chart_series", "select cast(date_trunc('year', o_orderdate) as timestamp) x, o_orderstatus series, round(sum(o_totalprice), 2) as \"value\" from orders group by 1, 2", "orders")(lambda d: r("value", n=2)(charts.execute(charts.ChartSpec("line", "o_orderdate", "o_totalprice", "o_orderstatus", "sum", "Y"), d)))
query("chart_top_categories", "select p_brand x, round(avg(p_retailprice), 4) as \"value\" from part group by 1 order by avg(p_retailprice) desc, 1 limit 10", "part")(lambda d: r("value")(charts.execute(charts.ChartSpec("bar", "p_brand", "p_retailprice", aggregation="average", limit=10), d)))
query("chart_histogram", "with e as (select min(c_acctbal) a, max(c_acctbal) b from customer) select cast(least(9, floor((c_acctbal - a) / ((b - a) / 10))) as int) bin, count(*) \"rows\" from customer, e group by 1", "customer")(lambda d: charts.histogram(d, "c_acctbal", 10).select("bin", "rows"))
query("chart_box", "select o_orderpriority x, count(*) \"rows\", min(o_totalprice) low, round(quantile_cont(o_totalprice, 0.25), 4) q1, round(median(o_totalprice), 4) median, round(quantile_cont(o_totalprice, 0.75), 4) q3, max(o_totalprice) high from orders group by 1", "orders")(lambda d: r("q1", "median", "q3")(charts.execute(charts.ChartSpec("box", "o_orderpriority", "o_totalprice"), d)))
query("chart_scatter", None, "lineitem")(lambda d: charts.execute(charts.ChartSpec("scatter", "l_quantity", "l_extendedprice", aggregation="none"), d))
query("chart_recommendations", None, "orders")(lambda d: d.sparkSession.createDataFrame([(float(s), c.kind, c.x, c.y, c.aggregation) for s, c in charts.recommend(d, quality.infer_schema(d))], "score double, kind string, x string, y string, aggregation string"))

# --- target ---
def _returned(d: DataFrame) -> DataFrame:
    return d.withColumn("y", (F.col("l_returnflag") == "R").cast("int"))


query("segment_rates", "with g as (select l_linestatus g, count(*) \"rows\", cast(sum(cast(l_returnflag = 'R' as int)) as bigint) positives from lineitem group by 1) select g \"group\", \"rows\", positives, round(positives / \"rows\", 6) rate, round((positives / \"rows\") / ((sum(positives) over ()) / (sum(\"rows\") over ())), 6) lift from g", "lineitem")(lambda d: r("rate", "lift", n=6)(target.segment_rates(_returned(d), "l_linestatus", "y")))
query("target_over_time", "select cast(date_trunc('quarter', l_shipdate) as timestamp) period, count(*) \"rows\", count(*) labelled, cast(sum(cast(l_returnflag = 'R' as int)) as bigint) positives, round(avg(cast(l_returnflag = 'R' as int)), 6) rate from lineitem group by 1", "lineitem")(lambda d: r("rate", n=6)(target.over_time(_returned(d), "l_shipdate", "Q", "y")))
query("panel_check", "select count(*) \"rows\", count(distinct user_id) \"keys\", count(distinct (user_id, ts)) pairs, count(distinct user_id) >= 2 and count(distinct user_id) <= 0.9 * count(*) and count(distinct (user_id, ts)) >= 0.95 * count(*) panel from events", "events")(lambda d: target.is_panel(d, "user_id", "ts"))
query("split_advice", "with p as (select date_trunc('month', o_orderdate) p, count(*) n from orders group by 1), k as (select *, row_number() over (order by p) i, count(*) over () c from p), x as (select max(p) filter (where i = greatest(1, ceil(c * 0.8))) cutoff from k) select cast(cutoff as timestamp) cutoff, cast(sum(n) filter (where p < cutoff) as bigint) \"before\", cast(sum(n) filter (where p >= cutoff) as bigint) \"after\", (select round(avg(1 - 0.8 ** n - 0.2 ** n), 6) from (select count(*) n from orders group by o_custkey)) overlap from p, x group by cutoff", "orders")(lambda d: r("overlap", n=6)(target.split_advice(d, "o_orderdate", "M", "o_custkey")))
query("target_candidates", None, "lineitem")(lambda d: d.sparkSession.createDataFrame(target.candidates(d, quality.infer_schema(d)) or [(0.0, "")], "score double, column string"))
query("leak_findings", None, "lineitem")(lambda d: target.leaks(_returned(d), "y", ["l_quantity", "l_discount"], ["l_linestatus", "l_returnflag"]))
query("label_quality_by_lang", "select lang, count(*) n, round(avg(quality), 6) quality, cast(sum(toxic) as bigint) toxic from documents join labels using (doc_id) group by 1", "documents", "labels")(lambda d, l: d.join(l, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.sum("toxic").cast("long").alias("toxic")))

# --- forecasts ---
SERIES_SQL = "with s as (select date_trunc('day', ts) p, event_type g, count(*) n from events where ts < {end} group by grouping sets ((p), (p, g))), c as (select unnest(generate_series((select min(p) from s), (select max(p) from s), interval 1 day)) p) select x.g series, cast(c.p as timestamp) period, cast(coalesce(s.n, 0) as double) as \"value\" from (select distinct coalesce(g, 'Total') g from s) x cross join c left join s on s.p = c.p and coalesce(s.g, 'Total') = x.g"
query("build_series", SERIES_SQL.replace("{end}", "timestamp '9999-01-01'"), "events")(lambda d: forecast.build_series(d, "ts", "D", "count", None, "event_type", drop_incomplete=False))
query("naive_forecasts", "with s as (select date_trunc('day', ts) p, cast(count(*) as double) n from events group by 1), c as (select p, coalesce(n, 0) y, row_number() over (order by p desc) r, count(*) over () k from (select unnest(generate_series((select min(p) from s), (select max(p) from s), interval 1 day)) p) left join s using (p)) select 'Total' series, cast(step as int) step, (select y from c where r = 1) naive, case when (select max(k) from c) >= 7 then (select y from c where r = 7 - (step - 1) % 7) else (select y from c where r = 1) end seasonal_naive, round((select y from c where r = 1) + step * ((select y from c where r = 1) - (select y from c where r = k)) / ((select max(k) from c) - 1), 6) drift from generate_series(1, 9) t(step)", "events")(lambda d: r("drift", n=6)(forecast.naive_forecasts(forecast.build_series(d, "ts", "D", "count", drop_incomplete=False), "D", 9)))
query("lag_features", "with s as (select cast(date_trunc('month', o_orderdate) as timestamp) period, cast(count(*) as double) as \"value\" from orders group by 1) select period, \"value\", lag(\"value\") over w lag_1, lag(\"value\", 2) over w lag_2, lag(\"value\", 3) over w lag_3, round(avg(\"value\") over (w rows between 3 preceding and 1 preceding), 6) mean_3 from s window w as (order by period)", "orders")(lambda d: r("mean_3", n=6)(forecast.lag_features(forecast.build_series(d, "o_orderdate", "M", "count", drop_incomplete=False)).drop("series")))
query("backtest", None, "orders")(lambda d: forecast.backtest(forecast.build_series(d, "o_orderdate", "M", "sum", "o_totalprice"), "M"))
query("forecast_theta", None, "orders")(lambda d: forecast.forecast(forecast.build_series(d, "o_orderdate", "M", "sum", "o_totalprice", "o_orderstatus"), "M", "theta"))

# --- segments ---
query("build_units", "select o_custkey, count(*) records, round(avg(o_totalprice) + 3e-6, 4) o_totalprice, (select min(p) from (select o_orderpriority p, count(*) n from orders b where b.o_custkey = a.o_custkey group by 1 qualify n = max(n) over ())) o_orderpriority from orders a group by 1", "orders")(lambda d: r("o_totalprice", up=3e-6)(segments.units(d, "o_custkey", ["o_totalprice"], ["o_orderpriority"])))
query("cluster_customers", None, "orders")(lambda d: segments.cluster(segments.units(d, "o_custkey", ["o_totalprice"]), ["records", "o_totalprice"])[0].groupBy("segment").agg(F.count(F.lit(1)).alias("rows")))
query("segment_profile", "with w as (select avg(c_acctbal) a, stddev_pop(c_acctbal) d from customer) select c_mktsegment, count(*) \"rows\", 'c_acctbal' \"column\", round(avg(c_acctbal), 4) mean, round((avg(c_acctbal) - a) / d, 6) z, case when (avg(c_acctbal) - a) / d >= 0.5 then 'High' when (avg(c_acctbal) - a) / d <= -0.5 then 'Low' else '' end trait from customer, w group by c_mktsegment, a, d", "customer")(lambda d: r("mean")(r("z", n=6)(segments.segment_profile(d, "c_mktsegment", ["c_acctbal"]))))
query("isolation_forest", None, "customer")(lambda d: segments.isolation_forest(d.select("c_custkey", "c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey"], "c_custkey"))

# --- documents ---
WORDS_SQL = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '([\\p{L}\\p{N}]+)', 1), lambda w: w not in (" + ", ".join(f"'{w}'" for w in sorted(documents.STOPWORDS)) + "))"
query("word_counts", f"select doc_id, cast(len({WORDS_SQL}) as int) n from documents", "documents")(lambda d: d.select("doc_id", F.size(documents.words(F.col("text"))).alias("n")))
query("bm25", f"""with d as (select doc_id, {WORDS_SQL} w from documents), t as (select unnest(['ing', 'thon', 'erre']) q), n as (select count(*) n, avg(len(w)) a from d), f as (select q, doc_id, len(list_filter(w, lambda x: x = q)) tf, len(w) l from d, t), k as (select q, count(*) filter (where tf > 0) df from f group by 1)
select doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))), 5) score from f join k using (q), n group by 1 having sum(tf) > 0 order by sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) desc, 1 limit 10""", "documents")(lambda d: r("score", n=5)(documents.bm25(d, "doc_id", "text", "ing thon erre")))
COS = "select vec_id, list_dot_product(cast(embedding as double[]), q) / (sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) * sqrt(list_dot_product(q, q))) score from embeddings, (select cast(embedding as double[]) q from embeddings where vec_id = 0)"
query("cosine_top_k", f"select vec_id, round(score, 6) score from ({COS}) order by score desc, vec_id limit 10", "embeddings")(lambda d: r("score", n=6)(documents.cosine_top(d, "vec_id", "embedding", list(d.where("vec_id = 0").first()["embedding"]))))
query("rank_fusion", "with a as (select c_custkey k, row_number() over (order by c_acctbal desc, c_custkey) r from customer where c_acctbal > 0 qualify r <= 20), b as (select c_custkey k, row_number() over (order by c_custkey desc) r from customer qualify r <= 20) select k c_custkey, round(coalesce(1 / (60 + a.r), 0) + coalesce(1 / (60 + b.r), 0), 8) score from a full join b using (k) order by 2 desc, 1 limit 10", "customer")(
    lambda d: r("score", n=8)(documents.fused(d.where("c_acctbal > 0").select("c_custkey", F.col("c_acctbal").alias("score")).orderBy(F.desc("score"), "c_custkey").limit(20), d.select("c_custkey", F.col("c_custkey").cast("double").alias("score")).orderBy(F.desc("score")).limit(20), "c_custkey")))

# --- models and plans ---
AP_SQL = """with d as (select o_totalprice / 1000000 s, cast(o_orderstatus = 'F' as int) y from orders), g as (select s, count(*) n, sum(y) p, sum((s - y) ** 2) e from d group by 1), c as (select *, sum(n) over (order by s desc) cn, sum(p) over (order by s desc) cp, sum(n) over () t, sum(p) over () q from g)
select cast(max(t) as bigint) "rows", cast(max(q) as bigint) positives, round(sum(p / q * cp / cn), 6) average_precision, round(sum((n - p) * (cp - p / 2)) / (max(q) * (max(t) - max(q))), 6) roc_auc, round(sum(e) / max(t), 6) brier, round(sum(greatest(0, least(n, round(t * 0.2) - (cn - n))) / n * p / q), 6) capture, round(sum(greatest(0, least(n, round(t * 0.2) - (cn - n))) / n * p / q) / 0.2, 6) lift from c"""
query("class_measures", AP_SQL, "orders")(lambda d: r("average_precision", "roc_auc", "brier", "capture", "lift", n=6)(modeling.class_measures(d.select((F.col("o_totalprice") / 1000000).alias("s"), (F.col("o_orderstatus") == "F").cast("int").alias("y")), "s", "y")))
query("number_measures", "select count(*) \"rows\", round(avg(abs(e)), 4) mae, round(sqrt(avg(e * e)), 4) rmse, round(1 - sum(e * e) / (var_pop(l_extendedprice) * count(*)), 6) r2 from (select l_extendedprice, l_quantity * 1400 - l_extendedprice e from lineitem)", "lineitem")(lambda d: r("r2", n=6)(r("mae", "rmse")(modeling.number_measures(d.withColumn("s", F.col("l_quantity") * 1400), "s", "l_extendedprice"))))
query("time_split", "with m as (select distinct o_orderdate d from orders), k as (select d, row_number() over (order by d) i, count(*) over () n from m), c as (select min(d) cut from k where i = ceil(n * 0.8) + 1) select count(*) filter (where o_orderdate < cut) \"before\", count(*) filter (where o_orderdate >= cut) \"after\" from orders, c", "orders")(lambda d: (lambda p: p[0].agg(F.count(F.lit(1)).alias("before")).crossJoin(p[1].agg(F.count(F.lit(1)).alias("after"))))(modeling.time_split(d, "o_orderdate")))


def _model(d: DataFrame) -> DataFrame:
    goal = modeling.ModelGoal("y", "o_orderkey", ["o_totalprice", "age"], ["o_orderpriority"])
    d = d.withColumn("y", (F.col("o_orderstatus") == "F").cast("int")).withColumn("age", F.datediff(F.lit("2002-01-01"), "o_orderdate"))
    model, _ = modeling.build(d, goal, ("logistic",))
    return r("score", n=6)(modeling.scored(model, modeling.prepared(d, goal), goal).select("o_orderkey", "score"))


query("model_scores", None, "orders")(_model)
query("plan_defaults", "select median(n) capacity, (select median(g) from (select date_diff('day', cast(lag(ts) over (partition by user_id order by ts) as date), cast(ts as date)) g from events)) gap from (select event_type, cast(ts as date) d, count(*) n from events group by 1, 2)", "events")(lambda d: recommend.default_settings(d, "event_type", "user_id", "ts"))
query("owner_assignment", None, "events")(lambda d: recommend.assign_owners(d, d, "user_id", "event_type"))
query("daily_plan", None, "events")(lambda d: recommend.daily_plan(recommend.assign_owners(d, d, "user_id", "event_type").join(d.groupBy("user_id").agg(F.avg("value").alias("score"), F.max("ts").alias("last")), "user_id"), "user_id", "owner", recommend.PlanSettings(), "last"))
query("rule_backtest", None, "events")(lambda d: recommend.backtest(d, "user_id", "ts", "event_id", F.col("event_type") == "purchase"))


def _ask(text: str):
    def f(d: DataFrame) -> DataFrame:
        from ravelin.plans.nl import ask

        return ask(d, text)[1]

    return f


query("ask_count", "select count(distinct o_custkey) as \"value\" from orders where o_totalprice > 200000", "orders")(_ask("number of customers with total price above 200,000"))
query("ask_top", "select o_custkey, round(sum(o_totalprice), 2) o_totalprice from orders group by 1 order by sum(o_totalprice) desc, 1 limit 5", "orders")(lambda d: r("o_totalprice", n=2)(_ask("top 5 customers by total price")(d)))
query("ask_grouped", "select o_orderpriority, round(avg(o_totalprice), 4) as \"value\" from orders where year(o_orderdate) = 1996 group by 1", "orders")(lambda d: r("value")(_ask("average total price by order priority in 1996")(d)))
query("ask_trend", "select cast(date_trunc('month', o_orderdate) as timestamp) o_orderdate, round(sum(o_totalprice), 2) as \"value\" from orders where o_orderpriority = '1-URGENT' group by 1", "orders")(lambda d: r("value", n=2)(_ask("monthly total price for urgent orders")(d)))

# --- more of the above ---
query("target_balance", "select count(*) \"rows\", count(y) labelled, cast(sum(y) as bigint) positives, round(sum(y) / count(y), 6) rate, case when least(avg(y), 1 - avg(y)) < 0.02 then 'critical' when least(avg(y), 1 - avg(y)) < 0.1 then 'warning' else '' end severity from (select cast(o_orderstatus = 'F' as int) y from orders)", "orders")(lambda d: r("rate", n=6)(report.balance(d.withColumn("y", (F.col("o_orderstatus") == "F").cast("int")), "y")))
query("target_signals", None, "lineitem")(lambda d: report.signals(_returned(d), "y", ["l_quantity", "l_discount", "l_tax"], ["l_linestatus"]))
query("redundant_ratios", None, "lineitem")(lambda d: relations.ratios(d.withColumn("unit_price", F.col("l_extendedprice") / F.col("l_quantity")), ["unit_price", "l_extendedprice", "l_quantity"]))
query("segment_heatmap", "select o_orderstatus, o_orderpriority, count(*) \"rows\", round(count(*) / sum(count(*)) over (partition by o_orderstatus), 6) \"share\" from orders group by 1, 2", "orders")(lambda d: r("share", n=6)(segments.heatmap(d, "o_orderstatus", "o_orderpriority")))
query("segment_plane", None, "customer")(lambda d: segments.plane(d.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation")), ["c_acctbal", "nation"], "c_custkey"))
query("season_strength", None, "events")(lambda d: forecast.season_strength(forecast.build_series(d, "ts", "D", "count"), "D"))
query("row_reasons", None, "orders")(lambda d: modeling.row_reasons(d.withColumn("y", (F.col("o_orderstatus") == "F").cast("int")), modeling.ModelGoal("y", "o_orderkey", ["o_totalprice"], ["o_orderpriority"])).select("o_orderkey", F.concat_ws("; ", "reasons").alias("reasons")))
query("rollup_revenue", "select o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) revenue from orders group by rollup (o_orderstatus, o_orderpriority)", "orders")(lambda d: d.rollup("o_orderstatus", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue")))
query("except_keys", "select c_custkey from customer except select o_custkey from orders", "customer", "orders")(lambda c, o: c.select("c_custkey").exceptAll(o.select(F.col("o_custkey").alias("c_custkey")).distinct()).distinct())
query("json_property", "select event_type, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) k from events group by 1", "events")(lambda d: d.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k")))
query("conversation_turns", "select role, count(*) turns, count(distinct conv_id) conversations from conversations group by 1", "conversations")(lambda d: d.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("conv_id").alias("conversations")))
