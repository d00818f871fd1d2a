"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity, scalars
from ..operators import contracts, history, kpis, metrics, quality
from ..sources.tables import table
from . import access, gateway, silver
from . import spec as specs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _scopes():
    return F.array(F.lit("ALL"), F.col("o_orderstatus"))


def _active(spark: SparkSession, d: str) -> DataFrame:
    return metrics.active(table(spark, d, "orders"), "o_custkey", "o_orderdate", _scopes())


def _grid(spark: SparkSession, d: str, metric: DataFrame, value: str, kind: str = "long") -> DataFrame:
    orders = table(spark, d, "orders")
    scopes = metrics.scoped(orders, _scopes()).select("scope").distinct()
    return metrics.on_grid(metric, metrics.month_spine(orders, "o_orderdate"), scopes, value, kind)


_SPINE = """months as (select cast(unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), interval 1 month)) as date) as month from orders),
rows_ as (select 'ALL' as scope, o_custkey, cast(o_orderdate as date) as d from orders union all select o_orderstatus, o_custkey, cast(o_orderdate as date) from orders where o_orderstatus is not null),
grid as (select month, scope from months cross join (select distinct scope from rows_)),
sets as (select month, scope, o_custkey, count(*) as n_rows from months join rows_ on last_day(month) - 30 < d and d <= last_day(month) group by all)"""


@query(f"with {_SPINE} select g.month, g.scope, cast(count(s.o_custkey) as bigint) as active from grid g left join sets s on s.month = g.month and s.scope = g.scope group by g.month, g.scope")
def metric_active_entities(spark, d):
    counts = _active(spark, d).groupBy("month", "scope").agg(F.count("o_custkey").alias("active"))
    return _grid(spark, d, counts, "active")


@query(f"with {_SPINE}, gone as (select cast(p.month + interval 1 month as date) as month, p.scope from sets p left join sets c on c.month = p.month + interval 1 month and c.scope = p.scope and c.o_custkey = p.o_custkey where c.o_custkey is null) select g.month, g.scope, cast(count(x.scope) as bigint) as lapsed from grid g left join gone x on x.month = g.month and x.scope = g.scope group by g.month, g.scope")
def metric_lapsed_entities(spark, d):
    return _grid(spark, d, metrics.lapsed(_active(spark, d), "o_custkey"), "lapsed")


@query(f"with {_SPINE}, v as (select month, scope, sum(n_rows) as n_rows, count(*) as active from sets group by month, scope) select g.month, g.scope, cast(coalesce(round(cast(n_rows as double) / active, 6), 0) as decimal(28,6)) as per_active from grid g left join v on v.month = g.month and v.scope = g.scope")
def metric_rows_per_active(spark, d):
    return _grid(spark, d, metrics.rows_per_active(_active(spark, d)), "per_active", "decimal(28,6)")


@query("select cast(date_trunc('month', l_shipdate) as date) as month, cast(sum(case when l_returnflag = 'R' then -1 else 1 end * cast(round(l_extendedprice * 100) as bigint)) as bigint) as net_cents from lineitem group by 1")
def metric_net_amount_by_month(spark, d):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long") * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    return table(spark, d, "lineitem").groupBy(F.to_date(F.trunc("l_shipdate", "MM")).alias("month")).agg(F.sum(cents).alias("net_cents"))


@query("""with c as (select cast(date_trunc('month', o_orderdate) as date) as period_month, o_orderstatus as product, count(distinct o_custkey) as canonical_value from orders group by all),
r as (select cast(date_trunc('month', o_orderdate) as date) as period_month, o_orderstatus as product, 'first_weeks' as reported_as, cast(count(distinct case when day(o_orderdate) <= 28 then o_custkey end) as double) as value from orders group by all
  union all select cast(date_trunc('month', o_orderdate) as date) as period_month, o_orderstatus, 'rows', cast(count(*) as double) from orders group by all),
v as (select * from (values ('F', 'first_weeks', 'lower', 0::double, 8::double, true), ('O', 'rows', 'higher', 1, 4, true), ('P', 'rows', 'any', 0, 0, false), ('F', 'rows', 'lower', 1, 50, true)) t(product, reported_as, expected_direction, tolerance, threshold_pct, comparable)),
j as (select period_month, product, reported_as, value as reported_value, canonical_value, value - canonical_value as diff, (value - canonical_value) * 100.0 / nullif(canonical_value, 0) as diff_pct, expected_direction, tolerance, threshold_pct, comparable from r join v using (product, reported_as) left join (select * from c where day(period_month) = 1 and month(period_month) <> 3) c using (period_month, product))
select period_month, product, reported_as, reported_value, canonical_value, diff, round(diff_pct, 6) as diff_pct, expected_direction, threshold_pct, comparable,
  case when not comparable then null when diff_pct is null then false else abs(diff_pct) <= threshold_pct and case expected_direction when 'higher' then diff_pct >= -tolerance when 'lower' then diff_pct <= tolerance else true end end as explained from j""")
def recon_reported_vs_canonical(spark, d):
    """Months of March have no canonical value, so that a missing percentage is among the rows."""
    orders = table(spark, d, "orders").select(scalars.month_start("o_orderdate").alias("period_month"), F.col("o_orderstatus").alias("product"), "o_custkey", F.dayofmonth("o_orderdate").alias("day"))
    canonical = orders.filter("month(period_month) <> 3").groupBy("period_month", "product").agg(F.countDistinct("o_custkey").alias("value"))
    both = orders.groupBy("period_month", "product").agg(F.countDistinct(F.when(F.col("day") <= 28, F.col("o_custkey"))).cast("double").alias("first_weeks"), F.count("*").cast("double").alias("rows"))
    reported = both.unpivot(["period_month", "product"], ["first_weeks", "rows"], "reported_as", "value")
    variants = [("F", "first_weeks", "lower", 0.0, 8.0, True), ("O", "rows", "higher", 1.0, 4.0, True), ("P", "rows", "any", 0.0, 0.0, False), ("F", "rows", "lower", 1.0, 50.0, True)]
    found = metrics.reconcile(reported, canonical, spark.createDataFrame(variants, specs._VARIANT))
    return found.withColumn("diff_pct", F.round("diff_pct", 6))


@query("with e as (select event_id, ts, user_id, 'a' as file from events union all select event_id, ts + interval 1 hour, user_id, 'b' from events where event_id % 50 = 0 union all select event_id, case when event_id % 3 = 0 then ts end, user_id, '0' from events where event_id % 40 = 0) select event_id, ts, user_id, file from e qualify row_number() over (partition by event_id order by ts nulls last, file nulls last) = 1")
def event_dedup_earliest(spark, d):
    events = table(spark, d, "events").select("event_id", "ts", "user_id")
    again = events.filter("event_id % 50 = 0").withColumn("ts", F.expr("ts + interval 1 hour")).withColumn("file", F.lit("b"))
    tied = events.filter("event_id % 40 = 0").withColumn("ts", F.expr("case when event_id % 3 = 0 then ts end")).withColumn("file", F.lit("0"))
    return history.deduplicated(events.withColumn("file", F.lit("a")).unionByName(again).unionByName(tied), "event_id", "ts", "file")


@query("select o_custkey, o_orderkey, o_orderstatus, o_orderdate from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def cdc_latest_state(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return history.first_per_key(orders, ["o_custkey"], [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc_nulls_last()])


@query("with a as (select *, lag(o_orderstatus || '|' || o_orderpriority) over w as b, row_number() over w as p from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)), v as (select * from a where p = 1 or b is distinct from o_orderstatus || '|' || o_orderpriority) select o_custkey, o_orderstatus, o_orderpriority, o_orderdate as valid_from, lead(o_orderdate) over w as valid_to, lead(o_orderdate) over w is null as is_current from v window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def scd2_history(spark, d):
    return history.scd2(table(spark, d, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"], ["o_orderdate", "o_orderkey"], "o_orderdate")


@query("with m as (select 1 as priority, c_custkey as id, c_nationkey as nation, case when c_custkey % 7 <> 0 then c_acctbal end as balance from customer union all select 2, s_suppkey, s_nationkey, s_acctbal from supplier) select nation, priority, id, balance, cast(count(*) over (partition by nation) as bigint) as n_records, max(case when priority = 2 then 1 else 0 end) over (partition by nation) = 1 as has_supplier, cast(max(case when priority = 1 then 1 else 0 end) over (partition by nation) + max(case when priority = 2 then 1 else 0 end) over (partition by nation) as int) as n_products from m qualify row_number() over (partition by nation order by priority, balance desc nulls last, id) = 1")
def survivorship_merge(spark, d):
    balance = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal"))
    customers = table(spark, d, "customer").select(F.lit(1).alias("priority"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), balance.alias("balance"))
    suppliers = table(spark, d, "supplier").select(F.lit(2).alias("priority"), "s_suppkey", "s_nationkey", "s_acctbal")
    # One pass with partial aggregation; the smallest (priority, no balance, -balance, id) survives.
    best = F.min_by(F.struct("priority", "id", "balance"), F.struct("priority", F.col("balance").isNull(), -F.col("balance"), "id"))
    flags = [F.bool_or(F.col("priority") == k).alias(f"p{k}") for k in (1, 2)]
    found = customers.union(suppliers).groupBy("nation").agg(best.alias("b"), F.count("*").alias("n_records"), *flags)
    return found.select("nation", "b.priority", "b.id", "b.balance", "n_records", F.col("p2").alias("has_supplier"), (F.col("p1").cast("int") + F.col("p2").cast("int")).alias("n_products"))


@query("with s as (select 'C' as kind, c_custkey as id, c_nationkey * 1000 + cast(floor(c_acctbal / 100) as bigint) as link from customer union all select 'S', s_suppkey, s_nationkey * 1000 + cast(floor(s_acctbal / 100) as bigint) from supplier) select link, min(case when kind = 'C' then id end) as canonical, count(distinct case when kind = 'C' then id end) as n_customers, count(distinct case when kind = 'C' then id end) > 1 as ambiguous from s group by link")
def link_map(spark, d):
    def link(n, b):
        return (F.col(n) * 1000 + F.floor(F.col(b) / 100)).cast("long").alias("link")

    rows = table(spark, d, "customer").select(F.lit("C").alias("kind"), F.col("c_custkey").alias("id"), link("c_nationkey", "c_acctbal"))
    rows = rows.union(table(spark, d, "supplier").select(F.lit("S"), "s_suppkey", link("s_nationkey", "s_acctbal")))
    own = F.when(F.col("kind") == "C", F.col("id"))
    return rows.groupBy("link").agg(F.min(own).alias("canonical"), F.countDistinct(own).alias("n_customers"), (F.countDistinct(own) > 1).alias("ambiguous"))


@query("with x as (select cast(ts as date) as day, event_type, count(*) as landed from events group by all), y as (select cast(ts as date) as day, event_type, count(*) as kept from events where value >= 10 and event_type <> 'error' group by all) select coalesce(x.day, y.day) as day, coalesce(x.event_type, y.event_type) as event_type, coalesce(landed, 0) as landed, coalesce(kept, 0) as kept from x full join y on x.day = y.day and x.event_type = y.event_type")
def ingest_quality_full_outer(spark, d):
    events = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    landed = events.groupBy("day", "event_type").agg(F.count("*").alias("landed"))
    kept = events.filter("value >= 10 and event_type <> 'error'").groupBy("day", "event_type").agg(F.count("*").alias("kept"))
    return landed.join(kept, ["day", "event_type"], "full_outer").na.fill(0, ["landed", "kept"])


@query("""with q as (select cast(o_orderdate as date) as d, count(*) as n from orders where o_orderkey % 1000 < 990 and dayofyear(o_orderdate) not in (100, 200, 201) group by 1),
s as (select d, n, avg(n) over w as mean, stddev(n) over w as sd, count(n) over w as seen from q window w as (order by d rows between 27 preceding and current row)),
p as (select d, n, lag(d) over (order by d) as pd, lag(mean) over (order by d) as mean, lag(sd) over (order by d) as sd, lag(seen) over (order by d) as seen from s)
select d as day, n as observed, round(mean, 6) as expected, 'unusual_count' as kind from p where seen >= 28 and sd > 0 and abs(n - mean) / sd > 2
union all select pd + 1, 0, round(mean, 6), 'missing_day' from p where seen >= 28 and sd > 0 and d - pd > 1 and mean / sd > 2""")
def row_count_anomaly(spark, d):
    orders = table(spark, d, "orders").filter("o_orderkey % 1000 < 990 and dayofyear(o_orderdate) not in (100, 200, 201)")
    daily = orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return history.row_count_anomalies(daily, "day", "n", 28, 2.0).withColumn("expected", F.round("expected", 6))


@query("select c_custkey, c_nationkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def anti_join(spark, d):
    held = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_nationkey").join(held, "c_custkey", "left_anti")


@query("select p_partkey, p_brand from part where p_partkey in (select l_partkey from lineitem where l_returnflag = 'R')")
def semi_join(spark, d):
    returned = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey", "p_brand").join(returned, "p_partkey", "left_semi")


@query("select c_nationkey as nation, c_mktsegment as segment from customer where c_acctbal < 0 except select c_nationkey, c_mktsegment from customer where c_acctbal > 9000")
def except_distinct(spark, d):
    own = table(spark, d, "customer")
    rows = own.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    return quality.known_elsewhere_only(rows.filter("c_acctbal < 0"), rows.filter("c_acctbal > 9000"), ["nation", "segment"])


@query("select 'view_or_click' as kind, user_id as entity, cast(ts as date) as day from events where event_type in ('view', 'click') union all select 'order', o_custkey, cast(o_orderdate as date) from orders")
def activity_union(spark, d):
    seen = table(spark, d, "events").filter(F.col("event_type").isin("view", "click")).select(F.lit("view_or_click").alias("kind"), F.col("user_id").alias("entity"), F.to_date("ts").alias("day"))
    return seen.union(table(spark, d, "orders").select(F.lit("order"), "o_custkey", F.to_date("o_orderdate")))


@query("select event_id, ts + interval 9 hour as local_ts, cast(date_trunc('month', ts + interval 9 hour) as date) as local_month from events")
def jst_shift(spark, d):
    local = scalars.tokyo_time("ts")
    return table(spark, d, "events").select("event_id", local.alias("local_ts"), scalars.month_start(local).alias("local_month"))


@query("select c_custkey, sha256('D:' || c_name) as pseudonym, left(c_name, 1) || '***' as masked, c_mktsegment, right(regexp_replace(c_name, '[^0-9]', '', 'g'), 4) as last4, split_part(c_name || '@' || lower(c_mktsegment), '@', 2) as domain from customer where c_mktsegment = 'BUILDING'")
def mask_and_pseudonymise(spark, d):
    own = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").withColumn("mail", F.concat("c_name", F.lit("@"), F.lower("c_mktsegment")))
    return own.select("c_custkey", scalars.pseudonym("c_name", "D").alias("pseudonym"), scalars.initial("c_name").alias("masked"), "c_mktsegment", scalars.phone_last4("c_name").alias("last4"), scalars.email_domain("mail").alias("domain"))


@query("select c_nationkey as household, count(*) as n_members, count(*) > 1 as is_family, count(distinct c_mktsegment) as n_segments, max(case when c_mktsegment = 'BUILDING' then 1 else 0 end) = 1 as has_building, max(case when c_acctbal < -990 then 1 else 0 end) = 1 as has_debt, min(c_custkey) as first_member from customer group by 1")
def household_rollup(spark, d):
    n = F.count("*")
    flags = [F.bool_or(F.col("c_mktsegment") == "BUILDING").alias("has_building"), F.bool_or(F.col("c_acctbal") < -990).alias("has_debt")]
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("household")).agg(n.alias("n_members"), (n > 1).alias("is_family"), F.countDistinct("c_mktsegment").alias("n_segments"), *flags, F.min("c_custkey").alias("first_member"))


@query("with m as (select l_suppkey, cast(date_trunc('month', l_shipdate) as date) as month from lineitem), a as (select l_suppkey, min(month) as first_month, max(month) as last_month from m group by 1) select *, last_month = (select max(month) from m) as is_live from a")
def account_latest_window(spark, d):
    own = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.to_date(F.trunc(F.min("l_shipdate"), "MM")).alias("first_month"), F.to_date(F.trunc(F.max("l_shipdate"), "MM")).alias("last_month"))
    latest = own.agg(F.max("last_month").alias("latest"))
    return own.crossJoin(F.broadcast(latest)).select("l_suppkey", "first_month", "last_month", (F.col("last_month") == F.col("latest")).alias("is_live"))


@query("select event_id, try_cast(regexp_replace(props, '[^0-9]', '', 'g') as bigint) as k, try_cast(case when event_id % 2 = 0 then '—' else cast(event_id as varchar) end as bigint) as seats, try_cast(replace(cast(event_id % 30 as varchar) || '%', '%', '') as double) / 100 as rate from events")
def digits_safe_cast(spark, d):
    digits = F.expr("try_cast(regexp_replace(props, '[^0-9]', '') as bigint)")
    typed = F.when(F.col("event_id") % 2 == 0, "—").otherwise(F.translate(F.col("event_id").cast("string"), "0123456789", "０１２３４５６７８９"))
    rate = F.concat((F.col("event_id") % 30).cast("string"), F.lit("%"))
    return table(spark, d, "events").select("event_id", digits.alias("k"), scalars.whole_number(typed).alias("seats"), scalars.percent(rate).alias("rate"))


@query("""select * from (
  select 'o_orderpriority' as "column", 'str_matches' as "check", count(*) filter (where not regexp_matches(o_orderpriority, '^[1-4]-')) as n_rows from orders
  union all select 'o_orderstatus', 'isin', count(*) filter (where o_orderstatus not in ('F', 'O')) from orders
  union all select 'o_totalprice', 'ge(5000)', count(*) filter (where o_totalprice < 5000) from orders
  union all select 'o_custkey', 'unique', coalesce(sum(n), 0)::bigint from (select count(*) as n from orders group by o_custkey having count(*) > 1)) where n_rows > 0""")
def contract_violations(spark, d):
    orders = table(spark, d, "orders")
    checks = [contracts.matches("o_orderpriority", "^[1-4]-"), contracts.one_of("o_orderstatus", ["F", "O"]), contracts.at_least("o_totalprice", 5000)]
    return contracts.violations(orders, contracts.Contract(orders.columns, nullable=orders.columns, checks=checks, unique=[["o_custkey"]]))


@query("""with files as (select cast(date_trunc('day', ts) as date) as day, count(*) as n_rows, count(*) filter (where event_type = 'error' and value > 400) as bad from events group by 1)
select day, n_rows from files where bad = 0""")
def quarantine_whole_files(spark, d):
    """One file a day: a single bad event quarantines its day."""
    events = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    good = contracts.Check("event_type", "no_large_error", (F.col("event_type") != "error") | F.coalesce(F.col("value") <= 400, F.lit(True)))
    kept, _ = contracts.split_files(events, contracts.Contract(events.columns, nullable=events.columns, checks=[good]), "day")
    return kept.groupBy("day").agg(F.count("*").alias("n_rows"))


@query("select o_custkey, count(*) as n_rows from orders where o_custkey is not null and o_custkey not in (select c_custkey from customer where c_acctbal >= 0) group by o_custkey")
def quality_relationships(spark, d):
    return quality.without_parent(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer").filter("c_acctbal >= 0"), "c_custkey")


@query("select l_orderkey, l_linenumber, count(*) as n_rows from lineitem where l_orderkey is not null and l_linenumber is not null group by all having count(*) > 1")
def quality_not_unique(spark, d):
    return quality.not_unique(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select event_id, ts - interval 9 hour as utc_ts, cast(ts + interval 9 hour as date) as tokyo_day, split_part(event_type, 'i', 2) as part, sha256('E:' || cast(user_id as varchar)) as pseudonym, cast(round(cast(user_id as double) * 1.5) as bigint) as taxed, cast(round(cast(user_id as double) / 1.1) as bigint) as untaxed, year(ts) as year, array_to_string(string_split(event_type, 'i'), ',') as parts from events")
def scalar_functions(spark, d):
    return table(spark, d, "events").select(
        "event_id", scalars.utc_from_tokyo("ts").alias("utc_ts"), scalars.tokyo_date("ts").alias("tokyo_day"), F.split_part("event_type", F.lit("i"), F.lit(2)).alias("part"), scalars.pseudonym("user_id", "E").alias("pseudonym"), scalars.with_tax(F.col("user_id").cast("double"), 0.5).alias("taxed"), scalars.without_tax(F.col("user_id").cast("double"), 0.1).alias("untaxed"), scalars.birth_year("ts").alias("year"), scalars.list_to_text(F.split("event_type", "i")).alias("parts")
    )


@query("select l_partkey, l_orderkey, l_linenumber, l_shipdate, l_quantity from lineitem qualify row_number() over (partition by l_partkey order by l_shipdate desc nulls last, l_linenumber desc, l_orderkey desc, l_quantity desc) = 1")
def snapshot_latest(spark, d):
    own = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    return history.latest_per_key(own, ["l_partkey"], "l_shipdate", "l_linenumber", "l_orderkey")


_LINKED = """s as (select 'C' as source, cast(c_custkey as varchar) as id, case when c_custkey % 11 <> 0 then c_nationkey * 1000 + cast(floor(c_acctbal / 100) as bigint) end as link, c_custkey % 3 = 0 as mailed from customer
  union all select 'S', cast(s_suppkey as varchar), s_nationkey * 1000 + cast(floor(s_acctbal / 100) as bigint), false from supplier),
k as (select source, id, cast(link as varchar) as link, case when mailed then 'email' else 'phone' end as method, sha256(source || id) as key from s),
m as (select link, min(case when method = 'email' then key end) as email_key, count(distinct case when method = 'email' then key end) as n from k where link is not null group by link)"""


def _linked(spark, d):
    def rows(name, source, key, nation, balance, link, mailed):
        value = F.when(link, F.col(nation) * 1000 + F.floor(F.col(balance) / 100).cast("long")).cast("string")
        return table(spark, d, name).select(F.lit(source).alias("source"), F.col(key).cast("string").alias("source_member_id"), value.alias("link_key"), F.when(mailed, "email").otherwise("phone").alias("key_method"))

    both = rows("customer", "C", "c_custkey", "c_nationkey", "c_acctbal", F.col("c_custkey") % 11 != 0, F.col("c_custkey") % 3 == 0).union(rows("supplier", "S", "s_suppkey", "s_nationkey", "s_acctbal", F.lit(True), F.lit(False)))
    return both.withColumn("member_key", F.sha2(F.concat("source", "source_member_id"), 256))


@query(f"with {_LINKED} select k.source, k.id as source_member_id, k.key as source_member_key, coalesce(m.email_key, k.key) as member_key, coalesce(m.n, 0) > 1 as link_ambiguous from k left join m on m.link = k.link")
def xref_canonical(spark, d):
    live = _linked(spark, d)
    return silver.xref_member(live, silver.link_map(live))


@query(f"with {_LINKED} select source, method as category, count(distinct id) as n from k group by all union all select source, 'deleted_in_source', count(distinct id) from k where link is null group by source union all select 'ALL', 'ambiguous_link', count(*) from m where n > 1")
def identity_quality_union(spark, d):
    rows = _linked(spark, d).withColumn("is_deleted", F.col("link_key").isNull())
    return silver.identity_quality(rows, rows, silver.link_map(rows))


@query("with v as (select o_custkey as k, o_orderdate as valid_from, case when o_orderkey % 10 <> 0 then lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) end as valid_to, o_orderkey from orders), w as (select *, lead(valid_from) over (partition by k order by valid_from, valid_to nulls last) as following from v) select k, count(*) filter (where valid_to is distinct from following) as n_gaps, count(*) filter (where valid_to is null) as n_open from w group by k having n_gaps > 0 or n_open <> 1")
def scd2_contiguity(spark, d):
    """A tenth of the versions has lost its end."""
    following = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    versions = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("valid_from"), F.when(F.col("o_orderkey") % 10 != 0, following).alias("valid_to"))
    return quality.history_breaks(versions, ["k"])


@query("""with l as (select o_custkey as k, o_orderstatus as status, o_orderdate as made, o_orderkey as lsn, case when o_orderkey % 9 = 0 then 'D' else 'U' end as op, o_orderpriority as carried from orders),
a as (select *, lag(status) over w as before, lag(op) over w as before_op, row_number() over w as place from l window w as (partition by k order by made, lsn)),
v as (select * from a where place = 1 or before is distinct from status or op = 'D' or before_op = 'D')
select k, status, carried, made as valid_from, lead(made) over w as valid_to, lead(made) over w is null as is_current, op = 'D' as is_deleted from v window w as (partition by k order by made, lsn)""")
def scd2_with_deletes(spark, d):
    op = F.when(F.col("o_orderkey") % 9 == 0, "D").otherwise("U")
    log = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("lsn"), op.alias("op"), F.col("o_orderpriority").alias("carried"))
    return history.scd2(log, ["k"], ["status"], ["at", "lsn"], "at", "op", ["carried"])


@query("with f as (select c_custkey as member_key, c_acctbal > 0 as a, c_mktsegment = 'BUILDING' as b, c_nationkey < 10 as c, c_custkey % 2 = 0 as d from customer) select member_key, 'A' as product from f where a union all select member_key, 'B' from f where b union all select member_key, 'C' from f where c union all select member_key, 'D' from f where d")
def flags_unpivot(spark, d):
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("member_key"), (F.col("c_acctbal") > 0).alias("in_a"), (F.col("c_mktsegment") == "BUILDING").alias("in_b"), (F.col("c_nationkey") < 10).alias("in_c"), (F.col("c_custkey") % 2 == 0).alias("in_d"))
    return silver.dim_member_product(own)


@query("select cast(unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), interval 1 month)) as date) as month from orders")
def month_spine(spark, d):
    return metrics.month_spine(table(spark, d, "orders"), "o_orderdate")


@query("""select 'old' as generation, l_orderkey, l_linenumber, cast(round(l_extendedprice) as bigint) as incl, cast(round(cast(round(l_extendedprice) as bigint) / (1 + 0.1::double)) as bigint) as ex from lineitem where l_linestatus = 'F'
union all select 'new', l_orderkey, l_linenumber, cast(round(cast(round(l_extendedprice) as bigint) * (1 + l_tax)) as bigint), cast(round(l_extendedprice) as bigint) from lineitem where l_linestatus <> 'F'""")
def union_normalised_amounts(spark, d):
    """Two generations of amounts, with and without tax, in one shape."""
    own = table(spark, d, "lineitem").withColumn("amount", F.round("l_extendedprice").cast("long"))
    old = own.filter("l_linestatus = 'F'").select(F.lit("old").alias("generation"), "l_orderkey", "l_linenumber", F.col("amount").alias("incl"), scalars.without_tax("amount", silver.TAX).alias("ex"))
    return old.unionByName(own.filter("l_linestatus <> 'F'").select(F.lit("new").alias("generation"), "l_orderkey", "l_linenumber", scalars.with_tax("amount", F.col("l_tax")).alias("incl"), F.col("amount").alias("ex")))


@query(f"""with {_SPINE.replace("from orders where o_orderstatus is not null", "from orders where o_orderstatus = 'F' union all select 'BUILDING', o_custkey, cast(o_orderdate as date) from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")}
select g.month, g.scope, cast(count(s.o_custkey) as bigint) as active from grid g left join sets s on s.month = g.month and s.scope = g.scope group by g.month, g.scope""")
def metric_population_scope(spark, d):
    """Everyone, one source, and the activity anywhere of one population."""
    kinds = {"ALL": "all", "F": "source", "BUILDING": "population"}
    held = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("product"))
    orders = metrics.with_population(table(spark, d, "orders"), "o_custkey", held, ["BUILDING"])
    counts = metrics.active(orders, "o_custkey", "o_orderdate", metrics.scope_column("o_orderstatus", kinds)).groupBy("month", "scope").agg(F.count("*").alias("active"))
    return metrics.on_grid(counts, metrics.month_spine(orders, "o_orderdate"), spark.createDataFrame([(k,) for k in kinds], "scope string"), "active")


@query(f"with {_SPINE}, held as (select distinct month, scope from sets where not (scope = 'P' and month(month) = 7)) select g.month, g.scope, 'missing' as problem from grid g left join held h on h.month = g.month and h.scope = g.scope where h.month is null")
def metric_grid_gaps(spark, d):
    """A metric that lacks the months of July in one scope."""
    held = _active(spark, d).select("month", "scope").distinct().filter("not (scope = 'P' and month(month) = 7)")
    orders = table(spark, d, "orders")
    return metrics.grid_gaps(held, metrics.month_spine(orders, "o_orderdate"), metrics.scoped(orders, _scopes()).select("scope").distinct())


@query("""with months as (select cast(unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), interval 1 month)) as date) as month from orders),
o as (select o_custkey as k, cast(o_orderdate as date) as d, o_totalprice as price, cast(o_orderdate as date) + cast(o_orderkey % 90 as int) as closed, o_orderkey from orders),
f as (select k, min(d) as d from o group by k),
w as (select month, count(distinct k) as v from months left join o on last_day(month) - 28 < d and d <= last_day(month) group by month),
t as (select month, coalesce(sum(cast(round(price * 100) as bigint)), 0) as v, count(k) as n from months left join o on date_trunc('month', d) = month group by month),
e as (select month, count(k) as v from months left join f on d <= last_day(month) group by month),
r as (select month, count(distinct k) as v from months left join o on last_day(month) - 60 < d and d <= last_day(month) group by month),
a as (select month, count(distinct k) as v, count(o_orderkey) as n from months left join o on d <= last_day(month) and (o_orderkey % 5 = 0 or closed >= last_day(month)) group by month),
x as (select month, count(o_orderkey) as v from months left join o on o_orderkey % 5 <> 0 and date_trunc('month', closed) = month group by month)
select 'A' as product, 'active' as reported_as, month as period_month, cast(v as double) as value, 'in 28 days' as definition from w
union all select 'A', 'revenue', month, cast(v as double), 'cents of the month' from t
union all select 'A', 'per_active', t.month, case when w.v > 0 then t.n / cast(w.v as double) else 0 end, 'rows for each' from t join w on w.month = t.month
union all select 'A', 'lost', e.month, cast(e.v - r.v as double), 'ever, not in 60 days' from e join r on r.month = e.month
union all select 'B', 'alive', month, cast(v as double), 'open on the last day' from a
union all select 'B', 'open_rows', month, cast(n as double), 'open on the last day' from a
union all select 'B', 'closed', month, cast(v as double), 'ends in the month' from x""")
def reported_kpis(spark, d):
    """Measures as products define them themselves; an order is open for up to 89 days, and every fifth never closes."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.lit(1).alias("one"))
    orders = orders.withColumn("closed", F.when(F.col("o_orderkey") % 5 != 0, F.date_add("day", (F.col("o_orderkey") % 90).cast("int"))))
    spine = metrics.month_spine(orders, "day")
    active = kpis.windowed_distinct(orders, "o_custkey", "day", spine, 28)
    return kpis.reported(
        {
            ("A", "active", "in 28 days"): active,
            ("A", "revenue", "cents of the month"): kpis.month_total(orders, "cents", "day", spine),
            ("A", "per_active", "rows for each"): kpis.ratio(kpis.month_rows(orders, "day", spine), active),
            ("A", "lost", "ever, not in 60 days"): kpis.ever_less_recent(orders, "o_custkey", "day", spine, 60),
            ("B", "alive", "open on the last day"): kpis.alive_distinct(orders, "o_custkey", "day", "closed", spine),
            ("B", "open_rows", "open on the last day"): kpis.alive_total(orders, "one", "day", "closed", spine),
            ("B", "closed", "ends in the month"): kpis.month_rows(orders.filter("closed is not null"), "closed", spine),
        }
    )


@query("""select cast(event_id as varchar) as event_id, ts as occurred_at, 'executed' as outcome, cast(user_id as varchar) as principal, 'analyst' as role, sha256(event_type) as sql_hash, event_type as sql_normalized, event_type || ',x' as referenced_tables, '' as referenced_columns, cast(null as varchar) as sensitive_columns, event_id % 2 = 0 as touched_sensitive, user_id as row_count, cast(null as varchar) as deny_reason from events where event_type = 'purchase'
union all select cast(event_id as varchar), ts, 'denied', cast(user_id as varchar), 'analyst', sha256(event_type), event_type, event_type || ',x', '', null, event_id % 2 = 0, null, 'no table' from events where event_type = 'error'""")
def audit_log_union(spark, d):
    lists = [F.array("event_type", F.lit("x")).alias("referenced_tables"), F.array().cast("array<string>").alias("referenced_columns"), F.lit(None).cast("array<string>").alias("sensitive_columns")]
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("ts").alias("occurred_at"), F.col("user_id").cast("string").alias("principal"), F.lit("analyst").alias("role"), F.sha2("event_type", 256).alias("sql_hash"), F.col("event_type").alias("sql_normalized"), *lists, (F.col("event_id") % 2 == 0).alias("touched_sensitive"), F.col("user_id").alias("row_count"), F.lit("no table").alias("deny_reason"))
    return silver.audit_access_log(rows.filter("sql_normalized = 'purchase'"), rows.filter("sql_normalized = 'error'"))


_CUSTOMER = [access.Described("c_custkey", key=True), access.Described("c_name", "direct", "initial"), access.Described("c_nationkey", "quasi", omit_for=("AUTOMOBILE",)), access.Described("c_acctbal", "sensitive"), access.Described("c_mktsegment")]


@query("select sha256('BUILDING:' || cast(c_custkey as varchar)) as c_custkey, left(c_name, 1) || '***' as c_name_initial, c_nationkey, c_mktsegment from customer where c_mktsegment = 'BUILDING'")
def role_scoped_copy(spark, d):
    role = access.Role("product", ("BUILDING",), "exclude", "mask", "pseudonym")
    return access.copy(table(spark, d, "customer"), role, access.RowScope("column", column="c_mktsegment"), _CUSTOMER)


@query("select key, 'canonical' as problem from (select distinct cast(c_custkey as varchar) as key from customer where c_custkey % 50 = 0) union all select key, 'in two roles' from (select sha256('A:' || cast(c_custkey as varchar)) as key from customer where c_custkey % 70 = 0)")
def linkable_keys(spark, d):
    """Two roles with pseudonyms, one of which got some canonical keys and some of the other's."""
    own = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("k"), "c_custkey")
    a = own.select(scalars.pseudonym("k", "A").alias("k"))
    b = own.select(F.when(F.col("c_custkey") % 50 == 0, F.col("k")).otherwise(scalars.pseudonym("k", "B")).alias("k")).union(own.filter("c_custkey % 70 = 0").select(scalars.pseudonym("k", "A")))
    return quality.linkable_keys({"a": a, "b": b}, "k", own.select("k"))


@query("select c_mktsegment, cast(count(*) as bigint) as n, max(c_nationkey) as top from customer where c_nationkey between 3 and 20 group by c_mktsegment order by n desc, c_mktsegment limit 3")
def gateway_select(spark, d):
    """A statement of a role: checked, resolved in a session of its own, and capped."""
    sql = "select c_mktsegment, count(*) as n, max(c_nationkey) as top from customer where c_nationkey between 3 and 20 group by c_mktsegment order by n desc, c_mktsegment limit 3"
    own = spark.newSession()
    role = access.Role("analyst", None, "exclude", "mask")
    access.copy(table(own, d, "customer"), role, access.RowScope("none"), _CUSTOMER).createOrReplaceTempView("customer")
    gateway.check(own, sql, {"customer": own.table("customer").columns})
    return own.sql(sql).limit(gateway.MOST_ROWS)


@query()
def hmac_member_key(spark, d):
    """Keys of customers from made contact data; HMAC has no SQL, so tests hold single keys against Python's."""
    own = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit("@Example.com"))).alias("mail"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("+81 90 "), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))).alias("phone"), F.lit("やまだ").alias("kana"))
    return identity.with_keys(own, "salt", "A", "c_custkey", "mail", "phone", "kana")


@query()
def nfkc_normalise(spark, d):
    """Normal forms of names in full width; NFKC has no SQL."""
    wide = F.concat(F.lit("株式会社　"), F.translate("c_name", "0123456789", "０１２３４５６７８９"))
    return table(spark, d, "customer").select("c_custkey", identity.normal_company(wide).alias("company"), identity.normal_phone(wide).alias("phone"), scalars.account_key(wide).alias("account_key"))


@query()
def pii_columns(spark, d):
    """What names and values of the columns of three tables look like; NFKC has no SQL."""
    found = None
    for name in ("customer", "documents", "conversations"):
        own = quality.personal_columns(table(spark, d, name)).select(F.lit(name).alias("table"), "column", "level", F.array_join("reasons", ", ").alias("reasons"))
        found = own if found is None else found.unionByName(own)
    return found


@query("select o_orderkey, o_totalprice from orders where not (o_totalprice > 5000 and o_orderstatus <> 'P')")
def quality_not_true(spark, d):
    return quality.not_true(table(spark, d, "orders"), "o_totalprice > 5000 and o_orderstatus <> 'P'").select("o_orderkey", "o_totalprice")


@query("select o_orderpriority, count(*) as n_rows from orders where o_orderpriority not in ('1-URGENT', '2-HIGH') group by 1")
def quality_accepted_values(spark, d):
    return quality.not_accepted(table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


_XREF = """x as (select 'A' as source, cast(s_suppkey as varchar) as id, 'S' || s_suppkey as member_key from supplier where s_suppkey % 2 = 0
  union all select 'C', cast(c_custkey as varchar), 'C' || c_custkey from customer where c_custkey % 5 <> 0
  union all select 'B', 'T' || c_nationkey || '/' || c_custkey, 'C' || c_custkey from customer where c_custkey % 3 <> 0
  union all select 'D', cast(c_custkey as varchar), 'C' || c_custkey from customer where c_custkey % 3 <> 0)"""


def _xref(spark, d):
    """Live members of four sources: half of the suppliers and most customers."""
    customers, suppliers = table(spark, d, "customer"), table(spark, d, "supplier")
    key, person = F.col("c_custkey").cast("string"), F.concat(F.lit("C"), "c_custkey")
    own = suppliers.filter("s_suppkey % 2 = 0").select(F.lit("A").alias("source"), F.col("s_suppkey").cast("string").alias("source_member_id"), F.concat(F.lit("S"), "s_suppkey").alias("member_key"))
    own = own.union(customers.filter("c_custkey % 5 <> 0").select(F.lit("C"), key, person))
    own = own.union(customers.filter("c_custkey % 3 <> 0").select(F.lit("B"), F.concat(F.lit("T"), "c_nationkey", F.lit("/"), "c_custkey"), person))
    return own.union(customers.filter("c_custkey % 3 <> 0").select(F.lit("D"), key, person))


def _cents(c):
    return F.round(c).cast("long")


@query(f"""with {_XREF},
p as (select 'P' || l_orderkey || '-' || l_linenumber as id, cast(l_suppkey as varchar) as m, l_shipdate as at, cast(round(l_extendedprice) as bigint) as incl, l_tax as rate from lineitem where l_returnflag = 'N'),
i as (select cast(o_orderkey as varchar) as no, cast(o_custkey as varchar) as m, o_orderdate as day, o_orderstatus as plan, cast(round(o_totalprice) as bigint) as ex, 0.1::double as rate from orders),
r as (select 'R' || l_orderkey || '-' || l_linenumber as id, cast(l_orderkey + 3 as varchar) as no, l_shipdate as day, cast(round(l_extendedprice) as bigint) as ex from lineitem where l_returnflag = 'R')
select p.id as payment_id, 'A' as source, 'charge' as payment_type, x.member_key, null as plan_ref, p.at as occurred_at, cast(round(incl / (1 + rate)) as bigint) as amount_ex_tax, incl as amount_tax_incl, incl as amount_original, 'tax_incl' as amount_original_basis, rate as tax_rate from p join x on x.source = 'A' and x.id = p.m
union all select i.no, 'D', 'charge', x.member_key, 'D:' || plan, cast(cast(day as date) as timestamp) - interval 9 hour, ex, cast(round(ex * (1 + rate)) as bigint), ex, 'ex_tax', rate from i join x on x.source = 'D' and x.id = i.m
union all select r.id, 'D', 'refund', x.member_key, 'D:' || plan, cast(cast(r.day as date) as timestamp) - interval 9 hour, -r.ex, -cast(round(r.ex * (1 + rate)) as bigint), -r.ex, 'ex_tax', rate from r left join i on i.no = r.no join x on x.source = 'D' and x.id = i.m""")
def payments_union(spark, d):
    """Charges and refunds with and without tax; refunds without an invoice and what deleted members left are dropped."""
    lines = table(spark, d, "lineitem").withColumn("no", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    bought = lines.filter("l_returnflag = 'N'").select(F.concat(F.lit("P"), "no").alias("event_id"), F.col("l_suppkey").cast("string").alias("member_id"), F.col("l_shipdate").cast("timestamp").alias("occurred_at"), _cents("l_extendedprice").alias("amount_tax_incl"), F.col("l_tax").alias("tax_rate"))
    invoices = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("invoice_no"), F.col("o_custkey").cast("string").alias("member_key"), F.to_date("o_orderdate").alias("invoice_date"), F.col("o_orderstatus").alias("plan_code"), _cents("o_totalprice").alias("amount_ex_tax"), F.lit(0.1).alias("tax_rate"))
    refunds = lines.filter("l_returnflag = 'R'").select(F.concat(F.lit("R"), "no").alias("refund_no"), (F.col("l_orderkey") + 3).cast("string").alias("invoice_no"), F.to_date("l_shipdate").alias("refund_date"), _cents("l_extendedprice").alias("refund_amount_ex_tax"))
    return silver.fct_payment(bought, invoices, refunds, _xref(spark, d))


@query(f"""with {_XREF},
w as (select 'E' || event_id as session_id, 'A' as source, 'workout' as session_type, x.member_key, ts as started_at, cast(value as bigint) as duration_min, null as facility_id from events join x on x.source = 'A' and x.id = cast(user_id as varchar) where event_type = 'click'),
v as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders),
s as (select * from w union all select 'C-' || o_custkey, 'C', 'visit', x.member_key, o_orderdate, null, o_orderpriority from v join x on x.source = 'C' and x.id = cast(o_custkey as varchar) where n = 1 and o_orderstatus <> 'P'),
b as (select *, row_number() over (partition by c_nationkey, l_orderkey order by l_shipdate desc nulls last, l_linenumber desc) as n from (select *, row_number() over (partition by l_orderkey, l_shipdate order by l_linenumber desc, l_quantity desc, l_partkey desc) as u from lineitem) l join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey where u = 1),
k as (select 'T' || c_nationkey || '/' || l_orderkey as booking_id, x.member_key, l_shipdate - interval 9 hour as held from b join x on x.source = 'B' and x.id = 'T' || c_nationkey || '/' || c_custkey where n = 1 and l_linestatus = 'F' and l_returnflag <> 'R')
select session_id as activity_id, member_key, started_at as occurred_at, cast(started_at + interval 9 hour as date) as activity_date_jst, session_type as activity_type, source from s
union all select booking_id, member_key, held, cast(held + interval 9 hour as date), 'booking_attended', 'B' from k""")
def activity_facts(spark, d):
    """Sessions of two sources and the attended bookings of the latest snapshot, all of live members."""
    events = table(spark, d, "events").filter("event_type = 'click'")
    workouts = events.select(F.concat(F.lit("E"), "event_id").alias("event_id"), F.col("user_id").cast("string").alias("member_id"), F.col("ts").cast("timestamp").alias("occurred_at"), F.col("value").cast("long").alias("duration_min"))
    orders = table(spark, d, "orders")
    visits = orders.select(F.when(F.col("o_orderstatus") == "P", "D").otherwise("I").alias("op"), F.col("o_orderdate").alias("changed_at"), F.col("o_orderkey").alias("lsn"), F.col("o_custkey").alias("visit_id"), F.col("o_custkey").alias("member_id"), F.col("o_orderdate").cast("timestamp").alias("checked_in_at"), F.col("o_orderpriority").alias("facility_id"))
    lines = history.latest_per_key(table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_quantity", "l_partkey", "l_linestatus", "l_returnflag"), ["l_orderkey", "l_shipdate"], "l_linenumber", "l_quantity", "l_partkey")
    held = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    bookings = held.select(F.concat(F.lit("T"), "c_nationkey").alias("tenant_id"), F.col("l_orderkey").alias("booking_no"), F.col("c_custkey").alias("member_no"), scalars.utc_from_tokyo("l_shipdate").alias("class_start_at"), scalars.utc_from_tokyo("l_shipdate").alias("created_at"), F.when(F.col("l_linestatus") == "F", "attended").otherwise("booked").alias("status"), _cents("l_quantity").alias("price_ex_tax"), F.lit(0.1).alias("tax_rate"), (F.col("l_returnflag") == "R").alias("is_deleted"), F.col("l_shipdate").alias("snapshot_date"))
    xref = _xref(spark, d)
    return silver.fct_activity(silver.fct_session(workouts, visits, xref), silver.fct_booking(bookings, xref))


@query(f"""with {_XREF},
l as (select o_custkey as contract_id, o_custkey as member_id, o_orderstatus as plan, o_orderdate as made, o_orderkey as lsn, case when o_orderkey % 11 = 0 then 'D' else 'U' end as op, o_orderkey % 2 as g, cast(round(o_totalprice) as bigint) as fee from orders),
n as (select *, case g when 0 then 'FY2025' else 'FY2026' end as generation, case g when 0 then 'C25:' else 'C26:' end || plan as plan_ref, case g when 0 then fee else cast(round(fee * (1 + 0.08::double)) as bigint) end as incl, case g when 0 then cast(round(fee / (1 + 0.1::double)) as bigint) else fee end as ex from l),
c as (select *, lag(struct_pack(a := member_id, b := plan_ref, c := incl, d := ex)) over w as before, lag(op) over w as before_op, row_number() over w as place from n window w as (partition by contract_id order by made, lsn)),
v as (select *, lead(made) over (partition by contract_id order by made, lsn) as valid_to from c where place = 1 or before is distinct from struct_pack(a := member_id, b := plan_ref, c := incl, d := ex) or op = 'D' or before_op = 'D')
select contract_id, generation, member_id, x.member_key, plan_ref, case when plan_ref = 'C25:F' then 'first' end as plan_key, incl as monthly_fee_tax_incl, ex as monthly_fee_ex_tax, status, made as valid_from, valid_to, valid_to is null as is_current, op = 'D' as is_deleted
from (select *, 'live' as status from v) v join x on x.source = 'C' and x.id = cast(member_id as varchar)""")
def contract_versions(spark, d):
    """Two generations of a contract log in one shape, and the versions of live members' contracts."""
    orders = table(spark, d, "orders")
    fee = _cents("o_totalprice")
    common = [F.when(F.col("o_orderkey") % 11 == 0, "D").otherwise("U").alias("op"), F.col("o_orderdate").alias("changed_at"), F.col("o_orderkey").alias("lsn"), F.col("o_custkey").alias("contract_id"), F.col("o_custkey").alias("member_id"), F.lit("live").alias("status")]
    none = F.lit(None).cast("date")
    old = orders.filter("o_orderkey % 2 = 0").select(*common, F.col("o_orderstatus").alias("plan_cd"), fee.alias("monthly_fee"), none.alias("start_dt"), none.alias("end_dt"), F.lit(None).cast("long").alias("family_group_id"))
    new = orders.filter("o_orderkey % 2 = 1").select(*common, F.col("o_orderstatus").alias("plan_id"), fee.alias("price_ex_tax"), F.lit(0.08).alias("tax_rate"), none.alias("effective_from"), none.alias("effective_to"), F.lit(None).cast("long").alias("payer_member_id"))
    plans = spark.createDataFrame([("C25:F", "first"), ("C25:X", "none")], "plan_ref string, plan_key string")
    return silver.scd_contract(silver.c_contract_log(old, new), plans, _xref(spark, d)).drop("start_date", "end_date", "payer_member_id")


@query("""with m as (select cast(l_suppkey as varchar) as account_key, cast(date_trunc('month', l_shipdate) as date) as report_month, max(l_quantity)::bigint as seats, cast(null as bigint) as monthly_fee_yen, max(l_returnflag) as flag from lineitem group by all),
r as (select *, min(report_month) over (partition by account_key) as first_month, max(report_month) over (partition by account_key) as last_month, max(report_month) over () as newest, row_number() over (partition by account_key order by report_month desc) as n from m)
select account_key, 'S' || account_key as company_name, seats, monthly_fee_yen, first_month, last_month, case flag when 'N' then 'active' when 'R' then 'cancelled' else 'unknown' end as status, last_month = newest and flag <> 'R' as is_active from r where n = 1""")
def account_status(spark, d):
    """The last month of each account, its status and whether it is active."""
    months = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("account_key"), scalars.month_start("l_shipdate").alias("report_month")).agg(F.max("l_quantity").cast("long").alias("seats"), F.max("l_returnflag").alias("flag"))
    status = F.when(F.col("flag") == "N", "契約中").when(F.col("flag") == "R", "解約").otherwise("?")
    rows = months.select("account_key", F.concat(F.lit("S"), "account_key").alias("company_name"), F.lit("x").alias("contact_name"), F.lit("y").alias("sales_owner"), "seats", F.lit(None).cast("long").alias("monthly_fee_yen"), status.alias("contract_status"), "report_month")
    return silver.dim_account(rows).drop("contact_name", "sales_owner")


@query(f"""with {_XREF},
live as (select 'C' as source, cast(c_custkey as varchar) as id, c_name as name, c_mktsegment as phone, c_acctbal as joined, 2 as priority, c_nationkey as house from customer
  union all select 'D', cast(c_custkey as varchar), 'D' || c_name, null, -c_acctbal, 4, c_nationkey from customer union all select 'A', cast(s_suppkey as varchar), s_name, null, s_acctbal, 1, s_nationkey from supplier),
k as (select x.member_key, live.* from live join x on x.source = live.source and x.id = live.id)
select member_key, name, phone, house as household_key, max(priority = 1) over p as in_a, max(priority = 2) over p as in_c, max(priority = 4) over p as in_d, min(joined) over p as first_seen_at, cast(count(distinct source) over p as int) as n_products
from k window p as (partition by member_key) qualify row_number() over (partition by member_key order by priority, joined, id) = 1""")
def people_merged(spark, d):
    """One row a person: attributes of the first source that knows them, flags of all."""
    customers, suppliers = table(spark, d, "customer"), table(spark, d, "supplier")

    def rows(df, source, priority, key, name, phone, joined, house):
        null = F.lit(None).cast("string")
        return df.select(F.lit(source).alias("source"), F.col(key).cast("string").alias("source_member_id"), null.alias("member_key"), F.col(house).alias("household_key"), null.alias("key_method"), name.alias("name"), null.alias("name_kana"), null.alias("email"), phone.alias("phone"), null.alias("birth_date"), null.alias("health_notes"), null.alias("medical_conditions"), joined.alias("joined_at"), F.lit(priority).alias("source_priority"))

    none = F.lit(None).cast("string")
    live = rows(customers, "C", 2, "c_custkey", F.col("c_name"), F.col("c_mktsegment"), F.col("c_acctbal"), "c_nationkey")
    live = live.union(rows(customers, "D", 4, "c_custkey", F.concat(F.lit("D"), "c_name"), none, -F.col("c_acctbal"), "c_nationkey")).union(rows(suppliers, "A", 1, "s_suppkey", F.col("s_name"), none, F.col("s_acctbal"), "s_nationkey"))
    return silver.dim_member(live, _xref(spark, d)).select("member_key", "name", "phone", "household_key", "in_a", "in_c", "in_d", "first_seen_at", "n_products")


@query("select distinct event_type as product, cast(user_id % 5 as varchar) as reported_as from events except select * from (values ('view', '0'), ('view', '1'), ('click', '4'), ('none', '9')) v(product, reported_as)")
def unknown_reported(spark, d):
    """Reported figures that no variant of a metric names."""
    seen = table(spark, d, "events").select(F.col("event_type").alias("product"), (F.col("user_id") % 5).cast("string").alias("reported_as"))
    own = tuple(specs.Variant(p, r, "") for p, r in (("view", "0"), ("view", "1"), ("click", "4"), ("none", "9")))
    return specs.unknown_reported(specs.Spec((specs.Metric("m", "sum_by_month", {}, known_variants=own),)), seen)


@query("select c_custkey as member_key, 'left' as problem from customer where c_custkey % 10 = 0 and exists (select 1 from orders where o_custkey = c_custkey) union all select c_custkey, 'no source' from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus <> 'P')")
def deleted_and_sourceless(spark, d):
    """People that were deleted and left rows, and people without a live row."""
    people, orders = table(spark, d, "customer").select(F.col("c_custkey").alias("member_key")), table(spark, d, "orders").select(F.col("o_custkey").alias("member_key"), "o_orderstatus")
    left = quality.left_by_deleted(people, orders.filter("member_key % 10 = 0"), ["member_key"])
    return left.withColumn("problem", F.lit("left")).union(quality.without_live_source(people, orders.filter("o_orderstatus <> 'P'")).withColumn("problem", F.lit("no source")))


@query("select max(ts) as latest, round((epoch(timestamp '2024-02-01 12:00:00') - floor(epoch(max(ts)))) / 3600.0, 6) as age_hours, case when (epoch(timestamp '2024-02-01 12:00:00') - epoch(max(ts))) / 3600.0 <= 24 then 'pass' when (epoch(timestamp '2024-02-01 12:00:00') - epoch(max(ts))) / 3600.0 <= 72 then 'warn' else 'error' end as state from events")
def source_freshness(spark, d):
    now = datetime.datetime(2024, 2, 1, 12, tzinfo=datetime.UTC)
    return quality.freshness(table(spark, d, "events"), "ts", now).withColumn("age_hours", F.round("age_hours", 6))


@query("""with r as (select cast(date_trunc('month', l_shipdate) as date) as month, l_returnflag as flag, cast(round(l_extendedprice * 100) as bigint) * case when l_returnflag = 'R' then -1 else 1 end as cents from lineitem)
select month, 'ALL' as scope, cast(sum(cents) as bigint) as total from r group by month union all select month, flag, cast(sum(cents) as bigint) from r where flag in ('A', 'R') group by all""")
def net_amount_by_scope(spark, d):
    """Sums of amounts by month, over all rows and for two of the sources."""
    lines = table(spark, d, "lineitem").withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("long") * F.when(F.col("l_returnflag") == "R", -1).otherwise(1))
    return metrics.sum_by_month(lines, "cents", scalars.month_start("l_shipdate"), metrics.scope_column("l_returnflag", {"ALL": "all", "A": "source", "R": "source"}))


@query("""with g as (select event_type as source, cast(cast(ts as date) as varchar) as day, count(*) as n, cast(sum(user_id) as bigint) as r from events where value >= 10 and event_type <> 'error' group by all),
b as (select event_type as source, cast(cast(ts as date) as varchar) as day, count(*) as n, cast(sum(event_id % 4) as bigint) as v from events where value < 10 or event_type = 'error' group by all)
select coalesce(g.source, b.source) as source, 'events' as dataset, coalesce(g.day, b.day) as partition_date, coalesce(g.n, 0) as files_landed, coalesce(g.r, 0) as rows_landed, coalesce(b.n, 0) as files_quarantined, coalesce(b.v, 0) as violations from g full join b on g.source = b.source and g.day = b.day""")
def deliveries_daily(spark, d):
    """What each delivery brought and what was quarantined of it; an event stands for a file."""
    files = table(spark, d, "events").select(F.col("event_type").alias("source"), F.lit("events").alias("dataset"), F.to_date("ts").cast("string").alias("partition_date"), F.lit(1).alias("files_landed"), F.col("user_id").alias("rows_landed"), (F.col("event_id") % 4).alias("n_violations"), "value")
    return silver.ingest_quality_daily(files.filter("value >= 10 and source <> 'error'"), files.filter("value < 10 or source = 'error'"))


_SEGMENTS = {"a": "BUILDING", "b": "AUTOMOBILE", "c": "MACHINERY", "d": "FURNITURE"}


@query(f"""select c_nationkey as household_key, count(*) as n_members, count(*) > 1 as is_family, {', '.join(f"bool_or(c_mktsegment = '{s}') as in_{p}" for p, s in _SEGMENTS.items())}, min(c_acctbal) as first_seen_at from customer group by 1""")
def households(spark, d):
    """Households of customers, and the products that any member has."""
    flags = [(F.col("c_mktsegment") == s).alias(f"in_{p}") for p, s in _SEGMENTS.items()]
    return silver.dim_household(table(spark, d, "customer").select(F.col("c_nationkey").alias("household_key"), F.col("c_acctbal").alias("first_seen_at"), *flags))


@query("""select o_orderstatus as product, c_nationkey as household_key, count(distinct c_custkey) as n_members, count(distinct c_custkey) > 1 as is_family, min(o_orderdate) as first_seen_at from orders join customer on c_custkey = o_custkey group by 1, 2""")
def households_by_product(spark, d):
    own = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return silver.dim_household_by_product(own.select(F.col("o_orderstatus").alias("product"), F.col("c_nationkey").alias("household_key"), F.col("c_custkey").alias("member_key"), F.col("o_orderdate").alias("joined_at")))


@query(f"""with {_XREF} select 'C' as product, x.member_key, cast(c_custkey as varchar) as source_member_id, c_nationkey as household_key, c_name as name, c_acctbal as joined_at from customer join x on x.source = 'C' and x.id = cast(c_custkey as varchar)
union all select 'A', x.member_key, cast(s_suppkey as varchar), s_nationkey, s_name, s_acctbal from supplier join x on x.source = 'A' and x.id = cast(s_suppkey as varchar)""")
def members_by_product(spark, d):
    """What each product itself knows of its live members, under their one key."""

    def rows(name, source, key, house, label, joined):
        none = [F.lit(None).cast("string").alias(c) for c in ("member_key", "key_method", "name_kana", "email", "phone", "birth_date", "health_notes", "medical_conditions")]
        return table(spark, d, name).select(F.lit(source).alias("source"), F.col(key).cast("string").alias("source_member_id"), F.col(house).alias("household_key"), F.col(label).alias("name"), F.col(joined).alias("joined_at"), *none)

    live = rows("customer", "C", "c_custkey", "c_nationkey", "c_name", "c_acctbal").union(rows("supplier", "A", "s_suppkey", "s_nationkey", "s_name", "s_acctbal"))
    return silver.dim_member_by_product(live, _xref(spark, d)).select("product", "member_key", "source_member_id", "household_key", "name", "joined_at")


@query(f"select * exclude (valid_to, is_current, is_deleted) from ({SQL['contract_versions']}) where is_current and not is_deleted")
def contracts_current(spark, d):
    """The version of each live contract that holds now."""
    return silver.c_contract_current(contract_versions(spark, d))


@query("""with t as (select l_orderkey, l_linenumber, strftime(l_shipdate, '%Y/%m/') || lpad(cast(day(l_shipdate) + l_linenumber % 3 as varchar), 2, '0') as slashes, strftime(l_shipdate, '%Y-%m-%dT08:30:00') || case l_linenumber % 3 when 0 then '+09:00' when 1 then 'Z' else ' o''clock' end as iso from lineitem)
select l_orderkey, l_linenumber, cast(try_strptime(slashes, '%Y/%m/%d') as date) as day, case when l_linenumber % 3 = 0 then strptime(iso[1:19], '%Y-%m-%dT%H:%M:%S') - interval 9 hour when l_linenumber % 3 = 1 then strptime(iso[1:19], '%Y-%m-%dT%H:%M:%S') end as at from t""")
def typed_dates(spark, d):
    """Texts as days and instants; those that name none are null, such as the 31st of a short month."""
    lines = table(spark, d, "lineitem")
    odd = F.col("l_linenumber") % 3
    slashes = F.concat(F.date_format("l_shipdate", "yyyy/MM/"), F.lpad((F.dayofmonth("l_shipdate") + odd).cast("string"), 2, "0"))
    iso = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T08:30:00"), F.when(odd == 0, "+09:00").when(odd == 1, "Z").otherwise(" o'clock"))
    return lines.select("l_orderkey", "l_linenumber", scalars.date_from_slashes(slashes).alias("day"), scalars.instant(iso).alias("at"))


@query("""select c_custkey, sha256('{"c0":"' || c_name || '"' || case when c_mktsegment <> 'BUILDING' then ',"c1":"' || c_mktsegment || '"' else '' end || ',"c2":"' || c_nationkey || '"}') as hash from customer""")
def row_hashes(spark, d):
    """Hashes that tell rows apart, nulls from empty texts included."""
    return table(spark, d, "customer").withColumn("segment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))).select("c_custkey", scalars.row_hash("c_name", "segment", "c_nationkey").alias("hash"))


_SETS = "select c_nationkey as nation, c_mktsegment as segment from customer where c_acctbal > 0 intersect select c_nationkey, c_mktsegment from customer where c_acctbal < 0 union select s_nationkey, 'SUPPLIER' from supplier except select n_nationkey, 'SUPPLIER' from nation where n_regionkey = 1"


@query(_SETS)
def governed_set_operations(spark, d):
    """Set operations of a role's statement, read through the data layer of the gateway."""
    return gateway.DataLayer(spark, {t: f"{d}/{t}.parquet" for t in ("customer", "supplier", "nation")}).read(_SETS)


def _measure(product: str, name: str, definition: str, value: str) -> str:
    return f"select '{product}' as product, '{name}' as reported_as, month as period_month, cast(v as double) as value, '{definition}' as definition from ({value})"


def _in_window(rows: str, who: str, day: str, days: int) -> str:
    return f"select month, count(distinct {who}) as v from months left join {rows} on {day} > last_day(month) - {days} and {day} <= last_day(month) group by month"


def _in_month(rows: str, value: str, day: str) -> str:
    return f"select month, coalesce({value}, 0) as v from months left join {rows} on date_trunc('month', {day}) = month group by month"


def _alive(value: str) -> str:
    return f"select month, coalesce({value}, 0) as v from months left join c on starts <= last_day(month) and (ends is null or ends >= last_day(month)) group by month"


def _each(over: str, under: str) -> str:
    return f"select o.month, case when u.v > 0 then cast(o.v as double) / u.v else 0 end as v from ({over}) o join ({under}) u on u.month = o.month"


def _less(left: str, right: str) -> str:
    return f"select l.month, l.v - r.v as v from ({left}) l join ({right}) r on r.month = l.month"


def _lost(rows: str, who: str, day: str) -> str:
    ever = f"select month, count(f) as v from months left join (select {who}, min({day}) as f from {rows} group by 1) on f <= last_day(month) group by month"
    return _less(ever, _in_window(rows, who, day, 60))


_OPENERS, _BOOKED, _MEMBERS = _in_window("o", "who", "day", 28), _in_window("b", "who", "made", 28), _alive("count(distinct who)")
_MEASURES = [
    ("A", "active_users", "opened the app in 30 days, UTC", _in_window("o", "who", "day", 30)),
    ("A", "iap_revenue", "purchases with tax, UTC month", _in_month("p", "sum(amount)", "day")),
    ("A", "workouts_per_user", "workouts in the month for each opener in 28 days", _each(_in_month("w", "count(who)", "day"), _OPENERS)),
    ("B", "active_customers", "made a booking in 28 days", _BOOKED),
    ("B", "booking_revenue", "price without tax of classes in the month, not cancelled", _in_month("(from b where not cancelled)", "sum(amount)", "held")),
    ("B", "bookings_per_customer", "bookings made for each active customer", _each(_in_month("b", "count(who)", "made"), _BOOKED)),
    ("B", "lost_customers", "customers without a booking in 60 days", _lost("b", "who", "made")),
    ("C", "active_members", "a contract alive on the last day", _MEMBERS),
    ("C", "monthly_revenue", "fees with tax of the contracts alive on the last day", _alive("sum(amount)")),
    ("C", "churned_members", "contracts that end in the month", _in_month("c", "count(ends)", "ends")),
    ("C", "avg_visits_per_member", "visits in the month for each active member", _each(_in_month("t", "count(who)", "day"), _MEMBERS)),
    ("D", "billed_customers", "invoiced in the month", _in_month("i", "count(distinct who)", "day")),
    ("D", "net_sales", "invoices less refunds, without tax", _less(_in_month("i", "sum(amount)", "day"), _in_month("r", "sum(amount)", "day"))),
    ("D", "cancelled_customers", "invoiced once, not in 60 days", _lost("i", "who", "day")),
    ("E", "seats_under_contract", "seats of accounts under contract", _in_month("e", "sum(coalesce(seats, 0))", "day")),
    ("E", "mrr", "fees of accounts under contract", _in_month("e", "sum(coalesce(fee, 0))", "day")),
]


@query(f"""with months as (select cast(unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), interval 1 month)) as date) as month from orders
  union select cast(unnest(generate_series(date_trunc('month', min(ts)), date_trunc('month', max(ts)), interval 1 month)) as date) from events),
o as (select user_id as who, cast(ts as date) as day from events where event_type = 'view'), w as (select user_id as who, cast(ts as date) as day from events where event_type = 'click'),
p as (select cast(round(value) as bigint) as amount, cast(ts as date) as day from events where event_type = 'purchase'),
b as (select o_custkey as who, cast(o_orderdate + interval 9 hour as date) as made, cast(o_orderdate + interval 10 day + interval 9 hour as date) as held, o_orderstatus = 'F' as cancelled, cast(round(o_totalprice) as bigint) as amount from orders),
c as (select o_custkey as who, cast(o_orderdate as date) as starts, case when o_orderkey % 5 <> 0 then cast(o_orderdate as date) + cast(o_orderkey % 90 as int) end as ends, cast(round(o_totalprice) as bigint) as amount from orders where o_orderkey % 7 <> 0),
t as (select l_suppkey as who, cast(l_shipdate + interval 9 hour as date) as day from lineitem), i as (select o_custkey as who, cast(o_orderdate as date) as day, cast(round(o_totalprice) as bigint) as amount from orders),
r as (select cast(l_shipdate as date) as day, cast(round(l_extendedprice) as bigint) as amount from lineitem where l_returnflag = 'R'),
e as (select l_suppkey, cast(date_trunc('month', l_shipdate) as date) as day, case when max(l_quantity) > 10 then cast(max(l_quantity) as bigint) end as seats, cast(sum(cast(round(l_extendedprice) as bigint)) as bigint) as fee from lineitem group by 1, 2 having max(l_returnflag) <> 'R')
{' union all '.join(_measure(*m) for m in _MEASURES)}""")
def products_own_measures(spark, d):
    """The sixteen measures as the five products count them, from events, orders and lines that stand for their sources."""
    events, orders, lines = (table(spark, d, n) for n in ("events", "orders", "lineitem"))
    seen = events.select(F.col("user_id").alias("member_id"), F.col("ts").alias("occurred_at"), _cents("value").alias("amount_tax_incl"), "event_type")
    price, day = _cents("o_totalprice"), F.to_date("o_orderdate")
    booked = [F.lit("T").alias("tenant_id"), F.col("o_custkey").alias("member_no"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.expr("interval 10 days")).alias("class_start_at"), F.when(F.col("o_orderstatus") == "F", "cancelled").otherwise("attended").alias("status"), price.alias("price_ex_tax")]
    ends = F.when(F.col("o_orderkey") % 5 != 0, F.date_add(day, (F.col("o_orderkey") % 90).cast("int")))
    accounts = lines.groupBy("l_suppkey", scalars.month_start("l_shipdate").alias("report_month")).agg(F.max("l_quantity").alias("most"), F.sum(_cents("l_extendedprice")).alias("monthly_fee_yen"), F.max("l_returnflag").alias("flag"))
    sources = {
        "a_app_opened": seen.filter("event_type = 'view'"),
        "a_workout_completed": seen.filter("event_type = 'click'"),
        "a_purchase_made": seen.filter("event_type = 'purchase'"),
        "st_bookings": orders.select(*booked),
        "st_contract_log": orders.select(F.when(F.col("o_orderkey") % 7 == 0, "D").otherwise("U").alias("op"), F.col("o_orderdate").alias("changed_at"), F.col("o_orderkey").alias("lsn"), F.col("o_orderkey").alias("contract_id"), F.col("o_custkey").alias("member_id"), price.alias("monthly_fee_tax_incl"), day.alias("start_date"), ends.alias("end_date")),
        "st_visits": lines.select(F.col("l_suppkey").alias("member_id"), F.col("l_shipdate").alias("checked_in_at")),
        "d_invoices": orders.select(F.col("o_custkey").alias("member_key"), day.alias("invoice_date"), price.alias("amount_ex_tax")),
        "d_refunds": lines.filter("l_returnflag = 'R'").select(F.to_date("l_shipdate").alias("refund_date"), _cents("l_extendedprice").alias("refund_amount_ex_tax")),
        "e_accounts": accounts.select("report_month", F.when(F.col("most") > 10, F.col("most").cast("long")).alias("seats"), "monthly_fee_yen", F.when(F.col("flag") == "R", "解約").otherwise("契約中").alias("contract_status")),
    }
    spine = metrics.month_spine(orders, "o_orderdate").union(metrics.month_spine(events, "ts")).distinct()
    return silver.reported(sources, spine)
