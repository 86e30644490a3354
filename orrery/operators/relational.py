"""Relational coverage over the star schema: joins of every kind, grouping sets, windows, set operations, nested types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.tables import table


def q_pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(disc), 2).alias("sum_disc"),
        F.round(F.sum(disc * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"),
    )


def q_join_kinds(spark, d):
    """Inner, left and full outer joins of customers and their large orders, counted by kind of match."""
    c, o = table(spark, d, "customer").select("c_custkey", "c_mktsegment"), table(spark, d, "orders").where("o_totalprice > 200000").select("o_orderkey", "o_custkey")
    on = c.c_custkey == o.o_custkey
    kinds = [("inner", c.join(o, on)), ("left", c.join(o, on, "left")), ("full", c.join(o, on, "full"))]
    out = None
    for name, df in kinds:
        x = df.agg(F.count("*").alias("n"), F.count("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders")).select(F.lit(name).alias("kind"), "n", "customers", "orders")
        out = x if out is None else out.union(x)
    return out


def q_star_join(spark, d):
    """Revenue by region and year through five joins; Catalyst broadcasts the small dimensions."""
    li, o, c, n, r = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", F.year("o_orderdate").alias("year")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("c_custkey").alias("customers"))


def q_semi_join(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority like '1%'")
    c = table(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def q_anti_join(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def q_range_join_bins(spark, d):
    """Parts joined to price bands by range; the band table is small and of fixed size."""
    bands = spark.createDataFrame([(k, 900.0 + 200 * k, 900.0 + 200 * (k + 1)) for k in range(7)], "band int, lo double, hi double")
    p = table(spark, d, "part")
    return p.join(F.broadcast(bands), (F.col("p_retailprice") >= F.col("lo")) & (F.col("p_retailprice") < F.col("hi"))).groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("p_size"), 6).alias("size"))


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before each row's ``at``, by key: one union, one window, no join blow-up."""
    both = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_side": F.lit(1)}).unionByName(right.select(*by, at, F.col(value).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"last_{value}", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side")


def q_asof_event(spark, d):
    """Each purchase with the value of the user's last click."""
    e = table(spark, d, "events")
    x = asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'").select("user_id", "ts", "value"), ["user_id"], "ts", "value")
    return x.select("event_id", F.round("last_value", 4).alias("click_value"))


def q_interval_join(spark, d):
    """Errors with the events of the same user in the ten minutes before: an equi-join on user and ten-minute slot, both slots probed."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    slot = F.expr("s div 600")
    err = e.where("event_type = 'error'").select(F.col("event_id").alias("err"), "user_id", F.col("s").alias("at"), slot.alias("slot")).withColumn("slot", F.explode(F.array("slot", F.col("slot") - 1)))
    other = e.where("event_type <> 'error'").select("user_id", "s", slot.alias("slot"))
    j = err.join(other, ["user_id", "slot"]).where("s <= at and s > at - 600")
    return j.groupBy("err").agg(F.count("*").alias("before"))


def q_cube_sales(spark, d):
    o = table(spark, d, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().cast("int").alias("gid")).select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n", "total", "gid")


def q_grouping_sets(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", F.year("o_orderdate").alias("y"), "o_totalprice")
    return o.groupingSets([["o_orderstatus"], ["y"], []], "o_orderstatus", "y").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean")).select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("y", F.lit(0)).alias("y"), "n", "mean")


def q_rollup_region(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance")).select(F.coalesce("r_name", F.lit("*")).alias("region"), F.coalesce("n_name", F.lit("*")).alias("nation"), "n", "balance")


def q_ranks(spark, d):
    """row_number, rank, dense_rank, ntile, percent_rank of orders by price in their customer's list."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    v = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(v).alias("rk"), F.dense_rank().over(v).alias("dr"), F.ntile(4).over(w).alias("nt"), F.round(F.percent_rank().over(v), 6).alias("pr"))


def q_lead_lag(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("change"), F.coalesce(F.lead("event_type").over(w), F.lit("end")).alias("next"), F.first("event_type").over(w).alias("first"))


def q_rolling_7d_range(spark, d):
    """Sum of a user's values in the seven days up to each event: a range frame on microseconds."""
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-7 * 86_400 * 1_000_000, 0)
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("event_id", F.round(F.sum("value").over(w), 4).alias("sum_7d"), F.count("*").over(w).alias("n_7d"))


def q_union_intersect_except(spark, d):
    s, c = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k"))
    parts = {"union": s.union(c).distinct(), "union_all": s.unionAll(c), "intersect": s.intersect(c), "except": c.subtract(s)}
    out = None
    for name, df in parts.items():
        x = df.agg(F.count("*").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("s")).select(F.lit(name).alias("op"), "n", "s")
        out = x if out is None else out.union(x)
    return out


def q_topk_customers(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return o.orderBy(F.desc("spent"), "o_custkey").limit(20)


def q_topk_per_group(spark, d):
    """Three dearest parts of each brand; the rank filter is pushed below the shuffle."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").select("p_brand", "p_partkey", F.row_number().over(w).alias("rank")).where("rank <= 3")


def q_array_map_json(spark, d):
    """Arrays, maps and JSON built from a customer's orders and read again."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"), F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col("o_orderkey").cast("string"), "o_orderstatus")))).alias("status"))
    return o.select(
        "o_custkey", F.size("keys").alias("n"), F.element_at("keys", -1).alias("last"), F.aggregate("keys", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
        F.size(F.filter("keys", lambda x: x % 2 == 0)).alias("even"), F.size(F.map_filter("status", lambda k, v: v == "O")).alias("open"),
        F.get_json_object(F.to_json(F.struct(F.col("keys").alias("k"))), "$.k[0]").cast("long").alias("first"),
    )


def q_date_parts(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.min(F.dayofweek("o_orderdate")).alias("dow"), F.max(F.dayofyear("o_orderdate")).alias("doy"), F.round(F.avg(F.datediff(F.lit("1999-01-01").cast("date"), F.col("o_orderdate").cast("date"))), 4).alias("age"))


def q_scalar_subquery(spark, d):
    """Orders above the average of their priority."""
    o = table(spark, d, "orders")
    m = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"))
    return o.join(m, "o_orderpriority").where("o_totalprice > m").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def q_unpivot(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_tax"), 4).alias("tax"), F.round(F.sum("l_discount"), 4).alias("discount"))
    return li.unpivot(["l_returnflag"], ["quantity", "tax", "discount"], "measure", "amount")


def q_skewed_join(spark, d):
    """A join on a skewed key, salted: the small side is copied to each salt, the large side dealt over them."""
    salts = 8
    e = table(spark, d, "events").select("event_type", "event_id", "value").withColumn("salt", F.pmod(F.xxhash64("event_id"), F.lit(salts)))
    w = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("m")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return e.join(w, ["event_type", "salt"]).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.abs(F.col("value") - F.col("m"))), 4).alias("deviation"))


QUERIES = {
    "pricing_summary": q_pricing_summary, "join_inner_left_full": q_join_kinds, "star_join_revenue": q_star_join, "semi_join": q_semi_join, "anti_join": q_anti_join, "range_join_bins": q_range_join_bins,
    "asof_event": q_asof_event, "interval_join": q_interval_join, "cube_sales": q_cube_sales, "grouping_sets": q_grouping_sets, "rollup_region": q_rollup_region, "rank_dense_ntile": q_ranks,
    "lead_lag": q_lead_lag, "rolling_7d_range": q_rolling_7d_range, "union_intersect_except": q_union_intersect_except, "topk_customers": q_topk_customers, "topk_per_group": q_topk_per_group,
    "array_map_json_funcs": q_array_map_json, "date_parts": q_date_parts, "above_average": q_scalar_subquery, "unpivot_measures": q_unpivot, "skewed_join_salted": q_skewed_join,
}
_SET = "select '{n}' as op, count(*) as n, coalesce(sum(k), 0)::bigint as s from ({q})"
_S, _C = "select s_nationkey as k from supplier", "select c_nationkey as k from customer where c_acctbal < 0"
ORACLE_SQL = {
    "pricing_summary": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge, round(avg(l_quantity), 6) as avg_qty, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all",
    "join_inner_left_full": "with o as (select * from orders where o_totalprice > 200000) " + " union all ".join(f"select '{k}' as kind, count(*) as n, count(c_custkey) as customers, count(o_orderkey) as orders from customer {k} join o on c_custkey = o_custkey" for k in ("inner", "left", "full")),
    "star_join_revenue": "select r_name, year(o_orderdate)::int as year, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(distinct c_custkey) as customers from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2",
    "semi_join": "select c_mktsegment, count(*) as n, round(sum(c_acctbal), 2) as balance from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority like '1%') group by 1",
    "anti_join": "select c_mktsegment, count(*) as n from customer where not exists (select 1 from orders where o_custkey = c_custkey) group by 1",
    "range_join_bins": "select band::int as band, count(*) as n, round(avg(p_size), 6) as size from part join (select unnest(range(7)) as band) on p_retailprice >= 900 + 200 * band and p_retailprice < 900 + 200 * (band + 1) group by 1",
    "asof_event": "select p.event_id, round(c.value, 4) as click_value from (select * from events where event_type = 'purchase') p left join lateral (select value from events c where c.event_type = 'click' and c.user_id = p.user_id and c.ts <= p.ts order by c.ts desc limit 1) c on true",
    "interval_join": "select e.event_id as err, count(*) as before from events e join events o on o.user_id = e.user_id and o.event_type <> 'error' and floor(epoch(o.ts)) <= floor(epoch(e.ts)) and floor(epoch(o.ts)) > floor(epoch(e.ts)) - 600 where e.event_type = 'error' group by 1",
    "cube_sales": "select coalesce(o_orderstatus, '*') as status, coalesce(o_orderpriority, '*') as priority, count(*) as n, round(sum(o_totalprice), 2) as total, (2 * grouping(o_orderstatus) + grouping(o_orderpriority))::int as gid from orders group by cube (o_orderstatus, o_orderpriority)",
    "grouping_sets": "select coalesce(o_orderstatus, '*') as status, coalesce(year(o_orderdate), 0)::int as y, count(*) as n, round(avg(o_totalprice), 4) as mean from orders group by grouping sets ((o_orderstatus), (year(o_orderdate)), ())",
    "rollup_region": "select coalesce(r_name, '*') as region, coalesce(n_name, '*') as nation, count(*) as n, round(sum(s_acctbal), 2) as balance from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)",
    "rank_dense_ntile": "select o_orderkey, row_number() over w as rn, rank() over v as rk, dense_rank() over v as dr, ntile(4) over w as nt, round(percent_rank() over v, 6) as pr from orders window w as (partition by o_custkey order by o_totalprice desc, o_orderkey), v as (partition by o_custkey order by o_orderpriority)",
    "lead_lag": "select event_id, round(value - lag(value) over w, 6) as change, coalesce(lead(event_type) over w, 'end') as next, first_value(event_type) over w as first from events window w as (partition by user_id order by ts, event_id)",
    "rolling_7d_range": "select event_id, round(sum(value) over w, 4) as sum_7d, count(*) over w as n_7d from events window w as (partition by user_id order by epoch_us(ts) range between 604800000000 preceding and current row)",
    "union_intersect_except": " union all ".join((_SET.format(n="union", q=f"{_S} union {_C}"), _SET.format(n="union_all", q=f"{_S} union all {_C}"), _SET.format(n="intersect", q=f"{_S} intersect {_C}"), _SET.format(n="except", q=f"{_C} except {_S}"))),
    "topk_customers": "select o_custkey, round(sum(o_totalprice), 2) as spent from orders group by 1 order by 2 desc, 1 limit 20",
    "topk_per_group": "select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey)::int as rank from part qualify rank <= 3",
    "array_map_json_funcs": "select o_custkey, count(*)::int as n, max(o_orderkey) as last, sum(o_orderkey)::bigint as total, (count(*) filter (o_orderkey % 2 = 0))::int as even, (count(*) filter (o_orderstatus = 'O'))::int as open, min(o_orderkey) as first from orders group by 1",
    "date_parts": "select strftime(o_orderdate, '%Y-%m') as month, count(*) as n, min(dayofweek(o_orderdate) + 1)::int as dow, max(dayofyear(o_orderdate))::int as doy, round(avg(date_diff('day', o_orderdate::date, date '1999-01-01')), 4) as age from orders group by 1",
    "above_average": "select o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders o where o_totalprice > (select avg(o_totalprice) from orders i where i.o_orderpriority = o.o_orderpriority) group by 1",
    "unpivot_measures": "unpivot (select l_returnflag, round(sum(l_quantity), 2) as quantity, round(sum(l_tax), 4) as tax, round(sum(l_discount), 4) as discount from lineitem group by 1) on quantity, tax, discount into name measure value amount",
    "skewed_join_salted": "with m as (select event_type, avg(value) as m from events group by 1) select event_type, count(*) as n, round(sum(abs(value - m)), 4) as deviation from events join m using (event_type) group by 1",
}
