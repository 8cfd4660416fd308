"""Registered queries: each applies operators to the shared tables; with SQL for the same rows.

The tables stand in for domain data: events are readings, lineitem a sparse operator (order = observation,
part modulo 90 = cell, quantity = value), orders monthly fluxes, customers sweep results.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, timeutil
from .operators import aggregate, covariance, inversion, joins, levels, mobile, qa, report, results, solvers, spatial, windows
from .plans import forward
from .plans import observations as plan
from .plans.concentrations import load_concentrations
from .plans.config import InversionConfig, config_id
from .plans.inversion import enough
from .scratch import written
from .sources import registry, writers
from .streaming import hourly

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

OBS = """obs as (select event_id, ts as "Time_UTC", event_type as site, 'inst_' || (user_id % 4) as instrument, value as "CH4",
  event_id % 4 - 1 as "QAQC_Flag", case when event_id % 10 = 0 then -9 else -10 end as "ID_CH4", event_type = 'view' as is_mobile,
  40.45 + (user_id % 48) * 0.01::double as latitude, -112.2 + (user_id % 45) * 0.01::double as longitude,
  4.0 + user_id % 3 as height from events)"""
VALID = """valid as (select *, case when "ID_CH4" = -10 and "QAQC_Flag" in (-140, -64, 0, 1, 2) and "CH4" between 1.7 and 300
  then "CH4" end as v from obs)"""
COO = """coo as (select l_orderkey as obs, l_partkey % 90 as cell, sum(l_quantity) as v from lineitem group by 1, 2)"""
POINTS = [(-112.2 + 0.45 * (k % 5) / 5 + 0.013, 40.45 + 0.48 * (k // 5) / 4 + 0.017) for k in range(20)]
POINTS = [(round(x, 6), round(y, 6)) for x, y in POINTS]
EXPECTED = {"inst_0": 3.0, "inst_1": 4.0, "inst_2": 5.0, "inst_3": 6.0}
EVENTS = [("2024-01-05 06:00:00", "2024-01-07 18:00:00"), ("2024-01-15 00:00:00", "2024-01-15 23:59:59")]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.observations(read(spark, sf_dir, "events"))


def r6(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)


def coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as obs", "l_partkey % 90 as cell", "l_quantity as value")
    return rows.groupBy("obs", "cell").agg(F.sum("value").alias("value"))


# --- observations --------------------------------------------------------------------------------


@query(f"""with {OBS} select site, date_trunc('hour', "Time_UTC")::timestamp as hour, round(avg("CH4"), 6) as ch4, count(*) as n,
  string_agg(distinct instrument, ' ' order by instrument) as instrument from obs group by 1, 2""")
def hourly_obs(spark, sf_dir):
    """Flagship: hourly means by site with the instruments that took part."""
    rows = obs(spark, sf_dir).withColumn("hour", timeutil.floor_period(F.col("Time_UTC"), "1h"))
    return rows.dropna(subset=["site", "hour"]).groupBy("site", "hour").agg(
        F.round(F.avg("CH4"), 6).alias("ch4"), F.count("*").alias("n"), aggregate.joined_names("instrument").alias("instrument")
    )


@query(f"with {OBS}, {VALID} select event_id, site, v as ch4 from valid")
def qa_normalize(spark, sf_dir):
    rows = obs(spark, sf_dir)
    return rows.select("event_id", "site", qa.normalize_pollutant(rows, "CH4").alias("ch4"))


@query(f"with {OBS}, {VALID} select event_id, v as ch4 from valid where v is not null")
def drop_all_null(spark, sf_dir):
    return qa.with_valid(obs(spark, sf_dir), ["CH4"]).select("event_id", F.col("CH4").alias("ch4"))


@query(f"""with {OBS} select event_id, "Time_UTC" - interval 7 hour as time_mst from obs
  where hour("Time_UTC" - interval 7 hour) in (12, 13, 14, 15, 16)""")
def mst_hours(spark, sf_dir):
    rows = qa.local_hours(qa.with_local_time(obs(spark, sf_dir)), list(InversionConfig().subset_hours))
    return rows.select("event_id", F.col("Time_MST").alias("time_mst"))


@query("""select event_id, value from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-12'""")
def half_open_trim(spark, sf_dir):
    return qa.trim(read(spark, sf_dir, "events"), "2024-01-05", "2024-01-12", "ts").select("event_id", "value")


@query("""select event_id, value from events where ts between timestamp '2024-01-05' and timestamp '2024-01-12'""")
def inclusive_slice(spark, sf_dir):
    return qa.time_slice(read(spark, sf_dir, "events"), "2024-01-05", "2024-01-12", "ts").select("event_id", "value")


@query(f"""with {OBS}, g as (select *, date_trunc('hour', "Time_UTC") as hour from obs),
  m as (select instrument as i, case instrument when 'inst_0' then 3.0 when 'inst_1' then 4.0 when 'inst_2' then 5.0 else 6.0 end as e
    from (select distinct instrument from obs)),
  k as (select site, hour, count(*) / arg_min(e, struct_pack(t := "Time_UTC", i := instrument)) as share from g join m on m.i = g.instrument group by 1, 2)
  select g.site, g.hour::timestamp as hour, round(avg("CH4"), 6) as ch4, count(*) as n from g join k using (site, hour)
  where share >= 0.75 group by 1, 2""")
def completeness_gate(spark, sf_dir):
    rows = obs(spark, sf_dir).withColumn("hour", timeutil.floor_period(F.col("Time_UTC"), "1h"))
    kept = aggregate.complete_groups(rows, ["site", "hour"], "1h", 0.75, EXPECTED)
    return kept.groupBy("site", "hour").agg(F.round(F.avg("CH4"), 6).alias("ch4"), F.count("*").alias("n"))


@query("""select user_id, count(*) as n, round(avg(value), 6) as v from events group by 1 having count(*) >= 60""")
def min_count_gate(spark, sf_dir):
    rows = qa.min_count(read(spark, sf_dir, "events"), ["user_id"], 60)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("v"))


@query(f"""with {OBS}, h as (select site, date_trunc('day', "Time_UTC") as d, date_trunc('hour', "Time_UTC") as h, stddev_samp("CH4") as sd from obs group by 1, 2, 3),
  dd as (select site, d, avg(sd) as sd from h group by 1, 2),
  q as (select site, quantile_cont(sd, 0.9) as lim from dd group by 1),
  bad as (select dd.site, dd.d from dd join q on dd.site = q.site and dd.sd > q.lim)
  select event_id, site from obs o where not exists (select 1 from bad b where b.site = o.site and b.d = date_trunc('day', o."Time_UTC"))""")
def spike_days(spark, sf_dir):
    return qa.drop_spike_days(obs(spark, sf_dir), 0.9).select("event_id", "site")


@query(f"""with {OBS} select site, height, round(round_even(latitude / 0.02, 0) * 0.02, 6) as latitude,
  round(round_even(longitude / 0.02, 0) * 0.02, 6) as longitude, date_trunc('day', "Time_UTC")::timestamp as day, round(avg("CH4"), 6) as ch4
  from obs where is_mobile group by site, height, round_even(latitude / 0.02, 0), round_even(longitude / 0.02, 0), 5 having count(*) >= 2""")
def grid_snap(spark, sf_dir):
    out = aggregate.aggregate_obs(obs(spark, sf_dir).where("is_mobile"), freq="1D", mobile_grid_res=0.02, mobile_min_count=2, place=[])
    out = out.where("is_mobile")
    return out.select("site", "height", r6("latitude"), r6("longitude"), F.col("Time_UTC").alias("day"), r6("CH4", "ch4"))


_POINTS_SQL = ", ".join(f"({k}, {x}::double, {y}::double)" for k, (x, y) in enumerate(POINTS))


@query(f"""with {OBS}, p(i, x, y) as (values {_POINTS_SQL}) select event_id,
  arg_min(i, struct_pack(d := (x - longitude) * (x - longitude) + (y - latitude) * (y - latitude), i := i)) as point
  from obs, p group by event_id""")
def nearest_point(spark, sf_dir):
    return joins.nearest_point(obs(spark, sf_dir), POINTS).select("event_id", "point")


@query(f"""with {OBS}, g as (select site, date_trunc('hour', "Time_UTC")::timestamp as t, latitude, longitude, height, avg("CH4") as v
    from obs where not is_mobile group by all)
  select site, t as obs_time, count(*) as n, round(avg(v), 6) as ch4 from g group by 1, 2""")
def aggregate_stationary(spark, sf_dir):
    out = aggregate.aggregate_obs(obs(spark, sf_dir).where("not is_mobile"), freq="h").where("not is_mobile")
    return out.groupBy("site", F.col("Time_UTC").alias("obs_time")).agg(F.count("*").alias("n"), F.round(F.avg("CH4"), 6).alias("ch4"))


@query(f"""with {OBS} select site, round(median("CH4"), 6) as ch4, string_agg(distinct instrument, ' ' order by instrument) as instrument from obs group by 1""")
def aggregate_by_median(spark, sf_dir):
    rows = obs(spark, sf_dir).select("site", "CH4", "instrument")
    return aggregate.aggregate_obs(rows, by="site", func="median").select("site", r6("CH4", "ch4"), "instrument")


_EXCLUDE_SQL = " and ".join(f"not ts between timestamp '{a}' and timestamp '{b}'" for a, b in EVENTS)


@query(f"select event_id, event_type from events where {_EXCLUDE_SQL}")
def event_exclusion(spark, sf_dir):
    return joins.exclude_events(read(spark, sf_dir, "events"), EVENTS, "ts").select("event_id", "event_type")


@query(f"""with {OBS} select event_id, strftime("Time_UTC", '%Y%m%d%H%M') as minute, case when is_mobile then printf('%.2f', longitude) || '_' || printf('%.2f', latitude) || '_' || height::int else site end as obs_location from obs""")
def sim_id(spark, sf_dir):
    """Location keys, and the first part of the receptors' simulation ids."""
    rows = obs(spark, sf_dir)
    place = qa.obs_location()
    ids = writers.receptors(rows.withColumn("site", F.col("event_id").cast("string"))).select(F.col("site").cast("long").alias("event_id"), F.split("sim_id", "_")[0].alias("minute"))
    two = lambda k: F.format_string("%.2f", F.split("p", "_")[k].cast("double"))
    named = rows.withColumn("p", place).select(
        "event_id", F.when(F.col("is_mobile"), F.concat_ws("_", two(0), two(1), F.split("p", "_")[2])).otherwise(F.col("p")).alias("obs_location")
    )
    return named.join(ids, "event_id")


@query(f"""with {OBS} select event_id, strftime("Time_UTC", '%Y%m%d%H%M') || '_' || longitude || '_' || latitude || '_' || height as sim_id from obs""")
def receptor_ids(spark, sf_dir):
    """Whole simulation ids: minute, longitude, latitude, height."""
    rows = obs(spark, sf_dir).withColumn("site", F.col("event_id").cast("string"))
    return writers.receptors(rows).select(F.col("site").cast("long").alias("event_id"), "sim_id")


@query("""select event_id, event_type, json_extract_string(props, '$.k')::double as k, user_id::double as user from events""")
def text_to_numbers(spark, sf_dir):
    """Text columns become numbers where all their values are."""
    text = read(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"), F.col("user_id").cast("string").alias("user"))
    return qa.to_numbers(text, ["event_type", "k", "user"])


@query(f"with {OBS} select event_id from obs where longitude between -112.1 and -111.9 and latitude between 40.5 and 40.7")
def readings_in_box(spark, sf_dir):
    return qa.in_box(obs(spark, sf_dir), -112.1, 40.5, -111.9, 40.7).select("event_id")


@query(f"""with {OBS} select site, round(latitude, 5) as lati, round(longitude, 5) as long, height as zagl, "Time_UTC" as time from obs""")
def receptors(spark, sf_dir):
    rows = writers.receptors(obs(spark, sf_dir))
    return rows.select("site", F.round("lati", 5).alias("lati"), F.round("long", 5).alias("long"), "zagl", "time")


@query(f"""with {OBS} select event_id, site, case when month("Time_UTC") in (12, 1, 2) then 'DJF' when month("Time_UTC") in (3, 4, 5) then 'MAM'
  when month("Time_UTC") in (6, 7, 8) then 'JJA' else 'SON' end as season from obs""")
def season_of(spark, sf_dir):
    return obs(spark, sf_dir).select("event_id", "site", timeutil.season(F.col("Time_UTC")).alias("season"))


@query("""select event_id, json_extract_string(props, '$.k') as k from events""")
def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""select sha256(o_orderpriority || '|' || o_orderstatus)[1:12] as hash, count(*) as n from orders group by 1""")
def config_hash(spark, sf_dir):
    key = writers.row_hash(["o_orderpriority", "o_orderstatus"], 12)
    return read(spark, sf_dir, "orders").groupBy(key.alias("hash")).agg(F.count("*").alias("n"))


@query("""select event_id as id, value as v, null::varchar as status from events union all
  select o_orderkey, o_totalprice, o_orderstatus from orders""")
def union_missing_cols(spark, sf_dir):
    a = read(spark, sf_dir, "events").selectExpr("event_id as id", "value as v")
    b = read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_totalprice as v", "o_orderstatus as status")
    return a.unionByName(b, allowMissingColumns=True)


@query("""select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_extendedprice > (select quantile_cont(l_extendedprice, 0.01) from lineitem)
  and l_extendedprice < (select quantile_cont(l_extendedprice, 0.99) from lineitem)""")
def altitude_trim(spark, sf_dir):
    return qa.outliers_trimmed(read(spark, sf_dir, "lineitem"), "l_extendedprice").select("l_orderkey", "l_linenumber", "l_extendedprice")


# --- joins over time -------------------------------------------------------------------------------


def _one_a_time(spark, sf_dir, kind: str) -> DataFrame:
    """Readings of one kind, one for each user and time."""
    rows = read(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return rows.groupBy("user_id", "ts").agg(F.max("value").alias("value"))


_KINDS = """a as (select user_id, ts, max(value) as value from events where event_type = 'click' group by 1, 2),
  b as (select user_id, ts, max(value) as value from events where event_type = 'view' group by 1, 2)"""


@query(f"""with {_KINDS} select a.user_id, a.ts, a.value as gas, b.value as met from a asof left join b on a.user_id = b.user_id and a.ts >= b.ts""")
def asof_merge(spark, sf_dir):
    left = _one_a_time(spark, sf_dir, "click").withColumnRenamed("value", "gas")
    right = _one_a_time(spark, sf_dir, "view").withColumnRenamed("value", "met")
    return joins.asof_join(left, right, ["user_id"], "ts", ["met"])


@query(f"""with {_KINDS}, lo as (select a.user_id, a.ts, a.value, b.ts as t0, b.value as v0 from a asof left join b on a.user_id = b.user_id and a.ts >= b.ts),
  hi as (select lo.*, b.ts as t1, b.value as v1 from lo asof left join b on lo.user_id = b.user_id and lo.ts <= b.ts)
  select user_id, ts, value as gas, round(case when t0 is null then v1 when t1 is null then v0 when t0 = t1 then v0
    else v0 + (v1 - v0) * ((epoch_us(ts) - epoch_us(t0))::double / (epoch_us(t1) - epoch_us(t0))::double) end, 6) as met from hi""")
def lerp_join(spark, sf_dir):
    left = _one_a_time(spark, sf_dir, "click").withColumnRenamed("value", "gas")
    right = _one_a_time(spark, sf_dir, "view").withColumnRenamed("value", "met")
    return joins.lerp_join(left, right, ["user_id"], "ts", ["met"]).select("user_id", "ts", "gas", r6("met"))


@query("""with d as (select ts::date as day, round(avg(value), 6) as background from events where event_type = 'signup' group by 1 having count(*) >= 2)
  select event_id, background from events e left join d on e.ts::date = d.day""")
def daily_background(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    daily = events.where("event_type = 'signup'").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("background"), F.count("*").alias("n"))
    return joins.daily_join(events, daily.where("n >= 2"), "ts", "background").select("event_id", "background")


_SITES = [(s[0], s[5], s[6], s[7]) for s in registry.SITES if s[5] is not None and s[7] is not None]
_SITES_SQL = ", ".join(f"('{s}', {a}::double, {b}::double, {c}::double)" for s, a, b, c in _SITES)


@query(f"""with s(site, lat, lon, z) as (values {_SITES_SQL}),
  ids as (select distinct s_suppkey, site, lon, lat, z from supplier, s where s_suppkey % 10 = z::int % 10)
  select s_suppkey, site from ids""")
def location_map(spark, sf_dir):
    sup = read(spark, sf_dir, "supplier").select("s_suppkey")
    listed = F.array(*(F.struct(F.lit(f"{b}_{a}_{int(c)}").alias("id"), F.lit(int(c)).alias("z")) for _, a, b, c in _SITES))
    ids = sup.withColumn("s", F.explode(listed)).where("s_suppkey % 10 = s.z % 10").select("s_suppkey", F.col("s.id").alias("location_id"))
    return ids.join(joins.location_map(ids, _SITES), "location_id").select("s_suppkey", "site").distinct()


# --- windows ---------------------------------------------------------------------------------------


@query(f"""with {OBS} select event_id, site, round(case when count("CH4") over w >= 3 then quantile_cont("CH4", 0.01) over w end, 6) as baseline from obs
  window w as (partition by site order by "Time_UTC" range between interval '05:59:59.999999' preceding and current row)""")
def rolling_baseline(spark, sf_dir):
    out = windows.rolling_baseline(obs(spark, sf_dir), ["site"], "Time_UTC", "CH4", "6h", 0.01, 3)
    return out.select("event_id", "site", r6("baseline"))


@query(f"""with {OBS} select event_id, site, round(case when count("CH4") over w >= 84 then quantile_cont("CH4", 0.01) over w end, 6) as baseline from obs
  window w as (partition by site order by "Time_UTC" range between interval '13 days 23:59:59.999999' preceding and current row)""")
def rolling_baseline_14d(spark, sf_dir):
    """The operator's own window and least count."""
    return windows.rolling_baseline(obs(spark, sf_dir), ["site"], "Time_UTC", "CH4").select("event_id", "site", r6("baseline"))


@query(f"""with {OBS} select event_id, round("CH4" - case when count("CH4") over w >= 3 then quantile_cont("CH4", 0.01) over w end, 6) as ex,
  round("CH4" / nullif("QAQC_Flag", 0), 6) as ratio from obs
  window w as (partition by site order by "Time_UTC" range between interval '05:59:59.999999' preceding and current row)""")
def enhancement_ratio(spark, sf_dir):
    out = windows.rolling_baseline(obs(spark, sf_dir), ["site"], "Time_UTC", "CH4", "6h", 0.01, 3)
    return out.select("event_id", F.round(windows.enhancement("CH4", "baseline"), 6).alias("ex"), F.round(windows.ratio("CH4", "QAQC_Flag"), 6).alias("ratio"))


@query(f"""with {OBS} select event_id, round(case when min("CH4") over w < max("CH4") over w and min(height) over w < max(height) over w then corr("CH4", height) over w end, 6) as r from obs
  window w as (partition by site order by "Time_UTC" range between interval '11:59:59.999999' preceding and current row)""")
def rolling_corr(spark, sf_dir):
    out = windows.rolling_corr(obs(spark, sf_dir), ["site"], "Time_UTC", "CH4", "height", "12h")
    return out.select("event_id", r6("r"))


@query(f"""with {OBS} select event_id, round(avg("CH4") over (partition by site order by "Time_UTC"
  range between interval '11:59:59.999999' preceding and interval '12:00:00' following), 6) as smooth from obs""")
def centered_mean(spark, sf_dir):
    return windows.centered_mean(obs(spark, sf_dir), ["site"], "Time_UTC", "CH4", "1d").select("event_id", r6("smooth"))


@query("""with d as (select distinct user_id, ts from events), l as (select user_id, lag(ts) over (partition by user_id order by ts) as gap_start, ts as gap_end from d)
  select * from l where gap_end - gap_start > interval 24 hour""")
def gap_detect(spark, sf_dir):
    return windows.gaps(read(spark, sf_dir, "events"), ["user_id"], "ts", "24h")


_ISLANDS = """h as (select date_trunc('hour', ts)::timestamp as hour, avg(value) as m from events group by 1),
  f as (select *, m >= 50 as f from h), g as (select *, row_number() over (order by hour) - sum(f::int) over (order by hour) as run from f)
  select min(hour) as start, max(hour) as "end", count(*) as n from g where f group by run having count(*) >= 3"""


@query(f"with {_ISLANDS}")
def pcap_islands(spark, sf_dir):
    hourly_mean = read(spark, sf_dir, "events").groupBy(F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("hour")).agg(F.avg("value").alias("m"))
    return windows.islands(hourly_mean, [], "hour", F.col("m") >= 50, 3)


@query("""with m as (select date_trunc('hour', ts)::timestamp as hour, avg(value) as value from events where event_type = 'purchase' group by 1),
  s as (select unnest(generate_series((select min(hour) from m), (select max(hour) from m), interval 1 hour)) as hour)
  select s.hour, round(m.value, 6) as value from s left join m using (hour)""")
def hourly_with_gaps(spark, sf_dir):
    out = aggregate.hourly_with_gaps(read(spark, sf_dir, "events").where("event_type = 'purchase'"), "ts", "value")
    return out.select("hour", r6("value"))


@query("""with s as (select event_type, ts::date as d, avg(value) as v from events group by 1, 2) select d as day, round(avg(v), 6) as v, count(*) as n from s group by 1""")
def site_mean(spark, sf_dir):
    daily = read(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return daily.groupBy("day").agg(F.round(F.avg("v"), 6).alias("v"), F.count("*").alias("n"))


# --- grids, operators, covariances -----------------------------------------------------------------


_ORDER_BINS = """bins as (select unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), interval 1 month))::timestamp as bin_start from orders)"""


@query(f"with {_ORDER_BINS} select bin_start, bin_start + interval 1 month as bin_end from bins")
def flux_bins(spark, sf_dir):
    """Months of the orders."""
    return _order_bins(spark, sf_dir)


def _order_bins(spark, sf_dir):
    """Months from the first to the last order."""
    span = read(spark, sf_dir, "orders").agg(F.date_trunc("MONTH", F.min("o_orderdate")), F.add_months(F.date_trunc("MONTH", F.max("o_orderdate")), 1)).first()
    return timeutil.flux_bins(spark, str(span[0]), str(span[1]), "MS")


def _bias(spark, sf_dir, grouping):
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderpriority as obs_location", "o_orderdate as obs_time")
    orgs = {"1-URGENT": "UATAQ", "2-HIGH": "UATAQ", "3-MEDIUM": "DAQ"}
    jac = inversion.bias_jacobian(rows, _order_bins(spark, sf_dir), grouping, orgs)
    return jac.groupBy("time", *["grp"] * (grouping is not None)).agg(F.sum("value").alias("total"), F.count_distinct("obs_location").alias("places"))


_BIAS = f"with {_ORDER_BINS}, j as (select o_orderpriority as loc, o_orderdate as t, b.bin_start as time from orders join bins b on b.bin_start <= o_orderdate and o_orderdate < b.bin_start + interval 1 month)"


@query(f"{_BIAS} select time, count(*)::double as total, count(distinct loc) as places from j group by 1")
def bias_jacobian_time(spark, sf_dir):
    return _bias(spark, sf_dir, None)


@query(f"{_BIAS} select time, loc as grp, count(*)::double as total, count(distinct loc) as places from j group by 1, 2")
def bias_jacobian_site(spark, sf_dir):
    return _bias(spark, sf_dir, "site")


@query(f"""{_BIAS} select time, case loc when '1-URGENT' then 'UATAQ' when '2-HIGH' then 'UATAQ' when '3-MEDIUM' then 'DAQ' else 'unknown' end as grp,
  count(*)::double as total, count(distinct loc) as places from j group by 1, 2""")
def bias_jacobian_group(spark, sf_dir):
    return _bias(spark, sf_dir, "site_group")


@query(f"""with {OBS}, g as (select i, j, round(-112.2 + (i + 0.5) * 0.05, 9) as lon, round(40.45 + (j + 0.5) * 0.06, 9) as lat from range(9) a(i), range(8) b(j)),
  n as (select floor((longitude + 112.2) / 0.05 + 1e-9)::int as i, floor((latitude - 40.45) / 0.06 + 1e-9)::int as j, count(*) as n from obs group by 1, 2)
  select lon, lat, coalesce(n, 0) as n from g left join n using (i, j)""")
def grid_cells(spark, sf_dir):
    """Cells of the grid with the number of readings in each, none included."""
    grid = inversion.regular_grid(spark, -112.2, -111.75, 40.45, 40.93, 0.05, 0.06)
    at = lambda c, o, d: F.round(F.lit(o) + (F.floor((F.col(c) - o) / d + 1e-9) + 0.5) * d, 9)
    n = obs(spark, sf_dir).groupBy(at("longitude", -112.2, 0.05).alias("lon"), at("latitude", 40.45, 0.06).alias("lat")).agg(F.count("*").alias("n"))
    return grid.join(n, ["lon", "lat"], "left").fillna(0, ["n"])


@query(f"""with {_ORDER_BINS} select bin_start as time, round(-112.2 + (i + 0.5) * 0.15, 9) as lon, round(40.45 + (j + 0.5) * 0.16, 9) as lat, 0.02::double as value
  from range(3) a(i), range(3) b(j), bins""")
def constant_prior(spark, sf_dir):
    grid = inversion.regular_grid(spark, -112.2, -111.75, 40.45, 40.93, 0.15, 0.16)
    return inversion.constant_prior(grid, _order_bins(spark, sf_dir), 0.02)


@query(f"""with {COO}, n as (select count(distinct obs) as n from coo), c as (select cell, sum(abs(v)) / max(n) as coverage from coo, n group by 1)
  select cell, round(coverage, 6) as coverage, coverage >= (select quantile_cont(coverage, 0.1) from c) as kept from c""")
def coverage_filter(spark, sf_dir):
    cover = inversion.coverage(coo(spark, sf_dir), "obs", ["cell"])
    kept, _ = inversion.split_cells(cover, 10, ["cell"])
    return cover.join(kept.withColumn("kept", F.lit(True)), "cell", "left").select("cell", r6("coverage"), F.coalesce("kept", F.lit(False)).alias("kept"))


def _state(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 90).alias("cell")).agg((F.avg("p_retailprice") / 1000).alias("value"))


_STATE = "st as (select p_partkey % 90 as cell, avg(p_retailprice) / 1000 as x from part group by 1)"


@query(f"with {COO}, {_STATE} select obs, round(sum(v * x), 6) as hs from coo join st using (cell) group by 1")
def spmv(spark, sf_dir):
    return inversion.spmv(coo(spark, sf_dir), _state(spark, sf_dir), ["cell"], ["obs"], "hs").select("obs", r6("hs"))


@query(f"""with {COO}, {_STATE}, n as (select count(distinct obs) as n from coo), c as (select cell, sum(abs(v)) / max(n) as cv from coo, n group by 1),
  gone as (select cell from c where cv < (select quantile_cont(cv, 0.1) from c))
  select obs, round(sum(v * x), 6) as removed from coo join st using (cell) where cell in (select cell from gone) group by 1""")
def removed_contribution(spark, sf_dir):
    jac = coo(spark, sf_dir)
    _, gone = inversion.split_cells(inversion.coverage(jac, "obs", ["cell"]), 10, ["cell"])
    out = inversion.spmv(jac.join(gone, "cell", "left_semi"), _state(spark, sf_dir), ["cell"], ["obs"], "removed")
    return out.select("obs", r6("removed"))


_DAYS = """o as (select distinct event_type as loc, date_trunc('hour', ts)::timestamp as t from events)"""


def _hours(spark, sf_dir):
    return (
        read(spark, sf_dir, "events")
        .select(F.col("event_type").alias("obs_location"), F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("obs_time"))
        .distinct()
    )


@query(f"""with {_DAYS}, p as (select a.loc, a.t as ti, b.t as tj, 0.011 * 0.011 * exp(-abs(epoch_us(a.t) - epoch_us(b.t)) / (2.8 * 3600e6)) as v
    from o a join o b on a.loc = b.loc and a.t::date = b.t::date)
  select loc as obs_location, ti as time_i, tj as time_j, round(v, 12) as value from p""")
def mdm_block_cov(spark, sf_dir):
    out = inversion.mdm_entries(_hours(spark, sf_dir), 0.011, True, "2.8h", False)
    return out.select("obs_location", "time_i", "time_j", F.round("value", 12).alias("value"))


@query(f"""with {_DAYS} select a.loc as obs_location, a.t as obs_time,
  round(sum(0.011 * 0.011 * exp(-abs(epoch_us(a.t) - epoch_us(b.t)) / (2.8 * 3600e6)) * hour(b.t)), 10) as value
  from o a join o b on a.loc = b.loc and a.t::date = b.t::date group by 1, 2""")
def mdm_product(spark, sf_dir):
    rows = _hours(spark, sf_dir).withColumn("value", F.hour("obs_time").cast("double"))
    out = inversion.mdm_product(rows, 0.011, "2.8h", False)
    return out.select("obs_location", "obs_time", F.round("value", 10).alias("value"))


@query(f"""with {_DAYS} select a.loc as obs_location, a.t as obs_time,
  round(sum(0.011 * 0.011 * exp(-abs(epoch_us(a.t) - epoch_us(b.t)) / (168 * 3600e6)) * hour(b.t)), 8) as value
  from o a join o b on a.loc = b.loc group by 1, 2""")
def mdm_product_interday(spark, sf_dir):
    """The background component: its kernel spans the days of a location's whole record."""
    rows = _hours(spark, sf_dir).withColumn("value", F.hour("obs_time").cast("double"))
    out = inversion.mdm_product(rows, 0.011, "7d", True)
    return out.select("obs_location", "obs_time", F.round("value", 8).alias("value"))


@query("""with m as (select date_trunc('month', o_orderdate)::timestamp as time, o_custkey % 8 as j, avg(o_totalprice) as flux from orders group by 1, 2)
  select time, round(sum(flux * 6371008.8 * 6371008.8 * radians(0.05) * (sin(radians(40.45 + (j + 0.5) * 0.06 + 0.03)) - sin(radians(40.45 + (j + 0.5) * 0.06 - 0.03)))) / 1e9, 3) as total
  from m group by 1""")
def domain_total(spark, sf_dir):
    m = read(spark, sf_dir, "orders").groupBy(F.date_trunc("MONTH", "o_orderdate").cast("timestamp_ntz").alias("time"), (F.col("o_custkey") % 8).alias("j")).agg(F.avg("o_totalprice").alias("flux"))
    m = m.withColumn("lat", 40.45 + (F.col("j") + 0.5) * 0.06)
    return aggregate.domain_total(m, 0.05, 0.06, 1e-9).select("time", F.round("total", 3).alias("total"))


@query("""select date_trunc('month', o_orderdate)::timestamp as month, o_orderpriority, round(avg(o_totalprice), 6) as mean from orders group by 1, 2""")
def resample_month(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("time"), "o_orderpriority", F.col("o_totalprice").alias("value"))
    out = inversion.resample(rows, ["o_orderpriority"], "D", "MS")
    return out.select(F.col("time").alias("month"), "o_orderpriority", r6("value", "mean"))


@query("""with y as (select o_orderpriority as p, year(o_orderdate) + (dayofyear(o_orderdate) - 1) / (case when dayofyear(make_date(year(o_orderdate), 12, 31)) = 366 then 366 else 365 end) as x, o_totalprice as y from orders)
  select p as o_orderpriority, round(regr_slope(y, x), 4) as slope, round(regr_r2(y, x), 6) as r2, count(*) as n from y group by 1""")
def trend(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderpriority", timeutil.decimal_year(F.col("o_orderdate")).alias("x"), F.col("o_totalprice").alias("y"))
    return inversion.trend(rows, "x", "y", ["o_orderpriority"]).select("o_orderpriority", F.round("slope", 4).alias("slope"), r6("r2"), F.col("n").cast("long").alias("n"))


@query("""select l_returnflag, round(avg(l_tax * l_discount), 8) as diagnosed, round(avg(l_quantity), 6) as specified,
  round(avg(l_tax * l_discount) / nullif(avg(l_quantity), 0), 8) as ratio from lineitem group by 1""")
def desroziers(spark, sf_dir):
    out = inversion.desroziers(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_tax", "l_discount", "l_quantity")
    return out.select("l_returnflag", F.round("diagnosed", 8).alias("diagnosed"), r6("specified"), F.round("ratio", 8).alias("ratio"))


@query("""select l_linestatus, round(sqrt(avg((l_quantity - l_tax) ** 2)), 6) as prior_conc_rmse, round(sqrt(avg((l_quantity - l_discount) ** 2)), 6) as posterior_conc_rmse,
  round(avg(l_quantity - l_tax), 6) as prior_conc_bias, round(avg(l_quantity - l_discount), 6) as posterior_conc_bias, count(*) as n_obs from lineitem group by 1""")
def fit_metrics(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_linestatus", "l_quantity as observed", "l_tax as prior", "l_discount as posterior")
    out = inversion.fit_metrics(rows, ["l_linestatus"])
    return out.select("l_linestatus", *(r6(c) for c in out.columns[1:5]), "n_obs")


@query("""with p as (select o_orderpriority as k, date_trunc('month', o_orderdate)::timestamp as t, sum(o_totalprice) as v from orders group by 1, 2),
  q as (select o_orderpriority as k, date_trunc('month', o_orderdate)::timestamp as t, sum(o_totalprice) as v from orders where o_orderstatus = 'F' group by 1, 2),
  a as (select k, avg(v) as p from p group by 1), b as (select k, avg(v) as q, stddev_samp(v) as s from q group by 1)
  select k as grp, round(p, 2) as prior_flux_mean, round(q, 2) as posterior_flux_mean, round(s, 2) as posterior_flux_std,
    round(100 * (q - p) / nullif(p, 0), 6) as flux_change_pct from a full join b using (k)""")
def flux_metrics(spark, sf_dir):
    """Mean, deviation and change of monthly totals by priority."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), timeutil.floor_period(F.col("o_orderdate"), "M").alias("time"), "o_totalprice", "o_orderstatus")
    total = lambda df: df.groupBy("grp", "time").agg(F.sum("o_totalprice").alias("total"))
    out = inversion.flux_metrics(total(rows), total(rows.where("o_orderstatus = 'F'")), ["grp"])
    means = ("prior_flux_mean", "posterior_flux_mean", "posterior_flux_std")
    return out.select("grp", *(F.round(c, 2).alias(c) for c in means), r6("flux_change_pct"))


@query("""with d as (select date_trunc('month', l_shipdate)::timestamp as month, avg(l_tax * l_discount) as v from lineitem where l_returnflag = 'R' group by 1),
  s as (select date_trunc('month', l_shipdate)::timestamp as month, avg(l_quantity) as v from lineitem where l_linestatus = 'O' group by 1),
  o as (select date_trunc('month', o_orderdate)::timestamp as month, count(*) as v from orders group by 1)
  select month, round(d.v, 8) as diagnosed, round(s.v, 6) as specified, o.v::double as n from d full join s using (month) full join o using (month)""")
def aligned_errors(spark, sf_dir):
    """Series of three origins, aligned by month; none of them has every month."""
    month = lambda c: F.date_trunc("MONTH", c).cast("timestamp_ntz").alias("month")
    lines = read(spark, sf_dir, "lineitem")
    parts = {
        "diagnosed": lines.where("l_returnflag = 'R'").groupBy(month("l_shipdate")).agg(F.avg(F.col("l_tax") * F.col("l_discount")).alias("value")),
        "specified": lines.where("l_linestatus = 'O'").groupBy(month("l_shipdate")).agg(F.avg("l_quantity").alias("value")),
        "n": read(spark, sf_dir, "orders").groupBy(month("o_orderdate")).agg(F.count("*").alias("value")),
    }
    return report.aligned(parts, ["month"]).select("month", F.round("diagnosed", 8).alias("diagnosed"), r6("specified"), "n")


@query(f"""with {COO}, c as (select cell, sum(v) as v from coo group by 1), s as (select distinct p_partkey % 100 as cell from part)
  select cell, round(coalesce(v, 0), 4) as value from s left join c using (cell)""")
def filled_cells(spark, sf_dir):
    """Sums of the operator's columns for every cell of the state; those that it does not reach have 0."""
    sums = coo(spark, sf_dir).groupBy("cell").agg(F.sum("value").alias("value"))
    states = read(spark, sf_dir, "part").select((F.col("p_partkey") % 100).alias("cell"))
    return inversion.filled(sums, states, ["cell"]).select("cell", F.round("value", 4).alias("value"))


@query("""select l_returnflag, round(quantile_cont(l_extendedprice, 0.0), 6) as low, round(quantile_cont(l_extendedprice, 0.25), 6) as q1,
  round(quantile_cont(l_extendedprice, 0.5), 6) as median, round(quantile_cont(l_extendedprice, 0.75), 6) as q3, round(quantile_cont(l_extendedprice, 1.0), 6) as high
  from lineitem group by 1""")
def five_numbers(spark, sf_dir):
    out = inversion.five_numbers(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", *(r6(c) for c in out.columns[1:]))


@query("""select l_returnflag, round(sqrt(sum(l_quantity * l_quantity)), 4) as norm from lineitem group by 1""")
def frobenius(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("value"))
    return inversion.frobenius(rows, ["l_returnflag"]).select("l_returnflag", F.round("norm", 4).alias("norm"))


_RETAINED = f"""{COO}, n as (select count(distinct obs) as n from coo), c as (select cell, sum(abs(v)) / max(n) as cv from coo, n group by 1),
  kept as (select cell from c where cv >= (select quantile_cont(cv, 0.1) from c))"""


def _retained(spark, sf_dir):
    return inversion.split_cells(inversion.coverage(coo(spark, sf_dir), "obs", ["cell"]), 10, ["cell"])[0]


@query(f"""with {_RETAINED}, p as (select p_partkey as cell, p_retailprice as v from part),
  q as (select l_partkey as cell, round(avg(l_extendedprice), 6) as v from lineitem where l_partkey % 90 in (select cell from kept) group by 1)
  select p.cell, coalesce(q.v, p.v) as value from p left join q using (cell)""")
def reconstruct_prior(spark, sf_dir):
    prior = read(spark, sf_dir, "part").selectExpr("p_partkey as cell", "p_retailprice as value")
    rows = read(spark, sf_dir, "lineitem").withColumn("cell", F.col("l_partkey") % 90).join(_retained(spark, sf_dir), "cell", "left_semi")
    post = rows.groupBy(F.col("l_partkey").alias("cell")).agg(F.round(F.avg("l_extendedprice"), 6).alias("value"))
    return inversion.reconstruct(prior, post, ["cell"]).select("cell", "value")


@query(f"""with {COO} select (obs % 1000) as row_bin, cell, round(sum(v) / max(n), 6) as value from coo join (select obs % 1000 as b, count(distinct obs) as n from coo group by 1) k on k.b = obs % 1000 group by 1, 2""")
def obs_space_mean(spark, sf_dir):
    jac = coo(spark, sf_dir).withColumn("row_bin", F.col("obs") % 1000)
    n = jac.groupBy("row_bin").agg(F.count_distinct("obs").alias("__n"))
    rows = jac.join(n, "row_bin").withColumn("obs_time", F.lit("2024-01-01").cast("timestamp_ntz"))
    return inversion.aggregate_space(rows, ["row_bin"], "DAY", ["cell"]).select("row_bin", "cell", r6("value"))


@query()
def cg_posterior(spark, sf_dir):
    """Orders as observations of 90 cells, all of lineitem as operator, read once; so few states need no steps."""
    at = "timestamp_ntz'2024-01-01' as time", "cast(cell as double) as lon", "0.0 as lat"
    row = "cast(obs as string) as obs_location", "timestamp_ntz'2024-01-01' as obs_time"
    jac = written(coo(spark, sf_dir), "operator")
    h = jac.selectExpr(*row, *at, "cast(value as double) as value")
    z = read(spark, sf_dir, "orders").selectExpr("o_orderkey as obs", "o_totalprice / 1000 as value").selectExpr(*row, "value")
    prior = jac.select("cell").distinct().selectExpr(*at, "1.0D as value", "0.5D as sigma")
    out = solvers.solve(h, z, prior, z.withColumn("value", F.lit(1e5)), written).posterior
    return out.select(F.col("lon").cast("long").alias("cell"), r6("value"))


def _yearly_problem(spark, sf_dir):
    """All of lineitem as operator from a grid of 90 cells and the years of shipping to the orders: operator, observations, prior.

    Rows are summed by the numbers that they have, names and places are made of the sums; the observations are written once."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", (F.col("l_partkey") % 90).alias("cell"), "l_quantity")
    rows = rows.groupBy("l_orderkey", F.date_trunc("YEAR", "l_shipdate").cast("timestamp_ntz").alias("time"), "cell").agg((F.sum("l_quantity") / 100).alias("value"))
    cell, named = F.col("cell"), lambda key: F.concat(F.lit("p"), F.col(key).cast("string")).alias("obs_location")
    lon, lat = F.round(F.lit(-112.2) + (cell % 10) * 0.05, 6).alias("lon"), F.round(F.lit(40.45) + F.floor(cell / 10) * 0.05, 6).alias("lat")
    when = F.lit("2024-01-01").cast("timestamp_ntz").alias("obs_time")
    h = written(rows.select(named("l_orderkey"), when, "time", lon, lat, "value"), "operator")
    reached = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    z = read(spark, sf_dir, "orders").join(reached, "o_orderkey", "left_semi")
    z = written(z.select(named("o_orderkey"), when, (F.col("o_totalprice") / 1e5).alias("value")), "observations")
    prior = h.select("time", "lon", "lat").distinct().withColumns({"value": F.lit(1.0), "sigma": F.lit(0.2)})
    return h, z, prior


def _solved(spark, sf_dir, probes=0):
    """Prior states correlated over years (2 years) and cells (10 km); the observations' errors have variance 25."""
    h, z, prior = _yearly_problem(spark, sf_dir)
    prior = written(prior, "prior")
    times = written(inversion.kernel_table(prior, "time", 730 * 86400e6), "times")
    cells = written(covariance.spatial_kernel(prior, 10.0), "cells")
    c = lambda x: covariance.kronecker_product(x, prior, times, cells, ["probe"])
    return solvers.solve(h, z, prior, z.withColumn("value", F.lit(25.0)), written, prior_product=c, probes=probes)


@query()
def kronecker_posterior(spark, sf_dir):
    """Posterior with a prior correlated in space and time, whose covariance is never written."""
    out = _solved(spark, sf_dir).posterior
    return out.select("time", "lon", "lat", r6("value"))


@query()
def posterior_information(spark, sf_dir):
    """Chi-square (exact) and degrees of freedom (eight probes, with their standard error) of the same problem."""
    f = _solved(spark, sf_dir, probes=8).figures
    return spark.createDataFrame([(f["n_obs"], f["reduced_chi2"], f["DOFS"], f["DOFS_error"])], "n_obs long, reduced_chi2 double, dofs double, dofs_error double")


# --- sweep results -----------------------------------------------------------------------------------


def _results(spark, sf_dir):
    return read(spark, sf_dir, "customer").selectExpr(
        "c_custkey as config_id", "c_acctbal / 5000 as reduced_chi2", "c_mktsegment as cfg_segment", "c_nationkey as cfg_nation", "c_acctbal as metric"
    )


@query("""select c_mktsegment as cfg_segment, round(avg(c_acctbal), 6) as mean, round(stddev_samp(c_acctbal), 6) as std, count(c_acctbal) as count from customer group by 1""")
def stability(spark, sf_dir):
    out = results.stability(_results(spark, sf_dir), ["cfg_segment"], "metric")
    return out.select("cfg_segment", r6("mean"), r6("std"), "count")


@query("""with l as (select 'cfg_segment' as param, c_mktsegment as setting, avg(c_acctbal) as m from customer group by 2 union all
    select 'cfg_nation', c_nationkey::varchar, avg(c_acctbal) from customer group by 2)
  select param, round(max(m) - min(m), 6) as range, arg_min(setting, m) as best_setting from l group by 1""")
def sensitivity(spark, sf_dir):
    out = results.sensitivity(_results(spark, sf_dir), ["cfg_segment", "cfg_nation"], "metric")
    return out.select("param", r6("range"), "best_setting")


@query("select c_custkey as config_id, round(abs(c_acctbal / 5000 - 1), 6) as chi2_distance from customer where abs(c_acctbal / 5000 - 1) < 0.1")
def best_configs(spark, sf_dir):
    return results.best(results.with_distance(_results(spark, sf_dir))).select("config_id", r6("chi2_distance"))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_SEGMENT_SQL = ", ".join(f"round(avg(case when c_mktsegment = '{x}' then c_acctbal end), 6) as {x.lower()}" for x in _SEGMENTS)


@query(f"select c_nationkey as cfg_nation, {_SEGMENT_SQL} from customer group by 1")
def heatmap(spark, sf_dir):
    out = results.heatmap(_results(spark, sf_dir), "cfg_segment", "cfg_nation", "metric", _SEGMENTS)
    return out.select("cfg_nation", *(r6(x, x.lower()) for x in _SEGMENTS))


@query("""select event_type as site, date_trunc('hour', ts)::timestamp as hour, round(avg(value), 6) as mean, count(value) as n from events group by 1, 2""")
def hourly_stream(spark, sf_dir):
    """The streaming plan, over the table at rest."""
    return hourly.hourly_stream(obs(spark, sf_dir)).select("site", "hour", r6("mean"), "n")


# --- registries and geometry ---------------------------------------------------------------------


def _values(rows: list[tuple], columns: str) -> str:
    def text(v):
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        return f"'{v}'" if isinstance(v, str) else f"{v}::double" if isinstance(v, float) else str(v)

    return f"(values {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) as t({columns})"


_SITE_VALUES = _values(registry.SITES, "stid, name, organization, type, active, latitude, longitude, height_agl, instruments")


_PLACES = ["wbb", "hw", "bv", "zz", "hdp"]
_PLACE_COUNTS = f"""n as (select ['{"', '".join(_PLACES)}'][user_id % 5 + 1] as stid, count(*) as n from events group by 1)"""


@query(f"with {_PLACE_COUNTS} select s.* exclude (instruments), array_to_string(string_split(instruments, ' '), '+') as instruments, coalesce(n, 0) as n from (select * from {_SITE_VALUES}) s left join n using (stid)")
def site_table(spark, sf_dir):
    """The sites, with the number of their readings in the archive."""
    n = _archive(spark, sf_dir).groupBy(F.col("site").alias("stid")).agg(F.count("*").alias("n"))
    return registry.sites(spark).withColumn("instruments", F.array_join("instruments", "+")).join(n, "stid", "left").fillna(0, ["n"])


_COLUMN_VALUES = _values(
    [(name, "calibrated" if cal else "qaqc", pol, col) for name, _, _, _, cal, cols in registry.INSTRUMENTS for pol, col in cols.items()],
    'instrument, "level", pollutant, "column"',
)


@query(f"""with {_PLACE_COUNTS}, i as (select case when stid in ('hw', 'bv', 'zz') then 'picarro_g2307' else 'lgr_ugga' end as instrument, sum(n)::bigint as n from n group by 1)
  select c.*, coalesce(n, 0) as n from (select * from {_COLUMN_VALUES}) c left join i using (instrument)""")
def instrument_table(spark, sf_dir):
    """The instruments' columns, with the number of their readings in the archive."""
    n = _archive(spark, sf_dir).groupBy("instrument").agg(F.count("*").alias("n"))
    return registry.instrument_columns(spark).join(n, "instrument", "left").fillna(0, ["n"])


@query()
def config_identity(spark, sf_dir):
    """One configuration for each nation of the customers (a bounded list), and its customers."""
    nations = [r[0] for r in read(spark, sf_dir, "nation").select("n_nationkey").distinct().orderBy("n_nationkey").collect()]
    configs = [(k, dataclasses.replace(InversionConfig(), prior_base_std=0.01 * (k + 1))) for k in nations]
    ids = spark.createDataFrame([(k, config_id(c), c.resolution) for k, c in configs], "c_nationkey int, config_id string, resolution string")
    return read(spark, sf_dir, "customer").join(F.broadcast(ids), "c_nationkey").groupBy("config_id", "resolution").agg(F.count("*").alias("n"))


@query(f"""with {OBS} select event_id, round(2 * 6371.0088 * asin(sqrt(least(1.0, sin(radians(40.766189 - latitude) / 2) ** 2
  + cos(radians(latitude)) * cos(radians(40.766189)) * sin(radians(-111.847672 - longitude) / 2) ** 2))), 6) as km from obs""")
def distance_to_site(spark, sf_dir):
    lat, lon, _ = registry.site_position("wbb")
    km = geo.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon))
    return obs(spark, sf_dir).select("event_id", F.round(km, 6).alias("km"))


@query(f"""with {OBS} select event_id from obs where longitude between -112.095 and -111.905 and latitude between 40.505 and 40.695""")
def box_polygon(spark, sf_dir):
    ring = [(-112.095, 40.505), (-111.905, 40.505), (-111.905, 40.695), (-112.095, 40.695)]
    return obs(spark, sf_dir).where(geo.in_polygon(F.col("longitude"), F.col("latitude"), ring)).select("event_id")


@query(f"""with {OBS} select event_id, round(-"CH4" * sin(radians(event_id % 360)), 6) + 0.0::double as u, round(-"CH4" * cos(radians(event_id % 360)), 6) + 0.0::double as v from obs""")
def wind_vectors(spark, sf_dir):
    u, v = geo.wind_components(F.col("CH4"), F.col("event_id") % 360)
    return obs(spark, sf_dir).select("event_id", (F.round(u, 6) + F.lit(0.0)).alias("u"), (F.round(v, 6) + F.lit(0.0)).alias("v"))


# The projection in SQL: Krueger's series to the sixth power of the third flattening would be long; the
# fourth is below a tenth of a millimetre here.
_UTM = f"""with {OBS}, c as (select 6378137.0::double as a, 1 / 298.257223563::double as f, 0.9996::double as k0, radians(-111.0) as lon0),
  n as (select *, f / (2 - f) as n from c),
  k as (select *, a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) as r, sqrt(f * (2 - f)) as e,
    n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180 as a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440 as a2,
    61 * n ** 3 / 240 - 103 * n ** 4 / 140 as a3, 49561 * n ** 4 / 161280 as a4 from n),
  t as (select event_id, k.*, sinh(atanh(sin(radians(latitude))) - e * atanh(e * sin(radians(latitude)))) as t, radians(longitude) - lon0 as dl from obs, k),
  x as (select *, atan2(t, cos(dl)) as xi, atanh(sin(dl) / sqrt(1 + t * t)) as eta from t)
  select event_id, round(500000 + k0 * r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta) + a4 * cos(8 * xi) * sinh(8 * eta)), 2) as easting,
    round(k0 * r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta)), 2) as northing from x"""


@query(_UTM)
def utm_positions(spark, sf_dir):
    e, n = geo.utm(F.col("latitude"), F.col("longitude"))
    return obs(spark, sf_dir).select("event_id", F.round(e, 2).alias("easting"), F.round(n, 2).alias("northing"))


# --- tables behind figures -------------------------------------------------------------------------


@query("""with m as (select p_partkey % 90 as lon, p_size as lat, avg(p_retailprice) as v from part group by 1, 2) select lon, lat, round(v, 6) as value from m""")
def cell_time_mean(spark, sf_dir):
    rows = read(spark, sf_dir, "part").selectExpr("p_partkey % 90 as lon", "p_size as lat", "p_retailprice as value")
    return report.time_mean(rows).select("lon", "lat", r6("value"))


@query(f"with {_RETAINED} select distinct p_partkey % 90 as cell from part where p_partkey % 90 not in (select cell from kept)")
def removed_cells(spark, sf_dir):
    full = read(spark, sf_dir, "part").selectExpr("p_partkey % 90 as cell")
    return report.removed_cells(full, _retained(spark, sf_dir), ["cell"])


@query("""with a as (select date_trunc('month', o_orderdate)::timestamp as time, sum(o_totalprice) as p from orders group by 1),
  b as (select date_trunc('month', o_orderdate)::timestamp as time, sum(o_totalprice) as q from orders where o_orderstatus = 'F' group by 1)
  select time, round(p, 2) as prior, round(q, 2) as posterior, round(100 * (q - p) / nullif(p, 0), 4) as change_pct from a full join b using (time)""")
def flux_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("time", timeutil.floor_period(F.col("o_orderdate"), "M"))
    total = lambda df: df.groupBy("time").agg(F.sum("o_totalprice").alias("total"))
    out = report.summary(total(rows), total(rows.where("o_orderstatus = 'F'")))
    return out.select("time", F.round("prior", 2).alias("prior"), F.round("posterior", 2).alias("posterior"), F.round("change_pct", 4).alias("change_pct"))


@query(f"""with {OBS}, g as (select distinct site, "Time_UTC" as t, latitude, longitude from obs where event_id % 7 = 0 qualify row_number() over (partition by site, "Time_UTC" order by event_id) = 1)
  select o.event_id, g.latitude, g.longitude from (select * from obs where event_id % 7 <> 0) o asof join g on o.site = g.site and o."Time_UTC" >= g.t
  where o."Time_UTC" - g.t <= interval 2 hour""")
def gps_positions(spark, sf_dir):
    rows = obs(spark, sf_dir)
    fixes = rows.where("event_id % 7 = 0").groupBy("site", "Time_UTC").agg(*(F.min_by(c, "event_id").alias(c) for c in ("latitude", "longitude")))
    left = rows.where("event_id % 7 <> 0").select("event_id", "site", "Time_UTC")
    out = joins.asof_join(left, fixes, ["site"], "Time_UTC", ["latitude", "longitude"], 2 * 3600 * 1_000_000)
    return out.dropna(subset=["latitude"]).select("event_id", "latitude", "longitude")


@query(f"with {OBS} select event_id from obs where longitude not between -112.095 and -111.905 or latitude not between 40.505 and 40.695")
def outside_storage(spark, sf_dir):
    ring = [(-112.095, 40.505), (-111.905, 40.505), (-111.905, 40.695), (-112.095, 40.695)]
    return mobile.outside(obs(spark, sf_dir), ring).select("event_id")


@query("""with b as (select o_orderkey, o_totalprice, count(*) over (partition by date_trunc('month', o_orderdate)) as n from orders) select o_orderkey from b where n >= 60""")
def enough_per_interval(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("obs_time"))
    return enough(rows, InversionConfig().min_obs_per_interval).select("o_orderkey")


@query("""with h as (select user_id % 3 as site, date_trunc('hour', ts)::timestamp as obs_time, avg(value) as v from events group by 1, 2),
  d as (select site, obs_time, v from (select distinct site from h) join (select distinct obs_time from h) on true left join h using (site, obs_time)),
  b as (select obs_time, case when count(v) over w >= 6 then quantile_cont(v, 0.01) over w end as b from d
    window w as (partition by site order by obs_time range between interval '23:59:59.999999' preceding and current row))
  select obs_time, round(avg(b), 6) as background from b group by 1""")
def rolling_background(spark, sf_dir):
    """Mean over the sites of each one's rolling percentile, at every hour that any of them has."""
    hourly_ = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 3).alias("site"), F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("obs_time")).agg(F.avg("value").alias("CH4"))
    return plan.background("rolling", hourly_, hours=hourly_, window="1d", min_periods=6).select("obs_time", r6("background"))


@query()
def curve_background(spark, sf_dir):
    """A curve fitted to the daily means of orders (as samples in ppb), at every hour of events."""
    day = F.date_trunc("DAY", "o_orderdate").cast("timestamp_ntz").alias("obs_time")
    samples = read(spark, sf_dir, "orders").groupBy(day).agg(F.avg("o_totalprice").alias("value"))
    hours = read(spark, sf_dir, "events").select(F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("obs_time")).distinct()
    return plan.background("gml", hours, samples=samples).select("obs_time", r6("background"))


# --- concentrations, point sources, forward operator -----------------------------------------------

_ARCHIVE_SQL = f"""arch as (select ts, ['{"', '".join(_PLACES)}'][user_id % 5 + 1] as site, value as v, event_id % 4 - 1 as flag,
  case when event_id % 10 = 0 then -9 else -10 end as id from events)"""


def _archive(spark, sf_dir):
    """Events as an archive of raw readings at five sites."""
    site = F.get(F.array(*map(F.lit, _PLACES)), (F.col("user_id") % 5).cast("int"))
    rows = read(spark, sf_dir, "events").withColumn("site", site)
    daq = F.col("site").isin("hw", "bv", "zz")
    return rows.select(
        "site",
        F.when(daq, "picarro_g2307").otherwise("lgr_ugga").alias("instrument"),
        F.lit("calibrated").alias("lvl"),
        F.col("ts").alias("Time_UTC"),
        F.when(F.col("event_id") % 10 == 0, -9).otherwise(-10).alias("ID_CH4"),
        (F.col("event_id") % 4 - 1).alias("QAQC_Flag"),
        F.col("value").alias("CH4d_ppm_cal"),
        F.when(~daq, F.col("value") * 100).alias("CO2d_ppm_cal"),
    )


@query(f"""with {_ARCHIVE_SQL}, s as (select * from {_SITE_VALUES}),
  ok as (select arch.*, case when id = -10 and flag in (-140, -64, 0, 1, 2) and v between 1.7 and 300 then v end as ch4,
    case when site in ('wbb', 'hdp') and flag in (-140, -64, 0, 1, 2) and v * 100 between 350 and 5000 then v * 100 end as co2 from arch)
  select ts as "Time_UTC", ts - interval 7 hour as "Time_MST", site, organization as org, case when site in ('wbb', 'hdp') then 'lgr_ugga' else 'picarro_g2307' end as instrument,
    ch4 as "CH4", co2 as "CO2", latitude, longitude, height_agl as height
  from ok join s on s.stid = ok.site where (ch4 is not null or co2 is not null) and hour(ts - interval 7 hour) between 8 and 19""")
def concentrations(spark, sf_dir):
    return load_concentrations(
        _archive(spark, sf_dir), ["CH4", "CO2"], sites=[x.upper() for x in _PLACES], include_location=True, hours=list(range(8, 20))
    )


_POINT_VALUES = _values(registry.POINT_SOURCES, "category, name, longitude, latitude")


@query(f"""with {OBS}, p as (select * from {_POINT_VALUES}), n as (select name, p.longitude, p.latitude, count(*) as n from p join obs on abs(obs.latitude - p.latitude) <= 0.02 and abs(obs.longitude - p.longitude) <= 0.02 group by 1, 2, 3)
  select category, p.name, p.longitude, p.latitude, coalesce(n, 0) as n from p left join n on n.name = p.name and n.longitude = p.longitude and n.latitude = p.latitude""")
def point_sources(spark, sf_dir):
    """The point sources, with the number of readings within a fiftieth of a degree of each (a bounded list: an expression)."""
    near = F.array_compact(F.array(*(F.when((F.abs(F.col("latitude") - r[3]) <= 0.02) & (F.abs(F.col("longitude") - r[2]) <= 0.02), F.lit(k)) for k, r in enumerate(registry.POINT_SOURCES))))
    n = obs(spark, sf_dir).select(F.explode(near).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(k, r[1], float(r[2]), float(r[3])) for k, r in enumerate(registry.POINT_SOURCES)], "k int, name string, longitude double, latitude double")
    n = n.join(F.broadcast(names), "k").drop("k")
    return registry.point_sources(spark).join(n, ["name", "longitude", "latitude"], "left").fillna(0, ["n"]).select("category", "name", "longitude", "latitude", "n")


@query(f"""with p as (select * from {_POINT_VALUES} where category = 'landfill'), {OBS}
  select name, count(*) as n, round(avg("CH4"), 6) as ch4 from obs join p on abs(obs.latitude - p.latitude) <= 0.05 and abs(obs.longitude - p.longitude) <= 0.05 group by 1""")
def near_landfills(spark, sf_dir):
    """Readings within a twentieth of a degree of each landfill: a bounded list, so an expression, not a join."""
    fills = [r for r in registry.POINT_SOURCES if r[0] == "landfill"]
    near = F.array_compact(
        F.array(*(F.when((F.abs(F.col("latitude") - y) <= 0.05) & (F.abs(F.col("longitude") - x) <= 0.05), F.lit(n)) for _, n, x, y in fills))
    )
    return obs(spark, sf_dir).select(F.explode(near).alias("name"), "CH4").groupBy("name").agg(F.count("*").alias("n"), F.round(F.avg("CH4"), 6).alias("ch4"))


_FOOT_SQL = """foot as (select 'loc' || (l_suppkey % 4) as lid, o_orderdate as t, l_shipdate as ft,
  -112.2 + (l_partkey % 45) * 0.01 + 0.003 as x, 40.45 + (l_suppkey % 48) * 0.01 + 0.003 as y, l_quantity / 1000 as v,
  case when l_linenumber = 1 then 'coarse' else 'fine' end as fp from lineitem join orders on l_orderkey = o_orderkey)"""


def _footprints(spark, sf_dir):
    """Line items as footprint values of simulations at four locations."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.concat(F.lit("loc"), (F.col("l_suppkey") % 4).cast("string")).alias("location_id"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=F.pmod("l_orderkey", F.lit(24)).cast("int"))).alias("run_time"),
        F.col("l_shipdate").alias("foot_time"),
        (F.lit(-112.2) + (F.col("l_partkey") % 45) * 0.01 + 0.003).alias("lon"),
        (F.lit(40.45) + (F.col("l_suppkey") % 48) * 0.01 + 0.003).alias("lat"),
        (F.col("l_quantity") / 1000).alias("foot"),
        F.when(F.col("l_linenumber") == 1, "coarse").otherwise("fine").alias("footprint"),
    )


@query(f"""with {_FOOT_SQL.replace("o_orderdate as t", "o_orderdate + to_hours((l_orderkey % 24)::int) as t")}
  select case lid when 'loc1' then 'wbb' when 'loc2' then 'hw' else lid end as obs_location, t::timestamp as obs_time, date_trunc('month', ft)::timestamp as time,
    round(-112.2 + (floor((x + 112.2) / 0.05 + 1e-9) + 0.5) * 0.05, 9) as lon, round(40.45 + (floor((y - 40.45) / 0.05 + 1e-9) + 0.5) * 0.05, 9) as lat, round(sum(v), 9) as value
  from foot where fp = 'fine' and lid in ('loc0', 'loc1', 'loc2') and hour(t) in (19, 20, 21, 22, 23) group by 1, 2, 3, 4, 5""")
def footprint_jacobian(spark, sf_dir):
    """Finest footprints of the simulations that observations need, at the receptors' hours, on grid and flux bins."""
    config = InversionConfig(location_site_map={"loc1": "wbb", "loc2": "hw"})
    foot = forward.relevant(
        _footprints(spark, sf_dir), ["wbb", "hw", "loc0"], config.location_site_map, config.subset_hours_utc, forward.finest({"coarse": 0.1, "fine": 0.01})
    )
    out = inversion.footprint_jacobian(foot, config.dx, config.dy, config.xmin, config.ymin)
    return out.withColumn("value", F.round("value", 9))


@query(f"""with {COO}, o as (select coo.obs as obs, cell, v, 'p' || (obs % 5) as loc, o_orderdate as t from coo join orders on o_orderkey = obs),
  n as (select loc, date_trunc('month', t)::timestamp as m, count(distinct obs) as n from o group by 1, 2)
  select o.loc as obs_location, m as obs_time, cell, round(sum(v) / max(n), 9) as value from o join n on n.loc = o.loc and n.m = date_trunc('month', o.t) group by 1, 2, 3""")
def operator_by_month(spark, sf_dir):
    """Operator rows averaged over the observations of a place and month; absent entries count as 0."""
    when = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs"), F.col("o_orderdate").alias("obs_time"))
    rows = coo(spark, sf_dir).join(when, "obs").withColumn("obs_location", F.concat(F.lit("p"), (F.col("obs") % 5).cast("string")))
    month = F.date_trunc("MONTH", "obs_time")
    n = rows.groupBy("obs_location", month.alias("m")).agg(F.count_distinct("obs").alias("__n"))
    rows = rows.withColumn("m", month).join(n, ["obs_location", "m"]).drop("m")
    out = inversion.aggregate_space(rows, inversion.OBS, "MONTH", ["cell"])
    return out.select(*inversion.OBS, "cell", F.round("value", 9).alias("value"))


_MDM_SITES = {"bv": "DAQ", "ed": "DAQ", "hw": "DAQ", "rb": "DAQ", "wbb": "UATAQ"}
_MDM_OBS = f"""o as (select distinct ['{"', '".join(_MDM_SITES)}'][user_id % 5 + 1] as loc, date_trunc('hour', ts)::timestamp as t from events),
  q as (select *, case loc when 'wbb' then 0.0033 else 0.0099 end as instr, case when month(t) in (12, 1, 2) then 1 when month(t) in (6, 7, 8) then 2 when month(t) in (3, 4, 5) then 3 else 4 end as k from o)"""
_WIND = "case loc " + " ".join(
    f"when '{s}' then [{', '.join(str(inversion.MDM['transport_wind']['std'][s][k]) for k in ('DJF', 'JJA', 'MAM', 'SON'))}][k]" for s in _MDM_SITES
) + " end"


@query(f"""with {_MDM_OBS}, w as (select loc, t, instr, ({_WIND})::double as wind from q),
  p as (select a.loc, a.t as ti, b.t as tj, a.t = b.t as own, a.t::date = b.t::date as day, a.instr as instr, a.wind * b.wind as wind, abs(epoch_us(a.t) - epoch_us(b.t)) / 3600e6 as h
    from w a join w b on a.loc = b.loc)
  select loc as obs_location, date_trunc('day', ti)::timestamp as day, count(*) as n, round(sum(case when own then 0.000765 ** 2 + instr ** 2 else 0 end + case when day then 0.0257 ** 2 else 0 end
    + 0.011 ** 2 * exp(-h / 168) + case when day then (wind + 0.00771 ** 2) * exp(-h / 2.8) else 0 end), 9) as total from p group by 1, 2""")
def mdm_matrix(spark, sf_dir):
    """All six components of the model-data mismatch over every hour of events, summed by location and day of the
    row: row sums from linear scans, the matrix is not written."""
    sums = covariance.mismatch_row_sums(_mdm_hours(spark, sf_dir), inversion.mdm_components({}), _MDM_SITES)
    return sums.groupBy("obs_location", F.date_trunc("DAY", "obs_time").cast("timestamp_ntz").alias("day")).agg(
        F.sum("n").alias("n"), F.round(F.sum("value"), 9).alias("total")
    )


def _mdm_hours(spark, sf_dir):
    place = F.get(F.array(*map(F.lit, _MDM_SITES)), (F.col("user_id") % 5).cast("int"))
    return read(spark, sf_dir, "events").select(place.alias("obs_location"), F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("obs_time")).distinct()


def _aggregated(unit: str) -> str:
    return f"""with {_MDM_OBS}, w as (select loc, t, date_trunc('{unit}', t)::timestamp as bin, instr, ({_WIND})::double as wind from q),
  n as (select loc, bin, count(*) as n from w group by 1, 2),
  p as (select a.loc, a.bin as ti, b.bin as tj, a.t = b.t as own, a.t::date = b.t::date as day, a.instr as instr, a.wind * b.wind as wind, abs(epoch_us(a.t) - epoch_us(b.t)) / 3600e6 as h
    from w a join w b on a.loc = b.loc),
  s as (select loc, ti, tj, sum(case when own then 0.000765 ** 2 + instr ** 2 else 0 end + case when day then 0.0257 ** 2 else 0 end
    + 0.011 ** 2 * exp(-h / 168) + case when day then (wind + 0.00771 ** 2) * exp(-h / 2.8) else 0 end) as v from p group by 1, 2, 3)
  select s.loc as obs_location, ti as time_i, tj as time_j, round(v / (a.n * b.n), 12) as value
  from s join n a on a.loc = s.loc and a.bin = s.ti join n b on b.loc = s.loc and b.bin = s.tj"""


def _aggregated_query(spark, sf_dir, unit):
    out = covariance.aggregated_mismatch(_mdm_hours(spark, sf_dir), inversion.mdm_components({}), unit, _MDM_SITES)
    return out.withColumn("value", F.round("value", 12))


@query(_aggregated("day"))
def mdm_daily_means(spark, sf_dir):
    """W S W' for daily means of every hour of events: within-day sums by recurrence, days linked by factors."""
    return _aggregated_query(spark, sf_dir, "DAY")


@query(_aggregated("week"))
def mdm_weekly_means(spark, sf_dir):
    """The same for weekly means: components of a day add up within the week."""
    return _aggregated_query(spark, sf_dir, "WEEK")


_FIELD_SQL = """inv as (select date_trunc('quarter', l_shipdate)::timestamp as time, -112.15 + (l_partkey % 8) * 0.1 as lon, 40.5 + (l_suppkey % 6) * 0.1 as lat, 's' || (l_linenumber % 3) as sector,
  sum(l_quantity) as value from lineitem group by 1, 2, 3, 4)"""


def _inventory(spark, sf_dir):
    """Line items as an inventory by quarter, cell and sector."""
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(
            F.date_trunc("QUARTER", "l_shipdate").cast("timestamp_ntz").alias("time"),
            (F.lit(-112.15) + (F.col("l_partkey") % 8) * 0.1).alias("lon"),
            (F.lit(40.5) + (F.col("l_suppkey") % 6) * 0.1).alias("lat"),
            F.concat(F.lit("s"), (F.col("l_linenumber") % 3).cast("string")).alias("sector"),
        )
        .agg(F.sum("l_quantity").alias("value"))
    )


@query(f"""with {_FIELD_SQL}, s as (select time, lon, lat, sum(value) as v from inv group by 1, 2, 3),
  g as (select *, -112.2 + i * 0.15 as x0, 40.45 + j * 0.15 as y0 from s, range(7) a(i), range(6) b(j)),
  w as (select *, greatest(0, least(lon + 0.05, x0 + 0.15) - greatest(lon - 0.05, x0)) as dx,
    greatest(0, sin(radians(least(lat + 0.05, y0 + 0.15))) - sin(radians(greatest(lat - 0.05, y0)))) as dy from g)
  select time, round(x0 + 0.075, 9) as lon, round(y0 + 0.075, 9) as lat, round(sum(v * dx * dy / (0.15 * (sin(radians(y0 + 0.15)) - sin(radians(y0))))), 6) as value
  from w where dx > 1e-7 and dy > 1e-9 group by 1, 2, 3""")
def regrid(spark, sf_dir):
    """Sectors summed and regridded, mass kept."""
    out = inversion.regrid(inversion.sector_sum(_inventory(spark, sf_dir)), (0.1, 0.1), (0.15, 0.15), (-112.2, 40.45))
    return out.withColumn("value", F.round("value", 6))


@query(f"""with {_FIELD_SQL}, s as (select time, lon, lat, sum(value) as v from inv group by 1, 2, 3), {_ORDER_BINS},
  q as (select distinct time from s), n as (select bin_start, arg_min(time, abs(epoch_us(time) - epoch_us(bin_start)) * 2 + case when time > bin_start then 1 else 0 end) as time from bins, q group by 1)
  select bin_start as time, round(lon, 6) as lon, round(lat, 6) as lat, v as value from s join n using (time)""")
def nearest_time(spark, sf_dir):
    times = _order_bins(spark, sf_dir).select(F.col("bin_start").alias("time"))
    out = inversion.nearest_time(inversion.sector_sum(_inventory(spark, sf_dir)), times, inversion.CELL)
    return out.select("time", r6("lon"), r6("lat"), "value")


_SECTORS_SQL = """select date_trunc('{unit}', l_shipdate)::timestamp as time, l_partkey % 8 as i, l_suppkey % 6 as j, 's' || (l_linenumber % 5) as sector, sum(l_quantity){scale} as value from lineitem {where} group by 1, 2, 3, 4"""


@query(f"""with a as ({_SECTORS_SQL.format(unit="year", scale=" / 12", where="")}), m as ({_SECTORS_SQL.format(unit="month", scale="", where="where l_linenumber % 5 < 3")}),
  alone as (select * from a where sector not in (select sector from m)),
  n as (select m.time, max(y.time) as year from (select distinct time from m) m join (select distinct time from alone) y on y.time <= m.time group by 1),
  u as (select time, i, j, value from m union all select n.time, i, j, value from alone join n on alone.time = n.year)
  select time, round(-112.15 + i * 0.1, 6) as lon, round(40.5 + j * 0.1, 6) as lat, round(sum(value), 4) as value from u group by 1, 2, 3""")
def merged_inventory(spark, sf_dir):
    """All line items by year and sector, some sectors by month: the yearly ones filled forward to the months, all summed."""
    cell = (F.round(F.lit(-112.15) + (F.col("l_partkey") % 8) * 0.1, 6).alias("lon"), F.round(F.lit(40.5) + (F.col("l_suppkey") % 6) * 0.1, 6).alias("lat"))
    sector = F.concat(F.lit("s"), (F.col("l_linenumber") % 5).cast("string")).alias("sector")
    by = lambda df, unit: df.groupBy(F.date_trunc(unit, "l_shipdate").cast("timestamp_ntz").alias("time"), *cell, sector)
    lines = read(spark, sf_dir, "lineitem")
    annual = by(lines, "YEAR").agg((F.sum("l_quantity") / 12).alias("value"))
    monthly = by(lines.where("l_linenumber % 5 < 3"), "MONTH").agg(F.sum("l_quantity").alias("value"))
    out = inversion.sector_sum(inversion.merged_inventory(annual, monthly))
    return out.select("time", "lon", "lat", F.round("value", 4).alias("value"))


@query(f"""with y as (select date_trunc('year', o_orderdate)::timestamp as t, o_orderpriority as sector, sum(o_totalprice) as value from orders group by 1, 2), {_ORDER_BINS}
  select bin_start as time, sector, round(value, 2) as value from bins asof join y on bin_start >= t cross join (select 1)""".replace(" cross join (select 1)", "").replace(
    "bins asof join y on bin_start >= t", "(select bin_start, sector from bins, (select distinct sector from y)) b asof join y on b.sector = y.sector and b.bin_start >= y.t"
).replace("bin_start as time, sector,", "b.bin_start as time, b.sector,"))
def filled_forward(spark, sf_dir):
    year = F.date_trunc("YEAR", "o_orderdate").cast("timestamp_ntz").alias("time")
    annual = read(spark, sf_dir, "orders").groupBy(year, F.col("o_orderpriority").alias("sector")).agg(F.sum("o_totalprice").alias("value"))
    out = inversion.filled_forward(annual, _order_bins(spark, sf_dir).select(F.col("bin_start").alias("time")), ["sector"])
    return out.select("time", "sector", F.round("value", 2).alias("value"))


@query(f"""with {_ORDER_BINS} select bin_start as time, grp, 0.0::double as value from bins, (values ('UATAQ'), ('DAQ'), ('unknown')) g(grp)""")
def bias_states(spark, sf_dir):
    sites = ["wbb", "hw", "bv", "elsewhere"]
    return inversion.bias_states(_order_bins(spark, sf_dir), "site_group", sites, {"wbb": "UATAQ", "hw": "DAQ", "bv": "DAQ"})


_SOUND_SQL = """snd as (select user_id % 7 as id, ts::date as day, 1200 + (event_id % 40) * 30 as z, avg(280 + value / 10) as theta from events group by 1, 2, 3)"""


def _soundings(spark, sf_dir):
    return (
        read(spark, sf_dir, "events")
        .groupBy((F.col("user_id") % 7).alias("id"), F.to_date("ts").alias("day"), (F.lit(1200) + (F.col("event_id") % 40) * 30).alias("z"))
        .agg(F.avg(F.lit(280) + F.col("value") / 10).alias("theta"))
        .withColumn("rho", F.lit(1.1))
    )


@query(f"""with {_SOUND_SQL}, b as (select * from snd where z <= 2200), t as (select id, day, arg_max(theta, z) as top from b group by 1, 2),
  d as (select b.id, b.day, z, 1005.0 * 1.1 * (top - theta) as d from b join t on t.id = b.id and t.day = b.day),
  s as (select *, (z - lag(z) over w) * (d + lag(d) over w) / 2 as step from d window w as (partition by id, day order by z))
  select id, day::varchar as day, round(sum(step) / 1e6, 6) as heat_deficit from s group by 1, 2""")
def heat_deficit(spark, sf_dir):
    out = windows.heat_deficit(_soundings(spark, sf_dir), ["id", "day"])
    return out.select("id", F.col("day").cast("string").alias("day"), r6("heat_deficit"))


@query("""select o_orderkey as id, round(0.019 + 0.5 * o_totalprice, 6) as sigma from orders""")
def prior_sigma(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    return inversion.prior_sigma(rows).select("id", r6("sigma"))


@query(f"with {_ORDER_BINS} select a.bin_start as key_i, b.bin_start as key_j, round(exp(-abs(epoch_us(a.bin_start) - epoch_us(b.bin_start)) / (32 * 86400e6)), 9) as k from bins a, bins b")
def time_kernel(spark, sf_dir):
    """Correlation between the months of the orders; a bounded list of times."""
    out = inversion.kernel_table(_order_bins(spark, sf_dir), "bin_start", 32 * 86400e6)
    return out.withColumn("k", F.round("k", 9))


# --- large point and route sets ---------------------------------------------------------------------

_FIXES = "f as (select event_id, (event_id * 15485863 % 50000)::double as x, (event_id * 32452843 % 50000)::double as y from events)"
_PARTS = "p as (select p_partkey as k, (p_partkey * 7919 % 50021)::double as x, (p_partkey * 104729 % 49999)::double as y from part)"
_LINES = """v as (select c_custkey as route, (c_custkey * 7919 % 50000)::double as x, (c_custkey * 104729 % 50000)::double as y,
  ((c_custkey % 41 - 20) * 50)::double as dx, ((c_custkey % 37 - 18) * 50)::double as dy, ((c_custkey % 29 - 14) * 60)::double as ex,
  ((c_custkey % 31 - 15) * 60)::double as ey from customer),
  s as (select route, 0 as n, x as ax, y as ay, x + dx as zx, y + dy as zy from v
  union all select route, 1, x + dx, y + dy, x + dx + ex, y + dy + ey from v)"""


def fixes(spark, sf_dir):
    """Every event as a position in metres."""
    return read(spark, sf_dir, "events").selectExpr("event_id", "double(event_id * 15485863 % 50000) as x", "double(event_id * 32452843 % 50000) as y")


def lines(spark, sf_dir):
    """Every customer as a route of three vertices in metres."""
    c = "c_custkey"
    steps = [(0, "0", "0"), (1, f"({c} % 41 - 20) * 50", f"({c} % 37 - 18) * 50")]
    steps.append((2, f"{steps[1][1]} + ({c} % 29 - 14) * 60", f"{steps[1][2]} + ({c} % 31 - 15) * 60"))
    vertices = ", ".join(f"struct({n} as n, double({c} * 7919 % 50000 + {dx}) as x, double({c} * 104729 % 50000 + {dy}) as y)" for n, dx, dy in steps)
    rows = read(spark, sf_dir, "customer").selectExpr(f"{c} as route", f"explode(array({vertices})) as v").select("route", "v.*")
    return spatial.segments_of(rows)


def _near_line(point: str, radius: float) -> str:
    """SQL: pairs of ``point`` (x, y) and the segments within the radius."""
    t = "greatest(0, least(1, case when dd > 0 then ((x - ax) * (zx - ax) + (y - ay) * (zy - ay)) / dd else 0 end))"
    inner = f"select *, (zx - ax) * (zx - ax) + (zy - ay) * (zy - ay) as dd from {point}, s"
    return f"select *, {t} as t from ({inner}) where sqrt((x - ax - {t} * (zx - ax)) ** 2 + (y - ay - {t} * (zy - ay)) ** 2) <= {radius}"


@query(f"""with {_FIXES}, {_PARTS}, d as (select event_id, k, p.x as x, p.y as y, (p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y) as d from f, p),
  m as (select event_id, min(d) as d from d group by 1) select event_id, min_by(k, k) as part, min_by(x, k) as x, min_by(y, k) as y
  from d join m using (event_id, d) group by 1""")
def nearest_part(spark, sf_dir):
    """The nearest of all parts' places for every event."""
    parts = read(spark, sf_dir, "part").selectExpr("p_partkey as part", "double(p_partkey * 7919 % 50021) as px", "double(p_partkey * 104729 % 49999) as py")
    out = spatial.nearest(fixes(spark, sf_dir), parts, "x", "y", "px", "py", "part", "near_x", "near_y")
    return out.select("event_id", "part", F.col("near_x").alias("x"), F.col("near_y").alias("y"))


@query(f"""with {_FIXES}, {_LINES}, h as ({_near_line("f", 300.123)})
  select event_id, count(distinct route) as n, string_agg(distinct route::varchar, ' ' order by route::varchar) as routes from h group by 1""")
def routes_passed(spark, sf_dir):
    """Events within 300.123 m of customers' routes, with the routes' names."""
    out = spatial.routes_at(fixes(spark, sf_dir), lines(spark, sf_dir).withColumn("route", F.col("route").cast("string")), 300.123, "x", "y")
    out = out.where(F.size("routes") > 0)
    return out.select("event_id", F.size("routes").cast("long").alias("n"), F.array_join("routes", " ").alias("routes"))


@query(f"""with {_LINES}, l as (select *, sqrt((zx - ax) * (zx - ax) + (zy - ay) * (zy - ay)) as len from s),
  g as (select *, coalesce(sum(len) over (partition by route order by n rows between unbounded preceding and 1 preceding), 0) as start from l),
  k as (select *, unnest(generate_series(ceil(start / 500.0)::bigint, floor((start + len) / 500.0)::bigint)) as k from g),
  q as (select distinct round(ax + (zx - ax) * case when len > 0 then (k * 500.0::double - start) / len else 0 end) as x,
    round(ay + (zy - ay) * case when len > 0 then (k * 500.0::double - start) / len else 0 end) as y from k),
  h as ({_near_line("q", 250.0)}) select x, y, array_to_string(list_sort(list_distinct(list(route))), '') as routes from h group by 1, 2""")
def route_points(spark, sf_dir):
    """Points every 500 m along all customers' routes with the routes within 250 m of them."""
    return spatial.route_points(lines(spark, sf_dir), 500.0)


@query(f"with {OBS} select event_id, round(latitude, 8) as latitude, round(longitude, 8) as longitude from obs")
def lat_lon_back(spark, sf_dir):
    """Positions in metres projected back: the latitudes and longitudes they came from."""
    e, n = geo.utm(F.col("latitude"), F.col("longitude"))
    lat, lon = geo.utm_inverse(F.col("e"), F.col("n"))
    rows = obs(spark, sf_dir).select("event_id", e.alias("e"), n.alias("n"))
    return rows.select("event_id", F.round(lat, 8).alias("latitude"), F.round(lon, 8).alias("longitude"))


_HYBRID = [(k, 20.0 * (k - 1) * (9 - k), (1 - (k - 1) / 8) ** 2) for k in range(1, 9)]
_TARGETS = [100.0, 300.0, 500.0, 700.0, 850.0]


@query(f"""with c(level, a, b) as (values {", ".join(f"({k}, {a}::double, {b}::double)" for k, a, b in _HYBRID)}),
  m as (select c.level, (c.a + d.a) / 2 as a, (c.b + d.b) / 2 as b from c join c d on d.level = c.level + 1),
  f as (select l_orderkey as k, m.a + m.b * (900 + l_orderkey % 200) as p, min(l_quantity::double) as v from lineitem join m on l_linenumber = m.level group by 1, 2),
  w as (select *, lead(p) over o as q, lead(v) over o as w, row_number() over o as i from f window o as (partition by k order by p))
  select k as order_key, t as target, round(case when t = p then v else v + (w - v) * ln(t / p) / ln(q / p) end, 6) as value
  from w, (values {", ".join(f"({t}::double)" for t in _TARGETS)}) g(t) where t > p and t <= q or i = 1 and t = p""")
def pressure_levels(spark, sf_dir):
    """Orders as columns of a model whose lines are levels: quantities at given pressures."""
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as order_key", "l_linenumber as level", "double(900 + l_orderkey % 200) as surface", "double(l_quantity) as value")
    rows = levels.with_pressure(rows, spark.createDataFrame(_HYBRID, "level long, a double, b double"))
    return levels.at_pressures(rows, ["order_key"], _TARGETS).select("order_key", "target", r6("value"))
