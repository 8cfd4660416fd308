"""Temporal URL list join (operator 5), DataFrame functions only.

A list is a history of dated events: (entry, action, day, category), action ``add`` or
``remove``.  ``intervals`` turns it into half-open validity intervals [from_day, to_day).  An
as-of join finds, for each (entry, day) asked for, the latest interval that began at or before the
day; it counts if it has not ended.  An entry matches its own host and every host below it.  Of
several active entries the longest wins.

Only distinct (host, day) pairs meet the list, so a host with a large part of all captures
costs as many rows as it has days; of the entries above a host only listed ones are asked for,
once for each day.  The join is one sort of questions and interval starts by entry and day, with the
last start carried forward, so an entry with a long history costs its length and not its square.
The verdicts go back to the captures by an equi-join that adaptive execution can split.  Page
bodies are not read.

Edge cases: a null, blank or host-less URL, or a null day, gives host ``''`` or no match, never
an error; letter case, port, user info and a final dot of a host do not matter, nor do letter case and
a final dot of an entry, which are dropped before events are put in order; an event with a
null entry, action or day is void; of several events of an entry on one day the last in the
order add < remove (then the highest category) holds; repeated captures keep their own rows; an
empty list blocks nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENTS = "entry string, action string, day date, category string"


def host_of(url: Column) -> Column:
    authority = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\s]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    return F.coalesce(F.regexp_replace(F.lower(bare), r"\.+$", ""), F.lit(""))


def intervals(events: DataFrame) -> DataFrame:
    """entry, category, from_day, to_day (null: still active) from a history of events."""
    valid = events.dropna(subset=["entry", "action", "day"]).where(F.col("action").isin("add", "remove"))
    valid = valid.withColumn("entry", F.regexp_replace(F.lower("entry"), r"\.+$", ""))
    last = Window.partitionBy("entry", "day").orderBy(F.desc("action"), F.desc_nulls_last("category"))
    daily = valid.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    following = F.lead("day").over(Window.partitionBy("entry").orderBy("day"))
    return (
        daily.withColumn("to_day", following)
        .where("action = 'add'")
        .select("entry", "category", F.col("day").alias("from_day"), "to_day")
    )


def active_at(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """As-of join: (entry, day) of ``asked`` with the category and from_day of the interval active then."""
    begun = F.struct("from_day", "to_day", "category")
    starts = spans.select("entry", F.col("from_day").alias("day"), begun.alias("span"))
    questions = asked.select("entry", "day", F.lit(None).cast(starts.schema["span"].dataType).alias("span"))
    # A start on the day itself comes before the question.
    order = Window.partitionBy("entry").orderBy("day", F.col("span").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    carried = starts.unionByName(questions).withColumn("at", F.last("span", ignorenulls=True).over(order))
    return carried.where("span is null and at is not null and (at.to_day is null or day < at.to_day)").select(
        "entry", "day", F.col("at.category").alias("category"), F.col("at.from_day").alias("from_day")
    )


def suffixes(host: Column) -> Column:
    """The host and all domains above it: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def temporal_list_join(captures: DataFrame, events: DataFrame) -> DataFrame:
    """page_id, host, day and verdict of each capture (page_id, url, day)."""
    rows = captures.select("page_id", host_of(F.col("url")).alias("host"), F.col("day").cast("date").alias("day"))
    pairs = rows.where("host <> '' and day is not null").select("host", "day").distinct()
    spans = intervals(events)
    above = pairs.withColumn("entry", F.explode(suffixes(F.col("host")))).join(spans.select("entry").distinct(), "entry")
    active = above.join(active_at(above.select("entry", "day").distinct(), spans), ["entry", "day"])
    best = lambda c: F.max_by(c, F.length("entry"))
    verdicts = active.groupBy("host", "day").agg(
        F.count("*").alias("n_active"),
        best("entry").alias("entry"),
        best("category").alias("category"),
        best("from_day").alias("active_since"),
    )
    return rows.join(verdicts, ["host", "day"], "left").select(
        "page_id",
        "host",
        "day",
        F.coalesce("n_active", F.lit(0)).alias("n_active"),
        "entry",
        "category",
        "active_since",
        F.col("n_active").isNotNull().alias("blocked"),
    )


# The production list of the query: fixed entries, and a history derived by rule from the hosts.
#: Fixed values: (entry, action, day, category).
FIXED_EVENTS = [
    ("cheap-pills.example.com", "add", "2024-02-01", "spam"),
    ("example.net", "add", "2024-05-01", "parked"),
    ("example.net", "remove", "2024-06-15", "parked"),
    ("spam-farm.example.org", "add", "2024-01-10", "spam"),
    ("spam-farm.example.org", "remove", "2024-03-01", "spam"),
    ("Spam-Farm.example.org", "add", "2024-03-20", "spam"),
]

_FIXED_SQL = ", ".join(f"('{e}', '{a}', date '{d}', '{c}')" for e, a, d, c in FIXED_EVENTS)


def listed_history(pages: DataFrame) -> DataFrame:
    """Dated events for a quarter of the hosts of ``pages``, by the digits of their MD5, and the fixed ones."""
    spark: SparkSession = pages.sparkSession
    hosts = pages.select(host_of(F.col("url")).alias("entry")).where("entry <> ''").distinct()
    digit = lambda k: F.expr(f"instr('0123456789abcdef', substr(md5(entry), {k}, 1)) - 1")
    dated = hosts.withColumns({"d1": digit(1), "d2": digit(2), "d3": digit(3)}).where("d1 < 4")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("d2") * 16 + F.col("d3")).cast("int"))
    event = lambda action, days: dated.select(
        "entry", F.lit(action).alias("action"), F.date_add(start, days).alias("day"), F.concat(F.lit("list"), "d1").alias("category")
    )
    fixed = spark.sql(f"select * from values {_FIXED_SQL} as f(entry, action, day, category)")
    return fixed.unionByName(
        event("add", 0).unionByName(event("remove", 45)).unionByName(event("add", 90))
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """page_id, url and the day of the fetch, which the table lacks: day page_id mod 365 of 2024."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int"))
    return pages.select("page_id", "url", day.alias("day"))


ORACLE_SQL = f"""
with caps as (
  select page_id, cast(date '2024-01-01' + cast(page_id % 365 as integer) as date) as day,
    coalesce(regexp_replace(lower(regexp_replace(regexp_replace(
      regexp_extract(url, '^\\s*[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#\\s]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '\\.+$', ''), '') as host
  from pages),
dated as (
  select entry, instr('0123456789abcdef', substr(md5(entry), 1, 1)) - 1 as d1,
    (instr('0123456789abcdef', substr(md5(entry), 2, 1)) - 1) * 16 + instr('0123456789abcdef', substr(md5(entry), 3, 1)) - 1 as n
  from (select distinct host as entry from caps where host <> '')),
events as (
  select * from (values {_FIXED_SQL}) as f(entry, action, day, category)
  union all
  select entry, e.action, cast(date '2024-01-01' + cast(n + e.days as integer) as date), 'list' || d1
  from dated, (values ('add', 0), ('remove', 45), ('add', 90)) as e(action, days) where d1 < 4),
daily as (
  select * replace (regexp_replace(lower(entry), '\\.+$', '') as entry) from events
  qualify row_number() over (partition by regexp_replace(lower(entry), '\\.+$', ''), day order by action desc, category desc nulls last) = 1),
spans as (
  select entry, category, day as from_day, action, lead(day) over (partition by entry order by day) as to_day from daily),
active as (
  select c.host, c.day, s.* exclude (action)
  from (select distinct host, day from caps where host <> '' and day is not null) c
  join spans s on (c.host = s.entry or ends_with(c.host, '.' || s.entry))
    and s.action = 'add' and s.from_day <= c.day and (s.to_day is null or c.day < s.to_day)),
verdicts as (
  select host, day, count(*) as n_active, arg_max(entry, length(entry)) as entry,
    arg_max(category, length(entry)) as category, arg_max(from_day, length(entry)) as active_since
  from active group by host, day)
select c.page_id, c.host, cast(c.day as varchar) as day, coalesce(v.n_active, 0) as n_active, v.entry, v.category,
  cast(v.active_since as varchar) as active_since,
  v.n_active is not null as blocked
from caps c left join verdicts v on c.host = v.host and c.day = v.day
"""
