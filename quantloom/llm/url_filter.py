"""URL filtering by dated list entries: validity intervals and an as-of join, in DataFrame operations only.

A list is a table of events (key, category, action 'add' or 'remove', day). A key is a host or one of its parent
domains, optionally followed by a path prefix that ends at a slash. For each key and category the event sequence
becomes validity intervals: from an 'add' to the next event of that key and category, or for ever. A capture is judged
by the entries whose interval holds its fetch day, [from, until), over all keys that its URL answers to.

Captures ask for each listed key that their URL answers to. The as-of join takes each distinct (key, day) of these
questions once, whatever the number of captures behind it: questions and intervals of a key and category are put in one
order of days, and each question takes the last interval begun. A hot host asks at most one question a key and day, so no
task of the join grows with its captures. The answers, one for each key and day with an active entry, then meet the
captures. Lists of at most ``broadcast_keys`` keys, counted first, are broadcast to find the listed keys; longer ones are
shuffled. A capture's keys reach down to its full depth, or to the greatest depth in the list if that is less.

Defined cases: a NULL or unparsable URL or a NULL day is matched by nothing and kept (blocked = false); repeated
events count once; several events of a key and category on one day: 'remove' wins; NULL keys or days in the list are
ignored; an empty list blocks nothing; repeated captures are each judged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.base import read_table


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or trailing dots; NULL if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path of a URL without query and fragment, beginning with a slash."""
    return F.concat(F.lit("/"), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1))


def keys_of(url: Column, deepest: int | None = None, root: bool = False) -> Column:
    """All list keys that a URL answers to: its host and parent domains, alone and with each path prefix.

    Prefixes of more than ``deepest`` folders are left out, as the caller knows that no list key has more; ``root`` adds
    the bare slash.
    """
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    hosts = F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(F.array(host_of(url)))
    steps = F.split(path_of(url), "/")
    depth, least = F.size(steps) - 2, F.lit(0 if root else 1)
    depth = depth if deepest is None else F.least(depth, F.lit(deepest))
    prefixes = F.when(depth >= least, F.transform(F.sequence(least, F.greatest(depth, least)), lambda i: F.concat(F.array_join(F.slice(steps, F.lit(1), i + 1), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    ends = F.concat(F.array(F.lit("")), prefixes)
    return F.when(host_of(url).isNotNull(), F.flatten(F.transform(hosts, lambda h: F.transform(ends, lambda e: F.concat(h, e)))))


def validity(events: DataFrame) -> DataFrame:
    """(key, category, valid_from, valid_until) from dated add and remove events; valid_until NULL means open."""
    daily = (
        events.filter(F.col("key").isNotNull() & F.col("day").isNotNull())
        .groupBy("key", "category", "day")
        .agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("removed"))
    )
    following = F.lead("day").over(Window.partitionBy("key", "category").orderBy("day"))
    return daily.withColumn("valid_until", following).filter("removed = 0").select("key", "category", F.col("day").alias("valid_from"), "valid_until")


def active_entries(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, day, category) of the distinct (key, day) of asked at which an entry is active; category: the first one.

    The as-of join: in the order of days, each question takes the last interval of its key and category begun by then.
    """
    none = F.lit(None).cast("date")
    questions = asked.join(spans.select("key", "category").distinct(), "key").select("key", "category", "day", none.alias("begun"), none.alias("until"))
    begins = spans.select("key", "category", F.col("valid_from").alias("day"), F.col("valid_from").alias("begun"), F.col("valid_until").alias("until"))
    order = Window.partitionBy("key", "category").orderBy("day", F.col("begun").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("begun").isNotNull(), F.struct("begun", "until")), ignorenulls=True).over(order)
    as_of = questions.unionByName(begins).withColumn("last", last).filter("begun is null and last is not null and (last.until is null or day < last.until)")
    return as_of.groupBy("key", "day").agg(F.min("category").alias("category"))


def filter_captures(captures: DataFrame, events: DataFrame, *, id_col: str, url_col: str = "url", day_col: str = "day", broadcast_keys: int = 50_000) -> DataFrame:
    """(id, url, day, blocked, n_active, key, category) for each capture; key: the longest active one, then the first category."""
    spans = validity(events)
    folders = F.length("key") - F.length(F.replace("key", F.lit("/"))) - 1
    listed = spans.select("key").distinct()
    facts = listed.agg(F.count("*").alias("keys"), F.max(folders).alias("deepest"), F.max(F.col("key").endswith("/") & (folders == 0)).alias("root")).first()
    if facts["keys"] <= broadcast_keys:
        listed = F.broadcast(listed)
    base = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(day_col).alias("_day"))
    keys = base.filter("_day is not null").withColumn("key", F.explode(keys_of(F.col("_url"), max(facts["deepest"] or 0, 0), bool(facts["root"]))))
    asked = keys.join(listed, "key", "left_semi")
    answers = active_entries(asked.select("key", F.col("_day").alias("day")).distinct(), spans).withColumnRenamed("day", "_day")
    top = F.struct(F.length("key").alias("long"), F.col("key"), F.col("category").alias("c"))
    met = asked.join(answers, ["key", "_day"])
    hits = met.groupBy("_id", "_url", "_day").agg(F.max(top).alias("best"), F.count_distinct("key").alias("n_active"))
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("_id", "_url", "_day")]
    return base.alias("b").join(hits.alias("h"), same[0] & same[1] & same[2], "left").select(
        F.col("b._id").alias(id_col),
        F.col("b._url").alias("url"),
        F.col("b._day").alias("day"),
        F.col("h.best").isNotNull().alias("blocked"),
        F.coalesce("h.n_active", F.lit(0)).cast("long").alias("n_active"),
        F.col("h.best.key").alias("key"),
        F.col("h.best.c").alias("category"),
    )


def sample_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day made from the id, as the table has none."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int")).alias("day"))


def sample_events(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the pages, made from the md5 of each host by fixed rules."""
    number = lambda c: F.conv(F.substring(F.md5(c.cast("binary")), 1, 6), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    event = lambda when, key, category, action, n: F.when(when, F.struct(key.alias("key"), F.lit(category).alias("category"), F.lit(action).alias("action"), day(n).alias("day")))
    hosts = pages.select(host_of(F.col("url")).alias("h")).filter("h is not null").distinct().withColumn("x", number(F.col("h")))
    h, x = F.col("h"), F.col("x")
    rows = F.array(
        event(x % 4 == 0, h, "spam", "add", x % 120),
        event(x % 4 == 0, h, "spam", "remove", 120 + x % 60),
        event(x % 4 == 0, h, "spam", "add", 240 + x % 90),
        event(x % 5 == 1, h, "malware", "add", x % 200),
        event(x % 7 == 2, F.concat(h, F.lit("/de/")), "section", "add", x % 100),
        event(x % 7 == 2, F.concat(h, F.lit("/de/")), "section", "remove", 150 + x % 100),
    )
    domains = hosts.select(F.substring_index("h", ".", -2).alias("h")).distinct().withColumn("x", number(F.col("h")))
    of_domain = domains.select(F.array(event(F.lit(True), h, "bulk", "add", 300 + x % 30)).alias("e"))
    return hosts.select(rows.alias("e")).unionByName(of_domain).select(F.inline(F.filter("e", lambda e: e.isNotNull())))


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages").select("page_id", "url")
    judged = filter_captures(sample_captures(pages), sample_events(pages), id_col="page_id")
    return judged.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


ORACLE = r"""
with captures as (
  select page_id, url, date '2024-01-01' + cast(page_id * 37 % 366 as integer) as day,
         nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '') as h,
         '/' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1) as p
  from pages),
hosts as (select h, ('0x' || substr(md5(h), 1, 6))::int as x from (select distinct h from captures where h is not null)),
domains as (select h, ('0x' || substr(md5(h), 1, 6))::int as x
  from (select distinct regexp_extract(h, '([^.]+[.])?[^.]+$') as h from hosts)),
events as (
  select h as kh, '' as kp, 'spam' as category, 'add' as action, date '2024-01-01' + x % 120 as day from hosts where x % 4 = 0
  union all select h, '', 'spam', 'remove', date '2024-01-01' + (120 + x % 60) from hosts where x % 4 = 0
  union all select h, '', 'spam', 'add', date '2024-01-01' + (240 + x % 90) from hosts where x % 4 = 0
  union all select h, '', 'malware', 'add', date '2024-01-01' + x % 200 from hosts where x % 5 = 1
  union all select h, '/de/', 'section', 'add', date '2024-01-01' + x % 100 from hosts where x % 7 = 2
  union all select h, '/de/', 'section', 'remove', date '2024-01-01' + (150 + x % 100) from hosts where x % 7 = 2
  union all select h, '', 'bulk', 'add', date '2024-01-01' + (300 + x % 30) from domains),
daily as (select kh, kp, category, day, max(case when action = 'remove' then 1 else 0 end) as removed from events group by all),
spans as (select * from (select *, lead(day) over (partition by kh, kp, category order by day) as until from daily) where removed = 0),
met as (
  select c.page_id, c.url, c.day, s.kh || s.kp as key, s.category
  from captures c join spans s
    on (c.h = s.kh or ends_with(c.h, '.' || s.kh)) and (s.kp = '' or starts_with(c.p, s.kp))
   and s.day <= c.day and (s.until is null or c.day < s.until)),
ranked as (select *, row_number() over (partition by page_id, url, day order by length(key) desc, key desc, category) as r,
  count(*) over (partition by page_id, url, day) as n from met),
hits as (select page_id, url, day, key, category from ranked where r = 1),
counted as (select page_id, url, day, count(distinct key) as n_active from met group by all)
select c.page_id, c.url, strftime(c.day, '%Y-%m-%d') as day, h.key is not null as blocked, cast(coalesce(n.n_active, 0) as bigint) as n_active, h.key, h.category
from captures c
left join hits h on h.page_id = c.page_id and h.url = c.url and h.day = c.day
left join counted n on n.page_id = c.page_id and n.url = c.url and n.day = c.day
"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_url_filter": op7_url_filter}
ORACLES: dict[str, str] = {"op7_url_filter": ORACLE}
