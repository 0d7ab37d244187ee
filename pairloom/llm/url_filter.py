"""URL filters as a temporal list join, in DataFrame functions only.

Dated entries (list, kind, pattern, action, since) become validity intervals: an ``add`` opens one that ends at the next
entry of the same list, kind and pattern. Kinds: ``host`` (that host), ``domain`` (it and all below it), ``prefix`` (URLs
whose host and path start so). Every distinct visit (host, path, time) asks for the keys that may concern it: its host, the
host's suffixes, and its own beginnings of those lengths that prefixes of its host have. An as-of join then finds the last
interval of each list, kind and key that began at or before the visit: intervals and visits are sorted by time together,
and a window carries the last interval on. Keys with many visits are dealt into parts that each see the key's intervals, so
that no key, host or list gathers in one task. An active ``allow`` entry lets a capture pass, else an active ``block``
entry blocks it.

Cases: a null or blank URL has host '' and matches nothing; URLs without scheme, with user, port, upper case or a final
dot are read as browsers do; a null fetch time matches nothing; of entries at one instant ``remove`` wins; repeated
entries and captures are kept apart or merged without effect on decisions; an empty list passes everything; an empty
table gives an empty table; input columns named like an output are replaced by it, others, whatever their names, are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed_row, row_columns

#: Visits of one key that meet in a task.
PART_VISITS = 100_000


def host_of(url: Column) -> Column:
    rest = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))


def path_of(url: Column) -> Column:
    rest = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, since, until) of every span in which an entry is active; until is null while it lasts."""
    key = ["list", "kind", "pattern"]
    # of several entries at one instant, 'remove' is the greatest action
    once = entries.groupBy(*key, "since").agg(F.max("action").alias("action"))
    after = F.lead("since").over(Window.partitionBy(*key).orderBy("since"))
    return once.withColumn("until", after).filter("action = 'add'").select(*key, "since", "until")


def keys_of(visits: DataFrame, spans: DataFrame) -> DataFrame:
    """(host, full, time, kind, key) for every key of ``visits`` (host, full, time) that an entry might have."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")))
    own = F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("key")))
    prefixes = spans.filter("kind = 'prefix'").select(F.regexp_extract("pattern", r"^([^/]*)", 1).alias("host"), F.length("pattern").alias("n"))
    lengths = prefixes.groupBy("host").agg(F.collect_set("n").alias("lengths"))  # at most as many as a URL has characters
    fitting = F.filter(F.coalesce("lengths", F.array().cast("array<int>")), lambda n: n <= F.length("full"))
    begins = F.transform(fitting, lambda n: F.struct(F.lit("prefix").alias("kind"), F.substring(F.col("full"), F.lit(1), n).alias("key")))
    joined = visits.join(lengths, "host", "left").select("host", "full", "time", F.explode(F.concat(own, suffixes, begins)).alias("k"))
    return joined.select("host", "full", "time", "k.kind", "k.key")


def active_entries(visits: DataFrame, entries: DataFrame) -> DataFrame:
    """(host, full, time, names) of those distinct ``visits`` at whose time an entry is active; names are sorted."""
    spans = intervals(entries).filter("pattern is not null and since is not null").withColumnRenamed("pattern", "key")
    listed = spans.select("list", "kind", "key").distinct()
    asked = keys_of(visits, spans.withColumnRenamed("key", "pattern")).join(listed, ["kind", "key"])
    parts = asked.groupBy("list", "kind", "key").agg(F.ceil(F.count(F.lit(1)) / PART_VISITS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("host", "full", "time"), F.col("parts")).cast("int")
    asked = asked.join(parts, ["list", "kind", "key"])
    probes = asked.select("list", "kind", "key", part.alias("part"), F.col("time").alias("at"), F.lit(1).alias("probe"), F.struct("host", "full", "time").alias("visit"), F.lit(None).cast(_span(spans)).alias("span"))
    began = spans.join(parts, ["list", "kind", "key"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    began = began.select("list", "kind", "key", "part", F.col("since").alias("at"), F.lit(0).alias("probe"), F.lit(None).cast(probes.schema["visit"].dataType).alias("visit"), F.struct("since", "until").alias("span"))
    order = Window.partitionBy("list", "kind", "key", "part").orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, 0)
    latest = probes.unionByName(began).withColumn("span", F.last("span", ignorenulls=True).over(order)).filter("probe = 1 and span is not null")
    holds = latest.filter(F.col("span.until").isNull() | (F.col("visit.time") < F.col("span.until")))
    name = F.concat_ws(":", "list", "kind", "key")
    return holds.groupBy("visit.host", "visit.full", "visit.time").agg(F.array_sort(F.collect_set(name)).alias("names"))


def _span(spans: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(c, spans.schema[c].dataType) for c in ("since", "until")])


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """``captures`` with host, active (the entries active at fetch time, as sorted 'list:kind:pattern') and decision:
    'allow', 'block' or 'pass'."""
    rest = [c for c in captures.columns if c not in ("host", "active", "decision")]
    url = F.col(f"`{url_col}`")
    marked = captures.select(packed_row(captures, rest), host_of(url).alias("host"), F.concat(host_of(url), path_of(url)).alias("full"), F.col(f"`{time_col}`").alias("time"))
    visits = marked.filter("host <> '' and time is not null").select("host", "full", "time").distinct()
    judged = marked.join(active_entries(visits, entries), ["host", "full", "time"], "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    has = lambda name: F.exists(names, lambda x: x.startswith(f"{name}:"))
    decision = F.when(has("allow"), "allow").when(has("block"), "block").otherwise("pass")
    return judged.select(*row_columns(rest), "host", names.alias("active"), decision.alias("decision"))


#: The test tables have neither fetch times nor a list. A capture is given a day of 2024 by its id, and every host, by
#: the hexadecimal digits of its MD5 sum, entries of the lists; both sides of the check use the same rules.
_DIGIT = "(strpos('0123456789abcdef', substr(md5(host), {n}, 1)) - 1)"
_DIGIT_SPARK = "(instr('0123456789abcdef', substr(md5(host), {n}, 1)) - 1)"


def _entries_sql(source: str, digit: str) -> str:
    d = {n: digit.format(n=n) for n in range(1, 6)}
    start = f"({d[2]} * 12)"
    end = f"({d[2]} * 12 + 20 + {d[3]} * 8)"
    kind = f"case {d[1]} % 4 when 0 then 'host' when 1 then 'domain' else 'prefix' end"
    pattern = f"case {d[1]} % 4 when 0 then host when 1 then regexp_replace(host, '^(m|www|blog)[.]', '') else concat(host, '/en/') end"
    parts = [
        f"select 'block' as list, {kind} as kind, {pattern} as pattern, 'add' as action, {start} as day from {source} where {d[1]} % 4 < 3",
        f"select 'block', {kind}, {pattern}, 'remove', {end} from {source} where {d[1]} % 4 < 3 and {d[4]} < 10",
        f"select 'block', {kind}, {pattern}, 'add', {end} + 30 from {source} where {d[1]} % 4 < 3 and {d[4]} < 5",
        f"select 'allow', 'host', host, 'add', {start} + 15 from {source} where {d[5]} < 3",
    ]
    return " union all ".join(parts)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every capture of ``pages`` against dated lists as of its fetch day."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched_at", (F.col("page_id") * 37 % 366).cast("int"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    entries = spark.sql(_entries_sql("{hosts}", _DIGIT_SPARK), hosts=hosts).withColumnRenamed("day", "since")
    judged = evaluate(captures, entries)
    return judged.select("page_id", "host", "fetched_at", F.array_join("active", " ").alias("active"), "decision")


ORACLE = f"""
with captures as (
  select page_id, cast(page_id * 37 % 366 as integer) as fetched_at,
    regexp_replace(trim(coalesce(url, '')), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as rest from pages),
named as (
  select page_id, fetched_at, rest,
    lower(regexp_replace(regexp_replace(regexp_extract(rest, '^([^/?#]*)', 1), '^.*@', ''), '[.]?(:[0-9]*)?$', '')) as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from captures),
hosts as (select distinct host from named where host <> ''),
entries as (select list, kind, pattern, day as since, max(action) as action from ({_entries_sql('hosts', _DIGIT)}) group by list, kind, pattern, day),
spans as (
  select list, kind, pattern, since, until from (
    select *, lead(since) over (partition by list, kind, pattern order by since) as until from entries) where action = 'add'),
hits as (
  select distinct n.page_id, s.list, s.kind, s.pattern from named n join spans s
  on s.since <= n.fetched_at and (s.until is null or n.fetched_at < s.until)
  and ((s.kind = 'host' and n.host = s.pattern)
    or (s.kind = 'domain' and (n.host = s.pattern or ends_with(n.host, concat('.', s.pattern))))
    or (s.kind = 'prefix' and starts_with(concat(n.host, n.path), s.pattern) and n.host = regexp_extract(s.pattern, '^([^/]*)', 1)))
  where n.host <> ''),
found as (
  select page_id, string_agg(concat(list, ':', kind, ':', pattern), ' ' order by concat(list, ':', kind, ':', pattern)) as active,
    bool_or(list = 'allow') as allowed from hits group by page_id)
select n.page_id, n.host, n.fetched_at, coalesce(f.active, '') as active,
  case when f.page_id is null then 'pass' when f.allowed then 'allow' else 'block' end as decision
from named n left join found f on n.page_id = f.page_id
"""
