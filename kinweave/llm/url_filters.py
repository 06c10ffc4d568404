"""URL filters by a temporal list join, in DataFrame operations only.

Lists are dated entries (list, kind, pattern, action, since): from ``since`` on, ``pattern`` is on the list, or is off it
again. lead() turns them into intervals that don't overlap. A capture has a few patterns that could name it (its host, the
domains above it, and host plus first path segment); each is joined to the intervals of that pattern that hold its fetch time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lists of at most so many intervals are sent to all executors; longer ones are joined by shuffling.
BROADCAST_ROWS = 100_000
ENTRIES = "list string, kind string, pattern string, action string, since date"
#: A small list to begin with; any table of these columns can stand for it.
DEFAULT_ENTRIES = [
    ("spam", "block", "spam-farm.example.org", "add", "2024-02-01"),
    ("spam", "block", "cheap-pills.example.com", "add", "2023-06-01"),
    ("spam", "block", "cheap-pills.example.com", "remove", "2024-05-01"),
    ("spam", "block", "cheap-pills.example.com", "add", "2024-08-15"),
    ("gambling", "block", "casino-win.example.org", "add", "2024-01-15"),
    ("gambling", "block", "free-bets.example.com", "add", "2024-03-10"),
    ("gambling", "block", "free-bets.example.com", "remove", "2024-11-01"),
    ("ads", "block", "ads-track.example.org", "add", "2023-01-01"),
    ("trusted", "allow", "ads-track.example.org/de", "add", "2024-04-01"),
]


def default_entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_ENTRIES, "list string, kind string, pattern string, action string, since string").withColumn("since", F.to_date("since"))


def number(text: Column) -> Column:
    """A number that stands for a text: the first 32 bits of its digest."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def watched_entries(captures: DataFrame) -> DataFrame:
    """A long list, made of the captures' own hosts and first path segments by their digests, where no table of entries is at hand.

    A fifth of the hosts is blocked from some day of 2024 on; half of these are removed 60 days later, and half of those are
    added again 120 days after the first day. A third of the paths below a host is allowed from some day on.
    """
    parts = url_parts(captures.select("url").distinct()).where("host <> ''")
    hosts = parts.select(F.col("host").alias("pattern")).distinct().withColumn("k", number(F.col("pattern")))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("k") % 200).cast("int"))
    steps = F.array(*(F.struct(F.lit(action).alias("action"), F.date_add(day, later).alias("since"), F.lit(each).alias("each")) for action, later, each in (("add", 0, 5), ("remove", 60, 10), ("add", 120, 20))))
    blocked = hosts.select("pattern", "k", F.inline(steps)).where(F.col("k") % F.col("each") == 0).select(F.lit("watch").alias("list"), F.lit("block").alias("kind"), "pattern", "action", "since")
    paths = parts.where(F.size("candidates") > 0).select(F.explode("candidates").alias("pattern"), "host").where(F.col("pattern").startswith(F.concat("host", F.lit("/")))).select("pattern").distinct().withColumn("k", number(F.col("pattern")))
    allowed = paths.where(F.col("k") % 3 == 0).select(F.lit("trusted").alias("list"), F.lit("allow").alias("kind"), "pattern", F.lit("add").alias("action"), day.alias("since"))
    return blocked.unionByName(allowed)


def intervals(entries: DataFrame) -> DataFrame:
    """list, kind, pattern, since, until (null: still open). Of entries of one day, a removal stands; entries with nulls don't count."""
    rows = entries.select("list", "kind", F.lower("pattern").alias("pattern"), "action", "since").dropna()
    days = rows.groupBy("list", "kind", "pattern", "since").agg(F.max("action").alias("action"))  # remove > add
    following = F.lead("since").over(Window.partitionBy("list", "kind", "pattern").orderBy("since"))
    return days.withColumn("until", following).where(F.col("action") == "add").drop("action")


def url_parts(captures: DataFrame) -> DataFrame:
    """captures with host and candidates, an array of patterns that could name the URL."""
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    segment = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)
    rows = captures.withColumns({"host": host, "segment": F.lower(segment)}).withColumn("labels", F.split("host", r"\."))
    above = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("labels") - 1, F.lit(1))),
        lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."),
    )
    names = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(above)
    rows = rows.withColumn("names", names)
    paths = F.when(F.col("segment") == "", F.array().cast("array<string>")).otherwise(F.transform("names", lambda x: F.concat(x, F.lit("/"), F.col("segment"))))
    return rows.withColumn("candidates", F.array_distinct(F.concat("names", paths))).drop("labels", "names", "segment")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, host, fetched_on, lists (sorted array of lists that name the capture), entry (the deciding pattern), blocked.

    captures(page_id, url, fetched_on date). The longest active pattern decides, and of equal ones an allowing entry. A null
    URL, or one without a host, has host '' and is on no list, nor is a capture without a date. Repeated rows stay repeated.
    Very long URLs are taken whole; other columns are not read; an empty table gives an empty one, and empty lists block nothing.
    """
    rows = captures.select("page_id", "url", "fetched_on").withColumn("capture", F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce(F.col("fetched_on").cast("string"), F.lit(""))))
    # a URL fetched twice on a day is looked up once
    wanted = url_parts(rows.groupBy("capture").agg(F.first("url").alias("url"), F.first("fetched_on").alias("fetched_on"))).select("capture", "fetched_on", F.explode("candidates").alias("pattern"))
    active = intervals(entries)
    if active.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        active = F.broadcast(active)
    on = (wanted.pattern == active.pattern) & (wanted.fetched_on >= active.since) & (active.until.isNull() | (wanted.fetched_on < active.until))
    found = wanted.join(active, on).select(wanted.capture, "list", "kind", wanted.pattern)
    best = F.max(F.struct(F.length("pattern").alias("n"), (F.col("kind") == "allow").alias("allow"), F.col("pattern").alias("pattern")))
    verdict = found.groupBy("capture").agg(F.sort_array(F.collect_set("list")).alias("lists"), best.alias("best"))
    out = rows.join(verdict, "capture", "left")
    host = url_parts(out).select("page_id", "url", "host", "fetched_on", "lists", "best")
    return host.select(
        "page_id", "url", "host", "fetched_on", F.coalesce("lists", F.array().cast("array<string>")).alias("lists"), F.col("best.pattern").alias("entry"), F.coalesce(~F.col("best.allow"), F.lit(False)).alias("blocked")
    )
