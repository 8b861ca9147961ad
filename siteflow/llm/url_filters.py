"""URL filters over time: dated list entries become validity intervals, captures are judged as of their fetch.

Entries say that a key (a host, a site or a path prefix) is put on or taken off a list at some time. Per key they turn
into the moments at which the key's state changes, the ends of its intervals [on, off). A capture meets the last moment at
or before its fetch: of its own hour, whose moments lie in one row of a key and hour (3,600 at most), or else the last one of the
hours before, which that row carries. So one equality join a list judges all captures, no row holds more than an hour's moments,
windows order a key's hours and not its entries or captures, and a hot key is only a hot side of the captures, which adaptive execution can split.

A site is the registered name: two labels, or three where the last two are a general label under a country's.

Ties: at one moment, an `add` outweighs a `remove`. Nulls: a capture without a URL or time is not blocked; entries
without key or time are ignored. Repeated captures are judged alike; empty tables give no rows. Extra columns of the
captures are dropped, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LISTS = ["host", "site", "prefix"]
HOUR = 3600
SITE = r"([^.]+\.(?:(?:ac|co|com|edu|gov|net|org)\.[a-z][a-z]|[^.0-9]+))$"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def keys_of(url: Column) -> dict[str, Column]:
    """The key of a URL in each list; empty where there is none."""
    host = host_of(url)
    first = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)
    return {
        "host": host,
        "site": F.regexp_extract(host, SITE, 1),
        "prefix": F.when((host == "") | (first == ""), F.lit("")).otherwise(F.concat(host, F.lit("/"), first)),
    }


def hour_of(seconds: Column) -> Column:
    return F.floor(seconds / HOUR).cast("long")


def changes(entries: DataFrame) -> DataFrame:
    """list, key, hour, at, listed: the moments at which a key's state changes. entries: list, key, action, effective_at (long seconds).

    Entries of one moment are reduced to one, and the state before an hour is the last one of the key's hours before, both with map-side
    combines; then every moment looks at the one before within its hour.
    """
    known = entries.where((F.col("key") != "") & F.col("effective_at").isNotNull())
    moments = known.groupBy("list", "key", F.col("effective_at").cast("long").alias("at")).agg(F.max(F.col("action") == "add").alias("listed")).withColumn("hour", hour_of(F.col("at")))
    hours = moments.groupBy("list", "key", "hour").agg(F.max(F.struct("at", "listed")).alias("last"))
    before = Window.partitionBy("list", "key").orderBy("hour")
    carried = hours.select("list", "key", "hour", F.coalesce(F.lag("last").over(before)["listed"], F.lit(False)).alias("carried"))
    of_hour = Window.partitionBy("list", "key", "hour").orderBy("at")
    was = F.coalesce(F.lag("listed").over(of_hour), F.col("carried"))
    return moments.join(carried, ["list", "key", "hour"]).withColumn("was", was).where("listed <> was").select("list", "key", "hour", "at", "listed")


def states(changed: DataFrame, asked: DataFrame) -> DataFrame:
    """key, hour, moments (an array of (at, listed) in that hour) and carried (the last one before), for every hour with changes or in asked (key, hour)."""
    own = changed.groupBy("key", "hour").agg(F.sort_array(F.collect_list(F.struct("at", "listed"))).alias("moments"))
    wanted = asked.join(own.select("key").distinct(), "key", "left_semi").select("key", "hour", F.lit(None).cast("array<struct<at:bigint,listed:boolean>>").alias("moments"))
    each = own.unionByName(wanted).groupBy("key", "hour").agg(F.max("moments").alias("moments"))
    before = Window.partitionBy("key").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("carried", F.last(F.element_at("moments", -1), ignorenulls=True).over(before))


def blocked(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, fetched_at, one flag per list, blocked, and since: start of the earliest entry that blocks (null: none)."""
    out = captures.select("page_id", "fetched_at", hour_of(F.col("fetched_at")).alias("hour"), *[k.alias(f"{name}_key") for name, k in keys_of(F.coalesce(F.col("url"), F.lit(""))).items()])
    changed = changes(entries)
    since = []
    for name in LISTS:
        asked = out.where(F.col("hour").isNotNull()).select(F.col(f"{name}_key").alias("key"), "hour").distinct()
        mine = states(changed.where(F.col("list") == name), asked).select(F.col("key").alias(f"{name}_key"), "hour", F.col("moments").alias(f"{name}_moments"), F.col("carried").alias(f"{name}_carried"))
        out = out.join(mine, [f"{name}_key", "hour"], "left")
        last = F.coalesce(F.array_max(F.filter(f"{name}_moments", lambda m: m["at"] <= F.col("fetched_at"))), F.col(f"{name}_carried"))
        since.append(F.when(last["listed"], last["at"]))
    judged = out.select("page_id", F.col("host_key").alias("host"), "fetched_at", *[s.alias(f"{n}_since") for n, s in zip(LISTS, since, strict=True)])
    starts = [F.col(f"{n}_since") for n in LISTS]
    return judged.select(
        "page_id", "host", "fetched_at", *[c.isNotNull().alias(f"{n}_listed") for n, c in zip(LISTS, starts, strict=True)],
        F.coalesce(*starts).isNotNull().alias("blocked"), F.least(*starts).alias("since"),
    )


START = 1_704_067_200  # 2024-01-01, UTC
DAY = 86_400


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages as captures: the table has no times, so each page gets one of 30 days from its id."""
    return pages.select("page_id", "url", (F.lit(START) + F.pmod(F.col("page_id") * 7919, F.lit(8640)) * 300).alias("fetched_at"))


def entries_of(captures: DataFrame) -> DataFrame:
    """Dated list entries that the captures themselves give; each takes effect at the start of the next day.

    A feed link lists its host, a paged link takes it off; an anchor link lists its path prefix, a plain .html link takes
    that off; an address under a bare host (no subdomain) with a trailing slash lists its site, a paged link takes it off.
    """
    keys = keys_of(F.coalesce(F.col("url"), F.lit("")))
    url = F.col("url")
    rules = [
        ("host", "add", url.contains("utm_source=")), ("host", "remove", url.contains("page=")),
        ("prefix", "add", url.endswith("#top")), ("prefix", "remove", url.endswith(".html")),
        ("site", "add", url.endswith("/") & ~url.contains("://www.")), ("site", "remove", url.contains("page=")),
    ]
    said = F.explode(F.array(*[F.when(when, F.struct(F.lit(name).alias("list"), keys[name].alias("key"), F.lit(action).alias("action"))) for name, action, when in rules]))
    effective = (F.floor((F.col("fetched_at") - START) / DAY) + 1) * DAY + START
    return captures.select(effective.cast("long").alias("effective_at"), said.alias("e")).where("e is not null").select("e.*", "effective_at")
