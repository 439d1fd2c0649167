"""Resolving not-modified revisits of a crawl, with DataFrame operations only.

A revisit record says that a page has not changed and carries no payload. It takes that of the latest
earlier full response of the same canonical URL, if its validators agree: the entity tag where both
have one, else the modification date. Headers are those of the full response, with the ones that a
not-modified answer may renew taken from the revisit.

The as-of join is a window over keys and times alone, in two levels. Captures are sorted by URL and time
over all tasks, and each task's stretch is a slice, so that a URL with a third of all captures, be they of
one hour or without a time, spreads over as many slices as it fills: rows look back within their slice,
and the last full response of each slice is carried to the later ones. Headers and payloads join at the
end; a response that many slices need is copied once for each of them.

Defined results: status is `full` for responses; `resolved`; `mismatch` if the latest earlier response
has another validator; `unchecked` if no validator can be compared (the payload is taken); `orphan`
without an earlier response. Records of the same time are ordered by record_id and then by a hash of the
record; a null time is before all others; null URLs are one URL; there is one row out for each row in, so
records that repeat are resolved alike, and other records with one record_id by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import cut

#: Headers that a 304 answer may renew, and query parameters that name no content.
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
#: Stands for a null time or id, before all others.
LEAST = -(1 << 62)


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, www, default port, fragment, trailing slash and tracking
    parameters, the others sorted."""
    u = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, "^[a-zA-Z]+://([^/?]*)", 1)), "^www[.]|:(80|443)$", "")
    rest = F.regexp_replace(u, "^[a-zA-Z]+://[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^([^?]*)", 1), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def resolve(records: DataFrame) -> DataFrame:
    """records: record_id, url, ts (seconds), type (`response` or `revisit`), etag, last_modified,
    headers map<string,string> (names in lower case), payload. Adds canonical, status, source_id, and
    gives revisits their payload and merged headers."""
    known = records.select("record_id", "url", "ts", "type", "etag", "last_modified", "headers", "payload")
    known = known.withColumn("canonical", canonical_url(F.col("url"))).withColumn("h", F.xxhash64("url", "ts", "etag", "last_modified", "payload"))
    full = F.col("type") == "response"
    # what tells a response: its time comes first, so that the greatest is the latest
    seen = F.when(full, F.struct(F.coalesce("ts", F.lit(LEAST)).alias("ts"), F.coalesce("record_id", F.lit(LEAST)).alias("id"), "h", "record_id", "etag", "last_modified"))
    points = known.select("canonical", "ts", "record_id", "h", "type", "etag", "last_modified", F.when(~full, F.col("headers")).alias("headers"), seen.alias("seen"))
    # written, so that slices stay as they are
    dealt = cut(points.repartitionByRange("canonical", "ts", "record_id", "h").withColumn("slice", F.spark_partition_id()), "captures")

    slices = dealt.groupBy("canonical", "slice").agg(F.max("seen").alias("newest"))
    earlier = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("canonical", "slice", F.last("newest", ignorenulls=True).over(earlier).alias("carried")).filter("carried is not null")
    within = Window.partitionBy("canonical", "slice").orderBy(F.col("ts").asc_nulls_first(), F.col("record_id").asc_nulls_first(), "h").rowsBetween(Window.unboundedPreceding, -1)
    looked = dealt.withColumn("near", F.last("seen", ignorenulls=True).over(within)).filter(~full).join(carried, ["canonical", "slice"], "left")
    looked = looked.withColumn("found", F.coalesce("near", "carried"))
    tags = F.col("etag").isNotNull() & F.col("found.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("found.last_modified").isNotNull()
    agrees = F.when(tags, F.col("etag") == F.col("found.etag")).when(dates, F.col("last_modified") == F.col("found.last_modified"))
    status = F.when(F.col("found").isNull(), "orphan").when(agrees.isNull(), "unchecked").when(agrees, "resolved").otherwise("mismatch")
    takes = status.isin("resolved", "unchecked")
    verdicts = looked.select(
        "record_id", "canonical", "ts", "type", status.alias("status"), "headers", "slice", F.when(takes, F.col("found.record_id")).alias("source_id"),
        F.when(takes, F.col("found.id")).alias("id"), F.when(takes, F.col("found.h")).alias("h"), F.col("near").isNull().alias("far"),
    )
    verdicts = cut(verdicts, "revisits")

    origin = known.filter(full).select(F.coalesce("record_id", F.lit(LEAST)).alias("id"), "h", F.col("headers").alias("stored"), "payload")
    if not dealt.filter(full).groupBy("record_id", "h").count().filter("count > 1").isEmpty():  # responses that repeat count once
        origin = origin.groupBy("id", "h").agg(F.min_by(F.struct("stored", "payload"), F.coalesce(F.to_json("stored"), F.lit(""))).alias("o")).select("id", "h", "o.*")
    # a slice bounds how many look back within it; those that look further join a copy made for their slice
    near = verdicts.filter("h is not null and not far").join(origin.hint("merge"), ["id", "h"])
    needed = cut(verdicts.filter("h is not null and far").select("id", "h", "slice").distinct(), "needed")
    far = verdicts.filter("h is not null and far").join(origin.join(needed, ["id", "h"]), ["id", "h", "slice"])
    none = verdicts.filter("h is null").withColumn("stored", F.lit(None).cast("map<string,string>")).withColumn("payload", F.lit(None).cast("string"))
    merged = near.unionByName(far).unionByName(none)
    empty = F.create_map().cast("map<string,string>")
    renew = F.map_filter(F.coalesce("headers", empty), lambda k, _: k.isin(*RENEWED))
    stored = F.map_filter(F.coalesce("stored", empty), lambda k, _: ~F.array_contains(F.map_keys(renew), k))
    merged = merged.withColumn("headers", F.when(F.col("h").isNotNull(), F.map_concat(stored, renew)).otherwise(F.col("headers")))
    columns = ["record_id", "canonical", "ts", "type", "status", "source_id", "headers", "payload"]
    whole = known.filter(full).withColumn("status", F.lit("full")).withColumn("source_id", F.col("record_id"))
    return whole.select(columns).unionByName(merged.select(columns))


def crawl(pages: DataFrame) -> DataFrame:
    """A crawl of pages(page_id, url, html): each page is fetched once, and two of three once more, by
    another spelling of the URL, when the server answers not-modified; some of these answers carry a
    wrong tag, only a date, or nothing."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    tag = F.concat(F.lit('"'), F.substring(F.sha2(F.coalesce("html", F.lit("")), 256), 1, 16), F.lit('"'))
    date = F.concat(F.lit("day "), (F.col("page_id") % 97).cast("string"))
    none = F.lit(None).cast("string")
    entry = lambda **kv: F.create_map(*(x for k, v in kv.items() for x in (F.lit(k.replace("_", "-")), v)))
    fetched = p.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 600).alias("ts"), F.lit("response").alias("type"), tag.alias("etag"), date.alias("last_modified"),
        entry(content_type=F.lit("text/html"), content_length=F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), date=date, etag=tag).alias("headers"), F.col("html").alias("payload"),
    )
    kind = F.col("page_id") % 11
    again = p.filter(F.col("page_id") % 3 != 0).select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_source=again#top")).alias("url"),
        (F.col("page_id") * 600 + 86_400).alias("ts"), F.lit("revisit").alias("type"), F.when(kind == 1, F.lit('"other"')).when(kind < 9, tag).alias("etag"), F.when(kind != 10, date).alias("last_modified"),
        entry(content_length=F.lit("0"), date=F.concat(F.lit("again "), date), expires=F.lit("never")).alias("headers"), none.alias("payload"),
    )
    return fetched.unionByName(again)


def summary(records: DataFrame) -> DataFrame:
    """record_id, canonical, status, source_id (-1: none), payload_sha256, headers as sorted text."""
    r = resolve(records)
    text = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return r.select("record_id", "canonical", "status", F.coalesce("source_id", F.lit(-1)).alias("source_id"), F.sha2(F.col("payload"), 256).alias("payload_sha256"), text.alias("headers"))
