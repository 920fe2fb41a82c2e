"""Resolution of not-modified revisits in web captures, in DataFrame functions.

A revisit says that a page had not changed since an earlier capture.  Each one
is joined, as of its time, to the latest earlier full response of its canonical
URL; the validators of both are compared, and the headers that such a reply may
update are merged into the response's.

Captures of one URL and time are first drawn together to one point, so that many
at once are one row.  The as-of join then works in time slices: within a slice a
window carries the last response forward, and a second window carries the last
response of each slice over to later slices.  A URL with a third of all captures
is so divided by time; web archives keep whole seconds, so a slice of a URL holds
no more points than it has seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The headers that a 304 reply may update, and query parameters that do not name a page.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = r"^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)(?:=|$)"
SLICE_SECONDS = 6 * 3600


def canonical_url(url: Column) -> Column:
    """Host in lower case without "www." and default port, path without its last slash, sorted query without tracking parameters; no scheme or fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^www[0-9]*\\.", ""), ":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "^[^?]*\\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~F.rlike(F.lower(p), F.lit(TRACKING)))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def validator(value: Column) -> Column:
    """An entity tag without its weakness mark, blank as null."""
    return F.nullif(F.regexp_replace(F.trim(value), "^W/", ""), F.lit(""))


def resolve_revisits(captures: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """One row per revisit in ``captures`` (record_id, url, ts, kind "response" or "revisit", headers map).

    Gives record_id, canonical_url, ts, response_id, response_ts, status and
    headers.  status is ``resolved`` (an entity tag, or for want of one the
    last-modified time, agrees), ``validator_mismatch``, ``no_validator`` or
    ``no_earlier_response``; only resolved rows have the response's headers, with
    the permitted ones of the revisit laid over them.  Only responses strictly
    earlier count; of responses at one time the one with the greatest record_id
    does.  Captures without URL or time resolve nothing and stay unresolved;
    rows of other kinds are ignored.  Repeated revisits each give a row.
    Missing headers are an empty map; header names are compared in lower case,
    and of one name given twice the last counts.  Other columns are not read.
    """
    named = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    rows = captures.where(F.col("kind").isin("response", "revisit")).select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "kind", _lower_keys(named).alias("headers"))
    placed = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    response = F.struct("ts", "record_id", validator(F.col("headers")["etag"]).alias("etag"), F.nullif(F.col("headers")["last-modified"], F.lit("")).alias("modified"), "headers")
    is_response, point, slice_ = F.col("kind") == "response", ["canonical_url", "ts"], ["canonical_url", "slice"]
    points = rows.where(placed).groupBy(*point).agg(F.max_by(F.when(is_response, response), F.when(is_response, F.struct("record_id"))).alias("own"), F.max(~is_response).alias("asked"))
    points = points.withColumn("slice", F.floor(F.unix_timestamp("ts") / slice_seconds))
    inside = Window.partitionBy(*slice_).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    near = points.withColumn("near", F.last("own", ignorenulls=True).over(inside))
    # A slice's last response, and whether it asks for one from before it.
    slices = near.groupBy(*slice_).agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("ts"))).alias("last"), F.max(F.col("asked") & F.col("near").isNull()).alias("asks"))
    over = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("earlier", F.last("last", ignorenulls=True).over(over)).where("asks and earlier is not null").select(*slice_, "earlier")
    answers = near.where("asked").join(carried, slice_, "left").select(*point, F.coalesce("near", "earlier").alias("found"))
    revisits = rows.where("kind = 'revisit'")
    joined = revisits.where(placed).join(answers, point, "left")
    joined = joined.unionByName(revisits.where(~placed).withColumn("found", F.lit(None).cast(joined.schema["found"].dataType)))
    etag, modified = validator(F.col("headers")["etag"]), F.nullif(F.col("headers")["last-modified"], F.lit(""))
    agrees = F.when(etag.isNotNull() & F.col("found.etag").isNotNull(), etag == F.col("found.etag")).when(modified.isNotNull() & F.col("found.modified").isNotNull(), modified == F.col("found.modified"))
    status = F.when(F.col("found").isNull(), "no_earlier_response").when(agrees.isNull(), "no_validator").when(agrees, "resolved").otherwise("validator_mismatch")
    newer = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("found.headers", lambda k, _: ~F.map_contains_key(newer, k)), newer)
    return joined.select("record_id", "canonical_url", "ts", F.col("found.record_id").alias("response_id"), F.col("found.ts").alias("response_ts"), status.alias("status"), F.when(status == "resolved", merged).alias("headers"))


def _lower_keys(headers: Column) -> Column:
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e: e["key"].isNotNull())
    names = F.array_distinct(F.transform(last, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(last, lambda e: e["key"] == n), -1)["value"]))


def captures_of(pages: DataFrame) -> DataFrame:
    """Two captures for each page: its response, and a revisit some hours later.

    The response is validated by the page's MD5 and a date; of four revisits one
    has an outdated tag, one only the date, one a weak tag and one the tag itself.
    """
    day = lambda n: F.concat(F.lit("day "), n.cast("string"))
    start = F.col("page_id") * 97 % 2_592_000
    tag, modified = F.md5(F.col("html")), day(F.col("page_id") % 365)
    lag = 600 + F.col("page_id") * 7919 % 172_800
    kind = F.col("page_id") % 4
    sent = F.when(kind == 0, F.lit("stale")).when(kind == 2, F.concat(F.lit("W/"), tag)).when(kind == 3, tag).otherwise(F.lit(""))
    at = lambda s: F.timestamp_seconds(F.lit(1_704_067_200) + s)
    header = lambda **h: F.create_map(*[x for k, v in h.items() for x in (F.lit(k.replace("_", "-")), v)])
    response = F.struct((F.col("page_id") * 2).alias("record_id"), at(start).alias("ts"), F.lit("response").alias("kind"), header(ETag=tag, Last_Modified=modified, Content_Type=F.lit("text/html"), Date=day(start)).alias("headers"))
    revisit = F.struct((F.col("page_id") * 2 + 1).alias("record_id"), at(start + lag).alias("ts"), F.lit("revisit").alias("kind"), header(etag=sent, last_modified=modified, content_type=F.lit("none"), date=day(start + lag)).alias("headers"))
    return pages.select("url", F.inline(F.array(response, revisit)))


def digest_revisits(pages: DataFrame) -> DataFrame:
    """Every revisit of ``captures_of(pages)`` with its status, response and merged headers as text."""
    found = resolve_revisits(captures_of(pages))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("record_id", "canonical_url", F.unix_timestamp("ts").alias("seen_at"), "response_id", "status", F.coalesce(text, F.lit("")).alias("headers"))


SQL = r"""
WITH p AS (
  SELECT page_id, page_id * 97 % 2592000 AS s, 600 + page_id * 7919 % 172800 AS lag, md5(html) AS tag, 'day ' || (page_id % 365) AS modified,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
c AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www[0-9]*\.', ''), ':(?:80|443)$', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
    || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical_url
  FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'),
    lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)(?:=|$)'))), '&') AS q FROM p)),
v AS (
  SELECT page_id * 2 + 1 AS record_id, canonical_url, s + lag AS seen_at, modified,
    CASE page_id % 4 WHEN 0 THEN 'stale' WHEN 1 THEN '' ELSE tag END AS etag,
    CASE page_id % 4 WHEN 0 THEN 'stale' WHEN 1 THEN '' WHEN 2 THEN 'W/' || tag ELSE tag END AS sent FROM c),
j AS (
  SELECT v.*, r.page_id * 2 AS response_id, r.tag AS r_tag, r.modified AS r_modified,
    row_number() OVER (PARTITION BY v.record_id ORDER BY r.s DESC, r.page_id DESC) AS nth
  FROM v LEFT JOIN c r ON r.canonical_url = v.canonical_url AND r.s < v.seen_at),
k AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no_earlier_response'
    WHEN (CASE WHEN etag <> '' THEN etag = r_tag ELSE modified = r_modified END) THEN 'resolved' ELSE 'validator_mismatch' END AS status
  FROM j WHERE nth = 1)
SELECT record_id, canonical_url, seen_at + 1704067200 AS seen_at, response_id, status,
  CASE WHEN status = 'resolved' THEN 'content-type=text/html;date=day ' || seen_at || ';etag=' || sent || ';last-modified=' || r_modified ELSE '' END AS headers
FROM k
"""
