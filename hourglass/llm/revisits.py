"""Resolution of not-modified revisit records of a web archive.

A revisit record (HTTP 304) has no body.  It is joined, as of its time, to
the latest earlier full response of the same canonical URL.  Validators must
agree: the entity tag when both sides have one (weak comparison), else the
last-modified date when both have one, else the payload digest.  A resolved
revisit takes the response's body and headers; headers sent with the revisit
replace stored ones, except those that describe the stored body.

Scale: the as-of join is two-level.  Captures are range-partitioned by URL and
time; within (URL, partition) a window finds the last response so far, and one
row per URL and partition carries the last response on.  Windows hold only ids
and times, not headers or bodies, and a URL with a third of all captures, also
if all are of one day, is spread over partitions.
Headers are fetched afterwards by a join on the response's own number, whose
hot side adaptive execution splits.

Captures: record_id, url, captured_at (timestamp), kind ('response' or
'revisit'), headers (map of lower-case name to value), payload_digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourglass.session import materialize

# Headers that describe the stored body or the connection, which a 304 must not replace.
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
                "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased, 'www.' and the default port dropped, no fragment, empty path as '/', query sorted.

    A url without '://' is only trimmed; null stays null.
    """
    url = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?]*)", 1)
    query = F.regexp_extract(url, r"\?(.*)$", 1)
    sorted_query = F.array_join(F.sort_array(F.split(query, "&")), "&")
    built = F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), sorted_query)))
    return F.when(scheme == "", url).otherwise(built)


def _tag(headers: str) -> Column:
    return F.regexp_replace(F.trim(F.expr(f"{headers}['etag']")), "^W/", "")


def latest_response(captures: DataFrame) -> DataFrame:
    """For every revisit: ``number``, and ``response``, the number of the latest earlier response of its URL (or null).

    ``captures`` has number, curl, captured_at, kind, record_id,
    payload_digest and headers_hash.  Responses at the revisit's own time
    count as earlier; of responses at one time the largest record_id is the
    latest, then the largest digest (null is the least), then the largest
    hash of the headers, so the order of the rows does not matter.  Rows
    without a URL or a time have no response.
    """
    is_response = F.col("kind") == "response"
    rows = captures.where("curl is not null and captured_at is not null").select(
        "number", "curl", "captured_at", F.when(is_response, 0).otherwise(1).alias("later"), "record_id", "payload_digest", "headers_hash")
    order = ["curl", "captured_at", "later", "record_id", "payload_digest", "headers_hash", "number"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(rows.select("number", "curl", "later", F.monotonically_increasing_id().alias("seq")), "capture-order")
    rows = rows.withColumn("part", F.shiftright("seq", 33))
    own = F.when(F.col("later") == 0, F.col("number"))
    so_far = Window.partitionBy("curl", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("here", F.last(own, ignorenulls=True).over(so_far))
    parts = rows.groupBy("curl", "part").agg(F.max(F.when(F.col("later") == 0, F.struct("seq", "number")))["number"].alias("last"))
    earlier = Window.partitionBy("curl").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("curl", "part", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    return (within.where(F.col("later") == 1).join(parts, ["curl", "part"])
            .select("number", F.coalesce("here", "carried").alias("response")))


def resolve(captures: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url, canonical_url, captured_at, refers_to, outcome, headers, payload_digest.

    ``outcome`` is ``resolved``, ``no_response`` (none earlier, or no URL or
    time), or ``validator_mismatch``; only resolved rows have merged headers
    and the response's digest, the others keep their own.  ``refers_to`` is
    the candidate response's record_id.  Repeated revisit rows are each
    resolved; a null header map counts as empty.  A kind other than
    'response' and 'revisit' is ignored.
    """
    numbered = materialize(captures.select("record_id", "url", "captured_at", "kind", "headers", "payload_digest")
                           .withColumns({"number": F.monotonically_increasing_id(), "curl": canonical_url(F.col("url")),
                                         "headers": F.coalesce("headers", F.create_map().cast("map<string,string>"))})
                           .withColumn("headers_hash", F.xxhash64(F.array_sort(F.map_entries("headers")))).where("kind in ('response', 'revisit')"), "captures")
    found = materialize(latest_response(numbered), "as-of")
    revisits = numbered.where("kind = 'revisit'").join(found, "number", "left")
    full = numbered.where("kind = 'response'").select(F.col("number").alias("response"), F.col("record_id").alias("refers_to"),
                                                      F.col("headers").alias("stored"), F.col("payload_digest").alias("stored_digest"))
    both = revisits.join(full, "response", "left")
    tag, stored_tag = _tag("headers"), _tag("stored")
    date, stored_date = F.expr("headers['last-modified']"), F.expr("stored['last-modified']")
    agrees = (F.when(tag.isNotNull() & stored_tag.isNotNull(), tag == stored_tag)
              .when(date.isNotNull() & stored_date.isNotNull(), date == stored_date)
              .otherwise(F.coalesce(F.col("payload_digest") == F.col("stored_digest"), F.lit(False))))
    outcome = F.when(F.col("stored").isNull(), "no_response").when(agrees, "resolved").otherwise("validator_mismatch")
    sent = F.map_filter("headers", lambda k, v: ~F.lower(k).isin(*KEPT_HEADERS))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.array_contains(F.map_keys(sent), k)), sent)
    ok = F.col("outcome") == "resolved"
    return both.withColumn("outcome", outcome).select(
        "record_id", "url", F.col("curl").alias("canonical_url"), "captured_at", "refers_to", "outcome",
        F.when(ok, merged).otherwise(F.col("headers")).alias("headers"),
        F.when(ok, F.col("stored_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"))
