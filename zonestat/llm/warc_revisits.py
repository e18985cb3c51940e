"""Not-modified revisits of web archives, resolved to the responses that they repeat.

Records are (id, url, at, kind, etag, last_modified, headers). A revisit takes the latest earlier full
response of its canonical URL. It is resolved if the validators agree: etags (weak comparison) where
both have one, else last-modified where both have one. A resolved revisit's headers are the
response's, with those that a 304 may carry taken from the revisit.

The as-of join is done in slices of time, so that a URL with a large share of all records isn't one
task's: inside a slice by a running window, across slices by the last response of each URL and slice.

Nulls: a null url is a URL of its own, kept apart from the empty one; a record without time is never
resolved nor resolves; validators that are null don't count, and a pair without common validators is
unverified. At the same time, a response comes before a revisit, then the smaller id (null first). Each
row is resolved by itself, whatever its id: null and repeated ids mix nothing up. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Headers that a not-modified response may change.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
SLICES = 64


def canonical_url(url: Column) -> Column:
    """Host in lower case without www., default port, scheme, fragment, tracking parameters or final slash; parameters in order."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(plain, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:www\.)?([^/?]*)", 1))
    host = F.regexp_replace(host, r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|fbclid|gclid)=")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def merge_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, with the permitted ones that the revisit has in their place."""
    new = F.map_filter(revisit, lambda k, v: F.lower(k).isin(*PERMITTED) & v.isNotNull())
    names = F.transform(F.map_keys(new), F.lower)
    return F.map_concat(F.map_filter(response, lambda k, v: ~F.array_contains(names, F.lower(k))), new)


def resolve_revisits(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """Per record: id, url_key, kind, outcome (response, resolved, mismatch, unverified or orphan), response_id, headers."""
    given = records.select(F.monotonically_increasing_id().alias("row"), "id", F.when(F.col("url").isNotNull(), F.concat(F.lit("u"), canonical_url(F.col("url")))).otherwise("").alias("url_key"), "at", "kind", "etag", "last_modified", "headers")
    given = cut(given)  # rows keep their numbers
    light = given.drop("headers")
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    first, last = light.agg(F.min(micros), F.max(micros)).first()
    width = max(1, ((last or 0) - (first or 0)) // slices + 1)
    light = light.withColumn("slice", F.floor((micros - F.lit(first or 0)) / F.lit(width)))
    full = F.when((F.col("kind") == "response") & F.col("at").isNotNull(), F.struct("at", "id", "row", "etag", "last_modified"))
    order = Window.partitionBy("url_key", "slice").orderBy("at", F.col("kind") != "response", "id", "row").rowsBetween(Window.unboundedPreceding, 0)
    near = light.withColumn("found", F.last(full, ignorenulls=True).over(order))
    ends = light.where("kind = 'response' and at is not null").groupBy("url_key", "slice").agg(F.max(F.struct("at", "id", "row", "etag", "last_modified")).alias("last"))
    # the last response of any earlier slice, for slices with records but also for those without responses
    held = light.where("slice is not null").select("url_key", "slice").distinct().join(ends, ["url_key", "slice"], "left")
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    carried = held.withColumn("carried", before).where("carried is not null").select("url_key", "slice", "carried")
    found = near.where("kind <> 'response'").join(carried, ["url_key", "slice"], "left").withColumn("r", F.when(F.col("at").isNotNull(), F.coalesce("found", "carried")))
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    by_etag = weak(F.col("etag")) == weak(F.col("r.etag"))
    agree = F.coalesce(by_etag, F.col("last_modified") == F.col("r.last_modified"))
    outcome = F.when(F.col("r").isNull(), "orphan").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    marked = found.select("row", outcome.alias("outcome"), F.col("r.id").alias("response_id"), F.col("r.row").alias("response_row"))
    responses = given.where("kind = 'response'").select(F.col("row").alias("response_row"), F.col("headers").alias("response_headers"))
    joined = given.where("kind <> 'response'").join(marked, "row")
    revisits = joined.where("response_row is not null").join(responses, "response_row")
    # orphans need no join: their null would bring all of them to one task
    orphans = joined.where("response_row is null").withColumn("response_headers", F.lit(None).cast("map<string,string>"))
    revisits = revisits.unionByName(orphans)
    headers = F.when(F.col("outcome") == "resolved", merge_headers(F.coalesce("response_headers", F.create_map().cast("map<string,string>")), F.coalesce("headers", F.create_map().cast("map<string,string>")))).otherwise(F.col("headers"))
    whole = given.where("kind = 'response'").select("id", "url_key", "kind", F.lit("response").alias("outcome"), F.col("id").alias("response_id"), "headers")
    return whole.unionByName(revisits.select("id", "url_key", "kind", "outcome", "response_id", headers.alias("headers")))
