"""Resolution of WARC not-modified revisits.

A revisit record says that a capture was not modified since an earlier one of the same resource. It
is resolved by an as-of join on the canonical URL to the latest earlier full response; the pair
holds if the validators agree; the revisit's permitted headers then replace the response's.

The as-of join is dealt by URL and time bucket, the buckets cut at quantiles of the capture times:
within a bucket a window carries the last response forward, and one row per URL and bucket carries
it across buckets. So a URL with any share of all captures is spread over its buckets.

Null URLs never match. Null dates come before all others and resolve nothing. Of captures at one
time, the larger record_id is the later. Repeated rows stay repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values (lower case): headers that a 304 response may replace.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not name a resource.
TRACKING = r"^(?:utm_[a-z]+|gclid|fbclid|sessionid|jsessionid|phpsessid|sid|ref)(?:=|$)"


def canonical_url(url: Column) -> Column:
    """Host and path under which captures of one resource meet.

    Scheme, user, ``www``, default port, fragment, trailing slash and tracking parameters go; the host
    is lower-cased and the parameters sorted.
    """
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(?:80|443)$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def merged_headers(base: Column, update: Column) -> Column:
    """``base`` (map, lower-case names) with the permitted headers of ``update`` in place of its own."""
    allowed = F.map_filter(update, lambda k, v: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def validators_agree(response: Column, revisit: Column, response_digest: Column, revisit_digest: Column) -> Column:
    """Whether the revisit may stand for the response.

    Equal payload digests decide if the revisit has one; else equal entity tags (weak ones as
    strong) if it has one; else equal modification dates. Without any validator it may not.
    """

    def tag(headers: Column) -> Column:
        return F.regexp_replace(F.try_element_at(headers, F.lit("etag")), r"^W/", "")

    def since(headers: Column) -> Column:
        return F.try_element_at(headers, F.lit("last-modified"))

    by_date = F.when(since(revisit).isNotNull(), F.coalesce(since(revisit) == since(response), F.lit(False))).otherwise(F.lit(False))
    by_tag = F.when(tag(revisit).isNotNull(), F.coalesce(tag(revisit) == tag(response), F.lit(False))).otherwise(by_date)
    return F.when(revisit_digest.isNotNull(), F.coalesce(revisit_digest == response_digest, F.lit(False))).otherwise(by_tag)


def resolve(records: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row per revisit of ``records``: what it resolves to.

    ``records`` has record_id long, url string, captured_at long (capture time), kind string (``response`` or
    ``revisit``), status int, headers map<string,string> (lower-case names), digest string. A full
    response has kind ``response`` and status 200. Returns record_id, canonical_url, captured_at, ref_id,
    ref_at, outcome (``resolved``, ``no_response``, ``mismatch``), headers (merged where resolved,
    else the revisit's own), digest (of the response where resolved).
    """
    spark = records.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    probes = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(records.select("captured_at").approxQuantile("captured_at", probes, 0.2 / buckets))) if probes else []
    edges = F.array(*[F.lit(int(c)) for c in cuts]).cast("array<bigint>")
    slim = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "captured_at", "kind", "status", "headers", "digest")
    slim = slim.where("kind in ('response', 'revisit')").withColumn("bucket", F.size(F.filter(edges, lambda e: e < F.col("captured_at"))))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("captured_at").isNotNull() & F.col("canonical_url").isNotNull()
    held = F.struct(F.col("captured_at").alias("ref_at"), F.col("record_id").alias("ref_id"), F.col("headers").alias("ref_headers"), F.col("digest").alias("ref_digest"))
    # records without a URL or a time meet nothing, and would all share a key
    placed = slim.where("canonical_url is not null and captured_at is not null")
    # within a bucket: strictly earlier in (captured_at, record_id)
    inside = Window.partitionBy("canonical_url", "bucket").orderBy("captured_at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("near", F.last(F.when(full, held), ignorenulls=True).over(inside)).where("kind = 'revisit'")
    # across buckets: the last response of each bucket, carried forward over buckets that have rows
    lasts = placed.groupBy("canonical_url", "bucket").agg(F.max_by(F.when(full, held), F.when(full, F.struct("captured_at", "record_id"))).alias("own"))
    over = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    far = lasts.select("canonical_url", "bucket", F.last("own", ignorenulls=True).over(over).alias("far"))
    met = near.join(far, ["canonical_url", "bucket"], "left").withColumn("ref", F.coalesce("near", "far")).drop("near", "far")
    alone = slim.where("kind = 'revisit' and (canonical_url is null or captured_at is null)")
    met = met.unionByName(alone.withColumn("ref", F.lit(None).cast(met.schema["ref"].dataType)))
    agree = validators_agree(F.col("ref.ref_headers"), F.col("headers"), F.col("ref.ref_digest"), F.col("digest"))
    outcome = F.when(F.col("ref").isNull(), "no_response").when(agree, "resolved").otherwise("mismatch")
    met = met.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    return met.select(
        "record_id", "canonical_url", "captured_at", "ref.ref_id", "ref.ref_at", "outcome",
        F.when(good, merged_headers(F.col("ref.ref_headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(good, F.col("ref.ref_digest")).otherwise(F.col("digest")).alias("digest"),
    )


def captures(pages: DataFrame, again: int = 1_000) -> DataFrame:
    """A crawl of ``pages``: each page is captured in full at its page_id and asked for again, with
    its entity tag, ``again`` ticks later, to which the server answers not modified.

    Between the two, another page of the same canonical URL may have been captured; the revisit then
    meets that page's response and its tag decides.
    """
    page_id, html = F.col("page_id").cast("long"), F.coalesce(F.col("html").cast("string"), F.lit(""))
    tag = F.concat(F.lit('"'), F.substring(F.sha2(html, 256), 1, 16), F.lit('"'))
    slim = pages.select(page_id.alias("page_id"), F.col("url").cast("string").alias("url"), tag.alias("tag"), F.sha2(html, 256).alias("sha"), F.octet_length(html).cast("string").alias("length"))
    first = F.struct(
        (2 * F.col("page_id")).alias("record_id"), F.col("page_id").alias("captured_at"), F.lit("response").alias("kind"), F.lit(200).alias("status"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("length"), F.lit("etag"), F.col("tag"), F.lit("date"), F.col("page_id").cast("string")).alias("headers"),
        F.col("sha").alias("digest"),
    )
    later = F.struct(
        (2 * F.col("page_id") + 1).alias("record_id"), (F.col("page_id") + again).alias("captured_at"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("etag"), F.concat(F.lit("W/"), F.col("tag")), F.lit("date"), (F.col("page_id") + again).cast("string")).alias("headers"),
        F.lit(None).cast("string").alias("digest"),
    )
    return slim.select("url", F.explode(F.array(first, later)).alias("r")).select("r.record_id", "url", "r.captured_at", "r.kind", "r.status", "r.headers", "r.digest")
