"""Revisit records answered "not modified", resolved to the response they stand for.

A server that answers 304 sends no body.  Such a record stands for the latest earlier full
response of the same canonical URL, if its validators agree with that response; then the
response's body holds, with its headers updated by those of the 304 that may change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.plans.lineage import cut_lineage

#: Header fields that a 304 may not change (fixed values, RFC 9111 section 3.2 and the fields
#: that describe the stored body or the connection).
FIXED_HEADERS = (
    "connection",
    "content-encoding",
    "content-length",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-authenticate",
    "proxy-authorization",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
)
#: Statuses of a full response: the body as the server has it, or as a proxy has changed it.
FULL = (200, 203)
#: Query parameters that only say where a visitor came from.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """One spelling per page: no scheme, user, default port, leading ``www.`` or ``m.``,
    fragment, tracking parameter or final slash; host in lower case.  Null stays null."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"^[^/?@]*@", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r":(80|443)$", "")
    host = F.regexp_replace(host, r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    fields = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    query = F.array_join(F.filter(fields, lambda f: (f != "") & ~f.rlike(TRACKING)), "&")
    return F.concat(host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def _same_validators(stored_etag: Column, stored_modified: Column) -> Column:
    """The entity tags decide if the revisit names one, else the times; a revisit with
    neither proves nothing."""
    weak = r"^W/"
    by_tag = F.regexp_replace(F.col("etag"), weak, "") == F.regexp_replace(stored_etag, weak, "")
    by_time = F.col("last_modified") == stored_modified
    return F.coalesce(
        F.when(F.col("etag").isNotNull(), by_tag).when(F.col("last_modified").isNotNull(), by_time), F.lit(False)
    )


def _one_spelling(headers: Column) -> Column:
    fields = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    names = F.array_distinct(F.transform(fields, lambda f: F.lower(f["key"])))

    def field(name: Column) -> Column:
        own = F.filter(fields, lambda f: F.lower(f["key"]) == name)
        values = F.array_distinct(F.array_compact(F.transform(own, lambda f: f["value"])))
        return F.struct(name, F.when(F.size(values) > 0, F.array_join(values, ", ")))

    return F.map_from_entries(F.transform(names, field))


def merge_headers(stored: Column, update: Column) -> Column:
    """``stored`` with the fields of ``update`` put over it, except the fixed ones; names in
    lower case.  A null side counts as having no fields.  Fields whose names differ in case only
    are one field: its different values in the order of the names, joined by ", "."""
    stored, update = _one_spelling(stored), _one_spelling(update)
    allowed = F.map_filter(update, lambda k, _: ~k.isin(*FIXED_HEADERS))
    kept = F.map_filter(stored, lambda k, _: ~F.map_contains_key(allowed, k))
    return F.map_concat(kept, allowed)


def resolve_revisits(records: DataFrame, full: Sequence[int] = FULL) -> DataFrame:
    """Each 304 record with the response it stands for, a record of a status in ``full``.

    ``records`` has record_id (long, orders records of one time), url, captured_at, status
    (int), etag, last_modified, headers (map of strings) and digest (of the body); other columns
    are ignored.  Returned per revisit: record_id, canonical (URL), captured_at, response_id
    and response_digest (null unless resolved), headers (merged if resolved, else its own) and
    outcome: ``resolved``, ``changed`` (the latest earlier response has other validators) or
    ``orphan`` (no earlier response, or no URL or time).  Records of other statuses, such as parts
    (206) and answers without a body (204, 205), are no responses to stand for.  A response at the same time counts as
    earlier if its record_id is lower.  Equal rows give equal results, one for each.

    Rows are dealt by ranges of (URL, time, id), so a hot URL spreads over several tasks; what
    a task lacks from before its range comes from a summary of one row per URL and task.
    """
    order = ("captured_at", "record_id")
    complete = F.coalesce(F.col("status").isin(*full), F.lit(False))
    shared = ["record_id", "captured_at", "etag", "last_modified", "headers"]
    rows = records.select(
        *shared,
        "digest",
        canonical_url(F.col("url")).alias("canonical"),
        complete.alias("_full"),
    ).filter(complete | (F.col("status") == 304))
    placed = F.col("canonical").isNotNull() & F.col("captured_at").isNotNull() & F.col("record_id").isNotNull()
    response = F.when(
        F.col("_full"),
        F.struct(
            F.col("record_id").alias("id"), "digest", "headers", "etag", F.col("last_modified").alias("modified")
        ),
    )
    dealt = cut_lineage(
        rows.filter(placed)
        .withColumn("_response", response)
        .repartitionByRange("canonical", *order)
        .withColumn("_range", F.spark_partition_id())
    )
    inside = Window.partitionBy("canonical", "_range").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        dealt.filter("_full")
        .groupBy("canonical", "_range")
        .agg(F.max_by("_response", F.struct(*order)).alias("_last"))
    )
    ranges = dealt.select("canonical", "_range").distinct().join(last, ["canonical", "_range"], "left")
    before = Window.partitionBy("canonical").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(
        "canonical", "_range", F.last("_last", ignorenulls=True).over(before).alias("_carried")
    ).filter(F.col("_carried").isNotNull())
    found = (
        dealt.withColumn("_own", F.last("_response", ignorenulls=True).over(so_far))
        .filter(~F.col("_full"))
        .join(carried, ["canonical", "_range"], "left")
        .withColumn("_stored", F.coalesce("_own", "_carried"))
    )
    same = _same_validators(F.col("_stored.etag"), F.col("_stored.modified"))
    outcome = (
        F.when(F.col("_stored").isNull(), "orphan").when(same, "resolved").otherwise("changed").alias("outcome")
    )
    resolved = F.col("outcome") == "resolved"
    return _result(found.select("*", outcome), resolved).unionByName(
        _result(
            rows.filter(~placed & ~F.col("_full")).select(
                "*", F.lit("orphan").alias("outcome"), F.lit(None).cast(dealt.schema["_response"].dataType).alias("_stored")
            ),
            resolved,
        )
    )


def _result(found: DataFrame, resolved: Column) -> DataFrame:
    return found.select(
        "record_id",
        "canonical",
        "captured_at",
        F.when(resolved, F.col("_stored.id")).alias("response_id"),
        F.when(resolved, F.col("_stored.digest")).alias("response_digest"),
        F.when(resolved, merge_headers(F.col("_stored.headers"), F.col("headers")))
        .otherwise(F.col("headers"))
        .alias("headers"),
        "outcome",
    )
