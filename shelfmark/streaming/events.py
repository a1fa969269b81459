"""Rules over event tables, as batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators.checks import union_all
from shelfmark.operators.components import connected
from shelfmark.operators.keyed import left_lookup
from shelfmark.operators.links import link_at
from shelfmark.session import dealt, stored

EVENT_KEY = ["network", "external_event_id"]
DIGEST_KEY = ["network", "payload_digest"]


def identified(conversions: DataFrame) -> DataFrame:
    """Conversions that carry at least one of their two identities."""
    return conversions.filter(
        F.col("external_event_id").isNotNull() | F.col("payload_digest").isNotNull()
    )


#: Rows that one task may settle one by one.
FOLD_ROWS = 200_000


def ingest_conversions(new: DataFrame, existing: DataFrame, order: str, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """The new conversions that would be stored, taken one by one in ``order``.

    A row is refused if a stored row, or one accepted before it, has its event id or its
    payload digest. A refused row reserves nothing. ``order`` must be unique.

    One round accepts the rows that come first under every identity they have and drops what those rule out, which settles
    all but chains across both identities. Rows of what is left belong together if they are connected by identities: each
    group of up to ``fold_rows`` is settled in order inside one task. In larger groups rounds go on, each of
    which follows chains of forced choices to their ends.
    """
    rows = identified(new)
    for key in (EVENT_KEY, DIGEST_KEY):
        rows = rows.join(_known(existing, key), key, "left_anti")
    # Repeats of both identities at once, the usual retry, are dropped before any round.
    pair = ["network", "external_event_id", "payload_digest"]
    firsts = rows.groupBy(*pair).agg(F.min(order).alias(order)).select(order)
    rows = rows.join(firsts, order, "left_semi")
    open_rows = stored(rows.select(order, *pair), "open-conversions")
    leaders = open_rows
    for key in (EVENT_KEY, DIGEST_KEY):
        leaders = _only_first(leaders, open_rows, key, order)
    accepted = [stored(leaders, "accepted")]
    open_rows = _still_open(open_rows, accepted[0], order)
    left = open_rows.count()
    if left > fold_rows:
        grouped = stored(_grouped(open_rows), "grouped-conversions")
        sizes = grouped.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"))
        small = grouped.join(sizes.filter(F.col("_rows") <= fold_rows), "_group", "left_semi")
        accepted.append(_taken_in_order(small, order))
        open_rows = stored(grouped.join(sizes.filter(F.col("_rows") > fold_rows), "_group", "left_semi").drop("_group"), "open-conversions")
        while not open_rows.isEmpty():
            more = stored(_forced(open_rows, order), "accepted")
            accepted.append(more)
            open_rows = _still_open(open_rows, more, order)
    elif left:
        accepted.append(_taken_in_order(open_rows.withColumn("_group", F.lit(0).cast("bigint")), order))
    return new.join(union_all([a.select(order) for a in accepted]), order, "left_semi")


def _still_open(rows: DataFrame, accepted: DataFrame, order: str) -> DataFrame:
    rest = rows.join(accepted.select(order), order, "left_anti")
    for key in (EVENT_KEY, DIGEST_KEY):
        rest = rest.join(_known(accepted, key), key, "left_anti")
    return stored(rest.select(rows.columns), "open-conversions")


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows with the group that connects them. Identities are told apart by hashes: one too few makes a group larger, no more."""
    marks = {f"_{i}": F.when(F.col(k[1]).isNotNull(), F.xxhash64(F.lit(i), *k)) for i, k in enumerate((EVENT_KEY, DIGEST_KEY))}
    marked = rows.withColumns(marks)
    roots = connected(marked.filter("_0 is not null and _1 is not null").select(F.col("_0").alias("a"), F.col("_1").alias("b")))
    mark = F.coalesce("_0", "_1")
    joined = marked.join(roots, mark == F.col("node"), "left")
    return joined.select(*rows.columns, F.coalesce("root", mark).alias("_group"))


def _taken_in_order(rows: DataFrame, order: str) -> DataFrame:
    """The rows of each ``_group`` that are accepted if they are taken one by one; a group is one task's.

    A task takes its groups one after the other from one sorted stream, as a call per group costs more than a small group.
    """

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = None, set()
        for batch in batches:
            keep = []
            columns = (batch.column(c).to_pylist() for c in ("_group", "network", "external_event_id", "payload_digest"))
            for group, network, event, digest in zip(*columns):
                if group != current:
                    current, seen = group, set()
                marks = [(kind, network, value) for kind, value in (("e", event), ("d", digest)) if value is not None]
                keep.append(not any(m in seen for m in marks))
                if keep[-1]:
                    seen.update(marks)
            yield batch.select([order]).filter(pa.array(keep, pa.bool_()))

    named = rows.schema[order]
    sorted_rows = dealt(rows, "_group").sortWithinPartitions("_group", order)
    return sorted_rows.mapInArrow(settle, T.StructType([T.StructField(order, named.dataType)]))


def _forced(rows: DataFrame, order: str) -> DataFrame:
    """Rows that are surely accepted: those first under their identities, and those that follow from them alone.

    A row that is second under one identity and first under the other is accepted exactly if the first row under the former is
    not. Such rows point there; pointers are doubled until they reach a row that does not point on, and every second row on
    the way from an accepted one is accepted.
    """
    placed = rows
    for i, key in enumerate((EVENT_KEY, DIGEST_KEY)):
        along = W.partitionBy(*key).orderBy(order)
        known = rows.filter(F.col(key[1]).isNotNull()).select(order, *key)
        first_two = known.withColumn(f"_place{i}", F.row_number().over(along)).filter(F.col(f"_place{i}") <= 2)
        both = first_two.groupBy(*key).agg(F.min(order).alias(f"_first{i}"), F.max(order).alias("_second"))
        place = both.select(F.explode(F.array_distinct(F.array(f"_first{i}", "_second"))).alias(order), f"_first{i}")
        placed = placed.join(place, order, "left")
    leads, second = [], []
    for i, key in enumerate((EVENT_KEY, DIGEST_KEY)):
        first = F.col(f"_first{i}")
        leads.append(F.col(key[1]).isNull() | F.coalesce(first == F.col(order), F.lit(False)))
        second.append(F.coalesce(first != F.col(order), F.lit(False)))
    to = F.when(leads[0] & second[1], F.col("_first1")).when(leads[1] & second[0], F.col("_first0"))
    placed = stored(placed.select(*rows.columns, (leads[0] & leads[1]).alias("_leads"), to.alias("_to")), "placed")
    going = placed.filter("_to is not null").select(order, "_to", F.lit(1).alias("_odd"))
    while True:
        on = going.select(F.col(order).alias("_to"), F.col("_to").alias("_next"), F.col("_odd").alias("_more"))
        doubled = stored(going.join(on, "_to", "left"), "pointers")
        going = doubled.select(order, F.coalesce("_next", "_to").alias("_to"), F.when(F.col("_next").isNull(), F.col("_odd")).otherwise((F.col("_odd") + F.col("_more")) % 2).alias("_odd"))
        if doubled.filter("_next is not null").isEmpty():
            break
    leaders = placed.filter("_leads")
    even = going.filter("_odd = 0").join(leaders.select(F.col(order).alias("_to")), "_to", "left_semi").select(order)
    return leaders.select(*rows.columns).unionAll(placed.join(even, order, "left_semi").select(*rows.columns))


def _known(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.filter(F.col(key[1]).isNotNull()).select(*key)


def _only_first(leaders: DataFrame, rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Leaders that come first under ``key`` among ``rows``, or have no such key."""
    first = (
        rows.filter(F.col(key[1]).isNotNull())
        .groupBy(*key)
        .agg(F.min(order).alias("_first"))
        .select(F.col("_first").alias(order))
    )
    keyless = leaders.filter(F.col(key[1]).isNull())
    return leaders.filter(F.col(key[1]).isNotNull()).join(first, order, "left_semi").unionByName(keyless)


def events_by_link(events: DataFrame, link: str, at: str, width: str = "1 hour") -> DataFrame:
    """Events of each link per time window."""
    return events.groupBy(F.window(at, width).alias("w"), link).agg(
        F.count(F.lit(1)).alias("n")
    ).select(link, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def enrich_click(clicks: DataFrame, links: DataFrame, unit: str = "microsecond") -> DataFrame:
    """Clicks (click_id, software_id, at) with the link valid then; null where none was."""
    columns = ["click_id", *[c for c in clicks.columns if c != "click_id"]]
    return link_at(clicks, columns, links, unit, outer=True)


def conversions_to_clicks(conversions: DataFrame, clicks: DataFrame) -> DataFrame:
    """Conversions with their click and the click's link, both optional."""
    known = clicks.select(
        F.col("affiliate_click_id").cast("string").alias("_key"),
        F.col("affiliate_link_id").alias("click_link_id"),
        F.col("occurred_at").alias("clicked_at"),
    )
    return left_lookup(
        conversions, known, F.col("affiliate_click_id"), "affiliate_conversion_id"
    )


def expire_ip_hash(clicks: DataFrame, at: Column) -> DataFrame:
    """Clicks without the hashes that have expired. A hash without expiry is marked invalid."""
    expired = F.col("ip_hash_expires_at") <= at
    return clicks.withColumns(
        {
            "valid": F.col("ip_hash").isNull() | F.col("ip_hash_expires_at").isNotNull(),
            "ip_hash": F.when(F.coalesce(expired, F.lit(False)), F.lit(None)).otherwise(F.col("ip_hash")),
            "ip_hash_expires_at": F.when(
                F.coalesce(expired, F.lit(False)), F.lit(None)
            ).otherwise(F.col("ip_hash_expires_at")),
        }
    )
