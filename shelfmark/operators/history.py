"""Ordered events of an entity: latest entries, page views, first and last sighting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.keyed import top_per_key
from shelfmark.operators.ranks import previous

HISTORY_LIMIT = 50


def json_text(details: str, field: str) -> Column:
    """A JSON field's value if it is a string, else null."""
    value = F.variant_get(F.try_parse_json(F.col(details)), f"$.{field}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def latest(df: DataFrame, entity: Sequence[str], order: Sequence[Column], n: int = HISTORY_LIMIT):
    """The ``n`` latest events of every entity, newest first."""
    return top_per_key(df, entity, order, n)


def page_views(
    visits: DataFrame, session: str, at: str, identifier: str, path: str, skipped: Column
) -> DataFrame:
    """Views that count: not skipped, and not a repeat of the path seen just before.

    The path loses its query and fragment first; ``referrer`` is the previous path. A session may hold any number of views.
    """
    public = visits.filter(~skipped).withColumn(
        path, F.regexp_replace(F.col(path), r"[?#].*$", "")
    )
    looked = previous(public, [session], [at, identifier], path, "referrer")
    return looked.filter(F.col("referrer").isNull() | (F.col("referrer") != F.col(path)))


def seen_bounds(events: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at")
    )
