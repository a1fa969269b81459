"""Listing, search, paging and drill-down over a catalogue.

Tables use the catalogue's own column names (``software_id``, ``software_name``,
``category_id``, ...); callers rename their columns to these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.operators.keyed import fold_sorted, top_per_key
from shelfmark.operators.ranks import SortedIndex, positions
from shelfmark.session import dealt

PUBLISHED = "published"
PAGE_SIZE = 12
INDEX_PAGE_SIZE = 6


def published_only(
    df: DataFrame, column: str = "publication_status", value: str = PUBLISHED
) -> DataFrame:
    return df.filter(F.col(column) == value)


def id_in_list(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed; an empty list selects nothing."""
    return df.join(ids.select(key), key, "left_semi")


def matches_text(query: str, columns: Sequence[str]) -> Column:
    """Literal, case-blind substring in any of the columns."""
    wanted = F.lower(F.lit(query))
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), wanted), F.lit(False))
    return hit


def search_any(df: DataFrame, query: str | None, columns: Sequence[str]) -> DataFrame:
    return df.filter(matches_text(query, columns)) if query else df


def starts_with_letter(name: Column, letter: str) -> Column:
    return F.upper(F.substring(name, 1, 1)) == letter.upper()


def view_defaults(df: DataFrame) -> DataFrame:
    """Public item: unknown flags read as false, the vendor record's name wins over the text."""
    return df.select(
        F.col("software_id").alias("id"),
        F.col("software_name").alias("name"),
        "slug",
        F.coalesce("vendor_name", "vendor").alias("vendor_name"),
        F.coalesce("free_plan", F.lit(False)).alias("free_plan"),
        F.coalesce("free_trial", F.lit(False)).alias("free_trial"),
    )


def join_vendor(software: DataFrame, vendors: DataFrame) -> DataFrame:
    """Software with its vendor row nested, or null where there is none."""
    nested = vendors.select("vendor_id", F.struct(*vendors.columns).alias("vendors"))
    return software.join(nested, "vendor_id", "left")


def page_by_name(df: DataFrame, page: int, size: int, order: Sequence[str]) -> DataFrame:
    """One page in name order. A page past the end shows the last one.

    All rows before the page are ordered, too; for deep pages keep a ``ranks.SortedIndex``.
    """
    if page < 1 or size < 1:
        raise ValueError("page and size count from 1")
    if page > 1:
        last = max(1, -(-df.count() // size))
        page = min(page, last)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def az_index(df: DataFrame, letter: str, size: int = INDEX_PAGE_SIZE) -> DataFrame:
    """Total and page count of one letter, or of ``ALL``."""
    chosen = df if letter == "ALL" else df.filter(starts_with_letter(F.col("software_name"), letter))
    total = F.count(F.lit(1))
    return chosen.agg(
        total.alias("total"),
        F.greatest(F.lit(1).cast("long"), F.ceil(total / F.lit(size)).cast("long")).alias(
            "total_pages"
        ),
    )


def initials(df: DataFrame) -> DataFrame:
    """Letters A to Z that at least one name starts with."""
    letter = F.upper(F.substring("software_name", 1, 1)).alias("letter")
    return df.groupBy(letter).agg(F.count(F.lit(1)).alias("names")).filter("letter rlike '^[A-Z]$'")


def dashboard_counts(software: DataFrame, categories: DataFrame) -> DataFrame:
    """Five editorial counts: one aggregate pass per table."""

    def having(column: str, value: str) -> Column:
        return F.count_if(F.col(column) == value)

    left = software.agg(
        having("publication_status", "in_review").alias("software_in_review"),
        having("publication_status", PUBLISHED).alias("software_published"),
        having("verification_status", "needs_verification").alias("software_needs_verification"),
    )
    right = categories.agg(
        having("publication_status", "in_review").alias("categories_in_review"),
        having("publication_status", PUBLISHED).alias("categories_published"),
    )
    return _measures(left).unionByName(_measures(right))


def _measures(one_row: DataFrame) -> DataFrame:
    return one_row.unpivot([], one_row.columns, "measure", "total")


def review_queue(df: DataFrame, status: str, order: Sequence[str]) -> DataFrame:
    return df.filter(F.col("publication_status") == status).orderBy(*order)


def category_software(
    relations: DataFrame, software: DataFrame, category_id: object, page: int, size: int
) -> DataFrame:
    """A page of a category: its published products are cut by id, then shown by name."""
    of_category = relations.filter(F.col("category_id") == F.lit(category_id))
    cut = (
        id_in_list(of_category, published_only(software), "software_id")
        .select("software_id")
        .distinct()
        .orderBy("software_id")
        .offset((page - 1) * size)
        .limit(size)
    )
    return software.join(F.broadcast(cut), "software_id", "left_semi").orderBy(
        "software_name", "software_id"
    )


def category_index(relations: DataFrame, software: DataFrame) -> SortedIndex:
    """Published products of every category by id, for pages of any depth: a page reads the ranges it lies in."""
    pairs = relations.select("category_id", "software_id").distinct()
    return SortedIndex(id_in_list(pairs, published_only(software), "software_id"), ["software_id"], ["category_id"])


def software_categories_of(relations: DataFrame, categories: DataFrame) -> DataFrame:
    """Published categories of each product, each once."""
    return (
        relations.select("software_id", "category_id")
        .distinct()
        .join(published_only(categories), "category_id")
    )


def search_in_category(
    software: DataFrame,
    relations: DataFrame,
    categories: DataFrame,
    query: str,
    category_slug: str,
    columns: Sequence[str],
) -> DataFrame:
    """Published items of one category matching the query.

    Always at least one row: without items it carries the reason, ``category_unavailable``
    for an unknown category and ``no_matches`` otherwise.
    """
    chosen = published_only(categories).filter(F.col("slug") == category_slug)
    ids = relations.join(chosen.select("category_id"), "category_id", "left_semi")
    items = search_any(
        id_in_list(published_only(software), ids, "software_id"), query, columns
    ).select(
        F.col("software_id"),
        F.col("software_name"),
        F.lit("items").alias("outcome"),
    )
    known = chosen.agg((F.count(F.lit(1)) > 0).alias("known"))
    # ``known`` and the emptiness test are single rows, joined on a constant key.
    verdict = (
        known.withColumn("_one", F.lit(1))
        .join(items.agg((F.count(F.lit(1)) > 0).alias("any")).withColumn("_one", F.lit(1)), "_one")
        .filter(~F.col("any"))
        .select(
            F.lit(None).cast(items.schema["software_id"].dataType).alias("software_id"),
            F.lit(None).cast("string").alias("software_name"),
            F.when(F.col("known"), F.lit("no_matches"))
            .otherwise(F.lit("category_unavailable"))
            .alias("outcome"),
        )
    )
    return items.unionByName(verdict)


def first_by_id(relations: DataFrame, n: int) -> DataFrame:
    """The first ``n`` products of each category by id: page one of the category."""
    pairs = relations.select("category_id", "software_id").distinct()
    return top_per_key(pairs, ["category_id"], [F.col("software_id")], n, rank="_page_position")


def previews(
    categories: DataFrame,
    relations: DataFrame,
    software: DataFrame,
    n_categories: int = 4,
    n_items: int = 5,
) -> DataFrame:
    """Menu content: the first categories by name, each with its first page of products."""
    shown = (
        published_only(categories)
        .orderBy("category_name", "category_id")
        .limit(n_categories)
        .select("category_id", "category_name")
    )
    public = published_only(software).select("software_id", "software_name")
    members = relations.join(F.broadcast(shown), "category_id").join(
        public, "software_id", "left_semi"
    )
    return (
        first_by_id(members, n_items)
        .join(F.broadcast(shown), "category_id")
        .join(public, "software_id")
        .select("category_id", "category_name", "software_id", "software_name")
    )


def related(
    relations: DataFrame,
    categories: DataFrame,
    software: DataFrame,
    n_categories: int = 3,
    n_page: int = 7,
    n_shown: int = 6,
) -> DataFrame:
    """Related products of every product at once.

    A product takes its first categories by name, the first page of each, leaves itself
    out, keeps the first occurrence of an item and shows six. At most 21 rows per product
    are ever formed, whatever the size of its categories.
    """
    public = published_only(software).select("software_id", "software_name")
    named = published_only(categories).select("category_id", "category_name")
    pairs = relations.select("software_id", "category_id").distinct().join(named, "category_id")
    pairs = pairs.join(public.select("software_id"), "software_id", "left_semi")
    mine = top_per_key(
        pairs,
        ["software_id"],
        [F.col("category_name"), F.col("category_id")],
        n_categories,
        rank="_category_position",
    ).select("software_id", "category_id", "_category_position")
    shelf = (
        first_by_id(pairs, n_page)
        .join(public, "software_id")
        .select(
            "category_id",
            F.col("software_id").alias("related_id"),
            F.col("software_name").alias("related_name"),
        )
    )
    offered = (
        mine.join(shelf, "category_id")
        .filter(F.col("related_id") != F.col("software_id"))
        .groupBy("software_id", "related_id", "related_name")
        .agg(F.min("_category_position").alias("_category_position"))
    )
    return top_per_key(
        offered,
        ["software_id"],
        [F.col("_category_position"), F.col("related_name"), F.col("related_id")],
        n_shown,
    ).select("software_id", "related_id", "related_name", "position")


def visible_vendors(vendors: DataFrame, software: DataFrame) -> DataFrame:
    """Active vendors with at least one published product."""
    active = vendors.filter(F.col("status") == "active")
    return active.join(published_only(software).select("vendor_id"), "vendor_id", "left_semi")


def visible_relationships(
    relations: DataFrame, software: DataFrame, categories: DataFrame
) -> DataFrame:
    """Pairs whose both ends are published."""
    left = relations.join(published_only(software), "software_id", "left_semi")
    return left.join(published_only(categories), "category_id", "left_semi")


def review_detail(
    software: DataFrame, vendors: DataFrame, relations: DataFrame, categories: DataFrame
) -> DataFrame:
    """Every product with vendor and categories, one row per category, all states shown."""
    nested = relations.select("software_id", "category_id").join(
        categories.select("category_id", "category_name"), "category_id", "left"
    )
    return software.join(
        vendors.select("vendor_id", "vendor_name"), "vendor_id", "left"
    ).join(nested, "software_id", "left")


def review_fold(detail: DataFrame) -> DataFrame:
    """One row per product with its distinct categories as an array in name order.

    ``status`` is ``error`` where a category id comes without a name.
    """
    product = ["software_id", "software_name", "vendor_name"]
    # by all three: a join on the id before it would make dealing out by the id alone go away
    pairs = dealt(detail.select(*product, "category_id", "category_name"), *product).distinct()
    entry = F.when(F.col("category_id").isNotNull(), F.struct("category_name", "category_id"))
    folded = fold_sorted(pairs, product, entry, "categories")
    nameless = F.exists("categories", lambda c: text.is_blank(c["category_name"]))
    return folded.withColumn("status", F.when(nameless, "error").otherwise("success"))


def review_entries(detail: DataFrame) -> DataFrame:
    """What ``review_fold`` folds, as rows: each product's distinct categories with their place in name order.

    A product may have any number of categories; those without one have no rows.
    """
    columns = ["software_id", "category_name", "category_id"]
    pairs = dealt(detail.filter(F.col("category_id").isNotNull()).select(*columns), *columns).distinct()
    return positions(pairs, ["software_id"], ["category_name", "category_id"])


def distinct_paths(
    fixed: Sequence[str], categories: DataFrame, software: DataFrame
) -> DataFrame:
    """Public paths: fixed pages, categories and products, each once."""

    def under(df: DataFrame, prefix: str) -> DataFrame:
        slugs = published_only(df).filter(~text.is_blank(F.col("slug")))
        encoded = F.replace(F.url_encode("slug"), F.lit("+"), F.lit("%20"))
        return slugs.select(F.concat(F.lit(prefix), encoded).alias("path"))

    pages = categories.sparkSession.createDataFrame([(p,) for p in fixed], "path string")
    return (
        pages.unionByName(under(categories, "/categories/"))
        .unionByName(under(software, "/software/"))
        .distinct()
    )
