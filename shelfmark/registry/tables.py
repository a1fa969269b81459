"""The supplied tables under the catalogue's column names, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import table


def software(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("software_id"),
        F.col("p_name").alias("software_name"),
        F.col("p_brand").alias("vendor"),
        F.col("p_type").alias("pricing"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), "p_partkey").alias("slug"),
        F.when(F.col("p_size") < 25, "published")
        .when(F.col("p_size") < 40, "in_review")
        .otherwise("draft")
        .alias("publication_status"),
        F.when(F.col("p_retailprice") < 1000, "needs_verification")
        .otherwise("verified")
        .alias("verification_status"),
    )


SOFTWARE = """software as (
  select p_partkey as software_id, p_name as software_name, p_brand as vendor, p_type as pricing,
    replace(p_name, ' ', '-') || '-' || p_partkey as slug,
    case when p_size < 25 then 'published' when p_size < 40 then 'in_review' else 'draft' end
      as publication_status,
    case when p_retailprice < 1000 then 'needs_verification' else 'verified' end
      as verification_status
  from part)"""


def categories(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("category_id"),
        F.col("s_name").alias("category_name"),
        F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("slug"),
        F.when(F.col("s_acctbal") > 2000, "published")
        .otherwise("in_review")
        .alias("publication_status"),
    )


CATEGORIES = """categories as (
  select s_suppkey as category_id, s_name as category_name,
    lower(replace(s_name, '#', '-')) as slug,
    case when s_acctbal > 2000 then 'published' else 'in_review' end as publication_status
  from supplier)"""


def relations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("software_id"), F.col("l_suppkey").alias("category_id")
    )


RELATIONS = """relations as (
  select l_partkey as software_id, l_suppkey as category_id from lineitem)"""

WITH_ALL = f"with {SOFTWARE}, {CATEGORIES}, {RELATIONS}"
