"""Result tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import scratch_path


def write_result(
    df: DataFrame, decision: str, path: str | None = None, form: str = "parquet"
) -> DataFrame:
    """Write rows in one folder per decision and return the written table.

    Rows go to a new folder, so a repeated attempt of a lost task leaves no half result.
    """
    target = path or scratch_path(df.sparkSession, "result")
    df.write.partitionBy(decision).format(form).save(target)
    return df.sparkSession.read.schema(df.schema).format(form).load(target)


def provenance(acquired: DataFrame) -> DataFrame:
    """One row per product: what was acquired, or why nothing was."""
    won = F.col("status") == "success"
    path = F.concat(F.lit("/software-logos/"), "slug", F.lit("."), "extension")

    def only(condition: Column, column: str) -> Column:
        return F.when(condition, F.col(column)).alias(column)

    return acquired.select(
        "slug",
        "name",
        F.col("vendor_name").alias("vendor"),
        "status",
        *[only(won, c) for c in ("source_kind", "source_url", "width", "height", "sha256")],
        F.when(won, path).alias("asset_path"),
        *[only(~won, c) for c in ("reason", "page_http_status", "invalid_candidates")],
    )


def asset_manifest(provenance_rows: DataFrame) -> DataFrame:
    """Slug and asset of each product that has one."""
    return provenance_rows.filter("status = 'success'").select(
        "slug",
        F.col("asset_path").alias("src"),
        F.concat("name", F.lit(" logo")).alias("alt"),
    )


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "bytes") -> int:
    """Writes each row as a file of its own, and says how many there are.

    A file gets its name once it is whole, and a repeated task writes the same again, so a lost executor leaves no half file.
    Names must be unique and hold no folder.
    """
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, data in zip(batch.column("name").to_pylist(), batch.column("bytes").to_pylist()):
                part = f"{root}/_{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(data or b"")
                system.move(part, f"{root}/{file}")
            yield pa.RecordBatch.from_pydict({"files": [batch.num_rows]})

    rows = df.select(F.col(name).alias("name"), F.col(content).alias("bytes"))
    return rows.mapInArrow(run, "files bigint").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
