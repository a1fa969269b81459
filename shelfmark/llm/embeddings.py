"""Embedding near-duplicates by int8 tile products with exact error bounds.

Unit vectors are rounded to int8 with one scale each, and the length of each rounding error is kept. For a tile,
two blocks of vectors of one label, the product of the int8 matrices gives every dot product up to a bound known
per pair; only pairs that could reach the threshold within it are computed again in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import written
from shelfmark.llm.components import components

#: Vectors of a block; a tile holds this many squared products.
BLOCK = 1024
#: Sign bits of fixed random directions by which blocks gather neighbours.
CODE_BITS = 20
SLACK = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, the scale of each, and the length of what rounding took from each row of ``x``."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of two int8 matrices: floats hold whole numbers up to 2**24 (or 2**53) exactly."""
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def linked(x: np.ndarray, y: np.ndarray, qx: tuple, qy: tuple, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``x`` and ``y`` with cosine of at least ``least``.

    With x = s q + e and y = t r + f, x.y differs from s t q.r by at most |e| |y| + |s q| |f|, and |y| = 1,
    |s q| <= 1 + |e|.
    """
    (q, s, e), (r, t, f) = qx, qy
    bound = e[:, None] + (1 + e)[:, None] * f[None, :]
    left, right = np.nonzero(products(q, r) * s[:, None] * t[None, :] + bound >= least - SLACK)
    hold = np.zeros(len(left), bool)
    for at in range(0, len(left), 100_000):  # a dense tile must not need its pairs' vectors at once
        i, j = left[at : at + 100_000], right[at : at + 100_000]
        a, b = x[i], y[j]
        dot = np.einsum("ij,ij->i", a, b)
        hold[at : at + 100_000] = dot / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)) >= least
    return left[hold], right[hold]


def _forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest node it is connected with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def signed(vectors: DataFrame, identifier: str, vector: str, label: str) -> DataFrame:
    """(id, label, sig, code, vector): sig names label and components; null where the vector links with nothing."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, codes = [], []
            labels = batch.column("label").to_pylist()
            column = batch.column("vector")
            for i, name in enumerate(labels):
                item = column[i]
                row = np.array(item.as_py(), float) if name is not None and item.is_valid else np.zeros(0)
                # None became nan
                # a length of zero is also that of a vector too small for one in double precision
                if not len(row) or not np.isfinite(row).all() or not 0 < np.linalg.norm(row) < np.inf:
                    sigs.append(None)
                    codes.append(0)
                    continue
                key = repr(name).encode() + b"\0" + (row + 0.0).tobytes()
                sigs.append(hashlib.blake2b(key, digest_size=16).hexdigest())
                codes.append(int(((_directions(len(row)) @ row) >= 0) @ (1 << np.arange(CODE_BITS - 1, -1, -1))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(sigs, pa.string()), pa.array(codes, pa.int32()), column],
                names=["id", "label", "sig", "code", "vector"],
            )

    narrow = vectors.select(F.col(identifier).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    return narrow.mapInArrow(run, f"id {kinds[identifier]}, label {kinds[label]}, sig string, code int, vector {kinds[vector]}")


_DIRECTIONS: dict[int, np.ndarray] = {}


def _directions(width: int) -> np.ndarray:
    if width not in _DIRECTIONS:
        _DIRECTIONS[width] = np.random.default_rng(width).standard_normal((CODE_BITS, width))
    return _DIRECTIONS[width]


def blocks(classes: DataFrame) -> DataFrame:
    """One row per block of at most about ``BLOCK`` vectors of one label and width, with its int8 matrix.

    Blocks of a large label are cells of the sign code, so that neighbours tend to share them; a full cell
    is dealt to several. Each block carries its centre and the widest angle from it, by which tiles are left out.
    """
    group = ["label", "width"]
    sized = classes.withColumn("width", F.size("vector"))
    counted = sized.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    depth = F.least(F.lit(CODE_BITS), F.floor(F.log2(F.greatest(F.col("_n") / BLOCK, F.lit(1.0)))).cast("int"))
    depths = counted.select(*group, depth.alias("_depth"))
    celled = sized.join(depths, group).withColumn("cell", F.expr(f"shiftright(code, {CODE_BITS} - _depth)"))
    cells = celled.groupBy(*group, "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("_parts"))
    dealt = celled.join(cells, [*group, "cell"]).withColumn("part", F.pmod(F.xxhash64("sig"), F.col("_parts")))
    kind = classes.schema["label"].dataType.simpleString()

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        x = np.array([np.asarray(v, float) for v in frame["vector"]])
        unit = _unit(x)
        q, scale, error = quantise(unit)
        centre = unit.sum(axis=0)
        norm = np.linalg.norm(centre)
        centre = centre / norm if norm > 0 else centre
        angle = float(np.arccos(np.clip((unit @ centre).min(), -1, 1))) if norm > 0 else np.pi
        row = frame.iloc[0]
        return pd.DataFrame(
            {
                "label": [row["label"]], "width": [int(row["width"])], "block": [f"{row['cell']}-{row['part']}"], "centre": [centre.tolist()], "angle": [angle],
                "ids": [frame["id"].to_numpy(np.int64).tobytes()], "weights": [frame["weight"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()],
                "q": [q.tobytes()], "scale": [scale.tobytes()], "error": [error.tobytes()],
            }
        )

    schema = f"label {kind}, width int, block string, centre array<double>, angle double, ids binary, weights binary, vectors binary, q binary, scale binary, error binary"
    return dealt.select(*group, "cell", "part", "id", "weight", "vector").groupBy(*group, "cell", "part").applyInPandas(pack, schema)


def _read(row: dict, side: str, width: int) -> tuple:
    get = lambda name, kind: np.frombuffer(row[f"{side}_{name}"], kind)
    x = get("vectors", float).reshape(-1, width)
    return get("ids", np.int64), get("weights", np.int64), x, (get("q", np.int8).reshape(-1, width), get("scale", float), get("error", float))


def _tiles(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Per tile and vector: how many it links with (copies counted), and a vector it is connected with."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            a, wa, x, qx = _read(row, "l", row["width"])
            same = row["l_block"] == row["r_block"]
            b, wb, y, qy = (a, wa, x, qx) if same else _read(row, "r", row["width"])
            left, right = linked(x, y, qx, qy, least)
            if same:
                left, right = left[left < right], right[left < right]
            ids = a if same else np.concatenate([a, b])
            shift = 0 if same else len(a)
            links = np.bincount(left, wb[right], len(ids)) + np.bincount(right + shift, wa[left], len(ids))
            root = _forest(left, right + shift, len(ids))
            least_id = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(least_id, root, ids)
            hit = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_pydict({"id": ids[hit], "links": links[hit].astype(np.int64), "other": least_id[root[hit]]})


def near_duplicates(
    vectors: DataFrame, identifier: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93
) -> DataFrame:
    """(identifier, n_links, component_id, kept) for each row of ``vectors``; identifiers are bigint.

    Rows link if their labels are equal and not null, their widths equal, and their cosine, in double
    precision, is at least ``least``. Vectors that are null, empty, zero, or hold a null or non-finite
    component link with nothing and stand alone. Equal vectors of a label are one class with a weight, so
    large groups of copies cost no pairs; a tile returns counts and one edge per vector, never its pairs. Rows
    with a repeated identifier count as rows. A row without identifier stands alone. Other columns are left
    out.
    """
    marked = written(signed(vectors, identifier, vector, label), "vectors")
    usable = marked.filter(F.col("sig").isNotNull() & F.col("id").isNotNull())
    classes = usable.groupBy("sig").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("code").alias("code"), F.first("vector").alias("vector")
    )
    packed = written(blocks(classes), "blocks")
    light = packed.select("label", "width", "block", "centre", "angle")
    cosine = F.aggregate(F.zip_with("l.centre", "r.centre", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    apart = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))) - F.col("l.angle") - F.col("r.angle")
    in_reach = (F.col("l.angle") + F.col("r.angle") >= 3.1) | (apart <= float(np.arccos(least)) + 1e-6)
    pairs = (
        light.alias("l")
        .join(light.alias("r"), [F.col("l.label") == F.col("r.label"), F.col("l.width") == F.col("r.width"), F.col("l.block") <= F.col("r.block")])
        .filter((F.col("l.block") == F.col("r.block")) | in_reach)
        .select(F.col("l.label").alias("label"), F.col("l.width").alias("width"), F.col("l.block").alias("l_block"), F.col("r.block").alias("r_block"))
    )
    heavy = ["ids", "weights", "vectors", "q", "scale", "error"]

    def side(name: str) -> DataFrame:
        return packed.select("label", "width", F.col("block").alias(f"{name}_block"), *[F.col(c).alias(f"{name}_{c}") for c in heavy])

    tiles = pairs.join(side("l"), ["label", "width", "l_block"]).join(side("r"), ["label", "width", "r_block"])
    found = written(
        tiles.drop("label").mapInArrow(lambda batches: _tiles(batches, least), "id bigint, links bigint, other bigint"), "tiles"
    )
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    settled = (
        classes.select("sig", "id", "weight")
        .join(counts, "id", "left")
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
        .select("sig", "weight", "links", F.coalesce("root", "id").alias("root"))
    )
    rows = marked.select("id", F.when(F.col("id").isNotNull(), F.col("sig")).alias("sig"))
    lonely = rows.filter(F.col("sig").isNull()).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    joined = rows.filter(F.col("sig").isNotNull()).join(settled, "sig").select(
        "id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.col("root").alias("component_id")
    )
    both = joined.unionAll(lonely)
    return both.select(F.col("id").alias(identifier), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
