"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of 64 bits are eight positional bytes. Two that differ in at most two bits share at least
six of them. The index posts each distinct fingerprint under combinations of its bytes chosen so that any
such pair meets in at least one posting list; there the shared bytes of a pair are tallied, pairs with
fewer than six dropped, and the rest verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import LOWER, SPACES, Texts, small_batches, texts, word_table, words, written
from shelfmark.llm.components import components

SEED = 42
#: Longest posting list whose pairs are tallied; members of longer ones meet by their neighbours instead.
LIST_LENGTH = 32
_INSIDE = word_table(SPACES)


def _single_spaced(part: Texts) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Row of each word; all words with one space between them, and where each starts and stops there."""
    row, start, stop = words(part, _INSIDE)
    length = stop - start
    ends = np.cumsum(length + 1)
    new = ends - length - 1
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    out[np.repeat(new - start, length) + np.flatnonzero(_INSIDE[part.data])] = LOWER[part.data[_INSIDE[part.data]]]
    return row, out.tobytes(), new, new + length


def fingerprints(part: Texts, shingle: int) -> np.ndarray:
    """A fingerprint per row: bit set where more than half of the shingle hashes have it."""
    row, line, start, stop = _single_spaced(part)
    counts = np.bincount(row, minlength=part.rows)
    first = np.cumsum(counts) - counts
    index = np.arange(len(row)) - first[row]
    # a row of fewer words than a shingle is one shingle
    begin = np.flatnonzero(np.where(counts[row] < shingle, index == 0, index <= counts[row] - shingle))
    last = begin + np.minimum(counts[row[begin]], shingle) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:z], SEED) for a, z in zip(start[begin].tolist(), stop[last].tolist())]
    out = np.zeros(part.rows, np.uint64)
    if not hashes:
        return out
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    owner = row[begin]
    heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    ones = np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    total = np.diff(np.append(heads, len(owner)))
    voted = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little")
    out[owner[heads]] = voted.view("<u8").ravel()
    return out


def fingerprinted(docs: DataFrame, identifier: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(identifier, fp) for each row, fp a signed bigint with the fingerprint's bits. Null texts are empty: 0."""
    small_batches(docs.sparkSession)
    kind = docs.schema[identifier].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints(p, shingle) for p in texts(batch.column("_text"))]
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(flat.view(np.int64))], names=[identifier, "fp"])

    narrow = docs.select(F.col(identifier).alias("_id"), F.col(text).alias("_text"))
    return narrow.mapInArrow(run, f"`{identifier}` {kind}, fp bigint")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def _keys(bits: int) -> list[tuple[int, ...]]:
    """Byte positions of each key: with ``bits`` bytes changed, the bytes of at least one key are unchanged.

    The eight positions are cut into ``bits + 2`` runs; a key leaves out ``bits`` of them.
    """
    runs = [tuple(int(x) for x in r) for r in np.array_split(np.arange(8), min(8, bits + 2))]
    return [sum(chosen, ()) for chosen in combinations(runs, max(1, len(runs) - bits))]


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints (column fp, distinct) that ``bits`` steps connect.

    Posting lists up to LIST_LENGTH are joined with themselves, with tally and check in the join.
    A longer list could hold a whole group of near copies; its members are posted under every
    fingerprint at half the distance instead. Two within ``bits`` meet at one of those, and whoever meets
    there is within ``bits``, so linking to the smallest member loses and adds nothing. Each list has at
    most as many members as there are such fingerprints, 65 for two bits. For other than two bits all
    pairs of long lists are tallied too.
    """
    keys = _keys(bits)
    fp = F.col("fp")
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("key"), sum((F.shiftleft(_byte(fp, p), 8 * n) for n, p in enumerate(k)), F.lit(0).cast("bigint")).alias("part"))
            for i, k in enumerate(keys)
        ]
    )
    postings = fps.select("fp", F.inline(entries))
    lengths = postings.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    listed = written(postings.join(lengths, ["key", "part"]), "postings")
    short = listed.filter(F.col("n") <= LIST_LENGTH) if bits == 2 else listed
    x, y = F.col("x.fp"), F.col("y.fp")
    tally = sum((F.when(_byte(x, p) == _byte(y, p), 1).otherwise(0) for p in range(8)), F.lit(0))
    pairs = (
        short.alias("x")
        .join(short.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & (x < y) & (tally >= 8 - bits) & (F.bit_count(x.bitwiseXOR(y)) <= bits))
        .select(y.alias("a"), x.alias("b"))
    )
    if bits != 2:
        return pairs
    long = listed.filter(F.col("n") > LIST_LENGTH).select("fp").distinct()
    ball = F.array(fp, *[fp.bitwiseXOR(F.lit(int(np.uint64(1 << i).astype(np.int64)))) for i in range(64)])
    met = long.select("fp", F.explode(ball).alias("at")).groupBy("at").agg(F.collect_list("fp").alias("fps"))
    near = met.filter(F.size("fps") > 1).select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a <> b")
    return pairs.unionAll(near)


def near_duplicates(
    docs: DataFrame, identifier: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 2
) -> DataFrame:
    """(identifier, fingerprint, component_id) for each row of ``docs``.

    ``fingerprint``: 16 hexadecimal digits. ``component_id``: the smallest identifier among rows reachable by
    steps of at most ``bits`` differing bits. Null and empty texts have fingerprint zero and link like any
    other. Rows that repeat an identifier are kept and linked by their own texts. Null identifiers are
    never the smallest; a component of such rows only has a null id. Other columns are left out.
    """
    marked = written(fingerprinted(docs, identifier, text, shingle), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min(identifier).alias("_first"))
    roots = components(links(classes.select("fp"), bits)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    settled = written(rooted.join(smallest, "root").select("fp", "component_id"), "classes")
    return marked.join(settled, "fp").select(identifier, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
