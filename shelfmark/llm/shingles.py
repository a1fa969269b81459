"""Near copies by SimHash fingerprints of word shingles, verified by Jaccard similarity and completed by prefix filtering.

Fingerprints find most copies, as op10 does; pairs are checked by their shingles. A fingerprint misses pairs of a lower
similarity, so prefix filtering finds the rest. Shingles have one order for all texts, rare ones first. Two sets that are similar enough share a shingle among
the first few of each, so only those are posted, and no such pair is missed. Texts whose similarity follows
from links found before are not compared: each text is first compared with the one that leads most of its posting
lists, and then only with those of its lists that are in another component. The parities of a set, a few bits for
each shingle, tell most pairs that are not similar, so that few whole sets are sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import simhash
from shelfmark.llm.common import Rolling, Texts, drop, mixed, small_batches, texts, written
from shelfmark.llm.components import components
from shelfmark.llm.simhash import _single_spaced

SHINGLE = 5
#: Differing bits up to which fingerprints link.
BITS = 2
#: Similarity from which two texts are near copies, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: Rows from which common shingles are learned, and counters for them. They set the order only: any order finds all pairs.
SAMPLE_ROWS, COUNTERS = 10_000, 1 << 18
#: Words of parities that go with each posting.
SHORT = 4
#: Leaders that a set is compared with at first.
LEADERS = 3
#: Bits for the classes whose sets are asked for; others of the same bits are sorted out afterwards.
ASKED_BITS = 1 << 24
#: Bytes of texts that one round of numpy work takes.
CHUNK = 250_000


class Shingles:
    """Hashes the distinct word shingles of texts."""

    def __init__(self, shingle: int = SHINGLE):
        self.hasher, self.shingle = Rolling(11), shingle

    def __call__(self, part: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash), distinct and in order of both. A row of fewer words than a shingle is one shingle."""
        row, line, start, stop = _single_spaced(part)
        counts = np.bincount(row, minlength=part.rows)
        index = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
        begin = np.flatnonzero(np.where(counts[row] < self.shingle, index == 0, index <= counts[row] - self.shingle))
        last = begin + np.minimum(counts[row[begin]], self.shingle) - 1
        found = self.hasher.spans(self.hasher.prefix(np.frombuffer(line, np.uint8)), start[begin], stop[last])
        owner = row[begin]
        order = np.lexsort((found, owner))
        owner, found = owner[order], found[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
        return owner[new], found[new]


def _class(part: Texts, row: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each row's set, and its size; 0 and 0 for a row without words."""
    size = np.bincount(row, minlength=part.rows)
    out = np.zeros(part.rows, np.uint64)
    if len(row):
        heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        out[row[heads]] = mixed(np.add.reduceat(mixed(found), heads) + size[row[heads]].astype(np.uint64))
    return out.view(np.int64), size


def _lists(row: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
    offsets = np.append(0, np.cumsum(np.bincount(row, minlength=rows))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _parities(row: np.ndarray, found: np.ndarray, held: np.ndarray) -> pa.Array:
    """For each set, in ``held`` words of 64 bits, whether an odd number of its shingles has each remainder by that many bits.

    Words are a power of two. Each shingle that only one of two sets holds changes one bit, so no more bits differ than
    there are such shingles. The halves of a set's parities, added bit by bit, are its parities in half as many words.
    """
    first = np.cumsum(held) - held
    place = 64 * first[row] + (found & (64 * held[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(place, minlength=64 * int(held.sum())) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)).astype(np.int32)), pa.array(np.packbits(odd, bitorder="little").view(np.int64)))


def _words_for(size: np.ndarray) -> np.ndarray:
    """Words of parities for sets of these sizes: a bit for each shingle at least."""
    return 1 << np.ceil(np.log2(np.maximum(-(-size // 64), 1))).astype(np.int64)


def able(n: tuple[Column, Column], parities: tuple[Column, Column]) -> Column:
    """Whether sets of these sizes and parities can be similar; false only if they are not."""
    part, whole = SIMILAR
    fits = F.least(*n) * whole >= F.greatest(*n) * part
    # sizes that fit differ by less than twice, so bits by twice at most
    words = F.least(*[F.size(p) for p in parities])
    x, y = (F.when(F.size(p) > words, F.zip_with(F.slice(p, F.lit(1), words), F.slice(p, words + 1, words), lambda a, b: a.bitwiseXOR(b))).otherwise(p) for p in parities)
    differ = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, bits: total + bits)
    return fits & (differ * (whole + part) <= (n[0] + n[1]) * (whole - part))


def _counts(docs: DataFrame, text: str, shingle: int) -> np.ndarray:
    """How often the shingles of each counter come up in a sample of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = Shingles(shingle), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in texts(batch.column("text"), CHUNK):
                total += np.bincount(find(part)[1] & np.uint64(COUNTERS - 1), minlength=COUNTERS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"counter": some.astype(np.int32), "n": total[some]})

    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    sample = docs.select(F.col(text).alias("text")).sample(share, 1).repartition(8)
    found = sample.mapInArrow(run, "counter int, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(COUNTERS, np.int64)
    out[found["counter"]] = found["n"]
    return out


def _bits_of(classes: DataFrame) -> np.ndarray:
    """Words of ``ASKED_BITS`` bits, set where the last bits of a class point."""
    place = F.col("_class").bitwiseAND(F.lit(ASKED_BITS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    found = classes.select(F.shiftright(place, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(ASKED_BITS // 64, np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def classified(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, sets: bool = False, among: np.ndarray | None = None) -> DataFrame:
    """``docs`` without the text, with ``_class``, which texts of the same shingles share, and with ``sets`` their shingles ``_set``.

    A set holds half of each hash, which is half as much to store and send. Of ``among``, made by ``_bits_of``, rows of
    other classes are left out, but for a few of the same bits.
    """
    held = docs.sparkSession.sparkContext.broadcast(among) if among is not None else None
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["_class bigint"] + ["_set array<int>"] * sets)
    names = [*[f.name for f in kept], "_class", *["_set"] * sets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Shingles(shingle)
        for batch in batches:
            marks, lists = [pa.array([], pa.int64())], [pa.array([], pa.list_(pa.int32()))]
            for part in texts(batch.column("_text"), CHUNK):
                row, found = find(part)
                marks.append(pa.array(_class(part, row, found)[0]))
                if sets:
                    lists.append(_lists(row, (found >> np.uint64(32)).astype(np.uint32).view(np.int32), part.rows))
            made = [pa.concat_arrays(marks), *[pa.concat_arrays(lists)] * sets]
            rows = pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *made], names=names)
            if held is not None:
                place = np.asarray(made[0]).view(np.uint64) & np.uint64(ASKED_BITS - 1)
                rows = rows.filter(pa.array((held.value[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)))
            yield rows

    return docs.select(*[f.name for f in kept], F.col(text).alias("_text")).mapInArrow(run, schema)


def _postings(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """(_class, n, keys, parities, short): size, first shingles, parities and parities in ``SHORT`` words of each set, distinct."""
    shared = docs.sparkSession.sparkContext.broadcast(_counts(docs, text, shingle))
    part_, whole = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Shingles(shingle)
        for batch in batches:
            for part in texts(batch.column("text"), CHUNK):
                row, found = find(part)
                mark, size = _class(part, row, found)
                order = np.lexsort((found, shared.value[found & np.uint64(COUNTERS - 1)], row))
                row, found = row[order], found[order]
                at = np.arange(len(row)) - (np.cumsum(size) - size)[row]
                first = at < (size - -(-size * part_ // whole) + 1)[row]
                columns = [pa.array(mark), pa.array(size.astype(np.int32)), _lists(row[first], found[first].view(np.int64), part.rows)]
                columns += [_parities(row, found, held) for held in (_words_for(size), np.full(part.rows, SHORT))]
                yield pa.RecordBatch.from_arrays(columns, names=["_class", "n", "keys", "parities", "short"])

    made = docs.select(F.col(text).alias("text")).mapInArrow(run, "_class bigint, n int, keys array<bigint>, parities array<bigint>, short array<bigint>")
    return made.filter("n > 0").dropDuplicates(["_class"])


def fingerprint_pairs(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Pairs (a, b) of different classes, a the larger, that connect all whose fingerprints ``BITS`` steps connect.

    Classes of one fingerprint are paired with the smallest of them; smallest ones as the index of ``simhash`` links
    their fingerprints. Texts without words are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Shingles(shingle)
        for batch in batches:
            for part in texts(batch.column("text"), CHUNK):
                mark, size = _class(part, *find(part))
                columns = [pa.array(mark), pa.array(size > 0), pa.array(simhash.fingerprints(part, shingle).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["_class", "worded", "fp"])

    made = docs.select(F.col(text).alias("text")).mapInArrow(run, "_class bigint, worded boolean, fp bigint")
    # texts of the same shingles differ in fingerprint if they repeat them differently
    marked = written(made.filter("worded").select("_class", "fp").distinct(), "shingle-fingerprints")
    first = written(marked.groupBy("fp").agg(F.min("_class").alias("first")), "fingerprint-first")
    same = marked.join(first, "fp").select(F.col("_class").alias("a"), F.col("first").alias("b"))
    ends = [first.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}")) for c in ("a", "b")]
    near = simhash.links(first.select("fp"), BITS).join(ends[0], "a").join(ends[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    met = same.unionAll(near).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = written(met.distinct(), "fingerprint-pairs")
    drop(marked, first)
    return pairs


def links(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Edges (a, b) between classes of ``docs`` that connect exactly those that similar pairs connect.

    The first round takes pairs of near fingerprints, and each class with the leaders of most of its lists.
    A list then costs as many comparisons as it has pairs of members from different components:
    few for a group of near copies of any size. Sets are sent only for pairs whose parities allow it, and that what was
    found before does not connect.
    """
    small_batches(docs.sparkSession)
    near = fingerprint_pairs(docs, text, shingle)
    part_, whole = SIMILAR
    # stored: the sides of the join read other columns, so that each would make the postings from the texts, both at once
    postings = written(_postings(docs, text, shingle), "shingle-postings")
    posted = postings.select("_class", "n", F.posexplode("keys").alias("at", "key"))
    lengths = posted.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("_class").alias("leader")).filter("members > 1").drop("members")
    listed = written(posted.join(lengths, "key"), "shingle-lists")
    marked = written(postings.select("_class", "n", "parities", "short"), "shingle-parities")
    drop(postings)

    def likely(pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) that can be similar, a the larger, distinct."""
        ends = [marked.select(F.col("_class").alias(c), F.struct("n", "parities").alias(f"_{c}")) for c in ("a", "b")]
        met = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(ends[0], "a").join(ends[1], "b")
        held = met.filter(able((F.col("_a.n"), F.col("_b.n")), (F.col("_a.parities"), F.col("_b.parities"))))
        return written(held.select("a", "b"), "shingle-pairs")

    def sets_of(pairs: DataFrame) -> DataFrame:
        """(_class, _set) of all classes of pairs (a, b)."""
        asked = written(pairs.select(F.explode(F.array("a", "b")).alias("_class")).distinct(), "shingle-asked")
        sets = classified(docs.select(text), text, shingle, sets=True, among=_bits_of(asked))
        held = written(sets.dropDuplicates(["_class"]).join(asked, "_class", "left_semi"), "shingle-sets")
        drop(asked)
        return held

    def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The similar ones of pairs (a, b)."""
        both = pairs.join(sets.select(F.col("_class").alias("a"), F.col("_set").alias("x")), "a").join(sets.select(F.col("_class").alias("b"), F.col("_set").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return written(both.filter(shared * whole >= (F.size("x") + F.size("y") - shared) * part_).select("a", "b"), "shingle-links")

    def led(lists: DataFrame) -> DataFrame:
        """Pairs of each class with the leaders of most of its lists."""
        counts = lists.filter("_class <> leader").groupBy("_class", "leader").agg(F.count(F.lit(1)).alias("lists"))
        best = F.slice(F.sort_array(F.collect_list(F.struct("lists", "leader")), False), 1, LEADERS)
        return counts.groupBy(F.col("_class").alias("a")).agg(best.alias("best")).select("a", F.explode("best.leader").alias("b"))

    pairs = likely(led(listed).unionAll(near))
    drop(near)
    sets = sets_of(pairs)
    found = similar(pairs, sets)
    drop(pairs, sets)
    roots = components(found).withColumnRenamed("node", "_class")
    rooted = written(listed.drop("leader").join(roots, "_class", "left").withColumn("root", F.coalesce("root", "_class")), "shingle-rooted")
    drop(listed)
    # the largest component of a list meets the others only, so that its own members are not paired
    sizes = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("rows"))
    most = sizes.groupBy("key").agg(F.max(F.struct("rows", "root"))["root"].alias("most"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").drop("roots")
    short = marked.select("_class", *[F.col("short")[i].alias(f"p{i}") for i in range(SHORT)])
    lists = written(rooted.join(most, "key").join(short, "_class"), "shingle-mixed")
    drop(rooted)
    x, y = lists.filter("root <> most").alias("x"), lists.alias("y")
    least = (F.col("x.n") + F.col("y.n")) * part_ / (whole + part_)
    # what is left of either set from the shared shingle on holds all that they share, if it is the first
    enough = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= least - 1e-6
    once = (F.col("y.root") == F.col("y.most")) | (F.col("x.root") < F.col("y.root"))
    differ = sum(F.bit_count(F.col(f"x.p{i}").bitwiseXOR(F.col(f"y.p{i}"))) for i in range(SHORT))
    enough &= differ * (whole + part_) <= (F.col("x.n") + F.col("y.n")) * (whole - part_)
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & once & enough)
    pairs = likely(met.select(F.col("x._class").alias("a"), F.col("y._class").alias("b")))
    drop(lists, marked)
    # a group whose members are still apart has the square of them in pairs: each goes first with its smallest, the others if still apart
    sets = sets_of(pairs)
    found = found.unionAll(similar(pairs.groupBy("a").agg(F.min("b").alias("b")), sets))
    roots = components(found)
    ends = [roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in ("a", "b")]
    apart = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").filter(F.coalesce("_a", "a") != F.coalesce("_b", "b"))
    found = found.unionAll(similar(apart.select("a", "b"), sets))
    drop(pairs, sets)
    return found


def first_of_near_copies(docs: DataFrame, identifier: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each group that pairs of a shingle similarity of at least ``SIMILAR`` connect.

    It is that with the smallest identifier; rows without one come last, of equal identifiers that with the smaller
    hash of its shingles goes first. Texts of fewer words than a shingle are one shingle; those without words are alike.
    """
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(identifier).alias("_id"), F.col(text).alias("_body"))
    rows = classified(whole, "_body", shingle)
    narrow = classified(whole.drop("row"), "_body", shingle)
    roots = components(links(docs, text, shingle)).withColumnRenamed("node", "_class")
    least = written(narrow.groupBy("_class").agg(F.min("_id").alias("_id")), "shingle-classes")
    rooted = least.join(roots, "_class", "left").withColumn("root", F.coalesce("root", "_class"))
    chosen = rooted.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_class")).alias("m")).select("m._id", "m._class")
    chosen = written(chosen, "shingle-first")
    # a struct is never null and equals one of the same value or of none, so rows are dealt out once for the join and the duplicates
    keys = ["_class", "_key"]
    kept = rows.withColumn("_key", F.struct("_id")).join(chosen.select("_class", F.struct("_id").alias("_key")), keys, "left_semi")
    return kept.dropDuplicates(keys).select("row.*")
