"""Language identification by nearest centroid of normalised TF-IDF n-gram vectors.

N-grams of two and three bytes of the lower-cased letters are hashed to a fixed number of features.
Document frequencies come from all training rows; centroids from a bounded sample of them, several
per language, by spherical k-means, so that one language may have several kinds of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfmark.llm.common import Texts, broadcast_up_to, small_batches, texts, word_table
from shelfmark.operators.keyed import top_per_key

FEATURES = 4096
#: Training rows of a language from which centroids are made; document frequencies use all rows.
SAMPLE_ROWS = 1500
CENTROIDS = 4
#: A text is rejected if its cosine is below this quantile of those of sampled texts, whole or cut, with about as many
#: n-grams, against centroids made without them. Classes of fewer texts take the floor of the next shorter class.
REJECT_SHARE, LEAST_TEXTS = 0.002, 20
#: The floor of the shortest class if it has too few texts, as a part of the lowest cosine.
REJECT_PART = 0.25
#: Characters to which sampled texts are cut, and classes of length: powers of two n-grams.
CUTS, CLASSES = (20, 40, 80, 160, 320, 640, 1280), 16
UNKNOWN = "und"
#: Bytes and rows of a round; each row takes FEATURES numbers.
SLICE, ROWS = 500_000, 300
#: Everything in ASCII that is no letter separates n-grams.
LETTERS = word_table(bytes(b for b in range(128) if not chr(b).isalpha()))


def _codes(part: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every n-gram. Runs of separators count as one space; none crosses rows."""
    data = np.where(LETTERS[part.data], part.data, np.uint8(32))
    row = part.ids()
    space = data == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (row[1:] == row[:-1]))
    data, row = data[keep].astype(np.uint32), row[keep]
    pairs = data[:-1] * np.uint32(0x9E3779B1) + data[1:] * np.uint32(0x85EBCA6B)
    triples = pairs[:-1] + data[2:] * np.uint32(0xC2B2AE35)
    out_rows, out_codes = [], []
    for n, code in ((2, pairs), (3, triples)):
        same = row[: len(code)] == row[n - 1 :]
        code = (code + np.uint32(n)) * np.uint32(0x27D4EB2F)
        out_rows.append(row[: len(code)][same])
        out_codes.append((code ^ (code >> np.uint32(15)))[same] % np.uint32(FEATURES))
    return np.concatenate(out_rows), np.concatenate(out_codes)


def counts(part: Texts) -> np.ndarray:
    """N-gram counts, one row of ``FEATURES`` numbers per text."""
    if not len(part.data):
        return np.zeros((part.rows, FEATURES), np.float32)
    row, code = _codes(part)
    flat = np.bincount(row * FEATURES + code, minlength=part.rows * FEATURES)
    return flat.reshape(part.rows, FEATURES).astype(np.float32)


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length one (or zero if nothing was found)."""
    weighted = np.sqrt(found) * idf
    norm = np.linalg.norm(weighted, axis=1, keepdims=True)
    return np.divide(weighted, norm, out=np.zeros_like(weighted), where=norm > 0)


def _spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Centres of length one, and each row's centre. The first centre is the mean; the next are far rows."""
    centres = rows.mean(axis=0, keepdims=True)
    centres /= max(np.linalg.norm(centres), 1e-12)
    while len(centres) < min(k, len(rows)):
        near = (rows @ centres.T).max(axis=1)
        # a low quantile rather than the farthest row: that one is often a fragment
        pick = rows[np.argsort(near, kind="stable")[len(rows) // 20]]
        centres = np.vstack([centres, pick])
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.vstack([rows[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres, (rows @ centres.T).argmax(axis=1)


def _length_class(found: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(found.sum(axis=1), 1)), 0, CLASSES - 1).astype(np.int64)


def _floors(given: list[str], rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Least cosine for each length class, from the vectors ``rows`` of texts of one language."""
    fold = np.arange(len(rows)) % 2
    if len(rows) < 2:
        return np.zeros(CLASSES)
    centres = [_spherical_kmeans(rows[fold != f], CENTROIDS)[0] for f in (0, 1)]
    size, near = [], []
    for cut in (*CUTS, None):
        some = [(t[:cut], f) for t, f in zip(given, fold) if cut is None or len(t) > cut]
        at = 0
        for part in texts(pa.array([t for t, _ in some], pa.string()), SLICE, ROWS):
            found = counts(part)
            cosine = vectors(found, idf)
            own = np.array([f for _, f in some[at : at + part.rows]])
            best = np.where(own == 0, (cosine @ centres[0].T).max(axis=1), (cosine @ centres[1].T).max(axis=1))
            size.append(np.where(found.any(axis=1), _length_class(found), -1))
            near.append(best)
            at += part.rows
    size, near = np.concatenate(size), np.concatenate(near)
    out, last = [], REJECT_PART * float(near[size >= 0].min(initial=1.0))
    for c in range(CLASSES):
        if (size == c).sum() >= LEAST_TEXTS:
            last = float(np.quantile(near[size == c], REJECT_SHARE, method="lower"))
        out.append(last)
    return np.array(out)


class Centroids:
    """A fitted model: as many numbers as languages * CENTROIDS * FEATURES, whatever the corpus."""

    def __init__(self, langs: list[str], matrix: np.ndarray, floors: np.ndarray, idf: np.ndarray):
        self.langs, self.matrix, self.floors, self.idf = langs, matrix, floors, idf

    def predict(self, part: Texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Nearest language, cosine, and whether it is too far, for each text."""
        if not self.langs:
            return [UNKNOWN] * part.rows, np.zeros(part.rows), np.ones(part.rows, bool)
        found = counts(part)
        cosine = vectors(found, self.idf) @ self.matrix.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(part.rows), best].astype(float), 0.0, 1.0)
        return [self.langs[b] for b in best], score, score < self.floors[best, _length_class(found)]


def _lowered(text: str) -> Column:
    return F.coalesce(F.lower(F.col(text)), F.lit(""))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Centroids:
    """A model from rows whose language is known; others must be filtered out before.

    The sample of a language is its ``SAMPLE_ROWS`` rows with the smallest hash of the key. A language whose sampled texts
    hold no n-gram (null, empty, no letters) is not learned; without any language all texts are rejected. Repeated rows count
    as often as they come up.
    """
    small_batches(docs.sparkSession)
    known = docs.select(
        F.col(lang).alias("lang"), _lowered(text).alias("text"), F.coalesce(F.xxhash64(F.col(key)), F.lit(0)).alias("pick")
    ).filter(F.col("lang").isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for part in texts(batch.column("text"), SLICE, ROWS):
                total += (counts(part) > 0).sum(axis=0)
                rows += part.rows
        found = np.append(total, rows)
        yield pa.RecordBatch.from_pydict({"feature": np.arange(FEATURES + 1, dtype=np.int32), "n": found})

    held = known.select("text").mapInArrow(frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    frequency = np.zeros(FEATURES + 1)
    for r in held.collect():  # one number per feature
        frequency[r.feature] = r.n
    idf = (np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1).astype(np.float32)

    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows"))
    # thin out by hash first, so that little reaches the exact choice of the smallest hashes
    span = F.least(F.lit(1.0), F.lit(2.0 * SAMPLE_ROWS) / F.col("_rows"))
    thinned = known.join(broadcast_up_to(sizes, 10_000), "lang").filter(
        (F.col("pick") / F.lit(float(1 << 63)) + 1) / 2 < span
    )
    chosen = top_per_key(thinned.withColumn("_row", F.xxhash64("text")), ["lang"], [F.col("pick"), F.col("_row")], SAMPLE_ROWS)

    def centre(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["pick", "position"])
        parts = texts(pa.array(group["text"], pa.string()), SLICE, ROWS)
        rows = np.vstack([vectors(counts(p), idf) for p in parts])
        some = rows.any(axis=1)
        rows = rows[some]
        if not len(rows):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("lang", "centre", "floors")})
        centres, _ = _spherical_kmeans(rows, CENTROIDS)
        floors = _floors([t for t, ok in zip(group["text"], some) if ok], rows, idf).tolist()
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centre": [c.astype(np.float32).tolist() for c in centres], "floors": [floors] * len(centres)})

    made = chosen.select("lang", "text", "pick", "position").groupBy("lang").applyInPandas(centre, "lang string, centre array<float>, floors array<double>")
    rows = sorted(made.collect(), key=lambda r: (r.lang, r.centre))  # CENTROIDS rows per language
    matrix = np.array([r.centre for r in rows], np.float32).reshape(len(rows), FEATURES)
    return Centroids([r.lang for r in rows], matrix, np.array([r.floors for r in rows]).reshape(len(rows), CLASSES), idf)


def predict(docs: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``.

    ``lang_pred`` is the nearest language; ``rejected`` marks texts too far from its centroid for their length. A null
    text and one without any letter gives ``und``, score 0, rejected. Columns of ``docs`` with these names are
    replaced; all others are kept, rows neither dropped nor joined. Equal cosines go to the first
    language by name.
    """
    made = ["lang_pred", "score", "rejected"]
    base = docs.drop(*made)
    small_batches(base.sparkSession)
    shared = base.sparkSession.sparkContext.broadcast(model)
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters")
    ready = base.select(F.struct(*base.columns).alias("row"), _lowered(text).alias("lowered"), letters)
    schema = StructType([ready.schema["row"], *StructType.fromDDL("lang_pred string, score double, rejected boolean")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, far = [], [], []
            for part in texts(batch.column("lowered"), SLICE, ROWS):
                a, b, c = shared.value.predict(part)
                names += a
                scores.append(b)
                far.append(c)
            letters = np.asarray(batch.column("letters"))
            score = np.where(letters, np.concatenate(scores), 0.0) if names else np.zeros(0)
            rejected = ~letters | np.concatenate(far) if names else np.zeros(0, bool)
            chosen = [n if ok else UNKNOWN for n, ok in zip(names, letters)]
            columns = [batch.column("row"), pa.array(chosen, pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", *made])

    return ready.mapInArrow(run, schema).select(*[F.col("row")[c].alias(c) for c in base.columns], *made)
