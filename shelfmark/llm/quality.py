"""Quality scores by histogram gradient-boosted trees over document statistics.

Trees have one depth and live in arrays: node ``i`` has children ``2i + 1`` and ``2i + 2``, so a batch of
documents walks all trees with array lookups only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import LOWER, SPACES, Rolling, Texts, texts, word_table, words

#: Labelled rows from which trees are fitted.
SAMPLE_ROWS = 20_000
BINS, TREES, DEPTH, RATE, RIDGE, LEAST = 64, 80, 4, 0.15, 1.0, 5.0
MARKS = b"|#!*%$&.,;:?"
STATISTICS = (
    "bytes words word_length word_length_spread upper digit space newline high punctuation distinct_words "
    "repeated_next top_word short_words long_words repeated_lines line_length first_upper entropy "
) .split() + [f"mark_{chr(b)}" for b in MARKS]
_INSIDE, _LINE = word_table(SPACES), word_table(b"\n\r")
_CLASS = np.zeros(256, np.int64)  # other, upper, digit, space, newline, high, then punctuation
for _byte in range(256):
    _c = chr(_byte)
    _CLASS[_byte] = (
        5 if _byte > 127 else 4 if _c == "\n" else 3 if _byte in SPACES else 1 if _c.isupper() else 2 if _c.isdigit()
        else 0 if _c.isalpha() else 7 + MARKS.index(_byte) if _byte in MARKS else 6
    )
_KINDS = 7 + len(MARKS)


def _groups(row: np.ndarray, key: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the greatest count of one key, per row."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(r)))
    top = np.zeros(rows)
    np.maximum.at(top, r[heads], sizes)
    return np.bincount(r[heads], minlength=rows).astype(float), top


def statistics(part: Texts, hasher: Rolling) -> np.ndarray:
    """One row of ``STATISTICS`` per text; all are 0 for an empty one."""
    n, size = part.rows, np.diff(part.offsets).astype(float)
    if not len(part.data):
        return np.zeros((n, len(STATISTICS)))
    ids = part.ids()
    kinds = np.bincount(ids * _KINDS + _CLASS[part.data], minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    # entropy of byte values, over 64 classes of four neighbours: cheap, and flat for ordinary prose
    coarse = np.bincount(ids * 64 + (part.data >> 2), minlength=n * 64).reshape(n, 64)
    share = coarse / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    prefix = hasher.prefix(LOWER[part.data])
    row, start, stop = words(part, _INSIDE)
    length, n_words = (stop - start).astype(float), np.bincount(row, minlength=n).astype(float)
    key = hasher.spans(prefix, start, stop)
    distinct, top = _groups(row, key, n)
    again = (row[1:] == row[:-1]) & (key[1:] == key[:-1])
    per_word = np.maximum(n_words, 1)

    def tally(r: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(r, weights, minlength=n).astype(float)

    mean = tally(row, length) / per_word
    spread = np.sqrt(np.maximum(tally(row, length**2) / per_word - mean**2, 0))
    line_row, line_start, line_stop = words(part, _LINE)
    lines = np.maximum(tally(line_row), 1)
    distinct_lines, _ = _groups(line_row, hasher.spans(prefix, line_start, line_stop), n)
    per_byte = np.maximum(size, 1)
    upper_first = _CLASS[part.data[start]] == 1
    columns = [
        np.log1p(size), np.log1p(n_words), mean, spread, *[kinds[:, k] / per_byte for k in (1, 2, 3, 4, 5)],
        kinds[:, 6:].sum(axis=1) / per_byte, distinct / per_word, tally(row[1:][again]) / per_word, top / per_word,
        tally(row[length <= 3]) / per_word, tally(row[length >= 15]) / per_word, 1 - distinct_lines / lines,
        size / lines, tally(row[upper_first]) / per_word, entropy, *[kinds[:, 7 + i] / per_byte for i in range(len(MARKS))],
    ]
    out = np.column_stack(columns)
    out[size == 0] = 0
    return out


class Trees:
    """Boosted trees in arrays: (tree, node) split feature and threshold, (tree, leaf) value."""

    def __init__(self, bias: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.bias, self.feature, self.threshold, self.value = bias, feature, threshold, value

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1. A number goes right if it is above the threshold."""
        margin, rows = np.full(len(x), self.bias), np.arange(len(x))
        depth = int(np.log2(self.value.shape[1])) if len(self.value) else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += value[node - len(feature)]
        return 1 / (1 + np.exp(-margin))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees from a bounded sample. Without both labels the score is the same for every text."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Trees(bias, np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 1)))
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    inner, leaves = 2**depth - 1, 2**depth
    features, thresholds = np.zeros((trees, inner), int), np.full((trees, inner), np.inf)
    values, margin = np.zeros((trees, leaves)), np.full(n, bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(n, int)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = node - first
            g, h = (np.stack([np.bincount(at * BINS + binned[:, f], w, minlength=count * BINS).reshape(count, BINS) for f in range(width)], 1) for w in (gradient, weight))
            left_g, left_h = g.cumsum(2), h.cumsum(2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(left_h < LEAST) | (right_h < LEAST)] = 0
            flat = gain.reshape(count, -1)
            best = flat.argmax(axis=1)
            f, b = best // BINS, best % BINS
            for i in range(count):
                if flat[i, best[i]] > 1e-6:
                    features[t, first + i], thresholds[t, first + i] = f[i], edges[f[i]][b[i]]
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > thresholds[t, node])
        leaf = node - inner
        values[t] = RATE * np.bincount(leaf, gradient, leaves) / (np.bincount(leaf, weight, leaves) + RIDGE)
        margin += values[t][leaf]
    return Trees(bias, features, thresholds, values)


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and the statistics of each text as an array."""
    kept = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["x array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Rolling(2)
        for batch in batches:
            rows = [statistics(p, hasher) for p in texts(batch.column("_text"))]
            x = np.vstack(rows) if rows else np.zeros((0, len(STATISTICS)))
            arrays = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], arrays], names=[*[f.name for f in kept], "x"])

    return docs.select(*[f.name for f in kept], F.col(text).alias("_text")).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> Trees:
    """Trees from the ``SAMPLE_ROWS`` labelled rows with the smallest hash of their key.

    ``labels`` has (key, label 0 or 1); rows with a null in either are left out. Of texts that share a key, as many as
    the sample holds are used.
    """
    usable = labels.select(F.col(key), F.col(label).cast("int").alias("_label")).filter(
        F.col(key).isNotNull() & F.col("_label").isin(0, 1)
    )
    chosen = usable.orderBy(F.xxhash64(F.col(key)), key, "_label").limit(SAMPLE_ROWS)
    # at most SAMPLE_ROWS rows of two numbers
    labelled = docs.select(key, text).join(F.broadcast(chosen), key)
    rows = measured(labelled, text, (key, "_label")).orderBy(key, "_label", "x").limit(SAMPLE_ROWS).collect()
    x = np.array([r.x for r in rows]).reshape(len(rows), len(STATISTICS))
    return grow(x, np.array([r["_label"] for r in rows], float))


def score(docs: DataFrame, model: Trees, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) for each row of ``docs``.

    Null texts count as empty and are scored like any other. Columns not in ``keep`` are left out, so
    that no name can clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name in keep and f.name not in ("score", "predicted")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Rolling(2)
        for batch in batches:
            found = [shared.value.score(statistics(p, hasher)) for p in texts(batch.column("_text"))]
            value = np.concatenate(found) if found else np.zeros(0)
            columns = [*[batch.column(f.name) for f in kept], pa.array(value), pa.array((value >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in kept], "score", "predicted"])

    return docs.select(*[f.name for f in kept], F.col(text).alias("_text")).mapInArrow(run, schema)
