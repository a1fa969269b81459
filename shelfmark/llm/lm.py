"""Language-model scores by a weighted backoff automaton over words.

The model holds every word, pair and triple of words of all training texts, each a hash with its
count. N-grams that may stand before a word are states, their continuations arcs. The lowest order is add-one smoothed
over the whole vocabulary; each order above mixes its counts with the order below, as if ``PRIOR`` more tokens
had been seen there. What a state gives to words it has no arc for is the weight of its failure arc to the next
shorter context. A traversal goes through a text once from left to right, carries the state and adds up log-probabilities.

The automaton grows with the corpus, so it is never in one place. Texts are dealt into blocks of about
``BLOCK_BYTES``. A block sends its distinct n-grams, with their counts in its training texts, to the buckets of
their hashes; a bucket adds them up and answers each block. A block then knows all arcs and failure arcs its texts can
take, and walks them. An n-gram comes to its bucket once per block, however frequent it is, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import LOWER, SPACES, Rolling, Texts, mixed, small_batches, texts, word_table, words

ORDER = 3
#: Tokens that the order below is worth in a mixture.
PRIOR = 4.0
#: Text that one block holds; a longer text is a block's own.
BLOCK_BYTES = 8_000_000
#: Tokens that a walk takes out of its arrays at once.
STEP = 100_000
#: Bits of the hashes of n-grams above words, which only decide what the model adds to the base score.
GRAM_BITS = 56
#: The token that ends a text; word hashes avoid it.
END = 0
_INSIDE = word_table(SPACES)
_NEXT = np.uint64(0x9E3779B97F4A7C15)
MADE = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


class Tokens:
    """Hashes texts to tokens: every word, then one end."""

    def __init__(self) -> None:
        self.hasher = Rolling(9)

    def __call__(self, part: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Row and hash of each token, in order."""
        row, start, stop = words(part, _INSIDE)
        prefix = self.hasher.prefix(LOWER[part.data])
        key = self.hasher.spans(prefix, start, stop)
        key[key == END] = 1
        ends = np.cumsum(np.bincount(row, minlength=part.rows))
        return np.insert(row, ends, np.arange(part.rows)), np.insert(key, ends, np.uint64(END))


class Grams:
    """The n-grams of one order in a block: distinct hashes, sorted, and which one ends at each token that has one."""

    def __init__(self, key: np.ndarray, there: np.ndarray):
        self.there = there
        self.distinct, place = np.unique(key[there], return_inverse=True)
        self.place = place.astype(np.int32)

    def in_training(self, learn: np.ndarray) -> np.ndarray:
        """How often each distinct n-gram ends at a token marked in ``learn``."""
        return np.bincount(self.place, learn[self.there], len(self.distinct)).astype(np.int64)

    def per_token(self, totals: np.ndarray) -> np.ndarray:
        """The count of the n-gram that ends at each token, 0 if there is none."""
        out = np.zeros(len(self.there), np.int64)
        out[self.there] = totals[self.place]
        return out


class Block:
    """Tokens of the texts of a block and its n-grams of all orders."""

    def __init__(self, column: pa.ChunkedArray, order: int):
        find, rows, keys, base = Tokens(), [], [], 0
        for part in texts(column):
            row, key = find(part)
            rows.append((row + base).astype(np.int32))
            keys.append(key)
            base += part.rows
        self.rows = base
        self.row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        self.grams = [Grams(key, np.ones(len(key), bool))]
        gram, there = key, self.grams[0].there
        for n in range(1, order):
            before = np.zeros(len(key), np.uint64)
            before[1:] = gram[:-1]
            there = there & self.after(there)
            gram = mixed(mixed(before + np.uint64(n)) * _NEXT + key)
            self.grams.append(Grams(gram >> np.uint64(64 - GRAM_BITS), there))

    def after(self, values: np.ndarray) -> np.ndarray:
        """For each token, the value of the token before it in the same text; nothing (0) for the first."""
        out = np.zeros_like(values)
        out[1:] = np.where(self.row[1:] == self.row[:-1], values[:-1], 0)
        return out


def _packed(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: most of their high bytes are zero."""
    return zstandard.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T.copy().view(kind).ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes as steps."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


def _cuts(distinct: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket's share of sorted hashes begins, and the end."""
    edges = np.array([(b << bits) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(distinct, edges), len(distinct))


def _totals(block: pa.Table) -> pa.Table:
    """A bucket's answer to each block: total counts in the order of the hashes it sent, tokens and distinct n-grams."""
    keys = [_unpacked_keys(k) for k in block["keys"].to_pylist()]
    counts = np.concatenate([_unpacked(n, np.int64) for n in block["n"].to_pylist()])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, counts, len(distinct)).astype(np.int64)
    answers = np.split(total[place], np.cumsum([len(k) for k in keys])[:-1])
    n = len(keys)
    return pa.table(
        {
            "block": block["block"],
            "bucket": block["bucket"],
            "totals": pa.array([_packed(a) for a in answers], pa.binary()),
            "tokens": pa.array([int(total.sum())] * n, pa.int64()),
            "vocabulary": pa.array([int((total > 0).sum())] * n, pa.int64()),
        }
    )


class Automaton:
    """The arcs and failure arcs that a block's tokens can take.

    ``arc[k]`` is the log10 weight of the arc by each token from the context of the ``k`` tokens before it, ``has[k]``
    whether there is such an arc, ``fail[k]`` the weight of this context's failure arc. The empty context has an
    arc by every token. ``seen`` tells whether the token alone came up in training.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], total: int, prior: float):
        self.seen = counts[0] > 0
        self.ends = np.append(block.row[1:] != block.row[:-1], True)
        probability = (counts[0] + 1) / total
        self.arc, self.fail, self.has = [np.log10(probability)], [np.zeros(len(probability))], [self.seen]
        for shorter, own in zip(counts, counts[1:]):
            context = block.after(shorter)
            probability = (own + prior * probability) / (context + prior)
            self.arc.append(np.log10(probability))
            self.fail.append(np.log10(prior / (context + prior)))
            self.has.append(own > 0)

    def walk(self) -> Iterator[float]:
        """Weights of the arcs and failure arcs on the way through all tokens, one sum per token.

        The state is the longest known context, told by its length: the tokens before the current one say which it is.
        The end of a text is in no context, so the walk starts anew after it.
        """
        top, state = len(self.arc) - 1, 0
        for start in range(0, len(self.ends), STEP):
            steps = [zip(*[a[start : start + STEP].tolist() for a in arrays]) for arrays in (self.has, self.arc, self.fail)]
            for has, arc, fail, ends in zip(*steps, self.ends[start : start + STEP].tolist()):
                passed = 0.0
                while state and not has[state]:
                    passed += fail[state]
                    state -= 1
                yield passed + arc[state]
                # the arc leads to the context it spells, or to that without its first word
                state = min(state + 1, top) if has[state] and not ends else 0


def score(docs: DataFrame, learn: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",), order: int = ORDER, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of all rows.

    The model is learned from the rows for which ``learn`` is true. ``base_score`` sums the add-one log10
    probabilities of single tokens; ``score`` is the automaton's. Null and empty texts have one token, the end. Repeated
    rows are learned and scored one by one. Without training rows every token has the same probability, 1 / 1.
    Columns not in ``keep`` are left out, so that no name can clash.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = [f for f in docs.schema.fields if f.name in keep and f.name not in MADE]
    names = [f"k{i}" for i in range(len(kept))]
    whole = F.coalesce(F.col(text), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(whole))).first()[0] or 0
    blocks = size // block_bytes + 1
    buckets = min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    narrow = docs.select(*[F.col(f.name).alias(n) for n, f in zip(names, kept)], F.coalesce(learn, F.lit(False)).alias("_learn"), whole.alias("_text"))
    # copies of one text have their own ids, so they are dealt to many blocks
    dealt = F.xxhash64("_text", *[n for n, f in zip(names, kept) if isinstance(f.dataType, T.AtomicType)])
    blocked = narrow.withColumn("block", F.pmod(dealt, F.lit(blocks)))

    def ask(table: pa.Table) -> pa.Table:
        block = Block(table["_text"], order)
        learned = np.asarray(table["_learn"].to_numpy(), bool)[block.row]
        out: dict[str, list] = {"block": [], "bucket": [], "keys": [], "n": []}
        number = table["block"][0].as_py()
        for at, grams in enumerate(block.grams):
            n, cuts = grams.in_training(learned), _cuts(grams.distinct, buckets, GRAM_BITS if at else 64)
            for bucket, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
                # each bucket of words is asked, as its answer also counts towards the vocabulary
                if b > a or at == 0:
                    for column, value in zip(out.values(), (number, at * buckets + bucket, _packed_keys(grams.distinct[a:b]), _packed(n[a:b]))):
                        column.append(value)
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], list(out))

    def walk(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table["_text"], order)
        answers = answers.sort_by("bucket")
        found = [[] for _ in block.grams]
        for bucket, totals in zip(answers["bucket"].to_pylist(), answers["totals"].to_pylist()):
            found[bucket // buckets].append(_unpacked(totals, np.int64))
        counts = [g.per_token(np.concatenate(f) if f else np.zeros(0, np.int64)) for g, f in zip(block.grams, found)]
        of_words = [b < buckets for b in answers["bucket"].to_pylist()]
        tokens = sum(n for n, w in zip(answers["tokens"].to_pylist(), of_words) if w)
        vocabulary = sum(n for n, w in zip(answers["vocabulary"].to_pylist(), of_words) if w)
        automaton = Automaton(block, counts, tokens + vocabulary + 1, prior)
        n_tokens = np.bincount(block.row, minlength=block.rows)
        each = np.fromiter(automaton.walk(), float, len(block.row))
        made = (
            n_tokens.astype(np.int64),
            np.bincount(block.row, automaton.seen, block.rows).astype(np.int64),
            np.full(block.rows, tokens, np.int64),
            np.bincount(block.row, automaton.arc[0], block.rows),
            np.bincount(block.row, each, block.rows),
        )
        return pa.table([*[table[n] for n in names], *[pa.array(m) for m in made]], [*names, *MADE])

    asked = blocked.groupBy("block").applyInArrow(ask, "block bigint, bucket bigint, keys binary, n binary")
    answered = asked.groupBy("bucket").applyInArrow(_totals, "block bigint, bucket bigint, totals binary, tokens bigint, vocabulary bigint")
    schema = ", ".join([*[f"{n} {f.dataType.simpleString()}" for n, f in zip(names, kept)], "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"])
    scored = blocked.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(walk, schema)
    return scored.select(*[F.col(n).alias(f.name) for n, f in zip(names, kept)], *MADE)
