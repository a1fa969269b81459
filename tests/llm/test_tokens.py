"""Byte-level BPE against the tokenizer library, whole and in chunks, and back."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from shelfmark.llm import bpe
from shelfmark.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\n\nfoo  bar\n", "it's we're I'LL they'd", "a" * 3000, "x1" * 700, "日本語のテキスト。" * 90, "🙂👩‍👩‍👧 é ñ",
    "​\x00\x1c\x85 　 z", "<|endoftext|> is text", " \t\r\n" * 300, "word " * 2000, "\U000323b0ab\U000323b0 1\U00011de0",
]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(value):
    return np.frombuffer(value, "<u4").tolist()


def mixed_texts():
    random.seed(3)
    words = ["the", "Übung", "it's", "42", "...", "\n", "  ", "naïve", "日本", "x" * 40, "-", "\t", "I'll"]
    return ["".join(random.choice(words) + random.choice(["", " "]) for _ in range(random.randint(1, 400))) for _ in range(60)]


@pytest.mark.parametrize("chunk,overlap", [(bpe.CHUNK, bpe.OVERLAP), (64, 32), (50, 8)])
def test_encode_is_the_library_and_decodes_back(spark, ranks, library, chunk, overlap):
    given = ODD + mixed_texts()
    # columns with the names that the operator uses, one of which it replaces; rows repeat
    rows = [(i, t, "mine", i, b"old") for i, t in enumerate(given)] * 2
    docs = spark.createDataFrame(rows, "doc_id int, text string, row string, no int, ids binary")
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
    assert encoded.columns == ["doc_id", "text", "row", "no", "ids"]
    found = bpe.decode(encoded, ranks).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.text, r.row, r.no) == (given[r.doc_id], "mine", r.doc_id)
        assert ids(r.ids) == library.encode_ordinary(given[r.doc_id] or ""), r.text
        assert r.decoded == (given[r.doc_id] or "").encode()


def test_pieces_of_any_length(ranks, library, monkeypatch):
    random.seed(4)
    given = ["".join(random.choice("abeinrst") for _ in range(size)) for size in [*range(1, 70), 99, 100, 400, 2000] * 3]
    given += ["é" * 30, "日本" * 20, "zzz", "e" * 63]
    encoder = bpe.Encoder(ranks, bpe.Pairs(ranks))
    wanted = [library.encode_ordinary(p) for p in given]
    assert [ids(v.as_py()) for v in encoder([[p] for p in given])] == wanted
    assert [ids(v.as_py()) for v in encoder([given, [], given[:3]])] == [sum(wanted, []), [], sum(wanted[:3], [])]
    assert [bpe.merge_one(p.encode(), ranks) for p in given if len(library.encode_ordinary(p)) > 1] == [w for w in wanted if len(w) > 1]
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    assert [ids(v.as_py()) for v in encoder([[p] for p in given])] == wanted
    assert [ids(v.as_py()) for v in encoder([[p] for p in given])] == wanted


def test_empty_tables_nulls_and_missing_tokens(spark, ranks):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.encode(empty, ranks, public_tokenizers.PATTERN).collect() == []
    rows = spark.createDataFrame([(1, None), (2, b"")], "k int, ids binary")
    assert {r.k: r.decoded for r in bpe.decode(rows, ranks).collect()} == {1: None, 2: b""}
    assert {r.k: r.ids for r in bpe.numbers(rows).collect()} == {1: None, 2: []}
    with pytest.raises(ValueError):
        bpe.encode(empty, {b"a": 0}, public_tokenizers.PATTERN)


def test_query(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    found = {r.doc_id: r for r in QUERIES["op11_byte_bpe"](spark, SMALL).collect()}
    assert len(found) == len(docs)
    for d in docs:
        wanted = library.encode_ordinary(d.text or "")
        r = found[d.doc_id]
        assert r.n_tokens == len(wanted)
        assert r.ids_sha256 == hashlib.sha256(np.array(wanted, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
