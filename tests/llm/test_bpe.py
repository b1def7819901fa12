import hashlib
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spendframe.llm import bpe, queries
from spendframe.llm.common import joined

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

ODD = [
    "",
    " ",
    "a",
    "Hello  world\n\n  it's I'LL don't 12x34",
    "x<|endoftext|>y <|endoftext|><|endoftext|>",
    "<|endoftext",
    "über ñandú 你好 🙂🙂    \x85 \x1c\x1f end ",
    "tabs\t\t and\r\nlines \n",
    "a" * 5000,
    "\x00\x01\x7f",
    "é" * 70 + " " * 90,
]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def truth():
    return tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def packed(ids):
    return b"".join(number.to_bytes(4, "little") for number in ids)


def test_same_ids_as_the_library(codec, truth):
    draw = random.Random(3)
    alphabet = "abcdeé ñ.,'!\n\t 0123　日本́ſ\x1c\x85"
    for text in ODD + ["".join(draw.choices(alphabet, k=draw.randint(1, 120))) for _ in range(1500)]:
        ids = truth.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == packed(ids), repr(text)
        assert codec.decode(packed(ids)) == truth.decode(ids, skip_special_tokens=False), repr(text)


def test_broken_utf8_is_decoded_like_the_library(codec, truth):
    draw = random.Random(5)
    for _ in range(300):
        ids = [draw.randrange(50257) for _ in range(draw.randint(1, 12))]
        assert codec.decode(packed(ids)) == truth.decode(ids, skip_special_tokens=False)


def test_full_cache_starts_anew(monkeypatch, truth):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    small = bpe.Codec(P.path("byte_bpe_50k.json"))
    text = "one two three four five six one two three four"
    assert small.encode(text) == packed(truth.encode(text, add_special_tokens=False).ids)


def test_nulls_repeats_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "a b", None)], "doc_id long, text string, ids string")
    path = P.path("byte_bpe_50k.json")
    rows = bpe.decode(bpe.encode(docs, path), path).collect()
    assert sorted((row.doc_id or 0, row.decoded, len(row.ids)) for row in rows) == [(0, "a b", 8), (1, "", 0), (1, "", 0)]
    assert bpe.encode(docs.limit(0), path).count() == 0


def test_query_matches_the_library(spark, sf_dir, truth):
    texts = {row.doc_id: row.text or "" for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op8_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = truth.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(packed(ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(truth.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_a_batch_holds_its_results_once(spark, monkeypatch):
    """Results go into the array as they are made; a list of them beside it doubled the memory of a Python worker."""
    functions = []
    monkeypatch.setattr(bpe, "arrow_udf", lambda kind: lambda function: functions.append(function) or (lambda column: F.lit(None).cast(kind)))
    docs, path = spark.createDataFrame([], "text string, ids binary"), P.path("byte_bpe_50k.json")
    bpe.encode(docs, path), bpe.decode(docs, path)
    encode, decode = functions
    texts = pa.array([f"{i} " + "some words of a text " * 500 for i in range(500)])
    encode(texts[:1])  # loads the codec
    ids = texts
    for function in (encode, decode):
        given, before = ids, pa.total_allocated_bytes()
        tracemalloc.start()
        ids = function(given)
        peak = tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - before
        tracemalloc.stop()
        assert peak < 1.5 * ids.nbytes
    assert ids.equals(texts)


def test_joined_arrays(codec):
    for values in ([], [b""], [b"a", b"", "\u00fc".encode()], [b"", b""]):
        array = joined(iter(values), pa.string())
        array.validate(full=True)
        assert array.to_pylist() == [value.decode() for value in values]
        assert joined(iter(values), pa.binary()).to_pylist() == values
