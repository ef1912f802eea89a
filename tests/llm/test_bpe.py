"""Token ids against the tokenizer library the rank file is made for, and round trips."""

import hashlib

import public_tokenizers
import pyarrow.parquet as pq
import tiktoken

from tidewire.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    None, "", " ", "\n\n  x", "it's we'll I'D", "a" * 5000, " " * 3000 + "b", "=" * 700, "日本語テキスト ١٢٣ ½", "é   x　y",
    "<|endoftext|>", "\x1c\x1d a\x85b", "🤷🏽‍♀️ ok", "Ünïcödé" * 200, "\r\n\t mixed \t\n", "don’t",
]


def expected(texts):
    ranks = bpe.read_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [library.encode_ordinary(t or "") for t in texts]


def test_ids_equal_the_library(spark):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    texts = ODD + table["text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ranks = bpe.read_ranks(PATH)
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    rows = encoded.select("doc_id", "ids", bpe.decode(encoded.ids, ranks).alias("bytes")).collect()
    got = {r.doc_id: (list(r.ids), bytes(r.bytes)) for r in rows}
    wanted = {i: (ids, (t or "").encode()) for i, (ids, t) in enumerate(zip(expected(texts), texts, strict=True))}
    assert got == wanted


def test_digests(spark):
    docs = spark.createDataFrame([(1, "hello hello", 7), (1, "hello hello", 8), (None, None, 9)], "doc_id long, text string, ids int")
    rows = sorted(queries.bpe_digests(docs).collect(), key=repr)
    ids = expected(["hello hello"])[0]
    packed = b"".join(i.to_bytes(4, "little") for i in ids)
    empty = hashlib.sha256(b"").hexdigest()
    one = (1, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(b"hello hello").hexdigest())
    assert [tuple(r) for r in rows] == [one, one, (None, 0, empty, empty)]
    assert queries.bpe_digests(docs.limit(0)).collect() == []


def test_long_words_merge_as_short_ones(spark):
    ranks = bpe.read_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for word in ("thereandback" * 40, "ab" * 300, "xyzzy"):
        assert bpe.merge_long(word.encode(), ranks) == library.encode_ordinary(word)
