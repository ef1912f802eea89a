"""Piece ids and decoded texts against the library the model file is made for."""

import hashlib
import random

import public_tokenizers
import pyarrow.parquet as pq
import sentencepiece

from tidewire.llm import chunks, pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "▁", "▁x ▁", "hello  world", "   a   b    ", "a\nb\t c ", "é🤷🏽‍♀️ x́", "<s> </s> <0x0A> <unk>", "\x00a\x01", "a" * 5000,
    " " * 3000 + "b", "=" * 700, "日本語テキスト ١٢٣ ½" * 40, "\U0001F9FF" * 90, "x y z　", "the-quick-brown" * 30, "\n\n\n", "�",
]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(4)
    letters = ["a", "th", "e", " ", "  ", "▁", "é", "日", "\n", "🤷", "ing", "\x07", "-"]
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 90))) for _ in range(300)]


def test_ids_and_texts_equal_the_library(spark):
    every = texts() + pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()["text"]
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").selectExpr("*", "'x' AS ids", "1 AS block").repartition(3)
    vocabulary = pieces.read_pieces(PATH)
    encoded = pieces.encode(docs, vocabulary)
    got = {r.doc_id: (list(r.ids), r.text) for r in encoded.select("doc_id", "ids", pieces.decode(vocabulary)("ids").alias("text")).collect()}
    model = library()
    wanted = [model.encode(t or "") for t in every]
    assert got == {i: (ids, model.decode(ids)) for i, ids in enumerate(wanted)}


def test_decoding_of_any_ids():
    vocabulary, model, rng = pieces.read_pieces(PATH), library(), random.Random(6)
    bytes_ = set(vocabulary.byte_ids.tolist())
    strings = [None if i in bytes_ else p.replace("▁", " ") if p in vocabulary.ids else "" for i, p in enumerate(vocabulary.pieces)]
    lead = vocabulary.byte_ids.tolist()
    cut_off = [[lead[0xE3], lead[0x81]], [lead[0xE3], lead[0x81], 264], [lead[0xF0], lead[0x9F], lead[0xE3], lead[0x81], lead[0x82]], [lead[0xC3]], [1, 28705, lead[0x20]]]
    for ids in cut_off:
        assert pieces.decoded(ids, vocabulary, strings) == model.decode(ids), ids
    for _ in range(400):
        ids = [rng.choice((rng.randrange(3, 259), rng.randrange(259, 32000), 1, 2, 28705, 259)) for _ in range(rng.randrange(0, 12))]
        assert pieces.decoded(ids, vocabulary, strings) == model.decode(ids), ids


def test_small_blocks_and_long_chunks(spark, monkeypatch):
    vocabulary, model = pieces.read_pieces(PATH), library()
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoin▁日") for _ in range(rng.randrange(1, 130))) for _ in range(300)]
    ids, counts = pieces.segment(words, vocabulary)
    ends = counts.cumsum()
    # The library puts a marker ahead of a text; here the words' own beginnings count.
    start = model.encode("\n")[:1]
    for word, low, high in zip(words, ends - counts, ends, strict=True):
        whole = model.encode("\n" + word)
        assert whole[:1] == start and list(ids[low:high]) == whole[2:], word
    for name, size in (("BLOCK_CHUNKS", 30), ("BLOCK_DISTINCT", 11), ("ROW_CHUNKS", 7)):
        monkeypatch.setattr(chunks, name, size)
    rows = [(i % 9, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id, list(r.ids)) for r in pieces.encode(docs, vocabulary).collect())
    assert found == sorted((i, model.encode(t or "")) for i, t in rows)


def test_digests(spark, tmp_path):
    rows = [(1, "hello hello", 7), (1, "hello hello", 8), (None, None, 9), (3, "", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in queries.QUERIES["op11_pieces"](spark, str(tmp_path)).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = library().encode("hello hello", add_eos=True)
    one, none = (1, len(ids), sha(" ".join(map(str, ids))), sha("hello hello")), (1, sha("2"), sha(""))
    assert got == sorted([one, one, (None, *none), (3, *none)], key=repr)
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), pieces.read_pieces(PATH)).collect() == []


def test_texts_are_cut_once(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    encoded = pieces.encode(docs, pieces.read_pieces(PATH))
    encoded.collect()
    assert "ReusedExchange" in encoded._jdf.queryExecution().executedPlan().toString()
