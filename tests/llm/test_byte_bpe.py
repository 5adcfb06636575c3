"""Byte-level BPE against the library whose results it must equal, and back."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import functions as F

from plumbline.llm import byte_bpe, wordblocks
from plumbline.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def test_random_strings(library):
    rng = random.Random(1)
    ranks, words = byte_bpe.read_ranks(PATH), byte_bpe.splitter(PATTERN, byte_bpe.code_ranges(byte_bpe.letters_apart()))
    own = lambda t: [i for c in byte_bpe.chunks(t) for w in words(c) for i in byte_bpe.merge_word(w.encode(), ranks)]
    pool = [chr(c) for c in range(0x250)] + list("՘֋࢏  　中́") + [chr(0x11de0), chr(0x1f600)]
    for _ in range(10_000):
        text = "".join(rng.choice(pool) if rng.random() < 0.5 else rng.choice("abc  '\n1st") for _ in range(rng.randint(0, 40)))
        assert own(text) == library.encode_ordinary(text)
    for text in ("a" * 60_000, "ab" * 9000, " " * 5000 + "x", "é" * 3000, "漢字かな" * 4000, "'s" * 2000, "<|endoftext|>" * 3):
        assert own(text) == library.encode_ordinary(text)
    every = "".join(chr(c) + "'s1" for c in range(0x30000) if not 0xD800 <= c < 0xE000)
    assert own(every) == library.encode_ordinary(every)


def test_short_and_long_words_agree():
    rng = random.Random(2)
    ranks = byte_bpe.read_ranks(PATH)
    for _ in range(3000):
        word = bytes(rng.choice(b"aeinrst the\xc3\xa9") for _ in range(rng.randint(1, 24)))
        assert byte_bpe._short(word, ranks) == byte_bpe._long(word, ranks)


def test_numbers_survive_packing():
    rng = np.random.default_rng(3)
    for high in (1, 200, 70_000, 2**32):
        a = rng.integers(0, high, 5000, dtype=np.uint64).astype(np.uint32)
        assert (wordblocks.unpack(wordblocks.pack(a)) == a).all()
    assert len(wordblocks.unpack(wordblocks.pack(np.zeros(0, np.uint32)))) == 0
    a = rng.integers(0, 10**6, 5000).astype(np.uint32)
    assert (wordblocks.unpack_ranks(wordblocks.pack_ranks(a)) == a).all() and (wordblocks.unpack_runs(wordblocks.pack_runs(a)) == a).all()
    for a in ([], [191, 192, 192 + 10239, 192 + 10240, 5, 1_500_000], [2**31, 3]):
        assert wordblocks.unpack_ranks(wordblocks.pack_ranks(np.array(a, np.uint32))).tolist() == a
    parts = [b"", b"ab", b"\0", "ü".encode()]
    assert wordblocks.unpack_bytes(wordblocks.pack_bytes(parts)) == parts and wordblocks.unpack_bytes(wordblocks.pack_bytes([])) == []


@pytest.mark.parametrize("chars", [wordblocks.BLOCK_CHARS, 50])
def test_corpus(spark, library, monkeypatch, chars):
    monkeypatch.setattr(wordblocks, "BLOCK_CHARS", chars)
    rng = random.Random(4)
    texts = [None, "", " ", "x", "long " * 300_000, "y" * 100_000, "a\0b\x1f  "] + ["Same text, twice."] * 5
    texts += ["".join(rng.choice(["the ", "élan", "12 ", "\n\n", "'re ", "՘"]) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    rows = [(None if i == 3 else i, t, "row", "blk", -1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keys string, block string, bucket int").repartition(3)
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.encoded_digests(docs, PATH, PATTERN).collect()),
                 key=str)
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert byte_bpe.encoded_digests(docs.limit(0), PATH, PATTERN).count() == 0


def test_one_python_worker_encodes_and_decodes(spark):
    docs = spark.createDataFrame([(1, "one two two"), (2, None), (None, "\u4e00 " * 700)], "doc_id long, text string")
    made = byte_bpe.encode(docs, PATH, PATTERN, decoded=True)
    digests = byte_bpe.encoded_digests(docs, PATH, PATTERN)._jdf.queryExecution().sparkPlan().toString()
    assert digests.split("Exchange")[0].count("MapInArrow") == 1
    assert sorted(map(tuple, made.collect()), key=str) == sorted(map(tuple, byte_bpe.decode(byte_bpe.encode(docs, PATH, PATTERN), PATH).collect()), key=str)


def test_long_texts_decode_in_steps(monkeypatch):
    monkeypatch.setattr(byte_bpe, "STEP", 3)
    ids = [i for w in (b"one", b" two", b" archaeology", b"\xe4\xb8\x80") for i in byte_bpe.merge_word(w, byte_bpe.read_ranks(PATH))] * 3
    assert byte_bpe.decoder(PATH)(np.array(ids, "<u4")) == "one two archaeology\u4e00".encode() * 3 and byte_bpe.decoder(PATH)(np.zeros(0, "<u4")) == b""


def test_decoding_refuses_unknown_ids(spark):
    ids = np.array([5, 60_000], "<u4").tobytes()
    with pytest.raises(Exception, match="no token"):
        byte_bpe.decode(spark.createDataFrame([(bytearray(ids),)], "ids binary"), PATH).collect()
    kept = byte_bpe.decode(spark.createDataFrame([(None, 1)], "ids binary, decoded_by long"), PATH).select(F.col("decoded").isNull()).first()[0]
    assert kept


def test_counts_know_the_librarys_letters():
    """Letters newer than the library, alone and before an ending, and random strings."""
    import tokenizers

    from plumbline.llm.token_counts import PairMerger

    path = tokenizer_path("word_bpe_49k.json")
    merger, library = PairMerger(path), tokenizers.Tokenizer.from_file(path)
    rng = random.Random(3)
    pool = [chr(c) for c in [*range(1, 0x600), 0x88F, 0x208F, 0x10940, 0x11DE0, 0x1C89, 0xA7CB, 0x2028]]
    texts = [chr(c) + "'s" for c in [*range(0x500, 0x600), 0x88F, 0x208F, 0x10940, 0x11DE0]]
    texts += ["".join(rng.choice(pool) if rng.random() < 0.5 else rng.choice("abc  '\n1stA") for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    assert [merger.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_packing_of_long_runs_takes_linear_time():
    """Runs just below what goes to the library: letters of 15,000 and blanks."""
    import time

    import tokenizers

    from plumbline.llm import packing

    path = tokenizer_path("byte_bpe_50k.json")
    encode, library = packing.encoder(path), tokenizers.Tokenizer.from_file(path)
    rng = random.Random(5)
    chinese = "".join(chr(0x4E00 + rng.randint(0, 3000)) for _ in range(15_000))
    for text in ("\n".join([chinese] * 20), " ".join(["ab" * 7499 + "c"] * 20), (" " * 15_000 + "x") * 20):
        began = time.perf_counter()
        ids = encode(text).tolist()
        assert time.perf_counter() - began < 5 and ids == library.encode(text, add_special_tokens=False).ids
    assert packing.longest_run("ab" * 50 + " " * 70 + "\n" + "c") == 100 and packing.longest_run("") == 0 and packing.longest_run(" " * 99) == 99
