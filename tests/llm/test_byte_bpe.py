"""The byte-level transducer against the library, and the streaming decoder against Python's."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from quartzline.llm import byte_bpe, queries

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def use():
    return byte_bpe.encoding(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library(use):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=use.ranks, special_tokens={})


def ids_of(use, text):
    return np.frombuffer(b"".join(use.encode(text)), "<u4")


def test_random_texts(use, library):
    rng = random.Random(3)
    alphabets = ["abcdefgh", "aaab", "the ing er", "aéß世界😀́ \n\t'sre1٣", "  \x1c\x85 x1.", "0123456789"]
    for k in range(1500):
        text = "".join(rng.choice(alphabets[k % len(alphabets)]) for _ in range(rng.randrange(200)))
        ids = ids_of(use, text)
        assert ids.tolist() == library.encode_ordinary(text), text
        assert not text or use.transducer(text.encode()) == library._core_bpe.encode_single_piece(text.encode())


def test_every_token_is_reached(use):
    for i, token in enumerate(use.pieces[::7]):
        assert use.transducer(token) == [7 * i]


@pytest.mark.parametrize("text", ["a" * 10**6, "ab" * 500_000, "1" * 10**6, "é" * 300_000, "xq" * 70_000 + " word" * 70_000, "A long text. It goes on.\n" * 40_000])
def test_very_long_texts(use, library, text):
    assert ids_of(use, text).tolist() == library.encode_ordinary(text)


def test_long_white_space(use):
    ids = ids_of(use, " " * 10**6)
    assert b"".join(use.pieces[i] for i in ids) == b" " * 10**6


def test_states_are_forgotten_and_made_again(use, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "_MAX_STATES", 50)
    monkeypatch.setattr(byte_bpe, "_CACHE_PIECES", 3)
    text = "unforgettable words, transducers and streams: überraschend 世界 " * 20
    assert ids_of(use, text).tolist() == library.encode_ordinary(text)


def test_decoder_gives_characters_when_whole(use):
    rng = random.Random(4)
    for k in range(1500):
        if k % 2:
            ids = np.array([rng.randrange(len(use.pieces)) if rng.random() < 0.4 else rng.randrange(256) for _ in range(20)])
        else:
            ids = ids_of(use, "".join(rng.choice("a世😀é\U00010348 ") for _ in range(30)))
        raw = b"".join(use.pieces[i] for i in ids)
        decoder, out, at = byte_bpe.StreamDecoder(use), b"", 0
        while at < len(ids):
            step = rng.randrange(1, 5)
            said = decoder.feed(ids[at : at + step])
            said.decode()  # never a part of a character
            out, at = out + said, at + step
        assert (out + decoder.finish()).decode() == raw.decode("utf-8", "replace")


def test_documents(spark, library):
    texts = [None, "", " ", "one", "one", "it's 12\n\n  x", "世界 " * 5000, "<|endoftext|>", "\u0000é"]
    rows = [(i if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)] + [(8, texts[8], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string, n_tokens int").repartition(3)
    got = byte_bpe.encode_documents(docs, PATH, P.PATTERN).collect()
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    tokens = byte_bpe.encode_documents(docs, PATH, P.PATTERN, output="tokens").collect()
    assert {(r.doc_id, tuple(r.ids), r.decoded) for r in tokens} == {(i, tuple(library.encode_ordinary(t or "")), t or "") for i, t, *_ in rows}
    assert byte_bpe.encode_documents(docs.where("false"), PATH, P.PATTERN).collect() == []


def test_bytes_that_are_no_text(spark, library):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62E4B8' AS STRING) AS text")
    row = byte_bpe.encode_documents(docs, PATH, P.PATTERN, output="tokens").first()
    assert row.decoded == "a�b�" and row.ids == library.encode_ordinary(row.decoded)


def test_ranks_without_all_bytes(tmp_path):
    (tmp_path / "ranks").write_text("YQ== 0\n")
    with pytest.raises(ValueError, match="255 of the 256"):
        byte_bpe.Encoding(str(tmp_path / "ranks"), P.PATTERN)


def test_query_is_one_stage(spark):
    plan = queries.op11_fst_bpe(spark, "/root/testdata/sf0.01")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.agg(F.countDistinct("doc_id")).first()[0] == 1000
