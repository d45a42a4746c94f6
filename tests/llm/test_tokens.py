"""Tokenizers against the public libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from tesselake.llm import bpe, tokens

MODEL, RANKS = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken")
TEXTS = ["", " ", "  a  b ", "a\nb\tc", "<s> hi", "▁a ▁ b", "a\x00b \x1c c", "x" * 3000, " " * 50, "é́ ﬁ ½ 日本🙂", "it's  we'll\n\n x's ", " a", "a\x85 b　c", "he'S 12ab ３４", "the of thander ereding"]


def made_up(n=400):
    rnd = random.Random(3)
    return ["".join(rnd.choice("ab cdethion▁  \n\té日🙂½\x00'") for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_counts_are_the_librarys():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    counter = tokens.PieceCounter(MODEL)
    for text in TEXTS + made_up():
        n = len(sp.encode(text))
        assert [counter.count(text), counter.count(text, chunk=3), counter.count(text, chunk=7)] == [n, n, n], repr(text)


def test_states_are_dropped_without_changing_counts():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    t = bpe.Transducer(bpe.piece_vocabulary(MODEL), counts=True, max_states=20)
    for text in made_up(50):
        whole = "▁" + text.replace(" ", "▁")
        assert (t.number(whole) if text else 0) == len(sp.encode(text))


def test_ids_are_the_librarys_and_decode():
    codec = tokens.ByteCodec(RANKS, P.PATTERN)
    vocabulary, _ = bpe.rank_vocabulary(RANKS)
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ids, special_tokens={})
    for text in TEXTS + made_up():
        coded = codec.encode(text)
        assert np.frombuffer(coded, "<u4").tolist() == encoding.encode_ordinary(text), repr(text)
        assert codec.decode(coded) == (text.encode(), True)


def test_utf8_machine():
    for data in [b"", b"a", "é日🙂".encode(), b"\xc0\x80", b"\xed\xa0\x80", b"\xe2\x82", b"\xf5\x80\x80\x80", b"\x80", b"\xf0\x8f\xbf\xbf", b"a\xff"]:
        try:
            data.decode()
            ok = True
        except UnicodeDecodeError:
            ok = False
        assert (tokens.Utf8States.read(0, data) == 0) == ok


def test_rows(spark):
    docs = spark.createDataFrame([(1, "the cat", "x"), (2, None, "x"), (None, "", "x"), (1, "the cat", "x")], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, tokens.token_counts(docs, MODEL, limit=1).collect()), key=str)
    assert got == [(1, 7, 2, True), (1, 7, 2, True), (2, 0, 0, False), (None, 0, 0, False)]
    empty = hashlib.sha256(b"").hexdigest()
    rows = {r["doc_id"]: r for r in tokens.byte_bpe(docs, RANKS, P.PATTERN, ids=True).collect()}
    assert (rows[2]["n_tokens"], rows[2]["ids_sha256"], rows[2]["decoded_sha256"], rows[2]["ids"]) == (0, empty, empty, [])
    assert rows[1]["decoded_sha256"] == hashlib.sha256(b"the cat").hexdigest() and rows[1]["round_trip"]
    assert tokens.token_counts(docs.limit(0), MODEL).count() == tokens.byte_bpe(docs.limit(0), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("a", ["", "ab", "▁ab", "a▁"])
def test_chunk_maps_compose_associatively(a):
    c = tokens.PieceCounter(MODEL)
    x, y, z = c.chunk_map("▁" + a, ""), c.chunk_map("b▁c▁▁d", (a or "▁")[-1]), c.chunk_map("e▁f", "d")
    assert c.compose(c.compose(x, y), z) == c.compose(x, c.compose(y, z))
