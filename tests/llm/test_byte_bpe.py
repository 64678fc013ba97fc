import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from cleanloom.llm import byte_bpe as B
from hypothesis import given, settings
from hypothesis import strategies as st

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BPE = B.coder(PATH, public_tokenizers.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})


def ids(text):
    return np.array(REFERENCE.encode_ordinary(text), "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert BPE.encode_batch([text]) == [ids(text)]
    assert BPE.decode(ids(text)) == text.encode()


def test_many_texts():
    rng = random.Random(2)
    signs = [*"abcdeABC 0123'sтüéß漢字😀\n\t\r\x1c\x85\xa0　​́.,!_-", " 's", "  ", "the", "ing"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    assert BPE.encode_batch(texts) == [ids(t) for t in texts]


@pytest.mark.parametrize("text", ["ab" * 30_000, "x" * 5000 + "é" * 3000, "z" * B.LONG, " " * 4000 + "a"])
def test_long_pieces(text):
    assert BPE.encode_batch([text])[0] == ids(text)


def test_long_and_short_matrices_agree(monkeypatch):
    rng = random.Random(4)
    pieces = ["".join(rng.choice("abcdeinst") for _ in range(B.LONG + k)).encode() for k in (-1, 0, 1, 200)]
    dealt = BPE.encode_pieces(pieces)
    monkeypatch.setattr(B, "LONG", 2 * B.LONG)  # one merge a row and round
    assert BPE.encode_pieces(pieces) == dealt


def test_ranks_in_any_order():
    """Rank tables that no training would give, in which a merge may bring up a pair of lesser rank."""
    rng = random.Random(9)
    for _ in range(200):
        tokens = [bytes([b]) for b in range(256)] + rng.sample(sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(14)}), 8)
        pairs = B.PairTable(B.pairs_of({t: i for i, t in enumerate(tokens)}))
        row = np.frombuffer(bytes(rng.choice(b"abc") for _ in range(40)), np.uint8).astype(np.int32)
        assert B.merge_long(row.copy(), pairs) == B.merge_rows(row[None].copy(), np.array([40]), pairs)[0]


def test_query(spark):
    rows = [(1, None), (2, ""), (3, "Hello <|endoftext|> wörld"), (3, "Hello <|endoftext|> wörld"), (None, "a"), (4, "word " * 50_000)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, ids int")
    got = sorted((tuple(r) for r in B.query(docs).collect()), key=str)
    want = [(i, len(ids(t or "")) // 4, hashlib.sha256(ids(t or "")).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    assert got == sorted(want, key=str)
    encoded = B.encode(docs, PATH, public_tokenizers.PATTERN)
    assert {bytes(r["decoded"]).decode() for r in B.decode(encoded, PATH, public_tokenizers.PATTERN).collect()} == {t or "" for _, t in rows}
    assert B.query(spark.createDataFrame([], "doc_id long, text string")).collect() == []
