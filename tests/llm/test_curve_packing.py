import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from cleanloom.llm import curve_packing as C
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_hilbert_is_a_path():
    """Keys are a bijection whose neighbours differ by one step in one coordinate."""
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        keys = C.hilbert(points, bits)
        assert sorted(keys) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_pieces(spark):
    texts = [None, "", "a", "Hello,  WORLD\n'tis", "é́ İ x's <|endoftext|> \t 漢字 12", "a <|endoftext|> b<|startoftext|>é c <|ENDOFTEXT|>", "<|endoftext|>", "word " * 9000, "word " * 9000, "x" * 50_000]
    rows = [(i, t, "b") for i, t in enumerate(texts)] + [(2, "a", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = C.pieces(docs, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    whole = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in rows}
    assert sum(r["length"] for r in got) == sum(len(whole[i]) for i, _, _ in rows)
    for r in got:
        own = whole[r["doc_id"]]
        ids = np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert len(own) == r["doc_tokens"] and zlib.crc32(ids) == r["ids_crc32"] and ids == r["ids"]
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s, parts in by.items():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0
        assert s == max(by) or sum(n for _, n in parts) == C.SEQUENCE
    assert sorted(by) == list(range(len(by)))


def test_empty(spark):
    assert C.pieces(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_words_as_the_library_does():
    rng = random.Random(4)
    letters = [*"abcdeABC 0123'sтüÉßÆŸñ漢字😀\n\t.,!_-|&", "İ", "'s", "'LL", "  ", "̈", "ǆ", "ŉ", "Ω", "the", "ing", "<|endoftext|>", "<|startoftext|>", "<|", "|>"]
    coder, tokenizer = C.tokens_of(PATH), Tokenizer.from_file(PATH)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    want = [[*e.ids, 2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, coder.kind).tolist() for x in coder.encode_batch(texts)] == want
    assert coder.plain is not None
