import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from cleanloom.llm.piece_bpe import _repaired, coder, decode, encode, query

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "  ", "Hello world", "  two  spaces ", "a\nb\tc\r\n", "▁x ▁", "é́ñ ﬁ Ａ ß", "日本語 🙂\x00z", "<s> </s> <0x41> <unk>", "　x\xa0y​",
    " \n ", "1234567890 12,5 %", "=" * 500, "a" * 333, "ab" * 200, "\n" * 40, "x" + " " * 37 + "y" + " " * 40, "�\U0010ffff", "don't I'm WE'RE", "naïve-coöperate", "Ωμέγα привет",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids_of(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in coder(PATH).encode_batch(texts)]


def test_equals_library_on_chosen_texts(library):
    assert ids_of(TEXTS) == library.encode(TEXTS)
    assert [coder(PATH).decode(i).decode() for i in library.encode(TEXTS)] == [library.decode(i) for i in library.encode(TEXTS)]


def test_equals_library_on_random_texts(library):
    rng = random.Random(12)
    signs = "  eeaaattoinsrhldcumfpgwybvk.,'-\n\t=()/\\0123ABCÉéßüñ▁中文\U0001f600"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 120))) for _ in range(1500)]
    texts += ["".join(rng.choices("aab e", k=rng.randint(200, 900))) for _ in range(40)]
    assert ids_of(texts) == library.encode(texts)


def test_runs_of_spaces(library):
    texts = [a + " " * n + b for n in (*range(0, 70), 95, 100, 101, 111, 128, 333, 1000) for a in ("", "x") for b in ("", "the", "\n", "▁")]
    assert ids_of(texts) == library.encode(texts)


def test_long_texts(library):
    rng = random.Random(3)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20_000))
    texts = [word, " " * 100_000, "word " * 50_000, "-" * 30_000]
    assert ids_of(texts) == library.encode(texts)


def test_decodes_any_ids(library):
    rng, bpe = random.Random(5), coder(PATH)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), rng.randrange(0, 32000), 28705, 259, 1, 0]) for _ in range(rng.randint(0, 12))]
        assert bpe.decode(ids).decode() == library.decode(ids), ids
    assert _repaired(b"\xe6\x97a\xc3\xa9") == "��aé".encode()


def test_query_and_tables(spark, library):
    rows = [(i, t, 1, "x") for i, t in enumerate([*TEXTS, None, TEXTS[3]])] + [(None, "id is null", 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long, n_tokens string")
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, query(docs).collect()), key=key) == sorted(want, key=key)
    assert query(docs.limit(0)).collect() == []
    coded = encode(docs.select("doc_id", "text"), PATH)
    back = {r.doc_id: r.decoded for r in decode(coded, PATH).collect()}
    assert back == {i: library.decode(library.encode(t or "")) for i, t, *_ in rows}
