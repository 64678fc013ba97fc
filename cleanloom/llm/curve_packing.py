"""Packing along a space-filling curve.

Each document is tokenised, its tokens are hashed into a vector of HASHED dimensions, a fixed random projection takes that
to DIMENSIONS coordinates, and the Hilbert curve turns those into one key. Documents are range-sorted by (key, doc_id) and
laid end to end along the curve; sequences of SEQUENCE tokens are cut from that line, so neighbours in content share
sequences and only the last sequence has padding.

Tokenisation is the only costly pass and runs once: its ids go to a table in the shared folder as 16-bit numbers where the
vocabulary allows. The sort moves only keys and lengths, and it splits groups of equal keys by doc_id; running sums are kept
for each sorted partition and the partitions' totals (a row for each partition) give the place of every document.

Defined cases: a null text is an empty text, which is the end token alone. Rows that repeat a doc_id are documents of their
own, each packed. An empty table gives an empty result. Extra columns are ignored by `pieces`.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import PairTable, by_length, merge_rows
from .common import chunks, cut, give_back

SEQUENCE = 4096
#: Fixed by the contract: the id that ends each document.
END = 2
HASHED, DIMENSIONS, BITS = 256, 4, 15
CACHE = 900_000
CHUNK = 2_000_000
LONG_UNIT = 60
SIGNS = (".", ",", ";", ":")


class WordTokens:
    """A tokenizer of lower-cased words whose splits never cross a space, with the ids of space-separated parts cached within a bound.

    Parts of plain Latin letters, digits and signs are split here and merged in padded matrices (see byte_bpe), which takes a
    fraction of the library's time for many new words; other parts, or another kind of tokenizer, go to the library.
    """

    def __init__(self, path: str, most: int = CACHE) -> None:
        from tokenizers import Tokenizer

        self.most = most

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes] = {}
        made = json.loads(self.tokenizer.to_str())
        #: Texts that hold one of these are the library's as a whole: it cuts them there before anything else.
        self.special = [x["content"] for x in made.get("added_tokens") or ()]
        self.plain = self._matrices(made)

    def _matrices(self, made: dict):
        """The test for parts that are merged here; None if the tokenizer isn't a byte-level BPE of lower-cased words."""
        model, vocabulary = made["model"], made["model"].get("vocab") or {}
        steps = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        splits = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in splits] != ["Split", "ByteLevel"]:
            return None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        triples = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges]
        ordered = [t[2] for t in triples]
        if ordered != sorted(set(ordered)):  # the matrices merge lesser ids first
            return None
        letter = bytes_to_letters()
        end = model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocabulary[letter[b]] for b in range(256)], np.int32)
        self.last = np.array([vocabulary[letter[b] + end] for b in range(256)], np.int32)
        self.pairs = PairTable(triples)
        self.split = regex.compile(splits[0]["pattern"]["Regex"]).findall
        # NFC leaves these letters as they are, and each has one lower-case form.
        return regex.compile(r"[\x21-\x7e\u00c0-\u012f\u0131-\u0148\u014a-\u017e]{1,200}").fullmatch

    def _new_words(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        for rows, width in by_length(raw):
            part = [raw[i] for i in rows]
            flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in part), np.uint8).reshape(-1, width)
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            ids, k = self.inner[flat], np.arange(len(part))
            ids[k, sizes - 1] = self.last[flat[k, sizes - 1]]
            for i, found in zip(rows, merge_rows(ids, sizes, self.pairs, self.kind.str), strict=True):
                self.cache[words[i]] = found

    def _library(self, units: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch(units, add_special_tokens=False)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if any(x in t for x in self.special)]
        # Line feeds part words as spaces do, and a word before one is the word that it is before a space.
        parts = [(t.replace("\n", " ") if self.plain else t).split(" ") for t in texts]
        for i in whole:
            parts[i] = []
        units = set().union(*parts)
        if len(self.cache) > self.most:  # what this batch needs stays
            self.cache = {u: self.cache[u] for u in units.intersection(self.cache)}
        known = self.cache
        missing = list(units.difference(known))
        alone, signed, split, pieces, others = [], [], [], [], []
        for u in missing if self.plain else ():
            # Most parts are a word, or a word and a sign: letters and signs are always apart.
            if len(u) < LONG_UNIT and (u.isascii() or self.plain(u)):
                if u.isalpha():
                    alone.append(u)
                    continue
                if u[-1:] in SIGNS and u[:-1].isalpha():
                    signed.append(u)
                    continue
            if self.plain(u):
                split.append(u)
                pieces.append(self.split(u.lower()))
            else:
                others.append(u)
        if not self.plain:
            others = missing
        lower, stems = [u.lower() for u in alone], [u[:-1].lower() for u in signed]
        # A word or sign by itself is a part too, with the same ids.
        new = set(lower).union(stems, SIGNS if signed else (), *pieces).difference(known)
        self._new_words(list(new))
        ids_of = known.__getitem__
        known.update(zip(alone, map(ids_of, lower), strict=True))
        known.update((u, ids_of(w) + ids_of(u[-1])) for u, w in zip(signed, stems, strict=True))
        known.update((u, b"".join(map(ids_of, own))) for u, own in zip(split, pieces, strict=True))
        known.update(zip(others, self._library(others), strict=True))
        end = np.array([END], self.kind).tobytes()
        out = [b"".join(map(ids_of, us)) + end for us in parts]
        for i, ids in zip(whole, self._library([texts[i] for i in whole]), strict=True):
            out[i] = ids + end
        for unit in (*split, *others, *new):
            if len(unit) > LONG_UNIT:
                known.pop(unit, None)
        return out


def bytes_to_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def projection() -> np.ndarray:
    return np.random.default_rng(9).standard_normal((HASHED, DIMENSIONS))


def coordinates(ids: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
    """Of each document, in whole numbers of BITS bits."""
    vectors = np.stack([np.bincount(((x.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)).astype(np.intp), minlength=HASHED) for x in ids]).astype(float)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    where = vectors @ matrix
    return np.clip((where / 6 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys along the Hilbert curve of points with whole coordinates of `bits` bits (rows; bits * columns under 64)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:  # undo the rotations of each level, from the coarsest
        low = level - 1
        for i in range(n):
            high = (x[i] & level) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, n):  # to a Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip ^= np.where((x[n - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


_made: dict[tuple[str, int], WordTokens] = {}


def tokens_of(path: str, most: int = CACHE) -> WordTokens:
    """One for each worker process."""
    if (path, most) not in _made:
        _made[path, most] = WordTokens(path, most)
    return _made[path, most]


def tokenised(docs: DataFrame, path: str, most: int = CACHE) -> DataFrame:
    """doc_id, ids (little-endian, 16 or 32 bits), doc_tokens and the key along the curve of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, matrix, chunk = tokens_of(path, most), projection(), CHUNK * most // CACHE
        for batch in batches:
            at = 0
            for part in chunks(batch.column("text"), chunk):
                raw = coder.encode_batch(part)
                ids = [np.frombuffer(x, coder.kind) for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(part)),
                        pa.array(raw, pa.binary()),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array(hilbert(coordinates(ids, matrix))),
                    ],
                    ["doc_id", "ids", "doc_tokens", "key"],
                )
                at += len(part)
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, doc_tokens long, key long")


def _running(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens before each row within its sorted partition."""
    total = 0
    for batch in batches:
        sizes = batch.column("doc_tokens").to_numpy()
        ends = total + np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("part"), batch.column("doc_tokens"), pa.array(ends - sizes)], ["row", "part", "doc_tokens", "inside"])
        total = int(ends[-1]) if len(ends) else total


def places(table: DataFrame) -> DataFrame:
    """row and global_start: where each document of `table` (row, doc_id, doc_tokens, key) begins on the line along the curve."""
    spark = table.sparkSession
    ordered = table.select("row", "doc_id", "doc_tokens", "key").repartitionByRange("key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row")
    ordered = ordered.select("row", F.spark_partition_id().alias("part"), "doc_tokens")
    inside = cut(ordered.mapInArrow(_running, "row long, part int, doc_tokens long, inside long"), "curve-order")
    totals = inside.groupBy("part").agg(F.sum("doc_tokens").alias("n")).orderBy("part").collect()  # a row for each partition
    before, starts = 0, []
    for r in totals:
        starts.append((r["part"], before))
        before += r["n"]
    starts = spark.createDataFrame(starts, "part int, before long")
    return inside.join(F.broadcast(starts), "part").select("row", (F.col("before") + F.col("inside")).alias("global_start"))


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, most: int = CACHE) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (32-bit, little-endian).

    most: how many words a worker keeps with their ids, and in proportion how much text it takes at once; fewer take less memory and more time.
    """
    table = cut(tokenised(docs, path, most).withColumn("row", F.monotonically_increasing_id()), "curve-ids")
    placed = table.select("row", "doc_id", "ids", "doc_tokens").join(places(table), "row").select("doc_id", "ids", "doc_tokens", "global_start")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            columns = [batch.column(k).to_pylist() for k in ("doc_id", "ids", "doc_tokens", "global_start")]
            for doc_id, raw, n, begin in zip(*columns, strict=True):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                at = 0
                while at < n:
                    spot = (begin + at) % sequence
                    size = min(n - at, sequence - spot)
                    own = ids[at : at + size].tobytes()
                    for column, value in zip(rows, (doc_id, at, size, zlib.crc32(own), n, (begin + at) // sequence, spot, own), strict=True):
                        column.append(value)
                    at += size
            kinds = [batch.schema.field("doc_id").type, *[pa.int64()] * 6, pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pieces(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")
