"""Byte-level BPE encoding and decoding with length-bucketed, padded numpy matrices.

Distinct regex matches of a batch of texts become rows of matrices, one for each bucket of byte lengths. In each round every
row merges its leftmost pair of minimum rank: ranks of adjacent pairs come from a hash table (open addressing, vectorised
probing), the merged column is closed up, and finished rows leave the matrix. Results are cached per worker, within a bound.
A piece over LONG bytes is a matrix of one row, in which a round merges all places of the least rank that don't overlap, from the
left; where that would differ from one merge after the other, the round merges the leftmost alone.

Documents are independent: no shuffle, one Arrow pass. Defined cases: a null text is an empty text, whose ids and bytes are
empty (their SHA-256 is that of no bytes). Repeated rows give repeated rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import chunks

NONE = np.int32(2**31 - 1)
LONG = 1024
#: Longer parts of a text, such as whole texts, don't stay in the cache.
LONG_UNIT = 60
#: Bounds of a worker's memory: cached pieces, and characters handled at once.
CACHE = 600_000
CHUNK = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Hash table from (left id, right id) to the id of their merge; lesser ids merge first."""

    def __init__(self, pairs: Iterable[tuple[int, int, int]]) -> None:
        keys, values = [], []
        for a, b, merged in pairs:
            keys.append((a << 32) | b)
            values.append(merged)
        self.bits = max(4, len(keys).bit_length() + 2)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        key, value = np.array(keys, np.int64), np.array(values, np.int32)
        at = self._home(key)
        while key.size:
            free = np.flatnonzero(self.keys[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = key[put], value[put]
            rest = np.ones(key.size, bool)
            rest[put] = False
            key, value, at = key[rest], value[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids, NONE where the pair has none."""
        shape = left.shape
        key = ((left.astype(np.int64) << 32) | right.astype(np.int64)).ravel()
        out = np.full(key.size, NONE, np.int32)
        at, todo = self._home(key), None
        found = self.keys[at]
        hit = found == key
        out[hit] = self.values[at[hit]]
        todo = np.flatnonzero(~hit & (found != -1))
        while todo.size:
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out.reshape(shape)


def pairs_of(ranks: dict[bytes, int]) -> Iterator[tuple[int, int, int]]:
    """Every way in which a token is two tokens."""
    for token, rank in ranks.items():
        for at in range(1, len(token)):
            a, b = ranks.get(token[:at]), ranks.get(token[at:])
            if a is not None and b is not None:
                yield a, b, rank


def merge_rows(ids: np.ndarray, sizes: np.ndarray, pairs: PairTable, kind: str = "<u4") -> list[bytes]:
    """The ids of each row (of which the first `sizes` count) once no pair merges any more."""
    n, width = ids.shape
    columns = np.arange(width, dtype=np.int32)
    pair = pairs.ranks(ids[:, :-1], ids[:, 1:])
    pair[columns[1:] >= sizes[:, None]] = NONE
    pair = np.concatenate([pair, np.full((n, 1), NONE, np.int32)], 1)
    rows, result = np.arange(n), [b""] * n
    bytes_each = np.dtype(kind).itemsize
    while rows.size:
        at = pair.argmin(1)
        live = pair[np.arange(rows.size), at] != NONE
        if not live.all():
            done, long = np.flatnonzero(~live), sizes[~live]
            flat = ids[done][columns[: ids.shape[1]] < long[:, None]].astype(kind).tobytes()
            ends = (np.cumsum(long) * bytes_each).tolist()
            for r, a, b in zip(rows[done].tolist(), [0, *ends], ends, strict=False):
                result[r] = flat[a:b]
            rows, at, ids, pair, sizes = rows[live], at[live], ids[live], pair[live], sizes[live]
            if not rows.size:
                break
            most = int(sizes.max())
            ids, pair = ids[:, :most], pair[:, :most]
        k = np.arange(rows.size)
        ids[k, at] = pair[k, at]
        width = ids.shape[1]
        source = columns[:width] + (columns[:width] > at[:, None])
        np.minimum(source, width - 1, out=source)
        # Close up the merged column. The pair that starts there was the next one; both pairs that touch the merged id are looked up anew.
        ids, pair = np.take_along_axis(ids, source, 1), np.take_along_axis(pair, source, 1)
        sizes = sizes - 1
        pair[k, sizes - 1] = NONE
        r = k[at < sizes - 1]
        pair[r, at[r]] = pairs.ranks(ids[r, at[r]], ids[r, at[r] + 1])
        r = k[at > 0]
        pair[r, at[r] - 1] = pairs.ranks(ids[r, at[r] - 1], ids[r, at[r]])
    return result


def merge_long(ids: np.ndarray, pairs: PairTable, kind: str = "<u4") -> bytes:
    """The same for one long row, with all places of the least rank in one round."""
    pair = pairs.ranks(ids[:-1], ids[1:])
    while len(pair) and (least := pair.min()) != NONE:
        at = np.flatnonzero(pair == least)
        # Of places in a row every second one, from the left, can be merged.
        fresh = np.diff(at, prepend=-2) != 1
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - first) % 2 == 0]
        after = ids[at[at + 2 < len(ids)] + 2]
        before = np.where(np.diff(at, prepend=-2) == 2, least, ids[at - 1])[at > 0]
        one = np.full(max(len(after), len(before)), least)
        if (pairs.ranks(one[: len(after)], after) < least).any() or (pairs.ranks(before, one[: len(before)]) < least).any():
            at = at[:1]  # a merge would make a pair that comes before the others
        merged = np.zeros(len(ids), bool)
        merged[at + 1] = True
        ids[at] = least
        spot = at - np.arange(len(at))
        ids, pair = ids[~merged], pair[~merged[1:]]
        # The pair of a merged place was closed up; look up anew those that touch a merged id.
        spot = np.unique(np.concatenate([spot, spot - 1]))
        spot = spot[(spot >= 0) & (spot < len(pair))]
        pair[spot] = pairs.ranks(ids[spot], ids[spot + 1])
    return ids.astype(kind).tobytes()


def by_length(pieces: list[bytes], cells: int = 2_000_000) -> Iterator[tuple[list[int], int]]:
    """Indices of pieces of similar length, and a width that holds them: matrices of at most `cells` cells."""
    buckets: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        if piece:
            buckets.setdefault((len(piece) - 1).bit_length(), []).append(i)
    for bits, rows in buckets.items():
        width = max(2, 1 << bits)
        step = max(1, cells // width)
        for k in range(0, len(rows), step):
            yield rows[k : k + step], width


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.uneven = regex.compile(r" (?=\s|\Z)").search
        self.pairs = PairTable(pairs_of(ranks))
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.cache: dict[str, bytes] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """For each piece its ids, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        matrix: list[bytes] = [b""] * len(pieces)
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > LONG:
                out[i] = merge_long(self.of_byte[np.frombuffer(piece, np.uint8)], self.pairs)
            else:
                matrix[i] = piece
        for rows, width in by_length(matrix):
            part = [matrix[i] for i in rows]
            flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in part), np.uint8).reshape(-1, width)
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            for i, ids in zip(rows, merge_rows(self.of_byte[flat], sizes, self.pairs), strict=True):
                out[i] = ids
        return out

    def units(self, text: str) -> list[str]:
        """Parts of text whose matches, taken together, are the matches of text.

        Where each space is followed by other than white space, no match crosses the place before a space: matches take a space
        only at their start, and a run of white space before such a place ends in a match of its own. Other texts stay whole.
        """
        if " " not in text or self.uneven(text):
            return [text]
        first, *others = text.split(" ")
        return [first, *map(" ".__add__, others)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        parts = [self.units(t) for t in texts]
        if len(self.cache) > CACHE:
            self.cache = {}
        known = self.cache
        missing = list(set().union(*parts).difference(known))
        found = [self.find(u) for u in missing]
        distinct = list({p for pieces in found for p in pieces})
        ids = dict(zip(distinct, self.encode_pieces([p.encode() for p in distinct]), strict=True))
        known.update((u, b"".join(map(ids.__getitem__, pieces))) for u, pieces in zip(missing, found, strict=True))
        out = [b"".join(map(known.__getitem__, us)) for us in parts]
        for u in missing:
            if len(u) > LONG_UNIT:
                del known[u]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_made: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """One for each worker process."""
    if (path, pattern) not in _made:
        _made[path, pattern] = ByteBpe(load_ranks(path), pattern)
    return _made[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            at = 0
            for part in chunks(batch.column("text"), CHUNK):
                ids = pa.array(bpe.encode_batch(part), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), ids], ["doc_id", "ids"])
                at += len(part)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and decoded bytes of each row of encode()'s result."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            out = pa.array([bpe.decode(x) for x in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out], ["doc_id", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encode and decode in one pass, so that ids never leave the worker."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            at = 0
            for part in chunks(batch.column("text"), CHUNK):
                ids = bpe.encode_batch(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(part)),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                at += len(part)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
