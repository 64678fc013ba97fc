"""SentencePiece encoding and decoding (BPE models with byte fallback) by vectorised merge rounds.

1. A text gets its dummy prefix, spaces become U+2581, and it is cut into units that no piece can cross: before a run of U+2581 if
   no piece has that sign after another one, and around signs that occur in no piece of several signs.
2. The distinct units of a batch are one flat array of symbols. In each round the least pair rank (best score) of every unit is
   found by a segmented minimum, all its places that don't overlap merge at once, leftmost first, and the array is compacted.
   Where such a merge makes a pair that comes before the others, the later places of that unit wait for the next round. Units
   without a pair leave the array, until none remains. Results are kept per worker, within a bound.
3. Symbols that are no pieces become the byte pieces of their UTF-8. Decoding joins the pieces' surfaces, drops the dummy prefix, and
   turns runs of byte pieces that aren't UTF-8 into one U+FFFD for each byte that fits nowhere.

Documents are independent: no shuffle, one Arrow pass, memory bounded by a batch and the bound of kept units. Defined cases: a null
text is an empty text, without ids and with an empty decoded text. Repeated rows give repeated rows, an empty table gives an empty
one, and extra columns, whatever their names, are ignored. Models that normalise characters, are no BPE, have symbols defined by
users or have no byte fallback raise.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import NONE, PairTable
from .common import chunks

#: The sign for a space, and what undecodable bytes become.
SPACE, REPLACEMENT = "▁", "�"
#: Bounds of a worker's memory: kept units, the signs of a unit that is kept, and characters handled at once.
CACHE, KEPT_UNIT, CHUNK = 400_000, 60, 1_000_000
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Model:
    """The pieces of a model file with their scores and kinds."""

    def __init__(self, data: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        trained, normal = proto.trainer_spec, proto.normalizer_spec
        self.pieces = [p.piece for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.prefix, self.unknown = normal.add_dummy_prefix, trained.unk_surface
        odd = {USER_DEFINED, UNUSED} & set(self.kinds)
        if trained.model_type != 2 or not trained.byte_fallback or normal.precompiled_charsmap or normal.remove_extra_whitespaces or trained.treat_whitespace_as_suffix or odd:
            raise ValueError("Only BPE models with byte fallback, without normalisation and without symbols of users, are read")


class PieceBpe:
    def __init__(self, model: Model) -> None:
        self.size, self.prefix = len(model.pieces), SPACE if model.prefix else ""
        own = {p: i for i, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)) if kind == NORMAL}
        # A symbol is a piece, or size plus its code point. Better scores have lesser ranks; equal ones share a rank.
        self.symbol = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for p, i in own.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        order = {s: r for r, s in enumerate(sorted({model.scores[i] for i in own.values()}, reverse=True))}
        self.rank = np.full(self.size + 1, NONE, np.int32)
        for i in own.values():
            self.rank[i] = order[model.scores[i]]
        self.pairs = PairTable((a, b, i) for p, i in own.items() for a, b in self._splits(p, own))
        self.byte_ids = np.zeros(256, np.uint32)
        self.surface, self.raw = [], {}
        for i, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)):
            if kind == BYTE:
                self.raw[i] = int(p[3:5], 16)
                self.byte_ids[self.raw[i]] = i
            self.surface.append({NORMAL: p.replace(SPACE, " "), CONTROL: "", UNKNOWN: model.unknown}.get(kind, "").encode() if kind != BYTE else bytes([self.raw[i]]))
        self.texts = [str(i) for i in range(self.size)]
        self.strip = {i for p, i in own.items() if p.startswith(SPACE)} if model.prefix else set()
        self.silent = {i for i, kind in enumerate(model.kinds) if kind == CONTROL}
        self.period = 0
        self.find = self._units(own)
        self.cache: dict[str, bytes] = {}
        self.period = self._period()

    def _splits(self, piece: str, own: dict[str, int]) -> Iterator[tuple[int, int]]:
        for at in range(1, len(piece)):
            a, b = (own.get(x, self.symbol[ord(x)] if len(x) == 1 else None) for x in (piece[:at], piece[at:]))
            if a is not None and b is not None:
                yield int(a), int(b)

    def _units(self, own: dict[str, int]):
        """Finds the units of a text: no piece of several signs goes over their ends."""
        joined = {c for p in own if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(0x80) if chr(c) not in joined)
        if any(SPACE in p.lstrip(SPACE) for p in own):
            return lambda text: [text] if text else []
        rest = f"[^{SPACE}{alone}]"
        return re.compile(f"{SPACE}+{rest}*|{rest}+|[{alone}]" if alone else f"{SPACE}+{rest}*|{rest}+").findall

    def _period(self, most: int = 100) -> int:
        """n where a run of more than n spaces is encoded as its first n and then the rest; 0 if there is no such n."""
        runs = [np.frombuffer(x, "<u4").tolist() for x in self.encode_units([SPACE * n for n in range(1, most)])]
        fits = (n for n in range(1, most // 4) if all(runs[k - 1] == runs[n - 1] + runs[k - n - 1] for k in range(n + 1, most)))
        return next(fits, 0)

    def _cut_runs(self, units: list[str]) -> list[str]:
        """Long runs of spaces in parts; the last part keeps a period at least, with what follows the run."""
        out = []
        for u in units:
            run = len(u) - len(u.lstrip(SPACE)) if self.period and u.startswith(SPACE * 3 * self.period) else 0
            n = max(0, run // self.period - 2) if run else 0
            out += [u[: self.period]] * n + [u[n * self.period :]]
        return out

    def _merged(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all units once no pair merges any more, and how many each unit has."""
        final, counts, unit = [np.empty(0, np.int32)] * len(sizes), np.zeros(len(sizes), np.int64), np.arange(len(sizes))
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(sizes) - 1] = True
        merge = np.full(len(symbols), NONE, np.int32)
        merge[:-1] = self.pairs.ranks(symbols[:-1], symbols[1:])
        merge[last] = NONE
        while len(unit):
            starts = np.cumsum(sizes) - sizes
            rank = self.rank[np.minimum(merge, self.size)]
            least = np.minimum.reduceat(rank, starts)
            live = least != NONE
            if not live.all():
                for k, a, n in zip(unit[~live].tolist(), starts[~live].tolist(), sizes[~live].tolist(), strict=True):
                    final[k] = symbols[a : a + n]
                counts[unit[~live]] = sizes[~live]
                stay = np.repeat(live, sizes)
                symbols, merge, rank, last = symbols[stay], merge[stay], rank[stay], last[stay]
                unit, sizes, least = unit[live], sizes[live], least[live]
                if not len(unit):
                    break
            own = np.repeat(np.arange(len(unit)), sizes)
            at = np.flatnonzero(rank == least[own])
            # Of places in a row every second one, from the left, can merge.
            first = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            made, of = merge[at], own[at]
            after = np.minimum(at + 2, len(symbols) - 1)
            to_right = self.rank[np.minimum(self.pairs.ranks(made, symbols[after]), self.size)]
            to_right[last[np.minimum(at + 1, len(symbols) - 1)]] = NONE
            before = np.where(np.diff(at, prepend=-3) == 2, np.concatenate([made[:1], made[:-1]]), symbols[np.maximum(at - 1, 0)])
            to_left = self.rank[np.minimum(self.pairs.ranks(before, made), self.size)]
            to_left[(at == 0) | last[np.maximum(at - 1, 0)]] = NONE
            # Once a merge makes a pair that comes next, what lies to its right in the unit waits.
            early = np.minimum(to_left, to_right) <= least[of]
            if early.any():
                seen = np.cumsum(early) - early
                begin = np.flatnonzero(np.diff(of, prepend=-1))
                at_begin = np.repeat(seen[begin], np.diff(np.append(begin, len(of))))
                wait = seen > at_begin
                at, made, of = at[~wait], made[~wait], of[~wait]
            symbols[at] = made
            last[at] = last[at + 1]
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            spot = at - np.arange(len(at))
            symbols, merge, last = symbols[~gone], merge[~gone], last[~gone]
            sizes = sizes - np.bincount(of, minlength=len(sizes))
            spot = np.unique(np.concatenate([spot, spot - 1]))
            spot = spot[(spot >= 0) & (spot < len(symbols))]
            merge[spot] = NONE
            inner = spot[~last[spot]]
            merge[inner] = self.pairs.ranks(symbols[inner], symbols[inner + 1])
        return (np.concatenate(final) if final else np.empty(0, np.int32)), counts

    def encode_units(self, units: list[str]) -> list[bytes]:
        """For each unit (not empty) its ids, as little-endian unsigned 32-bit integers."""
        if not units:
            return []
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        symbols, counts = self._merged(self.symbol[points], np.fromiter(map(len, units), np.int64, len(units)))
        if (symbols >= self.size).any():
            width = np.ones(len(symbols), np.int64)
            other = np.flatnonzero(symbols >= self.size)
            coded = [self.byte_ids[np.frombuffer(chr(c).encode(), np.uint8)] for c in (symbols[other] - self.size).tolist()]
            width[other] = [len(x) for x in coded]
            ids = np.repeat(symbols.astype(np.uint32), width)
            put = np.repeat(symbols >= self.size, width)
            ids[put] = np.concatenate(coded)
            counts = np.add.reduceat(width, np.cumsum(counts) - counts)
        else:
            ids = symbols.astype(np.uint32)
        flat, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        parts = []
        for t in texts:
            units = self.find(self.prefix + t.replace(" ", SPACE)) if t else []
            parts.append(self._cut_runs(units) if SPACE * 100 in t.replace(" ", SPACE) else units)
        if len(self.cache) > CACHE:
            self.cache = {}
        known = self.cache
        missing = list(set(chain.from_iterable(parts)).difference(known))
        known.update(zip(missing, self.encode_units(missing), strict=True))
        out = [b"".join(map(known.__getitem__, units)) for units in parts]
        for u in missing:
            if len(u) > KEPT_UNIT:
                del known[u]
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The decoded text in UTF-8."""
        shown = [self.surface[i] for i in ids]
        lead = next((k for k, i in enumerate(ids) if i not in self.silent), None)
        if lead is not None and ids[lead] in self.strip:
            shown[lead] = shown[lead][1:]
        joined = b"".join(shown)
        if self.silent.isdisjoint(ids):  # a piece without a surface parts the bytes around it
            try:
                joined.decode()
                return joined
            except UnicodeDecodeError:
                pass
        out, run = [], bytearray()
        for i, s in chain(zip(ids, shown, strict=True), [(-1, b"")]):
            if i in self.raw:
                run += s
                continue
            out += [_repaired(bytes(run)), s]
            run.clear()
        return b"".join(out)


def _repaired(raw: bytes) -> bytes:
    """UTF-8 as it is; each byte that begins no whole sign becomes U+FFFD."""
    out = []
    while raw:
        try:
            raw.decode()
            out.append(raw)
            break
        except UnicodeDecodeError as e:
            out += [raw[: e.start], REPLACEMENT.encode()]
            raw = raw[e.start + 1 :]
    return b"".join(out)


_made: dict[str, PieceBpe] = {}


def coder(path: str) -> PieceBpe:
    """One for each worker process."""
    if path not in _made:
        with open(path, "rb") as f:
            _made[path] = PieceBpe(Model(f.read()))
    return _made[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (an array) of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            at = 0
            for part in chunks(batch.column("text"), CHUNK):
                ids = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode_batch(part)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), ids], ["doc_id", "ids"])
                at += len(part)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded text of each row of encode()'s result; null ids are none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            out = pa.array([bpe.decode(x or []).decode() for x in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encode and decode in one pass, so that ids never leave the worker."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            at = 0
            for part in chunks(batch.column("text"), CHUNK):
                counts, ids_sha, text_sha = [], [], []
                for x in bpe.encode_batch(part):
                    ids = np.frombuffer(x, "<u4").tolist()
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(bpe.texts.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                columns = [batch.column("doc_id").slice(at, len(part)), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(part)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
