"""Encoding and decoding with a merge-type piece vocabulary.

The encoder keeps an agenda of adjacent symbol pairs by score: the pair whose piece has
the highest score merges first, the leftmost of equals. No merge crosses two characters
that no piece holds side by side, so texts fall into short segments, equal segments are
encoded once, and many segments share each step of array work. Results are compared
with the sentencepiece library in every Arrow batch.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import over_batches, pieces, span_hashes, table, text_bytes

SPACE = 0x2581
_NONE = np.int32(2**30)
#: Symbols from here on are characters without a piece.
_LOOSE = 1 << 21
#: Segments that a worker remembers before it starts anew.
REMEMBERED = 200_000


class PieceModel:
    """The vocabulary of a model file, and what is known of segments so far."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        n = lib.get_piece_size()
        text = [lib.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.bos, self.eos = lib.bos_id(), lib.eos_id()
        self.byte_ids = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        scores = np.full(n, -np.inf)
        for i in normal:
            scores[i] = lib.get_score(i)
        order = np.unique(-scores[normal])
        self.rank = np.full(n, _NONE, np.int32)
        self.rank[normal] = np.searchsorted(order, -scores[normal])
        self.id_of = {text[i]: i for i in normal}
        long = [text[i] for i in normal if len(text[i]) > 1]
        # single characters
        self.char = np.arange(0x110000, dtype=np.int32) + _LOOSE
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        # characters side by side in some piece
        alphabet = sorted({c for p in long for c in p})
        self.index = np.zeros(0x110000, np.uint16)
        self.index[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.beside = np.zeros((len(alphabet) + 1, len(alphabet) + 1), bool)
        for p in long:
            k = self.index[[ord(c) for c in p]]
            self.beside[k[:-1], k[1:]] = True
        # pairs of symbols that make a piece
        pairs = {}
        for p in long:
            for i in range(1, len(p)):
                a, b = self.symbol(p[:i]), self.symbol(p[i:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = self.id_of[p]
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.pairs = pairs
        self.forget()

    def forget(self) -> None:
        self.slot_of: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.first = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int32)
        self.slots = 0

    def symbol(self, piece: str) -> int | None:
        return self.id_of.get(piece) if len(piece) > 1 else int(self.char[ord(piece)])

    def agenda(self, symbols: list[int]) -> list[int]:
        """Merge one segment through a heap of pairs: score, then position."""
        right = [*range(1, len(symbols)), -1]
        left = list(range(-1, len(symbols) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (p := self.pairs.get((symbols[i] << 32) | symbols[j])) is not None:
                heapq.heappush(heap, (int(self.rank[p]), i, j, p, symbols[i], symbols[j]))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, p, a, b = heapq.heappop(heap)
            if symbols[i] != a or symbols[j] != b or right[i] != j:
                continue  # one of them has merged since
            symbols[i], symbols[j] = p, -1
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [s for s in symbols if s >= 0]

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Piece of each pair, or -1."""
        key = (a.astype(np.int64) << 32) | b.astype(np.int64)
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ids[at], -1)

    def _ranks(self, made: np.ndarray) -> np.ndarray:
        return np.where(made >= 0, self.rank[made], _NONE)

    def agendas(self, symbols: np.ndarray) -> np.ndarray:
        """Merge many segments, a row each, padded with -1: each step takes each row's best pair."""
        done = symbols.copy()
        rows = np.arange(len(symbols))
        made = self._pair(symbols[:, :-1], symbols[:, 1:])
        ranks = self._ranks(made)
        while True:
            best = ranks.argmin(axis=1)
            live = ranks[np.arange(len(best)), best] < _NONE
            if not live.all():
                done[rows[~live]] = symbols[~live]
                rows, symbols, made, ranks, best = rows[live], symbols[live], made[live], ranks[live], best[live]
            if not len(rows):
                return done
            every = np.arange(len(rows))
            width = symbols.shape[1]
            columns = np.arange(width)[None, :]
            symbols[every, best] = made[every, best]
            shift = np.minimum(columns + (columns > best[:, None]), width - 1)
            symbols = np.take_along_axis(symbols, shift, 1)
            symbols[:, -1] = -1
            pair_shift = np.minimum(shift[:, :-1], width - 2)
            made = np.take_along_axis(made, pair_shift, 1)
            ranks = np.take_along_axis(ranks, pair_shift, 1)
            made[:, -1] = -1
            ranks[:, -1] = _NONE
            for at in (best - 1, best):
                ok = (at >= 0) & (at < width - 1)
                r, c = every[ok], at[ok]
                new = self._pair(symbols[r, c], symbols[r, c + 1])
                made[r, c], ranks[r, c] = new, self._ranks(new)

    def _remember(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, chars: np.ndarray) -> None:
        """Encode segments and keep their ids under their hashes."""
        lengths = ends - starts
        low = 0
        for high in (1, 4, 8, 12, 16, 24, 40, 64):
            which = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            for part in range(0, len(which), 20_000):
                w = which[part : part + 20_000]
                at = starts[w][:, None] + np.arange(high)[None, :]
                inside = at < ends[w][:, None]
                symbols = np.where(inside, self.char[chars[np.minimum(at, len(chars) - 1)]], -1).astype(np.int32)
                if high > 1:
                    symbols = self.agendas(symbols)
                made = symbols >= 0
                self._keep(hashes[w], symbols[made], made.sum(axis=1))
        for i in np.flatnonzero(lengths > low).tolist():
            ids = np.array(self.agenda(self.char[chars[starts[i] : ends[i]]].tolist()), np.int32)
            self._keep(hashes[i : i + 1], ids, np.array([len(ids)]))

    def _keep(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """ids: those of all segments, one after the other."""
        loose = np.flatnonzero(ids >= _LOOSE)
        if len(loose):  # no piece: one id for each byte
            extra = [self.byte_ids[list(chr(s).encode())] for s in (ids[loose] - _LOOSE).tolist()]
            owner = np.searchsorted(np.cumsum(sizes), loose, side="right")
            repeat = np.ones(len(ids), np.int64)
            repeat[loose] = [len(x) for x in extra]
            sizes = sizes.copy()
            np.add.at(sizes, owner, repeat[loose] - 1)
            first = np.cumsum(repeat) - repeat
            ids = np.repeat(ids, repeat)
            for at, x in zip(first[loose].tolist(), extra, strict=True):
                ids[at : at + len(x)] = x
        n, total = len(hashes), len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.slots + n > len(self.first):
            self.first = np.concatenate((self.first, np.zeros_like(self.first)))
            self.size = np.concatenate((self.size, np.zeros_like(self.size)))
        self.flat[self.used : self.used + total] = ids
        self.first[self.slots : self.slots + n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.slots : self.slots + n] = sizes
        self.slot_of.update(zip(hashes.tolist(), range(self.slots, self.slots + n), strict=True))
        self.used += total
        self.slots += n

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, without begin and end ids, and the n + 1 offsets of the rows."""
        n = len(offsets) - 1
        chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        at = lead[offsets]
        filled = np.flatnonzero(at[1:] > at[:-1])
        if not len(filled):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        chars = np.insert(chars, at[:-1][filled], SPACE)
        row_start = at[:-1][filled] + np.arange(len(filled))
        chars = np.where(chars == 0x20, SPACE, chars)
        k = self.index[chars]
        start = np.ones(len(chars), bool)
        start[1:] = ~self.beside[k[:-1], k[1:]]
        start[row_start] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(chars))
        hashes = span_hashes(chars, starts, ends)
        unique, some, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if self.slots > REMEMBERED:
            self.forget()
        keys = unique.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.slot_of]
        if new:
            w = some[new]
            self._remember(unique[new], starts[w], ends[w], chars)
        slots = np.array([self.slot_of[h] for h in keys], np.int64)[inverse]
        sizes = self.size[slots].astype(np.int64)
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.repeat(self.first[slots] - cuts[:-1], sizes) + np.arange(cuts[-1])]
        out = np.zeros(n + 1, np.int64)
        first_segment = np.searchsorted(starts, row_start)
        bounds = cuts[np.append(first_segment, len(starts))]
        out[1:][filled] = np.diff(bounds)
        return ids, np.cumsum(out)


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _coder(path: str, column: str, names: list[str], whole: bool):
    """whole: ids and decoded text themselves instead of their digests."""

    def run(batches):
        m = model(path)
        for batch in batches:
            for part in pieces(batch, column, 500_000):
                data, offsets = text_bytes(part.column(part.schema.get_field_index(column)))
                ids, cuts = m.encode(data, offsets)
                # begin and end ids around each row
                ends = cuts[1:] + 2 * np.arange(1, len(cuts))
                marked = np.empty(len(ids) + 2 * len(part), "<u4")
                marked[ends - 1] = m.eos
                marked[ends - np.diff(cuts) - 2] = m.bos
                inside = np.ones(len(marked), bool)
                inside[ends - 1] = inside[ends - np.diff(cuts) - 2] = False
                marked[inside] = ids
                flat, at = marked.tolist(), [0, *ends.tolist()]
                own = [flat[a:b] for a, b in zip(at, at[1:], strict=False)]
                texts = [x or "" for x in part.column(part.schema.get_field_index(column)).to_pylist()]
                checked = m.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
                agrees = [x == y for x, y in zip(own, checked, strict=True)]
                raw = [marked[a:b] for a, b in zip(at, at[1:], strict=False)]
                decoded = m.library.decode(own, num_threads=1)
                if whole:
                    new = [pa.array([x.astype(np.int32) for x in raw], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                else:
                    new = [pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in raw], pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())]
                kept = [part.column(part.schema.get_field_index(x)) for x in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([len(x) for x in own], pa.int64()), *new, pa.array(agrees, pa.bool_())], names=[*names, "n_tokens", *(("ids", "decoded") if whole else ("ids_sha256", "decoded_sha256")), "agenda_agrees"])

    return run


def encode_decode(docs: DataFrame, path: str, whole: bool = True, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids and decoded text (whole) or their digests, and agenda_agrees.

    Begin and end ids are part of ids, which are the agenda's in any case. agenda_agrees tells
    whether the library gives the same. A null or empty text has those two ids only and
    decodes to an empty text. Repeated rows get equal results; an empty table stays empty.
    Columns of docs with one of the new names are replaced.
    """
    added = [T.StructField("n_tokens", T.LongType())]
    added += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())] if whole else [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    added.append(T.StructField("agenda_agrees", T.BooleanType()))
    docs = docs.drop(*(f.name for f in added))
    return over_batches(docs, _coder(path, text, docs.columns, whole), T.StructType([*docs.schema.fields, *added]))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), whole=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agenda_agrees")
