"""Repeated byte strings, by suffix sorting with hash comparisons.

A byte goes if some string of `length` bytes that covers it also starts earlier. Strings
are not listed one by one. In each string the smallest hash of SEED bytes is its anchor,
so equal strings have equal anchors at equal places, and neighbouring strings share one:
they make a block. Blocks equal as a whole, by a cryptographic digest of their bytes, are
settled by one sort. Of anchors whose blocks differ, the suffixes are sorted: two are
compared through prefix polynomial hashes and a binary search for their common extension,
which is then checked byte by byte; the extensions of neighbours in this order, with what
lies before the anchor, tell which single strings are equal, and their bytes are compared.
"""

from __future__ import annotations

import hashlib
from functools import cmp_to_key
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BASE, _INVERSE, _kept_powers, mixed, over_batches, pieces, staged, table, text_bytes, unused

LENGTH, SEED = 100, 32
#: Bytes of a text that are looked at in one go; a longer text goes in parts that share length - 1 bytes.
PART_BYTES = 2 << 20
#: Blocks resolved at once, and blocks of one anchor beyond which its strings are dealt out one by one.
AT_ONCE, CROWD = 4_000, 40_000
#: Stands for a null doc_id.
NO_ID = -(2**63)

_U64 = (1 << 64) - 1


def blocks_of(data: np.ndarray, offsets: np.ndarray, length: int, seed: int):
    """Anchors' hashes, rows, and starts, anchors and ends of blocks."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none, none, none
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _kept_powers(_BASE, n), out=prefix[1:])
    inverse = _kept_powers(_INVERSE, n + 1)
    grams = mixed((prefix[seed:] - prefix[:-seed]) * inverse[: n + 1 - seed])
    least = (grams & np.uint64(_U64 ^ 0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    width, have = length - seed + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if width > have:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # strings that lie in one text
    long = np.flatnonzero(np.diff(offsets) >= length)
    step = np.zeros(len(anchor) + 1, np.int32)
    np.add.at(step, offsets[:-1][long], 1)
    np.add.at(step, offsets[1:][long] - length + 1, -1)
    valid = np.cumsum(step[:-1]) > 0
    first = valid.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first[offsets[:-1][long]] = True
    last = valid.copy()
    last[:-1] &= first[1:] | ~valid[1:]
    start, end, at = np.flatnonzero(first), np.flatnonzero(last) + length, anchor[first]
    return grams[at], np.searchsorted(offsets, start, side="right") - 1, start, at, end


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(spans, 2): 128 bits of BLAKE2b of the bytes of each span."""
    raw = memoryview(data.tobytes())
    return np.frombuffer(b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), np.uint64).reshape(-1, 2)


_FOUND = T.StructType([T.StructField(x, T.LongType()) for x in ("anchor", "block", "block2", "id", "key")] + [T.StructField(x, T.IntegerType()) for x in ("start", "left", "size")] + [T.StructField("gone", T.BooleanType())])


def _find(length: int, seed: int, part_bytes: int = PART_BYTES):
    """Blocks of each text; gone: an earlier text of the same slice has the same block."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1_000_000):
                ids, keys = part.column(0).to_numpy(), part.column(1).to_numpy()
                data, offsets = text_bytes(part.column(2))
                if len(data) <= part_bytes:
                    yield found(ids, keys, data, offsets, 0)
                    continue
                for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
                    for c in range(a, max(b - length + 1, a + 1), part_bytes):
                        d = min(c + part_bytes + length - 1, b)
                        yield found(ids[i : i + 1], keys[i : i + 1], data[c:d], np.array([0, d - c]), c - a)

    def found(ids: np.ndarray, keys: np.ndarray, data: np.ndarray, offsets: np.ndarray, base: int) -> pa.RecordBatch:
        anchor, row, start, at, end = blocks_of(data, offsets, length, seed)
        block = digests(data, start, end)
        order = np.lexsort((start, keys[row], ids[row]))
        _, first, which = np.unique(block[order, 0], return_index=True, return_inverse=True)
        gone = np.ones(len(order), bool)
        gone[order[first]] = False
        gone[order] &= block[order, 1] == block[order[first], 1][which]  # the first of equal halves need not be equal
        # those are settled: they only travel, so they travel anywhere
        anchor = np.where(gone, mixed(anchor + start.astype(np.uint64)), anchor)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(anchor.view(np.int64)),
                pa.array(block[:, 0].view(np.int64)),
                pa.array(block[:, 1].view(np.int64)),
                pa.array(ids[row]),
                pa.array(keys[row]),
                pa.array((start - offsets[row] + base).astype(np.int32)),
                pa.array((at - start).astype(np.int32)),
                pa.array((end - start).astype(np.int32)),
                pa.array(gone),
            ],
            names=_FOUND.names,
        )

    return run


def _settle(batches):
    """Of blocks sorted by anchor, block and place: all but the first of equal ones are gone; a block alone with its anchor is dropped."""
    held = None  # the last first block, whose follower is not yet known
    last = (None, None, None)
    joined = False  # whether held has the anchor of an earlier first block
    for batch in batches:
        t = pa.Table.from_batches([batch])
        settled = t.filter(t.column("gone"))
        t = t.filter(pa.compute.invert(t.column("gone")))
        if settled.num_rows:
            yield from settled.to_batches()
        if not t.num_rows:
            continue
        a, b, c = (t.column(x).to_numpy() for x in ("anchor", "block", "block2"))
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
        new[0] = (a[0], b[0], c[0]) != last
        last = (a[-1], b[-1], c[-1])
        repeats = t.filter(pa.array(~new))
        if repeats.num_rows:
            yield from repeats.set_column(8, "gone", pa.array(np.ones(repeats.num_rows, bool))).to_batches()
        firsts = t.filter(pa.array(new))
        if held is not None:
            firsts = pa.concat_tables([held, firsts])
        if not firsts.num_rows:
            continue
        a = firsts.column("anchor").to_numpy()
        same = a[1:] == a[:-1]
        mixed_up = np.concatenate(([joined], same))
        mixed_up[:-1] |= same
        some = firsts.slice(0, len(a) - 1).filter(pa.array(mixed_up[:-1]))
        if some.num_rows:
            yield from some.to_batches()
        held, joined = firsts.slice(len(a) - 1), bool(mixed_up[-1])
    if held is not None and joined:
        yield from held.combine_chunks().to_batches()


_BYTES = T.StructType([T.StructField(x, T.LongType()) for x in ("anchor", "id", "key")] + [T.StructField(x, T.IntegerType()) for x in ("start", "left")] + [T.StructField("bytes", T.BinaryType())])


def _fetch(batches):
    """The bytes of the listed blocks of each text."""
    for batch in batches:
        for part in pieces(batch, "text", 1_000_000):
            name = part.schema.get_field_index
            data, offsets = text_bytes(part.column(name("text")))
            lists = part.column(name("blocks"))
            n = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(part)), n)
            flat = lists.flatten()
            anchor, start, left, size = (flat.field(k).to_numpy() for k in range(4))
            ids, keys = part.column(name("id")).to_numpy(), part.column(name("key")).to_numpy()
            raw = data.tobytes()
            at = (offsets[row] + start).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ids[row]), pa.array(keys[row]), pa.array(start), pa.array(left), pa.array([raw[x : x + s] for x, s in zip(at, size.tolist(), strict=True)], pa.binary())], names=_BYTES.names)


class SuffixOrder:
    """Lexicographic order of suffixes of one byte string, by prefix polynomial hashes."""

    def __init__(self, data: np.ndarray):
        self.raw = data.tobytes()
        hashes = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _kept_powers(_BASE, len(data)), out=hashes[1:])
        self.prefix = hashes
        self.sums = hashes.tolist()
        self.powers = _kept_powers(_BASE, len(data) + 1)

    def equal(self, i: int, j: int, n: int) -> bool:
        """Whether n bytes from i and from j on have equal hashes (i <= j)."""
        s = self.sums
        return ((s[i + n] - s[i]) * int(self.powers[j - i]) - (s[j + n] - s[j])) & _U64 == 0

    def extension(self, i: int, j: int, most: int) -> int:
        """Length of the common prefix of the suffixes at i and j, `most` at most: binary search, then a check of the bytes."""
        if i > j:
            i, j = j, i
        low, high = 0, most
        power = int(self.powers[j - i])
        s = self.sums
        while low < high:
            mid = (low + high + 1) // 2
            if ((s[i + mid] - s[i]) * power - (s[j + mid] - s[j])) & _U64:
                high = mid - 1
            else:
                low = mid
        while self.raw[i : i + low] != self.raw[j : j + low]:  # a collision
            low = next(k for k in range(low) if self.raw[i + k] != self.raw[j + k])
        return low

    def sorted(self, places: list[int], ends: dict[int, int]) -> list[int]:
        """places in the order of their suffixes, each cut at its end: a merge sort with logarithmic comparisons."""
        raw = self.raw

        def compare(i: int, j: int) -> int:
            a, b = ends[i] - i, ends[j] - j
            n = self.extension(i, j, min(a, b))
            return a - b if n == min(a, b) else raw[i + n] - raw[j + n]

        return sorted(places, key=cmp_to_key(compare))


def resolve(anchors: np.ndarray, data: np.ndarray, offsets: np.ndarray, left: np.ndarray, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings that an equal string precedes: (block numbers, first bytes within the block).

    anchors is sorted; rank orders the places of the blocks.
    """
    n = len(anchors)
    at, end = offsets[:-1] + left, offsets[1:]
    order = SuffixOrder(data)
    place, ends = at.tolist(), dict(zip(at.tolist(), end.tolist(), strict=True))
    number = {p: k for k, p in enumerate(place)}
    cuts = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1], [True]))).tolist()
    line: list[int] = []
    common = np.zeros(n, np.int64)
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a == 1:
            line.append(a)
            continue
        group = order.sorted(place[a:b], ends)
        for k, (x, y) in enumerate(zip(group, group[1:], strict=False)):
            common[a + k + 1] = order.extension(x, y, min(ends[x] - x, ends[y] - y))
        line += [number[x] for x in group]
    line_of = np.array(line)
    spot, rank_of, left_of, right_of = at[line_of], rank[line_of], left[line_of], (end - at)[line_of]
    inverse = _kept_powers(_INVERSE, len(data) + 1)
    rows, firsts = [], []
    for before in range(int(left.max()) + 1 if n else 0):  # bytes of the string before the anchor
        has = np.flatnonzero((left_of >= before) & (right_of >= length - before))
        if not len(has):
            continue
        interval = np.cumsum(common < length - before)[has]
        p = spot[has]
        ahead = (order.prefix[p] - order.prefix[p - before]) * inverse[p - before]
        by_place = np.argsort(rank_of[has], kind="stable")
        key = (mixed(ahead) + mixed(interval.astype(np.uint64)) * np.uint64(0xE7037ED1A0B428DB))[by_place]
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        again = np.ones(len(has), bool)
        again[by_place[first]] = False
        # what comes after the anchor is checked; now what lies before it
        of, later = by_place[first][which], by_place
        if not same_bytes(data, p[later] - before, p[of] - before, before) or (interval[later] != interval[of]).any():
            seen: set = set()  # a collision: by the bytes themselves
            for k in by_place.tolist():
                x = (int(interval[k]), order.raw[p[k] - before : p[k]])
                again[k] = x in seen
                seen.add(x)
        rows.append(line_of[has[again]])
        firsts.append(left_of[has[again]] - before)
    return (np.concatenate(rows), np.concatenate(firsts)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def same_bytes(data: np.ndarray, one: np.ndarray, two: np.ndarray, n: int, at_once: int = 1 << 22) -> bool:
    """Whether the n bytes from each place of one are those from its place of two."""
    apart = np.flatnonzero(one != two)
    if not n or not len(apart):
        return True
    columns = np.arange(n)[None, :]
    rows = max(1, at_once // n)
    return all((data[one[w][:, None] + columns] == data[two[w][:, None] + columns]).all() for k in range(0, len(apart), rows) for w in [apart[k : k + rows]])


_OUT = T.StructType([T.StructField(x, T.LongType()) for x in ("id", "key")] + [T.StructField(x, T.IntegerType()) for x in ("first", "last")] + [T.StructField(x, T.LongType()) for x in ("h", "g")])


def _resolve(length: int, at_once: int, crowd: int):
    """Removed runs (first, last) of blocks sorted by anchor; the strings of a crowded anchor go out one by one with their hashes."""

    def runs(t: pa.Table) -> pa.RecordBatch:
        ids, keys, start, left = (t.column(x).to_numpy() for x in ("id", "key", "start", "left"))
        raw = t.column("bytes").combine_chunks()
        data, offsets = text_bytes(raw)
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((start, keys, ids))] = np.arange(len(ids))
        row, first = resolve(t.column("anchor").to_numpy(), data, offsets, left.astype(np.int64), length, rank)
        order = np.lexsort((first, row))
        row, first = row[order], first[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (first[1:] != first[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(row)) - 1 if len(row) else head
        r = row[head]
        a, b = start[r] + first[head], start[r] + first[tail] + length - 1
        none = pa.nulls(len(r), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(keys[r]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), none, none], names=_OUT.names)

    def singles(t: pa.Table) -> pa.RecordBatch:
        ids, keys, start = (t.column(x).to_numpy() for x in ("id", "key", "start"))
        data, offsets = text_bytes(t.column("bytes").combine_chunks())
        n = np.diff(offsets) - length + 1
        row = np.repeat(np.arange(len(ids)), n)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        s = offsets[row] + inside
        h, g = np.ascontiguousarray(digests(data, s, s + length).T)
        a = (start[row] + inside).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(keys[row]), pa.array(a), pa.array(a + np.int32(length - 1)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64))], names=_OUT.names)

    def run(batches):
        held: list[pa.Table] = []
        rows, crowded = 0, None
        for batch in batches:
            for k in range(0, len(batch), at_once):
                t = pa.Table.from_batches([batch.slice(k, at_once)])
                if crowded is not None:
                    own = pa.compute.equal(t.column("anchor"), crowded)
                    mine = t.filter(own)
                    for j in range(0, mine.num_rows, 2_000):
                        yield singles(mine.slice(j, 2_000))
                    t = t.filter(pa.compute.invert(own))
                    if not t.num_rows:
                        continue
                    crowded = None
                held.append(t)
                rows += t.num_rows
                if rows < at_once:
                    continue
                whole = pa.concat_tables(held).combine_chunks()
                anchors = whole.column("anchor").to_numpy()
                cut = int(np.searchsorted(anchors, anchors[-1]))  # the last anchor may go on
                if cut:
                    yield runs(whole.slice(0, cut))
                rest = whole.slice(cut)
                if rest.num_rows > crowd:
                    crowded = anchors[-1].item()
                    for j in range(0, rest.num_rows, 2_000):
                        yield singles(rest.slice(j, 2_000))
                    rest = rest.slice(0, 0)
                held, rows = ([rest], rest.num_rows) if rest.num_rows else ([], 0)
                if rows >= at_once:  # wait for as many again, not for each next batch
                    rows = 0
        if held and (whole := pa.concat_tables(held).combine_chunks()).num_rows:
            yield runs(whole)

    return run


def _apply(names: list[str], whole: bool, spans_of: str):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1_000_000):
                name = part.schema.get_field_index
                data, offsets = text_bytes(part.column(name("text")))
                raw = memoryview(data.tobytes())
                lists = part.column(name(spans_of))
                size, removed, spans, kept = [], [], [], []
                for i in range(len(part)):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    found = lists[i]
                    out: list[list[int]] = []
                    if found.is_valid:
                        first, last = found.values.field(0).to_numpy(), found.values.field(1).to_numpy()
                        order = np.argsort(first, kind="stable")
                        first, last = first[order], np.maximum.accumulate(last[order])
                        new = np.concatenate(([True], first[1:] > last[:-1] + 1))
                        head = np.flatnonzero(new)
                        out = np.stack((first[head], last[np.append(head[1:], len(first)) - 1]), axis=1).tolist()
                    at, left = a, []
                    for f, e in out:
                        left.append(raw[at : a + f])
                        at = a + e + 1
                    left.append(raw[at:b])
                    size.append(b - a)
                    removed.append(sum(e - f + 1 for f, e in out))
                    spans.append([{"first": f, "last": e} for f, e in out] if whole else len(out))
                    if whole:
                        kept.append(b"".join(left))
                    else:
                        digest = hashlib.sha256()
                        for x in left:
                            digest.update(x)
                        kept.append(digest.hexdigest())
                own = [part.column(name(x)) for x in names]
                kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])) if whole else pa.int64()
                yield pa.RecordBatch.from_arrays([*own, pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary() if whole else pa.string())], names=[*names, "n_bytes", "n_removed", *(("spans", "kept") if whole else ("n_spans", "kept_sha256"))])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, whole: bool = True, seed: int = SEED, at_once: int = AT_ONCE, crowd: int = CROWD, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs with n_bytes, n_removed and, if whole, spans and kept bytes, else n_spans and kept_sha256.

    A byte of a text is removed if it is in a string of `length` bytes that also starts
    earlier: in a document of smaller doc_id, or earlier in the same document. Strings lie
    within one text and are judged on the texts as they are given. kept may end inside a
    character, so it is binary. A null text is empty; a null doc_id is the least; equal
    rows are one document and get equal results; rows that share a doc_id with different
    texts are documents of their own, in the order of a hash. An empty table stays empty.
    Columns of docs with one of the new names are replaced.
    """
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType())]
    span = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
    added += [T.StructField("spans", span), T.StructField("kept", T.BinaryType())] if whole else [T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    docs = docs.drop(*(f.name for f in added))
    i, k, id_, key_, gone_ = unused(docs, "_i", "_k", "_id", "_key", "_gone")
    id_of = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    # rows that share a doc_id are told apart by a hash of the text; where none do, that is 0 and takes no room
    shared = not docs.groupBy(id_of).count().filter("count > 1").isEmpty()
    keyed = docs.withColumns({i: id_of, k: F.xxhash64(F.coalesce("text", F.lit(""))) if shared else F.lit(0).cast("long")})
    own = keyed.select(F.col(i).alias("id"), F.col(k).alias("key"), "text")
    if shared:
        own = own.dropDuplicates(["id", "key"])  # equal rows: one stands for all
    found = over_batches(own, _find(length, seed, part_bytes), _FOUND)
    ordered = found.repartition("anchor").sortWithinPartitions("anchor", "block", "block2", "id", "key", "start")
    settled = staged(over_batches(ordered, _settle, _FOUND), "blocks")
    gone = settled.filter("gone").select("id", "key", F.col("start").alias("first"), (F.col("start") + F.col("size") - 1).alias("last"))

    listed = settled.filter(~F.col("gone")).groupBy("id", "key").agg(F.collect_list(F.struct("anchor", "start", "left", "size")).alias("blocks"))
    texts = over_batches(own.join(listed.hint("shuffle_hash"), ["id", "key"]), _fetch, _BYTES)
    by_anchor = texts.repartition("anchor").sortWithinPartitions("anchor", "id", "key", "start")
    resolved = staged(over_batches(by_anchor, _resolve(length, at_once, crowd), _OUT), "runs")
    gone = gone.union(resolved.filter(F.col("h").isNull()).select("id", "key", "first", "last"))
    single = resolved.filter(F.col("h").isNotNull())
    if not single.isEmpty():
        least = single.groupBy("h", "g").agg(F.min(F.struct("id", "key", "first")).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "g", "least")
        later = single.join(least, ["h", "g"]).filter(F.struct("id", "key", "first") != F.col("least"))
        gone = gone.union(later.select("id", "key", "first", "last"))

    lists = gone.groupBy("id", "key").agg(F.collect_list(F.struct("first", "last")).alias(gone_)).withColumnsRenamed({"id": id_, "key": key_})
    joined = keyed.join(lists.hint("shuffle_hash"), (F.col(i) == F.col(id_)) & (F.col(k) == F.col(key_)), "left")
    return over_batches(joined.select(*docs.columns, gone_), _apply(docs.columns, whole, gone_), T.StructType([*docs.schema.fields, *added]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), whole=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT doc_id, s, md5_number(substr(x, 2 * s + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS s FROM d WHERE length(x) >= 200)),
f AS MATERIALIZED (SELECT h, min((doc_id, s)) AS least FROM w GROUP BY h HAVING count(*) > 1),
g AS MATERIALIZED (SELECT doc_id, s FROM w JOIN f USING (h) WHERE (doc_id, s) <> least),
o AS MATERIALIZED (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS q FROM g),
r AS (SELECT doc_id, sum(least(100, coalesce(q - s, 100))) AS n_removed, count(*) FILTER (WHERE p IS NULL OR s > p + 100) AS n_spans FROM o GROUP BY doc_id),
a AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS k FROM o WHERE p IS NULL OR s > p + 100),
z AS (SELECT doc_id, s + 100 AS e, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS k FROM o WHERE q IS NULL OR q > s + 100),
-- what stays lies before each run, and after the last one
k AS (SELECT a.doc_id, a.k, coalesce(y.e, 0) AS first, a.s AS last FROM a LEFT JOIN z y ON y.doc_id = a.doc_id AND y.k = a.k - 1
      UNION ALL SELECT doc_id, max(k) + 1, max(e), 1000000000 FROM z GROUP BY doc_id),
t AS (SELECT k.doc_id, string_agg(substr(x, 2 * first + 1, 2 * (last - first)), '' ORDER BY k) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT d.doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN t USING (doc_id)
"""
