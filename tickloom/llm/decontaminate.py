"""Passages of test items inside training documents, by suffix arrays of the training shards.

The documents of an Arrow batch are a shard. All suffixes of its words are sorted by
prefix doubling: by their first word, two, four, eight and sixteen words. Every test
suffix is looked up by its first word, two, four and eight words, each a binary search,
and what is left is searched for in the suffix array with all its words. Windows found
side by side join to the longest verbatim matches, whose bytes are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import over_batches, pieces, span_hashes, staged, table, text_bytes, text_or_empty, unused, words_of

WINDOW = 10
#: Bytes of test texts that go to the executors at once; a larger set goes in blocks, one after the other.
BLOCK_BYTES = 16 << 20
#: Bytes of text of a shard, at most, but for longer texts.
SHARD_BYTES = 2 << 20
#: Bytes of matches of earlier blocks up to which they go to every task.
BROADCAST_BYTES = 16 << 20
#: Stands for a null doc_id.
NO_ID = -(2**63)

MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.IntegerType()), T.StructField("doc_word", T.IntegerType()), T.StructField("n_words", T.IntegerType())]))
RUNS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
ITEMS = T.ArrayType(T.StringType())
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("item_ids", ITEMS), T.StructField("matches", MATCH), T.StructField("hit_runs", RUNS)]


class TestItems:
    """Windows of the items of one block, ready for search. Items of equal words are one."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        column = pa.array([x[0] for x in items], pa.string())
        data, offsets = text_bytes(column)
        low, starts, ends, first = words_of(data, offsets)
        raw = low.tobytes()
        own = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids: dict[bytes, set[str]] = {}
        kept = []
        for k, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist(), strict=False)):
            words = b" ".join(own[a:b])
            if words and words not in ids:
                kept.append(k)
            ids.setdefault(words, set()).update(items[k][1])
        hashes = span_hashes(low, starts, ends)
        spans = [(int(first[k]), int(first[k + 1])) for k in kept]
        self.bytes = [own[a:b] for a, b in spans]
        self.ids = [sorted(ids[b" ".join(x)]) for x in self.bytes]
        counts = np.array([b - a for a, b in spans], np.int64)
        length = np.minimum(counts, window)
        n = counts - length + 1
        self.item = np.repeat(np.arange(len(spans)), n)
        self.at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.length = length[self.item]
        position = np.array([a for a, _ in spans], np.int64)[self.item] + self.at
        columns = np.arange(window)[None, :]
        padded = np.concatenate((hashes, np.zeros(window, np.uint64)))
        matrix = np.where(columns < self.length[:, None], padded[position[:, None] + columns], 0) if len(position) else np.zeros((0, window), np.uint64)
        # equal windows are searched once; members lists those that are equal
        if len(matrix):
            self.matrix, of = np.unique(matrix, axis=0, return_inverse=True)
            of = of.ravel()
        else:
            self.matrix, of = matrix, np.zeros(0, np.int64)
        self.members = np.argsort(of, kind="stable")
        self.member_first = np.searchsorted(of[self.members], np.arange(len(self.matrix) + 1))
        self.lengths = (self.matrix != 0).sum(axis=1)


class SuffixArray:
    """All suffixes of the words (hashes) of a shard, each up to its text's end, sorted by 16 words at least."""

    def __init__(self, words: np.ndarray, first: np.ndarray, least: int = 16):
        self.words, n = words, len(words)
        self.end = np.repeat(first[1:], np.diff(first))
        #: For each length 1, 2, 4, ... the sorted keys of what so many words can be.
        self.keys = []
        keys, rank = np.unique(words, return_inverse=True)
        width = 1
        while True:
            self.keys.append(keys)
            if width >= least:
                break
            # past the end of its text a suffix has nothing, which is less than anything
            after = np.zeros(n, np.int64)
            inside = np.flatnonzero(np.arange(n) + width < self.end)
            after[inside] = rank[inside + width] + 1
            keys, rank = np.unique(rank * np.int64(n + 1) + after, return_inverse=True)
            width *= 2
        self.order = np.argsort(rank, kind="stable")
        self.n = n

    def begin(self, tests: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tests whose first one, two, four and eight words, as far as they have them, are in the shard."""

        def known(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return at, keys[at] == wanted

        live = np.arange(len(tests))
        width, level = 1, 0
        numbers, ok = known(self.keys[0], tests)
        live = np.flatnonzero((ok | (np.arange(tests.shape[1])[None, :] >= lengths[:, None])).all(axis=1))
        numbers = numbers[live]
        while 2 * width <= tests.shape[1] and len(live):
            level += 1
            pairs = numbers.shape[1] // 2
            at, ok = known(self.keys[level], numbers[:, 0 : 2 * pairs : 2] * np.int64(self.n + 1) + numbers[:, 1 : 2 * pairs : 2] + 1)
            whole = (np.arange(1, pairs + 1) * 2 * width)[None, :] <= lengths[live][:, None]
            stay = (ok | ~whole).all(axis=1)
            live, numbers = live[stay], at[stay]
            width *= 2
        return live

    def search(self, tests: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each test the range of suffixes in the array that begin with its words."""
        columns = np.arange(tests.shape[1])[None, :]

        def before(at: np.ndarray, live: np.ndarray, equal: bool) -> np.ndarray:
            place = self.order[at]
            spot = place[:, None] + columns
            rows = np.where(spot < self.end[place][:, None], self.words[np.minimum(spot, self.n - 1)], 0)
            # a text's end is less than any word, whose hash may be 0 as well
            ended = spot >= self.end[place][:, None]
            differ = ((rows != tests[live]) | ended) & (columns < lengths[live][:, None])
            first = differ.argmax(axis=1)
            every = np.arange(len(rows))
            return np.where(differ[every, first], ended[every, first] | (rows[every, first] < tests[live][every, first]), equal)

        found = []
        for equal in (False, True):
            low = np.zeros(len(tests), np.int64)
            high = np.full(len(tests), self.n, np.int64)
            while len(live := np.flatnonzero(low < high)):
                mid = (low[live] + high[live]) // 2
                less = before(mid, live, equal)
                low[live] = np.where(less, mid + 1, low[live])
                high[live] = np.where(less, high[live], mid)
            found.append(low)
        return found[0], found[1]


def locate(column, tests: TestItems, window: int):
    """Numbers of words, matches (row, item, item word, document word, words), hit words and first words of the rows of a shard."""
    data, offsets = text_bytes(column)
    low, starts, ends, first = words_of(data, offsets)
    n_words = np.diff(first)
    hit = np.zeros(len(starts) + 1, np.int64)
    none = (n_words, np.zeros((0, 5), np.int64), hit[:0] > 0, first)
    if not len(starts) or not len(tests.matrix):
        return none
    array = SuffixArray(span_hashes(low, starts, ends), first)
    live = array.begin(tests.matrix, tests.lengths)
    lower, upper = array.search(tests.matrix[live], tests.lengths[live])
    counts = upper - lower
    if not counts.sum():
        return none
    which = live[np.repeat(np.arange(len(counts)), counts)]
    places = array.order[np.repeat(lower - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
    # each place with all items that have this window
    many = tests.member_first[which + 1] - tests.member_first[which]
    member = tests.members[np.repeat(tests.member_first[which] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
    place = np.repeat(places, many)
    item, word, length = tests.item[member], tests.at[member], tests.length[member]
    # windows next to each other on a diagonal are one match
    order = np.lexsort((place, place - word, item))
    place, item, word, length = place[order], item[order], word[order], length[order]
    row = np.searchsorted(first, place, side="right") - 1
    new = np.ones(len(place), bool)
    new[1:] = (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) | (word[1:] != word[:-1] + 1) | (row[1:] != row[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(place)) - 1
    span = place[tails] + length[tails] - place[heads]
    good = []
    for k, (i, w, p, n) in enumerate(zip(item[heads].tolist(), word[heads].tolist(), place[heads].tolist(), span.tolist(), strict=True)):
        if all(low[s:e].tobytes() == x for s, e, x in zip(starts[p : p + n].tolist(), ends[p : p + n].tolist(), tests.bytes[i][w : w + n], strict=True)):
            good.append(k)
    heads, span = heads[good], span[good]
    matches = np.stack((row[heads], item[heads], word[heads], place[heads] - first[row[heads]], span), axis=1)
    np.add.at(hit, place[heads], 1)
    np.add.at(hit, place[heads] + span, -1)
    return n_words, matches, np.cumsum(hit)[:-1] > 0, first


def _searcher(names: list[str], text: str, shared, window: int, earlier: list[str]):
    """names: columns that stay; earlier: those with item_ids, matches and hit_runs of other blocks, if any."""

    def run(batches):
        tests = TestItems(shared.value, window)
        for batch in batches:
            for part in pieces(batch, text, SHARD_BYTES):
                column = lambda x, part=part: part.column(part.schema.get_field_index(x))
                n_words, matches, hit, first = locate(column(text), tests, window)
                rows = len(part)
                found: list[list] = [[] for _ in range(rows)]
                ids: list[set] = [set() for _ in range(rows)]
                runs: list[list] = [[] for _ in range(rows)]
                for r, i, w, p, n in matches.tolist():
                    found[r].append({"item_id": tests.ids[i][0], "item_word": w, "doc_word": p, "n_words": n})
                    ids[r].update(tests.ids[i])
                for r in np.unique(matches[:, 0]).tolist():
                    inside = np.concatenate(([False], hit[first[r] : first[r + 1]], [False]))
                    step = np.flatnonzero(inside[1:] != inside[:-1]).tolist()
                    runs[r] = [{"first": a, "last": b - 1} for a, b in zip(step[::2], step[1::2], strict=True)]
                if earlier:
                    was = [[x or [] for x in column(c).to_pylist()] for c in earlier]
                    ids = [a | {x for y in b for x in y} for a, b in zip(ids, was[0], strict=True)]
                    found = [[x for y in b for x in y] + a for a, b in zip(found, was[1], strict=True)]
                    runs = [joined([x for y in b for x in y] + a) for a, b in zip(runs, was[2], strict=True)]
                new = [pa.array(n_words, pa.int64()), pa.array([sorted(x) for x in ids], pa.list_(pa.string())), pa.array(found, _arrow(MATCH)), pa.array(runs, _arrow(RUNS))]
                yield pa.RecordBatch.from_arrays([*(column(x) for x in names), *new], names=[*names, *(f.name for f in FOUND)])

    return run


def _arrow(kind: T.ArrayType) -> pa.DataType:
    return pa.list_(pa.struct([(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int32()) for f in kind.elementType.fields]))


def joined(runs: list[dict]) -> list[dict]:
    """Runs that overlap or touch, as one."""
    out: list[dict] = []
    for r in sorted(runs, key=lambda x: x["first"]):
        if out and r["first"] <= out[-1]["last"] + 1:
            out[-1] = {"first": out[-1]["first"], "last": max(out[-1]["last"], r["last"])}
        else:
            out.append(dict(r))
    return out


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, item_ids, matches and hit_runs.

    Words: runs of digits, a-z (A-Z lower-cased) and characters from U+0080 on. A window
    is `window` words in a row of an item; an item of fewer words is one window. item_ids:
    items with a window in the text, as text, sorted. matches: longest verbatim matches
    made of windows (item_id, of items of equal words the first one; first word in item and
    document; words). hit_runs: document words inside any window. Null or empty texts, on
    either side, have no words; a null item_id is an item with an empty id; repeated rows
    count each; an empty table on either side gives no matches. Columns of docs with one of
    the new names are replaced. Items go to the tasks in blocks of block_bytes; the driver
    holds one block at a time.
    """
    spark = docs.sparkSession
    texts = benchmark.groupBy(F.coalesce("text", F.lit("")).alias("t")).agg(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("i"))
    sizes = benchmark.select("text").distinct().agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    blocks = max(1, -(-int(sizes) // block_bytes))
    docs = docs.drop(*(f.name for f in FOUND))

    def block(k: int):
        some = texts.filter(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k) if blocks > 1 else texts
        return spark.sparkContext.broadcast([(r.t, r.i) for r in some.collect()])

    i, b, id_, body_, *was = unused(docs, "_i", "_b", "_id", "_body", "_items", "_matches", "_runs")
    earlier: list[DataFrame] = []
    keyed = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), b: F.xxhash64(text_or_empty())}) if blocks > 1 else docs
    for k in range(blocks - 1):  # none, unless the test set is larger than block_bytes
        shared = block(k)
        own = keyed.select(F.col(i).alias(id_), F.col(b).alias(body_), "text")
        schema = T.StructType([*own.schema.fields[:2], *FOUND])
        hits = over_batches(own, _searcher([id_, body_], "text", shared, window, []), schema)
        earlier.append(staged(hits.filter(F.size("hit_runs") > 0).dropDuplicates([id_, body_]), "passages"))
        shared.destroy()
    names = docs.columns
    if earlier:
        hits = earlier[0]
        for more in earlier[1:]:
            hits = hits.unionByName(more)
        hits = staged(hits.groupBy(id_, body_).agg(*(F.collect_list(f.name).alias(x) for f, x in zip(FOUND[1:], was, strict=True))), "passages")
        size = hits.agg(F.sum(64 + 32 * F.aggregate(was[1], F.lit(0), lambda a, x: a + F.size(x)))).first()[0] or 0
        docs = keyed.join(F.broadcast(hits) if size <= BROADCAST_BYTES else hits, (F.col(i) == F.col(id_)) & (F.col(b) == F.col(body_)), "left").select(*names, *was)
    schema = T.StructType([*(docs.schema[x] for x in names), *FOUND])
    return over_batches(docs, _searcher(names, "text", block(blocks - 1), window, was if earlier else []), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those that hold a window of any item; as find_passages in all else."""
    names = unused(docs, *("_" + f.name for f in FOUND))
    own = docs.withColumnsRenamed({f.name: n for f, n in zip(FOUND, names, strict=True)})
    found = find_passages(own, benchmark, window).filter(F.size("hit_runs") == 0)
    return found.drop(*(f.name for f in FOUND)).withColumnsRenamed({n: f.name for f, n in zip(FOUND, names, strict=True)}).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_runs", F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1).cast("long")
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), longest.cast("long").alias("longest"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT item_id, words, least(10, len(words)) AS k, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS p FROM b WHERE len(words) > 0),
t AS (SELECT DISTINCT item_id, k, array_to_string(words[p:p + k - 1], ' ') AS win FROM bw),
ks AS (SELECT DISTINCT k FROM t),
dw AS (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS p FROM w, ks WHERE len(words) >= k),
o AS (SELECT doc_id, t.item_id, p, dw.k FROM (SELECT doc_id, k, p, array_to_string(words[p:p + k - 1], ' ') AS win FROM dw) dw JOIN t ON t.k = dw.k AND t.win = dw.win),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS q FROM o) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM o) GROUP BY doc_id),
-- the longest run of windows that follow one another in an item and a document
g AS (SELECT DISTINCT o.doc_id, bw.item_id, o.p - bw.p AS diagonal, o.p, o.k FROM o JOIN bw ON bw.item_id = o.item_id AND bw.k = o.k JOIN w ON w.doc_id = o.doc_id WHERE array_to_string(bw.words[bw.p:bw.p + bw.k - 1], ' ') = array_to_string(w.words[o.p:o.p + o.k - 1], ' ')),
r AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p) AS island FROM g),
m AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, max(p) - min(p) + max(k) AS n FROM r GROUP BY doc_id, item_id, diagonal, island) GROUP BY doc_id)
SELECT w.doc_id, len(w.words) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated, coalesce(m.longest, 0) AS longest
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN m USING (doc_id)
"""
