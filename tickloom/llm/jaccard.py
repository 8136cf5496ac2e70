"""Documents whose sets of word shingles are alike: MinHash LSH forest, then exact counts.

Each document has a signature of min-hashes and a label of eight of them in each trie.
Labels are sorted, so that a node of a trie, all documents with one prefix, is a run of
rows, and its size at each depth is known. A document starts with its longest prefixes
and shortens them, those whose next node is small first, until pairs at the threshold
meet it in some trie with the target recall: in crowded nodes it stays deep. Inside a
node, signatures are compared, and documents that may be alike are joined by a few edges,
never by all pairs. In each connected group all pairs of shingle sets are then counted
exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mixed, over_batches, pieces, span_hashes, staged, table, text_bytes, text_or_empty, trimmed, unused, words_of
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Min-hashes of a signature, tries, and min-hashes of the longest prefix.
HASHES, TREES, DEPTH = 128, 32, 8
#: Share of pairs at the threshold that must meet in some trie.
RECALL = 0.999999
#: Rounds of shortening: in round k a prefix goes on while the next node has no more than 2**k documents; the last has no such limit.
ROUNDS = 24
#: Bytes of the keys of dropped rows up to which they go to every task, so that no text moves.
BROADCAST_BYTES = 16 << 20
#: Documents, or shingles, of a group that one task counts; larger groups are dealt as pairs of blocks.
#: A group of n documents has the square root of n blocks at most, so that copies of rows stay in bounds.
BLOCK_DOCS, BLOCK_SHINGLES = 250, 1_000_000
#: Signatures of a trie node that one task compares; larger nodes are dealt in the same way.
NODE_DOCS = 5_000
#: Stands for a null doc_id.
NO_ID = -(2**63)


def shortest_prefix(similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """One less than the longest prefix that reaches the recall if all tries use it, so that some tries may stay deeper."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return max(depth - 1, 1)


def forest(one: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH, rounds: int = ROUNDS) -> DataFrame:
    """(cid, node, depth, own, c): the nodes of the tries in which documents (cid, sig) meet others, c documents in each.

    own is the depth to which the document has shortened its prefix in this trie, depth
    that of the node: the least of all that share it, since a document is found by all
    that come up to it. A document that is alone in a trie has come to its shortest
    prefix there.
    """
    least = shortest_prefix(similarity, recall, trees, depth)
    width = 2 * HASHES // trees  # bytes of a trie's own min-hashes; deeper levels take those of the next trie
    labels = []
    for t in range(trees):
        label = F.concat(F.substring("sig", width * t + 1, width), F.substring("sig", width * ((t + 1) % trees) + 1, max(2 * depth - width, 0)))
        labels.append(F.struct(F.xxhash64(F.lit(t), F.substring(label, 1, 2 * least)).alias("root"), F.substring(label, 2 * least + 1, 2 * (depth - least)).alias("rest")))
    rows = one.select("cid", F.explode(F.array(*labels)).alias("x")).select("cid", "x.root", "x.rest").repartition("root")
    levels = list(range(least, depth + 1))
    letters = [f"l{d}" for d in levels[1:]]
    path = lambda d: ["root", *letters[: d - least]]
    rows = rows.withColumn(f"c{least}", F.count(F.lit(1)).over(Window.partitionBy("root"))).filter(F.col(f"c{least}") > 1)
    rows = rows.select("cid", "root", f"c{least}", *(F.substring("rest", 2 * k + 1, 2).alias(x) for k, x in enumerate(letters)))
    # the tries in their order: each node is a run of rows, and the nodes below lie inside it
    rows = rows.sortWithinPartitions("root", *letters)
    for d in levels[1:]:
        rows = rows.withColumn(f"c{d}", F.count(F.lit(1)).over(Window.partitionBy(*path(d))))
    rows = staged(rows, "tries")

    missed = {d: math.log1p(-(similarity**d)) for d in levels}

    def shortened(limit: Column | None, value) -> Column:
        out = F.lit(value(depth))
        for d in reversed(levels[:-1]):
            out = F.lit(value(d)) if limit is None else F.when(F.col(f"c{d}") <= limit, F.lit(value(d))).otherwise(out)
        return out

    limits = [F.lit(1 << k) for k in range(1, rounds)]
    alone = (trees - F.count(F.lit(1))) * F.lit(missed[least])
    sums = rows.groupBy("cid").agg(*((F.sum(shortened(x, missed.__getitem__)) + alone).alias(f"s{k}") for k, x in enumerate(limits)))
    enough = F.lit(math.log1p(-recall))
    chosen = F.coalesce(*(F.when(F.col(f"s{k}") <= enough, x.cast("long")) for k, x in enumerate(limits)), F.lit(2**62))
    rows = rows.join(sums.select("cid", chosen.alias("limit")), "cid").withColumn("own", shortened(F.col("limit"), int))
    # a node is in use if a document has come up to it; a document meets others in the highest such node above it
    rows = rows.repartition("root").sortWithinPartitions("root", *letters)
    used = [F.max(F.col("own") == d).over(Window.partitionBy(*path(d))) for d in levels]
    rows = rows.withColumns({f"u{d}": u for d, u in zip(levels, used, strict=True)})
    at = lambda value: F.coalesce(*(F.when(F.col(f"u{d}"), value(d)) for d in levels))
    met = rows.select("cid", at(lambda d: F.xxhash64(F.lit(d), *path(d))).alias("node"), at(F.lit).alias("depth"), "own", at(lambda d: F.col(f"c{d}")).alias("c"))
    return met.filter("c > 1")


def least_estimate(similarity: float = SIMILARITY, hashes: int = HASHES) -> int:
    """Equal min-hashes that a pair at the threshold has but for a chance of about one in ten million."""
    return int(hashes * similarity - 5.2 * (hashes * similarity * (1 - similarity)) ** 0.5)


def shingles_of(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, the n + 1 offsets of the rows, numbers of words, and two hashes of each row's words.

    A row of fewer words, but not none, has one shingle of them all.
    """
    low, starts, ends, first = words_of(data, offsets)
    words = span_hashes(low, starts, ends)
    n_words = np.diff(first)
    one, two = span_hashes(words, first[:-1], first[1:]), span_hashes(words, first[:-1], first[1:], second=True)
    n = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    cuts = np.concatenate(([0], np.cumsum(n)))
    rolled = np.zeros(len(words), np.uint64)
    follow = np.concatenate((words, np.zeros(k, np.uint64)))
    for j in range(k):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + follow[j : j + len(words)]
    at = np.repeat(first[:-1] - cuts[:-1], n) + np.arange(cuts[-1])
    out = mixed(rolled[at]) if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    out[cuts[short]] = mixed(one[short])
    return out, cuts, n_words, one, two


def _multipliers(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def signatures(shingles: np.ndarray, cuts: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """(rows, hashes) of 16 bits each; rows without shingles are zero."""
    out = np.zeros((len(cuts) - 1, hashes), np.uint16)
    has = np.flatnonzero(cuts[1:] > cuts[:-1])
    if not len(has):
        return out
    where = cuts[:-1][has]
    for k, m in enumerate(_multipliers(hashes)):
        low = np.minimum.reduceat((shingles * m) >> np.uint64(20), where)
        out[has, k] = mixed(low).astype(np.uint16)
    return out


def _sign(k: int):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1_000_000):
                data, offsets = text_bytes(part.column(1))
                shingles, cuts, n_words, one, two = shingles_of(data, offsets, k)
                sig = signatures(shingles, cuts)
                raw = sig.tobytes()
                wide = 2 * HASHES
                # of texts without words only equal ones are alike
                bare = span_hashes(data, offsets[:-1], offsets[1:])
                key = np.where(n_words > 0, one, bare).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array(key, pa.int64()),
                        pa.array(np.where(n_words > 0, two, ~bare).view(np.int64), pa.int64()),
                        pa.array(np.diff(offsets) == 0, pa.bool_()),
                        pa.array(np.diff(cuts), pa.int64()),
                        pa.array([raw[i * wide : (i + 1) * wide] if c else None for i, c in enumerate(n_words.tolist())], pa.binary()),
                    ],
                    names=["id", "body", "key", "key2", "bare", "n", "sig"],
                )

    return run


def _bucket(least: int):
    """Edges of a spanning forest over the signatures of one trie node that agree in `least` places."""

    def run(table):
        ids = table.column("cid").to_numpy()
        ids, at = np.unique(ids, return_index=True)
        sig = np.frombuffer(b"".join(table.column("sig").take(pa.array(at)).to_pylist()), np.uint16).reshape(len(ids), HASHES)
        a, b = [], []
        left = np.arange(len(ids))
        while len(left):
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                x = queue.pop()
                alike = np.concatenate([(sig[left[k : k + 20_000]] == sig[x]).sum(axis=1) >= least for k in range(0, len(left), 20_000)])
                found = left[alike]
                left = left[~alike]
                a += [int(ids[x])] * len(found)
                b += ids[found].tolist()
                queue += found.tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _sets(k: int):
    """(comp, parts, cid, copies, shingles) of the texts that stand for their group."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1_000_000):
                data, offsets = text_bytes(part.column(part.schema.get_field_index("text")))
                shingles, cuts, n_words, one, two = shingles_of(data, offsets, k)
                cid = part.column(part.schema.get_field_index("cid")).to_numpy()
                rows = np.flatnonzero((one.view(np.int64) == cid) & (n_words > 0)).tolist()
                sets = [np.unique(shingles[cuts[i] : cuts[i + 1]]).tobytes() for i in rows]
                kept = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(kept.column(kept.schema.get_field_index(x)) for x in ("comp", "parts", "cid", "copies")), pa.array(sets, pa.binary())], names=["comp", "parts", "cid", "copies", "shingles"])

    return run


def common_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of the sets."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[inverse] > 1  # what one set alone has is in no intersection
    owner, inverse = owner[keep], inverse[keep]
    number = np.cumsum(count > 1) - 1
    column = number[inverse]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((m, m), np.float64)
    total = int(column[-1]) + 1 if len(column) else 0
    for first in range(0, total, columns):
        a, b = np.searchsorted(column, [first, first + columns])
        block = np.zeros((m, min(columns, total - first)), np.float32)
        block[owner[a:b], column[a:b] - first] = 1
        out += block @ block.T
    np.fill_diagonal(out, [len(x) for x in sets])
    return out


def _verify(similarity: float):
    """(cid, links, label) of one group, or of one pair of its blocks: only pairs of this task count."""

    def run(key, table):
        first, second = key[1].as_py(), key[2].as_py()
        ids = table.column("cid").to_numpy()
        ids, at = np.unique(ids, return_index=True)
        copies = table.column("copies").to_numpy()[at]
        block = table.column("block").to_numpy()[at]
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").take(pa.array(at)).to_pylist()]
        sizes = np.array([len(x) for x in sets], float)
        common = common_counts(sets)
        linked = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-9
        np.fill_diagonal(linked, False)
        if first != second:
            linked &= block[:, None] != block[None, :]
        links = linked @ copies
        label = np.arange(len(ids))
        left = np.ones(len(ids), bool)
        for root in range(len(ids)):  # ids are sorted, so the first of a group is its least
            if left[root]:
                left[root] = False
                queue = [root]
                while queue:
                    x = queue.pop()
                    found = np.flatnonzero(linked[x] & left)
                    left[found] = False
                    label[found] = root
                    queue += found.tolist()
        some = links > 0
        del sets, common, linked
        if len(ids) > BLOCK_DOCS // 2:  # a large group: its arrays go back at once
            trimmed()
        return pa.table({"cid": pa.array(ids[some], pa.int64()), "links": pa.array(links[some].astype(np.int64), pa.int64()), "label": pa.array(ids[label[some]], pa.int64()), "split": pa.array([first >= 0] * int(some.sum()), pa.bool_())})

    return run


def blocks_for(n: Column, most: int) -> Column:
    """Blocks of a group of n rows, about `most` rows each, but the square root of n at most."""
    return F.least(F.ceil(n / F.lit(most)), F.ceil(F.sqrt(n))).cast("int")


def dealt_in_blocks(rows: DataFrame) -> DataFrame:
    """rows (cid, parts) with block, one and two: a group of one part is one task's (-1, -1); in a larger one each row meets every block."""
    block = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")
    partners = F.when(F.col("parts") == 1, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    met = rows.withColumn("block", block).withColumn("with", F.explode(partners))
    pair = {"one": F.least("block", "with"), "two": F.greatest("block", "with")}
    return met.withColumns({k: F.when(F.col("with") < 0, F.lit(-1)).otherwise(c) for k, c in pair.items()})


def _classes(docs: DataFrame, similarity: float, shingle: int, block_docs: int, block_shingles: int, node_docs: int) -> DataFrame:
    """(id, body, n_links, least) of each row: least is the (id, body) that comes first in its class; body tells texts apart."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text", F.xxhash64(text_or_empty()).alias("body"))
    signed = staged(over_batches(own, _sign(shingle), "id long, body long, key long, key2 long, bare boolean, n long, sig binary"), "signed")
    # equal texts, by 128 bits of hash, are one from here on; those with no characters are apart
    full = signed.filter(~F.col("bare"))
    groups = staged(full.groupBy("key", "key2").agg(F.min(F.struct("id", "body")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")), "groups")
    one = groups.select(F.col("key").alias("cid"), "rep", "copies", "n", "sig").filter(F.col("sig").isNotNull())

    nodes = forest(one.select("cid", "sig"), similarity).withColumn("parts", blocks_for(F.col("c"), node_docs))
    met = nodes.select("node", "parts", "cid").join(one.select("cid", "sig"), "cid")
    edges = dealt_in_blocks(met).select("node", "one", "two", "cid", "sig").groupBy("node", "one", "two").applyInArrow(_bucket(least_estimate(similarity)), "a long, b long")
    near = components(edges).withColumnsRenamed({"node": "cid", "label": "comp"})

    member = staged(near.join(one.select("cid", "rep", "copies", "n"), "cid"), "members")
    by_shingles = F.ceil(F.sum("n") / F.lit(block_shingles)).cast("int")
    sizes = member.groupBy("comp").agg(F.greatest(blocks_for(F.count(F.lit(1)), block_docs), by_shingles).alias("parts"))
    wanted = member.join(sizes, "comp").select("comp", "parts", "cid", "copies", F.col("rep.id").alias("id"), F.col("rep.body").alias("body"))
    texts = own.join(wanted.hint("shuffle_hash"), ["id", "body"])
    sets = over_batches(texts, _sets(shingle), "comp long, parts int, cid long, copies long, shingles binary")
    dealt = dealt_in_blocks(sets)
    checked = staged(dealt.select("comp", "one", "two", "cid", "copies", "block", "shingles").groupBy("comp", "one", "two").applyInArrow(_verify(similarity), "cid long, links long, label long, split boolean"), "checked")
    links = checked.groupBy("cid").agg(F.sum("links").alias("links"), F.min("label").alias("label"))
    split = checked.filter("split")
    if not split.isEmpty():
        whole = components(split.select(F.col("cid").alias("a"), F.col("label").alias("b"))).withColumnsRenamed({"node": "cid", "label": "_whole"})
        links = links.join(whole, "cid", "left").select("cid", "links", F.coalesce("_whole", "label").alias("label"))

    classes = groups.select("key", "key2", "rep", "copies").join(links, F.col("key") == F.col("cid"), "left").select("key", "key2", "rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "key").alias("label"))
    first = classes.groupBy("label").agg(F.min("rep").alias("least"))
    known = classes.join(first, "label").select("key", "key2", "least", "n_links")
    rows = signed.select("id", "body", F.when(~F.col("bare"), F.col("key")).alias("key"), F.when(~F.col("bare"), F.col("key2")).alias("key2"))
    return rows.join(known, ["key", "key2"], "left").select("id", "body", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", F.struct("id", "body")).alias("least"))


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES, node_docs: int = NODE_DOCS
) -> DataFrame:
    """(doc_id, class_id, n_links) for each row of docs (doc_id, text).

    Two documents are linked if the Jaccard similarity of their sets of `shingle`-word
    shingles is `similarity` or more; words are runs of digits, letters a-z (A-Z
    lower-cased) and characters from U+0080 on, and a text of fewer words has one shingle
    of them all. Texts without words are linked if they are equal; an empty or null text
    to none. class_id is the least doc_id of all that links connect, n_links the number of
    rows linked to the row. A null doc_id is the least; repeated rows are linked to each
    other; an empty table gives an empty result. Other columns are not read.
    """
    found = _classes(docs, similarity, shingle, block_docs, block_shingles, node_docs)
    real = lambda c: F.when(c != NO_ID, c)
    return found.select(real(F.col("id")).alias("doc_id"), real(F.col("least.id")).alias("class_id"), "n_links")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with one row of each class that near_duplicates() finds: of the least doc_id, and if that has several texts, the least hash.

    Of repeated rows (one doc_id and text) one stays, empty texts included. Where all that
    goes is at most broadcast_bytes it is sent to every task; beyond, rows move to it.
    """
    found = staged(_classes(docs, similarity, SHINGLE, BLOCK_DOCS, BLOCK_SHINGLES, NODE_DOCS), "near-classes")
    i, b, id_, body_, row = unused(docs, "_i", "_b", "_id", "_body", "_row")
    mine = F.struct("id", "body")
    gone = found.filter(mine != F.col("least")).select(F.col("id").alias(id_), F.col("body").alias(body_)).distinct()
    gone = staged(gone, "near-copies")
    keyed = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), b: F.xxhash64(text_or_empty())})
    same = (F.col(i) == F.col(id_)) & (F.col(b) == F.col(body_))
    kept = keyed.join(F.broadcast(gone) if 48 * gone.count() <= broadcast_bytes else gone, same, "left_anti")
    repeated = found.filter(mine == F.col("least")).groupBy("id", "body").count().filter("count > 1").select(F.col("id").alias(id_), F.col("body").alias(body_))
    repeated = staged(repeated, "repeated-rows")
    if not repeated.isEmpty():
        again = kept.join(repeated, same, "left_semi").withColumn(row, F.row_number().over(Window.partitionBy(i, b).orderBy(F.lit(0))))
        kept = kept.join(repeated, same, "left_anti").unionByName(again.filter(F.col(row) == 1).drop(row))
    return kept.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[p:p + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS p FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9
  UNION ALL SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON x.text = y.text AND x.doc_id <> y.doc_id WHERE len(x.words) = 0 AND x.text <> ''),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT w.doc_id, least(w.doc_id, coalesce(m.b, w.doc_id)) AS class_id, coalesce(l.n, 0) AS n_links
FROM w LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = w.doc_id LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) l ON l.a = w.doc_id
"""
