"""Shards of near-equal bytes: longest-processing-time scheduling of groups of equal texts."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table, text_or_empty

#: The largest groups, each of which the driver's heap sees by itself, and bundles of the many
#: smaller ones: at any size of the input the driver gets no more rows than these two together.
GROUPS, BUNDLES = 65_536, 65_536
#: Cells of a shard for numbering its rows, so that no task numbers a whole shard.
CELLS = 2_048
#: Bytes that each row takes besides its text.
ROW_BYTES = 8
#: Stands for a null doc_id.
NO_ID = -(2**63)


def longest_first(sizes: list[tuple], shards: int) -> dict:
    """Shard of each (unit, bytes): the largest first, each to the least-loaded shard; ties by unit."""
    heap = [(0, k) for k in range(shards)]
    out = {}
    for unit, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[unit] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def schedule(groups: DataFrame, shards: int, most: int = GROUPS, bundles: int = BUNDLES) -> tuple[DataFrame, DataFrame | None]:
    """Shards of groups (g1, g2, bytes, least): (g1, g2, shard) of the `most` largest, and (bundle, shard) of the rest, if any.

    A group is known to the heap by its least doc_id, which settles ties.
    """
    spark = groups.sparkSession
    head = groups.orderBy(F.col("bytes").desc(), "least", "g1", "g2").limit(most + 1).collect()
    tail: list = []
    rest = len(head) > most
    if rest:
        head = head[:most]
        last = head[-1]
        after = F.struct(-F.col("bytes"), "least", "g1", "g2") > F.struct(*(F.lit(x).cast("long") for x in (-last.bytes, last.least, last.g1, last.g2)))
        tail = groups.filter(after).groupBy(F.pmod("g1", F.lit(bundles)).cast("int").alias("bundle")).agg(F.sum("bytes").alias("bytes")).collect()
    units = [((0, r.least, r.g1, r.g2), r.bytes) for r in head] + [((1, r.bundle, 0, 0), r.bytes) for r in tail]
    shard_of = longest_first(units, shards)
    one = spark.createDataFrame([(*k[2:], v) for k, v in shard_of.items() if not k[0]], "g1 long, g2 long, shard int")
    return one, spark.createDataFrame([(k[1], v) for k, v in shard_of.items() if k[0]], "bundle int, tail_shard int") if rest else None


def assign_shards(docs: DataFrame, shards: int = 24, groups: int = GROUPS, bundles: int = BUNDLES, cells: int = CELLS) -> DataFrame:
    """Each row of docs (doc_id, text) with size, text_crc32, law, shard, slot and grown_shard.

    Equal texts (128 bits of hash) are one group and share a shard. Groups go by size, the
    largest first, to the least-loaded shard; beyond the `groups` largest, hash bundles of
    the smaller ones do. Sizes of shards are near equal, unless one group of equal texts is
    larger than a shard's share: it stays whole. Slots number a shard's rows from 0 without
    gaps. A null text counts as empty; a null doc_id comes first; repeated rows count, and
    get slots of their own. Other columns are not read. An empty table gives an empty result.
    """
    text = text_or_empty()
    rows = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("g1"),
            F.xxhash64(F.lit(17), text).alias("g2"),
        ),
        "sharding",
    )
    # groups are summed up before they move, so a group of any number of copies is a few rows
    found = staged(rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"), F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("least")), "sharding-groups")
    one, rest = schedule(found, shards, groups, bundles)
    dealt = rows.join(F.broadcast(one), ["g1", "g2"], "left")  # `groups` rows at most
    if rest is not None:
        dealt = dealt.withColumn("bundle", F.pmod("g1", F.lit(bundles)).cast("int")).join(F.broadcast(rest), "bundle", "left").withColumn("shard", F.coalesce("shard", "tail_shard"))
    cell = (F.crc32(F.concat_ws(":", F.coalesce("doc_id", F.lit(NO_ID)), "text_crc32").cast("binary")) % cells).cast("int")
    dealt = dealt.select("doc_id", "size", "text_crc32", "shard", cell.alias("cell"))
    counts = dealt.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))  # shards * cells rows at most
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    return (
        dealt.withColumn("k", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


#: Scheduling one group after the other; as many groups as the heap sees by themselves, at most.
ORACLE = rf"""
WITH RECURSIVE t AS MATERIALIZED (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x::BIGINT)) AS tbl),
c AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + {ROW_BYTES} AS size, 
  xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT), lambda s, b: xor(s >> 8, tbl[xor(s & 255, b) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32 FROM documents, t),
g AS MATERIALIZED (SELECT text, bytes, row_number() OVER (ORDER BY bytes DESC, least) AS k FROM (SELECT text, sum(size)::BIGINT AS bytes, min(doc_id) AS least FROM c GROUP BY text)),
r AS (SELECT 0::BIGINT AS k, list_transform(range(24), lambda x: 0::BIGINT) AS loads, 0::BIGINT AS shard
      UNION ALL SELECT g.k, list_transform(loads, lambda v, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN v + g.bytes ELSE v END), list_position(loads, list_min(loads)) - 1 FROM r JOIN g ON g.k = r.k + 1),
s AS (SELECT c.*, r.shard, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id || ':' || text_crc32)), '..'), lambda h: ('0x' || h)::BIGINT), lambda s, b: xor(s >> 8, tbl[xor(s & 255, b) + 1]), 4294967295::BIGINT), 4294967295) % {CELLS} AS cell
      FROM c JOIN g USING (text) JOIN r USING (k), t)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY cell, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s
"""
