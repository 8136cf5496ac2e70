"""Lines that many documents share stay in one document only. DataFrame functions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table, text_or_empty, unused

#: Code points of a key, and documents that hold it, from which its lines go.
MIN_CHARS, MIN_DOCS = 40, 5
#: Stands for a null doc_id, which is smaller than all others.
NO_ID = -(2**63)
#: Bytes of all bitmaps up to which they go to every task, so that no text moves.
BROADCAST_BYTES = 16 << 20


def line_key(line: Column) -> Column:
    """Stripped of white space at both ends, A-Z lower-cased."""
    bare = F.trim(line, F.lit(" \t\n\x0b\f\r"))
    # lower() is the fast way, and right where no other letter has a lower case
    other = bare.rlike("[[\\p{IsUppercase}\\p{Lt}]&&[^A-Z]]")
    return F.when(other, F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(bare))


def first_occurrences(keys: DataFrame) -> DataFrame:
    """The first row of each line in each document, of keys (h, g, id, body, pos).

    Rows are range-partitioned by hash and document, so that a frequent line spreads over
    many partitions, and sorted by document and position in each; the window reads them as
    a stream in this order and needs no other exchange or sort.
    """
    ranged = keys.repartitionByRange("h", "g", "id").sortWithinPartitions("h", "g", "id", "pos", "body")
    seen = Window.partitionBy("h", "g", "id").orderBy("pos", "body")
    return ranged.withColumn("seen", F.row_number().over(seen)).filter("seen = 1").select("h", "g", "id", "pos")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, body, runs): the documents that lose lines, runs of line numbers as (first, last).

    The runs are the compressed bitmap of what a document loses; no text moves here.
    id is doc_id, or NO_ID for null; body tells apart rows that share a doc_id.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(text_or_empty()).alias("body"),
        F.posexplode(F.split(text_or_empty(), "\n", -1)).alias("pos", "line"),
    )
    # a line too short before stripping needs no key
    keys = rows.filter(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    keys = staged(keys.select("id", "body", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(17), F.col("key")).alias("g")), "lines")
    # counts are made in each partition before they meet, so a line of any frequency is a few rows here
    shared = first_occurrences(keys).groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= min_docs).select("h", "g", "keeper")
    # as a table of its own, so that Spark can split a frequent line's rows over several tasks of the join
    shared = staged(shared, "shared-lines")
    lost = keys.join(shared, ["h", "g"]).filter(F.col("id") != F.col("keeper"))
    byte_of = lost.groupBy("id", "body").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    first = F.filter("p", lambda x, i: (i == 0) | (F.get(F.col("p"), i - 1) != x - 1))
    last = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get(F.col("p"), i + 1) != x + 1))
    return byte_of.select("id", "body", F.arrays_zip(first.alias("first"), last.alias("last")).alias("runs"))


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text besides its own columns.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of
    min_chars code points or more, in min_docs documents or more, lose their lines in all
    documents but the largest doc_id. A null or empty text is one empty line and keeps
    its value; a null doc_id is one document, smaller than all others; repeated rows with
    one doc_id count once as a document, and get equal results. Other columns stay, and
    columns named n_lines, n_dropped or kept_text are replaced. Where all that documents
    lose is at most broadcast_bytes it goes to every task; beyond, texts move to it.
    """
    own = docs.drop("n_lines", "n_dropped", "kept_text")
    i, b, id_, body, runs = unused(own, "_i", "_b", "_id", "_body", "_runs")
    lost = staged(dropped_lines(docs, min_chars, min_docs), "lost-lines")
    size = lost.agg(F.sum(48 + 16 * F.size("runs"))).first()[0] or 0
    lost = lost.withColumnsRenamed({"id": id_, "body": body, "runs": runs})
    keyed = own.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), b: F.xxhash64(text_or_empty())})
    joined = keyed.join(F.broadcast(lost) if size <= broadcast_bytes else lost.hint("shuffle_hash"), (F.col(i) == F.col(id_)) & (F.col(b) == F.col(body)), "left")
    lines = F.split(text_or_empty(), "\n", -1)
    gone = F.flatten(F.transform(runs, lambda r: F.sequence(r["first"], r["last"])))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    # the lines as one value, so that each lookup does not split the text again
    text = F.element_at(F.transform(F.array(lines), lambda own_lines: F.array_join(F.transform(kept, lambda k: F.get(own_lines, k)), "\n")), 1)
    return joined.select(
        *own.columns,
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate(runs, F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col(runs).isNull(), F.col("text")).otherwise(text).alias("kept_text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(text_or_empty("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
