"""Secrets in texts, scanned once for each content and version of the rules. DataFrame functions throughout."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, staged, table, text_or_empty


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of pattern that do not overlap; of these, those whose group has the least length.

    hint: what every text with a match also matches, if that is quicker to tell.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hint: str = ""


# What the base rules look for.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, "(?i:passw|secret|token|api_?key)"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    Rule("hex", r"[0-9a-f]+", 0, 32, "[0-9a-f]{32}"),
]
MORE = [
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, "eyJ"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, "gh[pousr]_"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "-----BEGIN "),
]
RULES = BASE + MORE
SPAN = "struct<start: int, k: int, end: int, kind: string>"
NONE = f"cast(array() as array<{SPAN}>)"
ROW = f"blob binary, rule_version string, spans array<{SPAN}>"
#: Stands for a null path.
NO_PATH = -(2**63)
#: Bytes of all findings up to which they go to every task, so that paths do not move.
BROADCAST_BYTES = 16 << 20


def rule_version(rules: list[Rule]) -> str:
    """What the rules find, as a digest: another pattern, group, length or order is another version."""
    return hashlib.sha256(repr([(r.kind, r.pattern, r.group, r.least) for r in rules]).encode()).hexdigest()[:16]


def likely(text: Column, rules: list[Rule]) -> Column:
    """Whether a text may hold a match of some rule: one search for all hints, and one for each rule that has none."""
    hints = [r.hint for r in rules if r.hint]
    found = [text.rlike("|".join(hints))] if hints else []
    for r in rules:
        if not r.hint:
            found.append(text.rlike(r.pattern))
    out = F.lit(False)
    for x in found:
        out = out | x
    return out


def _spans(text: Column, order: int, rule: Rule) -> Column:
    """Array of (start, kind number, end, kind) in code points."""
    # what lies before each match, and the match itself: both lists come from the same search
    before = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    found = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda x: F.length(x))
    tested = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda x: F.length(x)) if rule.group else found
    start = F.struct(F.lit(0).alias("at"), F.expr(NONE).alias("spans"))

    def step(state: Column, x: Column) -> Column:
        first = state["at"] + x["b"]
        span = F.struct(first.alias("start"), F.lit(order).alias("k"), (first + x["f"]).alias("end"), F.lit(rule.kind).alias("kind"))
        kept = F.when(x["t"] >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((first + x["f"]).alias("at"), kept.alias("spans"))

    # the hex rule has a match at every letter a-f: only the long ones need places
    zipped = F.arrays_zip(before.alias("b"), found.alias("f"), tested.alias("t"))
    return F.aggregate(F.filter(zipped, lambda x: x["f"].isNotNull()), start, step, lambda s: s["spans"])


def scan(blobs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """blobs (blob, text) that hold a secret: (blob, spans), spans by start, then kind as listed."""
    none = F.expr(NONE)
    parts = []
    for k, r in enumerate(rules):
        # short hex digits are everywhere: this finds the same long runs and nothing else
        exact = Rule(r.kind, "[0-9a-f]{32,}", 0, 32) if r == BASE[2] else r
        parts.append(F.when(F.col("text").rlike(exact.pattern), _spans(F.col("text"), k, exact)).otherwise(none))
    chosen = blobs.filter(likely(F.col("text"), rules))
    return chosen.select("blob", F.sort_array(F.concat(none, *parts)).alias("spans")).filter(F.size("spans") > 0)


def blob_of(text: str = "text") -> Column:
    """The address of a content: 256 bits of its UTF-8 bytes."""
    return F.unhex(F.sha2(text_or_empty(text).cast("binary"), 256))


def addressed(versions: DataFrame, path: str = "doc_id") -> DataFrame:
    """(path, blob) of every version."""
    return versions.select(F.col(path).cast("long").alias("path"), blob_of().alias("blob"))


def scan_unseen(versions: DataFrame, addresses: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", rules: list[Rule] = RULES) -> DataFrame:
    """New rows of the ledger: (blob, rule_version, spans) of contents not yet scanned with these rules.

    However many paths hold a content, one version of it is read. Clean contents get
    empty spans, so that the ledger knows them.
    """
    version = rule_version(rules)
    chosen = addresses.groupBy("blob").agg(F.min(F.coalesce("path", F.lit(NO_PATH))).alias("path"))
    if ledger is not None:
        chosen = chosen.join(ledger.filter(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    texts = versions.select(F.coalesce(F.col(path).cast("long"), F.lit(NO_PATH)).alias("path"), blob_of().alias("blob"), text_or_empty().alias("text"))
    found = scan(texts.join(chosen.hint("shuffle_hash"), ["path", "blob"]).select("blob", "text"), rules).groupBy("blob").agg(F.first("spans").alias("spans"))
    return chosen.select("blob").join(found, "blob", "left").select("blob", F.lit(version).alias("rule_version"), F.coalesce("spans", F.expr(NONE)).alias("spans"))


class Ledger:
    """The ledger as a folder of commits. A commit is there once all of it is written."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def commits(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        root = path(self.folder)
        files = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not files.exists(root):
            return []
        found = [x.getPath().toString() for x in files.listStatus(root)]
        return sorted(x for x in found if files.exists(path(f"{x}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        found = self.commits()
        return self.spark.read.schema(ROW).parquet(*found) if found else None

    def commit(self, new: DataFrame) -> DataFrame:
        """Append what is new; gives the whole ledger."""
        new.write.parquet(f"{self.folder}/commit-{len(self.commits()):06d}-{uuid.uuid4().hex[:8]}")
        return self.read()

    def scan(self, versions: DataFrame, path: str = "doc_id", rules: list[Rule] = RULES) -> DataFrame:
        """(path, blob, spans) of every row of versions; contents that the ledger does not know are scanned and go into it."""
        addresses = staged(addressed(versions, path), "addresses")
        whole = self.commit(scan_unseen(versions, addresses, self.read(), path, rules))
        return findings(addresses, whole, rules)


def findings(addresses: DataFrame, ledger: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(path, blob, spans) of all addresses (path, blob), from the ledger's rows of these rules."""
    held = ledger.filter((F.col("rule_version") == rule_version(rules)) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
    held = staged(held, "findings")
    size = held.agg(F.sum(64 + 40 * F.size("spans"))).first()[0] or 0
    joined = addresses.join(F.broadcast(held) if size <= BROADCAST_BYTES else held, "blob", "left")
    return joined.select("path", "blob", F.coalesce("spans", F.expr(NONE)).alias("spans"))


def find_secrets(versions: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", rules: list[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """(path, blob, spans) of every version, and the ledger with what is new.

    spans: array of (start, k, end, kind) in code points, end exclusive. Contents of the
    ledger are scanned again only with other rules. A null or empty text has no spans; null
    paths and repeated rows are versions like others; an empty table gives empty results.
    Other columns are not read.
    """
    addresses = staged(addressed(versions, path), "addresses")
    new = staged(scan_unseen(versions, addresses, ledger, path, rules), "ledger")
    whole = new if ledger is None else ledger.select("blob", "rule_version", "spans").unionByName(new)
    return findings(addresses, whole, rules), whole


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the table are scanned one after the other with one ledger: what the source that comes first had delivered, then all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    ledger = Ledger(spark, f"{shared_dir(spark)}/blob-ledger-{uuid.uuid4().hex}")
    ledger.scan(docs.filter(F.col("source") == docs.agg(F.min("source")).first()[0]))
    found = ledger.scan(docs)
    base = F.filter("spans", lambda s: s["k"] < len(BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda k: F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long")
    return found.select(F.col("path").alias("doc_id"), of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    quoted = lambda x: x.replace("'", "''")
    parts = []
    for k, r in enumerate(RULES):
        pattern = quoted("[0-9a-f]{32,}" if r == BASE[2] else r.pattern)
        parts.append(f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(text, '{pattern}') AS b, regexp_extract_all(text, '{pattern}') AS f, regexp_extract_all(text, '{pattern}', {r.group}) AS t FROM d WHERE regexp_matches(text, '{pattern}')")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS ({' UNION ALL '.join(parts)}),
u AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM p),
s AS (SELECT doc_id, k, kind, list_sum(list_transform(b[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0)::BIGINT AS a, length(f[i]) AS n FROM u WHERE length(t[i]) >= least),
j AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
      string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) FILTER (WHERE k < {len(BASE)}) AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (doc_id)
"""


ORACLE = _oracle()
