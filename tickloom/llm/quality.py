"""Quality rules: counts of words, symbols and repeats, and how far a text is from its language. DataFrame functions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, unused

#: A text of fewer words fails; so does one with more repeated words of 100.
MIN_WORDS, MAX_REPEAT = 50, 50
#: Largest Jensen-Shannon distances (0 to 1) from the language's own histograms; that of common words is
#: scaled by the distance of a text that has none of them.
MAX_CLASSES, MAX_COMMON = 0.30, 0.92
#: A histogram of fewer characters or words than this says nothing of a text.
LEAST_CHARS, LEAST_WORDS = 200, 50
#: Largest lack of common words, 1 for a text without any, and how many common words a text must be expected to have for it.
MAX_LACK, LEAST_COMMON = 0.6, 5

# Common words, in lower case, whose shares make the second histogram; any other language takes them all.
COMMON = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "this", "are", "at", "from", "or", "which", "have", "not"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "par", "qui", "dans", "avec", "sur", "pas", "au", "ne", "se", "il", "ce"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ein", "für", "ist", "im", "nicht", "dem", "eine", "als", "es", "an", "auch", "wird"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "su", "una", "para", "es", "al", "lo", "como", "más", "pero", "sus"],
}
EVERY = sorted({w for words in COMMON.values() for w in words})
#: No longer word needs a look.
MOST_LETTERS = max(map(len, EVERY))
#: Character classes and the bin of the histogram that each counts for: small letters, white space, capitals, digits,
#: punctuation, symbols, other letters and marks; what is left over is the last bin. Each class leaves less text for the next.
CLASSES = [("[a-z]+", 0), ("[\\x20\\x09-\\x0D]+", 1), ("[A-Z]+", 2), ("[0-9]+", 3), ("[.,;:!?'\"()-]+", 4), ("[#*$%&|<>]+", 5), ("\\p{Ll}+", 0), ("[\\p{Lu}\\p{Lt}]+", 2), ("[\\p{Lo}\\p{Lm}\\p{M}]+", 6)]
BINS = 8


def _repeated(w: Column, s: Column, bits: Column) -> Column:
    """Words in 3-word windows that a text has twice or more; s holds the windows' hashes over their places, sorted."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    place = lambda x: x.bitwiseAND(mask).cast("int")
    key = lambda x: F.call_function("shiftright", x, bits)

    def same(x: Column, y: Column) -> Column:
        a, b = place(x), place(y)
        words = [F.get(w, a + k) == F.get(w, b + k) for k in range(3)]
        return F.coalesce((key(x) == key(y)) & words[0] & words[1] & words[2], F.lit(False))

    twice = F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
    places = F.flatten(F.transform(twice, lambda x: F.array(place(x), place(x) + 1, place(x) + 2)))
    return F.size(F.array_distinct(places)).cast("long")


def measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the two histograms in _classes and _common."""
    text, words, bits, windows, lines, hits, counts = unused(docs, "_t", "_w", "_bits", "_s", "_lines", "_hits", "_counts")
    left = unused(docs, *(f"_t{k}" for k in range(len(CLASSES))))
    df = docs.withColumn(text, F.coalesce("text", F.lit("")))
    for before, after, (pattern, _) in zip([text, *left], left, CLASSES, strict=False):
        df = df.withColumn(after, F.regexp_replace(before, pattern, ""))
    sizes = [F.length(x) for x in (text, *left)]
    bins: list[list[Column]] = [[] for _ in range(BINS)]
    for (_, k), a, b in zip(CLASSES, sizes, sizes[1:], strict=False):
        bins[k].append(a - b)
    bins[-1].append(sizes[-1])
    classes = F.array(*(sum(x[1:], x[0]) for x in bins))
    space = CLASSES[1][0]
    bare = F.trim(F.col(text), F.lit(" \t\n\x0b\f\r"))
    df = df.withColumn(words, F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, space, -1)))
    n = F.size(words)
    hashed = F.transform(words, lambda x, i: F.call_function("shiftleft", F.xxhash64(x, F.get(F.col(words), i + 1), F.get(F.col(words), i + 2)), F.col(bits)).bitwiseOR(i.cast("long")))
    df = df.withColumn(bits, F.ceil(F.log2(n + 2)).cast("int"))
    df = df.withColumn(windows, F.when(n >= 3, F.sort_array(F.slice(hashed, F.lit(1), F.greatest(n - 2, F.lit(0))))))
    df = df.withColumn(lines, F.filter(F.split(F.col(text), "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    # the common words of a text as one string, |of||the|, in which one search counts each
    found = F.filter(words, lambda x: (F.length(x) <= MOST_LETTERS) & F.lower(x).isin(*EVERY))
    df = df.withColumn(hits, F.concat(F.lit("|"), F.lower(F.array_join(found, "||")), F.lit("|")))
    chosen = F.array(*map(F.lit, EVERY))
    for lang, own in COMMON.items():
        chosen = F.when(F.col("lang") == lang, F.array(*map(F.lit, own))).otherwise(chosen)
    of = lambda c: (F.octet_length(F.col(hits)) - F.octet_length(F.replace(F.col(hits), F.concat(F.lit("|"), c, F.lit("|")), F.lit("")))) / (F.octet_length(c) + 2)
    df = df.withColumn(counts, F.transform(chosen, lambda c: of(c).cast("int")))
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    return df.select(
        *columns,
        n.cast("long").alias("n_words"),
        (sizes[0] - bins[1][0]).cast("long").alias("word_chars"),
        bins[5][0].cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, _repeated(F.col(words), F.col(windows), F.col(bits))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        sizes[0].alias("_chars"),
        classes.alias("_classes"),
        F.concat(counts, F.array(n - total)).alias("_common"),
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two lists of shares of one length."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, v: a + v), F.lit(0.0)) / 2)


def of_two(p: Column, q: Column) -> Column:
    """The same for shares p and 1 - p against q and 1 - q."""
    part = lambda a, m: F.when(a > 0, a * F.log2(F.try_divide(a, m))).otherwise(F.lit(0.0))
    terms = [part(a, (a + b) / 2) for a, b in ((p, q), (q, p), (1 - p, 1 - q), (1 - q, 1 - p))]
    return F.sqrt(F.greatest(sum(terms[1:], terms[0]), F.lit(0.0)) / 2)


#: Languages, those with the most rows, whose references go to all tasks.
BROADCAST_LANGUAGES = 1_000


def _with_reference(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """rows with their language's reference (_lang), without dealing texts out by language: a few hold most of them."""
    same = lambda: F.col("lang").eqNullSafe(F.col("_lang"))
    frequent = reference.orderBy(F.col("_rows").desc(), F.col("_lang")).limit(BROADCAST_LANGUAGES)
    if reference.count() <= BROADCAST_LANGUAGES:
        return rows.join(F.broadcast(frequent), same(), "left")
    names = frequent.select(F.col("_lang").alias("_frequent"), F.lit(True).alias("_is"))
    known = rows.join(F.broadcast(names), F.col("lang").eqNullSafe(F.col("_frequent")), "left")
    often, rare = known.filter("_is").drop("_frequent", "_is"), known.filter("_is is null").drop("_frequent", "_is")
    return often.join(F.broadcast(frequent), same()).unionByName(rare.join(reference, same(), "left"))


HISTOGRAMS = {"_classes": BINS, "_common": len(EVERY) + 1}
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "common_distance", "common_lack"]
def judge(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """docs, or the named columns of it (lang among them), with ADDED columns: the counts, the distances and whether the rules keep the row.

    Histograms of all rows of a lang that pass the base rules are its reference; a null
    lang is a lang of its own. A text too short for a histogram has no distance and is not
    rejected by it, nor is one whose language has no reference. A null or empty text has
    no words and fails. Repeated rows count each; an empty table stays empty. Columns of
    docs with one of the new names are replaced.
    """
    own = docs.drop(*ADDED)
    columns = columns or own.columns
    # helper columns have names that no column of docs has
    used = ("_classes", "_common", "_chars", "_lang", "_rows", "_frequent", "_is", "_of_classes", "_of_common", "_none", "_share")
    away = {c: x for c, x in zip(used, unused(own, *used), strict=True) if c != x}
    own = own.withColumnsRenamed(away)
    rows = staged(measured(own, [away.get(c, c) for c in columns]), "quality")
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))
    sums = [F.sum(F.get(name, F.lit(k)).cast("double")).alias(f"{name}{k}") for name, n in HISTOGRAMS.items() for k in range(n)]
    reference = rows.filter(~F.col("base_failed")).groupBy("lang").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_chars").alias("_chars"), F.sum("n_words").alias("_words"), *sums)
    # of a known language the list is shorter: what was never there is no part of it
    bins = lambda name: F.filter(F.array(*(F.col(f"{name}{k}") for k in range(HISTOGRAMS[name]))), lambda x: x.isNotNull())
    shares = {"_classes": F.transform(bins("_classes"), lambda x: x / F.col("_chars")), "_common": F.transform(bins("_common"), lambda x: x / F.col("_words"))}
    reference = reference.select(F.col("lang").alias("_lang"), "_rows", *(c.alias(f"_of{name}") for name, c in shares.items()))
    # a text that has only other words, and the share of common ones
    none = F.transform("_of_common", lambda v, k: F.when(k == F.size("_of_common") - 1, 1.0).otherwise(0.0))
    reference = reference.withColumns({"_none": distance(none, F.col("_of_common")), "_share": 1 - F.element_at("_of_common", -1)})
    joined = _with_reference(rows, staged(reference, "languages"))
    share = 1 - F.try_divide(F.element_at("_common", -1), F.col("n_words"))
    missing = F.when(share < F.col("_share"), F.try_divide(of_two(share, F.col("_share")), of_two(F.lit(0.0), F.col("_share")))).otherwise(F.lit(0.0))
    joined = joined.withColumns(
        {
            "class_distance": F.when(F.col("word_chars") >= LEAST_CHARS, distance(F.transform("_classes", lambda v: v / F.col("_chars")), F.col("_of_classes"))),
            # as a share of the distance of a text that has only other words
            "common_distance": F.when(F.col("n_words") >= LEAST_WORDS, F.try_divide(distance(F.transform("_common", lambda v: v / F.col("n_words")), F.col("_of_common")), F.col("_none"))),
            # how far the share of common words falls short, as a share of a text's without any; where some are to be expected
            "common_lack": F.when((F.col("n_words") >= LEAST_WORDS) & (F.col("n_words") * F.col("_share") >= LEAST_COMMON), missing),
        }
    )
    near = F.lit(True)
    for x, most in (("class_distance", MAX_CLASSES), ("common_distance", MAX_COMMON), ("common_lack", MAX_LACK)):
        near = near & F.coalesce(F.col(x) <= most, F.lit(True))
    back = {v: k for k, v in away.items()}
    done = joined.withColumn("kept", ~F.col("base_failed") & near).select(*(away.get(c, c) for c in columns), *ADDED)
    return done.withColumnsRenamed(back)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with their own columns; those that have names of ADDED stay as they are."""
    names = dict(zip(ADDED, unused(docs, *("_" + x for x in ADDED)), strict=True))
    own = docs.withColumnsRenamed(names)
    kept = judge(own).filter("kept").select(*own.columns)
    return kept.withColumnsRenamed({v: k for k, v in names.items()})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["doc_id", "lang"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    lists = " ".join(f"WHEN {quote(lang)} THEN [{', '.join(map(quote, words))}]" for lang, words in COMMON.items())
    bins = ["|".join(c for c, at in CLASSES if at == k) for k in range(BINS - 1)]
    classes = ", ".join(f"length(text) - length(regexp_replace(text, {quote(c)}, '', 'g'))" for c in bins)
    terms = "sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)"
    js = f"sqrt(greatest({terms}, 0) / 2)"
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END"
    two = lambda a, b: f"sqrt(greatest({part(a, b)} + {part(b, a)} + {part(f'(1 - {a})', f'(1 - {b})')} + {part(f'(1 - {b})', f'(1 - {a})')}, 0) / 2)"
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (SELECT doc_id, p, w[p:p + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri) WHERE c > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b0 AS MATERIALIZED (SELECT doc_id, lang, text, w, coalesce(rep.n, 0) AS rep, len(w) < {MIN_WORDS} OR 100 * coalesce(rep.n, 0) > {MAX_REPEAT} * len(w) AS base_failed, [{classes}] AS c,
  CASE lang {lists} ELSE [{', '.join(map(quote, EVERY))}] END AS l FROM d LEFT JOIN rep USING (doc_id)),
hc AS (SELECT doc_id, lang, base_failed, unnest(list_concat(c, [length(text) - list_sum(c)]))::DOUBLE AS v, unnest(range(1, {BINS + 1})) AS k FROM b0),
hw0 AS (SELECT doc_id, lang, base_failed, x AS k, len(list_filter(w, lambda y: lower(y) = x))::DOUBLE AS v FROM (SELECT doc_id, lang, base_failed, unnest(l) AS x, w FROM b0)),
hw AS (SELECT * FROM hw0 UNION ALL SELECT doc_id, lang, base_failed, '', len(w) - (SELECT coalesce(sum(v), 0) FROM hw0 WHERE hw0.doc_id = b0.doc_id) FROM b0),
rw AS (SELECT *, s / sum(s) OVER (PARTITION BY lang) AS q FROM (SELECT lang, k, sum(v) AS s FROM hw WHERE NOT base_failed GROUP BY lang, k)),
nw AS (SELECT lang, {js} AS d, max(CASE WHEN k = '' THEN 1 - q END) AS share FROM (SELECT lang, k, q, CASE WHEN k = '' THEN 1.0 ELSE 0.0 END AS p FROM rw) GROUP BY lang),
jc AS (SELECT doc_id, {js} AS d FROM (SELECT doc_id, v / sum(v) OVER (PARTITION BY doc_id) AS p, s / sum(s) OVER (PARTITION BY doc_id) AS q FROM hc JOIN (SELECT lang, k, sum(v) AS s FROM hc WHERE NOT base_failed GROUP BY lang, k) r ON hc.lang IS NOT DISTINCT FROM r.lang AND hc.k = r.k) GROUP BY doc_id),
jw AS (SELECT doc_id, {js} AS d FROM (SELECT doc_id, v / sum(v) OVER (PARTITION BY doc_id) AS p, q FROM hw JOIN rw ON hw.lang IS NOT DISTINCT FROM rw.lang AND hw.k = rw.k) GROUP BY doc_id),
m AS (SELECT b0.doc_id, len(w) AS n_words, length(text) - c[2] AS word_chars, c[6] AS n_symbols, coalesce(ln.n, 0) AS n_dup_lines, rep AS n_repeat_words, b0.base_failed, jc.d AS dc, jw.d / nullif(nw.d, 0) AS dw, nw.share AS q, 1 - o.v / len(w) AS p
      FROM b0 LEFT JOIN ln USING (doc_id) LEFT JOIN jc USING (doc_id) LEFT JOIN jw USING (doc_id) LEFT JOIN nw ON b0.lang IS NOT DISTINCT FROM nw.lang LEFT JOIN hw o ON o.doc_id = b0.doc_id AND o.k = '')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (word_chars < {LEAST_CHARS} OR coalesce(dc <= {MAX_CLASSES}, true)) AND (n_words < {LEAST_WORDS} OR coalesce(dw <= {MAX_COMMON}, true)
         AND (coalesce(n_words * q < {LEAST_COMMON}, true) OR p >= q OR coalesce({two('p', 'q')} / {two('0.0', 'q')} <= {MAX_LACK}, true))) AS kept
FROM m
"""


ORACLE = _oracle()
