"""Language of a text from pieces of a fixed public vocabulary.

Each language has a probability for each piece. A word's score is the sum over all ways to
cut it into pieces, by the forward algorithm; a text's is the product over its words.
Words are scored once for all their occurrences in a slice of texts and remembered.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mixed, over_batches, pieces, span_hashes, table, text_bytes

#: Rows of each language that the probabilities are learned from, those of the smallest hash, and rows in all.
FIT_ROWS, FIT_ALL = 150, 20_000
#: Letters of the longest word that is learned from; predictions take words of any length.
FIT_LETTERS = 40
#: Rounds of expectation and maximisation; characters of the vocabulary's longest piece.
ROUNDS, LONGEST = 3, 16
#: A word of more characters goes through the forward algorithm in parts of so many.
PART = 4096
#: Added to each piece's expected count, and the share of a character outside the vocabulary.
SMOOTH, STRANGE = 0.05, 1e-7
#: Words that a worker remembers before it starts anew.
REMEMBERED = 200_000

_HASH = np.uint64(0x9E3779B97F4A7C15)


def _letters(chars: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    kinds = _KINDS
    if kinds is None:
        kinds = _make_kinds()
    return kinds[chars] > 0


_KINDS = None


def _make_kinds() -> np.ndarray:
    global _KINDS
    kinds = np.zeros(0x110000, np.uint8)
    kinds[[c for c in range(0x110000) if chr(c).isalpha()]] = 1
    # parts of words that are no letters themselves
    import unicodedata

    kinds[[c for c in range(0x300, 0x3000) if unicodedata.category(chr(c)) in ("Mn", "Mc")]] = 2
    _KINDS = kinds
    return kinds


_FOLD = None


def _fold() -> np.ndarray:
    """Code point of the lower case, where that is one character."""
    global _FOLD
    if _FOLD is None:
        _FOLD = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            low = chr(c).lower()
            if len(low) == 1:
                _FOLD[c] = ord(low)
    return _FOLD


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return chars, lead[offsets]


def letter_words(chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points, starts and ends of runs of letters, and the n + 1 first-word numbers of the rows."""
    low = _fold()[chars]
    _letters(chars[:0])
    kinds = _KINDS[chars]
    inside = np.zeros(len(chars) + 2, bool)
    inside[1:-1] = kinds > 0
    step = inside[1:] != inside[:-1]
    first, last = step & inside[1:], step & inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(chars))]
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    first[cuts] = True
    last[cuts] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return low, starts, ends, np.searchsorted(starts, offsets)


class Pieces:
    """The letter pieces of the vocabulary, found by hash; begin of word is a mark of its own."""

    MARK = 0x2581

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        found = set()
        for i in range(lib.get_piece_size()):
            p = lib.id_to_piece(i)
            bare = p.lstrip(chr(self.MARK))
            if bare and bare.isalpha() and len(p) <= LONGEST and not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)):
                found.add(p.lower())
        self.text = sorted(found | {chr(self.MARK)})
        by_length: dict[int, list[int]] = {}
        for k, p in enumerate(self.text):
            by_length.setdefault(len(p), []).append(k)
        self.tables = {}
        for n, ids in by_length.items():
            hashes = self.hash(np.array([[ord(c) for c in self.text[k]] for k in ids], np.uint64))
            order = np.argsort(hashes)
            self.tables[n] = (hashes[order], np.array(ids, np.int64)[order])

    @staticmethod
    def hash(rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.uint64)
        for j in range(rows.shape[1]):
            out = out * _HASH + rows[:, j]
        return mixed(out)

    def lattice(self, words: np.ndarray, lengths: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end position the pieces that end there: (length, rows, piece numbers)."""
        out: list[list] = [[] for _ in range(words.shape[1] + 1)]
        for end in range(1, words.shape[1] + 1):
            for n, (hashes, ids) in self.tables.items():
                if n > end:
                    continue
                rows = np.flatnonzero(lengths >= end)
                h = self.hash(words[rows, end - n : end])
                at = np.searchsorted(hashes, h)
                at[at == len(hashes)] = 0
                ok = hashes[at] == h
                if ok.any():
                    out[end].append((n, rows[ok], ids[at[ok]]))
        return out


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """The pieces of a model file, made once in a worker."""
    return Pieces(path)


def forward(lattice: list, lengths: np.ndarray, chances: np.ndarray, width: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all segmentations of each prefix: alpha (words, ends, languages), scaled by exp of the second result (words, languages).

    A character that no piece covers costs STRANGE. Every prefix is reached, so no word scores 0.
    known: alpha of the first ends, where a word goes on from a part before.
    """
    n, langs = len(lengths), chances.shape[1]
    alpha = np.zeros((n, width + 1, langs))
    known = np.ones((n, 1, langs)) if known is None else known
    alpha[:, : known.shape[1]] = known
    scale = np.zeros((n, langs))
    for end in range(known.shape[1], width + 1):
        now = alpha[:, end - 1] * STRANGE
        for size, rows, ids in lattice[end]:
            now[rows] += alpha[rows, end - size] * chances[ids]
        alpha[:, end] = np.where((lengths >= end)[:, None], now, 0)
        if end % 16 == 0:  # long words would underflow
            top = np.where(alpha[:, end] > 0, alpha[:, end], 1)  # each language by its own: one may be far below another
            alpha[:, max(0, end - LONGEST) : end + 1] /= top[:, None]
            scale += np.log(top)
    return alpha, scale


class Scorer:
    """Log scores of words by language."""

    def __init__(self, path: str, chances: np.ndarray):
        self.pieces, self.chances = pieces_of(path), chances
        self.forget()

    def forget(self) -> None:
        self.slot_of: dict[int, int] = {}
        self.scores = np.zeros((1 << 12, self.chances.shape[1]))

    def words(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores (words, languages) of the words given by their spans."""
        lengths = ends - starts
        out = np.zeros((len(starts), self.chances.shape[1]))
        done = 0
        for high in (4, 8, 12, 16, 24, 48, 1 << 40):
            which = np.flatnonzero((lengths > done) & (lengths <= high))
            done = high
            part = 20_000 if high <= 48 else 1
            for k in range(0, len(which), part):
                w = which[k : k + part]
                out[w] = self.block(low, starts[w], ends[w])
        return out

    def block(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        width = int((ends - starts).max())
        if width > PART:
            return np.array([self.long(low, a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        words, lengths = padded(low, starts, ends, width)
        alpha, scale = forward(self.pieces.lattice(words, lengths), lengths, self.chances, width + 1)
        return np.log(alpha[np.arange(len(lengths)), lengths]) + scale

    def long(self, low: np.ndarray, start: int, end: int) -> np.ndarray:
        """Scores of one very long word, in parts, so that memory stays bounded; each part goes on from the last ends of the one before."""
        known, total = None, np.zeros(self.chances.shape[1])
        for k in range(start, end, PART):
            # the characters that a piece over the cut can begin with
            back = 0 if known is None else known.shape[1] - 1
            stop = min(k + PART, end)
            if known is None:
                words, lengths = padded(low, np.array([k]), np.array([stop]), stop - k)
            else:
                words, lengths = low[None, k - back : stop].astype(np.uint64), np.array([stop - k + back])
            alpha, scale = forward(self.pieces.lattice(words, lengths), lengths, self.chances, words.shape[1], known)
            total += scale[0]
            known = alpha[:, -min(LONGEST + 1, alpha.shape[1]) :]
        return np.log(known[0, -1]) + total

    def texts(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Scores (rows, languages), and which texts have a letter; the scores of the others are 0."""
        data, offsets = text_bytes(column)
        chars, at = code_points(data, offsets)
        low, starts, ends, first = letter_words(chars, at)
        # a run of marks without a letter is no word
        letters = np.concatenate(([0], np.cumsum(_KINDS[chars] == 1)))
        out = np.zeros((len(offsets) - 1, self.chances.shape[1]))
        has = letters[at[1:]] > letters[at[:-1]]
        if not has.any():
            return out, has
        hashes = span_hashes(low, starts, ends)
        unique, some, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.slot_of) > REMEMBERED:
            self.forget()
        keys = unique.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.slot_of]
        if new:
            w = some[new]
            found = self.words(low, starts[w], ends[w])
            used = len(self.slot_of)
            while used + len(new) > len(self.scores):
                self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
            self.scores[used : used + len(new)] = found
            self.slot_of.update(zip((keys[i] for i in new), range(used, used + len(new)), strict=True))
        slots = np.array([self.slot_of[h] for h in keys], np.int64)[inverse]
        some = first[1:] > first[:-1]
        out[some] = np.add.reduceat(self.scores[slots], first[:-1][some], axis=0)
        out[~has] = 0
        return out, has


def padded(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of code points behind a begin mark, and their lengths with it."""
    at = starts[:, None] + np.arange(width)[None, :]
    inside = at < ends[:, None]
    rows = np.where(inside, low[np.minimum(at, max(len(low) - 1, 0))], 0)
    return np.concatenate((np.full((len(starts), 1), Pieces.MARK), rows), axis=1).astype(np.uint64), ends - starts + 1


def fit(path: str, counts: list[tuple[str, str, int]], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages, and chances (pieces, languages), from (language, lower-case word, occurrences)."""
    vocabulary = pieces_of(path)
    langs = sorted({c[0] for c in counts})
    chances = np.full((len(vocabulary.text), len(langs)), 1.0 / len(vocabulary.text))
    blocks = []
    ordered = sorted(counts, key=lambda c: (len(c[1]), c))
    for k in range(0, len(ordered), 20_000):
        part = ordered[k : k + 20_000]
        low = np.array([ord(c) for x in part for c in x[1]], np.uint32)
        ends = np.cumsum([len(x[1]) for x in part])
        words, lengths = padded(low, ends - [len(x[1]) for x in part], ends, max(len(x[1]) for x in part))
        blocks.append((vocabulary.lattice(words, lengths), lengths, np.array([langs.index(x[0]) for x in part]), np.array([x[2] for x in part], float)))
    for _ in range(rounds):
        expected = np.full_like(chances, SMOOTH)
        for lattice, lengths, lang, n in blocks:
            width = int(lengths.max())
            rows = np.arange(len(lengths))
            own = np.zeros((len(chances), len(langs)))
            alpha = np.zeros((len(lengths), width + 1))
            alpha[:, 0] = 1
            for end in range(1, width + 1):
                now = alpha[:, end - 1] * STRANGE
                for size, r, ids in lattice[end]:
                    now[r] += alpha[r, end - size] * chances[ids, lang[r]]
                alpha[:, end] = np.where(lengths >= end, now, 0)
            total = np.maximum(alpha[rows, lengths], 1e-300)
            beta = np.zeros((len(lengths), width + 1))
            beta[rows, lengths] = 1
            for end in range(width, 0, -1):
                for size, r, ids in lattice[end]:
                    chance = chances[ids, lang[r]]
                    np.add.at(own, (ids, lang[r]), n[r] * alpha[r, end - size] * chance * beta[r, end] / total[r])
                    beta[r, end - size] += chance * beta[r, end]
                beta[:, end - 1] += STRANGE * beta[:, end]
            expected += own
        chances = expected / expected.sum(axis=0)
    return langs, chances


def training_words(docs: DataFrame, rows: int = FIT_ROWS, most: int = FIT_ALL) -> list[tuple[str, str, int]]:
    """(lang, word, occurrences) over `rows` labelled rows of each language, those whose doc_id has the smallest hash."""
    # Spark keeps the first `rows` of each task before it moves any, so a frequent language is no burden
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = docs.filter(F.col("lang").isNotNull()).select("lang", "doc_id").withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= rows).orderBy("_k", "lang", "doc_id").limit(most).select("doc_id", "lang")
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen.distinct()), ["doc_id", "lang"])  # `most` rows at most
    words = texts.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{Mn}\p{Mc}]+")).alias("w")).filter(F.length("w").between(1, FIT_LETTERS))
    return [(r.lang, r.w, r.n) for r in words.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")).collect()]


def _predictor(names: list[str], shared, path: str):
    def run(batches):
        langs, chances = shared.value
        scorer = Scorer(path, chances)
        for batch in batches:
            for part in pieces(batch, "text", 1_000_000):
                scores, has = scorer.texts(part.column(part.schema.get_field_index("text")))
                none = ~has
                chance = np.exp(scores - scores.max(axis=1, keepdims=True))
                chance /= chance.sum(axis=1, keepdims=True)
                best = chance.argmax(axis=1)
                said = ["und" if x else langs[k] for x, k in zip(none.tolist(), best.tolist(), strict=True)]
                sure = np.where(none, 0.0, chance[np.arange(len(best)), best])
                kept = [part.column(part.schema.get_field_index(x)) for x in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(said, pa.string()), pa.array(sure, pa.float64())], names=[*names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, counts: list[tuple[str, str, int]], path: str) -> DataFrame:
    """docs with lang_pred and score (the language's share among all, 0 to 1), learned from counts.

    A null text or one without letters is `und` with score 0, and so is every text if there
    is nothing to learn from. Only text is read for a prediction; repeated rows get equal
    results. Columns of docs with one of the new names are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    if not counts:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(fit(path, counts))
    return over_batches(docs, _predictor(docs.columns, shared, path), T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    counts = training_words(docs.filter(~held_out))
    found = predict(docs.select("doc_id", "text"), counts, vocabulary())
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
