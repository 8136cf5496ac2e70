"""Each operator against plain loops, on rows with nulls, copies, repeated rows and clashing columns."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from tickloom.llm import decontaminate, jaccard, language_id, line_dedup, piece_codec, quality, secrets, sharding, suffix_dedup
from tickloom.llm.queries import QUERIES

from . import brute


def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def by_id(df):
    rows = df.collect()
    assert len(rows) == len({r.doc_id for r in rows})
    return {r.doc_id: r for r in rows}


# ---------------------------------------------------------------- the queries, on whole tables


@pytest.mark.parametrize(("at_once", "crowd"), [(4_000, 40_000), (7, 3)])
def test_suffix_dedup(spark, sf_dir, at_once, crowd):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = by_id(suffix_dedup.remove_repeats(table, whole=False, at_once=at_once, crowd=crowd))
    for i, want in brute.repeats(documents(spark, sf_dir)).items():
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want


def test_suffix_dedup_in_parts_of_a_text(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    import random

    rnd = random.Random(9)
    part = " ".join(str(rnd.randint(0, 10**9)) for _ in range(40_000))
    long = part + part[5_000:9_000] + "x" * 700_000 + part[100_000:150_000] + "".join(rnd.choice("ab") for _ in range(400_000))
    rows = [*documents(spark, sf_dir), (10_000, long), (10_001, part[:120_000] + "tail")]
    got = by_id(suffix_dedup.remove_repeats(spark.createDataFrame(rows, table.schema), whole=False, part_bytes=300_000))
    for i, want in brute.repeats(rows).items():
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want


def test_suffix_order_checks_bytes(monkeypatch):
    """With hashes that all collide the strings are told apart by their bytes."""
    import numpy as np

    text = [b"abcdefgh" * 3 + b"XY" + b"ijklmnop" * 2, b"bbcdefgh" + b"abcdefgh" * 2 + b"XY" + b"ijklmnop" * 2, b"abcdefgh" * 3 + b"XY" + b"ijklmnop" * 2]
    data = np.frombuffer(b"".join(text), np.uint8)
    offsets = np.cumsum([0, *map(len, text)])
    want = suffix_dedup.resolve(np.zeros(3, np.int64), data, offsets, np.array([24, 24, 24]), 30, np.arange(3))
    monkeypatch.setattr(suffix_dedup, "mixed", lambda x: np.zeros(len(x), np.uint64))
    got = suffix_dedup.resolve(np.zeros(3, np.int64), data, offsets, np.array([24, 24, 24]), 30, np.arange(3))
    plain = set()
    seen: set = set()
    for k, t in enumerate(text):
        for a in range(25):
            s = t[a : a + 30]
            if len(s) == 30 and a <= 24 <= a + 30:
                if s in seen:
                    plain.add((k, a))
                seen.add(s)
    as_set = lambda x: set(zip(x[0].tolist(), x[1].tolist(), strict=True))
    assert as_set(want) == as_set(got) == plain


def test_line_dedup(spark, sf_dir):
    got = by_id(QUERIES["op4_line_dedup"](spark, sf_dir))
    want = brute.lines(documents(spark, sf_dir))
    assert sum(w[1] for w in want.values()) > 0
    for i, w in want.items():
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) == w


def test_line_dedup_streams_first_occurrences_of_a_sort(spark, sf_dir):
    keys = spark.createDataFrame([(1, 2, 3, 4, k) for k in range(3)] + [(1, 2, 5, 6, 9)], "h long, g long, id long, body long, pos int")
    first = line_dedup.first_occurrences(keys)
    assert sorted(tuple(r) for r in first.collect()) == [(1, 2, 3, 0), (1, 2, 5, 9)]
    plan = first._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == plan.count("Exchange rangepartitioning(h") == 1
    assert plan.count("Sort [h") == 1 and "Window" in plan


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_line_dedup_with_and_without_broadcast(spark, sf_dir, most):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = by_id(line_dedup.drop_shared_lines(table, broadcast_bytes=most))
    for i, w in brute.lines(documents(spark, sf_dir)).items():
        assert (got[i].n_lines, got[i].n_dropped, brute.sha(got[i].kept_text or "")) == w


def test_sharding(spark, sf_dir):
    rows = QUERIES["op5_sharding"](spark, sf_dir).collect()
    text = dict(documents(spark, sf_dir))
    assert len(rows) == len(text)
    shard_of, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        assert r.size == len((text[r.doc_id] or "").encode()) + 8 and r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
        shard_of[text[r.doc_id] or ""].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(len(x) == 1 for x in shard_of.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    groups = Counter()
    for r in rows:
        groups[text[r.doc_id] or ""] += r.size
    assert max(load.values()) <= max(max(groups.values()), sum(groups.values()) / 24 * 4 / 3 + max(groups.values()))


def test_longest_first():
    assert sharding.longest_first([(1, 5), (2, 4), (3, 3), (4, 3), (5, 3)], 2) == {1: 0, 2: 1, 3: 1, 4: 0, 5: 1}


def test_sharding_is_plain_scheduling(spark):
    """Every group goes through the heap by its own size."""
    path = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    size, least = Counter(), {}
    for i, t in texts.items():
        size[t] += len(t.encode()) + 8
        least[t] = min(i, least.get(t, i))
    load, shard_of = [0] * 24, {}
    for t in sorted(size, key=lambda t: (-size[t], least[t])):
        k = load.index(min(load))
        shard_of[t] = k
        load[k] += size[t]
    assert {r.doc_id: r.shard for r in QUERIES["op5_sharding"](spark, path).collect()} == {i: shard_of[t] for i, t in texts.items()}


def test_sharding_with_a_bundled_tail(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = sharding.assign_shards(docs, groups=50, bundles=64).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    shard_of, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        shard_of[text[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert len(rows) == len(text) and all(len(x) == 1 for x in shard_of.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(load.values()) < 1.2 * sum(load.values()) / 24


def test_quality_rules(spark, sf_dir):
    got = by_id(QUERIES["op6_quality_rules"](spark, sf_dir))
    for i, text in documents(spark, sf_dir):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_counts(text)
        assert not (r.kept and r.base_failed)


def test_texts_without_common_words_go(spark):
    import random

    rnd = random.Random(3)
    names = [f"{a}{b}{c}" for a in ("bar", "col", "den", "fir") for b in ("a", "e", "i", "o") for c in ("ming", "ton", "lar", "sen")]
    clean = [" ".join(rnd.choice(quality.COMMON["en"]) if rnd.random() < 0.25 else rnd.choice(names) for _ in range(n)) for n in (60, 90, 150, 400) * 10]
    junk = [" ".join(rnd.choice(names) for _ in range(n)) for n in (55, 200)]
    short = "the barton of colsen"
    rows = [(k, t, "en") for k, t in enumerate([*clean, *junk, short])]
    rows += [(100 + k, " ".join(rnd.choice(names) for _ in range(90)), "xx") for k in range(3)]  # a language whose common words nobody has listed
    kept = {r.doc_id for r in quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert kept == {*range(len(clean)), 100, 101, 102}


def test_jaccard_join(spark, sf_dir):
    got = by_id(QUERIES["op7_jaccard_join"](spark, sf_dir))
    want = brute.near(documents(spark, sf_dir))
    assert any(w[1] for w in want.values())
    for i, (label, links) in want.items():
        assert (got[i].class_id, got[i].n_links) == (label, links), i


def test_jaccard_join_in_blocks(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = by_id(jaccard.near_duplicates(table, block_docs=2, node_docs=2))
    for i, (label, links) in brute.near(documents(spark, sf_dir)).items():
        assert (got[i].class_id, got[i].n_links) == (label, links), i


def test_prefixes_shorten_until_recall(spark):
    """Each document reaches the recall, deep prefixes stay in crowded nodes, and documents of a node share it."""
    import math

    import numpy as np

    rnd = np.random.default_rng(4)
    base = rnd.integers(1, 60_000, jaccard.HASHES)
    rows = []
    for k in range(60):  # alike in the tries of the first 96 hashes
        sig = rnd.integers(1, 60_000, jaccard.HASHES)
        sig[:96] = base[:96]
        rows.append((k, sig.astype(np.uint16).tobytes()))
    for k in range(60, 66):  # few, alike in some of the others
        sig = rnd.integers(1, 60_000, jaccard.HASHES)
        sig[96:120] = base[96:120]
        rows.append((k, sig.astype(np.uint16).tobytes()))
    found = jaccard.forest(spark.createDataFrame(rows, "cid long, sig binary")).collect()
    least = jaccard.shortest_prefix()
    assert least == 3
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r.cid].append(r)
        assert least <= r.depth <= r.own <= jaccard.DEPTH
    assert len({r.own for r in found}) > 1  # not one depth for all
    for own in by_doc.values():
        missed = sum(math.log1p(-(0.8**r.own)) for r in own) + (jaccard.TREES - len(own)) * math.log1p(-(0.8**least))
        assert missed <= math.log1p(-jaccard.RECALL) + 1e-9
    nodes = defaultdict(set)
    for r in found:
        nodes[r.node].add((r.depth, r.c))
    assert all(len(x) == 1 for x in nodes.values())


def test_forest_finds_what_exact_pairs_are(spark):
    """Recall over pairs of random sets at the threshold and just above."""
    import numpy as np

    rnd = np.random.default_rng(8)
    sets, pairs = [], []
    for k in range(300):
        one = rnd.integers(0, 2**63, 100, dtype=np.uint64)
        two = one.copy()
        two[: 11 if k % 2 else 8] = rnd.integers(0, 2**63, 11 if k % 2 else 8, dtype=np.uint64)  # 0.80 and 0.85
        sets += [one, two]
        pairs.append((2 * k, 2 * k + 1))
    sig = jaccard.signatures(np.concatenate(sets), np.arange(0, 100 * len(sets) + 1, 100))
    met = defaultdict(set)
    for r in jaccard.forest(spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(sig)], "cid long, sig binary")).collect():
        met[r.node].add(r.cid)
    found = {p for p in pairs for x in met.values() if set(p) <= x}
    assert len(found) == len(pairs)


def test_keep_one_by_row(spark):
    docs = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (2, "y"), (3, ""), (3, ""), (4, None), (None, "z"), (None, "z"), (5, "Z!")], "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(docs).collect()), key=str)
    assert kept == sorted([(1, "x"), (2, "y"), (3, ""), (4, None), (None, "z")], key=str)
    assert sorted(((r.doc_id, r.text) for r in jaccard.keep_one(docs, broadcast_bytes=0).collect()), key=str) == kept


def test_secret_scan(spark, sf_dir):
    got = by_id(QUERIES["op8_secret_scan"](spark, sf_dir))
    for i, text in documents(spark, sf_dir):
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute.secrets(text)
    assert any(r.n_assign and "jwt:" in r.spans for r in got.values())


def test_secret_ledger(spark, tmp_path):
    old = spark.createDataFrame([(1, "token=abcdefgh99"), (2, "clean")], "doc_id long, text string")
    new = spark.createDataFrame([(3, "token=abcdefgh99"), (4, "secret: zyxwvuts11"), (5, None)], "doc_id long, text string")
    _, ledger = secrets.find_secrets(old)
    assert ledger.count() == 2
    addresses = secrets.addressed(new)
    fresh = secrets.scan_unseen(new, addresses, ledger)
    assert fresh.count() == 2  # what doc 3 holds is known
    found, whole = secrets.find_secrets(new, ledger)
    assert whole.count() == 4
    assert {r.path: len(r.spans) for r in found.collect()} == {3: 1, 4: 1, 5: 0}
    other = [*secrets.RULES[:-1], secrets.Rule("pem", "-----BEGIN [A-Z ]*KEY-----")]
    assert secrets.scan_unseen(new, addresses, whole, rules=other).count() == 3  # other rules see all contents anew


def test_secret_ledger_as_commits(spark, tmp_path):
    """Of each version only what no commit holds is scanned; an unfinished commit does not count."""
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.read() is None
    one = spark.createDataFrame([(1, "token=abcdefgh99"), (2, "clean")], "doc_id long, text string")
    two = one.union(spark.createDataFrame([(3, "token=abcdefgh99"), (4, "secret: zyxwvuts11")], one.schema))
    ledger.scan(one)
    got = {r.path: [tuple(s) for s in r.spans] for r in ledger.scan(two).collect()}
    assert [spark.read.parquet(c).count() for c in ledger.commits()] == [2, 1]
    assert got == {1: [(0, 0, 16, "assign")], 2: [], 3: [(0, 0, 16, "assign")], 4: [(0, 0, 18, "assign")]}
    (tmp_path / "ledger" / "commit-000002-x").mkdir()
    assert len(ledger.commits()) == 2
    ledger.scan(two)
    assert spark.read.parquet(ledger.commits()[-1]).count() == 0


def test_secrets_of_ones_own_rules(spark):
    rules = [secrets.Rule("slack", "xox[bp]-[a-z]+"), *secrets.RULES]
    docs = spark.createDataFrame([(1, "see xoxb-abc here"), (2, "x token=abcdefgh99"), (3, "none")], "doc_id long, text string")
    found = {r.path: [s.kind for s in r.spans] for r in secrets.find_secrets(docs, rules=rules)[0].collect()}
    assert found == {1: ["slack"], 2: ["assign"], 3: []}
    assert secrets.rule_version(rules) != secrets.rule_version(secrets.RULES) != secrets.rule_version(secrets.RULES[::-1])


def test_piece_codec(spark, sf_dir):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=piece_codec.vocabulary())
    got = by_id(QUERIES["op9_piece_codec"](spark, sf_dir))
    for i, text in documents(spark, sf_dir):
        ids = lib.encode(text or "", add_bos=True, add_eos=True)
        r = got[i]
        assert r.agenda_agrees and r.n_tokens == len(ids)
        assert r.ids_sha256 == brute.sha(b"".join(x.to_bytes(4, "little") for x in ids)) and r.decoded_sha256 == brute.sha(lib.decode(ids))


def test_decontaminate(spark, sf_dir):
    got = by_id(QUERIES["op10_decontaminate"](spark, sf_dir))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = brute.passages(documents(spark, sf_dir), items)
    assert any(w[4] for w in want.values()) and not all(w[4] for w in want.values())
    for i, w in want.items():
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == w


def test_equal_items_are_one(spark):
    docs = spark.createDataFrame([(1, "the " * 1000), (2, "one two three")], "doc_id long, text string")
    items = spark.createDataFrame([(k, "THE" if k % 2 else "the!") for k in range(300)] + [(900, "two three")], "item_id long, text string")
    got = by_id(decontaminate.find_passages(docs, items))
    assert len(got[1].matches) == 1000 and got[1].item_ids == sorted(str(k) for k in range(300)) and got[1].hit_runs == [(0, 999)]
    assert got[2].item_ids == ["900"] and [tuple(m) for m in got[2].matches] == [("900", 0, 1, 2)]


def test_suffix_array_is_sorted(spark):
    import numpy as np

    rnd = np.random.default_rng(5)
    words = rnd.integers(1, 4, 300).astype(np.uint64)
    first = np.array([0, 0, 120, 121, 300])
    array = decontaminate.SuffixArray(words, first)
    end = np.repeat(first[1:], np.diff(first))
    cut = lambda p: tuple(words[p : min(p + 16, end[p])].tolist())
    assert [cut(p) for p in array.order.tolist()] == sorted(cut(p) for p in range(300))
    tests = np.array([(*cut(7)[:10],), (1, 2, 3, 0, 0, 0, 0, 0, 0, 0), (9,) * 10], np.uint64)
    lengths = np.array([10, 3, 10])
    assert array.begin(tests, lengths).tolist()[:1] == [0] and 2 not in array.begin(tests, lengths)
    lower, upper = array.search(tests, lengths)
    for t, n, a, b in zip(tests.tolist(), lengths.tolist(), lower, upper, strict=True):
        assert sorted(array.order[a:b].tolist()) == [p for p in range(300) if cut(p)[:n] == tuple(t[:n])]


def test_decontaminate_in_blocks(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one, many = (by_id(decontaminate.find_passages(table, items, block_bytes=b)) for b in (1 << 20, 90))
    for i, r in one.items():
        assert r.hit_runs == many[i].hit_runs and sorted(r.matches) == sorted(many[i].matches)


def test_language_id(spark):
    path = "/root/testdata/sf0.01"
    rows = QUERIES["op3_language_id"](spark, path).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and 0.15 < len(held) / len(rows) < 0.35
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98


def test_language_forward_sums_all_segmentations():
    import numpy as np

    path = language_id.vocabulary()
    pieces = language_id.Pieces(path)
    rnd = np.random.default_rng(1)
    chances = rnd.random((len(pieces.text), 2)) / 100
    number = {p: k for k, p in enumerate(pieces.text)}
    word = "▁there"

    def total(s: str, k: int) -> float:
        if not s:
            return 1.0
        return sum(chances[number[s[:n]], k] * total(s[n:], k) for n in range(1, min(len(s), language_id.LONGEST) + 1) if s[:n] in number) + language_id.STRANGE * total(s[1:], k)

    low = np.array([ord(c) for c in word[1:]], np.uint32)
    got = language_id.Scorer(path, chances).words(low, np.array([0]), np.array([len(low)]))[0]
    assert np.allclose(np.exp(got), [total(word, 0), total(word, 1)])


def test_language_of_all_rows_by_brute_force(spark, docs, rows):
    """Every row's score by summing segmentations word by word with logarithms, from the same probabilities."""
    import math
    import re
    import unicodedata

    import numpy as np

    path = language_id.vocabulary()
    counts = [(lang, w, n) for lang, text in (("en", "the of and alder birch cedar hazel one token"), ("fr", "les des été maple juniper larch élan")) for n, w in enumerate(text.split(), 1)]
    langs, chances = language_id.fit(path, counts)
    number = {p: k for k, p in enumerate(language_id.pieces_of(path).text)}
    logs = np.log(chances)

    def word(w: str) -> np.ndarray:
        s = "\u2581" + w
        at = np.full((len(s) + 1, len(langs)), -np.inf)
        at[0] = 0
        for end in range(1, len(s) + 1):
            parts = [at[end - 1] + math.log(language_id.STRANGE)]
            parts += [at[end - n] + logs[number[s[end - n : end]]] for n in range(1, min(end, language_id.LONGEST) + 1) if s[end - n : end] in number]
            at[end] = np.logaddexp.reduce(parts, axis=0)
        return at[len(s)]

    inside = lambda c: c.isalpha() or 0x300 <= ord(c) < 0x3000 and unicodedata.category(c) in ("Mn", "Mc")
    odd = [(900, "ü" * 400, "de"), (901, "schschsch" * 200, None), (902, "the" * 1700, "en"), (903, "les " * 3, "fr")]
    more = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string")).coalesce(1)
    made = language_id.predict(more, counts, path).collect()
    assert len(made) == len(rows) + len(odd)
    for r in made:
        text = "".join((c.lower() if len(c.lower()) == 1 else c) if inside(c) else " " for c in r.text or "")
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = sum(word(w) for w in re.split(" +", text) if w)
        share = np.exp(total - np.logaddexp.reduce(total))
        assert r.lang_pred == langs[int(share.argmax())] and abs(r.score - share.max()) < 1e-6


def test_language_of_texts_after_a_long_run_of_letters(spark):
    counts = [("en", w, 900) for w in ("the", "house", "and", "where", "thehouseandwhere")] + [("de", w, 900) for w in ("der", "haus", "und", "woher", "derhausundwoher")]
    long = "derhausundwoher" * 250
    texts = ["the house", long, "the house and where", "der haus und woher", None, "12 34", "..."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in language_id.predict(docs, counts, language_id.vocabulary()).collect()}
    assert [got[k].lang_pred for k in range(7)] == ["en", "de", "en", "de", "und", "und", "und"]
    alone = {r.doc_id: r for r in language_id.predict(docs.filter("doc_id <> 1"), counts, language_id.vocabulary()).collect()}
    assert all(got[k].score == alone[k].score for k in alone)


def test_language_uses_all_letter_pieces_and_no_cuts(monkeypatch):
    import numpy as np
    import sentencepiece

    path = language_id.vocabulary()
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    every = [lib.id_to_piece(i) for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
    pieces = language_id.pieces_of(path)
    assert {p.lower() for p in every if p.lstrip("▁").isalpha()} <= set(pieces.text) and "▁government" in pieces.text
    chances = np.random.default_rng(2).random((len(pieces.text), 2)) / 100
    low = np.array([ord(c) for c in "governmentinformation" * 9], np.uint32)
    whole = language_id.Scorer(path, chances).words(low, np.array([0]), np.array([len(low)]))
    for part in (25, 63, 188):
        monkeypatch.setattr(language_id, "PART", part)
        assert np.allclose(language_id.Scorer(path, chances).words(low, np.array([0]), np.array([len(low)])), whole, rtol=1e-12)


# ---------------------------------------------------------------- any rows, any columns


def test_operators_take_any_rows(spark, docs, none, rows, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    counts = [("en", "the", 5), ("fr", "les", 4)]
    calls = {
        "suffix": lambda d: suffix_dedup.remove_repeats(d),
        "lines": lambda d: line_dedup.drop_shared_lines(d),
        "shards": lambda d: sharding.assign_shards(d),
        "quality": lambda d: quality.judge(d),
        "near": lambda d: jaccard.near_duplicates(d),
        "secrets": lambda d: secrets.find_secrets(d)[0],
        "pieces": lambda d: piece_codec.encode_decode(d, piece_codec.vocabulary()),
        "passages": lambda d: decontaminate.find_passages(d, bench),
        "language": lambda d: language_id.predict(d, counts, language_id.vocabulary()),
    }
    for name, call in calls.items():
        made = call(docs)
        assert made.count() == len(rows), name
        assert len(set(made.columns)) == len(made.columns), name
        assert call(none).count() == 0, name
    assert decontaminate.find_passages(docs, bench.limit(0)).filter("size(matches) > 0").count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, [], language_id.vocabulary()).collect()} == {"und"}
    assert {r.lang_pred for r in calls["language"](docs).filter("text is null or text = ''").collect()} == {"und"}


def test_columns_with_names_of_helpers_stay(spark, docs, rows, sf_dir):
    """No operator that gives back the columns of docs touches one that only has the name of something it uses."""
    from .conftest import CLASHES

    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    calls = {
        "suffix": (suffix_dedup.remove_repeats, ["spans", "kept"]),
        "lines": (line_dedup.drop_shared_lines, []),
        "quality": (quality.judge, ["n_words", "base_failed", "kept"]),
        "good": (quality.keep_good, []),
        "near": (jaccard.keep_one, []),
        "pieces": (lambda d: piece_codec.encode_decode(d, piece_codec.vocabulary()), []),
        "passages": (lambda d: decontaminate.find_passages(d, bench), ["n_words"]),
        "clean": (lambda d: decontaminate.decontaminate(d, bench), []),
        "language": (lambda d: language_id.predict(d, [("en", "the", 5), ("fr", "les", 4)], language_id.vocabulary()), []),
    }
    value = dict(zip(CLASHES, range(100, 100 + len(CLASHES)), strict=True))
    for name, (call, replaced) in calls.items():
        made = call(docs).collect()
        assert made, name
        for r in made:
            assert all(r[c] == v for c, v in value.items() if c not in replaced), name
    # shards, near copies and secrets give rows of their own
    assert sharding.assign_shards(docs).count() == jaccard.near_duplicates(docs).count() == secrets.find_secrets(docs)[0].count() == len(rows)


def test_a_very_long_text(spark, sf_dir):
    """20 MB of text among others: right results, in parts where arrays would be several times as long."""
    import random

    rnd = random.Random(2)
    words = [f"w{rnd.randint(0, 10**6)}" for _ in range(60_000)]
    long = "\n".join(" ".join(words[k : k + 12]) for k in range(0, 60_000, 12))
    period, times = len(long) + 1, 20_000_000 // len(long)
    long = (long + " ") * times
    small = long[1000:2500]
    docs = spark.createDataFrame([(1, "the small text"), (2, long), (3, small), (4, None)], "doc_id long, text string").repartition(4).cache()
    docs.count()
    bench = spark.createDataFrame([(7, " ".join(words[500:530]))], "item_id long, text string")
    raw = long.encode()
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, whole=False).collect()}
    assert got[2].n_bytes == len(raw) and got[2].n_removed >= len(raw) - period - 200 and got[3].n_removed > 0
    found = {r.doc_id: r for r in decontaminate.find_passages(docs, bench).collect()}
    assert found[2].item_ids == ["7"] and len(found[2].hit_runs) == len(found[2].matches) == times and not found[3].hit_runs
    near = {r.doc_id: r for r in jaccard.near_duplicates(docs).collect()}
    assert near[2].n_links == 0 and near[2].class_id == 2
    said = {r.doc_id: r for r in language_id.predict(docs, [("en", "the", 5), ("fr", "les", 4)], language_id.vocabulary()).collect()}
    assert said[2].lang_pred in ("en", "fr") and said[4].lang_pred == "und"


def test_repeated_rows_get_equal_results(docs):
    same = lambda made, *out: [tuple(r[c] for c in out) for r in made.filter("doc_id = 9").collect()]
    assert len(set(same(suffix_dedup.remove_repeats(docs, whole=False), "text", "kept_sha256"))) == 1
    assert len(set(same(line_dedup.drop_shared_lines(docs), "kept_text"))) == 1
    links = same(jaccard.near_duplicates(docs), "class_id", "n_links")
    assert len(links) == 3 and len(set(links)) == 1 and links[0][1] >= 2


def test_filters_keep_columns(docs, spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for made in (quality.keep_good(docs), jaccard.keep_one(docs), decontaminate.decontaminate(docs, bench)):
        assert made.columns == docs.columns and made.count() < docs.count()


def test_quality_with_more_languages_than_go_to_all_tasks(spark, sf_dir, monkeypatch):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = {r.doc_id: tuple(r) for r in quality.judge(table).collect()}
    monkeypatch.setattr(quality, "BROADCAST_LANGUAGES", 1)
    assert {r.doc_id: tuple(r) for r in quality.judge(table).collect()} == one
