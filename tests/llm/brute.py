"""The same results by plain loops over all rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

SPACE = " \t\n\x0b\f\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(UPPER))


def repeats(docs: list[tuple]) -> dict:
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def lines(docs: list[tuple]) -> dict:
    key = lambda x: x.strip(SPACE).translate(UPPER)
    holders = defaultdict(set)
    for i, text in docs:
        for x in (text or "").split("\n"):
            holders[key(x)].add(i)
    out = {}
    for i, text in docs:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and max(holders[key(x)]) != i)]
        out[i] = (len(all_lines), len(all_lines) - len(kept), sha("\n".join(kept)))
    return out


def shingle_sets(docs: list[tuple]) -> dict:
    out = {}
    for i, text in docs:
        w = words(text)
        out[i] = frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def near(docs: list[tuple], similarity: float = 0.8) -> dict:
    """doc -> (class, links)."""
    sets, text = shingle_sets(docs), dict(docs)
    parent, links = {i: i for i in sets}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        one, two = sets[a], sets[b]
        alike = len(one & two) >= similarity * len(one | two) - 1e-9 if one and two else bool(text[a]) and text[a] == text[b]
        if alike:
            links[a] += 1
            links[b] += 1
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (root(i), links[i]) for i in sets}


def passages(docs: list[tuple], items: list[tuple]) -> dict:
    windows = defaultdict(set)
    for i, text in items:
        w = words(text)
        k = min(10, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[p : p + k])].add("" if i is None else str(i))
    sizes = {len(x) for x in windows}
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                if got := windows.get(tuple(w[p : p + k])):
                    hit |= set(range(p, p + k))
                    found |= got
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def base_counts(text: str | None) -> tuple:
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    rep = {k + j for k in range(len(w) - 2) if tri[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
    seen = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(seen) - len(set(seen)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


SECRETS = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)]


def secrets(text: str | None) -> tuple:
    found = [(m.start(), k, m.end(), kind) for k, (kind, pattern, group, least) in enumerate(SECRETS) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    n = Counter(x[3] for x in found)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)))
