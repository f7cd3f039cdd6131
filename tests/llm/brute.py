"""Plain versions of the text operators, for small tables."""

import hashlib
import itertools
import re

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(value):
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


def unite(ids, links):
    """Smallest id reachable by links."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def ngrams(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def ngram_join(rows, n=4, percent=85):
    """{id: (n_shingles, component)} by comparing all pairs that share an n-gram."""
    sets = {i: ngrams(t, n) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    both = {}
    for own in holders.values():
        for pair in itertools.combinations(sorted(own), 2):
            both[pair] = both.get(pair, 0) + 1
    links = [(a, b) for (a, b), k in both.items() if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k)]
    component = unite(sets, links)
    return {i: (len(s), component[i]) for i, s in sets.items()}


def cosines(rows, threshold=0.9):
    """{id: (n_links, component)} over all pairs."""
    sound = {}
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            sound[i] = x / np.sqrt((x * x).sum())
    links = [(a, b) for a, b in itertools.combinations(sorted(sound), 2) if len(sound[a]) == len(sound[b]) and sound[a] @ sound[b] >= threshold]
    component = unite([i for i, _ in rows], links)
    return {i: (sum(i in p for p in links), component[i]) for i, _ in rows}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_pii(text):
    """[(kind, start, end)] by start, then kind as listed."""
    text = text or ""
    out = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def alnum_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def contamination(docs, items, length=10):
    """{id: (n_words, n_hit, items)}"""
    windows = {}
    for item, text in items:
        words = alnum_words(text)
        size = min(length, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        words, hit, found = alnum_words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(words[i : i + size])]
        out[doc] = len(words), len(hit), sorted(found)
    return out


def line_dedup(rows, min_chars=10):
    """{id: (n_lines, n_dropped, kept)}"""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out[i] = len(lines), len(lines) - len(kept), "\n".join(kept)
    return out


def repeats(rows, size=400):
    """[(id, n_bytes, n_removed, n_spans, kept)]"""
    data = [(i, (t or "").encode()) for i, t in rows]
    count = {}
    for _, b in data:
        for p in range(len(b) - size + 1):
            count[b[p : p + size]] = count.get(b[p : p + size], 0) + 1
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if count[b[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, kept))
    return out


def licenses(text, templates, n=5, least=0.8):
    """Names of the templates of which some stretch as long as the template holds enough shingles."""
    def shingles(words):
        return [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []

    own, out = shingles(alnum_words(text)), set()
    for name, template in templates.items():
        want = set(shingles(alnum_words(template)))
        for i in range(len(own)):
            if len(want & set(own[i : i + len(want)])) >= least * len(want):
                out.add(name)
                break
    return out
