"""Plain Python versions of the operators, and small tables with odd rows."""

from __future__ import annotations

import re
from collections import defaultdict


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0):
    """A documents table; a text may be an (id, text) pair."""
    rows = []
    for i, t in enumerate(texts, first):
        doc_id, text = t if isinstance(t, tuple) else (i, t)
        rows.append((doc_id, text, "en", "s", None if text is None else len(text)))
    return spark.createDataFrame(rows, DOCS)


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def jaccard_classes(rows, k, percent):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
        sets[doc_id] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by_shingle = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by_shingle[x].append(d)
    pairs = {(min(a, b), max(a, b)) for own in by_shingle.values() for a in own for b in own if a != b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def contaminated(texts, items, n=10):
    """[(n_words, hit word places, item ids)] for each text."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    windows = defaultdict(set)
    for item_id, text in items:
        w = words(text)
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[i : i + m])].add(item_id)
    out = []
    for t in texts:
        w = words(t)
        hit, owners = set(), set()
        for size in {len(g) for g in windows}:
            for i in range(len(w) - size + 1):
                if own := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    owners |= own
        out.append((len(w), hit, owners))
    return out


def base_spans(text):
    """The contract's patterns as they stand, failing matches dropped afterwards."""
    text = text or ""
    spans = []
    key = "(" + "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    for m in re.finditer(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for kind, order, pattern, least in (("access", 1, "AKIA[A-Z0-9]+", 18), ("hex", 2, "[0-9a-f]+", 16)):
        for m in re.finditer(pattern, text):
            if m.end() - m.start() >= least:
                spans.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(spans))
