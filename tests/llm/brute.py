"""What the corpus operators compute, from the definitions alone."""

from __future__ import annotations

import re

from foldgraph.llm.pii_spans import luhn, ordered
from foldgraph.llm.winnow import SPAN, WORD, as_bytes


def pattern_spans(text):
    """The base spans of personal data by the four patterns as they are stated."""
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d or "1"), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), m.end(), kind))
    return ordered(out)


def contamination(text, items, span=SPAN):
    """``(n_words, n_hit, items found)`` of one text."""
    words, hit, names = WORD.findall(as_bytes(text)), set(), set()
    places = {}
    for name, t in items:
        item = WORD.findall(as_bytes(t))
        size = min(span, len(item))
        for q in range(len(item) - size + 1 if size else 0):
            places.setdefault(tuple(item[q : q + size]), set()).add(name)
    for size in {len(w) for w in places}:
        for s in range(len(words) - size + 1):
            if found := places.get(tuple(words[s : s + size])):
                hit.update(range(s, s + size))
                names |= found
    return len(words), len(hit), sorted(names)


def shingles(text, width=5):
    """The set of word shingles of a text, words apart by ASCII white space, A-Z lower-cased."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def similar_components(texts, width=5, least=0.8):
    """Smallest key reachable by links of Jaccard similarity, comparing all pairs; texts without words are alike."""
    sets = {k: shingles(t, width) for k, t in sorted(texts.items())}
    keys = list(sets)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if least * len(x) <= len(y) + 1e-9 and least * len(y) <= len(x) + 1e-9 and len(x & y) >= least * len(x | y) - 1e-9:
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return {k: find(k) for k in keys}
