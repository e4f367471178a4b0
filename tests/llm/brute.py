"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def repeats(rows):
    """(doc_id, text) to doc_id -> (bytes, removed, runs, the bytes left); a null id is the least, equal ids are one."""
    first, order = {}, lambda d: (d is not None, d or 0)
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], order(d)), order(d))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < order(d):
                gone[i : i + 50] = b"\1" * 50
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()


def groups(rows, percent):
    """(doc_id, text) to doc_id -> (size of its set, least doc_id that links reach)."""
    sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := lowered(t)) else frozenset() for d, t in rows if d is not None}
    parent = {d: d for d in sets}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def grams(text):
    """N-grams of one to three characters of the words of letters, their edges marked."""
    out = collections.Counter()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        w = f"\1{w}\1"
        out.update(w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if n > 1 or w[i] != "\1")
    return out


def ranking(counts):
    return {g: k for k, g in enumerate(sorted(counts, key=lambda g: (-counts[g], len(g), g))[:300])}


def profiles(rows):
    """(text, lang) to lang -> rank of each n-gram."""
    counts = collections.defaultdict(collections.Counter)
    for t, lang in rows:
        if lang is not None:
            counts[lang].update(grams(t))
    return {lang: ranking(c) for lang, c in counts.items()}


def language(text, known):
    own = ranking(grams(text))
    if not own or not known:
        return "und", 0.0
    apart = {lang: sum(abs(r - theirs[g]) if g in theirs else 300 for g, r in own.items()) for lang, theirs in known.items()}
    best = min(sorted(apart), key=apart.get)
    return best, 1 - apart[best] / (300 * len(own))


def tiles(doc, item, least=5):
    used, done, out = [x == 0 for x in doc], [x == 0 for x in item], []
    while True:
        best, size = [], least
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not used[i + n] and not done[j + n]:
                    n += 1
                if n > size:
                    best, size = [(i, j)], n
                elif n == size:
                    best.append((i, j))
        if not best:
            return sorted(out)
        for i, j in best:
            if not any(used[i : i + size]) and not any(done[j : j + size]):
                used[i : i + size] = done[j : j + size] = [True] * size
                out.append((size, i, j))


def leaks(text, items, share=0.6):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    return [k for k, t in items if (w := words(t)) and sum(n for n, _, _ in tiles(words(text), w, min(5, len(w)))) >= share * len(w)]
