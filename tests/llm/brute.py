"""Plain one-process versions that the operators are compared with."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def removed_bytes(docs, length=100):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256) of (doc_id, text) rows with unique ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            piece = hashlib.blake2b(data[i : i + length], digest_size=12).digest()
            if piece in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, k=3):
    words = WORD.findall(low(text or ""))
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def linked_components(docs, percent=90, k=3):
    """doc_id -> (n_shingles, component) of (doc_id, text) rows, every pair compared."""
    sets = [(d, shingles(t, k)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)):
                common = len(s & t)
                if 100 * common >= percent * (len(s) + len(t) - common):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets}


def leaked_items(text, items, overlap=0.5):
    """Ids of items of which both halves stand in the text to that share of their three-word runs, within one passage."""
    split = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
    words = [low(w) for w in split.findall(text or "")]
    have = {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
    out = []
    for item, said in items:
        mine = [low(w) for w in split.findall(said or "")]
        half = (len(mine) + 1) // 2
        parts = [[tuple(p[i : i + 3]) for i in range(len(p) - 2)] for p in (mine[:half], mine[half:])]
        if mine and all(not p or sum(g in have for g in p) / len(p) >= overlap for p in parts) and any(parts):
            out.append(item)
    return out


def grams(text):
    """Counts of one to three letters of a text, words padded with a blank on both sides."""
    counts = {}
    line = " " + "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text) + " "
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            g = line[i : i + n]
            if (n == 1 and g != " ") or (n == 2 and g != "  ") or (n == 3 and g[1] != " "):
                counts[g] = counts.get(g, 0) + 1
    return counts
