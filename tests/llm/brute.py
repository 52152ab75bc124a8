"""Plain Python versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import xxhash

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in BLANK.split(text or "") if w]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def joined(n, links):
    parent = list(range(n))
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return [find(parent, i) for i in range(n)]


def simhash(docs, k=3):
    """doc_id -> (fingerprint, component) for (doc_id, text)."""
    prints = []
    for _, text in docs:
        w = words(lower(text or ""))
        grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    distinct = sorted(set(prints))
    place = {p: i for i, p in enumerate(distinct)}
    links = [(i, j) for i, a in enumerate(distinct) for j, b in enumerate(distinct[:i]) if (a ^ b).bit_count() <= 2]
    roots = joined(len(distinct), links)
    least = {}
    for (d, _), p in zip(docs, prints):
        r = roots[place[p]]
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, f"{p:016x}", least.get(roots[place[p]])) for (d, _), p in zip(docs, prints)]


ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def secrets(text):
    """Base spans as (start, kind rank, end, kind)."""
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def substring(docs, n=13):
    """(doc_id, n_words, n_removed, sha256 of what is kept) for docs with distinct ids."""
    first = {}
    split = {d: words(t) for d, t in docs}
    key = lambda d: (d is not None, d)
    for d, w in split.items():
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            first[g] = min(first.get(g, d), d, key=key)
    out = []
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - n + 1):
            if key(first[tuple(w[i : i + n])]) < key(d):
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def pieces(docs, tokenizer, capacity=2048):
    out = []
    for d, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for i, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start : start + capacity]
            out.append((d, i, start, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))))
    return out


def repeated_words(text, n=8):
    w = words(text)
    grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    many = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(n)})
