"""Plain-Python versions of what the operators must return, for small tables."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda b: hashlib.sha256(b).hexdigest()


def roots(nodes, links):
    """Node -> smallest node reachable."""
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def repeats(docs, length=100):
    seen, out = set(), {}
    for doc, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(w)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[doc] = (len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return out


def contamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= x
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found))).encode()), bool(hit))
    return out


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)])


def near_copies(docs):
    sets = {d: shingles(t) for d, t in docs}
    by, links = defaultdict(set), set()
    for d, s in sets.items():
        for x in s:
            by[x].add(d)
    for d, s in sets.items():
        count = defaultdict(int)
        for x in s:
            for o in by[x]:
                if o < d:
                    count[o] += 1
        links |= {(o, d) for o, c in count.items() if 100 * c >= 80 * (len(s) + len(sets[o]) - c)}
    root = roots(sets, links)
    return {d: (len(s), root[d], root[d] == d) for d, s in sets.items()}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def personal(docs):
    out = {}
    for doc, text in docs:
        found = {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m[0])] for k, (p, ok) in BASE.items()}
        flat = ",".join(f"{k}:{a}:{b}" for k, x in found.items() for a, b in x)
        out[doc] = (*(len(x) for x in found.values()), sha(flat.encode()), flat)
    return out


def vectors(rows, least=0.95):
    good = {i: v for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in good.items()}
    ids = sorted(unit)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(unit[a]) == len(unit[b]) and sum(x * y for x, y in zip(unit[a], unit[b], strict=True)) >= least]
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    root = roots([i for i, _ in rows], links)
    return {i: (n[i], root[i], root[i] == i) for i, _ in rows}


def pages(rows):
    last = {}
    for page, html in rows:
        raw = (html or "").encode()
        last[raw] = max(last.get(raw, page), page)
    out = {}
    for page, html in rows:
        raw = (html or "").encode()
        own = last[raw] == page
        out[page] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own else "revisit", None if own else last[raw])
    return out
