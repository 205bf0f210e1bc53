"""Plain versions of the operators' contracts, to test against."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    tri = list(zip(w, w[1:], w[2:]))
    c = Counter(tri)
    rep = {i + k for i, t in enumerate(tri) if c[t] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(s) for s in "#*$%&|<>"), dup, len(rep), failed


def _luhn(d):
    s = 0
    for k, x in enumerate(map(int, reversed(d))):
        s += x if k % 2 == 0 else sum(divmod(2 * x, 10))
    return s % 10 == 0


def pii(text):
    text = text or ""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = []
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and _luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ):
        out += [(kind, *m.span()) for m in re.finditer(pattern, text) if ok(m[0])]
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in out)
    n = Counter(k for k, _, _ in out)
    return n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined.encode()).hexdigest(), {f"{k}:{a}:{b}" for k, a, b in out}


def shingle_set(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(t)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(docs):
    sets = {i: shingle_set(t) for i, t in docs}
    by, links = {}, []
    for i, s in sorted(sets.items()):
        near = Counter()
        for x in s:
            for j in by.setdefault(x, []):
                near[j] += 1
            by[x].append(i)
        links += [(i, j) for j, c in near.items() if 100 * c >= 75 * (len(s) + len(sets[j]) - c)]
    comp = components(sets, links)
    return {i: (len(sets[i]), comp[i]) for i in sets}
