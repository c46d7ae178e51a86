"""Plain versions of the operators, to test against."""

import hashlib
import re
from collections import defaultdict


def sha(b):
    return hashlib.sha256(b).hexdigest()


def key(doc_id):
    return 2**63 - 1 if doc_id is None else doc_id


def repeated(units, width):
    """units: (id, sequence). For each row the set of positions covered by a window of a smaller id."""
    least = {}
    for d, s in units:
        for i in range(len(s) - width + 1):
            w = s[i : i + width] if isinstance(s, bytes) else tuple(s[i : i + width])
            least[w] = min(least.get(w, key(None) + 1), key(d))
    out = []
    for d, s in units:
        hit = set()
        for i in range(len(s) - width + 1):
            w = s[i : i + width] if isinstance(s, bytes) else tuple(s[i : i + width])
            if least[w] < key(d):
                hit.update(range(i, i + width))
        out.append(hit)
    return out


def op1(rows):
    units = [(d, (t or "").encode()) for d, t in rows]
    out = []
    for (d, b), hit in zip(units, repeated(units, 50)):
        rest = bytes(c for i, c in enumerate(b) if i not in hit)
        out.append((d, len(b), len(hit), sum(i - 1 not in hit for i in hit), sha(rest)))
    return out


def op3(rows):
    units = [(d, (t or "").encode().split()) for d, t in rows]
    out = []
    for (d, w), hit in zip(units, repeated(units, 13)):
        out.append((d, len(w), len(hit), sha(b" ".join(x for i, x in enumerate(w) if i not in hit))))
    return out


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def op2(docs, bench):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in bench:
        w = word.findall(lower(text))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for d, text in docs:
        w = word.findall(lower(text))
        hit, items = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    items |= found
        out.append((d, len(w), len(hit), len(items), sha(",".join(sorted(items)).encode()), bool(hit)))
    return out


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def op4(text):
    """Base spans as (start, end, kind)."""
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    order = ("email", "ip", "card", "phone")
    return sorted(out, key=lambda s: (s[0], order.index(s[2])))


def op5(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = defaultdict(list)
    for i in range(len(words) - 4):
        seen[tuple(words[i : i + 5])].append(i)
    again = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), n < 10 or 100 * len(again) > 20 * n)


def mcd(x, floors, share, median):
    """Squared distances by a plain minimum-covariance-determinant estimate: subsets of exact size, until they stay the same."""
    import numpy as np

    n, p = x.shape
    h = int(np.ceil(n * share))
    middle = np.sort(x, axis=0)[(n - 1) // 2]
    off = np.abs(x - middle)
    scaled = off / np.maximum(1.4826 * np.sort(off, axis=0)[(n - 1) // 2], floors)
    best = None
    for order in ((scaled**2).sum(1), scaled.max(1), scaled.sum(1)):
        chosen = np.argsort(order, kind="stable")[:h]
        while True:
            mean = x[chosen].mean(0)
            spread = np.cov(x[chosen].T, bias=True).reshape(p, p) + np.diag(np.square(floors))
            d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(spread), x - mean)
            again = np.argsort(d2, kind="stable")[:h]
            if set(again) == set(chosen):
                break
            chosen = again
        if best is None or np.linalg.det(spread) < best[0]:
            best = (np.linalg.det(spread), d2)
    return best[1] / np.sort(best[1])[(n - 1) // 2] * median


def fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def op6(rows):
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key(None)), key(d))
    return [(d, f"{p:016x}", None if least[find(i)] == key(None) else least[find(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints))]
