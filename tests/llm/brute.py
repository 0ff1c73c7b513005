"""Plain Python answers for small inputs, written from the contracts."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    kinds = ["assign", "access", "hex"]
    said = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return [sum(k == i for _, k, _ in spans) for i in range(3)] + [hashlib.sha256(said.encode()).hexdigest(), said]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def fingerprint(text, width=3):
    w = words(lower(text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def components(values, linked):
    """Root (smallest index) of each of the values under linked(a, b)."""
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(win)
    covered = {i + k for i, x in enumerate(win) if n[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}


def license_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    at = sorted((i, k) for k, p in PHRASES.items() for q in [p.split()] for i in range(len(w)) if w[i : i + len(q)] == q)
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({k for _, k in at}))


def crc_ids(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
