"""Plain versions of the operators, straight from their definitions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def op1(pages, rules):
    out = []
    for page, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = lower(re.split(r"[/?#]", rest)[0])
        path = re.split(r"[?#]", rest[len(host) :])[0]
        fit = [(len(h + p), len(h), v == "block", h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        out.append((page, host, path, best and best[3], "block" if best and best[2] else "allow"))
    return out


def op2(docs, size=50):
    first = {}
    for doc, text in docs:
        w = words(text)
        if doc is None:
            continue
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in docs:
        w = words(text)
        gone = set()
        for k in range(len(w) - size + 1):
            if doc is not None and first[tuple(w[k : k + size])] < doc:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, n=4):
    w = words(lower(text))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def op5(docs, n=4, t=(85, 100)):
    sets = [shingles(text, n) for _, text in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            having[x].append(k)
    shared = Counter()
    for group in having.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                shared[a, b] += 1
    for (a, b), n_shared in shared.items():
        if t[1] * n_shared >= t[0] * (len(sets[a]) + len(sets[b]) - n_shared):
            parent[root(a)] = root(b)
    least = {}
    for k, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(k)] = min(least.get(root(k), doc), doc)
    return [(doc, len(sets[k]), least.get(root(k))) for k, (doc, _) in enumerate(docs)]


def op7(docs):
    out = []
    for doc, text in docs:
        w = words(text)
        lines = [x for x in (text or "").split("\n") if words(x)]
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        out.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed))
    return out


def op8(docs, tokenizer, size=1024):
    out = []
    for doc, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((doc, piece, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))))
    return out


def distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i]
        for j, c in enumerate(text, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (p != c)))
    return min(row)
