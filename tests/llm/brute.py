"""Plain-Python versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near_duplicates(docs):
    sets = {i: shingles(t) for i, t in docs}
    where = defaultdict(list)
    links = []
    for i in sorted(sets):
        met = defaultdict(int)
        for g in sets[i]:
            for j in where[g]:
                met[j] += 1
            where[g].append(i)
        links += [(i, j) for j, k in met.items() if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k)]
    comp = components(sets, links)
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def repeated_bytes(docs, length=100):
    """doc -> mask of removed bytes; docs in ascending order of id."""
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\x01" * length
            seen.add(w)
        out[i] = (b, bytes(gone))
    return out


def suffix_report(docs, length=100):
    out = {}
    for i, (b, g) in repeated_bytes(docs, length).items():
        kept = bytes(x for x, y in zip(b, g) if not y)
        out[i] = (len(b), sum(g), len(re.findall(b"\x01+", g)), sha(kept))
    return out


def repeated_words(docs, size=13):
    words = {i: WORD.findall(t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][k : k + size]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, y in zip(w, gone) if not y).encode()))
    return out


def draw(doc_id, text, seed="mix-1"):
    key = f"{seed}:{doc_id if doc_id is not None else text or ''}"
    return int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52


def mix(docs):
    """rows (doc_id, text, source) -> (size, source_size, target, taken) of each."""
    size = [len(WORD.findall(t or "")) for _, t, _ in docs]
    per = defaultdict(int)
    for (_, _, s), n in zip(docs, size):
        per[s] += n
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(per.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            level = 0.0
            break
        level = (1.5 * total - sum(2 * per[s] for s in capped)) / sum(weight[s] for s in free)
        new = {s for s in free if 2 * per[s] <= level * weight[s]}
        if not new:
            break
        capped |= new
    target = {s: min(2.0 * per[s], level * weight[s]) if s not in capped else 2.0 * per[s] for s in order}
    out = []
    for (i, t, s), n in zip(docs, size):
        rate = target[s] / per[s] if per[s] else 0.0
        copies = int(rate) + (draw(i, t) < rate - int(rate))
        out.append((n, per[s], target[s], copies * n))
    return out


def judge_url(url, rules, default="allow"):
    if not url or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = m[1].translate(LOWER), m[2]
    best = None
    for h, p, v in rules:
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or (len(h + p), len(h)) > (len(best[0]), best[2]):
                best = (h + p, v, len(h))
    return host, path, best and best[0], best[1] if best else default


# ---------------------------------------------------------------- tokenizers and clusters


def byte_bpe(texts, ranks, pattern):
    """id -> (ids, bytes): merges of the lowest rank first, match by match."""
    import regex

    names = {k: t for t, k in ranks.items()}

    def merge(word):
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            rank, k = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [ranks[p] for p in parts]

    out = {}
    for i, t in texts:
        ids = [x for m in regex.findall(pattern, t or "") for x in merge(m.encode())]
        out[i] = ids, b"".join(names[x] for x in ids)
    return out


def lloyd(rows, k=16, rounds=3, dim=64, seed=1):
    """[(id, cluster, distance)] in the order of the rows that are kept, and the centroids."""
    import math

    kept = []
    for i, x in rows:
        if x is not None and len(x) == dim and all(c is not None and math.isfinite(c) for c in x):
            kept.append((i, [math.floor(64 * c) for c in x]))
    kept_sorted = sorted(kept, key=lambda r: (sha(f"{seed}:{'' if r[0] is None else r[0]}".encode()), r[1]))
    centres = [v for _, v in kept_sorted[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        where = defaultdict(list)
        for _, v in kept:
            where[nearest(v)[1]].append(v)
        centres = [[sum(col) // len(where[j]) for col in zip(*where[j])] if where[j] else c for j, c in enumerate(centres)]
    told = [(i, *nearest(v)[::-1]) for i, v in kept]
    return told, centres


def alignment(texts, encode_a, bytes_a, encode_b, bytes_b):
    """Rows (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), token by token."""
    told, held = [], defaultdict(set)
    for n, (i, t) in enumerate(texts):
        a, b = (encode_a(" " + t), encode_b(t)) if t else ([], [])
        whole = (" " + (t or "")).encode()
        if not t or b"".join(map(bytes_a, a)) != whole or b"".join(map(bytes_b, b)) != whole:
            told.append((i, [], [], [], []))
            continue

        def ends(ids, of):
            out, at = [], 0
            for x in ids:
                out.append((at, at + len(of(x)), x))
                at += len(of(x))
            return out

        ea, eb = ends(a, bytes_a), ends(b, bytes_b)
        both = sorted({e for _, e, _ in ea} & {e for _, e, _ in eb})
        groups, start = [], 0
        for end in both:
            groups.append(tuple(",".join(str(x) for s, e, x in side if start < e <= end) for side in (ea, eb)))
            start = end
        links = [(x, y) for s, e, x in ea for s2, e2, y in eb if s < e2 and s2 < e]
        for pair in links:
            held[pair].add(n)
        told.append((i, a, b, groups, links))
    top = defaultdict(int)
    for (x, _), docs in held.items():
        top[x] = max(top[x], len(docs))
    out = []
    for i, a, b, groups, links in told:
        text = ";".join(f"{x}|{y}" for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(len(held[p]) == top[p[0]] for p in links), sum(len(held[p]) for p in links), sha(text.encode()) if a else ""))
    return out
