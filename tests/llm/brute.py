"""The operators' contracts in plain Python, for small tables."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RUN = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def turns(rows):
    """conv_id -> (n_turns, digest of turns, trained characters, digest of trained texts)."""
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-(1 << 63) if t is None else t, r or "", x or ""))
    out = {}
    for c, v in by.items():
        v.sort()
        trained = "".join(x for _, r, x in v if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(v), sha("".join(f"{r}\n{x}\n" for _, r, x in v)), len(trained), sha(trained))
    return out


def contamination(docs, bench, window=10):
    wins = collections.defaultdict(set)
    for i, t in bench:
        w = WORD.findall(low(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, items = WORD.findall(low(t)), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if s := wins.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= s
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out


def measures(t):
    t = t or ""
    w, seen, dup, cover = RUN.findall(t), set(), 0, set()
    for line in t.split("\n"):
        if RUN.search(line):
            dup += line in seen
            seen.add(line)
    often = collections.Counter(zip(w, w[1:], w[2:]))
    for i in range(len(w) - 2):
        if often[tuple(w[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def phrases(t):
    w, places, labels = WORD.findall(low(t)), [], set()
    for phrase, label in {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def shingles(t, k):
    w = RUN.findall(low(t))
    n = min(k, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def near(docs, k, percent=80):
    """doc_id -> (set size, smallest doc_id reachable); doc_ids are distinct."""
    sets = {d: shingles(t, k) for d, t in docs}
    inverted = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            inverted[x].append(d)
    common = collections.Counter((min(a, b), max(a, b)) for ds in inverted.values() for i, a in enumerate(ds) for b in ds[:i])
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def near_dense(docs, k, percent=80):
    """As near(), from products of a matrix of the shingles that stand in several documents."""
    import numpy as np

    sets = [shingles(t, k) for _, t in docs]
    often = collections.Counter(x for s in sets for x in s)
    place = {x: i for i, x in enumerate(x for x, n in often.items() if n > 1)}
    m = np.zeros((len(docs), len(place)), np.float32)
    for i, s in enumerate(sets):
        m[i, [place[x] for x in s if x in place]] = 1
    n, common = np.array([len(s) for s in sets]), m @ m.T
    link = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    np.fill_diagonal(link, n > 0)
    comp = np.array([d for d, _ in docs])
    while True:
        new = np.array([comp[link[i]].min() if n[i] else comp[i] for i in range(len(docs))])
        if (new == comp).all():
            return {d: (int(a), int(c)) for (d, _), a, c in zip(docs, n, comp)}
        comp = new
