"""Plain statements of what the operators compute, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def shingles(text, n=5):
    w = SPACED.findall(low(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(texts, threshold=80):
    """texts: list of (key, text); the smallest key reachable of each row."""
    sets = [shingles(t) for _, t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if k and 100 * k >= threshold * (len(a) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (key, _) in enumerate(texts):
        ids[find(i)].append(key)
    return [min(ids[find(i)]) for i in range(len(texts))]


def contamination(text, items, window=13):
    w = ALNUM.findall(low(text))
    hit, found = [0] * len(w), set()
    for i, t in items:
        x = ALNUM.findall(low(t))
        k = min(window, len(x))
        for a in range(len(x) - k + 1) if x else []:
            for b in range(len(w) - k + 1):
                if w[b : b + k] == x[a : a + k]:
                    hit[b : b + k] = [1] * k
                    found.add(i)
    return len(w), sum(hit), found


def repeats(texts, width=200):
    """For each text (bytes): a list of flags of what is removed."""
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return out
