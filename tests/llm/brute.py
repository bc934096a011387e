"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def words(text, lower=False):
    text = text or ""
    return re.findall("[^\x20\x09-\x0d]+", text.translate(LOWER) if lower else text)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def quality(text):
    w, lines, seen = words(text), [x for x in (text or "").split("\n") if words(x)], defaultdict(list)
    for i in range(len(w) - 4):
        seen[tuple(w[i:i + 5])].append(i)
    repeat = len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)})
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeat,
            len(w) < 10 or 100 * repeat > 20 * len(w))


def licenses(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    hits = [(i, label) for phrase, label in PHRASES.items() for i in range(len(w))
            if w[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def substrings(texts, n=35):
    """(words, removed, digest of the kept words) of each text."""
    own = [words(t) for t in texts]
    count = Counter(tuple(w[i:i + n]) for w in own for i in range(len(w) - n + 1))
    out = []
    for w in own:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if count[tuple(w[i:i + n])] > 1:
                gone[i:i + n] = [True] * n
        out.append((len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return out


def jaccard(rows):
    """[(id, set size, component)] of (id, text) rows."""
    sets = []
    for _, text in rows:
        w = words(text, True)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min([x for x in (least.get(root(i)), key) if x is not None], default=None)
    return [(key, len(sets[i]), least[root(i)]) for i, (key, _) in enumerate(rows)]


def base_scores(rows, held):
    """(tokens, known, training tokens, base score) of each (id, text) row."""
    own = [[*words(t, True), "\n"] for _, t in rows]
    count = Counter(w for (key, _), ws in zip(rows, own) if not held(key) for w in ws)
    total, bottom = sum(count.values()), sum(count.values()) + 0.1 * (len(count) + 1)
    return [(len(ws), sum(count[w] > 0 for w in ws), total, sum(math.log10((count[w] + 0.1) / bottom) for w in ws)) for ws in own]
