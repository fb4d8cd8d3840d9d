"""Plain Python versions of the pipeline's stages, for small tables."""

import collections
import re

LOWER = {c: c + 32 for c in range(65, 91)}


def without_frequent_lines(docs, least):
    def key(line):
        return line.encode().strip().lower()
    seen = collections.Counter(k for t in docs.values() for k in {key(x) for x in (t or "").split("\n")})
    return {i: "\n".join(x for x in (t or "").split("\n") if not key(x) or seen[key(x)] < least) for i, t in docs.items()}


def components(docs, shingle=4, percent=85):
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in docs:
        for j in docs:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in docs}


def contaminated(text, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    doc = words(text)
    for item in map(words, items):
        n = min(10, len(item))
        windows = {tuple(item[i:i + n]) for i in range(len(item) - n + 1)} if n else set()
        if any(tuple(doc[i:i + n]) in windows for i in range(len(doc) - n + 1)):
            return True
    return False
