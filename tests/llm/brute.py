"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SF_SMALL = "/root/testdata/sf0.001"


def public(name):
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def quality_counts(text):
    text = text or ""
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for k in range(len(w) - 2):
        if windows[tuple(w[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def shingles(text):
    w = words(text, lower=True)
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def near(docs, threshold=0.8):
    """doc place -> (class id, links) for [(doc_id, text)]."""
    sets = [shingles(t) for _, t in docs]
    parent, links = list(range(len(docs))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    places = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in places[x])
        for x in s:
            places[x].append(i)
        for j, n in shared.items():
            if n / (len(s) + len(sets[j]) - n) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(least.get(find(i), doc_id), links[i]) for i, (doc_id, _) in enumerate(docs)]


def line_fields(line, depth=3, fields=8):
    w = ["<*>" if re.search("[0-9]", x) else x for x in words(line)]
    n, leaf = len(w), (len(w), tuple(w[:depth]))
    cuts = [(n * k // fields, n * (k + 1) // fields) for k in range(fields)]
    return n, [((leaf, k, tuple(w[lo:hi])), hi - lo) for k, (lo, hi) in enumerate(cuts) if hi > lo]


def line_dedup(docs):
    """Texts after dropping repeated lines for [(doc_id, text)]; ids without null."""
    where, lines = defaultdict(set), []
    for i, (doc_id, text) in enumerate(docs):
        for j, line in enumerate((text or "").split("\n")):
            n, f = line_fields(line)
            if n >= 3:
                lines.append((i, j, n, f))
                for key, _ in f:
                    where[key].add(doc_id)
    gone = defaultdict(set)
    for i, j, n, f in lines:
        need = 2 if n >= 10 else 5
        if sum(c for key, c in f if len(where[key]) >= need and min(where[key]) < docs[i][0]) >= 0.8 * n:
            gone[i].add(j)
    return [None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[i]) for i, (_, t) in enumerate(docs)]


def letters(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate(LOWER))


def substring_distance(pattern, text):
    before = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        row = [i]
        for j, y in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        before = row
    return min(before)


def contaminated(docs, items, rate=0.15, least=5):
    """{(doc place, item id): distance}."""
    out = {}
    for i, (_, text) in enumerate(docs):
        own = letters(text)
        for item_id, item in items:
            p = letters(item)
            if len(p) >= least and len(set(p) & set(own)) * 2 >= len(set(p)):
                d = substring_distance(p, own)
                if d <= int(rate * len(p)):
                    out[i, item_id] = d
    return out
