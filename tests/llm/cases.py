"""Small untidy inputs and brute-force versions of the operators."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=3, words=120):
    """Texts with copies, near copies, shared passages, nulls, empties and repeated rows."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeiostnrlé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, near = text(70), text(words)
    rows = [(i, text(r.randint(1, 2 * words))) for i in range(25)]
    rows += [(30 + i, text(20) + " " + passage + "\n" + text(15)) for i in range(5)]
    for i in range(8):
        w = near.split()
        w[r.randrange(len(w))] = "changed%d" % i
        rows.append((40 + i, " ".join(w)))
    rows += [(50, near), (51, near), (52, near.upper()), (60, None), (61, ""), (62, " \t\n"), (63, "one"), (64, "one two"),
             (65, "One  two"), (66, text(3000)), (67, (passage + " ") * 4), (67, (passage + " ") * 4), (68, "#" * 300)]
    return rows


def doubling(length):
    """The two doubling strings of ``length`` (a power of two): they collide in polynomial hashes modulo 2**64."""
    t = "a"
    while len(t) < length:
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


def forced():
    """Pairs of texts that differ in one long word of equal polynomial hash, among words of their own."""
    r = random.Random(9)
    rows = []
    for k, length in enumerate((64, 256, 1024, 4096)):
        same = " ".join("".join(r.choice("klmnop") for _ in range(6)) for _ in range(70))
        a, b = doubling(length)
        rows += [(900 + 2 * k, f"{a} {same}"), (901 + 2 * k, f"{b} {same}"), (950 + 2 * k, a), (951 + 2 * k, b)]
    return rows


def words(t):
    return WORD.findall(t or "")


def removed_words(rows, window):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            first[k] = min(d, first.get(k, d))
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        rest = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(rest.encode()).hexdigest()))
    return sorted(out)


def removed_bytes(rows, window):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            k = b[i:i + window]
            first[k] = min((d, i), first.get(k, (d, i)))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first[b[i:i + window]] < (d, i):
                gone[i:i + window] = b"\1" * window
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def linked(rows, n, percent):
    """(id, set size, component) by comparing all pairs."""
    def grams(t):
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(t)]
        return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    sets = [(d, grams(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and 100 * len(a & b) >= percent * len(a | b) and find(d) != find(e):
                parent[max(find(d), find(e))] = min(find(d), find(e))
    return sorted((d, len(s), find(d)) for d, s in sets)
