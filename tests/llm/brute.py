"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import xxhash

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return _WORD.findall(text or "")


def fingerprint(text):
    w = words((text or "").translate(_LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, distance=2):
    """{doc_id: component} for (doc_id, text)."""
    fps = {}
    for i, t in rows:
        fps.setdefault(fingerprint(t), []).append(i)
    keys, parent = list(fps), {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if (keys[a] ^ keys[b]).bit_count() <= distance:
                parent[find(keys[a])] = find(keys[b])
    low = {}
    for k, ids in fps.items():
        low[find(k)] = min([low.get(find(k), min(ids)), *ids])
    return {i: low[find(k)] for k, ids in fps.items() for i in ids}


def kept_words(rows, window=50):
    """{doc_id: (n_words, n_removed, kept words)} for (doc_id, text) with distinct ids."""
    first = {}
    for i, t in sorted(rows):
        w = words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), [x for k, x in enumerate(w) if k not in gone])
    return out


def sha(kept):
    return hashlib.sha256(" ".join(kept).encode()).hexdigest()


def cut_pieces(ids, capacity=2048):
    """(piece, start, length, crc32) of a document's ids, its end included."""
    n = len(ids)
    count = -(-n // capacity)
    first = n - (count - 1) * capacity
    out, at = [], 0
    for k in range(count):
        size = first if k == 0 else capacity
        out.append((k, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())))
        at += size
    return out


def repeats(text):
    """n_words, n_repeat_words (5), words covered by repeats of at least 10, longest repeat."""
    w = words(text)

    def covered(k):
        seen = {}
        for i in range(len(w) - k + 1):
            seen.setdefault(tuple(w[i : i + k]), []).append(i)
        return {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + k)}

    longest = 0
    while longest < len(w) and covered(longest + 1):
        longest += 1
    return len(w), len(covered(5)), len(covered(10)), longest


def toxic_terms(model, text):
    """Places of a text's terms among those that the machine keeps: words and prefixes, up to their third occurrence."""
    place = {int(t): k for k, t in enumerate(model.kept)}
    counts = {}
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        for name in [word, *(word[:k] + "~" for k in (4, 5) if len(word) > k)]:
            b = xxhash.xxh32(name.encode()).intdigest() % (1 << 20)
            counts[b] = counts.get(b, 0) + 1
    return [place[3 * b + k] for b, n in counts.items() for k in range(min(n, 3)) if 3 * b + k in place]


def machine_score(model, terms):
    """Every pair of terms, one by one."""
    s = model.bias + sum(float(model.weights[t]) for t in terms)
    v = np.asarray(model.factors, float)
    s += sum(float(v[a] @ v[b]) for k, a in enumerate(terms) for b in terms[:k])
    return 1 / (1 + np.exp(-s))
