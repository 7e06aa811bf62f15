"""Plain versions of the operators for small data."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def components(n, linked):
    """Smallest member of each one's component, by index."""
    top = list(range(n))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in linked:
        a, b = find(i), find(j)
        top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def fingerprint(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = WORD.findall(raw)
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def repeated(texts, length=200):
    """(bytes, removed, runs, digest of the rest) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        rest = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


def cosine_links(ids, vectors, least=0.95):
    """Links of each vector and the smallest id it reaches."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    order = np.argsort(ids, kind="stable")
    top = components(len(ids), [(int(i), int(j)) for i, j in np.argwhere(near[np.ix_(order, order)])])
    least_id = np.empty(len(ids), np.int64)
    least_id[order] = np.asarray(ids)[order][top]
    return near.sum(axis=1), least_id


def phrases(text, known, block):
    """Longest-match phrases of a text against another, in blocks."""
    n = 0
    for lo in range(0, len(text), block):
        n, held = n + 1, b""
        for c in text[lo:lo + block]:
            if held + bytes([c]) in known:
                held += bytes([c])
            else:
                n, held = n + 1, bytes([c]) if bytes([c]) in known else b""
    return n
