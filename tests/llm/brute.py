"""Plain versions of the operators, for small inputs."""

import hashlib
import zlib
from array import array
from collections import Counter

import xxhash

LAST = 1 << 63
SMALL = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def order(i):
    return LAST if i is None else i


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def pieces(rows, tokenizer, capacity):
    out = Counter()
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            out[i, k // capacity, k, len(part), zlib.crc32(array("I", part).tobytes())] += 1
    return out


def without_windows(rows, length, by_bytes):
    """Rows are (doc_id, text); rows of one doc_id and text are one document."""
    seen, out = set(), {}
    for i, text in sorted({(order(i), t or "") for i, t in rows}):
        units = text.encode() if by_bytes else text.encode().split()
        gone, own = [False] * len(units), []
        for s in range(len(units) - length + 1):
            key = units[s : s + length] if by_bytes else b" ".join(units[s : s + length])
            if key in seen:
                gone[s : s + length] = [True] * length
            elif by_bytes:
                seen.add(key)
            else:
                own.append(key)
        out.setdefault(i, [set(), []])
        out[i][0].update(own)
        seen.update(own if not by_bytes else ())
        kept = bytes(u for u, g in zip(units, gone) if not g) if by_bytes else b" ".join(u for u, g in zip(units, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i, text] = (len(units), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def fingerprint(text):
    words = (text or "").encode().translate(SMALL).split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
    return row[-1]
