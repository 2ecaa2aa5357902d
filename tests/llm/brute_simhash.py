"""Plain version of the SimHash groups, for comparison."""

import re

import xxhash


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum((h >> i) & 1 for h in hs) > len(hs))


def groups(rows):
    """rows: (doc_id, text). Returns sorted (doc_id, hex, component)."""
    fps = [fingerprint(t) for _, t in rows]
    distinct = sorted(set(fps))
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    least = {}
    for (d, _), f in zip(rows, fps):
        if d is not None:
            r = find(f)
            least[r] = min(least.get(r, d), d)
    return sorted(((d, f"{f:016x}", least.get(find(f))) for (d, _), f in zip(rows, fps)), key=str)
