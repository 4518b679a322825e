"""SimHash fingerprints of hashes, and the self-join of their binary trie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Node pairs that are traversed at once.
FRONT = 1 << 14
#: Fingerprints up to which the counts of each bit are kept.
_KEPT = 1 << 16


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, hashes.size, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((ones * 2 > hashes.size).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def _all(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (x < y) of the places [a0, a1) and [b0, b1) of each row, FRONT or one row's at a time."""
    size = (a1 - a0) * (b1 - b0)
    cut = np.flatnonzero(np.diff(np.cumsum(size) // FRONT)) + 1 if size.size else []
    for k in np.split(np.arange(size.size), cut):
        of = np.repeat(k, size[k])
        nth = np.arange(of.size) - np.repeat(np.cumsum(size[k]) - size[k], size[k])
        x, y = a0[of] + nth // (b1 - b0)[of], b0[of] + nth % (b1 - b0)[of]
        yield x[x < y], y[x < y]


def trie_pairs(bucket: np.ndarray, fp: np.ndarray, bits: int, label: np.ndarray | None = None, joins: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of fingerprints of one bucket that differ in at most `bits` bits; input sorted by bucket, then fp.

    Node pairs of the buckets' binary tries are traversed together; a pair is dropped as soon as its paths differ in
    more bits, or once all below it has one label. Pairs of one label are left out; callers may join labels meanwhile.
    """
    n = fp.size
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if n else np.zeros(0, np.int64)
    last = np.r_[first[1:], n]
    live = last - first > 1
    # A node is a run of sorted fingerprints; a pair has two nodes of equal depth, the same one or the left one first.
    stack = [(63, first[live], last[live], first[live], last[live], np.zeros(live.sum(), np.int8))]

    counts: dict[int, np.ndarray] = {}
    change = None if label is None else np.r_[0, np.cumsum(label[1:] != label[:-1])]

    def ones_at(bit: int) -> np.ndarray:
        """Before each place, the fingerprints that have the bit."""
        if bit not in counts:
            own = np.cumsum(np.r_[0, (fp >> np.uint64(bit)).astype(np.int64) & 1], dtype=np.int32 if n <= _KEPT else np.int64)
            if n > _KEPT:
                return own
            counts[bit] = own
        return counts[bit]

    def apart(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if label is None:
            return x, y
        ok = label[x] != label[y]
        return x[ok], y[ok]

    while stack:
        bit, a0, a1, b0, b1, d = stack.pop()
        if a0.size > FRONT:
            for at in range(0, a0.size, FRONT):
                stack.append((bit, *(x[at : at + FRONT] for x in (a0, a1, b0, b1, d))))
            continue
        # Pairs of single fingerprints are settled by their own bits.
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            x, y = a0[leaf], b0[leaf]
            near = (x != y) & (np.bitwise_count(fp[x] ^ fp[y]) <= bits)
            yield apart(x[near], y[near])
        a0, a1, b0, b1, d = (x[~leaf] for x in (a0, a1, b0, b1, d))
        if label is not None and a0.size:
            # Nothing is new below two nodes whose fingerprints all have one label.
            if joins and leaf.any():
                change = np.r_[0, np.cumsum(label[1:] != label[:-1])]
            whole = (change[a1 - 1] == change[a0]) & (change[b1 - 1] == change[b0]) & (label[a0] == label[b0])
            a0, a1, b0, b1, d = (x[~whole] for x in (a0, a1, b0, b1, d))
        if bit < 0:  # equal fingerprints in each node
            for x, y in _all(a0, a1, b0, b1):
                yield apart(x, y)
            continue
        if not a0.size:
            continue
        ones = ones_at(bit)
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        parts = [(a0, am, b0, bm, d, None), (am, a1, bm, b1, d, None), (a0, am, bm, b1, d + 1, None), (am, a1, b0, bm, d + 1, same)]
        out = []
        for p0, p1, q0, q1, e, drop in parts:
            ok = (p1 > p0) & (q1 > q0) & (e <= bits) & ~((p0 == q0) & (p1 - p0 == 1))
            if drop is not None:
                ok &= ~drop
            out.append([x[ok] for x in (p0, p1, q0, q1, e)])
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*out, strict=True))))


def trie_forest(bucket: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b), a spanning forest of all pairs of `trie_pairs`."""
    label = np.arange(fp.size)
    links: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for x, y in trie_pairs(bucket, fp, bits, label, joins=True):
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            r, s = root(p), root(q)
            if r != s:
                label[max(r, s)] = min(r, s)
                links.append((p, q))
        while (label != label[label]).any():
            label[:] = label[label]
    e = np.array(links, np.int64).reshape(-1, 2)
    return e[:, 0], e[:, 1]
