"""Sorted runs of byte strings, front-coded, and their merge by a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard


def shared(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix; the first `start` bytes are known to be equal."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    low, high = start, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def prefixes(texts: list[bytes]) -> list[int]:
    """Of sorted strings, the length that each shares with the one before."""
    return [0, *map(shared, texts, texts[1:])][: len(texts)]


def encode(texts: list[bytes], lcp: list[int]) -> bytes:
    """A block of sorted strings: how many, their common prefixes, their lengths, and only what follows the prefixes."""
    head = np.array([len(texts), *lcp, *map(len, texts)], "<u4").tobytes()
    return zstandard.compress(head + b"".join(t[n:] for t, n in zip(texts, lcp, strict=True)), 3)


def decode(block: bytes) -> tuple[list[int], list[bytes]]:
    """(common prefixes, strings); the prefix of the first is 0."""
    raw = zstandard.decompress(block)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    lcp, sizes = np.frombuffer(raw, "<u4", 2 * n, 4).reshape(2, n).tolist()
    last, at, out = b"", 4 + 8 * n, []
    for p, size in zip(lcp, sizes, strict=True):
        last = last[:p] + raw[at : at + size - p]
        at += size - p
        out.append(last)
    return lcp, out


def merge(runs: list[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """The runs' (lcp, string, payload) in order, lcp with the string put out before.

    Each inner node keeps the run that lost there and the prefix that it shares with the winner. All that meet the
    next winner's path have lost to the last one put out, so their prefixes with it are known: a longer prefix is
    smaller without a look at the strings, and where two are equal the comparison starts behind it.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    head: list[tuple[int, bytes, tuple] | None] = [next(r, None) for r in runs] + [None] * (k - len(runs))
    lcp = [0] * k
    loser = [-1] * (2 * k)

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); lcp of the loser becomes that with the winner."""
        x, y = head[a], head[b]
        if y is None or x is None:
            return (a, b) if y is None else (b, a)
        p, q = lcp[a], lcp[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        n = shared(x[1], y[1], p)
        if n == len(x[1]) == len(y[1]) or x[1][n:] <= y[1][n:]:
            lcp[b] = n
            return a, b
        lcp[a] = n
        return b, a

    winner = list(range(k)) if k == 1 else [-1] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winner[node], loser[node] = play(winner[2 * node], winner[2 * node + 1])
    top = winner[1] if k > 1 else 0
    while head[top] is not None:
        _, text, payload = head[top]
        yield lcp[top], text, payload
        head[top] = following = next(runs[top], None)
        if following is not None:
            lcp[top] = following[0]
        node = (top + k) // 2
        while node:
            top, loser[node] = play(top, loser[node])
            node //= 2
