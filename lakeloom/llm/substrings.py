"""Removal of repeated substrings by sorted suffixes of what can repeat.

Whether the `length` bytes from a place also start earlier is asked for every place of every text. Sorting all
suffixes would move many times the input, so those that can't match are found first. Each window of `length` bytes names
an anchor, the place of the least hash of K bytes in it, which depends on the window's bytes alone. Anchors whose K
bytes occur once repeat nothing. Those with equal surroundings (all that any of their windows can hold) point to the
earliest of them; where the surroundings differ, the windows are told apart by hashes of their own. Either way a
candidate is a stretch of a text and an earlier stretch whose hashes are equal.

Hashes decide nothing. Both stretches, cut at places of the earlier one's grid, become strings (suffixes as far as they can match);
each task sorts its own, drops those that it has twice, and writes front-coded runs, cut by range: splitters come from
a sample of the strings. A partition merges its runs with a loser tree that never compares a known prefix again, as a
stream: what is below the next block's first string is settled and leaves. Of equal strings the earliest place stays.
A string that many texts share leaves each task once, and its bytes decide which.

Texts are kept in the shared folder, bucketed by a row number, so they are dealt out once and lists of places come to them.
Null and empty texts have nothing to remove. Very long texts are read in pieces that overlap. Rows that share a doc_id
are texts of their own, one before the other in an order that is the same within a run; a null doc_id comes last. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import front
from .common import bucketed, partition_keys, partitions, scratch, written

#: Bytes of an anchor: enough that texts seldom share them by chance.
K = 50
#: Bytes of text (or of strings) that a task combines before it passes rows on, and bytes whose hashes are held at once.
BATCH, PIECE = 1 << 23, 1 << 19
#: Windows that a task combines; rows that are looked at together; windows of a string at most.
WINDOWS, ROWS, CHUNK = 1 << 18, 1 << 17, 1024
#: Strings of a block, strings that a merge holds before it settles some, and strings of the sample for each partition.
BLOCK, MERGED, SAMPLE = 512, 1 << 17, 32
_U = np.uint64
_POWERS: list[np.ndarray] = []
_LAST = (1 << 63) - 1

#: An anchor or window: hash, hash of all surroundings, place; span: windows before it << 8 | windows less one.
#: Or a pair: h and c are the row and place of the earlier stretch, rid and at of the later one, span the windows, negative.
_ROW = "h long, c long, ord long, rid long, at long, span long"
#: Windows from `first`, n of them, that look like those from lfirst of the row lrid; lrid -1: not yet known.
_PAIR = "rid long, first long, n long, lrid long, lfirst long"
_COLUMNS = {k: [x.split()[0] for x in k.split(", ")] for k in (_ROW, _PAIR)}


def _frame(kind: str, *columns: np.ndarray | int) -> pd.DataFrame:
    n = max((np.size(c) for c in columns if np.ndim(c)), default=0)
    return pd.DataFrame({k: np.broadcast_to(np.asarray(c).astype(np.int64), n) for k, c in zip(_COLUMNS[kind], columns, strict=True)})


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return (x ^ (x >> _U(32))) * _U(0x94D049BB133111EB)


def _powers() -> list[np.ndarray]:
    """Random values of the bytes, powers of an odd base, and of its inverse, modulo 2^64."""
    if not _POWERS:
        base = 0x9E3779B97F4A7C15
        n = PIECE + 4096
        _POWERS.extend([np.random.default_rng(7).integers(0, 2**64, 256, dtype=_U), np.cumprod(np.r_[_U(1), np.full(n, base, _U)]), np.cumprod(np.r_[_U(1), np.full(n, pow(base, -1, 2**64), _U)])])
    return _POWERS


def _sums(buf: np.ndarray) -> np.ndarray:
    value, _, down = _powers()
    sums = np.zeros(buf.size + 1, _U)
    np.cumsum(value[buf] * down[: buf.size], out=sums[1:])
    return sums


def _anchors(buf: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of `buf`: anchors, their first and last windows, their hashes, and prefix sums for other hashes."""
    up, sums = _powers()[1], _sums(buf)
    h = _mixed((sums[K:] - sums[:-K]) * up[: buf.size - K + 1])
    span, size, least = length - K + 1, 1, h
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if rest := span - size:
        least = np.minimum(least[:-rest], least[rest:])
    # The first place of the least hash in each window: hashes that are a minimum of some window, by place.
    n = least.size
    change = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    stop = np.r_[change[1:], n]
    at_list, first, last = [], [], []
    for s, e in _leftmost(h, least, change, stop):
        at_list.append(s), first.append(e[0]), last.append(e[1])
    return np.concatenate(at_list), np.concatenate(first), np.concatenate(last), h, sums


def _leftmost(h: np.ndarray, least: np.ndarray, change: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """Runs of windows with one least hash, cut where its first place in the window moves on to a later copy of it."""
    s, e = change, stop
    low = s  # the place is not before the run's first window, nor before that of the last round
    while s.size:
        at = np.empty(s.size, np.int64)
        todo, place = np.arange(s.size), np.maximum(low, s)
        while todo.size:
            hit = h[place[todo]] == least[s[todo]]
            at[todo[hit]] = place[todo[hit]]
            todo = todo[~hit]
            place[todo] += 1
        end = np.minimum(e, at + 1)  # windows that start behind the place have another
        yield at, (s, end - 1)
        more = end < e
        s, e, low = end[more], e[more], at[more] + 1


def _pieces(size: int, length: int) -> Iterator[tuple[int, int]]:
    """Windows [s, e) that are looked at together."""
    n = size - length + 1
    for s in range(0, max(0, n), PIECE - 4 * length):
        yield s, min(n, s + PIECE - 4 * length)


def _anchor_rows(texts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """Rows of h, c (hash of all surroundings), doc (place in `texts`), at, first, last."""
    found: list[tuple] = []
    up = _powers()[1]
    left = length - K

    def run(group: list[tuple[int, int, int, bytes, int]]) -> None:
        """group: (text, offset of the bytes in it, windows, bytes, bytes before the first window)."""
        buf = np.frombuffer(b"".join(g[3] for g in group), np.uint8)
        size = np.array([len(g[3]) for g in group])
        base = np.cumsum(size) - size
        at, first, last, h, sums = _anchors(buf, length)
        # Windows across texts, or beyond a piece's own, don't count.
        of = np.searchsorted(base, first, "right") - 1
        twice = np.searchsorted(base, last, "right") - 1 != of
        parts = [(at, first, last, of)]
        if twice.any():  # a run of windows that goes on into the next text: also look from its end
            parts.append((at[twice], first[twice], last[twice], np.searchsorted(base, last[twice], "right") - 1))
        windows = np.array([g[2] for g in group])
        offset, doc, skip = (np.array([g[k] for g in group]) for k in (1, 0, 4))
        for a, f, e, o in parts:
            f, e = np.maximum(f, base[o] + skip[o]), np.minimum(e, base[o] + skip[o] + windows[o] - 1)
            ok = f <= e
            a, f, e, o = a[ok], f[ok], e[ok], o[ok]
            lo, hi = np.maximum(base[o], a - left), np.minimum(base[o] + size[o], a + length)
            c = _mixed((sums[hi] - sums[lo]) * up[lo]) ^ _mixed(((a - lo) * 4096 + (hi - a)).astype(_U))
            found.append((h[a], c, doc[o], a - base[o] + offset[o], f - base[o] + offset[o], e - base[o] + offset[o]))

    group: list[tuple] = []
    held = 0
    for k, text in enumerate(texts):
        for s, e in _pieces(len(text), length):
            lo, hi = max(0, s - length), min(len(text), e + 2 * length)
            if held + hi - lo > PIECE:
                run(group)
                group, held = [], 0
            group.append((k, lo, e - s, text[lo:hi], s - lo))
            held += hi - lo
    if group:
        run(group)
    names = ("h", "c", "doc", "at", "first", "last")
    return {n: np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i, n in enumerate(names)}


def _window_hashes(text: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(starts.size, _U)
    up = _powers()[1]
    for s, e in _pieces(len(text), length):
        i, j = np.searchsorted(starts, (s, e))
        if i < j:
            sums, own = _sums(np.frombuffer(text, np.uint8, min(len(text), e + length) - s, s)), starts[i:j] - s
            out[i:j] = _mixed((sums[own + length] - sums[own]) * up[own])
    return out


def _joined(rid: np.ndarray, first: np.ndarray, n: np.ndarray, lrid: np.ndarray, lfirst: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs that go on where others of the same two rows end, or overlap with them, as one."""
    shift = lfirst - first
    order = np.lexsort((first, shift, lrid, rid))
    rid, first, n, lrid, shift = (x[order] for x in (rid, first, n, lrid, shift))
    if not rid.size:
        return rid, first, n, lrid, shift
    new = np.r_[True, (rid[1:] != rid[:-1]) | (lrid[1:] != lrid[:-1]) | (shift[1:] != shift[:-1])]
    far = np.cumsum(new) * (np.int64(1) << 40)
    reach = np.maximum.accumulate(far + first + n) - far
    new[1:] |= first[1:] > reach[:-1]
    start = np.flatnonzero(new)
    return rid[start], first[start], np.maximum.reduceat(first + n, start) - first[start], lrid[start], first[start] + shift[start]


def _union(rid: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that overlap or touch in a row as one."""
    rid, low, n, _, _ = _joined(rid, low, high - low, np.zeros(rid.size, np.int64), low)
    return rid, low, low + n


def _twins(order: np.ndarray, keys: list[np.ndarray], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In `order` (equal keys together, then by text and place): the first row with each row's keys; whether it is elsewhere."""
    new = np.zeros(order.size, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    start = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return start, (doc[order] != doc[start]) | (at[order] != at[start])


def _pairs(rid: np.ndarray, first: np.ndarray, n: np.ndarray, lrid: np.ndarray, lfirst: np.ndarray) -> pd.DataFrame:
    rid, first, n, lrid, lfirst = _joined(rid, first, n, lrid, lfirst)
    return _frame(_ROW, lrid, lfirst, 0, rid, first, -n)


def anchors(texts: DataFrame, length: int) -> DataFrame:
    """A row for each anchor of a task with other surroundings than all before it; and pairs for those with the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, int, bytes]] = []

        def settle() -> Iterator[pd.DataFrame]:
            held.sort(key=lambda x: x[:2])
            r = _anchor_rows([t for _, _, t in held], length)
            ord_, rid = np.array([x[:2] for x in held], np.int64).T
            held.clear()
            doc, at, first, last, h, c = r["doc"], r["at"], r["first"], r["last"], r["h"], r["c"]
            order = np.lexsort((at, doc, c, h))
            start, again = _twins(order, [h, c], doc, at)
            own, late, lead = order[~again], order[again], start[again]
            yield _pairs(rid[doc[late]], first[late], last[late] - first[late] + 1, rid[doc[lead]], at[lead] - at[late] + first[late])
            yield _frame(_ROW, h[own], c[own], ord_[doc[own]], rid[doc[own]], at[own], (at - first)[own] << 8 | (last - first)[own])

        size = 0
        for b in batches:
            for o, d, t in zip(b["ord"], b["rid"], b["bytes"], strict=True):
                held.append((o, d, t))
                size += len(t)
                if size >= BATCH:
                    yield from settle()
                    size = 0
        if held:
            yield from settle()

    return texts.filter(F.length("bytes") >= length).select("ord", "rid", "bytes").mapInPandas(run, _ROW)


def windows(texts: DataFrame, contested: DataFrame, length: int) -> DataFrame:
    """As `anchors`, for single windows: of those named by `contested` (_PAIR), each by the hash of its bytes."""
    lists = contested.groupBy("rid").agg(F.collect_list(F.struct("first", "n")).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []

        def settle() -> Iterator[pd.DataFrame]:
            held.sort(key=lambda x: x[:2])
            sizes = [x[2].size for x in held]
            ord_, rid = (np.repeat(np.array([x[k] for x in held], np.int64), sizes) for k in (0, 1))
            at, h = (np.concatenate([x[k] for x in held]) for k in (2, 3))
            held.clear()
            order = np.lexsort((at, rid, ord_, h))
            start, again = _twins(order, [h], rid, at)
            own, late, lead = order[~again], order[again], start[again]
            yield _pairs(rid[late], at[late], np.ones(late.size, np.int64), rid[lead], at[lead])
            yield _frame(_ROW, h[own], 0, ord_[own], rid[own], at[own], 0)

        size = 0
        for b in batches:
            for o, d, t, spans in zip(b["ord"], b["rid"], b["bytes"], b["spans"], strict=True):
                p = np.unique(np.concatenate([np.arange(s["first"], s["first"] + s["n"]) for s in spans]))
                held.append((o, d, p, _window_hashes(t, p, length)))
                size += p.size
                if size >= WINDOWS:
                    yield from settle()
                    size = 0
        if held:
            yield from settle()

    return texts.join(lists, "rid").select("ord", "rid", "bytes", "spans").mapInPandas(run, _ROW)


def _bundled(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Batches of about so many rows; those that Spark hands over are small, for the sake of long texts."""
    held: list[pd.DataFrame] = []
    size = 0
    for b in batches:
        held.append(b)
        size += len(b)
        if size >= rows:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if size:
        yield pd.concat(held, ignore_index=True)


def candidates(rows: DataFrame) -> DataFrame:
    """_PAIR from rows of all tasks: each with the earliest of the same h and c; and with lrid -1 those whose h has another c."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Sorted by h, c, text and place: what a row is depends on its neighbours; the last ones wait for the next batch.
        before: int | None = None  # the h of the last surroundings, if another surroundings of it came before
        wait: pd.DataFrame | None = None
        for b in _bundled(batches, ROWS):
            known = b[b["span"] < 0]
            yield _frame(_PAIR, *(known[k].to_numpy() for k in ("rid", "at")), -known["span"].to_numpy(), *(known[k].to_numpy() for k in ("h", "c")))
            b = b[b["span"] >= 0]
            b = b.reset_index(drop=True) if wait is None else pd.concat([wait, b], ignore_index=True)
            if not len(b):
                continue
            h, c, rid, at, span = (b[k].to_numpy() for k in ("h", "c", "rid", "at", "span"))
            first, n = at - (span >> 8), (span & 255) + 1
            new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
            start = np.flatnonzero(new)[np.cumsum(new) - 1]
            lead = (rid == rid[start]) & (at == at[start])
            other = np.zeros(len(b), bool)  # another surroundings of the same h on either side
            turn = np.flatnonzero(new[1:] & (h[1:] == h[:-1]))
            other[start[turn]] = True
            other[turn + 1] = True
            if before is not None and before == h[0]:
                other[0] = True
            # The last surroundings may go on: its first rows wait, its repeats needn't.
            tail = start[-1]
            done = lead & other[start]
            done[tail:] = False
            yield _frame(_PAIR, rid[done], first[done], n[done], -1, 0)
            late = ~lead
            yield _frame(_PAIR, rid[late], first[late], n[late], rid[start[late]], at[start[late]] - at[late] + first[late])
            wait = b[lead & (np.arange(len(b)) >= tail)]
            before = int(h[tail]) if other[tail] else None
        if wait is not None and before is not None:
            rid, at, span = (wait[k].to_numpy() for k in ("rid", "at", "span"))
            yield _frame(_PAIR, rid, at - (span >> 8), (span & 255) + 1, -1, 0)

    # Pairs go with their row, all else with its bytes.
    dealt = rows.repartition(partitions(rows), F.when(F.col("span") < 0, F.col("rid")).otherwise(F.col("h")))
    return dealt.sortWithinPartitions("h", "c", "ord", "rid", "at").mapInPandas(run, _PAIR)


def strings(pairs: DataFrame) -> DataFrame:
    """rid, first, n: the stretches of both sides of all pairs, cut where the earlier one's windows begin a multiple of CHUNK."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _bundled(batches, ROWS):
            rid, first, n, lrid, lfirst = _joined(*(b[k].to_numpy() for k in _COLUMNS[_PAIR]))
            pieces = (lfirst + n - 1) // CHUNK - lfirst // CHUNK + 1
            of = np.repeat(np.arange(rid.size), pieces)
            cell = lfirst[of] // CHUNK + np.arange(of.size) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            low, high = np.maximum(lfirst[of], cell * CHUNK), np.minimum((lfirst + n)[of], (cell + 1) * CHUNK)
            yield pd.DataFrame({"rid": np.r_[rid[of], lrid[of]], "first": np.r_[low - (lfirst - first)[of], low], "n": np.r_[high - low, high - low]})

    return pairs.repartition(partitions(pairs), "rid").sortWithinPartitions("rid", "lrid", "first").mapInPandas(run, "rid long, first long, n long")


def _cut(text: bytes, spans: list, length: int) -> Iterator[tuple[int, bytes]]:
    for s in spans:
        yield s["first"], text[s["first"] : s["first"] + s["n"] + length - 1]


def splitters(texts: DataFrame, items: DataFrame, length: int, parts: int) -> list[bytes]:
    """parts - 1 strings, fewer if there are few, that divide all of `items` about evenly; their sample has SAMPLE for each part."""
    every = max(1, items.count() // (SAMPLE * parts))
    lists = items.filter(F.pmod(F.xxhash64("rid", "first", "n"), F.lit(every)) == 0).groupBy("rid").agg(F.collect_list(F.struct("first", "n")).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"s": [x[:64] for t, spans in zip(b["bytes"], b["spans"], strict=True) for _, x in _cut(t, spans, length)]})

    some = sorted(bytes(r[0]) for r in texts.join(lists, "rid").select("bytes", "spans").mapInPandas(run, "s binary").collect())
    return sorted({some[len(some) * k // parts] for k in range(1, parts)}) if some else []


def suffix_runs(texts: DataFrame, items: DataFrame, length: int, split: list[bytes], keys: list[int]) -> DataFrame:
    """Front-coded blocks of sorted runs (part, first string, run, places); and with part -1 what repeats within a task."""
    lists = items.groupBy("rid").agg(F.collect_set(F.struct("first", "n")).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: list[bytes] = []
        places: list[tuple[int, int, int]] = []

        def settle(name: str) -> Iterator[pd.DataFrame]:
            place = np.array(places, np.int64)
            order = np.lexsort(place.T[::-1]).tolist()
            order.sort(key=held.__getitem__)  # stable: equal strings by text and place
            texts, place = [held[k] for k in order], place[order]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            held.clear(), places.clear()
            lcp = front.prefixes(texts)
            again = np.r_[False, (np.array(lcp[1:]) == sizes[1:]) & (sizes[1:] == sizes[:-1])]
            start = np.flatnonzero(~again)[np.cumsum(~again) - 1]
            gone = again & (place[:, 1:] != place[start, 1:]).any(1)
            spans = np.array(_union(place[gone, 1], place[gone, 2], place[gone, 2] + sizes[gone]))
            out = [(keys[task % len(keys)], -1, b"", "", b"", spans.astype("<i8").tobytes())]
            own = np.flatnonzero(~again)
            part = np.fromiter((bisect_right(split, texts[k]) for k in own.tolist()), np.int64, own.size)
            for p, e in zip(np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), np.flatnonzero(np.r_[part[1:] != part[:-1], True]) + 1, strict=True):
                for s in range(p, e, BLOCK):
                    k = own[s : min(e, s + BLOCK)].tolist()
                    some = [texts[x] for x in k]
                    out.append((keys[part[p]], int(part[p]), some[0], name, front.encode(some, [0, *(lcp[x] for x in k[1:])]), place[k].astype("<i8").tobytes()))
            yield pd.DataFrame(out, columns=["key", "part", "low", "run", "block", "places"])

        size = serial = 0
        for b in batches:
            for o, d, t, spans in zip(b["ord"], b["rid"], b["bytes"], b["spans"], strict=True):
                for at, s in _cut(t, spans, length):
                    held.append(s), places.append((o, d, at))
                    size += len(s) + 100
                    if size >= BATCH:
                        yield from settle(f"{task}-{serial}")
                        serial, size = serial + 1, 0
        if held:
            yield from settle(f"{task}-{serial}")

    return texts.join(lists, "rid").select("ord", "rid", "bytes", "spans").mapInPandas(run, "key long, part int, low binary, run string, block binary, places binary")


def merged(runs: DataFrame, parts: int) -> DataFrame:
    """rid, first, last: stretches of bytes that start earlier too."""

    def settle(lists: list[tuple[list[int], list[bytes], list]]) -> pd.DataFrame:
        rid, first, last = [], [], []
        best: list[int] = []
        size = -1
        for n, text, here in front.merge([zip(*x, strict=True) for x in lists]):
            if n == len(text) == size:
                best, later = (best, here) if best <= here else (here, best)
                if best[1:] != later[1:]:
                    rid.append(later[1]), first.append(later[2]), last.append(later[2] + size)
            else:
                best, size = here, len(text)
        return pd.DataFrame(np.array(_union(*(np.array(x, np.int64) for x in (rid, first, last)))).T, columns=["rid", "first", "last"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[list[int], list[bytes], list]] = defaultdict(lambda: ([], [], []))
        size, full, now = 0, MERGED, None

        def below(x: bytes | None) -> Iterator[pd.DataFrame]:
            """Settles the strings below x (all, if None): blocks come by their first strings, so no run has more of them."""
            nonlocal size
            out = []
            for name, own in list(held.items()):
                at = len(own[1]) if x is None else bisect_left(own[1], x)
                out.append(tuple(y[:at] for y in own))
                held[name] = tuple(y[at:] for y in own)
                if at == len(own[1]):
                    del held[name]
            if out := [y for y in out if y[1]]:
                size -= sum(len(y[1]) for y in out)
                yield settle(out)

        for b in batches:
            for part, low, name, block, places in zip(b["part"], b["low"], b["run"], b["block"], b["places"], strict=True):
                if part < 0:
                    yield pd.DataFrame(np.frombuffer(places, "<i8").reshape(3, -1).T, columns=["rid", "first", "last"])
                    continue
                if part != now:
                    yield from below(None)
                    now, full = part, MERGED
                elif size >= full:
                    yield from below(low)
                    full = max(MERGED, 2 * size)
                lcp, texts = front.decode(block)
                own = held[name]
                if own[1]:  # a block's first string is whole; the merge goes by the prefix that it shares with the one before
                    lcp[0] = front.shared(own[1][-1], texts[0])
                for x, y in zip(own, (lcp, texts, np.frombuffer(places, "<i8").reshape(-1, 3).tolist()), strict=True):
                    x.extend(y)
                size += len(texts)
        yield from below(None)

    return runs.repartition(parts, "key").sortWithinPartitions("part", "low").mapInPandas(run, "rid long, first long, last long")


def repeats(texts: DataFrame, length: int = 100) -> DataFrame:
    """rid, first, last: stretches of bytes, which may overlap, that repeat what starts earlier. `texts`: see `stored`."""
    with scratch(texts.sparkSession):
        return _repeats(texts, length)


def _repeats(texts: DataFrame, length: int) -> DataFrame:
    found = written(candidates(anchors(texts, length)), "anchors")
    more = written(candidates(windows(texts, found.filter("lrid < 0"), length)).filter("lrid >= 0"), "windows")
    items = written(strings(found.filter("lrid >= 0").unionByName(more)), "strings")
    parts = partitions(texts)
    split = splitters(texts, items, length, parts)
    return written(merged(suffix_runs(texts, items, length, split, partition_keys(texts.sparkSession, parts)), parts), "repeats", keep=True)


def stored(docs: DataFrame) -> DataFrame:
    """rid, ord (the order of texts, before rid), doc_id, bytes; bucketed by rid, which numbers the rows."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col("doc_id"), F.lit(_LAST)).alias("ord"), "doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"))
    return bucketed(rows, "rid", "texts")


def removed(docs: DataFrame, length: int = 100, with_text: bool = True) -> DataFrame:
    """doc_id, text (the bytes that remain, or null), n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    texts = stored(docs)
    spans = repeats(texts, length).groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, spans in zip(b["bytes"], b["spans"], strict=True):
                spans = [] if spans is None else spans
                low, high = np.array([s["first"] for s in spans], np.int64), np.array([s["last"] for s in spans], np.int64)
                _, low, high = _union(np.zeros(low.size, np.int64), low, high)
                rest = b"".join(t[s:e] for s, e in zip([0, *high.tolist()], [*low.tolist(), len(t)], strict=True))
                out.append((rest if with_text else None, len(t), len(t) - len(rest), low.size, hashlib.sha256(rest).hexdigest()))
            yield pd.concat([b["doc_id"], pd.DataFrame(out, columns=["text", "n_bytes", "n_removed", "n_spans", "kept_sha256"], index=b.index)], axis=1)

    return texts.join(spans, "rid", "left").select("doc_id", "bytes", "spans").mapInPandas(cut, "doc_id long, text binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
