"""Byte-level BPE over many texts at once.

Texts are cut into pre-tokens with numpy, and each pre-token's ids are looked up by two hashes in a table of the worker;
what is new there is encoded once, from the vocabulary file of `tokenizers`. Texts with characters beyond U+024F, with
numbers that aren't digits, or with special tokens' strings go to `tokenizers` whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np

_U = np.uint64
#: Characters that are cut together, and pre-tokens that the table holds before it is emptied; both bound memory.
#: One longer text is cut whole; should it have more pre-tokens, the table has room for them until the next chunk.
CHUNK, CAPACITY = 1 << 18, 1 << 19
# Superscripts, fractions and separators on which classes differ, and what lies beyond the table below.
_OTHER = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")
_LIMIT = 0x250
_SPACE, _LETTER, _DIGIT, _REST = range(4)
_CLASS = np.array([_SPACE if chr(c).isspace() else _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _REST for c in range(_LIMIT)], np.uint8)


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin; `points`: characters of texts that begin at `first` (none empty).

    A pre-token is a run of letters, digits or other characters, with one space before it, or white space up to the
    last in front of something else; an apostrophe that follows neither space nor its like takes s, t, m, d, re, ve, ll.
    """
    n = points.size
    kind = _CLASS[points]
    head = np.zeros(n, bool)
    head[1:] = kind[1:] != kind[:-1]
    fresh = np.zeros(n + 1, bool)
    fresh[first] = fresh[n] = True
    head |= fresh[:n]
    run = np.flatnonzero(head)
    end = np.r_[run[1:], n]
    white = (kind[run] == _SPACE) & ~fresh[end]
    last = end[white] - 1
    joined = points[last] == 32
    head[last] = True
    head[last[joined] + 1] = False
    mark = np.flatnonzero((points[run] == 39) & (end - run == 1) & head[run] & ~fresh[end])
    if mark.size:
        e = end[mark]
        stop = end[mark + 1]
        a = points[e]
        b = np.where(e + 1 < stop, points[np.minimum(e + 1, n - 1)], 0)
        letters = kind[e] == _LETTER
        one = letters & np.isin(a, (ord("s"), ord("t"), ord("m"), ord("d")))
        two = letters & ((np.isin(a, (ord("r"), ord("v"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for hit, size in ((one, 1), (two, 2)):
            head[e[hit]] = False
            more = hit & (e + size < stop)
            head[e[more] + size] = True
    return np.flatnonzero(head)


class Vocabulary:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        byte = _byte_letters()
        # Where ids of a byte-level vocabulary rise with the merges that make them, ids are ranks; others are left to the library.
        made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model.get("merges", [])]
        self.ranked = model["type"] == "BPE" and "ByteLevel" in json.dumps(whole.get("pre_tokenizer")) and not whole.get("normalizer") and len(made) > 0 and min(made) >= 256 and all(a < b for a, b in zip(made, made[1:], strict=False))
        if not self.ranked:
            return
        ranks = {bytes(byte[ch] for ch in t): i for t, i in model["vocab"].items() if t not in self.special}
        self.merges = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        rng = np.random.default_rng(5)
        self.value = rng.integers(0, 2**64, (2, _LIMIT), dtype=_U)
        size = CHUNK * 2 + 16
        base = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
        self.up = [np.cumprod(np.r_[_U(1), np.full(size, b, _U)]) for b in base]
        self.down = [np.cumprod(np.r_[_U(1), np.full(size, pow(b, -1, 2**64), _U)]) for b in base]
        self._clear()

    def _clear(self, need: int = 0) -> None:
        self.room = max(CAPACITY, need)
        self.slot = np.full(self.room * 4, -1, np.int32)
        self.key = np.zeros((2, self.room), _U)
        self.at, self.count = np.zeros(self.room, np.int64), np.zeros(self.room, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = self.filled = 0

    def plain(self, text: str) -> bool:
        return not _OTHER.search(text) and not any(s in text for s in self.special)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Entries of pre-tokens by their hashes; -1 where there is none."""
        out = np.full(a.size, -1, np.int64)
        todo = np.arange(a.size)
        at = (a >> _U(32)).astype(np.int64) % self.slot.size
        while todo.size:
            e = self.slot[at]
            hit = (e >= 0) & (self.key[0][e] == a[todo]) & (self.key[1][e] == b[todo])
            out[todo[hit]] = e[hit]
            go = (e >= 0) & ~hit
            todo, at = todo[go], (at[go] + 1) % self.slot.size
        return out

    def _learn(self, a: np.ndarray, b: np.ndarray, texts: list[str]) -> None:
        for x, y, t in zip(a.tolist(), b.tolist(), texts, strict=True):
            ids = self.merges._core_bpe.encode_single_piece(t.encode())
            k = self.used
            if self.filled + len(ids) > self.ids.size:
                self.ids = np.r_[self.ids, np.zeros(max(self.ids.size, len(ids)), np.uint32)]
            self.ids[self.filled : self.filled + len(ids)] = ids
            self.key[0][k], self.key[1][k], self.at[k], self.count[k] = x, y, self.filled, len(ids)
            self.filled += len(ids)
            self.used += 1
            at = (x >> 32) % self.slot.size
            while self.slot[at] >= 0:
                at = (at + 1) % self.slot.size
            self.slot[at] = k

    def _cut(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
        """(places in texts, their first pre-tokens and the end, lengths, entries) of chunks of plain texts, none empty."""
        for group in _groups(texts):
            points = np.frombuffer("".join(texts[k] for k in group).encode("utf-32-le"), np.uint32)
            first = np.r_[0, np.cumsum([len(texts[k]) for k in group])]
            s = starts(points, first[:-1])
            e = np.r_[s[1:], points.size]
            hashes = []
            for value, up, down in zip(self.value, self.up, self.down, strict=True):
                if points.size >= up.size:  # one very long text
                    up, down = _longer(up, points.size), _longer(down, points.size)
                sums = np.zeros(points.size + 1, _U)
                np.cumsum(value[points] * down[: points.size], out=sums[1:])
                h = (sums[e] - sums[s]) * up[s]
                hashes.append((h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9))
            a, b = hashes
            if self.room > CAPACITY:
                self._clear()
            entry = self._find(a, b)
            if (entry < 0).any():
                new = np.flatnonzero(entry < 0)
                if self.used + np.unique(a[new]).size > CAPACITY:
                    self._clear(np.unique(a).size)
                    new = np.arange(a.size)
                one = new[np.unique(a[new], return_index=True)[1]]
                self._learn(a[one], b[one], [points[i:j].tobytes().decode("utf-32-le") for i, j in zip(s[one], e[one], strict=True)])
                entry = self._find(a, b)
            yield group, np.searchsorted(s, first), (e - s).astype(np.int32), entry

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers."""
        if not self.ranked:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        own = [k for k, t in enumerate(texts) if t and self.plain(t)]
        for group, first, _, entry in self._cut_of(texts, own):
            count = self.count[entry]
            ends = np.cumsum(count)
            flat = np.arange(ends[-1]) + np.repeat(self.at[entry] - (ends - count), count)
            ids = self.ids[flat]
            bound = np.r_[0, ends][first]
            for k, i, j in zip(group, bound, bound[1:], strict=False):
                out[k] = ids[i:j]
        for k in set(range(len(texts))) - set(own):
            if texts[k]:
                out[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, np.uint32)
        return out

    def split(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text the lengths of its pre-tokens and their numbers of tokens; special strings are ordinary text."""
        if not self.ranked:
            raise ValueError("pre-tokens are known for byte-level BPE only, with ids in the order of merges")
        none = np.zeros(0, np.int32)
        out = [(none, none)] * len(texts)
        own = [k for k, t in enumerate(texts) if t and not _OTHER.search(t)]
        for group, first, lens, entry in self._cut_of(texts, own):
            count = self.count[entry]
            for k, i, j in zip(group, first, first[1:], strict=False):
                out[k] = (lens[i:j], count[i:j])
        for k in set(range(len(texts))) - set(own):
            if texts[k]:
                pieces = pre_tokens(texts[k])
                out[k] = (np.array([len(p) for p in pieces], np.int32), np.array([len(self.merges._core_bpe.encode_single_piece(p.encode("utf-8", "replace"))) for p in pieces], np.int32))
        return out

    def _cut_of(self, texts: list[str], own: list[int]) -> Iterator[tuple]:
        for group, *rest in self._cut([texts[k] for k in own]):
            yield [own[k] for k in group], *rest


def _longer(powers: np.ndarray, n: int) -> np.ndarray:
    return np.cumprod(np.r_[_U(1), np.full(n + 1, powers[1], _U)])


def _groups(texts: list[str]) -> Iterator[list[int]]:
    group: list[int] = []
    size = 0
    for k, t in enumerate(texts):
        if group and size + len(t) > CHUNK:
            yield group
            group, size = [], 0
        group.append(k)
        size += len(t)
    if group:
        yield group


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of any text."""
    import public_tokenizers
    import regex

    return regex.findall(public_tokenizers.PATTERN, text)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]
