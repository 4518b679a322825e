"""Token counts that follow edits.

`trees` keeps a row for each document: its text and, for each pre-token, characters and tokens, from which a segment
tree is set up without encoding: its leaves hold some pre-tokens each with their text, its inner nodes sums. An edit (a range of characters and what replaces it) finds the leaves that it touches by
the sums, encodes their text again, with as many leaves behind them as it takes until a pre-token begins where a leaf
began before, and updates the sums above; leaves that become large are split. The rest of the text is neither encoded nor copied. The edited
rows can be kept and edited again.

Null texts and edits count as empty; edits without a document are ignored. Edits of a document are applied in order of
`start` from the last, so that places are those of the text before; edits that overlap one behind them are skipped,
and so are those outside the text. Special tokens' strings are ordinary text here. Very long texts have deep trees.
Rows that share a doc_id get the same edits. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path, written
from .tokens import Vocabulary, vocabulary

#: Pre-tokens of a leaf when it is made, and those that it may come to have.
LEAF, FULL = 32, 128
#: Characters beyond a place that decide whether a pre-token ends there.
AHEAD = 4


class TokenTree:
    """Sums of characters and tokens over leaves of pre-tokens; node k has the children 2k and 2k + 1."""

    def __init__(self, text: str, words: Vocabulary, lens: np.ndarray, toks: np.ndarray):
        self.words, self.encoded = words, 0
        self.leaves = self._made(text, lens, toks) or [("", lens, toks)]
        self._sum()

    @staticmethod
    def _made(text: str, lens: np.ndarray, toks: np.ndarray, size: int = LEAF) -> list[tuple[str, np.ndarray, np.ndarray]]:
        """Leaves of so many pre-tokens: their text, and characters and tokens of each."""
        at = np.arange(0, lens.size, size)
        cuts = [0, *np.cumsum(np.add.reduceat(lens, at)).tolist()] if at.size else []
        return [(text[s:e], lens[i : i + size], toks[i : i + size]) for i, s, e in zip(at.tolist(), cuts, cuts[1:], strict=False)]

    def _sum(self) -> None:
        self.n = 1
        while self.n < len(self.leaves):
            self.n *= 2
        pad = [0] * (self.n - len(self.leaves))
        self.chars = [0] * self.n + [len(t) for t, _, _ in self.leaves] + pad
        self.tokens = [0] * self.n + [int(x.sum()) for _, _, x in self.leaves] + pad
        for k in range(self.n - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def size(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(t for t, _, _ in self.leaves)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([x for _, x, _ in self.leaves]), np.concatenate([x for _, _, x in self.leaves])

    def leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at `at`, and where it starts; the last one that holds any beyond the end."""
        k, start = 1, 0
        while k < self.n:
            k *= 2
            if at - start >= self.chars[k] and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        return k - self.n, start

    def _set(self, leaf: int, own: tuple[str, np.ndarray, np.ndarray]) -> None:
        self.leaves[leaf] = own
        k = leaf + self.n
        self.chars[k], self.tokens[k] = len(own[0]), int(own[2].sum())
        while k > 1:
            k //= 2
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters [start, end). A pre-token looks at most two characters beyond its own."""
        first, at = self.leaf(max(0, start - 3))
        while at > 0 and at > start - 3:
            first, at = self.leaf(at - 1)
        last, stop, more = first, at + len(self.leaves[first][0]), 1
        while True:
            while stop < end:
                last += 1
                stop += len(self.leaves[last][0])
            old = "".join(t for t, _, _ in self.leaves[first : last + 1])
            region = old[: start - at] + new + old[end - at :]
            ahead, k = "", last + 1
            while len(ahead) < AHEAD and k < len(self.leaves):
                ahead += self.leaves[k][0][:AHEAD]
                k += 1
            lens, toks = self.words.split([region + ahead])[0]
            self.encoded += len(region) + len(ahead)
            ends = np.cumsum(lens)
            n = int(np.searchsorted(ends, len(region), "right"))
            if not ahead or not region or n and ends[n - 1] == len(region):
                break
            # A pre-token goes on behind the region: take in more leaves.
            for _ in range(min(more, len(self.leaves) - 1 - last)):
                last += 1
                stop += len(self.leaves[last][0])
            more *= 2
        lens, toks, slots = lens[:n], toks[:n], last - first + 1
        if n <= slots * FULL:
            made = self._made(region, lens, toks, max(LEAF, -(-n // slots)))
            for k in range(slots):
                self._set(first + k, made[k] if k < len(made) else ("", lens[:0], toks[:0]))
        else:
            self.leaves[first : last + 1] = self._made(region, lens, toks)
            self._sum()


def _apply(tree: TokenTree, edits: list[tuple[int, int, str]]) -> int:
    done, limit = 0, tree.size
    for start, end, new in sorted(edits, key=lambda e: (-e[0], -e[1])):
        if 0 <= start <= end <= limit:
            tree.edit(start, end, new or "")
            limit, done = start, done + 1
    return done


_TREES = "doc_id long, text string, lens binary, toks binary"
_EDITED = f"{_TREES}, n_tokens long, n_edits int, n_tokens_edited long, n_chars_edited long, n_chars_encoded long"
COUNTS = ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "n_chars_encoded"]


def _packed(x: np.ndarray) -> bytes:
    """Numbers, in a byte each where they fit; the first byte says which."""
    return b"\1" + x.astype(np.uint8).tobytes() if not x.size or x.max() < 256 else b"\4" + x.astype("<u4").tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<u4" if x[0] == 4 else np.uint8, offset=1).astype(np.int64)


def trees(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """_TREES of each document, to be written and kept."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = vocabulary(tokenizer or tokenizer_path("byte_bpe_50k.json"))
        for b in batches:
            both = words.split([t or "" for t in b])
            yield pd.DataFrame({"lens": [_packed(x) for x, _ in both], "toks": [_packed(x) for _, x in both]})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.pandas_udf(run, "lens binary, toks binary")(F.col("text")).alias("_t"))
    return out.select("doc_id", "text", "_t.lens", "_t.toks")


def _edited(words: Vocabulary, b: pd.DataFrame, edits: list[list[tuple[int, int, str]]]) -> pd.DataFrame:
    out = []
    for doc, text, lens, toks, own in zip(b["doc_id"], b["text"], b["lens"], b["toks"], edits, strict=True):
        sizes = _unpacked(toks)
        before = int(sizes.sum())
        if not own:
            out.append((doc, text, lens, toks, before, 0, before, len(text), 0))
            continue
        tree = TokenTree(text, words, _unpacked(lens), sizes)
        n = _apply(tree, own)
        out.append((doc, tree.text, *map(_packed, tree.arrays()), before, n, tree.total, tree.size, tree.encoded))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _EDITED.split(", ")])


def edited(kept: DataFrame, edits: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """_EDITED: the rows of `trees` after the edits (doc_id, start, end in characters, replacement), and their counts."""
    lists = edits.filter("start IS NOT NULL AND end IS NOT NULL").groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "replacement")).alias("edits")).withColumnRenamed("doc_id", "_d")
    rows = kept.join(lists, F.col("doc_id") == F.col("_d"), "left").select("doc_id", "text", "lens", "toks", "edits")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(tokenizer or tokenizer_path("byte_bpe_50k.json"))
        for b in batches:
            yield _edited(words, b, [[] if e is None else [(int(x["start"]), int(x["end"]), x["replacement"]) for x in e] for e in b["edits"]])

    return rows.mapInPandas(run, _EDITED)


def replaced(kept: DataFrame, pattern: str, replacement: str, tokenizer: str | None = None) -> DataFrame:
    """_EDITED where the edits put `replacement` for each match of `pattern` (Python) in a text; in one pass, without a join."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, found = vocabulary(tokenizer or tokenizer_path("byte_bpe_50k.json")), re.compile(pattern)
        for b in batches:
            yield _edited(words, b, [[(m.start(), m.end(), replacement) for m in found.finditer(t)] for t in b["text"]])

    return kept.select("doc_id", "text", "lens", "toks").mapInPandas(run, _EDITED)


def count_edited(docs: DataFrame, edits: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """COUNTS of each document after `edits`."""
    return edited(written(trees(docs, tokenizer), "trees"), edits, tokenizer).select(COUNTS)


def count_replaced(docs: DataFrame, pattern: str, replacement: str, tokenizer: str | None = None) -> DataFrame:
    """COUNTS of each document after the edits of `replaced`."""
    return replaced(written(trees(docs, tokenizer), "trees"), pattern, replacement, tokenizer).select(COUNTS)
