"""Sequence similarity as an Arrow batch function; Spark has no built-in with the same result."""

from __future__ import annotations

from collections.abc import Generator, Iterator, Sequence
from difflib import SequenceMatcher
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word of `a` per step (integers as bit rows)."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


#: texts and letters of a block that are compared in one pass; cells of the table of letters and places that is built at once
_BLOCK, _BLOCK_LETTERS, _CELLS = 64, 65_536, 4_000_000
#: bits between texts, and the steps after which the carries counted there are cleared
_GAP, _STRETCH = 6, 63


def _letter_counts(texts: Sequence[str]) -> np.ndarray:
    """A row for each text: how often letters occur, those of one last byte together."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    counts = np.bincount(owner * 256 + (codes & 255), minlength=256 * len(texts)).reshape(-1, 256)
    return counts[:, counts.any(0)].astype(np.int32)


class CommonSubsequences:
    """Lengths of the longest common subsequences of one text with many texts, found in the same pass over that one.

    The texts lie behind each other in one bit row, with bits between them that take up the carries.
    """

    def __init__(self, texts: Sequence[str]) -> None:
        self.texts, self.sizes = texts, np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes + _GAP)
        self.starts = self.ends - self.sizes - _GAP
        gap = "\n" * _GAP
        codes = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.inside = np.ones(len(codes), bool)
        self.inside[(self.ends[:, None] - np.arange(1, _GAP + 1)).ravel()] = False
        row = lambda bits: int.from_bytes(bits.tobytes(), "little")
        self.full = row(np.packbits(self.inside, bitorder="little"))
        #: places of a letter, and all others
        self.masks: dict[str, tuple[int, int]] = {}
        # a few letters at a time where texts are long
        letters, step = np.unique(codes), max(1, _CELLS // len(codes))
        for first in range(0, len(letters), step):
            some = letters[first : first + step]
            at = np.packbits((codes == some[:, None]) & self.inside, axis=1, bitorder="little")
            self.masks.update((ch, (mask, self.full ^ mask)) for ch, mask in zip(map(chr, some.tolist()), map(row, at)))

    @cached_property
    def counts(self) -> np.ndarray:
        return _letter_counts(self.texts)

    def near(self, k: int, first: int, bound: float) -> np.ndarray:
        """Those of the `first` texts whose ratio with text `k` the common subsequence lets reach the bound."""
        return self.reached(self.texts[k], _hope(self.counts[:first], self.counts[k], self.sizes[:first], len(self.texts[k]), bound), bound)

    def reached(self, text: str, hope: np.ndarray, bound: float) -> np.ndarray:
        """Those of the first texts named by `hope` whose ratio with `text` the common subsequence lets reach the bound."""
        if not hope.any():
            return np.flatnonzero(hope)
        first = int(np.flatnonzero(hope)[-1]) + 1
        hope, total = hope[:first], np.maximum(self.sizes[:first] + len(text), 1)
        at, lengths, walk = 0, np.zeros(first, np.int64), self._walk(text, first)
        next(walk)
        while at < len(text):
            # no text can fall below the bound before the letters are passed that the best one may still miss, and less than half are missed
            spare = (lengths + (len(text) - at) - bound * total / 2)[hope].max()
            at = min(len(text), at + 12 + int(2.5 * spare))
            lengths = walk.send(at)
            hope = hope & (2.0 * (lengths + (len(text) - at)) / total >= bound)
            if not hope.any():
                break
        return np.flatnonzero(hope)

    def lengths(self, k: int, first: int) -> np.ndarray:
        """One length for each of the `first` texts (at least one)."""
        walk = self._walk(self.texts[k], first)
        next(walk)
        return walk.send(len(self.texts[k]))

    def _walk(self, text: str, first: int) -> Generator[np.ndarray | None, int, None]:
        """Gets places in `text` and gives the lengths up to there."""
        n = int(self.ends[first - 1])
        row = full = self.full & ((1 << n) - 1)
        at, stop = 0, (yield None)
        while True:
            for start in range(at, stop, _STRETCH):
                for mask, others in filter(None, map(self.masks.get, text[start : min(stop, start + _STRETCH)])):
                    row = (row + (row & mask)) | (row & others)
                row &= full
            left = np.unpackbits(np.frombuffer(row.to_bytes((n + 7) // 8, "little"), np.uint8), count=n, bitorder="little")
            at, stop = stop, (yield np.add.reduceat(self.inside[:n] & (left == 0), self.starts[:first], dtype=np.int64))


def _hope(counts: np.ndarray, own: np.ndarray, sizes: np.ndarray, size: int, bound: float) -> np.ndarray:
    """Do the letters in common let the ratio reach the bound?"""
    return 2.0 * np.minimum(counts, own).sum(1) / np.maximum(sizes + size, 1) >= bound


def near_pairs(texts: Sequence[str], bound: float, part: int = 0, parts: int = 1) -> Iterator[tuple[int, int]]:
    """Numbers of different texts whose common subsequence lets the ratio reach the bound, each pair once.

    Texts go by length, longer ones first, in blocks of like length; a shorter one is passed over the blocks that its length can reach.
    `part` takes one of `parts` shares of the shorter texts.
    """
    if len(texts) < 2:
        return
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = [len(texts[i]) for i in order]
    lengths, counts = np.array(sizes, np.int64), _letter_counts([texts[i] for i in order])
    reach = lambda long, short: 2.0 * short >= bound * (long + short)
    start = 0
    while start < len(order):
        end, room = start + 1, _BLOCK_LETTERS - sizes[start]
        while end < len(order) and end - start < _BLOCK and sizes[end] <= room and reach(sizes[start], sizes[end]):
            room -= sizes[end]
            end += 1
        packed = None
        for k in range(start + 1, len(order)):
            stop = min(k, end)
            if not reach(sizes[stop - 1], sizes[k]):
                break
            if k % parts == part:
                hope = _hope(counts[start:stop], counts[k], lengths[start:stop], sizes[k], bound)
                if hope.any():
                    packed = packed or CommonSubsequences([texts[i] for i in order[start:end]])
                    for i in packed.reached(texts[order[k]], hope, bound):
                        yield order[start + i], order[k]
        start = end


def ratio_at_least(matcher: SequenceMatcher, bound: float) -> float:
    """The exact ratio when it can reach the bound, else -1.

    The matched blocks form a common subsequence, so its length limits the ratio; that and the cheap
    character bounds spare most of the slow block search.
    """
    if matcher.real_quick_ratio() < bound or matcher.quick_ratio() < bound:
        return -1.0
    total = len(matcher.a) + len(matcher.b)
    if total and 2.0 * common_subsequence(matcher.a, matcher.b) / total < bound:
        return -1.0
    return matcher.ratio()


def _ratios(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    matcher = SequenceMatcher(None)
    for left, right in batches:
        out, held = [], None
        for a, b in zip(left, right):
            if a is None or b is None:
                out.append(None)
                continue
            if b != held:
                matcher.set_seq2(b)
                held = b
            matcher.set_seq1(a)
            out.append(matcher.ratio())
        yield pd.Series(out, dtype="float64")


def seq_ratio(left: Column, right: Column) -> Column:
    """Matching-block ratio of two strings; not symmetric, so argument order matters."""
    return F.pandas_udf(_ratios, "double")(left, right)
