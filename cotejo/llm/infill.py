"""Fill-in-middle: cuts texts into prefix, middle and suffix and puts them into training order.

A text's cut places are the ends of its tokens (`[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+`, or trailing white space). They are kept in a
boundary set: places are dealt by their high bits to containers of 65,536 places, each an array, a bitmap or a list of runs, whichever
is smallest. Cumulative cardinalities say which container holds the k-th place, a select inside the container says which place it is; so
both cut offsets of a document come from two selects, however long the text.

Random choices are the first four 8-digit groups of the SHA-256 of `seed:doc_id`. Texts that are empty, hold a marker or are not chosen
stay plain. Null texts are empty; a null doc_id counts as the empty string. Repeated rows are cut alike. Further columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cotejo.llm.common import text_chunks

#: The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SUFFIX_FIRST = 42, 50, 80
_HIGH = 16
_SPAN = 1 << _HIGH


class Container:
    """Sorted places below 65,536 as an array, a bitmap or runs, with select by rank."""

    def __init__(self, low: np.ndarray) -> None:
        starts = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-2) != 1)
        costs = {"array": 2 * len(low), "bitmap": _SPAN // 8, "run": 4 * len(starts)}
        self.kind = min(costs, key=costs.get)
        if self.kind == "array":
            self.data = low.astype(np.uint16)
        elif self.kind == "bitmap":
            bits = np.zeros(_SPAN, np.uint8)
            bits[low] = 1
            self.data = np.packbits(bits, bitorder="little")
            words = np.bitwise_count(self.data.view(np.uint64)).astype(np.int64)
            self.before = np.concatenate(([0], np.cumsum(words)))
        else:
            sizes = np.diff(np.append(starts, len(low)))
            self.data = low[starts].astype(np.uint16)
            self.before = np.concatenate(([0], np.cumsum(sizes)))

    def select(self, k: int) -> int:
        """The place of rank k, from 0."""
        if self.kind == "array":
            return int(self.data[k])
        i = int(np.searchsorted(self.before, k, "right")) - 1
        rest = k - int(self.before[i])
        if self.kind == "run":
            return int(self.data[i]) + rest
        word = np.unpackbits(self.data[8 * i : 8 * i + 8], bitorder="little")
        return 64 * i + int(np.flatnonzero(word)[rest])


class BoundarySet:
    """Sorted distinct places of any size in containers."""

    def __init__(self, places: np.ndarray) -> None:
        high = places >> _HIGH
        first = np.flatnonzero(np.diff(high, prepend=-1))
        self.high = high[first]
        self.before = np.append(first, len(places))
        self.containers = [Container(places[a:b] & (_SPAN - 1)) for a, b in zip(self.before[:-1], self.before[1:], strict=True)]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        if not 0 <= k < len(self):
            raise IndexError(k)
        i = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.high[i]) * _SPAN + self.containers[i].select(k - int(self.before[i]))


def boundaries(points: np.ndarray) -> np.ndarray:
    """Ends of the tokens of a text given as code points."""
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
    return np.append(ends, len(points)) if len(points) and blank[-1] else ends


def choices(doc_id, seed: int = SEED) -> list[int]:
    """Four numbers below 2^32 that depend on seed and id alone."""
    text = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(text[8 * i : 8 * i + 8], 16) for i in range(4)]


def cut(doc_id, text: str, points: np.ndarray, seed: int, rate: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, characters of prefix and middle, and the text in training order."""
    ends = boundaries(points)
    n = len(ends)
    h = choices(doc_id, seed)
    if not text or h[2] % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    units = BoundarySet(ends)
    a, b = (units.select(k - 1) if k else 0 for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and the output text.

    `rate` is the percentage of documents that are cut, `suffix_first` that of the cut ones whose suffix comes first.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_chunks(batch, "text"):
                ids = batch.column("doc_id").slice(start, len(texts))
                points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
                at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
                rows = [cut(i, t, points[a:b], seed, rate, suffix_first) for i, t, a, b in zip(ids.to_pylist(), texts, at[:-1], at[1:], strict=True)]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that `output` was made from. No marker stands in a cut text, and none can arise across a cut, so there are four parts."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
