"""SentencePiece encoding and decoding by a table of each prefix's last token.

Merges of a BPE model never cross a place where two neighbouring characters stand together in no piece, so texts are cut there, and
each distinct segment of a block of texts is encoded once. For every prefix of a segment the table holds the last token of its
encoding. Segments seen before are remembered. Candidates are the pieces that an automaton finds ending there; exactly one of them goes with the last token of the prefix
before it. Two tokens go together if encoding the two as one string gives them back: no merge across their border may come before
the merges that made them. The ids of a segment are then read from its end backwards. Time is linear in the text, also for one long
run without white space.

The model must be of the merge type with byte fallback, an identity normaliser and escaped spaces; others raise ValueError. Characters
outside the vocabulary become their UTF-8 bytes. Null and empty texts have no ids and decode to the empty string. Repeated rows are
encoded one by one; ids may be null or repeat. Further columns don't matter.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cotejo.llm.common import distinct_segments, text_chunks

BLOCK_CHARACTERS = 1_000_000
#: pairs of tokens and segments that a worker remembers; beyond it the memory starts anew
_PAIRS, _SEGMENTS = 2_000_000, 200_000
SPACE = "▁"
_NO_TOKEN = -1


class MergeModel:
    """The pieces of a merge-type model with everything that the prefix table needs."""

    def __init__(self, blob: bytes) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.size = model.get_piece_size()
        ids = range(self.size)
        self.control = {i for i in ids if model.is_control(i)}
        self.unknown = model.unk_id()
        self.byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        plain = [i for i in ids if i not in self.control and i != self.unknown and not model.is_byte(i)]
        self.piece = {i: model.id_to_piece(i) for i in plain}
        self._refuse(model, plain)
        by_score = sorted({model.get_score(i) for i in plain}, reverse=True)
        place = {s: n for n, s in enumerate(by_score)}
        #: order of merges, 0 first; one beyond for "no piece"
        self.rank = np.full(self.size + 1, len(by_score), np.int64)
        self.rank[plain] = [place[model.get_score(i)] for i in plain]
        self.length = np.zeros(self.size + 1, np.int64)
        self.length[plain] = [len(self.piece[i]) for i in plain]
        self.id_of = {p: i for i, p in self.piece.items()}

        self.automaton = ahocorasick.Automaton()
        for i, p in self.piece.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        letters = sorted({c for p in self.piece.values() for c in p})
        #: a code for each character of the vocabulary, 0 for all others
        self.code = np.zeros(0x110000, np.int16)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.together = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in self.piece.values():
            at = self.code[[ord(c) for c in p]]
            self.together[at[:-1], at[1:]] = True
        self.gap = next(chr(c) for c in range(0xE000, 0x110000) if not self.code[c])

        self._split()
        self.all_reached = bool(self.reached[list(self.piece)].all())
        self._forget()
        self._known = np.zeros(0, np.int64)
        self._good = np.zeros(0, bool)

    def _refuse(self, model, plain: list[int]) -> None:
        probe = " ÅÅ ﬁ  x "
        kept = [i for i in model.encode(probe) if i not in self.byte_ids.values()]
        back = model.decode(model.encode(probe))
        if any(model.is_unused(i) for i in plain) or len(self.byte_ids) != 256 or back != probe or not kept:
            raise ValueError("only models with byte fallback, without unused pieces and without normalisation are read")
        if model.encode("") or not model.id_to_piece(model.encode("x")[0]).startswith(SPACE):
            raise ValueError("the model must set a space before the text")
        single = {p for p in self.piece.values() if len(p) == 1}
        if any(c not in single for p in self.piece.values() for c in p):
            raise ValueError("every character of a piece must be a piece")

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Plain merging of a short string: the symbols left, and the two parts of the last merge."""
        symbols, last = list(text), None
        while True:
            best = None
            for i in range(len(symbols) - 1):
                got = self.id_of.get(symbols[i] + symbols[i + 1])
                if got is not None and (best is None or self.rank[got] < best[0]):
                    best = (self.rank[got], i)
            if best is None:
                return symbols, last
            i = best[1]
            last = (symbols[i], symbols[i + 1])
            symbols[i : i + 2] = ["".join(last)]

    def _split(self) -> None:
        """How each piece comes about: its two parts; which pieces never do; and which are made of parts that come later than they."""
        n = self.size + 1
        self.left, self.right = np.full(n, _NO_TOKEN, np.int64), np.full(n, _NO_TOKEN, np.int64)
        self.reached, self.orderly = np.zeros(n, bool), np.ones(n, bool)
        for i in sorted(self.piece, key=lambda i: self.length[i]):
            p = self.piece[i]
            if len(p) == 1:
                self.reached[i] = True
                continue
            symbols, last = self.merge(p)
            if len(symbols) > 1:
                continue
            a, b = self.id_of[last[0]], self.id_of[last[1]]
            self.reached[i], self.left[i], self.right[i] = True, a, b
            later = [x for x in (a, b) if self.length[x] > 1 and self.rank[x] >= self.rank[i]]
            self.orderly[i] = not later and self.orderly[a] and self.orderly[b]
        made = sorted((self.id_of[p[:k]] * n + self.id_of[p[k:]], i) for i, p in self.piece.items() for k in range(1, len(p)) if p[:k] in self.id_of and p[k:] in self.id_of)
        self._pairs = np.array([m[0] for m in made], np.int64)
        self._makes = np.array([m[1] for m in made], np.int64)

    def _made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that a and b would make, or of none."""
        key = a * (self.size + 1) + b
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[at] == key, self.rank[self._makes[at]], self.rank[self.size])

    def go_together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a and b stay apart when a + b is encoded.

        Goes back in time from the whole tokens: the later of the two last merges at the border is undone, until single characters are
        left. A merge across the border may at no moment come before the next one that was undone. Of equal merges the leftmost comes first.
        """
        good = self.reached[a] & self.reached[b]
        for i in np.flatnonzero(good & ~(self.orderly[a] & self.orderly[b])):
            x, y = self.piece[int(a[i])], self.piece[int(b[i])]
            good[i] = self.merge(x + y)[0] == [x, y]
        open_ = np.flatnonzero(good & self.orderly[a] & self.orderly[b])
        x, y = a[open_].copy(), b[open_].copy()
        none = 4 * (self.rank[self.size] + 1)
        limit = np.full(len(open_), none - 1)
        while len(open_):
            across = self._made(x, y)
            bad = (across < self.rank[self.size]) & (4 * across + 1 < limit)
            good[open_[bad]] = False
            of_x = np.where(self.right[x] >= 0, 4 * self.rank[x], -1)
            of_y = np.where(self.left[y] >= 0, 4 * self.rank[y] + 2, -1)
            go = ~bad & ((of_x >= 0) | (of_y >= 0))
            open_, x, y, of_x, of_y = open_[go], x[go], y[go], of_x[go], of_y[go]
            later = of_x > of_y
            limit = np.where(later, of_x, of_y)
            x, y = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
        return good

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`go_together` through a memory of tested pairs; a may be `size`, the start, which goes with every token that comes about."""
        key = a * (self.size + 1) + b
        at = np.searchsorted(self._known, key)
        new = np.ones(len(key), bool)
        inside = at < len(self._known)
        new[inside] = self._known[at[inside]] != key[inside]
        if new.any():
            fresh = np.unique(key[new])
            x, y = fresh // (self.size + 1), fresh % (self.size + 1)
            start = x == self.size
            good = self.reached[y]
            good[~start] = self.go_together(x[~start], y[~start])
            if len(self._known) > _PAIRS:
                fresh, places = np.unique(key, return_inverse=True)
                x, y = fresh // (self.size + 1), fresh % (self.size + 1)
                start = x == self.size
                good = self.reached[y]
                good[~start] = self.go_together(x[~start], y[~start])
                self._known, self._good = fresh, good
                return good[places]
            put = np.searchsorted(self._known, fresh)
            self._known, self._good = np.insert(self._known, put, fresh), np.insert(self._good, put, good)
            at = np.searchsorted(self._known, key)
        return self._good[at]

    # ---- encoding

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments one after another, and how many each has. Segments are single unknown characters or known ones."""
        lengths = np.array([len(s) for s in segments], np.int64)
        begin = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        text = self.gap.join(segments) + self.gap
        matches = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int32).reshape(-1, 2)
        end, token = matches[:, 0] + 1, matches[:, 1]
        if not self.all_reached:
            end, token = end[self.reached[token]], token[self.reached[token]]
        place = end - np.repeat(begin, lengths + 1)[end - 1]
        order = np.argsort(place.astype(np.uint16) if len(place) and place.max() < 1 << 16 else place, kind="stable")
        end, token, place = end[order], token[order].astype(np.int64), place[order]
        start = end - self.length[token]
        last = np.full(len(text) + 1, _NO_TOKEN, np.int64)
        last[begin] = self.size
        cuts = np.concatenate((np.flatnonzero(np.diff(place, prepend=-1)), [len(place)]))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            before = last[start[lo:hi]]
            at = np.flatnonzero(before != _NO_TOKEN) + lo
            at = at[self.compatible(last[start[at]], token[at])]
            last[end[at]] = token[at]
        # backwards from the ends
        pos = begin + lengths
        own = np.flatnonzero(last[pos] != _NO_TOKEN)
        got_own, got_token, step = [own[:0]], [own[:0]], [own[:0]]
        at, turn = pos[own], 0
        while len(own):
            t = last[at]
            got_own.append(own)
            got_token.append(t)
            step.append(np.full(len(own), turn))
            at = at - self.length[t]
            more = at > begin[own]
            own, at, turn = own[more], at[more], turn + 1
        unknown = np.flatnonzero((last[pos] == _NO_TOKEN) & (lengths > 0))
        for i in unknown:
            data = segments[i].encode("utf-8", "surrogatepass")
            got_own.append(np.full(len(data), i))
            got_token.append(np.array([self.byte_ids[b] for b in data], np.int64))
            step.append(np.arange(len(data))[::-1])
        owners, tokens, steps = np.concatenate(got_own), np.concatenate(got_token), np.concatenate(step)
        order = np.lexsort((-steps, owners))
        return tokens[order].astype(np.int32), np.bincount(owners, minlength=len(segments))

    def _forget(self) -> None:
        self._number: dict[str, int] = {}
        self._ids, self._counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _remembered(self, segments: list[str]) -> np.ndarray:
        """Numbers of the segments in the worker's memory; those that are new to it are encoded now."""
        if len(self._number) > _SEGMENTS:
            self._forget()
        new = [s for s in segments if s not in self._number]
        if new:
            new = list(dict.fromkeys(new))
            ids, counts = self.encode_segments(new)
            self._number.update(zip(new, range(len(self._number), len(self._number) + len(new)), strict=True))
            self._ids, self._counts = np.concatenate((self._ids, ids)), np.concatenate((self._counts, counts))
        return np.fromiter(map(self._number.__getitem__, segments), np.int64, len(segments))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        spaced = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        sizes = np.array([len(t) for t in spaced], np.int64)
        joined = "".join(spaced)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = self.code[points]
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = ~self.together[code[:-1], code[1:]]
        cut[np.cumsum(sizes)] = True
        edge = np.flatnonzero(cut)
        begin, size = edge[:-1], np.diff(edge)
        first, which = distinct_segments(points, begin, size)
        number = self._remembered([joined[b : b + n] for b, n in zip(begin[first].tolist(), size[first].tolist(), strict=True)])[which]
        many = self._counts[number]
        upto = np.cumsum(many)
        take = np.arange(upto[-1]) - np.repeat(upto - many - (np.cumsum(self._counts) - self._counts)[number], many)
        doc = np.searchsorted(np.cumsum(sizes), begin, "right")
        return self._ids[take], np.bincount(doc, weights=many, minlength=len(texts)).astype(np.int64)

    # ---- decoding

    @functools.cached_property
    def surface(self) -> pa.BinaryArray:
        """The bytes of each id."""
        of = {i: p.replace(SPACE, " ").encode() for i, p in self.piece.items()} | {i: bytes([b]) for b, i in self.byte_ids.items()}
        of[self.unknown] = " ⁇ ".encode()
        return pa.array([of.get(i, b"") for i in range(self.size)], pa.binary())

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each list of ids: pieces joined, spaces back, the first one off; bytes that are no UTF-8 become U+FFFD each."""
        pieces = self.surface.take(pa.array(ids))
        data = b"".join([pieces.buffers()[2].to_pybytes()]) if len(ids) else b""
        width = np.diff(np.frombuffer(pieces.buffers()[1], np.int32, len(ids) + 1)) if len(ids) else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(width.astype(np.int64))))[np.concatenate(([0], np.cumsum(counts)))]
        first = np.concatenate(([0], np.cumsum(counts)))[:-1]
        out = []
        for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            strip = counts[i] and self.piece.get(int(ids[first[i]]), "").startswith(SPACE)
            out.append(_utf8(data[a + bool(strip) : b]))
        return out


def _utf8(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return re.sub("[\udc80-\udcff]", "�", data.decode("utf-8", "surrogateescape"))


@functools.lru_cache(maxsize=2)
def merge_model(blob: bytes) -> MergeModel:
    return MergeModel(blob)


def _spread(counts: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (array) of every document's text."""
    return _coded(docs, model, False)


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and decoded text of every document, in one pass."""
    return _coded(docs, model, True)


def _coded(docs: DataFrame, model: str, back: bool) -> DataFrame:
    sent = _checked(docs, model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merge_model(sent.value)
        for batch in batches:
            for start, texts in text_chunks(batch, "text", BLOCK_CHARACTERS):
                ids, counts = own.encode(texts)
                columns = {"doc_id": batch.column("doc_id").slice(start, len(texts)), "ids": _spread(counts, ids)}
                if back:
                    columns["decoded"] = pa.array(own.decode(ids, counts), pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>" + (", decoded string" if back else ""))


def decode(coded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and decoded text of stored ids (doc_id, ids); null ids are none, ids outside the vocabulary raise."""
    sent = _checked(coded, model)
    kind = coded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merge_model(sent.value)
        for batch in batches:
            lists = batch.column("ids").fill_null([])
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            counts = np.diff(lists.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(own.decode(flat, counts), pa.string())], ["doc_id", "ids", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def _checked(df: DataFrame, model: str):
    """The model's bytes for the tasks; the driver reads the file and refuses models of other kinds."""
    blob = Path(model).read_bytes()
    merge_model(blob)
    return df.sparkSession.sparkContext.broadcast(blob)
