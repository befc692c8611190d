"""BPE encoding and decoding through a table of distinct words.

No token crosses white space, so a text's ids are those of its words in turn. Documents are read in blocks of bounded size. Every
block sends its different words, packed by word hash, to the task of that hash; there each distinct word is encoded once and the ids
go back to the blocks that asked, in the order of the words. A block then puts ids into the places of its words. Should a block hold
other rows on its second reading (input whose order changes), the checksum of its words differs and it encodes them itself. However
often a word stands, each block sends it once, so no word is hot; there are as many buckets as the characters of all texts need.
Decoding looks every id up in the id-to-piece table, which is as large as the vocabulary; `decode` is the same as a DataFrame join.

Null and empty texts have no ids and decode to the empty string. Repeated rows are encoded one by one. Ids may be null or repeat.
Further columns don't matter.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from cotejo.llm.common import bounded_batches, digest, distinct_segments
from cotejo.llm.tokens import read_text, tokenizer

BLOCK_CHARACTERS = 6_000_000
#: characters of all texts for each bucket of words; what meets in a bucket is less, since a block sends a word once
BUCKET_CHARACTERS = 50_000_000
#: white space at which words are split; a subset of what the tokenizers drop
_SPLIT = re.compile(r"[ \t\n\r]+")
_SLICE = 400_000  # characters whose words are told apart at once
_WORDS = 2_000  # words that are encoded at once; the library's answers are far larger than their ids
_PLACES = 200_000  # words whose ids are put into place at once


def _blocks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, dict[str, list]]]:
    """Numbered blocks of rows, each of about BLOCK_CHARACTERS or a single longer text."""
    number, size, rows = 0, 0, {c: [] for c in columns}
    for batch in batches:
        values = {c: batch.column(c).to_pylist() for c in columns}
        for i, text in enumerate(values["text"]):
            n = len(text or "")
            if rows["text"] and size + n > BLOCK_CHARACTERS:
                yield number, rows
                number, size, rows = number + 1, 0, {c: [] for c in columns}
            size += n
            for c in columns:
                rows[c].append(values[c][i])
    if rows["text"]:
        yield number, rows


def distinct_words(texts: list[str | None]) -> list[str]:
    words: set[str] = set()
    for text in texts:
        words.update(_SPLIT.split(text or ""))
    words.discard("")
    return list(words)


def block_words(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of a block in order of appearance by slices, which of them each word is, and how many words each text has."""
    joined = "\n".join(t or "" for t in texts)
    starts = np.cumsum([0, *(len(t or "") + 1 for t in texts)])[:-1]
    index: dict[str, int] = {}
    numbers, counts, at = [], np.zeros(len(texts), np.int64), 0
    while at < len(joined):
        end = _cut_after(joined, at)
        points = np.frombuffer(joined[at:end].encode("utf-32-le", "surrogatepass"), np.uint32)
        word = (points != 32) & (points != 10) & (points != 9) & (points != 13)
        edge = np.diff(word.astype(np.int8), prepend=0, append=0)
        begin = np.flatnonzero(edge == 1)
        size = np.flatnonzero(edge == -1) - begin
        first, which = distinct_segments(points, begin, size)
        of_slice = [index.setdefault(joined[at + b : at + b + n], len(index)) for b, n in zip(begin[first].tolist(), size[first].tolist(), strict=True)]
        numbers.append(np.array(of_slice, np.int32)[which] if len(begin) else np.zeros(0, np.int32))
        counts += np.bincount(np.searchsorted(starts, begin + at, "right") - 1, minlength=len(texts))
        at = end
    return list(index), np.concatenate(numbers) if numbers else np.zeros(0, np.int32), counts


def _cut_after(text: str, at: int) -> int:
    """End of a slice that starts at `at`: white space within reach, or the end of a longer word."""
    reach = at + _SLICE
    if reach >= len(text):
        return len(text)
    cut = max(text.rfind(c, at, reach) for c in " \n\t\r")
    if cut < 0:
        cut = min((x for c in " \n\t\r" if (x := text.find(c, reach)) >= 0), default=len(text) - 1)
    return cut + 1


def _dealt(words: list[str], buckets: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(bucket, numbers of its words, the words packed in sorted order) for every bucket with words."""
    bucket = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words], np.int64)
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    order = order[np.argsort(bucket[order], kind="stable")]
    cuts = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(words))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[lo:hi]
        yield int(bucket[own[0]]), own, "\n".join([words[i] for i in own.tolist()]).encode("utf-8", "surrogatepass")


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=4).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def encode_decode(docs: DataFrame, vocabulary: str, buckets: int | None = None, texts: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids (array) and decoded; without `texts` the last two are left out.

    Tasks return ids and decoded texts; count and digests are expressions over them, so those that nobody selects cost nothing.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    content = read_text(vocabulary)
    drops_space(content)
    sent = spark.sparkContext.broadcast(content)
    kind_of_id = "<u2" if tokenizer(content).get_vocab_size() <= 1 << 16 else "<u4"
    if buckets is None:
        characters = docs.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-characters // BUCKET_CHARACTERS))
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _blocks(batches, ["text", "part"]):
            dealt = [(b, _pack(blob)) for b, _, blob in _dealt(distinct_words(rows["text"]), buckets)]
            if dealt:
                use, blobs = zip(*dealt, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows["part"][0]] * len(use), pa.int32()), pa.array([number] * len(use), pa.int32()), pa.array(use, pa.int32()), pa.array(blobs, pa.binary())],
                    ["part", "block", "bucket", "words"],
                )

    def answer(asked: pa.Table) -> pa.Table:
        encoder = tokenizer(sent.value)
        asked_words = asked.column("words").to_pylist()
        unpacked = lambda data: data.decode("utf-8", "surrogatepass").split("\n")
        known: set[str] = set()
        for b in asked_words:
            known.update(unpacked(_unpack(b)))
        words = sorted(known)
        del known
        length, flat = _encoded(encoder, words, kind_of_id)
        begin, number = np.cumsum(length) - length, {w: i for i, w in enumerate(words)}
        blobs, sums = [], []
        for b in asked_words:
            data = _unpack(b)
            own = np.array([number[w] for w in unpacked(data)], np.int64)
            blobs.append(_pack(length[own].astype("<u4").tobytes() + _gathered(flat, begin, length, own).tobytes()))
            sums.append(zlib.crc32(data))
        return asked.select(["part", "block", "bucket"]).append_column("check", pa.array(sums, pa.int64())).append_column("ids", pa.array(blobs, pa.binary()))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _blocks(batches, ["text", "part", "doc_id"]):
            lengths = np.array([-1 if t is None else len(t.encode("utf-8", "surrogatepass")) for t in rows["text"]], "<i8")
            blob = _pack("".join(t or "" for t in rows["text"]).encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows["part"][0]], pa.int32()), pa.array([number], pa.int32()), pa.array([rows["doc_id"]], pa.list_(id_type)), pa.array([lengths.tobytes()], pa.binary()), pa.array([blob], pa.binary())],
                ["part", "block", "ids_of", "lengths", "packed"],
            )

    id_type = pa.array([], type=_arrow_type(docs)).type

    def place(shipped: pa.Table, answers: pa.Table) -> pa.Table:
        encoder = tokenizer(sent.value)
        known = {b: (c, i) for b, c, i in zip(*(answers.column(n).to_pylist() for n in ("bucket", "check", "ids")), strict=True)}
        out = []
        for r in shipped.to_pylist():
            data, at, rows = _unpack(r["packed"]), 0, []
            for n in np.frombuffer(r["lengths"], "<i8").tolist():
                rows.append(None if n < 0 else data[at : at + n].decode("utf-8", "surrogatepass"))
                at += max(n, 0)
            del data
            words, which, counts = block_words(rows)
            many, flat, order = [], [], []
            for bucket, own, blob in _dealt(words, buckets):
                check, ids = known.get(bucket, (None, b""))
                if check == zlib.crc32(blob):
                    ids = _unpack(ids)
                    many.append(np.frombuffer(ids, "<u4", len(own)))
                    flat.append(np.frombuffer(ids, kind_of_id, -1, 4 * len(own)) if len(ids) > 4 * len(own) else np.zeros(0, kind_of_id))
                else:
                    length, ids = _encoded(encoder, [words[i] for i in own.tolist()], kind_of_id)
                    many.append(length)
                    flat.append(ids)
                order.append(own)
            del rows, words
            at = 0
            for ids, per_text in _in_place(which, counts, order, many, flat):
                decoded = pa.array(_decoded(sent.value, ids, per_text), pa.string())
                ends = pa.array(np.append(0, np.cumsum(per_text)), pa.int32())
                of = pa.array(r["ids_of"][at : at + len(per_text)], id_type)
                out.append(pa.table({"doc_id": of, "ids": pa.ListArray.from_arrays(ends, pa.array(ids)), "decoded": decoded}))
                at += len(per_text)
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], id_type), "ids": pa.array([], pa.list_(pa.int32())), "decoded": pa.array([], pa.string())})

    asked = source.mapInArrow(ask, "part int, block int, bucket int, words binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "part int, block int, bucket int, check long, ids binary")
    shipped = source.mapInArrow(ship, f"part int, block int, ids_of array<{kind}>, lengths binary, packed binary")
    placed = shipped.groupBy("part", "block").cogroup(answers.groupBy("part", "block")).applyInArrow(place, f"doc_id {kind}, ids array<int>, decoded string")
    return placed.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"), *(["ids", "decoded"] if texts else []),
    )


def _encoded(encoder, words: list[str], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """How many ids every word has, and the ids one after another."""
    length, flat = [np.zeros(0, np.int64)], [np.zeros(0, kind)]
    for at in range(0, len(words), _WORDS):
        got = [e.ids for e in encoder.encode_batch_fast(words[at : at + _WORDS], add_special_tokens=False)]
        length.append(np.array([len(g) for g in got], np.int64))
        flat.append(np.array([i for g in got for i in g], kind))
    return np.concatenate(length), np.concatenate(flat)


def _gathered(flat: np.ndarray, begin: np.ndarray, length: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The ids of words `own` one after another; word i has `length[i]` ids of `flat` from `begin[i]`."""
    many = length[own]
    upto = np.cumsum(many)
    return flat[np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin[own] - upto + many, many)]


def _in_place(which: np.ndarray, counts: np.ndarray, order: list, many: list, flat: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of the texts one after another and how many each has, by stretches of texts of about _PLACES words or a single longer text.

    `order`, `many` and `flat`: words by number, their counts of ids, the ids.
    """
    order, many, flat = (np.concatenate([np.zeros(0, k), *x]) for k, x in ((np.int64, order), (np.int64, many), (np.uint16, flat)))
    length, begin = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    length[order], begin[order] = many, np.cumsum(many) - many
    ends = np.cumsum(counts)
    start = 0
    while start < len(counts):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + _PLACES, "right")))
        own = which[before : ends[end - 1]]
        upto = np.append(0, np.cumsum(length[own]))
        yield _gathered(flat, begin, length, own).astype(np.int32), np.diff(upto[np.append(0, ends[start:end] - before)])
        start = end


def _decoded(content: str, ids: np.ndarray, per_text: np.ndarray) -> list[str]:
    """Text of every text's ids by the id-to-piece table; pieces are joined by spaces where the tokenizer has no decoder of its own."""
    encoder = tokenizer(content)
    ends = np.append(0, np.cumsum(per_text))
    if encoder.decoder is not None:
        return [encoder.decode(ids[a:b].tolist(), skip_special_tokens=False) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    if not len(ids):
        return [""] * len(per_text)
    got = _spaced_pieces(content).take(pa.array(ids))
    data, offsets = got.buffers()[2].to_pybytes(), np.frombuffer(got.buffers()[1], np.int64, len(ids) + 1)[ends].tolist()
    return [data[a : max(a, b - 1)].decode("utf-8", "surrogatepass") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _arrow_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


_PIECES: dict[str, dict[int, str]] = {}


def _pieces(text: str) -> dict[int, str]:
    """The id-to-piece table, special tokens included, made once per worker."""
    if text not in _PIECES:
        _PIECES.clear()
        _PIECES[text] = {i: w for w, i in tokenizer(text).get_vocab(with_added_tokens=True).items()}
    return _PIECES[text]


@functools.lru_cache(maxsize=2)
def _spaced_pieces(content: str) -> pa.LargeBinaryArray:
    """The piece of every id with a space behind, by id."""
    pieces = _pieces(content)
    return pa.array([(pieces[i] + " ").encode("utf-8", "surrogatepass") if i in pieces else b"" for i in range(max(pieces) + 1)], pa.large_binary())


def drops_space(content: str) -> None:
    """Raises for a tokenizer whose ids depend on white space: words could not stand for the text."""
    t = tokenizer(content)
    if t.encode(" a\n b ", add_special_tokens=False).ids != t.encode("a b", add_special_tokens=False).ids:
        raise ValueError("this tokenizer keeps white space; words can't be encoded on their own")


def vocabulary_table(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(id, piece) of the vocabulary, special tokens included."""
    pairs = pd.DataFrame(sorted(_pieces(read_text(vocabulary)).items()), columns=["id", "piece"])
    return docs.sparkSession.createDataFrame(pairs, "id int, piece string")


def decode(encoded: DataFrame, pieces: DataFrame) -> DataFrame:
    """doc_id and decoded text of stored ids (doc_id, ids) by a join with `pieces`, for tokenizers without a decoder of their own.

    The piece table is bounded by the vocabulary and may be broadcast. Unknown ids have no piece and are left out.
    """
    rows = encoded.select("doc_id", "ids", F.monotonically_increasing_id().alias("_row"))
    rows = rows.select("doc_id", "_row", F.posexplode_outer("ids").alias("at", "id"))
    named = rows.join(F.broadcast(pieces), "id", "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", "piece"))))
    return named.groupBy("_row", "doc_id").agg(parts.alias("p")).select("doc_id", F.array_join(F.col("p.piece"), " ").alias("decoded"))
