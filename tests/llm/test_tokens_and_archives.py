"""Encoding, token files and archives against the libraries themselves and exact round trips."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest

import brute
import corpus_pipeline
from cotejo.llm import tokenfiles, tokens, warc, wordbpe
from cotejo.llm.common import scratch
from cotejo.llm.queries import vocabulary

WORDS, BYTES = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "Hello, wörld don't STOP", "a  b", "a   b", " lead", "trail ", "tab\tand\nnew\n\n line\r\n end", "x \n y", "x\n y", "x\n\n  y", "nb sp   x", "é ́x", "ΣΑΣ σας İ ǅ",
    "<|endoftext|>", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>c", "日本語 テスト　字", "1234567 3.14 v2", "'s 't I'll  we've", "🙂🙃 \U0001f9d1‍\U0001f680", "\x00\x01 \x1c \x1d\x85x", "!!!??? ...", "word " * 5000, "q" * 20000,
]


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def test_word_encoding_equals_the_library(spark):
    lib = tokens.tokenizer(tokens.read_text(WORDS))
    for buckets in (1, 5):
        got = {r.doc_id: r for r in wordbpe.encode_decode(brute.docs(spark, TEXTS), WORDS, buckets, texts=True).collect()}
        for i, t in enumerate(TEXTS):
            ids = lib.encode(t or "", add_special_tokens=False).ids
            text = lib.decode(ids, skip_special_tokens=False)
            assert (got[i].ids, got[i].decoded, got[i].n_tokens) == (ids, text, len(ids)), repr(t)[:50]
            assert (got[i].ids_sha256, got[i].decoded_sha256) == (sha(" ".join(map(str, ids))), sha(text))
    stored = wordbpe.encode_decode(brute.docs(spark, TEXTS[:10]), WORDS, 3, texts=True)
    joined = {r.doc_id: r.decoded for r in wordbpe.decode(stored, wordbpe.vocabulary_table(stored, WORDS)).collect()}
    assert joined == {r.doc_id: r.decoded for r in stored.collect()}


def test_word_encoding_keeps_repeated_rows_and_null_ids(spark):
    rows = [(None, "a b"), (None, None), (3, "a"), (3, "a"), (3, "b c")]
    assert sorted((r.doc_id or 0, r.n_tokens) for r in wordbpe.encode_decode(brute.docs(spark, rows), WORDS).collect()) == [(0, 0), (0, 2), (3, 1), (3, 1), (3, 2)]
    assert wordbpe.encode_decode(brute.docs(spark, []), WORDS).count() == 0
    with pytest.raises(ValueError):
        wordbpe.encode_decode(brute.docs(spark, ["a"]), BYTES)


def test_ids_and_decoded_texts_come_back_by_default(spark):
    lib = tokens.tokenizer(tokens.read_text(WORDS))
    want = {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    for df in (wordbpe.encode_decode(brute.docs(spark, TEXTS), WORDS, 3), corpus_pipeline.encode(spark, brute.docs(spark, TEXTS), "")):
        assert {r.doc_id: (r.ids, r.decoded) for r in df.collect()} == {i: (ids, lib.decode(ids, skip_special_tokens=False)) for i, ids in want.items()}


def test_word_blocks_split_anywhere(spark, monkeypatch):
    lib = tokens.tokenizer(tokens.read_text(WORDS))
    rows = [f"word{i % 7} and more {i}" for i in range(200)]
    got = {r.doc_id: r.n_tokens for r in wordbpe.encode_decode(brute.docs(spark, rows).repartition(5), WORDS, 3).collect()}
    assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(rows)}


def test_whole_texts_equal_the_library():
    lib = tokens.tokenizer(tokens.read_text(BYTES))
    odd = [t or "" for t in TEXTS] + [a + b + c for a in ("x", "x\n", "\t", "") for b in (" ", "  ", " \n", "\n ", "  ") for c in ("y", " ", "\n", "")]
    encode = tokens.byte_encoder(tokens.read_text(BYTES))
    assert [encode(t).tolist() for t in odd] == [lib.encode(t, add_special_tokens=False).ids for t in odd]
    other = tokens.byte_encoder(tokens.read_text(WORDS))  # no byte-level file: the library itself
    assert other("Hello there").tolist() == tokens.tokenizer(tokens.read_text(WORDS)).encode("Hello there", add_special_tokens=False).ids


def test_token_files_hold_all_ids_in_order(spark):
    lib = tokens.tokenizer(tokens.read_text(BYTES))
    rows = [(i * 7 % 25, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (24, "again"), (10**12, "far")]
    folder = scratch(spark, "test")
    shards = tokenfiles.write_shards(brute.docs(spark, rows).repartition(4), folder, BYTES, 0, parts=5)
    got = sorted(tokenfiles.read_documents(shards, folder).collect(), key=lambda r: r.start)
    want = sorted(((-1 if i is None else i), [*lib.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows)
    assert [(-1 if r.doc_id is None else r.doc_id) for r in got] == [i for i, _ in want]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((i, len(ids), crc(ids)) for i, ids in want)
    table = shards.orderBy("shard").collect()
    assert len(table) > 2 and {r.bits for r in table} == {16}
    fs, _ = pafs.FileSystem.from_uri(folder)
    flat = np.concatenate([np.frombuffer(fs.open_input_file(f"{r.path}.bin").read(), "<u2") for r in table])
    assert len(flat) == at and (flat == 0).sum() >= len(rows)


def test_token_files_of_no_documents(spark):
    assert tokenfiles.token_files(brute.docs(spark, []), BYTES).count() == 0


PAGES = [
    (3, "u3", "x" * 200), (1, "u1", "x" * 200), (2, "u2", "x" * 200), (4, "u4", "short"), (5, "u5", "short"), (6, None, None), (7, "u 7\r\n", ""), (8, "u8", "é" * 50), (9, "u9", "é" * 50),
    (10, "u", "WARC/1.1\r\n\r\n" * 30), (11, "u", "\r\n\r\n" * 100), (1, "again", "x" * 200), (None, "n", "x" * 200), (12, "long", "y" * 3_000_000),
]


def test_archives_round_trip_and_revisits(spark):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int").repartition(3)
    got = sorted(warc.archive(pages).collect(), key=lambda r: (r.page_id or 0, r.record_type))
    assert len(got) == len(PAGES)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert {(3, "revisit", 1), (2, "revisit", 1), (1, "response", None), (4, "response", None), (5, "response", None), (9, "revisit", 8), (8, "response", None), (None, "response", None)} <= kinds
    want = {p: h or "" for p, _, h in PAGES}
    for r in got:
        assert r.payload_digest == sha(want[r.page_id]) if r.page_id else True
        if r.record_type == "response" and r.page_id:
            assert r.payload == want[r.page_id]


def test_archives_are_plain_warc(spark):
    data = warc.record("response", "http://a/", 5, "00", b"body", "2020-01-01T00:00:00Z")
    head, _, rest = data.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"Content-Length: 4" in head and rest == b"body\r\n\r\n"
    import gzip

    two = gzip.compress(data) + gzip.compress(warc.record("revisit", None, 6, "00", b"body", "2020-01-01T00:00:00Z", 5, "http://a/"))
    read = list(warc.records_in(io.BytesIO(two)))
    assert [h["WARC-Type"] for h, _ in read] == ["response", "revisit"]
    assert read[1][0]["WARC-Refers-To"] == read[0][0]["WARC-Record-ID"] and read[1][0]["WARC-Refers-To-Target-URI"] == "http://a/"
    assert read[1][0]["WARC-Refers-To-Date"] == read[0][0]["WARC-Date"] and read[1][0]["X-Payload-Length"] == "4" and read[1][1] == b""
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive(none).count() == 0


@pytest.mark.parametrize("reach", [7, 40, 2_000_000])
def test_words_of_a_block_are_those_of_its_texts(monkeypatch, reach):
    monkeypatch.setattr(wordbpe, "_SLICE", reach)
    r = random.Random(reach)
    for _ in range(100):
        texts = [None if r.random() < 0.1 else "".join(r.choice("ab \n\té😀\x0b") if r.random() < 0.97 else "x" * 60 for _ in range(r.randrange(60))) for _ in range(r.randrange(6))]
        words, which, counts = wordbpe.block_words(texts)
        want = [[w for w in re.split("[ \t\n\r]+", t or "") if w] for t in texts]
        assert [words[i] for i in which] == [w for x in want for w in x] and counts.tolist() == [len(x) for x in want]
        assert sorted(words) == sorted(wordbpe.distinct_words(texts))


def test_a_block_needs_little_memory_beside_its_text():
    import tracemalloc

    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(9000)}" for _ in range(1500)) for _ in range(300)]
    wordbpe.block_words(texts[:1])
    tracemalloc.start()
    words, which, counts = wordbpe.block_words(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(words) == 9000 and counts.sum() == len(which) == 450_000
    assert most < 30 * sum(map(len, texts))


def test_texts_go_to_the_workers_in_batches_of_bounded_size(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(setting)
    try:
        docs = brute.docs(spark, ["word " * 20_000] * 400).coalesce(1)
        coded = wordbpe.encode_decode(docs, WORDS, 2)
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 5_000_000
        assert [r.n_tokens for r in coded.select("n_tokens").collect()] == [20_000] * 400
        spark.conf.set(setting, "8m")
        wordbpe.encode_decode(docs, WORDS, 2)
        assert spark.conf.get(setting) == "8m"
    finally:
        spark.conf.unset(setting)


def test_places_and_answers_in_small_stretches(spark, monkeypatch):
    import numpy as np
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    words = ["alpha", "", "bet\u00e1gamma", "x" * 50]
    length, flat = wordbpe._encoded(library, words, "<u2")
    monkeypatch.setattr(wordbpe, "_WORDS", 1)
    again = wordbpe._encoded(library, words, "<u2")
    want = [library.encode(w, add_special_tokens=False).ids for w in words]
    assert length.tolist() == again[0].tolist() == [len(w) for w in want] and flat.tolist() == again[1].tolist() == sum(want, [])
    which, counts = np.array([2, 0, 0, 3, 1, 2]), np.array([0, 2, 0, 3, 1, 0])
    for places in (1, 2, 100):
        monkeypatch.setattr(wordbpe, "_PLACES", places)
        got = list(wordbpe._in_place(which, counts, [np.arange(4)], [length], [flat]))
        assert sum((ids.tolist() for ids, _ in got), []) == sum((want[i] for i in which), [])
        assert sum((n.tolist() for _, n in got), []) == [0, *(sum(len(want[i]) for i in x) for x in ([2, 0], [], [0, 3, 1], [2])), 0]
    assert [n.tolist() for _, n in wordbpe._in_place(which[:0], np.zeros(2, np.int64), [], [], [])] == [[0, 0]]


def test_equal_hashes_of_different_segments_stay_apart(monkeypatch):
    import numpy as np

    from cotejo.llm import common

    points = np.frombuffer("abcabdabc".encode("utf-32-le"), np.uint32)
    begin, size = np.array([0, 3, 6]), np.array([3, 3, 3])
    first, which = common.distinct_segments(points, begin, size)
    assert len(first) == 2 and which[0] == which[2] != which[1]

    class Blind:  # all sums are equal
        @staticmethod
        def reduceat(values, at):
            return np.zeros(len(at), np.uint64) if values.dtype == np.uint64 else np.array([values[a:b].sum() for a, b in zip(at, [*at[1:], len(values)])])

    monkeypatch.setattr(common.np, "add", Blind)
    first, which = common.distinct_segments(points, begin, size)
    assert points[begin[first][which][1] + 2] == ord("d") and begin[first][which][0] == 0


def test_every_revisit_names_a_record_of_the_archives(spark):
    body = "x" * 200
    pages = spark.createDataFrame([(3, None, body), (1, "http://a/", body), (1, "http://b/", body), (2, "http://c/", body), (9, "u", "y" * 300), (8, "v", "y" * 300), (4, "w", "short")], "page_id long, url string, html string")
    folder = scratch(spark, "warc-test")
    files = warc.write_archives(pages, folder)
    heads = []
    for r in files.collect():
        fs, path = pafs.FileSystem.from_uri(folder)
        with fs.open_input_file(r.path) as data:
            heads += [h for h, _ in warc.records_in(data)]
    assert len([h for h in heads if h["WARC-Type"] == "warcinfo"]) == files.count()
    by_id = {h["WARC-Record-ID"]: h for h in heads if h["WARC-Type"] == "response"}
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 3
    for h in revisits:
        first = by_id[h["WARC-Refers-To"]]
        assert (first["X-Page-ID"], first["WARC-Target-URI"], first["WARC-Date"]) == (h["X-Refers-To-Page-ID"], h["WARC-Refers-To-Target-URI"], h["WARC-Refers-To-Date"])
        assert first["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] and first["X-Payload-Length"] == h["X-Payload-Length"]
