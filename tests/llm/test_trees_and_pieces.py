"""Prefix trie, SentencePiece and fill-in-middle against plain Python and the library."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

import brute
from cotejo.llm import infill, pieces, queries, trie

TURNS = "conv_id long, turn long, role string, text string"

# ---- prefix trie


def brute_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [m[3:] for m in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - int(np.fmod(c, 5)), [])[:h] + own[c][h:])
    nodes = {}
    for c, path in whole.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    kids = {k: 0 for k in nodes}
    leaves, saved = dict(kids), dict(kids)
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
    ends = lambda k: ",".join(map(str, sorted(c for c in nodes[k] if len(whole[c]) == len(k))))
    key = lambda k: min(nodes[k])
    return sorted((key(k), len(k), key(k[:-1]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends(k).encode()).hexdigest()) for k, m in nodes.items())


def trie_rows(spark, rows, **options):
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS depth", "'x' AS d1", "2 AS shard")
    return sorted(tuple(r) for r in trie.prefix_trie(df, **options).collect())


def conversations(seed, n, longest):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]), f"t{r.randrange(3)}") for c in r.sample(range(-20, 4 * n), n) for t in range(r.randrange(1, longest))]


@pytest.mark.parametrize(("band", "shard_rows"), [(4096, 200_000), (3, 50), (1, 200_000)])
def test_trie_equals_brute_force(spark, band, shard_rows):
    rows = conversations(3, 60, 14)
    rows += [(700, t, "user", "same") for t in range(40)] + [(705, t, "user", "same") for t in range(35)]  # two long ones, with a common path
    rows += [(c, t, "user", "hello") for c in range(1000, 1060) for t in range(3)]  # many equal ones
    assert trie_rows(spark, rows, band=band, shard_rows=shard_rows) == brute_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (5, None, None, None), (5, 1, "user", ""), (5, 1, "user", ""), (5, 1, None, "é中"), (6, 1, "user", "long " * 50_000), (8, 3, "a", "b"), (8, None, "a", "b"), (3, 0, "user", "one turn")]
    assert trie_rows(spark, rows) == brute_trie(rows)
    turnless = [c for c in range(1, 3000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2][:4]
    rows = [(c, 0, "user", "x") for c in turnless]  # their group's first conversation is absent
    assert trie_rows(spark, rows) == brute_trie(rows) and len(brute_trie(rows)) == 1
    assert trie_rows(spark, []) == []


def test_many_ends_of_one_node_are_hashed_in_order(spark):
    ids = random.Random(4).sample(range(10**9), 30_000)
    df = spark.createDataFrame([(7, 8, i) for i in ids] + [(7, 9, 4)], "d1 long, d2 long, conv_id long")
    got = {(r.d1, r.d2): r.ends_sha256 for r in trie.ends_digests(df, 5).collect()}
    want = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
    assert got == {(7, 8): want(ids), (7, 9): want([4])}


def test_slots_are_a_perfect_hash():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        a, b = r.integers(-(2**63), 2**63 - 1, n), r.integers(-(2**63), 2**63 - 1, n)
        table = trie.PerfectHash(a, b)
        slot = table.slot(a, b)
        assert sorted(slot) == list(range(n))
        assert (table.slot(a, b ^ 1) == -1).all()
    a, b = np.array([5, 5, 6]), np.array([1, 2, 1])
    assert sorted(trie.PerfectHash(a, b).slot(a, b)) == [0, 1, 2]


# ---- SentencePiece

MODEL = queries.vocabulary("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
OWN = pieces.merge_model(open(MODEL, "rb").read())
ODD = [
    "", " ", "  ", "a", " a", "a ", "▁", "▁x y", "é", "﻿é", "😀", "a😀b", "中国人民", "\n", "\t\n ", "x\x00y", "<s>", "</s><unk><0x41>", "aaaaaaaa", " " * 777, "a" * 5000, "-" * 301,
    "ab" * 999, "don't stop", "½ ﬁ Å Å", "=" * 64 + " " * 65, "́́a", "1234567890" * 9, "  x",
]


def same_as_library(texts):
    ids, counts = OWN.encode(texts)
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == LIBRARY.encode(texts)
    assert OWN.decode(ids, counts) == [LIBRARY.decode(x) for x in LIBRARY.encode(texts)]


def test_ids_equal_the_library_on_odd_texts():
    same_as_library(ODD)
    r = random.Random(2)
    letters = ["a", "e", "th", "in", " ", "  ", "▁", "é", "😀", "\n", "中", "国", "aaa", "    ", "1", "ing", "==", "--", "//", "the", "<", "s", ">"]
    same_as_library(["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(3000)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=8))
def test_ids_equal_the_library_on_any_text(texts):
    same_as_library(texts)


def test_pairs_go_together_as_plain_merging_says():
    r = random.Random(3)
    ids = sorted(OWN.piece)
    a, b = np.array([r.choice(ids) for _ in range(4000)]), np.array([r.choice(ids) for _ in range(4000)])
    # and pairs whose characters make longer pieces
    cut = [(p[:k], p[k:]) for p in r.sample(list(OWN.piece.values()), 3000) for k in range(1, len(p)) if p[:k] in OWN.id_of and p[k:] in OWN.id_of]
    a, b = np.append(a, [OWN.id_of[x] for x, _ in cut]), np.append(b, [OWN.id_of[y] for _, y in cut])
    want = [OWN.merge(OWN.piece[int(x)] + OWN.piece[int(y)])[0] == [OWN.piece[int(x)], OWN.piece[int(y)]] for x, y in zip(a, b)]
    assert OWN.go_together(a, b).tolist() == want
    assert OWN.compatible(a, b).tolist() == want and OWN.compatible(a, b).tolist() == want


def test_memory_of_pairs_starts_anew(monkeypatch):
    monkeypatch.setattr(pieces, "_PAIRS", 50)
    same_as_library(["many different words here", "and others", "yet more of them", *ODD])


def test_any_ids_decode_as_in_the_library():
    r = random.Random(5)
    lists = [[r.randrange(3, OWN.size) for _ in range(r.randrange(12))] for _ in range(300)] + [[r.randrange(3, 259) for _ in range(6)] for _ in range(300)] + [[1, 5, 2], [0, 300], [3, 28705]]
    got = OWN.decode(np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists]))
    assert got == [LIBRARY.decode(x) for x in lists]


def test_documents_encode_and_decode(spark):
    rows = [*enumerate([None, *ODD]), (3, "twice"), (3, "twice"), (None, "no id")]
    df = brute.docs(spark, rows).selectExpr("*", "1 AS ids", "'x' AS decoded")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.ids, r.decoded) for r in pieces.encode_decode(df, MODEL).collect())
    assert got == sorted((i is not None, i or 0, LIBRARY.encode(t or ""), LIBRARY.decode(LIBRARY.encode(t or ""))) for i, t in rows)
    stored = pieces.encode(df, MODEL)
    assert stored.columns == ["doc_id", "ids"]
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids, r.decoded) for r in pieces.decode(stored, MODEL).collect()) == got
    assert pieces.encode_decode(brute.docs(spark, []), MODEL).count() == 0


# ---- fill-in-middle


def brute_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_infill_equals_brute_force_and_restores(spark):
    r = random.Random(6)
    texts = [None, "", " ", "\n\n", "a", " a ", "é 中\t😀", "has <P> inside", "<M>", "ends <", "<S", "word " * 40_000, "x" * 200_000, " " * 70_000 + "y", "   x"]
    texts += ["".join(r.choice(["a", "<", ">", "S", "P", " ", "\n", "é", "\x1c"]) for _ in range(r.randrange(30))) for _ in range(400)]
    rows = [*enumerate(texts), (3, "twice"), (3, "twice"), (None, "no id at all")] + [(1000 + i, t) for i, t in enumerate(texts)]
    df = brute.docs(spark, rows).selectExpr("*", "1 AS n", "'x' AS output", "2 AS form")
    made = infill.transform(df)
    back = infill.restored(made.output, made.form)
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", back.alias("back")).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:3], x[5])
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *brute_infill(i, t), t or "") for i, t in rows), key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.transform(brute.docs(spark, [])).count() == 0


@pytest.mark.parametrize("kind", ["array", "bitmap", "run", "mixed"])
def test_select_of_every_container(kind):
    r = np.random.default_rng(7)
    of = {"array": lambda lo: lo + np.unique(r.integers(0, 65536, 900)), "bitmap": lambda lo: lo + np.unique(r.integers(0, 65536, 40_000)), "run": lambda lo: lo + np.concatenate((np.arange(5, 9000), np.arange(20_000, 65_536)))}
    kinds = ["array", "bitmap", "run"] if kind == "mixed" else [kind]
    places = np.concatenate([of[k](65536 * 3 * i) for i, k in enumerate(kinds)])
    units = infill.BoundarySet(places)
    assert [c.kind for c in units.containers] == kinds and len(units) == len(places)
    at = sorted({0, 1, len(places) - 1, *r.integers(0, len(places), 300).tolist()})
    assert [units.select(k) for k in at] == places[at].tolist()
    with pytest.raises(IndexError):
        units.select(len(places))
