"""Line dedup, decontamination, n-gram join and components against plain Python."""

import hashlib
import random

import pytest

import brute
from cotejo.llm import components, decontam, linededup, ngramjoin


def texts(seed, n, words=60, vocab=400):
    r = random.Random(seed)
    return [" ".join(f"w{r.randrange(vocab)}" for _ in range(r.randrange(1, words))) for _ in range(n)]


def near(text, seed, edits):
    r = random.Random(seed)
    w = text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def classes(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_classes_equal_all_pairs(spark, k, percent):
    r = random.Random(k)
    base = texts(1, 40) + [" ".join(f"v{r.randrange(5000)}" for _ in range(300)) for _ in range(6)]
    # groups of near copies in chains, small sets around the boundary, boilerplate, equal texts and odd rows
    more = [near(t, i, e) for i, t in enumerate(base) for e in (0, 1, 1, 2, 4)]
    chain = [base[-1]]
    for i in range(12):
        chain.append(near(chain[-1], 100 + i, 4))
    passage = " ".join(f"p{i}" for i in range(55))
    shared = [f"{passage} {t}" for t in texts(7, 30, 40)] + [f"{t} {passage}" for t in texts(8, 30, 12)]
    tiny = [" ".join("abcdefghijklmnopqrstuvwxyz"[i : i + n]) for i in range(6) for n in range(1, 20)]
    odd = [None, "", "  \n\t", "A", "a", "a a a a a a a", "É é", "\x0b", "one two three", "ONE two\nthree"]
    rows = list(enumerate(base + more + chain + shared + tiny + odd))
    got = classes(ngramjoin.jaccard_classes(brute.docs(spark, rows), k, percent))
    assert got == brute.jaccard_classes(rows, k, percent)


def test_near_copies_of_one_text_in_a_large_group(spark):
    r = random.Random(5)
    base = " ".join(f"v{r.randrange(5000)}" for _ in range(200))
    rows = list(enumerate(near(base, i, i % 5) for i in range(300)))
    assert classes(ngramjoin.jaccard_classes(brute.docs(spark, rows))) == brute.jaccard_classes(rows, 4, 85)


def test_classes_of_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (None, None), (7, "x y")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in ngramjoin.jaccard_classes(brute.docs(spark, rows)).collect() if r.n_shingles)
    assert got == [(False, 3, 2, 3), (False, 5, 2, 3), (False, 5, 2, 3), (False, 7, 1, 7), (True, 0, 2, 3)]
    assert ngramjoin.jaccard_classes(brute.docs(spark, [])).count() == 0


def test_boundary_follows_cost():
    assert ngramjoin.boundary({n: 100 for n in range(1, 25)}, 85) >= 6
    assert ngramjoin.boundary({24: 1000}, 85, candidates=0.0) == 0
    assert ngramjoin.boundary({}, 85) == 0
    for n in range(1, 200):
        for m in ngramjoin.partners(n, 85):
            c = ngramjoin.overlap(n, m, 85)
            assert 100 * c >= 85 * (n + m - c) and 100 * (c - 1) < 85 * (n + m - c + 1)


def test_components_of_paths_stars_and_pairs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 400)] + [(900, 899), (5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(300, 400)]} | {899: 899, 900: 899}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- decontamination

ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (3, "a b c d e f g h i j"), (4, "A b-c d e f g h i, j"), (5, "..."), (6, None), (6, "Élan vital zwei drei"), (None, "null id item here")]
PAGES = [
    None, "", "!!!", "x one two three four five six seven eight nine ten eleven twelve y", "one two three four five six seven eight nine", "a short, ITEM here short item",
    "a b c d e f g h i j k a b c d e f g h i j", "élan vital zwei drei / Élan vital zwei drei", "short\nitem", "TWO three four five six seven eight nine ten eleven", "long " * 3000 + "short item",
]


@pytest.mark.parametrize("most", [50_000, 3])
def test_windows_equal_brute_force(spark, most):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute.contaminated(PAGES, [i for i in ITEMS if i[0] is not None] + [("?", "null id item here")])
    got = {r.doc_id: r for r in decontam.report(brute.docs(spark, PAGES), bench, set_windows=most).collect()}
    for i, (n, hit, owners) in enumerate(want):
        r = got[i]
        assert (r.n_words, r.n_hit, r.items, r.contaminated) == (n, len(hit), sorted(str(o) for o in owners), bool(hit)), i


def test_spans_and_documents_are_removed(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = {r.doc_id: r.text for r in decontam.remove(brute.docs(spark, PAGES), bench, "spans").collect()}
    assert kept[3] == "x y" and kept[2] == "!!!" and kept[0] is None and kept[5] == "a here" and kept[8] == ""
    clean = {r.doc_id for r in decontam.remove(brute.docs(spark, PAGES), bench).collect()}
    assert clean == {i for i, (_, hit, _) in enumerate(brute.contaminated(PAGES, ITEMS)) if not hit}


def test_no_benchmark_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontam.report(brute.docs(spark, ["a b"]), none).collect()] == [0]
    assert decontam.report(brute.docs(spark, []), none).count() == 0
    assert decontam.remove(brute.docs(spark, ["a b", None]), none).count() == 2


# ---- lines


def test_cuckoo_filter_finds_all_and_forgets():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(5000)]
    f = linededup.CuckooFilter.of(keys)
    assert f.contains(keys).all()
    other = [hashlib.md5(f"o{i}".encode()).digest() for i in range(5000)]
    assert f.contains(other).mean() < 0.01
    again = linededup.CuckooFilter.load(f.dump())
    assert all(again.delete(k) for k in keys[:4000])
    assert again.contains(keys[4000:]).all() and again.contains(keys[:4000]).mean() < 0.01
    assert not linededup.CuckooFilter.of([]).contains(keys).any()


def drop_lines(rows, threshold):
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: brute.fold(line.strip(blank))
    counts = {}
    for t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            counts[k] = counts.get(k, 0) + 1
    out = []
    for t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not key(x) or counts[key(x)] < threshold]
        out.append((len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def test_lines_equal_brute_force_and_deletion_restores(spark):
    r = random.Random(3)
    rows = [None, "", "\n\n", "É\né"] + ["\n".join(r.choice(["Common", " common ", "other", "É", "", f"l{r.randrange(30)}", "x\ty"]) for _ in range(r.randrange(1, 8))) for _ in range(120)]
    docs = brute.docs(spark, rows)
    index = linededup.LineIndex.empty(spark, threshold=10, shards=4).insert(docs)
    got = {x.doc_id: (x.n_lines, x.n_dropped, x.text or "") for x in index.clean(docs).collect()}
    assert [got[i] for i in range(len(rows))] == drop_lines(rows, 10)
    more = brute.docs(spark, ["common\nl1\nl2"] * 40, 1000)
    grown = index.insert(more)
    both = {x.doc_id: (x.n_lines, x.n_dropped, x.text or "") for x in grown.clean(docs).collect()}
    assert [both[i] for i in range(len(rows))] == drop_lines(rows + ["common\nl1\nl2"] * 40, 10)[: len(rows)]
    back = grown.delete(more)
    assert {x.doc_id: (x.n_lines, x.n_dropped, x.text or "") for x in back.clean(docs).collect()} == got
    count = lambda i: sorted((bytes(x.key), x.n_docs) for x in i.refs.collect())
    assert count(back) == count(index)
    assert {x.key for x in back.too_common(linededup.occurrences(docs, 4)).collect()} == {x.key for x in index.refs.where("n_docs >= 10").collect()}


def test_lines_of_repeated_rows_null_ids_and_no_rows(spark):
    docs = brute.docs(spark, [(None, "a\nb")] * 6 + [(4, "a\nc")] * 6)
    index = linededup.LineIndex.empty(spark).insert(docs)
    assert sorted((r.doc_id or 0, r.text, r.n_dropped) for r in index.clean(docs).collect()) == [(0, "b", 1)] * 6 + [(4, "c", 1)] * 6
    none = brute.docs(spark, [])
    assert linededup.LineIndex.empty(spark).insert(none).clean(none).count() == 0


# ---- given columns with the operators' own names


def test_removal_and_cleaning_keep_clashing_columns(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    names = ["_w", "_hits", "_hit", "_row", "_id", "_drop", "_doc", "_text", "key", "salt", "shard"]
    docs = brute.docs(spark, PAGES).selectExpr("*", *[f"concat('own ', doc_id) AS {n}" for n in names])
    for got in (decontam.remove(docs, bench), decontam.remove(docs, bench, "spans"), decontam.remove(docs, bench, "spans", set_windows=3)):
        assert got.columns == docs.columns
        assert all(r[n] == f"own {r.doc_id}" for r in got.collect() for n in names)
    docs = docs.selectExpr("*", "'given' AS n_lines", "'given' AS n_dropped")
    got = linededup.LineIndex.empty(spark).insert(docs).clean(docs)
    rows = got.collect()
    assert sorted(got.columns) == sorted(docs.columns) and len(rows) == len(PAGES)
    assert all(r[n] == f"own {r.doc_id}" for r in rows for n in names) and {r.doc_id: r.n_lines for r in rows}[8] == 2


def test_names_that_two_sets_share_are_told_apart(spark, monkeypatch):
    plain = ngramjoin.set_id
    rows = list(enumerate(["a b c d e f", "a b c d e f", "q r s t u v w", "x y"]))
    shared = plain(ngramjoin.shingle_sets([rows[0][1]])[0])
    assert ngramjoin.node_id(ngramjoin.shingle_sets([rows[0][1]])[0], frozenset([shared])) == plain(ngramjoin.shingle_sets([rows[0][1]])[0], 1) != shared
    assert ngramjoin.node_id(ngramjoin.shingle_sets([rows[0][1]])[0], frozenset()) == shared


def test_one_very_long_text_and_its_copy(spark):
    r = random.Random(9)
    long = " ".join(f"v{r.randrange(90_000)}" for _ in range(200_000))
    rows = [(4, long), (2, near(long, 1, 1000)), (7, near(long, 2, 20_000)), (9, "short text of some words")]
    got = classes(ngramjoin.jaccard_classes(brute.docs(spark, rows)))
    assert got == brute.jaccard_classes(rows, 4, 85) and got[4][1] == got[2][1] == 2 and got[7][1] == 7


def test_tasks_with_small_blocks_and_buckets(spark, monkeypatch):
    rows = list(enumerate(texts(11, 60) + [near(t, i, 1) for i, t in enumerate(texts(11, 60))]))
    assert classes(ngramjoin.jaccard_classes(brute.docs(spark, rows).repartition(7))) == brute.jaccard_classes(rows, 4, 85)


def test_small_batches_hold_all_rows_and_bound_their_text():
    import pyarrow as pa

    from cotejo.llm.common import small_batches

    b = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, 5]), pa.array(["ab", None, "c" * 9, "", "d"])], ["doc_id", "text"])
    assert [x.column("doc_id").to_pylist() for x in small_batches(iter([b, b.slice(0, 0)]), "text", 3)] == [[1, 2], [3], [4, 5]]
