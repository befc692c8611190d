"""Registered queries against their SQL, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from compare import check, connect
from cotejo.llm import decontam, linededup, ngramjoin, queries, quality
from cotejo.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    ok, note = check(spark, connect(SF), name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_answers_for_every_row(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert got.count() == table(spark, SF, "documents").count()


def test_pipeline_keeps_what_each_stage_keeps(spark):
    docs = table(spark, SF, "documents")
    kept = {r.doc_id: r.text for r in docs.collect()}
    scored = {r.doc_id: r.score for r in quality.score_documents(docs, quality.train(docs, table(spark, SF, "labels"))).collect()}
    kept = {i: t for i, t in kept.items() if scored[i] >= 0.3}
    from brute import contaminated, jaccard_classes
    from test_pairs_and_lines import drop_lines

    kept = dict(zip(kept, [x[2] for x in drop_lines(list(kept.values()), linededup.THRESHOLD)]))
    classes = jaccard_classes(list(kept.items()), corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    kept = {i: t for i, t in kept.items() if classes[i][1] == i}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    hits = contaminated(list(kept.values()), items, decontam.WINDOW)
    kept = {i: t for (i, t), h in zip(kept.items(), hits) if not h[1]}
    from cotejo.llm.tokens import read_text, tokenizer

    lib = tokenizer(read_text(queries.vocabulary("word_bpe_49k.json")))
    want = {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in kept.items()}
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()} == want
    assert 0 < len(want) < docs.count()
    assert ngramjoin.WORDS == 4


def test_stages_take_tables_without_rows_and_with_more_columns(spark):
    docs = table(spark, SF, "documents")
    for df in (docs.where("false"), docs.limit(40).selectExpr("*", "1 AS score", "2 AS n_dropped", "'x' AS _drop", "3 AS sid", "'q' AS _w")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == corpus_pipeline.COLUMNS
            assert out.count() <= df.count()
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() == df.count()


def test_near_duplicates_are_judged_row_by_row(spark):
    from brute import docs

    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c), (None, c), (None, "only here " * 9), (5, None), (5, ""), (6, "")]
    kept = corpus_pipeline.near_duplicates(spark, docs(spark, rows), SF).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept)
    assert got == sorted([(False, 1, a), (False, 2, b), (False, 4, c), (True, 0, "only here " * 9), (False, 5, ""), (False, 5, ""), (False, 6, "")])
