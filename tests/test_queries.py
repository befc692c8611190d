"""Every registered query against its SQL twin, on the smallest tables."""

from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cotejo.plans import queries_boxes, queries_text, registry
from cotejo.plans.derived import table
from compare import check, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.QUERIES, registry.ORACLE_SQL


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    ok, note = check(spark, con, name, QUERIES[name], ORACLE[name], SF)
    assert ok, note


# ---- queries without SQL: against plain Python on the same tables


def _rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def _greedy(sri, pdf):
    """(doc, sri_no, pdf_no, ratio): every line in order takes its best free line, the first of equals."""
    by_doc, out = {}, []
    for doc, no, text in sorted(pdf):
        by_doc.setdefault(doc, []).append((no, text))
    used = set()
    for doc, no, text in sorted(sri):
        best, score = None, -1.0
        for other, words in by_doc.get(doc, []):
            if (doc, other) not in used:
                r = SequenceMatcher(None, text.upper(), words.upper()).ratio()
                if r > score:
                    best, score = other, r
        if best is not None and score >= 0.6:
            used.add((doc, best))
            out.append((doc, no, best, round(score, 6)))
    return out


def _sides(spark):
    names = ("doc_id", "item_no", "descripcion", "cantidad", "precio_unitario", "precio_total")
    return [_rows(side, *names) for side in queries_boxes._two_sides(spark, SF)]


def brute_item_match(spark):
    sri, pdf = _sides(spark)
    return _greedy([r[:3] for r in sri], [r[:3] for r in pdf])


def brute_item_diffs(spark):
    sri, pdf = _sides(spark)
    s, p = ({r[:2]: r[3:] for r in side} for side in (sri, pdf))
    out = []
    for doc, a, b, _ in _greedy([r[:3] for r in sri], [r[:3] for r in pdf]):
        off = tuple(abs(x - y) > e for x, y, e in zip(s[doc, a], p[doc, b], (0.001, 0.01, 0.02)))
        if any(off):
            out.append((doc, a, b, *off))
    return out


def _line_pairs(spark):
    lines = {}
    for doc, text in _rows(table(spark, SF, "documents"), "doc_id", "text"):
        lines[doc] = [x.strip() for x in (text or "").split("\n") if x.strip()]
    found = {}
    for doc, own in lines.items():
        for j, b in enumerate(own):
            for i, a in enumerate(own[:j]):
                if a != b and 2 * min(len(a), len(b)) >= 0.7 * (len(a) + len(b)):
                    m = SequenceMatcher(None, a, b)
                    if m.quick_ratio() >= 0.7 and 0.7 <= (r := m.ratio()) < 1:
                        found.setdefault(doc, []).append((i, j, r))
    return lines, found


def brute_similar_lines(spark):
    return [(doc, i, j, round(r, 6)) for doc, pairs in _line_pairs(spark)[1].items() for i, j, r in pairs]


def brute_text_overlap(spark):
    lines, found = _line_pairs(spark)
    kinds = dict(_rows(queries_text.q_line_format(spark, SF), "doc_id", "n_sospechas"))
    out = []
    for doc, own in lines.items():
        if own:
            repeated = sum(c > 1 for c in Counter(own).values())
            n, similar = len(own), len(found.get(doc, []))
            p = min(0.6, repeated / n * 2) + min(0.3, similar / n * 5) + min(0.1, kinds[doc] * 0.05)
            out.append((doc, round(min(1.0, p), 6), p > 0.3, repeated, similar))
    return out


BRUTE = {
    "item_match": (brute_item_match, ("doc_id", "sri_no", "pdf_no", "similitud")),
    "item_diffs": (brute_item_diffs, ("doc_id", "sri_no", "pdf_no", "dif_cantidad", "dif_precio_unitario", "dif_precio_total")),
    "similar_lines": (brute_similar_lines, ("doc_id", "i", "j", "ratio")),
    "text_overlap": (brute_text_overlap, ("doc_id", "probabilidad", "superpuesto", "lineas_duplicadas", "n_similares")),
}


@pytest.mark.parametrize("name", sorted(BRUTE))
def test_query_equals_plain_python(spark, name):
    plain, names = BRUTE[name]
    assert sorted(_rows(QUERIES[name](spark, SF), *names)) == sorted(plain(spark))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - set(BRUTE)))
def test_query_without_sql_answers(spark, name):
    """The operators of these are compared with plain Python or NumPy in test_operators."""
    rows = QUERIES[name](spark, SF).collect()
    assert rows and any(v is not None for v in rows[0])


def test_entry_is_the_invoice_level_query(spark):
    assert {"doc_id", "score", "nivel"} <= set(entry.entry(spark).columns)


def test_tokens_of_large_suppliers_match_sql(spark, tmp_path):
    """A supplier above 9,999 carries into the leading digits of the token's number."""
    import duckdb

    table(spark, SF, "lineitem").limit(200).withColumn("l_suppkey", F.col("l_suppkey") + 59000).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    ok, note = check(spark, con, "tokens_for_boxes", QUERIES["tokens_for_boxes"], ORACLE["tokens_for_boxes"], str(tmp_path))
    assert ok, note


def _shuffled(spark, run):
    """Bytes that the stages of `run` wrote for a shuffle."""
    context = spark.sparkContext
    none = context._gateway.new_array(context._jvm.double, 0)

    def total():
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = context._jsc.sc().statusStore().stageList(context._jvm.java.util.ArrayList(), False, False, none, context._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in map(stages.apply, range(stages.size()))}

    before = total()
    run()
    return sum(n for k, n in total().items() if n and k not in before)


@pytest.mark.parametrize("name", ["text_overlap", "similar_lines"])
def test_lines_of_a_text_are_not_shuffled(spark, tmp_path, name):
    docs = table(spark, SF, "documents")
    docs.repartition(32).write.parquet(f"{tmp_path}/documents.parquet")
    letters = docs.agg(F.sum(F.length("text"))).first()[0]
    assert _shuffled(spark, lambda: QUERIES[name](spark, str(tmp_path)).collect()) < letters / 20


def test_boxes_are_shuffled_once(spark):
    """A box has six numbers of eight bytes, and its image is counted."""
    rows = table(spark, SF, "lineitem").count()
    assert _shuffled(spark, lambda: QUERIES["merge_boxes"](spark, SF).collect()) < 100 * rows
