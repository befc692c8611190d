"""Reconciliation of a printed invoice with the tax authority's record."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cotejo.functions.similarity import ratio_at_least
from cotejo.functions.text import norm_desc, norm_name
from cotejo.session import cut_lineage
from cotejo.skew import first_by, length_chunks

QTY_EPS, PRICE_EPS, TOTAL_EPS, MATCH_THRESHOLD = 0.001, 0.01, 0.02, 0.60
# lines of one invoice that are settled in one row, and descriptions of a chunk of longer ones
CHUNK = 256


def reconcile_headers(pdf_fields: DataFrame, sri: DataFrame) -> DataFrame:
    """Differing header fields of documents found on both sides: (clave, campo, sri, pdf).

    Both inputs: clave, ruc, razonSocial, fechaEmision, importeTotal double, claveAcceso. A field
    differs only when both sides have it.
    """
    names = ["ruc", "fechaEmision", "importeTotal", "razonSocial", "claveAcceso"]
    left = sri.select("clave", *[F.col(n).alias(f"s_{n}") for n in names])
    right = pdf_fields.select("clave", *[F.col(n).alias(f"p_{n}") for n in names])
    s, p = (lambda n: F.col(f"s_{n}")), (lambda n: F.col(f"p_{n}"))
    slash = lambda c: F.replace(c, F.lit("-"), F.lit("/"))
    given = lambda n: (s(n) != "") & (p(n) != "")
    tests = {
        "ruc": given("ruc") & (s("ruc") != p("ruc")),
        "fechaEmision": given("fechaEmision") & (slash(s("fechaEmision")) != slash(p("fechaEmision"))),
        "importeTotal": F.abs(s("importeTotal") - p("importeTotal")) > PRICE_EPS,
        "razonSocial": given("razonSocial") & (norm_name(s("razonSocial")) != norm_name(p("razonSocial"))),
        "claveAcceso": given("claveAcceso") & (s("claveAcceso") != p("claveAcceso")),
    }
    rows = F.array_compact(
        F.array(
            *[
                F.when(test, F.struct(F.lit(n).alias("campo"), s(n).cast("string").alias("sri"), p(n).cast("string").alias("pdf")))
                for n, test in tests.items()
            ]
        )
    )
    return left.join(right, "clave").select("clave", F.explode(rows).alias("_d")).select("clave", "_d.*")


def dedupe_items(items: DataFrame) -> DataFrame:
    """First item per normalised description, quantity, price and total."""
    keyed = items.withColumn("_key", norm_desc(F.col("descripcion")))
    for n in ("cantidad", "precio_unitario", "precio_total"):
        keyed = keyed.withColumn(f"_{n}", F.round(n, 4))
    keys = ["doc_id", "source", "_key", "_cantidad", "_precio_unitario", "_precio_total"]
    return first_by(keyed, keys, F.col("item_no")).select(*items.columns)


def _numbered(items: DataFrame, values: Sequence[str] = ()) -> DataFrame:
    return items.select("doc_id", F.col("item_no").cast("bigint").alias("no"), norm_name(F.col("descripcion")).alias("d"), *values)


def _scorer(threshold: float):
    """Ratio of two descriptions, -1 below the threshold; repeated pairs are answered from a bounded cache."""
    matcher = SequenceMatcher(None)

    @lru_cache(maxsize=200_000)
    def score(a: str, b: str) -> float:
        matcher.set_seqs(a, b)
        r = ratio_at_least(matcher, threshold)
        return r if r >= threshold else -1.0

    return score


def _lists(column: pa.ListArray) -> Iterator[list]:
    """The lists of a column, whose values become Python objects all at once."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False).tolist(), column.value_lengths().to_numpy().cumsum().tolist()
    return map(values.__getitem__, map(slice, [0, *ends], ends))


def _match_whole(threshold: float):
    """Greedy match of documents whose lines all fit one row, from the numbers and texts of both sides in order of the numbers."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        score = _scorer(threshold)
        for columns in batches:
            sri_no, pdf_no, ratio, ends = [], [], [], [0]
            for sri, sri_text, pdf, pdf_text in zip(*map(_lists, columns)):
                by_text: dict[str, list[int]] = {}
                for n, text in zip(pdf, pdf_text):
                    by_text.setdefault(text, []).append(n)
                # PDF lines of every different SRI text, best first
                best: dict[str, list[tuple[float, int]]] = {}
                used: set[int] = set()
                for no, text in zip(sri, sri_text):
                    if text not in best:
                        best[text] = sorted((-r, n) for other, numbers in by_text.items() if (r := score(text, other)) >= 0 for n in numbers)
                    for r, n in best[text]:
                        if n not in used:
                            used.add(n)
                            sri_no.append(no)
                            pdf_no.append(n)
                            ratio.append(-r)
                            break
                ends.append(len(sri_no))
            pairs = pa.StructArray.from_arrays([pa.array(sri_no, pa.int64()), pa.array(pdf_no, pa.int64()), pa.array(ratio, pa.float64())], ["sri_no", "pdf_no", "similitud"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)

    return F.arrow_udf(run, "array<struct<sri_no:bigint,pdf_no:bigint,similitud:double>>").asNondeterministic()


def _packed_pairs(sri: DataFrame, pdf: DataFrame, threshold: float, values: Sequence[str], how: str) -> DataFrame:
    """One row per document: the lines of both sides as arrays `sri` and `pdf` in order of their numbers, and the matches `pairs`."""
    pack = lambda df, name: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("no", "d", *values))).alias(name))
    met = pack(sri, "sri").join(pack(pdf, "pdf"), "doc_id", how)
    given = lambda n: F.coalesce(n, F.array().cast(met.schema[n].dataType)).alias(n)
    met = met.select("doc_id", given("sri"), given("pdf"))
    of = lambda side, field: F.transform(side, lambda x: x[field])
    return met.withColumn("pairs", _match_whole(threshold)(of("sri", "no"), of("sri", "d"), of("pdf", "no"), of("pdf", "d")))


def _long_documents(sri: DataFrame, pdf: DataFrame) -> DataFrame | None:
    """Documents of more than CHUNK lines on a side, counted at once; None where there are none, so that the lines are not read for them."""
    both = sri.select("doc_id", F.lit(True).alias("sri")).unionByName(pdf.select("doc_id", F.lit(False).alias("sri")))
    sizes = both.groupBy("doc_id").agg(F.count_if("sri").alias("_s"), F.count_if(~F.col("sri")).alias("_p"))
    long = cut_lineage(sizes.where(F.greatest("_s", "_p") > CHUNK).select("doc_id"))
    return None if long.isEmpty() else long


def _edges(threshold: float):
    """Pairs of different descriptions of two chunks that are similar enough: doc_id, a, b, ratio."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = _scorer(threshold)
        for batch in batches:
            out = []
            for doc, sri, pdf in zip(batch["doc_id"], batch["sri"], batch["pdf"]):
                out += [(doc, a, b, r) for a in sri for b in pdf if (r := score(a, b)) >= 0]
            yield pd.DataFrame(out, columns=["doc_id", "a", "b", "ratio"])

    return run


def choose_in_order(edges: Iterable[tuple[str, str, float]], sri: Iterable[tuple[int, str]], pdf: Iterable[tuple[int, str]]) -> list[tuple[int, int, float]]:
    """SRI lines in order take their best free PDF line, the first of equals: (sri_no, pdf_no, ratio).

    Equal descriptions are one class: its PDF lines go in order, so a class is known by its next line. Every class of SRI lines keeps a
    heap of the PDF classes that suit it; an entry whose line is gone goes back with the next line of its class, or falls out.
    """
    left: dict[str, deque[int]] = {}
    for no, d in sorted(pdf):
        left.setdefault(d, deque()).append(no)
    heaps: dict[str, list] = {}
    for a, b, r in edges:
        if b in left:
            heaps.setdefault(a, []).append((-r, left[b][0], b))
    for h in heaps.values():
        heapq.heapify(h)
    out = []
    for no, a in sorted(sri):
        h = heaps.get(a, [])
        while h:
            r, n, b = h[0]
            free = left[b]
            if not free:
                heapq.heappop(h)
            elif free[0] != n:
                heapq.heapreplace(h, (r, free[0], b))
            else:
                out.append((no, free.popleft(), -r))
                break
    return out


def _fold(final: str):
    columns = [c.split()[0] for c in final.split(", ")]

    def run(edges: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        sides = [lines[lines["sri"]], lines[~lines["sri"]]]
        pairs = choose_in_order(edges[["a", "b", "ratio"]].itertuples(index=False), *(x[["no", "d"]].itertuples(index=False, name=None) for x in sides))
        rows = pd.DataFrame(pairs, columns=columns[1:])
        rows.insert(0, "doc_id", lines["doc_id"].iloc[0] if len(lines) else None)
        return rows

    return run


def _match_long(sri: DataFrame, pdf: DataFrame, threshold: float) -> DataFrame:
    """Matches of long documents: different descriptions meet in chunks, lines choose over classes of equal descriptions."""
    key = sri.schema["doc_id"].dataType.simpleString()
    final = f"doc_id {key}, sri_no bigint, pdf_no bigint, similitud double"
    lines = sri.select("doc_id", "no", "d", F.lit(True).alias("sri")).unionByName(pdf.select("doc_id", "no", "d", F.lit(False).alias("sri")))
    chunks = lambda side, name: length_chunks(lines.where(side).select("doc_id", "d").distinct(), ["doc_id"], "d", threshold, CHUNK, name, ["d"])
    near = F.explode(F.array([F.col("length_class") + i for i in (-1, 0, 1)]))
    met = chunks(F.col("sri"), "sri").join(chunks(~F.col("sri"), "pdf").withColumn("length_class", near), ["doc_id", "length_class"])
    met = met.repartition("doc_id", "length_class", "_sri", "_pdf").select("doc_id", "sri", "pdf")
    edges = met.mapInPandas(_edges(threshold), f"doc_id {key}, a string, b string, ratio double")
    return edges.groupBy("doc_id").cogroup(lines.groupBy("doc_id")).applyInPandas(_fold(final), final)


def match_items(sri_items: DataFrame, pdf_items: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Greedy one-to-one match of lines by description: (doc_id, sri_no, pdf_no, similitud).

    SRI lines choose in order of their numbers, the first of equally good PDF lines wins. Documents of up to CHUNK lines on both sides
    are settled over packed rows. For longer ones the different descriptions of both sides are compared in chunks, spread over all
    tasks, and the choices are made over classes of equal descriptions, document by document; what then meets in a task are the line
    numbers of one document, whose size the document scan limits. Numbers may be of any size and leave gaps.
    """
    sri, pdf = _numbered(sri_items), _numbered(pdf_items)
    long = _long_documents(sri, pdf)
    within = lambda df, how: df.join(long, "doc_id", how)
    short = (sri, pdf) if long is None else (within(sri, "left_anti"), within(pdf, "left_anti"))
    out = _packed_pairs(*short, threshold, (), "inner").select("doc_id", F.inline("pairs"))
    return out if long is None else out.unionByName(_match_long(within(sri, "left_semi"), within(pdf, "left_semi"), threshold))


def settle_items(sri_items: DataFrame, pdf_items: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Every matched pair with its differences and every line left over, in one pass: (doc_id, sri_no, pdf_no, similitud, dif_...).

    The number of the missing side is null for a line left over. What `match_items`, `diff_items` and `unmatched_items` say of the same
    lines; ordinary documents carry their values in the packed row, so nothing is joined again.
    """
    values = list(_EPS)
    sri, pdf = _numbered(sri_items, values), _numbered(pdf_items, values)
    long = _long_documents(sri, pdf)
    within = lambda df, how: df.join(long, "doc_id", how)
    short = (sri, pdf) if long is None else (within(sri, "left_anti"), within(pdf, "left_anti"))
    met = _packed_pairs(*short, threshold, values, "full")

    def row(sri_no: Column, pdf_no: Column, ratio: Column, flags: list[Column]) -> Column:
        return F.struct(sri_no.alias("sri_no"), pdf_no.alias("pdf_no"), ratio.alias("similitud"), *flags)

    def of_pair(pair: Column) -> Column:
        side = lambda name, no: F.filter(name, lambda x: x["no"] == pair[no])
        both = lambda s, p: row(s["no"], p["no"], pair["similitud"], _flags(lambda v: s[v], lambda v: p[v]))
        return F.flatten(F.transform(side("sri", "sri_no"), lambda s: F.transform(side("pdf", "pdf_no"), lambda p: both(s, p))))

    none, nothing = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    no_flags = [F.lit(False).alias(f"dif_{v}") for v in values]
    rest = lambda name, no, make: F.transform(F.filter(name, lambda x: ~F.array_contains(F.col("pairs")[no], x["no"])), lambda x: make(x["no"]))
    rows = F.concat(
        F.flatten(F.transform("pairs", of_pair)),
        rest("sri", "sri_no", lambda n: row(n, none, nothing, no_flags)),
        rest("pdf", "pdf_no", lambda n: row(none, n, nothing, no_flags)),
    )
    out = met.select("doc_id", F.inline(rows))
    if long is None:
        return out
    items = [within(x, "left_semi") for x in (sri_items, pdf_items)]
    matches = _match_long(within(sri, "left_semi"), within(pdf, "left_semi"), threshold)
    loose = unmatched_items(matches, *items)
    number = lambda label: F.when(F.col("match") == label, F.col("item_no"))
    loose = loose.select("doc_id", number("no_encontrado_en_pdf").alias("sri_no"), number("no_encontrado_en_sri").alias("pdf_no"), nothing.alias("similitud"), *no_flags)
    return out.unionByName(_with_flags(matches, *items).select(*out.columns)).unionByName(loose)


_EPS = {"cantidad": QTY_EPS, "precio_unitario": PRICE_EPS, "precio_total": TOTAL_EPS}


def _flags(s: Callable[[str], Column], p: Callable[[str], Column]) -> list[Column]:
    return [F.coalesce(F.abs(s(v) - p(v)) > eps, F.lit(False)).alias(f"dif_{v}") for v, eps in _EPS.items()]


def _with_flags(matches: DataFrame, sri_items: DataFrame, pdf_items: DataFrame) -> DataFrame:
    values = ["descripcion", *_EPS]
    s = sri_items.select("doc_id", F.col("item_no").cast("bigint").alias("sri_no"), *[F.col(v).alias(f"s_{v}") for v in values])
    p = pdf_items.select("doc_id", F.col("item_no").cast("bigint").alias("pdf_no"), *[F.col(v).alias(f"p_{v}") for v in values])
    out = matches.join(s, ["doc_id", "sri_no"]).join(p, ["doc_id", "pdf_no"])
    return out.select("*", *_flags(lambda v: F.col(f"s_{v}"), lambda v: F.col(f"p_{v}")))


def differing(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("dif_cantidad") | F.col("dif_precio_unitario") | F.col("dif_precio_total"))


def diff_items(matches: DataFrame, sri_items: DataFrame, pdf_items: DataFrame) -> DataFrame:
    """Matched pairs whose quantity, unit price or total differ beyond tolerance."""
    return differing(_with_flags(matches, sri_items, pdf_items)).withColumn("similitud", F.round("similitud", 3))


def unmatched_items(matches: DataFrame, sri_items: DataFrame, pdf_items: DataFrame) -> DataFrame:
    """Lines left over on either side."""
    def rest(items: DataFrame, no: str, label: str) -> DataFrame:
        used = matches.select("doc_id", F.col(no).alias("item_no"))
        side = items.select("doc_id", F.col("item_no").cast("bigint").alias("item_no"), "descripcion")
        return side.join(used, ["doc_id", "item_no"], "left_anti").withColumn("match", F.lit(label))

    return rest(sri_items, "sri_no", "no_encontrado_en_pdf").unionByName(rest(pdf_items, "pdf_no", "no_encontrado_en_sri"))


def compare_totals(pdf_totals: DataFrame, xml_totals: DataFrame) -> DataFrame:
    """Grand totals of both sides; nulls stay null and never coincide."""
    a, b = F.col("valor_pdf"), F.col("valor_xml")
    diff = F.abs(a - b)
    return pdf_totals.join(xml_totals, "clave").select(
        "clave",
        "valor_pdf",
        "valor_xml",
        diff.alias("diferencia"),
        F.when(b != 0, diff / b * 100).alias("porcentaje_diferencia"),
        F.coalesce(diff < 0.01, F.lit(False)).alias("valores_coinciden"),
    )


def attach_auth(docs: DataFrame, auth: DataFrame, key: str = "clave") -> DataFrame:
    """Every document with its authorization; unknown keys are kept and not authorized."""
    a = auth.select(F.col("clave").alias(key), "autorizado", "estado")
    return (
        docs.join(a, key, "left")
        .withColumn("sri_ok", F.coalesce("autorizado", F.lit(False)))
        .withColumn("sri_estado", F.coalesce("estado", F.lit("SIN_RESPUESTA")))
        .drop("autorizado", "estado")
    )


def coincidence(docs: DataFrame, headers: DataFrame, item_diffs: DataFrame, unmatched: DataFrame, totals: DataFrame) -> DataFrame:
    """A document coincides when no field, line or total differs."""
    n = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    return verdicts(docs, headers, n(item_diffs, "n_lineas").join(n(unmatched, "n_sueltas"), "doc_id", "full"), totals)


def settled_coincidence(docs: DataFrame, headers: DataFrame, settled: DataFrame, totals: DataFrame) -> DataFrame:
    """The same from the rows of `settle_items`, which are read once."""
    off, loose = F.col("dif_cantidad") | F.col("dif_precio_unitario") | F.col("dif_precio_total"), F.col("sri_no").isNull() | F.col("pdf_no").isNull()
    return verdicts(docs, headers, settled.groupBy("doc_id").agg(F.count_if(off).alias("n_lineas"), F.count_if(loose).alias("n_sueltas")), totals)


def verdicts(docs: DataFrame, headers: DataFrame, lines: DataFrame, totals: DataFrame) -> DataFrame:
    """Verdict of every document from its differing fields, its numbers of differing and loose lines, and its totals."""
    fields = headers.groupBy(F.col("clave").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_campos"))
    out = (
        docs.select("doc_id")
        .join(fields, "doc_id", "left")
        .join(lines, "doc_id", "left")
        .join(totals.select("doc_id", "difiere"), "doc_id", "left")
        .fillna(0, ["n_campos", "n_lineas", "n_sueltas"])
        .fillna(False, ["difiere"])
    )
    return out.withColumn(
        "coincide", (F.col("n_campos") + F.col("n_lineas") + F.col("n_sueltas") == 0) & ~F.col("difiere")
    )
