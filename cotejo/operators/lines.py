"""Signals from the lines of a text: repeats, odd formatting, near copies and labelled amounts."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cotejo.functions.binding import let
from cotejo.functions.numbers import as_double, first_money
from cotejo.functions.similarity import CommonSubsequences, near_pairs
from cotejo.functions.text import contains_any, extract_all, lines_of, strip
from cotejo.session import bounded_batches
from cotejo.skew import bounded_broadcast, length_chunks, spread

LINE_CHUNK = 64
#: lines of a text that one task compares with all of its lines, parts that a longer text goes to at most, rows of an answer
LONG_TEXT, MOST_PARTS, ANSWER = 512, 64, 10_000


def split_lines(doc_text: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): trimmed lines without the empty ones, numbered from zero."""
    return doc_text.select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("line_no", "line"))


def duplicate_lines(lines: DataFrame) -> DataFrame:
    """Lines that occur more than once in a document, with their count.

    The grouping key holds the line text, so one long document spreads over all tasks.
    """
    return lines.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("veces")).where(F.col("veces") > 1)


def line_stats(lines: DataFrame) -> DataFrame:
    """Lines, different lines, repeated ones, duplication ratio and mean length per document."""
    per_line = lines.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("_n"))
    n, u = F.sum("_n"), F.count(F.lit(1))
    return per_line.groupBy("doc_id").agg(
        n.alias("total_lineas"),
        u.alias("lineas_unicas"),
        F.count_if(F.col("_n") > 1).alias("lineas_duplicadas"),
        (1 - u / n).alias("ratio_duplicacion"),
        (F.sum(F.length("line") * F.col("_n")) / n).alias("largo_medio"),
        F.sum(F.when((F.length("line") <= 3) & (F.col("_n") > 5), F.col("_n"))).alias("_short"),
    ).withColumn("cortas_repetidas", F.coalesce("_short", F.lit(0))).drop("_short")


# Shapes of suspicious lines.
WIDE_SPACES = r"\s{10,}"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
GLUED = r"[A-ZÁÉÍÓÚÑ]{3,}[a-záéíóúñ]+[A-ZÁÉÍÓÚÑ]{3,}"
BROKEN_NUMBER = r"\d{4,}\s+[A-Za-z]{1,3}\s+[A-Za-z]"
LOOSE_SPACES = r"\w{3,}\s{3,}\w{3,}"


def line_format(lines: DataFrame) -> DataFrame:
    """Counts of suspicious line shapes; `n_sospechas` is the number of kinds used by the score."""
    x = F.col("line")
    shapes = lines.groupBy("doc_id").agg(
        F.count_if(x.rlike(WIDE_SPACES)).alias("espaciado"),
        F.count_if(x.rlike(CONTROL)).alias("control"),
        F.count_if(x.rlike(GLUED)).alias("pegado"),
        F.count_if(x.rlike(BROKEN_NUMBER)).alias("numero_roto"),
        F.count_if(x.rlike(LOOSE_SPACES)).alias("espacios_sueltos"),
    )
    short = line_stats(lines).select("doc_id", "cortas_repetidas")
    kinds = sum(((F.col(c) > 0).cast("int") for c in ("espaciado", "control", "cortas_repetidas")), F.lit(0))
    return shapes.join(short, "doc_id").withColumn("n_sospechas", kinds.cast("bigint"))


def _similar_in_pair(min_ratio: float):
    """Near copies among the different lines of two chunks: the earlier line first, both orders where one of the lines is repeated.

    The common subsequences of a line with all lines of the other chunk are found in one pass; they bound the ratio, which is worked out
    for the pairs that are left.
    """

    def close(firsts, seconds, same):
        """Pairs of lines whose common subsequence lets the ratio reach the bound."""
        # a pass goes over the shorter line
        rows = sorted(firsts, key=lambda x: -len(x["line"])) + ([] if same else list(seconds))
        packed = CommonSubsequences([x["line"] for x in rows])
        for k in range(1 if same else len(firsts), len(rows)):
            for i in packed.near(k, min(k, len(firsts)), min_ratio):
                yield rows[i], rows[k]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = SequenceMatcher(None)
        for batch in batches:
            out = []
            for doc, same, a, b in zip(batch["doc_id"], batch["same"], batch["a"], batch["b"]):
                for x, y in close(a, b, same):
                    for first, second in ((x, y), (y, x)):
                        if first["no"] < second["no"] or first["n"] > 1 or second["n"] > 1:
                            matcher.set_seqs(first["line"], second["line"])
                            r = matcher.ratio()
                            if r >= min_ratio:
                                out.append((doc, first["no"], first["h"], second["no"], second["h"], r))
            yield pd.DataFrame(out, columns=["doc_id", "i", "h_i", "j", "h_j", "ratio"])

    return run


def similar_lines(lines: DataFrame, min_ratio: float = 0.7, limit: int | None = None) -> DataFrame:
    """All pairs of nearly equal lines per document, or the first `limit` in (i, j) order for a report.

    Different lines of a document meet in chunks of like length, so a long document is many equal jobs; repeated lines are compared once
    and put back by their numbers, with the hash of the line where a number occurs twice.
    """
    key = lines.schema["doc_id"].dataType.simpleString()
    texts = lines.groupBy("doc_id", "line").agg(F.min("line_no").alias("no"), F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("line"))
    packed = length_chunks(texts, ["doc_id"], "line", min_ratio, LINE_CHUNK, "a", ["no", "n", "h", "line"])
    other = packed.select("doc_id", F.explode(F.array(F.col("length_class"), F.col("length_class") - 1)).alias("length_class"), F.col("length_class").alias("own"), F.col("_a").alias("_b"), F.col("a").alias("b"))
    met = packed.join(other, ["doc_id", "length_class"]).where((F.col("own") != F.col("length_class")) | (F.col("_a") <= F.col("_b")))
    met = met.withColumn("same", (F.col("own") == F.col("length_class")) & (F.col("_a") == F.col("_b")))
    # the only line of a chunk has no pair there
    met = met.where(~F.col("same") | (F.size("a") > 1))
    pairs = spread(met, ["doc_id", "length_class", "own", "_a", "_b"]).select("doc_id", "same", "a", "b").mapInPandas(_similar_in_pair(min_ratio), f"doc_id {key}, i bigint, h_i bigint, j bigint, h_j bigint, ratio double")
    again = texts.where("n > 1").select("doc_id", "line", "no")
    places = lines.join(again, ["doc_id", "line"], "left").select("doc_id", F.coalesce("no", "line_no").cast("bigint").alias("no"), F.col("line_no").cast("bigint").alias("at"), "line")
    side = lambda c: places.select("doc_id", F.col("no").alias(c), F.xxhash64("line").alias(f"h_{c}"), F.col("at").alias(f"at_{c}"), F.col("line").alias(f"line_{c}"))
    met = pairs.join(side("i"), ["doc_id", "i", "h_i"]).join(side("j"), ["doc_id", "j", "h_j"]).where("at_i < at_j")
    found = met.select("doc_id", F.col("at_i").alias("i"), F.col("at_j").alias("j"), "line_i", "line_j", "ratio")
    if limit is None:
        return found
    # the rank filter also runs before the shuffle, so a document sends at most `limit` rows per task
    order = W.partitionBy("doc_id").orderBy("i", "j")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")


def text_overlap(lines: DataFrame, similar: DataFrame) -> DataFrame:
    """Probability that text was laid over text, from repeats, near copies and formatting."""
    stats = line_stats(lines).select("doc_id", "total_lineas", "lineas_duplicadas")
    fmt = line_format(lines).select("doc_id", "n_sospechas")
    sim = similar.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_s"))
    df = stats.join(fmt, "doc_id").join(sim, "doc_id", "left").withColumn("n_similares", F.coalesce("_s", F.lit(0)))
    return _overlap_score(df)


def _overlap_score(df: DataFrame) -> DataFrame:
    n = F.greatest(F.lit(1), F.col("total_lineas"))
    p = (
        F.least(F.lit(0.6), F.col("lineas_duplicadas") / n * 2)
        + F.least(F.lit(0.3), F.col("n_similares") / n * 5)
        + F.least(F.lit(0.1), F.col("n_sospechas") * 0.05)
    )
    return df.select(
        "doc_id",
        F.least(F.lit(1.0), p).alias("probabilidad"),
        (p > 0.3).alias("superpuesto"),
        ((F.col("lineas_duplicadas") > 0) | (F.col("n_similares") > 0)).alias("superpuesto_simple"),
        F.round(
            F.least(F.lit(0.4), F.col("lineas_duplicadas") * 0.1) + F.least(F.lit(0.3), F.col("n_similares") * 0.05), 3
        ).alias("probabilidad_previa"),
        "lineas_duplicadas",
        "n_similares",
        "n_sospechas",
    )


# ---------------------------------------------------------------- whole texts in their rows


def _text_jobs(doc_text: DataFrame, **more: Callable[[Column], Column]) -> list[DataFrame]:
    """(doc_id, part, parts, lines and `more` columns made of them) of ordinary texts, which stay where they are, and of long ones, which go
    to several tasks."""
    text = F.col("text")
    long = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) >= LONG_TEXT
    told = doc_text.where(F.col("doc_id").isNotNull())
    rows = lambda test: told.where(test).select("doc_id", lines_of(text).alias("lines"))
    parts = F.greatest(F.lit(1), F.least(F.lit(MOST_PARTS), F.ceil(F.size("lines") / LONG_TEXT))).cast("int")
    split = rows(long).withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    whole = rows(~long).select("*", F.lit(0).alias("part"), F.lit(1).alias("parts"))
    bounded_batches(doc_text.sparkSession)
    columns = ["doc_id", "part", "parts", "lines", *[f(F.col("lines")).alias(name) for name, f in more.items()]]
    return [whole.select(*columns), spread(split.select(*columns), ["doc_id", "part"])]


def _by_text(doc_text: DataFrame, own: Callable[[DataFrame], DataFrame], shared: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`own` of the texts that have their doc_id to themselves, and `shared` of the others, whose lines count together."""
    again = doc_text.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id")
    if again.isEmpty():
        return own(doc_text)
    again = bounded_broadcast(again)
    rest = shared(doc_text.join(again, "doc_id", "left_semi"))
    return own(doc_text.join(again, "doc_id", "left_anti")).unionByName(rest)


def _alike(lines: list[str], min_ratio: float, part: int, parts: int) -> Iterator[tuple[list[int], list[int], float]]:
    """Near copies among the different lines of a text: numbers of the one, numbers of the other, ratio in this order."""
    places: dict[str, list[int]] = {}
    for no, line in enumerate(lines):
        places.setdefault(line, []).append(no)
    texts, matcher = list(places), SequenceMatcher(None)
    for x, y in near_pairs(texts, min_ratio, part, parts):
        for first, second in ((texts[x], texts[y]), (texts[y], texts[x])):
            # the ratio depends on the order, which is that of the lines
            if places[first][0] < places[second][-1]:
                matcher.set_seqs(first, second)
                r = matcher.ratio()
                if r >= min_ratio:
                    yield places[first], places[second], r


def _map_texts(jobs: DataFrame, answers: Callable[..., Iterator[tuple]], columns: str) -> DataFrame:
    """Rows (doc_id, `columns`) of what `answers` finds in (part, parts, lines, ...), a bounded number at a time."""
    names = ["doc_id", *[c.split()[0] for c in columns.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key = [], None
        packed = lambda: pa.RecordBatch.from_arrays([pa.array(c, key if n == "doc_id" else None) for n, c in zip(names, zip(*out))], names)
        for batch in batches:
            key = batch.schema.field("doc_id").type
            for doc, *job in zip(*(c.to_pylist() for c in batch.columns)):
                for answer in answers(*job):
                    out.append((doc, *answer))
                    if len(out) == ANSWER:
                        yield packed()
                        out = []
        if out:
            yield packed()

    return jobs.mapInArrow(run, f"doc_id {jobs.schema['doc_id'].dataType.simpleString()}, {columns}")


def similar_lines_in_texts(doc_text: DataFrame, min_ratio: float = 0.7) -> DataFrame:
    """(doc_id, i, j, ratio) of `similar_lines`, found inside the row: nothing is shuffled but the parts of long texts."""

    def pairs(part: int, parts: int, lines: list[str]) -> Iterator[tuple]:
        for firsts, seconds, r in _alike(lines, min_ratio, part, parts):
            for i in firsts:
                yield from ((i, j, r) for j in seconds[bisect_right(seconds, i) :])

    def own(texts: DataFrame) -> DataFrame:
        whole, split = [_map_texts(j, pairs, "i bigint, j bigint, ratio double") for j in _text_jobs(texts)]
        return whole.unionByName(split)

    return _by_text(doc_text, own, lambda texts: similar_lines(split_lines(texts), min_ratio).select("doc_id", "i", "j", "ratio"))


def text_overlap_in_texts(doc_text: DataFrame, min_ratio: float = 0.7) -> DataFrame:
    """`text_overlap` of the lines of texts and their near copies, counted inside the row: nothing is shuffled but the parts of long texts."""

    def counted(part: int, parts: int, lines: list[str], shapes: int) -> Iterator[tuple]:
        if lines:
            times = Counter(lines)
            short = any(n > 5 and len(x) <= 3 for x, n in times.items())
            alike = sum(len(b) - bisect_right(b, i) for a, b, _ in _alike(lines, min_ratio, part, parts) for i in a)
            yield len(lines), sum(n > 1 for n in times.values()), alike, shapes + short

    def own(texts: DataFrame) -> DataFrame:
        shape = lambda x, pattern: F.exists(x, lambda line: line.rlike(pattern)).cast("bigint")
        jobs = _text_jobs(texts, shapes=lambda x: shape(x, WIDE_SPACES) + shape(x, CONTROL))
        whole, split = [_map_texts(j, counted, "total_lineas bigint, lineas_duplicadas bigint, n_similares bigint, n_sospechas bigint") for j in jobs]
        first = [F.first(c).alias(c) for c in ("total_lineas", "lineas_duplicadas", "n_sospechas")]
        return _overlap_score(whole.unionByName(split.groupBy("doc_id").agg(*first, F.sum("n_similares").alias("n_similares"))))

    def shared(texts: DataFrame) -> DataFrame:
        lines = split_lines(texts)
        return text_overlap(lines, similar_lines(lines, min_ratio))

    return _by_text(doc_text, own, shared)


# ---------------------------------------------------------------- amounts and numbers


def repeated_amounts(doc_text: DataFrame, more_than: int = 3) -> DataFrame:
    """Amount texts that occur more than three times in a document."""
    found = doc_text.select("doc_id", F.explode(extract_all(F.col("text"), r"\d+[.,]\d{2}")).alias("monto"))
    return found.groupBy("doc_id", "monto").agg(F.count(F.lit(1)).alias("veces")).where(F.col("veces") > more_than)


def big_numbers(doc_text: DataFrame) -> DataFrame:
    """Runs of six or more digits in texts that name no product codes."""
    t = F.col("text")
    named = contains_any(F.lower(t), ["codigo", "product", "item", "ref"])
    return doc_text.select("doc_id", F.when(named, 0).otherwise(F.regexp_count(t, F.lit(r"\b(\d{6,})\b"))).cast("bigint").alias("n_numeros_grandes"))


def amount_stats(doc_text: DataFrame, most: float | None = None, most_total: float | None = None) -> DataFrame:
    """Last resort: largest amount as total, second largest as subtotal when at least 70% of it.

    `most` leaves larger amounts out; with `most_total` a larger total gives no answer.
    """
    values = F.transform(extract_all(F.col("text"), r"\d+[.,]\d{2}"), lambda v: as_double(F.replace(v, F.lit(","), F.lit("."))))
    kept = F.sort_array(F.array_distinct(F.filter(values, lambda v: (v >= 1.0) if most is None else v.between(1.0, most))), asc=False)
    top, second = F.get("_v", F.lit(0)), F.get("_v", F.lit(1))
    usable = F.lit(True) if most_total is None else top <= most_total
    sub = F.when(usable & (second >= top * 0.7), second)
    return doc_text.select("doc_id", kept.alias("_v")).select(
        "doc_id", F.when(usable, top).alias("total"), sub.alias("subtotal"), F.round(top - sub, 2).alias("iva")
    )


# ---------------------------------------------------------------- candidates near the end

# Scoring of the last lines, one rule set per profile.
TAIL_PROFILES = {
    "posicion": {
        "lines": 15, "lo": 1.0, "base": 0,
        "good": ["total", "valor", "importe", "pagar"], "bad": ["mg", "ml", "gr", "caps", "unidad"], "minimum": 20,
        "near_end": 30, "at_line_end": 20, "drop_bad": False,
    },
    "dirigida": {
        "lines": 10, "lo": 1.0, "base": 100,
        "good": ["total", "valor", "credito", "tarjeta"], "bad": ["caps", "mg", "spray", "gr", "comp", "recu"], "minimum": 0,
        "near_end": 0, "at_line_end": 0, "drop_bad": True,
    },
}


def tail_candidates(doc_text: DataFrame, profile: str = "posicion", most: float | None = None) -> DataFrame:
    """Best amount of the last lines by context; the first of equal scores wins. `most` leaves larger amounts out.

    Works on the array of lines inside the row, so nothing is shuffled.
    """
    r = TAIL_PROFILES[profile]
    keep_empty = profile == "dirigida"
    df = doc_text.select("doc_id", lines_of(F.col("text"), keep_empty=keep_empty).alias("_l"))
    n = F.size("_l")
    first = F.greatest(n - r["lines"], F.lit(0))

    def scored(x: Column, i: Column) -> Column:
        low = F.lower(x)
        bad = contains_any(low, r["bad"])
        score = F.lit(r["base"]) + F.when(contains_any(low, r["good"]), 50).otherwise(0)
        if r["near_end"]:
            score = score + F.when(i + first >= n - 5, r["near_end"]).otherwise(0)
        if r["drop_bad"]:
            # a product word clears the base score; only a keyword bonus can remain
            score = F.when(bad, score - r["base"]).otherwise(score)
        else:
            score = score - F.when(bad, 50).otherwise(0)
        def one(v: Column, k: Column) -> Column:
            value = as_double(F.replace(v, F.lit(","), F.lit(".")))
            at_end = F.when(F.endswith(x, v), r["at_line_end"]).otherwise(0)
            return F.struct((-(score + at_end)).alias("rank"), i.alias("line"), k.alias("hit"), value.alias("valor"))

        return F.transform(extract_all(x, r"(\d+[.,]\d{2})", 1), one)

    found = F.flatten(F.transform(F.slice("_l", first + 1, F.lit(r["lines"])), scored))
    good = F.filter(found, lambda s: (s["valor"] >= r["lo"]) & (F.lit(True) if most is None else s["valor"] <= most) & (-s["rank"] > r["minimum"]))
    best = F.array_min(good)
    return df.select("doc_id", best["valor"].alias("total"), (-best["rank"]).alias("puntaje"))


# ---------------------------------------------------------------- labelled amounts

# Label patterns of each amount.
AMOUNT_LABELS = {
    "subtotal_15": r"(?i)SUB\s*TOTAL\s*15%",
    "subtotal_0": r"(?i)SUB\s*TOTAL\s*0%",
    "subtotal_no_objeto": r"(?i)SUBTOTAL\s*No\s*objeto\s*de\s*IVA|SUB\s*TOTAL\s*No\s*objeto\s*IVA",
    "subtotal_exento": r"(?i)SUBTOTAL\s*Exento\s*de\s*IVA|SUB\s*TOTAL\s*Exento\s*IVA",
    "subtotal_sin_impuestos": r"(?i)SUB\s*TOTAL\s*SIN\s*IMPUESTOS|BASE\s*IMPONIBLE|SUBTOTAL\s*GRAVADO",
    "iva_15": r"(?i)\bIVA\s*15%|IVA\s+15%|IVA\s*15\s*%|I\.V\.A\.?\s*15%?|IMPUESTO\s*15%",
    "total_descuento": r"(?i)DESC\w*",
    "propina": r"(?i)\bPROPINA\b|SERVICIO|TIP",
    "valor_total": r"(?i)(?:VALOR|TOTAL|IMPORTE|MONTO)",
    "ice": r"(?i)\bICE\b",
    "irbpnr": r"(?i)\bIRBPNR\b",
    "forma_pago_header": r"(?i)\bFORMA\s*PAGO\b.*\bVALOR\b|FORMA\s*DE\s*PAGO.*VALOR|METODO\s*PAGO.*VALOR",
    "tarjeta_credito_valor": r"(?i)TARJETA\s*DE\s*CREDITO|TARJETA\s*CREDITO",
}
_WINDOWS = {"forma_pago_header": 6}


def amount_lines(text: Column) -> Column:
    """All lines with blanks collapsed, empty ones kept: label windows count them."""
    whole = F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")
    return F.transform(whole, lambda x: strip(F.regexp_replace(x, r"[ \t]+", " ")))


def label_next_lines(doc_text: DataFrame, labels: dict[str, str] | None = None, window: int = 3) -> DataFrame:
    """First amount on a labelled line or on the lines after it, one column per label.

    The amounts of all lines are read once; each label then scans the line array of its own row.
    """
    labels = labels or AMOUNT_LABELS
    lines = doc_text.select("doc_id", amount_lines(F.col("text")).alias("_l"))
    df = lines.withColumn("_a", F.transform("_l", lambda x: F.when(x.rlike(r"\d"), first_money(x))))

    def search(name: str, pattern: str) -> Column:
        ahead = _WINDOWS.get(name, window)
        near = lambda i: F.coalesce(*[F.get("_a", i + k) for k in range(ahead + 1)])
        hits = F.transform("_l", lambda x, i: F.when(x.rlike(pattern), near(i)))
        return F.get(F.filter(hits, lambda v: v.isNotNull()), F.lit(0))

    out = df.select("doc_id", *[search(n, p).alias(n) for n, p in labels.items()])
    if "forma_pago_header" in labels and "tarjeta_credito_valor" in labels:
        # both describe the payment; the card line is read last and wins
        out = out.withColumn("forma_pago_valor", F.coalesce("tarjeta_credito_valor", "forma_pago_header")).drop(
            "tarjeta_credito_valor", "forma_pago_header"
        )
    return out


# Words that mark the amount on the same line, before or after it.
CONTEXT_WORDS = {
    "subtotal": r"(?:subtotal|sub\s*total|base)",
    "iva": r"(?:iva|i\.v\.a|impuesto)",
    "total": r"(?:total|valor.*?total|importe)",
}


def context_amounts(doc_text: DataFrame) -> DataFrame:
    """Amount next to a keyword; each line may settle one kind only, in the order of the kinds.

    Folds over the lines of the row with the kinds found so far as state.
    """
    amount = r"(\d{1,6}[.,]\d{2})"
    # lines without an amount settle nothing
    told = F.filter(F.transform(lines_of(F.col("text")), F.lower), lambda x: x.rlike(amount))
    df = doc_text.select("doc_id", told.alias("_l"))

    def on_line(x: Column) -> list[tuple[str, Column]]:
        tries = []
        for kind, words in CONTEXT_WORDS.items():
            for pattern in (f"{words}.*?{amount}", f"{amount}.*?{words}"):
                v = as_double(F.replace(F.regexp_extract(x, pattern, 1), F.lit(","), F.lit(".")))
                tries.append((kind, let(v, lambda x: F.when(x.between(0.01, 999999.0), x))))
        return tries

    found = F.transform("_l", lambda x: F.struct(*[v.alias(f"t{i}") for i, (_, v) in enumerate(on_line(x))]))
    kinds = [k for k in CONTEXT_WORDS for _ in range(2)]
    empty = F.struct(*[F.lit(None).cast("double").alias(k) for k in CONTEXT_WORDS])

    def step(state: Column, line: Column) -> Column:
        # index of the first usable try whose kind is still open
        pick = F.coalesce(*[F.when(state[k].isNull() & line[f"t{i}"].isNotNull(), F.lit(i)) for i, k in enumerate(kinds)])
        new = []
        for k in CONTEXT_WORDS:
            value = state[k]
            for i, kind in enumerate(kinds):
                if kind == k:
                    value = F.when(pick == i, line[f"t{i}"]).otherwise(value)
            new.append(value.alias(k))
        return F.struct(*new)

    folded = df.select("doc_id", F.aggregate(found, empty, step).alias("_s"))
    return folded.select("doc_id", *[F.col(f"_s.{k}").alias(k) for k in CONTEXT_WORDS])
