"""Benchmark decontamination with DataFrame and SQL functions only.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. The word windows of the benchmark form a hash set;
every window of a document is hashed in its row, the few that are in the set are compared word by word, and the words inside any
occurrence are hit. A set of at most `SET_WINDOWS` windows travels with the expression, so documents are read once and never
shuffled; a larger one is joined on the hash instead, with the same answer.

Null and empty texts have no words and are clean. Repeated rows are judged one by one. An item without words is ignored; an item
shorter than the window counts whole. Items may repeat. Further columns of both tables don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cotejo.llm.common import fold_sql

WINDOW = 10
SET_WINDOWS = 50_000
_BREAK = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """Array of the words of a text column; null has none."""
    return F.expr(f"filter(split({fold_sql(f'coalesce({text}, {chr(39)*2})')}, '{_BREAK}'), w -> w != '')")


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """item_id, width, gram (words joined by a space), hash; one row for each item and different window."""
    items = benchmark.select("item_id", words("text").alias("w")).where(F.size("w") > 0)
    items = items.withColumn("width", F.least(F.lit(n), F.size("w")))
    grams = F.expr("array_distinct(transform(sequence(1, size(w) - width + 1), i -> slice(w, i, width)))")
    rows = items.select("item_id", "width", F.explode(grams).alias("g"))
    return rows.select("item_id", "width", F.array_join("g", " ").alias("gram"), F.xxhash64("g").alias("hash"))


def _with_hits(docs: DataFrame, windows: DataFrame, set_windows: int) -> DataFrame:
    """Adds `_w` (words) and `_hits`: (first word, width, gram) of every window of the benchmark found in the row."""
    distinct = windows.select("width", "hash", "gram").distinct()
    known = distinct.limit(set_windows + 1).collect()
    if len(known) > set_windows:
        return _joined_hits(docs, distinct)
    found = []
    for width in sorted({r.width for r in known}):
        hashes = ",".join(f"{h}L" if h > -(2**63) else "(-9223372036854775807L - 1L)" for h in sorted({r.hash for r in known if r.width == width}))
        grams = ",".join(f"'{g}'" for g in sorted({r.gram for r in known if r.width == width}))
        at = f"filter(sequence(1, size(_w) - {width - 1}), i -> xxhash64(slice(_w, i, {width})) IN ({hashes}))"
        hits = f"filter(transform({at}, i -> struct(i - 1 AS first, {width} AS width, array_join(slice(_w, i, {width}), ' ') AS gram)), h -> h.gram IN ({grams}))"
        found.append(f"CASE WHEN size(_w) >= {width} THEN {hits} ELSE array() END")
    none = "CAST(array() AS array<struct<first:int,width:int,gram:string>>)"
    hits = F.expr(f"concat({none}, {', '.join(found)})" if found else none)
    # generators of one row: otherwise a filter on the hits would cut the text into words again for every window
    return docs.select("*", F.explode(F.array(words("text"))).alias("_w")).select("*", F.explode(F.array(hits)).alias("_hits"))


def _joined_hits(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """The same for a benchmark of any size: hashes of all windows meet the set in a join, then go back to their rows."""
    key = [F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th")]
    widths = [r.width for r in distinct.select("width").distinct().collect()]
    base = docs.select(*key, words("text").alias("_w"))
    parts = None
    for width in widths:
        at = F.expr(f"transform(sequence(1, size(_w) - {width - 1}), i -> struct(i - 1 AS first, {width} AS width, xxhash64(slice(_w, i, {width})) AS hash))")
        rows = base.where(F.size("_w") >= width).select("_id", "_th", F.explode(at).alias("h")).select("_id", "_th", "h.*")
        parts = rows if parts is None else parts.unionAll(rows)
    met = parts.join(distinct, ["width", "hash"]).groupBy("_id", "_th").agg(F.collect_set(F.struct("first", "width", "gram")).alias("_met"))
    out = docs.select("*", key[1], words("text").alias("_w")).alias("d").join(met.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m._id")) & (F.col("d._th") == F.col("m._th")), "left")
    same = F.expr("filter(coalesce(_met, array()), h -> array_join(slice(_w, h.first + 1, h.width), ' ') = h.gram)")
    return out.select("d.*", F.col("_met")).withColumn("_hits", same).drop("_met", "_th")


_HIT_WORDS = "array_sort(array_distinct(flatten(transform({hits}, h -> sequence(h.first, h.first + h.width - 1)))))"


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, set_windows: int = SET_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted strings), contaminated."""
    windows = benchmark_windows(benchmark, n)
    rows = _with_hits(docs.select("doc_id", "text"), windows, set_windows).select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", F.size("_w").cast("long").alias("n_words"),
        F.size(F.expr(_HIT_WORDS.format(hits="_hits"))).cast("long").alias("n_hit"),
        F.expr("array_distinct(transform(_hits, h -> h.gram))").alias("_grams"),
    )
    owners = windows.groupBy("gram").agg(F.collect_set(F.col("item_id").cast("string")).alias("_owners"))
    met = rows.select("*", F.explode_outer("_grams").alias("gram")).drop("_grams").join(owners, "gram", "left")
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("_owners"))))
    out = met.groupBy("_row", "doc_id", "n_words", "n_hit").agg(items.alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, what: str = "documents", n: int = WINDOW, set_windows: int = SET_WINDOWS) -> DataFrame:
    """The same columns without contaminated documents, or with hit words and the separators before them cut out of the text."""
    held = {c: f"_given{i}" for i, c in enumerate(docs.columns)}  # names that no column of the operator has
    whole = docs.select("doc_id", "text", *[docs[c].alias(n) for c, n in held.items()])
    rows = _with_hits(whole, benchmark_windows(benchmark, n), set_windows)
    if what == "documents":
        return rows.where(F.size("_hits") == 0).select(*[F.col(n).alias(c) for c, n in held.items()])
    hit = F.expr(_HIT_WORDS.format(hits="_hits"))
    pieces = F.regexp_extract_all("text", F.lit(_PIECE), F.lit(0))
    tail = F.regexp_extract("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z", 0)
    rows = rows.select("*", F.explode(F.array(hit)).alias("_hit"))
    kept = F.concat(F.array_join(F.filter(pieces, lambda _, i: ~F.array_contains("_hit", i)), ""), tail)
    text = F.when(F.size("_hits") > 0, kept).otherwise(F.col("text"))
    return rows.select(*[(text if c == "text" else F.col(n)).alias(c) for c, n in held.items()])
