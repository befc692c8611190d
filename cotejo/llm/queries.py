"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cotejo.llm import chat, decontam, infill, linededup, ngramjoin, pieces, quality, secrets, tokenfiles, topk, trie, warc, wordbpe
from cotejo.llm.common import digest, table

PREDICT = 0.3


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score_documents(docs, quality.train(docs, labels))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    clean = linededup.LineIndex.empty(spark).insert(docs).clean(docs.select("doc_id", "text"))
    return clean.select("doc_id", "n_lines", "n_dropped", digest(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and digests, derived from the ids and decoded texts that the operator returns."""
    coded = wordbpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn is a call of the tool `ask`, the assistant's next turn its result; every fourth turn builds on the call before.

    Texts of several lines give their length as text, which the schema does not allow.
    """
    turns = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    size = F.length("text").cast("long")
    plain = F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("query"), size.alias("n_chars")))
    lines = F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("query"), size.cast("string").alias("n_chars")))
    calls = turns.where("role = 'user'").select(
        "conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("ask").alias("name"),
        F.when(F.col("text").contains("\n"), lines).otherwise(plain).alias("arguments"),
        F.when(F.col("turn") % 4 == 2, F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("after"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    schemas = spark.createDataFrame([("ask", "query", "string", True), ("ask", "n_chars", "integer", True), ("ask", "turn", "integer", False)], "name string, field string, type string, required boolean")
    return chat.format_messages(turns, calls, results, schemas)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_classes(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and digests, derived from the ids and decoded texts that the operator returns."""
    coded = pieces.encode_decode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(joined).alias("ids_sha256"), digest("decoded").alias("decoded_sha256"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(table(spark, sf_dir, "documents"))
    back = infill.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest(back).alias("restored_sha256"))


_ALL = (
    op1_quality, op2_line_dedup, op3_decontaminate, op4_warc, op5_word_bpe, op6_top_k, op7_secrets, op8_chat, op9_jaccard, op10_token_files,
    op11_prefix_trie, op12_pieces, op13_infill,
)
QUERIES = {f.__name__: f for f in _ALL}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = r"[\x20\x09-\x0D]"

#: CRC-32 of a decimal number in ASCII, bit by bit
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length({0}) + 1),
  lambda i: [ascii(substr({0}, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295)"""

ORACLE_SQL = {
    "op2_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, i, l, translate(regexp_replace(l, '^{_BLANK}+|{_BLANK}+$', '', 'g'), '{_UP}', '{_LOW}') AS k
  FROM (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), common AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.k) AS n_dropped, sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common c USING (k) GROUP BY doc_id""",
    "op3_decontaminate": rf"""
WITH w AS (
  SELECT true AS bench, item_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
  UNION ALL
  SELECT false, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM documents
), items AS (SELECT DISTINCT id AS item_id, least(10, len(ws)) AS n, unnest([array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') FOR i IN range(1, len(ws) - least(10, len(ws)) + 2)]) AS g FROM w WHERE bench AND len(ws) > 0),
lens AS (SELECT DISTINCT n FROM items),
grams AS (SELECT id, n, unnest(range(1, len(ws) - n + 2)) AS i, unnest([array_to_string(ws[i:i + n - 1], ' ') FOR i IN range(1, len(ws) - n + 2)]) AS g FROM w, lens WHERE NOT bench AND len(ws) >= n),
hits AS (SELECT id, grams.n, i, item_id FROM grams JOIN items USING (n, g)),
pos AS (SELECT DISTINCT id, unnest(range(i, i + n)) AS p FROM hits)
SELECT w.id AS doc_id, len(ws) AS n_words, coalesce(h.c, 0) AS n_hit, coalesce(t.c, 0) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.c, 0) > 0 AS contaminated
FROM w LEFT JOIN (SELECT id, count(*) AS c FROM pos GROUP BY id) h USING (id)
LEFT JOIN (SELECT id, count(*) AS c, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT id, item_id FROM hits) GROUP BY id) t USING (id)
WHERE NOT bench""",
    "op4_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS f FROM p)
SELECT page_id, b AS payload_bytes, d AS payload_digest, CASE WHEN b >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN b >= 100 AND page_id <> f THEN f END AS refers_to FROM m""",
    "op6_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op8_chat": """
WITH t AS (SELECT conv_id, turn, role, text FROM conversations),
calls AS (
  SELECT conv_id, turn, 'c' || conv_id || '-' || turn AS call_id, contains(text, chr(10)) AS lines, length(text) AS size, text FROM t WHERE role = 'user'
)
SELECT t.conv_id, t.turn, t.role, c.call_id,
  CASE WHEN c.call_id IS NULL THEN NULL WHEN t.turn % 4 = 2 AND b.call_id IS NOT NULL THEN 1 ELSE 0 END AS level,
  r.turn AS result_turn, CASE WHEN c.call_id IS NULL THEN NULL WHEN c.lines THEN 'type n_chars' ELSE '' END AS errors, CASE WHEN c.call_id IS NOT NULL THEN NOT c.lines END AS valid,
  '{' || array_to_string(list_filter([
    CASE WHEN a.call_id IS NOT NULL AND t.role = 'assistant' THEN '"answers":' || to_json(a.call_id)::VARCHAR END,
    CASE WHEN c.call_id IS NOT NULL THEN '"call":{"arguments":{"n_chars":' || CASE WHEN c.lines THEN '"' || c.size || '"' ELSE c.size::VARCHAR END || ',"query":' || to_json(c.text)::VARCHAR || ',"turn":' || c.turn || '},"id":' || to_json(c.call_id)::VARCHAR || ',"name":"ask"}' END,
    '"content":' || to_json(t.text)::VARCHAR, '"role":' || to_json(t.role)::VARCHAR], lambda x: x IS NOT NULL), ',') || '}' AS json
FROM t LEFT JOIN calls c ON t.conv_id = c.conv_id AND t.turn = c.turn AND t.role = 'user'
LEFT JOIN calls a ON t.conv_id = a.conv_id AND t.turn = a.turn + 1
LEFT JOIN calls b ON t.conv_id = b.conv_id AND t.turn = b.turn + 2
LEFT JOIN t r ON r.conv_id = t.conv_id AND r.turn = t.turn + 1 AND r.role = 'assistant' AND t.role = 'user'""",
    "op9_jaccard": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_BLANK}+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) END AS g FROM w
), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS n, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (n - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON r.node = u.a)
SELECT s.doc_id, len(g) AS n_shingles, m.c AS component_id FROM s JOIN (SELECT node, min(root) AS c FROM r GROUP BY node) m ON m.node = s.doc_id""",
    "op11_prefix_trie": f"""
WITH m AS (
  SELECT c, md5(strlen(role) || ':' || role || text) AS t, strlen(text) AS b, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS p
  FROM (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), ids AS (SELECT c, c - c % 5 AS base, {_CRC.format("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT c FROM m)),
given AS (SELECT ids.c, m.p AS d, m.t, m.b FROM ids JOIN m ON m.c = ids.base AND m.p <= ids.h),
kept AS (SELECT ids.c, ids.h, count(given.c) AS k FROM ids LEFT JOIN given USING (c) GROUP BY ALL),
whole AS (SELECT * FROM given UNION ALL SELECT m.c, m.p - kept.h + kept.k, m.t, m.b FROM m JOIN kept USING (c) WHERE m.p > kept.h),
path AS (SELECT c, d, b, string_agg(t, '') OVER (PARTITION BY c ORDER BY d) AS k FROM whole UNION ALL SELECT c, 0, 0, '' FROM ids),
size AS (SELECT c, max(d) AS n FROM path GROUP BY c),
node AS (
  SELECT k, min(d) AS d, min(b) AS b, min(c) AS c, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = size.n), '') AS ends
  FROM path JOIN size USING (c) GROUP BY k
), kids AS (SELECT substr(k, 1, length(k) - 32) AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
whole_node AS (SELECT node.*, coalesce(kids.n, 0) AS kids FROM node LEFT JOIN kids USING (k)),
up AS (SELECT substr(k, 1, 32 * i) AS k, count(*) FILTER (WHERE kids = 0) AS leaves, sum((n - 1) * b) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM whole_node) GROUP BY 1)
SELECT a.c AS conv_id, a.d AS depth, p.c AS parent_conv_id, a.n AS n_convs, a.kids AS n_children, up.leaves AS n_leaves, up.saved::BIGINT AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM whole_node a JOIN up USING (k) LEFT JOIN node p ON a.d > 0 AND p.k = substr(a.k, 1, length(a.k) - 32)""",
    "op13_infill": rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_BLANK}*[^\x20\x09-\x0D]+|{_BLANK}+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents
), h AS (SELECT *, len(u) AS n, [('0x' || substr(s, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS h FROM t),
f AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h
), c AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS r FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || r || '<M>' || m ELSE '<S>' || r || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM c""",
}
