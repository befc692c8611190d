"""Document scans, file kinds and JSON sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below a folder as raw documents; one row per file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.col("path").alias("doc_id"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        "content",
        F.col("length").alias("size_bytes"),
    )


def decode_base64(df: DataFrame, body: str = "body") -> DataFrame:
    """Base64 request bodies to raw documents; undecodable ones keep null content."""
    content = F.try_to_binary(F.col(body), F.lit("base64"))
    return df.withColumn("content", content).withColumn("size_bytes", F.length("content").cast("bigint")).drop(body)


def _too_large(max_bytes: int | None) -> Column:
    return F.lit(False) if max_bytes is None else F.length("content") > max_bytes


def accept_docs(raw_docs: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Documents with content, of any size unless `max_bytes` is given."""
    return raw_docs.where(F.col("content").isNotNull() & ~_too_large(max_bytes))


def reject_docs(raw_docs: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Too large or undecodable documents, without their content."""
    reason = F.when(F.col("content").isNull(), "base64_invalido").otherwise("demasiado_grande")
    bad = F.col("content").isNull() | _too_large(max_bytes)
    return raw_docs.where(bad).select("doc_id", "name", "size_bytes", reason.alias("reason"))


# Leading bytes in hex, tried in order.
MAGIC = [
    ("PDF", "^25504446"),
    ("JPEG", "^FFD8FF"),
    ("PNG", "^89504E470D0A1A0A"),
    ("GIF", "^47494638(37|39)61"),
    ("BMP", "^424D"),
    ("TIFF", "^(49492A00|4D4D002A)"),
    ("PSD", "^38425053"),
    ("HEIC", "^66747970"),
    # the box size precedes the brand in real files
    ("HEIC", "^.{8}66747970(68656963|68656978|6D696631|68657663)"),
]


def file_kind(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 12))
    kind = None
    for name, pattern in MAGIC:
        test = head.rlike(pattern)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return kind.otherwise("UNKNOWN")


def document_branch(content: Column) -> Column:
    """pdf or xml, the choice made before signature checks; anything else counts as pdf."""
    text = F.try_validate_utf8(content.cast("string"))
    markup = F.ltrim(text).startswith("<?xml") | (text.contains("<") & text.contains(">"))
    is_pdf = F.substring(content, 1, 4) == F.to_binary(F.lit("25504446"), F.lit("hex"))
    return F.when(~is_pdf & F.coalesce(markup, F.lit(False)), "xml").otherwise("pdf")


def write_traces(responses: DataFrame, path: str, key: str = "clave") -> None:
    """One folder per first ten digits of the key, JSON inside."""
    responses.withColumn("key_prefix", F.substring(key, 1, 10)).write.mode("append").partitionBy("key_prefix").json(path)


def export_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
