"""Content digests and distances between perceptual hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digests(content: Column) -> Column:
    return F.struct(
        F.md5(content).alias("md5"),
        F.sha1(content).alias("sha1"),
        F.sha2(content, 256).alias("sha256"),
        F.sha2(content, 512).alias("sha512"),
    )


def _half(c: Column, start: int) -> Column:
    return F.conv(F.substring(F.lpad(c, 16, "0"), start, 8), 16, 10).cast("bigint")


def hamming64(a: Column, b: Column) -> Column:
    """Bit distance of two 16-digit hex hashes; two 32-bit halves keep `conv` inside bigint."""
    return F.bit_count(_half(a, 1).bitwiseXOR(_half(b, 1))) + F.bit_count(_half(a, 9).bitwiseXOR(_half(b, 9)))


def hash_consistency(phash: Column, dhash: Column, whash: Column, limit: int = 20) -> Column:
    """Distances between the three hashes of one image; inconsistent when any exceeds the limit."""
    pd, pw, dw = hamming64(phash, dhash), hamming64(phash, whash), hamming64(dhash, whash)
    return F.struct(
        pd.alias("phash_dhash"),
        pw.alias("phash_whash"),
        dw.alias("dhash_whash"),
        (F.greatest(pd, pw, dw) > limit).alias("inconsistent"),
    )
