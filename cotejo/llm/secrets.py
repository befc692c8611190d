"""Secret scans: three base patterns and a token-efficiency test.

A text that a vocabulary knows needs few tokens; random strings need many. Runs of key characters whose characters per token
fall below a limit are reported as kind `random`, and so are the pieces between / _ = - of runs that pass as a whole. Known digests
(hex of a usual digest length, UUIDs), plain numbers and identifiers whose words the vocabulary knows are left out. Base spans are always
reported.

Null and empty texts have no spans. Repeated rows are scanned one by one; further columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cotejo.llm.tokens import rank_encoder, read_ranks

# The patterns and least lengths of the base kinds.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, ACCESS_LENGTH = r"AKIA[A-Z0-9]+", 18
HEX, HEX_LENGTH = r"[0-9a-f]+", 16
VALUE_LENGTH = 12
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_ASSIGN = re.compile(ASSIGN.replace("(password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))"), re.ASCII)
#: greedy runs, so a least length in the pattern drops exactly the runs that are too short
_ACCESS = re.compile(r"AKIA[A-Z0-9]{%d,}" % (ACCESS_LENGTH - 4))
_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LENGTH)
#: least lengths of a run or piece: with letters and digits, and of letters only, where ordinary words of under 16 look alike
MIXED_LENGTH, LETTERS_LENGTH, JOINED_LENGTH = 12, 16, 16
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIXED_LENGTH)
_PIECE = re.compile(r"[A-Za-z0-9+]{%d,}" % MIXED_LENGTH)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]")
_UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
_HEX_ANY = re.compile(r"[0-9A-Fa-f]+")
_IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[_/=+-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})|[A-Z][a-z]+|[0-9]{1,4}(?![A-Za-z]))*[_/=+-]*")
#: characters per token below which a run of key characters counts as random
EFFICIENCY = 2.2


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three base patterns, code points, end exclusive."""
    spans = []
    low = text.lower()
    if (":" in text or "=" in text) and ("passw" in low or "secret" in low or "token" in low or "api" in low):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= VALUE_LENGTH]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return spans


def is_digest(bare: str) -> bool:
    """Digests of a usual length and UUIDs."""
    return bool(_UUID.fullmatch(bare) or (len(bare) in DIGEST_LENGTHS and _HEX_ANY.fullmatch(bare)))


def reads_as_words(bare: str, encode, limit: float) -> bool:
    """Identifiers of words joined by punctuation or case, if the vocabulary knows the words in lower case."""
    if not _IDENTIFIER.fullmatch(bare):
        return False
    words = _WORD.findall(bare)
    return sum(map(len, words)) >= limit * sum(len(encode(w.lower())) for w in words)


def is_random(run: str, encode, limit: float) -> bool:
    bare = run.strip("=_-+/")
    if not re.search("[A-Za-z]", bare) or is_digest(bare):
        return False
    letters = not re.search("[0-9]", bare)
    if len(run) < (LETTERS_LENGTH if letters else JOINED_LENGTH if re.search("[/_=-]", bare) else MIXED_LENGTH):
        return False
    return len(run) < limit * len(encode(run)) and not reads_as_words(bare, encode, limit)


def random_spans(text: str, encode, limit: float = EFFICIENCY) -> list[tuple[int, int, str]]:
    """A run that is random as a whole is one span; of any other but a digest each piece is judged."""
    found = []
    for m in _RUN.finditer(text):
        if is_random(m[0], encode, limit):
            found.append((m.start(), m.end(), "random"))
        elif not is_digest(m[0].strip("=_-+/")) and re.search("[/_=-]", m[0]):
            found += [(p.start(), p.end(), "random") for p in _PIECE.finditer(text, m.start(), m.end()) if is_random(p[0], encode, limit)]
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then by the order of the kinds."""
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], order[s[2]], s[1])))


def scan(docs: DataFrame, vocabulary: str, limit: float = EFFICIENCY) -> DataFrame:
    """Per document the counts of the base kinds, the digest of the base spans and all spans; one pass, no shuffle."""
    blob = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_encoder(blob.value)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text) if text else []
                more = random_spans(text, encode, limit) if text else []
                count = {k: sum(s[2] == k for s in spans) for k in KINDS}
                rows.append((count["assign"], count["access"], count["hex"], hashlib.sha256(joined(spans).encode()).hexdigest(), joined(spans + more)))
            if rows:
                n_assign, n_access, n_hex, sha, spans = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n_assign, pa.int64()), pa.array(n_access, pa.int64()), pa.array(n_hex, pa.int64()), pa.array(sha), pa.array(spans)],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
