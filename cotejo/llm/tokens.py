"""Access to vocabulary files: read once on the driver, sent to the tasks, built once per Python worker."""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from collections.abc import Callable
from pathlib import Path

import numpy as np

# How byte-level vocabularies of this family cut a text before merging.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG = re.compile(r"\S{4000}|\s{4000}")


def read_text(path: str) -> str:
    """A tokenizer file; the driver reads it, so executors need no copy."""
    return Path(path).read_text(encoding="utf-8")


def read_ranks(path: str) -> bytes:
    return Path(path).read_bytes()


@functools.lru_cache(maxsize=2)
def rank_encoder(blob: bytes) -> Callable[[str], list[int]]:
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}
    return tiktoken.Encoding("given", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@functools.lru_cache(maxsize=4)
def tokenizer(text: str):
    """A tokenizer of the tokenizers library without truncation and padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(text)
    t.no_truncation()
    t.no_padding()
    return t


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def byte_encoder(text: str) -> Callable[[str], np.ndarray]:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library, special tokens of the text included.

    Where merges are ranked by the ids they make, the ranks say all, and the ranked coder, several times as fast, gives the same ids.
    Any other file, and texts with a run of thousands of characters without white space, go to the tokenizers library itself.
    """
    data, library = json.loads(text), tokenizer(text)
    slow = lambda t: np.array(library.encode(t, add_special_tokens=False).ids, np.uint32)
    model, before, added = data["model"], data.get("pre_tokenizer") or {}, data.get("added_tokens") or []
    vocabulary = model["vocab"]
    made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not data.get("normalizer")
    plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    plain = plain and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    special = {t["content"]: t["id"] for t in added}
    if not plain or made != sorted(made) or len(vocabulary.keys() - special) != 256 + len(made):
        return slow
    import tiktoken

    letters = byte_letters()
    ranks = {bytes(letters[c] for c in w): i for w, i in vocabulary.items() if w not in special}
    fast = tiktoken.Encoding("given", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda t: slow(t) if _LONG.search(t) else fast.encode_to_numpy(t, allowed_special="all")
