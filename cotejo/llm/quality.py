"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line carries surface features of itself and of both neighbours. Two states (bad, good) and stay weights for each make
the chain; forward-backward gives P(good) per line, and a document's quality is their mean weighted by line length, put on the
scale of the document labels by a logistic fit.

Null and empty texts are one empty line and get a score like any other. Repeated rows are scored one by one. A null id counts as
held out. Columns besides the named ones are ignored by `score` queries and kept by `score_documents(keep=...)`.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cotejo.llm.common import bounded_batches, small_batches, text_chunks

FEATURES = (
    "bias", "log_bytes", "empty", "upper", "upper_of_letters", "digits", "space", "stops", "symbols", "symbol_words", "bangs", "pipes", "repeats",
    "distinct", "word_bytes", "long_words", "ends_stop", "starts_upper", "same_as_before",
)
#: At most so many labelled documents, of at most so many lines each, are used to fit the model.
TRAIN_DOCUMENTS, TRAIN_LINES = 4000, 300

_SPACE, _UPPER, _LETTER, _DIGIT, _STOP, _SYMBOL = 1, 2, 3, 4, 5, 6
_KIND = np.full(256, _SYMBOL, np.uint8)
_KIND[0x80:] = _LETTER
_KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[ord("A") : ord("Z") + 1] = _UPPER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[[ord(c) for c in ".,;:'\"()-?"]] = _STOP
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[ord("A") : ord("Z") + 1] += 32


def line_features(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x FEATURES; a word's key is made of letter sums, good enough to tell repeats), bytes of each line and number of lines of each text; lines end at \\n."""
    raw = ("\n".join(texts) + "\n").encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    lines = np.array([t.count("\n") + 1 for t in texts], np.int64)
    length = ends - starts
    size = np.maximum(length, 1).astype(np.float64)
    kind = _KIND[data]

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))
        return (total[ends] - total[starts]).astype(np.float64)

    upper, letter, symbol = count(kind == _UPPER), count(kind == _LETTER), count(kind == _SYMBOL)
    word = kind != _SPACE
    first = np.flatnonzero(word & np.concatenate(([True], ~word[:-1])))
    x = np.zeros((len(ends), len(FEATURES)))
    if len(first):
        last = np.flatnonzero(word & np.concatenate((~word[1:], [True]))) + 1
        width = last - first
        at = np.searchsorted(ends, first, "right") if len(ends) > 1 else np.zeros(len(first), np.int64)
        total = np.concatenate(([0], np.cumsum(_FOLD[data])))
        shape = np.concatenate(([0], np.cumsum(_FOLD[data] * _FOLD[data])))
        key = (total[last] - total[first]) * np.uint64(0x9E3779B1) + (shape[last] - shape[first]) * np.uint64(0x85EBCA77) + _FOLD[data[first]] * np.uint64(65599) + width.astype(np.uint64)
        words = np.bincount(at, minlength=len(ends)).astype(np.float64)
        same = np.zeros(len(first), bool)
        same[1:] = (key[1:] == key[:-1]) & (at[1:] == at[:-1])
        order = np.lexsort((key, at))
        fresh = np.ones(len(first), bool)
        fresh[1:] = (key[order][1:] != key[order][:-1]) | (at[order][1:] != at[order][:-1])
        sym = np.concatenate(([0], np.cumsum(kind == _SYMBOL)))
        n = np.maximum(words, 1)
        x[:, 9] = np.bincount(at, sym[last] > sym[first], len(ends)) / n
        x[:, 12] = np.bincount(at, same, len(ends)) / n
        x[:, 13] = np.bincount(at[order], fresh, len(ends)) / n
        x[:, 14] = np.bincount(at, width, len(ends)) / n / 10
        x[:, 15] = np.bincount(at, width > 20, len(ends)) / n
        line_key = np.bincount(at, key.astype(np.float64) * ((np.arange(len(first)) - first.searchsorted(starts)[at]) % 97 + 1), len(ends))
    else:
        line_key = np.zeros(len(ends))
    x[:, 0] = 1
    x[:, 1] = np.log1p(length) / 5
    x[:, 2] = length == 0
    x[:, 3] = upper / size
    x[:, 4] = upper / np.maximum(upper + letter, 1)
    x[:, 5] = count(kind == _DIGIT) / size
    x[:, 6] = count(kind == _SPACE) / size
    x[:, 7] = count(kind == _STOP) / size
    x[:, 8] = symbol / size
    x[:, 10] = count(data == ord("!")) / size
    x[:, 11] = count(data == ord("|")) / size
    x[:, 16] = (kind[np.maximum(ends - 1, 0)] == _STOP) & (length > 0)
    x[:, 17] = (kind[starts] == _UPPER) & (length > 0)
    doc = np.repeat(np.arange(len(texts)), lines)
    x[1:, 18] = (line_key[1:] == line_key[:-1]) & (doc[1:] == doc[:-1]) & (length[1:] > 0)
    return x, length, lines


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Own, previous and next features side by side; zeros beyond a document's ends."""
    ends = np.cumsum(lines)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[ends - lines] = 0
    after[ends - 1] = 0
    return np.hstack((x, before, after))


@dataclasses.dataclass(frozen=True)
class Model:
    weights: np.ndarray  #: of the emission score of state good against bad
    stay: tuple[float, float]  #: log weight of bad after bad, good after good
    scale: tuple[float, float]  #: slope and intercept from the mean marginal's logit to the document's

    def line_marginals(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of every line, bytes of every line, lines of every text."""
        x, length, lines = line_features(texts)
        logit = forward_backward(with_neighbours(x, lines) @ self.weights, lines, self.stay)[0]
        return _sigmoid(logit), length, lines

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        p, length, lines = self.line_marginals(texts)
        return _sigmoid(self.scale[0] * _logit(weighted(p, length, lines)) + self.scale[1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def weighted(p: np.ndarray, length: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Mean of the line marginals of each document, weighted by bytes; an empty line weighs as one byte."""
    w = np.maximum(length, 1)
    at = np.cumsum(lines) - lines
    return np.add.reduceat(p * w, at) / np.add.reduceat(w, at)


def forward_backward(emit: np.ndarray, lines: np.ndarray, stay: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior log odds of good for every line; the two messages and the log normaliser per document.

    With two states a message is one number, the log odds, so each step of the chain is a few operations on a vector over all
    documents that are long enough to have that line.
    """
    order = np.argsort(-lines, kind="stable")
    begin = (np.cumsum(lines) - lines)[order]
    n = lines[order]
    active = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), "right")
    bad, good = stay
    ahead, back = np.zeros_like(emit), np.zeros_like(emit)
    log_z = np.zeros(len(lines))

    def step(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to_good, to_bad = np.logaddexp(z + good, 0), np.logaddexp(z, bad)
        return to_good - to_bad, to_bad

    for t, k in enumerate(active):
        at = begin[:k] + t
        if t == 0:
            ahead[at] = emit[at]
        else:
            message, plus = step(ahead[at - 1])
            ahead[at] = emit[at] + message
            log_z[order[:k]] += plus
    log_z[order] += np.logaddexp(ahead[begin + n - 1], 0) if len(n) else 0
    for t in range(len(active) - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        back[at] = step(back[at + 1] + emit[at + 1])[0]
    return ahead + back, ahead, back, log_z


def fit(texts: Sequence[str], good: np.ndarray, rounds: int = 250, ridge: float = 1e-3) -> Model:
    """Maximum likelihood, every line taking its document's label; Adam on whole-sample gradients."""
    parts = [line_features(texts[at : at + 100]) for at in range(0, len(texts), 100)]  # features need far more memory than the result
    x, length, lines = (np.concatenate(p) for p in zip(*parts, strict=True))
    x = with_neighbours(x, lines)
    y = np.repeat(good.astype(np.float64), lines)
    doc_weight = 1 / np.sqrt(lines)  # long documents shall not rule the fit
    w_line = np.repeat(doc_weight, lines)
    w_line = w_line / doc_weight.sum()
    theta = np.zeros(x.shape[1] + 2)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(lines) - 1] = False
    pair = np.flatnonzero(inner)
    for i in range(1, rounds + 1):
        emit = x @ theta[:-2]
        post, ahead, back, _ = forward_backward(emit, lines, (theta[-2], theta[-1]))
        grad = np.empty_like(theta)
        grad[:-2] = x.T @ (w_line * (y - _sigmoid(post)))
        # joint of two neighbours: bad-bad, bad-good, good-bad, good-good
        a, b = ahead[pair], back[pair + 1] + emit[pair + 1]
        joint = np.stack((np.full(len(pair), theta[-2]), b, a, a + b + theta[-1]))
        joint = np.exp(joint - joint.max(0)) if len(pair) else joint
        joint = joint / joint.sum(0)
        grad[-2] = (w_line[pair] * ((1 - y[pair]) - joint[0])).sum()
        grad[-1] = (w_line[pair] * (y[pair] - joint[3])).sum()
        grad -= ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
    post = forward_backward(x @ theta[:-2], lines, (theta[-2], theta[-1]))[0]
    z = _logit(weighted(_sigmoid(post), length, lines))
    a, b = 1.0, 0.0
    for _ in range(200):  # two numbers, so plain Newton steps
        p = _sigmoid(a * z + b)
        g = np.array([((good - p) * z).mean() - 1e-3 * (a - 1), (good - p).mean()])
        s = p * (1 - p) + 1e-6
        h = np.array([[(s * z * z).mean() + 1e-3, (s * z).mean()], [(s * z).mean(), s.mean()]])
        d = np.linalg.solve(h, g)
        a, b = a + np.clip(d[0], -1, 1), b + np.clip(d[1], -1, 1)
        if abs(d).max() < 1e-8:
            break
    return Model(theta[:-2], (float(theta[-2]), float(theta[-1])), (float(max(a, 0.05)), float(b)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, documents: int = TRAIN_DOCUMENTS, lines: int = TRAIN_LINES) -> pd.DataFrame:
    """At most `documents` labelled rows that aren't held out, spread evenly by a hash of the id."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    short = F.length(F.regexp_replace("text", "[^\n]", "")) < lines  # counted for the picked rows alone
    return texts.where(short).dropDuplicates(["doc_id"]).select("doc_id", "text", "quality").toPandas().sort_values("doc_id")


def train(docs: DataFrame, labels: DataFrame, documents: int = TRAIN_DOCUMENTS, lines: int = TRAIN_LINES) -> Model:
    """Fit on the bounded sample. Without labels of both kinds every score is the share of good labels (0.5 without any)."""
    sample = training_sample(docs, labels, documents, lines)
    good = sample["quality"].to_numpy(np.float64)
    if len(good) == 0 or good.min() == good.max():
        share = float(np.clip(good.mean() if len(good) else 0.5, 0.01, 0.99))
        return Model(np.zeros(3 * len(FEATURES)), (0.0, 0.0), (1.0, float(np.log(share / (1 - share)))))
    return fit(sample["text"].tolist(), good)


def score_documents(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns and `score` for each row, in one pass without a shuffle; a kept column named score gives way to it."""
    bounded_batches(docs.sparkSession)
    keep = [c for c in keep if c != "score"]
    row = F.struct(*[docs[c] for c in keep]) if keep else F.lit(0)
    source = docs.select(row.alias("_row"), docs["text"].alias("_text"))
    schema = source.select("_row", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            parts = [model.scores(texts) for _, texts in text_chunks(batch, "_text", 500_000)]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(np.concatenate(parts))], ["_row", "score"])

    return source.mapInArrow(run, schema).select(*[F.col("_row").getField(c).alias(c) for c in keep], "score")


def score_lines(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, line (from 0), good (marginal probability of the label good) and is_good for every line of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_chunks(batch, "text", 500_000):
                good, _, lines = model.line_marginals(texts)
                owner = np.repeat(np.arange(start, start + len(texts)), lines)
                number = np.arange(len(good)) - np.repeat(np.cumsum(lines) - lines, lines)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner)), pa.array(number), pa.array(good), pa.array(good >= 0.5)], ["doc_id", "line", "good", "is_good"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, line long, good double, is_good boolean")
