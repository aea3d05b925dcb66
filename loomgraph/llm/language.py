"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

Subwords are byte 3- and 4-grams of the text (A-Z in lower case, other ASCII but letters as spaces) that hold no space
inside, hashed into 2**13 buckets. A document is the mean of its subwords' embeddings; a linear layer and a softmax
give the languages' probabilities. Embeddings and weights are trained together, by minibatch gradient descent, on a
bounded sample of labelled rows: at most ``PER_LANGUAGE`` of each language and about ``SAMPLE`` in all (but one of each
language, however many there are), drawn by a hash of doc_id. The driver holds their subwords, 6 bytes for each distinct
one (at most 2**13 a row, so 200 MB if all texts were very long); dense rows are made for one minibatch only. A fifth of the sample is kept for calibration: a temperature that minimises its log loss, and
the score below which a prediction is rejected: ``REJECT`` of the correct calibration rows are below it, but it is
no more than ``REJECT_AT_MOST``, where a calibrated score says that the language is rather right than wrong.

Mean and linear layer are both linear, so prediction needs only the product of embeddings and weights, one row per
bucket: that table (2**13 x languages) is broadcast.

Cases: a null text, or one without a letter, is ``und`` with score 0; an empty training set makes every document
``und``; a null doc_id stays null and is no training row; ties go to the language first in alphabetical order;
repeated rows give repeated results; further columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrow import binary, bounded_batches, mapped

BITS, DIMENSIONS = 13, 16
BUCKETS = 1 << BITS
PER_LANGUAGE, SAMPLE = 500, 4000
#: Languages of at most so many rows, by count, are broadcast with their shares of the sample.
BROADCAST_LANGUAGES = 100_000
REJECT, REJECT_AT_MOST = 0.001, 0.5
UND = "und"

_SPACED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string")) % modulus


def subword_counts(texts: list[bytes]) -> np.ndarray:
    """A row of subword shares (float32, BUCKETS columns) for each text."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, text in enumerate(texts):
        data = np.frombuffer(b" " + text.translate(_SPACED) + b"   ", np.uint8)
        space = data == 32
        d = data.astype(np.uint32)
        three = d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16)
        four = three | d[3:] << np.uint32(24)
        solid = ~space[1:-2]
        h3 = (three[solid] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        h4 = (four[solid & ~space[2:-1]] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
        total = h3.size + h4.size
        if total:
            out[i] = (np.bincount(h3, minlength=BUCKETS) + np.bincount(h4, minlength=BUCKETS)) / total
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages, divided by the temperature
    bias: np.ndarray
    reject_below: float

    def probabilities(self, shares: np.ndarray) -> np.ndarray:
        return softmax(shares @ self.table + self.bias)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Shares:
    """Rows of subword shares, as lists of buckets and values one after the other."""

    ends: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.ends)

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for k, r in enumerate(rows.tolist()):
            own = slice(int(self.ends[r - 1]) if r else 0, int(self.ends[r]))
            out[k, self.at[own]] = self.value[own]
        return out

    @classmethod
    def of(cls, at: pa.ListArray, value: pa.ListArray) -> Shares:
        n = np.diff(at.offsets.to_numpy())
        return cls(np.cumsum(n), at.flatten().to_numpy(), value.flatten().to_numpy())


def train(shares: Shares, labels: np.ndarray, languages: list[str], epochs: int = 25, batch: int = 64, rate: float = 0.5, seed: int = 5) -> Model:
    """SGD with momentum on softmax loss; ``labels`` are numbers of ``languages``."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(labels))
    held = order[: max(1, len(order) // 5)]
    used = order[len(held) :] if len(order) > 1 else order
    k = len(languages)
    embed = rng.normal(0, 1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weight = rng.normal(0, 1 / DIMENSIONS**0.5, (DIMENSIONS, k)).astype(np.float32)
    bias = np.zeros(k, np.float32)
    moves = [np.zeros_like(p) for p in (embed, weight, bias)]
    balance = len(labels) / (k * np.maximum(np.bincount(labels, minlength=k), 1))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in range(0, len(used), batch):
            rows = rng.permutation(used)[:batch] if epoch == 0 and i == 0 else used[i : i + batch]
            x, y = shares.dense(rows), labels[rows]
            hidden = x @ embed
            error = softmax(hidden @ weight + bias)
            error[np.arange(len(y)), y] -= 1
            error = (error * balance[y][:, None] / len(y)).astype(np.float32)
            # a bucket's share of a document is about 1/BUCKETS, so its gradient is scaled up to match the weights'
            grads = (x.T @ (error @ weight.T) * 50, hidden.T @ error, error.sum(axis=0))
            for p, m, g in zip((embed, weight, bias), moves, grads, strict=True):
                m *= 0.9
                m -= step * g
                p += m
        used = rng.permutation(used)
    table = embed @ weight
    logits = np.concatenate([shares.dense(held[i : i + batch]) @ table for i in range(0, len(held), batch)]) + bias
    y = labels[held]
    losses = {t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
    t = min(losses, key=losses.get)
    p = softmax(logits / t)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    reject = min(REJECT_AT_MOST, float(np.quantile(right, REJECT))) if right.size else 0.0
    return Model(languages, (table / t).astype(np.float32), (bias / t).astype(np.float32), reject)


def fit(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE) -> Model | None:
    """Trains on rows of ``docs`` (doc_id, text, lang) for which ``usable`` holds; null if there is none."""
    labelled = docs.select("doc_id", "text", "lang").filter(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = labelled.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return None
    most = max(1, min(per_language, SAMPLE // len(counts)))
    # a share of each language's rows, by hash, a little above the bound; what exceeds it is cut off below
    rates = docs.sparkSession.createDataFrame([(r["lang"], (most + 4 * most**0.5 + 4) / r["count"]) for r in counts], "lang string, rate double")
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    few = len(counts) <= BROADCAST_LANGUAGES
    drawn = labelled.join(F.broadcast(rates) if few else rates, "lang").filter(uniform < F.col("rate"))

    def features(batch: pa.RecordBatch) -> dict:
        shares = subword_counts(binary(batch.column("text")))
        found = [np.flatnonzero(s).astype(np.int16) for s in shares]
        values = [s[f] for s, f in zip(shares, found, strict=True)]
        return {"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "at": found, "share": values}

    rows = mapped(drawn, features, "doc_id long, lang string, at array<short>, share array<float>", ["doc_id", "text", "lang"]).toArrow()
    # of each language the rows that come first in the order of a hash, at most the bound
    hashed = rows.column("doc_id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) & np.uint64(0xFFFFFFFF)
    rows = rows.append_column("hash", pa.array(hashed)).sort_by([("lang", "ascending"), ("hash", "ascending"), ("doc_id", "ascending")])
    langs = np.array(rows.column("lang").to_pylist(), object)
    if not langs.size:
        return None
    languages, first, labels = np.unique(langs.astype(str), return_index=True, return_inverse=True)
    taken = np.flatnonzero(np.arange(labels.size) - first[labels] < most)
    rows = rows.select(["at", "share"]).take(pa.array(taken)).combine_chunks()
    shares = Shares.of(rows.column("at").chunk(0), rows.column("share").chunk(0))
    del rows
    pa.default_memory_pool().release_unused()
    return train(shares, labels[taken], languages.tolist())


def judged(model: Model | None, batch: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text of a batch."""
    n = batch.num_rows
    if model is None:
        return [UND] * n, np.zeros(n), np.ones(n, bool)
    letters = np.array([has_letter(t) for t in batch.column("text").to_pylist()])
    texts = binary(batch.column("text"))
    best, score = np.zeros(n, int), np.zeros(n)
    for i in range(0, n, 256):
        p = model.probabilities(subword_counts(texts[i : i + 256]))
        best[i : i + 256], score[i : i + 256] = p.argmax(axis=1), p.max(axis=1)
    score = np.where(letters, np.clip(score, 0, 1), 0.0)
    names = [model.languages[b] if has else UND for b, has in zip(best, letters, strict=True)]
    return names, score, ~letters | (score < model.reject_below)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, lang_pred, score, rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict:
        names, score, rejected = judged(held.value, batch)
        return {"doc_id": batch.column("doc_id"), "lang_pred": names, "score": score, "rejected": rejected}

    return mapped(docs, work, "doc_id long, lang_pred string, score double, rejected boolean", ["doc_id", "text"])


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` (all columns) whose prediction isn't rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(~judged(held.value, batch)[2]))

    return docs.mapInArrow(run, docs.schema)
