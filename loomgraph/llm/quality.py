"""Quality: attention-based multiple-instance learning over the passages of a document.

A passage is 64 consecutive words with what follows each. It is encoded by the shares of the pairs of 12 character
classes in it, and by its words: how many are distinct, how many repeat the one before, their mean length. A document
is a bag of passages and has one label. The network is: ``z = tanh(A x + a)`` for each passage; gated attention
``softmax(w . (tanh(V z) * sigmoid(U z)))`` over the document's passages; a logistic layer on the attended sum of z.
All of it is trained together, on document labels only, by Adam in numpy.

The sample for training is bounded: at most ``PER_LABEL`` rows of each label, drawn by a hash of doc_id; labels are
weighted back to their shares among all labelled rows. Passages of a text are never left out.

Cases: null and empty texts are one empty passage; without labelled rows of both labels every score is the share of
label 1, or 0; labels with null doc_id or null label are ignored, and of repeated labels the largest counts; a null
doc_id stays null; repeated rows give repeated results; further columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrow import binary, mapped
from loomgraph.llm.neardup import word_hashes

PASSAGE = 64
CLASSES = 12
FEATURES = CLASSES * CLASSES + 3
HIDDEN, GATE = 24, 12
PER_LABEL = 1000


def _class(b: int) -> int:
    if 0x61 <= b <= 0x7A:
        return 0
    if 0x41 <= b <= 0x5A:
        return 1
    if 0x30 <= b <= 0x39:
        return 2
    if b in b" \t":
        return 3
    if b in b"\n\r\v\f":
        return 4
    if b in b".,;:":
        return 5
    if b in b"!?":
        return 6
    if b in b"'\"()-":
        return 7
    if b in b"|<>[]{}\\/=_~^`+":
        return 8
    if b < 0x80:
        return 9
    return 10 if b >= 0xC0 else 11


_CLASS = bytes(_class(b) for b in range(256))
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Encoded passages of all texts (rows), and the number of passages of each text (at least one)."""
    hashes, counts = word_hashes(texts)
    number = np.maximum(1, -(-counts // PASSAGE))
    first = np.cumsum(number) - number
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    text_of = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    word = ~_BLANK[data]
    begins = word & np.concatenate([[True], ~word[:-1]])
    # the number of the word at or before each byte, counted in its text
    seen = np.cumsum(begins)
    before = np.concatenate([[0], np.cumsum(counts)[:-1]])
    at = np.maximum(seen - 1 - before[text_of], 0)
    passage = first[text_of] + at // PASSAGE
    kinds = np.frombuffer(joined.translate(_CLASS), np.uint8).astype(np.int64)
    total = int(number.sum())
    pair = kinds[:-1] * CLASSES + kinds[1:]
    inside = text_of[:-1] == text_of[1:]
    out = np.zeros((total, FEATURES), np.float32)
    pairs = np.bincount(passage[:-1][inside] * (CLASSES * CLASSES) + pair[inside], minlength=total * CLASSES * CLASSES)
    pairs = pairs.reshape(total, -1).astype(np.float32)
    out[:, : CLASSES * CLASSES] = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
    if hashes.size:
        word_text = np.repeat(np.arange(len(texts)), counts)
        word_passage = first[word_text] + (np.arange(hashes.size) - before[word_text]) // PASSAGE
        n = np.maximum(np.bincount(word_passage, minlength=total), 1)
        order = np.lexsort((hashes, word_passage))
        h, p = hashes[order], word_passage[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (p[1:] != p[:-1])])
        out[:, -3] = np.bincount(p[new], minlength=total) / n
        again = (hashes[1:] == hashes[:-1]) & (word_passage[1:] == word_passage[:-1])
        out[:, -2] = np.bincount(word_passage[1:][again], minlength=total) / n
        letters = np.bincount(passage[word], minlength=total)
        out[:, -1] = np.minimum(letters / n / 20, 2)
    return out, number


class Network:
    """Gated attention over passages."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.p = {
            "A": rng.normal(0, 1 / len(mean) ** 0.5, (len(mean), HIDDEN)),
            "a": np.zeros(HIDDEN),
            "V": rng.normal(0, 1 / HIDDEN**0.5, (HIDDEN, GATE)),
            "U": rng.normal(0, 1 / HIDDEN**0.5, (HIDDEN, GATE)),
            "w": rng.normal(0, 1 / GATE**0.5, GATE),
            "c": rng.normal(0, 1 / HIDDEN**0.5, HIDDEN),
            "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, number: np.ndarray) -> dict:
        p, f = self.p, {}
        f["x"] = (x - self.mean) / self.scale
        f["start"] = np.cumsum(number) - number
        f["bag"] = np.repeat(np.arange(len(number)), number)
        f["z"] = np.tanh(f["x"] @ p["A"] + p["a"])
        f["t"] = np.tanh(f["z"] @ p["V"])
        f["g"] = 1 / (1 + np.exp(-f["z"] @ p["U"]))
        e = (f["t"] * f["g"]) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, f["start"])[f["bag"]])
        f["alpha"] = e / np.add.reduceat(e, f["start"])[f["bag"]]
        f["m"] = np.add.reduceat(f["alpha"][:, None] * f["z"], f["start"])
        f["score"] = 1 / (1 + np.exp(-np.clip(f["m"] @ p["c"] + p["d"], -30, 30)))
        return f

    def gradients(self, f: dict, error: np.ndarray) -> dict:
        """``error``: derivative of the loss by each bag's logit."""
        p = self.p
        dm = error[:, None] * p["c"]
        da = (f["z"] * dm[f["bag"]]).sum(axis=1)
        de = f["alpha"] * (da - np.add.reduceat(f["alpha"] * da, f["start"])[f["bag"]])
        ds = de[:, None] * p["w"]
        dt = ds * f["g"] * (1 - f["t"] ** 2)
        dg = ds * f["t"] * f["g"] * (1 - f["g"])
        dz = f["alpha"][:, None] * dm[f["bag"]] + dt @ p["V"].T + dg @ p["U"].T
        du = dz * (1 - f["z"] ** 2)
        return {
            "A": f["x"].T @ du,
            "a": du.sum(axis=0),
            "V": f["z"].T @ dt,
            "U": f["z"].T @ dg,
            "w": (f["t"] * f["g"]).T @ de,
            "c": f["m"].T @ error,
            "d": error.sum(keepdims=True),
        }


def train(bags: list[np.ndarray], y: np.ndarray, weights: np.ndarray, epochs: int = 30, batch: int = 32, rate: float = 3e-3, seed: int = 3) -> Network:
    every = np.concatenate(bags)
    net = Network(every.mean(axis=0), every.std(axis=0) + 0.02, seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            f = net.forward(np.concatenate([bags[r] for r in rows]), np.array([len(bags[r]) for r in rows]))
            g = net.gradients(f, (f["score"] - y[rows]) * weights[rows] / len(rows))
            step += 1
            now = rate * (1 - epoch / epochs)
            for k, v in net.p.items():
                g[k] += 1e-4 * v
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                v -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, per_label: int = PER_LABEL) -> Network | float:
    """Trains on labelled rows; labels of rows with remainder 0 modulo ``folds`` are never read."""
    known = labels.filter((F.crc32(F.col("doc_id").cast("string")) % folds != 0) & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0))
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rates = {k: min(1.0, per_label / n) for k, n in counts.items()}
    drawn = known.filter(uniform < F.when(F.col("label") == 1, rates[1]).otherwise(rates[0]))

    def work(batch: pa.RecordBatch) -> dict:
        x, number = passages(binary(batch.column("text")))
        ends = np.cumsum(number)
        own = [x[e - n : e].ravel() for e, n in zip(ends.tolist(), number.tolist(), strict=True)]
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "x": own}

    # the sample is bounded by per_label, so it may be broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    rows = mapped(sample, work, "doc_id long, label int, x array<float>", ["doc_id", "text", "label"]).toArrow().sort_by("doc_id")
    y = np.array(rows.column("label").to_pylist(), float)
    if len(set(y)) < 2:
        return float(counts[1] / sum(counts.values()))
    bags = [rows.column("x")[i].values.to_numpy().reshape(-1, FEATURES) for i in range(len(y))]
    share = np.array([(y == 0).mean(), (y == 1).mean()])
    true = np.array([counts[0], counts[1]]) / (counts[0] + counts[1])
    return train(bags, y, (true / share)[y.astype(int)])


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_passages, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict:
        x, number = passages(binary(batch.column("text")))
        net = held.value
        scores = net.forward(x, number)["score"] if isinstance(net, Network) else np.full(len(number), net)
        return {"doc_id": batch.column("doc_id"), "n_passages": number, "score": scores}

    return mapped(docs, work, "doc_id long, n_passages int, score double", ["doc_id", "text"])
