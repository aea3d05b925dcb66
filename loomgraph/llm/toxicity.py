"""Toxicity: class-conditional Kneser-Ney models of symbol 5-grams and of words by their beginnings.

Texts become sequences of 32 symbols: letters (A-Z in lower case), a space for white space, classes for digits and
other marks, and for non-ASCII letters the last bits of their code. For each class, toxic and ordinary, and with its
5-gram counts n, context totals N and follower types T, ``P(s | 4 symbols) = max(n - D, 0) / N + D * T / N *
P(s | 3 symbols)``. Orders 4 and 3 are the same of the class's Kneser-Ney continuation counts; they back off to orders
2 and 1, which both classes share: continuation counts over all documents, labelled or not. So neither class gains by
symbols that are merely rare.

The log-likelihood ratio of a 5-gram is one entry of a table of 2**25 bytes (0.1 a step), whatever the corpus; it is
broadcast. 5-grams fold non-ASCII letters and see less than two syllables; the second model does neither. It takes the
distinct words of a document (runs of ASCII letters, digits and all non-ASCII letters, in lower case; where scripts
set no spaces, up to four characters from each character on) as paths: their first 3, 6, 9 and 12 bytes, then the
whole word. With the numbers n, N of words that reach a piece and its parent in a class, T of its parent's children
there, and those of all documents, ``P(piece | parent) = max(n - D, 0) / N + D * T / N * n_all / N_all``. The counts of
all documents, labelled or not, are a table that grows with the corpus; the ratios of the pieces in labelled rows are
broadcast if they are few, by count, and joined by shuffle if not.

A document's 5-gram ratios are compared per symbol, over the whole text and over its words, its word ratios by the
highest ones and by how many are high; a logistic layer turns these into a score. It is fitted on labelled rows that
the class counts don't include (a fourth of those allowed), at most ``CALIBRATION`` of them, drawn by hash; then the
class counts are completed by those rows, and scores use the ratios of all labelled rows allowed.

Cases: null and empty texts have ratio 0 and get the logistic layer's value for that; without labelled rows of both
classes every score is the share of label 1, or 0; labels with null doc_id or null label are ignored, and of repeated
labels the largest counts; a null doc_id stays null; repeated rows give repeated results; further columns are
ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrow import binary, bounded_batches, mapped
from loomgraph.llm.neardup import mix, powers
from loomgraph.storage import Stage

ORDER, SYMBOL_BITS = 5, 5
SYMBOLS = 1 << SYMBOL_BITS
GRAMS = 1 << (ORDER * SYMBOL_BITS)
CONTEXTS = GRAMS // SYMBOLS
DISCOUNT = 0.75
#: Orders up to this one are counted over all documents and shared by the classes.
SHARED = 2
STEP = 0.1
CALIBRATION = 6000
BROADCAST_LABELS = 500_000
TOP = 3
#: Bytes of the beginnings that words are compared by, and bytes of a word where scripts set no spaces.
LENGTHS, WINDOW = (3, 6, 9, 12), 12
#: Words are counted from these log-likelihood ratios on.
HIGH = (2.0, 3.0, 4.0)
#: Word pieces of at most so many rows, by count, are broadcast; more are joined by shuffle.
BROADCAST_PIECES = 4_000_000

#: Kinds of rows that are counted apart: by label, those that the logistic layer isn't fitted on, then those that it is.
COUNTED = {"ordinary": 0, "toxic": 1, "more_ordinary": 3, "more_toxic": 4}

_random = np.random.default_rng(20240301)
_TABLE = _random.integers(0, 1 << 64, 256, np.uint64)
_BASE = int(_random.integers(0, 1 << 63)) * 8 + 5
_END = np.uint64(1 << 40)
_GAP = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
#: Lead bytes of scripts that mostly set no spaces.
_DENSE = np.isin(np.arange(256), [0xE0, 0xE1, *range(0xE3, 0xEA), 0xF0])
#: Marks that aren't ASCII, as lead byte, range of the next byte, and length.
_MARKS = ((0xC2, 0x80, 0xBF, 2), (0xE2, 0x80, 0x81, 3), (0xE3, 0x80, 0x80, 3))


def _symbol(b: int) -> int:
    if 0x61 <= (b | 32) <= 0x7A and b < 0x80:
        return (b | 32) - 0x60  # 1 to 26
    if b <= 0x20:
        return 0
    if b < 0x80:
        return 27 if 0x30 <= b <= 0x39 else 28
    return 29 + b % 3


_SYMBOL = bytes(_symbol(b) for b in range(256))
#: Lead bytes of two-byte characters carry less than what follows.
_LEAD = bytes(range(0xC2, 0xE0))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """5-grams of all texts (each text starts after ORDER - 1 spaces and ends with one), their symbols, ends of texts."""
    pad = b"\0" * (ORDER - 1)
    coded = [t.translate(_SYMBOL, _LEAD) for t in texts]
    data = np.frombuffer(pad + pad.join(c + b"\0" for c in coded), np.uint8).astype(np.uint32)
    ends = np.cumsum([len(c) + 1 + len(pad) for c in coded]) - len(pad)
    out = np.zeros(max(0, data.size - ORDER + 1), np.uint32)
    for i in range(ORDER):
        out = (out << np.uint32(SYMBOL_BITS)) | data[i : i + out.size]
    return out, data[ORDER - 1 :], ends


def own_spans(ends: np.ndarray) -> list[tuple[int, int]]:
    """Where in the 5-grams those of each text are; what lies between is padding."""
    return [(0 if i == 0 else int(ends[i - 1]) + ORDER - 1, int(e)) for i, e in enumerate(ends)]


def counted(docs: DataFrame) -> Stage:
    """(gram, and counts of the kinds in COUNTED); grams of all rows of ``docs`` (text, kind) have a row."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("gram", pa.int32()), *((c, pa.int64()) for c in COUNTED)])

    def out(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Sums of the held (gram, kind) codes, as one batch of each 2**16 grams."""
        if not held:
            return
        codes, n = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        sums = np.bincount(n, weights=np.concatenate([h[1] for h in held])).astype(np.int64)
        gram, kind = (codes >> 3).astype(np.int32), codes & 7
        for i in range(0, gram.size, 1 << 16):
            part = slice(i, i + (1 << 16))
            columns = [pa.array(gram[part]), *(pa.array(np.where(kind[part] == k, sums[part], 0)) for k in COUNTED.values())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            found, _, ends = grams(binary(batch.column("text")))
            kinds = batch.column("kind").to_pylist()
            parts = [found[s:e].astype(np.int64) << 3 | k for (s, e), k in zip(own_spans(ends), kinds, strict=True)]
            held.append(np.unique(np.concatenate(parts), return_counts=True))
            if len(held) >= 8 or sum(h[0].size for h in held) > 1 << 21:
                codes, n = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
                held = [(codes, np.bincount(n, weights=np.concatenate([h[1] for h in held])))]
                if codes.size > 1 << 21:  # many different ones: they go on, and the sums below add them up
                    yield from out(held)
                    held = []
        yield from out(held)

    rows = docs.select("text", "kind").mapInArrow(run, ", ".join(["gram int", *(f"{c} long" for c in COUNTED)]))
    sums = rows.groupBy("gram").agg(*[F.sum(c).alias(c) for c in COUNTED])
    return Stage(sums, "grams")


def backed_off(count: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """P(last symbol | symbols before) of all grams of an order, from their counts and the next lower order."""
    count = count.astype(np.float64).reshape(-1, SYMBOLS)
    total, types = count.sum(axis=1, keepdims=True), (count > 0).sum(axis=1, keepdims=True)
    lower = lower.reshape(-1, SYMBOLS)
    lower = np.tile(lower, (max(1, len(count) // len(lower)), 1))  # the context without its first symbol
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.maximum(count - DISCOUNT, 0) / total + DISCOUNT * types / total * lower
    return np.where(total > 0, own, lower).ravel()


def continuations(gram: np.ndarray, order: int) -> np.ndarray:
    """For all grams of an order, the number of different symbols before them in the distinct longer ``gram``."""
    longer = np.unique(gram & ((1 << ((order + 1) * SYMBOL_BITS)) - 1))
    return np.bincount(longer & ((1 << (order * SYMBOL_BITS)) - 1), minlength=1 << (order * SYMBOL_BITS))


def by_order(longest: np.ndarray) -> dict[int, np.ndarray]:
    """:func:`continuations` of all orders below ORDER, from those of order ORDER - 1."""
    found = {ORDER - 1: longest}
    for order in range(ORDER - 2, 0, -1):
        found[order] = (found[order + 1] > 0).reshape(SYMBOLS, -1).sum(axis=0)
    return found


def log_ratios(ordinary: np.ndarray, toxic: np.ndarray, lower: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Log-likelihood ratios toxic to ordinary of all 5-grams with one first symbol, in steps of STEP (int8)."""
    logs = [np.log(np.maximum(backed_off(n, prob), 1e-12)) for n, prob in zip((ordinary, toxic), lower, strict=True)]
    return np.clip(np.rint((logs[1] - logs[0]) / STEP), -127, 127).astype(np.int8)


def ratio_table(counts: DataFrame) -> np.ndarray:
    """The log-likelihood ratios of all 5-grams from :func:`counted` rows (gram, ordinary, toxic).

    The driver gets continuation counts (at most CONTEXTS rows of 7 bytes) and the finished table. The table is made on
    executors, one task for each first symbol, so none sees more than CONTEXTS counts.
    """
    held = ["ordinary", "toxic"]
    counts = counts.select("gram", *held)
    suffix = F.col("gram").bitwiseAND(F.lit(CONTEXTS - 1)).alias("suffix")
    before = counts.groupBy(suffix).agg(F.count("*").cast("byte").alias("any"), *[F.count_if(F.col(c) > 0).cast("byte").alias(c) for c in held])
    found = before.toArrow()
    at = found.column("suffix").to_numpy()

    def dense(name: str) -> dict[int, np.ndarray]:
        out = np.zeros(CONTEXTS, np.int8)
        out[at] = found.column(name).to_numpy()
        return by_order(out)

    shared, every = np.full(SYMBOLS, 1 / SYMBOLS), dense("any")
    for order in range(1, SHARED + 1):
        shared = backed_off(every[order], shared)
    lower = []
    for name in held:
        prob, own = shared, dense(name)
        for order in range(SHARED + 1, ORDER):
            prob = backed_off(own[order], prob)
        lower.append(prob)
    del found
    pa.default_memory_pool().release_unused()
    probs = counts.sparkSession.sparkContext.broadcast([p.astype(np.float32) for p in lower])  # 4 MB each

    def work(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        place = rows.column("gram").to_numpy() & (CONTEXTS - 1)
        columns = [np.zeros(CONTEXTS), np.zeros(CONTEXTS)]
        for column, name in zip(columns, held, strict=True):
            column[place] = rows.column(name).to_numpy()
        made = log_ratios(*columns, tuple(probs.value))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([made.tobytes()], pa.binary())], names=["first", "made"])

    first = F.shiftright("gram", (ORDER - 1) * SYMBOL_BITS).cast("int").alias("first")
    made = counts.groupBy(first).applyInArrow(work, "first int, made binary").toArrow()
    table = np.empty(GRAMS, np.int8)
    table.reshape(SYMBOLS, -1)[:] = log_ratios(np.zeros(CONTEXTS), np.zeros(CONTEXTS), tuple(lower))  # for symbols without counts
    for row in range(made.num_rows):
        start = made.column("first")[row].as_py() * CONTEXTS
        table[start : start + CONTEXTS] = np.frombuffer(made.column("made")[row].as_buffer(), np.int8)
    probs.destroy()
    del made
    pa.default_memory_pool().release_unused()
    return table


def word_paths(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of each text: the text's number, and the hashes of its pieces (a row each; 0: none)."""
    lowered = [t.decode(errors="replace").lower().encode() for t in texts]
    data = np.frombuffer(b"".join(t + b"\n" for t in lowered), np.uint8)
    gap, after = _GAP[data], np.append(data[1:], np.uint8(0))
    for lead, low, high, n in _MARKS:
        at = np.flatnonzero((data == lead) & (after >= low) & (after <= high))
        for k in range(n):
            gap[at + k] = True
    edge = np.flatnonzero(np.diff((~gap).astype(np.int8), prepend=np.int8(0)))
    begin, end = edge[::2], edge[1::2]
    dense = np.flatnonzero(_DENSE[data] & ~gap)
    own = ~_DENSE[data[begin]]
    stop = np.minimum(end[np.searchsorted(end, dense, side="right")], dense + WINDOW) if dense.size else dense
    begin, end = np.concatenate([begin[own], dense]), np.concatenate([end[own], stop])
    length = end - begin
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(_BASE, data.size), out=sums[1:])
    inverse = powers(pow(_BASE, -1, 1 << 64), max(1, data.size))[begin]
    whole = mix((sums[end] - sums[begin]) * inverse + length.astype(np.uint64) + _END)
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in lowered]), begin, side="right")
    _, first = np.unique(mix(whole ^ mix(text.astype(np.uint64) + np.uint64(1))), return_index=True)
    first.sort()
    text, begin, length, inverse, whole = text[first], begin[first], length[first], inverse[first], whole[first]
    paths = np.zeros((first.size, len(LENGTHS) + 1), np.uint64)
    for k, n in enumerate(LENGTHS):
        longer = np.flatnonzero(length > n)
        paths[longer, k] = mix((sums[begin[longer] + n] - sums[begin[longer]]) * inverse[longer] + np.uint64(n))
    paths[np.arange(first.size), np.searchsorted(LENGTHS, length)] = whole
    return text, paths.view(np.int64)


def pieces(docs: DataFrame) -> Stage:
    """(piece, parent, n_all, and counts of the kinds in COUNTED): words of ``docs`` (text, kind) by piece."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("piece", pa.int64()), ("parent", pa.int64()), ("kind", pa.int8()), ("n", pa.int64())])

    def summed(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        piece, parent, n = (np.concatenate(c) for c in zip(*held, strict=True))
        piece, first, number = np.unique(piece, return_index=True, return_inverse=True)
        return piece, parent[first], np.bincount(number, weights=n).astype(np.int64)

    def out(kind: int, held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        piece, parent, n = summed(held)
        for i in range(0, piece.size, 1 << 16):
            part = slice(i, i + (1 << 16))
            columns = [pa.array(piece[part]), pa.array(parent[part]), pa.array(np.full(piece[part].size, kind, np.int8)), pa.array(n[part])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {k: [] for k in range(5)}
        for batch in batches:
            if not batch.num_rows:
                continue
            text, paths = word_paths(binary(batch.column("text")))
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)[text]
            parents = np.column_stack([np.zeros(len(paths), np.int64), paths[:, :-1]])
            for kind, parts in held.items():
                here = (paths != 0) & (kinds == kind)[:, None]
                if here.any():
                    piece = paths[here]
                    parts.append(summed([(piece, parents[here], np.ones(piece.size))]))
                if len(parts) >= 8 or sum(p[0].size for p in parts) > 1 << 20:
                    parts[:] = [summed(parts)]
                    if parts[0][0].size > 1 << 20:  # many different ones: they go on, and the sums below add them up
                        yield from out(kind, parts)
                        parts.clear()
        for kind, parts in held.items():
            if parts:
                yield from out(kind, parts)

    rows = docs.select("text", "kind").mapInArrow(run, "piece long, parent long, kind byte, n long")
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
    sums = rows.groupBy("piece", "parent").agg(F.sum("n").alias("n_all"), *[of(k).alias(c) for c, k in COUNTED.items()])
    return Stage(sums, "pieces")


def word_ratios(counts: DataFrame) -> DataFrame:
    """(piece, step, unseen) of the pieces in labelled rows: the log-likelihood ratio toxic to ordinary of the piece
    after its parent, and of a piece after it that neither class has. Piece 0 stands before all words.
    """
    totals = counts.groupBy("parent").agg(
        F.sum("n_all").alias("all_here"),
        *[F.sum(c).alias(f"{c}_here") for c in ("ordinary", "toxic")],
        *[F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_types") for c in ("ordinary", "toxic")],
    )
    totals = totals.filter("ordinary_here + toxic_here > 0")

    def rest(c: str):  # what the class leaves to the counts of all documents
        return F.when(F.col(f"{c}_here") > 0, DISCOUNT * F.col(f"{c}_types") / F.col(f"{c}_here")).otherwise(1.0)

    def prob(c: str):
        own = F.when(F.col(f"{c}_here") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"{c}_here")).otherwise(0.0)
        return own + rest(c) * F.col("n_all") / F.col("all_here")

    steps = counts.filter("ordinary + toxic > 0").join(totals, "parent")
    steps = steps.select("piece", F.log(prob("toxic") / prob("ordinary")).cast("float").alias("step"))
    unseen = totals.select(F.col("parent").alias("piece"), F.log(rest("toxic") / rest("ordinary")).cast("float").alias("unseen"))
    joined = steps.join(unseen, "piece", "full")
    return joined.select("piece", F.coalesce("step", F.lit(0.0).cast("float")).alias("step"), F.coalesce("unseen", F.lit(0.0).cast("float")).alias("unseen"))


@dataclass
class Words:
    """The ratios of :func:`word_ratios`, sorted by piece."""

    piece: np.ndarray
    step: np.ndarray
    unseen: np.ndarray

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ratios of the distinct words of each text."""
        text, paths = word_paths(texts)
        ratio, last = np.zeros(len(paths), np.float32), np.full(len(paths), self.unseen[np.searchsorted(self.piece, 0)] if self.piece.size else 0, np.float32)
        on = np.arange(len(paths)) if self.piece.size else np.zeros(0, np.int64)
        for k in range(paths.shape[1]):
            on = on[paths[on, k] != 0]
            if not on.size:
                break
            piece, number = np.unique(paths[on, k], return_inverse=True)
            at = np.minimum(np.searchsorted(self.piece, piece), self.piece.size - 1)
            found, at = (self.piece[at] == piece)[number], at[number]
            ratio[on[~found]] += last[on[~found]]
            on, at = on[found], at[found]
            ratio[on] += self.step[at]
            last[on] = self.unseen[at]
        cut = np.searchsorted(text[order := np.argsort(text, kind="stable")], np.arange(1, len(texts)))
        return np.split(ratio[order], cut) if texts else []


def joined_ratios(docs: DataFrame, table: DataFrame) -> DataFrame:
    """``docs`` (text) with ``ratios`` of its distinct words, as :class:`Words` gives them, by a shuffle join."""
    keyed = docs.withColumn("text_key", F.sha2("text", 256))

    def work(batch: pa.RecordBatch) -> dict:
        text, paths = word_paths(binary(batch.column("text")))
        word, level = np.nonzero(paths)
        keys = batch.column("text_key").take(pa.array(text[word]))
        return {"text_key": keys, "word": paths[word, (paths[word] != 0).sum(axis=1) - 1], "level": level, "piece": paths[word, level]}

    rows = mapped(keyed, work, "text_key string, word long, level int, piece long", ["text_key", "text"])
    rows = rows.filter("text_key is not null").dropDuplicates(["text_key", "word", "level"]).join(table, "piece", "left")
    root = F.lit((table.filter("piece = 0").first() or {"unseen": 0.0})["unseen"])
    found = F.when(F.col("step").isNotNull(), F.col("level"))
    last = F.coalesce(F.max_by("unseen", found), root)
    ratio = F.coalesce(F.sum("step"), F.lit(0.0)) + F.when(F.count("step") < F.count("*"), last).otherwise(0.0)
    words = rows.groupBy("text_key", "word").agg(ratio.cast("float").alias("ratio"))
    lists = words.groupBy("text_key").agg(F.collect_list("ratio").alias("ratios"))
    return keyed.join(lists, "text_key", "left").drop("text_key")


FEATURES = 1 + 2 * TOP + TOP + 1 + len(HIGH)


def features(texts: list[bytes], table: np.ndarray, ratios: list[np.ndarray]) -> np.ndarray:
    """For each text: mean ratio per symbol, the highest TOP word sums, and the highest TOP means per symbol of a word;
    of the ratios of its distinct words the highest TOP, the mean, and how many are high (logarithms).
    """
    out = np.zeros((len(texts), FEATURES), np.float32)
    found, symbols, ends = grams(texts)
    ratio = table[found].astype(np.float32) * STEP
    for i, (s, e) in enumerate(own_spans(ends)):
        r, space = ratio[s:e], symbols[s:e] == 0
        if r.size < 2:
            continue
        out[i, 0] = r.mean()
        after = np.flatnonzero(space)  # a word with the space that ends it
        begin = np.concatenate([[0], after[:-1] + 1])
        length = after - begin + 1
        word = length > 1
        if word.any():
            sums = np.add.reduceat(r, begin)[word]
            means = sums / (length[word] + 2)
            k = min(TOP, sums.size)
            out[i, 1 : 1 + k] = np.sort(np.partition(sums, sums.size - k)[-k:])[::-1]
            out[i, 1 + TOP : 1 + TOP + k] = np.sort(np.partition(means, means.size - k)[-k:])[::-1]
    for i, r in enumerate(ratios):
        if r.size:
            k = min(TOP, r.size)
            out[i, 1 + 2 * TOP : 1 + 2 * TOP + k] = np.sort(np.partition(r, r.size - k)[-k:])[::-1]
            out[i, 1 + 3 * TOP :] = r.mean(), *(np.log1p((r >= h).sum()) for h in HIGH)
    return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> Logistic:
    """Newton's method on the penalised log loss."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([penalty] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return Logistic(mean, scale, w[:-1], float(w[-1]))


def labelled(docs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """``docs`` (doc_id, text) with ``label`` (null where there is none); labels are broadcast if they are few, by count."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(name).isNotNull()).groupBy("doc_id").agg(F.max(name).cast("int").alias("label"))
    few = labels.count() <= BROADCAST_LABELS
    return docs.select("doc_id", "text").join(F.broadcast(known) if few else known, "doc_id", "left")


@dataclass
class Model:
    """The 5-gram ratios, the word ratios (as a table where they are many) and the logistic layer, or a fixed score."""

    table: np.ndarray | None
    words: Words | DataFrame | None
    layer: Logistic | float = 0.0
    sent: list[Broadcast] = field(default_factory=list)

    def release(self) -> None:
        """Drops the ratios, on executors too; results made with them must have been read."""
        self.table = self.words = None
        for held in self.sent:
            held.destroy()
        self.sent.clear()

    def features(self, docs: DataFrame, work: Callable[[pa.RecordBatch, np.ndarray], dict], schema: str, columns: list[str]) -> DataFrame:
        """``work`` on batches of ``docs`` (``columns``, text among them) and the features of their texts."""
        local = isinstance(self.words, Words)
        held = docs.sparkSession.sparkContext.broadcast((self.table, self.words if local else None))
        self.sent.append(held)

        def run(batch: pa.RecordBatch) -> dict:
            table, words = held.value
            texts = binary(batch.column("text"))
            ratios = words(texts) if local else [np.array(r or [], np.float32) for r in batch.column("ratios").to_pylist()]
            return work(batch, features(texts, table, ratios))

        return mapped(docs if local else joined_ratios(docs, self.words), run, schema, columns if local else [*columns, "ratios"])


def held_words(counts: DataFrame, most: int) -> Words | DataFrame:
    """The ratios of the pieces: in memory if they are at most so many."""
    ratios = Stage(word_ratios(counts), "word-ratios")
    if ratios.df.count() > most:
        return ratios.df
    rows = ratios.df.toArrow()
    ratios.drop()
    piece, step, unseen = (rows.column(c).to_numpy() for c in ("piece", "step", "unseen"))
    order = np.argsort(piece)
    words = Words(piece[order], step[order], unseen[order])
    del rows, piece, step, unseen
    pa.default_memory_pool().release_unused()
    return words


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, broadcast: int = BROADCAST_PIECES) -> Model:
    """The ratios and the logistic layer. Labels of rows with remainder 0 modulo ``folds`` are never read."""
    rest = F.crc32(F.col("doc_id").cast("string")) % folds
    allowed = labels.filter(rest != 0)
    known = labelled(docs, allowed, "toxic")
    toxic = F.least(F.greatest("label", F.lit(0)), F.lit(1))
    kinds = known.withColumn("kind", F.when(F.col("label").isNull(), 2).when(rest == folds - 1, 3 + toxic).otherwise(toxic))
    by_gram, by_piece = counted(kinds), pieces(kinds)
    model = Model(ratio_table(by_gram.df), held_words(by_piece.df, broadcast))
    own = known.filter(F.col("label").isNotNull() & (rest == folds - 1))
    n = max(1, own.count())
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    own = own.filter(uniform < min(1.0, CALIBRATION / n))

    def work(batch: pa.RecordBatch, x: np.ndarray) -> dict:
        return {"x": list(x), "label": batch.column("label"), "doc_id": batch.column("doc_id")}

    found = model.features(own, work, "doc_id long, label int, x array<float>", ["doc_id", "text", "label"]).toArrow().sort_by("doc_id")
    y = np.minimum(1, np.array(found.column("label").to_pylist(), float))
    if len(set(y)) < 2:
        model.layer = float(y.mean()) if y.size else 0.0
    else:
        model.layer = fit_logistic(np.array(found.column("x").to_pylist(), np.float64), y)
    # the layer is fitted: its rows count for the ratios too; the first ratios go before the driver gets the others
    model.release()
    whole = {c: F.col(c) + F.col(f"more_{c}") for c in ("ordinary", "toxic")}
    model.table = ratio_table(by_gram.df.withColumns(whole))
    model.words = held_words(by_piece.df.withColumns(whole), broadcast)
    by_gram.drop()
    by_piece.drop()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, ratio (mean per symbol), score."""
    layer = model.layer

    def work(batch: pa.RecordBatch, x: np.ndarray) -> dict:
        scores = layer(x.astype(np.float64)) if isinstance(layer, Logistic) else np.full(len(x), layer)
        return {"doc_id": batch.column("doc_id"), "ratio": x[:, 0].astype(np.float64), "score": scores}

    return model.features(docs, work, "doc_id long, ratio double, score double", ["doc_id", "text"])
