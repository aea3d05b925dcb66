"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become their words (A-Z in lower case, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) with one space between and
around them. A pattern is a window of 13 consecutive words of a benchmark item, with the spaces around it; an item of
fewer words is one pattern. Patterns are sought by Wu and Manber's method:

* all patterns of a group are seen through their first m bytes, m being the length of the shortest one;
* the shift table tells for the hash of a block of B bytes (up to 12, by the number of patterns) how far the search may move on: the least distance of such
  a block from byte m in any pattern, or m - B + 1 if there is none (hash collisions only make shifts shorter);
* where the shift is 0, the hash of the block selects a bucket of patterns, and a direct comparison of all their
  bytes confirms each occurrence.

Many places of a batch of texts are searched in step: the batch is cut into strips, each with a cursor, and numpy moves
all cursors at once. Patterns of less than 32 bytes form a group of their own, so that a short item does not make the
shifts of all others short.

Benchmark rows reach the driver one bounded block at a time (``BLOCK_BYTES``); each block's tables, whose size that
bounds, are broadcast. Every further block is one more pass over the documents, without a shuffle.

Cases: null or empty texts have no words and are not contaminated; a null doc_id stays null; benchmark rows without an
item_id or without words find nothing, and rows with the same item_id are one item; repeated documents give repeated
results; further columns are ignored; with an empty benchmark nothing is contaminated.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.arrow import binary, mapped
from loomgraph.llm.text import alnum_normal

WINDOW = 13
BLOCK_BYTES = 4 << 20
SHORT = 32
STRIP = 2048
TABLE_BITS = 22


def windows(normal: bytes, size: int = WINDOW) -> list[bytes]:
    words = normal.split()
    if not words:
        return []
    last = max(0, len(words) - size)
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(last + 1)]


def eights(text: bytes) -> np.ndarray:
    """The 8 bytes from each place on as a number; the text must go on for 7 bytes after the last place asked for."""
    return np.ndarray((max(0, len(text) - 7),), "<u8", text, 0, (1,))


class Group:
    """Shift table and buckets of patterns of at least ``m`` bytes."""

    def __init__(self, patterns: list[bytes], numbers: list[int]):
        self.m = m = min(map(len, patterns))
        # blocks so long that few of them are in any pattern: about two bits a byte in natural text
        self.block = block = min(m, 6 if len(patterns) < 100 else 8 if len(patterns) < 2000 else 12)
        self.mask = np.uint64((1 << (8 * min(block, 8))) - 1)
        heads = b"".join(p[:m] for p in patterns)
        words, rows = eights(heads + b"\0" * 8), np.arange(len(patterns)) * m
        self.shift = np.full(1 << TABLE_BITS, min(m - block + 1, 255), np.uint8)
        for end in range(block, m + 1):  # later blocks have the shorter shift and are written last
            if m - end < 255:
                hashes = self.hash(words, rows + end)
                self.shift[hashes] = m - end
        order = np.argsort(hashes, kind="stable")  # by the block that ends at m
        self.patterns = [patterns[i] for i in order]
        self.numbers = [numbers[i] for i in order]
        self.keys, self.starts = np.unique(hashes[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        self.first_mask = np.uint64((1 << (8 * min(m, 8))) - 1)
        self.first = (words[rows] & self.first_mask)[order]

    def hash(self, words: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the blocks that end at the given places."""
        h = (words[end - self.block] & self.mask) * np.uint64(0x9E3779B97F4A7C15)
        if self.block > 8:
            h = (h ^ words[end - 8]) * np.uint64(0xC2B2AE3D27D4EB4F)
        return h >> np.uint64(64 - TABLE_BITS)

    def find(self, text: bytes) -> tuple[list[int], list[int]]:
        """Starts of all occurrences, and the numbers of their patterns."""
        if len(text) < self.m:
            return [], []
        words = eights(text + b"\0" * 8)
        at = np.arange(self.m, len(text) + 1, STRIP)  # a cursor is the end of the m bytes that it looks at
        stop = np.minimum(at + STRIP, len(text) + 1)
        starts, found = [], []
        while at.size:
            hashes = self.hash(words, at)
            step = self.shift[hashes]
            here = np.flatnonzero(step == 0)
            if here.size:
                self.confirm(text, words, at[here] - self.m, hashes[here], starts, found)
            at = at + np.maximum(step, 1)
            going = at < stop
            if not going.all():
                at, stop = at[going], stop[going]
        return starts, found

    def confirm(self, text: bytes, words: np.ndarray, begin: np.ndarray, hashes: np.ndarray, starts: list, found: list) -> None:
        key = np.searchsorted(self.keys, hashes)
        key[key == self.keys.size] = 0
        real = self.keys[key] == hashes
        begin, key = begin[real], key[real]
        low, n = self.starts[key], self.ends[key] - self.starts[key]
        place = np.repeat(begin, n)
        which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        same = (words[place] & self.first_mask) == self.first[which]
        for s, w in zip(place[same].tolist(), which[same].tolist(), strict=True):
            if text.startswith(self.patterns[w], s):
                starts.append(s)
                found.append(self.numbers[w])


class Searcher:
    """Patterns of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        of: dict[bytes, set[str]] = defaultdict(set)
        for item, normal in items:
            for w in windows(normal, size):
                of[w].add(item)
        patterns = sorted(of)
        self.items = [sorted(of[p]) for p in patterns]
        self.words = [p.count(b" ") - 1 for p in patterns]
        self.groups = []
        for fits in (lambda n: n < SHORT, lambda n: n >= SHORT):
            if own := [i for i, p in enumerate(patterns) if fits(len(p))]:
                self.groups.append(Group([patterns[i] for i in own], own))

    def find(self, text: bytes) -> tuple[list[int], list[int]]:
        starts, found = [], []
        for g in self.groups:
            s, f = g.find(text)
            starts += s
            found += f
        return starts, found


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The items (id as string, normal form), at most ``limit`` bytes of them at a time (one item at least)."""
    held, size = [], 0
    rows = benchmark.filter("item_id is not null").select(F.col("item_id").cast("string"), "text").toLocalIterator()
    for item, text in rows:
        normal = alnum_normal((text or "").encode())
        if held and size + len(normal) > limit:
            yield held
            held, size = [], 0
        held.append((item, normal))
        size += len(normal)
    if held:
        yield held


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, spans, items.

    ``spans`` are the hit runs of words as (first, count), flat; ``items`` the ids of items with occurring windows.
    """
    context = docs.sparkSession.sparkContext
    found = docs.select("doc_id", "text", *empty())
    searchers = [context.broadcast(Searcher(b, size)) for b in blocks(benchmark, block_bytes)] or [context.broadcast(Searcher([]))]
    for k, searcher in enumerate(searchers):
        last = k == len(searchers) - 1
        schema = "doc_id long, " + ("n_words long, " if last else "text string, ") + "spans array<int>, items array<string>"
        found = mapped(found, searching(searcher, last), schema, ["doc_id", "text", "spans", "items"])
    return found


def searching(searcher, last: bool, carried: str = "doc_id"):
    def work(batch: pa.RecordBatch) -> dict:
        normals = [alnum_normal(t) for t in binary(batch.column("text"))]
        spans, items = find_all(searcher.value, normals, batch.column("spans").to_pylist(), batch.column("items").to_pylist())
        out = {carried: batch.column(carried), "spans": spans, "items": items}
        if last:
            out["n_words"] = [n.count(b" ") + 1 if n else 0 for n in normals]
        else:
            out["text"] = batch.column("text")
        return out

    return work


def find_all(searcher: Searcher, normals: list[bytes], spans: list[list[int]], items: list[list[str]]):
    """Adds what the searcher finds to the spans and items of each text."""
    text = b"\n".join(b" " + n + b" " for n in normals)
    starts, found = searcher.find(text)
    if not starts:
        return spans, items
    begins = np.cumsum([0] + [len(n) + 3 for n in normals[:-1]])
    spaces = np.cumsum(np.frombuffer(text, np.uint8) == 32)
    at = np.asarray(starts)
    doc = np.searchsorted(begins, at, "right") - 1
    word = spaces[at] - spaces[begins[doc]]  # both are spaces; the first one stands before word 0
    by_doc: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for d, w, p in zip(doc.tolist(), word.tolist(), found, strict=True):
        by_doc[d].append((w, p))
    spans, items = list(spans), list(items)
    for d, hits in by_doc.items():
        runs = [(s, s + n) for s, n in zip(spans[d][::2], spans[d][1::2], strict=True)]
        runs += [(w, w + searcher.words[p]) for w, p in hits]
        spans[d] = [x for s, e in merged(runs) for x in (s, e - s)]
        items[d] = sorted({*items[d], *(i for _, p in hits for i in searcher.items[p])})
    return spans, items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def empty() -> tuple[Column, Column]:
    return F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items")


def hit_words() -> Column:
    """Words in ``spans``: the sum of every second number."""
    lengths = F.filter("spans", lambda _, i: i % 2 == 1)
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def judged(found: DataFrame) -> DataFrame:
    """:func:`scan`'s rows with n_hit, n_items, items_sha256 and contaminated (a twentieth of the words is hit)."""
    return found.withColumn("n_hit", hit_words()).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that aren't contaminated."""
    context, fields = docs.sparkSession.sparkContext, docs.schema.names
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in fields]).alias("row"), *empty())
    searchers = [context.broadcast(Searcher(b)) for b in blocks(benchmark)]
    for k, searcher in enumerate(searchers):
        last = k == len(searchers) - 1
        schema = T.StructType([T.StructField("row", rows.schema["row"].dataType)])
        schema = schema.add("n_words", "long") if last else schema.add("text", "string")
        schema = schema.add("spans", T.ArrayType(T.IntegerType())).add("items", T.ArrayType(T.StringType()))
        rows = mapped(rows, searching(searcher, last, "row"), schema, ["text", "row", "spans", "items"])
    if not searchers:
        return docs
    n_hit = hit_words()
    return rows.filter(~((n_hit > 0) & (20 * n_hit >= F.col("n_words")))).select("row.*")
