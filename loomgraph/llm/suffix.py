"""Exact substring dedup: bytes covered by strings of a fixed length that also start anywhere else.

Two lengths are in use. :func:`dedup` removes what 400-byte strings cover and counts passages; :func:`cleaned` removes
passages: maximal runs covered by repeated 200-byte strings that hold more than 50 words. A passage of over 50 words is
rarely shorter than 200 bytes and often shorter than 400. Suffix arrays find the repeated strings. So that the strings
that have to be compared meet in one shard, and those that can't repeat never do, texts are cut by content first:

1. Every window (string of the length) has an anchor: the gram (64 bytes for 400, 32 for 200) with the least hash in it
   (the first of equal ones). Equal windows have equal anchors. Consecutive windows with the same anchor place form a
   run; the bytes of a run are its context, less than two lengths. Runs whose anchor gram occurs once in the corpus hold
   no repeated window and go.
2. Equal contexts (by 192 bits of hash) are held once, with their number; a context that occurs twice repeats in all its
   windows.
3. Contexts are dealt by anchor gram to shards of less than 2**20 bytes. Each shard gets a suffix array by Larsson and
   Sadakane's refinement in numpy: order by 8 bytes, then groups of equal prefixes are ordered by the rank of what
   follows, 16, 32, ... up to the length; groups of one are done. Kasai's rule gives common prefixes (capped at the
   length) of neighbours: with a stride that is halved, the prefix of place i bounds that of i + d from below. Runs of
   neighbours with that many common bytes that hold two window starts are repeats.
4. Merging across shards: an anchor gram with more contexts than fit a shard is parted by binary search on the place of
   the window. Windows to the left and to the right of the middle share longer cores around the anchor; each half is
   dealt by its core, whose unique ones go, and halves that are still too many are parted again, at most nine times
   (then the core is the window itself). No shard's size, nor any group's, grows with the corpus.
5. Repeated window starts go back to their documents and are united. A 400-byte string that repeats lies where 200-byte
   strings do, so the longer ones are searched only within the runs that the shorter ones cover.

Cases: null is an empty text; texts shorter than the length keep everything; a null doc_id stays null; repeated rows are
documents of their own, so their windows repeat; further columns are ignored by :func:`dedup` and carried by
:func:`cleaned`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.arrow import binary, bounded_batches, mapped
from loomgraph.storage import Stage

#: Bytes of the strings that :func:`dedup` removes.
LENGTH = 400
#: A passage is a run of repeated strings of so many bytes that holds more than so many words.
PASSAGE, OVER_WORDS = 200, 50
#: A shard holds fewer than 2**PLACE_BITS bytes, so that two ranks and a place fit 64 bits.
PLACE_BITS = 20
#: More contexts than this with one key are parted further (their bytes might not fit a shard).
SHARD_CONTEXTS = 1200
BROADCAST_IDS = 500_000
NO_ID = -(1 << 63)


# ---- anchors -------------------------------------------------------------------------------------------------------


def gram_of(length: int) -> int:
    """Bytes of the anchors of strings of so many bytes, a multiple of 16: a sixth at most, but 16 at least."""
    return max(16, length // 6 // 16 * 16)


def gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """Hashes of the ``gram`` bytes (a multiple of 16) from each place on."""
    n = len(data) - gram + 1
    h = np.zeros(n, np.uint64)
    for at in range(0, gram, 16):
        h ^= np.ndarray((n,), "<u8", data, at, (1,)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h ^= np.ndarray((n,), "<u8", data, at + 8, (1,)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(31))


def runs(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor place and anchor hash of each run of the text."""
    if len(text) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    gram = gram_of(length)
    hashes = gram_hashes(text, gram)
    # the least of (hash, place) over length - gram + 1 grams, by doubling
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(hashes.size, dtype=np.uint64)
    width, wanted = 1, length - gram + 1
    while width * 2 <= wanted:
        least = np.minimum(least[: least.size - width], least[width:])
        width *= 2
    if width < wanted:
        least = np.minimum(least[: least.size - (wanted - width)], least[wanted - width :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    return first, np.diff(first, append=anchor.size), anchor[first], hashes[anchor[first]]


def digest(context: bytes, offset: int) -> tuple[int, int]:
    """128 bits of a context and its anchor's place in it, as two signed numbers."""
    d = hashlib.blake2b(context, digest_size=16, key=offset.to_bytes(4, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


OCCURRENCE = "id long, tag long, at int, n int, offset int, key long, hi long, lo long"


def occurrences(batch: pa.RecordBatch, length: int) -> dict:
    texts = binary(batch.column("text"))
    found: dict[str, list] = {c.split()[0]: [] for c in OCCURRENCE.split(", ")}
    for i, t, tag in zip(batch.column("id").to_pylist(), texts, batch.column("tag").to_pylist(), strict=True):
        first, n, anchor, key = runs(t, length)
        ends = (first + n + length - 1).tolist()
        offset = (anchor - first).tolist()
        both = [digest(t[s:e], o) for s, e, o in zip(first.tolist(), ends, offset, strict=True)]
        found["id"] += [i] * len(both)
        found["tag"] += [tag] * len(both)
        found["at"] += first.tolist()
        found["n"] += n.tolist()
        found["offset"] += offset
        found["key"] += key.view(np.int64).tolist()
        found["hi"] += [a for a, _ in both]
        found["lo"] += [b for _, b in both]
    return found


# ---- suffix arrays -------------------------------------------------------------------------------------------------


def suffix_array(data: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of all places of ``data`` (uint8, less than 2**PLACE_BITS) by their next ``depth`` bytes, ties by place.

    Also the rank of each place in that order, and whether its ``depth`` bytes are another place's too, as ranks tell.
    """
    n = data.size
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).tobytes()
    words = np.ndarray((n,), ">u8", padded, 0, (1,)).astype(np.uint64)
    order = np.argsort(words)  # ties are ordered by the rounds below
    sorted_words = words[order]
    head = np.concatenate([[True], sorted_words[1:] != sorted_words[:-1]])
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # a group is named by its first rank
    name = np.empty(n + 1, np.int64)
    name[order] = group
    name[n] = 0  # what lies behind the end; windows never reach it
    done = 8
    low, mid = np.uint64(PLACE_BITS), np.uint64(2 * PLACE_BITS)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    while done < depth:
        step = min(done, depth - done)
        alone = head & np.concatenate([head[1:], [True]])
        open_ = np.flatnonzero(~alone)  # ranks in groups of more than one
        if not open_.size:
            break
        place = order[open_]
        after = name[np.minimum(place + step, n)]
        packed = (group[open_].astype(np.uint64) << mid) | (after.astype(np.uint64) << low) | place.astype(np.uint64)
        packed.sort()
        order[open_] = (packed & mask).astype(np.int64)
        pair = packed >> low
        split = np.concatenate([[True], pair[1:] != pair[:-1]])
        head[open_] = split
        group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        name[order[open_]] = group[open_]
        done += step
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    tied = np.empty(n, bool)
    tied[order] = ~(head & np.concatenate([head[1:], [True]]))
    return order, rank, tied


def common_prefixes(
    data: np.ndarray, order: np.ndarray, rank: np.ndarray, depth: int = LENGTH, among: np.ndarray | None = None
) -> np.ndarray:
    """For each place (or those ``among`` marks; 0 elsewhere), the bytes, at most ``depth``, shared with the place before it.

    Kasai's rule: if i shares l bytes with j before it, then i + d shares l - d with j + d, and, if j + d is before
    i + d in the order, at least as many with the place just before i + d.
    """
    n = data.size
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([data, np.zeros(depth + 16, np.uint8)]).tobytes()
    words = np.ndarray((n + depth + 8,), "<u8", padded, 0, (1,))
    out = np.zeros(n, np.int64)
    stride = 64
    levels = [(np.arange(0, n, stride), 0)]
    while stride > 1:
        levels.append((np.arange(stride // 2, n, stride), stride // 2))
        stride //= 2
    for places, d in levels:
        places = places[before[places] >= 0]
        if among is not None:
            places = places[among[places]]
        least = np.zeros(places.size, np.int64)
        if d:
            shifted = before[places - d] + d
            holds = (before[places - d] >= 0) & (shifted < n)
            holds &= rank[np.minimum(shifted, n - 1)] < rank[places]
            least = np.where(holds, np.maximum(out[places - d] - d, 0), 0)
        other, going = before[places], np.arange(places.size)
        while going.size:
            at = least[going]
            p, q = places[going] + at, other[going] + at
            differ = words[p] ^ words[q]
            same = differ == 0
            # the lowest differing byte of the eight
            bit = (differ & (~differ + np.uint64(1))).astype(np.float64)
            equal = np.where(same, 8, (np.log2(np.maximum(bit, 1)) // 8).astype(np.int64))
            # bytes behind the end of the data are no bytes
            least[going] = np.minimum(np.minimum(at + equal, depth), n - np.maximum(places[going], other[going]))
            going = going[same & (least[going] == at + 8)]
        out[places] = least
    return out


def repeated(contexts: list[bytes], counts: list[int], depth: int = LENGTH) -> list[list[int]]:
    """For each distinct context, the windows that repeat, as flat [start, end) pairs; ``counts`` says how often it occurs."""
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    starts_window = np.zeros(data.size, bool)
    for s, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        starts_window[s : e - depth + 1] = True
    order, rank, tied = suffix_array(data, depth)
    shared = common_prefixes(data, order, rank, depth, tied)
    run = np.cumsum(shared[order] < depth) - 1 if data.size else np.zeros(0, np.int64)
    valid = starts_window[order]
    number = np.bincount(run[valid], minlength=(run[-1] + 1) if run.size else 0)
    again = np.zeros(data.size, bool)
    again[order] = valid & (number[run] >= 2)
    out = []
    for s, e, c in zip((ends - sizes).tolist(), ends.tolist(), counts, strict=True):
        n = e - s - depth + 1
        if c >= 2:
            out.append([0, n])
        else:
            edge = np.flatnonzero(np.diff(again[s : s + n].astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
            out.append(edge.tolist())
    return out


# ---- shards --------------------------------------------------------------------------------------------------------

VERDICT = "key long, hi long, lo long, spans array<int>"


def judge_shards(contexts: DataFrame, length: int) -> DataFrame:
    """Verdicts on contexts (key, hi, lo, total, bytes): those of one key together, few enough for a shard."""
    bounded_batches(contexts.sparkSession)
    schema = pa.schema([("key", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("spans", pa.list_(pa.int32()))])
    limit = 1 << PLACE_BITS

    def judge(rows: list[tuple]) -> pa.RecordBatch:
        spans = repeated([r[4] for r in rows], [r[3] for r in rows], length)
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)] + [pa.array(spans, schema.field("spans").type)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []  # whole keys
        own: list[tuple] = []  # the key that is being read
        size = own_size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "hi", "lo", "total", "bytes")), strict=True):
                if own and row[0] != own[0][0]:
                    if shard and size + own_size >= limit:
                        yield judge(shard)
                        shard, size = [], 0
                    shard += own
                    size += own_size
                    own, own_size = [], 0
                if own and row[:3] == own[-1][:3]:  # the same context of a repeated row
                    continue
                own.append(row)
                own_size += len(row[4])
        if shard and size + own_size >= limit:
            yield judge(shard)
            shard = []
        if shard or own:
            yield judge(shard + own)

    dealt = contexts.select("key", "hi", "lo", "total", "bytes").repartition("key").sortWithinPartitions("key", "hi", "lo")
    return dealt.mapInArrow(run, VERDICT)


CONTEXT = ["key", "hi", "lo", "total", "offset", "low", "high", "bytes"]
PARTED = (
    "pkey long, phi long, plo long, first int, key long, hi long, lo long, total long, offset int, low int, high int, bytes binary"
)


def part(batch: pa.RecordBatch, length: int) -> dict:
    """Contexts (CONTEXT), whose windows lie ``low`` to ``high`` bytes before the anchor, parted into halves."""
    out: dict[str, list] = {c.split()[0]: [] for c in PARTED.split(", ")}
    for key, hi, lo, total, offset, low, high, data in zip(*(batch.column(c).to_pylist() for c in CONTEXT), strict=True):
        n, middle = len(data) - length + 1, (low + high) // 2
        for least, most in ((low, middle), (middle + 1, high)):
            # window t of the context lies offset - t bytes before the anchor
            first, last = max(0, offset - most), min(n - 1, offset - least)
            if first > last:
                continue
            core = data[offset - least : offset - most + length]
            own = data[first : last + length]
            child = digest(core, least)[0]
            a, b = digest(own, offset - first)
            values = (key, hi, lo, first, child, a, b, total, offset - first, least, most, own)
            for name, v in zip(out, values, strict=True):
                out[name].append(v)
    return out


def resolve(contexts: DataFrame, length: int = LENGTH, most: int | None = None) -> DataFrame:
    """Verdicts on distinct contexts (CONTEXT), however many a key has: a loop of at most nine rounds.

    A round judges the keys whose contexts fit a shard and parts the others. Keys of a single window have one context,
    so the loop ends. Verdicts then go back from the last round's halves to the first round's contexts.
    """
    most = most or SHARD_CONTEXTS
    judged: list[Stage] = []
    halves: list[Stage] = []
    while True:
        numbers = Stage(contexts.groupBy("key").agg(F.count("*").alias("contexts"), F.sum("total").alias("all")), "keys")
        again = numbers.df.filter("all >= 2")
        # a key with one context that occurs twice: all its windows repeat
        alone = contexts.join(again.filter("contexts = 1").select("key"), "key", "left_semi")
        alone = alone.select("key", "hi", "lo", F.array(F.lit(0), (F.length("bytes") - length + 1)).alias("spans"))
        few = contexts.join(again.filter(f"contexts between 2 and {most}").select("key"), "key", "left_semi")
        judged.append(Stage(alone.unionByName(judge_shards(few, length)), "judged"))
        hot = again.filter(F.col("contexts") > most).select("key")
        if hot.isEmpty():
            numbers.drop()
            break
        halves.append(Stage(mapped(contexts.join(hot, "key", "left_semi"), partial(part, length=length), PARTED, CONTEXT), "halves"))
        numbers.drop()
        firsts = [F.first(c).alias(c) for c in ("offset", "low", "high", "bytes")]
        distinct = halves[-1].df.groupBy("key", "hi", "lo").agg(F.sum("total").alias("total"), *firsts)
        contexts = Stage(distinct, "parted").df
    verdicts = judged.pop().df
    while halves:
        side = halves.pop()
        back = side.df.join(verdicts, ["key", "hi", "lo"])
        shifted = back.select("pkey", "phi", "plo", F.transform("spans", lambda x: x + F.col("first")).alias("spans"))
        both = shifted.groupBy("pkey", "phi", "plo").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # two halves
        parents = both.select(F.col("pkey").alias("key"), F.col("phi").alias("hi"), F.col("plo").alias("lo"), "spans")
        verdicts = Stage(judged.pop().df.unionByName(parents), "verdicts").df
        side.drop()
    return verdicts


# ---- the operator --------------------------------------------------------------------------------------------------


def only(df: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose (id, tag) is among ``ids`` (or isn't: left_anti); ids are broadcast if they are few, by count."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, ["id", "tag"], how)


def named(docs: DataFrame) -> DataFrame:
    """``docs`` with an id that isn't null and a tag that tells apart texts with the same id."""
    return docs.withColumns({"id": F.coalesce("doc_id", F.lit(NO_ID)), "tag": F.xxhash64("text")})


def spans(texts: DataFrame, length: int = LENGTH) -> Stage:
    """(id, tag, spans) of the texts (id, tag, text) with repeated windows; flat [start, end) pairs of window starts."""
    every = Stage(mapped(texts, partial(occurrences, length=length), OCCURRENCE, ["id", "tag", "text"]), "runs")
    twice = Stage(every.df.groupBy("key").agg(F.count("*").alias("c")).filter("c >= 2").select("key"), "repeated-keys")
    some = Stage(every.df.join(twice.df, "key", "left_semi"), "repeated-runs")
    every.drop()
    twice.drop()
    sole = F.min(F.struct("id", "tag", "at", "n", "offset"))
    distinct = Stage(some.df.groupBy("key", "hi", "lo").agg(F.count("*").alias("total"), sole.alias("own")), "contexts")
    per_key = Stage(distinct.df.groupBy("key").agg(F.count("*").alias("c")), "context-numbers")
    # a key with one context: it occurs at least twice, so all its windows repeat
    simple = distinct.df.join(per_key.df.filter("c = 1").select("key"), "key", "left_semi").select(
        "key", "hi", "lo", F.array(F.lit(0), F.col("own.n")).alias("spans")
    )
    several = distinct.df.join(per_key.df.filter("c > 1").select("key"), "key", "left_semi")
    wanted = Stage(
        several.groupBy(F.col("own.id").alias("id"), F.col("own.tag").alias("tag")).agg(
            F.collect_list(F.struct("key", "hi", "lo", "total", "own.at", "own.n", "own.offset")).alias("own")
        ),
        "wanted",
    )
    some_texts = only(texts, wanted.df.select("id", "tag"))
    contexts = Stage(
        mapped(some_texts.join(wanted.df, ["id", "tag"]), partial(cut, length=length), CUT, ["text", "own"]),
        "context-bytes",
    )
    wanted.drop()
    verdicts = Stage(simple.unionByName(resolve(contexts.df, length)).filter(F.size("spans") > 0), "verdicts")
    shifted = F.transform("spans", lambda x: x + F.col("at"))
    back = some.df.join(verdicts.df, ["key", "hi", "lo"]).select("id", "tag", shifted.alias("spans"))
    out = Stage(back.groupBy("id", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    for s in (some, distinct, per_key, contexts, verdicts):
        s.drop()
    return out


CUT = "key long, hi long, lo long, total long, offset int, low int, high int, bytes binary"


def cut(batch: pa.RecordBatch, length: int) -> dict:
    out: dict[str, list] = {c: [] for c in CONTEXT}
    for text, own in zip(binary(batch.column("text")), batch.column("own").to_pylist(), strict=True):
        for r in own:
            for c in ("key", "hi", "lo", "total", "offset"):
                out[c].append(r[c])
            out["low"].append(0)
            out["high"].append(length - gram_of(length))
            out["bytes"].append(text[r["at"] : r["at"] + r["n"] + length - 1])
    return out


def removed(flat: list[int], length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the windows starting in these [start, end) pairs cover."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(flat[::2], flat[1::2], strict=True)):
        e += length - 1
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def without(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    starts, ends = [0, *(e for _, e in gone)], [*(s for s, _ in gone), len(text)]
    return b"".join(text[s:e] for s, e in zip(starts, ends, strict=True))


def passages(text: bytes, flat: list[int], length: int = PASSAGE, over: int = OVER_WORDS) -> list[tuple[int, int]]:
    """The maximal runs that hold more than ``over`` words (parted by white space)."""
    return [(s, e) for s, e in removed(flat, length) if len(text[s:e].split()) > over]


def part_runs(batch: pa.RecordBatch, least: int, length: int) -> dict:
    """The runs that strings of ``least`` bytes cover and that can hold one of ``length``, each as a text of its own."""
    out: dict[str, list] = {"id": [], "tag": [], "at": [], "text": []}
    for i, tag, text, flat in zip(batch.column("id").to_pylist(), batch.column("tag").to_pylist(), binary(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
        for s, e in removed(flat, least):
            if e - s >= length:
                for name, v in zip(out, (i, tag, s, text[s:e]), strict=True):
                    out[name].append(v)
    return out


def longer(texts: DataFrame, short: DataFrame, least: int, length: int) -> DataFrame:
    """(id, tag, long): windows of ``length`` that repeat, from the ``short`` ones (id, tag, spans) of ``least`` bytes.

    Each part of a repeated string repeats too, so a longer one lies within a run that shorter ones cover.
    """
    inner = mapped(texts.join(short, ["id", "tag"]), partial(part_runs, least=least, length=length), "id long, tag long, at int, text binary", ["id", "tag", "text", "spans"])
    held = Stage(inner.withColumn("own", F.xxhash64("tag", "at")), "covered")
    found = spans(held.df.select("id", F.col("own").alias("tag"), "text"), length)
    places = held.df.select("id", "tag", "at", "own").distinct()
    back = places.join(found.df.select("id", F.col("tag").alias("own"), "spans"), ["id", "own"])
    shifted = back.select("id", "tag", F.transform("spans", lambda x: x + F.col("at")).alias("spans"))
    out = Stage(shifted.groupBy("id", "tag").agg(F.flatten(F.collect_list("spans")).alias("long")), "long-spans")
    held.drop()
    found.drop()
    return out.df


def dedup(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, over: int = OVER_WORDS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): what repeats, and what remains without it.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the strings of ``length`` bytes; n_passages and
    passage_bytes, the runs of repeated strings of ``passage`` bytes that hold more than ``over`` words, which are counted
    but not removed; kept, what remains as binary, null where nothing was removed.
    """
    passage = min(passage, length)
    texts = named(docs.select("doc_id", "text"))
    short = spans(texts.select("id", "tag", "text"), passage).df
    ids = short.select("id", "tag")
    some = only(texts, ids)
    long = longer(some, short, passage, length) if passage < length else short.withColumnRenamed("spans", "long")

    def work(batch: pa.RecordBatch) -> dict:
        texts = binary(batch.column("text"))
        runs = [removed(flat or [], length) for flat in batch.column("long").to_pylist()]
        wordy = [passages(t, flat, passage, over) for t, flat in zip(texts, batch.column("spans").to_pylist(), strict=True)]
        kept = [without(t, r) for t, r in zip(texts, runs, strict=True)]
        return {
            "doc_id": batch.column("doc_id"),
            "n_bytes": [len(t) for t in texts],
            "n_removed": [len(t) - len(k) for t, k in zip(texts, kept, strict=True)],
            "n_spans": [len(r) for r in runs],
            "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
            "n_passages": [len(w) for w in wordy],
            "passage_bytes": [sum(e - s for s, e in w) for w in wordy],
            "kept": [k if r else None for k, r in zip(kept, runs, strict=True)],
        }

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long, kept binary"
    touched = mapped(some.join(short, ["id", "tag"]).join(long, ["id", "tag"], "left"), work, schema, ["doc_id", "text", "spans", "long"])
    none = F.lit(0).cast("long")
    whole = F.coalesce("text", F.lit(""))
    rest = only(texts, ids, "left_anti").select(
        "doc_id",
        F.octet_length(whole).cast("long").alias("n_bytes"),
        none.alias("n_removed"),
        none.alias("n_spans"),
        F.sha2(whole, 256).alias("kept_sha256"),
        none.alias("n_passages"),
        none.alias("passage_bytes"),
        F.lit(None).cast("binary").alias("kept"),
    )
    return touched.unionByName(rest)


def cleaned(docs: DataFrame, passage: int = PASSAGE, over: int = OVER_WORDS) -> DataFrame:
    """``docs`` (all columns) without passages that repeat: runs of repeated strings of ``passage`` bytes with more than
    ``over`` words. Texts of which nothing is left go, n_chars follows the text.

    Where a cut would split a character, the rest of that character goes too.
    """
    fields = docs.schema.names
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in fields]).alias("row"))
    found = spans(named(rows.select("doc_id", "text")), passage)
    ids = found.df.select("id", "tag")
    texts = named(rows)

    def work(batch: pa.RecordBatch) -> dict:
        pairs = zip(binary(batch.column("text")), batch.column("spans").to_pylist(), strict=True)
        gone = [(t, passages(t, flat, passage, over)) for t, flat in pairs]
        # null: nothing goes
        return {"row": batch.column("row"), "left": [without(t, g).decode("utf-8", "ignore") if g else None for t, g in gone]}

    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("left", T.StringType())])
    touched = mapped(only(texts, ids).join(found.df, ["id", "tag"]), work, schema, ["text", "spans", "row"])
    touched = touched.filter("left is null or left <> ''")
    values = {"text": F.col("left"), "n_chars": F.length("left")}
    types = dict(docs.dtypes)
    own = lambda c: F.col(f"row.`{c}`")
    new = touched.select(
        *[(F.when(F.col("left").isNotNull(), values[c].cast(types[c])).otherwise(own(c)) if c in values else own(c)).alias(c) for c in fields]
    )
    return new.unionByName(only(texts, ids, "left_anti").select("row.*"))
