"""Near-duplicate documents: MinHash bands find candidates, odd sketches verify them, full shingle sets confirm them.

A document's set holds its distinct 5-word shingles (A-Z in lower case, words ``[^\\x20\\x09-\\x0D]+``) as 64-bit
hashes; with fewer words, the whole sequence is one. Two documents are linked if ``100 * |A & B| >= 85 * |A | B|``.

1. Documents with equal sets form a class; only its member with the smallest doc_id goes on, so a large group of
   copies is one row from here on. From here on, classes are told apart by a hash of their own, which is redrawn until
   no two share it, not by doc_id: one doc_id may have several texts.
2. 128 MinHash values in 32 bands of 4: a pair at the threshold shares no band with probability 6e-11.
3. Documents that share a bucket with another are candidates. Far copies of one template share buckets by thousands
   without being linked, so pairs are drawn up from the candidates' rarest shingles: by global frequency, with length
   and positional filters, which lose no linked pair (see :func:`prefixes`). Each shingle links its holders to the
   smallest one (a star, not all pairs). Then, where holders are in different components, they are paired across
   components, at the first shingle of theirs that they share: with 16 of the shingle's holders, then, fewer being left
   outside the large components, with 64 and so on, and in the end, when that is no more work, with all. Pairs within
   one component are never needed. Pairs without a common band are dropped.
4. Odd sketches: the 128 (place, MinHash) samples are folded into 512 parity bits. The population count of the XOR of
   two sketches estimates how many samples differ, hence the similarity. Pairs estimated below the threshold by more
   than six standard deviations are dropped; all others are confirmed on their full sets.
5. Components of the confirmed links, then from classes back to documents.

Cases: null and empty texts have an empty set and stay alone; a null doc_id takes no part and has a null component;
rows with the same doc_id are judged each by its text and share a component, their classes being linked; ties can't occur, ids being compared;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrow import binary, mapped
from loomgraph.operators.components import connected_components
from loomgraph.storage import Stage

SHINGLE, PERCENT = 5, 85
BANDS, ROWS, SKETCH_LONGS = 32, 4, 8
SAMPLES, BITS = BANDS * ROWS, SKETCH_LONGS * 64
#: Id lists of at most so many rows, by count, are broadcast; longer ones are joined by shuffle.
BROADCAST_IDS = 500_000
#: Holders of a shingle that its others are compared with in the first turn; a matter of cost, not of results.
PIVOTS = 16

_random = np.random.default_rng(20240229)
_TABLE = _random.integers(0, 1 << 64, 256, np.uint64)
_STEP = _random.integers(0, 1 << 64, SHINGLE, np.uint64) | np.uint64(1)
_BASE = int(_random.integers(0, 1 << 63)) * 8 + 5
_MULTIPLY = _random.integers(0, 1 << 32, SAMPLES, np.uint32) | np.uint32(1)
_ADD = _random.integers(0, 1 << 32, SAMPLES, np.uint32)
_BAND = _random.integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1)
_PLACE = _random.integers(0, 1 << 64, SAMPLES, np.uint64)
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every other."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64."""
    out = np.ones(1, np.uint64)
    while out.size < n:
        out = np.concatenate([out, out * np.uint64(pow(base, out.size, 1 << 64))])
    return out[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, one after the other, and the number of words of each text."""
    joined = b"\n".join(texts).translate(_LOWER) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    word = ~_BLANK[data]
    edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    # sums of byte codes times powers of a base by prefix sums; dividing by the power at the start makes them comparable
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(_BASE, data.size), out=sums[1:])
    inverse = powers(pow(_BASE, -1, 1 << 64), data.size)
    hashes = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(start, ends), prepend=0)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(texts)
    n = words.size - SHINGLE + 1
    shingles = np.zeros(max(n, 0), np.uint64)
    for i in range(SHINGLE if n > 0 else 0):
        shingles += words[i : i + n] * _STEP[i]
    shingles = mix(shingles)
    out, at = [], 0
    for c in counts.tolist():
        if c >= SHINGLE:
            own = np.sort(shingles[at : at + c - SHINGLE + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if own.size > 1 else own)
        elif c:
            out.append(mix((words[at : at + c] * _STEP[:c]).sum(keepdims=True) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def samples(shingles: np.ndarray) -> np.ndarray:
    """The MinHash values of a set that isn't empty."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, low.size, 512):
        np.minimum(least, (low[i : i + 512] * _MULTIPLY + _ADD).min(axis=0), out=least)
    return least


def sketches(minima: np.ndarray) -> np.ndarray:
    """Odd sketches (rows of SKETCH_LONGS) of rows of MinHash values."""
    bit = mix(minima.astype(np.uint64) + _PLACE) % np.uint64(BITS)
    flat = (bit.astype(np.int64) + np.arange(len(minima))[:, None] * BITS).ravel()
    parity = (np.bincount(flat, minlength=len(minima) * BITS) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(len(minima), BITS), axis=1, bitorder="little").view(np.int64)


SIGNATURE = "doc_id long, n_shingles long, hi long, lo long, bands array<long>, sketch array<long>"


def signature(batch: pa.RecordBatch) -> dict:
    sets = shingle_sets(binary(batch.column("text")))
    full = [i for i, s in enumerate(sets) if s.size]
    minima = np.array([samples(sets[i]) for i in full], np.uint32).reshape(len(full), SAMPLES)
    bands = (minima.reshape(-1, BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=2, dtype=np.uint64)
    bands = mix(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
    odd = sketches(minima)
    of = {d: k for k, d in enumerate(full)}
    both = np.array([sums(s) for s in sets], np.uint64).reshape(len(sets), 2).view(np.int64)
    return {
        "doc_id": batch.column("doc_id"),
        "n_shingles": [s.size for s in sets],
        "hi": both[:, 0],
        "lo": both[:, 1],
        "bands": [bands[of[i]] if i in of else None for i in range(len(sets))],
        "sketch": [odd[of[i]] if i in of else None for i in range(len(sets))],
    }


FULL_SET = "hi long, lo long, n int, shingles array<long>"


def sums(shingles: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits of a set."""
    return mix(shingles).sum(dtype=np.uint64), mix(shingles * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)


def full_sets(batch: pa.RecordBatch) -> dict:
    sets = shingle_sets(binary(batch.column("text")))
    both = np.array([sums(s) for s in sets], np.uint64).reshape(len(sets), 2).view(np.int64)
    return {"hi": both[:, 0], "lo": both[:, 1], "n": [s.size for s in sets], "shingles": [s.view(np.int64) for s in sets]}


def only(df: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key is (or, left_anti, isn't) in ``ids`` (that one column): broadcast if their count is small."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, ids.columns[0], how)


def differing(a: Column, b: Column) -> Column:
    """Population count of the XOR of two sketches."""
    counts = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SKETCH_LONGS)]
    return sum(counts[1:], counts[0])


def most_bits(percent: int = PERCENT) -> int:
    """Most odd bits of a pair that may reach the threshold.

    The number of differing samples of a pair at the threshold is binomial; six deviations above its mean, and the
    bits they set are six deviations of their own above the expected count.
    """
    j = percent / 100
    worst = min(SAMPLES, SAMPLES * (1 - j) + 6 * (SAMPLES * j * (1 - j)) ** 0.5)
    odd = BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * worst))
    return int(min(BITS, odd + 6 * (odd * (1 - odd / BITS)) ** 0.5))


def least_overlap(a: Column, b: Column, percent: int) -> Column:
    """Least intersection of sets of these sizes at the threshold."""
    return F.ceil(percent * (a + b) / F.lit(100 + percent) - 1e-9)


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(token, id, n, place): the places, in the order of frequency, of the shingles that linked sets must share one of.

    Shingles are ordered by the number of sets that hold them, rarest first, then by value. Linked sets share one
    among the first ``n - ceil(n * percent / 100) + 1`` of each. Shingles that one set holds only have places, but no
    rows: they link nothing. Edits make rare shingles, so far copies of one template don't meet here.
    """
    rows = sets.select("id", "n", F.explode("shingles").alias("token"))
    shared = Stage(rows.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1"), "shared-shingles")
    per_set = rows.join(shared.df, "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("own"))
    length = F.col("n") - F.ceil(percent * F.col("n") / F.lit(100) - 1e-9) + 1
    alone = F.col("n") - F.size("own")
    first = F.slice("own", 1, F.greatest(F.lit(0), length - alone).cast("int"))
    return per_set.select("id", "n", alone.alias("alone"), F.posexplode(first).alias("at", "t")).select(
        F.col("t.token").alias("token"), "id", "n", (F.col("alone") + F.col("at")).alias("place")
    )


class Candidates:
    """Confirms candidate pairs of class representatives; keeps what was confirmed."""

    def __init__(self, sets: DataFrame, reps: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.signs = reps.select("id", "sketch", "bands")
        self.links: list[Stage] = []
        self.tried: list[Stage] = []

    def confirm(self, pairs: DataFrame) -> None:
        """``pairs``: (a, b) of representatives, a < b."""
        fresh = pairs.distinct()
        if self.tried:
            fresh = fresh.join(reduce(DataFrame.union, [t.df for t in self.tried]), ["a", "b"], "left_anti")
        now = Stage(fresh, "pairs")
        self.tried.append(now)
        ids, held = now.df.select(F.col("a").alias("id")).union(now.df.select("b")), None
        if now.df.count() > BROADCAST_IDS // 2:  # fewer are broadcast as they are
            held = Stage(ids.distinct(), "pair-ids")
            ids = held.df
        signs = only(self.signs, ids)
        both = now.df.join(signs.withColumnsRenamed({"id": "a", "sketch": "sa", "bands": "ba"}), "a").join(
            signs.withColumnsRenamed({"id": "b", "sketch": "sb", "bands": "bb"}), "b"
        )
        banded = both.filter(F.arrays_overlap("ba", "bb"))
        likely = Stage(banded.filter(differing(F.col("sa"), F.col("sb")) <= most_bits(self.percent)).select("a", "b"), "likely")
        sets = only(self.sets, ids)
        a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa"))
        b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb"))
        met = likely.df.join(b, "b").join(a, "a").withColumn("both", F.size(F.array_intersect("xa", "xb")))
        linked = met.filter(100 * F.col("both") >= self.percent * (F.size("xa") + F.size("xb") - F.col("both")))
        self.links.append(Stage(linked.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "links"))
        likely.drop()
        if held:
            held.drop()

    def components(self) -> Stage:
        """Components of all links; from then on, links to each component's least vertex stand for them."""
        links = self.links[0].df
        for more in self.links[1:]:
            links = links.unionByName(more.df)
        found = Stage(connected_components(links), "components")
        for s in self.links:
            s.drop()
        self.links = [Stage(found.df.filter("id <> component").select(F.col("id").alias("src"), F.col("component").alias("dst")), "links")]
        return found


def find(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, class_id, component_id, kept.

    class_id is the smallest doc_id with an equal set, component_id the smallest doc_id reachable over links.
    """
    signed = Stage(mapped(docs, signature, SIGNATURE, ["doc_id", "text"]), "signatures")
    full = signed.df.filter("n_shingles > 0 and doc_id is not null")
    classes, key = classed(full)
    unique = full.groupBy("doc_id").count().filter("count > 1").isEmpty()
    firsts = classes.df.withColumnRenamed("class_id", "doc_id")
    reps = full.select(key.alias("id"), "doc_id", "sketch", "bands").join(firsts, ["id", "doc_id"], "left_semi")
    banded = reps.select("id", "doc_id", F.explode("bands").alias("bucket"))
    shared = Stage(banded.groupBy("bucket").agg(F.min("id").alias("l"), F.max("id").alias("m")).filter("l <> m").select("bucket"), "buckets")
    candidates = Stage(banded.join(shared.df, "bucket", "left_semi").select("id", "doc_id").distinct(), "candidates")
    shared.drop()
    texts = docs.select("doc_id", "text").filter("doc_id is not null")
    found_sets = mapped(only(texts, candidates.df.select("doc_id")), full_sets, FULL_SET, ["doc_id", "text"])
    found_sets = found_sets.withColumnRenamed("n", "n_shingles").select(key.alias("id"), F.col("n_shingles").alias("n"), "shingles")
    if not unique:  # other texts of the same doc_id, and repeated rows
        found_sets = found_sets.join(candidates.df.select("id"), "id", "left_semi").dropDuplicates(["id"])
    sets = Stage(found_sets, "sets")
    members = Stage(prefixes(sets.df, percent), "prefixes")
    pivots = members.df.groupBy("token").agg(F.min(F.struct("id", "n", "place")).alias("p"))
    pivots = Stage(pivots.select("token", F.col("p.id").alias("rep"), F.col("p.n").alias("rn"), F.col("p.place").alias("rplace")), "pivots")
    found = Candidates(sets.df, reps, percent)
    found.confirm(paired(members.df, pivots.df, F.col("id") != F.col("rep"), percent))
    pivots.drop()
    if not unique:
        named = full.select("doc_id", key.alias("id")).distinct()
        star = named.groupBy("doc_id").agg(F.min("id").alias("src"))
        found.links.append(Stage(named.join(star, "doc_id").filter("id <> src").select("src", F.col("id").alias("dst")), "same-document"))
    labels = found.components()
    pivots = PIVOTS
    while True:
        mixed = mixed_members(members.df, labels.df)
        work, rows = outstanding(mixed.df)
        last = work <= pivots * rows
        pairs = Stage(across(mixed.df, percent) if last else to_pivots(mixed.df, pivots, percent), "across")
        if not pairs.df.isEmpty():
            found.confirm(pairs.df)
            labels.drop()
            labels = found.components()
        mixed.drop()
        pairs.drop()
        if last:
            break
        pivots *= 4
    for s in (candidates, sets, members, *found.links, *found.tried):
        s.drop()
    placed = labels.df.join(classes.df, "id")
    least = placed.groupBy("component").agg(F.min("class_id").alias("least"))
    placed = placed.join(least, "component").select("id", "least")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), key)
    by_class = signed.df.select("doc_id", "n_shingles", own.alias("id")).join(classes.df, "id", "left").join(placed, "id", "left")
    component = F.coalesce("least", "class_id", "doc_id")
    return by_class.select(
        "doc_id",
        "n_shingles",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def classed(full: DataFrame) -> tuple[Stage, Column]:
    """(id, class_id) of the classes of equal sets, and the column that gives the class of a row of ``full``.

    An id is 64 bits of the set; if two classes share one (their other 64 bits or their sizes differ), all are redrawn.
    """
    for salt in range(100):
        key = F.col("hi") if not salt else F.xxhash64("hi", "lo", "n_shingles", F.lit(salt))
        ends = [f(c).alias(f"{name}_{c}") for c in ("lo", "n_shingles") for name, f in (("least", F.min), ("most", F.max))]
        classes = Stage(full.groupBy(key.alias("id")).agg(F.min("doc_id").alias("class_id"), *ends), "classes")
        if classes.df.filter("least_lo <> most_lo or least_n_shingles <> most_n_shingles").isEmpty():
            classes.df = classes.df.select("id", "class_id")
            return classes, key
        classes.drop()
    raise RuntimeError("classes can't be told apart")


def paired(members: DataFrame, offered: DataFrame, more: Column, percent: int) -> DataFrame:
    """Pairs (a, b) of members (token, id, n, place) and offered (token, rep, rn, rplace) that may be linked.

    If the token is the first that both share, what follows it in either bounds the intersection; of linked sets, the
    token that is the first passes.
    """
    least = least_overlap(F.col("n"), F.col("rn"), percent)
    sized = 100 * F.least("n", "rn") >= percent * F.greatest("n", "rn")
    placed = (F.col("n") - F.col("place") >= least) & (F.col("rn") - F.col("rplace") >= least)
    o = offered.withColumnRenamed("token", "otoken")
    met = members.join(o, (F.col("token") == F.col("otoken")) & more & sized & placed)
    return met.select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")).distinct()


def mixed_members(members: DataFrame, labels: DataFrame) -> Stage:
    """Members, with labels, of the tokens that more than one component holds."""
    named = members.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    held = Stage(named, "labelled")
    mixed = Stage(held.df.groupBy("token").agg(F.min("label").alias("l"), F.max("label").alias("m")).filter("l <> m"), "mixed")
    out = held.df.join(mixed.df.select("token"), "token", "left_semi")
    out = Stage(with_before(out), "mixed-members")
    held.drop()
    mixed.drop()
    return out


def with_before(members: DataFrame) -> DataFrame:
    """Members (token, id, n, place, label) with "before": the tokens in front of this one in the member's own rows.

    A pair is drawn at the first token that both hold only, so each pair is drawn once.
    """
    own = F.sort_array(F.collect_list(F.struct("place", "token"))).alias("own")
    lists = members.groupBy("id", "n", "label").agg(own).select("id", "n", "label", "own", F.posexplode("own").alias("at", "t"))
    before = F.slice(F.col("own.token"), 1, F.col("at"))
    return lists.select(F.col("t.token").alias("token"), "id", "n", F.col("t.place").alias("place"), "label", before.alias("before"))


def outstanding(members: DataFrame) -> tuple[float, int]:
    """A bound of the pairs that :func:`across` draws, and the number of members."""
    sizes = members.groupBy("token", "label").agg(F.count("*").cast("double").alias("c"))
    tokens = sizes.groupBy("token").agg(F.sum("c").alias("all"), F.max("c").alias("top"))
    found = tokens.agg(F.sum(F.col("all") * (F.col("all") - F.col("top"))), F.sum("all")).first()
    return found[0] or 0.0, int(found[1] or 0)


def offering(offered: DataFrame) -> DataFrame:
    return offered.withColumnsRenamed({"id": "rep", "n": "rn", "place": "rplace", "label": "own", "before": "rbefore"})


def to_pivots(members: DataFrame, pivots: int, percent: int) -> DataFrame:
    """Pairs (a, b) with different labels of a token's members and at most so many of them.

    Tokens choose by a hash of the id, so that tokens with much the same members choose much the same pivots.
    """
    drawn = F.xxhash64("id", F.lit(pivots))
    least = F.min_by(F.struct("id", "n", "place", "label"), drawn).alias("p")
    chosen = members.groupBy("token", F.pmod(drawn, F.lit(pivots)).alias("part")).agg(least).select("token", "p.*")
    first = ~F.arrays_overlap("before", "rbefore")
    return paired(members, offering(with_before(chosen)), (F.col("label") != F.col("own")) & first, percent)


def across(members: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) with different labels of a token's members, each once.

    A token's members are joined with those that don't have its largest label.
    """
    sizes = members.groupBy("token", "label").count()
    largest = sizes.groupBy("token").agg(F.max(F.struct("count", "label")).alias("top")).select("token", "top.label")
    offered = offering(members.join(largest, ["token", "label"], "left_anti"))
    mine = members.join(largest.withColumnRenamed("label", "top"), "token")
    once = (F.col("label") == F.col("top")) | (F.col("id") < F.col("rep"))
    first = ~F.arrays_overlap("before", "rbefore")
    return paired(mine, offered, (F.col("label") != F.col("own")) & once & first, percent)


def keep(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` (all columns) that are the first of their component; rows without doc_id stay."""
    dropped = Stage(find(docs, percent).filter("doc_id is not null and not kept").select("doc_id").distinct(), "dropped")
    rows = only(docs, dropped.df, "left_anti")
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return rows
    # repeated rows: one of them stays, but each of the texts of one document
    return rows.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(rows.filter("doc_id is null"))
