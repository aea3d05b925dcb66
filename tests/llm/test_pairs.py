"""Near-duplicates, top-k and suffix dedup against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import neardup, suffix, topk

WORDS = [f"w{i}" for i in range(400)]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, bucket string")


def row(i, text):
    return (i, text, None, "s", None if text is None else len(text), 7, "x")


# ---- near-duplicates


def word_sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute_components(rows, percent=85):
    sets = word_sets(rows)
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return label, {i: len(s) for i, s in sets.items()}


def corpus(seed, n, size=120, edits=(0, 1, 2, 3, 5, 9)):
    random.seed(seed)
    templates = [[random.choice(WORDS) for _ in range(size)] for _ in range(4)]
    rows = []
    for i in range(n):
        words = list(random.choice(templates)) if random.random() < 0.7 else [random.choice(WORDS) for _ in range(random.randint(1, 60))]
        for _ in range(random.choice(edits)):
            words[random.randrange(len(words))] = random.choice(WORDS)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_all_pairs(spark, seed):
    rows = corpus(seed, 160)
    rows += [(500, rows[0][1].upper().replace(" ", "\n\t")), (501, None), (502, ""), (503, " \n"), (504, "two words"), (505, "Two WORDS"), (506, "é É"), (507, "É é")]
    label, sizes = brute_components(rows)
    found = {r.doc_id: r for r in neardup.find(docs(spark, [row(*r) for r in rows])).collect()}
    assert {i: r.component_id for i, r in found.items()} == label
    assert {i: r.n_shingles for i, r in found.items()} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.values())


def test_near_duplicates_cross_rounds(spark):
    # a chain: each text differs from the next by little, from the others by more
    random.seed(9)
    base = [random.choice(WORDS) for _ in range(200)]
    rows = []
    for i in range(12):
        base = list(base)
        base[(i * 16) % 200 : (i * 16) % 200 + 6] = [random.choice(WORDS) for _ in range(6)]
        rows.append((i, " ".join(base)))
    label, _ = brute_components(rows)
    found = neardup.find(docs(spark, [row(*r) for r in rows])).collect()
    assert {r.doc_id: r.component_id for r in found} == label


def test_near_duplicates_pivot_turns(spark, monkeypatch):
    # one group of copies around the threshold, of which each is linked with some of the others only
    random.seed(4)
    base = [random.choice(WORDS) + str(i) for i in range(150)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in random.sample(range(150), random.choice((1, 2, 3))):
            words[at] = random.choice(WORDS)
        rows.append((i, " ".join(words)))
    label, _ = brute_components(rows)
    assert 1 < len(set(label.values())) < 60
    turns, to_pivots = [], neardup.to_pivots
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    monkeypatch.setattr(neardup, "to_pivots", lambda m, pivots, percent: turns.append(pivots) or to_pivots(m, pivots, percent))
    found = neardup.find(docs(spark, [row(*r) for r in rows])).collect()
    assert {r.doc_id: r.component_id for r in found} == label
    assert turns[:1] == [1]


def test_near_duplicates_repeated_rows_nulls_and_empty(spark):
    same = "one two three four five six seven"
    rows = [row(3, same), row(3, same), row(4, same), row(None, same), row(5, "x " * 30000)]
    found = sorted((r.doc_id or 0, r.component_id) for r in neardup.find(docs(spark, rows)).collect())
    assert found == [(0, None), (3, 3), (3, 3), (4, 3), (5, 5)]
    kept = neardup.keep(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 5]
    assert neardup.find(docs(spark, [])).count() == 0


def test_sketches_estimate_similarity():
    random.seed(1)
    a = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64))
    b = np.sort(np.concatenate([a[60:], np.random.default_rng(1).integers(0, 1 << 63, 60).astype(np.uint64)]))
    sa, sb = neardup.sketches(np.array([neardup.samples(a), neardup.samples(b)]))
    differing = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in sa ^ sb)
    assert 0 < differing <= neardup.most_bits(85)
    c = np.random.default_rng(2).integers(0, 1 << 63, 1000).astype(np.uint64)
    (sc,) = neardup.sketches(np.array([neardup.samples(c)]))
    assert sum(bin(int(x) & (1 << 64) - 1).count("1") for x in sa ^ sc) > neardup.most_bits(85)


def test_sets_follow_words():
    texts = ["A b\x0bc d  e\nf", "a B c D e f", "a b c", "", " ", "a b c d", "a\x85b c d e", "a b c d e"]
    sets = neardup.shingle_sets([t.encode() for t in texts])
    assert [s.size for s in sets] == [2, 2, 1, 0, 0, 1, 1, 1]
    assert (sets[0] == sets[1]).all() and sets[2][0] != sets[5][0] and sets[6][0] != sets[7][0]


# ---- top-k


def brute_top(rows, k, is_query):
    sound = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and len(v) == 4:
            sound[i] = min(sound.get(i, v), v)
    vectors = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v in sound.items()}
    out = {}
    for q in vectors:
        if is_query(q):
            scores = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_top_k_against_brute_force(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(0, 0.3, 4), 1)]) for i in range(300)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(300, 420)]
    rows += [(1000, None), (1020, [None, 1.0, 1.0, 1.0]), (1040, [float("nan"), 1.0, 1.0, 1.0]), (1060, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (1080, [1.0]), (1100, [0.0] * 4), (1120, [-1e30, 1.0, 0.0, 0.0])]
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {}
    for r in topk.search(df, F.col("vec_id") % 20 == 0, 5).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    held = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    expected = brute_top(rows, 5, lambda i: i % 20 == 0)
    assert found == {q: [(i, held(s)) for i, s in best] for q, best in expected.items()}


def test_top_k_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<float>")
    found = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0, 20).collect())
    assert found == [(0, 1, 20, 64 * 64 * 3), (0, 2, 3, 64 * 32 + 128 * 32), (20, 1, 0, 64 * 64 * 3), (20, 2, 3, 64 * 64)]
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_search_stops_early():
    rng = np.random.default_rng(0)
    rows = np.zeros((4000, 8), np.int64)
    rows[:, 0] = rng.integers(-50, 50, 4000)
    block = topk.Block(np.arange(4000), rows)
    places, scores = block.search(np.array([10, 0, 0, 0, 0, 0, 0, 0]), -1, 5)
    order = np.lexsort((np.arange(4000), -rows[:, 0] * 10))[:5]
    assert (places == order).all() and (scores == rows[order, 0] * 10).all()


# ---- suffix dedup


def brute_removed(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for s in range(len(t) - 399):
            if seen[t[s : s + 400]] > 1:
                gone[s : s + 400] = b"\1" * 400
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def passages(seed):
    random.seed(seed)
    make = lambda n: " ".join(random.choice(WORDS) for _ in range(n))
    shared = [make(110) for _ in range(3)] + ["é" * 300, "ab" * 400, "z" * 900]
    rows = []
    for i in range(40):
        parts = [make(random.randint(0, 150)) for _ in range(random.randint(1, 3))]
        for _ in range(random.choice([0, 0, 1, 2])):
            p = random.choice(shared)
            cut = random.randint(0, 60)
            parts.insert(random.randrange(len(parts) + 1), p[cut : len(p) - random.randint(0, 60)])
        rows.append((i, " ".join(parts)))
    return [*rows, (100, None), (101, ""), (102, "x" * 399), (103, "q" * 400), (104, "r" * 401), (105, rows[0][1]), (106, make(3000))]


@pytest.mark.parametrize(("seed", "most"), [(1, 2000), (2, 2000), (3, 1), (4, 3)])
def test_suffix_dedup_against_brute_force(spark, seed, most, monkeypatch):
    """With ``most`` small, keys are parted across shards again and again."""
    rows = passages(seed)
    monkeypatch.setattr(suffix, "SHARD_CONTEXTS", most)
    found = suffix.dedup(docs(spark, [row(*r) for r in rows]))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()) == brute_removed(rows)


def brute_passages(rows, length=200, over=50):
    """(doc_id, bytes of the text, [(start, end)] of the passages) by all windows."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        runs, at = [], 0
        while at < len(t):
            end = at
            while end < len(t) and gone[end] == gone[at]:
                end += 1
            if gone[at] and len(t[at:end].split()) > over:
                runs.append((at, end))
            at = end
        out.append((i, t, runs))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_passages(spark, seed):
    """Counts of both lengths together, on texts that share pieces of 30 to 90 words."""
    random.seed(seed)
    shared = [" ".join(random.choices(WORDS, k=random.randint(30, 90))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [" ".join(random.choices(WORDS, k=random.randint(0, 40))) for _ in range(3)]
        parts[1:1] = random.sample(shared, random.choice([0, 1, 1, 2]))
        rows.append((i, " ".join(parts)))
    found = suffix.dedup(docs(spark, [row(*r) for r in rows])).collect()
    expected = [(i, len(r), sum(e - s for s, e in r)) for i, _, r in brute_passages(rows)]
    assert sorted((r.doc_id, r.n_passages, r.passage_bytes) for r in found) == expected
    assert any(e[1] for e in expected) and not all(e[1] for e in expected)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == brute_removed(rows)
    left = {r.doc_id: r.text for r in suffix.cleaned(docs(spark, [row(*r) for r in rows])).collect()}
    for i, t, runs in brute_passages(rows):
        whole = b"".join(t[s:e] for s, e in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(t)], strict=True))
        assert left.get(i, "") == whole.decode()


def test_near_duplicates_of_one_id_with_several_texts(spark):
    """Documents 5 and 8 have two unlike texts each; what is like either is reachable through the document."""
    random.seed(4)
    one, two, other, last = (" ".join(random.choices(WORDS, k=100)) for _ in range(4))
    rows = [(5, one), (5, two), (6, one + " z"), (7, two + " z"), (8, other), (8, last), (2, last + " z"), (9, other + " z"), (9, other + " z"), (10, "alone")]
    found = {r.doc_id: (r.component_id, r.kept) for r in neardup.find(docs(spark, [row(*r) for r in rows])).collect()}
    assert found == {5: (5, True), 6: (5, False), 7: (5, False), 8: (2, False), 2: (2, True), 9: (2, False), 10: (10, True)}
    kept = sorted((r.doc_id, r.text) for r in neardup.keep(docs(spark, [row(*r) for r in [*rows, (5, one)]])).collect())
    assert kept == sorted([(5, one), (5, two), (2, last + " z"), (10, "alone")])


def test_near_duplicate_classes_are_redrawn(spark):
    full = spark.createDataFrame([(1, 3, 7, 7), (2, 3, 7, 8), (3, 3, 7, 7)], "doc_id long, n_shingles long, hi long, lo long")
    classes, key = neardup.classed(full)
    got = {r.doc_id: r.class_id for r in full.select("doc_id", key.alias("id")).join(classes.df, "id").collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_top_k_of_large_components_and_other_lengths(spark):
    rows = [(0, [1.0, 1.0]), (1, [6e6, 0.0]), (2, [5e6, 0.0]), (3, [7e6, -1.0]), (4, [1.0, 1.0, 1.0]), (20, [2.0, 0.0, 5.0]), (40, [3e12, 1.0]), (41, [9e12, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for least in (0, 10**9):  # in double precision, in 64 bits
        own = [(i, v) for i, v in rows if i < 40 or least]
        found = topk.search(table.filter(F.col("vec_id") < 40) if not least else table, F.col("vec_id") % 20 == 0).collect()
        expected = []
        for q, x in own:
            if q % 20 == 0:
                scores = [(-sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(x, y, strict=True)), i) for i, y in own if i != q and len(x) == len(y)]
                expected += [(q, r + 1, i, max(-(2**63) + 1, min(2**63 - 1, -s))) for r, (s, i) in enumerate(sorted(scores)[:20])]
        assert sorted(tuple(r) for r in found) == sorted(expected)


def test_suffix_cleaned(spark):
    long = " ".join(random.Random(1).choices(WORDS, k=150))
    rows = [row(1, "alpha " + long + " omega"), row(2, "é" + long[1:] + "ü"), row(3, long), row(4, "clean"), row(None, "no id"), row(5, None)]
    out = suffix.cleaned(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {1, 2, 4, None, 5}
    assert got[1].text.startswith("alpha ") and len(got[1].text) < 20 and got[1].n_chars == len(got[1].text)
    assert got[2].text[0] == "é" and got[4].text == "clean" and got[5].text is None
    assert suffix.dedup(docs(spark, [])).count() == 0


def test_suffix_repeated_rows(spark):
    text = " ".join(random.Random(2).choices(WORDS, k=150))
    found = suffix.dedup(docs(spark, [row(1, text), row(1, text), row(None, text[:50])])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in found) == [(0, 0), (1, len(text)), (1, len(text))]


@pytest.mark.parametrize("seed", range(40))
def test_suffix_arrays(seed):
    random.seed(seed)
    depth = random.choice([9, 12, 23, 33, 50, 100])
    letters = b"ab" if seed % 2 else b"abcdefgh"
    pool = [bytes(random.choice(letters) for _ in range(random.randint(20, 120))) for _ in range(4)]
    contexts = []
    for _ in range(random.randint(1, 12)):
        x = b"a" * random.randint(10, 200) if random.random() < 0.2 else b"".join(random.choice(pool)[random.randint(0, 10) :] for _ in range(random.randint(1, 4)))
        if len(x) >= depth and x not in contexts:
            contexts.append(x)
    if not contexts:
        return
    counts = [random.choice([1, 1, 1, 2]) for _ in contexts]
    seen = Counter()
    for x, k in zip(contexts, counts, strict=True):
        for i in range(len(x) - depth + 1):
            seen[x[i : i + depth]] += k
    expected = [[i for i in range(len(x) - depth + 1) if seen[x[i : i + depth]] >= 2] for x in contexts]
    found = suffix.repeated(contexts, counts, depth)
    assert [[i for s, e in zip(f[::2], f[1::2], strict=True) for i in range(s, e)] for f in found] == expected
    data = np.frombuffer(b"".join(contexts), np.uint8)
    order, rank, tied = suffix.suffix_array(data, depth)
    shared, raw = suffix.common_prefixes(data, order, rank, depth), data.tobytes()
    for p, q in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
        k = 0
        while k < depth and max(p, q) + k < len(raw) and raw[p + k] == raw[q + k]:
            k += 1
        assert shared[q] == k
