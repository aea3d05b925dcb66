"""Decontamination, licenses, URLs, mixing and the trained scorers on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import contamination, language, licenses, mixing, quality, toxicity, urls
from loomgraph.llm.text import alnum_normal

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, words string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, "a", "b") for i, t, lang, s in rows], SCHEMA)


def plain(spark, pairs):
    return docs(spark, [(i, t, "en", "src1") for i, t in pairs])


# ---- decontamination


def brute_hits(pairs, items):
    patterns = {}
    for i, t in items:
        w = WORD.findall(low(t))
        if i is not None and w:
            for k in range(max(1, len(w) - 12)):
                patterns.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    out = []
    for i, t in pairs:
        w, hit, found = WORD.findall(low(t)), set(), set()
        for n in {len(p) for p in patterns}:
            for k in range(len(w) - n + 1):
                if own := patterns.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination_against_brute_force(spark, block_bytes):
    random.seed(3)
    words = [f"a{i}" for i in range(30)] + ["é", "ß1", "X", "the"]
    make = lambda n: " ".join(random.choice(words) for _ in range(n))
    items = [(i, make(random.randint(13, 40))) for i in range(12)] + [(50, "the"), (51, "X é"), (52, None), (53, "!!"), (None, make(20)), (0, make(15))]
    pairs = []
    for i in range(60):
        text = make(random.randint(0, 200))
        if i % 3 == 0:
            item = random.choice(items)[1] or ""
            text += random.choice([" ", "\n", ", "]) + item.upper().replace(" ", "-") + " " + make(4)
        pairs.append((i, text))
    pairs += [(100, None), (101, ""), (102, "..."), (None, items[0][1]), (3, pairs[3][1]), (103, items[1][1] * 300)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = contamination.judged(contamination.scan(plain(spark, pairs), benchmark, block_bytes=block_bytes))
    expected = brute_hits(pairs, items)
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected
    kept = contamination.clean(plain(spark, pairs), benchmark)
    assert kept.columns == plain(spark, pairs).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(e[0]) for e in expected if not e[-1])


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    found = contamination.judged(contamination.scan(plain(spark, [(1, "a b")]), none)).first()
    assert (found.n_words, found.n_hit, found.contaminated) == (2, 0, False)
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert contamination.scan(plain(spark, []), some).count() == 0
    assert contamination.clean(plain(spark, [(1, "a b")]), none).count() == 1


def test_shift_tables_miss_nothing():
    random.seed(5)
    for _ in range(60):
        patterns = sorted({bytes(random.choice(b"ab c") for _ in range(random.randint(3, 20))) for _ in range(random.randint(1, 30))})
        text = bytes(random.choice(b"ab c") for _ in range(5000))
        group = contamination.Group(patterns, list(range(len(patterns))))
        found = sorted(zip(*group.find(text), strict=True))
        assert found == sorted((i, k) for k, p in enumerate(patterns) for i in range(len(text) - len(p) + 1) if text.startswith(p, i))


def test_normal_form():
    for t in ["A-b  C\n9_é", "", " ", "\x7fÄB\x80"]:
        assert alnum_normal(t.encode()).decode().split(" ") == (WORD.findall(low(t)) or [""])


# ---- licenses


def test_license_scan(spark):
    lines = ["Licensed under CC BY-NC 4.0.", "x CC-BY y cc by", "All Rights Reserved", "The apache license under version 2.0 licensed", "GNU General  Public\nLicense", "licensed under apache"]
    pairs = [*enumerate(lines), (10, None), (11, ""), (12, "word " * 20000), (None, "CC BY"), (13, "all rights all rights reserved all rights reserved")]
    found = {r.doc_id: r for r in licenses.scan(plain(spark, pairs)).collect()}
    assert (found[0].base_labels, found[0].labels, found[0].n_base, found[0].first_word, found[0].score) == ("cc-by", "cc-by,cc-by-nc-4.0", 1, 2, 1.0)
    assert (found[1].n_base, found[1].first_word, found[1].last_word) == (2, 1, 4)
    assert found[2].labels == "reserved" and found[4].labels == "gpl" and found[4].first_word == 1
    assert found[3].labels == "apache-2.0" and found[3].base_labels == "" and found[3].score == 1.0
    assert found[5].labels == "" and found[5].score == 0.0
    assert (found[10].n_words, found[11].n_words, found[12].n_words) == (0, 0, 20000) and found[10].first_word is None
    assert (found[13].n_base, found[13].first_word, found[13].last_word) == (2, 2, 5) and found[None].n_base == 1
    assert licenses.scan(plain(spark, [])).count() == 0


# Beginnings of license texts as they are shipped.
SHIPPED = {
    "mit": """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction""",
    "bsd": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:""",
    "bsd-3-clause": """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "apache-2.0": """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/""",
    "gpl": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.""",
    "gpl-3.0": """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
}


def test_shipped_licenses(spark):
    names, pairs = {}, []
    for k, (label, text) in enumerate(SHIPPED.items()):
        for n, form in enumerate((text, "x y\n" * 50 + text + "\nz" * 50, text.replace("\n", "\n# "), text.replace("\n", " ") + "\r\n")):
            names[10 * k + n] = label
            pairs.append((10 * k + n, form))
    pairs += [(900, "Released under the MIT License.\nx"), (901, "permission is free\nof charge, hereby"), (902, "Apache\n" + "v\n" * 9 + "License Version 2.0, January 2004")]
    pairs += [(900, "Released under the MIT License.\nx")]  # a repeated row
    rows = licenses.scan(plain(spark, pairs)).collect()
    found = {r.doc_id: r.labels.split(",") for r in rows}
    assert all(label in found[i] for i, label in names.items()), {i: found[i] for i, label in names.items() if label not in found[i]}
    assert found[900] == ["mit"] and found[901] == [""] and "apache-2.0" not in found[902]
    assert len(rows) == len(pairs)


def test_license_join_against_all_pairs(spark):
    random.seed(8)
    vocabulary = [f"t{i}" for i in range(14)]
    templates = {f"L{k}": " ".join(random.sample(vocabulary, random.randint(1, 9))) for k in range(6)}
    pairs = [(i, "\n".join(" ".join(random.sample(vocabulary, random.randint(0, 12))) for _ in range(3))) for i in range(80)]
    for threshold in (0.5, 0.7, 1.0):
        found = licenses.scan(plain(spark, pairs), {}, templates, threshold)
        got = {(r.doc_id, m.label, m.block, m.overlap) for r in found.collect() for m in r.matches}
        expected = set()
        for i, t in pairs:
            for b, line in enumerate(t.split("\n")):
                for label, template in templates.items():
                    n = len(set(line.split()) & set(template.split()))
                    if n >= licenses.needed(len(template.split()), threshold):
                        expected.add((i, label, b, n))
        assert got == expected


# ---- URLs


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, host string")


def test_url_rules(spark):
    cases = {
        "https://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/de/": ("example.net", "/de/", "net/", "block"),
        "http://badexample.net/en/": ("badexample.net", "/en/", "net/", "block"),
        "ftp://www.example.com/de/y": ("www.example.com", "/de/y", "example.com/de/", "block"),
        "http://x.org/fr/": ("x.org", "/fr/", "org/fr/", "allow"),
        "http://x.org/FR/": ("x.org", "/FR/", None, "allow"),
        "http://other.com?x://y": ("other.com", "", None, "allow"),
        "other.com/x": ("", "", None, "allow"),
        "://h/p": ("h", "/p", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u, None) for i, u in enumerate(cases)]
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages(spark, rows)).collect()}
    assert found == dict(enumerate(cases.values()))
    assert urls.judge(pages(spark, [])).count() == 0


def test_distrust_goes_against_links(spark):
    link = '<a href="http://spam.net/x">s</a>'
    rows = [
        (1, "http://spam.net/", None),
        (2, "http://spam.net", None),  # no path: no rule fits, but its host is a blocked seed
        (3, "http://links.com/a", link),
        (4, "http://far.com/a", '<A HREF=http://links.com/a>x</A>'),
        (5, "http://good.org/fr/", link + '<a href="http://liked.com/">'),
        (6, "http://good.org/xx", None),
        (7, "http://liked.com/", None),
        (8, "http://alone.com/", None),
        (8, "http://alone.com/", None),
    ]
    found = [(r.page_id, r.verdict) for r in urls.judge(pages(spark, rows)).collect()]
    assert sorted(found) == [(1, "block"), (2, "block"), (3, "block"), (4, "block"), (5, "allow"), (6, "allow"), (7, "allow"), (8, "allow"), (8, "allow")]


def test_distrust_of_hosts_without_pages(spark):
    rows = [
        (1, "http://spammy.com/a", '<a href="http://uncrawled.net/x">'),
        (2, "http://far.com/a", '<a href="http://between.com/y"> <a href="http://spammy.com/a">'),
        (3, "http://mixed.com/a", '<a href="http://good.example.net/en/x"> <a href="http://good.example.net/de/x">'),
        (4, "http://alone.com/", None),
    ]
    found = {r.page_id: r.verdict for r in urls.judge(pages(spark, rows)).collect()}
    assert found == {1: "block", 2: "block", 3: "allow", 4: "allow"}


# ---- mixing


def water(amount, caps, weights):
    """Shares by bisection of the water level."""
    if amount >= sum(caps):
        return list(caps)
    lo, hi = 0.0, amount / min(weights)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(c, mid * w) for c, w in zip(caps, weights, strict=True)) < amount else (lo, mid)
    return [min(c, hi * w) for c, w in zip(caps, weights, strict=True)]


def brute_mix(rows, mix):
    from collections import defaultdict

    leaf, tokens = defaultdict(list), {}
    for i, t, lang, source in rows:
        n = int(m[0]) % 4 if (m := re.search(r"\d{1,9}$", source or "")) else 0
        key = (("web", "books", "code", "reference")[n], lang or "none", source or "none")
        leaf[key].append(i)
        tokens[i] = len((t or "").split())
    supply = {k: sum(tokens[i] for i in v) for k, v in leaf.items()}
    cap = lambda p: sum(s * mix.max_epochs for k, s in supply.items() if k[: len(p)] == p)
    amounts = {(): float(int(sum(supply.values()) * mix.budget_share))}
    for depth, level in enumerate(mixing.LEVELS):
        for p in [p for p in amounts if len(p) == depth]:
            children = sorted({k[: depth + 1] for k in supply if k[:depth] == p})
            weights = [mix.weights.get(level, {}).get(c[-1], mix.other) for c in children]
            amounts |= dict(zip(children, water(amounts[p], [cap(c) for c in children], weights), strict=True))
    out = {}
    for k, ids in leaf.items():
        quota = int(amounts[k] + 1e-6)
        whole = quota // supply[k] if supply[k] else 0
        rest, run = quota - whole * supply[k], 0
        for i in sorted(ids, key=lambda i: hashlib.md5(f"{mix.seed}:{whole}:{i}".encode()).hexdigest()):
            run += tokens[i]
            if whole + (run <= rest):
                out[i] = whole + (run <= rest)
    return out


@pytest.mark.parametrize(("share", "epochs", "digits"), [(0.6, 2, 3), (0.1, 3, 1), (1.7, 2, 1), (0.0, 1, 3)])
def test_mix_against_brute_force(spark, share, epochs, digits, monkeypatch):
    random.seed(11)
    monkeypatch.setattr(mixing, "BUCKET_DIGITS", digits)
    langs, sources = ["en", "en", "en", "de", "xx", None], [f"src{i}" for i in range(7)] + ["src0"] * 9 + [None, "web"]
    rows = [(i, " ".join("w" for _ in range(random.randint(0, 30))), random.choice(langs), random.choice(sources)) for i in range(400)]
    rows += [(1000, None, "en", "src1"), (1001, "w " * 5000, "de", "src5")]
    mix = mixing.Mix(budget_share=share, max_epochs=epochs)
    expected = brute_mix(rows, mix)
    got = {r.doc_id: r.epochs for r in mixing.select(docs(spark, rows), mix).collect()}
    assert got == expected
    full = mixing.mixed(docs(spark, rows), mix)
    assert full.columns == [*docs(spark, rows).columns, "mix_epoch"]
    taken = {}
    for r in full.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert taken == expected


def test_mix_of_nothing_and_repeated_rows(spark):
    assert mixing.select(docs(spark, [])).count() == 0
    assert mixing.mixed(docs(spark, [])).count() == 0
    rows = [(1, "a b", "en", "src0"), (1, "a b", "en", "src0"), (None, "a b", "en", "src0")]
    assert mixing.select(docs(spark, rows), mixing.Mix(budget_share=1.0)).count() == 3


# ---- trained scorers


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ber", "ung", "ein"], "cc": ["tion", "é", "eau", "le"]}


def speech(lang, n, rng):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def test_language(spark):
    rng = random.Random(1)
    rows = [(i, speech(lang, rng.randint(5, 80), rng), lang, "s") for i, lang in enumerate(rng.choices(list(SYLLABLES), k=300))]
    rows += [(1000, None, "aa", "s"), (1001, "12 ?!", "aa", "s"), (1002, "", None, "s"), (None, "kalo mitu", "bb", "s"), (1003, speech("bb", 20000, rng), None, "s"), (0, rows[0][1], "aa", "s")]
    df = docs(spark, rows)
    model = language.fit(df, language.remainder(F.col("doc_id"), 4) != 2)
    found = {r.doc_id: r for r in language.predict(df, model).collect()}
    held = [r for r in rows if r[0] is not None and r[0] < 300 and fold(r[0], 4) == 2]
    assert sum(found[r[0]].lang_pred == r[2] for r in held) >= 0.98 * len(held) and len(held) > 40
    assert [found[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and found[1003].lang_pred == "bb" and found[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in found.values())
    kept = language.accepted(df, model)
    assert kept.columns == df.columns and not {1000, 1001, 1002} & {r.doc_id for r in kept.collect()}
    assert kept.count() >= 0.97 * len(rows)


def test_language_without_labels(spark):
    df = docs(spark, [(1, "abc", None, "s"), (2, None, None, "s")])
    model = language.fit(df, F.lit(True))
    assert model is None and {r.lang_pred for r in language.predict(df, model).collect()} == {"und"}
    assert language.predict(df.limit(0), model).count() == 0


@pytest.fixture(scope="module")
def marked(spark):
    """Texts of which some hold one of a few words, and some are stuttered."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        words = speech(rng.choice(list(SYLLABLES)), rng.randint(20, 200), rng).split()
        toxic, poor = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["vykzor", "qaxxle", "zuvvik"]))
        if poor:
            words = [w + rng.choice(["%%%", "###"]) for w in words]
        rows.append((i, " ".join(words), "aa", "s"))
        labels.append((i, int(not poor), int(toxic)))
    extra = [(5000, None, None, None), (5001, "", None, None), (5002, "kalo " * 30000, None, None), (None, "kalo", None, None)]
    labels += [(None, 1, 1), (5000, None, None), (0, labels[0][1], labels[0][2])]
    return docs(spark, rows + extra), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize(("module", "column", "threshold"), [(toxicity, 2, 0.5), (quality, 1, 0.3)])
def test_scorers_on_held_out_labels(spark, marked, module, column, threshold):
    df, labels, rows = marked
    found = {r.doc_id: r.score for r in module.score(df, module.fit(df, labels)).collect()}
    assert len(found) == 904 and all(0 <= s <= 1 for s in found.values())
    held = [r for r in rows[:900] if fold(r[0], 5) == 0]
    right = sum((found[r[0]] >= threshold) == bool(r[column]) for r in held)
    assert right >= 0.97 * len(held)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scorers_never_read_held_out_labels(spark, marked, module):
    df, labels, _ = marked
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    flipped = labels.withColumns({c: F.when(rest == 0, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    a, b = (sorted((str(r.doc_id), r.score) for r in module.score(df, module.fit(df, y)).collect()) for y in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scorers_without_labels(spark, marked, module):
    df, labels, _ = marked
    assert {r.score for r in module.score(df, module.fit(df, labels.limit(0))).collect()} == {0.0}
    assert module.score(df.limit(0), module.fit(df.limit(0), labels)).count() == 0


def test_toxicity_of_words_of_common_syllables(spark):
    rng = random.Random(6)
    syllables = ["ка", "ло", "ми", "ту", "ре", "со", "ви", "ны"]
    rows, labels = [], []
    for i in range(900):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(20, 120))]
        words = [w for w in words if not w.startswith("витуре")]
        toxic = rng.random() < 0.3
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), "витуре" + rng.choice(syllables))
        rows.append((i, " ".join(words), "ru", "s"))
        labels.append((i, 1, int(toxic)))
    df, given = docs(spark, [*rows, (None, None, None, None), (0, rows[0][1], "ru", "s")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = sorted((str(r.doc_id), r.score) for r in toxicity.score(df, toxicity.fit(df, given)).collect())
    of = dict(found)
    held = [i for i in range(900) if fold(i, 5) == 0]
    assert sum((of[str(i)] >= 0.5) == bool(labels[i][2]) for i in held) >= 0.95 * len(held)
    joined = sorted((str(r.doc_id), r.score) for r in toxicity.score(df, toxicity.fit(df, given, broadcast=0)).collect())
    assert len(joined) == 902 and all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-3 for a, b in zip(found, joined, strict=True))


def test_word_paths_keep_letters_apart():
    text, paths = toxicity.word_paths(["Ré réeux «RÉEUX» a1".encode(), b"", "坏人 ka\u2014ka".encode()])
    assert text.tolist().count(0) == 3 and 1 not in text and text.tolist().count(2) == 3
    assert len({p for row in paths.tolist() for p in row if p}) == (paths != 0).sum() == 8


def test_backed_off_probabilities_sum_to_one():
    gram = np.unique(np.random.default_rng(0).integers(0, toxicity.GRAMS, 5000))
    prob = np.full(toxicity.SYMBOLS, 1 / toxicity.SYMBOLS)
    for order in range(1, toxicity.ORDER):
        prob = toxicity.backed_off(toxicity.continuations(gram, order), prob)
        assert np.allclose(prob.reshape(-1, toxicity.SYMBOLS).sum(axis=1), 1)


def test_network_gradients():
    rng = np.random.default_rng(1)
    net = quality.Network(np.zeros(5), np.ones(5))
    x, number, y = rng.normal(size=(7, 5)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -(y * np.log(f := net.forward(x, number)["score"]) + (1 - y) * np.log(1 - f)).sum()
    f = net.forward(x, number)
    for name, g in net.gradients(f, f["score"] - y).items():
        p = net.p[name]
        at = tuple(rng.integers(0, s) for s in p.shape)
        old = p[at]
        p[at] = old + 1e-6
        up = loss()
        p[at] = old - 1e-6
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-6 - g[at]) < 1e-4
