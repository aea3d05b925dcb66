"""License scan: phrase places and an exact set-similarity join with license templates. DataFrame functions only.

The join finds every block B of a text and every template T with ``|B & T| >= threshold * |T|``. Blocks are the groups
of consecutive lines, from each line on, that a template takes up where texts are wrapped: one line for templates of up
to ten words, more for longer ones. The tokens of each line are found once; a group's are those of its lines.

* tokens are ordered by their frequency in the whole corpus, rarest first;
* prefix filter: if the overlap must reach ``o = ceil(threshold * |T|)``, then one of the first ``|T| - o + 1``
  tokens of T is in B, so only texts that hold such a token are cut into blocks, and only their prefix tokens meet;
* length filter: a block with fewer than ``o`` distinct tokens can't qualify;
* positional filter: if the first shared token stands at place p of T, the overlap is at most ``|T| - p``;
* what is left is counted exactly.

The filters never lose a qualifying block. Templates are a parameter, a short list held in the plan; nothing else is
broadcast, and the only shuffle is the count of template tokens, which is combined before it is sent.

Cases: a null or empty text has no words, no labels and score 0; a null doc_id stays null; repeated rows give
repeated results; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.text import alnum_words, ascii_lower

# The phrases and labels that a scan always looks for.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

@dataclass(frozen=True)
class Template:
    """A notice and the label that it stands for; ``lines``, if given, is the number of lines that it may take up."""

    label: str
    text: str
    lines: int = 0

    @property
    def block(self) -> int:
        n = len(tokens(self.text))
        return self.lines or (1 if n <= LINE_WORDS else 1 + math.ceil(n / LINE_WORDS))


#: Words of a wrapped line, at least.
LINE_WORDS = 10

# Titles, headers and opening sentences of well-known licenses, and the labels that the join adds.
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2.0", "Apache License Version 2.0, January 2004", 3),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    Template("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    Template("creative-commons", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("gpl", "free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version"),
    Template("gpl-3.0", "GNU General Public License Version 3, 29 June 2007", 3),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("lgpl", "GNU Lesser General Public License", 2),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    Template("mit", "Released under the MIT License"),
    Template("mpl-2.0", "Mozilla Public License Version 2.0", 2),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.9


def tokens(text: str) -> list[str]:
    """The words of a phrase or template, by the rule that also parts the documents."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def needed(size: int, threshold: float) -> int:
    """Least overlap with a template of so many tokens."""
    return max(1, math.ceil(threshold * size - 1e-9))


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def places(words: Column, phrase: Sequence[str]) -> Column:
    """Array of the word numbers at which the phrase starts."""
    last = F.size(words) - len(phrase)
    at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    def stands(i: Column) -> Column:
        found = F.lit(True)
        for k, word in enumerate(phrase):
            found = found & (F.get(words, i + k) == word)
        return found

    return F.filter(at, stands)


def token_order(texts: DataFrame, vocabulary: Sequence[str]) -> list[str]:
    """The vocabulary by the number of documents that hold each token, rarest first; ``texts`` has ``words``."""
    counts = (
        texts.select(F.explode(F.array_intersect("words", strings(vocabulary))).alias("token"))
        .groupBy("token")
        .count()
    )
    found = {r["token"]: r["count"] for r in counts.collect()}  # at most one row for each template token
    return sorted(vocabulary, key=lambda t: (found.get(t, 0), t))


def scan(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, str] | Sequence[Template] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text).

    Columns: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches. ``matches`` holds
    (label, block, overlap, containment) for each qualifying block, ``block`` being its first line; ``score`` is the largest containment, 1 where a
    base phrase stands, else 0.
    """
    base = {tuple(tokens(p)): label for p, label in phrases.items()}
    listed = [Template(*t) for t in templates.items()] if isinstance(templates, Mapping) else templates
    sets = {t: sorted(set(tokens(t.text))) for t in listed}
    sets = {t: own for t, own in sets.items() if own}
    vocabulary = sorted({token for own in sets.values() for token in own})
    texts = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("lowered"))
    texts = texts.withColumn("words", alnum_words(F.col("lowered")))
    rank = {token: i for i, token in enumerate(token_order(texts, vocabulary))}

    ordered = {t: sorted(own, key=rank.__getitem__) for t, own in sets.items()}
    prefix = {t: own[: len(own) - needed(len(own), threshold) + 1] for t, own in ordered.items()}
    alphabet = sorted({token for own in prefix.values() for token in own})

    none = F.array().cast("array<int>")
    for k, phrase in enumerate(base):
        # the array is searched only where the first and last word are there at all
        there = F.array_contains("words", phrase[0]) & F.array_contains("words", phrase[-1])
        texts = texts.withColumn(f"at{k}", F.when(there, places(F.col("words"), phrase)).otherwise(none))
    at = F.concat(*[F.col(f"at{k}") for k in range(len(base))]) if base else none
    base_labels = F.array_compact(
        F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, label in enumerate(base.values())])
    )

    block = "array<struct<label:string,block:int,overlap:int,containment:double>>"
    nothing = F.array().cast(block)

    def judged(b: Column, number: Column, t: Template) -> Column:
        full, least = ordered[t], needed(len(ordered[t]), threshold)
        first = F.lit(None).cast("int")
        for p, token in reversed(list(enumerate(prefix[t]))):
            first = F.when(F.array_contains(b, token), F.lit(p)).otherwise(first)
        overlap = F.size(F.array_intersect(b, strings(full)))
        passes = (F.size(b) >= least) & first.isNotNull() & (len(full) - first >= least)
        return F.when(
            passes & (overlap >= least),
            F.struct(
                F.lit(t.label).alias("label"),
                number.alias("block"),
                overlap.alias("overlap"),
                (overlap.cast("double") / len(full)).alias("containment"),
            ),
        )

    def found(t: Template) -> Column:
        """The blocks that meet the template, sought only where a text holds one of its prefix tokens."""
        if t.block == 1:
            own = F.transform("lines", lambda line, i: judged(line, i, t))
        else:
            # an array of one, so that the block's token set is made once
            group = lambda i: F.array(F.array_distinct(F.flatten(F.slice("lines", i + 1, F.lit(t.block)))))
            own = F.flatten(F.transform("lines", lambda line, i: F.transform(group(i), lambda b: judged(b, i, t))))
        return F.when(F.arrays_overlap("words", strings(prefix[t])), F.array_compact(own)).otherwise(nothing)

    if ordered:
        lines = F.transform(F.split("lowered", "\n"), lambda line: F.array_distinct(alnum_words(line)))
        texts = texts.withColumn("lines", F.when(F.arrays_overlap("words", strings(alphabet)), lines))
        matches = F.when(F.col("lines").isNotNull(), F.concat(*[found(t) for t in ordered])).otherwise(nothing)
    else:
        matches = nothing
    own = F.transform("matches", lambda m: m["label"])
    return (
        texts.withColumn("at", at)
        .withColumn("base", F.array_sort(F.array_distinct(base_labels)))
        .withColumn("matches", matches)
        .select(
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.size("at").cast("long").alias("n_base"),
            F.array_min("at").cast("long").alias("first_word"),
            F.array_max("at").cast("long").alias("last_word"),
            F.array_join("base", ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union("base", own)), ",").alias("labels"),
            F.greatest(
                F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.lit(0.0)),
                F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)),
            ).alias("score"),
            "matches",
        )
    )
