"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree.

A token budget starts at the root. Each node deals its share to its children in proportion to their weights; a child
never gets more than its subtree can supply (its tokens times ``max_epochs``), and what it can't take goes to its
siblings, again by weight, until all is dealt. A node's own supply bounds what it is dealt, so a shortage leaves a
node only when no sibling below it can take it: siblings come before ancestors.

The share of siblings is found in closed form (water level): with children by supply/weight, the first ones are full
and the rest get ``level * weight``. That is a window over the children of one node, rows of the leaf table, never
documents.

A leaf takes whole epochs first, then a token-prefix of the next epoch's order, the order of
``md5(seed:epoch:doc_id)``: documents whose running token count stays within the rest. The running count is found in
two steps, sums per (leaf, first three hex digits) and a window within the one boundary bucket of each leaf, so a hot
leaf is never sorted in one task.

Cases: null texts have 0 tokens and are taken with any prefix that reaches them; null languages and sources are leaves
of their own, named ``none``; null doc_ids sort as the empty string; repeated rows are taken each by itself; further
columns are ignored by :func:`select` and carried by :func:`mixed`; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.storage import Stage

LEVELS = ("domain", "lang", "source")
#: Leaf tables of at most so many rows, by count, are broadcast; larger ones are joined by shuffle.
BROADCAST_LEAVES = 20_000
BUCKET_DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """Target weights by level (names without one get ``other``), the budget as a share of all tokens, the seed."""

    weights: Mapping[str, Mapping[str, float]] = field(
        default_factory=lambda: {
            "domain": {"web": 0.4, "books": 0.3, "code": 0.2, "reference": 0.1},
            "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
            "source": {},
        }
    )
    other: float = 0.05
    budget_share: float = 0.6
    max_epochs: int = 2
    seed: int = 17


def domain_of(source: Column) -> Column:
    """Domain of a source: its trailing number modulo four; sources without a number are ``web``."""
    number = F.coalesce(F.regexp_extract(source, r"(\d{1,9})$", 1).try_cast("long"), F.lit(0))
    return F.element_at(F.array(*[F.lit(d) for d in ("web", "books", "code", "reference")]), (number % 4 + 1).cast("int"))


def token_count(text: Column) -> Column:
    return F.when(
        F.length(text) > 0, F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long")
    ).otherwise(F.lit(0).cast("long"))


def weight_of(level: str, mix: Mix) -> Column:
    weight = F.lit(float(mix.other))
    for name, w in mix.weights.get(level, {}).items():
        weight = F.when(F.col(level) == name, F.lit(float(w))).otherwise(weight)
    return weight


def deal(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``share`` to siblings (same ``parent`` columns) with ``cap``, ``weight`` and the parent's ``amount``.

    ``share = min(cap, level * weight)`` with the level at which the shares of all siblings add up to the amount, or
    every cap, if the amount isn't less than their sum.
    """
    by = [F.col(c) for c in parent] or [F.lit(0)]
    order = W.partitionBy(*by).orderBy(F.col("cap") / F.col("weight"), F.col("name"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    # the level if exactly the siblings before this one were full: it rises until one does not fill up, then falls
    level = (F.col("amount") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    tried = nodes.withColumn("try", level)
    fits = F.when(F.col("try") * F.col("weight") < F.col("cap"), F.col("try"))
    return (
        tried.withColumn("level", F.max(fits).over(W.partitionBy(*by)))
        .withColumn(
            "share",
            F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))),
        )
        .drop("try", "level")
    )


def quotas(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Adds ``quota`` (tokens, whole) to the leaf table (domain, lang, source, supply)."""
    capped = leaves.withColumn("cap", F.col("supply").cast("double") * mix.max_epochs)
    total = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).cast("double")).first()[0]
    budget, dealt = F.lit(math.floor(total * mix.budget_share)).cast("double"), None
    for depth, level in enumerate(LEVELS):
        parent, own = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        nodes = capped.groupBy(*own).agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of(level, mix))
        nodes = nodes.withColumn("name", F.col(level))
        nodes = nodes.withColumn("amount", budget) if dealt is None else nodes.join(dealt, parent)
        dealt = deal(nodes, parent).select(*own, F.col("share").alias("amount"))
    return leaves.join(dealt, list(LEVELS)).withColumn("quota", F.floor(F.col("amount") + 1e-6).cast("long")).drop("amount")


def key_of(mix: Mix, epoch: Column) -> Column:
    return F.md5(
        F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    )


def select(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents taken: one row for each taken row of ``docs`` (doc_id, text, lang, source), with ``epochs`` >= 1.

    Columns: doc_id, domain, lang, source (``none`` for null), n_tokens, quota (its leaf's), epochs.
    """
    light = Stage(with_leaves(docs), "mix-tokens").df
    return take(light, plan(light, mix), mix).select("doc_id", *LEVELS, "n_tokens", "quota", "epochs")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``docs`` (all columns, and ``mix_epoch`` from 0, in place of a column of that name), each as many
    times as it is taken.

    Texts aren't shuffled: each row is compared with its leaf's bound where it is read.
    """
    rows = docs.select("doc_id", "text", "lang", "source", F.struct(*[F.col(f"`{c}`") for c in docs.schema.names]).alias("row"))
    leaved = plan(Stage(with_leaves(docs), "mix-tokens").df, mix)
    taken = take(with_leaves(rows, "row"), leaved, mix)
    epoch = F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("mix_epoch")
    kept = [F.col(f"row.`{c}`") for c in docs.schema.names if c.lower() != "mix_epoch"]
    return taken.select(*kept, epoch)


def with_leaves(docs: DataFrame, *carried: str) -> DataFrame:
    return docs.select(
        "doc_id",
        F.coalesce(domain_of(F.col("source")), F.lit("web")).alias("domain"),
        F.coalesce("lang", F.lit("none")).alias("lang"),
        F.coalesce("source", F.lit("none")).alias("source"),
        token_count(F.col("text")).alias("n_tokens"),
        *carried,
    )


@dataclass(frozen=True)
class Leaves:
    """What a document needs to know of its leaf: quota, whole epochs, rest, edge_bucket and tokens before it."""

    table: DataFrame
    few: bool

    def join(self, docs: DataFrame) -> DataFrame:
        return docs.join(F.broadcast(self.table) if self.few else self.table, list(LEVELS))


def keyed(docs: DataFrame, mix: Mix) -> DataFrame:
    with_key = docs.withColumn("key", key_of(mix, F.col("whole")))
    return with_key.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))


def plan(light: DataFrame, mix: Mix) -> Leaves:
    """Quotas, and where each leaf's token-prefix ends; ``light`` has doc_id, the leaf's names and n_tokens."""
    leaf = list(LEVELS)
    supplies = Stage(light.groupBy(*leaf).agg(F.sum("n_tokens").alias("supply")), "mix-supplies").df
    budget = Stage(quotas(supplies, mix), "mix-quotas").df
    whole = F.when(F.col("supply") > 0, F.floor(F.col("quota") / F.col("supply"))).otherwise(0).cast("int")
    dealt = budget.withColumn("whole", whole).withColumn("rest", F.col("quota") - F.col("whole") * F.col("supply"))
    few = dealt.count() <= BROADCAST_LEAVES
    sums = keyed(Leaves(dealt, few).join(light), mix).groupBy(*leaf, "rest", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    # at most 16**BUCKET_DIGITS rows a leaf
    upto = F.sum("tokens").over(W.partitionBy(*leaf).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
    # the first bucket that doesn't fit whole; what fits before it
    edge = (
        sums.withColumn("upto", upto)
        .filter(F.col("upto") > F.col("rest"))
        .groupBy(*leaf)
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("before"))).alias("edge"))
        .select(*leaf, F.col("edge.bucket").alias("edge_bucket"), F.col("edge.before").alias("before"))
    )
    return Leaves(Stage(dealt.join(edge, leaf, "left"), "mix-leaves").df, few)


def take(docs: DataFrame, leaves: Leaves, mix: Mix) -> DataFrame:
    """``docs`` (as ``plan`` needs it, and further columns) with quota and ``epochs`` >= 1; the rest goes."""
    placed = keyed(leaves.join(docs), mix)
    out = [*docs.columns, "quota", "epochs"]
    # documents in buckets below the edge are in the prefix, those above only in whole epochs
    below = F.col("edge_bucket").isNull() | (F.col("bucket") < F.col("edge_bucket"))
    clear = placed.filter("edge_bucket is null or bucket <> edge_bucket")
    clear = clear.withColumn("epochs", F.col("whole") + F.when(below, 1).otherwise(0))
    running = F.sum("n_tokens").over(
        W.partitionBy(*LEVELS).orderBy("key", "n_tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    at_edge = placed.filter("bucket = edge_bucket").withColumn("running", F.col("before") + running)
    at_edge = at_edge.withColumn("epochs", F.col("whole") + F.when(F.col("running") <= F.col("rest"), 1).otherwise(0))
    return clear.select(*out).unionByName(at_edge.select(*out)).filter("epochs > 0")
