"""URL filter: host and path rules first, then link-graph propagation over hosts. DataFrame functions only.

A page that a rule fits gets that rule's verdict (longest rule wins). Every other page gets its host's verdict:

* hosts are those of pages and of what pages link to, crawled or not; a crawled host is judged by the urls of its pages,
  another one by the linked urls;
* hosts with urls that allow rules fit are trusted seeds; hosts with urls that only block rules fit are blocked seeds;
* host edges are the absolute links in the pages' HTML, and, both ways, a host and the same host without its first
  label, if both are hosts of these;
* trust is personalised PageRank from the trusted seeds along the edges, distrust the same from the blocked seeds
  against them: who links to a blocked host is distrusted;
* a host is blocked if its distrust exceeds ``margin`` times its trust and ``floor`` times one seed's share.

Each iteration is a join of edges with ranks and a sum per target, combined before the shuffle; ranks are written to
the shared folder after each iteration, so neither lineage nor plan grows. Nothing is broadcast by request.

Cases: a null url, or one without ``://``, has an empty host and path and is allowed; null html has no links; a null
page_id stays null; repeated rows give repeated results; further columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.text import ascii_lower
from loomgraph.storage import Stage

# The rules of the list, as (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
ITERATIONS, DAMPING, MARGIN, FLOOR = 8, 0.85, 1.0, 0.01


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; of equally long ones the first listed."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def links(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst, path) of the absolute links in the HTML of ``pages`` (host, html)."""
    return (
        pages.filter(F.col("html").contains("://"))
        .select("host", F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?([^"'\s>]+://[^"'\s>]+)"""), 1)).alias("url"))
        .select(F.col("host").alias("src"), host_of(F.col("url")).alias("dst"), path_of(F.col("url")).alias("path"))
        .filter("dst <> ''")
        .distinct()
    )


def host_edges(linked: DataFrame, hosts: DataFrame) -> DataFrame:
    """Distinct (src, dst) of links and, both ways, of hosts with their parent host."""
    up = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("dst"))
    up = up.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").select("src", "dst")
    both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return linked.select("src", "dst").unionByName(both).filter("src <> '' and dst <> '' and src <> dst").distinct()


def propagate(hosts: DataFrame, edges: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) of all hosts; ``hosts`` has trusted and blocked shares that sum to 1 each.

    Without edges, and at hosts without any, rank stays at the seed's own share ``(1 - damping) * share``.
    """
    degree_out = edges.groupBy("src").agg(F.count("*").alias("n_out"))
    degree_in = edges.groupBy("dst").agg(F.count("*").alias("n_in"))
    wired = Stage(edges.join(degree_out, "src").join(degree_in, "dst"), "host-edges")
    ranks = hosts.select("host", F.col("trusted").alias("trust"), F.col("blocked").alias("distrust"))
    held: Stage | None = None
    for _ in range(iterations if not wired.df.isEmpty() else 1):
        forward = wired.df.join(ranks, F.col("src") == F.col("host")).select(
            F.col("dst").alias("to"), (F.col("trust") / F.col("n_out")).alias("t"), F.lit(0.0).alias("d")
        )
        backward = wired.df.join(ranks, F.col("dst") == F.col("host")).select(
            F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("distrust") / F.col("n_in")).alias("d")
        )
        got = forward.unionByName(backward).groupBy("to").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        ranks = hosts.join(got, F.col("host") == F.col("to"), "left").select(
            "host",
            ((1 - damping) * F.col("trusted") + damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
            ((1 - damping) * F.col("blocked") + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"),
        )
        now = Stage(ranks, "host-ranks")
        ranks = now.df
        if held:
            held.drop()
        held = now
    wired.drop()
    return ranks


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    iterations: int = ITERATIONS,
    damping: float = DAMPING,
    margin: float = MARGIN,
    floor: float = FLOOR,
) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, host_verdict."""
    cut = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = cut.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    linked = Stage(links(cut), "links")
    targets = linked.df.select(F.col("dst").alias("host"), "path").distinct()
    targets = targets.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))

    def of(verdict: str, crawled: bool) -> Column:
        fits = F.coalesce(F.col("fit.verdict"), F.lit("")) == verdict
        return F.max((fits & (F.col("crawled") == crawled)).cast("int"))

    urls = ruled.filter("host <> ''").select("host", "fit", F.lit(True).alias("crawled"))
    urls = urls.unionByName(targets.select("host", "fit", F.lit(False).alias("crawled")))
    seeds = urls.groupBy("host").agg(
        F.when(F.max("crawled"), of("allow", True)).otherwise(of("allow", False)).alias("a"),
        F.when(F.max("crawled"), of("block", True)).otherwise(of("block", False)).alias("b"),
    )
    kinds = Stage(seeds.select("host", "a", (F.col("b") * (1 - F.col("a"))).alias("b")), "hosts")
    n = kinds.df.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    shares = kinds.df.select(
        "host",
        (F.col("a") / F.lit(float(max(1, n["a"] or 0)))).alias("trusted"),
        (F.col("b") / F.lit(float(max(1, n["b"] or 0)))).alias("blocked"),
    )
    ranks = propagate(shares, host_edges(linked.df, shares), iterations, damping)
    least = floor * (1 - damping) / max(1, n["b"] or 0)
    bad = ranks.filter((F.col("distrust") > margin * F.col("trust")) & (F.col("distrust") > least)).select(
        F.col("host").alias("bad_host")
    )
    # Only pages without a rule ask for their host's verdict; a hot host's rows are light and AQE splits them.
    light = ruled.select("page_id", "host", "path", "fit")
    by_rule = light.filter("fit is not null").select("page_id", "host", "path", "fit.rule", "fit.verdict")
    by_host = light.filter("fit is null").join(bad, F.col("host") == F.col("bad_host"), "left").select(
        "page_id",
        "host",
        "path",
        F.lit(None).cast("string").alias("rule"),
        F.when(F.col("bad_host").isNotNull(), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
    )
    return by_rule.unionByName(by_host)
