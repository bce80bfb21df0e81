"""URL filtering: path rules first, else trust and distrust propagated over the host link graph.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`,
`#` or the end. A rule fits its host and all subdomains if the path starts with the rule's path; the
longest (host and path together) wins.

For pages without a rule, personalised PageRank over host edges decides. Edges are the absolute
links in the pages' HTML, counted by pair of hosts, and one edge each way between a host and its
parent domain, if that is no top-level domain: `com` says nothing of a host, and would be one key for
half the web. Trust restarts at hosts in proportion to their pages that rules allow and follows
edges; distrust restarts at hosts in proportion to their pages that rules block and follows edges
backwards, for who links to bad hosts is suspect. Both are stepped until a round moves less than
`tolerance` of the mass; a warning tells if they still do after the last round. A host's suspicion is distrust / (trust + distrust); it is blocked if that
exceeds `threshold`. Hosts that neither reaches are allowed.

A null url, or one without `://`, has an empty host and path, fits no rule and is allowed; it has
no place in the graph. Null HTML has no links. Repeated rows each come back and each
count as pages. Rules with a null or empty host fit nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm import scratch

#: (host, path, verdict)
Rule = tuple[str, str, str]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted((r for r in rules if r[0]), key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """pages (host, html, n copies counted by row) to (src, dst, weight), without loops."""
    link = F.explode(F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"), 1))
    linked = pages.where("host <> '' AND html IS NOT NULL").select(F.col("host").alias("src"), link.alias("url"))
    linked = linked.select("src", host_of(F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), "url")).otherwise(F.col("url"))).alias("dst"))
    links = linked.where("dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    names = pages.where("host <> ''").select("host").distinct().unionByName(links.select(F.col("dst").alias("host"))).distinct()
    # Every host and all domains above it but the top level, each linked with the next.
    labels = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = names.select(chain.alias("chain")).where(F.size("chain") > 1)
    steps = steps.select(F.explode(F.arrays_zip(F.slice("chain", F.lit(1), F.size("chain") - 1).alias("a"), F.slice("chain", F.lit(2), F.size("chain") - 1).alias("b"))).alias("s")).select("s.a", "s.b").distinct()
    tree = steps.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(steps.select(F.col("b").alias("src"), F.col("a").alias("dst"))).withColumn("weight", F.lit(1.0))
    return links.unionByName(tree).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def page_rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-3, most_rounds: int = 200, every: int = 6) -> DataFrame:
    """(src, dst, weight) and seeds (host, seed) to (host, rank). The mass of hosts without edges out
    is lost to the others. Each round is saved, and every `every` rounds compared with the one before:
    at damping d, all later rounds move at most d / (1 - d) times what one round moves."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = scratch.save(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "rank-edges")
    row = lambda host, rank, before: (F.col(host).alias("host"), rank.alias("rank"), before.alias("before"))
    zero = F.lit(0.0)
    restart = scratch.save(seeds.select(*row("host", (1 - damping) * F.col("seed"), zero)), "rank-seeds")
    rank = scratch.save(seeds.select("host", F.col("seed").alias("rank")), "rank")
    for n in range(1, -(-most_rounds // every) * every + 1):
        # A host that has rank keeps some, so the rows of the round before add no host. A round is one
        # small plan of its own: what many rounds take in one grows with their number in the driver.
        last = rank
        moved = last.join(shares, F.col("host") == F.col("src")).select(*row("dst", damping * F.col("rank") * F.col("share"), zero))
        both = moved.unionByName(restart).unionByName(last.select(*row("host", zero, F.col("rank"))))
        rank = scratch.save(both.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("before").alias("before")), "rank")
        scratch.drop(last)
        if n % every == 0:
            step, mass = rank.agg(F.sum(F.abs(F.col("rank") - F.col("before"))), F.sum("rank")).first()
            if (step or 0) <= tolerance * (mass or 0):
                break
    else:
        warnings.warn(f"ranks still move after {most_rounds} rounds", stacklevel=2)
    return rank.select("host", "rank")


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", damping: float = 0.85, threshold: float = 0.5, tolerance: float = 1e-3) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust, a row for each row of pages."""
    pages = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    ruled = pages.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    counted = ruled.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("fit.verdict") == "allow").alias("good"), F.count_if(F.col("fit.verdict") == "block").alias("bad"))
    hosts = scratch.save(counted, "hosts")
    n, good, bad = (x or 0 for x in hosts.agg(F.sum("n"), F.sum("good"), F.sum("bad")).first())
    edges = scratch.save(host_edges(pages), "host-edges")
    # Both graphs go through one computation; a mark before the host keeps them apart.
    mark = lambda m, c: F.concat(F.lit(m), c)
    both = edges.select(mark("+", "src").alias("src"), mark("+", "dst").alias("dst"), "weight").unionByName(edges.select(mark("-", "dst").alias("src"), mark("-", "src").alias("dst"), "weight"))
    seeds = hosts.where("good > 0").select(mark("+", "host").alias("host"), (F.col("good") / max(good, 1)).alias("seed"))
    seeds = seeds.unionByName(hosts.where("bad > 0").select(mark("-", "host").alias("host"), (F.col("bad") / max(bad, 1)).alias("seed")))
    rank = page_rank(both, seeds, damping, tolerance)
    side = lambda m: F.coalesce(F.sum(F.when(F.col("host").startswith(m), F.col("rank"))), F.lit(0.0))
    ranked = rank.groupBy(F.substr("host", F.lit(2)).alias("name")).agg(side("+").alias("trust"), side("-").alias("distrust"))
    scored = hosts.join(ranked, F.col("host") == F.col("name"), "left").select("host", "n", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")))
    suspicion = F.coalesce(F.try_divide("distrust", F.col("trust") + F.col("distrust")), F.lit(0.0))
    scored = scratch.save(scored.withColumn("method", F.when(suspicion > threshold, "block").otherwise("allow")), "host-scores")

    # Hosts with more than a thousandth of all pages are a thousand at most and go to every task; the
    # others' pages meet their host by a shuffle in which no host is large.
    what = F.struct("trust", "distrust", "method")
    common = scored.where(F.col("n") * 1000 > n).select("host", what.alias("common"))
    rest = scored.where(F.col("n") * 1000 <= n).select(F.col("host").alias("other"), what.alias("rest"))
    out = ruled.drop("html").join(F.broadcast(common), "host", "left")
    spread = F.when(F.col("common").isNull(), F.col("host")).otherwise(F.concat(F.lit("/"), F.xxhash64("page_id", "path").cast("string")))  # no host has a /
    out = out.withColumn("meet", spread).join(rest, F.col("meet") == F.col("other"), "left").withColumn("s", F.coalesce("common", "rest"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "s.method", F.lit("allow")).alias("verdict"), F.coalesce("s.trust", F.lit(0.0)).alias("trust"), F.coalesce("s.distrust", F.lit(0.0)).alias("distrust"))
