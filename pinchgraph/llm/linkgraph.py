"""URL filter: rules on host and path, then trust and distrust spread over the host graph.

Trust is a personalised PageRank from hosts whose pages the rules allow, along links; distrust is
the same walk from hosts whose pages the rules block, against the links (who points at bad hosts is
suspect).  Edges are links between hosts and those of a host with its parent domain, which is a node of its own.  Dangling mass is left out of each round: handing it back to the seeds would scale all scores
of a walk alike, and scores are compared after division by their sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinchgraph.llm.common import ascii_lower
from pinchgraph.storage import materialize

#: (host, path prefix, verdict)
Rule = tuple[str, str, str]

DAMPING = 0.85
#: The walks end when no host's score can still move by more than this share of all scores.
TOLERANCE = 1e-3
#: Rounds between two written tables.
ROUNDS_A_TABLE = 4
#: A host is blocked when its distrust exceeds its trust and this many times an average host's distrust.
THRESHOLD = 1.0
#: Bytes of a domain name at most; longer hosts have no parent domains.
LONGEST_NAME = 253
#: Rules become one expression; a longer list belongs in a table joined on host suffixes.
MOST_RULES = 1_000
#: An absolute or protocol-relative link in an anchor.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*", 0)
    return F.when(F.coalesce(at, F.lit(0)) > 0, ascii_lower(host)).otherwise("")


def url_path(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end; empty without `://` or for null."""
    at = F.instr(url, "://")
    path = F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(at, F.lit(0)) > 0, path).otherwise("")


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits, null when none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are taken as an expression")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the last that fits wins
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts in the pages' anchors, counted."""
    src = url_host(F.col(url_col))
    links = pages.select(src.alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))).alias("_to"))
    named = links.select("src", url_host(F.concat(F.lit("x:"), F.substr("_to", F.instr("_to", "//")))).alias("dst"))
    good = (F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))
    return named.where(good).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def domain_links(hosts: DataFrame) -> DataFrame:
    """(src, dst, n): each host and its parent domains in a chain, both ways, weight 1.

    Parent domains are nodes also when no page is theirs; a single label (a public suffix) and the tail of an address
    in digits are none.
    """
    labels = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = (F.size(labels) > 2) & (F.octet_length("host") <= LONGEST_NAME) & ~F.col("host").rlike(r"\.[0-9]+(:[0-9]*)?$")
    chains = hosts.where(named).select(chain.alias("_c"))
    steps = F.transform(F.sequence(F.lit(1), F.size("_c") - 1), lambda i: F.struct(F.get("_c", i - 1).alias("src"), F.get("_c", i).alias("dst")))
    pairs = chains.select(F.inline(steps)).distinct()
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select("src", "dst", F.lit(1).cast("long").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust), each summing to 1 over all hosts where it has a seed at all.

    `links(src, dst, n)`; `seeds(host, kind)` with kind trust or distrust, and `weight` where they are not uniform.
    Both walks run as one: distrust has its edges turned round.  Without `rounds` they go on until what is
    still to come is below `tolerance` of the scores' sum: a round shrinks it by `damping`, so the change over some
    rounds bounds all later ones.
    """
    both = links.select(F.col("src").alias("host"), F.lit("trust").alias("kind"), F.col("dst").alias("to"), "n").unionByName(
        links.select(F.col("dst").alias("host"), F.lit("distrust").alias("kind"), F.col("src").alias("to"), "n"))
    out = both.groupBy("host", "kind").agg(F.sum("n").alias("all"))
    edges = materialize(both.join(out, ["host", "kind"]).select("host", "kind", "to", (F.col("n") / F.col("all")).alias("share")), "edges")
    weight = F.col("weight") if "weight" in seeds.columns else F.lit(1.0)
    start = materialize(seeds.select("host", "kind", weight.cast("double").alias("score")), "seeds").df
    scores, done = start, not edges.rows
    ran = 0
    while not done:
        before = scores
        step = ROUNDS_A_TABLE if rounds is None else min(ROUNDS_A_TABLE, rounds - ran)
        for _ in range(step):
            moved = scores.join(edges.df, ["host", "kind"]).select(F.col("to").alias("host"), "kind", (F.col("score") * F.col("share") * damping).alias("score"))
            scores = moved.unionByName(start.withColumn("score", F.col("score") * (1 - damping))).groupBy("host", "kind").agg(F.sum("score").alias("score"))
        ran += step
        sides = scores.withColumn("old", F.lit(0.0)).unionByName(before.select("host", "kind", F.lit(0.0).alias("score"), F.col("score").alias("old")))
        sides = sides.groupBy("host", "kind").agg(F.sum("score").alias("score"), F.sum("old").alias("old"))
        written = materialize(sides, "scores", moved=F.sum(F.abs(F.col("score") - F.col("old"))), all=F.sum("score"))
        scores = written.df.select("host", "kind", "score")
        ahead = float(written.metrics.get("moved") or 0) * damping**step / (1 - damping**step)
        done = ran >= rounds if rounds is not None else ahead <= tolerance * float(written.metrics.get("all") or 0)
    sums = {r["kind"]: r["s"] for r in scores.groupBy("kind").agg(F.sum("score").alias("s")).collect()}
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)) / F.lit(float(sums.get(k) or 1.0))
    return scores.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))


def judge(pages: DataFrame, rules: Sequence[Rule], rounds: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of `pages(page_id, url, html)`.

    A page under a rule gets the rule's verdict; another gets that of its host: block when distrust is above
    trust and above `threshold` times an average host's, else allow.  A host is a seed of trust by the share of its pages
    that rules allow, and one of distrust by the share that they block; it may be both.  `trust` and `distrust` sum
    to 1 over the hosts of the pages.  Pages without a host (null url, no `://`) and those of hosts that
    no seed reaches are allowed.  A null html has
    no links.  Repeated rows are judged alike; other columns are ignored.
    """
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    named = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    named = materialize(named.withColumn("rule", rule).withColumn("_by_rule", verdict), "named").df
    count = lambda v: F.count(F.when(F.col("_by_rule") == v, 1))
    hosts = materialize(named.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), count("allow").alias("trust"), count("block").alias("distrust")), "hosts")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(k) / F.col("pages")).alias("weight")) for k in ("trust", "distrust")])
    seeds = hosts.df.select("host", F.inline(kinds)).where("weight > 0")
    links = host_links(pages).unionByName(domain_links(hosts.df)).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    reached = propagate(links, seeds, rounds).join(hosts.df.select("host"), "host")
    scores = materialize(reached, "reached", trust=F.sum("trust"), distrust=F.sum("distrust"))
    # parent domains without pages hold a part of the walk
    part = {kind: F.col(kind) / F.lit(float(scores.metrics.get(kind) or 1.0)) for kind in ("trust", "distrust")}
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") * float(max(1, hosts.rows)) > threshold)
    judged = scores.df.withColumns(part).withColumn("_by_host", F.when(bad, "block").otherwise("allow"))
    return named.join(judged, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("_by_rule", "_by_host", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
