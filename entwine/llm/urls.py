"""URL verdicts: host and path rules first, then trust and distrust spread over the host graph; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_spread, stage

#: (verdict, host, path): fits the host and its subdomains where the url's path starts with the rule's path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Mass of one seed page: masses are integers, so that every engine adds them to the same sum.
SCALE = 1_000_000
#: Mass that a host hands on, at least: what is less (a thousandth of a page) ends there, so the spreading ends.
LEAST = 1_000
#: Steps between two staged states.
UNROLL = 5
#: An address with a host in an href or src attribute, with or without a scheme.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?(//[^"'\s>]+)"""
#: Whole per mille of a node's mass that follows its edges; the rest goes back to the seeds.
DAMPING = 850


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_edges(judged: DataFrame, html_column: str = "html") -> DataFrame:
    """Weighted edges (src, dst, n) between hosts.

    A link that names a host (`href` or `src` with `//`, with or without a scheme) is an edge from the page's host to
    the link's; pages of one host are added up before the shuffle. Every host is also joined with its parent domain, down to two labels, in both
    directions, so that judgements reach hosts that no page links to.
    """
    links = judged.where("host <> ''").select(
        F.col("host").alias("src"),
        F.explode(F.regexp_extract_all(F.coalesce(F.col(html_column), F.lit("")), F.lit(LINK), F.lit(1))).alias("url"),
    )
    links = links.select("src", host_of(F.concat(F.lit(":"), F.col("url"))).alias("dst")).where("dst <> '' AND dst <> src")
    labels = F.split("host", r"\.")
    up = judged.where("host <> ''").select("host").distinct().select(F.explode(F.expr("transform(sequence(0, greatest(size(split(host, '[.]')) - 2, 0)), i -> concat_ws('.', slice(split(host, '[.]'), i + 1, 1000)))")).alias("host"))
    up = up.where(F.size(labels) > 2).select(F.col("host").alias("src"), F.expr("substring(host, instr(host, '.') + 1)").alias("dst")).distinct()
    tree = up.union(up.select("dst", "src"))
    both = links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).union(tree.select("src", "dst", F.lit(1).cast("long")))
    return both.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Personalised PageRank in whole numbers: (kind, host, mass) from seeds (kind, host, mass) over edges
    (kind, src, dst, n).

    A host's mass is its seed mass and all that reaches it: each step a host hands DAMPING per mille of what it just
    got to its out-edges, in proportion to n (the sum over steps is PageRank with restarts, up to a constant factor).
    It ends when no host has LEAST to hand on. Masses depend on a host's surroundings alone, not on the size of the
    table. What is lost to rounding and to hosts without edges is dropped. Every UNROLL steps the state is staged.
    """
    total = edges.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    flow = edges.join(total, ["kind", "src"])
    places = edges.select("kind", "src").union(edges.select("kind", "dst")).union(seeds.select("kind", "host")).distinct()
    # A loop at every host (total 0) hands over what it has collected, so that one join makes a step.
    loops = places.select("kind", "src", F.col("src").alias("dst"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"))
    flow = stage(flow.select("kind", "src", "dst", "n", "total").union(loops), "flow")
    state = seeds.select("kind", "host", F.col("mass").alias("held"), F.col("mass").alias("new"))
    sent = F.expr(f"CASE WHEN new >= {LEAST} AND total > 0 THEN cast(new div 1000 * {DAMPING} + new % 1000 * {DAMPING} div 1000 as decimal(38,0)) * n div total ELSE 0L END")
    while True:
        for _ in range(UNROLL):
            moved = state.withColumnRenamed("host", "src").join(flow, ["kind", "src"])
            moved = moved.select("kind", F.col("dst").alias("host"), F.when(F.col("total") == 0, F.col("held")).otherwise(sent).alias("held"), F.when(F.col("total") == 0, 0).otherwise(sent).alias("new"))
            state = moved.groupBy("kind", "host").agg(F.sum("held").alias("held"), F.sum("new").alias("new"))
        state = stage(state, "mass")
        if state.where(F.col("new") >= LEAST).isEmpty():
            return state.select("kind", "host", F.col("held").alias("mass"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    A page with a fitting rule takes that rule's verdict. For the others the method decides by host: hosts with
    pages that rules allow are trusted seeds and hosts with blocked pages are distrust seeds, SCALE for each
    such page; trust follows host edges forwards and distrust follows them backwards (a host that
    links to a bad host is suspect). A host is blocked where its distrust exceeds its trust, else allowed: a host
    that neither reaches is allowed. A host may hold a third of all pages: pages are counted by host before they are
    shuffled, and marks come back to them by a join that deals such a host over several tasks.

    Null url or no `://`: empty host and path, no rule, allowed. Null html has no links. Empty table: no rows.
    Repeated rows give repeated rows and count as often. Only page_id, url and html are read.
    """
    own = pages.select("page_id", "url", "html")
    judged = own.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("rule", rule).withColumn("by_rule", verdict)
    edges = stage(host_edges(judged), "links")
    votes = stage(judged.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("by_rule") == "allow").alias("good"), F.count_if(F.col("by_rule") == "block").alias("bad")), "seeds")
    kinds = lambda trust, distrust: trust.withColumn("kind", F.lit("trust")).union(distrust.withColumn("kind", F.lit("distrust")))
    seeds = kinds(*(votes.where(f"{c} > 0").select("host", (F.col(c) * SCALE).alias("mass")) for c in ("good", "bad")))
    both = kinds(edges, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    mass = spread(both, seeds).groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0)).alias(k) for k in ("trust", "distrust")])
    marks = stage(votes.join(mass, "host", "left").na.fill(0, ["trust", "distrust"]).select("host", "pages", "trust", "distrust"), "marks")
    named = judged.select("page_id", "host", "path", "rule", "by_rule")
    nowhere = named.where("host = ''").withColumn("trust", F.lit(0).cast("long")).withColumn("distrust", F.lit(0).cast("long"))
    out = join_spread(named.where("host <> ''"), marks, "host", "pages", "page_id").select(*nowhere.columns).union(nowhere)
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
