"""URL filters by rules and by link-graph propagation (operator 10).

Rules of (host, path) decide a url where one fits. Hosts with allowed pages are trusted
seeds, hosts with blocked pages are distrusted ones. Trust flows along links between hosts
by personalised PageRank from the trusted seeds; distrust flows against them from the
blocked ones: who links to a blocked host shares in its distrust. A url that no rule
decides gets the verdict of its host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# The rules of the registered query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""

DAMPING = 0.85
ROUNDS = 10
# The share of all mass that may still be in flight when a verdict is taken, and rounds in which it gets that small on any graph.
REST = 1e-3
ENOUGH = 50


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_urls(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path of their url; input columns of these names are replaced."""
    url = F.col("url").cast("string")
    return pages.withColumns({"host": host_of(url), "path": path_of(url)})


def fitting_rule(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits columns host and path; nulls for none."""
    name = verdict = None
    for kind, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name = F.when(fits, host + path) if name is None else name.when(fits, host + path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (name, verdict) if name is not None else (none, none)


def apply_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    name, verdict = fitting_rule(rules)
    return split_urls(pages).withColumns({"rule": name, "rule_verdict": verdict})


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, out of pages with host and html.

    Absolute links and those that start with // count; others stay on their host. A host
    whose name is another crawled host's with one more label in front counts as linked
    with it both ways, once, since both belong to one site.
    """
    links = pages.select("host", F.explode(F.regexp_extract_all(F.col("html").cast("string"), F.lit(LINK), F.lit(1))).alias("link"))
    target = F.translate(F.regexp_extract("link", r"^[^/]*//([^/?#]*)", 1), UPPER, LOWER)
    edges = links.select(F.col("host").alias("src"), target.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))
    hosts = pages.where("host <> ''").select("host").distinct()
    site = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+)$", 1).alias("dst")).where("dst <> ''")
    site = site.join(hosts.withColumnRenamed("host", "dst"), "dst", "left_semi").select("src", "dst", F.lit(1.0).alias("n"))
    return edges.union(site).union(site.select("dst", "src", "n")).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, rest: float = 0.0) -> DataFrame:
    """(host, score): PageRank that restarts at ``seeds`` (host, weight) in proportion to weight.

    ``edges`` are (src, dst, n). What a host without links would pass on is lost, as in
    TrustRank. A round passes on only what the round before brought, so it costs what it
    touches; contributions are summed before they are shuffled. It ends after ``rounds``, or
    once at most ``rest`` of all mass is in flight, which then stays where it is. A round
    leaves at most ``damping`` of the mass in flight, on any graph, so as many rounds as
    log(rest) / log(damping) always suffice.
    """
    total = seeds.agg(F.sum("weight")).first()[0]
    if not total:
        return seeds.select("host", F.lit(0.0).alias("score")).where("false")
    degree = edges.groupBy("src").agg(F.sum("n").alias("degree"))
    moves = written(edges.join(degree, "src").select(F.col("src").alias("host"), "dst", (F.col("n") / F.col("degree")).alias("share")))
    start = F.sum("weight") * ((1 - damping) / total)
    score = written(seeds.groupBy("host").agg(start.alias("score"), start.alias("flow")))
    for k in range(rounds):
        passed = score.where("flow > 0").join(moves, "host").groupBy("dst").agg((damping * F.sum(F.col("flow") * F.col("share"))).alias("got"))
        both = score.select("host", "score", F.lit(0.0).alias("flow")).union(passed.select("dst", "got", "got"))
        score = both.groupBy("host").agg(F.sum("score").alias("score"), F.sum("flow").alias("flow"))
        if k % 5 == 4 and k + 1 < rounds:
            score = written(score)
            if score.agg(F.sum("flow")).first()[0] <= rest * (1 - damping):
                break
    return score.select("host", (F.col("score") + F.col("flow") * (damping / (1 - damping))).alias("score"))


def host_verdicts(ruled: DataFrame, rounds: int = ENOUGH, ratio: float = 1.0) -> DataFrame:
    """(host, trust, distrust, host_verdict): block where distrust is over ``ratio`` times trust, else allow.

    ``ruled`` are pages with host, html and rule_verdict. A seed's weight is its number of
    decided pages, so both flows are in the unit of pages; hosts that neither flow reaches
    have no row and count as allowed. Flows run until at most ``REST`` of their mass is in
    flight, so a host is out of reach only behind more links than take the rest away.
    """
    counts = ruled.where("host <> ''").groupBy("host").agg(F.count_if(F.col("rule_verdict") == "allow").cast("double").alias("good"), F.count_if(F.col("rule_verdict") == "block").cast("double").alias("bad"))
    counts = written(counts)
    good, bad = counts.agg(F.sum("good"), F.sum("bad")).first()
    edges = written(host_edges(ruled))
    trust = personalised_pagerank(edges, counts.where("good > 0").select("host", F.col("good").alias("weight")), rounds=rounds, rest=REST)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = personalised_pagerank(back, counts.where("bad > 0").select("host", F.col("bad").alias("weight")), rounds=rounds, rest=REST)
    both = trust.select("host", (F.col("score") * (good or 0)).alias("trust"), F.lit(0.0).alias("distrust")).union(distrust.select("host", F.lit(0.0), F.col("score") * (bad or 0)))
    both = both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    return both.withColumn("host_verdict", F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow"))


def judge(pages: DataFrame, rules=RULES, rounds: int = ENOUGH) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html; other columns are ignored): page_id, host, path, rule, verdict.

    A null url, or one without ://, has empty host and path; no rule fits it and no flow
    reaches it, so it is allowed. A null html has no links. Rows of equal page_id are
    judged each, though a link on both counts twice. An empty table gives none.
    """
    ruled = apply_rules(pages.select("page_id", "url", "html"), rules)
    hosts = host_verdicts(ruled, rounds).select("host", "host_verdict")
    judged = ruled.drop("html", "url").join(hosts, "host", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"))
