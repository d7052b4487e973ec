"""URL filters: rules first, then trust and distrust spread over the links between hosts.  DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.sizing import checked_broadcast, cut_lineage

#: Share of a host's standing that it takes from its links, rounds, and rounds between lineage cuts.
DAMPING, ROUNDS, CUT_EVERY = 0.85, 20, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HOST, _PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"
#: Absolute links, also those without a scheme.
_LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for a null url or one without ``://``."""
    return (lower_ascii(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit(""))),
            F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit("")))


def host_rules(hosts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(host, rules) for the hosts any rule fits: its rules as (path, rule, verdict), the longest first.

    Every ending of a host at a dot is looked up in the rules, so the work doesn't grow with their number.
    """
    spark = hosts.sparkSession
    table = spark.createDataFrame(
        [(r.split("/", 1)[0], "/" + r.split("/", 1)[1], r, verdict) for r, verdict in rules],
        "ending string, path string, rule string, verdict string")
    endings = hosts.select("host", F.expr(
        "explode(transform(sequence(1, size(split(host, '[.]'))), n -> substring_index(host, '.', -n)))").alias("ending"))
    met = endings.distinct().join(F.broadcast(table) if len(rules) <= 10_000 else table, "ending")
    return met.groupBy("host").agg(F.sort_array(F.collect_set(F.struct(
        (-F.length("rule")).alias("longest"), "path", "rule", "verdict"))).alias("rules"))


def host_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst, links): links between different hosts, counted where they are read."""
    host, _ = host_and_path(F.col(url_col))
    found = F.when(F.contains(F.col(html_col), F.lit("//")), F.regexp_extract_all(F.col(html_col), F.lit(_LINK), F.lit(1)))
    return (pages.select(host.alias("src"), F.explode(found).alias("dst")).select("src", lower_ascii(F.col("dst")).alias("dst"))
            .where("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").alias("links")))


def spread_standing(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust, exposure): personalised PageRank from ``seeds`` (host, trust, distrust).

    Trust goes from a host to those it links to, distrust back from a host to those that link to it, each in proportion to the
    number of links.  A host keeps ``1 - damping`` of its seed and takes the rest from its neighbours.  Exposure starts as
    distrust does, but a host takes the mean over its own links: other hosts that link to the same place don't lessen it.  All run
    in the same rounds; a host with very many links is summed before the shuffle, and its join is split by the adaptive skew join.
    """
    total = links.groupBy("src").agg(F.sum("links").alias("n"))
    back = links.groupBy("dst").agg(F.sum("links").alias("n"))
    forward = links.join(total, "src").select(F.lit("t").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"),
                                              (F.col("links") / F.col("n")).alias("part"))
    backward = links.join(back, "dst").select(F.lit("d").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"),
                                              (F.col("links") / F.col("n")).alias("part"))
    own = forward.select(F.lit("e").alias("kind"), F.col("to").alias("host"), F.col("host").alias("to"), "part")
    edges = cut_lineage(forward.unionByName(backward).unionByName(own))
    start = cut_lineage(seeds.select("host", F.expr("inline(array(struct('t' as kind, trust as seed), struct('d' as kind, distrust as seed), "
                                                    "struct('e' as kind, distrust as seed)))"))
                        .where("seed > 0").withColumn("seed", F.col("seed") * (1 - damping)))
    ranks = start.select("kind", "host", F.col("seed").alias("rank"))
    # Without links every round gives the seeds again.
    for n in range(1, (rounds if edges.limit(1).count() else 0) + 1):
        moved = ranks.join(edges, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("rank") * F.col("part") * damping).alias("rank"))
        ranks = moved.unionByName(start.withColumnRenamed("seed", "rank")).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if n % CUT_EVERY == 0:
            ranks = cut_lineage(ranks)
    return ranks.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(name)
                                       for kind, name in (("t", "trust"), ("d", "distrust"), ("e", "exposure"))))


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust, exposure) per page.

    A rule ``host/path`` fits a host and its subdomains if the url's path starts with ``/path``; the longest fitting rule decides.
    Seeds are the shares of a host's pages that rules allow and block.  Other pages are blocked if their host's distrust
    is above its trust and its exposure at least half of what a fully blocked host without links has, allowed if not; so are urls without a
    host, and hosts nothing is known about.  Distrust is shared out among all who link to a host, so it is weighed against trust, which is shared out
    alike, and the fixed threshold of a host is on exposure, the part of its own links that leads to the blocked.  Null html has no links; repeated rows and null ids stay; an empty table gives none.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    # Pages are many, hosts and their paths fewer: equal ones are judged once for the seeds.
    counted = cut_lineage(rows.groupBy("host", "path").agg(F.count("*").alias("n")))
    known = cut_lineage(host_rules(counted.select("host").distinct(), rules))
    small = checked_broadcast(known)

    def ruled(what: DataFrame) -> DataFrame:
        fits = "filter(rules, r -> startswith(path, r.path))"
        return what.join(small, "host", "left").withColumn("hit", F.expr(f"try_element_at({fits}, 1)")).drop("rules")

    share = lambda verdict: F.sum(F.when(F.col("hit.verdict") == verdict, F.col("n")).otherwise(0)) / F.sum("n")
    seeds = ruled(counted).where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    standing = cut_lineage(spread_standing(seeds, host_links(pages, url_col, html_col), damping, rounds))
    bound = (1 - damping) / 2
    out = ruled(rows).join(checked_broadcast(standing), "host", "left")
    outcast = (F.col("distrust") > F.col("trust")) & (F.col("exposure") >= bound)
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(
        F.col("hit.verdict"), F.when(outcast, "block").otherwise("allow")).alias("verdict"), "trust", "distrust", "exposure")
