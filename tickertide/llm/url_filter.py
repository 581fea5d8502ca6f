"""Allow or block pages: rules for hosts and paths, else trust and distrust along links."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tickertide.llm.tables import lower_ascii, stage


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Fixed values.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def split_url(url: Column | str) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it is null or has no ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    plain = F.regexp_extract(rest, "^[^?#]*", 0)
    host = F.regexp_extract(plain, "^[^/]*", 0)
    return lower_ascii(host), F.substring(plain, F.length(host) + 1, F.length(plain) + F.lit(1))


def longest_rule(host: str, path: str, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((F.col(host) == rule.host) | F.col(host).endswith(f".{rule.host}")) & F.col(path).startswith(rule.path)
        text = F.when(fits, rule.host + rule.path).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Weighted edges (src, dst, n) between hosts: the links of their pages (host, targets)."""
    links = pages.select(F.col("host").alias("src"), F.explode("targets").alias("dst"))
    return links.where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = 10, stay: float = 0.85) -> DataFrame:
    """Personalised PageRank of several kinds at once: rows (kind, host, rank), each kind adding to 1.

    ``edges`` are (kind, src, dst, share), the shares of a src adding to 1; ``seeds`` are
    (kind, host, seed), the seeds of a kind adding to 1. Rank of hosts without edges returns to
    the seeds. Every other round is a written table.
    """
    ranks = seeds.withColumnRenamed("seed", "rank")
    for number in range(rounds):
        moved = (
            ranks.withColumnRenamed("host", "src")
            .join(edges, ["kind", "src"])
            .groupBy("kind", F.col("dst").alias("host"))
            .agg(F.sum(F.col("rank") * F.col("share")).alias("moved"))
        )
        if number % 2 == 1 or number == rounds - 1:
            moved = stage(moved, "host-moved")
        kept = moved.groupBy("kind").agg(F.sum("moved").alias("kept"))
        back = seeds.join(F.broadcast(kept), "kind", "left").select(  # one row per kind
            "kind", "host", (F.col("seed") * (1 - stay * F.coalesce("kept", F.lit(0.0)))).alias("rank")
        )
        ranks = (
            back.unionByName(moved.select("kind", "host", (F.col("moved") * stay).alias("rank")))
            .groupBy("kind", "host")
            .agg(F.sum("rank").alias("rank"))
        )
    return stage(ranks, "host-ranks")


def judge_pages(pages: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = 10, usual: float = 1.0) -> DataFrame:
    """Judge ``pages`` (page_id, url, html) by the longest rule, else by their host.

    Trust starts at the hosts of pages that rules allow, in proportion to their number, and
    follows links; distrust starts at those of blocked pages and follows links backwards. A
    host is blocked if its distrust exceeds its trust and ``usual`` times the mean over hosts.
    Hosts without either, and urls without a host, are allowed. Null html has no links.
    Each input row gives one row; other columns are ignored.

    Returns page_id, host, path, rule, verdict.
    """
    host, path = split_url("url")
    read = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    text, verdict = longest_rule("host", "path", rules)
    targets = F.when(F.col("html").contains("//"), F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    read = stage(
        read.select(
            "page_id",
            "host",
            "path",
            text.alias("rule"),
            verdict.alias("ruled"),
            F.transform(F.coalesce(targets, F.array().cast("array<string>")), lower_ascii).alias("targets"),
        ),
        "judged-urls",
    )
    counted = read.where("host <> ''").groupBy("host", F.coalesce("ruled", F.lit("none")).alias("ruled")).count()
    hosts = stage(
        counted.groupBy("host").agg(
            *(F.sum(F.when(F.col("ruled") == r, F.col("count")).otherwise(0)).alias(r) for r in ("allow", "block"))
        ),
        "judged-hosts",
    )
    number = hosts.count()
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in ("allow", "block")))).alias("k")
    seeds = hosts.select("host", kinds).select("k.kind", "host", "k.n").where("n > 0")
    sums = seeds.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = stage(
        seeds.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("seed")),  # two rows
        "judged-seeds",
    )
    edges = stage(host_edges(read), "host-edges")
    both = edges.select(F.lit("allow").alias("kind"), "src", "dst", "n").union(
        edges.select(F.lit("block"), F.col("dst"), F.col("src"), "n")
    )
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    shares = stage(
        both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")),
        "host-shares",
    )
    ranks = propagate(shares, seeds, rounds)
    judged = ranks.groupBy(F.col("host").alias("r_host")).agg(
        *(F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(n) for k, n in (("allow", "trust"), ("block", "distrust")))
    )
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") * number > usual)
    blocked = judged.where(bad).select("r_host")
    return read.join(blocked, F.col("host") == F.col("r_host"), "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(F.col("r_host").isNotNull(), "block").otherwise("allow")).alias("verdict"),
    )
