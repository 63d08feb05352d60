"""URL filters: rules, and propagation of trust and distrust over the host graph.

A rule names a host with all its subdomains and the start of a path; the longest fitting rule judges
the page. Pages without a rule are judged by their host: the share of a host's pages that rules allow
is its trusted seed, the share that they block its distrusted seed. Trust is a personalised PageRank
from the trusted seeds along the links between hosts; distrust runs from the blocked seeds against the
links, to the hosts that lead there, which share it among them. The lead of a host is the same mass
taken over its own links, each by its share of them: where a walk from there comes to, however many
others link to the same hosts. A host is blocked where the larger of its distrust and lead exceeds its
trust and reaches ``threshold`` times that of a fully blocked host without links; any other is allowed.

Links are absolute ``href`` values of the whole page. They are counted per pair of hosts before
anything is joined, so a host with a third of all pages is a bounded number of rows per task.

Defined results: a missing url, or one without "://", has an empty host and path, no rule and no
links, and is allowed; a missing page text has no links; links within a host do not count; repeated
pages count each; of rules of equal length the longer host wins, then a block; mass of hosts without
links is lost, not spread; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.rows import staged
from tapeloom.session import drop_staged, staged_mark


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Graph:
    """Rounds go on until no mass changes by ``tolerance``; ``rounds`` ends them before, if given."""

    damping: float = 0.85
    rounds: int | None = None
    tolerance: float = 1e-6
    threshold: float = 0.5


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_replace(_after_scheme(url), "^[^/?#]*", "")
    return F.coalesce(F.regexp_extract(rest, "^[^?#]*", 0), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block"))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in reversed(ordered):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, chosen).otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, n`` of ``pages(host, html)``: absolute links between different hosts."""
    target = F.regexp_extract_all(
        "html", F.lit("(?i)\\bhref\\s*+=\\s*+(?:[\"']\\s*+)?+((?:https?:)?//[^\"'\\s>]+)"), F.lit(1)
    )
    links = pages.filter("host != ''").select(F.col("host").alias("src"), F.explode(target).alias("url"))
    url = F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), "url")).otherwise(F.col("url"))
    links = links.select("src", host_of(url).alias("dst")).filter("dst != '' AND dst != src")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def _shares(links: DataFrame, of: str, to: str) -> DataFrame:
    """``of, to, share``: each link's share of all links of ``of``."""
    total = links.groupBy(of).agg(F.sum("n").alias("total"))
    return links.join(total, of).select(
        F.col(of).alias("of"), F.col(to).alias("to"), (F.col("n") / F.col("total")).alias("share")
    )


def propagate(seeds: DataFrame, links: DataFrame, cfg: Graph) -> DataFrame:
    """``host, trust, distrust, lead`` from ``seeds(host, trusted, blocked)`` over ``links(src, dst, n)``.

    Every host that has pages or links has a row. Each round is a written table, which replaces the
    one before; one number, the largest change, reaches the driver.
    """
    links = staged(links, "host-links")
    ends = links.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    seeds = seeds.join(ends, "host", "full").na.fill(0.0, ["trusted", "blocked"])
    rest = 1 - cfg.damping
    start = staged(
        seeds.select(
            "host",
            (rest * F.col("trusted")).alias("trust0"),
            (rest * F.col("blocked")).alias("distrust0"),
            (rest * F.col("blocked")).alias("lead0"),
        ),
        "host-seeds",
    )
    forward = staged(_shares(links, "src", "dst"), "forward")
    backward = staged(_shares(links, "dst", "src"), "backward")
    # Each mass with the links it moves along, from one end to the other.
    walks = {
        "trust": (forward, "of", "to"),
        "distrust": (backward, "of", "to"),
        "lead": (forward, "to", "of"),
    }
    ranks = start.select("host", *[F.col(f"{n}0").alias(n) for n in walks])
    rounds = cfg.rounds
    if rounds is None:
        # All masses together change by at most the seeds' mass times a power of the damping.
        mass = start.agg(F.sum(F.col("trust0") + F.col("distrust0"))).first()[0] or 0.0
        most = max(mass / cfg.tolerance, 1.0)
        rounds = 1 + math.ceil(math.log(most) / -math.log(cfg.damping))
    for i in range(rounds):
        new = start
        for name, (shares, at, to) in walks.items():
            moved = shares.join(ranks.select(F.col("host").alias(at), F.col(name).alias("v")), at)
            flow = moved.filter("v > 0").groupBy(F.col(to).alias("host"))
            flow = flow.agg(F.sum(F.col("share") * F.col("v")).alias(f"in_{name}"))
            new = new.join(flow, "host", "left")
        new = new.select(
            "host",
            *[
                (F.col(f"{n}0") + cfg.damping * F.coalesce(f"in_{n}", F.lit(0.0))).alias(n)
                for n in walks
            ],
        )
        old = ranks.select("host", F.struct(*walks).alias("was"))
        mark = staged_mark()
        new = staged(new.join(old, "host"), "host-ranks")
        if i:
            drop_staged(seeds.sparkSession, mark - 1, mark)
        change = F.greatest(*[F.abs(F.col(n) - F.col(f"was.{n}")) for n in walks])
        largest = new.agg(F.max(change)).first()[0]
        ranks = new.drop("was")
        if largest is None or largest < cfg.tolerance:
            break
    return ranks


def judge(
    pages: DataFrame,
    rules: list[Rule],
    cfg: Graph = Graph(),
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and trust and distrust of its host."""
    url = F.col(f"`{url_col}`").cast("string")
    parts = pages.select(
        F.col(f"`{id_col}`").alias("page_id"),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        F.col(f"`{html_col}`").cast("string").alias("html"),
    )
    judged = parts.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    share = [
        F.avg((F.coalesce("found.verdict", F.lit("")) == v).cast("double")).alias(n)
        for v, n in (("allow", "trusted"), ("block", "blocked"))
    ]
    seeds = judged.filter("host != ''").groupBy("host").agg(*share)
    ranks = propagate(seeds, host_links(parts), cfg)
    least = cfg.threshold * (1 - cfg.damping)
    against = F.greatest("distrust", "lead")
    blocked = (against > F.col("trust")) & (against >= least)
    hosts = ranks.withColumn("by_host", F.when(blocked, "block").otherwise("allow"))
    return (
        judged.drop("html")
        .join(hosts, "host", "left")
        .select(
            "page_id",
            "host",
            "path",
            F.col("found.rule").alias("rule"),
            F.coalesce("found.verdict", "by_host", F.lit("allow")).alias("verdict"),
            F.coalesce("trust", F.lit(0.0)).alias("trust"),
            F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
        )
    )
