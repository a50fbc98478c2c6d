"""URL verdicts: host and path rules first, then trust and distrust propagated over the links between hosts.

Native throughout (DataFrame operations only). Trust is personalised PageRank along links from hosts whose pages the
allow rules fit. Distrust runs against the links, from hosts whose pages the block rules fit to the hosts that link to
them, and weighs by the share of the linking host's links, so it is as strong as that host's interest in blocked ones. A
host's seed is the share of its pages under such rules, so scores don't depend on how many pages a corpus has. Both are the series
sum of (damping * M)^k * seed, computed by moving only the last increment a step further; the increment is written to
the shared folder at each step. Hosts are blocked where distrust reaches ``threshold`` and is above trust.

Links are counted per pair of hosts before any join, so a hub host is one row per neighbour. No side is broadcast by
hint; Spark's run-time sizes decide, and skewed joins are split by adaptive execution.

Edge cases: a null url, or one without ``://``, has empty host and path, no rule and the verdict allow; a null html has
no links; links of a host to itself don't count; repeated pages count as often as they stand; empty tables give no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import lower_ascii

Rule = tuple[str, str]
# (verdict, host/path prefix)
RULES: tuple[Rule, ...] = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
SALTS = 16  # parts that the pages of one host are dealt to when they meet the host's verdict
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, by the letter of the contract."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule whose host is the url's or a parent of it and whose path starts the url's; null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        rule_host, _, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, counted."""
    host, _ = url_parts(F.col(url_col))
    links = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(html_col, F.lit(LINK), 1)).alias("dst"))
    return links.select("src", lower_ascii("dst").alias("dst")).where("src != dst and src != ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, iterations: int, tolerance: float) -> DataFrame:
    """(host, trust, distrust) of every host that either reaches. seeds: host, trust, distrust."""
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    shares = edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share"))
    moves = shares.selectExpr("stack(2, 'trust', src, dst, 'distrust', dst, src) as (kind, host, to)", "share").checkpoint()
    step = seeds.selectExpr("host", "stack(2, 'trust', trust, 'distrust', distrust) as (kind, score)").where("score > 0").checkpoint()
    parts = [step]
    if not moves.isEmpty():
        for _ in range(iterations):
            step = (
                step.join(moves, ["kind", "host"]).groupBy("kind", F.col("to").alias("host"))
                .agg((F.sum(F.col("score") * F.col("share")) * F.lit(damping)).alias("score")).checkpoint()
            )
            parts.append(step.select("host", "kind", "score"))
            largest = step.agg(F.max("score")).first()[0]
            if largest is None or largest < tolerance:
                break
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.groupBy("host").agg(
        *(F.round(F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)), 9).alias(k) for k in ("trust", "distrust"))
    )


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    damping: float = 0.85, threshold: float = 0.5, iterations: int = 30, tolerance: float = 1e-9,
) -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits) and verdict (allow or block)."""
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    rule, by_rule = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = parts.select(id_col, "host", "path", rule.alias("rule"), by_rule.alias("by_rule"))
    share = lambda kind: F.avg(F.when(F.col("by_rule") == kind, 1.0).otherwise(0.0))
    seeds = judged.where("host != ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = propagate(host_edges(pages, url_col, html_col), seeds, damping, iterations, tolerance)
    blocked = scores.where((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))).select("host", F.lit("block").alias("by_host"))
    # a host may have a third of all pages: its pages meet copies of its verdict in SALTS places
    dealt = judged.withColumn("salt", F.pmod(F.xxhash64(id_col, "path"), F.lit(SALTS)).cast("int"))
    blocked = blocked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(blocked, ["host", "salt"], "left").select(
        id_col, "host", "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict")
    )


ORACLE = r"""
WITH RECURSIVE u AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(kind, rule, rh, rp) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
                                 ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
j AS (SELECT p.page_id, p.host, p.path, p.html, r.rule, r.kind FROM p LEFT JOIN r
        ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp)),
best AS (SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, max_by(kind, length(rule)) AS kind FROM j GROUP BY ALL),
seeds AS (SELECT host, avg(CASE WHEN kind = 'allow' THEN 1.0 ELSE 0.0 END) AS trust, avg(CASE WHEN kind = 'block' THEN 1.0 ELSE 0.0 END) AS distrust
          FROM best WHERE host <> '' GROUP BY host),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?(?:https?:)?//([^/?#"''\s>]+)', 1)) AS dst FROM p),
e AS (SELECT src, translate(dst, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst, count(*) AS n FROM l GROUP BY ALL HAVING src <> dst AND src <> ''),
m AS (SELECT 'trust' AS kind, src AS host, dst AS goal, n / sum(n) OVER (PARTITION BY src) AS share FROM e
      UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY src) FROM e),
inc(k, kind, host, score) AS (
  SELECT 0, 'trust', host, trust FROM seeds WHERE trust > 0 UNION ALL SELECT 0, 'distrust', host, distrust FROM seeds WHERE distrust > 0
  UNION ALL
  SELECT k + 1, inc.kind, m.goal, 0.85 * sum(score * share) FROM inc JOIN m ON m.kind = inc.kind AND m.host = inc.host WHERE k < 30 GROUP BY k + 1, inc.kind, m.goal),
s AS (SELECT host, round(sum(CASE WHEN kind = 'trust' THEN score ELSE 0 END), 9) AS trust, round(sum(CASE WHEN kind = 'distrust' THEN score ELSE 0 END), 9) AS distrust FROM inc GROUP BY host)
SELECT best.page_id, best.host, best.path, best.rule,
       coalesce(best.kind, CASE WHEN s.distrust >= 0.5 AND s.distrust > s.trust THEN 'block' END, 'allow') AS verdict
FROM best LEFT JOIN s USING (host)
"""
