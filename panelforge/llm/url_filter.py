"""URL filters with redirect equivalence.

A page's own rule decides: of the rules that fit its host (or a parent domain) and path, the
longest.  Pages without a rule take the decision of their aliases: URLs joined by canonical
links and redirects are one component, found by distributed connected components, and a block
anywhere in it blocks every member that no rule allows explicitly.  Otherwise they are allowed.

Defined cases: a null URL, or one without `://`, has an empty host and path and no alias; a
fragment does not make another URL; relative targets are resolved against the page; repeated
rows are judged alike; pages without html have no links; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import durable
from panelforge.llm.components import components

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, action) of the longest rule that fits, or null; ties go to allow."""
    out = None
    for action, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        then = F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, then) if out is None else out.when(fits, then)
    return out if out is not None else F.lit(None).cast("struct<rule:string,action:string>")


def targets(html: Column) -> Column:
    """Targets of all canonical links and of all redirects in a page; tags in comments count too."""

    def found(word: str, tag: str, target: str) -> Column:
        tags = F.regexp_extract_all(html, F.lit(tag), F.lit(0))
        return F.when(F.contains(F.lower(html), F.lit(word)), F.transform(tags, lambda t: F.regexp_extract(t, target, 1))).otherwise(F.array().cast("array<string>"))

    links = found("canonical", r"(?is)<link\s[^>]*?\brel\s*=\s*[\"']?\s*canonical\b[^>]*>", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
    moves = found("http-equiv", r"(?is)<meta\s[^>]*?\bhttp-equiv\s*=\s*[\"']?\s*refresh\b[^>]*>", r"(?is)\burl\s*=\s*['\"]?([^\"'\s>]+)")
    return F.array_distinct(F.concat(links, moves))


def resolved(target: Column, url: Column) -> Column:
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0)
    folder = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(?:[^?#]*/)?", 0)
    folder = F.when(F.endswith(folder, F.lit("/")) & (folder != F.concat(scheme, F.lit("://"))), folder).otherwise(F.concat(site, F.lit("/")))
    return (
        F.when(target.contains("://"), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(site, target))
        .otherwise(F.concat(folder, target))
    )


def node_of(url: Column) -> Column:
    """An alias node: the URL with its host in lower case and without its fragment."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    site = F.regexp_extract(bare, r"(?s)^.*?://[^/?#]*", 0)
    return F.xxhash64(F.concat(F.lower(site), F.substr(bare, F.length(site) + 1)))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict) of pages (page_id, url, html); rules: (action, host, path)."""
    url = F.col("url")
    links = pages.where("url IS NOT NULL AND html IS NOT NULL AND instr(url, '://') > 0").select("url", F.explode(targets(F.col("html"))).alias("target"))
    links = links.where("target IS NOT NULL AND target <> ''").select("url", resolved(F.col("target"), url).alias("target"))
    links = durable(links.distinct().select(node_of(url).alias("u"), node_of(F.col("target")).alias("v"), "url", "target"))

    judged = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    blocked = F.lit(False)
    if links.limit(1).count():
        root = components(links.select("u", "v"))
        both = links.select("u", "url").unionByName(links.select(F.col("v").alias("u"), F.col("target").alias("url")))
        # the roots themselves are nodes too
        member = root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())
        bad = both.where(rule_of(host_of(url), path_of(url), rules)["action"] == BLOCK).select(F.col("u").alias("node")).distinct()
        bad = member.join(bad, "node", "left_semi").select("root").distinct()
        alias = member.join(bad, "root", "left_semi").select("node", F.lit(True).alias("by_alias"))
        judged = judged.withColumn("node", F.when(url.contains("://"), node_of(url))).join(alias, "node", "left")
        blocked = F.coalesce("by_alias", F.lit(False))
    verdict = F.coalesce(F.col("r.action"), F.when(blocked, BLOCK).otherwise(ALLOW))
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))
