"""URL filter: host and path rules, and block decisions carried over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.components import attach, components
from wardline.llm.frames import ascii_lower, quoted
from wardline.session import cut_lineage

# A tag that names another address for its page, and the address in it.
_TAG = r"(?i)<(?:link|meta)\b[^>]*>"
_CANONICAL = r"""(?i)\brel\s*=\s*["']?canonical\b"""
_REFRESH = r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""
_HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
_BASE = r"""(?i)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_CONTENT = r"""(?i)\burl\s*=\s*['"]?([^"'\s>;]+)"""


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """One name for an address: lower-case host, no scheme, no fragment; null where there is no host."""
    query = F.regexp_extract(rest_of(url), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def _plain_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` steps."""
    steps = F.split(path, "/", -1)
    last = F.element_at(steps, -1)
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda done, s: F.when(s == ".", done).when(
        s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(s))))
    joined = F.array_join(kept, "/")
    return F.when(last.isin(".", "..") & ~F.endswith(joined, F.lit("/")), F.concat(joined, F.lit("/"))).otherwise(joined)


def resolved(target: Column, base: Column) -> Column:
    """A full address for ``target`` as written on a page at ``base``; null for other schemes, fragments and no base."""
    scheme = F.regexp_extract(base, r"^([^:/?#]+)://", 1)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(rest_of(base), r"^[^/?#]*", 0))
    folder = F.regexp_extract(path_of(base), r"^.*/", 0)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    path, tail = F.regexp_extract(target, r"^[^?#]*", 0), F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    full = (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | target.startswith("#") | (target == ""), F.lit(None))
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), F.concat(root, _plain_path(path), tail))
            .when(target.startswith("?"), F.concat(root, path_of(base), target))
            .otherwise(F.concat(root, _plain_path(F.concat(folder, path)), tail)))
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://") | (scheme != ""), full)


def redirects(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``url, target`` for the canonical links and refresh redirects of the pages; relative ones go by the page's url and
    ``<base>``, and those that name no address are left out."""
    base = F.replace(F.regexp_extract(F.col(quoted(html_col)), _BASE, 1), F.lit("&amp;"), F.lit("&"))
    base = F.when(F.coalesce(base, F.lit("")) == "", F.col(quoted(url_col))).otherwise(resolved(base, F.col(quoted(url_col))))
    tags = F.regexp_extract_all(F.col(quoted(html_col)), F.lit(_TAG), F.lit(0))
    tags = F.filter(tags, lambda t: t.rlike(_CANONICAL) | t.rlike(_REFRESH))
    found = pages.filter(F.col(quoted(url_col)).isNotNull()).select(F.col(quoted(url_col)).alias("url"), base.alias("base"), F.explode(tags).alias("tag"))
    target = F.when(F.col("tag").rlike(_CANONICAL), F.regexp_extract("tag", _HREF, 1)).otherwise(F.regexp_extract("tag", _CONTENT, 1))
    target = resolved(F.replace(target, F.lit("&amp;"), F.lit("&")), F.col("base"))
    return found.select("url", target.alias("target")).filter(F.instr("target", "://") > 0)


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, rule, verdict`` for the distinct urls that a rule fits: its host or a subdomain, and its path as a prefix.

    The longest rule wins, of equally long ones an allowing one.  Only host suffixes with as many labels as some rule
    has are looked up, by an equi-join.
    """
    rules = rules.select(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    labels = F.size(F.split("rule_host", "\\."))
    depths = sorted(r[0] for r in rules.select(labels.alias("d")).distinct().collect())
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    if not depths:
        return urls.select("url", F.lit("").alias("rule"), F.lit("").alias("verdict")).filter(F.lit(False))
    suffixes = F.array_distinct(F.array(*[F.substring_index(host, ".", -d) for d in depths]))
    tried = urls.filter(host != "").select("url", path.alias("path"), F.explode(suffixes).alias("rule_host"))
    fit = tried.join(rules, "rule_host").filter(F.expr("startswith(path, rule_path)"))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("verdict") == "allow").alias("allow"), rule.alias("rule"), "verdict"))
    return fit.groupBy("url").agg(best.alias("b")).select("url", "b.rule", "b.verdict")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, component`` for every page; rules has host, path and verdict (allow, block).

    A page's own rule decides, so an explicit allow outweighs what its aliases are.  A page without a rule is blocked
    if a rule blocks any address in its component of redirect and canonical links, else allowed.  Null url, or one
    without ``://``, has empty host and path, no rule and no alias: allowed.  Null html has no links; repeated pages are
    judged each; without rules or links every page is allowed; an empty table gives an empty result.
    """
    links = cut_lineage(redirects(pages, url_col, html_col).distinct())
    urls = pages.select(F.col(quoted(url_col)).alias("url")).union(links.select("target")).filter("url is not null").distinct()
    verdicts = cut_lineage(ruled(urls, rules))
    edges = links.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"))
    found = components(edges)
    bad = verdicts.filter("verdict = 'block'").select(node_of(F.col("url")).alias("node")).distinct()
    blocked = bad.join(found, "node").select("component").distinct().withColumn("blocked", F.lit(True))
    own = pages.select(F.col(quoted(id_col)).alias("page_id"), F.col(quoted(url_col)).alias("url")).withColumn("node", node_of(F.col("url")))
    out = attach(attach(attach(own, verdicts, "url", how="left"), found, "node", how="left"), blocked, "component", how="left")
    return out.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule",
                      F.coalesce("verdict", F.when(F.col("blocked"), "block"), F.lit("allow")).alias("verdict"), "component")
