"""URL filtering under redirect equivalence.

Pages name other addresses of themselves: ``<link rel=canonical href=...>`` and
``<meta http-equiv=refresh content="0; url=...">``.  These links make addresses
equivalent; connected components over them carry a block decision to every alias.  A rule
that fits an address itself decides it; otherwise an explicit allow anywhere in its
component has precedence over any block there, and a component without either is allowed.
Column expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import Workspace
from .components import components

#: Rules become one expression; more than this many must come as several passes.
MOST_RULES = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule; nulls inside if none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} a pass")
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    order = sorted(rules, key=lambda r: (len(r.text), r.verdict == "allow", r.text))  # allow wins a tie
    for r in order:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def address(url: Column) -> Column:
    """An address without scheme and fragment, its host in lower case; null without host."""
    rest = F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1)
    rest = F.when((rest == "") | rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(host_of(url) != "", F.concat(host_of(url), rest))


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted either way or bare."""
    found = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(found, r"""^["']|["']$""", ""), "&amp;", "&"))


def resolve(base: Column, target: Column) -> Column:
    """A link's target as a full url, seen from the page at ``base``."""
    host = F.regexp_extract(base, r"^[^:]*://[^/?#]*", 0)
    return (
        F.when(target == "", F.lit(None))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None))
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(host, target))
        .otherwise(F.concat(host, F.coalesce(F.nullif(F.regexp_extract(path_of(base), r"^.*/", 0), F.lit("")), F.lit("/")), target))
    )


def alias_links(pages: DataFrame, work: Workspace, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): addresses that a page declares to be the same as its own.

    Tags and targets are few; written between the steps, they keep each step's generated
    code within what the JVM compiles.
    """
    text = F.col(html).cast("string")
    tags = F.regexp_extract_all(text, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    # most pages have neither word, and are done with after one search each
    some = pages.where(text.rlike("(?i)canonical") | text.rlike(r"(?i)http-equiv"))
    tag = work.put(some.select(F.col(url).alias("base"), F.explode(tags).alias("tag")), "tags")
    t = F.col("tag")
    canonical = t.rlike(r"(?is)^<link\b") & F.lower(_attribute(t, "rel")).rlike(r"(^|\s)canonical(\s|$)")
    refresh = t.rlike(r"(?is)^<meta\b") & (F.lower(_attribute(t, "http-equiv")) == "refresh")
    later = F.trim(F.regexp_replace(F.regexp_extract(_attribute(t, "content"), r"(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*(.*)$", 1), r"""^["']|["']$""", ""))
    target = F.when(canonical, _attribute(t, "href")).when(refresh, later)
    aimed = work.put(tag.select("base", target.alias("target")).where("target != ''"), "targets")
    full = work.put(aimed.select("base", resolve(F.col("base"), F.col("target")).alias("target")), "resolved")
    links = full.select(address(F.col("base")).alias("a"), address(F.col("target")).alias("b"))
    return links.where("a is not null and b is not null and a != b").distinct()


def judge(pages: DataFrame, rules: list[Rule], links: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages(page_id, url, html).

    ``links`` may hold more (a, b) addresses known to be redirects.  A null url, or one
    without ``://``, has empty host and path, no rule, and the default verdict.  Repeated
    rows are judged each; other columns are ignored; an empty table gives no rows.
    """
    work = Workspace(pages.sparkSession, "urls")
    found = alias_links(pages, work)
    if links is not None:
        found = found.union(links.select("a", "b").where("a is not null and b is not null and a != b")).distinct()
    group = components(work.put(found, "links"), "a", "b")
    seen = F.concat(F.lit("x://"), F.col("node"))
    of_node = group.withColumn("fit", fitting_rule(host_of(seen), path_of(seen), rules))
    decided = of_node.where("fit.verdict is not null").groupBy("component").agg(F.max(F.col("fit.verdict") == "allow").alias("free"))
    aliases = group.join(decided, "component").select(F.col("node").alias("address"), "free")
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("address"))
    own = own.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("free"), "allow").when(~F.col("free"), "block"), F.lit(default))
    # pages without an address, or decided by a rule of their own, have no part in the join
    apart = F.col("address").isNull() | F.col("fit.verdict").isNotNull()
    met = own.where(~apart).join(aliases, "address", "left").unionByName(own.where(apart).withColumn("free", F.lit(None).cast("boolean")))
    return met.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))
