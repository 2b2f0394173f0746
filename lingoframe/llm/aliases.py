"""Block decisions that hold for every alias of a URL.

URLs are one page if a redirect or a canonical link leads from one to the other. Redirects come from meta refresh tags, from
a crawl's log if one is given, and from the customary ones (scheme, www. or m. hosts, index pages, fragments, tracking
parameters), canonical links from the pages. Components of these edges carry a block to all their URLs; a URL that an
allow rule names stays allowed whatever its aliases are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingoframe.llm.graph import connected_components
from lingoframe.llm.shared import written

#: Regular expressions (of the kind that Java and RE2 share) over the URL as it stands. BLOCK names the junk sites, whatever the scheme,
#: user, host prefix or port. ALLOW has the blogs of sites whose names are one word: they stay even where a blocked site
#: redirects to them or names them as canonical. Since every name on the block list has a hyphen, no blog of a junk site is allowed.
BLOCK = (r"(?i)^([a-z][a-z0-9+.-]*:)?//([^/?#]*[.@])?(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)\.?(:[0-9]*)?([/?#]|$)",)
ALLOW = (r"(?i)^https?://blog\.[a-z]+\.example\.(com|net|org)(:[0-9]*)?([/?#]|$)",)
CANONICAL = (r"(?is)<link[^>]*rel=.?canonical[^>]*href=[\"']([^\"'>]+)", r"(?is)<link[^>]*href=[\"']([^\"'>]+)[\"'][^>]*rel=.?canonical")
REFRESH = r"(?is)<meta[^>]*http-equiv=.?refresh[^>]*url=[\"']?([^\"'>\s]+)"
#: (pattern, replacement), in order; the first four take scheme, host prefix, fragment and tracking parameters.
CUSTOMARY = (("^[hH][tT][tT][pP][sS]?://", "https://"), (r"^https://(www|m)\.", "https://"), ("#.*$", ""), (r"([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "$1"), ("&&+", "&"), (r"[?]&+", "?"), (r"[?&]+$", ""), (r"/index\.html?$", "/"), (r"\.html?$", ""), ("/+$", ""))


def customary(url: Column) -> Column:
    """Where servers customarily redirect a URL to."""
    for pattern, new in CUSTOMARY:
        url = F.regexp_replace(url, pattern, new)
    return url


def resolved(target: Column, base: Column) -> Column:
    """A link's target as seen from the page it stands on: relative ones with scheme, site and folder of its URL, dots taken out."""
    link = F.regexp_replace(F.trim(target), "&amp;", "&")
    bare = F.regexp_replace(base, r"[?#].*$", "")
    site = F.regexp_extract(base, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
    path, rest = F.regexp_extract(link, "^[^?#]*", 0), F.regexp_extract(link, r"[?#].*$", 0)
    folder = F.regexp_extract(F.substr(bare, F.length(site) + 1), "^.*/", 0)
    whole = F.when(link.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    step = lambda done, part: F.when(part == "..", F.regexp_replace(done, "/[^/]*$", "")).when(part == ".", done).otherwise(F.concat(done, F.lit("/"), part))
    parts = F.split(F.regexp_replace(F.regexp_replace(whole, "^/", ""), r"(^|/)(\.\.?)$", "$1$2/"), "/")
    short = F.aggregate(parts, F.lit(""), step)
    return (
        F.when((link == "") | F.regexp_like(link, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")) | (site == ""), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, "^[^:]*:", 0), link))
        .when(link.startswith("?"), F.concat(bare, link)).when(link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link)).otherwise(F.concat(site, short, rest))
    )


def _any(url: Column, rules) -> Column:
    found = F.lit(False)
    for rule in rules:
        found = found | url.rlike(rule)
    return found


def alias_edges(pages: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """(src, dst, kind) of pages (url, html) and of a log (src, dst) of redirects; relative targets are resolved, empty ones are
    left out."""
    link = F.coalesce(F.nullif(F.regexp_extract("html", CANONICAL[0], 1), F.lit("")), F.regexp_extract("html", CANONICAL[1], 1))
    made = F.array(
        F.struct(customary(F.col("url")).alias("dst"), F.lit("customary").alias("kind")),
        F.struct(resolved(link, F.col("url")).alias("dst"), F.lit("canonical").alias("kind")),
        F.struct(resolved(F.regexp_extract("html", REFRESH, 1), F.col("url")).alias("dst"), F.lit("refresh").alias("kind")),
    )
    edges = pages.where("url is not null").select(F.col("url").alias("src"), F.inline(made))
    if log is not None:
        edges = edges.unionByName(log.select("src", "dst", F.lit("log").alias("kind")))
    # A target is also tied to where it customarily redirects, so that two spellings of one target meet.
    onward = edges.where("kind <> 'customary' and dst <> ''").select(F.col("dst").alias("src"), customary(F.col("dst")).alias("dst"), F.lit("customary").alias("kind"))
    return edges.unionByName(onward).where("src <> '' and dst <> '' and src <> dst")


def url_decisions(pages: DataFrame, block=BLOCK, allow=ALLOW, log: DataFrame | None = None) -> DataFrame:
    """For each page: page_id, url, component (its smallest URL), decision and blocked_by (the smallest blocked URL there).

    decision: 'allowed' if an allow rule names the URL itself, else 'blocked' if a block rule does, else 'alias_blocked' if
    one does so for a URL of its component that no allow rule names, else 'clear'. A null URL has 'clear' and nulls; a URL
    without edges is its own component; repeated rows are decided alike; columns beyond page_id, url and html are ignored.
    """
    rows = written(pages.select("page_id", "url", _any(F.col("url"), block).alias("b"), _any(F.col("url"), allow).alias("a")), "urls")
    edges = written(alias_edges(pages, log).select("src", "dst").distinct(), "aliases")
    roots = written(connected_components(edges, "src", "dst"), "components")
    seeds = roots.withColumn("b", _any(F.col("node"), block) & ~_any(F.col("node"), allow)).where("b")
    blocked = seeds.groupBy("root").agg(F.min("node").alias("by"))
    placed = rows.join(roots.withColumnRenamed("node", "url"), "url", "left").join(blocked, "root", "left")
    by = F.when(F.col("root").isNotNull(), F.col("by")).when(F.col("b") & ~F.col("a"), F.col("url"))
    decision = F.when(F.col("a"), "allowed").when(F.col("b"), "blocked").when(by.isNotNull(), "alias_blocked").otherwise("clear")
    return placed.select("page_id", "url", F.coalesce("root", "url").alias("component"), decision.alias("decision"), by.alias("blocked_by"))
