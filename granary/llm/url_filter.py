"""URL block lists whose decisions spread over redirects and canonical links.

Urls that redirect to each other or name each other canonical are one resource. The resources are
the connected components of those edges, found with alternating large-star and small-star steps.
A rule that fits a url decides it. Without one, a url is allowed if an allow rule fits any alias,
else blocked if a block rule fits any alias, else allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import spread
from granary.session import cut


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or end, A-Z lower-cased; empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? # or end; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def parse_rule(text: str) -> tuple[str, str, str]:
    """'block com/en/' -> ('block', 'com', '/en/')."""
    verdict, _, rule = text.partition(" ")
    host, slash, path = rule.partition("/")
    if verdict not in ("block", "allow") or not host:
        raise ValueError(f"not a rule: {text!r}")
    return verdict, host, slash + path


def matched(host: Column, path: Column, rules: list[str]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does; an allow wins a tie.

    A rule fits its host and all subdomains, where the path starts with the rule's path. The rule set
    is a literal of the plan: it is a parameter of the query, not data.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    order = sorted((parse_rule(r) for r in rules), key=lambda r: (len(r[1] + r[2]), r[0] == "allow"))
    for kind, h, p in order:  # the last that fits wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _without_dots(path: Column) -> Column:
    """path after removing its segments . and .. (which takes the one before away)."""
    parts = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))
    step = lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    left = F.aggregate(parts, F.array().cast("array<string>"), step)
    end = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(left) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(left, "/"), end)


def normal(url: Column) -> Column:
    """url without its fragment; with a scheme and ://, these and the host in lower case, no dot segments, and / for an empty path."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    part = lambda i: F.regexp_extract(bare, r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?]*)([^?]*)(.*)$", i)
    path = F.when(part(3) == "", F.lit("/")).when(part(3).contains("/."), _without_dots(part(3))).otherwise(part(3))
    return F.when(part(1) == "", bare).otherwise(F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), path, part(4)))


def node(url: Column) -> Column:
    """A url's identity in the graph: the 16-byte hash of its normal form."""
    return F.unhex(F.md5(normal(url)))


def absolute(base: Column, link: Column) -> Column:
    """link as an absolute url: with a scheme as it is, // and / relative to base's scheme and host, ? to base's path, else to base's folder."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(F.regexp_extract(base, r"(?s)^([^?#]*)", 1), link))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), link))
    )


#: A link whose relations, a list of words, have canonical among them.
CANONICAL = r"""(?is)^<link\b.*?\srel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical[\s/>])"""


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) urls of each page's canonical link and of its meta refresh, in whole pages; relative ones go by its <base href>, if any.

    Null urls or pages, and pages without such a tag outside comments, give no edge.
    """
    url, html = F.col(url_col), F.regexp_replace(F.col(html_col), r"(?s)<!--.*?(?:-->|$)", "")
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta|base)\b[^>]*>"), 0)
    canonical = F.filter(tags, lambda t: t.rlike(CANONICAL))
    refresh = F.filter(tags, lambda t: t.rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    href = F.transform(canonical, lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    goal = F.transform(refresh, lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    bases = F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r"(?is)^<base\b.*\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)), lambda b: b != "")
    base = F.coalesce(F.replace(F.get(bases, 0), F.lit("&amp;"), F.lit("&")), F.lit(""))
    found = pages.filter(url.isNotNull()).select(url.alias("src"), base.alias("base"), F.explode(F.concat(href, goal)).alias("link")).filter("link <> ''")
    found = found.withColumn("base", F.when(F.col("base") == "", F.col("src")).otherwise(absolute(F.col("src"), F.col("base"))))
    return found.select("src", absolute(F.col("base"), F.replace(F.col("link"), F.lit("&amp;"), F.lit("&"))).alias("dst"))


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected component, for nodes with an edge to another.

    Large-star and small-star steps until nothing changes; each step joins a node's neighbours with
    the node's minimum (one row a node, dealt anew), so that a hub's edges can be split over tasks.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(most):
        if edges.isEmpty():
            break
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        star = both.join(spread(low), F.col("u") == F.col("c")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        joined = star.join(spread(low), F.col("u") == F.col("c"))
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("c").alias("u"), F.col("m").alias("v")))
        edges = cut(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def url_filter(pages: DataFrame, rules: list[str], edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, host, path, rule, verdict, spread (the decision came over an edge), one row for each of pages.

    `edges` (src, dst urls) adds redirects known from elsewhere to the links found in the pages. A
    null url has no host, no aliases and is allowed. Rows repeated with one url are judged alike.
    """
    found = links(pages, url_col, html_col)
    if edges is not None:
        found = found.unionByName(edges.select("src", "dst").filter("src is not null and dst is not null"))
    found = cut(found.distinct())
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("_own"))
    roots = cut(components(found.select(node(F.col("src")).alias("a"), node(F.col("dst")).alias("b"))))
    # Every url that the graph names is judged, page or not.
    urls = found.select(F.col("src").alias("u")).union(found.select(F.col("dst").alias("u"))).distinct()
    _, own = matched(host_of(normal(F.col("u"))), path_of(normal(F.col("u"))), rules)
    named = urls.select(node(F.col("u")).alias("node"), own.alias("own")).filter("own is not null")
    judged = named.join(spread(roots), "node").groupBy("root").agg(F.max(F.when(F.col("own") == "allow", 2).otherwise(1)).alias("rank"))
    passed = roots.join(judged, "root").select(F.col("node").alias("_node"), F.when(F.col("rank") == 2, "allow").otherwise("block").alias("_passed"))
    rows = rows.withColumn("_n", node(F.col("url")))
    out = rows.join(passed, F.col("_n") == F.col("_node"), "left")
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("_own", "_passed", F.lit("allow")).alias("verdict"), (F.col("_own").isNull() & F.col("_passed").isNotNull()).alias("spread"))
