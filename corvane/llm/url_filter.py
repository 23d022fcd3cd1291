"""URL filtering with redirect equivalence, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.components import connected_components
from corvane.llm.shared import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first "://"; null where there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))


def host_of(url: Column) -> Column:
    """From "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty for null or no "://"."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """A URL's host and path without what doesn't choose a page: scheme, "www." or "m.", query, fragment, final "/" or ".html"."""
    host, path = F.regexp_replace(host_of(url), r"^(www|m)\.", ""), F.regexp_replace(path_of(url), r"(/|\.html)$", "")
    return F.when(host != "", F.concat(F.lit("//"), host, path))


def resolved(href: Column, base: Column) -> Column:
    """href as an absolute URL, seen from the page `base`; null if it is empty or the page has no "://".

    Covers absolute links, "//host", "/path", "?query", "#fragment" and paths relative to the page's folder; "." and
    ".." segments of the latter are taken out.
    """
    href = F.nullif(F.trim(href), F.lit(""))
    scheme, site = F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path = path_of(base)
    folder = F.concat(F.regexp_replace(path, r"[^/]*$", ""), href)
    relative = F.regexp_extract(F.when(F.startswith(href, F.lit("/")), href).otherwise(folder), r"(?s)^([^?#]*)", 1)
    rest = F.regexp_extract(href, r"(?s)^[^?#]*(.*)$", 1)
    nothing = F.array().cast("array<string>")
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))).when(x.isin(".", ""), done).otherwise(F.array_append(done, x))
    parts = F.aggregate(F.split(relative, "/"), nothing, step)
    final = F.when(F.endswith(relative, F.lit("/")) & (F.size(parts) > 0), F.lit("/")).otherwise(F.lit(""))
    whole = F.concat(site, F.lit("/"), F.array_join(parts, "/"), final, rest)
    out = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), href).when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.substring(href, 1, 1).isin("?", "#"), F.concat(site, path, href)).when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None)).otherwise(whole)
    )
    return F.when(F.locate("://", base) > 0, out)


def links_of(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between URLs that are one page by what the html says: every canonical link and refresh redirect."""
    link = F.regexp_extract_all("html", F.lit(r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']([^"']+)["']"""), 1)
    moved = F.regexp_extract_all("html", F.lit(r"""(?is)<meta\b(?=[^>]*http-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*([^"'>\s]+)"""), 1)
    said = pages.select("url", F.explode(F.concat(link, moved)).alias("href"))
    return said.select(F.col("url").alias("a"), resolved(F.col("href"), F.col("url")).alias("b")).where("b is not null")


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its action, both null if none does.

    rules: (action, host and path in one); a rule fits its host and all subdomains if the path starts with its path.
    Of two that are the same string, allow goes first.
    """
    rule = action = F.lit(None).cast("string")
    for what, pattern in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow")):
        domain, slash, rest = pattern.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + rest))
        rule, action = F.when(fits, F.lit(pattern)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def judge(pages: DataFrame, rules: list[tuple[str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url, html) with host, path, rule and verdict.

    A URL that a rule fits has the rule's verdict: an explicit allow always stands. Any other is blocked if it is an
    alias of a blocked URL, and allowed if not. URLs of one canonical form are aliases, and redirects (a, b: URLs) and
    canonical links connect forms by chains of any length: every end of a link counts by its own form, whether it is
    a page of the table or not. Components are found over distinct forms, so that a host or target with any share of
    the rows is one node, and they carry one decision each.

    A null url, or one without "://", has empty host and path, no rule and no aliases. An empty table gives an empty
    result; repeated rows are judged alike; columns named host, path, rule or verdict are replaced, any others stay.
    """
    rule, action = best_rule(F.col("host"), F.col("path"), rules)
    own = F.struct(*(c for c in pages.columns if c not in ("host", "path", "rule", "verdict"))).alias("own")
    parts = lambda df, url: df.withColumns({"host": host_of(url), "path": path_of(url), "form": canonical(url)})
    judged = parts(pages.select(own), F.col("own.url")).withColumns({"rule": rule, "action": action})

    edges = links_of(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("a", "b").where("a is not null and b is not null"))
    edges = cut(edges.distinct(), "url-links")
    ends = parts(edges.select(F.explode(F.array("a", "b")).alias("url")), F.col("url")).withColumn("action", action)
    seen = judged.select("form", "action").unionByName(ends.select("form", "action")).where("form is not null")
    forms = seen.groupBy("form").agg(F.max(F.coalesce(F.col("action") == "block", F.lit(False))).alias("blocked"))
    groups = connected_components(edges.select(canonical(F.col("a")).alias("a"), canonical(F.col("b")).alias("b")), "url-components")
    named = cut(forms.join(groups, forms.form == groups.node, "left").select("form", "blocked", F.coalesce("component", "form").alias("component")), "url-forms")
    bad = named.where("blocked").select("component").distinct()
    spread = named.join(bad, "component", "left_semi").select("form", F.lit(True).alias("spread"))
    verdict = F.coalesce("action", F.when(F.col("spread"), F.lit("block")), F.lit("allow"))
    return judged.join(spread, "form", "left").select("own.*", "host", "path", "rule", verdict.alias("verdict"))
