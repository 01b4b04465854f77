"""URL filters by redirect equivalence.

1. Rules (host, path, verdict) fit a host and its subdomains, if the path of the url starts with the
   rule's; the longest rule (host and path together) decides. They are found by a key: a url is looked
   up under its host and each parent domain.
2. Pages give edges: from their url to the target of a canonical link or of a redirect by meta refresh;
   a table of further redirects can be given. Urls are the same node whatever their scheme, fragment
   and case of host.
3. Connected components of the edges, found by joins and minima, are the aliases. A component with an
   allowed url is allowed, else one with a blocked url is blocked, targets that are no page included.
   Urls with a rule keep its verdict; the others get that of their component, or allow.

Cases: a null url or one without ``://`` has an empty host and path and is allowed unless an alias says
otherwise (it has no alias: it takes part in no edge); null or empty html and unreadable targets give no
edge; a url that names itself gives none; repeated rows are judged alike; of equally long rules allow
wins; an empty table gives an empty table; other columns are not looked at. Links inside comments or
scripts count as links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import saved
from factloom.llm.components import connected_components

#: The rules of the registered query: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_UPPER, _LOWER = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
_CANONICAL = r"""(?is)\brel\s*=\s*(?:"[^"]*\bcanonical\b[^"]*"|'[^']*\bcanonical\b[^']*'|canonical\b)"""
_REFRESH = r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b"""
_HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_URL = r"""(?is)\burl\s*=\s*['"]?([^'">]*)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """Host, path and query: what is left of a url without scheme and fragment; null without a host."""
    host, rest = host_of(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(host, rest))


def resolved(target: Column, url: Column) -> Column:
    """A link's target as a whole url: whole, without scheme, from the root, or beside the page; null if empty."""
    t = F.replace(F.trim(target), F.lit("&amp;"), F.lit("&"))
    scheme, site = F.regexp_extract(url, r"(?s)^(.*?:)//", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    beside = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    return (
        F.when((t == "") | t.startswith("#"), F.lit(None)).when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t).when(t.startswith("//"), F.concat(scheme, t))
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None)).when(t.startswith("/"), F.concat(site, t))
        .otherwise(F.concat(site, F.when(beside == "", "/").otherwise(beside), t))
    )


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes of pages and of the targets of their canonical links and meta redirects."""
    body = pages.select(pages[url].alias("url"), pages[html].cast("string").alias("html")).where("url IS NOT NULL AND html IS NOT NULL")
    # most pages have neither: the cheap test comes first
    body = body.where(F.col("html").rlike("(?i)canonical|refresh"))
    tags = body.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))).alias("tag"))
    tags = tags.withColumns({"link": F.lower(F.left("tag", F.lit(5))) == "<link"})
    canonical = F.col("link") & F.col("tag").rlike(_CANONICAL)
    redirect = ~F.col("link") & F.col("tag").rlike(_REFRESH)
    href = F.concat(*[F.regexp_extract("tag", _HREF, i) for i in (1, 2, 3)])
    target = F.when(canonical, href).when(redirect, F.regexp_extract("tag", _URL, 1))
    return tags.select(node_of(F.col("url")).alias("a"), node_of(resolved(target, F.col("url"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")


def ruled(urls: DataFrame, rules: DataFrame, host: str, path: str) -> DataFrame:
    """Adds rule (its host and path) and rule_verdict, null where none fits. ``rules``: host, path, verdict.

    A url is looked up under its host and each parent of it; the longest fitting rule stays."""
    table = rules.select(F.col("host").alias("__host"), F.struct(F.length(F.concat("host", "path")).alias("size"), (F.col("verdict") == "allow").alias("allow"), F.concat("host", "path").alias("rule"), F.col("path").alias("path"), F.col("verdict").alias("verdict")).alias("r"))
    # one row a host, with all its rules
    table = table.groupBy("__host").agg(F.collect_list("r").alias("__rules"))
    hosts = urls.select(F.col(host).alias("__url_host")).distinct()
    labels = F.split("__url_host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = hosts.select("__url_host", F.explode(parents).alias("__host")).join(table, "__host")
    found = saved(found.groupBy("__url_host").agg(F.flatten(F.collect_list("__rules")).alias("__rules")), "rules")
    fits = F.filter("__rules", lambda r: F.startswith(F.col(path), r["path"]))
    out = urls.join(found, F.col(host) == F.col("__url_host"), "left").withColumn("__best", F.array_max(fits))
    return out.withColumns({"rule": F.col("__best.rule"), "rule_verdict": F.col("__best.verdict")}).drop("__best", "__rules", "__url_host")


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row for each page: id, host, path, rule (null without one), verdict (allow or block) and component,
    the least node of its aliases (null without any). ``rules``: host, path, verdict; ``redirects``: from_url,
    to_url."""
    edges = page_edges(pages, url, html)
    if redirects is not None:
        more = redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b"))
        edges = edges.unionByName(more.where("a IS NOT NULL AND b IS NOT NULL AND a <> b"))
    aliases = saved(connected_components(edges), "aliases")
    # nodes are urls without their scheme
    named = aliases.withColumn("__url", F.concat(F.lit("://"), "node")).select("node", "component", host_of(F.col("__url")).alias("__h"), path_of(F.col("__url")).alias("__p"))
    judged = ruled(named, rules, "__h", "__p")
    decided = judged.groupBy("component").agg(F.max(F.col("rule_verdict") == "allow").alias("allow"), F.max(F.col("rule_verdict") == "block").alias("block"))
    spread = aliases.join(decided, "component").select(F.col("node").alias("__node"), "component", F.when(F.col("allow"), "allow").when(F.col("block"), "block").alias("alias_verdict"))
    spread = saved(spread, "alias-verdicts")
    rows = pages.select(pages[id_col].alias("page_id"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"), node_of(pages[url]).alias("node"))
    rows = ruled(rows, rules, "host", "path").join(spread, F.col("node") == F.col("__node"), "left")
    verdict = F.coalesce("rule_verdict", "alias_verdict", F.lit("allow"))
    return rows.select(F.col("page_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "component")
