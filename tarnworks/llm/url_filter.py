"""URL filters with redirect equivalence, in DataFrame functions only.

A url gets the longest rule that fits its host or a parent domain and the start of its path. Urls without a rule of their
own are judged by their aliases: pages are linked with the targets of their canonical links and refresh redirects, and
each connected component is allowed if any member has an allow rule, blocked if any has a block rule, and allowed else.

Null urls and those without "://" have an empty host and path, fit no rule, have no aliases and are allowed. Repeated
rows each get their row. Relative links are resolved against the page's base href, or else its url; of the entities in
links, those of "&" are decoded. Links of schemes without "://" (mailto:, data:) don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnworks.llm.components import components
from tarnworks.session import stash

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the query, as (host, path, verdict).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?([^"'\s>]+)"""
_BASE = r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.expr("substring(__url, locate('://', __url) + 3)")).otherwise(F.lit(""))


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host and path of the url."""
    x = df.withColumn("__url", F.coalesce(F.col(f"`{url}`"), F.lit(""))).withColumn("__rest", _rest(F.col("__url")))
    return x.withColumn("host", F.translate(F.regexp_extract("__rest", r"^[^/?#]*", 0), _UPPER, _LOWER)).withColumn("path", F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1)).drop("__url", "__rest")


def _query(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*(\?[^#]*)", 1)


def _node(host: Column, path: Column, url: Column) -> Column:
    """What aliases are compared by: host, path and query, without scheme and fragment. Null without a host."""
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), _query(url)))


def _without_dots(path: Column) -> Column:
    """A path that begins with "/", with its segments "." and ".." carried out."""
    segments = F.split(path, "/")
    step = lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    kept = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.array().cast("array<string>"), step)
    ended = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(ended, "/"))


def resolve(link: Column, host: Column, path: Column, query: Column) -> Column:
    """The url that a link leads to from host, path and query. Null for schemes without "://"."""
    here = F.concat(F.lit("http://"), host)
    own = F.when(path == "", "/").otherwise(path)
    to, asked = F.regexp_extract(link, r"^[^?#]*", 0), _query(link)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(to.startswith("/"), F.concat(here, _without_dots(to), asked))
        .when(to != "", F.concat(here, _without_dots(F.concat(F.regexp_extract(own, r"^(?s:.*)/", 0), to)), asked))
        .otherwise(F.concat(here, own, F.when(asked == "", query).otherwise(asked)))
    )


def _link(raw: Column) -> Column:
    return F.regexp_replace(raw, r"(?i)&(amp|#38|#x26);", "&")


def fitting_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct (host, path) of places that a rule fits; rules: host, path, verdict."""
    r = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "verdict").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = places.select("host", "path").where("host <> ''").distinct().select("host", "path", F.explode(suffixes).alias("suffix"))
    fits = tried.join(r, "suffix").where(F.col("path").startswith(F.col("start")))
    rule = F.struct(F.length(F.concat("suffix", "start")).alias("n"), F.concat("suffix", "start").alias("rule"), (F.col("verdict") == "allow").alias("allows"), "verdict")
    return fits.groupBy("host", "path").agg(F.max(rule).alias("best")).select("host", "path", "best.rule", "best.verdict")


def alias_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """(a, b, host, path) of each canonical link and refresh redirect; host and path are the target's. pages: url, host, path, html."""
    target = F.explode(F.array_distinct(F.concat(*[F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(p), F.lit(1)) for p in (_CANONICAL, _REFRESH)])))
    base = F.regexp_extract(F.coalesce(F.col(html), F.lit("")), _BASE, 1)
    found = pages.where("host <> ''").select(_node(F.col("host"), F.col("path"), F.col("url")).alias("a"), "url", "host", "path", _link(base).alias("base"), target.alias("to"))
    page = resolve(F.col("base"), F.col("host"), F.col("path"), _query(F.col("url")))
    # tables between the steps: filters that are pushed through them would repeat their expressions over and over
    based = with_parts(stash(found.select("a", F.coalesce(page, "url").alias("from"), _link(F.col("to")).alias("to")), "links"), "from")
    full = resolve(F.col("to"), F.col("host"), F.col("path"), _query(F.col("from")))
    placed = with_parts(stash(based.select("a", full.alias("target")), "targets").where("target IS NOT NULL"), "target")
    return placed.select("a", _node(F.col("host"), F.col("path"), F.col("target")).alias("b"), "host", "path").where("b IS NOT NULL")


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages."""
    given = with_parts(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")))
    slim = stash(given.select("page_id", "host", "path", _node(F.col("host"), F.col("path"), F.col("url")).alias("node")), "urls")
    edges = stash(alias_edges(given), "aliases")
    ruled = stash(fitting_rules(slim.select("host", "path").union(edges.select("host", "path")), rules), "ruled")
    roots = components(edges)
    # verdicts that members of a component have from rules
    known = slim.select("node", "host", "path").union(edges.select("b", "host", "path")).distinct().join(ruled, ["host", "path"])
    spread = known.join(roots, "node").groupBy("root").agg(F.max(F.col("verdict") == "allow").alias("allowed"))
    of_node = roots.join(spread, "root").select("node", F.when(F.col("allowed"), "allow").otherwise("block").alias("inherited"))
    out = slim.join(ruled, ["host", "path"], "left").join(of_node, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "inherited", F.lit("allow")).alias("verdict"))
