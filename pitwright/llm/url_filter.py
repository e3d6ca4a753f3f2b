"""URL rules carried over redirect equivalence, with DataFrame functions only.

Pages that redirect to one another, or name one another as canonical, are aliases. Aliases are found as connected
components over the edges; a url that no rule fits takes the decision of its component: allow if a rule allows any of its
members explicitly, else block if a rule blocks any, else allow.

A node is a url without scheme and fragment, its host in lower case (a redirect from http to https is no edge then). Edges
come from <link rel=canonical> and <meta http-equiv=refresh> of the whole html, and from a table of redirects, if
given. Relative targets are resolved against the page's url.

Defined results: a null url, or one without ://, has an empty host and path, no node and no alias, and is allowed unless a
rule fits; a null html has no edges; repeated rows are judged alike; an empty table gives an empty result; of equally long
rules that fit, the first in order of their text wins, and of equal ones allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwright.llm.common import ascii_lower, cut
from pitwright.llm.graph import components

#: Up to so many decided aliases are broadcast; more are joined by shuffling.
BROADCAST_ALIASES = 200_000
#: Up to so many rules become one expression; more are a table, joined to the hosts and the domains above them.
INLINE_RULES = 200

#: The values of attributes, in quotes or not.
CANONICAL = r"rel\s*=\s*(?:canonical\b|\"[^\">]*\bcanonical\b|'[^'>]*\bcanonical\b)"
REFRESH = r"http-equiv\s*=\s*[\"']?refresh"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Null where there is no host."""
    rest = F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host_of(url) != "", F.concat(host_of(url), rest))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's or above it and whose path begins the url's; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0]), reverse=True):
        at, slash, tail = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def with_rule(df: DataFrame, host: Column, path: Column, rules: list[tuple[str, str]]) -> DataFrame:
    """df with rule and own: the longest rule that fits host and path, and its verdict."""
    if len(rules) <= INLINE_RULES:
        rule, verdict = fitting_rule(host, path, rules)
        return df.select("*", rule.alias("rule"), verdict.alias("own"))
    table = df.sparkSession.createDataFrame([(t.partition("/")[0], t[len(t.partition("/")[0]) :], t, kind) for kind, t in rules], "of string, begins string, rule string, own string")
    keyed = df.select("*", host.alias("__host"), path.alias("__path"))
    parts = F.split("__host", r"\.")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))).alias("of")
    fits = keyed.select("__host", "__path").distinct().select("__host", "__path", above).join(table, "of").where(F.col("__path").startswith(F.col("begins")))
    longest = fits.groupBy("__host", "__path").agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "own")).alias("b")).select(F.col("__host").alias("h"), F.col("__path").alias("p"), "b.rule", "b.own")
    return keyed.join(longest, (F.col("__host") == F.col("h")) & (F.col("__path") == F.col("p")), "left").drop("__host", "__path", "h", "p")


def _target(tag: str, mark: str, value: str) -> Column:
    found = F.regexp_extract(F.col("html"), rf"(?is)<{tag}\b[^>]*?\b{mark}\b[^>]*>", 0)
    return F.nullif(F.replace(F.regexp_extract(found, value, 1), F.lit("&amp;"), F.lit("&")), F.lit(""))


def resolved(target: Column, url: Column) -> Column:
    folder = F.regexp_extract(path_of(url), r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("x:"), target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("/"), F.concat(F.lit("x://"), host_of(url), target))
        .when(target.startswith("#"), F.lit(None))
        .when(target.startswith("?"), F.concat(F.lit("x://"), host_of(url), path_of(url), target))
        .otherwise(F.concat(F.lit("x://"), host_of(url), folder, target))
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) nodes of canonical links and refreshes, of whatever delay."""
    p = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    canonical = _target("link", CANONICAL, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
    refresh = _target("meta", REFRESH, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)")
    named = p.where(F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", F.explode(F.array(canonical, refresh)).alias("target")).where("target is not null")
    return named.select(node_of(F.col("url")).alias("src"), node_of(resolved(F.col("target"), F.col("url"))).alias("dst")).where("src is not null and dst is not null and src <> dst").distinct()


def alias_decisions(edges: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(node, carried): the decision that each alias gets from its component, where there is one."""
    of = cut(components(edges, "src", "dst"), "aliases")
    url = F.concat(F.lit("x://"), F.col("node"))
    own = with_rule(of, host_of(url), path_of(url), rules)
    decided = cut(own.where("own is not null").groupBy("root").agg(F.when(F.max((F.col("own") == "allow").cast("int")) == 1, "allow").otherwise("block").alias("carried")), "decided")
    return of.join(decided, "root").select("node", "carried")


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """id, host, path, rule, verdict and carried (the component's decision, null if it has none), for every row of pages.

    redirects: columns src_url and dst_url.
    """
    url = F.col(url_col)
    rows = with_rule(pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("alias")), F.col("host"), F.col("path"), rules)
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionAll(redirects.select(node_of(F.col("src_url")).alias("src"), node_of(F.col("dst_url")).alias("dst")))
    edges = cut(edges.where("src is not null and dst is not null and src <> dst").distinct(), "alias-edges")
    if edges.isEmpty():
        rows = rows.withColumn("carried", F.lit(None).cast("string"))
    else:
        carried = cut(alias_decisions(edges, rules).withColumnRenamed("node", "at"), "carried")
        rows = rows.join(F.broadcast(carried) if carried.count() <= BROADCAST_ALIASES else carried, F.col("alias") == F.col("at"), "left")
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("own", "carried", F.lit("allow")).alias("verdict"), "carried")
