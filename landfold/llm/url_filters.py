"""URL filter with redirect equivalence: a block reaches every alias of the blocked address.

Only DataFrame functions. Aliases are addresses that lead to one another by redirects (``meta refresh``) or
canonical links found in the pages, or that differ only in what a server redirects away (scheme, ``www.``, fragment,
tracking parameters, trailing slash).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landfold.llm.common import written
from landfold.llm.components import connected_components
from landfold.tables import joined_by_hot_key

#: (action, host, path)
Rule = tuple[str, str, str]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """One string for all addresses that a server sends to the same place; null for what has no host."""
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda x: ~x.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)") & (x != ""))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as struct(length, rule, action), or null. The rule list is a parameter, not data."""
    if not rules:
        return F.lit(None).cast("struct<length:int,rule:string,action:string>")
    found = [
        F.when(
            ((host == F.lit(h)) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(action).alias("action")),
        )
        for action, h, p in rules
    ]
    return F.array_max(F.array_compact(F.array(*found)))


#: Character references that addresses are written with.
REFERENCES = [("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&#47;", "/"), ("&#x2f;", "/"), ("&#x2F;", "/"), ("&#58;", ":"), ("&#x3a;", ":"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&")]


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` parts resolved; what would lead above the root is dropped."""
    parts = F.split(path, "/")
    empty = F.array().cast("array<string>")
    step = lambda kept, x: F.when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.least(F.size(kept), F.lit(1))))).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate(parts, empty, step)
    ended = F.element_at(parts, -1).isin(".", "..")
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.concat(F.array_join(kept, "/"), F.when(ended, F.lit("/")).otherwise(""))).otherwise(path)


def with_targets(links: DataFrame) -> DataFrame:
    """links(url, href) with ``target``: the address that ``href`` names in the page at ``url``.

    Null for a null or empty one, a fragment, and an address of another scheme without a host. Each step is a column
    of its own, so that no expression is repeated inside the next.
    """
    href = F.trim("href")
    for written, meant in REFERENCES:
        href = F.replace(href, F.lit(written), F.lit(meant))
    rows = links.select("url", "href", href.alias("_href"))
    rows = rows.select(
        "url", "href", "_href",
        F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1).alias("_site"), F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("_own"),
        F.regexp_extract("_href", r"(?s)^([^?#]*)", 1).alias("_path"), F.regexp_extract("_href", r"(?s)^[^?#]*(.*)$", 1).alias("_rest"),
    )
    folder = F.regexp_extract("_own", r"(?s)^(.*/)", 1)
    full = F.when(F.col("_path").startswith("/"), F.col("_path")).when(folder != "", F.concat(folder, "_path")).otherwise(F.concat(F.lit("/"), "_path"))
    rows = rows.withColumn("_full", full)
    rows = rows.withColumn("_full", _without_dots(F.col("_full")))
    href = F.col("_href")
    target = (
        F.when((href == "") | href.startswith("#"), None)
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract("_site", r"(?s)^(.*?:)//", 1), href))
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(href.startswith("?"), F.concat("_site", "_own", href))
        .otherwise(F.concat("_site", "_full", "_rest"))
    )
    return rows.select("url", "href", target.alias("target"))


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target): redirects and canonical links that the pages state themselves, outside comments and scripts.

    Null pages and null urls state none; a page that repeats states its links again; a page of any length is read whole.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    seen = F.regexp_replace(html, r"(?is)<!--(?:.*?-->|.*+)|<(script|style)\b[^<>]*+>(?:.*?</\1\b|.*+)", "")
    tags = F.regexp_extract_all(seen, F.lit(r"(?i)<(?:link|meta)\b[^<>]*+>"), F.lit(0))
    tags = F.when(html.rlike(r"(?i)canonical|http-equiv"), tags).otherwise(F.array().cast("array<string>"))
    value = lambda name: F.coalesce(
        F.nullif(F.regexp_extract("tag", rf"""(?i)\b{name}\s*+=\s*+"([^"]*+)\"""", 1), F.lit("")), F.nullif(F.regexp_extract("tag", rf"""(?i)\b{name}\s*+=\s*+'([^']*+)'""", 1), F.lit("")), F.regexp_extract("tag", rf"""(?i)\b{name}\s*+=\s*+([^"'\s>]++)""", 1)
    )
    said = pages.where(F.col("url").isNotNull()).select("url", F.explode(tags).alias("tag"))
    said = said.select("url", *(value(name).alias(name.replace("-", "_")) for name in ("rel", "href", "http-equiv", "content")))
    canonical = F.when(F.array_contains(F.split(F.lower("rel"), r"\s+"), "canonical"), F.col("href"))
    refresh = F.when(F.lower(F.trim("http_equiv")) == "refresh", F.regexp_extract("content", r"""(?i)^[^;,]*+[;,]\s*+url\s*+=\s*+["']?([^"']*+)""", 1))
    links = said.select("url", F.coalesce(canonical, refresh).alias("href")).where("href is not null")
    return with_targets(links).where("target is not null").select("url", "target")


def judge_urls(urls: DataFrame, links: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """urls with ``host, path, rule, verdict``.

    An address's own longest rule decides. Without one it is blocked if any alias of it is blocked by a rule (also
    an alias that is only a link's target), else allowed. So an explicit allow takes precedence over a block that
    comes through aliases. Null or host-less urls have no aliases and are allowed. Repeated rows get equal verdicts;
    other columns are kept, and columns of these four names are replaced. Links with a null end are ignored.
    """
    links = written(links.select("url", "target"), "links")  # read three times below; pages are read for it once
    ours = urls.drop("host", "path", "rule", "verdict")
    judged = ours.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url")), "_alias": alias_key(F.col("url"))})
    judged = judged.withColumn("_best", best_rule(F.col("host"), F.col("path"), rules))
    ends = links.select(F.explode(F.array("url", "target")).alias("end")).where("end is not null").distinct()
    ends = ends.select("end", url_host(F.col("end")).alias("host"), url_path(F.col("end")).alias("path"))
    best = best_rule(F.col("host"), F.col("path"), rules)
    blocked = (
        judged.where("_best.action = 'block'")
        .select("_alias")
        .union(ends.where(best["action"] == "block").select(alias_key(F.col("end"))))
        .where("_alias is not null")
        .distinct()
    )
    groups = connected_components(links.select(alias_key(F.col("url")).alias("a"), alias_key(F.col("target")).alias("b")), native=True)
    reached = blocked.join(groups, blocked["_alias"] == groups["node"], "left").select("_alias", "component")
    hit = reached.where("component is not null").select("component").distinct()
    reached = reached.select("_alias").union(groups.join(hit, "component", "left_semi").select("node")).distinct()
    # rows without host have no alias, and one address may have very many: neither gathers in a task
    many = judged.groupBy("_alias").agg(F.count(F.lit(1)).alias("n"))
    return (
        joined_by_hot_key(judged, reached.withColumn("_reached", F.lit(True)), "_alias", F.struct(*(c for c, t in ours.dtypes if "map<" not in t)), many, "left")
        .withColumn("rule", F.col("_best.rule"))
        .withColumn("verdict", F.coalesce("_best.action", F.when(F.col("_reached"), F.lit("block")), F.lit("allow")))
        .drop("_alias", "_best", "_reached")
    )
