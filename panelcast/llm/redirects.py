"""URL filters with verdicts that hold for all aliases of a page.

Rules allow or block a host, its subdomains and a path prefix; the longest fitting rule decides. Redirects
(meta refresh, or a table of them) and canonical links are edges between URLs; connected components of
these edges are aliases. A URL without a rule is allowed if an alias is allowed by a rule, else blocked if
an alias is blocked by one, else allowed.

A node is a URL with scheme and host in lower case, without the fragment. Null URLs and those without ://
have an empty host and path, fit no rule, have no aliases and are allowed. Links of null or broken html
and links that aren't absolute URLs after joining count for nothing. Repeated rows get one verdict each.
"""

from __future__ import annotations

from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.components import components
from panelcast.llm.stage import keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct of rule and verdict of the longest rule that fits; of equals, one that allows. Null if none."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "allow", r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    scheme = F.translate(F.regexp_extract(url, "^([^#]*?)://", 1), UPPER, LOWER)
    after = F.regexp_extract(_rest(url), "^[^/?#]*([^#]*)", 1)
    return F.when(F.locate("://", url) > 0, F.concat(scheme, F.lit("://"), host_of(url), after))


class _Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[str] = []
        self.base = ""  # of the first base element with a link

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag == "link" and "canonical" in a.get("rel", "").lower().split() and a.get("href", "").strip():
            self.found.append(a["href"].strip())
        elif tag == "base" and not self.base:
            self.base = a.get("href", "").strip()
        elif tag == "meta" and a.get("http-equiv", "").strip().lower() == "refresh":
            _, mark, target = a.get("content", "").partition(";")
            name, _, url = target.strip().partition("=")
            if mark and name.strip().lower() == "url" and url.strip(" \t\r\n'\""):
                self.found.append(url.strip(" \t\r\n'\""))

    handle_startendtag = handle_starttag


def _join(base: str, link: str) -> str | None:
    try:
        return urljoin(base, link)
    except ValueError:  # a link that can't be read
        return None


def _targets(urls: pa.Array, pages: pa.Array) -> pa.Array:
    out = []
    for url, html in zip(urls.to_pylist(), pages, strict=True):
        parser = _Links()
        try:
            parser.feed(html.as_py())
            parser.close()
        except (AssertionError, ValueError):  # html that can't be read from here on
            pass
        base = (_join(url, parser.base) if parser.base else None) or url
        out.append([x for link in parser.found if (x := _join(base, link)) is not None])
    return pa.array(out, pa.list_(pa.string()))


def page_edges(pages: DataFrame) -> DataFrame:
    """Edges (u, v) between nodes that the pages' canonical links and refreshes state."""
    some = pages.select("url", "html").where(F.col("url").contains("://") & F.col("html").rlike("(?i)canonical|refresh"))
    targets = some.select(node_of(F.col("url")).alias("u"), F.explode(F.arrow_udf(_targets, "array<string>")("url", "html")).alias("v"))
    return targets.select("u", node_of(F.col("v")).alias("v")).where("v is not null and u <> v")


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; redirects: source and target URLs, if any."""
    edges = page_edges(pages)
    if redirects is not None:
        source, target = redirects.columns[:2]
        more = redirects.select(node_of(F.col(source)).alias("u"), node_of(F.col(target)).alias("v"))
        edges = edges.union(more.where("u is not null and v is not null"))
    found = components(edges)
    members = found.union(found.select("component", "component")).distinct()
    own = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    verdicts = members.groupBy("component").agg(F.max(own == "allow").alias("allowed"), F.max(own == "block").alias("blocked"))
    shared = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block")
    aliases = keep(members.join(verdicts, "component").select("node", shared.alias("shared")).where("shared is not null"))
    url = F.col("url")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    judged = judged.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    return judged.join(aliases, "node", "left").select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "shared", F.lit("allow")).alias("verdict")
    )
