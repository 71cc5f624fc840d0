"""URL filters with redirect equivalence (operator 5).

Urls that lead to one resource share a decision. A url is linked to its canonical form (no
scheme, fragment, tracking parameters or last slash), and pages link their own form to those
named by ``<link rel="canonical">`` and by a refresh to another url. Relative targets are resolved
against the page's ``<base href>`` or else its url. Decisions of the rules go to every alias in
the same connected component: an explicit allow comes before a block, and a page's own rule
before both.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, no
alias, and is allowed; null html has no links; repeated rows give a row each; of rules of equal
length an allowing one wins, then the first by name; an empty table gives an empty result. Other
columns are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.components import components
from palisade.session import materialize

ALLOW, BLOCK = "allow", "block"

#: Rules (host and path) of the registered query.
RULES = {"org/": ALLOW, "example.org/es/": BLOCK, "example.org/en/1": BLOCK, "com/fr/": ALLOW,
         "com/de/": BLOCK}

TRACKING = "utm_[a-z]+|ref|fbclid|gclid"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The url in a canonical link or refresh of a page, whichever order its attributes have. The first
#: ``href=`` or ``url=`` counts, since a url may hold another.
_LINKS = (
    r'(?is)<link\b(?=[^>]*\brel\s*=\s*["\x27]?canonical\b)[^>]*?(?<![\w-])href\s*=\s*["\x27]?'
    r'([^"\x27\s>]+)',
    r'(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["\x27]?refresh\b)[^>]*?(?<![\w-])url\s*=\s*["\x27]?'
    r'([^"\x27\s>]+)',
)
_BASE = r'(?is)<base\b[^>]*?(?<![\w-])href\s*=\s*["\x27]?([^"\x27\s>]+)'


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    """The query with its question mark; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def canonical(url: Column, host: Column, path: Column) -> Column:
    """The form that all spellings of a url share; null where there is no host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"),
                    lambda p: (p != "") & ~p.rlike(f"^(?:{TRACKING})(?:=|$)"))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&")))
    form = F.concat(host, F.regexp_replace(path, "/$", ""), F.coalesce(tail, F.lit("")))
    return F.when(host != "", form)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits a url."""
    def fits(rule: str) -> Column:
        own, slash, rest = rule.partition("/")
        return ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)

    order = sorted(rules, key=lambda r: (-len(r), rules[r] != ALLOW, r))
    return F.coalesce(*[F.when(fits(r), F.lit(r)) for r in order], F.lit(None).cast("string"))


def verdict_of(rule: Column, rules: dict[str, str]) -> Column:
    return reduce(lambda c, r: c.when(rule == r, F.lit(rules[r])), sorted(rules)[1:],
                  F.when(rule == sorted(rules)[0], F.lit(rules[sorted(rules)[0]])))


def without_dots(path: Column) -> Column:
    """A path that starts with a slash, without its ``.`` and ``..`` segments."""
    def onward(out: Column, part: Column) -> Column:
        up = F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))
        return F.when(part == ".", out).when(part == "..", up).otherwise(
            F.concat(out, F.array(part)))

    # A path that ends in a dot segment names the folder.
    parts = F.split(F.substr(F.regexp_replace(path, r"/(\.\.?)$", "/$1/"), F.lit(2)), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), onward)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolved(target: Column, host: Column, path: Column, query: Column) -> Column:
    """The url that ``target`` names on a page of this host, path and query (with its ``?``)."""
    own = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    rest = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), "[^/]*$", "")
    site = F.concat(F.lit("http://"), host)
    return (F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), target)
            .when(target.startswith("//"), F.concat(F.lit("http:"), target))
            .when(target.startswith("/"), F.concat(site, without_dots(own), rest))
            .when(own != "", F.concat(site, without_dots(F.concat(folder, own)), rest))
            .when(target.startswith("?"), F.concat(site, path, rest))
            .otherwise(F.concat(site, path, query, rest)))


def links_of(pages: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) between canonical forms from canonical tags and refreshes."""
    found = pages.where(F.col("form").isNotNull()).select(
        "form", "host", "path", "query", "html", F.concat(*[
            F.regexp_extract_all("html", F.lit(p), 1) for p in _LINKS]).alias("targets"))
    found = found.where(F.size("targets") > 0).withColumn(
        "base", F.regexp_extract("html", _BASE, 1)).drop("html")
    page = [F.col(c) for c in ("host", "path", "query")]
    # A base without a host (data:, mailto:) is none; an empty one is the page's own url.
    found = found.withColumn("base", resolved(F.col("base"), *page))
    base, based = F.col("base"), host_of(F.col("base")) != ""
    found = found.select(
        "form", F.when(based, host_of(base)).otherwise(page[0]).alias("host"),
        F.when(based, path_of(base)).otherwise(page[1]).alias("path"),
        F.when(based, query_of(base)).otherwise(page[2]).alias("query"),
        F.explode("targets").alias("target"))
    found = found.select("form", resolved(F.col("target"), *page).alias("target"))
    target = F.col("target")
    return found.select(F.col("form").alias("a"),
                        canonical(target, host_of(target), path_of(target)).alias("b"))


def judged(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """Host, path, rule, verdict and alias group of every page.

    Only canonical forms that a tag or refresh links go through the component search. The
    decisions of a group are two flags, gathered before rows are moved and written, one row per
    group; so the adaptive skew join can cut the pages of a hot group.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"),
                        url.alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules)
                       .alias("rule"), canonical(F.col("url"), F.col("host"), F.col("path"))
                       .alias("form"), query_of(F.col("url")).alias("query"), "html")
    groups = components(links_of(rows))
    rows = rows.select("page_id", "host", "path", "rule", "form")
    tagged = materialize(rows.join(groups, rows["form"] == groups["node"], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("component", "form").alias("alias_group")), "pages")
    own = verdict_of(F.col("rule"), rules)
    decided = materialize(tagged.where(
        F.col("rule").isNotNull() & F.col("alias_group").isNotNull()).groupBy(
        F.col("alias_group").alias("g")).agg(F.bool_or(own == ALLOW).alias("allowed"),
                                             F.bool_or(own == BLOCK).alias("blocked")), "decided")
    both = tagged.join(decided, tagged["alias_group"] == decided["g"], "left")
    inherited = F.when(F.col("allowed"), F.lit(ALLOW)).when(
        F.col("blocked"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return both.select("page_id", "host", "path", "rule",
                       F.coalesce(own, inherited).alias("verdict"), "alias_group")
