"""URL rules whose block decisions reach the aliases of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridegrid.llm.common import small, staged
from stridegrid.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that a plan may hold as literals.
MOST_RULES = 1_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, query, fragment or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a query, fragment or the end; empty without host part."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The resource a url names: host, path and query; scheme and fragment do not tell resources apart."""
    query = F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1)
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    return F.when(host_of(url) != "", F.concat(host_of(url), path, query))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule ``host/path`` that fits the host or a parent domain and the path.

    Of rules of one length an allow goes before a block. No rules: null. Above
    ``MOST_RULES`` rules take ``with_rule``, which joins them as a table.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules are a table: use with_rule")
    if not rules:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    held = F.array(
        *(
            F.struct(
                F.lit(len(rule)).alias("size"),
                F.lit(verdict == "allow").alias("allows"),
                F.lit(rule).alias("rule"),
                F.lit(verdict).alias("verdict"),
                F.lit(f".{rule.partition('/')[0]}").alias("domain"),
                F.lit(f"/{rule.partition('/')[2]}").alias("start"),
            )
            for verdict, rule in rules
        )
    )
    dotted = F.concat(F.lit("."), host)
    best = F.array_max(F.filter(held, lambda r: dotted.endswith(r["domain"]) & path.startswith(r["start"])))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def with_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path, …) with ``r``, as ``rule_for`` has it, for a table of rules (verdict, rule) of any length.

    Distinct urls meet the domains that have rules by the suffixes of their
    host, then the rules themselves by domain and path prefix; only prefixes of
    the lengths of the domain's rules are made. Rules without text or verdict
    fit nothing; repeated rules count once.
    """
    held = rules.where("rule IS NOT NULL AND verdict IS NOT NULL").select(
        F.concat(F.lit("."), F.substring_index("rule", "/", 1)).alias("domain"),
        F.expr("CASE WHEN contains(rule, '/') THEN substring(rule, locate('/', rule)) ELSE '/' END").alias("start"),
        F.struct(
            F.char_length("rule").alias("size"), (F.col("verdict") == "allow").alias("allows"), "rule", "verdict"
        ).alias("best"),
    )
    held = staged(held.groupBy("domain", "start").agg(F.max("best").alias("best")), "rules")
    lengths = held.groupBy("domain").agg(F.collect_set(F.char_length("start")).alias("lengths"))
    seen = urls.select("host", "path").where("host <> ''").distinct()
    suffixes = F.expr(
        "transform(sequence(1, size(split(host, '[.]'))), i -> concat('.', substring_index(host, '.', -i)))"
    )
    met = seen.select("host", "path", F.explode(suffixes).alias("domain"))
    met = met.join(lengths, "domain").select(
        "host", "path", "domain", F.explode(F.filter("lengths", lambda n: n <= F.char_length("path"))).alias("n")
    )
    met = met.select("host", "path", "domain", F.expr("substring(path, 1, n)").alias("start")).join(held, ["domain", "start"])
    best = met.groupBy(F.col("host").alias("_h"), F.col("path").alias("_p")).agg(F.max("best").alias("best"))
    out = urls.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    found = F.when(F.col("best").isNotNull(), F.struct(F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")))
    return out.withColumn("r", found).drop("best", "_h", "_p")


def _resolved(target: Column, host: Column, path: Column) -> Column:
    """An absolute form of a link target found on the page with this host and path."""
    origin = F.concat(F.lit("http://"), host)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"^/(.*/)?[^/]*$", 1))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("#") | target.startswith("?"), F.concat(origin, path, target))
        .otherwise(F.concat(origin, folder, target))
    )


def alias_edges(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): resources tied by a canonical link or an immediate redirect (meta refresh after 0 seconds) of a page.

    All such elements count, but not those in comments and scripts.
    """
    plain = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<script\b.*?</script\b[^>]*>", " ")
    held = pages.where(F.col(html).rlike(r"(?i)canonical|refresh")).select(F.col(url).alias("u"), plain.alias("x"))
    links = F.regexp_extract_all("x", F.lit(r"""(?is)(<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>)"""), 1)
    metas = F.regexp_extract_all("x", F.lit(r"""(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>)"""), 1)
    href = r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
    jump = r"""(?is)\bcontent\s*=\s*["']?\s*(?:0+(?:\.0*)?|\.0+)[\s;,]+url\s*=\s*["']?\s*([^"'\s>;]+)"""
    targets = F.concat(
        F.transform(links, lambda e: F.regexp_extract(e, href, 1)), F.transform(metas, lambda e: F.regexp_extract(e, jump, 1))
    )
    found = held.select("u", F.explode(targets).alias("t")).where("t <> ''")
    found = found.select(
        host_of(F.col("u")).alias("h"),
        path_of(F.col("u")).alias("p"),
        node_of(F.col("u")).alias("a"),
        F.regexp_replace("t", "&amp;", "&").alias("t"),
    )
    found = found.select("a", _resolved(F.col("t"), F.col("h"), F.col("p")).alias("t"))
    return found.select("a", node_of(F.col("t")).alias("b"))


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]] | DataFrame,
    *,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    edges: DataFrame | None = None,
) -> DataFrame:
    """Allow or block every page url: its own rule, else what its aliases say, else allow.

    ``rules`` are (verdict, ``host/path``), as a list or a table (verdict,
    rule); above ``MOST_RULES`` a list is made a table, which is joined. No
    rules: all is allowed. Of rules of one length an allow goes first. Urls tied by redirects and
    canonical links, taken from the pages or given as ``edges`` (a, b), form
    components. A page without rule is blocked if a rule blocks any member of
    its component and none allows one: an explicit allow goes before a
    propagated block, and a page's own rule before both.

    Returns key, url, host, path, rule, verdict and ``component`` (the least
    resource of the component, null for a page without alias). Null urls and
    urls without ``://`` have empty host and path and fit no rule; repeated
    rows are judged each; other columns are not read.
    """
    own = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"))
    own = own.select(
        "_key",
        "_url",
        host_of(F.col("_url")).alias("host"),
        path_of(F.col("_url")).alias("path"),
        node_of(F.col("_url")).alias("node"),
    )
    if not isinstance(rules, DataFrame) and len(rules) > MOST_RULES:
        rules = staged(pages.sparkSession.createDataFrame(rules, "verdict string, rule string"), "rule-list")

    def ruled(urls: DataFrame) -> DataFrame:
        if isinstance(rules, DataFrame):
            return with_rule(urls, rules)
        return urls.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))

    own = ruled(own)
    if edges is None:
        edges = alias_edges(pages, url=url, html=html)
    groups = components(edges)
    at = F.concat(F.lit("http://"), F.col("node"))
    said = ruled(groups.select("component", host_of(at).alias("host"), path_of(at).alias("path")))
    verdicts = said.select("component", F.col("r.verdict").alias("r")).groupBy("component").agg(
        F.when(F.bool_or(F.col("r") == "allow"), "allow").when(F.bool_or(F.col("r") == "block"), "block").alias("said")
    )
    told = staged(groups.join(verdicts, "component"), "aliases")
    out = own.join(small(told), "node", "left")
    return out.select(
        F.col("_key").alias(key),
        F.col("_url").alias(url),
        "host",
        "path",
        F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), F.col("said"), F.lit("allow")).alias("verdict"),
        "component",
    )
