"""URL filters: host and path rules, with decisions carried over redirects and canonical links.

Everything is DataFrame code. Pages and the addresses that they name as redirects or canonical are nodes; a
component in which a rule blocks a page, and none allows one, is blocked as a whole. A page's own rule, allow above
all, always stands before what it inherits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, unused

# The named character references that addresses in attributes commonly bear, the ampersand last.
ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _without_dots(path: Column) -> Column:
    """A path without its . and .. segments."""
    parts = F.split(path, "/")
    walked = F.aggregate(F.slice(parts, 2, 1 << 30), F.array().cast("array<string>"), lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))))
    # A path that ends in such a segment names a folder.
    whole = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    return F.concat(F.lit("/"), F.array_join(whole, "/"))


def with_nodes(df: DataFrame, url_col: str, node_col: str) -> DataFrame:
    """df with numbers for the addresses in url_col: of host without the usual ports, path without dot segments, and query, without scheme and fragment.

    Null where there is no address: null urls and those without :// are no nodes. Steps are projections of their own,
    so that nothing is computed or compiled twice.
    """
    url, (h, p, q) = F.col(url_col), unused(df, "_host", "_path", "_query")
    t = df.withColumns({h: F.regexp_replace(host_of(url), ":(80|443)$", ""), p: path_of(url), q: F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)})
    t = t.withColumn(p, F.when(F.col(p) == "", "/").when(F.col(p).startswith("/") & F.col(p).contains("/."), _without_dots(F.col(p))).otherwise(F.col(p)))
    return t.withColumn(node_col, F.when(url.contains("://"), F.xxhash64(h, p, q))).drop(h, p, q)


def resolve(df: DataFrame, base_col: str, to_col: str, out_col: str) -> DataFrame:
    """df with the address that a reference names on a page at base, as RFC 3986 has it; null for other schemes and without a base.

    Dot segments stay: they go where nodes are made. A reference to a place on the same page gives the page.
    """
    base, to = F.col(base_col), F.col(to_col)
    scheme, host, path, own, site = unused(df, "_scheme", "_host", "_path", "_own", "_site")
    t = df.withColumns({scheme: F.regexp_extract(base, r"(?s)^(.*?)://", 1), host: F.regexp_extract(base, r"(?s)^.*?://([^/?#]*)", 1), path: path_of(base), own: F.regexp_extract(to, r"^([A-Za-z][A-Za-z0-9+.-]*:(?://)?)", 1)})
    t = t.withColumn(site, F.when(base.contains("://"), F.concat(scheme, F.lit("://"), host)))
    folder = F.when(F.col(path) == "", "/").otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    full = (
        F.when(F.col(own).endswith("//"), to).when(F.col(own) != "", F.lit(None)).when(F.col(site).isNull(), F.lit(None))
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to)).when(to.startswith("/"), F.concat(site, to)).when(to.startswith("?"), F.concat(site, path, to))
        .when((to == "") | to.startswith("#"), base).otherwise(F.concat(site, folder, to))
    )
    return t.withColumn(out_col, full).drop(scheme, host, path, own, site)


def _attribute(tag: Column, name: str, inner: str = "") -> Column:
    """An attribute's value (what follows `inner` in it), with character references decoded; empty where there is none."""
    head = rf"""(?is)[\s"'/]{name}\s*=\s*"""
    if inner:
        raw = F.regexp_extract(tag, head + rf"""["']?[^"'>]*?\b{inner}\s*=\s*["']?\s*([^"'\s>]*)""", 1)
    else:
        quoted = [F.regexp_extract(tag, head + rf"{q}\s*([^{q}>]*?)\s*{q}", 1) for q in "\"'"]
        raw = F.when(quoted[0] != "", quoted[0]).when(quoted[1] != "", quoted[1]).otherwise(F.regexp_extract(tag, head + r"""([^"'\s>]+)""", 1))
    for sign, plain in ENTITIES:
        raw = F.replace(raw, F.lit(sign), F.lit(plain))
    return raw


def page_edges(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (from_url, to_url) from canonical links and refreshes in pages, relative addresses resolved against the page's.

    Pages without html give none, nor do pages without an address but for links that name a whole one; base elements
    aren't looked at. Repeated rows give repeated edges.
    """
    tags = F.expr(f"regexp_extract_all(`{html_col}`, '(?is)<(?:link|meta)\\\\b[^>]*>', 0)")
    tag = df.where(F.col(html_col).rlike("(?i)canonical|http-equiv")).select(F.col(url_col).alias("from_url"), F.explode(tags).alias("tag"))
    canonical = F.when(F.col("tag").rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?\s*canonical"""), _attribute(F.col("tag"), "href"))
    refresh = F.when(F.col("tag").rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?\s*refresh"""), _attribute(F.col("tag"), "content", "url"))
    found = tag.select("from_url", F.coalesce(canonical, refresh).alias("to")).where("to <> ''")
    return resolve(found, "from_url", "to", "to_url").select("from_url", "to_url").where("to_url is not null")


def match_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (verdict, host, path) that fits; ties go to allow. Null if none fits."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def with_rules(df: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, compiled: int = 64) -> DataFrame:
    """df (host, path, ...) with own: struct(rule, verdict) of the longest rule that fits, as match_rules has it.

    Up to `compiled` rules are one expression. A longer list, or a table (verdict, host, path), is joined: a host is looked
    up under each of its suffixes, so rules are as many as they like, and the longest of those whose path begins the
    page's is taken for each host and path once.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= compiled:
            return df.withColumn("own", match_rules(F.col("host"), F.col("path"), rules))
        rules = df.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    table = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "verdict").where("suffix is not null and start is not null")
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    places = df.select("host", "path").distinct()
    met = places.withColumn("suffix", F.explode(suffixes)).join(table, "suffix").where(F.col("path").startswith(F.col("start")))
    rank = F.struct((F.length("suffix") + F.length("start")).alias("n"), (F.col("verdict") == "allow").alias("allow"), F.concat("suffix", "start").alias("rule"), "verdict")
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", F.struct("best.rule", "best.verdict").alias("own"))
    return df.join(best, ["host", "path"], "left")


def filter_urls(df: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    rules: (verdict, host, path) in a list, or a table of such columns of any size. Without a rule of its own a page is blocked if its component holds a blocked page and no allowed one, else
    allowed. redirects: further edges (from_url, to_url). Null urls, and those without ://, have an empty host and
    path and belong to no component; repeated rows get equal verdicts; null html has no links; an empty table gives
    none. Other columns of df aren't looked at.
    """
    own = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    own = with_nodes(with_rules(own, rules), "url", "node")
    parts = [page_edges(df, url_col, html_col)] if html_col else []
    parts += [redirects.select("from_url", "to_url")] if redirects is not None else []
    out = own.select("page_id", "host", "path", "node", F.col("own.rule").alias("rule"), F.col("own.verdict").alias("ruled"))
    edges = None
    for part in parts:
        edges = part if edges is None else edges.unionByName(part)
    inherited = F.lit(None).cast("string")
    if edges is not None:
        edges = with_nodes(with_nodes(edges, "from_url", "src"), "to_url", "dst")
        edges = materialize(edges.where("src is not null and dst is not null").select("src", "dst", "to_url"))
        if edges.head(1):
            label = connected_components(edges.select("src", "dst"))
            # Targets count even where no page of theirs was crawled.
            seen = own.where("node is not null").select("node", F.col("own.verdict").alias("ruled"))
            target = with_rules(edges.select(F.col("dst").alias("node"), host_of(F.col("to_url")).alias("host"), path_of(F.col("to_url")).alias("path")), rules).select("node", F.col("own.verdict").alias("ruled"))
            voted = seen.unionByName(target).where("ruled is not null").groupBy("node").agg(F.max((F.col("ruled") == "allow").cast("int")).alias("a"), F.max((F.col("ruled") == "block").cast("int")).alias("b"))
            vote = label.join(voted, "node").groupBy("label").agg(F.max("a").alias("a"), F.max("b").alias("b"))
            blocked = materialize(vote.where("a = 0 and b = 1").select("label"))
            fate = materialize(label.join(blocked, "label", "left_semi").select("node", F.lit("block").alias("inherited")))
            out, inherited = out.join(fate, "node", "left"), F.col("inherited")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", inherited, F.lit("allow")).alias("verdict"))
