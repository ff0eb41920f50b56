"""URL rules with redirect equivalence, on built-in functions only.

Explicit rules come first. Pages that no rule fits take the decision of their
alias class: URLs joined by canonical links, refresh redirects and the usual
server-side redirects between spellings of one address (scheme, ``www.``,
trailing slash, fragment, tracking parameters).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components

#: The production rules (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Query parameters that do not change the page.
TRACKING = r"(?i)(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls if none fits; of two as long ones, the allowing one."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in reversed(order):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def spelling(url: Column) -> Column:
    """The key that all spellings of one address share; null for what is no URL."""
    query = F.regexp_replace(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), TRACKING, "")
    query = F.regexp_replace(query, "^&+|&+$", "")
    p = F.regexp_replace(path(url), "/+$", "")
    key = F.concat(F.regexp_replace(host(url), r"^www\.", ""), p, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.contains("://"), key)


def resolved(base: Column, to: Column) -> Column:
    """The address that a link on page ``base`` names; null for other schemes without ``://`` and for empty links."""
    to = F.regexp_replace(F.trim(to), "&amp;", "&")
    origin = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    own, tail = path(base), F.regexp_extract(to, r"(?s)[?#].*$", 0)
    here = F.regexp_extract(to, r"(?s)^[^?#]*", 0)
    full = F.when(here.startswith("/"), here).otherwise(F.concat(F.when(own == "", F.lit("/")).otherwise(F.regexp_extract(own, r"(?s)^.*/", 0)), here))
    parts = F.split(F.when(full.rlike(r"(?s)(^|/)\.\.?$"), F.concat(full, F.lit("/"))).otherwise(full), "/")
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))
    plain = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return (
        F.when((to == "") | ~base.contains("://"), None)
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), to)
        .when(to.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), to))
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None)
        .when(here == "", F.concat(origin, own, F.when(tail.startswith("#"), F.regexp_extract(base, r"\?[^#]*", 0)).otherwise(F.lit("")), tail))
        .otherwise(F.concat(origin, plain, tail))
    )


#: Tags that may name another address of a page, what marks them, and where the address is. RE2 knows these patterns too.
TAGS = (
    (r"(?is)<link\b[^>]*>", r"(?is)\brel\s*=\s*[\"']?\s*canonical", r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"),
    (r"(?is)<meta\b[^>]*>", r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh", r"(?is)\bcontent\s*=\s*[\"'][^\"'>]*?url\s*=\s*[\"']?\s*([^\"'\s>]+)"),
)


def links(pages: DataFrame) -> DataFrame:
    """(a, b, to): spelling keys of each page and of each address that its canonical links and refresh redirects name, and that address."""
    html = F.col("html")

    def named(tag: str, mark: str, address: str) -> Column:
        marked = F.filter(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: t.rlike(mark))
        return F.transform(marked, lambda t: F.regexp_extract(t, address, 1))

    found = pages.where(html.rlike("(?i)canonical|http-equiv")).select("url", F.explode(F.concat(*[named(*t) for t in TAGS])).alias("to"))
    found = found.where("to <> ''").select("url", resolved(F.col("url"), F.col("to")).alias("to"))
    return found.select(spelling(F.col("url")).alias("a"), spelling(F.col("to")).alias("b"), "to").where("a is not null and b is not null")


def link_targets(pages: DataFrame) -> DataFrame:
    """(a, b): spelling keys of each page and of the addresses it names."""
    return links(pages).select("a", "b").where("a <> b")


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, alias_class and by (``rule``, ``alias`` or ``default``) for every page.

    A page's own rule decides. Without one, its alias class does: allow if any
    member is explicitly allowed, else block if any is blocked, else allow.
    All addresses that a page's canonical links and refresh redirects name are
    members, whether they are pages or not. Null urls and those without
    ``://`` have empty host and path, no class, and are allowed; repeated rows are judged alike, one by one; extra columns are
    ignored. A class is summed before the shuffle, so one that holds a third
    of all pages is no hot task.
    """
    url = F.col("url")
    seen = pages.select("page_id", "url", host(url).alias("host"), path(url).alias("path"), spelling(url).alias("_key"))
    rule, own = match_rule(F.col("host"), F.col("path"), rules)
    seen = seen.select("page_id", "host", "path", rule.alias("rule"), own.alias("_own"), "_key")
    comps = components(link_targets(pages.select("url", "html")))
    linked = seen.join(comps, seen["_key"] == comps["id"], "left").select(*seen.columns, F.coalesce("component", "_key").alias("alias_class"))
    named = links(pages.select("url", "html")).select("b", match_rule(host(F.col("to")), path(F.col("to")), rules)[1].alias("_own")).where("_own is not null").distinct()
    named = named.join(comps, named["b"] == comps["id"], "left").select(F.coalesce("component", "b").alias("alias_class"), "_own")
    ruled = linked.where("_own is not null and alias_class is not null").select("alias_class", "_own").unionAll(named)
    classes = ruled.groupBy(F.col("alias_class").alias("_class")).agg(F.max(F.col("_own") == "allow").alias("_allow"))
    out = linked.join(classes, F.col("alias_class") == F.col("_class"), "left")
    by_class = F.when(F.col("_allow"), "allow").when(~F.col("_allow"), "block")
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("_own", by_class, F.lit("allow")).alias("verdict"),
        "alias_class",
        F.when(F.col("_own").isNotNull(), "rule").when(F.col("_allow").isNotNull(), "alias").otherwise("default").alias("by"),
    )


def _oracle() -> str:
    """The same over DuckDB: links are read, resolved and walked to classes.

    It resolves whole, host-relative and path-relative addresses; steps like
    ``../`` are left to the tests.
    """
    parts = lambda url: (
        f"coalesce(translate(regexp_extract({url}, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')",
        f"coalesce(regexp_extract({url}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')",
        f"regexp_replace(regexp_replace(regexp_extract({url}, '\\?([^#]*)', 1, 's'), '{TRACKING[4:]}', '', 'gi'), '^&+|&+$', '', 'g')",
    )
    key = "CASE WHEN contains(url, '://') THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END"
    rule = """CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END"""
    h, p, q = parts("url")
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    tags = " UNION ALL ".join(
        f"SELECT url, regexp_extract(t, {quoted(address)}, 1) AS link FROM (SELECT url, unnest(regexp_extract_all(html, {quoted(tag)})) AS t FROM pages WHERE regexp_matches(html, '(?i)canonical|http-equiv')) WHERE regexp_matches(t, {quoted(mark)})"
        for tag, mark, address in TAGS
    )
    return f"""
WITH RECURSIVE k AS (
  SELECT *, {key} AS key, {rule} AS rule FROM (SELECT page_id, url, {h} AS host, {p} AS path, {q} AS q FROM pages)
), raw AS (
  SELECT url AS page, replace(trim(link), '&amp;', '&') AS link, regexp_extract(url, '^.*?://[^/?#]*', 0, 's') AS origin, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS own FROM ({tags}) WHERE link <> '' AND contains(url, '://')
), named AS (
  SELECT page, CASE
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.\\-]*://') THEN link
    WHEN starts_with(link, '//') THEN regexp_extract(page, '^(.*?:)//', 1, 's') || link
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN NULL
    WHEN starts_with(link, '/') THEN origin || link
    WHEN starts_with(link, '?') THEN origin || own || link
    WHEN starts_with(link, '#') THEN page
    ELSE origin || CASE WHEN own = '' THEN '/' ELSE regexp_extract(own, '^.*/', 0, 's') END || link END AS url
  FROM raw
), targets AS (
  SELECT page, url, {rule} AS rule, {key} AS key FROM (SELECT page, url, {h} AS host, {p} AS path, {q} AS q FROM named WHERE url IS NOT NULL)
), edges AS (
  SELECT DISTINCT k.key AS a, t.key AS b FROM targets t JOIN k ON k.url = t.page WHERE k.key IS NOT NULL AND t.key IS NOT NULL AND k.key <> t.key
), walk(a, b) AS (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges UNION SELECT w.a, CASE WHEN e.a = w.b THEN e.b ELSE e.a END FROM walk w JOIN edges e ON w.b IN (e.a, e.b)
), classes AS (SELECT a, min(least(a, b)) AS class FROM walk GROUP BY a
), linked AS (SELECT k.*, coalesce(classes.class, k.key) AS alias_class FROM k LEFT JOIN classes ON k.key = classes.a
), ruled AS (
  SELECT alias_class, rule FROM linked WHERE alias_class IS NOT NULL
  UNION ALL SELECT coalesce(classes.class, t.key), t.rule FROM targets t LEFT JOIN classes ON t.key = classes.a WHERE t.key IS NOT NULL
), c AS (
  SELECT alias_class, bool_or(rule IN ('example.net/en/', 'org/fr/')) AS allowed FROM ruled WHERE rule IS NOT NULL GROUP BY 1
)
SELECT l.page_id, l.host, l.path, l.rule,
  CASE WHEN l.rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN l.rule IS NOT NULL THEN 'block' WHEN c.allowed THEN 'allow' WHEN NOT c.allowed THEN 'block' ELSE 'allow' END AS verdict,
  l.alias_class,
  CASE WHEN l.rule IS NOT NULL THEN 'rule' WHEN c.allowed IS NOT NULL THEN 'alias' ELSE 'default' END AS "by"
FROM linked l LEFT JOIN c ON l.alias_class = c.alias_class
"""


ORACLE_SQL = _oracle()
