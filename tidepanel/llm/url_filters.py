"""URL filters: rules behind an index of their rarest literal tokens.

Two kinds of rules judge a url.  Site rules (host, path) fit a host with its
subdomains and a beginning of the path; of several the longest wins (then the one
with the longer host, then the greater text).  Where none fits, pattern rules
decide: a pattern blocks, one that starts with ``@@`` excepts from blocking, and a
url that nothing blocks is allowed.  In patterns ``*`` stands for anything, ``^``
for a separator or the end, ``|`` for the beginning or end, ``||`` for a host or a
subdomain of it; after ``re:`` comes a regular expression.  Patterns look at the
whole url, A-Z lower-cased.

Every rule becomes a regular expression.  A token is a run of a-z and 0-9; a
rule's own tokens are those of its literal text that no wildcard can lengthen, so
a url that the rule matches has them all.  The tokens' numbers of urls are counted
over the whole table, and each rule is filed under its rarest token.  A url
fetches the rules filed under its tokens and runs only their expressions, and
those of the few rules without a token.  The index is as large as the rule list:
up to ``shipped`` rules it goes to the tasks, which then read urls without a
shuffle; beyond, distinct urls are joined to the rules by token.

A null url, or one without ``://``, has an empty host and path and fits no site
rule; patterns still see the latter.  Null and repeated page_ids are kept row by
row, an empty table gives no rows, other columns are ignored, urls are read whole.
"""

from __future__ import annotations

import re
import string
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Site rules (fixed by the query's contract).
SITES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Pattern rules of this filter's own, for advertising, trackers, spam, adult and gambling sites, downloads and pages without prose.
PATTERNS = (
    "||cheap-pills.", "||spam-farm.", "-pills.", "-casino.", ".casino.", "||casino-*.", "-poker.", "||free-money.", "||get-rich-*.", "||win-prize*.", "-viagra.", "||buy-viagra*.", "||payday-loans.", "-payday-",
    "||xxx.", ".xxx/", ".xxx^", "||porn.", "-porn-", "||adult-*.", "-escorts.", "||hot-singles.", "||link-farm.", "-link-farm.", "||seo-links.", "||essay-mill.", "||replica-watches.", "||warez.", "-warez.", "||torrent.", "-torrents.",
    "||ads.", "||ads-", "||ad.", "||adserver.", "||adservice.", "||banner.", "||banners.", "||track.", "||tracker.", "||tracking.", "||pixel.", "||beacon.", "||stats.", "||metrics.", "||telemetry.", "||clicks.", "||affiliate.",
    "/ads/", "/adserver/", "/banner/", "/banners/", "/popup/", "/popunder/", "/sponsored/", "/affiliate/", "/tracking/", "/pixel.gif", "/beacon.js", "/analytics.js", "/clicktrack?", "?clickid=", "&clickid=", "?affid=", "&affid=", "?gclid=", "&gclid=",
    "/cgi-bin/", "/wp-admin/", "/wp-login.php", "/admin/login", "/login?", "/signin?", "/logout^", "/cart^", "/checkout^", "/basket^", "/unsubscribe^", "/captcha^", "/trackback/", "/xmlrpc.php", "?replytocom=", "&replytocom=", "?sessionid=", "&sessionid=", "?phpsessid=", "&phpsessid=",
    ".exe|", ".msi|", ".apk|", ".dmg|", ".iso|", ".zip|", ".rar|", ".7z|", ".tar.gz|", ".mp3|", ".mp4|", ".avi|", ".jpg|", ".jpeg|", ".png|", ".gif|", ".svg|", ".css|", ".js|", ".woff|", ".woff2|",
    "/calendar/*/calendar/", "/page/*/page/", "/tag/*/tag/", "re:^[a-z]+://[0-9]{1,3}(?:[.][0-9]{1,3}){3}[:/]", "re:^data:", "re:^javascript:", "|ftp://*.bin|", "re:[?&][a-z]+=[0-9a-f]{64}", "||xn--*.casino^",
    "@@/robots.txt|", "@@||stats.*/docs/", "@@/wiki/*.svg|", "@@||metrics.*/handbook/", "@@/licenses/*.zip|",
)

#: A rule list of up to so many rules is shipped to the tasks.
SHIPPED = 200_000

TOKEN = "[a-z0-9]+"
#: Stands for the end of the url until an engine's own sign for it is put in: \\Z in Python, \\z elsewhere.
END = "\ue000"
_SEPARATOR, _HOST = f"(?:[^a-z0-9_.%-]|{END})", r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"


@dataclass(frozen=True)
class Rule:
    """A rule as an expression; it looks at host and path (site) or at the lower-cased url."""

    text: str
    verdict: str  # block, allow
    site: bool
    expression: str
    tokens: tuple[str, ...]
    size: tuple[int, int] = (0, 0)  # of a site rule: length, length of the host


def site_rule(verdict: str, host: str, path: str) -> Rule:
    text = host + path
    tokens = re.findall(TOKEN, lower(host)) + [m[0] for m in re.finditer(TOKEN, lower(path)) if m.end() < len(path)]
    return Rule(text, verdict, True, r"^(?:[^/]*\.)?" + re.escape(text), tuple(dict.fromkeys(tokens)), (len(text), len(host)))


def pattern_rule(text: str) -> Rule:
    verdict, body = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
    if body.startswith("re:"):
        return Rule(text, verdict, False, body[3:], ())
    expression, inner, left, right = "", body, "*", "*"
    if inner.startswith("||"):
        expression, inner, left = _HOST, inner[2:], "|"
    elif inner.startswith("|"):
        expression, inner, left = "^", inner[1:], "|"
    if inner.endswith("|"):
        inner, right = inner[:-1], "|"
    for c in inner:
        expression += {"*": ".*", "^": _SEPARATOR}.get(c) or re.escape(c)
    around = left + inner + right
    tokens = [m[0] for m in re.finditer(TOKEN, around) if "*" not in (around[m.start() - 1], around[m.end()])]
    return Rule(text, verdict, False, expression + (END if right == "|" else ""), tuple(dict.fromkeys(tokens)))


def rules(sites: Sequence[tuple[str, str, str]] = SITES, patterns: Sequence[str] = PATTERNS) -> list[Rule]:
    return [site_rule(*s) for s in sites] + [pattern_rule(p) for p in patterns]


def lower(text: str) -> str:
    return text.translate(_LOWER)


_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, and the url lower-cased."""
    part = lambda k: F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    low = lambda c: F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    url = F.col("url").cast("string").alias("url")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url).select("page_id", "url", low(part(1)).alias("host"), part(2).alias("path"), low(F.coalesce("url", F.lit(""))).alias("lowered"))


def _tokens() -> Column:
    return F.array_distinct(F.regexp_extract_all("lowered", F.lit(TOKEN), F.lit(0)))


def filed(urls: DataFrame, found: list[Rule]) -> list[str | None]:
    """The rarest token of each rule (of equal ones the first by name); None for rules without one."""
    spark, own = urls.sparkSession, sorted({t for r in found for t in r.tokens})
    if not own:
        return [None] * len(found)
    names = spark.createDataFrame([(t,) for t in own], "token string")
    names = F.broadcast(names) if len(own) <= SHIPPED else names  # else tokens would be dealt by name before they are counted
    counts = urls.select(F.explode(_tokens()).alias("token")).join(names, "token", "left_semi").groupBy("token").count()
    count = dict(map(tuple, counts.collect()))  # one row a token of the rule list at most
    return [min(r.tokens, key=lambda t: (count.get(t, 0), t)) if r.tokens else None for r in found]


def decided(found: list[Rule], hits: Sequence[int]) -> tuple[str | None, str | None, str]:
    """(site rule, pattern, verdict) from the numbers of the matching rules."""
    sites = [found[k] for k in hits if found[k].site]
    if sites:
        best = max(sites, key=lambda r: (r.size, r.text))
        return best.text, None, best.verdict
    for verdict in ("allow", "block"):
        if some := [k for k in hits if found[k].verdict == verdict]:
            return None, found[min(some)].text, verdict
    return None, None, "allow"


_JUDGED = "page_id long, host string, path string, rule string, pattern string, verdict string, n_tried long"


def _shipped(found: list[Rule], tokens: list[str | None]):
    """Judge for batches of parsed urls, with the index in hand."""
    index: dict[str, list[int]] = defaultdict(list)
    always = [k for k, t in enumerate(tokens) if t is None]
    for k, t in enumerate(tokens):
        if t is not None:
            index[t].append(k)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = re.compile(TOKEN)
        expressions = [re.compile(r.expression.replace(END, r"\Z"), re.DOTALL) for r in found]
        for batch in batches:
            rows = []
            for host, path, lowered in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "lowered")), strict=True):
                tried = always + [k for t in set(words.findall(lowered)) for k in index.get(t, ())]
                site = host + path
                hits = [k for k in tried if expressions[k].search(site if found[k].site else lowered)]
                rows.append((*decided(found, hits), len(tried)))
            rule, pattern, verdict, n = zip(*rows, strict=True) if rows else ((), (), (), ())
            columns = [batch.column("page_id"), batch.column("host"), batch.column("path"), *(pa.array(x, pa.string()) for x in (rule, pattern, verdict)), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "rule", "pattern", "verdict", "n_tried"])

    return judge


def _joined(urls: DataFrame, found: list[Rule], tokens: list[str | None]) -> DataFrame:
    """The same by joining distinct urls to the rules by token; rules without one stand under the empty token, which every url then has."""
    fields = "number int, token string, site boolean, expression string, block boolean, text string, size int, host_size int"
    listed = urls.sparkSession.createDataFrame([(k, t or "", r.site, "(?s)" + r.expression.replace(END, r"\z"), r.verdict == "block", r.text, *r.size) for k, (r, t) in enumerate(zip(found, tokens, strict=True))], fields)
    own = F.concat(F.array(F.lit("")), _tokens()) if None in tokens else _tokens()
    distinct = urls.select("host", "path", "lowered").distinct()
    tried = distinct.withColumn("token", F.explode(own)).join(listed, "token")
    hit = F.expr("regexp_like(if(site, concat(host, path), lowered), expression)")
    best = F.max(F.when(hit & F.col("site"), F.struct("size", "host_size", "text", "block")))
    first = lambda block: F.min(F.when(hit & ~F.col("site") & (F.col("block") == block), F.struct("number", "text")))
    found_for = tried.groupBy("host", "path", "lowered").agg(best.alias("best"), first(False).alias("excepting"), first(True).alias("blocking"), F.count("*").alias("n_tried"))
    judged = urls.join(found_for, ["host", "path", "lowered"], "left")
    deciding = F.when(F.col("best").isNull(), F.coalesce("excepting", "blocking"))
    block = F.coalesce(F.col("best.block"), F.col("excepting").isNull() & F.col("blocking").isNotNull())
    return judged.select("page_id", "host", "path", F.col("best.text").alias("rule"), deciding["text"].alias("pattern"), F.when(block, "block").otherwise("allow").alias("verdict"), F.coalesce("n_tried", F.lit(0)).alias("n_tried"))


def judge(pages: DataFrame, found: list[Rule] | None = None, shipped: int = SHIPPED) -> DataFrame:
    """page_id, host, path, the site rule or pattern that decided, verdict, and the number of expressions run, for every row of pages(page_id, url)."""
    found = rules() if found is None else found
    urls = parsed(pages)
    tokens = filed(urls, found)
    urls = urls.drop("url")
    return urls.mapInArrow(_shipped(found, tokens), _JUDGED) if len(found) <= shipped else _joined(urls, found, tokens)


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("n_tried")


def _sql() -> str:
    """Every expression on every url."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = ", ".join(f"({k}, {quoted(r.text)}, {quoted('(?s)' + r.expression.replace(END, chr(92) + 'z'))}, {r.verdict == 'block'})" for k, r in enumerate(rules()) if not r.site)
    sites = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in SITES)
    low = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
    WITH sites(verdict, h, p) AS (VALUES {sites}), patterns(number, text, expression, block) AS (VALUES {listed}),
    cut AS (SELECT row_number() OVER () AS i, page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
    hosts AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
    parts AS (SELECT i, page_id, {low.format('url')} AS lowered, {low.format('raw')} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
    fits AS (
        SELECT i, max(struct_pack(n := length(h || p), m := length(h), rule := h || p, verdict := verdict)) AS best
        FROM parts JOIN sites ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i),
    hits AS (
        SELECT i, min(struct_pack(number := number, text := text)) FILTER (NOT block) AS excepting, min(struct_pack(number := number, text := text)) FILTER (block) AS blocking
        FROM parts JOIN patterns ON regexp_matches(lowered, expression) GROUP BY i)
    SELECT page_id, host, path, best.rule AS rule, CASE WHEN best IS NULL THEN coalesce(excepting.text, blocking.text) END AS pattern,
        CASE WHEN best IS NOT NULL THEN best.verdict WHEN excepting IS NULL AND blocking IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
    FROM parts LEFT JOIN fits USING (i) LEFT JOIN hits USING (i)"""


SQL = _sql()
