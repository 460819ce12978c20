"""URL filters by temporal list join, in DataFrame functions only.

Dated list entries (rule, at, action, category) become validity intervals, and an as-of join evaluates each capture against the entries that
were active when it was fetched. A rule is a host name, in any case and with or without closing dots, and covers its subdomains. The most specific active rule decides.

Defined cases: a null url or one without host, and a null fetch time, match nothing and are never blocked; entries with a null rule or time are
void; of entries of one rule at one instant a ``drop`` wins; repeated captures each get their verdict; empty tables give empty results.

Verdicts are found once per distinct (host, instant), so a hot host doesn't multiply work; captures never leave with more than url and time.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.llm.common import C


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dots; null if there is none."""
    place = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")
    return F.when(host != "", host)


def suffixes(host: Column) -> Column:
    """The host and its parent domains of two labels or more (a bare label: itself)."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(rule, category, listed_at, until): when each rule was active; ``until`` is exclusive and null while it still is."""
    named = F.regexp_replace(F.lower("rule"), r"\.+$", "")
    e = entries.withColumn("rule", named).filter("rule <> '' AND at IS NOT NULL").groupBy("rule", "at").agg(F.max("action").alias("action"), F.max("category").alias("category"))
    nxt = F.lead("at").over(W.partitionBy("rule").orderBy("at"))
    return e.withColumn("until", nxt).filter("action = 'add'").select("rule", "category", C("at").alias("listed_at"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """One row per capture: its id, host, fetched_at, blocked, rule, category, listed_at."""
    caps = captures.select(C(id_col).alias("_id"), host_of(C(url_col)).alias("host"), C(at_col).alias("fetched_at"))
    asked = caps.filter("host IS NOT NULL AND fetched_at IS NOT NULL").select("host", "fetched_at").distinct()
    active = asked.withColumn("suffix", F.explode(suffixes(C("host")))).join(
        intervals(entries), (C("suffix") == C("rule")) & (C("fetched_at") >= C("listed_at")) & (C("until").isNull() | (C("fetched_at") < C("until"))))
    verdict = active.groupBy(C("host").alias("_host"), C("fetched_at").alias("_at")).agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "category", "listed_at")).alias("hit"))
    return caps.join(verdict, (C("host") == C("_host")) & (C("fetched_at") == C("_at")), "left").select(
        C("_id").alias(id_col), "host", "fetched_at", C("hit").isNotNull().alias("blocked"), "hit.rule", "hit.category", "hit.listed_at")


def dated_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch second of the year 2024, spread by page id (the table has no fetch time)."""
    return pages.select("page_id", "url", (F.lit(1704067200) + F.pmod(C("page_id") * 7919, F.lit(31536000))).alias("fetched_at"))


def derived_list(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts and domains of ``pages``: a third is added at some day, half of these dropped later, some of those added again."""
    rules = pages.select(F.explode(suffixes(host_of(C("url")))).alias("rule")).distinct()
    x = rules.withColumn("x", F.conv(F.substring(F.md5("rule"), 1, 7), 16, 10).cast("long")).filter("x % 3 = 0")
    day = lambda d: F.lit(1704067200) + d * 86400
    first, gone = C("x") % 300, C("x") % 300 + 20 + C("x") % 41
    entry = lambda at, what: F.struct(day(at).alias("at"), F.lit(what).alias("action"))
    dated = F.filter(F.array(entry(first, "add"), F.when(C("x") % 2 == 0, entry(gone, "drop")), F.when(C("x") % 10 == 0, entry(gone + 30, "add"))), lambda e: e.isNotNull())
    kind = F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), (C("x") % 7 % 3 + 1).cast("int"))
    return x.select("rule", kind.alias("category"), F.explode(dated).alias("e")).select("rule", "category", "e.at", "e.action")


SQL = r"""WITH p AS (SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '\.+$', ''), '') AS host,
  1704067200 + (((page_id * 7919) % 31536000) + 31536000) % 31536000 AS fetched_at FROM pages),
h AS (SELECT DISTINCT host, string_split(host, '.') AS labels FROM p WHERE host IS NOT NULL),
u AS (SELECT host, unnest(list_transform(range(1, greatest(len(labels) - 1, 1) + 1), lambda i: array_to_string(labels[i:], '.'))) AS rule FROM h),
r AS (SELECT DISTINCT rule, ('0x' || substr(md5(rule), 1, 7))::BIGINT AS x FROM u),
e AS (SELECT rule, x, x % 300 AS d, 'add' AS action FROM r WHERE x % 3 = 0
  UNION ALL SELECT rule, x, x % 300 + 20 + x % 41, 'drop' FROM r WHERE x % 3 = 0 AND x % 2 = 0
  UNION ALL SELECT rule, x, x % 300 + 50 + x % 41, 'add' FROM r WHERE x % 3 = 0 AND x % 10 = 0),
i AS (SELECT rule, ['adult', 'malware', 'spam'][x % 7 % 3 + 1] AS category, action, 1704067200 + d * 86400 AS listed_at, lead(1704067200 + d * 86400) OVER (PARTITION BY rule ORDER BY d) AS until FROM e),
a AS (SELECT page_id, u.host, fetched_at, i.rule, category, listed_at, row_number() OVER (PARTITION BY u.host, fetched_at, page_id ORDER BY length(i.rule) DESC) AS n
  FROM p JOIN u ON p.host = u.host JOIN i ON i.rule = u.rule AND action = 'add' AND fetched_at >= listed_at AND (until IS NULL OR fetched_at < until))
SELECT p.page_id, p.host, p.fetched_at, a.rule IS NOT NULL AS blocked, a.rule, a.category, a.listed_at
FROM p LEFT JOIN a ON a.page_id = p.page_id AND a.host = p.host AND a.fetched_at = p.fetched_at AND a.n = 1"""
