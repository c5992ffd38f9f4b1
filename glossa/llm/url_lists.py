"""URL filters by a temporal list join, in DataFrame functions only.

A list is a log of dated entries: a rule is added or removed on a day. Per rule the entries become validity intervals; a capture is judged
by the entries that were active on the day it was fetched. Rules are hosts (with their subdomains) or a host with
a path that the URL's path begins with, by whole segments. The as-of join runs over the distinct
(rule, day) pairs that captures need: per rule there are no more of these than days, however many captures share a host;
its result joins back by equality, so a hot host can be split.

Defined results: null or unreadable URLs match nothing; without a fetch day nothing is active; of two entries for a rule on one day
an addition wins; entries with a null rule, day or unknown action are left out; repeated entries count once and repeated captures
repeat; of several active rules the longest is named (then the first by code point). Extra columns are kept; the
result's names replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossa.llm.common import stash

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[^:]+://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def candidates(url: Column, depth: int) -> Column:
    """Every rule that could match: the host's suffixes, and the host with up to ``depth`` segments of its path."""
    labels = F.split(host_of(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda p: p != "")
    some = F.least(F.size(parts), F.lit(depth))
    paths = F.when(some > 0, F.transform(F.sequence(F.lit(1), some), lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    found = F.concat(suffixes, F.coalesce(paths, F.expr("cast(array() as array<string>)")))
    return F.when(host_of(url) != "", F.array_distinct(found)).otherwise(F.expr("cast(array() as array<string>)"))


def intervals(entries: DataFrame) -> DataFrame:
    """(rule, valid_from, valid_to, category) of a log (rule, action, day, category); valid_to is null while open."""
    days = entries.where(F.col("rule").isNotNull() & F.col("day").isNotNull() & F.col("action").isin("add", "remove"))
    days = days.groupBy(F.regexp_replace(F.lower(F.split("rule", "/")[0]), r"\.$", "").alias("host"), "rule", "day").agg(
        F.max(F.col("action") == "add").alias("active"), F.max(F.when(F.col("action") == "add", F.col("category"))).alias("category")
    )
    days = days.withColumn("rule", F.concat("host", F.expr("substring(rule, length(split(rule, '/')[0]) + 1)")))
    days = days.groupBy("rule", "day").agg(F.max("active").alias("active"), F.max("category").alias("category"))
    following = F.lead("day").over(Window.partitionBy("rule").orderBy("day"))
    return days.withColumn("valid_to", following).where("active").select("rule", F.col("day").alias("valid_from"), "valid_to", "category")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetched") -> DataFrame:
    """``captures`` with blocked, rule, category, listed_since and n_rules."""
    added = ["blocked", "rule", "category", "listed_since", "n_rules"]
    active = stash(intervals(entries), "intervals")
    depth = active.agg(F.max(F.size(F.split("rule", "/")) - 1)).first()[0] or 0
    wanted = captures.select(F.col(url).alias("url"), F.col(day).cast("date").alias("day")).where("url is not null and day is not null").distinct()
    wanted = wanted.select("url", "day", F.explode(candidates(F.col("url"), depth)).alias("rule"))
    rules = stash(active.select("rule").distinct(), "rules")
    wanted = stash(wanted.join(rules, "rule"), "wanted")

    # As of each needed day: the interval that began last, if it is still open then.
    asked = wanted.select("rule", "day").distinct().select("rule", "day", F.lit(1).alias("ask"), F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(None).cast("string").alias("category"))
    begun = active.select("rule", F.col("valid_from").alias("day"), F.lit(0).alias("ask"), "valid_from", "valid_to", "category")
    line = Window.partitionBy("rule").orderBy("day", "ask").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(F.when(F.col("ask") == 0, F.struct("valid_from", "valid_to", "category")), ignorenulls=True).over(line)
    known = begun.unionByName(asked).withColumn("latest", latest).where("ask = 1")
    known = known.where(F.col("latest.valid_to").isNull() & F.col("latest").isNotNull() | (F.col("day") < F.col("latest.valid_to")))
    known = stash(known.select("rule", "day", F.col("latest.category").alias("category"), F.col("latest.valid_from").alias("listed_since")), "known")

    hits = wanted.join(known, ["rule", "day"]).groupBy("url", "day").agg(
        F.count(F.lit(1)).alias("n_rules"), F.min(F.struct((-F.length("rule")).alias("short"), "rule", "category", "listed_since")).alias("best")
    )
    verdicts = stash(hits.select(F.col("url").alias("_u"), F.col("day").alias("_d"), "n_rules", F.col("best.rule").alias("rule"), F.col("best.category").alias("category"), F.col("best.listed_since").alias("listed_since")), "verdicts")
    kept = captures.drop(*[c for c in added if c in captures.columns])
    joined = kept.join(verdicts, (kept[url] == verdicts["_u"]) & (kept[day].cast("date") == verdicts["_d"]), "left")
    return joined.select(*[kept[c] for c in kept.columns], F.col("n_rules").isNotNull().alias("blocked"), "rule", "category", "listed_since", F.coalesce("n_rules", F.lit(0)).alias("n_rules"))


# The tables hold no list and no fetch days, so the query derives both from digests of hosts and URLs:
# a third of the hosts and a fifth of the domains are listed, most are removed again, some come back; some hosts are listed for one path.
_DAY = "date_add(date'2020-01-01', cast({n} as int))"


def _number(text: str) -> str:
    return f"cast(conv(substring(md5({text}), 1, 8), 16, 10) as bigint)"


def sample_captures(pages: DataFrame) -> DataFrame:
    """(page_id, url, fetched): a fetch day for each page."""
    n = _number("coalesce(url, '')")
    return pages.select("page_id", "url", F.expr(_DAY.format(n=f"({n} % 1800)")).alias("fetched"))


def sample_entries(captures: DataFrame) -> DataFrame:
    """(rule, action, day, category) for hosts, domains and first path segments that occur."""
    seen = captures.select(host_of(F.col("url")).alias("host"), F.regexp_extract("url", PATH, 1).alias("path")).where("host != ''").distinct()
    hosts = seen.select("host").distinct().where(f"{_number('host')} % 3 = 0").select(F.col("host").alias("rule"))
    domains = seen.select(F.substring_index("host", ".", -2).alias("rule")).distinct().where(f"{_number('rule')} % 5 = 0")
    first = F.filter(F.split("path", "/"), lambda p: p != "")
    paths = seen.where(F.size(first) > 0).select(F.concat("host", F.lit("/"), first[0]).alias("rule")).distinct().where(f"{_number('rule')} % 7 = 0")
    rules = hosts.unionByName(domains).unionByName(paths).distinct().withColumn("n", F.expr(_number("rule")))
    category = F.when(F.col("n") % 2 == 0, "spam").otherwise("adult")
    add = rules.select("rule", F.lit("add").alias("action"), F.expr(_DAY.format(n="(n % 1000)")).alias("day"), category.alias("category"))
    gone = rules.where("n % 4 != 1").select("rule", F.lit("remove").alias("action"), F.expr(_DAY.format(n="(n % 1000 + 1 + n % 397)")).alias("day"), category.alias("category"))
    back = rules.where("n % 4 = 0").select("rule", F.lit("add").alias("action"), F.expr(_DAY.format(n="(n % 1000 + 401 + n % 397)")).alias("day"), F.lit("phishing").alias("category"))
    return add.unionByName(gone).unionByName(back)


ORACLE_SQL = r"""
WITH captures AS (
  SELECT page_id, url, date '2020-01-01' + (('0x' || substr(md5(coalesce(url, '')), 1, 8))::UBIGINT % 1800)::INT AS fetched,
    lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
    list_filter(string_split(regexp_extract(url, '^[^:]+://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages
), rules AS (
  SELECT rule, ('0x' || substr(md5(rule), 1, 8))::UBIGINT::BIGINT AS n FROM (
    SELECT DISTINCT host AS rule FROM captures WHERE host <> '' AND ('0x' || substr(md5(host), 1, 8))::UBIGINT % 3 = 0
    UNION SELECT DISTINCT array_to_string(string_split(host, '.')[-2:], '.') FROM captures
      WHERE host <> '' AND ('0x' || substr(md5(array_to_string(string_split(host, '.')[-2:], '.')), 1, 8))::UBIGINT % 5 = 0
    UNION SELECT DISTINCT host || '/' || parts[1] FROM captures
      WHERE host <> '' AND len(parts) > 0 AND ('0x' || substr(md5(host || '/' || parts[1]), 1, 8))::UBIGINT % 7 = 0)
), entries AS (
  SELECT rule, true AS active, date '2020-01-01' + (n % 1000)::INT AS day, CASE WHEN n % 2 = 0 THEN 'spam' ELSE 'adult' END AS category FROM rules
  UNION ALL SELECT rule, false, date '2020-01-01' + (n % 1000 + 1 + n % 397)::INT, NULL FROM rules WHERE n % 4 <> 1
  UNION ALL SELECT rule, true, date '2020-01-01' + (n % 1000 + 401 + n % 397)::INT, 'phishing' FROM rules WHERE n % 4 = 0
), days AS (
  SELECT rule, day, bool_or(active) AS active, max(category) AS category FROM entries GROUP BY rule, day
), valid AS (
  SELECT * FROM (SELECT rule, day AS valid_from, lead(day) OVER (PARTITION BY rule ORDER BY day) AS valid_to, category, active FROM days) WHERE active
), hits AS (
  SELECT c.url, c.fetched, v.rule, v.category, v.valid_from FROM (SELECT DISTINCT url, fetched, host, parts FROM captures) c
  JOIN valid v ON (v.rule = c.host OR ends_with(c.host, '.' || v.rule) OR (len(c.parts) > 0 AND v.rule = c.host || '/' || c.parts[1]))
    AND c.fetched >= v.valid_from AND (v.valid_to IS NULL OR c.fetched < v.valid_to)
), best AS (
  SELECT url, fetched, rule, category, valid_from, count(*) OVER (PARTITION BY url, fetched) AS n_rules,
    row_number() OVER (PARTITION BY url, fetched ORDER BY length(rule) DESC, rule) AS r FROM hits
)
SELECT c.page_id, c.url, c.fetched, b.rule IS NOT NULL AS blocked, b.rule, b.category, b.valid_from AS listed_since, coalesce(b.n_rules, 0) AS n_rules
FROM captures c LEFT JOIN best b ON b.url = c.url AND b.fetched = c.fetched AND b.r = 1
"""
