"""URL filters by a temporal list join.

Lists change: an entry is added on one day and may be removed, and added again, later. Each list's dated entries become
validity intervals (from the day of the addition to the day of the next change), and an as-of join holds every capture
against the entries that were active when it was fetched. An entry is a host, which stands for its subdomains too, or a
host with the beginning of a path, which ends at a whole segment.

A capture asks for the suffixes of its host and the beginnings of its path, as many as the deepest entry has, so a long
URL costs no more than the lists ask for. Captures with one URL and day are judged once; the intervals are broadcast
where they have been counted to be few, else only those that any capture asks for are kept, and if these are many the
join is salted. No capture or list reaches the driver.

Edge cases: a null or unreadable URL, or a null day, matches nothing and is not blocked; entries with a null value,
list or day count for nothing; of an addition and a removal on one day the addition holds; an addition of what is listed
already, or a removal of what is not, changes nothing; an interval holds its first day and not its last; repeated rows
are judged alike; empty tables give an empty result, or one that blocks nothing; captures' columns named like an
output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, without

SALTS = 32
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without a final dot; empty if there is none."""
    return F.rtrim(F.lower(F.regexp_extract(url, _AUTHORITY, 1)), F.lit("."))


def path_of(url: Column) -> Column:
    return F.rtrim(F.regexp_extract(url, _PATH, 1), F.lit("/"))


def _plain(value: Column) -> Column:
    """An entry without scheme and final slash, its host in lower case."""
    bare = F.rtrim(F.regexp_replace(value, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), F.lit("/"))
    host = F.substring_index(bare, "/", 1)
    return F.concat(F.lower(host), F.substr(bare, F.char_length(host) + 1))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, value, since, until) of (list, value, day, listed boolean); ``until`` is null where nothing follows."""
    known = entries.select("list", _plain(F.col("value")).alias("value"), "day", "listed").where("list is not null and value <> '' and day is not null")
    daily = known.groupBy("list", "value", "day").agg(F.max("listed").alias("listed")).where("listed is not null")
    order = Window.partitionBy("list", "value").orderBy("day")
    changes = daily.withColumn("before", F.lag("listed").over(order)).where("before is null or before <> listed")
    return changes.withColumn("until", F.lead("day").over(order)).where("listed").select("list", "value", F.col("day").alias("since"), "until")


def _keys(url: Column, labels: int, depth: int) -> Column:
    """Values of entries that would cover ``url``."""
    host, path = host_of(url), path_of(url)
    places = lambda n, most: F.when(F.least(n, F.lit(most)) > 0, F.sequence(F.lit(1), F.least(n, F.lit(most)))).otherwise(F.array().cast("array<int>"))
    hosts = F.transform(places(F.size(F.split(host, r"\.")), labels), lambda k: F.call_function("substring_index", host, F.lit("."), -k))
    # Segments are counted by their slashes; the first piece before a slash is empty.
    paths = F.transform(places(F.char_length(path) - F.char_length(F.replace(path, F.lit("/"), F.lit(""))), depth),
                        lambda k: F.concat(host, F.call_function("substring_index", path, F.lit("/"), k + 1)))
    return F.when(host != "", F.array_distinct(F.concat(hosts, paths))).otherwise(F.array().cast("array<string>"))


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched", limit: int = BROADCAST_ROWS) -> DataFrame:
    """``captures`` with active (array of list, value, since: the entries that cover the URL on the day) and blocked."""
    captures = without(captures, "active", "blocked")
    spans = cut(intervals(entries))
    slashes = F.char_length("value") - F.char_length(F.replace("value", F.lit("/"), F.lit("")))
    deepest = spans.agg(F.max(F.size(F.split(F.substring_index("value", "/", 1), r"\."))).alias("labels"), F.max(slashes).alias("depth")).first()
    pairs = captures.select(F.col(url).alias("__url"), F.col(fetched).alias("__at")).where("__url is not null and __at is not null").distinct()
    asked = pairs.withColumn("__key", F.explode(_keys(F.col("__url"), deepest.labels or 0, deepest.depth or 0)))
    few = spans.limit(limit + 1).count() <= limit
    if not few:
        spans = cut(spans.join(asked.select(F.col("__key").alias("value")).distinct(), "value", "left_semi"))
        few = spans.limit(limit + 1).count() <= limit
    on = (F.col("__key") == F.col("value")) & (F.col("since") <= F.col("__at")) & (F.col("until").isNull() | (F.col("__at") < F.col("until")))
    if few:
        hits = asked.join(F.broadcast(spans), on)
    else:
        spread = asked.withColumn("__salt", F.pmod(F.xxhash64("__url", "__at"), F.lit(SALTS)).cast("int"))
        copies = spans.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = spread.join(copies, on & (F.col("__salt") == F.col("__copy")))
    # A capture's own keys bound how many entries it can meet.
    found = hits.groupBy("__url", "__at").agg(F.array_sort(F.collect_set(F.struct("list", "value", "since"))).alias("active"))
    out = captures.join(found, (F.col(url) == F.col("__url")) & (F.col(fetched) == F.col("__at")), "left")
    kind = found.schema["active"].dataType
    return out.select(*captures.columns, F.coalesce("active", F.array().cast(kind)).alias("active"), F.col("active").isNotNull().alias("blocked"))


#: The query's captures and lists, read off the pages by fixed rules: the day of a fetch follows from the page's id, and
#: what a host, its parent domain or its English section is listed as, and when, from a digest of that value.
FETCHED = "date_add(DATE '2024-01-01', CAST(page_id % 366 AS INT))"
_ENTRIES = """
SELECT CASE WHEN substr(h, 4, 1) < '8' THEN 'spam' ELSE 'adult' END AS list, value, {day} AS day, step <> 1 AS listed
FROM (SELECT value, h, step, strpos('0123456789abcdef', substr(h, 2, 1)) * 10 + CASE step WHEN 0 THEN 0 WHEN 1 THEN strpos('0123456789abcdef', substr(h, 3, 1)) * 8 ELSE 200 END AS n
  FROM (SELECT value, md5(value) AS h, {steps} AS step FROM {values_}) each) dated
WHERE substr(h, 1, 1) < '6'"""


def page_entries(pages: DataFrame) -> DataFrame:
    host = host_of(F.col("url"))
    values = pages.select(host.alias("host")).distinct().where("host <> ''")
    values = values.select(F.explode(F.array("host", F.expr("substr(host, instr(host, '.') + 1)"), F.concat("host", F.lit("/en")))).alias("value")).distinct()
    sql = _ENTRIES.replace("strpos('0123456789abcdef', substr(h, 2, 1))", "instr('0123456789abcdef', substr(h, 2, 1))").replace(
        "strpos('0123456789abcdef', substr(h, 3, 1))", "instr('0123456789abcdef', substr(h, 3, 1))")
    return pages.sparkSession.sql(sql.format(day="date_add(DATE '2024-01-01', n)", steps="explode(array(0, 1, 2))", values_="{values}"), values=values)


URL_SQL = f"""
WITH hosts AS (SELECT DISTINCT lower(regexp_extract(url, '{_AUTHORITY}', 1)) AS host FROM pages),
named AS (SELECT DISTINCT unnest([host, substr(host, strpos(host, '.') + 1), host || '/en']) AS value FROM hosts WHERE host <> ''),
entries AS ({_ENTRIES.format(day="DATE '2024-01-01' + n::INT", steps="unnest([0, 1, 2])", values_="named")}),
daily AS (SELECT list, value, day, max(listed) AS listed FROM entries GROUP BY ALL),
changes AS (SELECT * FROM daily QUALIFY lag(listed) OVER (PARTITION BY list, value ORDER BY day) IS DISTINCT FROM listed),
spans AS (SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY list, value ORDER BY day) AS until FROM changes) WHERE listed),
captures AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INT AS fetched, lower(regexp_extract(url, '{_AUTHORITY}', 1)) AS host,
  rtrim(regexp_extract(url, '{_PATH}', 1), '/') AS path FROM pages),
hits AS (SELECT page_id, c.url, fetched, list, value, day FROM captures c JOIN spans s ON fetched >= day AND (until IS NULL OR fetched < until)
  AND (host = value OR ends_with(host, '.' || value) OR host || path = value OR starts_with(host || path, value || '/')))
SELECT c.page_id, c.fetched::VARCHAR AS fetched, count(value) AS n_active, count(value) > 0 AS blocked,
  coalesce(string_agg(list || '|' || value || '|' || day::VARCHAR, ',' ORDER BY list, value, day), '') AS active
FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id GROUP BY c.page_id, c.fetched
"""
