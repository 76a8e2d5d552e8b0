"""URL filters as a temporal list join, in DataFrame functions only.

Dated list entries (added, removed) become validity intervals. Every capture's URL is cut into the keys
under which an entry could stand (its host and the host's parents, its host with every path
prefix), the keys meet the intervals in an equi-join, and the entries active at fetch time decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hot_join

FAR = "9999-01-01 00:00:00"


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, action 'add'|'remove', at) -> (list, key, valid_from, valid_to), half-open, none overlapping.

    Of several changes at one time a removal wins. Adding what stands, or removing what does not, changes
    nothing. Rows with a null key, list, date or another action are ignored. Keys are lower-cased.
    """
    e = entries.select("list", F.lower(F.trim("key")).alias("key"), F.lower("action").alias("action"), F.col("at").cast("timestamp").alias("at"))
    e = e.where("list is not null and key is not null and key <> '' and at is not null and action in ('add', 'remove')")
    e = e.groupBy("list", "key", "at").agg(F.max("action").alias("action"))  # 'remove' > 'add'
    by = Window.partitionBy("list", "key").orderBy("at")
    e = e.withColumn("last", F.lag("action").over(by)).where("last is null and action = 'add' or last <> action")
    e = e.withColumn("valid_to", F.coalesce(F.lead("at").over(by), F.lit(FAR).cast("timestamp")))
    return e.where("action = 'add'").select("list", "key", F.col("at").alias("valid_from"), "valid_to")


def host(url: Column) -> Column:
    """The lower-cased host: no user, port or final dot; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*?)\.?(?::\d*)?(?:[/?#]|\s*$)", 1))


def path(url: Column) -> Column:
    """The path without query and fragment, with a leading slash."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)", 1)


def keys(h: Column, p: Column) -> Column:
    """'host' for the host and each parent domain, and 'host/a', 'host/a/b' ... for each prefix of the path."""
    labels = F.split(h, r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    down = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(h, F.lit("/"), F.lower(F.array_join(F.slice(parts, F.lit(1), i), "/"))))).otherwise(F.array())
    return F.when(h != "", F.array_distinct(F.concat(up, down))).otherwise(F.array().cast("array<string>"))


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at", allow: tuple[str, ...] = ("allow",)) -> DataFrame:
    """One row a capture: id, url, fetched_at, host, blocked_by (sorted list names), allowed, blocked.

    A capture is blocked if an entry of any list for its host, a parent domain or a prefix of its path is
    active at its fetch time, unless an entry of a list in `allow` is. Null or hostless URLs and null
    times match nothing. Rows that repeat id, URL or time get equal results; other columns are
    ignored; an empty table or an empty list is no error. Equal (URL, time) pairs are decided once;
    hot keys are joined apart, so no task gets the rows of a common domain.
    """
    c = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).cast("timestamp").alias("at"))
    c = c.withColumn("ck", F.when(F.col("url").isNotNull() & F.col("at").isNotNull(), F.md5(F.concat_ws("|", F.unix_micros("at").cast("string"), "url").cast("binary"))))
    u = c.where("ck is not null").select("ck", "url", "at").distinct().withColumn("h", host(F.col("url"))).where("h <> ''")
    u = u.select("ck", "at", F.explode(keys(F.col("h"), path(F.col("url")))).alias("key"))
    hit = hot_join(u, intervals(entries), "key").where("at >= valid_from and at < valid_to")
    hit = hit.groupBy("ck").agg(F.sort_array(F.collect_set("list")).alias("lists"))
    out = hot_join(c, hit, "ck", "left")
    none = F.array().cast("array<string>")
    names = F.array(*map(F.lit, allow)) if allow else none
    lists = F.coalesce("lists", none)
    blocked_by, allowed = F.array_except(lists, names), F.size(F.array_intersect(lists, names)) > 0
    return out.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("at").alias(time_col), host(F.col("url")).alias("host"),
        F.array_join(blocked_by, ",").alias("blocked_by"), allowed.alias("allowed"), ((F.size(blocked_by) > 0) & ~allowed).alias("blocked"),
    )


# The dated entries of the query (list, key, action, date).
ENTRIES = (
    ("spam", "spam-farm.example.com", "add", "2023-03-01"),
    ("spam", "cheap-pills.example.com", "add", "2023-06-01"),
    ("spam", "cheap-pills.example.com", "remove", "2024-02-01"),
    ("spam", "cheap-pills.example.com", "add", "2024-07-01"),
    ("gambling", "casino-win.example.com", "add", "2023-01-15"),
    ("gambling", "free-bets.example.com", "add", "2024-05-20"),
    ("tracking", "ads-track.example.com", "add", "2023-11-11"),
    ("tracking", "ads-track.example.com", "remove", "2024-10-01"),
    ("adult", "adult-x.example.net", "add", "2023-01-01"),
    ("takedown", "tionsh.example.net/en", "add", "2024-03-01"),
    ("takedown", "tionsh.example.net/en", "remove", "2024-03-15"),
    ("takedown", "blog.tionsh.example.net/fr", "add", "2024-04-01"),
    ("takedown", "example.org", "add", "2024-08-01"),
    ("takedown", "example.org", "remove", "2024-08-08"),
    ("allow", "thther.example.org", "add", "2024-08-03"),
)

VALUES = ", ".join(f"('{a}', '{b}', '{c}', TIMESTAMP '{d} 00:00:00')" for a, b, c, d in ENTRIES)
#: The pages have no fetch time: the query derives one from the id, over two years.
FETCHED = "TIMESTAMP '2023-01-01 00:00:00' + INTERVAL '1' HOUR * (page_id % 17520)"
ORACLE = rf"""
WITH en(list, key, action, day) AS (VALUES {VALUES}),
ch AS (SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY list, key ORDER BY day) AS last FROM en) WHERE (last IS NULL AND action = 'add') OR last <> action),
iv AS (SELECT * FROM (SELECT list, key, action, day AS valid_from, coalesce(lead(day) OVER (PARTITION BY list, key ORDER BY day), TIMESTAMP '{FAR}') AS valid_to FROM ch) WHERE action = 'add'),
c AS (SELECT page_id, url, {FETCHED} AS fetched_at, lower(regexp_extract(coalesce(url, ''), '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*?)\.?(?::\d*)?(?:[/?#]|\s*$)', 1)) AS host,
 lower(regexp_extract(coalesce(url, ''), '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)', 1)) AS p FROM pages),
m AS (SELECT c.page_id, c.url, iv.list FROM c JOIN iv ON c.fetched_at >= valid_from AND c.fetched_at < valid_to AND host <> ''
 AND (('.' || host) LIKE ('%.' || key) OR (key LIKE '%/%' AND starts_with(rtrim(host || p, '/') || '/', key || '/')))),
g AS (SELECT page_id, url, list_sort(list(DISTINCT list)) AS lists FROM m GROUP BY page_id, url)
SELECT c.page_id, c.url, c.fetched_at, c.host, array_to_string(list_filter(coalesce(lists, []), lambda x: x <> 'allow'), ',') AS blocked_by,
 list_contains(coalesce(lists, []), 'allow') AS allowed,
 len(list_filter(coalesce(lists, []), lambda x: x <> 'allow')) > 0 AND NOT list_contains(coalesce(lists, []), 'allow') AS blocked
FROM c LEFT JOIN g ON g.page_id = c.page_id AND g.url = c.url"""
