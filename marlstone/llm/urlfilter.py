"""URL filters by a temporal list join.

A list is a log of dated changes (kind, value, listed, action): from `listed` on an `add`
makes the entry active and a `remove` ends it. The log becomes validity intervals, one after
the other for each (kind, value), and an as-of join holds every capture against the entries
that were active when it was fetched. Three kinds of entry: `host` (the host itself),
`domain` (the host or any host below it), `prefix` (host/first path segment).

A capture has one key for each kind and each domain above its host, so the join is an equi-join
on (kind, value) with a range on the date; at most one interval of a key holds on a date, so
the join can't multiply rows. Spark splits a hot host's partition, as both sides come from
plain exchanges. No Python, no broadcast of our own choosing.

Schemes and hosts are matched in any case, paths in their own. User names and ports don't count. An
address in brackets is one label: it has no domain above it. Blanks around a URL are left out.
Null or unparsable URLs have no keys and are never blocked; neither are captures without a
date. Changes with a null in kind, value, listed or action are left out. On one date a
`remove` wins over an `add`. Repeated captures are each returned. Empty tables give empty or
unblocked results. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#@\[\]]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def intervals(changes: DataFrame) -> DataFrame:
    """kind, value, since, until (exclusive; null: still active) of every time an entry was active."""
    key = ["kind", "value"]
    daily = changes.dropna(subset=["kind", "value", "listed", "action"]).groupBy(*key, "listed").agg(F.max("action").alias("action"))
    line = W.partitionBy(*key).orderBy("listed")
    return daily.withColumn("until", F.lead("listed").over(line)).where(F.col("action") == "add").select(*key, F.col("listed").alias("since"), "until")


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.lower(F.trim(url)), _HOST, 1), r"\.+$", "")


def _keys(url: Column) -> Column:
    """array<struct<kind, value>> that the URL is looked up by."""
    host, path = host_of(url), F.regexp_extract(F.trim(url), _PATH, 1)
    labels = F.when(F.startswith(host, F.lit("[")), F.array(host)).otherwise(F.split(host, r"\.", -1))
    n = F.size(labels)
    above = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, n), ".").alias("value")))
    one = F.array(F.struct(F.lit("host").alias("kind"), host.alias("value")))
    prefix = F.when(path != "", F.array(F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", host, path).alias("value"))))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    return F.when(host != "", F.concat(one, above, F.coalesce(prefix, none))).otherwise(none)


def screen(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """page_id, url, fetched, blocked, kind, value, since, n_rules for each row of captures (page_id, url, fetched).

    kind, value, since: the first of the active entries that hold, in the order of kind and value.
    """
    key = ["page_id", "url", "fetched"]
    rows = captures.groupBy(*key).agg(F.count(F.lit(1)).alias("alike"))
    keys = rows.withColumn("_k", F.explode_outer(_keys(F.col("url")))).select(*key, "alike", F.col("_k.kind").alias("kind"), F.col("_k.value").alias("value"))
    active = intervals(changes).withColumnsRenamed({"kind": "e_kind", "value": "e_value"})
    on = (F.col("kind") == F.col("e_kind")) & (F.col("value") == F.col("e_value")) & (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    rule = F.when(F.col("since").isNotNull(), F.struct("e_kind", "e_value", "since"))
    found = keys.join(active, on, "left").groupBy(*key, "alike").agg(F.min(rule).alias("r"), F.count("since").alias("n_rules"))
    out = found.select(*key, F.col("r").isNotNull().alias("blocked"), F.col("r.e_kind").alias("kind"), F.col("r.e_value").alias("value"), F.col("r.since").alias("since"), "n_rules", "alike")
    return out.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("alike").cast("int")))).drop("alike", "_")


def _draw(value: Column, turn: int) -> Column:
    """0 to 4095 from three hexadecimal digits of a hash; SQL says the same."""
    digit = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(value), i, 1)) - 1
    return digit(3 * turn + 1) * 256 + digit(3 * turn + 2) * 16 + digit(3 * turn + 3)


def sample_captures(pages: DataFrame, start: str = "2024-01-01") -> DataFrame:
    """The table has no fetch date: one day of the year by page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit(start).cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int")).alias("fetched"))


def sample_changes(pages: DataFrame, start: str = "2024-01-01") -> DataFrame:
    """A dated list over every host of the table: a fifth of the hosts, their parent domains' and first
    segments' entries added on a day drawn by hash, removed later, and every other one added again."""
    url = F.col("url")
    seen = pages.select(F.explode(_keys(url)).alias("k")).select("k.kind", "k.value").distinct()
    draw = _draw(F.col("value"), 0)
    day = lambda n: F.date_add(F.lit(start).cast("date"), n.cast("int"))
    first = F.pmod(_draw(F.col("value"), 1), F.lit(300))
    gap = F.pmod(_draw(F.col("value"), 2), F.lit(90))
    again = F.array(F.struct(day(first).alias("listed"), F.lit("add").alias("action")), F.struct(day(first + gap).alias("listed"), F.lit("remove").alias("action")), F.struct(day(first + gap + gap).alias("listed"), F.lit("add").alias("action")))
    log = F.when(draw % 2 == 0, again).otherwise(F.slice(again, 1, 2))
    return seen.where(draw % 5 == 0).select("kind", "value", F.explode(log).alias("e")).select("kind", "value", "e.listed", "e.action")


_SQL_KEYS = """
urls AS (SELECT page_id, url, (DATE '2024-01-01' + CAST(((page_id % 366) + 366) % 366 AS INT)) AS fetched,
  regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?(\\[[^\\]/?#]*\\]|[^:/?#@\\[\\]]+)', 1), '\\.+$', '') AS host,
  regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS path FROM pages),
labels AS (SELECT *, CASE WHEN starts_with(host, '[') THEN [host] ELSE string_split(host, '.') END AS l FROM urls WHERE host <> ''),
keys AS (
  SELECT page_id, url, fetched, 'host' AS kind, host AS value FROM labels
  UNION ALL SELECT page_id, url, fetched, 'domain', array_to_string(l[i:], '.') FROM (SELECT *, unnest(range(1, greatest(len(l), 2))) AS i FROM labels)
  UNION ALL SELECT page_id, url, fetched, 'prefix', host || '/' || path FROM labels WHERE path <> '')"""
_SQL_DRAW = " + ".join(f"(instr('0123456789abcdef', substr(md5(value), {{0}} + {i}, 1)) - 1) * {w}" for i, w in ((1, 256), (2, 16), (3, 1)))

#: DuckDB over the same tables; each (kind, value) of the sample list is dated by the same hash digits.
ORACLE = f"""WITH {_SQL_KEYS},
listed AS (SELECT kind, value, ({_SQL_DRAW.format(0)}) AS d, ({_SQL_DRAW.format(3)}) % 300 AS f, ({_SQL_DRAW.format(6)}) % 90 AS g FROM (SELECT DISTINCT kind, value FROM keys)),
changes AS (
  SELECT kind, value, DATE '2024-01-01' + CAST(f AS INT) AS listed, 'add' AS action FROM listed WHERE d % 5 = 0
  UNION ALL SELECT kind, value, DATE '2024-01-01' + CAST(f + g AS INT), 'remove' FROM listed WHERE d % 5 = 0
  UNION ALL SELECT kind, value, DATE '2024-01-01' + CAST(f + g + g AS INT), 'add' FROM listed WHERE d % 10 = 0),
daily AS (SELECT kind, value, listed, max(action) AS action FROM changes GROUP BY ALL),
line AS (SELECT *, lead(listed) OVER (PARTITION BY kind, value ORDER BY listed) AS until FROM daily),
hits AS (SELECT DISTINCT k.page_id, k.url, k.fetched, l.kind, l.value, l.listed AS since FROM keys k JOIN line l
  ON k.kind = l.kind AND k.value = l.value AND l.action = 'add' AND k.fetched >= l.listed AND (l.until IS NULL OR k.fetched < l.until)),
firsts AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY page_id, url, fetched) AS n FROM hits WINDOW w AS (PARTITION BY page_id, url, fetched ORDER BY kind, value, since))
SELECT u.page_id, u.url, u.fetched, h.since IS NOT NULL AS blocked, h.kind, h.value, h.since, coalesce(h.n, 0) AS n_rules
FROM urls u LEFT JOIN firsts h ON h.r = 1 AND u.page_id = h.page_id AND u.url = h.url AND u.fetched = h.fetched"""
