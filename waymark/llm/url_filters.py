"""URL filters over time: list entries become validity intervals, and every capture meets the entries of its fetch time.

A list is a log of dated events (list_name, action, pattern, op, listed_at): op is 'add' or 'remove'. For each list and
pattern, `lead` turns the log into intervals [valid_from, valid_to). A pattern is a domain (it covers its subdomains)
or a domain and path segments ("a.org/x" covers a.org/x and a.org/x/y, not a.org/xy). A capture's candidate keys are its
domain suffixes and its host with each path prefix, so the as-of join is an equi-join on the key and a range condition.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and closing dots; null where the URL has none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")
    return F.when(host != "", host)


def candidate_keys(url: Column) -> Column:
    """The patterns that would cover url: each suffix of its host's labels, and its host with each prefix of its path."""
    labels = F.split(host_of(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")))
    return F.array_distinct(F.concat(suffixes, F.when(F.size(segments) > 0, prefixes).otherwise(F.array().cast("array<string>"))))


def normal_pattern(pattern: Column) -> Column:
    """A list's pattern as candidate keys are written: host in lower case, single slashes, none at the end."""
    host = F.substring_index(pattern, "/", 1)
    path = F.regexp_replace(F.substring(pattern, F.length(host) + 1, F.length(pattern)), "/+", "/")
    return F.concat(F.lower(host), F.regexp_replace(path, "/$", ""))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list_name, action, pattern, valid_from, valid_to): valid_to is null while the entry stands.

    A pattern's host is lower-cased, its path keeps its case; closing slashes are left out.
    Of events of a list and pattern on one date, a removal wins. An add that follows an add starts a new interval. A
    removal without an add, and rows with a null in any column, have no effect.
    """
    day = entries.dropna(subset=["list_name", "action", "pattern", "op", "listed_at"])
    day = day.groupBy("list_name", "action", normal_pattern(F.col("pattern")).alias("pattern"), "listed_at").agg(F.max(F.col("op") == "remove").alias("removed"))
    log = W.partitionBy("list_name", "action", "pattern").orderBy("listed_at")
    spans = day.select("list_name", "action", "pattern", F.col("listed_at").alias("valid_from"), F.lead("listed_at").over(log).alias("valid_to"), "removed")
    return spans.where(~F.col("removed")).drop("removed")


def url_filters(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """One row per capture: id_col, host, fetched_at, n_active, decision, pattern, list_name, listed_at.

    The longest active pattern decides; of equal patterns an allow, then the least list name. decision is 'block',
    'allow' or 'none'. A null or malformed URL, a null time and an empty list give 'none' with n_active 0. Captures
    that repeat a URL and a time are evaluated once and joined back. A very long URL has a key for each label and path
    segment. The list may grow with the captures: it is joined by its key, broadcast only where Spark measures it small.
    """
    seen = captures.select(F.col(url_col).alias("u"), F.col(time_col).alias("t")).where("u is not null and t is not null").distinct()
    keys = seen.select("u", "t", F.explode(candidate_keys(F.col("u"))).alias("key"))
    spans = validity_intervals(entries)
    active = keys.join(spans, (F.col("key") == F.col("pattern")) & (F.col("t") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("t") < F.col("valid_to"))))
    # min over (-length, action, ...): 'allow' sorts before 'block'.
    order = F.struct(-F.length("pattern"), "action", "list_name", "pattern", F.col("valid_from").alias("from"))
    ruled = active.groupBy("u", "t").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("best"))
    out = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("at"))
    out = out.join(ruled, F.col("url").eqNullSafe(F.col("u")) & F.col("at").eqNullSafe(F.col("t")), "left")
    return out.select(
        F.col("id").alias(id_col), host_of(F.col("url")).alias("host"), F.col("at").alias("fetched_at"), F.coalesce("n", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("best.action", F.lit("none")).alias("decision"), F.col("best.pattern").alias("pattern"), F.col("best.list_name").alias("list_name"), F.col("best.from").alias("listed_at"),
    )
