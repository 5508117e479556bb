"""URL filters: temporal list join.

A list is a table of dated entries that add or remove a pattern. Entries become validity intervals, and
an as-of join evaluates every capture against the entries that were active when it was fetched. Two
kinds of patterns exist: ``domain`` covers a host and all hosts below it, ``url`` covers a host and path and
all paths below it. Distinct hosts are matched with the patterns of their domains first, so that a hot host
is looked up once, and captures join the result on the host. For ``url`` patterns, a capture lists the
beginnings of its path at the depths that its host's patterns have, and joins them on (host, path). The
interval is the only other condition, so no pattern meets a capture that it does not cover.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and a dot at its end; null if there is none."""
    host = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Rows (kind, host, path, valid_from, valid_to): an added pattern is valid from its date until the next date of an entry
    that removes it, which is excluded, or for ever (null). Of entries with the same pattern and date, one that adds
    prevails. Entries with a null among (kind, pattern, action, dated) are left out. Hosts fold case and dots at their
    end, paths slashes at their end; a domain has an empty path."""
    host = F.rtrim(F.lower(F.split_part("pattern", F.lit("/"), F.lit(1))), F.lit("."))
    path = F.rtrim(F.expr("substring(pattern, length(split_part(pattern, '/', 1)) + 1)"), F.lit("/"))
    rows = entries.select("kind", host.alias("host"), F.when(F.col("kind") == "domain", F.lit("")).otherwise(path).alias("path"), (F.col("action") == "add").alias("adds"), "dated")
    rows = rows.na.drop().groupBy("kind", "host", "path", "dated").agg(F.max("adds").alias("adds"))
    by = Window.partitionBy("kind", "host", "path").orderBy("dated")
    rows = rows.withColumn("before", F.lag("adds").over(by)).filter("before IS NULL OR before <> adds")
    rows = rows.withColumn("valid_to", F.lead("dated").over(by)).filter("adds")
    return rows.select("kind", "host", "path", F.col("dated").alias("valid_from"), "valid_to")


def temporal_list_join(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Evaluate captures(capture_id, url, fetched_at) against entries(kind, pattern, action, dated) as of fetched_at.

    Rows (capture_id, host, n_active, blocked): how many entries cover the URL and are active, and whether
    any is. A null or unreadable URL has a null host and is not blocked, nor is one without fetched_at.
    Rows that repeat a capture_id are told apart by url and fetched_at; equal rows give one. Other columns
    are not looked at. Path prefixes end at a slash, so ``a.org/x`` covers ``a.org/x/y`` and not ``a.org/xy``.
    URLs are read whole; of a very long one only the beginnings at depths that occur among its host's patterns are made.
    """
    captures = captures.select("capture_id", "url", "fetched_at", host_of(F.col("url")).alias("host")).distinct()
    valid = validity_intervals(entries)
    domains, urls = valid.filter("kind = 'domain'").withColumnRenamed("host", "pattern"), valid.filter("kind = 'url'")
    hosts = captures.filter("host IS NOT NULL").select("host").distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rules = hosts.select("host", F.explode(above).alias("pattern")).join(domains, "pattern").select("host", "valid_from", "valid_to")
    depth = F.length("path") - F.length(F.replace("path", F.lit("/")))
    depths = urls.groupBy("host").agg(F.collect_set(depth).alias("depths"))  # different numbers of slashes
    known = captures.select("url", "fetched_at", "capture_id", "host").filter("fetched_at IS NOT NULL")
    paths = known.join(depths, "host").select(*known.columns, F.concat(path_of(F.col("url")), F.lit("/")).alias("below"), F.explode("depths").alias("depth"))
    paths = paths.withColumn("path", F.expr("substring_index(below, '/', depth + 1)"))
    active = (F.col("c.fetched_at") >= F.col("r.valid_from")) & (F.col("r.valid_to").isNull() | (F.col("c.fetched_at") < F.col("r.valid_to")))
    keys = ["capture_id", "url", "fetched_at", "host"]
    each = [F.col(f"c.{c}") for c in keys]
    by_host = known.alias("c").join(rules.alias("r"), (F.col("c.host") == F.col("r.host")) & active).select(*each, F.lit(1).alias("hit"))
    by_path = paths.alias("c").join(urls.alias("r"), (F.col("c.host") == F.col("r.host")) & (F.col("c.path") == F.col("r.path")) & active).select(*each, F.lit(1).alias("hit"))
    found = captures.select(*keys, F.lit(0).alias("hit")).union(by_host).union(by_path)
    return found.groupBy(*keys).agg(F.sum("hit").alias("n_active")).select("capture_id", "host", "n_active", (F.col("n_active") > 0).alias("blocked"))
