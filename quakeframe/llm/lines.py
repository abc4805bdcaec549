"""Line dedup by site-relative frequency.

Rows are pages of a host. For each host and line, the pages that contain the line are divided by the pages of the host;
lines above ``MAX_RATIO`` on at least ``MIN_PAGES`` pages are boilerplate and are dropped from all pages of that host.

At most (lines of a page on average) / MAX_RATIO lines of a host can be boilerplate, so a host's list is short. All
lists together are broadcast while they have at most ``BROADCAST_LINES`` entries of eight bytes; beyond that they are joined by
host, the pages of each host being dealt to ``SALTS`` groups, so that a hot host is no single task.
Counting is combined before the shuffle, so a line that most pages share is one row for each task.

Defined results: lines are compared without outer spaces; blank lines are kept and never counted; a null host is a host of
its own; a null text stays null with no lines; a page with boilerplate alone keeps its row with an empty text; repeated rows
are pages of their own and stay; an empty table gives no rows; columns named like the results, in any case, are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, stored, unused, without

MAX_RATIO, MIN_PAGES, BROADCAST_LINES, SALTS = 0.01, 3, 1_000_000, 64


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = MAX_RATIO, pages: int = MIN_PAGES) -> DataFrame:
    """host and its array of line hashes."""
    pages_of = docs.groupBy(F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(host).isNull().alias("no_host")).agg(F.count(F.lit(1)).alias("host_pages"))
    keys = F.array_distinct(F.transform(F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x) != ""), _key))
    lines = docs.select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(host).isNull().alias("no_host"), F.explode(keys).alias("line"))
    counted = lines.groupBy("host", "no_host", "line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= pages)
    found = counted.join(pages_of, ["host", "no_host"]).where(F.col("pages") > F.lit(ratio) * F.col("host_pages"))
    return found.groupBy("host", "no_host").agg(F.array_sort(F.collect_list("line")).alias("drop"))


def drop_boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = MAX_RATIO, pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES
) -> DataFrame:
    """``docs`` with the text less its boilerplate lines, and n_lines and n_dropped (columns of these names are replaced)."""
    lists = stored(boilerplate(docs, host, text, ratio, pages), "boilerplate")
    size = lists.agg(F.coalesce(F.sum(F.size("drop") + 1), F.lit(0)).alias("n")).first()["n"]
    docs = without(docs, ["n_lines", "n_dropped"])
    h, none, drop, kept_, salt = unused(docs, "__host", "__no_host", "__drop", "__kept", "__salt")
    lists = lists.select(F.col("host").alias(h), F.col("no_host").alias(none), "drop").withColumnRenamed("drop", drop)
    on = (F.coalesce(F.col(host), F.lit("")) == F.col(h)) & (F.col(host).isNull() == F.col(none))
    if size <= broadcast_lines:
        joined = docs.join(F.broadcast(lists), on, "left")
    else:
        # the pages of a host are dealt to SALTS groups, each of which gets the host's list
        salted = docs.withColumn(salt, F.pmod(F.xxhash64(text), F.lit(SALTS)))
        every = lists.withColumn(f"{salt}_of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(every, on & (F.col(salt) == F.col(f"{salt}_of")), "left")
    lines = F.split(F.col(text), "\n")
    kept = F.when(F.col(drop).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col(drop), _key(x)) | (F.trim(x) == "")))
    joined = joined.withColumn(kept_, kept)
    n = F.coalesce(F.size(lines).cast("long"), F.lit(0).cast("long"))
    made = {text: F.array_join(kept_, "\n"), "n_lines": F.when(F.col(text).isNull(), 0).otherwise(n), "n_dropped": F.when(F.col(text).isNull(), 0).otherwise(n - F.size(kept_))}
    return joined.withColumns(made).select(*(quoted(c) for c in docs.columns), "n_lines", "n_dropped")
