"""URL filter with a dated list: every capture is judged by the list as it stood when it was fetched.

Dated entries of a pattern (a host or a parent domain) become validity intervals, one row each. For every day on which
a pattern is asked for, the interval that was open before and those that begin on the day are found; an as-of join by
pattern and day then gives each host and fetch time the interval that holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small, unused


def normal(host: Column) -> Column:
    """Lower-case without a trailing dot; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(host), r"\.$", ""), F.lit(""))


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; null if the URL has none."""
    return normal(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def suffixes(host: Column, most: int | None = None) -> Column:
    """The host and its parent domains down to the last label, longest first; those of at most ``most`` labels if it is given."""
    labels = F.split(host, r"\.")
    first = F.lit(1) if most is None else F.greatest(F.size(labels) - F.lit(most - 1), F.lit(1))
    return F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity(entries: DataFrame) -> DataFrame:
    """``pattern, valid_from, valid_to`` of ``pattern, dated, listed``: from a listing until the pattern's next entry.

    Patterns are compared as hosts are, in lower case and without a trailing dot. ``valid_to`` is exclusive and null
    while open. Of entries with one pattern and date a removal wins; entries without pattern or date say nothing. A
    listing repeated while it holds gives an interval that meets the former.
    """
    said = entries.select(normal(F.col("pattern")).alias("pattern"), "dated", F.coalesce("listed", F.lit(False)).alias("listed"))
    one = said.filter(F.col("pattern").isNotNull() & F.col("dated").isNotNull()).groupBy("pattern", "dated").agg(F.min("listed").alias("listed"))
    following = F.lead("dated").over(Window.partitionBy("pattern").orderBy("dated"))
    return one.withColumn("valid_to", following).filter("listed").select("pattern", F.col("dated").alias("valid_from"), "valid_to")


def _by_day(spans: DataFrame, days: DataFrame) -> DataFrame:
    """``pattern, day, valid_from, valid_to``: the intervals that may hold on each of ``days`` (``pattern, day``).

    Intervals of a pattern don't overlap, so these are the last one that began on an earlier day, and those that begin
    on the day itself: no more rows than days and intervals together.
    """
    begun = spans.withColumn("day", F.unix_date(F.to_date("valid_from")))
    span = F.struct("valid_from", "valid_to")
    marks = begun.select("pattern", "day", span.alias("span"), F.lit(False).alias("asked")).unionByName(days.withColumn("asked", F.lit(True)), allowMissingColumns=True)
    earlier = Window.partitionBy("pattern").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    former = marks.withColumn("last", F.max("span").over(earlier)).filter("asked and last is not null").select("pattern", "day", "last.*")
    return former.unionByName(begun.join(days, ["pattern", "day"], "left_semi"))


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (with ``url, fetched``) plus ``host, blocked, pattern, listed_since``; columns so named are replaced, all
    others stay as they are, whatever their names.

    Of several patterns in force the longest counts. A URL without host and a capture without fetch time are not
    blocked. Rows stay one to one, repeated ones too; either table may be empty. Of a host of very many labels no more are
    looked up than the longest pattern has. Only hosts below a listed pattern are
    looked up, each once per fetch time, and only what is blocked is joined to the captures. Tables are counted before
    they are broadcast; larger ones are joined by shuffle, the captures by host and fetch time, which spreads a hot host.
    """
    rows = captures.drop("host", "blocked", "pattern", "listed_since").withColumn("host", host_of(F.col("url")))
    spans = cut(validity(entries))
    hosts = rows.select("host").filter(F.col("host").isNotNull()).distinct()
    listed = small(cut(spans.select("pattern").distinct()))
    labels = listed.agg(F.max(F.size(F.split("pattern", r"\.")))).first()[0] or 1  # longer parts of a host are on no list
    reach = small(cut(hosts.select("host", F.explode(suffixes(F.col("host"), labels)).alias("pattern")).join(listed, "pattern", "left_semi")))
    asked = rows.select("host", "fetched").filter(F.col("fetched").isNotNull()).join(reach.select("host").distinct(), "host", "left_semi").distinct()
    asked = asked.join(reach, "host").withColumn("day", F.unix_date(F.to_date("fetched")))
    held = small(cut(_by_day(spans, asked.select("pattern", "day").distinct())))
    holds = (F.col("valid_from") <= F.col("fetched")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    (hit,) = unused(rows, "__hit")
    hits = asked.join(held, ["pattern", "day"]).filter(holds).groupBy("host", "fetched")
    hits = hits.agg(F.min(F.struct((-F.length("pattern")).alias("rank"), "pattern", "valid_from")).alias(hit))
    joined = rows.join(small(cut(hits)), ["host", "fetched"], "left")
    return joined.select(
        *[c for c in rows.columns], F.col(hit).isNotNull().alias("blocked"), F.col(f"{hit}.pattern").alias("pattern"), F.col(f"{hit}.valid_from").alias("listed_since")
    )
