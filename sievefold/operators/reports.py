"""Summaries of report rows: groups, counts and sizes. Orders are the caller's, as results are sets of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 500


def by_term(hits: DataFrame, *, unit: str = "files", inside: dict[str, list[str]] | None = None) -> DataFrame:
    """Per term: distinct items, occurrences, and hits by where they are. hits: id, location, term_id, count.

    inside names the columns that count hits of some locations; locations of no list count as the last.
    """
    inside = inside or {"in_name": ["name"], "in_content": []}
    listed = [x for v in inside.values() for x in v]
    at = {k: F.col("location").isin(v) if v else ~F.col("location").isin(listed) for k, v in inside.items()}
    each = hits.groupBy("term_id", "id").agg(F.sum("count").alias("n"), *(F.count_if(c).alias(k) for k, c in at.items()))
    return each.groupBy("term_id").agg(F.count("*").alias(unit), F.sum("n").alias("occurrences"), *(F.sum(k).alias(k) for k in inside))


def counted(df: DataFrame, key: Column, name: str, *, unit: str = "files") -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count("*").alias(unit))


def sized(df: DataFrame, key: Column, name: str, *, size: str = "size") -> DataFrame:
    """count and bytes of each group; sizes that aren't known count as 0."""
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("count"), F.sum(F.coalesce(F.col(size), F.lit(0))).cast("long").alias("bytes"))


def largest(groups: DataFrame, by: str, then: str, tie: str, *, top: int = TOP) -> DataFrame:
    return groups.orderBy(F.desc(by), F.desc(then), tie).limit(top)


def by_user(files: DataFrame) -> DataFrame:
    """Per last user: files, occurrences, and how many files named the user by each source. files: last_user, source, occurrences."""
    user = F.when(F.coalesce("last_user", F.lit("")) == "", F.lit("(não identificado)")).otherwise(F.col("last_user"))
    sources = files.groupBy(user.alias("user"), F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"), F.sum("occurrences").alias("o"))
    text = F.array_join(F.array_sort(F.collect_list(F.when(F.col("source") != "", F.concat_ws("=", "source", F.col("n").cast("string"))))), "|")
    return sources.groupBy("user").agg(F.sum("n").alias("files"), F.sum("o").alias("occurrences"), text.alias("sources"))


def at_locations(hits: DataFrame) -> DataFrame:
    """How many items have a hit at each location."""
    return hits.select("id", "location").distinct().groupBy("location").agg(F.count("*").alias("files"))


def status_totals(df: DataFrame, statuses: tuple[str, ...], *, status: str = "status") -> DataFrame:
    """One row with a count for each status."""
    return df.agg(*(F.count_if(F.col(status) == s).alias(s) for s in statuses))


def message_totals(messages: DataFrame, *groups: str) -> DataFrame:
    """messages, bytes, with attachments, oldest and newest (as text), of all or of each group."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    own = messages.groupBy(*groups) if groups else messages
    return own.agg(
        F.count("*").alias("messages"),
        F.sum(F.length("text")).cast("long").alias("bytes"),
        F.count_if(F.coalesce("attached", F.lit(False))).alias("with_attachments"),
        text(F.min("sent")).alias("oldest"),
        text(F.max("sent")).alias("newest"),
    )


def census(messages: DataFrame, *groups: str) -> DataFrame:
    """Per group: how many, how many without a date, oldest and newest."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return messages.groupBy(*groups).agg(F.count("*").alias("messages"), F.count_if(F.col("sent").isNull()).alias("without_date"), text(F.min("sent")).alias("oldest"), text(F.max("sent")).alias("newest"))


def timeline(messages: DataFrame, *, most_months: int = 24) -> DataFrame:
    """Messages per month, or per year when there are more months than most_months. The choice stays in the plan."""
    months = messages.where("sent is not null").groupBy(F.date_format("sent", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    many = months.agg(F.count("*").alias("k"))
    period = F.when(F.col("k") > most_months, F.substring("month", 1, 4)).otherwise(F.col("month"))
    return months.crossJoin(F.broadcast(many)).groupBy(period.alias("period")).agg(F.sum("n").alias("messages"))


def scan_statistics(files: DataFrame) -> DataFrame:
    """Counters of a scan by what became of each file's content; partial ones count up to the limit."""
    is_ = lambda *s: F.col("status").isin(*s)
    return files.agg(
        F.count("*").alias("seen"),
        F.count_if(is_("ok", "partial")).alias("analysed"),
        F.count_if(is_("partial")).alias("partial"),
        F.count_if(is_("encrypted")).alias("encrypted"),
        F.count_if(is_("skipped-size")).alias("too_large"),
        F.count_if(is_("empty")).alias("empty"),
        F.count_if(is_("error")).alias("errors"),
        F.sum(F.when(is_("ok"), F.col("size")).when(is_("partial"), F.least("size", F.lit(50 * 1048576))).otherwise(0)).cast("long").alias("bytes_analysed"),
    )


def options(df: DataFrame, column: str, *, most: int = TOP) -> DataFrame:
    """Distinct values to choose from, in order."""
    value = F.nullif(F.col(column), F.lit(""))
    return df.select(value.alias("value")).where("value is not null").distinct().orderBy("value").limit(most)


def top_in_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_nth") <= n).drop("_nth")
