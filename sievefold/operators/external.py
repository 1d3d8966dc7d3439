"""Mail to recipients outside the organisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import email_domain, is_internal
from .reports import top_in_group


def recipients(messages: DataFrame, own: list[str], *, fields: tuple[str, ...] = ("to", "cc", "bcc")) -> DataFrame:
    """A row per message and external address, with the fields that it stands in. Fields are arrays of addresses."""
    def entries(field: str) -> Column:
        return F.transform(F.coalesce(field, F.array().cast("array<string>")), lambda a: F.struct(F.lower(F.trim(a)).alias("address"), F.lit(field).alias("field")))

    every = F.flatten(F.array(*map(entries, fields)))
    each = messages.withColumn("_x", F.explode(every)).where((F.col("_x.address") != "") & ~is_internal(F.col("_x.address"), own))
    kept = [c for c in messages.columns if c not in fields]
    grouped = each.groupBy(*kept, F.col("_x.address").alias("address")).agg(F.array_sort(F.collect_set("_x.field")).alias("fields"))
    return grouped.withColumn("domain", email_domain(F.col("address")))


def by_recipient(pairs: DataFrame) -> DataFrame:
    """pairs: id, mailbox, address, domain, sent."""
    return pairs.groupBy("address", "domain").agg(F.countDistinct("id").alias("messages"), F.countDistinct("mailbox").alias("mailboxes"), F.min("sent").alias("first"), F.max("sent").alias("last"))


def by_domain(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("domain").agg(F.countDistinct("address").alias("recipients"), F.countDistinct("id").alias("messages"), F.min("sent").alias("first"), F.max("sent").alias("last"))


def by_mailbox(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("mailbox").agg(F.countDistinct("id").alias("messages"), F.countDistinct("address").alias("recipients"))


def by_sender(pairs: DataFrame, own: list[str], *, top: int = 5) -> DataFrame:
    """Internal senders: distinct messages (by message_id where there is one), recipients, and the domains most written to."""
    sent = pairs.where(is_internal(F.col("sender"), own))
    key = F.coalesce(F.nullif("message_id", F.lit("")), F.concat_ws(":", "source", "mailbox", F.col("id").cast("string")))
    totals = sent.groupBy("sender").agg(F.countDistinct(key).alias("messages"), F.countDistinct("address").alias("recipients"), F.countDistinct("domain").alias("domains"), F.countDistinct("mailbox").alias("mailboxes"))
    ranked = top_in_group(sent.groupBy("sender", "domain").agg(F.count("*").alias("n")), ["sender"], [F.desc("n"), F.asc("domain")], top)
    listed = ranked.groupBy("sender").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "domain"))), lambda x: x["domain"]), "|").alias("top_domains"))
    return totals.join(listed, "sender")
