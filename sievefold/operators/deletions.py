"""Analytics of the deletion log. A deletion is final for its item; nothing here deletes anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import ancestors
from .scans import running_counts, streak_before

STATUSES = ("deleted", "missing", "changed", "failed")


def item_key(scan: Column, record: Column, seq: Column) -> Column:
    """Scan and record; an event without a record is an item of its own."""
    return F.when(record.isNull(), F.concat(F.lit("#"), seq.cast("string"))).otherwise(F.concat_ws(":", scan.cast("string"), record.cast("string")))


def final_states(events: DataFrame, *key: str) -> DataFrame:
    """One event per key: its first deletion, or else its last attempt. events: status, seq.

    A max over (deleted?, rank) needs no sort and combines in the tasks before the shuffle.
    """
    deleted = F.col("status") == "deleted"
    rank = F.struct(deleted.alias("d"), F.when(deleted, -F.col("seq")).otherwise(F.col("seq")).alias("r"))
    keep = F.struct(*[c for c in events.columns if c not in key])
    return events.groupBy(*key).agg(F.max_by(keep, rank).alias("x")).select(*key, "x.*")


def with_uniqueness(events: DataFrame, *key: str) -> DataFrame:
    """unique: whether the event is its item's first deletion."""
    first = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(F.col("status") == "deleted").over(first), F.lit(False))
    return events.withColumn("unique", (F.col("status") == "deleted") & ~before)


def log_stats() -> list[Column]:
    """attempts, each status, distinct deletions and the bytes that they freed. Needs status, unique, size."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    freed = F.coalesce(F.sum(F.when(F.col("unique"), F.col("size"))), F.lit(0)).cast("long")
    return [F.count("*").alias("attempts"), *counts, F.count_if("unique").alias("unique_deleted"), freed.alias("bytes_deleted")]


def log_summary(events: DataFrame, *groups: Column | str) -> DataFrame:
    return events.groupBy(*groups).agg(*log_stats())


def pending(selected: DataFrame, whole: DataFrame, *key: str) -> DataFrame:
    """Items of a selection, and how many are missing or still in place by the whole log's final state."""
    chosen = selected.select(*key).distinct()
    final = final_states(whole, *key).join(chosen, list(key), "left_semi")
    return final.agg(F.count("*").alias("unique_items"), F.count_if(F.col("status") == "missing").alias("unique_missing"), F.count_if(F.col("status").isin("failed", "changed")).alias("unique_pending"))


def slots(attempts: DataFrame, limit: int, *, group: str, order: str, parts: int | None = None) -> DataFrame:
    """acted: whether an attempt still had a slot: fewer than limit successes and failures before it. attempts: outcome."""
    done = {"_ok": F.col("outcome") == "ok", "_failed": F.col("outcome") == "failed"}
    counted = running_counts(attempts, [group], [F.col(order).asc()], done, parts=parts)
    return counted.withColumn("acted", (F.col("_ok") < limit) & (F.col("_failed") < limit)).drop("_ok", "_failed")


def breakers(attempts: DataFrame, *, run: int = 20, folder_run: int = 5, group: str = "batch", order: str = "seq", parts: int | None = None) -> DataFrame:
    """stopped: after run failures in a row the batch stops; skipped: after folder_run in a folder the folder does."""
    failed, by = F.col("outcome") != "ok", [F.col(order).asc()]
    out = streak_before(attempts, [group], by, failed, run, "stopped", parts=parts)
    return streak_before(out, [group, "folder"], by, failed, folder_run, "skipped", parts=parts)


def decide(files: DataFrame, now: DataFrame) -> DataFrame:
    """What a deletion would come to: deleted, missing, changed or failed, by the state that files have now.

    files: id, size, modified, allowed, protected, expired; now: id, size, modified, is_file.
    """
    current = now.select("id", F.col("size").alias("_size"), F.col("modified").alias("_modified"), "is_file", F.lit(True).alias("_there"))
    same = (F.col("size") == F.col("_size")) & (F.abs(F.unix_millis("modified") - F.unix_millis("_modified")) < 2000)
    plan = (
        F.when(~F.col("allowed") | F.col("protected"), "failed")
        .when(F.col("_there").isNull(), "missing")
        .when(~F.col("is_file"), "failed")
        .when(~F.coalesce(same, F.lit(False)) | ~F.col("expired"), "changed")
        .otherwise("deleted")
    )
    return files.join(current, "id", "left").select("id", plan.alias("plan"))


#: What parts of an item's text are joined by, and how the actor of a scheduled run is written.
SEPARATOR = " › "
SCHEDULED = r'(política de retenção|agendamento) "([^"]+)"'
KINDS = ("local", "onedrive", "sharepoint", "mail", "teams")
RECORD, SCAN, ITEM, PARTS, HOLDS = 0, 10, 20, 30, 40  # ranks of evidence for a kind


def normalised(events: DataFrame) -> DataFrame:
    """events with kind, mailbox, folder, purpose and schedule_name as they are shown, also of rows that lack them.

    events: item, actor, mode, method, and, null where they are not known, scan_kind, target_type, target_mailbox,
    target_folder, schedule, recorded_purpose, and clouds (the kinds of cloud storage that the row's scan holds).
    An item is a path, an address, or parts joined by SEPARATOR: mailbox, folder and subject of a message.
    """
    item, actor = F.coalesce("item", F.lit("")), F.coalesce("actor", F.lit(""))
    parts = F.split(item, SEPARATOR)
    several = F.size(parts) > 1
    single = F.when(F.size(F.array_distinct("clouds")) == 1, F.get("clouds", F.lit(0)))
    personal = item.rlike(r"(?i)-my\.sharepoint\.[a-z.]+/personal/")
    cloud = F.coalesce(single, F.when(personal, "onedrive").when(item.rlike(r"(?i)^https?://[^/]*sharepoint\."), "sharepoint").otherwise("cloud"))
    names = F.coalesce("clouds", F.array().cast("array<string>"))
    is_kind, owner = F.col("scan_kind").eqNullSafe, F.get(parts, F.lit(0))
    # what speaks for a kind, by how much it counts: the record, then the scan, the item as an address or path, its parts, what the scan holds
    evidence = [
        (RECORD, F.col("target_type").isin(*KINDS), F.col("target_type")),
        (RECORD, F.col("target_type") == "cloud", cloud),
        (SCAN, is_kind("mail"), "mail"),
        (SCAN + 1, is_kind("teams") | F.col("method").eqNullSafe("teams"), "teams"),
        (ITEM, item.rlike("(?i)^https?://"), cloud),
        (ITEM + 1, F.col("method").eqNullSafe("file") | item.rlike(r"(?i)^([a-z]:[\\/]|\\\\|/)"), "local"),
        (PARTS, is_kind(None) & (F.size(parts) >= 3) & owner.rlike(r"^[^\s@]+@[^\s@]+$"), "mail"),
        (PARTS + 1, is_kind(None) & several & owner.rlike("(?i)^OneDrive de "), "onedrive"),
        (PARTS + 2, is_kind(None) & several, "cloud"),
        (HOLDS, is_kind("files") & (F.size(names) == 0), "local"),
        (HOLDS + 1, is_kind("files"), cloud),
    ]
    weighed = [F.when(holds, F.struct(F.lit(rank).alias("rank"), (F.lit(k) if isinstance(k, str) else k).alias("kind"))) for rank, holds, k in evidence]
    known = events.withColumn("kind", F.coalesce(F.array_min(F.array(*weighed))["kind"], F.lit("")))
    mail, deep = F.col("kind") == "mail", F.size(parts) > 2
    mailbox = F.coalesce("target_mailbox", F.when(mail & deep, F.get(parts, F.lit(0))), F.lit(""))
    path = F.when(mail, F.when(deep, F.get(parts, F.lit(1)))).when(F.col("kind") == "teams", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), SEPARATOR))
    named = F.nullif(F.regexp_extract(actor, SCHEDULED, 2), F.lit(""))
    retention = F.regexp_extract(actor, SCHEDULED, 1) == "política de retenção"
    purpose = F.coalesce("recorded_purpose", F.when(F.col("schedule").isNull() & retention, "retention"), F.when(F.col("mode") == "retention", "retention"), F.lit(""))
    shown = {"mailbox": mailbox, "folder": F.coalesce("target_folder", path, F.lit("")), "purpose": purpose, "schedule_name": F.coalesce("schedule", named)}
    return known.withColumns(shown)


def _path_key(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"), "/+$", ""))


def with_repositories(events: DataFrame, targets: DataFrame, boxes: DataFrame) -> DataFrame:
    """events with repository and relative_path: the recorded repository, or else the one of the event's scan that its item belongs to.

    events: scan, kind, item, mailbox, recorded (null where the row names none); targets: scan, id, type (a kind of files, or source) and path;
    boxes: source, address. A file belongs to the longest path of its scan that contains it, in any spelling; a message to the only connection
    of the scan that has its mailbox; anything to the only target of its kind. Events of unknown scans have none. Ties go to the smaller id.
    """
    files = targets.where("type <> 'source'").select("scan", "id", F.explode(F.when(F.col("type") == "local", F.array("type")).otherwise(F.array("type", F.lit("cloud")))).alias("kind"))
    sources = targets.where("type = 'source'").select("scan", "id", F.explode(F.array(F.lit("mail"), F.lit("teams"))).alias("kind"))
    only = files.unionByName(sources).groupBy("scan", "kind").agg(F.count("*").alias("_n"), F.min("id").alias("_only")).where("_n = 1").drop("_n")
    # distinct paths of a scan look their ancestors up
    places = events.where("kind = 'local'").select("scan", "item").distinct().withColumn("_key", _path_key(F.col("item")))
    ups = places.withColumn("_up", F.explode(ancestors(F.col("_key"))))
    roots = targets.where("type = 'local' and path <> ''").select("scan", _path_key(F.col("path")).alias("_up"), F.col("id").alias("_root"), F.length(F.regexp_replace("path", r"[\\/]+$", "")).alias("_long"))
    # of targets with the same path only the one that wins the tie, so that an item meets at most one a folder
    roots = roots.groupBy("scan", "_up").agg(F.min_by(F.struct("_root", "_long"), "_root").alias("_r")).select("scan", "_up", "_r.*")
    closest = F.max_by(F.struct("_root", "_long", (F.col("_key") != F.col("_up")).alias("_below")), F.struct(F.length("_up"), -F.col("_root")))
    held = ups.join(roots, ["scan", "_up"]).groupBy("scan", "item").agg(closest.alias("_in"))
    # mailboxes of the scan's connections
    wanted = events.where("kind = 'mail' and mailbox <> ''").select("scan", F.lower("mailbox").alias("_box")).distinct()
    held_by = targets.where("type = 'source'").select("scan", F.col("id").alias("source")).join(boxes.select("source", F.lower("address").alias("_box")).distinct(), "source")
    owners = held_by.join(wanted, ["scan", "_box"], "left_semi")
    owned = owners.groupBy("scan", "_box").agg(F.count("*").alias("_n"), F.min("source").alias("_owner")).where("_n = 1").drop("_n")

    out = events.join(only, ["scan", "kind"], "left").join(held.withColumn("kind", F.lit("local")), ["scan", "item", "kind"], "left")
    out = out.withColumn("_box", F.when(F.col("kind") == "mail", F.lower("mailbox"))).join(owned, ["scan", "_box"], "left")
    found = F.coalesce("recorded", "_in._root", "_only", "_owner")
    below = F.col("recorded").isNull() & F.col("_in._below")
    relative = F.when(below, F.expr("substr(item, _in._long + 2)")).otherwise("")
    return out.select(*events.columns, found.alias("repository"), F.coalesce(relative, F.lit("")).alias("relative_path"))


def bulk_candidates(records: DataFrame, repositories: DataFrame) -> DataFrame:
    """Number of records of a slice that a bulk run may still delete. records: repository, status of the last deletion
    or null; repositories: repository, allow_delete."""
    open_ = ~F.coalesce("status", F.lit("")).isin("deleted", "missing")
    held = records.join(repositories, "repository", "left")
    return held.agg(F.count_if(open_ & F.coalesce("allow_delete", F.lit(False))).alias("candidates"))
